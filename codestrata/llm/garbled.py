"""Texts that were decoded with the wrong character encoding.

Every character of a non-ASCII run is mapped back to the byte it has in a
legacy encoding. An automaton over these bytes finds the maximal spans that
are well-formed in the encoding the author used; only these spans are decoded
again, and only if what comes out is ordinary writing. Spans that were decoded
wrongly several times are undone step by step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.runtime import cut_lineage, small_side, spread

# Encodings that texts get read in by mistake, likeliest first.
SINGLE_BYTE = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "iso8859_2"]
# Encodings with one byte a letter that authors used.
AUTHORS = ["cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "mac_roman", "cp850", "iso8859_2", "iso8859_5"]
# Letters and signs of ordinary writing outside ASCII, beside Cyrillic, kana and ideographs.
LATIN = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿŒœŸĄąĆćĘęŁłŃńŚśŹźŻżČčĎďĚěŇňŘřŠšŤťŮůŽžŐőŰűĂăȘșȚțŞşĞğİı"
SIGNS = "    ­¡¿§°«»‘’‚“”„–—…•·→←↑↓⇒€£©®™№×÷½¼¾²³ªº±µ‹›✅✓✗≤≥≠≈−∂∆∑πΩ∞√∫†‡‰⚠"
BROKEN = "�"  # what decoders put where bytes fit nothing
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_UTF8 = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
DEEPEST = 4  # decodings on top of each other that are undone


@lru_cache
def to_bytes(codec: str) -> dict[int, int]:
    """Character to byte. Bytes the encoding leaves open keep their number, as lenient decoders do."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = b
    if codec == "cp1252":  # Latin-1 differs in 0x80 to 0x9f only
        for b in range(128, 160):
            out.setdefault(b, b)
    return out


@lru_cache(maxsize=65536)
def ordinary(c: str) -> bool:
    o = ord(c)
    return (
        c in LATIN or c in SIGNS or 0x410 <= o <= 0x44F or o in (0x401, 0x451)
        or 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xFF01 <= o <= 0xFF5E or 0x2500 <= o <= 0x257F
        or 0x1F300 <= o <= 0x1FAFF or 0xAC00 <= o <= 0xD7A3 or 0x391 <= o <= 0x3C9
    )


def _one_of(codec: str, *ranges: tuple[int, int]) -> str:
    """The characters whose bytes lie in these ranges, as a class of an expression."""
    return "[" + "".join(re.escape(chr(c)) for c, b in to_bytes(codec).items() if any(x <= b <= y for x, y in ranges)) + "]"


@lru_cache
def _begins(codec: str) -> re.Pattern:
    """How every well-formed span begins: a first byte, then a continuation."""
    return re.compile(_one_of(codec, (0xC2, 0xF4)) + _one_of(codec, (0x80, 0xBF)))


def spans(text: str, codec: str) -> Iterator[tuple[int, int, str]]:
    """start, end, and the UTF-8 reading of the maximal well-formed byte spans of `text` under `codec`."""
    if not _begins(codec).search(text):
        return
    table = to_bytes(codec)
    for run in _RUN.finditer(text):
        s = run[0]
        raw = bytes(map(table.get, map(ord, s), [0] * len(s)))
        for hit in _UTF8.finditer(raw):
            yield run.start() + hit.start(), run.start() + hit.end(), hit[0].decode("utf-8", "replace")


def repair_once(text: str) -> tuple[str, int]:
    """Undo one level; the text and how many spans were decoded."""
    best: dict[int, tuple[int, int, str]] = {}
    for rank, codec in enumerate(SINGLE_BYTE):
        for a, b, new in spans(text, codec):
            old = text[a:b]
            if not all(ordinary(c) or c in _RESIDUE for c in new) or not plausible(old, new, text, a, b, rank):
                continue
            best.setdefault(a, (b, rank, new))
    if not best:
        return text, 0
    out, at, n = [], 0, 0
    for a in sorted(best):
        b, _, new = best[a]
        if a < at:
            continue
        out += [text[at:a], new]
        at, n = b, n + 1
    return "".join(out) + text[at:], n


# Characters that a correct step may leave behind when a text was decoded wrongly twice.
_RESIDUE = frozenset("".join(bytes([b]).decode(c, "ignore") for c in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250") for b in range(128, 256)) + "".join(map(chr, range(128, 160))))


def plausible(old: str, new: str, text: str, a: int, b: int, rank: int) -> bool:
    """Whether the span is better writing once decoded."""
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    if all("\u2500" <= c <= "\u259f" for c in old):  # a drawing, unless it stands in a word
        if new in ("¿", "¡"):
            return after.isalpha() and not before.isalnum()
        return new.isalpha() and (len(new) > 1 or ((before.isalpha() or after.isalpha()) and not ("\u2500" <= after <= "\u259f")))
    if len(new) > 1 or len(old) > 2:
        return True
    if old[1] in "»”’“›" and (old[0].isupper() or SINGLE_BYTE[rank] == "cp1251") and before.isalpha() and not after.isalpha():
        return before.islower()  # a capital letter before a closing quote stands in words of capitals
    return SINGLE_BYTE[rank] in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250")


# Japanese in two other encodings, read as cp1252: kana, common ideographs and punctuation only.
_SJIS = re.compile(rb"(?:[\x81-\x83\x88-\x97][\x40-\x7e\x80-\xfc])(?:[\x81-\x83\x88-\x97][\x40-\x7e\x80-\xfc]|[\xe0-\xea][\x9f-\xfc])+")
_EUC = re.compile(rb"(?:[\xa1\xa4\xa5\xb0-\xcf][\xa1-\xfe]){2,}")
_SJIS_BEGINS = re.compile(_one_of("cp1252", (0x81, 0x83), (0x88, 0x97)) + "(?:[@-~]|" + _one_of("cp1252", (0x80, 0xFC)) + ")" + _one_of("cp1252", (0x81, 0x83), (0x88, 0x97), (0xE0, 0xEA)))
_EUC_BEGINS = re.compile(_one_of("cp1252", (0xA1, 0xCF)) + _one_of("cp1252", (0xA1, 0xFE)) + "{3}")
# UTF-8 read as a two-byte encoding leaves runs of rare ideographs.
_WIDE = re.compile(r"[\u2010-\u9fff\uff61-\uff9f]{2,}")


def repair_wide(text: str, codecs: tuple[str, ...] = ("euc_jp", "shift_jis")) -> tuple[str, int]:
    """Undo decodings in which one side has two bytes a character."""
    hits = []
    forms = [f for f in (("euc_jp", _EUC, _EUC_BEGINS), ("shift_jis", _SJIS, _SJIS_BEGINS)) if f[0] in codecs and f[2].search(text)]
    if forms:
        table = to_bytes("cp1252")
        raw = bytes([o if o < 128 else table.get(o, 0) for o in map(ord, text)])
        japanese = re.search("[\u3040-\u30ff]", text) is not None
        for codec, form, _ in forms:
            for m in form.finditer(raw):
                old = text[m.start() : m.end()]
                if codec == "euc_jp" and (raw[m.start() - 1 : m.start()] > b"\x7f" or raw[m.end() : m.end() + 1] > b"\x7f"):
                    continue  # part of a run that is something else
                try:
                    new = m[0].decode(codec)
                except UnicodeDecodeError:
                    continue
                odd = sum(not c.isalpha() or "\u0080" <= c <= "\u009f" for c in old if c > "\x7f")
                wide = sum(c > "\u3000" for c in new)
                if wide == len(new) and odd and not old.isascii() and (len(new) >= 3 or japanese or "\u0080" <= min(c for c in old if c > "\x7f") <= "\u009f"):
                    hits.append((m.start(), m.end(), new))
    for m in _WIDE.finditer(text):
        for codec in ("cp932", "gbk"):
            try:
                new = m[0].encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if len(new) < len(m[0]) and all(map(ordinary, new)):
                hits.append((m.start(), m.end(), new))
                break
    out, at = [], 0
    for a, b, new in sorted(hits):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join(out) + text[at:], len(hits)


def repair(text: str | None) -> tuple[str | None, int, bool]:
    """The text as its author wrote it as far as it can be told, the number of
    spans decoded, and whether anything is lost. Null and empty texts are as they are."""
    if not text or text.isascii():
        return text, 0, False
    text, total = repair_wide(text, ("euc_jp",))  # its bytes can look like UTF-8 here and there, hardly ever the other way round
    for _ in range(DEEPEST):
        text, n = repair_once(text)
        if not n:
            text, n = repair_wide(text)
        total += n
        if not n:
            break
    return text, total, BROKEN in text


# A word with letters outside ASCII, as it stands between spaces, digits and ASCII signs.
_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]*[^\x00-\x7f\s][^\x00-\x40\x5b-\x60\x7b-\x7f\s]*")
LONGEST_WORD = 40  # writing without spaces is no list of words


def _word(m: re.Match) -> str:
    """A word as it is counted: of a sign before a number the sign and a 0."""
    return m[0] + "0" if len(m[0]) == 1 and m.string[m.end() : m.end() + 1].isdigit() else m[0]


def words(text: str | None) -> list[str]:
    """The distinct words of a text that aren't all ASCII."""
    if not text or text.isascii():
        return []
    return sorted({_word(m) for m in _WORD.finditer(text) if m.end() - m.start() <= LONGEST_WORD})


def reworded(text: str, meant: dict[str, str]) -> str:
    """A text with words replaced."""
    return _WORD.sub(lambda m: meant[w][: len(meant[w]) - len(w) + len(m[0])] if (w := _word(m)) in meant else m[0], text)


PAIRS = [(read, wrote) for read in SINGLE_BYTE for wrote in AUTHORS if wrote != read]


def reading(word: str, read: str, wrote: str) -> str | None:
    """What a word was, if `wrote` was taken for `read`; None if that can't be or changes nothing."""
    table = to_bytes(read)
    if not all(ord(c) < 128 or ord(c) in table for c in word):
        return None
    try:
        new = bytes([o if o < 128 else table[o] for o in map(ord, word)]).decode(wrote)
    except UnicodeDecodeError:
        return None
    return new if new != word and all(c < "\x80" or ordinary(c) for c in new) else None


def readings(word: str) -> dict[str, list[int]]:
    """What a word may have been, if one single-byte encoding was taken for another, and the pairs of encodings that say so."""
    out: dict[str, list[int]] = {}
    for k, pair in enumerate(PAIRS):
        if (new := reading(word, *pair)) is not None:
            out.setdefault(new, []).append(k)
    return out


def inspect(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `copy`, `n_spans`, `lost`, `words` of every row: a hash that copies
    share, spans decoded again, whether characters are lost for good, and the
    words left outside ASCII."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, lost, left = [], [], []
            for t in b.column(2).to_pylist():
                new, spans_, gone = repair(t)
                n.append(spans_)
                lost.append(gone)
                left.append(words(new))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(lost, pa.bool_()), pa.array(left, pa.list_(pa.string()))], names=[key, "copy", "n_spans", "lost", "words"])

    return spread(df.select(key, F.xxhash64(text).alias("copy"), text)).mapInArrow(run, f"`{key}` {kind}, copy long, n_spans int, lost boolean, words array<string>")


SHARE = 4  # a word is taken for another one that stands in so many times as many documents
LONE_SHARE = 50  # the same for a single letter


def texts_of(inspected: DataFrame) -> DataFrame:
    """`copy`, `words`, `rows` of every distinct text that has such words."""
    return cut_lineage(inspected.where(F.size("words") > 0).groupBy("copy").agg(F.first("words").alias("words"), F.count("*").alias("rows")))


def swapped_words(per_text: DataFrame) -> DataFrame:
    """`word`, `meant`, `pairs`: words that stand for one that is far commoner in
    the whole collection and differs by nothing but the encoding it was read in.

    Commoner by distinct texts: however often a garbled text is copied, it counts
    once. Where these don't say the contrary, by rows too, but of the texts
    without a word found so. A lone letter must be rarer by LONE_SHARE than what
    is meant, a letter or a dash. A meaning in the word's own script goes first.
    """
    counts = per_text.select("rows", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        for b in batches:
            rows = [(w, n, k, r, p) for w, n, k in zip(*(c.to_pylist() for c in b.columns)) for r, p in readings(w).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["word", "n", "rows", "meant", "pairs"])

    may_be = counts.mapInArrow(run, "word string, n long, rows long, meant string, pairs array<int>")
    def commoner(meant: str, n: str):
        lone = F.col("word").rlike(r"\p{L}") & F.col("meant").rlike("[\\p{L}\u2013\u2014]") & (F.col(meant) >= LONE_SHARE * F.col(n))
        return (F.col(meant) >= 2) & (F.col(meant) >= SHARE * F.col(n)) & ((F.length("word") > 1) | lone)

    may_be = cut_lineage(may_be.join(counts.select(F.col("word").alias("meant"), F.col("n").alias("n_meant")), "meant"))
    by_texts = may_be.where(commoner("n_meant", "n")).withColumn("rows_meant", F.lit(0).cast("long"))
    uses = per_text.select("copy", "rows", F.explode("words").alias("word"))
    found = uses.join(small_side(by_texts.select("word").distinct()), "word", "left_semi").select("copy").distinct()
    clean = uses.join(small_side(found), "copy", "left_anti").groupBy(F.col("word").alias("meant")).agg(F.sum("rows").alias("rows_meant"))
    by_rows = may_be.join(clean, "meant").where(commoner("rows_meant", "rows") & (F.col("n_meant") >= F.col("n")))
    hit = by_texts.unionByName(by_rows)
    script = F.col("word").rlike(r"\p{IsCyrillic}") == F.col("meant").rlike(r"\p{IsCyrillic}")
    best = hit.groupBy("word").agg(F.max(F.struct(script.alias("script"), "n_meant", "rows_meant", "meant", "pairs")).alias("b"))
    return best.select("word", F.col("b.meant").alias("meant"), F.col("b.pairs").alias("pairs"))


def swaps_of_texts(texts: DataFrame) -> DataFrame:
    """`copy`, `word`, `meant` of the words that are swapped in a text.

    A text with a word of swapped_words() was read in the pair of encodings that
    explains most such words in it, lone letters and signs aside; its words are
    read so first. So were its other words, however rare: all of them, or, if
    some are commoner as they are in the texts without such words (it is garbled
    in part only), those that are commoner as the pair has them.
    """
    uses = texts.select("copy", F.explode("words").alias("word"))
    certain = cut_lineage(uses.join(small_side(swapped_words(texts)), "word").select("copy", "word", "meant", "pairs"))
    votes = certain.where(~F.col("word").rlike("^.0?$")).select("copy", F.explode("pairs").alias("pair")).groupBy("copy", "pair").agg(F.count("*").alias("n"))
    pair = small_side(votes.groupBy("copy").agg(F.max_by("pair", F.struct("n", -F.col("pair"))).alias("pair")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, w, r) for c, k, ws in zip(*(c.to_pylist() for c in b.columns)) for w in ws if (r := reading(w, *PAIRS[k])) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["copy", "word", "meant"])

    paired = cut_lineage(texts.join(pair, "copy").select("copy", "pair", "words").mapInArrow(run, "copy long, word string, meant string"))
    told = certain.select("copy", "word", "meant").join(paired.withColumnRenamed("meant", "as_paired"), ["copy", "word"], "left")
    told = told.select("copy", "word", F.coalesce("as_paired", "meant").alias("meant"))
    rest = paired.join(certain.select("copy", "word"), ["copy", "word"], "left_anti")
    clean = uses.join(pair, "copy", "left_anti").groupBy("word").agg(F.count("*").alias("n"))
    rest = rest.join(clean.withColumnRenamed("n", "n_word"), "word", "left").join(clean.select(F.col("word").alias("meant"), F.col("n").alias("n_meant")), "meant", "left").fillna(0, ["n_word", "n_meant"])
    whole = F.min(F.col("n_word") <= F.col("n_meant")).over(W.partitionBy("copy"))
    rest = rest.withColumn("whole", whole).where(F.col("whole") | (F.col("n_meant") > F.col("n_word")))
    return told.unionByName(rest.select("copy", "word", "meant"))


def garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `n_spans`, `lost`, `swapped` (array of word and meaning) of every
    row that holds garbled text.

    Null, empty and ASCII texts are never garbled. A key that repeats comes
    out once, with the greatest figures of its rows. The counts of words cover
    all distinct texts.
    """
    seen = cut_lineage(inspect(df, key, text))
    swaps = swaps_of_texts(texts_of(seen))
    per_row = seen.select(key, "copy").distinct().join(swaps, "copy").groupBy(key).agg(F.sort_array(F.collect_set(F.struct("word", "meant"))).alias("swapped"))
    direct = seen.where((F.col("n_spans") > 0) | F.col("lost")).groupBy(key).agg(F.max("n_spans").alias("n_spans"), F.max("lost").alias("lost"))
    both = direct.join(per_row, key, "full_outer")
    return both.select(key, F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("lost", F.lit(False)).alias("lost"), "swapped")


def restore(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `fixed`, `lost` of the garbled rows: the text as it was written,
    as far as that can be told."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col(text).alias("_t")).join(garbled(df, key, text).select(key, "swapped"), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed, lost = [], []
            for t, swaps in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                new, _, gone = repair(t)
                meant = {s["word"]: s["meant"] for s in swaps or ()}
                fixed.append(reworded(new, meant) if meant else new)
                lost.append(gone)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fixed, pa.string()), pa.array(lost, pa.bool_())], names=[key, "fixed", "lost"])

    return rows.mapInArrow(run, f"`{key}` {kind}, fixed string, lost boolean")
