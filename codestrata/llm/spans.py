"""Long verbatim spans that texts share.

A text is cut into sentences at positions its own characters decide: where
the hash of the next GRAM characters is the least within WINDOW positions. So
shared text is cut alike wherever it stands, in one line or many. Every run of
RUN consecutive sentences is hashed; texts that share a run are compared along
the diagonals of their shared runs.

Nothing is missed: in a shared span of L characters all cuts at least WINDOW-1
positions from its ends are the same in both texts, and cuts are never more
than WINDOW apart. With (RUN + 3) * WINDOW + GRAM - 3 <= L a whole run lies
among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.runtime import cut_lineage

GRAM, WINDOW, RUN = 20, 36, 2
LEAST = 200
CHARS_AT_ONCE = 500_000
HOT = 64  # places at which a run may stand before longer keys are taken
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def guaranteed(gram: int = GRAM, window: int = WINDOW, run: int = RUN) -> int:
    """The length from which shared spans are always found."""
    return (run + 3) * window + gram - 3


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
        _POWERS["down"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BACK, np.uint64))])
    return _POWERS["up"], _POWERS["down"]


class Hashes:
    """Hashes of any stretch of a text in constant time."""

    def __init__(self, chars: np.ndarray):
        up, self.down = _powers(len(chars) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the stretches from a to b, b excluded."""
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] ^ (b - a).astype(np.uint64))


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    step, out = 1, x
    while step * 2 <= w:
        out = f(out[:-step], out[step:])
        step *= 2
    return f(out[: len(out) - (w - step)], out[w - step :]) if w > step else out


def cuts(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that hold the least value of a window; all of equal ones."""
    if len(h) < window:
        return np.flatnonzero(h == h.min()) if len(h) else np.empty(0, np.int64)
    least = _sliding(h, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), window, np.maximum) == h)


def runs_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """number of the text, position, hash of every run, a few texts at once."""
    group: list[int] = []
    size = 0
    for i, t in enumerate([*texts, None]):
        if group and (t is None or size + len(t) > CHARS_AT_ONCE):
            yield _runs(group, [texts[g] for g in group])
            group, size = [], 0
        if t is not None:
            group.append(i)
            size += len(t)


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _runs(numbers: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    chars = _chars("".join(texts))
    none = np.empty(0, np.int64)
    if len(chars) < GRAM:
        return none, none, none
    hashes = Hashes(chars)
    at = np.arange(len(chars) - GRAM + 1)
    h = hashes.of(at, at + GRAM)
    row = np.repeat(np.arange(len(texts)), sizes)
    whole = row[at] == row[at + GRAM - 1]
    h[~whole] = np.uint64(2**64 - 1)
    c = cuts(h)
    c = c[whole[c]]
    if len(c) <= RUN:
        return none, none, none
    a, b = c[:-RUN], c[RUN:] + GRAM
    same = row[a] == row[b - 1]
    a, b = a[same], b[same]
    return np.array(numbers)[row[a]], (a - starts[row[a]]).astype(np.int32), hashes.of(a, b).view(np.int64)


def stretches(a: str, b: str, shifts: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the maximal equal stretches of at
    least `least` characters whose start in a lies `shift` after that in b."""
    x, y, out = _chars(a), _chars(b), []
    for s in shifts:
        i, j = max(s, 0), max(-s, 0)
        n = min(len(x) - i, len(y) - j)
        if n < least:
            continue
        edge = np.flatnonzero(np.concatenate([[True], x[i : i + n] != y[j : j + n], [True]]))
        gap = np.diff(edge) - 1
        for k in np.flatnonzero(gap >= least):
            out.append((int(i + edge[k]), int(j + edge[k]), int(gap[k])))
    return out


def text_classes(df: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(`cid`, `text`), one row per distinct text of at least `least`
    characters, and (`cid`, key) of its distinct keys."""
    long = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.char_length("_text") >= least).withColumn("_print", F.unhex(F.md5(F.col("_text").cast("binary"))))
    first = long.groupBy("_print").agg(F.first("_text").alias("text")).withColumn("cid", F.monotonically_increasing_id())
    kept = cut_lineage(first)
    members = long.select("_print", "_key").distinct().join(kept.select("_print", "cid"), "_print").select("cid", F.col("_key").alias(key))
    return kept.select("cid", "text"), members


def _run_table(classes: DataFrame) -> DataFrame:
    """`cid`, `run`, `pos` of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for n, pos, h in runs_of(texts):
                yield pa.RecordBatch.from_arrays([pa.array(ids[n]), pa.array(h), pa.array(pos)], names=["cid", "run", "pos"])

    return classes.mapInArrow(run, "cid long, run long, pos int")


def _long_keys(classes: DataFrame, hot: DataFrame, least: int) -> DataFrame:
    """`cid`, `run`, `pos` of the stretches of `least` characters around hot
    runs. Texts that share such a key do share a long span, so a run that
    stands in very many texts gives no more pairs than there are."""
    places = hot.groupBy("cid").agg(F.sort_array(F.collect_set("pos")).alias("places")).join(classes, "cid").select("cid", "places", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, places_, t in zip(*(c.to_pylist() for c in b.columns)):
                hashes, n = Hashes(_chars(t)), len(t)
                at = np.unique(np.concatenate([np.arange(max(0, p - least), min(p, n - least) + 1) for p in places_]))
                at = at[at + least <= n]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cid)), pa.array(hashes.of(at, at + least).view(np.int64)), pa.array(at.astype(np.int32))], names=["cid", "run", "pos"])

    return places.mapInArrow(run, "cid long, run long, pos int")


def _paired(runs: DataFrame, star: bool = False) -> DataFrame:
    """`a`, `b`, `shift` of the texts that have a key in common. With `star`,
    where a key is long enough by itself, every place is set against one place
    of the other text instead of all."""
    one = runs.groupBy("run", "cid").agg(F.collect_list("pos").alias("at"))
    a = one.select("run", F.col("cid").alias("a"), F.col("at").alias("at_a"))
    b = one.select("run", F.col("cid").alias("b"), F.col("at").alias("at_b"))
    if star:
        shifts = F.concat(F.transform("at_a", lambda x: x - F.array_min("at_b")), F.transform("at_b", lambda y: F.array_min("at_a") - y))
    else:
        shifts = F.flatten(F.transform("at_a", lambda x: F.transform("at_b", lambda y: x - y)))
    return a.join(b, "run").where("a < b").select("a", "b", F.explode(F.array_distinct(shifts)).alias("shift"))


def shared_spans(classes: DataFrame, least: int = LEAST) -> DataFrame:
    """`a`, `b`, `start_a`, `start_b`, `length`: the maximal stretches of at
    least `least` characters that two distinct texts have in common."""
    if least < guaranteed():
        raise ValueError(f"spans under {guaranteed()} characters may be missed")
    runs = _run_table(classes)
    counts = runs.groupBy("run").agg(F.count("*").alias("n"), F.min("cid").alias("least"), F.max("cid").alias("most")).where("least < most")
    # What several texts have is little; the runs themselves are made twice rather than kept.
    several = cut_lineage(runs.join(counts.select("run", "n"), "run"))
    plain, hot = several.where(F.col("n") <= HOT).drop("n"), several.where(F.col("n") > HOT).drop("n")
    shifts = _paired(plain).unionByName(_paired(_long_keys(classes, hot, least), star=True))
    pairs = shifts.groupBy("a", "b").agg(F.collect_set("shift").alias("shifts"))
    left = classes.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = classes.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "shifts", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, s, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(a, b, *hit) for hit in stretches(x, y, s, least)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["a", "b", "start_a", "start_b", "length"])

    return full.mapInArrow(run, "a long, b long, start_a int, start_b int, length int")


def current_nodes(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """The nodes of the scans that readers see."""
    return nodes.select("id", "scan_id", "source_code").join(current.select("scan_id").distinct(), "scan_id", "left_semi").select("id", "source_code")


def sharing_pairs(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """`a`, `b` (a < b): all pairs of keys whose texts share a span of at least
    `least` characters.

    Copies are compared once, as one text, and expanded at the end, as pairs
    of keys are asked for. Null and shorter texts share nothing. Repeated rows
    of a key count once; keys must not stand for different texts.
    """
    classes, members = text_classes(df, key, text, least)
    links = shared_spans(classes, least).select("a", "b").distinct()
    m, w = members.select("cid", F.col(key).alias("k")), members.select(F.col("cid").alias("cid2"), F.col(key).alias("k2"))
    apart = links.join(m, F.col("a") == F.col("cid")).join(w, F.col("b") == F.col("cid2")).select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"))
    alike = m.join(w, F.col("cid") == F.col("cid2")).where("k < k2").select(F.col("k").alias("a"), F.col("k2").alias("b"))
    return apart.unionByName(alike)


def _sides(spans: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """`cid`, `other`, `s`, `length`, `later` of both sides of every span: later
    where the other text's least key is less."""
    first = members.groupBy("cid").agg(F.min(key).alias("_f"))
    both = spans.select(F.col("a").alias("cid"), F.col("b").alias("other"), F.col("start_a").alias("s"), "length").unionByName(spans.select(F.col("b").alias("cid"), F.col("a").alias("other"), F.col("start_b").alias("s"), "length"))
    own, theirs = first.select("cid", F.col("_f").alias("_own")), first.select(F.col("cid").alias("other"), F.col("_f").alias("_theirs"))
    return both.join(own, "cid").join(theirs, "other").select("cid", "other", "s", "length", (F.col("_theirs") < F.col("_own")).alias("later"))


def shared_amount(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """`key`, `n_chars`, `n_shared`, `n_later`, `n_partners` of every key whose
    text shares a span: how many of its characters also stand in another text,
    how many of them stand in one with a lesser key too and could be removed,
    and how many other texts share them. In a class of copies every character
    is shared, and all but the least key are later."""
    classes, members = text_classes(df, key, text, least)
    sides = cut_lineage(_sides(cut_lineage(shared_spans(classes, least)), members, key))
    covered = _union_length(sides, "n_shared").join(_union_length(sides.where("later"), "n_later"), "cid", "left").join(sides.groupBy("cid").agg(F.count_distinct("other").alias("n_partners")), "cid")
    sizes = members.groupBy("cid").agg(F.count("*").alias("copies"), F.min(key).alias("first"))
    base = members.join(sizes, "cid").join(classes.select("cid", F.char_length("text").alias("n_chars")), "cid").join(covered, "cid", "left").where((F.col("copies") > 1) | F.col("n_shared").isNotNull())
    again = (F.col("copies") > 1) & (F.col(key) != F.col("first"))
    return base.select(
        key, "n_chars", F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("n_shared")).cast("long").alias("n_shared"),
        F.when(again, F.col("n_chars")).otherwise(F.coalesce("n_later", F.lit(0))).cast("long").alias("n_later"), F.coalesce("n_partners", F.lit(0)).alias("n_partners"))


def sentences(text: str) -> list[int]:
    """Where the sentences of a text begin, and its end."""
    chars = _chars(text)
    at = np.arange(max(0, len(chars) - GRAM + 1))
    inner = cuts(Hashes(chars).of(at, at + GRAM)) if len(at) else np.empty(0, np.int64)
    return sorted({0, len(chars), *inner.tolist()})


def without(text: str, islands: list[tuple[int, int]]) -> tuple[str, int]:
    """A text without the sentences that lie whole in an island, which don't
    overlap and are in order, and how many characters are gone."""
    ends, out, k = sentences(text), [], 0
    for a, b in zip(ends, ends[1:]):
        while k < len(islands) and islands[k][1] < b:
            k += 1
        if k == len(islands) or not islands[k][0] <= a:
            out.append(text[a:b])
    kept = "".join(out)
    return kept, len(text) - len(kept)


def without_repeats(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """`key`, `kept`, `n_removed` of every key whose text loses something: each
    sentence covered by a span that a text with a lesser key has too.

    Of copies the least key keeps its text as far as it is new, the others
    keep nothing. So every sentence of a repeated span stays in its first
    text. Null and shorter texts, and those without repeats, give no row.
    """
    classes, members = text_classes(df, key, text, least)
    later = _sides(cut_lineage(shared_spans(classes, least)), members, key).where("later")
    order = W.partitionBy("cid").orderBy("s", "length")
    before = F.max(F.col("s") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = later.withColumn("_new", F.coalesce(F.col("s") > before, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    islands = runs.groupBy("cid", "_run").agg(F.min("s").alias("start"), F.max(F.col("s") + F.col("length")).alias("end"))
    per = islands.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("islands"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [without(t, [(i["start"], i["end"]) for i in x]) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], names=["cid", "kept", "n_removed"])

    cut = classes.join(per, "cid").select("cid", "text", "islands").mapInArrow(run, "cid long, kept string, n_removed long")
    first = members.groupBy("cid").agg(F.min(key).alias("_f"))
    copies = members.join(first, "cid").where(F.col(key) != F.col("_f")).join(classes.select("cid", F.char_length("text").cast("long").alias("n_removed")), "cid").select(key, F.lit("").alias("kept"), "n_removed")
    leads = first.select("cid", F.col("_f").alias(key)).join(cut, "cid").where("n_removed > 0").select(key, "kept", "n_removed")
    return leads.unionByName(copies)


def _union_length(sides: DataFrame, name: str) -> DataFrame:
    """Characters covered by the spans of each text, each counted once."""
    order = W.partitionBy("cid").orderBy("s")
    reach = F.coalesce(F.max(F.col("s") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sides.withColumn("fresh", F.greatest(F.lit(0), F.col("s") + F.col("length") - F.greatest("s", reach))).groupBy("cid").agg(F.sum("fresh").alias(name))
