"""Oversized texts cut into overlapping pieces at natural boundaries.

One regular expression consumes a text piece by piece. Its alternatives are
ordered by the strength of the boundary they end at, each may take up to the
limit, and the last takes any character. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_LIMIT, CHUNK_LIMIT, OVERLAP = 6000, 1500, 200
_END = r"(?:\r\n|[\n\r\u0085\u2028\u2029])"
_WHOLE = r"(?!(?<=\r)\n)"  # never between the two halves of a line end
# Boundaries from strong to weak, as what stands before and after the cut.
BOUNDARIES = [
    rf"(?<={_END})(?={_END})",  # before a blank line
    rf"(?<=[}}\])][;,)]?{_END})",  # after a block's end
    rf"(?<=[;:,.{{}}>。]{_END})",  # after a statement's end
    rf"(?<={_END}){_WHOLE}",  # after any line
    r"(?<=[;}。.!?])(?!\w)",  # after a statement within a line
    r"(?<=[,)\]>])",
    r"(?<=\s)(?=\S)",
    r"\b",
]


def pattern(core: int) -> str:
    """The expression whose successive matches are pieces of at most `core`
    characters; a boundary is sought in the latter half of the room left."""
    low = max(1, core // 2)
    ways = [rf".{{1,{core}}}\z", *[rf".{{{low},{core}}}{_WHOLE if b != BOUNDARIES[3] else ''}{b}" for b in BOUNDARIES], rf".{{1,{core}}}{_WHOLE}", rf".{{1,{core}}}"]
    return "(?s)" + "|".join(ways)


def pieces(text: Column, limit: int, overlap: int = OVERLAP) -> Column:
    """array<struct<chunk_index, start, overlap, piece>> of a text column.

    Lengths are Unicode code points. A text within the limit is one piece; an
    empty one is one empty piece, null gives null. Every piece is at most
    `limit` long; piece[overlap:] of all pieces, in order, is the text again.
    The overlap begins at a line's start where one lies within reach.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    core = limit - overlap
    # Beyond the basic plane characters are two units in the JVM: lengths are found on a stand-in of equal length.
    flat = F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "")
    found = F.regexp_extract_all(flat, F.lit(pattern(core)), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,piece:string>>").alias("out"))
    placed = F.aggregate(
        found, zero,
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), p.alias("piece")))).alias("out")),
    )["out"]
    cores = F.when(flat == text, placed).otherwise(F.transform(placed, lambda p: F.struct(p["start"].alias("start"), F.substring(text, p["start"] + 1, F.length(p["piece"])).alias("piece"))))
    # Each piece is zipped with the one before it: a lambda that looked back into `cores` would make it anew for every piece.
    none = F.array(F.lit(None).cast("struct<start:int,piece:string>"))
    paired = F.zip_with(cores, F.slice(F.concat(none, cores), F.lit(1), F.size(cores)), lambda p, q: F.struct(p.alias("p"), q["piece"].alias("before")))
    many = F.transform(paired, lambda x, i: _with_lookback(x["p"], x["before"], i, overlap))
    one = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("start"), F.lit(0).alias("overlap"), text.alias("piece")))
    return F.when(text.isNull(), None).when(F.char_length(text) <= limit, one).otherwise(many)


def _with_lookback(p: Column, before: Column, i: Column, overlap: int) -> Column:
    tail = F.coalesce(F.right(before, F.lit(overlap)), F.lit("")) if overlap else F.lit("")
    # Drop a partial first line, unless nothing would be left.
    tail = F.regexp_replace(tail, r"(?s)\A[^\r\n]*(?:\r\n|[\r\n])(?=.)", "")
    return F.struct(i.alias("chunk_index"), (p["start"] - F.char_length(tail)).alias("start"), F.char_length(tail).alias("overlap"), F.concat(tail, p["piece"]).alias("piece"))


def oversized(records: DataFrame, text: str, keys: list[str], limit: int, overlap: int = OVERLAP) -> DataFrame:
    """The records cut because their text is over the limit: `keys`, `pieces`.

    Null and short texts give no row; repeated rows come out once per distinct
    `keys`. Columns other than keys and text are not read.
    """
    cut = records.select(*keys, F.col(text).alias("_text")).where(F.char_length("_text") > limit).dropDuplicates(keys)
    return cut.select(*keys, pieces(F.col("_text"), limit, overlap).alias("pieces"))


def split_records(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """`rec_kind`, `rec_id`, `pieces` of the nodes and chunks over their limits."""
    n = oversized(nodes.select(F.lit("node").alias("rec_kind"), F.col("id").alias("rec_id"), F.col("source_code").alias("text")), "text", ["rec_kind", "rec_id"], NODE_LIMIT)
    c = oversized(chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"), F.col("chunk_text").alias("text")), "text", ["rec_kind", "rec_id"], CHUNK_LIMIT)
    return n.unionByName(c)
