"""Evaluation passages inside a training corpus.

Texts are sequences of words. A seed is a fixed mask over a window of words
that looks at some positions and ignores the others, so windows that differ
only at ignored positions share the seed's hash. Seeds of items and documents
are joined by hash; every hit brings its window along, and both windows are
compared word by word. Overlapping windows of one diagonal make one passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.runtime import spread

SPAN = 13  # words of a window
# Positions looked at. Together they find every window with at most two words replaced.
MASKS = ["1110000001111", "1001011011010", "0010101110110", "1100101110001", "0111010010101", "0101110001011", "1011110100100"]
MOST_DIFFERENT = 2
BROADCAST_ROWS = 200_000  # seeds of the items beyond which they are joined by shuffle
_WORD = re.compile(r"[^\W_]+")
KEPT_WORDS = 500_000


def masks_cover(masks: list[str], span: int, k: int) -> bool:
    """Whether any k replaced positions leave one mask untouched."""
    return all(any(all(m[i] == "0" for i in at) for m in masks) for at in combinations(range(span), k))


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits in lower case; none for null."""
    return _WORD.findall(text.lower()) if text else []


def _hashes(text: str | None, kept: dict[str, int]) -> tuple[list[str], np.ndarray]:
    found = words(text)
    out = np.empty(len(found), dtype=np.uint64)
    for i, w in enumerate(found):
        h = kept.get(w)
        if h is None:
            if len(kept) >= KEPT_WORDS:
                kept.clear()
            h = kept[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return found, out


def _seed_values(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    n = len(h) - len(mask) + 1
    out = np.full(n, 0x9E3779B97F4A7C15 * (number + 1) % 2**64, dtype=np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ h[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out.view(np.int64)


def seeds(df: DataFrame, key: str, text: str, wanted=None, masks: list[str] = MASKS) -> DataFrame:
    """`key`, `mask`, `pos`, `seed`, `window` of every window of every text.

    Texts of fewer words than a window have none. `wanted` is a broadcast
    sorted array of seed values; windows with another seed are left out, which
    only spares their way to the join.
    """
    kind = df.schema[key].dataType.simpleString()
    span = len(masks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                keys, texts = part.column(0).to_pylist(), [_hashes(t, kept) for t in part.column(1).to_pylist()]
                sizes = np.array([len(h) for _, h in texts])
                ends = np.cumsum(sizes)
                h = np.concatenate([h for _, h in texts]) if len(texts) else np.empty(0, np.uint64)
                if len(h) < span:
                    continue
                row = np.repeat(np.arange(len(texts)), sizes)
                inside = row[: len(h) - span + 1] == row[span - 1 :]
                out: list[tuple] = []
                for number, mask in enumerate(masks):
                    values = _seed_values(h, mask, number)
                    take = inside
                    if wanted is not None:
                        at = np.minimum(np.searchsorted(wanted.value, values), max(len(wanted.value) - 1, 0))
                        take = inside & (wanted.value[at] == values) if len(wanted.value) else np.zeros_like(inside)
                    for j in np.flatnonzero(take):
                        r = row[j]
                        pos = int(j - (ends[r] - sizes[r]))
                        out.append((keys[r], number, pos, int(values[j]), texts[r][0][pos : pos + span]))
                yield _seed_batch(out, b.schema.field(0).type, key)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, mask int, pos int, seed long, window array<string>")


def _seed_batch(rows: list[tuple], kind: pa.DataType, key: str) -> pa.RecordBatch:
    types = (kind, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "mask", "pos", "seed", "window"])


def hits(corpus: DataFrame, items: DataFrame, key: str, item_key: str, text: str = "text", masks: list[str] = MASKS) -> DataFrame:
    """`key`, `item_key`, `pos`, `item_pos`, `different` of every pair of
    windows that differ in at most MOST_DIFFERENT words."""
    spark = corpus.sparkSession
    item_seeds = seeds(items.select(F.col(item_key), F.col(text)), item_key, text, masks=masks)
    item_side = item_seeds.select(item_key, "mask", "seed", F.col("pos").alias("item_pos"), F.col("window").alias("item_window"))
    wanted = None
    # Items are a stated query set; a bounded look tells whether their seeds are few.
    few = item_seeds.select("seed").limit(BROADCAST_ROWS + 1).toArrow().column(0).to_numpy()
    if len(few) <= BROADCAST_ROWS:
        wanted = spark.sparkContext.broadcast(np.unique(few))
        item_side = F.broadcast(item_side)
    found = seeds(spread(corpus.select(key, text)), key, text, wanted, masks).join(item_side, ["seed", "mask"])
    differ = F.aggregate(F.zip_with("window", "item_window", lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    near = found.select(key, item_key, "pos", "item_pos", differ.alias("different")).where(F.col("different") <= MOST_DIFFERENT)
    return near.distinct()


def leaks(corpus: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """`key`, `item_key`, `passages`, `n_words`, `exact` of every document and
    item that share a passage of at least SPAN words with at most
    MOST_DIFFERENT of a window's words replaced.

    `exact` tells whether SPAN words in a row are the same; `passages` lists
    first and last word of each passage in the document and the item, counted
    from 0; `n_words` is the sum of their lengths. Null and short texts share
    nothing. Repeated rows of a key come out once. Neither side loses a pair,
    however many documents an item leaked into.
    """
    near = hits(corpus, items, key, item_key, text)
    line = [key, item_key, "shift"]
    order = W.partitionBy(*line).orderBy("pos")
    marked = near.withColumn("shift", F.col("pos") - F.col("item_pos"))
    marked = marked.withColumn("new", (F.coalesce(F.col("pos") - F.lag("pos").over(order), F.lit(SPAN + 1)) > SPAN).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(order)).groupBy(*line, "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min("different").alias("least"))
    passage = F.struct(F.col("a").alias("first"), (F.col("b") + SPAN - 1).alias("last"), (F.col("a") - F.col("shift")).alias("item_first"), (F.col("b") + SPAN - 1 - F.col("shift")).alias("item_last"))
    return runs.groupBy(key, item_key).agg(
        F.sort_array(F.collect_list(passage)).alias("passages"), F.sum(F.col("b") - F.col("a") + SPAN).cast("long").alias("n_words"), (F.min("least") == 0).alias("exact"))


def exact_leaks(corpus: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """`key`, `item_key` of the pairs that share SPAN words in a row."""
    return hits(corpus, items, key, item_key, text).where("different = 0").select(key, item_key).distinct()

