"""Nearest neighbours and upkeep of vector tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_QUERIES = 2_000  # queries compared at once; more are taken in several passes


def knn(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """`query`, `key`, `distance`, `rank`: the k rows nearest to every query by
    Euclidean distance, ties by key.

    Queries are a stated set: they go to the workers in blocks of about
    BLOCK_QUERIES, by a hash of their key, and every partition keeps its k best a query, so what is
    shuffled grows with partitions, not with pairs. Rows whose vector is null
    or of another length than the query's are no neighbours. A query that is a
    row itself finds itself first.
    """
    kind = rows.schema[key].dataType.simpleString()
    q = queries.where(F.col(vector).isNotNull()).select(key, vector)
    n_blocks = -(-q.count() // BLOCK_QUERIES) or 1
    out = None
    for at in range(n_blocks):
        # One block of queries at a time is on the driver.
        part = q.where(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == at).toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((part.column(0).to_pylist(), part.column(1).to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            best: dict[int, list[tuple[float, object]]] = {}
            for b in batches:
                keys, rows_ = b.column(0).to_pylist(), b.column(1).to_pylist()
                for size, of in by_size.items():
                    fit = [i for i, v in enumerate(rows_) if v is not None and len(v) == size]
                    if not fit:
                        continue
                    x = np.array([rows_[i] for i in fit], np.float64)
                    for qi in of:
                        d = np.sqrt(((x - np.array(vectors[qi], np.float64)) ** 2).sum(1))
                        near = np.argpartition(d, min(k, len(d)) - 1)[:k] if len(d) > k else np.arange(len(d))
                        limit = d[near].max()
                        found = [(float(d[j]), keys[fit[j]]) for j in np.flatnonzero(d <= limit)]
                        best[qi] = sorted([*best.get(qi, []), *found])[:k]
            flat = [(ids[qi], key_, d) for qi, found in best.items() for d, key_ in found]
            t = part.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], t), pa.array([f[1] for f in flat], t), pa.array([f[2] for f in flat], pa.float64())], names=["query", key, "distance"])

        one = rows.select(key, vector).mapInArrow(run, f"query {kind}, `{key}` {kind}, distance double")
        out = one if out is None else out.unionByName(one)
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_searches(lists: dict[str, DataFrame], key: str, k: int) -> DataFrame:
    """`source`, `key`, `distance` of several neighbour lists, the k nearest of all."""
    both = None
    for name, df in lists.items():
        one = df.select(F.lit(name).alias("source"), key, "distance")
        both = one if both is None else both.unionByName(one)
    return both.orderBy("distance", "source", key).limit(k)


def vector_delta(stored: DataFrame, wanted: DataFrame, hash_column: str) -> DataFrame:
    """`hash`, `action`: embed what is wanted and not stored, drop what is stored and not wanted, keep the rest."""
    s, w = (df.where(F.col(hash_column).isNotNull()).select(F.col(hash_column).alias("hash")).distinct() for df in (stored, wanted))
    return (
        w.join(s, "hash", "left_anti").withColumn("action", F.lit("embed"))
        .unionByName(s.join(w, "hash", "left_anti").withColumn("action", F.lit("drop")))
        .unionByName(w.join(s, "hash", "left_semi").withColumn("action", F.lit("keep")))
    )


def embed(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], np.ndarray], dim: int, at_once: int = 256) -> DataFrame:
    """`key`, `vector` of every row by an embedder (texts to rows of `dim`
    numbers), called with a few texts at a time on the executors. Null texts
    have no vector; an embedder that answers with another shape is an error."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, at_once):
                part = b.slice(i, at_once)
                texts = part.column(1).to_pylist()
                told = [t for t in texts if t is not None]
                v = np.asarray(embedder(told), np.float32).reshape(-1, dim) if told else np.empty((0, dim), np.float32)
                if len(v) != len(told):
                    raise ValueError(f"{len(told)} texts, {len(v)} vectors")
                each = iter(v)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else next(each) for t in texts], pa.list_(pa.float32()))], names=[key, "vector"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, vector array<float>")


def hashed_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """Vectors by which texts of the same words are near: an embedder that needs no model."""
    import re

    import xxhash

    out = np.zeros((len(texts), dim), np.float32)
    for row, t in zip(out, texts):
        for w in re.findall(r"\w+", t.lower()):
            h = xxhash.xxh64_intdigest(w)
            row[h % dim] += 1.0 if h >> 63 else -1.0
        row /= np.linalg.norm(row) or 1.0
    return out


def check_embedder(pinned: dict, model: str, dim: int) -> None:
    """Raise if a store was filled by another model or with another length."""
    if pinned and (pinned.get("model"), pinned.get("dim")) != (model, dim):
        raise ValueError(f"the store holds vectors of {pinned.get('model')} with {pinned.get('dim')} numbers, not of {model} with {dim}")
