"""Byte-pair encoding with a segment tree over byte positions.

A text is cut by the tokenizer's own pattern. In each piece every byte is a
token at first; leaf i of the tree holds the rank of the pair that begins at
position i, the root the least rank, leftmost among equals. A merge takes the
root, joins two live neighbours and updates three leaves, so a piece of n
bytes costs n log n however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codestrata.runtime import spread

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value of this tokenizer
KEPT_PIECES = 400_000  # entries of a worker's memory of pieces; when full it starts anew
KEPT_BYTES = 64  # longer pieces are encoded each time


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file: token bytes and id, which is the rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. Equal ranks are merged from left to right."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    shift = size.bit_length()
    end = list(range(1, n + 1))  # of the token that begins at i
    before = list(range(-1, n - 1))
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    mask = (1 << shift) - 1

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] != none:
        i = tree[1] & mask
        j = end[i]  # the right neighbour begins here
        e = end[i] = end[j]
        put(j, none)
        if e < n:
            before[e] = i
            r = get(piece[i : end[e]])
            put(i, none if r is None else r << shift | i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            r = get(piece[h:e])
            put(h, none if r is None else r << shift | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, data: bytes, pattern: str = PATTERN):
        import regex

        self.ranks, self.find, self.kept = load_ranks(data), regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts give no ids. Strings of special tokens are ordinary text."""
        out: list[int] = []
        kept = self.kept
        for p in self.find(text) if text else ():
            ids = kept.get(p)
            if ids is None:
                raw = p.encode("utf-8", "surrogatepass")
                ids = merge(raw, self.ranks)
                if len(raw) <= KEPT_BYTES:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[p] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encode_table(df: DataFrame, key: str, text: str, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """`key`, `ids` of every row: one list of ids per row, none for null and
    empty texts, repeated rows as often as they come. Only the two columns are
    read, and nothing else is shuffled. `vocabulary` is the path of the .tiktoken
    file on the driver; its content (a vocabulary, under 1 MB) goes to the
    workers by broadcast. A scan of fewer
    partitions than cores is spread first.
    """
    data = Path(vocabulary).read_bytes()
    shared = df.sparkSession.sparkContext.broadcast(data)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (len(shared.value), pattern)
        encoder = _ENCODERS.get(at) or _ENCODERS.setdefault(at, Encoder(shared.value, pattern))
        for b in batches:
            step = 512  # texts at once, so the lists of ids stay small
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((x for row in ids for x in row), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
