"""First-fit-decreasing packing of token sequences, in randomised groups of documents.

A document's ids are cut every `capacity` ids; the pieces are dealt at random to groups of about group_docs documents,
whatever their source or size, and each group is packed alone: pieces in decreasing length, each into the first
sequence with room, found by walking down a tournament tree of what is left. A sequence is padded to the capacity, except
where it already fills a power of two.

The draw is a hash of a document's id, its ids and a seed, so a task that is run again, over rows in any order, deals them alike.
Rows equal in id and text count how often their task has met them, and are dealt apart; of a very long document every
SPAN pieces are dealt as a document of their own.

Null text counts as empty: only the end id. A null id is carried along. Rows that repeat an id are packed each.
Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm import tokens
from pixelmill.llm.common import JSON_VOCAB, ship, text_or_empty, tidied

#: Pieces of one document that are dealt together.
SPAN = 64
_PIECE = "grp long, doc_id long, start long, length long, doc_tokens long, ids binary"
_PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"


class Tournament:
    """The room left in each of up to `size` bins; first(need) is the leftmost bin with that much."""

    def __init__(self, size: int, room: int):
        self.leaves = 1 << max(0, (size - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        tree, at = self.tree, 1
        if tree[1] < need:
            return -1
        while at < self.leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        return at - self.leaves

    def take(self, index: int, need: int) -> None:
        tree, at = self.tree, index + self.leaves
        tree[at] -= need
        while at > 1:
            at >>= 1
            new = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == new:
                break
            tree[at] = new


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset there, fill of each bin)."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, offsets, fill = [0] * len(lengths), [0] * len(lengths), []
    tree = Tournament(len(lengths), capacity)
    for i in order:
        b = tree.first(lengths[i])
        tree.take(b, lengths[i])
        if b == len(fill):  # bins open from the left
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += lengths[i]
    return bins, offsets, fill


def padded(fill: int, capacity: int) -> int:
    return fill if fill & (fill - 1) == 0 else capacity


def pieces(df: DataFrame, groups: int, capacity: int = 1024, end_id: int = 0, vocab: str = JSON_VOCAB, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, remember: int = 600_000) -> DataFrame:
    """Tokenised documents cut into pieces, each with a random group that depends on the document alone. remember: pre-tokens that a
    worker may keep twice, a trade of memory for time."""
    ship(df.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocab, remember)
        met: dict[tuple[int | None, int], int] = {}  # of the rows of this task
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in tokens.some(texts):
                out: list[list] = [[], [], [], [], [], []]
                for doc, data in zip(ids[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    data += end
                    n = len(data) // 4
                    key = doc, xxhash.xxh3_64_intdigest(data, seed=seed)
                    met[key] = again = met.get(key, 0) + 1
                    for k, start in enumerate(range(0, n, capacity)):
                        if k % SPAN == 0:
                            grp = xxhash.xxh3_64_intdigest(f"{doc} {key[1]} {again} {k}") % groups
                        for column, value in zip(out, (grp, doc, start, min(capacity, n - start), n, data[4 * start : 4 * (start + capacity)]), strict=True):
                            column.append(value)
                types = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["grp", "doc_id", "start", "length", "doc_tokens", "ids"])

    return df.select(df[id_col].cast("long").alias("doc_id"), text_or_empty(df, text_col).alias("text")).mapInArrow(tidied(run, "tokens"), _PIECE)


def pack(df: DataFrame, capacity: int = 1024, group_docs: int = 2048, **how) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence, and its ids (little-endian, unsigned, 32 bit).

    sequence_id: the group's number times 2**32, plus the sequence's number in the group.
    """
    groups = max(1, math.ceil(df.count() / group_docs))

    def one(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "ids")})
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        bins, offsets, fill = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        base = table.column("grp")[0].as_py() << 32
        pads = [padded(x, capacity) for x in fill]
        new = {"sequence_id": [base + b for b in bins], "offset": offsets, "padded_length": [pads[b] for b in bins]}
        kept = {n: table.column(n) for n in ("doc_id", "start", "length", "doc_tokens")}
        return pa.table(kept | {n: pa.array(v, pa.int64()) for n, v in new.items()} | {"ids": table.column("ids")})

    return pieces(df, groups, capacity, **how).groupBy("grp").applyInArrow(one, _PACKED)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")
