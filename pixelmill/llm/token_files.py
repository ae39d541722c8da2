"""Token-id files of patched frame-of-reference blocks, written in ascending id order and read back.

A file: magic, blocks, tables, footer. A block holds 256 ids (the last may hold fewer): its minimum (u32), a bit width (u8), the
number of exceptions (u16), the ids less the minimum at that width in 64-bit words, then the exceptions: places (u8) and whole
differences (u32). The width fits the 90th percentile of a block's differences; larger ones are exceptions. The tables are
the blocks' byte offsets (u64), each document's id (i64, with a null flag, u8) and its number of ids (u64). The footer has the
counts and the places of the tables.

Documents are dealt by ranges of id, so each task writes one sorted file; equal ids are split by text and a salt, so no
id is too frequent. A file gets its name only when it is complete, and the list of files comes from the tasks that Spark
committed: a repeated task leaves an unlisted file at most. Null text counts as empty: its end id alone. Null ids
come first. Empty tables give no files. Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import tokens
from pixelmill.llm.common import JSON_VOCAB, Table, shared_dir, ship, text_or_empty, tidied

MAGIC, BLOCK, HEAD = b"PFOR0001", 256, 7
_FOOT = struct.Struct("<QQQQQQ")  # ids, blocks, documents, and the places of the three tables


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of integers below 2**53."""
    return np.frexp(x.astype(np.float64))[1]


def pack_blocks(ids: np.ndarray, percentile: int = 90) -> list[bytes]:
    """The blocks of ids; blocks of one width are packed together."""
    n = len(ids)
    if not n:
        return []
    count = -(-n // BLOCK)
    full = np.full(count * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(count, BLOCK)
    low = full.min(axis=1)
    diff = (full - low[:, None]).astype(np.uint64)
    at = (BLOCK - 1) * percentile // 100
    width = _bits(np.partition(diff, at, axis=1)[:, at])
    outlier = diff >> width[:, None].astype(np.uint64) != 0
    head = np.zeros(count, [("low", "<u4"), ("width", "u1"), ("n", "<u2")])
    head["low"], head["width"], head["n"] = low, width, outlier.sum(axis=1)
    heads = head.tobytes()
    body: list[bytes] = [b""] * count
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        words = np.zeros((len(rows), 4 * w), np.uint64)  # 256 ids of w bits
        part = diff[rows] & np.uint64((1 << int(w)) - 1)
        for i in range(BLOCK if w else 0):
            word, shift = divmod(i * int(w), 64)
            words[:, word] |= part[:, i] << np.uint64(shift)
            if shift + w > 64:
                words[:, word + 1] |= part[:, i] >> np.uint64(64 - shift)
        data, size = words.astype("<u8").tobytes(), 32 * int(w)
        for k, r in enumerate(rows.tolist()):
            body[r] = data[k * size : (k + 1) * size]
    row, place = np.nonzero(outlier)
    value, ends = diff[row, place].astype("<u4"), np.cumsum(head["n"])
    place = place.astype(np.uint8)
    out = []
    for k in range(count):
        hi, m = int(ends[k]), int(head["n"][k])
        patch = place[hi - m : hi].tobytes() + value[hi - m : hi].tobytes() if m else b""
        out.append(heads[HEAD * k : HEAD * (k + 1)] + body[k] + patch)
    return out


def unpack_blocks(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the blocks that start at these bytes."""
    count = len(starts)
    out = np.zeros((count, BLOCK), np.uint32)
    if not count:
        return out.reshape(-1)
    heads = data[starts[:, None] + np.arange(HEAD)]
    low = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0]
    width, patches = heads[:, 4].astype(np.int64), np.ascontiguousarray(heads[:, 5:7]).view("<u2")[:, 0].astype(np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        words = np.ascontiguousarray(data[starts[rows, None] + HEAD + np.arange(32 * w)]).view("<u8")
        mask = np.uint64((1 << w) - 1)
        for i in range(BLOCK):
            word, shift = divmod(i * w, 64)
            x = words[:, word] >> np.uint64(shift)
            if shift + w > 64:
                x = x | words[:, word + 1] << np.uint64(64 - shift)
            out[rows, i] = x & mask
    rows = np.flatnonzero(patches)
    if len(rows):
        m = patches[rows]
        row = np.repeat(rows, m)
        k = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        base = starts[row] + HEAD + 32 * width[row]
        values = np.ascontiguousarray(data[(base + patches[row] + 4 * k)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        out[row, data[base + k]] = values
    return (out + low[:, None]).reshape(-1)[:n]


class _Store:
    """Files below a URI: local ones by the operating system, others by pyarrow's file systems."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        if parsed.scheme in ("", "file"):
            self.fs, self.path = None, unquote(parsed.path)
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def write(self, name: str, make) -> None:
        """make(file) fills a file of another name, which then gets its own."""
        to, draft = f"{self.path}/{name}", f"{self.path}/.{name}.draft"
        if self.fs is None:
            os.makedirs(self.path, exist_ok=True)
            with open(draft, "wb") as f:
                make(f)
            os.replace(draft, to)
        else:
            self.fs.create_dir(self.path)
            with self.fs.open_output_stream(draft) as f:
                make(f)
            self.fs.move(draft, to)

    def read(self, name: str) -> bytes:
        if self.fs is None:
            with open(f"{self.path}/{name}", "rb") as f:
                return f.read()
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return f.read()


class Writer:
    """Streams documents' ids to a file; holds one run of blocks and the tables."""

    def __init__(self, file, run: int = 1 << 20):
        self.file, self.at, self.run = file, len(MAGIC), run
        self.ids, self.held, self.total = [], 0, 0
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        file.write(MAGIC)

    def add(self, doc: int | None, data: bytes) -> None:
        self.docs.append(doc)
        self.sizes.append(len(data) // 4)
        self.ids.append(data)
        self.held += len(data) // 4
        if self.held >= self.run:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.ids), "<u4")
        for block in pack_blocks(ids[:n]):
            self.offsets.append(self.at)
            self.at += len(block)
            self.file.write(block)
        self.total += n
        self.ids, self.held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        tables = [
            np.array(self.offsets, "<u8").tobytes(),
            np.array([x or 0 for x in self.docs], "<i8").tobytes() + np.array([x is None for x in self.docs], "u1").tobytes(),
            np.array(self.sizes, "<u8").tobytes(),
        ]
        places = []
        for t in tables:
            places.append(self.at)
            self.file.write(t)
            self.at += len(t)
        self.file.write(_FOOT.pack(self.total, len(self.offsets), len(self.docs), *places) + MAGIC)


class Reader:
    """A file's documents, blocks decoded in runs as they are needed."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a whole token file")
        self.data = np.frombuffer(data, np.uint8)
        self.total, blocks, docs, b, d, s = _FOOT.unpack(data[-len(MAGIC) - _FOOT.size : -len(MAGIC)])
        self.offsets = np.frombuffer(data, "<u8", blocks, b).astype(np.int64)
        ids, null = np.frombuffer(data, "<i8", docs, d), np.frombuffer(data, "u1", docs, d + 8 * docs)
        self.docs = [None if z else x for x, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.sizes = np.frombuffer(data, "<u8", docs, s).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place on: only the blocks that hold them are decoded."""
        first, last = start // BLOCK, -(-(start + n) // BLOCK)
        some = unpack_blocks(self.data, self.offsets[first:last], min(self.total, last * BLOCK) - first * BLOCK)
        return some[start - first * BLOCK : start - first * BLOCK + n]

    def runs(self, most: int = 1 << 20) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of documents, their places, their sizes, all their ids in a row) of runs of documents."""
        place = np.cumsum(np.r_[0, self.sizes])
        k = 0
        while k < len(self.docs):
            last = max(k + 1, int(np.searchsorted(place, place[k] + most, "right")) - 1)
            yield self.docs[k:last], place[k:last], self.sizes[k:last], self.ids(int(place[k]), int(place[last] - place[k]))
            k = last


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocab: str = JSON_VOCAB, remember: int = 600_000) -> list[tuple[str, int]]:
    """Writes df's documents below folder (a URI all executors see). Returns (file, ids before it) in order of id.

    What comes to the driver is a row for each file, as with any table's listing.
    """
    spark = ship(df.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, state = TaskContext.get(), tokens.encoder(vocab, remember), {"ids": 0, "docs": 0}
        rows = iter(batches)
        first = next((b for b in rows if b.num_rows), None)
        if first is None:
            return

        def make(f) -> None:
            w = Writer(f)
            b = first
            while b is not None:
                docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for lo, hi in tokens.some(texts):
                    for doc, data in zip(docs[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                        w.add(doc, data + end)
                b = next(rows, None)
            w.close()
            state.update(ids=w.total, docs=len(w.docs))

        name = f"part-{part.partitionId():08d}-{part.taskAttemptId()}.pfor"
        _Store(folder).write(name, make)
        yield pa.RecordBatch.from_arrays([pa.array([part.partitionId()]), pa.array([name]), pa.array([state["ids"]])], names=["part", "file", "n"])

    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_or_empty(df, text_col).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("salt", F.rand(17))
    dealt = docs.repartitionByRange("doc_id", "h", "salt").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    listed = Table(dealt.mapInArrow(tidied(run, "tokens"), "part long, file string, n long"), "files")
    found = sorted((r["part"], r["file"], r["n"]) for r in listed.df.collect())
    listed.drop()
    before = accumulate((n for _, _, n in found), initial=0)
    return [(name, start) for (_, name, _), start in zip(found, before, strict=False)]


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids (little-endian, unsigned, 32 bit) of every document in the files."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Store(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for docs, place, sizes, ids in Reader(store.read(name)).runs():
                    ends = np.cumsum(np.r_[0, 4 * sizes])
                    data = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4", copy=False))])
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + place), pa.array(sizes), data.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    n = max(1, len(files))
    rows = spark.createDataFrame(spark.sparkContext.parallelize(files, n), "file string, start long")
    return rows.mapInArrow(tidied(run, "tokens"), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(df: DataFrame) -> DataFrame:
    """Writes df's ids to a new shared folder and reads them back."""
    folder = f"{shared_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(df.sparkSession, folder, write(df, folder))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["Reader", "Writer", "digests", "pack_blocks", "read", "round_trip", "unpack_blocks", "write"]
