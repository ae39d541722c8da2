"""Exact deduplication over a log-structured merge index of text digests.

Each task feeds its texts' SHA-256 digests to an index: a memtable that flushes sorted runs with Bloom
filters, merged by compaction. The tasks' merged runs - one row a digest, so a group of any size is one row a
task - are dealt out by digest and compacted again, keeping the winning identifier and the group's size.
Digests seen twice are hits: their texts are then compared byte for byte.

Of equal texts the row with the largest (or smallest) id stays. Null text counts as empty. A null id loses to any
other; a group of nulls keeps one null. Rows equal in id and text are one document repeated: one of them stays.
An empty table gives an empty result. Other columns don't matter here; their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import cut, ship, tidied

_RUN = "digest binary, best long, n long"
#: A digest held by more rows than a HOT-th of the table is hot; there are fewer than HOT of those.
HOT = 1000
BUCKETS = 1 << 20


class Bloom:
    """A filter over 32-byte digests, of ten bits an entry; digests are uniform, so their own bytes are the hashes."""

    def __init__(self, keys: np.ndarray):
        self.bits = 1 << max(10, int(len(keys) * 10).bit_length())
        self.data = np.zeros(self.bits // 8, np.uint8)
        for at in self._at(keys):
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _at(self, keys: np.ndarray) -> list[np.ndarray]:
        words = keys.view("<u8").reshape(-1, 4)
        return [(words[:, k] & np.uint64(self.bits - 1)).astype(np.int64) for k in range(4)]

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._at(keys):
            out &= (self.data[at >> 3] >> (at & 7)) & 1 == 1
        return out


def _merged(keys: np.ndarray, best: np.ndarray, n: np.ndarray, largest: bool):
    """One entry a digest, sorted: the winning id and the sum of the counts."""
    order = np.argsort(keys, kind="stable")
    keys, best, n = keys[order], best[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return keys, best, n
    return keys[first], (np.maximum if largest else np.minimum).reduceat(best, first), np.add.reduceat(n, first)


class MergeIndex:
    """Digest -> (winning id, count). Levels of sorted runs; a level of `fan` runs is compacted into one of the next."""

    def __init__(self, memtable: int = 1 << 16, fan: int = 4, largest: bool = True):
        self.most, self.fan, self.largest = memtable, fan, largest
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0
        self.levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, Bloom]]] = [[]]

    def add(self, keys: np.ndarray, best: np.ndarray, n: np.ndarray) -> None:
        for i in range(0, len(keys), self.most):
            self.pending.append((keys[i : i + self.most], best[i : i + self.most], n[i : i + self.most]))
            self.rows += len(self.pending[-1][0])
            if self.rows >= self.most:
                self.flush()

    def flush(self) -> None:
        if self.rows:
            run = _merged(*map(np.concatenate, zip(*self.pending, strict=True)), self.largest)
            self.pending, self.rows = [], 0
            self._put(0, (*run, Bloom(run[0])))

    def _put(self, level: int, run) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            merged = _merged(*(np.concatenate([r[k] for r in self.levels[level]]) for k in range(3)), self.largest)
            self.levels[level] = []
            self._put(level + 1, (*merged, Bloom(merged[0])))

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winning id and count (0: absent) of each digest; a run is searched only where its filter admits the digest."""
        self.flush()
        best = np.full(len(keys), np.iinfo(np.int64).min if self.largest else np.iinfo(np.int64).max)
        n = np.zeros(len(keys), np.int64)
        for run in (r for level in self.levels for r in level):
            ask = np.flatnonzero(run[3].may_hold(keys))
            at = np.searchsorted(run[0], keys[ask])
            hit = at < len(run[0])
            hit[hit] = run[0][at[hit]] == keys[ask][hit]
            ask, at = ask[hit], at[hit]
            best[ask] = (np.maximum if self.largest else np.minimum)(best[ask], run[1][at])
            n[ask] += run[2][at]
        return best, n

    def compacted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.flush()
        runs = [r for level in self.levels for r in level]
        if not runs:
            return np.empty(0, "S32"), np.empty(0, np.int64), np.empty(0, np.int64)
        return _merged(*(np.concatenate([r[k] for r in runs]) for k in range(3)), self.largest)


def to_keys(column: pa.Array) -> np.ndarray:
    """Binary values of 32 bytes as one numpy array that sorts and searches."""
    return np.frombuffer(b"".join(column.to_pylist()), "S32")


def to_column(keys: np.ndarray) -> pa.Array:
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(keys.tobytes())])
    return data.cast(pa.binary())


def indexed(largest: bool, memtable: int):
    """The task: an index over the entries it gets, and its compacted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MergeIndex(memtable, largest=largest)
        for b in batches:
            if b.num_rows:
                index.add(to_keys(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
        keys, best, n = index.compacted()
        for i in range(0, len(keys), 1 << 15):
            part = slice(i, i + (1 << 15))
            yield pa.RecordBatch.from_arrays([to_column(keys[part]), pa.array(best[part]), pa.array(n[part])], names=["digest", "best", "n"])

    return tidied(run)


def sha256(text):
    return F.unhex(F.sha2(text, 256))


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _buckets(digests: DataFrame, key: str) -> DataFrame:
    """The buckets that hold a digest: BUCKETS rows at most, at any input. Other rows need no join with the digests, so their
    texts stay where they are."""
    return F.broadcast(digests.select(_bucket(key).alias("_pm_bucket")).distinct())


def _found(df: DataFrame, id_col: str, text_col: str, largest: bool, digest, memtable: int):
    """(all rows' ids and digests, each (id, text) of a verified group with its winner, digests seen twice)."""
    ship(df.sparkSession)
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    base = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"))
    none = -(1 << 63) if largest else (1 << 63) - 1
    task = indexed(largest, memtable)
    entries = base.select("digest", F.coalesce("doc_id", F.lit(none)).alias("best"), F.lit(1).cast("long").alias("n"))
    twice = cut(entries.mapInArrow(task, _RUN).repartition("digest").mapInArrow(task, _RUN).filter("n > 1"))
    limit = max(100, df.count() // HOT)
    hot = F.broadcast(twice.filter(F.col("n") > limit).select("digest"))  # fewer than HOT rows
    cold = twice.filter(F.col("n") <= limit).select("digest")
    rest = base.join(hot, "digest", "left_anti")
    near = rest.withColumn("_pm_bucket", _bucket("digest")).join(_buckets(cold, "digest"), "_pm_bucket", "left_semi").drop("_pm_bucket")
    hits = base.join(hot, "digest", "left_semi").unionByName(near.join(cold, "digest", "left_semi"))
    # The texts themselves are the keys here: equal digests of unequal bytes part.
    same = cut(hits.groupBy("digest", "text", "doc_id").agg(F.count(F.lit(1)).alias("c")))
    pick = F.max if largest else F.min
    groups = same.groupBy("digest", "text").agg(pick("doc_id").alias("own"), F.sum("c").alias("size")).join(twice, "digest")
    whole = F.col("size") == F.col("n")  # all of the digest's rows hold these bytes: the index's answer stands
    winner = F.when(whole, F.when(F.col("best") != none, F.col("best"))).otherwise(F.col("own"))
    groups = cut(groups.select("digest", "text", winner.alias("keep_id"), F.col("size").alias("group_size")))
    verified = same.join(groups, ["digest", "text"])
    singles = rest.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256")).join(cold, "digest", "left_anti")
    return singles, verified


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, digest=sha256, memtable: int = 1 << 16) -> DataFrame:
    """A row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    digest: of a text column, 32 bytes; a weaker one costs time, never a right answer.
    """
    singles, verified = _found(df, id_col, text_col, largest, digest, memtable)
    alone = singles.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    each = verified.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return alone.unionByName(each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.sha2("text", 256).alias("text_sha256")))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """df's own rows and columns, one of each group of equal texts."""
    _, verified = _found(df, id_col, text_col, largest, sha256, 1 << 16)
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    known = cut(verified.select(F.col("doc_id").alias("_pm_id"), F.col("digest").alias("_pm_digest"), "c", wins.alias("wins")))
    tagged = df.withColumn("_pm_key", sha256(F.coalesce(df[text_col].cast("string"), F.lit(""))))
    match = lambda k: (F.col("_pm_key") == k["_pm_digest"]) & F.col(id_col).cast("long").eqNullSafe(k["_pm_id"])
    losers, again = known.filter(~F.col("wins")), known.filter(F.col("wins") & (F.col("c") > 1))
    tagged, held = tagged.withColumn("_pm_bucket", _bucket("_pm_key")), _buckets(known, "_pm_digest")
    alone = tagged.join(held, "_pm_bucket", "left_anti").drop("_pm_bucket")
    out = tagged.join(held, "_pm_bucket", "left_semi").drop("_pm_bucket").join(losers, match(losers), "left_anti")
    if not again.isEmpty():  # rows equal in id and text: one of them
        more = out.join(again, match(again), "left_semi").dropDuplicates([id_col, "_pm_key"])
        out = out.join(again, match(again), "left_anti").unionByName(more)
    return alone.unionByName(out).drop("_pm_key")
