"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at .!? before white space and at line ends; a sentence of more than 12 words counts as several of
12 at most, cut where the words themselves say so (winnowing), so that from 12 words on after the start of a passage the cuts
inside it are the same wherever it stands. Every run of 3 consecutive sentences with 8 words or more is hashed; where 3 sentences hold fewer words, the run goes
on, forward and backward, until it holds 8. All runs meet by hash; of equal runs the first - by id, then place - stays, and
sentences covered by any other are removed. What is left of a text is its own bytes.

Equal runs within one task are settled there: only a run's first place in each task is sent on, so a passage of any
frequency is one row a task. Null text stays null and has no sentences. A null id sorts before all others. Rows equal in
id and text are one document: none is a repeat of the other. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import ship, tidied
from pixelmill.llm.ngram_join import _hashes

RUN, LEAST_WORDS, LONG = 3, 8, 12
_NONE = -(1 << 63)
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])  # there is no white space beyond U+3000
_WEIGHTS = np.array([xxhash.xxh3_64_intdigest(bytes([k])) | 1 for k in range(LONG)], np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15) + b
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first character, character after the last, words, hash of the words) of each sentence."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, n)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.r_[True, _SPACE[np.minimum(code, 0x3001)], True]
    begin, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    lines = np.cumsum(code == 10)
    first = np.r_[True, np.isin(code[end[:-1] - 1], [33, 46, 63]) | (lines[begin[1:]] > lines[end[:-1] - 1])]
    # of every LONG places in a row inside a sentence, the one with the least hash of the words at its sides is a cut
    if n > LONG:
        inner = np.cumsum(np.r_[0, first])
        at = np.flatnonzero(inner[LONG:] == inner[:-LONG])
        side = _mixed(np.r_[h[:1], h[:-1]], h)
        best, where = side[at], at.copy()
        for k in range(1, LONG):
            less = side[at + k] < best
            best, where = np.where(less, side[at + k], best), np.where(less, at + k, where)
        first[where] = True
    head = np.flatnonzero(first)
    count = np.diff(np.r_[head, n])
    place = np.arange(n) - np.repeat(head, count)
    return begin[head], end[head + count - 1], count, _mixed(np.add.reduceat(h * _WEIGHTS[place], head), count.astype(np.uint64))


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(first character, character after the last, words) of each sentence."""
    return list(zip(*(x.tolist() for x in _cut(text)[:3]), strict=True))


def spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first sentence) of each run that counts. A run of more than RUN sentences comes as pieces of RUN that cover it."""
    _, _, words, h = _cut(text)
    n = len(h)
    if n < RUN:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    upto = np.cumsum(np.r_[0, words])
    # the shortest run that counts from each sentence on, and the shortest up to each
    begin, end = np.arange(n - RUN + 1), np.arange(RUN, n + 1)
    far = np.maximum(end, np.searchsorted(upto, upto[begin] + LEAST_WORDS))
    near = np.minimum(begin, np.searchsorted(upto, upto[end] - LEAST_WORDS, "right") - 1)
    back = (near < begin) & (near >= 0)
    back[back] = far[near[back]] != end[back]
    a, e = np.r_[begin[far <= n], near[back]], np.r_[far[far <= n], end[back]]
    mixed, size = h[a], e - a
    for k in range(1, LEAST_WORDS):
        on = np.flatnonzero(size > k)
        mixed[on] = _mixed(mixed[on], h[a[on] + k])
    out, at = [mixed], [a]
    for k in range(RUN, LEAST_WORDS, RUN):
        on = np.flatnonzero(size > k)
        out.append(_mixed(mixed[on], np.uint64(k)))
        at.append(np.minimum(a[on] + k, e[on] - RUN))
    return np.concatenate(out), np.concatenate(at)


def without(text: str, covered: set[int]) -> tuple[str, int, int]:
    """(text without the covered sentences, sentences, sentences removed). A line keeps its end while it keeps a sentence."""
    found = sentences(text)
    gone = [i for i in range(len(found)) if i in covered]
    if not gone:
        return text, len(found), 0
    out, at, i = [], 0, 0
    while i < len(found):
        if i not in covered:
            i += 1
            continue
        j = i
        while j + 1 < len(found) and j + 1 in covered:
            j += 1
        start, end = found[i][0], found[j + 1][0] if j + 1 < len(found) else len(text)
        gap = text[found[j][1] : end]
        line_start = start == 0 or text[start - 1] == "\n"
        out.append(text[at:start])
        if "\n" in gap and not line_start:
            out.append(gap[gap.index("\n") :])
        at, i = end, j + 1
    out.append(text[at:])
    return "".join(out), len(found), len(gone)


def _places(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    def settled(parts: list) -> pa.RecordBatch:
        h, pos = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        size = [len(p[0]) for p in parts]
        doc = np.repeat(np.array([p[2] for p in parts], np.int64), size)
        own = np.repeat(np.array([p[3] for p in parts], np.int64), size)
        o = np.lexsort((pos, own, doc, h))
        h, pos, doc, own = h[o], pos[o], doc[o], own[o]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
        first = np.flatnonzero(new)
        which = first[np.cumsum(new) - 1] if len(h) else first
        repeat = (doc != doc[which]) | (own != own[which]) | (pos != pos[which])
        keep = repeat | new
        h, pos, doc, own, repeat = h[keep], pos[keep], doc[keep], own[keep], repeat[keep]
        # what is settled travels under a key of its own place, spread evenly
        key = np.where(repeat, (doc * 31 + own) ^ (pos * 0x9E3779B97F4A7C1), h.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(repeat), pa.array(doc), pa.array(own), pa.array(pos.astype(np.int32))], names=["k", "settled", "doc", "own", "pos"])

    parts, size = [], 0
    with np.errstate(over="ignore"):
        for b in batches:
            for doc, own, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                parts.append((*spans(text), doc, own))
                size += len(text)
                if size >= most:
                    yield settled(parts)
                    parts, size = [], 0
        if parts:
            yield settled(parts)


def covered(df: DataFrame) -> DataFrame:
    """(doc, own, gone): sentences covered by a run that is not the first of its kind. df: doc, own, text."""
    found = df.filter("text is not null").select("doc", "own", "text").mapInArrow(tidied(_places), "k long, settled boolean, doc long, own long, pos int")
    order = Window.partitionBy("k", "settled").orderBy("doc", "own", "pos")
    later = found.withColumn("r", F.rank().over(order)).filter("settled or r > 1")
    each = later.select("doc", "own", F.explode(F.sequence(F.col("pos"), F.col("pos") + RUN - 1)).alias("pos"))
    return each.groupBy("doc", "own").agg(F.collect_set("pos").alias("gone"))  # at most a document's sentences


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_sentences, n_removed of every row."""
    ship(df.sparkSession)
    doc = F.coalesce(df[id_col].cast("long"), F.lit(_NONE))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), doc.alias("doc"), F.xxhash64(df[text_col]).alias("own"), df[text_col].cast("string").alias("text"))
    joined = docs.join(covered(docs), ["doc", "own"], "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                done = [(None, 0, 0) if t is None else without(t, set(g or ())) for t, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["doc_id", "text", "n_sentences", "n_removed"])

    return joined.mapInArrow(tidied(run), "doc_id long, text string, n_sentences long, n_removed long")
