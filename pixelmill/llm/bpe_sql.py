"""Byte-level BPE as recursive DuckDB queries, one database in each Python worker.

Encoding: each pre-token's bytes are its first tokens. A recursive query turns every word that changed into rows of a token pair
and its position, joins them with the merge table, contracts each word's leftmost pair of least rank, and goes on until no
word changes. Words that are a token are found by a join with the vocabulary. Decoding: token rows join the vocabulary; an
ordered aggregation puts their bytes together.

A pre-token of any length may come: a text can be a single one. As one word it would take a step for each token, over all of
them. One of more than PIECE bytes is encoded in pieces, which are words of the same query, and joined where they meet: ids are
a word's encoding if and only if any two side by side are the encoding of their own bytes. Where the ids at a seam are not,
what lies on both sides is encoded again as one word, twice as much each time.

Distinct pre-tokens are encoded and decoded once a worker and remembered up to a bound; a document is its pre-tokens
in a row. Null text counts as empty: no ids. A null id is carried along; rows that repeat an id are answered each. Very long
texts are encoded whole. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from pixelmill.llm import tokens
from pixelmill.llm.common import RANKS, remembered, ship, text_or_empty, tidied

_WORKER = remembered("bpe")
#: Bytes of a pre-token that is one word of the query; no less than the longest token.
PIECE = 256

#: given: a word's number, its bytes (null for a piece) and its first tokens. pair: a row for each token pair and its position;
#: pick: rank and position of the least.
MERGE = """
CREATE OR REPLACE TEMP TABLE token_lists AS
WITH RECURSIVE step(w, ts) USING KEY (w) AS (
  SELECT g.w, CASE WHEN v.t IS NULL THEN g.ts ELSE [v.t] END FROM given g LEFT JOIN vocab v ON v.spelling = g.word
  UNION
  SELECT s.w, s.ts[: pick.x % 4294967296 - 1] || [pick.x // 4294967296] || s.ts[pick.x % 4294967296 + 2 :]
  FROM step s JOIN (
    SELECT pair.w, min(m.k * 4294967296 + pair.p) AS x
    FROM (SELECT w, unnest(ts[:-2]) * 65536 + unnest(ts[2:]) AS ab, unnest(range(1, len(ts))) AS p FROM step) pair
    JOIN merges m ON m.pair = pair.ab
    GROUP BY pair.w
  ) pick ON pick.w = s.w
)
SELECT w, ts FROM step
"""

SPELL = """
SELECT w, unhex(string_agg(v.hex, '' ORDER BY r.p)) AS bytes
FROM (SELECT w, unnest(ts) AS t, unnest(range(len(ts))) AS p FROM token_lists) r JOIN vocab v ON v.t = r.t
GROUP BY w
"""

ANSWER = f"SELECT array_to_string(l.ts, ' ') AS ids, s.bytes FROM token_lists l JOIN ({SPELL}) s ON s.w = l.w ORDER BY l.w"


class Bpe:
    """Ranks in an in-memory database of bounded size."""

    def __init__(self, path: str, memory: str = "300MB", most: int = 200_000, max_bytes: int = 24 << 20):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 16 or max(map(len, ranks)) > PIECE:
            raise ValueError("ranks must be below 65536, tokens of 256 bytes at most")
        self.single = np.array([ranks[bytes([c])] for c in range(256)], np.int64)
        self.spelling = {r: t for t, r in ranks.items()}
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self._table("merges", pair=pa.array([a * 65536 + b for a, b in pairs], pa.int64()), k=pa.array(pairs.values(), pa.int64()))
        self._table("vocab", t=pa.array(ranks.values(), pa.int64()), hex=pa.array([t.hex() for t in ranks]), spelling=pa.array(list(ranks), pa.binary()))
        self.known: dict[str, tuple[str, bytes]] = {"": ("", b"")}
        self.most, self.max_bytes, self.bytes = most, max_bytes, 0

    def _table(self, name: str, **columns) -> None:
        self.db.register("rows", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows")
        self.db.unregister("rows")

    def _merge(self, words: list[bytes], pieces: bool = False) -> None:
        """Leaves (w, ts) of each word in token_lists."""
        ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
        data = b"".join(words)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.single[np.frombuffer(data, np.uint8)]))
        spelt = pa.nulls(len(words), pa.binary()) if pieces else pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        self.db.register("given", pa.table({"w": pa.array(np.arange(len(words))), "word": spelt, "ts": lists}))
        self.db.execute(MERGE)
        self.db.unregister("given")

    def _lists(self, pieces: list[bytes]) -> list[list[int]]:
        self._merge(pieces, pieces=True)
        return [x for (x,) in self.db.execute("SELECT ts FROM token_lists ORDER BY w").fetchall()]

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))

    def _long(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that are encoded in pieces, all of them together."""
        cut = [[w[i : i + PIECE] for i in range(0, len(w), PIECE)] for w in words]
        done = iter(self._lists([x for parts in cut for x in parts]))
        out: list[list[int]] = []
        seams: dict[int, list[int]] = {}  # of each word: between which ids
        for k, parts in enumerate(cut):
            out.append([])
            seams[k] = []
            for _ in parts:
                seams[k].append(len(out[k]))
                out[k] += next(done)
            del seams[k][0]
        reach = 4
        while pairs := {(out[k][s - 1], out[k][s]) for k, at in seams.items() for s in at}:
            alone = zip(pairs, self._lists([self._bytes(p) for p in pairs]), strict=True)
            bad = {p for p, ids in alone if ids != list(p)}
            spans: dict[int, list[list[int]]] = {}
            for k, at in seams.items():
                for s in at:
                    if (out[k][s - 1], out[k][s]) in bad:
                        here = spans.setdefault(k, [])
                        lo, hi = max(0, s - reach), min(len(out[k]), s + reach)
                        if here and lo <= here[-1][1]:
                            here[-1][1] = hi
                        else:
                            here.append([lo, hi])
            again = iter(self._lists([self._bytes(out[k][lo:hi]) for k, here in spans.items() for lo, hi in here]) if spans else [])
            seams = {}
            for k, here in spans.items():
                old, new, at = out[k], [], 0
                seams[k] = []
                for lo, hi in here:
                    new += old[at:lo]
                    seams[k] += [len(new)] * (lo > 0)
                    new += next(again)
                    seams[k] += [len(new)] * (hi < len(old))
                    at = hi
                out[k] = new + old[at:]
            reach *= 2
        return out

    def merge(self, words: list[bytes]) -> None:
        """Leaves (w, ts) of each word, none of them empty, in token_lists."""
        far = [i for i, x in enumerate(words) if len(x) > PIECE]
        if not far:
            return self._merge(words)
        lists = self._long([words[i] for i in far])
        self._merge([b"\0" if len(x) > PIECE else x for x in words])
        self.db.register("rows", pa.table({"w": pa.array(far, pa.int64()), "ts": pa.array(lists, pa.list_(pa.int64()))}))
        self.db.execute("UPDATE token_lists SET ts = rows.ts FROM rows WHERE rows.w = token_lists.w")
        self.db.unregister("rows")

    def spell(self, lists: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids."""
        if any(t not in self.spelling for x in lists for t in x):
            raise ValueError("an id outside the vocabulary")
        self.db.register("rows", pa.table({"w": pa.array(range(len(lists)), pa.int64()), "ts": pa.array(lists, pa.list_(pa.int64()))}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE token_lists AS SELECT * FROM rows")
        self.db.unregister("rows")
        found = dict(self.db.execute(SPELL).fetchall())
        return [found.get(i, b"") for i in range(len(lists))]

    def learn(self, words: list[str], at_once: int = 1 << 19) -> None:
        """Encodes and decodes new words, runs of about so many bytes at a time."""
        spelt = [x.encode() for x in words]
        run = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt))) // at_once
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(run)) + 1):
            if len(part):
                lo, hi = int(part[0]), int(part[-1]) + 1
                self.merge(spelt[lo:hi])
                found = self.db.sql(ANSWER).to_arrow_table()
                self.known.update(zip(words[lo:hi], zip(found.column("ids").to_pylist(), found.column("bytes").to_pylist(), strict=True), strict=True))
                self.bytes += found.nbytes + sum(map(len, words[lo:hi]))

    def encode(self, texts: list[str]) -> tuple[list[str], list[bytes]]:
        """Each text's ids, joined by a space, and what they decode to."""
        on = gc.isenabled()
        gc.disable()  # many small objects and no cycles: collections would walk everything remembered
        try:
            words = [split(x) for x in texts]
            new = set().union(*words).difference(self.known)
            if new:
                self.learn(list(new))
            get = self.known.__getitem__
            both = [tuple(zip(*map(get, ws), strict=True)) or ((), ()) for ws in words]
            out = [" ".join(a) for a, _ in both], [b"".join(b) for _, b in both]
        finally:
            if on:
                gc.enable()
        if len(self.known) > self.most or self.bytes > self.max_bytes:
            self.known, self.bytes = {}, 0
        return out


def _bpe(path: str) -> Bpe:
    if path not in _WORKER:
        _WORKER[path] = Bpe(path)
    return _WORKER[path]


_SPLIT = regex.compile(PATTERN)


def split(text: str) -> list[str]:
    """The matches of the public pattern; texts of common characters go by an equal pattern that is faster."""
    return tokens.WORDS.findall(text) if not tokens.ODD.search(text) else _SPLIT.findall(text)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space), decoded (the ids' bytes) of every row."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks)
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in tokens.some(texts):
                ids, back = bpe.encode(texts[lo:hi])
                n = [x.count(" ") + 1 if x else 0 for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi], pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_or_empty(df, text_col).alias("text"))
    return docs.mapInArrow(tidied(run, "bpe"), "doc_id long, n_tokens long, ids string, decoded binary")


def decode(df: DataFrame, id_col: str, ids_col: str, ranks: str = RANKS) -> DataFrame:
    """(id_col, decoded) for any lists of ids; a null list decodes to nothing. Ids outside the vocabulary are an error."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.spell([x or [] for x in part.column(1).to_pylist()]), pa.binary())], names=["id", "decoded"])

    return df.select(df[id_col].cast("long").alias("id"), df[ids_col].cast("array<bigint>").alias("ids")).mapInArrow(tidied(run, "bpe"), "id long, decoded binary")


def digests(df: DataFrame) -> DataFrame:
    """encode(), with digests in place of ids and bytes, made in the same pass."""
    from pyspark.sql import functions as F

    found = encode(df)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["Bpe", "decode", "digests", "encode", "split"]
