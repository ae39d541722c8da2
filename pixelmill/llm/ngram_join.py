"""Exact Jaccard self-join of word shingles by grouped prefixes, and its connected components.

Words are lower-cased (A-Z only); a document's set holds its distinct five-word shingles, as 64-bit hashes. Two sets with
Jaccard similarity 0.8 or more must share a shingle among the first n - ceil(0.8 n) + 1 of each, in any one order of
all shingles. The order puts shingles that many documents hold last, so that prefixes hold rare ones.

1. Documents with one set are a class; classes with one prefix and size are a group. Only groups are indexed.
2. A shingle's list holds the groups with it in their prefix. Lists of one group are dropped, group members expanded.
3. Not all pairs of a list are formed. First, each list's members are verified against one hub, its smallest id.
4. Of lists whose other members are still in different components, those with few members outside the largest component form the
   pairs of these few, as far as sizes and places allow. Others go to the arena of that component, where those outside it meet all members of like size, in blocks of some hundred against some hundred. A block's rows are sent, not its pairs, and
   the links that join the block's components come out.
   Pairs and blocks are tried twice: by bitmaps of the sets, about two bits a shingle, whose distance bounds the overlap from above
   and so refutes no link, and then by the whole sets of what is left.
   So every link between different texts is found or already implied by others.
5. Links feed a distributed connected-components loop (large star, small star).

Lists of shingles known to be in very many documents ("hot") are not sorted in a window: what windows only thin out is kept
whole there, and every list's hub is an aggregated minimum.

Null text, or text without words, has an empty set and is linked with nothing; its component is its own id. Rows with a
null id take no part in links and get a null component. Rows that repeat an id count as one document, of all their
links. Very long texts are compared whole. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import Table, cut, release, remembered, ship, text_or_empty, tidied

_WORKER = remembered("words")


class _Words(dict):
    """word -> 64-bit hash; emptied when it holds too many, and when a task ends."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _hashes() -> _Words:
    words = _WORKER.setdefault("words", _Words())
    if len(words) > 200_000:
        words.clear()
    return words


def shingles(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of fewer words, of all of them; empty without words."""
    found = text.encode().lower().split()  # bytes: only A-Z change, and only \x20 and \x09-\x0D part words
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, found), np.uint64, n)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc_id"), text_or_empty(df, text_col).alias("text"))


def _runs(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def frequent(docs: DataFrame, most: int = 1 << 17, seen: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of the most frequent shingles: those in `seen` documents of one task at least, summed over
    all tasks, at most `most` of them. It only orders shingles: a shingle missed here costs time, no link."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([n for _, n in parts]), len(values)).astype(np.int64)

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for _, texts in _runs(batches):
            values, n = np.unique(np.concatenate([shingles(t) for t in texts]), return_counts=True)
            parts.append((values[n > 1], n[n > 1]))
            if sum(len(v) for v, _ in parts) > 8 * most:  # what a task holds is bounded: rare ones go first
                values, n = merged(parts)
                keep = np.argsort(-n, kind="stable")[: 4 * most]
                parts = [(values[keep], n[keep])]
        if parts:
            values, n = merged(parts)
            keep = n >= seen
            yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep])], names=["s", "n"])

    counts = cut(docs.mapInArrow(tidied(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")))
    steps = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("b")).count().orderBy(F.desc("b")).collect()  # some dozens of rows
    least, total = None, 0
    for r in steps:
        if total + r["count"] > most:
            break
        least, total = r["b"], total + r["count"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.filter(F.floor(F.log2("n") * 4).cast("int") >= least).toArrow()
    s, n = rows.column("s").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefix_size(n: int, percent: int = 80) -> int:
    return n - (percent * n + 99) // 100 + 1


def _parities(x: np.ndarray) -> bytes:
    """A bitmap of two bits or more for each shingle: whether an odd number of shingles falls on the bit."""
    size = 1 << max(6, (2 * len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of `size` bytes of the same set."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def prefixes(docs: DataFrame, table, percent: int) -> DataFrame:
    """doc_id, n, sig (of the set), psig (of the prefix), prefix (rarest shingles first), bits (bitmap of the set)."""

    def run(batches):
        known, counts = table.value
        for ids, texts in _runs(batches, 2 << 20):
            rows: list[list] = [[], [], [], [], [], []]
            for i, t in zip(ids, texts, strict=True):
                x = shingles(t)
                n = len(x)
                head = x[:0]
                if n:
                    freq = np.zeros(n, np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        hit = known[at] == x
                        freq[hit] = counts[at[hit]]
                    head = x[np.lexsort((x, freq))[: prefix_size(n, percent)]]
                for column, value in zip(rows, (i, n, xxhash.xxh3_128_digest(x.tobytes()), xxhash.xxh3_128_digest(head.tobytes()), head.view(np.int64), _parities(x)), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "n", "sig", "psig", "prefix", "bits"])

    return docs.mapInArrow(tidied(run), "doc_id long, n long, sig binary, psig binary, prefix array<long>, bits binary")


def _bitmap(wanted: DataFrame, bits: int = 23) -> np.ndarray:
    """A filter of the wanted representatives, 1 MB at any input; it may admit others."""
    rows = wanted.select((F.xxhash64("rep").bitwiseAND(F.lit((1 << bits) - 1))).alias("b"))
    words = rows.groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("x")).toArrow()
    data = np.zeros(1 << (bits - 6), np.int64)
    data[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return data


_ITEMS = "rep long, sig binary, n long, items binary"


def _admitted(source: DataFrame, mask: np.ndarray, read) -> DataFrame:
    """(rep, sig, n, items) of source's rows that the filter admits, so that most others are neither hashed nor sent. A join
    decides. read: (sig, n, items) from a row after its id and the id's hash."""
    sent = source.sparkSession.sparkContext.broadcast(mask)

    def run(batches):
        mask = sent.value
        low = 64 * len(mask) - 1
        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False) & low
            may = np.flatnonzero((mask[h >> 6] >> (h & 63)) & 1)
            for lo in range(0, len(may), 256):
                part = b.take(pa.array(may[lo : lo + 256]))
                found = {}
                for row in zip(*(part.column(k) for k in range(part.num_columns)), strict=True):
                    sig, n, items = read(*row[2:])
                    found[row[0].as_py(), sig] = n, items  # rows that repeat count once
                columns = ([k[0] for k in found], [k[1] for k in found], [v[0] for v in found.values()], [v[1] for v in found.values()])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["rep", "sig", "n", "items"])

    return source.mapInArrow(tidied(run), _ITEMS)


def _read_text(text):
    x = shingles(text.as_py())
    return xxhash.xxh3_128_digest(x.tobytes()), len(x), x.tobytes()


def _read_bits(sig, n, bits):
    return sig.as_py(), n.as_py(), bits.as_py()


def _need(na, nb, percent: int):
    """The least overlap of two sets of these sizes that link."""
    return -(-percent * (na + nb) // (100 + percent))


def _alike(percent: int):
    def test(a, b, na, nb):
        return len(np.intersect1d(a, b, assume_unique=True)) >= _need(na, nb, percent)

    return test


def _may_be_alike(percent: int):
    """What two bitmaps allow. Each bit that differs is the work of one shingle at least that only one set holds, and sets overlap
    by half of what their sizes exceed the number of such shingles."""

    def test(a, b, na, nb):
        size = min(len(a), len(b))
        far = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())
        return na + nb - far >= 2 * _need(na, nb, percent)

    return test


def _compared(pairs: DataFrame, classes: DataFrame, items, kind: str, test, share: int = 512) -> DataFrame:
    """The pairs (hub, x) that pass a test of their items. A hub's items go once to each share of its partners, a partner's to
    each of its hubs. items: from wanted representatives to (rep, sig, n, items); kind: what the items' bytes are."""
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares"))
    own = hubs.select(F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(False).alias("partner"))
    theirs = pairs.join(hubs, "hub").select(F.col("x").alias("rep"), "hub", F.pmod(F.xxhash64("x"), F.col("shares")).cast("int").alias("salt"), F.lit(True).alias("partner"))
    roles = cut(own.unionByName(theirs).join(classes.select("rep", "sig"), "rep"))
    sent = roles.join(items(roles.select("rep")), ["rep", "sig"]).select("hub", "salt", "partner", F.col("rep").alias("x"), "n", "items")
    both = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "partner")

    def run(batches):
        now, own = None, []  # an id with several texts comes with the items of each
        for b in batches:
            out: tuple[list, list] = ([], [])
            for hub, salt, partner, x, n, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                data = np.frombuffer(data, kind)
                if now != (hub, salt):
                    now, own = (hub, salt), []
                if not partner:
                    own.append((data, n))
                elif any(test(mine, data, size, n) for mine, size in own):
                    out[0].append(hub)
                    out[1].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["hub", "x"])

    return cut(both.mapInArrow(tidied(run), "hub long, x long").distinct())


def _verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that link. Bitmaps refute most others, at a twentieth of the size of whole sets."""
    short = heads.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "sig", "n", "bits")
    left = _compared(pairs, classes, lambda w: _admitted(short, _bitmap(w), _read_bits), "u1", _may_be_alike(percent))
    release(docs.sparkSession)
    whole = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    return _compared(left, classes, lambda w: _admitted(whole, _bitmap(w), _read_text), "<u8", _alike(percent))


def _block(size_class: str, base: float, share: int, most: int = 1 << 21):
    """Rows of a block: fewer of large sets, so that a block holds some millions of shingles."""
    return F.greatest(F.lit(16.0), F.least(F.lit(float(share)), F.lit(float(most)) / F.pow(F.lit(base), F.col(size_class) + 1)))


def _units(apart: DataFrame, percent: int, share: int) -> DataFrame:
    """(arena, b, mblock, oblock, out, rep, n, c): where each member, and each outsider again, meets the others. Sizes whose
    classes b differ by more than one can't link."""
    base = 100 / percent * 1.001
    who = cut(apart.select("arena", "rep", "n", "c").distinct().withColumn("b", F.floor(F.log("n") / math.log(base)).cast("int")))
    out = who.filter("c <> arena").withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    many = lambda x, name: x.groupBy("arena", "b").agg(F.ceil(F.count(F.lit(1)) / F.first(_block("b", base, share))).cast("int").alias(name))
    units = many(who, "mblocks").join(many(out, "oblocks"), ["arena", "b"])
    deal = lambda seed, n: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = who.join(units, ["arena", "b"]).withColumn("mblock", deal(1, "mblocks")).withColumn("oblock", each("oblocks")).withColumn("out", F.lit(False))
    outside = out.join(units, ["arena", "b"]).withColumn("oblock", deal(2, "oblocks")).withColumn("mblock", each("mblocks")).withColumn("out", F.lit(True))
    columns = ("arena", "b", "mblock", "oblock", "out", "rep", "n", "c")
    return members.select(*columns).unionByName(outside.select(*columns))


_UNIT = ("arena", "b", "mblock", "oblock")


def _overlaps(outside: list, members: list) -> Iterator[np.ndarray]:
    """For each outsider: how many items it shares with each member."""
    values = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), [len(x) for x in members])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for x in outside:
        lo, hi = np.searchsorted(values, x), np.searchsorted(values, x, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.bincount(owner[at], minlength=len(members))


def _met(units: DataFrame, classes: DataFrame, items, kind: str, answer, schema: str) -> DataFrame:
    """answer(unit, outsiders, members) of each unit; both are lists of (rep, c, n, items); kind: what the items' bytes are."""
    named = cut(units.join(classes.select("rep", F.col("n").cast("int").alias("n"), "sig"), ["rep", "n"]))
    rows = named.drop("n").join(items(named.select("rep")), ["rep", "sig"]).select(*_UNIT, "out", "rep", "c", "n", "items")
    rows = rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT)

    def run(batches):
        now, held = None, ([], [])
        for b in batches:
            for *unit, out, rep, c, n, data in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                if unit != now:
                    if held[0] and held[1]:
                        yield from answer(now, *held)
                    now, held = unit, ([], [])
                held[not out].append((rep, c, n, np.frombuffer(data, kind)))
        if held[0] and held[1]:
            yield from answer(now, *held)

    return cut(rows.mapInArrow(tidied(run), schema).distinct())


def _arenas(apart: DataFrame, docs: DataFrame, heads: DataFrame, classes: DataFrame, percent: int, share: int) -> DataFrame:
    """Links (hub, x) between components: of each document, one at least to each component it links with."""

    def columns(members):
        return np.array([m[1] for m in members]), np.array([m[2] for m in members])

    def may(unit, outside, members):
        c, n = columns(members)
        size = min(len(x[3]) for x in [*outside, *members])
        bits = np.stack([_folded(m[3], size) for m in members])
        marked = np.zeros(len(members), bool)
        reps = []
        for x in outside:
            far = np.bitwise_count(bits ^ _folded(x[3], size)).sum(axis=1, dtype=np.int64)
            hit = (c != x[1]) & (x[2] + n - far >= 2 * _need(x[2], n, percent))
            if hit.any():
                marked |= hit
                reps.append((True, x[0], x[2], x[1]))
        reps += [(False, members[k][0], members[k][2], members[k][1]) for k in np.flatnonzero(marked)]
        if reps:
            fixed = [pa.array([v] * len(reps), pa.int64() if k == 0 else pa.int32()) for k, v in enumerate(unit)]
            kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(fixed + [pa.array([r[k] for r in reps], t) for k, t in enumerate(kinds)], names=[*_UNIT, "out", "rep", "n", "c"])

    def link(unit, outside, members):
        c, n = columns(members)
        hub, far = [], []
        root: dict[int, int] = {}  # components of this block: what its links already join needs no other

        def find(v: int) -> int:
            while v in root:
                v = root[v]
            return v

        for x, both in zip(outside, _overlaps([x[3] for x in outside], [m[3] for m in members]), strict=True):
            hit = np.flatnonzero((c != x[1]) & (both >= _need(x[2], n, percent)))
            for k in hit[np.unique(c[hit], return_index=True)[1]]:
                a, b = find(x[1]), find(members[k][1])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    hub.append(members[k][0])
                    far.append(x[0])
        if hub:
            yield pa.RecordBatch.from_arrays([pa.array(hub, pa.int64()), pa.array(far, pa.int64())], names=["hub", "x"])

    short = heads.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "sig", "n", "bits")
    left = _met(_units(apart, percent, share), classes, lambda w: _admitted(short, _bitmap(w), _read_bits), "u1", may, "arena long, b int, mblock int, oblock int, out boolean, rep long, n int, c long")
    release(docs.sparkSession)
    whole = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    return _met(left, classes, lambda w: _admitted(whole, _bitmap(w), _read_text), "<u8", link, "hub long, x long")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest id reachable, of every id in an edge (hub, x). Alternates large-star and small-star steps until
    nothing moves; each step is joins and combinable minima, so no neighbourhood is gathered."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e: (u, v) with u > v. A node's neighbours meet at its least neighbour, itself included.
        way = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = way.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = way.join(least, "u")
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").distinct()

    e = edges.select(F.greatest("hub", "x").alias("u"), F.least("hub", "x").alias("v")).filter("u <> v").distinct()
    e, before = cut(e), None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            break
        before = tuple(mark)
        e = cut(star(star(e, True), False))
    return e.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(e.select("v", F.col("v").alias("c")).distinct())


def _apart(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """Lists whose members are in more than one component, with each member's component, the list's largest one (arena) and the
    number of members outside that."""
    comp = components(edges).withColumnRenamed("v", "rep")
    lists = lists.join(comp, "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    each = lists.groupBy("s", "c").agg(F.count(F.lit(1)).alias("k"))
    main = each.groupBy("s").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("k")).select("s", F.col("main.c").alias("arena"), (F.col("k") - F.col("main.k")).alias("outside"))
    return lists.join(main.filter("outside > 0"), "s")


def _fits(a: str, b: str, percent: int) -> str:
    """Sizes allow the similarity, and the shared shingle's place in each prefix leaves room for the overlap it needs."""
    need = f"ceil({percent} * ({a}.n + {b}.n) / {100 + percent}.0D - 1e-6)"
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND {a}.pos <= {a}.n - {need} AND {b}.pos <= {b}.n - {need}"


def clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, hot: int = 20_000, few: int = 12, share: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    hot: lists of shingles that are known to be in more documents than this are not sorted. few: members outside a list's largest
    component that are paired with the list, so that pairs are so many times its length at most. share: rows of a block.
    """
    spark: SparkSession = ship(df.sparkSession)
    docs = _texts(df, id_col, text_col)
    order = frequent(docs)
    sent = spark.sparkContext.broadcast(order)
    heads = Table(prefixes(docs, sent, percent), "prefixes")
    members = cut(heads.df.select("doc_id", "n", "sig"))
    # classes of equal sets, then groups of equal prefixes and sizes
    classes = cut(heads.df.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("psig").alias("psig")))
    groups = classes.groupBy("n", "psig").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("many"))
    leaders = heads.df.filter("doc_id is not null").select(F.col("doc_id").alias("gid"), "n", "psig", "prefix")
    leaders = leaders.join(groups.select("gid", "n", "psig"), ["gid", "n", "psig"]).dropDuplicates(["gid", "n", "psig"])
    postings = leaders.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "s"))
    hottest = order[0][order[1] > hot].view(np.int64).tolist()  # part of a table of bounded size
    known_hot = F.broadcast(spark.createDataFrame([(x,) for x in hottest], "s long"))
    cold = postings.join(known_hot, "s", "left_anti") if hottest else postings
    found = cold.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("s"))).filter("k > 1").drop("k")
    if hottest:
        found = found.unionByName(postings.join(known_hot, "s", "left_semi"))
    shared = Table(found.select("s", "gid", "n", "pos"), "lists")
    release(spark)
    of = classes.join(groups.filter("many > 1"), ["n", "psig"]).select("gid", "rep", "psig", F.col("n").cast("int").alias("n"))
    many = of.filter("gid <> rep").select("gid", "rep")
    grown = shared.df.join(many, "gid").select("s", "rep", "n", "pos")
    alike = of.select(F.xxhash64("psig").alias("s"), "rep", "n", F.lit(0).alias("pos"))  # members of one group meet in a list of their own
    lists = shared.df.select("s", F.col("gid").alias("rep"), "n", "pos").unionByName(grown).unionByName(alike)
    near = Window.partitionBy("s").orderBy("n")
    some = lists.join(known_hot, "s", "left_anti") if hottest else lists
    sized = some.withColumn("up", F.lead("n").over(near)).withColumn("down", F.lag("n").over(near)).filter(f"100 * n >= {percent} * up or 100 * down >= {percent} * n").drop("up", "down")
    if hottest:
        sized = sized.unionByName(lists.join(known_hot, "s", "left_semi"))
    sized = Table(sized.select("s", "rep", "n", "pos"), "sized")
    shared.drop()
    lists = sized.df
    hubs = lists.groupBy("s").agg(F.min(F.struct("rep", "n", "pos")).alias("hub"), F.count(F.lit(1)).alias("k"))
    placed = lists.select("s", F.struct("rep", "n", "pos").alias("x")).join(hubs, "s").filter("hub.rep <> x.rep").withColumn("fits", F.expr(_fits("hub", "x", percent)))
    placed = Table(placed.filter("fits or k > 2").select("s", "x.*", F.col("hub.rep").alias("hub"), "fits", "k"), "placed")
    sized.drop()
    pairs = cut(placed.df.filter("fits").select("hub", F.col("rep").alias("x")).distinct())
    stars = _verified(pairs, docs, heads.df, classes, percent)
    release(spark)
    # what a list's hub was tried against needs no more of this list: it goes on without its hub
    rest = Table(_apart(placed.df.filter("k > 2").select("s", "rep", "n", "pos"), stars), "rest")
    placed.drop()
    near = rest.df.filter(F.col("outside") <= few)
    more = near.filter("c <> arena").alias("a").join(near.alias("b"), F.expr(f"a.s = b.s AND a.c <> b.c AND (b.c = b.arena OR a.rep < b.rep) AND {_fits('a', 'b', percent)}"))
    more = more.select(F.expr("least(a.rep, b.rep)").alias("hub"), F.expr("greatest(a.rep, b.rep)").alias("x")).distinct()
    more = cut(more.join(pairs, ["hub", "x"], "left_anti"))
    links = _verified(more, docs, heads.df, classes, percent)
    release(spark)
    edges = stars.unionByName(links).unionByName(_arenas(rest.df.filter(F.col("outside") > few), docs, heads.df, classes, percent, share))
    rest.drop()
    release(spark)
    heads.drop()
    comp = cut(components(edges)).withColumnRenamed("v", "rep")
    whole = classes.select("sig", "rep").join(comp, "rep", "left").select("sig", F.coalesce("c", "rep").alias("c"))
    out = members.join(whole, "sig", "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's own rows and columns: those whose id is their component's smallest. Rows without words all stay."""
    found = clusters(df, id_col, text_col)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_pm_gone")).distinct()
    return df.join(gone, df[id_col].cast("long") == F.col("_pm_gone"), "left_anti")
