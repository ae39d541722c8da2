"""Language identification by a byte convolutional network, written and trained in numpy.

Bytes of the lower-cased text are embedded; filters of several widths run over windows of fixed length; the largest response
of each filter over a window feeds a softmax. A width's filters are a sum of one table look-up for each byte they span, so
both directions are look-ups and small matrix products. A text's windows cover all of it; their probabilities, weighted by the
bytes they hold, are averaged.

The network is fitted on a bounded sample: up to per_lang texts of each of the most_langs languages with most rows, of which
snippets of snippet_chars characters at two places are taken. Languages are counted first, so that each row decides by a hash
whether it can be in the sample, and what is sorted by language is about twice the sample at any input.

Null text, or text without a letter (general category L), is `und` with score 0; so is every row if nothing can be learned (an
empty table, no labels). Null ids are carried along; rows that repeat an id are answered each. Very long texts are read whole.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import ship, tidied
from pixelmill.llm.tokens import some

LETTER = regex.compile(r"\p{L}")
WINDOW = 192


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all texts' bytes in rows of WINDOW, the last of each filled up with zeros; bytes that each row holds; each text's first row)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    count = np.maximum(1, -(-size // WINDOW))
    first = np.cumsum(count) - count
    held = np.full(count.sum(), WINDOW, np.int64)
    held[first + count - 1] = size - WINDOW * (count - 1)
    data = b"".join(x.ljust(n * WINDOW, b"\0") for x, n in zip(texts, count.tolist(), strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), held, first


class Network:
    def __init__(self, classes: int, widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, embed: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        self.widths = widths
        self.p = {"E": r.normal(0, 0.5, (256, embed)), "out": r.normal(0, 0.3, (filters * len(widths), classes)), "bias": np.zeros(classes)}
        for w in widths:
            self.p[f"W{w}"] = r.normal(0, 1 / np.sqrt(w * embed), (w, embed, filters))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def tables(self) -> dict[int, np.ndarray]:
        """For each width: what a byte at each place adds to each filter, (width, 256, filters)."""
        return {w: np.einsum("be,wef->wbf", self.p["E"], self.p[f"W{w}"], optimize=True).astype(np.float32) for w in self.widths}

    def features(self, x: np.ndarray, tables: dict[int, np.ndarray], where: bool = False):
        pooled, at = [], []
        for w, t in tables.items():
            n = x.shape[1] - w + 1
            h = t[0][x[:, :n]]
            for k in range(1, w):
                h += t[k][x[:, k : n + k]]
            if where:
                at.append(h.argmax(axis=1))
            pooled.append(h.max(axis=1))
        out = np.maximum(np.concatenate(pooled, axis=1), 0)
        return (out, at) if where else out

    def probabilities(self, x: np.ndarray, tables: dict[int, np.ndarray], rows: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.p["bias"])), np.float32)
        for i in range(0, len(x), rows):
            z = self.features(x[i : i + rows], tables) @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + rows] = z / z.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tables = self.tables()
        f, at = self.features(x, tables, where=True)
        z = f @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        g = {"out": f.T @ z, "bias": z.sum(axis=0), "E": np.zeros_like(self.p["E"])}
        back = (z @ self.p["out"].T) * (f > 0)
        size = self.p[f"W{self.widths[0]}"].shape[2]
        for i, w in enumerate(self.widths):
            part = back[:, i * size : (i + 1) * size]
            dw = np.empty_like(self.p[f"W{w}"])
            for k in range(w):  # a filter's gradient goes to the bytes at its largest response alone
                dt = np.zeros((256, size), np.float32)
                np.add.at(dt, (np.take_along_axis(x, at[i] + k, axis=1), np.arange(size)[None, :]), part)
                g["E"] += dt @ self.p[f"W{w}"][k].T
                dw[k] = self.p["E"].T @ dt
            g[f"W{w}"] = dw
        return g


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on shuffled batches, the rate falling to a tenth."""
    net, r = Network(classes, seed=seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    step, last = 0, max(1, epochs * -(-len(x) // batch))
    for _ in range(epochs):
        order = r.permutation(len(x))
        for i in range(0, len(x), batch):
            step += 1
            lr = rate * (1 - 0.9 * step / last)
            for k, g in net.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


def sample(rows: DataFrame, text_col: str, lang_col: str, order_col: str, per_lang: int, most_langs: int, snippet_chars: int, seed: int) -> DataFrame:
    """(lang, r, text, more): two snippets of each text that the fit learns from."""
    t = F.col(text_col).cast("string")
    rows = rows.filter(t.isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), t.alias("whole"), F.col(order_col).alias("key"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()  # most_langs rows at most
    shares = F.broadcast(rows.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * per_lang / r["count"])) for r in counts], "lang string, share double"))
    place = F.xxhash64("key", "whole", F.lit(seed))
    near = rows.withColumn("place", place).join(shares, "lang").filter((F.col("share") >= 1) | (F.pmod("place", F.lit(1 << 30)) < F.col("share") * (1 << 30)))
    room = F.greatest(F.length("whole") - snippet_chars, F.lit(0)) + 1
    snippet = lambda k: F.substr("whole", (F.pmod(F.xxhash64("place", F.lit(k)), room) + 1).cast("int"), F.lit(snippet_chars))
    near = near.filter(F.col("whole").rlike(r"\p{L}")).select("lang", "place", snippet(0).alias("text"), snippet(1).alias("more"))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).filter(F.col("r") <= per_lang).select("lang", "r", "text", "more")


def fit(train_rows: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", per_lang: int = 600, most_langs: int = 500, snippet_chars: int = 400, seed: int = 5):
    """(languages, network) from a bounded sample of labelled rows, or None if there is none."""
    got = sorted(map(tuple, sample(train_rows, text_col, lang_col, order_col, per_lang, most_langs, snippet_chars, seed).collect()))
    langs = sorted({g[0] for g in got})
    if not langs:
        return None
    x, y = [], []
    for lang, _, *texts in got:
        for s in texts:
            if LETTER.search(s):
                w = windows([s.lower().encode()])[0][:2]
                x.append(w)
                y += [langs.index(lang)] * len(w)
    return langs, train(np.concatenate(x), np.array(y), len(langs), seed=seed)


def predict(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone."""
    spark = ship(df.sparkSession)
    sent = spark.sparkContext.broadcast(model and (np.array([*model[0], "und"], object), model[1], model[1].tables()))

    def answer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        names, net, tables = sent.value or (np.array(["und"], object), None, None)
        best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        told = [i for i, t in enumerate(texts) if net is not None and t is not None and LETTER.search(t)]
        if told:
            x, held, first = windows([texts[i].lower().encode() for i in told])
            p = np.add.reduceat(net.probabilities(x, tables) * held[:, None], first, axis=0) / np.add.reduceat(held, first)[:, None]
            best[told], score[told] = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
        return names[best], score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in some([t or "" for t in texts], 1 << 20):
                lang, score = answer(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the rows that are not held out, applied to all."""
    model = fit(df.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = predict(df, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
