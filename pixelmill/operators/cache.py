"""A byte-budgeted least-recently-used cache, replayed over a log of accesses per key.

State per key is the cache's entries, bounded by its budget; a key's log is read in order, in Arrow batches.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import ship


class Lru:
    def __init__(self, budget: int):
        if budget <= 0:
            raise ValueError("the budget must be above zero")
        self.budget, self.bytes, self.evicted = budget, 0, 0
        self.held: OrderedDict[str, int] = OrderedDict()

    def get(self, name: str) -> bool:
        """Whether it is held; it becomes the most recent."""
        if name not in self.held:
            return False
        self.held.move_to_end(name)
        return True

    def peek(self, name: str) -> bool:
        return name in self.held

    def put(self, name: str, size: int) -> list[str]:
        """Names that had to go, oldest first - itself among them if it alone is over the budget."""
        self.bytes -= self.held.pop(name, 0)
        self.held[name] = size
        self.bytes += size
        gone = []
        while self.bytes > self.budget and self.held:
            old, n = self.held.popitem(last=False)
            self.bytes -= n
            self.evicted += 1
            gone.append(old)
        return gone


def replay(df: DataFrame, key: str, order: str, op: str, name: str, size: str, budget: int) -> DataFrame:
    """key, order, hit, bytes, evicted after each access: op is get, put or contains."""
    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), F.col(op).alias("op"), F.col(name).cast("string").alias("name"), F.col(size).cast("long").alias("size"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cache, out = Lru(budget), []
        for r in pdf.sort_values(["at", "op", "name"]).itertuples(index=False):
            hit = cache.get(r.name) if r.op == "get" else cache.peek(r.name)
            if r.op == "put":
                cache.put(r.name, int(r.size))
            out.append((r.key, r.at, hit, cache.bytes, cache.evicted))
        return pd.DataFrame(out, columns=["key", "at", "hit", "bytes", "evicted"])

    return rows.groupBy("key").applyInPandas(one, "key long, at long, hit boolean, bytes long, evicted long")
