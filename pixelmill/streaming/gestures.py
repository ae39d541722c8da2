"""Pointer events as a stream: per-session view state, kept by Spark between batches.

The scalar functions of this library are column expressions and run on streaming DataFrames unchanged; this module has
the operator that needs memory of earlier events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixelmill.session import ship

#: Two taps within this time and distance are one double tap; what it zooms to.
DOUBLE_TAP_MS, DOUBLE_TAP_SLOP, DOUBLE_TAP_SCALE = 300, 48.0, 2.0
OUTPUT = "session long, events long, taps long, double_taps long, drag_x double, drag_y double, scale double"
STATE = "events long, taps long, double_taps long, drag_x double, drag_y double, scale double, last_ms long, last_x double, last_y double"


def fold(state: tuple, rows: list[tuple[int, str, float, float, float]]) -> tuple:
    """state after events (ms, kind, x, y, value): tap at a place, drag by a way, pinch by a factor limited to 1..10."""
    events, taps, doubles, dx, dy, scale, last_ms, last_x, last_y = state
    for ms, kind, x, y, value in rows:
        events += 1
        if kind == "tap":
            near = abs(x - last_x) <= DOUBLE_TAP_SLOP and abs(y - last_y) <= DOUBLE_TAP_SLOP
            if last_ms >= 0 and 0 <= ms - last_ms <= DOUBLE_TAP_MS and near:
                doubles += 1
                scale = 1.0 if scale > 1.0 else DOUBLE_TAP_SCALE
                last_ms = -1
            else:
                taps += 1
                last_ms, last_x, last_y = ms, x, y
        elif kind == "drag":
            dx, dy = dx + x, dy + y
        elif kind == "pinch" and value > 0:
            scale = min(10.0, max(1.0, scale * value))
    return events, taps, doubles, dx, dy, scale, last_ms, last_x, last_y


START = (0, 0, 0, 0.0, 0.0, 1.0, -1, 0.0, 0.0)


def sessions(events: DataFrame, session: str = "session", ms: str = "ms", kind: str = "kind", x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """A row for each session touched in a batch: its totals so far. Works on streaming and on batch input."""
    ship(events.sparkSession)
    rows = events.select(F.col(session).cast("long").alias("session"), F.col(ms).cast("long").alias("ms"), F.col(kind).alias("kind"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in ((x, "x"), (y, "y"), (value, "value"))))

    def ordered(pdfs) -> list[tuple]:
        got = pd.concat(list(pdfs)).sort_values(["ms", "kind", "x", "y", "value"])
        return list(got[["ms", "kind", "x", "y", "value"]].itertuples(index=False, name=None))

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = fold(tuple(state.get) if state.exists else START, ordered(pdfs))
        state.update(now)
        yield pd.DataFrame([(key[0], *now[:6])], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    if events.isStreaming:
        return rows.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)

    def once(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["session"].iloc[0], *fold(START, ordered([pdf]))[:6])], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return rows.groupBy("session").applyInPandas(once, OUTPUT)
