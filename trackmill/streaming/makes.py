"""Crossing events from a live track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackmill.functions.geometry import Box, above_band, side_band, through_band
from trackmill.operators.events import BOUNCE_MS, COOLDOWN_MS, MAX_GAP_MS, NEVER
from trackmill.streaming.state import need_rocks

OUT = "video_id bigint, above_ms bigint, through_ms bigint, make_ms bigint"


class MakeFinder(StatefulProcessor):
    """Per recording: rows wait until the look-ahead after them is complete, then follow the rule in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rule = handle.getValueState("rule", "above bigint, last bigint")
        self.waiting = handle.getListState("waiting", "t bigint, kind string, high boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(r) for pdf in rows for r in pdf[["t_ms", "kind", "high"]].itertuples(index=False)]
        had = self.waiting.exists()
        self.waiting.appendList([(int(t), str(k), bool(h)) for t, k, h in fresh])
        if not had:
            self.handle.registerTimer(min(t for t, _, _ in fresh) + BOUNCE_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        above, last = self.rule.get() if self.rule.exists() else (NEVER, NEVER)
        found, ready = [], 0
        for ready, (t, kind, _) in enumerate(rows):
            if t + BOUNCE_MS >= now:
                break
            if kind == "reset":
                above = NEVER
            elif kind == "set":
                above = t
            elif kind == "through" and t - above <= MAX_GAP_MS and t - last > COOLDOWN_MS:
                ahead = (r for r in rows[ready + 1:] if r[0] <= t + BOUNCE_MS)
                if not any(high for _, _, high in ahead):
                    found.append((key[0], above, t, (above + t) // 2))
                    last = t
                above = NEVER
        else:
            ready = len(rows)
        self.rule.update((above, last))
        if rows[ready:]:
            self.waiting.put([(int(t), str(k), bool(h)) for t, k, h in rows[ready:]])
            self.handle.registerTimer(max(rows[ready][0] + BOUNCE_MS, now + 1))
        else:
            self.waiting.clear()
        yield pd.DataFrame(found, columns=["video_id", "above_ms", "through_ms", "make_ms"])

    def close(self) -> None:
        pass


def stream_makes(track: DataFrame, b: Box, lateness: str = "2 seconds") -> DataFrame:
    """Streaming find_makes over track(video_id, t_ms, cx, cy); an event appears once its look-ahead is over.

    Rows later than `lateness` are dropped by the watermark. Rows that can neither
    change the rule's state nor veto an event never reach the state store.
    """
    need_rocks(track.sparkSession)
    cx, cy = F.col("cx"), F.col("cy")
    kind = (
        F.when(~side_band(b, cx), "reset").when(above_band(b, cy), "set").when(through_band(b, cy), "through")
        .otherwise("skip")
    )
    d = track.where("cx is not null").select(
        "video_id", "t_ms", F.timestamp_millis("t_ms").alias("at"), kind.alias("kind"), (cy < b.y1).alias("high")
    ).where((F.col("kind") != "skip") | F.col("high"))
    return d.withWatermark("at", lateness).groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=MakeFinder(), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )
