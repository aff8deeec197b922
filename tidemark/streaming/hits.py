"""The streaming face: window votes as hits arrive, and min-gap deduplication with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HIT = "tv string, clip string, start double, length double, score double"
STATE = "start double, length double, score double, ms long"


def window_scores(hits: DataFrame, ts: str = "ts", *, delay: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Hits, mean and largest score of each clip in tumbling time windows; late rows beyond ``delay`` are left out."""
    return hits.withWatermark(ts, delay).groupBy(F.window(ts, width), "tv", "clip").agg(F.count("*").alias("votes"), F.avg("score").alias("avg_score"), F.max("score").alias("best_score"))


def min_gap(hits: DataFrame, gap: float, ts: str = "ts", *, delay: str = "10 seconds") -> DataFrame:
    """Hits of one video and clip, at least ``gap`` seconds apart: of closer ones the better, as the batch fold has it.

    Hits come in order of their start within a key. A hit is given out when the next one is far enough away, or when
    the watermark has passed its time by more than ``gap``, so that none that could compete is still to come.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(held)
            state.remove()
        else:
            rows = sorted(r for b in batches for r in zip(b["start"], b["length"], b["score"], b["ms"]))
            for r in rows:
                if held is None:
                    held = r
                elif r[0] - held[0] < gap:
                    held = r if r[2] > held[2] else held
                else:
                    out.append(held)
                    held = r
            state.update(tuple(held))
            state.setTimeoutTimestamp(int(max(held[3] + gap * 1000, state.getCurrentWatermarkMs()) + 1))
        if out:
            yield pd.DataFrame([(*key, *r[:3]) for r in out], columns=["tv", "clip", "start", "length", "score"])

    timed = hits.withWatermark(ts, delay).select("tv", "clip", "start", "length", "score", ts, F.unix_millis(ts).alias("ms"))
    return timed.groupBy("tv", "clip").applyInPandasWithState(fold, HIT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
