"""Detections as a stream: tracks kept live across micro-batches, and windowed counts with a watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import greedy

OUT = "media_id long, label string, frame long, det_no long, track_no int"
STATE = "live string"


def associate_stream(dets: DataFrame, most_missed: int = 8, least: float = 0.3, idle: str | None = None) -> DataFrame:
    """(media_id, label, frame, det_no, track_no) of a stream of detections, the numbers the batch operator gives.

    The state of a medium's label is its live tracks, closed after ``most_missed`` frames, so it stays bounded.  A frame
    comes whole in one micro-batch and after all earlier frames of its medium.  ``idle`` (such as ``10 minutes``) ends a
    label's state when nothing came for so long; its numbers then start again at 0.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    wait = _milliseconds(idle)

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        kept = json.loads(state.get[0]) if state.exists else {"live": [], "made": 0}
        pdf = pd.concat(list(frames)).sort_values(["frame", "det_no"], ignore_index=True)
        n = greedy.associate(list(pdf[["frame", "score", *"xywh"]].itertuples(index=False, name=None)), most_missed, least, kept)
        state.update((json.dumps(kept, default=float),))
        if wait is not None:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({"media_id": key[0], "label": key[1], "frame": pdf["frame"], "det_no": pdf["det_no"], "track_no": n})

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return dets.groupBy("media_id", "label").applyInPandasWithState(run, OUT, STATE, "append", timeout)


def _milliseconds(span: str | None) -> int | None:
    if span is None:
        return None
    n, unit = span.split()
    return int(float(n) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key; a window is given out, once, when the watermark has passed its end."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), by, "n")
