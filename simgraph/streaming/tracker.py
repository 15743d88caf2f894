"""The tracker over a stream: one state an asset, kept from batch to batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.entities import Tracker


def track_stream(detections: DataFrame, idle_ms: int = 600_000, **settings) -> DataFrame:
    """``(asset_id, source, track_id, x1, y1, x2, y2)`` of tracks seen in each frame.

    A frame's detections must come in one batch, and an asset's frames in order. An asset without
    detections for ``idle_ms`` loses its state.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["asset_id", "source", "track_id", "x1", "y1", "x2", "y2"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=cols)
            return
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(**settings)
        rows, out = pd.concat(list(parts)), []
        for source, f in rows.sort_values("source").groupby("source", sort=True):
            for tid, box in tracker.step(f[["x1", "y1", "x2", "y2"]].to_numpy(float), f["confidence"].to_numpy(float)):
                out.append((key[0], source, tid, *map(float, box)))
        state.update((pickle.dumps(tracker),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=cols)

    kinds = {f.name: f.dataType.simpleString() for f in detections.schema}
    schema = f"asset_id {kinds['asset_id']}, source {kinds['source']}, track_id int, x1 double, y1 double, x2 double, y2 double"
    return detections.groupBy("asset_id").applyInPandasWithState(run, schema, "tracker binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
