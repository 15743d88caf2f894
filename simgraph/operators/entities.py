"""From detections and faces to tracked entities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bbox import iou


def cols(prefix: str = ""):
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def best_match(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, min_iou: float) -> DataFrame:
    """For each left box the right one of the same frame with the greatest overlap above ``min_iou``."""
    r = right.select(*on, F.col(right_id).alias("_rid"), *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    m = left.join(r, on).withColumn("iou", iou(cols(), cols("r_"))).filter(F.col("iou") > min_iou)
    best = m.groupBy(*on, left_id).agg(F.max_by(F.struct("_rid", "iou"), F.struct("iou", -F.col("_rid"))).alias("m"))
    return best.select(*on, left_id, F.col("m._rid").alias(right_id), F.col("m.iou").alias("iou"))


def greedy_match(tracks: DataFrame, detections: DataFrame, on: list[str], min_iou: float) -> DataFrame:
    """One-to-one: tracks in order of id each take the unused detection of greatest overlap above ``min_iou``.

    Only pairs that overlap enough meet. A frame's pairs are one array, sorted by track, overlap and detection, and folded
    in the JVM: a track that is not served yet takes its first detection that is not used yet.
    """
    d = detections.select(*on, "det_id", *[F.col(c).alias(f"d_{c}") for c in ("x1", "y1", "x2", "y2")])
    t = tracks.select(*on, "track_id", "x1", "y1", "x2", "y2")
    m = t.join(d, on).withColumn("iou", iou(cols(), cols("d_"))).filter(F.col("iou") > min_iou).select(*on, "track_id", "det_id", "iou")
    pair = F.struct("track_id", (-F.col("iou")).alias("less"), "det_id")
    per = m.groupBy(*on).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    kind = m.select(F.array(pair)).schema[0].dataType.simpleString()
    taken = F.aggregate(
        "pairs",
        F.array().cast(kind),
        lambda done, p: F.when(F.exists(done, lambda d: (d["track_id"] == p["track_id"]) | (d["det_id"] == p["det_id"])), done).otherwise(F.concat(done, F.array(p))),
    )
    out = per.select(*on, F.explode(taken).alias("p"))
    return out.select(*on, "p.track_id", "p.det_id", (-F.col("p.less")).alias("iou"))


def detections_by_frame(persons: DataFrame) -> DataFrame:
    """``(asset_id, source, detections)`` of documents (asset_id, detections): each keeps its place among all of the asset."""
    each = persons.select("asset_id", F.posexplode("detections").alias("det_index", "d"))
    each = each.select("asset_id", "d.source", F.struct("det_index", *[F.col(f"d.{c}").alias(c) for c in ("bbox", "confidence")]).alias("d"))
    return each.groupBy("asset_id", "source").agg(F.array_sort(F.collect_list("d"), lambda x, y: x["det_index"] - y["det_index"]).alias("detections"))


def at_sources(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections with the frame of their asset that bears their source's name."""
    return detections.join(frames, ["asset_id", "source"])


def with_faces(entities: DataFrame) -> DataFrame:
    """Entities that any frame shows a face of; only these go on to face embeddings."""
    return entities.filter("has_face")


def faces_by_detection(detections: DataFrame, faces: DataFrame) -> DataFrame:
    """Detections with the array of their faces, empty where there are none."""
    per = faces.groupBy("asset_id", "det_id").agg(F.array_sort(F.collect_list(F.struct("face_id", "confidence"))).alias("faces"))
    none = F.array().cast("array<struct<face_id:bigint,confidence:double>>")
    return detections.join(per, ["asset_id", "det_id"], "left").withColumn("faces", F.coalesce("faces", none))


def assemble(frames: DataFrame, key: list[str], min_frames: int = 1) -> DataFrame:
    """One row an entity: its frames in order of source, their number, and whether any has a face."""
    f = frames.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("source", "det_id", "faces"))).alias("frames"))
    f = f.withColumns({"frame_count": F.size("frames"), "has_face": F.exists("frames", lambda x: F.size(x["faces"]) > 0)})
    f = f.filter(F.col("frame_count") >= min_frames)
    return f.withColumn("entity_id", F.sha1(F.concat(*[F.col(k).cast("string") for k in key])))


def _kalman_mats() -> tuple[np.ndarray, np.ndarray]:
    move = np.eye(8)
    move[:4, 4:] = np.eye(4)
    return move, np.eye(4, 8)


def _assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Least-cost one-to-one assignment below ``limit``, by shortest augmenting paths."""
    n, m = cost.shape
    if not n or not m:
        return []
    size = n + m
    c = np.full((size, size), limit)
    c[:n, :m] = np.where(cost <= limit, cost, 1e6)
    c[n:, m:] = 0
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    match = np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = c[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, low[1:], np.inf))) + 1
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if 0 < match[j] <= n and cost[match[j] - 1, j - 1] <= limit]


class Tracker:
    """Two-stage association of boxes with Kalman-filtered tracks of one sequence.

    Boxes at ``track_thresh`` or above are matched first with live and lost tracks, those above 0.1 then with
    the live tracks that are left; what remains of the first starts new tracks. Ids start at 1.
    """

    def __init__(self, track_thresh: float = 0.3, match_thresh: float = 0.8, track_buffer: int = 30, frame_rate: int = 30) -> None:
        self.high, self.match, self.keep = track_thresh, match_thresh, int(frame_rate / 30 * track_buffer)
        self.tracks: list[dict] = []
        self.next, self.frame = 1, 0
        self.move, self.see = _kalman_mats()

    @staticmethod
    def _to_state(b: np.ndarray) -> np.ndarray:
        w, h = b[2] - b[0], max(b[3] - b[1], 1e-6)
        return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, w / h, h])

    @staticmethod
    def _to_box(s: np.ndarray) -> np.ndarray:
        w = s[2] * s[3]
        return np.array([s[0] - w / 2, s[1] - s[3] / 2, s[0] + w / 2, s[1] + s[3] / 2])

    @staticmethod
    def _spread(h: float) -> np.ndarray:
        return np.array([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160])

    def _predict(self, t: dict) -> None:
        t["x"] = self.move @ t["x"]
        t["p"] = self.move @ t["p"] @ self.move.T + np.diag(self._spread(t["x"][3]) ** 2)

    def _update(self, t: dict, b: np.ndarray) -> None:
        z = self._to_state(b)
        h = t["x"][3]
        s = self.see @ t["p"] @ self.see.T + np.diag(np.array([h / 20, h / 20, 1e-1, h / 20]) ** 2)
        gain = t["p"] @ self.see.T @ np.linalg.inv(s)
        t["x"] = t["x"] + gain @ (z - self.see @ t["x"])
        t["p"] = t["p"] - gain @ self.see @ t["p"]
        t["seen"], t["state"] = self.frame, "live"

    @staticmethod
    def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(a) or not len(b):
            return np.zeros((len(a), len(b)))
        w = np.clip(np.minimum(a[:, None, 2], b[:, 2]) - np.maximum(a[:, None, 0], b[:, 0]), 0, None)
        h = np.clip(np.minimum(a[:, None, 3], b[:, 3]) - np.maximum(a[:, None, 1], b[:, 1]), 0, None)
        area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        return w * h / np.maximum(area(a)[:, None] + area(b) - w * h, 1e-6)

    def _associate(self, tracks: list[dict], boxes: np.ndarray, limit: float):
        cost = 1 - self.overlaps(np.array([self._to_box(t["x"]) for t in tracks]).reshape(-1, 4), boxes)
        got = _assign(cost, limit)
        for i, j in got:
            self._update(tracks[i], boxes[j])
            tracks[i]["hit"] = True
        rest = sorted(set(range(len(boxes))) - {j for _, j in got})
        return [t for k, t in enumerate(tracks) if k not in {i for i, _ in got}], rest

    def step(self, boxes: np.ndarray, conf: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """``(track id, box)`` of the tracks seen in this frame."""
        self.frame += 1
        boxes, conf = np.asarray(boxes, float).reshape(-1, 4), np.asarray(conf, float)
        strong, weak = boxes[conf >= self.high], boxes[(conf < self.high) & (conf > 0.1)]
        born = conf[conf >= self.high]
        for t in self.tracks:
            self._predict(t)
            t["hit"] = False
        sure = [t for t in self.tracks if t["state"] in ("live", "lost")]
        left, rest = self._associate(sure, strong, self.match)
        left, _ = self._associate([t for t in left if t["state"] == "live"], weak, 0.5)
        for t in left:
            t["state"] = "lost"
        new = [t for t in self.tracks if t["state"] == "new"]
        strong_left, born_left = strong[rest], born[rest]
        gone, rest = self._associate(new, strong_left, 0.7)
        drop = {id(t) for t in gone}
        self.tracks = [t for t in self.tracks if id(t) not in drop and self.frame - t["seen"] <= self.keep]
        for j in rest:
            if born_left[j] >= self.high + 0.1:
                s = self._to_state(strong_left[j])
                p = np.diag((self._spread(s[3]) * np.array([2, 2, 1, 2, 10, 10, 1, 10])) ** 2)
                self.tracks.append({"id": self.next, "x": np.concatenate([s, np.zeros(4)]), "p": p, "seen": self.frame, "state": "live" if self.frame == 1 else "new", "hit": self.frame == 1})
                self.next += 1
        return [(t["id"], self._to_box(t["x"])) for t in self.tracks if t["hit"] and t["state"] == "live"]


def track(detections: DataFrame, min_iou: float = 0.2, **settings) -> DataFrame:
    """``(asset_id, source, track_id, det_id, iou)``: each asset's detections followed from frame to frame.

    An asset's frames are one sequence and stay in one task; ids restart in every asset. Each tracked box
    takes the unused detection it overlaps most. ``source`` orders the frames.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tracker, out = Tracker(**settings), []
        for source, f in g.sort_values(["source", "det_id"]).groupby("source", sort=True):
            boxes = f[["x1", "y1", "x2", "y2"]].to_numpy(float)
            seen = tracker.step(boxes, f["confidence"].to_numpy(float))
            used: set[int] = set()
            for tid, box in sorted(seen, key=lambda x: x[0]):
                o = tracker.overlaps(box[None], boxes)[0]
                o[list(used)] = -1
                if len(o) and o.max() > min_iou:
                    k = int(o.argmax())
                    used.add(k)
                    out.append((g["asset_id"].iloc[0], source, tid, int(f["det_id"].iloc[k]), float(o[k])))
        return pd.DataFrame(out, columns=["asset_id", "source", "track_id", "det_id", "iou"])

    kinds = {f.name: f.dataType.simpleString() for f in detections.schema}
    schema = f"asset_id {kinds['asset_id']}, source {kinds['source']}, track_id int, det_id long, iou double"
    return detections.groupBy("asset_id").applyInPandas(run, schema)
