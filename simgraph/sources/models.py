"""The slots for models: batches in, rows out, loaded once a task. No model is shipped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.raster import crop
from ..functions.vector import mean_of, unit


class Found(NamedTuple):
    """A box x1, y1, x2, y2 in pixels of the image it was found in."""

    box: tuple[float, float, float, float]
    confidence: float
    embedding: list[float] | None = None


class Detector(Protocol):
    """Persons, or faces, in BGR images."""

    def detect(self, images: list[np.ndarray]) -> list[list[Found]]: ...


class Embedder(Protocol):
    def embed(self, images: list[bytes]) -> np.ndarray: ...


class StubEmbedder:
    """Unit vectors drawn from a content's hash; for tests."""

    def __init__(self, dim: int = 16) -> None:
        self.dim = dim

    def embed(self, images: list[bytes]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(x).digest()[:8], "little") for x in images]
        v = np.stack([np.random.default_rng(s).normal(size=self.dim) for s in seeds])
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def embed(df: DataFrame, make: Callable[[], Embedder], modality: str, id_col: str = "id", content: str = "content") -> DataFrame:
    """``(id, modality, embedding)`` by a model that ``make`` builds once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b[id_col].astype(str), "modality": modality, "embedding": list(model.embed([bytes(x) for x in b[content]]))})

    return df.select(id_col, content).mapInPandas(run, "id string, modality string, embedding array<double>")


def _image(r) -> np.ndarray:
    return np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)


def _clamped(box, w: int, h: int):
    x1, y1, x2, y2 = (min(max(v, 0), m) for v, m in zip(box, (w, h, w, h), strict=True))
    return (x1, y1, x2, y2) if x2 > x1 and y2 > y1 else None


_BOX = "x1 double, y1 double, x2 double, y2 double, confidence double"


def detect_persons(rasters: DataFrame, make: Callable[[], Detector], confidence: float = 0.3) -> DataFrame:
    """``(asset_id, source, det_id, x1, y1, x2, y2, confidence)`` of persons in rasters (asset_id, frame_index, height, width, pixels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            rows = list(b.itertuples(index=False))
            found = model.detect([_image(r) for r in rows]) if rows else []
            out = [(str(r.asset_id), int(r.frame_index), k, *map(float, f.box), float(f.confidence)) for r, fs in zip(rows, found, strict=True) for k, f in enumerate(f for f in fs if f.confidence >= confidence)]
            yield pd.DataFrame(out, columns=["asset_id", "source", "det_id", "x1", "y1", "x2", "y2", "confidence"])

    return rasters.mapInPandas(run, f"asset_id string, source int, det_id long, {_BOX}")


def detect_faces(rasters: DataFrame, persons: DataFrame, make: Callable[[], Detector], confidence: float = 0.6) -> DataFrame:
    """``(asset_id, source, det_id, x1, y1, x2, y2, confidence, embedding)`` of faces inside each person's box, in the image's pixels."""
    p = persons.select(F.col("asset_id").cast("string").alias("asset_id"), F.col("source").alias("frame_index"), "det_id", "x1", "y1", "x2", "y2")
    met = p.join(rasters.withColumn("asset_id", F.col("asset_id").cast("string")), ["asset_id", "frame_index"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            rows = [(r, _image(r), box) for r in b.itertuples(index=False) if (box := _clamped((r.x1, r.y1, r.x2, r.y2), r.width, r.height))]
            rows = [(r, cut, box) for r, img, box in rows if (cut := crop(img, box)).size]
            found = model.detect([cut for _, cut, _ in rows]) if rows else []
            out = []
            for (r, _, box), fs in zip(rows, found, strict=True):
                for f in fs:
                    moved = _clamped((f.box[0] + box[0], f.box[1] + box[1], f.box[2] + box[0], f.box[3] + box[1]), r.width, r.height)
                    if f.confidence >= confidence and moved:
                        out.append((r.asset_id, int(r.frame_index), int(r.det_id), *map(float, moved), float(f.confidence), f.embedding))
            yield pd.DataFrame(out, columns=["asset_id", "source", "det_id", "x1", "y1", "x2", "y2", "confidence", "embedding"])

    return met.mapInPandas(run, f"asset_id string, source int, det_id long, {_BOX}, embedding array<double>")


def embed_crops(rasters: DataFrame, boxes: DataFrame, make: Callable[[], Embedder], modality: str, prepare: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(id, modality, embedding)``: unit mean of the embeddings of an entity's crops (entity_id, asset_id, source, box).

    ``prepare`` makes a model's input of a crop; boxes are cut to the image, and empty ones skipped.
    """
    p = boxes.select(F.col("entity_id").cast("string").alias("id"), F.col("asset_id").cast("string").alias("asset_id"), F.col("source").alias("frame_index"), "x1", "y1", "x2", "y2")
    met = p.join(rasters.withColumn("asset_id", F.col("asset_id").cast("string")), ["asset_id", "frame_index"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            rows = [(r.id, crop(_image(r), box)) for r in b.itertuples(index=False) if (box := _clamped((r.x1, r.y1, r.x2, r.y2), r.width, r.height))]
            rows = [(i, prepare(c)) for i, c in rows if c.size]
            if rows:
                yield pd.DataFrame({"id": [i for i, _ in rows], "embedding": list(model.embed([c.tobytes() for _, c in rows]))})

    each = met.mapInPandas(run, "id string, embedding array<double>").withColumn("embedding", unit(F.col("embedding")))
    return mean_of(each, "id", "embedding").select("id", F.lit(modality).alias("modality"), unit(F.col("vector")).alias("embedding"))


def dense_embeddings(wanted: DataFrame, cached: DataFrame, frames: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """``(asset_id, frame_index, embedding)`` of the wanted assets, embedded once each: those of ``cached`` are not made again.

    ``frames`` is (asset_id, frame_index, content); an asset in many pairs comes once.
    """
    need = wanted.select("asset_id").distinct()
    have = cached.join(need, "asset_id", "left_semi").select("asset_id", "frame_index", F.col("embedding").cast("array<double>").alias("embedding"))
    todo = frames.join(need, "asset_id", "left_semi").join(cached.select("asset_id").distinct(), "asset_id", "left_anti")
    keyed = todo.select(F.to_json(F.struct("asset_id", "frame_index")).alias("id"), "content")
    kind = todo.select("asset_id", "frame_index").schema.simpleString()
    made = embed(keyed, make, "dense").select(F.from_json("id", kind).alias("k"), "embedding")
    return have.unionByName(made.select("k.asset_id", "k.frame_index", unit(F.col("embedding")).alias("embedding")))
