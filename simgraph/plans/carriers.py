"""Views that project the test tables onto the engine's schemas.

Each text runs unchanged in Spark SQL and in other engines over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hash import simhash
from ..session import spread

ASSETS = """SELECT doc_id AS asset_id,
  CASE WHEN doc_id % 3 = 0 THEN 'video' ELSE 'image' END AS type,
  concat('/lib/', source, '/', lang, '/', CAST(doc_id AS STRING),
    CASE doc_id % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.jpg' WHEN 2 THEN '.PNG' ELSE '.txt' END) AS path,
  n_chars AS size, 1700000000 + doc_id * 60 AS mtime,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 320 + (doc_id % 5) * 160 END AS width,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 240 + (doc_id % 3) * 120 END AS height,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0
    THEN CAST((doc_id * 7) % 600 AS DOUBLE) / 4 END AS duration
FROM documents"""

FRAMES = """SELECT source AS asset_id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS frame_index, doc_id
FROM documents"""

SEQUENCES = """SELECT label AS asset_id,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, vec_id
FROM embeddings"""

MODAL = """SELECT c.vec_id AS entity_id, b.vec_id AS body_vec, f.vec_id AS face_vec
FROM embeddings c
LEFT JOIN embeddings b ON b.vec_id = c.vec_id + 1 AND c.vec_id % 2 = 0
LEFT JOIN embeddings f ON f.vec_id = c.vec_id + 2 AND c.vec_id % 5 = 0"""

CLUSTERS = """SELECT vec_id AS entity_id,
  CASE WHEN vec_id % 10 = 0 THEN -1
       WHEN vec_id % 97 = 1 THEN 100 + vec_id
       WHEN vec_id % 60 IN (7, 8) THEN 50 + label
       ELSE label END AS cluster_id
FROM embeddings"""

BOXES = """SELECT user_id AS asset_id, event_type AS source, event_id AS det_id,
  CAST((event_id * 37) % 400 AS DOUBLE) - 20 AS x1,
  CAST((event_id * 53) % 300 AS DOUBLE) - 20 AS y1,
  CAST((event_id * 37) % 400 + 30 + event_id % 90 AS DOUBLE) - 20 AS x2,
  CAST((event_id * 53) % 300 + 40 + event_id % 120 AS DOUBLE) - 20 AS y2,
  CAST((event_id * 17) % 100 AS DOUBLE) / 100 AS confidence
FROM events"""

FACES = f"""SELECT asset_id, source, det_id AS face_id, x1 + 10 AS x1, y1 + 10 AS y1, x2 - 10 AS x2, y2 - 10 AS y2, confidence
FROM ({BOXES}) b WHERE det_id % 3 = 0"""

OVERLAY_BASE = """SELECT doc_id AS asset_id, doc_id % 40 AS group_id
FROM documents WHERE doc_id % 3 <> 0"""

OVERLAY_EDITS = """SELECT doc_id AS asset_id, doc_id % 7 AS group_id, 1 AS seq FROM documents WHERE doc_id % 5 = 0
UNION ALL
SELECT doc_id AS asset_id, 1000 + doc_id AS group_id, 2 AS seq FROM documents WHERE doc_id % 10 = 0
UNION ALL
SELECT doc_id + 1000000 AS asset_id, 3 AS group_id, 3 AS seq FROM documents WHERE doc_id % 50 = 0"""


class Carriers:
    """The views over one folder of tables; a SQL text names its tables as they are called."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in ("documents", "embeddings", "events") if t in text}
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return self.spark.sql(text, **used)

    def assets(self) -> DataFrame:
        """With the content hash of the document as sha256."""
        sha = self.table("documents").select(F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("sha256"))
        return self.sql(ASSETS).join(sha, "asset_id")

    def signatures(self) -> DataFrame:
        """``(asset_id, phash)``: SimHash of each document in the place of an image hash."""
        return simhash(spread(self.table("documents").select(F.col("doc_id").alias("asset_id"), "text"), "asset_id"), "asset_id", "text")

    def frame_hashes(self) -> DataFrame:
        h = self.signatures().withColumnRenamed("asset_id", "doc_id")
        return self.sql(FRAMES).join(h, "doc_id").select("asset_id", "frame_index", "phash")

    def vectors(self, name: str = "id") -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias(name), F.col("embedding").cast("array<double>").alias("embedding"), "label")

    def sequences(self) -> DataFrame:
        return self.sql(SEQUENCES).join(self.vectors("vec_id"), "vec_id").select("asset_id", "frame_index", "embedding")

    def modal(self) -> DataFrame:
        """``(entity_id, clip, body, face)``."""
        m, v = self.sql(MODAL), self.vectors("v").select("v", "embedding")
        out = m.join(v.withColumnsRenamed({"v": "entity_id", "embedding": "clip"}), "entity_id")
        for c in ("body", "face"):
            out = out.join(v.withColumnsRenamed({"v": f"{c}_vec", "embedding": c}), f"{c}_vec", "left")
        return out.select("entity_id", "clip", "body", "face")

    def clusters(self) -> DataFrame:
        return self.sql(CLUSTERS).join(self.vectors("entity_id"), "entity_id").select("entity_id", F.col("cluster_id").cast("int").alias("cluster_id"), "embedding")

    def boxes(self) -> DataFrame:
        return self.sql(BOXES)

    def faces(self) -> DataFrame:
        return self.sql(FACES)

    def base(self) -> DataFrame:
        return self.sql(OVERLAY_BASE)

    def edits(self) -> DataFrame:
        return self.sql(OVERLAY_EDITS)
