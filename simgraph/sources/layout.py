"""Where the tables of a library lie; paths only, nothing is made or deleted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schemas import ASSIGNMENTS, CENTROIDS, EMBEDDINGS, ENTITIES, EXACT_GROUPS, FACES, FILE_INDEX, FRAME_EMBEDDINGS, GROUPS, HASHES, OVERRIDES, PAIRS, PERSONS, RANKED, RASTERS, SCORED_PAIRS, VIDEO_ALIGNMENT
from .media import read_or_empty

#: Path below the root, and schema, of each table.
TABLES = {
    "file_index": ("data/index", FILE_INDEX),
    "rasters": ("data/frames", RASTERS),
    "hashes": ("data/hashes", HASHES),
    "embeddings": ("data/embeddings", EMBEDDINGS),
    "frame_embeddings": ("data/embeddings_dense", FRAME_EMBEDDINGS),
    "pairs": ("data/candidates/pairs", PAIRS),
    "scored_pairs": ("data/candidates/scored", SCORED_PAIRS),
    "alignment": ("data/candidates/alignment", VIDEO_ALIGNMENT),
    "exact_groups": ("data/duplicates/exact", EXACT_GROUPS),
    "near_groups": ("data/duplicates/near", GROUPS),
    "groups": ("data/duplicates/groups", GROUPS),
    "ranked": ("data/duplicates/ranked", RANKED),
    "overrides": ("data/duplicates/overrides", OVERRIDES),
    "persons": ("data/detections/persons", PERSONS),
    "faces": ("data/detections/faces", FACES),
    "entities": ("data/entities", ENTITIES),
    "assignments": ("data/clusters/assigned", ASSIGNMENTS),
    "refined": ("data/clusters/refined", ASSIGNMENTS),
    "centroids": ("data/clusters/centroids", CENTROIDS),
}


@dataclass(frozen=True)
class Layout:
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{TABLES[table][0]}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The table as it is now; empty, with its schema, where it has not been written."""
        return read_or_empty(spark, self.path(table), TABLES[table][1])

    def write(self, df: DataFrame, table: str) -> None:
        """Replace the table; columns are put into the schema's order, and a missing one is an error."""
        schema = df.sparkSession.createDataFrame([], TABLES[table][1]).schema
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(self.path(table))

    def refresh(self, spark: SparkSession, *tables: str) -> dict[str, DataFrame]:
        """Fresh reads of the tables, whatever has been read of them before."""
        for t in tables:
            spark.catalog.refreshByPath(self.path(t))
        return {t: self.read(spark, t) for t in tables}
