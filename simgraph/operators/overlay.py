"""Edits over immutable assignments: overlays, versions, undo and redo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.media import read_or_empty
from .skew import rank_within, ranks


def last_wins(edits: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """The edit of the greatest ``seq`` of each id."""
    others = [c for c in edits.columns if c != id_col]
    best = edits.groupBy(id_col).agg(F.max_by(F.struct(*others), seq_col).alias("m"))
    return best.select(id_col, *[F.col(f"m.{c}").alias(c) for c in others])


def overlay_known(base: DataFrame, edits: DataFrame, id_col: str = "id", value_col: str = "group_id") -> DataFrame:
    """Base values, replaced where an edit names the id; edits of unknown ids vanish."""
    e = last_wins(edits, id_col).select(id_col, F.col(value_col).alias("_v"))
    return base.join(e, id_col, "left").withColumn(value_col, F.coalesce("_v", value_col)).drop("_v")


def overlay_full(base: DataFrame, edits: DataFrame, index: DataFrame, id_col: str = "asset_id", value_col: str = "group_id") -> DataFrame:
    """Edits win and may add ids; ids that the index lacks vanish."""
    e = last_wins(edits, id_col).select(id_col, F.col(value_col).alias("_v"))
    out = base.select(id_col, value_col).join(e, id_col, "full").select(id_col, F.coalesce("_v", value_col).alias(value_col))
    return out.join(index.select(id_col), id_col, "left_semi")


def with_singletons(groups: DataFrame, index: DataFrame, id_col: str = "asset_id", value_col: str = "group_id") -> DataFrame:
    """Adds assets without a group, each under a negative id by its place among them."""
    alone = ranks(index.select(id_col).join(groups.select(id_col), id_col, "left_anti"), id_col, "_r")
    return groups.select(id_col, value_col).unionByName(alone.select(id_col, (-(F.col("_r") + 1)).alias(value_col)))


def fresh_id(*tables: DataFrame, value_col: str = "group_id") -> DataFrame:
    """One row ``fresh``: one above the greatest id in use, or 1."""
    t = tables[0].select(value_col)
    for x in tables[1:]:
        t = t.union(x.select(value_col))
    return t.agg((F.coalesce(F.max(value_col), F.lit(0)) + 1).alias("fresh"))


def merge_groups(groups: DataFrame, edits: DataFrame, ids: list[int], value_col: str = "group_id") -> DataFrame:
    """All members of the groups under the least non-negative id of them, else under a fresh one."""
    if len(set(ids)) < 2:
        raise ValueError("merging takes two groups at least")
    known = [i for i in ids if i >= 0]
    if known:
        return groups.withColumn(value_col, F.when(F.col(value_col).isin(ids), min(known)).otherwise(F.col(value_col)))
    return groups.crossJoin(F.broadcast(fresh_id(groups, edits, value_col=value_col))).withColumn(value_col, F.when(F.col(value_col).isin(ids), F.col("fresh")).otherwise(F.col(value_col))).drop("fresh")


def move(groups: DataFrame, ids: list, to: int | None, edits: DataFrame | None = None, id_col: str = "asset_id", value_col: str = "group_id") -> DataFrame:
    """Members moved to a group, or to one fresh group if ``to`` is None."""
    hit = F.col(id_col).isin(ids)
    if to is not None:
        return groups.withColumn(value_col, F.when(hit, to).otherwise(F.col(value_col)))
    f = fresh_id(groups, *([edits] if edits is not None else []), value_col=value_col)
    return groups.crossJoin(F.broadcast(f)).withColumn(value_col, F.when(hit, F.col("fresh")).otherwise(F.col(value_col))).drop("fresh")


def merge_selected(groups: DataFrame, ids: Sequence[int], edits: DataFrame | None = None, value_col: str = "group_id") -> DataFrame:
    """All members of the groups under one fresh id."""
    if len(set(ids)) < 2:
        raise ValueError("merging takes two groups at least")
    f = fresh_id(groups, *([edits] if edits is not None else []), value_col=value_col)
    return groups.crossJoin(F.broadcast(f)).withColumn(value_col, F.when(F.col(value_col).isin(list(ids)), F.col("fresh")).otherwise(F.col(value_col))).drop("fresh")


def edit_clusters(groups: DataFrame, action: str, *, entity_ids: Sequence = (), cluster_ids: Sequence[int] = (), source: int | None = None, target: int | None = None, id_col: str = "entity_id", value_col: str = "cluster_id") -> DataFrame:
    """One of the edits of the review screen; what is unknown or lacks its arguments is refused before anything changes."""
    if action == "move_entities" and entity_ids and target is not None:
        return move(groups, list(entity_ids), target, id_col=id_col, value_col=value_col)
    if action == "merge_selected" and len(set(cluster_ids)) > 1:
        return merge_selected(groups, cluster_ids, value_col=value_col)
    if action == "merge_clusters" and source is not None and target is not None:
        return retarget(groups, source, target, value_col)
    if action == "split_cluster" and entity_ids and source is not None:
        return move(groups, list(entity_ids), None, id_col=id_col, value_col=value_col)
    known = ("move_entities", "merge_selected", "merge_clusters", "split_cluster")
    raise ValueError(f"{action} lacks arguments" if action in known else f"unknown edit: {action}")


def changes(before: DataFrame, after: DataFrame, id_col: str = "asset_id", value_col: str = "group_id") -> DataFrame:
    """``(id, value)`` of members whose value an edit has changed: what goes into the override table."""
    old = before.select(id_col, F.col(value_col).alias("_old"))
    return after.select(id_col, value_col).join(old, id_col).filter(~F.col(value_col).eqNullSafe(F.col("_old"))).drop("_old")


class OverrideLog:
    """An append-only table of overrides, one partition a version; version 0 is empty.

    A version holds every override in force, so that undo and redo only move the place in the history.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self, version: int) -> DataFrame:
        log = read_or_empty(self.spark, self.path, f"{self.schema}, version bigint")
        return at_version(log, version).drop("version")

    def append(self, current: int, edits: DataFrame, version: int, id_col: str = "asset_id") -> None:
        """Write ``version``: the overrides of ``current``, where ``edits`` name no id of theirs, and the edits."""
        kept = self.read(current).join(edits.select(id_col), id_col, "left_anti")
        out = kept.unionByName(edits).withColumn("version", F.lit(version).cast("long"))
        out.write.mode("append").partitionBy("version").parquet(self.path)


def retarget(groups: DataFrame, source: int, target: int, value_col: str = "group_id") -> DataFrame:
    return groups.withColumn(value_col, F.when(F.col(value_col) == source, target).otherwise(F.col(value_col)))


class History:
    """Versions of an override table with a place in it: edits append, undo and redo move the place."""

    def __init__(self) -> None:
        self.versions, self.at = [0], 0

    @property
    def version(self) -> int:
        return self.versions[self.at]

    def edit(self) -> int:
        """A new version; what was undone can no longer be redone."""
        self.versions = [*self.versions[: self.at + 1], max(self.versions) + 1]
        self.at += 1
        return self.version

    def undo(self) -> int:
        if not self.at:
            raise ValueError("nothing to undo")
        self.at -= 1
        return self.version

    def redo(self) -> int:
        if self.at + 1 == len(self.versions):
            raise ValueError("nothing to redo")
        self.at += 1
        return self.version


def at_version(log: DataFrame, version: int) -> DataFrame:
    """Rows of one version of an append-only override log."""
    return log.filter(F.col("version") == version)


def rank_in_group(groups: DataFrame, order: list, value_col: str = "group_id") -> DataFrame:
    return rank_within(groups, value_col, order)
