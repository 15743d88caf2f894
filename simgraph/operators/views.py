"""Read side of the review screens: pages, counters, cluster summaries, suggestions, projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, distance, mean_of, transform
from ..session import materialize, release
from .rank import keeper_rank
from .skew import ranks


def group_counters(groups: DataFrame) -> DataFrame:
    """One row: groups of two or more, groups of one, assets in the former."""
    n = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("duplicate_count"), F.count_if(F.col("n") == 1).alias("singleton_count"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_asset_count"))


def groups_page(groups: DataFrame, offset: int = 0, limit: int = 24, singletons: bool = False) -> DataFrame:
    """``(group_id, size)`` of one page, largest first, then by id; rows are counted before members are read."""
    n = groups.groupBy("group_id").agg(F.count("*").alias("size"))
    if not singletons:
        n = n.filter("size > 1")
    return n.orderBy(F.desc("size"), "group_id").offset(max(0, offset)).limit(max(1, limit))


def group_preview(groups: DataFrame, index: DataFrame, page: DataFrame, members: int = 12, epsilon: float = 1.5) -> DataFrame:
    """Ranked first members of a page's groups; only these groups are ranked."""
    some = groups.join(F.broadcast(page.select("group_id")), "group_id", "left_semi")  # a page has ``limit`` rows
    return keeper_rank(some, index, epsilon).filter(F.col("rank") < members)


def group_members(groups: DataFrame, index: DataFrame, group_id: int, offset: int = 0, limit: int = 12, epsilon: float = 1.5) -> DataFrame:
    """One page of a group's members by rank; an unknown group is an error."""
    mine = groups.filter(F.col("group_id") == group_id)
    if mine.isEmpty():
        raise KeyError(group_id)
    r = keeper_rank(mine, index, epsilon)
    o = max(0, offset)
    return r.filter((F.col("rank") >= o) & (F.col("rank") < o + max(1, limit)))


def title(names, size, group_id):
    """A group of one shows its name, cut to ten letters; others their number."""
    cut = F.when(F.length(names) > 10, F.concat(F.substring(names, 1, 10), F.lit("..."))).otherwise(names)
    return F.when(size == 1, cut).otherwise(F.concat(F.lit("Bucket "), group_id.cast("string")))


def named(items: DataFrame, index: DataFrame) -> DataFrame:
    """Items with asset_type, asset_path and asset_basename of their asset: "unknown" and the id where the index lacks it."""
    i = index.select("asset_id", F.col("type").alias("asset_type"), F.col("path").alias("asset_path"))
    out = items.join(i, "asset_id", "left").withColumn("asset_type", F.coalesce("asset_type", F.lit("unknown")))
    base = F.when(F.length("asset_path") > 0, F.element_at(F.split("asset_path", "/"), -1))
    return out.withColumn("asset_basename", F.coalesce(base, F.col("asset_id").cast("string")))


def similarity_maps(similar: DataFrame) -> DataFrame:
    """``(entity_id, cluster_id, similarities)``: a map of modality to similarity, null where either side is missing."""
    pairs = F.array_sort(F.collect_list(F.struct("modality", "similarity")))  # a few modalities an entity
    return similar.groupBy("entity_id", "cluster_id").agg(F.map_from_entries(pairs).alias("similarities"))


def asset_breakdown(members: DataFrame) -> DataFrame:
    """``(cluster_id, asset_type, n)``: entities of each type of asset."""
    return members.filter("cluster_id >= 0").groupBy("cluster_id", "asset_type").agg(F.count("*").alias("n"))


def own_similarity(members: DataFrame, metric: str = "cosine", kind: str = "reciprocal", scale: float = 1.0) -> DataFrame:
    """``members`` (entity_id, cluster_id, modality, vector) with their similarity to their cluster's centroid."""
    c = mean_of(members.filter("cluster_id >= 0 and vector is not null"), ["cluster_id", "modality"], "vector", "centroid")
    d = distance(metric, F.col("vector"), F.col("centroid"))
    return members.filter("cluster_id >= 0").join(c, ["cluster_id", "modality"], "left").withColumn("similarity", F.when(F.col("vector").isNotNull() & F.col("centroid").isNotNull(), transform(kind, d, scale))).drop("centroid")


def modality_coverage(similar: DataFrame) -> DataFrame:
    """Average and number of known similarities of each cluster and modality."""
    return similar.groupBy("cluster_id", "modality").agg(F.avg("similarity").alias("average"), F.count("similarity").alias("coverage"))


def cluster_overview(members: DataFrame) -> DataFrame:
    """Size, assets, frames and faces of each cluster, largest first; noise left out."""
    m = members.filter("cluster_id >= 0")
    return m.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_distinct("asset_id").alias("unique_assets"), F.sum("frame_count").alias("frames_total"), F.sum("face_count").alias("faces_total")).orderBy(F.desc("size"), "cluster_id")


def cluster_detail(similar: DataFrame, cluster_id: int) -> DataFrame:
    """Items of a cluster by fused similarity; unknown counts as 0."""
    f = similar.filter((F.col("cluster_id") == cluster_id) & (F.col("modality") == "fused"))
    w = Window.partitionBy("cluster_id").orderBy(F.coalesce("similarity", F.lit(0.0)).desc(), "entity_id")
    return f.select("entity_id", "cluster_id", "similarity", (F.row_number().over(w) - 1).alias("place"))


def multi_cluster_summary(coverage: DataFrame, sizes: DataFrame, ids: list[int]) -> DataFrame:
    """Coverage-weighted averages over several clusters, with their summed sizes."""
    c = coverage.filter(F.col("cluster_id").isin(ids))
    avg = c.groupBy("modality").agg(F.try_divide(F.sum(F.col("average") * F.col("coverage")), F.sum(F.when(F.col("average").isNotNull(), F.col("coverage")))).alias("average"), F.sum("coverage").alias("coverage"))
    total = sizes.filter(F.col("cluster_id").isin(ids)).agg(F.sum("size").alias("size"))
    return avg.crossJoin(F.broadcast(total))


def items_by_asset(items: DataFrame) -> DataFrame:
    """One row an asset of a cluster: its least entity and how many it has."""
    return items.groupBy("cluster_id", "asset_id").agg(F.min("entity_id").alias("first_entity"), F.count("*").alias("n_entities"))


def suggestions(c: DataFrame, cluster_id: int, limit: int = 8) -> DataFrame:
    """The clusters whose centroids are most similar to that of one; empty if it has none."""
    one = c.filter(F.col("cluster_id") == cluster_id).select(F.col("centroid").alias("mine"))
    s = c.filter(F.col("cluster_id") != cluster_id).crossJoin(F.broadcast(one))
    s = s.select(F.col("cluster_id").alias("suggested_id"), cosine(F.col("centroid"), F.col("mine")).alias("similarity"))
    return s.orderBy(F.desc("similarity"), "suggested_id").limit(limit)


def neighbours(ids: DataFrame) -> DataFrame:
    """Previous and next cluster by id, wrapping round; one row a cluster."""
    r = ranks(ids.select("cluster_id"), "cluster_id", "r")
    n = r.agg(F.count("*").alias("n"))
    at = lambda step: F.pmod(F.col("r") + step, F.col("n"))
    out = r.crossJoin(F.broadcast(n)).select("cluster_id", at(-1).alias("p"), at(1).alias("q"))  # n is one row
    out = out.join(r.select(F.col("cluster_id").alias("previous"), F.col("r").alias("p")), "p")
    return out.join(r.select(F.col("cluster_id").alias("next"), F.col("r").alias("q")), "q").select("cluster_id", "previous", "next")


def projection(c: DataFrame) -> DataFrame:
    """``(cluster_id, x, y)``: two principal components of the centroids, each scaled to [0, 1].

    A component's sign makes its loading of greatest magnitude positive. One cluster stands in the middle, and a
    component without spread gives 0.
    """
    kept = materialize(c.select("cluster_id", "centroid"))
    v = kept.select("cluster_id", array_to_vector("centroid").alias("v"))
    if v.count() < 2:
        return kept.select("cluster_id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(v)
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, k]).argmax(), k] >= 0 else -1.0 for k in (0, 1)]
    p = model.transform(v).select("cluster_id", *[(vector_to_array("p")[k] * sign[k]).alias(n) for k, n in enumerate("xy")])
    lim = p.agg(*[f(n).alias(f"{n}_{f.__name__}") for n in "xy" for f in (F.min, F.max)])
    s = p.crossJoin(F.broadcast(lim))
    scaled = {n: (F.col(n) - F.col(f"{n}_min")) / F.when(F.col(f"{n}_max") > F.col(f"{n}_min"), F.col(f"{n}_max") - F.col(f"{n}_min")).otherwise(1.0) for n in "xy"}
    out = materialize(s.select("cluster_id", *[e.alias(n) for n, e in scaled.items()]))
    release(kept)
    return out


def in_rect(points: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    return points.filter(F.col("x").between(min(x1, x2), max(x1, x2)) & F.col("y").between(min(y1, y2), max(y1, y2)))


def in_polygon(points: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Points inside a closed polygon, by the parity of edges to their right; points on an edge may go either way."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if ay != by:
            crosses = (F.lit(ay) > F.col("y")) != (F.lit(by) > F.col("y"))
            at = F.lit(ax) + (F.col("y") - ay) * ((bx - ax) / (by - ay))
            inside = inside != (crosses & (F.col("x") < at))
    return points.filter(inside)


def representatives(similar: DataFrame) -> DataFrame:
    """``(cluster_id, entity_id)``: the member most similar to its centroid, the least id on ties."""
    best = F.max_by("entity_id", F.struct(F.coalesce("similarity", F.lit(0.0)), -F.col("entity_id")))
    return similar.groupBy("cluster_id").agg(best.alias("entity_id"))
