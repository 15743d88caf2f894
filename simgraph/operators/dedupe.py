"""Exact and near duplicates: content-hash groups, banded Hamming joins and pair verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hash import band_keys, to_long
from ..session import Scratch
from .graph import connected_components
from .skew import lookup, ranks

#: One threshold for all hash columns, or one for each.
Thresholds = int | Mapping[str, int]


def exact_groups(assets: DataFrame, id_col: str = "asset_id", hash_col: str = "sha256") -> DataFrame:
    """``(asset_id, group_id, sha256)`` of contents that two assets or more share.

    ``group_id`` is the hash's place among all distinct non-null hashes, so groups of one leave gaps. The
    rank is taken over hashes, not over assets.
    """
    a = assets.filter(F.col(hash_col).isNotNull())
    per = a.groupBy(hash_col).agg(F.count("*").alias("n"))
    ranked = ranks(per, hash_col, "group_id")
    return a.join(ranked.filter("n > 1"), hash_col).select(id_col, "group_id", hash_col)


def unresolved(assets: DataFrame, *resolved: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """Assets that no earlier tier has settled; the same anti join skips work whose output exists."""
    done = resolved[0].select(id_col)
    for r in resolved[1:]:
        done = done.union(r.select(id_col))
    return assets.join(done.distinct(), id_col, "left_anti")


def limits(columns: Sequence[str], thresholds: Thresholds) -> dict[str, int]:
    return {c: thresholds if isinstance(thresholds, int) else thresholds[c] for c in columns}


def _same(columns: Sequence[str]):
    """One value for rows whose hashes are all equal; null where all are null."""
    return F.when(F.coalesce(*columns).isNotNull(), F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in columns]))


def _met(classes: DataFrame, columns: Sequence[str], thresholds: Thresholds) -> DataFrame:
    """``(ra, rb, distance)`` of representatives that share a band of a hash, once a band and hash.

    With threshold+1 bands, two hashes within that many bits share one. Hashes travel along as numbers, so nothing is
    joined again to compare them.
    """
    out = None
    for c, t in limits(columns, thresholds).items():
        keyed = classes.filter(F.col(c).isNotNull()).select("rep", to_long(F.col(c)).alias("h"), F.explode(band_keys(F.col(c), t + 1)).alias("k")).select("rep", "h", "k.band", "k.key")
        other = keyed.select(F.col("rep").alias("rb"), F.col("h").alias("hb"), "band", "key")
        pairs = keyed.join(other, ["band", "key"]).filter(F.col("rep") < F.col("rb"))
        pairs = pairs.select(F.col("rep").alias("ra"), "rb", F.bit_count(F.col("h").bitwiseXOR(F.col("hb"))).cast("int").alias("distance"), F.lit(t).alias("limit"))
        out = pairs if out is None else out.union(pairs)
    return out


def hash_classes(hashes: DataFrame, columns: Sequence[str], id_col: str = "asset_id") -> DataFrame:
    """``(rep, *columns, members)``: the distinct combinations of hashes with their least id."""
    some = hashes.filter(F.coalesce(*columns).isNotNull())
    return some.groupBy(*columns).agg(F.min(id_col).alias("rep"), F.count("*").alias("members"))


def near_classes(classes: DataFrame, columns: Sequence[str], thresholds: Thresholds) -> DataFrame:
    """``(ra, rb, distance)`` of representatives within the threshold of any of the hashes."""
    met = _met(classes, columns, thresholds).filter(F.col("distance") <= F.col("limit"))
    return met.groupBy("ra", "rb").agg(F.min("distance").alias("distance"))


def _stars(s: Scratch, hashes: DataFrame, classes: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """``(rep, member)`` of every class of two members or more."""
    keyed = hashes.select(id_col, _same(columns).alias("same")).filter("same is not null")
    table = classes.filter("members > 1").select(_same(columns).alias("same"), "rep", "members")
    return lookup(keyed, table, ["same"], "members", keyed.count()).filter(F.col(id_col) != F.col("rep")).select("rep", F.col(id_col).alias("member"))


def lsh_candidates(hashes: DataFrame, columns: Sequence[str], thresholds: Thresholds, id_col: str = "asset_id", expand: bool = False) -> DataFrame:
    """Distinct ``(a, b)`` with a < b that share a band of a hash.

    Equal hashes meet as one representative, the least id, so a common hash does not fill a bucket: pairs are those of
    representatives, and of each with the copies it stands for. ``expand`` gives all pairs of members instead.
    """
    with Scratch() as s:
        h = s.table(hashes.select(id_col, *columns))
        classes = s.table(hash_classes(h, columns, id_col))
        pairs = _met(classes, columns, thresholds).select("ra", "rb").distinct()
        return s.result(_members(s, h, classes, pairs.withColumn("distance", F.lit(0)), columns, id_col, expand).select("a", "b"))


def hamming_pairs(hashes: DataFrame, columns: Sequence[str], thresholds: Thresholds, id_col: str = "asset_id", expand: bool = False) -> DataFrame:
    """``(a, b, distance)`` of pairs within the threshold of any of the hashes; the least such distance.

    Pairs are those of representatives, and of each with its copies, at distance 0; ``expand`` gives all pairs of members.
    """
    with Scratch() as s:
        h = s.table(hashes.select(id_col, *columns))  # hashes are dear
        classes = s.table(hash_classes(h, columns, id_col))
        return s.result(_members(s, h, classes, near_classes(classes, columns, thresholds), columns, id_col, expand))


def _members(s: Scratch, h: DataFrame, classes: DataFrame, pairs: DataFrame, columns: Sequence[str], id_col: str, expand: bool) -> DataFrame:
    stars = s.table(_stars(s, h, classes, columns, id_col))
    if not expand:
        return pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "distance").union(stars.select("rep", "member", F.lit(0)))
    every = stars.union(classes.select("rep", "rep"))
    same = classes.filter("members > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.lit(0))
    full = pairs.union(same).join(every.toDF("ra", "u"), "ra").join(every.toDF("rb", "v"), "rb").filter("u <> v and (ra <> rb or u < v)")
    return full.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "distance")


def pair_verdict(frames: DataFrame, columns: Sequence[str], thresholds: Thresholds, ratio: float, id_col: str = "asset_id") -> DataFrame:
    """``(a, b, matched, ratio, is_duplicate)`` for assets with frames that match.

    Frames match where any hash is within its threshold. ``matched`` counts the frames of ``a``, the smaller id, that match
    a frame of ``b``; it is set against the shorter side, and a single frame on one side needs a single match.
    Frames meet through their bands, which lose none, as distinct hashes. Assets with the same frames are
    copies: the least stands for them, and the copies follow as pairs with it.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")
    with Scratch() as s:
        frames = s.table(frames.select(id_col, *columns))  # hashes are dear
        f = frames.filter(F.coalesce(*columns).isNotNull()).withColumn("_same", _same(columns))
        f = s.table(f.groupBy(id_col, "_same", *columns).agg(F.count("*").alias("k")))
        total = frames.groupBy(id_col).agg(F.count("*").alias("n"))
        # assets whose frames are the same are one; an asset's frames are a bounded list
        whole = f.groupBy(id_col).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("_same", "k")))), 256).alias("sign")).join(total, id_col)
        whole = s.table(whole)
        kind = whole.groupBy("sign", "n").agg(F.min(id_col).alias("rep"), F.max(id_col).alias("last"), F.count("*").alias("members"))
        kind = s.table(kind)
        classes = f.groupBy("_same", *columns).agg(F.min(F.xxhash64("_same")).alias("rep"))
        near = near_classes(classes, columns, thresholds)
        near = near.select("ra", "rb").union(near.select("rb", "ra")).union(classes.select("rep", "rep"))
        mine = f.join(kind.select(F.col("rep").alias(id_col)), id_col).select(F.col(id_col).alias("p"), F.xxhash64("_same").alias("ra"), "k")
        mine = s.table(mine)
        hits = mine.join(near, "ra").join(mine.select(F.col("p").alias("q"), F.col("ra").alias("rb")), "rb").filter("p <> q")
        hits = hits.select("p", "q", "ra", "k").distinct().groupBy("p", "q").agg(F.sum("k").alias("matched"))
        info = kind.select(F.col("rep").alias("p"), F.col("n").alias("n_p"), "last")
        hits = s.table(hits.join(info, "p").join(kind.select(F.col("rep").alias("q"), F.col("n").alias("n_q")), "q"))
        least = F.least("n_p", "n_q")
        hits = hits.withColumns({"ratio": F.col("matched") / least, "ok": (least == 1) | (F.col("matched") / least >= ratio)})
        # the side that counts is the smaller id's; of copies some may be greater than the other side's
        back = hits.filter("p > q").select(F.col("q").alias("p"), F.col("p").alias("q"), F.col("ok").alias("ok_back"), F.col("p").alias("p_back"))
        ahead = hits.filter("p < q").join(back, ["p", "q"], "left")
        good = F.col("ok") | F.coalesce((F.col("last") > F.col("p_back")) & F.col("ok_back"), F.lit(False))
        out = ahead.select(F.col("p").alias("a"), F.col("q").alias("b"), "matched", "ratio", good.alias("is_duplicate"))
        copies = lookup(whole, kind.filter("members > 1").select("sign", "n", "rep", "members"), ["sign", "n"], "members", whole.count()).filter(F.col(id_col) != F.col("rep"))
        copies = copies.select(F.col("rep").alias("a"), F.col(id_col).alias("b"), F.col("n").alias("matched"), F.lit(1.0).alias("ratio"), F.lit(True).alias("is_duplicate"))
        return s.result(out.unionByName(copies))


def any_match(images: DataFrame, frames: DataFrame, columns: Sequence[str], thresholds: Thresholds, id_col: str = "asset_id") -> DataFrame:
    """Distinct ``(a, b)`` of each image a and asset b one of whose frames matches it.

    Both sides meet as distinct hashes; only what is found is told for every image.
    """
    with Scratch() as s:
        one = s.table(images.select(F.col(id_col).alias("a"), *columns, _same(columns).alias("same")).filter("same is not null"))
        many = s.table(frames.select(F.col(id_col).alias("b"), *columns, _same(columns).alias("same")).filter("same is not null").distinct())
        both = one.select("same", *columns).union(many.select("same", *columns)).distinct()
        classes = s.table(ranks(both, "same", "rep"))
        near = near_classes(classes, columns, thresholds)
        near = near.select("ra", "rb").union(near.select("rb", "ra")).union(classes.select("rep", "rep"))
        kinds = s.table(one.groupBy("same").agg(F.count("*").alias("n")).join(classes.select("same", "rep"), "same"))
        theirs = many.join(classes.select("same", F.col("rep").alias("rb")), "same").select("b", "rb")
        found = s.table(kinds.select(F.col("rep").alias("ra")).join(near, "ra").join(theirs, "rb").select("ra", "b").distinct())
        whose = lookup(one, kinds, ["same"], "n", one.count()).select("a", F.col("rep").alias("ra"))
        return s.result(whose.join(found, "ra").select("a", "b").distinct())


def near_groups(pairs: DataFrame, assets: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """``(asset_id, group_id)`` of components of two assets or more.

    ``group_id`` is the place of the component's least id among the least ids of all components, those of
    one asset included.
    """
    comp = connected_components(pairs, "a", "b")
    every = assets.select(F.col(id_col).alias("vertex")).join(comp, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
    per = every.groupBy("component").agg(F.count("*").alias("n"))
    return every.join(ranks(per, "component", "group_id").filter("n > 1"), "component").select(F.col("vertex").alias(id_col), "group_id")


def star_edges(groups: DataFrame, id_col: str = "asset_id", group_col: str = "group_id") -> DataFrame:
    """``(a, b)`` from the least member of each group to the others."""
    first = groups.groupBy(group_col).agg(F.min(id_col).alias("a"))
    return groups.join(first, group_col).filter(F.col(id_col) != F.col("a")).select("a", F.col(id_col).alias("b"))


def incremental(source: DataFrame, existing: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """Rows of ``source`` that have no output yet."""
    return source.join(existing.select(id_col).distinct(), id_col, "left_anti")
