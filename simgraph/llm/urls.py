"""URL verdicts: prefix rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and Spark ML's trees; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


FEATURES = ["n_chars", "host_chars", "path_chars", "host_depth", "path_depth", "digit_ratio", "upper_ratio", "entropy", "n_params", "query_chars", "n_hyphens", "n_escapes", "is_https", "has_port", "suffix_seen", "suffix_blocked"]


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    behind = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.coalesce(F.regexp_extract(behind, r"^[^?#]*", 0), F.lit(""))


def rule_for(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits as ``struct<text, verdict>``, or null."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _count(s: Column, c: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that a URL alone gives; expects ``url``, ``host`` and ``path`` without nulls."""
    u, n = F.col("url"), F.greatest(F.length("url"), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    chars = F.array_distinct(F.split(u, ""))
    share = F.transform(F.filter(chars, lambda c: c != ""), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    plain_host = F.regexp_replace("host", r":\d*$", "")
    return df.withColumns(
        {
            "n_chars": F.length(u).cast("double"),
            "host_chars": F.length("host").cast("double"),
            "path_chars": F.length("path").cast("double"),
            "host_depth": _count(F.col("host"), ".").cast("double"),
            "path_depth": _count(F.col("path"), "/").cast("double"),
            "digit_ratio": F.length(F.regexp_replace(u, r"[^0-9]", "")) / n,
            "upper_ratio": F.length(F.regexp_replace(u, r"[^A-Z]", "")) / n,
            "entropy": F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
            "n_params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0),
            "query_chars": F.length(query).cast("double"),
            "n_hyphens": _count(u, "-").cast("double"),
            "n_escapes": _count(u, "%").cast("double"),
            "is_https": F.lower(u).startswith("https:").cast("double"),
            "has_port": F.col("host").rlike(r":\d+$").cast("double"),
            "suffix": F.regexp_extract(plain_host, r"[^.]*$", 0),
        }
    )


def suffix_stats(rows: DataFrame) -> DataFrame:
    """``(suffix, n, labelled, blocked)`` over all ``rows`` (suffix, label); ``label`` is null where no rule decides."""
    return rows.groupBy("suffix").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked"))


def judge(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", sample_rows: int = 20_000, trees: int = 20, depth: int = 3, most_suffixes: int = 200_000) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` for every row.

    URLs that a rule decides are the labelled ones. Suffixes are counted over all rows. The trees are fitted on at
    most ``sample_rows`` of the labelled, those of the least hash, so that the choice follows neither size nor
    order; ``score`` is the trees' probability of ``block`` and decides where no rule fits. If no or
    only one verdict is labelled there is nothing to learn: the score is then that share of ``block``, or 0.

    Suffixes are broadcast where they are ``most_suffixes`` at most, and joined by a shuffle beyond.

    A null URL, or one without ``://``, has an empty host and path and is judged by its features; a URL of any length is
    read whole. Of rules that fit, the longest wins. Null ids stay, repeated rows give repeated rows, an empty table an
    empty one, and further columns of ``df`` are not read, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = lexical(rows.withColumn("rule", rule_for(rules, F.col("host"), F.col("path"))))
    block = (F.col("rule.verdict") == "block").cast("double")
    rows = rows.withColumn("label", block)
    counts = materialize(suffix_stats(rows))
    n_suffixes, all_labelled, all_blocked = counts.agg(F.count("*"), F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    rate = F.when(F.col("labelled") > 0, (F.col("blocked") + 1) / (F.col("labelled") + 2)).otherwise((all_blocked + 1) / (all_labelled + 2))
    stats = counts.select("suffix", F.log1p("n").alias("suffix_seen"), rate.alias("suffix_blocked"))
    stats = F.broadcast(stats) if n_suffixes <= most_suffixes else stats
    sample = rows.filter("rule is not null").orderBy(F.xxhash64("url"), "id", "url").limit(sample_rows)
    sample = materialize(sample.select("suffix", "label", *FEATURES[:-2]))
    n, n_block = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    whole = lambda d: VectorAssembler(inputCols=FEATURES, outputCol="features").transform(d.join(stats, "suffix", "left"))
    if 0 < n_block < n:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=1).fit(whole(sample).select("features", "label"))
        scored = model.transform(whole(rows.drop("label"))).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = rows.withColumn("score", F.lit(n_block / n if n else 0.0))
    release(sample)
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("id", "host", "path", F.col("rule.text").alias("rule"), verdict.alias("verdict"), "score")
