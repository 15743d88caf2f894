"""Every query of the engine's own operators with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DedupeConfig, IdentityConfig
from .functions import bbox, hash, vector
from .operators import align, cluster, dedupe, entities, fuse, overlay, rank, refine, simjoin, views
from .plans import carriers as C
from .plans.cascade import duplicate_groups, identities as identity_clusters
from .sources import media

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views that the SQL texts share; each text takes those that it names.
VIEWS = {
    "assets": f"SELECT a.*, sha256(d.text) AS sha256 FROM ({C.ASSETS}) a JOIN documents d ON d.doc_id = a.asset_id",
    "seqs": f"SELECT s.asset_id, s.frame_index, e.embedding::double[] AS v FROM ({C.SEQUENCES}) s JOIN embeddings e ON e.vec_id = s.vec_id",
    "vecs": "SELECT vec_id AS id, embedding::double[] AS v, label FROM embeddings",
    "clus": f"SELECT c.entity_id, c.cluster_id, e.embedding::double[] AS v FROM ({C.CLUSTERS}) c JOIN embeddings e ON e.vec_id = c.entity_id",
    "boxes": C.BOXES,
    "faces": C.FACES,
    "base": C.OVERLAY_BASE,
    "edits": C.OVERLAY_EDITS,
    "last_edits": "SELECT asset_id, arg_max(group_id, seq) AS group_id FROM edits GROUP BY asset_id",
    "effective": "SELECT * FROM (SELECT coalesce(b.asset_id, e.asset_id) AS asset_id, coalesce(e.group_id, b.group_id) AS group_id FROM base b FULL JOIN last_edits e ON e.asset_id = b.asset_id) WHERE asset_id IN (SELECT asset_id FROM assets)",
    "tokens": r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[^ \n\t\r]+')) AS t FROM documents",
    "bits": "SELECT doc_id, i, sum(CASE WHEN substr('0123456789abcdef', 1, 16) IS NOT NULL AND (('0x' || substr(md5(t), 1 + CAST(i // 4 AS INTEGER), 1))::INTEGER >> CAST(3 - i % 4 AS INTEGER)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM tokens, range(64) r(i) GROUP BY doc_id, i",
    "sigs": "SELECT d.doc_id AS asset_id, coalesce(x.phash, '0000000000000000') AS phash FROM documents d LEFT JOIN (SELECT doc_id, string_agg(substr('0123456789abcdef', 1 + CAST(n AS INTEGER), 1), '' ORDER BY k) AS phash FROM (SELECT doc_id, i // 4 AS k, sum(CASE WHEN s > 0 THEN CASE i % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END ELSE 0 END) AS n FROM bits GROUP BY doc_id, i // 4) GROUP BY doc_id) x ON x.doc_id = d.doc_id",
    "dist": "SELECT a.asset_id AS a, b.asset_id AS b, CAST(bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)) AS INTEGER) AS distance FROM sigs a, sigs b WHERE a.asset_id < b.asset_id",
    "hclasses": "SELECT phash, min(asset_id) AS rep FROM sigs GROUP BY phash",
    "cents": "SELECT cluster_id, list(m ORDER BY p) AS c FROM (SELECT cluster_id, p, avg(x) AS m FROM (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM clus WHERE cluster_id >= 0) GROUP BY cluster_id, p) GROUP BY cluster_id",
    "cpairs": "SELECT a.cluster_id, b.cluster_id AS other, list_cosine_similarity(a.c, b.c) AS similarity FROM cents a, cents b WHERE a.cluster_id <> b.cluster_id",
}
NEEDS = {
    "last_edits": ["edits"],
    "effective": ["base", "last_edits", "assets"],
    "bits": ["tokens"],
    "sigs": ["bits"],
    "dist": ["sigs"],
    "hclasses": ["sigs"],
    "cents": ["clus"],
    "cpairs": ["cents"],
}


def _with(names: list[str], body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{' ' if not body.startswith(',') else ''}{body}"


def query(views: list[str] | None = None, oracle: str | None = None, recursive: bool = False):
    """Register a function of ``Carriers`` under its name, and the SQL over ``VIEWS`` that gives its rows."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(C.Carriers(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[f.__name__] = _with(views, oracle, recursive) if views else oracle
        return f

    return put


def r6(c) -> F.Column:
    """Six digits, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# exact copies


@query(["assets"], "SELECT asset_id, group_id, sha256 FROM (SELECT asset_id, sha256, dense_rank() OVER (ORDER BY sha256) - 1 AS group_id, count(*) OVER (PARTITION BY sha256) AS n FROM assets) WHERE n > 1")
def exact_duplicate_groups(c):
    return dedupe.exact_groups(c.assets()).select("asset_id", "group_id", "sha256")


@query(["assets"], "SELECT count(DISTINCT sha256) AS n_groups, count(*) AS n_assets FROM (SELECT sha256, count(*) OVER (PARTITION BY sha256) AS n FROM assets) WHERE n > 1")
def exact_group_summary(c):
    return dedupe.exact_groups(c.assets()).agg(F.count_distinct("group_id").alias("n_groups"), F.count("*").alias("n_assets"))


@query(["assets"], "SELECT asset_id, path, type, size, mtime, sha256 FROM assets")
def content_hash_index(c):
    return c.assets().select("asset_id", "path", "type", "size", "mtime", "sha256")


@query(["assets"], "SELECT asset_id, sha1(path || size || mtime) AS id FROM assets")
def asset_id_sha1(c):
    return c.assets().select("asset_id", hash.asset_id(F.col("path"), F.col("size"), F.col("mtime")).alias("id"))


@query(["assets"], "SELECT asset_id FROM (SELECT asset_id, count(*) OVER (PARTITION BY sha256) AS n FROM assets) WHERE n = 1")
def unresolved_after_exact(c):
    a = c.assets()
    return dedupe.unresolved(a, dedupe.exact_groups(a)).select("asset_id")


@query(["assets"], r"SELECT asset_id, lower(regexp_extract(path, '(\.[^.]+)$', 1)) AS suffix, CASE lower(regexp_extract(path, '(\.[^.]+)$', 1)) WHEN '.mp4' THEN 'video' WHEN '.jpg' THEN 'image' WHEN '.png' THEN 'image' END AS kind, regexp_extract(path, '([^/]*)$', 1) AS basename FROM assets")
def media_suffix_classify(c):
    return media.classify_suffix(c.assets()).select("asset_id", "suffix", "kind", "basename")


@query(["assets"], "SELECT asset_id FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM assets WHERE size % 2 = 0)")
def incremental_skip(c):
    a = c.assets()
    return dedupe.incremental(a, a.filter("size % 2 = 0")).select("asset_id")


# perceptual hashes and near copies


@query(["sigs"], "SELECT asset_id, phash FROM sigs")
def simhash_signature(c):
    return c.signatures()


_GRID = "SELECT id, v, list_avg(v) AS m FROM vecs"


def _hex(bits: str) -> str:
    """SQL for a list of 64 booleans as hex digits."""
    return f"array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', CAST(1 + 8 * CAST({bits}[4 * k + 1] AS INTEGER) + 4 * CAST({bits}[4 * k + 2] AS INTEGER) + 2 * CAST({bits}[4 * k + 3] AS INTEGER) + CAST({bits}[4 * k + 4] AS INTEGER) AS INTEGER), 1)), '')"


@query(["vecs"], f"SELECT id, {_hex('b')} AS ahash FROM (SELECT id, list_transform(v, lambda x: x > list_sum(v) / 64) AS b FROM vecs)")
def grid_ahash(c):
    return c.vectors().select("id", hash.ahash(F.col("embedding")).alias("ahash"))


@query(["vecs"], f"SELECT id, {_hex('b')} AS dhash FROM (SELECT id, list_transform(range(64), lambda i: i < 56 AND v[CAST((i // 7) * 8 + i % 7 + 2 AS BIGINT)] > v[CAST((i // 7) * 8 + i % 7 + 1 AS BIGINT)]) AS b FROM vecs)")
def grid_dhash(c):
    return c.vectors().select("id", hash.dhash(F.col("embedding"), 8, 8).alias("dhash"))


#: The orthonormal transform of eight values, as rows of a table, and the 64 products of a grid with it.
_DCT = ", dct AS (SELECT k, i, cos(pi() * (2 * i + 1) * k / 16) * sqrt(CASE k WHEN 0 THEN 1 ELSE 2 END / 8.0::DOUBLE) AS w FROM range(8) a(k), range(8) b(i)), cells AS (SELECT id, CAST(p - 1 AS INTEGER) // 8 AS i, CAST(p - 1 AS INTEGER) % 8 AS j, x FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM vecs)), co AS (SELECT id, r.k AS k, c.k AS l, sum(r.w * x * c.w) AS y FROM cells JOIN dct r ON r.i = cells.i JOIN dct c ON c.i = cells.j GROUP BY id, r.k, c.k), hi AS (SELECT id, k, l, y > median(y) OVER (PARTITION BY id) AS b FROM co)"


@query(["vecs"], _DCT + " SELECT id, string_agg(substr('0123456789abcdef', 1 + CAST(n AS INTEGER), 1), '' ORDER BY g) AS phash FROM (SELECT id, (8 * k + l) // 4 AS g, sum(CASE WHEN b THEN CASE l % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END ELSE 0 END) AS n FROM hi GROUP BY id, (8 * k + l) // 4) GROUP BY id")
def grid_phash(c):
    from .functions.raster import grid_phash as phash

    return c.vectors().select("id", phash("embedding").alias("phash"))


@query(["sigs"], "SELECT asset_id, CAST(b.i AS INTEGER) AS band, substr(phash, b.s, b.n) AS key FROM sigs, (VALUES (0, 1, 6), (1, 7, 5), (2, 12, 5)) b(i, s, n)")
def lsh_band_keys(c):
    return c.signatures().select("asset_id", F.explode(hash.band_keys(F.col("phash"), 3)).alias("k")).select("asset_id", "k.band", "k.key")


#: Copies of a hash are told once, as pairs with the least of them.
_COPIES = "FROM sigs s JOIN hclasses h ON h.phash = s.phash WHERE s.asset_id <> h.rep"


@query(["hclasses"], "SELECT a.rep AS a, b.rep AS b FROM hclasses a, hclasses b WHERE a.rep < b.rep AND (substr(a.phash, 1, 6) = substr(b.phash, 1, 6) OR substr(a.phash, 7, 5) = substr(b.phash, 7, 5) OR substr(a.phash, 12, 5) = substr(b.phash, 12, 5)) UNION ALL SELECT h.rep, s.asset_id " + _COPIES)
def lsh_candidate_pairs(c):
    return dedupe.lsh_candidates(c.signatures(), ["phash"], 2)


@query(["dist", "hclasses"], "SELECT a, b, distance FROM dist WHERE distance BETWEEN 1 AND 2 AND a IN (SELECT rep FROM hclasses) AND b IN (SELECT rep FROM hclasses) UNION ALL SELECT h.rep, s.asset_id, 0 " + _COPIES)
def hamming_near_pairs(c):
    return dedupe.hamming_pairs(c.signatures(), ["phash"], 2)


@query(["dist"], "SELECT a, b, distance FROM dist WHERE distance <= 2")
def hamming_all_pairs(c):
    return dedupe.hamming_pairs(c.signatures(), ["phash"], 2, expand=True)


_REACH = """, near AS (SELECT a, b FROM dist WHERE distance <= 2),
both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT asset_id AS x, asset_id AS y FROM sigs UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON e.a = r.y),
comp AS (SELECT x AS asset_id, min(y) AS root FROM reach GROUP BY x)"""


@query(["dist"], _REACH + " SELECT asset_id, dense_rank() OVER (ORDER BY root) - 1 AS group_id FROM comp QUALIFY count(*) OVER (PARTITION BY root) > 1", recursive=True)
def near_duplicate_groups(c):
    s = c.signatures()
    return dedupe.near_groups(dedupe.hamming_pairs(s, ["phash"], 2), s).select("asset_id", "group_id")


_FRAMES = f""", fh AS (SELECT f.asset_id, f.frame_index, s.phash FROM ({C.FRAMES}) f JOIN sigs s ON s.asset_id = f.doc_id),
n AS (SELECT asset_id, count(*) AS n FROM fh GROUP BY asset_id),
hits AS (SELECT x.asset_id AS a, y.asset_id AS b, count(DISTINCT x.frame_index) AS matched FROM fh x JOIN fh y ON x.asset_id < y.asset_id
  AND bit_count(xor(('0x' || x.phash)::UBIGINT, ('0x' || y.phash)::UBIGINT)) <= 2 GROUP BY x.asset_id, y.asset_id)"""


@query(["sigs"], _FRAMES + " SELECT a, b, matched, round(matched / least(p.n, q.n), 6) + 0.0::DOUBLE AS ratio, (least(p.n, q.n) = 1 OR matched / least(p.n, q.n) >= 0.04) AS is_duplicate FROM hits JOIN n p ON p.asset_id = a JOIN n q ON q.asset_id = b")
def frame_pair_verdict(c):
    return dedupe.pair_verdict(c.frame_hashes(), ["phash"], 2, 0.04).withColumn("ratio", r6(F.col("ratio")))


@query(["sigs"], ", one AS (SELECT asset_id AS a, phash FROM sigs WHERE asset_id % 3 <> 0), vh AS (SELECT d.source AS b, s.phash FROM sigs s JOIN documents d ON d.doc_id = s.asset_id WHERE d.doc_id % 3 = 0) SELECT DISTINCT a, b FROM one JOIN vh ON bit_count(xor(('0x' || one.phash)::UBIGINT, ('0x' || vh.phash)::UBIGINT)) <= 2")
def image_video_any_match(c):
    """Every image against the frames of every video; the type of an asset says what it is."""
    s = c.sql(C.ASSETS).select("asset_id", "type").join(c.signatures(), "asset_id")
    source = c.table("documents").select(F.col("doc_id").alias("asset_id"), "source")
    frames = s.filter("type = 'video'").join(source, "asset_id").select(F.col("source").alias("asset_id"), "phash")
    return dedupe.any_match(s.filter("type = 'image'"), frames, ["phash"], 2)


# cosine joins

_SIMS = ", sims AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM vecs a, vecs b WHERE a.id <> b.id), top AS (SELECT a, b, s FROM sims WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)"


@query(["vecs"], _SIMS + " SELECT a, b, round(s, 6) + 0.0::DOUBLE AS similarity FROM top")
def cosine_topk_pairs(c):
    return simjoin.topk_directed(c.vectors(), 5, 0.3).withColumn("similarity", r6(F.col("similarity")))


@query(["vecs"], _SIMS + " SELECT a, b, round(s, 6) + 0.0::DOUBLE AS similarity FROM top")
def cosine_topk_blocks(c):
    return simjoin.topk_blocks(c.vectors(), 5, 0.3, block_rows=1024).withColumn("similarity", r6(F.col("similarity")))


_UND = _SIMS + ", und AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(s) AS s FROM top GROUP BY ALL)"


@query(["vecs"], _UND + " SELECT a, b, round(s, 6) + 0.0::DOUBLE AS similarity FROM und")
def cosine_candidates_undirected(c):
    return simjoin.undirected(simjoin.topk_blocks(c.vectors(), 5, 0.3)).withColumn("similarity", r6(F.col("similarity")))


_CLASS = _UND + ", cl AS (SELECT a, b, s, CASE WHEN a % 3 = 0 THEN 'video' ELSE 'image' END AS type_a, CASE WHEN b % 3 = 0 THEN 'video' ELSE 'image' END AS type_b, CASE WHEN s >= 0.45 THEN 'resolved' WHEN a % 3 = 0 AND b % 3 = 0 AND s >= 0.38 THEN 'escalate' END AS status FROM und)"


def _scored(c):
    types = c.table("embeddings").select(F.col("vec_id").alias("asset_id"), F.when(F.col("vec_id") % 3 == 0, "video").otherwise("image").alias("type"))
    return simjoin.classify(simjoin.undirected(simjoin.topk_blocks(c.vectors(), 5, 0.3)), types, 0.45, 0.38)


@query(["vecs"], _CLASS + " SELECT a, b, type_a, type_b, round(s, 6) + 0.0::DOUBLE AS similarity, status FROM cl WHERE status IS NOT NULL")
def classify_candidate_pairs(c):
    return _scored(c).select("a", "b", "type_a", "type_b", r6(F.col("similarity")).alias("similarity"), "status")


@query(["vecs"], _CLASS + " SELECT count(*) FILTER (status = 'resolved') AS n_resolved, count(*) FILTER (status = 'escalate') AS n_escalate FROM cl")
def pair_status_counts(c):
    return _scored(c).agg(F.count_if(F.col("status") == "resolved").alias("n_resolved"), F.count_if(F.col("status") == "escalate").alias("n_escalate"))


# alignment

_DIAG = """, n AS (SELECT asset_id, count(*) AS n FROM seqs GROUP BY asset_id),
cells AS (SELECT x.asset_id AS a, y.asset_id AS b, y.frame_index - x.frame_index AS o, count(*) AS k FROM seqs x JOIN seqs y ON x.asset_id < y.asset_id WHERE list_cosine_similarity(x.v, y.v) >= 0.2 GROUP BY ALL),
best AS (SELECT a, b, o, k FROM cells QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY k DESC, o) = 1),
al AS (SELECT p.asset_id AS a, q.asset_id AS b, CAST(o AS INTEGER) AS "offset", CAST(coalesce(k, 0) AS INTEGER) AS match_count, p.n AS n_a, q.n AS n_b, coalesce(k, 0) / least(p.n, q.n) AS r FROM n p JOIN n q ON p.asset_id < q.asset_id LEFT JOIN best ON a = p.asset_id AND b = q.asset_id)"""


def _aligned(c):
    s = c.sequences()
    ids = s.select("asset_id").distinct()
    pairs = ids.select(F.col("asset_id").alias("a")).join(ids.select(F.col("asset_id").alias("b")), F.col("a") < F.col("b"))
    return align.diagonal_overlap(pairs, s, 0.2)


@query(["seqs"], _DIAG + ' SELECT a, b, "offset", match_count, n_a, n_b, round(r, 6) + 0.0::DOUBLE AS overlap_ratio FROM al')
def diagonal_overlap(c):
    return _aligned(c).withColumn("overlap_ratio", r6(F.col("overlap_ratio")))


@query(["seqs"], _DIAG + ' SELECT a, b, "offset", match_count, (match_count >= 6 AND r >= 0.12) AS is_duplicate FROM al')
def alignment_verdict(c):
    return align.verdict(_aligned(c), 6, 0.12).select("a", "b", "offset", "match_count", "is_duplicate")


@query(["vecs"], _CLASS + " SELECT a AS asset_id FROM cl WHERE status = 'escalate' UNION SELECT b FROM cl WHERE status = 'escalate'")
def dense_asset_dedupe(c):
    e = _scored(c).filter("status = 'escalate'")
    return e.select(F.col("a").alias("asset_id")).union(e.select("b")).distinct()


# groups and keepers


@query(["dist", "assets"], """, star AS (SELECT min(asset_id) OVER (PARTITION BY sha256) AS a, asset_id AS b FROM assets QUALIFY count(*) OVER (PARTITION BY sha256) > 1),
edges AS (SELECT a, b FROM star WHERE a <> b UNION SELECT a, b FROM dist WHERE distance <= 2),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON e.a = r.y)
SELECT x AS asset_id, min(y) AS group_root FROM reach GROUP BY x""", recursive=True)
def duplicate_clusters(c):
    a = c.assets()
    edges = dedupe.star_edges(dedupe.exact_groups(a)).union(dedupe.hamming_pairs(c.signatures(), ["phash"], 2).select("a", "b"))
    from .operators.graph import connected_components

    return connected_components(edges, "a", "b").select(F.col("vertex").alias("asset_id"), F.col("component").alias("group_root"))


@query(["assets"], """, g AS (SELECT asset_id, group_id FROM (SELECT asset_id, dense_rank() OVER (ORDER BY sha256) - 1 AS group_id, count(*) OVER (PARTITION BY sha256) AS n FROM assets) WHERE n > 1),
k AS (SELECT a.asset_id, g.group_id, a.path, a.mtime, CASE WHEN type = 'video' AND duration > 0 THEN round_even(duration / 1.5, 0) * 1.5 ELSE 0.0 END AS duration_bucket, CAST(coalesce(width, 0) * coalesce(height, 0) AS BIGINT) AS resolution, CASE WHEN type = 'video' AND duration > 0 THEN size / duration ELSE CAST(size AS DOUBLE) END AS quality FROM g JOIN assets a ON a.asset_id = g.asset_id)
SELECT asset_id, group_id, path, CAST(row_number() OVER w - 1 AS INTEGER) AS rank, (row_number() OVER w = 1) AS is_keeper, CAST(duration_bucket AS DOUBLE) AS duration_bucket, resolution, round(quality, 6) + 0.0::DOUBLE AS quality_key, mtime FROM k WINDOW w AS (PARTITION BY group_id ORDER BY duration_bucket DESC, resolution DESC, quality DESC, mtime DESC, asset_id)""")
def keeper_rank(c):
    a = c.assets()
    return rank.keeper_rank(dedupe.exact_groups(a).select("asset_id", "group_id"), a).withColumn("quality_key", r6(F.col("quality_key")))


_RANKED = """, k AS (SELECT a.asset_id, g.group_id, a.path, a.mtime, CASE WHEN type = 'video' AND duration > 0 THEN round_even(duration / 1.5, 0) * 1.5 ELSE 0.0 END AS duration_bucket, CAST(coalesce(width, 0) * coalesce(height, 0) AS BIGINT) AS resolution, CASE WHEN type = 'video' AND duration > 0 THEN size / duration ELSE CAST(size AS DOUBLE) END AS quality FROM g JOIN assets a ON a.asset_id = g.asset_id)
SELECT asset_id, group_id, path, CAST(row_number() OVER w - 1 AS INTEGER) AS rank, (row_number() OVER w = 1) AS is_keeper, CAST(duration_bucket AS DOUBLE) AS duration_bucket, resolution, round(quality, 6) + 0.0::DOUBLE AS quality_key, mtime FROM k WINDOW w AS (PARTITION BY group_id ORDER BY duration_bucket DESC, resolution DESC, quality DESC, mtime DESC, asset_id)"""
_CLOSED = """both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON e.a = r.y),
g AS (SELECT x AS asset_id, min(y) AS group_id FROM reach GROUP BY x)"""
_TIERS = """, exact AS (SELECT asset_id, min(asset_id) OVER (PARTITION BY sha256) AS lead FROM assets QUALIFY count(*) OVER (PARTITION BY sha256) > 1),
near AS (SELECT a, b FROM dist WHERE distance <= 2 AND a NOT IN (SELECT asset_id FROM exact) AND b NOT IN (SELECT asset_id FROM exact))"""


def _ranked(d: DataFrame) -> DataFrame:
    return d.withColumn("quality_key", r6(F.col("quality_key")))


@query(["assets", "dist"], _TIERS + ", edges AS (SELECT lead AS a, asset_id AS b FROM exact WHERE lead <> asset_id UNION SELECT a, b FROM near), " + _CLOSED + _RANKED, recursive=True)
def flagship_duplicate_cascade(c):
    return _ranked(duplicate_groups(c.assets(), c.signatures(), ["phash"], DedupeConfig()))


_SOURCES = """SELECT source AS asset_id, 'video' AS type, '/lib/' || source AS path, sum(n_chars) AS size, max(doc_id) AS mtime, 640 AS width, 480 AS height, count(*) / 2.0::DOUBLE AS duration FROM documents GROUP BY source"""


@query(["sigs"], f", assets AS ({_SOURCES})" + """, fh AS (SELECT d.source, s.phash, s.asset_id AS f FROM sigs s JOIN documents d ON d.doc_id = s.asset_id), n AS (SELECT source, count(*) AS n FROM fh GROUP BY source),
edges AS (SELECT a, b FROM (SELECT x.source AS a, y.source AS b, count(DISTINCT x.f) AS m FROM fh x JOIN fh y ON x.source < y.source AND bit_count(xor(('0x' || x.phash)::UBIGINT, ('0x' || y.phash)::UBIGINT)) <= 2 GROUP BY x.source, y.source) JOIN n p ON p.source = a JOIN n q ON q.source = b WHERE m / least(p.n, q.n) >= 0.04), """ + _CLOSED + _RANKED, recursive=True)
def frame_duplicate_cascade(c):
    """The cascade on assets of many frames each: one matching frame makes no duplicate."""
    index = c.sql(_SOURCES).withColumn("sha256", F.sha2("asset_id", 256))
    return _ranked(duplicate_groups(index, c.frame_hashes(), ["phash"], DedupeConfig(min_frame_match_ratio=0.04)))


@query(["assets", "dist"], _TIERS + """, opened AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings WHERE vec_id IN (SELECT asset_id FROM assets) AND vec_id NOT IN (SELECT asset_id FROM exact) AND vec_id NOT IN (SELECT a FROM near) AND vec_id NOT IN (SELECT b FROM near)),
sims AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM opened a, opened b WHERE a.id <> b.id), top AS (SELECT a, b, s FROM sims WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
und AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(s) AS s FROM top GROUP BY ALL),
cl AS (SELECT a, b, CASE WHEN s >= 0.42 THEN 'resolved' WHEN a % 3 = 0 AND b % 3 = 0 AND s >= 0.3 THEN 'escalate' END AS status FROM und),
fr AS (SELECT e.vec_id // 3 * 3 AS id, e.vec_id % 3 AS i, e.embedding::double[] AS v FROM embeddings e),
hits AS (SELECT a, b, y.i - x.i AS o, count(*) AS k FROM cl JOIN fr x ON x.id = a JOIN fr y ON y.id = b WHERE status = 'escalate' AND list_cosine_similarity(x.v, y.v) >= 0.1 GROUP BY ALL),
aligned AS (SELECT a, b FROM hits GROUP BY a, b HAVING max(k) >= 2),
edges AS (SELECT lead AS a, asset_id AS b FROM exact WHERE lead <> asset_id UNION SELECT a, b FROM near UNION SELECT a, b FROM cl WHERE status = 'resolved' UNION SELECT a, b FROM aligned), """ + _CLOSED + _RANKED, recursive=True)
def full_duplicate_cascade(c):
    """All four tiers: copies, hashes, vectors of assets, and sequences of three vectors for videos."""
    cfg = DedupeConfig(floor=0.3, resolve_threshold=0.42, escalate_threshold=0.3, align_threshold=0.1, min_overlap_frames=2, min_overlap_ratio=0.1)
    vectors = c.vectors("asset_id").join(c.sql(C.ASSETS).select("asset_id"), "asset_id", "left_semi")
    frames = c.vectors("v").select((F.floor(F.col("v") / 3) * 3).alias("asset_id"), (F.col("v") % 3).alias("frame_index"), "embedding")
    return _ranked(duplicate_groups(c.assets(), c.signatures(), ["phash"], cfg, vectors, frames))


# sampling on event sequences

_SAMPLED = "SELECT asset_id, frame_index, event_id FROM (SELECT user_id AS asset_id, CAST(floor((epoch_us(ts) - t0) / 1000000.0 / {step}) AS BIGINT) AS frame_index, event_id, row_number() OVER (PARTITION BY user_id, floor((epoch_us(ts) - t0) / 1000000.0 / {step}) ORDER BY ts, event_id) AS r FROM (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0, (max(epoch_us(ts)) OVER (PARTITION BY user_id) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0 AS dur FROM events)) WHERE r = 1"


@query(None, _SAMPLED.format(step="greatest(dur / 20, 1.0)"))
def sparse_sampling(c):
    from .sources.sampling import sample_sparse

    return sample_sparse(c.table("events"), 20, 1.0)


@query(None, _SAMPLED.format(step="86400.0"))
def dense_sampling(c):
    from .sources.sampling import sample_dense

    return sample_dense(c.table("events"), 86400.0)


# vectors


@query(["vecs"], "SELECT id, CAST(p AS INTEGER) - 1 AS pos, round(x / sqrt(list_dot_product(v, v)), 6) + 0.0::DOUBLE AS x FROM (SELECT id, v, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM vecs)")
def l2_normalise(c):
    u = c.vectors().select("id", F.posexplode(vector.unit(F.col("embedding"))).alias("pos", "x"))
    return u.withColumn("x", r6(F.col("x")))


_POOL = ", m AS (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM vecs) GROUP BY label, p), nn AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)"


@query(["vecs"], _POOL + " SELECT m.label, CAST(p AS INTEGER) - 1 AS pos, round(m / n, 6) + 0.0::DOUBLE AS x FROM m JOIN nn ON nn.label = m.label")
def mean_pool_embedding(c):
    p = vector.mean_of(c.vectors(), "label", "embedding").select("label", F.posexplode(vector.unit(F.col("vector"))).alias("pos", "x"))
    return p.withColumn("x", r6(F.col("x")))


@query(["cents"], "SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(p AS INTEGER) - 1 AS pos, round(x, 6) + 0.0::DOUBLE AS x FROM (SELECT cluster_id, unnest(c) AS x, generate_subscripts(c, 1) AS p FROM cents)")
def cluster_centroids(c):
    return refine.centroids(c.clusters()).select("cluster_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", r6(F.col("x")))


_NEXT = ", prs AS (SELECT x.id AS a, y.id AS b, x.v AS p, y.v AS q FROM vecs x JOIN vecs y ON y.id = x.id + 1)"


def _neighbour_pairs(c):
    v = c.vectors().select("id", "embedding")
    return v.select(F.col("id").alias("a"), F.col("embedding").alias("p"), (F.col("id") + 1).alias("b")).join(v.select(F.col("id").alias("b"), F.col("embedding").alias("q")), "b")


@query(["vecs"], _NEXT + " SELECT a, b, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: abs(p[i] - q[i]))), 6) + 0.0::DOUBLE AS manhattan, round(list_distance(p, q), 6) + 0.0::DOUBLE AS euclidean, round(least(1.0, greatest(0.0, 1 - list_cosine_similarity(p, q))), 6) + 0.0::DOUBLE AS cosine FROM prs")
def distance_metrics(c):
    return _neighbour_pairs(c).select("a", "b", *[r6(vector.distance(m, F.col("p"), F.col("q"))).alias(m) for m in ("manhattan", "euclidean", "cosine")])


@query(["vecs"], _NEXT + " SELECT a, b, round(1.0::DOUBLE / (1 + d), 6) + 0.0::DOUBLE AS reciprocal, round(greatest(0.0, 1 - d), 6) + 0.0::DOUBLE AS linear, round(exp(-d), 6) + 0.0::DOUBLE AS exponential FROM (SELECT a, b, list_distance(p, q) AS d FROM prs)")
def similarity_transforms(c):
    d = _neighbour_pairs(c).withColumn("d", vector.distance("euclidean", F.col("p"), F.col("q")))
    return d.select("a", "b", *[r6(vector.transform(k, F.col("d"))).alias(n) for k, n in (("reciprocal", "reciprocal"), ("linear", "linear"), ("exp", "exponential"))])


_FUSED = f"""SELECT entity_id, list_transform(range(1, 65), lambda i: CASE WHEN f IS NOT NULL THEN 0.6::DOUBLE * f[i] + CASE WHEN b IS NOT NULL THEN 0.25::DOUBLE * b[i] ELSE 0.0::DOUBLE END + 0.15::DOUBLE * c[i] WHEN b IS NOT NULL THEN 0.65::DOUBLE * b[i] + 0.35::DOUBLE * c[i] ELSE c[i] END) AS w
FROM (SELECT m.entity_id, x.embedding::double[] AS c, y.embedding::double[] AS b, z.embedding::double[] AS f FROM ({C.MODAL}) m JOIN embeddings x ON x.vec_id = m.entity_id LEFT JOIN embeddings y ON y.vec_id = m.body_vec LEFT JOIN embeddings z ON z.vec_id = m.face_vec)"""


@query(None, f"SELECT entity_id, CAST(p AS INTEGER) - 1 AS pos, round(x / sqrt(list_dot_product(w, w)), 6) + 0.0::DOUBLE AS x FROM (SELECT entity_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM ({_FUSED}))")
def fuse_modalities(c):
    return fuse.fuse(c.modal()).select("entity_id", F.posexplode("fused").alias("pos", "x")).withColumn("x", r6(F.col("x")))


# boxes


def _box(c):
    return c.boxes().select("det_id", *entities.cols()), entities.cols()


_CLIP = "SELECT det_id, x1, y1, x2, y2 FROM (SELECT det_id, least(greatest({x1}, 0), 400) AS x1, least(greatest({y1}, 0), 300) AS y1, least(greatest({x2}, 0), 400) AS x2, least(greatest({y2}, 0), 300) AS y2 FROM boxes) WHERE x2 > x1 AND y2 > y1"


@query(["boxes"], _CLIP.format(x1="x1", y1="y1", x2="x2", y2="y2"))
def bbox_clamp(c):
    b, k = _box(c)
    return b.select("det_id", bbox.clamp(k, F.lit(400.0), F.lit(300.0)).alias("b")).filter("b is not null").select("det_id", "b.*")


@query(["boxes"], "SELECT det_id, x1, y1, x2, y2 FROM (SELECT det_id, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1, CAST(trunc(x2) AS INTEGER) AS x2, CAST(trunc(y2) AS INTEGER) AS y2 FROM (" + _CLIP.split(" WHERE ")[0].replace("SELECT det_id, x1, y1, x2, y2 FROM (", "", 1).rsplit(")", 1)[0].format(x1="x1 - (x2 - x1) * 0.05", y1="y1 - (y2 - y1) * 0.05", x2="x2 + (x2 - x1) * 0.05", y2="y2 + (y2 - y1) * 0.05") + ")) WHERE x2 > x1 AND y2 > y1")
def bbox_clamp_padded(c):
    b, k = _box(c)
    return b.select("det_id", bbox.clamp_padded(k, F.lit(400.0), F.lit(300.0), 0.05).alias("b")).filter("b is not null").select("det_id", "b.*")


@query(["boxes"], "SELECT det_id, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2 FROM (" + _CLIP.format(x1="trunc(x1)", y1="trunc(y1)", x2="trunc(x2)", y2="trunc(y2)") + ")")
def bbox_clamp_int(c):
    b, k = _box(c)
    return b.select("det_id", bbox.clamp_int(k, F.lit(400), F.lit(300)).alias("b")).filter("b is not null").select("det_id", "b.*")


@query(["boxes"], "SELECT det_id, x1 + 10 AS x1, y1 + 20 AS y1, x2 - x1 AS w, y2 - y1 AS h FROM boxes")
def bbox_offset(c):
    b, k = _box(c)
    x1, y1, w, h = bbox.tlwh(bbox.offset(k, F.lit(10.0), F.lit(20.0)))
    return b.select("det_id", x1.alias("x1"), y1.alias("y1"), w.alias("w"), h.alias("h"))


_IOU = """, prs AS (SELECT b.asset_id, b.source, b.det_id, f.face_id, b.x1, b.y1, b.x2, b.y2, f.x1 AS u1, f.y1 AS v1, f.x2 AS u2, f.y2 AS v2 FROM boxes b JOIN faces f ON f.asset_id = b.asset_id AND f.source = b.source),
io AS (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) AS i FROM prs),
ious AS (SELECT asset_id, source, det_id, face_id, CASE WHEN i <= 0 THEN 0.0 ELSE i / greatest(greatest(0, x2 - x1) * greatest(0, y2 - y1) + greatest(0, u2 - u1) * greatest(0, v2 - v1) - i, 1e-6) END AS iou FROM io)"""


@query(["boxes", "faces"], _IOU + " SELECT det_id, face_id, round(iou, 6) + 0.0::DOUBLE AS iou FROM ious WHERE iou > 0.2")
def bbox_iou_pairs(c):
    f = c.faces().select("asset_id", "source", "face_id", *[F.col(k).alias(f"f_{k}") for k in ("x1", "y1", "x2", "y2")])
    j = c.boxes().join(f, ["asset_id", "source"]).withColumn("iou", bbox.iou(entities.cols(), entities.cols("f_")))
    return j.filter("iou > 0.2").select("det_id", "face_id", r6(F.col("iou")).alias("iou"))


@query(["boxes", "faces"], _IOU + " SELECT asset_id, source, det_id, face_id, round(iou, 6) + 0.0::DOUBLE AS iou FROM ious WHERE iou > 0.2 QUALIFY row_number() OVER (PARTITION BY asset_id, source, det_id ORDER BY iou DESC, face_id) = 1")
def best_iou_match(c):
    return entities.best_match(c.boxes(), c.faces(), ["asset_id", "source"], "det_id", "face_id", 0.2).withColumn("iou", r6(F.col("iou")))


_BEST = _IOU + ", bm AS (SELECT asset_id, source, det_id, face_id FROM ious WHERE iou > 0.2 QUALIFY row_number() OVER (PARTITION BY asset_id, source, face_id ORDER BY iou DESC, det_id) = 1)"


def _faced(c):
    m = entities.best_match(c.faces(), c.boxes().withColumnRenamed("det_id", "d"), ["asset_id", "source"], "face_id", "d", 0.2)
    f = c.faces().join(m.select("face_id", F.col("d").alias("det_id")), "face_id")
    return entities.faces_by_detection(c.boxes(), f.select("asset_id", "det_id", "face_id", "confidence"))


@query(["boxes", "faces"], _BEST + " SELECT b.asset_id, b.det_id, CAST(count(face_id) AS INTEGER) AS n_faces, coalesce(min(face_id), -1) AS first_face FROM boxes b LEFT JOIN bm ON bm.det_id = b.det_id GROUP BY b.asset_id, b.det_id")
def faces_grouped_to_detection(c):
    return _faced(c).select("asset_id", "det_id", F.size("faces").alias("n_faces"), F.coalesce(F.get("faces", F.lit(0))["face_id"], F.lit(-1)).alias("first_face"))


@query(["boxes"], "SELECT det_id, confidence FROM boxes WHERE confidence >= 0.6")
def confidence_filter(c):
    return c.boxes().filter("confidence >= 0.6").select("det_id", "confidence")


@query(["boxes", "faces"], _BEST + " SELECT b.asset_id, b.det_id, 1 AS frame_count, count(face_id) > 0 AS has_face, sha1(CAST(b.asset_id AS VARCHAR) || CAST(b.det_id AS VARCHAR)) AS entity_id FROM boxes b LEFT JOIN bm ON bm.det_id = b.det_id GROUP BY b.asset_id, b.det_id")
def entity_assembly_image(c):
    f = _faced(c).withColumn("k", F.col("det_id"))
    return entities.assemble(f, ["asset_id", "k"]).select("asset_id", F.col("k").alias("det_id"), "frame_count", "has_face", "entity_id")


@query(["boxes", "faces"], _BEST + " SELECT b.asset_id, b.det_id % 5 AS track_id, CAST(count(DISTINCT b.det_id) AS INTEGER) AS frame_count, count(face_id) > 0 AS has_face FROM boxes b LEFT JOIN bm ON bm.det_id = b.det_id GROUP BY b.asset_id, b.det_id % 5 HAVING count(DISTINCT b.det_id) >= 3")
def entity_assembly_track(c):
    f = _faced(c).withColumn("track_id", F.col("det_id") % 5)
    return entities.assemble(f, ["asset_id", "track_id"], 3).select("asset_id", "track_id", "frame_count", "has_face")


@query()
def greedy_track_match(c):
    t = c.faces().withColumnRenamed("face_id", "track_id")
    return entities.greedy_match(t, c.boxes(), ["asset_id", "source"], 0.2)


@query()
def bytetrack_entities(c):
    d = c.boxes().withColumn("source", F.floor(F.col("det_id") / 3))
    return entities.track(d)


# clusters


@query()
def average_linkage_split(c):
    return cluster.split_large(c.clusters(), 0.8, 45)


@query()
def relabel_split_clusters(c):
    return cluster.relabel(cluster.split_large(c.clusters(), 0.8, 45))


@query()
def hdbscan_clusters(c):
    return cluster.hdbscan(c.vectors("entity_id"), 5, 3)


@query(["cpairs"], """, e AS (SELECT cluster_id AS a, other AS b FROM cpairs WHERE similarity >= 0.2),
reach AS (SELECT cluster_id AS x, cluster_id AS y FROM cents UNION SELECT r.x, e.b FROM reach r JOIN e ON e.a = r.y),
comp AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT CAST(x AS INTEGER) AS cluster_id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS new_id FROM comp""", recursive=True)
def merge_similar_clusters(c):
    return refine.merge_similar(c.clusters(), 0.2).select("cluster_id", "new_id")


_NOISE = ", s AS (SELECT n.entity_id, k.cluster_id, list_cosine_similarity(n.v, k.c) AS s FROM clus n, cents k WHERE n.cluster_id < 0), b AS (SELECT entity_id, CAST(cluster_id AS INTEGER) AS cluster_id, s FROM s QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, cluster_id) = 1)"


@query(["cents"], _NOISE + " SELECT entity_id, cluster_id, round(s, 6) + 0.0::DOUBLE AS similarity FROM b WHERE s >= 0.2")
def reassign_noise(c):
    return refine.reassign_noise(c.clusters(), 0.2).withColumn("similarity", r6(F.col("similarity")))


@query(["cents"], _NOISE + " SELECT entity_id, cluster_id, round(s, 6) + 0.0::DOUBLE AS similarity FROM b")
def force_reassign_noise(c):
    return refine.reassign_noise(c.clusters(), None).withColumn("similarity", r6(F.col("similarity")))


_TARGET = ", n AS (SELECT cluster_id, count(*) AS size FROM clus WHERE cluster_id >= 0 GROUP BY cluster_id), near AS (SELECT cluster_id, other, similarity FROM cpairs QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, other) = 1) SELECT CAST(near.cluster_id AS INTEGER) AS cluster_id, n.size, CAST(other AS INTEGER) AS target, round(similarity, 6) + 0.0::DOUBLE AS similarity FROM near JOIN n ON n.cluster_id = near.cluster_id JOIN n t ON t.cluster_id = other WHERE "


def _targets(c, *a, **k):
    t = refine.small_targets(c.clusters(), *a, **k)
    return t.select(F.col("cluster_id").cast("int").alias("cluster_id"), "size", F.col("target").cast("int").alias("target"), r6(F.col("similarity")).alias("similarity"))


@query(["cpairs"], _TARGET + "n.size <= 4 AND similarity >= CASE WHEN t.size >= 45 THEN 0.25 ELSE 0.1 END")
def tiny_cluster_targets(c):
    return _targets(c, 4, 0.1, 45, 0.25)


@query(["cpairs"], _TARGET + "n.size < 4 AND similarity >= 0.05")
def min_size_targets(c):
    return _targets(c, 3, 0.05)


@query(["cpairs"], _TARGET + "n.size = 1")
def singleton_targets(c):
    return _targets(c, 1, -2.0)


@query()
def refine_pipeline(c):
    return refine.refine(c.clusters(), 0.2, 0.2, 4, 0.1, 45, 0.25, 4, 0.05, 45, 0.8)


@query()
def identities(c):
    """Fuse, cluster, split and refine, with thresholds that vectors without clusters of their own still meet."""
    cfg = IdentityConfig(min_cluster_size=5, min_samples=3, max_cluster_size=50, split_threshold=0.8, merge_threshold=0.6, noise_threshold=0.2, small_threshold=0.2, small_size=4, large_size=60, small_to_large_threshold=0.3, refine_split_threshold=0.8, min_size=4, min_size_threshold=0.1)
    return identity_clusters(c.modal(), cfg)


# overlays and edits


@query(["base", "last_edits"], "SELECT b.asset_id, coalesce(e.group_id, b.group_id) AS group_id FROM base b LEFT JOIN last_edits e ON e.asset_id = b.asset_id")
def overlay_left(c):
    return overlay.overlay_known(c.base(), c.edits(), "asset_id").select("asset_id", "group_id")


def _effective(c):
    return overlay.overlay_full(c.base(), c.edits(), c.sql(C.ASSETS))


@query(["effective"], "SELECT asset_id, group_id FROM effective")
def overlay_full(c):
    return _effective(c)


@query(["last_edits"], "SELECT asset_id, group_id FROM last_edits")
def last_override_wins(c):
    return overlay.last_wins(c.edits(), "asset_id").select("asset_id", "group_id")


@query(["effective"], "SELECT asset_id, group_id FROM effective UNION ALL SELECT asset_id, -row_number() OVER (ORDER BY asset_id) FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM effective)")
def unmatched_singletons(c):
    return overlay.with_singletons(_effective(c), c.sql(C.ASSETS))


@query(["effective"], "SELECT asset_id, CASE WHEN group_id IN (5, 9, 1010) THEN 5 ELSE group_id END AS group_id FROM effective")
def merge_groups_edit(c):
    return overlay.merge_groups(_effective(c), c.edits(), [9, 5, 1010])


_FRESH = "(SELECT max(g) + 1 FROM (SELECT group_id AS g FROM effective UNION ALL SELECT group_id FROM edits))"


@query(["effective"], f"SELECT asset_id, CASE WHEN asset_id = 7 THEN {_FRESH} ELSE group_id END AS group_id FROM effective")
def remove_member_edit(c):
    return overlay.move(_effective(c), [7], None, c.edits())


@query(["clus"], "SELECT entity_id, CAST(CASE WHEN entity_id IN (3, 14, 25) THEN 2 ELSE cluster_id END AS INTEGER) AS cluster_id FROM clus")
def move_entities_edit(c):
    return overlay.move(c.clusters().select("entity_id", "cluster_id"), [3, 14, 25], 2, id_col="entity_id", value_col="cluster_id")


@query(["clus"], "SELECT entity_id, CAST(CASE WHEN cluster_id = 4 THEN 6 ELSE cluster_id END AS INTEGER) AS cluster_id FROM clus")
def merge_clusters_edit(c):
    return overlay.retarget(c.clusters().select("entity_id", "cluster_id"), 4, 6, "cluster_id")


@query(["clus"], "SELECT entity_id, CAST(CASE WHEN entity_id IN (2, 13, 24) THEN (SELECT max(cluster_id) + 1 FROM clus) ELSE cluster_id END AS INTEGER) AS cluster_id FROM clus")
def split_cluster_edit(c):
    return overlay.move(c.clusters().select("entity_id", "cluster_id"), [2, 13, 24], None, id_col="entity_id", value_col="cluster_id")


@query(["clus"], "SELECT entity_id, CAST(CASE WHEN cluster_id IN (1, 2, 5) THEN (SELECT max(cluster_id) + 1 FROM clus) ELSE cluster_id END AS INTEGER) AS cluster_id FROM clus")
def merge_selected_edit(c):
    return overlay.edit_clusters(c.clusters().select("entity_id", "cluster_id"), "merge_selected", cluster_ids=[1, 2, 5])


@query(["base", "edits"], "SELECT b.asset_id, coalesce(e.group_id, b.group_id) AS group_id FROM base b LEFT JOIN (SELECT asset_id, group_id FROM edits WHERE seq = 1) e ON e.asset_id = b.asset_id")
def undo_redo_state(c):
    h = overlay.History()
    h.edit()
    h.edit()
    h.undo()
    log = c.edits().withColumnRenamed("seq", "version")
    return overlay.overlay_known(c.base(), overlay.at_version(log, h.version).withColumnRenamed("version", "seq"), "asset_id").select("asset_id", "group_id")


@query(["effective"], "SELECT group_id, count(*) AS size FROM effective GROUP BY group_id HAVING count(*) > 1 ORDER BY size DESC, group_id LIMIT 12 OFFSET 6")
def groups_page(c):
    return views.groups_page(_effective(c), 6, 12)


@query(["effective"], """, k AS (SELECT a.*, e.group_id, CASE WHEN type = 'video' AND duration > 0 THEN round_even(duration / 1.5, 0) * 1.5 ELSE 0.0 END AS bucket, coalesce(width, 0) * coalesce(height, 0) AS res, CASE WHEN type = 'video' AND duration > 0 THEN size / duration ELSE size END AS q FROM effective e JOIN assets a ON a.asset_id = e.asset_id WHERE e.group_id = 3)
SELECT asset_id, rank, is_keeper FROM (SELECT asset_id, CAST(row_number() OVER w - 1 AS INTEGER) AS rank, row_number() OVER w = 1 AS is_keeper FROM k WINDOW w AS (ORDER BY bucket DESC, res DESC, q DESC, mtime DESC, asset_id)) WHERE rank >= 2 AND rank < 8""")
def group_members_page(c):
    return views.group_members(_effective(c), c.sql(C.ASSETS), 3, 2, 6).select("asset_id", "rank", "is_keeper")


@query(["effective"], "SELECT count(*) FILTER (n > 1) AS duplicate_count, count(*) FILTER (n = 1) AS singleton_count, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_asset_count FROM (SELECT count(*) AS n FROM effective GROUP BY group_id)")
def group_counters(c):
    return views.group_counters(_effective(c))


@query(["effective"], "SELECT group_id, n AS size, CASE WHEN n = 1 THEN CASE WHEN length(b) > 10 THEN substr(b, 1, 10) || '...' ELSE b END ELSE 'Bucket ' || group_id END AS title FROM (SELECT group_id, count(*) AS n, min(regexp_extract(path, '([^/]*)$', 1)) AS b FROM effective e JOIN assets a ON a.asset_id = e.asset_id GROUP BY group_id)")
def group_titles(c):
    a = c.sql(C.ASSETS).select("asset_id", F.element_at(F.split("path", "/"), -1).alias("b"))
    g = _effective(c).join(a, "asset_id").groupBy("group_id").agg(F.count("*").alias("size"), F.min("b").alias("b"))
    return g.select("group_id", "size", views.title(F.col("b"), F.col("size"), F.col("group_id")).alias("title"))


# cluster screens

_MEM = f""", mem AS (SELECT c.entity_id, c.cluster_id, m.k AS modality, CASE m.k WHEN 'clip' THEN x.embedding WHEN 'body' THEN y.embedding ELSE z.embedding END::double[] AS v
FROM ({C.MODAL}) o JOIN ({C.CLUSTERS}) c ON c.entity_id = o.entity_id CROSS JOIN (VALUES ('clip'), ('body'), ('face')) m(k)
JOIN embeddings x ON x.vec_id = o.entity_id LEFT JOIN embeddings y ON y.vec_id = o.body_vec LEFT JOIN embeddings z ON z.vec_id = o.face_vec WHERE c.cluster_id >= 0),
mc AS (SELECT cluster_id, modality, list(m ORDER BY p) AS c FROM (SELECT cluster_id, modality, p, avg(x) AS m FROM (SELECT cluster_id, modality, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM mem WHERE v IS NOT NULL) GROUP BY cluster_id, modality, p) GROUP BY cluster_id, modality),
sim AS (SELECT mem.entity_id, mem.cluster_id, mem.modality, CASE WHEN v IS NOT NULL AND c IS NOT NULL THEN 1 / (1 + least(1.0, greatest(0.0, 1 - list_cosine_similarity(v, c)))) END AS s FROM mem LEFT JOIN mc ON mc.cluster_id = mem.cluster_id AND mc.modality = mem.modality)"""


def _members(c):
    return fuse.presence(c.modal()).join(c.sql(C.CLUSTERS).select("entity_id", F.col("cluster_id").cast("int").alias("cluster_id")), "entity_id")


@query(["clus"], _MEM + " SELECT entity_id, CAST(cluster_id AS INTEGER) AS cluster_id, modality, coalesce(round(s, 6) + 0.0::DOUBLE, -1.0::DOUBLE) AS similarity FROM sim")
def cluster_detail_items(c):
    return views.own_similarity(_members(c)).select("entity_id", "cluster_id", "modality", F.coalesce(r6(F.col("similarity")), F.lit(-1.0)).alias("similarity"))


@query(["clus"], _MEM + " SELECT CAST(cluster_id AS INTEGER) AS cluster_id, modality, coalesce(round(avg(s), 6) + 0.0::DOUBLE, -1.0::DOUBLE) AS average, count(s) AS coverage FROM sim GROUP BY cluster_id, modality")
def modality_coverage(c):
    return views.modality_coverage(views.own_similarity(_members(c))).withColumn("average", F.coalesce(r6(F.col("average")), F.lit(-1.0)))


@query(["clus"], _MEM + ", cov AS (SELECT cluster_id, modality, avg(s) AS a, count(s) AS n FROM sim GROUP BY cluster_id, modality) SELECT modality, round(sum(a * n) / sum(n), 6) + 0.0::DOUBLE AS average, CAST(sum(n) AS BIGINT) AS coverage, (SELECT count(*) FROM clus WHERE cluster_id IN (1, 2, 3)) AS size FROM cov WHERE cluster_id IN (1, 2, 3) GROUP BY modality")
def multi_cluster_summary(c):
    cov = views.modality_coverage(views.own_similarity(_members(c)))
    sizes = c.clusters().groupBy("cluster_id").agg(F.count("*").alias("size"))
    return views.multi_cluster_summary(cov, sizes, [1, 2, 3]).withColumn("average", r6(F.col("average")))


@query(["clus"], "SELECT CAST(cluster_id AS INTEGER) AS cluster_id, count(*) AS size, count(DISTINCT entity_id % 7) AS unique_assets, CAST(sum(1 + entity_id % 4) AS BIGINT) AS frames_total, CAST(sum(entity_id % 3) AS BIGINT) AS faces_total FROM clus WHERE cluster_id >= 0 GROUP BY cluster_id")
def cluster_overview(c):
    m = c.clusters().select("entity_id", "cluster_id", (F.col("entity_id") % 7).alias("asset_id"), (1 + F.col("entity_id") % 4).alias("frame_count"), (F.col("entity_id") % 3).alias("face_count"))
    return views.cluster_overview(m)


@query(["clus"], "SELECT CAST(cluster_id AS INTEGER) AS cluster_id, entity_id % 7 AS asset_id, min(entity_id) AS first_entity, count(*) AS n_entities FROM clus GROUP BY ALL")
def items_by_asset(c):
    return views.items_by_asset(c.clusters().select("entity_id", "cluster_id", (F.col("entity_id") % 7).alias("asset_id")))


@query(["cpairs"], "SELECT CAST(other AS INTEGER) AS suggested_id, round(similarity, 6) + 0.0::DOUBLE AS similarity FROM cpairs WHERE cluster_id = 3 ORDER BY similarity DESC, other LIMIT 8")
def suggest_similar_clusters(c):
    return views.suggestions(refine.centroids(c.clusters()), 3).withColumn("similarity", r6(F.col("similarity")))


@query(["clus"], "SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(coalesce(lag(cluster_id) OVER (ORDER BY cluster_id), (SELECT max(cluster_id) FROM clus)) AS INTEGER) AS previous, CAST(coalesce(lead(cluster_id) OVER (ORDER BY cluster_id), (SELECT min(cluster_id) FROM clus WHERE cluster_id >= 0)) AS INTEGER) AS next FROM (SELECT DISTINCT cluster_id FROM clus WHERE cluster_id >= 0)")
def cluster_neighbours(c):
    return views.neighbours(c.clusters().filter("cluster_id >= 0").select("cluster_id").distinct())


@query()
def cluster_projection_2d(c):
    return views.projection(refine.centroids(c.clusters()))


@query(["base", "edits"], "SELECT max(g) + 1 AS fresh FROM (SELECT group_id AS g FROM base UNION ALL SELECT group_id FROM edits)")
def fresh_group_id(c):
    return overlay.fresh_id(c.base(), c.edits())


@query(["clus"], _MEM + " SELECT CAST(cluster_id AS INTEGER) AS cluster_id, entity_id FROM sim WHERE modality = 'clip' QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(s, 9) DESC, entity_id) = 1")
def cluster_representatives(c):
    s = views.own_similarity(_members(c).filter("modality = 'clip'"))
    return views.representatives(s.withColumn("similarity", F.round("similarity", 9)))


@query(["clus"], "SELECT CAST(cluster_id AS INTEGER) AS cluster_id, count(*) AS size FROM clus GROUP BY cluster_id")
def cluster_sizes(c):
    return c.clusters().groupBy("cluster_id").agg(F.count("*").alias("size"))


@query(["boxes"], "SELECT det_id FROM boxes WHERE x1 BETWEEN 50 AND 150 AND y1 BETWEEN 40 AND 120")
def rectangle_selection(c):
    p = c.boxes().select("det_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return views.in_rect(p, 150, 40, 50, 120).select("det_id")


_LASSO = [(-3.3, -5.7), (141.2, 12.4), (90.6, 101.9), (60.3, 40.1), (20.5, 177.3)]


def _crossings() -> str:
    """SQL for the number of a polygon's edges to the right of (x1, y1)."""
    edges = zip(_LASSO, [*_LASSO[1:], _LASSO[0]], strict=True)
    return " + ".join(f"CASE WHEN ({ay} > y1) <> ({by} > y1) AND x1 < {ax} + (y1 - ({ay})) * ({bx} - ({ax})) / ({by} - ({ay})) THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in edges)


@query(["boxes"], f"SELECT det_id FROM boxes WHERE ({_crossings()}) % 2 = 1")
def lasso_selection(c):
    p = c.boxes().select("det_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return views.in_polygon(p, _LASSO).select("det_id")


@query(["boxes"], "SELECT min(x1) AS x_min, max(x2) AS x_max, min(y1) AS y_min, max(y2) AS y_max FROM boxes")
def extent(c):
    return c.boxes().agg(F.min("x1").alias("x_min"), F.max("x2").alias("x_max"), F.min("y1").alias("y_min"), F.max("y2").alias("y_max"))


# guards, and views over documents of the index


@query(["assets"], "SELECT asset_id FROM assets WHERE coalesce(width, 0) > 0 AND coalesce(height, 0) > 0")
def measured_assets(c):
    return media.measured(c.sql(C.ASSETS)).select("asset_id")


@query(["assets"], "SELECT asset_id FROM assets WHERE type <> 'video' OR duration > 0")
def playable_assets(c):
    return media.playable(c.sql(C.ASSETS)).select("asset_id")


@query(["boxes"], "SELECT asset_id, source, count(*) AS n, min(i) AS first_index, CAST(sum(i) AS BIGINT) AS sum_index FROM (SELECT asset_id, source, row_number() OVER (PARTITION BY asset_id ORDER BY det_id) - 1 AS i FROM boxes) GROUP BY asset_id, source")
def detections_by_frame(c):
    d = F.struct("det_id", "source", F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence")
    persons = c.boxes().groupBy("asset_id").agg(F.array_sort(F.collect_list(d)).alias("detections"))
    f = entities.detections_by_frame(persons).select("asset_id", "source", F.explode("detections.det_index").alias("i"))
    return f.groupBy("asset_id", "source").agg(F.count("*").alias("n"), F.min("i").cast("long").alias("first_index"), F.sum("i").alias("sum_index"))


@query(["boxes", "faces"], _BEST + " SELECT b.asset_id, b.det_id % 5 AS track_id FROM boxes b LEFT JOIN bm ON bm.det_id = b.det_id GROUP BY b.asset_id, b.det_id % 5 HAVING count(face_id) > 0")
def entities_with_faces(c):
    e = entities.assemble(_faced(c).withColumn("track_id", F.col("det_id") % 5), ["asset_id", "track_id"])
    return entities.with_faces(e).select("asset_id", "track_id")


@query(["boxes"], "SELECT b.det_id, f.at FROM boxes b JOIN (SELECT user_id AS asset_id, event_type AS source, min(epoch_us(ts)) AS at FROM events GROUP BY ALL) f ON f.asset_id = b.asset_id AND f.source = b.source")
def detections_at_sources(c):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    frames = c.table("events").groupBy(F.col("user_id").alias("asset_id"), F.col("event_type").alias("source")).agg(F.min(at).alias("at"))
    return entities.at_sources(c.boxes(), frames).select("det_id", "at")


@query(["clus", "assets"], "SELECT c.entity_id, coalesce(a.type, 'unknown') AS asset_type, coalesce(regexp_extract(a.path, '([^/]*)$', 1), CAST(c.entity_id * 3 AS VARCHAR)) AS asset_basename FROM clus c LEFT JOIN assets a ON a.asset_id = c.entity_id * 3")
def named_items(c):
    items = c.clusters().select("entity_id", (F.col("entity_id") * 3).alias("asset_id"))
    return views.named(items, c.sql(C.ASSETS)).select("entity_id", "asset_type", "asset_basename")


@query(["clus", "assets"], "SELECT CAST(c.cluster_id AS INTEGER) AS cluster_id, coalesce(a.type, 'unknown') AS asset_type, count(*) AS n FROM clus c LEFT JOIN assets a ON a.asset_id = c.entity_id * 3 WHERE c.cluster_id >= 0 GROUP BY ALL")
def cluster_asset_types(c):
    items = c.clusters().select("entity_id", "cluster_id", (F.col("entity_id") * 3).alias("asset_id"))
    return views.asset_breakdown(views.named(items, c.sql(C.ASSETS)))


@query(["clus"], _MEM + " SELECT entity_id, count(*) AS n, coalesce(round(max(s) FILTER (modality = 'clip'), 6) + 0.0::DOUBLE, -1.0::DOUBLE) AS clip, coalesce(round(max(s) FILTER (modality = 'face'), 6) + 0.0::DOUBLE, -1.0::DOUBLE) AS face FROM sim GROUP BY entity_id")
def similarity_by_modality(c):
    m = views.similarity_maps(views.own_similarity(_members(c)))
    one = lambda k: F.coalesce(r6(F.col("similarities")[k]), F.lit(-1.0)).alias(k)
    return m.select("entity_id", F.size("similarities").cast("long").alias("n"), one("clip"), one("face"))


@query(["clus"], _MEM + " SELECT entity_id, CAST(cluster_id AS INTEGER) AS cluster_id, CAST(row_number() OVER (ORDER BY round(s, 9) DESC, entity_id) - 1 AS INTEGER) AS place FROM sim WHERE modality = 'clip' AND cluster_id = 3")
def cluster_detail(c):
    s = views.own_similarity(_members(c).filter("modality = 'clip'").withColumn("modality", F.lit("fused")))
    return views.cluster_detail(s.withColumn("similarity", F.round("similarity", 9)), 3).select("entity_id", "cluster_id", "place")


@query(["effective"], """, page AS (SELECT group_id FROM effective GROUP BY group_id HAVING count(*) > 1 ORDER BY count(*) DESC, group_id LIMIT 5),
k AS (SELECT a.*, e.group_id, CASE WHEN type = 'video' AND duration > 0 THEN round_even(duration / 1.5, 0) * 1.5 ELSE 0.0 END AS bucket, coalesce(width, 0) * coalesce(height, 0) AS res, CASE WHEN type = 'video' AND duration > 0 THEN size / duration ELSE size END AS q FROM effective e JOIN assets a ON a.asset_id = e.asset_id WHERE e.group_id IN (SELECT group_id FROM page))
SELECT asset_id, group_id, rank FROM (SELECT asset_id, group_id, CAST(row_number() OVER w - 1 AS INTEGER) AS rank FROM k WINDOW w AS (PARTITION BY group_id ORDER BY bucket DESC, res DESC, q DESC, mtime DESC, asset_id)) WHERE rank < 4""")
def group_preview(c):
    g = _effective(c)
    return views.group_preview(g, c.sql(C.ASSETS), views.groups_page(g, 0, 5), 4).select("asset_id", "group_id", "rank")


# the same shapes over the large tables


@query(None, "SELECT sha256 AS content, count(*) AS members, min(k) AS first_key FROM (SELECT sha256(l_partkey || '|' || l_suppkey) AS sha256, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY sha256 HAVING count(*) > 1")
def volume_exact_groups(c):
    li = c.table("lineitem").select(F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey"), 256).alias("content"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return li.groupBy("content").agg(F.count("*").alias("members"), F.min("k").alias("first_key")).filter("members > 1")


@query(None, "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) - 1 AS INTEGER) AS rank FROM lineitem")
def volume_rank_lines(c):
    li = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return overlay.rank_in_group(li, [F.desc("l_extendedprice"), "l_linenumber"], "l_orderkey").select("l_orderkey", "l_linenumber", "rank")


@query(None, "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def volume_keep_last(c):
    o = c.table("orders").select("o_custkey", F.col("o_orderkey").alias("last_order"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return overlay.last_wins(o, "o_custkey").select("o_custkey", "last_order")


@query(None, "SELECT l_partkey AS group_id, count(*) AS size FROM lineitem GROUP BY l_partkey HAVING count(*) > 1 ORDER BY size DESC, group_id LIMIT 24 OFFSET 48")
def volume_groups_page(c):
    return views.groups_page(c.table("lineitem").select(F.col("l_partkey").alias("group_id")), 48, 24)
