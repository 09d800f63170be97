"""The registered queries of this subpackage and, where SQL can say it, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merset.llm import jpeg, language, lm, secrets, toxicity, warc
from merset.llm.centroids import cluster_vectors
from merset.llm.common import fold
from merset.llm.decontam import find_leaks
from merset.llm.jaccard import ngram_components
from merset.llm.mixture import mix_sources
from merset.llm.neardup import near_duplicates
from merset.llm.urlrules import judge_urls
from merset.llm.whitening import whiten

#: Rules that op5 applies: host, path, action.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    code = language.fit(docs.where(fold("doc_id", 5) != 0))
    found = language.identify(docs, code)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op2_jpeg_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.store_and_read(table(spark, sf_dir, "documents"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "total_bits", "bits_per_byte")


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [F.struct(*[F.lit(x).alias(name) for x, name in zip(rule, ("host", "path", "action"), strict=True)]) for rule in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*each)))
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id", 5) != 0)
    found = toxicity.score_texts(docs, toxicity.learn(docs, labels))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85).drop("row_key")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_warc(spark, folder).drop("url")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), centroids=40, rounds=5, dims=64, scale=256, seed=2)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, offset=100_000)


QUERIES = {"op1_language": op1_language, "op2_jpeg_payload": op2_jpeg_payload, "op3_context_mixing": op3_context_mixing, "op4_secret_ledger": op4_secret_ledger, "op5_url_rules": op5_url_rules, "op6_mix_sources": op6_mix_sources, "op7_toxicity": op7_toxicity, "op8_near_duplicates": op8_near_duplicates, "op9_warc": op9_warc, "op10_benchmark_leaks": op10_benchmark_leaks, "op11_ngram_jaccard": op11_ngram_jaccard, "op12_centroids": op12_centroids, "op13_whitening": op13_whitening}

#: kind, pattern, group whose length counts, least length, as op4 has them; letters of assign's names in either case, ASCII only.
_SECRETS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16), ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]


def _secret_kind(rank: int) -> str:
    kind, pattern, group, least = _SECRETS[rank]
    p = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS g, string_split_regex(t, {p}) AS s FROM d"


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(map(_secret_kind, range(len(_SECRETS))))}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
e AS (
  SELECT doc_id, kind, rank, list_sum(list_transform(s[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS pos, length(m[i]) AS n
  FROM u WHERE length(g[i]) >= least),
f AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || pos || ':' || (pos + n), ',' ORDER BY pos, rank) AS spans,
         string_agg(kind || ':' || pos || ':' || (pos + n), ',' ORDER BY pos, rank) FILTER (rank < 3) AS base
  FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id
"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(instr(url, '://'), 0) AS pos FROM pages),
q AS (
  SELECT page_id,
         CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p),
rules(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, host, path, h || p AS rule, action, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h) + length(p) DESC, length(h) DESC) AS rn
  FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT * FROM m WHERE rn = 1)
SELECT q.page_id, q.host, q.path, best.rule, coalesce(best.action, 'allow') AS verdict
FROM q LEFT JOIN best ON q.page_id IS NOT DISTINCT FROM best.page_id AND q.host = best.host AND q.path = best.path
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM c WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, max(CASE WHEN cap > level * w THEN level END) OVER () AS lam FROM l),
t AS (
  SELECT source, source_size::BIGINT AS source_size, least(cap, lam * w) AS target FROM v),
e AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""



def _jaccard_sql(words: int, percent: int, more: str = "") -> str:
    """Components of the documents whose sets of shingles are at least so similar."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {words} THEN list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id{more}
FROM documents d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


OP8_SQL = _jaccard_sql(3, 85, ", d.doc_id = c.component_id AS kept")
OP11_SQL = _jaccard_sql(4, 85)

OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""

_PLACED = """
d{r} AS (SELECT v.vec_id, v.q, c.j, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS distance FROM v JOIN c{r} c ON true),
a{r} AS MATERIALIZED (SELECT vec_id, q, j, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, j) AS rn FROM d{r}) WHERE rn = 1)"""
_MOVED = """,
s{r} AS (SELECT j, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS q FROM (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(q) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY j, i) GROUP BY j),
c{next} AS MATERIALIZED (SELECT c.j, coalesce(s.q, c.q) AS q FROM c{r} c LEFT JOIN s{r} s ON c.j = s.j),"""

OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT j, q FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, q FROM v) WHERE j < 40),
{"".join(_PLACED.format(r=r) + _MOVED.format(r=r, next=r + 1) for r in range(5))}
{_PLACED.format(r=5)}
SELECT a.vec_id, a.j::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a5 a JOIN c5 c ON a.j = c.j
"""

ORACLES = {"op4_secret_ledger": OP4_SQL, "op5_url_rules": OP5_SQL, "op6_mix_sources": OP6_SQL, "op8_near_duplicates": OP8_SQL, "op9_warc": OP9_SQL, "op11_ngram_jaccard": OP11_SQL, "op12_centroids": OP12_SQL}
