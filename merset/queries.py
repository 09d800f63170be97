"""The registered queries of the k-mer operators, over the k-mers of ``documents.text``, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merset.functions.kmers import code_of, decode, deletions, distance, insertions, is_kmer, lower_bound, profile, substitutions, upper_bound, vertex
from merset.operators.ball import balls, named_balls
from merset.operators.conflict import conflicts, first_covers, near_pairs, profiled
from merset.operators.meeting import meeting
from merset.operators.neighbors import unit_edges
from merset.operators.orders import placed, ranked
from merset.operators.reach import compacted, nearer
from merset.plans.methods import assign, cover_from_neighbors, find_mis
from merset.plans.report import size
from merset.plans.verify import dependent_pairs, uncovered
from merset.session import cut
from merset.sources.universe import kmer_counts, kmers_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def universe(spark: SparkSession, sf_dir: str, k: int, min_count: int = 1) -> DataFrame:
    return cut(kmers_of(documents(spark, sf_dir), k, min_count=min_count), "universe")


def km_sql(k: int, min_count: int = 1) -> str:
    """CTEs: kc (kmer, n) and km (enc, kmer) of the documents' k-mers that occur ``min_count`` times."""
    enc = " + ".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k))
    return f"""
letters AS (SELECT upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS s FROM documents WHERE text IS NOT NULL),
windows AS (SELECT unnest(list_transform(range(1, length(s) - {k} + 2), lambda i: substr(s, i, {k}))) AS kmer FROM letters WHERE length(s) >= {k}),
kc AS (SELECT kmer, count(*) AS n FROM windows GROUP BY kmer),
km AS (SELECT ({enc})::BIGINT AS enc, kmer FROM kc WHERE n >= {min_count})"""


SQL_DISTANCE = {"edit": "levenshtein", "hamming": "hamming"}


def mis_sql(k: int, d: int, metric: str, order: str = "lex", pin: bool = False, min_count: int = 1) -> str:
    """CTEs up to mis (sel_idx, kmer): sequential greedy, one k-mer a step."""
    rank = "enc" if order == "lex" else f"(2654435761 * enc + 12345) % {4**k}"
    first = "CASE WHEN enc = 0 THEN 0 ELSE 1 END, " if pin else ""
    return f"""{km_sql(k, min_count)},
o AS MATERIALIZED (SELECT kmer, row_number() OVER (ORDER BY {first}{rank}, enc) AS rn FROM km),
g(i, mis) AS (
  SELECT 0::BIGINT, []::VARCHAR[]
  UNION ALL
  SELECT o.rn, CASE WHEN len(list_filter(g.mis, lambda m: {SQL_DISTANCE[metric]}(m, o.kmer) <= {d})) > 0 THEN g.mis ELSE list_append(g.mis, o.kmer) END
  FROM g JOIN o ON o.rn = g.i + 1),
mis AS (SELECT unnest(range(1, len(mis) + 1)) AS sel_idx, unnest(mis) AS kmer FROM g WHERE i = (SELECT count(*) FROM o))"""


@query("kmer_counts_k6", f"WITH {km_sql(6)} SELECT kmer, n FROM kc")
def _(spark, sf_dir):
    return kmer_counts(documents(spark, sf_dir), 6)


@query("kmer_universe_k4", f"WITH {km_sql(4)} SELECT enc, kmer, kmer AS decoded FROM km")
def _(spark, sf_dir):
    return universe(spark, sf_dir, 4).select("enc", "kmer", decode(F.col("enc"), 4).alias("decoded"))


@query(
    "base_profile_k5",
    f"WITH {km_sql(5)} SELECT kmer, " + ", ".join(f"length(replace(kmer, '{x}', ''))::INT AS d{x.lower()}" for x in "ACGT") + " FROM km",
)
def _(spark, sf_dir):
    return profiled(universe(spark, sf_dir, 5), 5).drop("enc")


@query(
    "homopolymer_distances_k5",
    f"""WITH {km_sql(5)} SELECT kmer, x AS base, levenshtein(kmer, repeat(x, 5))::INT AS edit, hamming(kmer, repeat(x, 5))::INT AS hamming, length(replace(kmer, x, ''))::INT AS component
FROM km, (VALUES ('A'), ('C'), ('G'), ('T')) b(x)""",
)
def _(spark, sf_dir):
    rows = universe(spark, sf_dir, 5).withColumns(profile(F.col("kmer"), 5))
    each = rows.select("kmer", F.struct("enc", "kmer").alias("a"), F.explode(F.array(*[F.struct(F.lit(x).alias("base"), F.lit(i * 341).cast("bigint").alias("enc"), F.lit(x * 5).alias("kmer"), F.col(f"d{x.lower()}").alias("component")) for i, x in enumerate("ACGT")])).alias("b"))
    return each.select("kmer", "b.base", distance("edit", "a", "b").alias("edit"), distance("hamming", "a", "b").alias("hamming"), "b.component")


def _pairs(name: str, metric: str, bounds: bool, k: int = 4, d: int = 2) -> None:
    @query(name, f"WITH {km_sql(k)} SELECT a.kmer AS a, b.kmer AS b FROM km a JOIN km b ON a.enc <> b.enc AND {SQL_DISTANCE[metric]}(a.kmer, b.kmer) <= {d}")
    def _(spark, sf_dir):
        return conflicts(universe(spark, sf_dir, k), k, d, metric, bounds).select(decode(F.col("a"), k).alias("a"), decode(F.col("b"), k).alias("b"))


for _metric in ("edit", "hamming"):
    _pairs(f"bounded_conflict_pairs_{_metric}_k4_d2", _metric, True)
    _pairs(f"blocked_conflict_pairs_{_metric}_k5_d2", _metric, False, 5, 2)


def _near_counts(way: str, metric: str, k: int, d: int, pivots: tuple[str, ...] = ()) -> None:
    """For each k-mer, how many others are within d, and their distances' sum, by one way of finding the pairs."""

    @query(
        f"near_counts_{way}{'_pivots' if pivots else ''}_{metric}_k{k}_d{d}",
        f"""WITH {km_sql(k)} SELECT a.kmer, count(*) AS n, sum({SQL_DISTANCE[metric]}(a.kmer, b.kmer))::BIGINT AS total
FROM km a JOIN km b ON a.enc <> b.enc AND {SQL_DISTANCE[metric]}(a.kmer, b.kmer) <= {d} GROUP BY a.kmer""",
    )
    def _(spark, sf_dir):
        u = universe(spark, sf_dir, k)
        if way == "meeting":
            pairs = meeting(u, u, k, d, metric).select(decode(F.col("a"), k).alias("kmer"), "dist")
        else:
            pairs = near_pairs(u, u, k, d, metric, way, pivots).select("a.kmer", distance(metric, "a", "b").alias("dist"))
        return pairs.groupBy("kmer").agg(F.count("*").alias("n"), F.sum("dist").cast("bigint").alias("total"))


_near_counts("meeting", "edit", 5, 3)
_near_counts("meeting", "hamming", 6, 3)
_near_counts("profiles", "edit", 5, 3)
_near_counts("profiles", "hamming", 6, 2)
_near_counts("pieces", "edit", 6, 2, ("ACGTAC", "GGTTCA", "TCATCG"))


@query(
    "distance_histogram_k4",
    f"""WITH {km_sql(4)} SELECT levenshtein(a.kmer, b.kmer)::INT AS edit, hamming(a.kmer, b.kmer)::INT AS hamming, count(*) AS n
FROM km a JOIN km b ON a.enc <> b.enc AND levenshtein(a.kmer, b.kmer) <= 3 GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    u = universe(spark, sf_dir, 4)
    side = lambda x: u.select(F.col("enc").alias(x), F.struct("enc", "kmer").alias(f"{x}_"))
    pairs = conflicts(u, 4, 3, "edit").join(side("a"), "a").join(side("b"), "b")
    return pairs.groupBy(distance("edit", "a_", "b_").alias("edit"), distance("hamming", "a_", "b_").alias("hamming")).agg(F.count("*").alias("n"))


_DEPTH = {x: f"length(replace({{}}.kmer, '{x}', ''))" for x in "ACGT"}
_LOWER = "greatest(" + ", ".join(f"abs({d.format('a')} - {d.format('b')})" for d in _DEPTH.values()) + ")"
_UPPER = "least(" + ", ".join(f"{d.format('a')} + {d.format('b')}" for d in _DEPTH.values()) + ")"


@query(
    "profile_bounds_k5",
    f"""WITH {km_sql(5)} SELECT levenshtein(a.kmer, b.kmer)::INT AS edit, {_LOWER}::INT AS lower, {_UPPER}::INT AS upper, count(*) AS n
FROM km a JOIN km b ON a.enc <> b.enc AND levenshtein(a.kmer, b.kmer) <= 3 GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    u = profiled(universe(spark, sf_dir, 5), 5)
    side = lambda x: u.select(F.col("enc").alias(x), F.struct("enc", "kmer", "da", "dc", "dg", "dt").alias(f"{x}_"))
    pairs = conflicts(u, 5, 3, "edit", bounds=False).join(side("a"), "a").join(side("b"), "b")
    return pairs.groupBy(distance("edit", "a_", "b_").alias("edit"), lower_bound("a_", "b_").alias("lower"), upper_bound("a_", "b_").alias("upper")).agg(F.count("*").alias("n"))


@query(
    "profile_bound_violations_k5",
    f"""WITH {km_sql(5)}, p AS (SELECT levenshtein(a.kmer, b.kmer) AS e, hamming(a.kmer, b.kmer) AS h, {_LOWER} AS lo, {_UPPER} AS hi FROM km a JOIN km b ON a.enc <> b.enc AND levenshtein(a.kmer, b.kmer) <= 3)
SELECT count(*) AS pairs, count(*) FILTER (lo > e OR lo > h) AS below, count(*) FILTER (hi < e OR hi < h) AS above FROM p""",
)
def _(spark, sf_dir):
    u = profiled(universe(spark, sf_dir, 5), 5)
    side = lambda x: u.select(F.col("enc").alias(x), F.struct("enc", "kmer", "da", "dc", "dg", "dt").alias(f"{x}_"))
    pairs = conflicts(u, 5, 3, "edit", bounds=False).join(side("a"), "a").join(side("b"), "b")
    e, h = distance("edit", "a_", "b_"), distance("hamming", "a_", "b_")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if((lower_bound("a_", "b_") > e) | (lower_bound("a_", "b_") > h)).alias("below"), F.count_if((upper_bound("a_", "b_") < e) | (upper_bound("a_", "b_") < h)).alias("above"))


@query(
    "substitution_neighbors_k5",
    f"WITH {km_sql(5)} SELECT kmer, substr(kmer, 1, j - 1) || x || substr(kmer, j + 1) AS other FROM km, range(1, 6) p(j), (VALUES ('A'), ('C'), ('G'), ('T')) b(x) WHERE substr(kmer, j, 1) <> x",
)
def _(spark, sf_dir):
    return universe(spark, sf_dir, 5).select("kmer", F.explode(substitutions(F.col("enc"), 5)).alias("o")).select("kmer", decode(F.col("o"), 5).alias("other"))


@query("deletion_neighbors_k5", f"WITH {km_sql(5)} SELECT DISTINCT kmer, substr(kmer, 1, j - 1) || substr(kmer, j + 1) AS other FROM km, range(1, 6) p(j)")
def _(spark, sf_dir):
    return universe(spark, sf_dir, 5).select("kmer", F.explode(deletions(F.col("enc"), 5)).alias("o")).select("kmer", decode(F.col("o"), 4).alias("other"))


@query("insertion_neighbors_k5", f"WITH {km_sql(4)} SELECT DISTINCT kmer, substr(kmer, 1, j) || x || substr(kmer, j + 1) AS other FROM km, range(0, 5) p(j), (VALUES ('A'), ('C'), ('G'), ('T')) b(x)")
def _(spark, sf_dir):
    return universe(spark, sf_dir, 4).select("kmer", F.explode(insertions(F.col("enc"), 5)).alias("o")).select("kmer", decode(F.col("o"), 5).alias("other"))


@query(
    "unit_edges_edit_k4",
    f"""WITH {km_sql(4)} SELECT kmer AS src, substr(kmer, 1, j - 1) || x || substr(kmer, j + 1) AS dst FROM km, range(1, 5) p(j), (VALUES ('A'), ('C'), ('G'), ('T')) b(x) WHERE substr(kmer, j, 1) <> x
UNION ALL SELECT DISTINCT kmer, substr(kmer, 1, j - 1) || substr(kmer, j + 1) FROM km, range(1, 5) p(j)""",
)
def _(spark, sf_dir):
    edges = unit_edges(universe(spark, sf_dir, 4).select(vertex(F.col("enc")).alias("vid")), 4, "edit")
    spell = lambda v: F.when(is_kmer(F.col(v)), decode(code_of(F.col(v)), 4)).otherwise(decode(code_of(F.col(v)), 3))
    return edges.select(spell("src").alias("src"), spell("dst").alias("dst"))


def _ball(metric: str) -> None:
    @query(
        f"{metric}_ball_bfs_k4_d2",
        f"""WITH {km_sql(4)}, every AS (SELECT a.b || b.b || c.b || d.b AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) a(b), (VALUES ('A'), ('C'), ('G'), ('T')) b(b), (VALUES ('A'), ('C'), ('G'), ('T')) c(b), (VALUES ('A'), ('C'), ('G'), ('T')) d(b))
SELECT km.kmer AS src_kmer, every.kmer AS dst_kmer, {SQL_DISTANCE[metric]}(km.kmer, every.kmer)::INT AS dist FROM km JOIN every ON {SQL_DISTANCE[metric]}(km.kmer, every.kmer) <= 2""",
    )
    def _(spark, sf_dir):
        return named_balls(universe(spark, sf_dir, 4), 4, 2, metric)


_ball("edit")
_ball("hamming")


@query("affine_order_k5", f"WITH {km_sql(5)} SELECT kmer, row_number() OVER (ORDER BY (2654435761 * enc + 12345) % 1024) AS place FROM km")
def _(spark, sf_dir):
    return placed(ranked(universe(spark, sf_dir, 5), 5, "affine")).select("kmer", F.col("place").cast("bigint").alias("place"))


def _mis(metric: str, method: str, order: str, k: int, d: int, min_count: int = 1) -> None:
    pin = order != "lex" and (metric, method) == ("edit", "improved")

    @query(f"mis_{metric}_{method}_{order}_k{k}_d{d}", f"WITH RECURSIVE {mis_sql(k, d, metric, order, pin, min_count)} SELECT sel_idx, kmer FROM mis")
    def _(spark, sf_dir):
        return find_mis(universe(spark, sf_dir, k, min_count), k, d, metric, method, order).select("sel_idx", "kmer")


for _metric in ("edit", "hamming"):
    for _method in ("simple", "improved", "bfs"):
        for _order in ("lex", "affine"):
            _mis(_metric, _method, _order, 4, 2)
_mis("edit", "improved", "lex", 5, 3)
_mis("edit", "bfs", "lex", 5, 3)
_mis("hamming", "improved", "lex", 5, 2)
#: Longer k-mers, of those that occur often enough to be chosen from.
OFTEN = 25
for _method in ("simple", "improved"):
    _mis("edit", _method, "lex", 9, 4, OFTEN)
    _mis("hamming", _method, "affine", 9, 4, OFTEN)


@query(
    "mis_size_by_kd",
    " UNION ALL ".join(f"SELECT {k} AS k, {d} AS d, '{m}' AS metric, (WITH RECURSIVE {mis_sql(k, d, m)} SELECT count(*) FROM mis) AS mis_size" for k, d in ((3, 1), (3, 2)) for m in ("edit", "hamming")),
)
def _(spark, sf_dir):
    out = None
    u = universe(spark, sf_dir, 3)
    for d in (1, 2):
        for m in ("edit", "hamming"):
            one = size(find_mis(u, 3, d, m)).select(F.lit(3).alias("k"), F.lit(d).alias("d"), F.lit(m).alias("metric"), "mis_size")
            out = one if out is None else out.unionByName(one)
    return out


def _random(metric: str, method: str, seed: int) -> None:
    """Independence, maximality and reproducibility of a selection in random order; which set it is, only the hash says."""

    @query(f"mis_{metric}_{method}_random_k4_d2", f"WITH {km_sql(4)} SELECT count(*) AS kmers, 0::BIGINT AS dependent, 0::BIGINT AS uncovered, 0::BIGINT AS other FROM km")
    def _(spark, sf_dir):
        u = universe(spark, sf_dir, 4)
        mis, again = (cut(find_mis(u, 4, 2, metric, method, "random", seed), "mis") for _ in range(2))
        told = lambda rows, name: rows.select(F.lit(name).alias("what"))
        other = mis.select("sel_idx", "kmer").exceptAll(again.select("sel_idx", "kmer"))
        by = "pairs" if method == "bfs" else "balls"  # not the way that found them
        rows = told(u, "kmers").unionByName(told(dependent_pairs(mis, 4, 2, metric, by), "dependent")).unionByName(told(uncovered(u, mis, 4, 2, metric, by), "uncovered")).unionByName(told(other, "other"))
        return rows.agg(*[F.count_if(F.col("what") == x).alias(x) for x in ("kmers", "dependent", "uncovered", "other")])


for _seed, _metric in enumerate(("edit", "hamming")):
    for _method in ("simple", "improved", "bfs"):
        _random(_metric, _method, 3 + _seed)


def _first_cover(name: str, metric: str) -> None:
    @query(
        name,
        f"""WITH RECURSIVE {mis_sql(5, 2, metric)}
SELECT km.kmer, arg_min(mis.kmer, sel_idx) AS cover, arg_min({SQL_DISTANCE[metric]}(km.kmer, mis.kmer), sel_idx)::INT AS dist
FROM km JOIN mis ON {SQL_DISTANCE[metric]}(km.kmer, mis.kmer) <= 2 GROUP BY km.kmer""",
    )
    def _(spark, sf_dir):
        u = universe(spark, sf_dir, 5)
        mis = cut(find_mis(u, 5, 2, metric), "mis")
        return first_covers(u, mis.withColumnRenamed("sel_idx", "place"), 5, 2, metric).select(decode(F.col("enc"), 5).alias("kmer"), F.col("cover_kmer").alias("cover"), "dist")


_first_cover("mis_first_cover_k5_d2", "hamming")
_first_cover("mis_first_cover_edit_k5_d2", "edit")


@query(
    "nearest_member_k5_d2",
    f"""WITH RECURSIVE {mis_sql(5, 2, 'hamming')} SELECT km.kmer, min(levenshtein(km.kmer, mis.kmer))::INT AS dist FROM km JOIN mis ON levenshtein(km.kmer, mis.kmer) <= 2 GROUP BY km.kmer""",
)
def _(spark, sf_dir):
    """How far the nearest member is, from the kept table: members of even places first, the others where they are nearer."""
    u = universe(spark, sf_dir, 5)
    mis = cut(find_mis(u, 5, 2, "hamming"), "mis").select(vertex(F.col("enc")).alias("vid"), (F.col("sel_idx") % 2 == 0).alias("even"))
    parts = nearer(mis.where("even"), [], 5, 2, "edit")
    parts += nearer(mis.where("not even"), parts, 5, 2, "edit")
    near = compacted(parts, 1)[0].where(is_kmer(F.col("vid"))).select(code_of(F.col("vid")).alias("enc"), "dist")
    return u.join(near, "enc").select("kmer", "dist")


@query(
    "mis_assignment_k4_d2",
    f"""WITH RECURSIVE {mis_sql(4, 2, 'edit')}
SELECT km.kmer, arg_min(mis.kmer, sel_idx) AS cover, arg_min(levenshtein(km.kmer, mis.kmer), sel_idx)::INT AS dist
FROM km JOIN mis ON levenshtein(km.kmer, mis.kmer) <= 2 GROUP BY km.kmer""",
)
def _(spark, sf_dir):
    u = universe(spark, sf_dir, 4)
    mis = cut(find_mis(u, 4, 2, "edit"), "mis")
    return assign(u, mis, 4, 2, "edit").select(decode(F.col("enc"), 4).alias("kmer"), decode(F.col("cover"), 4).alias("cover"), "dist")


@query(
    "neighbor_cover_k4_d2",
    f"""WITH RECURSIVE {mis_sql(4, 2, 'edit')},
asg AS (SELECT km.kmer, arg_min(mis.kmer, sel_idx) AS cover FROM km JOIN mis ON levenshtein(km.kmer, mis.kmer) <= 2 GROUP BY km.kmer)
SELECT km.kmer, min(asg.cover) AS cover FROM km JOIN asg ON hamming(km.kmer, asg.kmer) <= 1 WHERE levenshtein(km.kmer, asg.cover) <= 2 GROUP BY km.kmer""",
)
def _(spark, sf_dir):
    u = universe(spark, sf_dir, 4)
    mis = cut(find_mis(u, 4, 2, "edit"), "mis")
    known = assign(u, mis, 4, 2, "edit").select("enc", "cover", decode(F.col("cover"), 4).alias("cover_kmer"))
    return cover_from_neighbors(u, known, 4, 2, "edit").select(decode(F.col("enc"), 4).alias("kmer"), decode(F.col("cover"), 4).alias("cover"))


@query(
    "covered_kmers_k4_d2",
    f"""WITH RECURSIVE {mis_sql(4, 2, 'hamming')} SELECT km.kmer, count(*) AS members FROM km JOIN mis ON hamming(km.kmer, mis.kmer) <= 2 GROUP BY km.kmer""",
)
def _(spark, sf_dir):
    u = universe(spark, sf_dir, 4)
    mis = cut(find_mis(u, 4, 2, "hamming"), "mis")
    near = balls(mis, 4, 2, "hamming").select(F.col("dst").alias("enc"))
    return u.join(near, "enc").groupBy("kmer").agg(F.count("*").alias("members"))
