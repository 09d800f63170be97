"""Centroid clustering of integer vectors with built-in expressions only.

A vector's products with a centroid are a ``zip_with`` summed by an
``aggregate``, over a literal array; the nearest centroid is the ``array_min`` of
(distance, number) structs; and the sums that move the centroids are one
generated column a dimension. All of it is exact in BIGINT: a squared distance
is norm + norm - 2 products.

A call of a lambda costs the same for any number, and numbers here are short. So
several centroids share a call: each has a lane of the 63 bits, and one sum of
products holds the sums of all of them.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.session import cut, spread

#: Components are held within plus and minus this, so that any squared distance of up to 64 of them is a BIGINT.
MOST = 1 << 27


def integer_vectors(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, q (floor(scale * x) of each component x), norm (their squares' sum) of the rows whose vector has ``dims`` components, none null, NaN or infinite."""
    x = F.col(embedding)
    sound = (F.size(x) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-2.0 * MOST)), F.lit(2.0 * MOST))), F.lit(-MOST)), F.lit(MOST)))
    rows = vectors.where(x.isNotNull() & sound).select(F.col(vec_id).alias("vec_id"), whole.alias("q"))
    return rows.withColumn("norm", F.aggregate("q", F.lit(0).cast("bigint"), lambda s, c: s + c * c))


def _array(numbers: list[int]) -> str:
    return f"array({', '.join(f'{x}L' for x in numbers)})"


def lane_bits(largest_norm: int, centroids: list[list[int]]) -> int:
    """Bits that hold any sum of products, with its sign: none exceeds the root of the product of both norms."""
    most = isqrt(largest_norm * max(sum(x * x for x in c) for c in centroids)) + 1
    return most.bit_length() + 1


def with_nearest(rows: DataFrame, centroids: list[list[int]], bits: int) -> DataFrame:
    """Rows (with q and norm), and near: a struct (distance, cluster) of the nearest centroid, of equally near ones the smallest number.

    A sum is raised by half a lane in each lane, so that no lane borrows from the next one.
    """
    lanes, half = max(1, 63 // bits), 1 << (bits - 1)
    sums, each = [], []
    for first in range(0, len(centroids), lanes):
        group = centroids[first : first + lanes]
        packed = [sum(x << (bits * i) for i, x in enumerate(column)) for column in zip(*group, strict=True)]
        each += [f"named_struct('at', {len(sums)}, 'lane', {bits * i}, 'norm', {sum(x * x for x in c)}L, 'cluster', {first + i})" for i, c in enumerate(group)]
        sums.append(f"aggregate(zip_with(q, {_array(packed)}, (x, c) -> x * c), {sum(half << (bits * i) for i in range(len(group)))}L, (s, x) -> s + x)")
    product = f"(shiftright(sums[c.at], c.lane) & {2 * half - 1}L) - {half}L"
    near = f"array_min(transform(array({', '.join(each)}), c -> struct(norm + c.norm - 2L * ({product}) AS distance, c.cluster AS cluster)))"
    return rows.withColumn("near", F.expr(f"transform(array(array({', '.join(sums)})), sums -> {near})[0]"))  # the lambda binds sums, so they are made once a row


def cluster_vectors(vectors: DataFrame, centroids: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that is kept.

    Kept are vectors of exactly ``dims`` (at most 64) components, none null or not finite; a
    component is floor(scale * x), held within plus and minus 2 ** 27. The
    first centroids are the kept vectors of the smallest SHA-256 of
    ``seed:vec_id``; of rows with one id, that of the smallest components comes first.
    In each round vectors go to the nearest centroid (ties: the smallest
    number), and a centroid becomes floor(sum / count) of its own; one without
    any stays. Then vectors are assigned once more.

    Fewer vectors than centroids: each is one. Repeated rows count each time.
    A null id is hashed as an empty one. No vectors: no rows. Inertias beyond
    BIGINT are null. Other columns are not read. The driver holds the centroids
    and their sums: ``centroids`` times ``dims`` numbers a round.
    """
    if dims > 64:
        raise ValueError("dims is at most 64")
    rows = cut(integer_vectors(spread(vectors.select(vec_id, embedding)), dims, scale, vec_id, embedding), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    now = [list(r["q"]) for r in rows.orderBy(order, "q").limit(centroids).select("q").collect()]
    out = "vec_id {}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string".format(rows.schema["vec_id"].dataType.simpleString())
    if not now:
        return rows.sparkSession.createDataFrame([], out)
    largest = rows.agg(F.max("norm")).first()[0]
    for _ in range(rounds):
        placed = with_nearest(rows, now, lane_bits(largest, now)).select(F.col("near.cluster").alias("cluster"), *[F.col("q")[i].alias(f"q{i}") for i in range(dims)])
        for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f"q{i}").alias(f"q{i}") for i in range(dims)]).collect():
            now[r["cluster"]] = [r[f"q{i}"] // r["n"] for i in range(dims)]
    found = cut(with_nearest(rows, now, lane_bits(largest, now)).select("vec_id", "near.cluster", "near.distance"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: f"{x}L" if x < 1 << 63 else "CAST(NULL AS BIGINT)"
    inertias = F.expr(f"array({', '.join(fits(sums.get(j, 0)) for j in range(len(now)))})")
    names = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in now])
    return found.select("vec_id", "cluster", "distance", inertias[F.col("cluster")].alias("cluster_inertia"), F.expr(fits(sum(sums.values()))).alias("inertia"), names[F.col("cluster")].alias("centroid_sha256"))
