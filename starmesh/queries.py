"""Queries of the point-set operators over the test tables, and the SQL that tells their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmesh.functions.zkey import BitRange
from starmesh.operators import fof, neighbors, runner, tree, windows, zorder
from starmesh.operators.components import connected_components
from starmesh.operators.index import build_index, merged, open_index, search
from starmesh.operators.points import point_set, union_types


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark, d, dim, keep=None):
    return point_set(table(spark, d, "embeddings"), "vec_id", "embedding", dim=dim, keep=keep)


def parts(spark, d):
    return point_set(table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"])


def customers(spark, d):
    return point_set(table(spark, d, "customer"), "c_custkey", ["c_acctbal"])


def rounded(pairs: DataFrame) -> DataFrame:
    return pairs.select("qid", "rank", "id", F.round("rad", 9).alias("rad"))


def knn_self_embeddings3(spark, d):
    return rounded(neighbors.knn_pairs(embeddings(spark, d, 3), 4))


def knn_embeddings64(spark, d):
    return rounded(neighbors.knn_pairs(embeddings(spark, d, 64), 5))


def knn_query_subset(spark, d):
    e = embeddings(spark, d, 3, ["label"])
    return rounded(neighbors.knn_pairs(e.where("label != 0").drop("label"), 3, query=e.where("label = 0").drop("label")))


def _boxed(spark, d):
    return point_set(table(spark, d, "customer").withColumn("__x", F.expr("((cast(c_acctbal as double) % 1000.0D) + 1000.0D) % 1000.0D")), "c_custkey", ["__x"])


def knn_periodic(spark, d):
    return rounded(neighbors.knn_pairs(_boxed(spark, d), 3, boxsize=1000.0))


def knn_mean_radius(spark, d):
    out = neighbors.knn(embeddings(spark, d, 3), 9, result=("rad",), reducer=neighbors.mean_radius)
    return out.select("qid", F.round("mean_rad", 9).alias("mean_rad"))


def knn_attributes(spark, d):
    return neighbors.knn(embeddings(spark, d, 3, ["label"]), 3, result=("id", "label"))


def knn_difference(spark, d):
    out = neighbors.knn(embeddings(spark, d, 3), 3, result=("id", "drad", "part"))
    return out.select("qid", "rank", "id", *[F.round(F.col("drad")[i], 9).alias(f"d{i}") for i in range(3)], F.col("part.id").alias("part_id"))


def knn_supplier_customer(spark, d):
    s = point_set(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal"])
    return rounded(neighbors.knn_pairs(s, 2, query=customers(spark, d)))


def knn_parts_ties(spark, d):
    return rounded(neighbors.knn_pairs(parts(spark, d), 4))


def fof_labels_customers(spark, d):
    return fof.labels(customers(spark, d), 1.0).select("id", F.col("label").alias("label"), "zindex")


def fof_periodic(spark, d):
    out = fof.labels(_boxed(spark, d), 0.02, boxsize=1000.0)
    least = out.groupBy("label").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("count"))
    return out.join(least, "label").select("id", "least_id", "count")


def fof_labels_parts(spark, d):
    out = fof.labels(parts(spark, d), 0.9)
    least = out.groupBy("label").agg(F.min("id").alias("least_id"))
    return out.join(least, "label").select("id", "least_id")


def fof_labels_embeddings3(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[(F.col("embedding")[i].cast("double") + 1.0).alias(f"e{i}") for i in range(3)])
    out = fof.labels(point_set(e, "vec_id", ["e0", "e1", "e2"]), 0.06, boxsize=2.0)
    least = out.groupBy("label").agg(F.min("id").alias("least_id"))
    return out.join(least, "label").select("id", "least_id")


def fof_sizes(spark, d):
    return fof.group_sizes(fof.labels(customers(spark, d), 1.0))


def fof_catalogue(spark, d):
    c = table(spark, d, "customer").withColumn("mass", F.lit(1.0) + F.pmod("c_custkey", F.lit(3))).withColumn("v0", F.col("c_nationkey").cast("double")).withColumn("zplus1", F.lit(2.0))
    p = point_set(c, "c_custkey", ["c_acctbal"], ["mass", "v0", "zplus1"])
    _, cat = fof.labels_and_catalogue(p, 2.0, npart_min=3)
    return cat.select("label", "count", "offset", F.round("mass", 6).alias("mass"), F.round("com_pos0", 6).alias("com_pos0"), F.round("com_vel0", 6).alias("com_vel0"), F.round("scale_factor", 6).alias("scale_factor"), F.round("com_inertia_radius", 5).alias("com_inertia_radius"))


def fof_group_order(spark, d):
    return fof.group_order(fof.labels(customers(spark, d), 2.0)).select("id", "row", "label")


def fof_superset(spark, d):
    a, b = fof.labels(customers(spark, d), 2.0), fof.labels(customers(spark, d), 1.0)
    return spark.createDataFrame([(fof.is_superset(a, b), fof.is_superset(b, a))], "wide_holds_narrow boolean, narrow_holds_wide boolean")


def zindex_customers(spark, d):
    return zorder.with_zindex(customers(spark, d)).select("id", "zindex")


def zindex_parts(spark, d):
    p = table(spark, d, "part").withColumn("a", F.floor("p_retailprice").cast("double"))
    return zorder.with_zindex(point_set(p, "p_partkey", ["a", "p_size"])).select("id", "zindex")


def zindex_fractions(spark, d):
    """Quarters and halves of both signs."""
    c = table(spark, d, "customer").withColumn("a", F.floor(F.col("c_acctbal") * 4) / 4).withColumn("b", (F.col("c_nationkey") - 12) / 2)
    return zorder.with_zindex(point_set(c, "c_custkey", ["a", "b"])).select("id", "zindex")


def zindex_embeddings3(spark, d):
    """Three dimensions, fractions of both signs."""
    e = table(spark, d, "embeddings").select("vec_id", *[(F.floor(F.col("embedding")[i].cast("double") * 4096) / 4096).alias(f"e{i}") for i in range(3)])
    return zorder.with_zindex(point_set(e, "vec_id", ["e0", "e1", "e2"])).select("id", "zindex")


def zindex_integers(spark, d):
    """Integers of 63 bits and both signs, which no floating-point number holds."""
    o = table(spark, d, "orders").withColumn("a", F.expr("9007199254740993L + o_orderkey * (1 - 2 * (o_orderkey % 2))")).withColumn("b", F.expr("o_custkey - 500L"))
    return zorder.with_zindex(point_set(o, "o_orderkey", ["a", "b"], integer=True)).select("id", "zindex")


def search_leaves_parts(spark, d):
    p = table(spark, d, "part").withColumn("a", F.floor("p_retailprice").cast("double"))
    leaved = tree.assign_leaves(point_set(p.where("p_partkey % 2 = 0"), "p_partkey", ["a", "p_size"]), 16, PART_BITS)
    asked = point_set(p.where("p_partkey % 2 = 1"), "p_partkey", ["a", "p_size"])
    return zorder.search_leaves(leaved.select("id", "x0", "x1", "leaf"), asked)


def search_sorted_accounts(spark, d):
    s = point_set(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal"])
    return zorder.search_sorted(s, customers(spark, d))


def leaf_counts(spark, d):
    p = table(spark, d, "part").withColumn("a", F.floor("p_retailprice").cast("double"))
    leaved = tree.assign_leaves(point_set(p, "p_partkey", ["a", "p_size"]), 16, PART_BITS)
    return _leaves(leaved, F.count(F.lit(1)).alias("npart"), dim=2, span=PART_BITS)


def _leaves(leaved, *aggs, dim, span):
    """A row per leaf, by its prefix without the bits of class."""
    rows = leaved.groupBy("leaf", "depth").agg(F.min("zkey").alias("zkey"), *aggs)
    name = F.substr(tree.node_name(F.col("zkey"), F.col("depth"), dim, span), F.lit(2 * dim + 1)).alias("leaf")
    return rows.select(name, *[c for c in rows.columns if c not in ("leaf", "depth", "zkey")])


def multi_type_leaves(spark, d):
    a = point_set(table(spark, d, "supplier").withColumn("x", F.floor("s_acctbal") + 1000.0), "s_suppkey", ["x"])
    b = point_set(table(spark, d, "customer").withColumn("x", F.floor("c_acctbal") + 1000.0), "c_custkey", ["x"])
    c = point_set(table(spark, d, "part").withColumn("x", F.floor("p_retailprice") + 1000.0), "p_partkey", ["x"])
    leaved = tree.assign_leaves(union_types(a, b, c), 8, ACCOUNT_BITS)
    return _leaves(leaved, *[F.count_if(F.col("ptype") == t).alias(f"n{t}") for t in range(3)], dim=1, span=ACCOUNT_BITS)


def _part_nodes(spark, d):
    p = table(spark, d, "part").withColumn("a", F.floor("p_retailprice").cast("double")).withColumn("mass", F.lit(1.0) + F.pmod("p_partkey", F.lit(3)))
    return tree.build_nodes(point_set(p, "p_partkey", ["a", "p_size"], ["mass"]), 16, 6.0, 8, span=PART_BITS)


def node_mass_centres(spark, d):
    n = _part_nodes(spark, d).where("plane = 0")
    return n.select(F.expr("substring(node, 5)").alias("leaf"), "npart", F.round("mass", 6).alias("mass"), F.round("mass_cent0", 6).alias("mass_cent0"), F.round("mass_cent1", 6).alias("mass_cent1"))


def node_planes(spark, d):
    outside = (F.col("lo0") < F.col("cent0") - F.col("ext0") / 2) | (F.col("hi1") > F.col("cent1") + F.col("ext1") / 2)
    return _part_nodes(spark, d).groupBy("plane").agg(F.count(F.lit(1)).alias("nodes"), F.sum("npart").alias("npart"), F.max("npart").alias("most"), F.min("lvl").alias("lvl"), F.round(F.sum(F.col("mass") * F.col("mass_cent0")), 3).alias("moment"), F.count_if(outside).alias("outside"))


def level_histogram(spark, d):
    return tree.level_histogram(_part_nodes(spark, d).where("plane = 0"), F.col("npart"))


def bucket_prefix_sum(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return windows.bucket_prefix_sum(o, "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey", "prefix")


def segment_sort(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return windows.segment_rank(p, "p_size", "p_retailprice", "p_partkey").select("p_partkey", "p_size", "rank")


def components_graph(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("a"), (F.col("o_custkey") + F.pmod("o_orderkey", F.lit(5))).cast("long").alias("b"))
    return connected_components(o, contract=True)


def knn_indexed(spark, d):
    """From a stored index that is opened again."""
    return rounded(neighbors.knn_pairs(open_index(spark, build_index(parts(spark, d)).path), 4))


def knn_indexed_queries(spark, d):
    """Suppliers that are asked for from an index of customers."""
    s = point_set(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal"])
    return rounded(neighbors.knn_pairs(build_index(customers(spark, d)), 3, query=s))


def fof_indexed(spark, d):
    return fof.labels(build_index(customers(spark, d)), 1.0).select("id", "label", "zindex")


def index_merged(spark, d):
    """z-indices of an index of two thirds of the customers into which the others are merged."""
    c = customers(spark, d)
    index = build_index(c.where("id % 3 > 0"), span=ALL_BITS)
    return merged(index, c.where("id % 3 = 0")).points.select("id", "zindex")


def search_indexed(spark, d):
    """Customers' balances in an index of suppliers: how many are before each, and the leaf of 16 that it falls into."""
    s = point_set(table(spark, d, "supplier").withColumn("x", F.floor("s_acctbal") + 1000.0), "s_suppkey", ["x"])
    c = point_set(table(spark, d, "customer").withColumn("x", F.floor("c_acctbal") + 1000.0), "c_custkey", ["x"])
    return search(build_index(s, leaf_size=16, span=ALL_BITS), c)


RADII = (0.0, 1.0, 2.5, 10.0, 60.0, 300.0)


def pair_counts(spark, d):
    return runner.pair_counts(parts(spark, d), list(RADII))


def density_customers(spark, d):
    """How many suppliers' balances are at most 75 from each customer's, through an index."""
    s = point_set(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal"])
    return runner.density(build_index(s), 75.0, query=customers(spark, d))


def density_embeddings3(spark, d):
    return runner.density(embeddings(spark, d, 3), 0.2)


def _grid3(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[((F.floor(F.col("embedding")[i].cast("double") * 4096) + 4096) / 4096).alias(f"e{i}") for i in range(3)], (1.0 + F.pmod("vec_id", F.lit(3))).alias("mass"))
    return point_set(e, "vec_id", ["e0", "e1", "e2"], ["mass"])


def fof_catalogue_periodic(spark, d):
    """Three dimensions in a periodic box; groups lie across its faces."""
    _, cat = fof.labels_and_catalogue(_grid3(spark, d), 0.06, boxsize=2.0, npart_min=2)
    return cat.select("label", "count", "offset", F.round("mass", 6).alias("mass"), *[F.round(f"com_pos{i}", 6).alias(f"com_pos{i}") for i in range(3)], F.round("com_inertia_radius", 6).alias("com_inertia_radius"))


#: All bits that balances have, whichever customers there are.
ALL_BITS = BitRange(16, -60)
#: Bits of floor(price), below 2 ** 17, and size: exponents 16 to 0.
PART_BITS = BitRange(16, 0)
#: Bits of amounts, shifted and rounded down, below 2 ** 17.
ACCOUNT_BITS = BitRange(16, 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (knn_self_embeddings3, knn_embeddings64, knn_query_subset, knn_periodic, knn_mean_radius, knn_attributes, knn_difference, knn_supplier_customer, knn_parts_ties, fof_labels_customers, fof_periodic, fof_labels_parts, fof_labels_embeddings3, fof_sizes, fof_catalogue, fof_group_order, fof_superset, zindex_customers, zindex_parts, zindex_fractions, zindex_embeddings3, zindex_integers, search_sorted_accounts, search_leaves_parts, leaf_counts, multi_type_leaves, node_mass_centres, node_planes, level_histogram, bucket_prefix_sum, segment_sort, components_graph, knn_indexed, knn_indexed_queries, fof_indexed, index_merged, pair_counts, density_customers, density_embeddings3, fof_catalogue_periodic, search_indexed)
    return {f.__name__: f for f in found}


def _knn_sql(source: str, query: str, dim: int, k: int, box: float | None = None, cols: str = "qid, rank, id, round(rad, 9) AS rad") -> str:
    """source and query are SELECTs of id, x0, x1, ..."""
    diff = [f"q.x{i} - s.x{i}" for i in range(dim)]
    if box:
        diff = [f"CASE WHEN {e} < -{box / 2} THEN {e} + {box} WHEN {e} >= {box / 2} THEN {e} - {box} ELSE {e} END" for e in diff]
    r2 = " + ".join(f"({e}) * ({e})" for e in diff)
    return f"""
WITH s AS ({source}), q AS ({query}), r AS (SELECT q.id AS qid, s.id AS id, {r2} AS r2 FROM q CROSS JOIN s),
n AS (SELECT qid, id, sqrt(r2) AS rad, CAST(row_number() OVER (PARTITION BY qid ORDER BY r2, id) AS INTEGER) AS rank FROM r QUALIFY rank <= {k})
SELECT {cols} FROM n"""


def _embedding_points(dim: int, where: str = "true") -> str:
    return f"SELECT vec_id AS id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}' for i in range(dim))} FROM embeddings WHERE {where}"


_PARTS = "SELECT p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS x1 FROM part"
_CUSTOMERS = "SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x0 FROM customer"
_BOXED = "SELECT c_custkey AS id, ((CAST(c_acctbal AS DOUBLE) % 1000.0) + 1000.0) % 1000.0 AS x0 FROM customer"

#: The z-order of single numbers is their order, except that -0 is 0; ties go by id.
_FOF_1D = """
WITH p AS ({points}), z AS (SELECT *, row_number() OVER (ORDER BY x0, id) - 1 AS zindex FROM p),
g AS (SELECT *, CASE WHEN (x0 - lag(x0) OVER (ORDER BY zindex)) * (x0 - lag(x0) OVER (ORDER BY zindex)) <= {r2} THEN 0 ELSE 1 END AS starts FROM z),
h AS (SELECT *, sum(starts) OVER (ORDER BY zindex) AS grp FROM g),
f AS (SELECT *, min(zindex) OVER (PARTITION BY grp) AS label FROM h)
"""


def _z2(top: int) -> str:
    """Bits of x0 and x1, interleaved, x0 first, from 2 ** top down."""
    return f"array_to_string(list_transform(range({top}, -1, -1), lambda i: (((CAST(x0 AS BIGINT) >> CAST(i AS INTEGER)) & 1)::VARCHAR || ((CAST(x1 AS BIGINT) >> CAST(i AS INTEGER)) & 1)::VARCHAR)), '')"


_PART_Z = f"WITH p AS (SELECT p_partkey AS id, floor(p_retailprice) AS x0, p_size AS x1, 1.0 + p_partkey % 3 AS mass FROM part), z AS (SELECT *, {_z2(16)} AS zbits FROM p)"
_PART_LEAVES = _PART_Z + ", d AS (SELECT z.*, n FROM z, range(0, 35) t(n)), c AS (SELECT n, substring(zbits, 1, n) AS node, count(*) AS c FROM d GROUP BY ALL), l AS (SELECT z.id, min(c.n) AS n FROM z JOIN c ON substring(z.zbits, 1, c.n) = c.node AND (c.c <= 16 OR c.n = 34) GROUP BY z.id), leaved AS (SELECT z.*, substring(zbits, 1, l.n) AS leaf FROM z JOIN l USING (id))"
_ACCOUNT_LEAVES = """
WITH z AS (
  SELECT s_suppkey AS id, 0 AS ptype, CAST(floor(s_acctbal) + 1000 AS BIGINT) AS x FROM supplier UNION ALL SELECT c_custkey, 1, CAST(floor(c_acctbal) + 1000 AS BIGINT) FROM customer
  UNION ALL SELECT p_partkey, 2, CAST(floor(p_retailprice) + 1000 AS BIGINT) FROM part
), b AS (SELECT *, array_to_string(list_transform(range(16, -1, -1), lambda i: ((x >> CAST(i AS INTEGER)) & 1)::VARCHAR), '') AS zbits FROM z),
c AS (SELECT n, substring(zbits, 1, n) AS node, greatest(count_if(ptype = 0), count_if(ptype = 1), count_if(ptype = 2)) AS c FROM b, range(0, 18) t(n) GROUP BY n, node),
l AS (SELECT b.id, b.ptype, min(c.n) AS n FROM b JOIN c ON substring(b.zbits, 1, c.n) = c.node AND (c.c <= 8 OR c.n = 17) GROUP BY b.id, b.ptype)
SELECT substring(zbits, 1, n) AS leaf, count_if(ptype = 0)::BIGINT AS n0, count_if(ptype = 1)::BIGINT AS n1, count_if(ptype = 2)::BIGINT AS n2 FROM b JOIN l USING (id, ptype) GROUP BY 1"""


def _signed_z(points: str, dim: int, scale: int, top: int) -> str:
    """z-indices of points whose coordinates are multiples of 1 / scale: a digit of class for each
    dimension, then the bits of the magnitude, turned round below zero, interleaved."""
    bit = lambda j: f"(((CAST(abs(x{j}) * {scale} AS BIGINT) >> CAST(i AS INTEGER)) & 1) + CASE WHEN x{j} < 0 THEN 1 ELSE 0 END) % 2"
    head = " || ".join(f"CASE WHEN x{j} < 0 THEN '1' ELSE '2' END" for j in range(dim))
    body = " || ".join(f"CAST({bit(j)} AS VARCHAR)" for j in range(dim))
    return f"SELECT id, row_number() OVER (ORDER BY {head} || array_to_string(list_transform(range({top}, -1, -1), lambda i: {body}), ''), id) - 1 AS zindex FROM ({points})"


_INTEGERS = "SELECT o_orderkey AS id, 9007199254740993 + o_orderkey * (1 - 2 * (o_orderkey % 2)) AS x0, o_custkey - 500 AS x1 FROM orders"
_FLIPPED = "((CAST({x} AS HUGEINT) + 9223372036854775808) >> CAST(i AS INTEGER)) & 1"
#: Nodes of all planes: the shortest prefix with at most 16, 96, 576 ... points.
_PART_PLANES = _PART_LEAVES + """, s AS (SELECT ceil(count(*) / 8.0) + 1 AS n FROM part),
k AS (SELECT p AS plane, CAST(floor(16 * pow(6, p)) AS BIGINT) AS cap FROM range(0, 12) t(p), s WHERE p < greatest(1, ceil(ln(s.n / 8.0) / ln(6.0)))),
w AS (SELECT k.plane, z.id, min(c.n) AS n FROM z CROSS JOIN k JOIN c ON substring(z.zbits, 1, c.n) = c.node AND (c.c <= k.cap OR c.n = 34) GROUP BY ALL),
m AS (SELECT plane, substring(zbits, 1, n) AS node, n, count(*) AS npart, sum(mass * x0) AS moment FROM w JOIN z USING (id) GROUP BY ALL)
SELECT CAST(plane AS INTEGER) AS plane, count(*) AS nodes, CAST(sum(npart) AS BIGINT) AS npart, max(npart) AS most, CAST(34 - max(n) AS INTEGER) AS lvl, round(sum(moment)::DOUBLE, 3) AS moment, CAST(0 AS BIGINT) AS outside FROM m GROUP BY plane"""
_SEARCH_LEAVES = _PART_Z + """, src AS (SELECT *, row_number() OVER (ORDER BY zbits, id) - 1 AS place FROM z WHERE id % 2 = 0),
d AS (SELECT src.zbits, n FROM src, range(0, 35) t(n)), c AS (SELECT n, substring(zbits, 1, n) AS node, count(*) AS c FROM d GROUP BY ALL),
l AS (SELECT src.id, min(c.n) AS n FROM src JOIN c ON substring(src.zbits, 1, c.n) = c.node AND (c.c <= 16 OR c.n = 34) GROUP BY src.id),
v AS (SELECT src.*, min(place) OVER (PARTITION BY substring(zbits, 1, l.n)) AS leaf FROM src JOIN l USING (id)),
q AS (SELECT id, zbits FROM z WHERE id % 2 = 1),
r AS (SELECT q.id, q.zbits, (SELECT count(*) FROM v WHERE v.zbits < q.zbits) AS at FROM q),
e AS (SELECT r.id, a.leaf AS lo, b.leaf AS hi, coalesce((SELECT max(n) FROM range(0, 35) t(n) WHERE substring(a.zbits, 1, n) = substring(r.zbits, 1, n)), -1) AS la, coalesce((SELECT max(n) FROM range(0, 35) t(n) WHERE substring(b.zbits, 1, n) = substring(r.zbits, 1, n)), -1) AS lb
  FROM r LEFT JOIN v a ON a.place = r.at - 1 LEFT JOIN v b ON b.place = r.at)
SELECT id, CASE WHEN la >= lb AND lo IS NOT NULL THEN lo ELSE hi END AS leaf FROM e"""


_SUPPLIERS = "SELECT s_suppkey AS id, CAST(s_acctbal AS DOUBLE) AS x0 FROM supplier"
#: Bits that two whole numbers below 2 ** 17 share, from above.
_SHARED = "17 - length(CASE WHEN xor({a}, {b}) = 0 THEN '' ELSE bin(xor({a}, {b})) END)"
_SEARCH_INDEXED = f"""
WITH s AS (SELECT x, row_number() OVER (ORDER BY x, id) - 1 AS z FROM (SELECT s_suppkey AS id, CAST(floor(s_acctbal) + 1000 AS BIGINT) AS x FROM supplier)),
q AS (SELECT c_custkey AS id, CAST(floor(c_acctbal) + 1000 AS BIGINT) AS x FROM customer),
p AS (SELECT q.id, q.x, (SELECT count(*) FROM s WHERE s.x < q.x) AS position FROM q)
SELECT p.id, position, CASE WHEN r.z IS NULL OR {_SHARED.format(a="l.x", b="p.x")} >= {_SHARED.format(a="r.x", b="p.x")} THEN l.z // 16 ELSE r.z // 16 END AS leaf
FROM p LEFT JOIN s l ON l.z = position - 1 LEFT JOIN s r ON r.z = position"""
_PAIR_COUNTS = f"""
WITH p AS ({_PARTS}), e AS (SELECT i - 1 AS bin, [{", ".join(map(str, RADII))}][i] AS radius FROM range(1, {len(RADII) + 1}) t(i)),
r AS (SELECT (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) AS r2 FROM p a JOIN p b ON a.id < b.id),
c AS (SELECT (SELECT min(bin) FROM e WHERE r2 <= radius * radius) AS bin, count(*) AS pairs FROM r GROUP BY 1)
SELECT CAST(e.bin AS INTEGER) AS bin, CAST(e.radius AS DOUBLE) AS radius, coalesce(c.pairs, 0) AS pairs FROM e LEFT JOIN c USING (bin)"""


def _catalogue_sql(link: float = 0.06, box: float = 2.0) -> str:
    points = "SELECT vec_id AS id, 1.0 + vec_id % 3 AS m, " + ", ".join(f"(floor(CAST(embedding[{i + 1}] AS DOUBLE) * 4096) + 4096) / 4096 AS x{i}" for i in range(3)) + " FROM embeddings"
    near = lambda d: f"CASE WHEN {d} < -{box / 2} THEN {d} + {box} WHEN {d} >= {box / 2} THEN {d} - {box} ELSE {d} END"
    mod = lambda x: f"(({x}) - {box} * floor(({x}) / {box}))"
    wrapped = lambda a, b: f"({mod(f'{a} - {b} + {box / 2}')} - {box / 2})"
    apart = " + ".join(f"pow({near(f'(a.x{i} - b.x{i})')}, 2)" for i in range(3))
    return f"""
WITH RECURSIVE p AS ({points}), z AS ({_signed_z("SELECT id, x0, x1, x2 FROM p", 3, 4096, 13)}),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {apart} <= {link} * {link}),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
l AS (SELECT r.a AS id, min(z.zindex) AS label FROM r JOIN z ON z.id = r.b GROUP BY r.a),
w AS (SELECT p.*, l.label, {", ".join(f"o.x{i} AS o{i}" for i in range(3))} FROM p JOIN l USING (id) JOIN z zo ON zo.zindex = l.label JOIN p o ON o.id = zo.id),
c AS (SELECT label, count(*) AS count, sum(m) AS mass, {", ".join(mod(f"any_value(o{i}) + sum(m * {wrapped(f'x{i}', f'o{i}')}) / sum(m)") + f" AS c{i}" for i in range(3))} FROM w GROUP BY label),
f AS (SELECT *, coalesce(sum(count) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM c)
SELECT f.label, any_value(f.count) AS count, any_value(off) AS offset, round(any_value(f.mass)::DOUBLE, 6) AS mass, {", ".join(f"round(any_value(c{i})::DOUBLE, 6) AS com_pos{i}" for i in range(3))},
       round(sqrt(sum(m * ({" + ".join(f"pow({wrapped(f'x{i}', f'c{i}')}, 2)" for i in range(3))})) / sum(m)), 6) AS com_inertia_radius
FROM f JOIN w USING (label) WHERE f.count >= 2 GROUP BY f.label"""


def oracle_sql() -> dict[str, str]:
    e3, f1, f2 = _embedding_points(3), _FOF_1D.format(points=_CUSTOMERS, r2=1.0), _FOF_1D.format(points=_CUSTOMERS, r2=4.0)
    return {
        "knn_self_embeddings3": _knn_sql(e3, e3, 3, 4),
        "knn_embeddings64": _knn_sql(_embedding_points(64), _embedding_points(64), 64, 5),
        "knn_query_subset": _knn_sql(_embedding_points(3, "label <> 0"), _embedding_points(3, "label = 0"), 3, 3),
        "knn_periodic": _knn_sql(_BOXED, _BOXED, 1, 3, 1000.0),
        "knn_mean_radius": "SELECT qid, round(avg(CASE WHEN rank > 1 THEN rad END), 9) AS mean_rad FROM (" + _knn_sql(e3, e3, 3, 9, cols="qid, rank, rad") + ") GROUP BY qid",
        "knn_attributes": "SELECT qid, rank, id, label FROM (" + _knn_sql(e3, e3, 3, 3, cols="qid, rank, id") + ") JOIN embeddings ON vec_id = id",
        "knn_supplier_customer": _knn_sql("SELECT s_suppkey AS id, CAST(s_acctbal AS DOUBLE) AS x0 FROM supplier", _CUSTOMERS, 1, 2),
        "knn_parts_ties": _knn_sql(_PARTS, _PARTS, 2, 4),
        "fof_labels_customers": f1 + "SELECT id, label, zindex FROM f",
        "fof_sizes": f1 + "SELECT count, count(*) AS groups FROM (SELECT label, count(*) AS count FROM f GROUP BY label) GROUP BY count",
        "fof_group_order": f2 + "SELECT id, row_number() OVER (ORDER BY label, zindex) - 1 AS row, label FROM f",
        "fof_superset": f2 + ", g1 AS (" + f1 + "SELECT id, label AS narrow FROM f), j AS (SELECT * FROM f JOIN g1 USING (id)) SELECT (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT label) AS n FROM j GROUP BY narrow)) AS wide_holds_narrow, (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT narrow) AS n FROM j GROUP BY label)) AS narrow_holds_wide",
        "fof_catalogue": f2 + """, m AS (SELECT f.*, 1.0::DOUBLE + id % 3 AS w, CAST(c_nationkey AS DOUBLE) AS v FROM f JOIN customer ON c_custkey = id),
a AS (SELECT label, count(*) AS count, sum(w) AS mass, sum(w * x0) / sum(w) AS com, sum(w * v) / sum(w) AS vel FROM m GROUP BY label),
o AS (SELECT *, coalesce(sum(count) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM a)
SELECT o.label, count, off AS offset, round(mass, 6) AS mass, round(com, 6) AS com_pos0, round(vel, 6) AS com_vel0, 0.5::DOUBLE AS scale_factor,
       round(sqrt(sum(w * (x0 - com) * (x0 - com)) / sum(w)), 5) AS com_inertia_radius
FROM o JOIN m USING (label) WHERE count >= 3 GROUP BY o.label, count, off, mass, com, vel""",
        "fof_periodic": f"""
WITH p AS ({_BOXED}), z AS (SELECT *, row_number() OVER (ORDER BY x0, id) - 1 AS zindex FROM p),
g AS (SELECT *, CASE WHEN (x0 - lag(x0) OVER (ORDER BY zindex)) * (x0 - lag(x0) OVER (ORDER BY zindex)) <= 0.02 * 0.02 THEN 0 ELSE 1 END AS starts FROM z),
h AS (SELECT *, sum(starts) OVER (ORDER BY zindex) AS grp FROM g),
e AS (SELECT min(grp) AS lo, max(grp) AS hi, min(x0) - max(x0) + 1000.0 AS gap FROM h),
k AS (SELECT h.*, CASE WHEN grp = hi AND gap * gap <= 0.02 * 0.02 THEN lo ELSE grp END AS grp2 FROM h, e)
SELECT id, min(id) OVER (PARTITION BY grp2) AS least_id, count(*) OVER (PARTITION BY grp2) AS count FROM k""",
        "fof_labels_parts": f"""
WITH RECURSIVE p AS ({_PARTS}), u AS (SELECT x0, x1, min(id) AS id FROM p GROUP BY x0, x1),
e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON b.x0 BETWEEN a.x0 - 0.9 AND a.x0 + 0.9 AND (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) <= 0.9 * 0.9),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS least_id FROM r GROUP BY a)
SELECT p.id, c.least_id FROM p JOIN u USING (x0, x1) JOIN c ON c.a = u.id""",
        "knn_indexed": _knn_sql(_PARTS, _PARTS, 2, 4),
        "knn_indexed_queries": _knn_sql(_CUSTOMERS, _SUPPLIERS, 1, 3),
        "fof_indexed": f1 + "SELECT id, label, zindex FROM f",
        "index_merged": f"SELECT id, row_number() OVER (ORDER BY x0, id) - 1 AS zindex FROM ({_CUSTOMERS})",
        "pair_counts": _PAIR_COUNTS,
        "search_indexed": _SEARCH_INDEXED,
        "density_customers": f"SELECT q.id, count(s.id) AS count FROM ({_CUSTOMERS}) q LEFT JOIN ({_SUPPLIERS}) s ON (q.x0 - s.x0) * (q.x0 - s.x0) <= 75.0 * 75.0 GROUP BY q.id",
        "density_embeddings3": f"SELECT q.id, count(*) AS count FROM ({e3}) q JOIN ({e3}) s ON {' + '.join(f'(q.x{i} - s.x{i}) * (q.x{i} - s.x{i})' for i in range(3))} <= 0.2 * 0.2 GROUP BY q.id",
        "fof_catalogue_periodic": _catalogue_sql(),
        "zindex_customers": f"SELECT id, row_number() OVER (ORDER BY x0, id) - 1 AS zindex FROM ({_CUSTOMERS})",
        "knn_difference": "SELECT qid, rank, id, d0, d1, d2, id AS part_id FROM (SELECT n.qid, n.rank, n.id, round(a.x0 - b.x0, 9) AS d0, round(a.x1 - b.x1, 9) AS d1, round(a.x2 - b.x2, 9) AS d2 FROM (" + _knn_sql(e3, e3, 3, 3, cols="qid, rank, id") + f") n JOIN ({e3}) a ON a.id = n.qid JOIN ({e3}) b ON b.id = n.id)",
        "zindex_fractions": _signed_z("SELECT c_custkey AS id, floor(c_acctbal * 4) / 4 AS x0, (c_nationkey - 12) / 2.0 AS x1 FROM customer", 2, 4, 20),
        "zindex_embeddings3": _signed_z("SELECT vec_id AS id, " + ", ".join(f"floor(CAST(embedding[{i + 1}] AS DOUBLE) * 4096) / 4096 AS x{i}" for i in range(3)) + " FROM embeddings", 3, 4096, 13),
        "zindex_integers": "SELECT id, row_number() OVER (ORDER BY array_to_string(list_transform(range(63, -1, -1), lambda i: CAST(" + _FLIPPED.format(x="x0") + " AS VARCHAR) || CAST(" + _FLIPPED.format(x="x1") + f" AS VARCHAR)), ''), id) - 1 AS zindex FROM ({_INTEGERS})",
        "search_leaves_parts": _SEARCH_LEAVES,
        "node_planes": _PART_PLANES,
        "fof_labels_embeddings3": f"""
WITH RECURSIVE p AS (SELECT id, x0 + 1.0 AS x0, x1 + 1.0 AS x1, x2 + 1.0 AS x2 FROM ({e3})),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {" + ".join(f"pow(CASE WHEN a.x{i} - b.x{i} < -1.0 THEN a.x{i} - b.x{i} + 2.0 WHEN a.x{i} - b.x{i} >= 1.0 THEN a.x{i} - b.x{i} - 2.0 ELSE a.x{i} - b.x{i} END, 2)" for i in range(3))} <= 0.06 * 0.06),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS id, min(b) AS least_id FROM r GROUP BY a""",
        "zindex_parts": _PART_Z + " SELECT id, row_number() OVER (ORDER BY zbits, id) - 1 AS zindex FROM z",
        "search_sorted_accounts": "SELECT c_custkey AS id, (SELECT count(*) FROM supplier WHERE s_acctbal < c_acctbal) AS position FROM customer",
        "leaf_counts": _PART_LEAVES + " SELECT leaf, count(*) AS npart FROM leaved GROUP BY leaf",
        "multi_type_leaves": _ACCOUNT_LEAVES,
        "node_mass_centres": _PART_LEAVES + " SELECT leaf, count(*) AS npart, round(sum(mass)::DOUBLE, 6) AS mass, round(sum(mass * x0)::DOUBLE / sum(mass)::DOUBLE, 6) AS mass_cent0, round(sum(mass * x1)::DOUBLE / sum(mass)::DOUBLE, 6) AS mass_cent1 FROM leaved GROUP BY leaf",
        "level_histogram": _PART_LEAVES + " SELECT CAST(34 - length(leaf) AS INTEGER) AS lvl, count(*) AS weight FROM leaved GROUP BY 1",
        "bucket_prefix_sum": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS prefix FROM orders",
        "segment_sort": "SELECT p_partkey, p_size, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) AS INTEGER) AS rank FROM part",
        "components_graph": """
WITH RECURSIVE o AS (SELECT DISTINCT o_custkey::BIGINT AS a, (o_custkey + o_orderkey % 5)::BIGINT AS b FROM orders WHERE o_orderkey % 5 <> 0), s AS MATERIALIZED (SELECT a, b FROM o UNION SELECT b, a FROM o),
r(id, component) USING KEY (id) AS (SELECT a, least(a, min(b)) FROM s GROUP BY a
  UNION SELECT s.b, min(r.component) FROM r JOIN s ON s.a = r.id JOIN recurring.r AS old ON old.id = s.b WHERE r.component < old.component GROUP BY s.b)
SELECT id, component FROM r""",
    }
