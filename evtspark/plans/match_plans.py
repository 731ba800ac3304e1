"""Matching, ranking, reshaping and the region tree over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evtspark.operators import match as ma
from evtspark.operators import regions as rg
from evtspark.plans.registry import PTS, first_component, points, query, r6, table
from evtspark.plans.selection_plans import CAT, catalog
from evtspark.plans.summary_plans import EMB, TR, _long, _trials, label_corr
from evtspark.staging import stage


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_session_subject(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment")


@query("SELECT s_suppkey, position FROM supplier LEFT JOIN (SELECT l_suppkey AS s_suppkey, min(l_orderkey) AS position FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09 GROUP BY 1) USING (s_suppkey)")
def j2_is_member(spark, d):
    b = table(spark, d, "lineitem").where("l_quantity = 50 AND l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey")
    return ma.is_member(table(spark, d, "supplier").select("s_suppkey"), b, "s_suppkey", "l_orderkey")


SITES = "loc AS (SELECT p_partkey, p_partkey % 5 * 32 AS x, p_size * 15 AS y FROM part), tgt AS (SELECT s_suppkey AS site, s_suppkey % 4 * 32 AS x, s_suppkey % 50 * 15 AS y FROM supplier)"


@query(f"""WITH {SITES}, m(step, dx, dy) AS (VALUES (0, 0, 0), (1, -32, 0), (2, 32, 0), (3, 0, -15), (4, 0, 15)), h AS (SELECT p_partkey, step, count(*) AS n, min(site) AS s FROM loc, m JOIN tgt ON tgt.x = loc.x + dx AND tgt.y = loc.y + dy GROUP BY 1, 2),
 f AS (SELECT p_partkey, arg_min(s, step) AS site FROM h WHERE n = 1 GROUP BY 1) SELECT p_partkey, site FROM loc LEFT JOIN f USING (p_partkey)""")
def j8_match_sites(spark, d):
    loc = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 5 * 32).alias("x"), (F.col("p_size") * 15).cast("long").alias("y"))
    k = F.col("s_suppkey")
    return ma.match_sites(loc, table(spark, d, "supplier").select(k.alias("site"), (k % 4 * 32).alias("x"), (k % 50 * 15).alias("y")), "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40")
def j9_assign_regions(spark, d):
    li, p = table(spark, d, "lineitem").where("l_quantity > 40"), table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_size")


VOX = "vox AS (SELECT i, j, k, (i * 7 + j * 3 + k) % 5 AS label FROM range(0, 10) a(i), range(0, 10) b(j), range(0, 10) c(k)), pp AS (SELECT p_partkey, p_size / 5.0 AS x, p_partkey % 90 / 10.0 AS y, p_retailprice / 250.0 AS z FROM part)"


def _voxels(spark):
    r = spark.range(1000)
    return r.select(F.floor(F.col("id") / 100).alias("i"), (F.floor(F.col("id") / 10) % 10).alias("j"), (F.col("id") % 10).alias("k")).withColumn("label", (F.col("i") * 7 + F.col("j") * 3 + F.col("k")) % 5)


def _voxel_points(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") / 5.0).alias("x"), (F.col("p_partkey") % 90 / 10.0).alias("y"), (F.col("p_retailprice") / 250.0).alias("z"))


@query(f"WITH {VOX} SELECT p_partkey, label FROM pp LEFT JOIN vox ON i = CAST(round(x - 0.25) AS INT) AND j = CAST(round(y - 0.25) AS INT) AND k = CAST(round(z - 0.25) AS INT)")
def j10_voxel_lookup(spark, d):
    return ma.voxel_lookup(_voxel_points(spark, d), _voxels(spark), "p_partkey", ["x", "y", "z"], [0.25, 0.25, 0.25], 1.0)


@query(f"""WITH {VOX}, c AS (SELECT p_partkey, label, count(*) AS n FROM pp JOIN vox ON (i - CAST(round(x - 0.25) AS INT)) ** 2 + (j - CAST(round(y - 0.25) AS INT)) ** 2 + (k - CAST(round(z - 0.25) AS INT)) ** 2 <= 1 GROUP BY 1, 2)
 SELECT p_partkey, label, round(n / sum(n) OVER (PARTITION BY p_partkey), 6) AS share FROM c""")
def j10_voxel_shares(spark, d):
    return ma.voxel_shares(_voxel_points(spark, d), _voxels(spark), "p_partkey", ["x", "y", "z"], [0.25, 0.25, 0.25], 1.0, 1).withColumn("share", r6("share"))


@query("SELECT p_partkey, coalesce(n, 0) AS n, round(coalesce(q, -1), 6) AS q FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) USING (p_partkey)")
def j11_complete_units(spark, d):
    m = table(spark, d, "lineitem").where("l_discount > 0.08").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    return ma.complete(table(spark, d, "part").select("p_partkey"), m, ["p_partkey"], {"n": 0, "q": -1.0}).withColumn("q", r6("q"))


@query("""SELECT p_partkey, round(max(q) FILTER (f = 'A'), 6) AS "kernelVE_A", round(max(q) FILTER (f = 'N'), 6) AS "kernelVE_N" FROM part LEFT JOIN (SELECT l_partkey, l_returnflag AS f, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) ON l_partkey = p_partkey GROUP BY 1""")
def j12_attach_scores(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), "l_returnflag").agg(r6(F.avg("l_quantity")).alias("q"))
    return ma.attach_scores(table(spark, d, "part").select("p_partkey"), s, ["p_partkey"], "l_returnflag", "q", ["A", "N"])


@query(f"""WITH {CAT}, s AS (SELECT *, left(expDate, 4) AS yr, o_orderkey * 31 % 4001 AS dur FROM cat), p AS (SELECT subject, yr, o_orderkey AS passive, row_number() OVER (PARTITION BY subject, yr ORDER BY dur DESC, o_orderkey) AS r FROM s WHERE flag = 'O')
 SELECT o_orderkey, passive FROM s JOIN p USING (subject, yr) WHERE flag = 'F' AND r = 1""")
def j14_pair_sessions(spark, d):
    s = catalog(spark, d).withColumn("yr", F.substring("expDate", 1, 4)).withColumn("dur", F.col("o_orderkey") * 31 % 4001)
    return ma.pair_sessions(s.where("flag = 'F'"), s.where("flag = 'O'"), ["subject", "yr"], "o_orderkey", "dur")


@query(f"""WITH {CAT} SELECT subject, coalesce(arg_max(o_orderkey, (expDate, o_orderkey)) FILTER (expDate <= '1998-01-01'), arg_min(o_orderkey, (expDate, o_orderkey))) AS o_orderkey FROM cat GROUP BY 1""")
def j15_nearest_prior_session(spark, d):
    return ma.nearest_prior_session(catalog(spark, d), ["subject"], "expDate", "1998-01-01", "o_orderkey")


CH = """pr AS (SELECT x.l_linenumber AS day, x.l_suppkey AS a, y.l_suppkey AS b, max(x.l_extendedprice) AS score FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 GROUP BY 1, 2, 3),
 bst AS (SELECT day, a, b FROM (SELECT *, row_number() OVER (PARTITION BY day, b ORDER BY score DESC, a) AS r FROM pr) WHERE r = 1)"""


def _pairs(spark, d):
    """Suppliers of an order's neighbouring lines as pairs of day k and k + 1; a line's number is the day."""
    li = table(spark, d, "lineitem")
    first = li.select("l_orderkey", F.col("l_linenumber").alias("day"), F.col("l_suppkey").alias("a"), F.col("l_extendedprice").alias("score"))
    second = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("day"), F.col("l_suppkey").alias("b"))
    return first.join(second, ["l_orderkey", "day"]).groupBy("day", "a", "b").agg(F.max("score").alias("score"))


STEPS = " ".join(f"JOIN bst x{k} ON x{k}.day = {k} AND x{k}.a = x{k - 1}.b" for k in range(2, 7))


@query(f"WITH {CH} SELECT x1.a AS u0, x1.b AS u1, x2.b AS u2, x3.b AS u3, x4.b AS u4, x5.b AS u5, x6.b AS u6 FROM bst x1 {STEPS} WHERE x1.day = 1")
def j18_chain_matches(spark, d):
    p = stage(_pairs(spark, d))
    return ma.chain_matches([p.where(F.col("day") == k).drop("day") for k in range(1, 7)])


@query("WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")
def j19_pair_distance(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    pairs = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return ma.pair_distance(pairs, e, e, "vec_id", "x", "y").withColumn("distance", r6("distance"))


@query(f"""WITH {TR}, t AS (SELECT session, trial, ln, level, ln = 1 AS hit FROM tr), s AS (SELECT DISTINCT session, level FROM t WHERE hit)
 SELECT level, false AS control, count(*) AS n FROM t WHERE hit GROUP BY 1 UNION ALL SELECT s.level, true, count(*) FROM t JOIN s USING (session) WHERE NOT hit GROUP BY 1""")
def j20_with_controls(spark, d):
    t = _trials(spark, d).select("session", "trial", "ln", "level")
    return ma.with_controls(t, "session", F.col("ln") == 1, ["level"]).groupBy("level", "control").agg(F.count("*").alias("n"))


@query("SELECT a.l_partkey, a.n AS n_active, b.n AS n_passive FROM (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (l_partkey)")
def j21_match_units_by_id(spark, d):
    li = table(spark, d, "lineitem")
    n = lambda f, name: li.where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.count("*").alias(name))
    return n("A", "n_active").join(n("R", "n_passive"), "l_partkey")


@query(f"WITH {CAT}, r AS (SELECT subject, o_orderkey, row_number() OVER (PARTITION BY subject ORDER BY o_orderkey * 31 % 4001 DESC, o_orderkey) AS k FROM cat) SELECT subject, o_orderkey FROM r WHERE k = 1")
def t1_longest_session(spark, d):
    s = catalog(spark, d).withColumn("dur", F.col("o_orderkey") * 31 % 4001)
    return ma.top_n(s.withColumn("dur", F.col("dur").cast("double")), ["subject"], "dur", 1, "o_orderkey").select("subject", "o_orderkey")


@query(f"WITH {EMB}, c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(corr(a.x, b.x), 9) AS r FROM em a JOIN em b ON a.pix = b.pix AND b.label = (a.label + 1) % 10 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS rank FROM c) SELECT a, b, rank FROM k WHERE rank <= 5")
def t2_top_n_matches(spark, d):
    c = label_corr(spark, d, best=(5, 9)).withColumn("r", F.round("r", 9))
    return ma.top_n(c, ["a"], "r", 5, "b").select("a", "b", F.col("rank").cast("long").alias("rank"))


@query("WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM k WHERE r <= 40")
def t3_first_n_trials(spark, d):
    return ma.first_n(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"], ["l_orderkey", "l_linenumber", "l_partkey"], 40).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH k AS (SELECT l_returnflag, l_linestatus, l_quantity, l_orderkey, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem),
 c AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
 SELECT * FROM k WHERE rank <= 250 UNION ALL SELECT l_returnflag, l_linestatus, l_quantity, NULL, r FROM c JOIN range(1, 251) g(r) ON r > n""")
def t3_padded_trials(spark, d):
    keys = ["l_returnflag", "l_linestatus", "l_quantity"]
    li = table(spark, d, "lineitem").select(*keys, "l_orderkey", "l_linenumber", "l_partkey")
    return ma.first_n(li, keys, ["l_orderkey", "l_linenumber", "l_partkey"], 250, pad=True).select(*keys, "l_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT l_linestatus, min(n) AS m FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus, l_returnflag ORDER BY (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber) % 1000003, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey FROM k JOIN s USING (l_linestatus) WHERE r <= m""")
def t4_equalise_counts(spark, d):
    order = F.struct(((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber")) % 1000003).alias("h"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ma.equalise_counts(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", order, width=1000.0).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS place FROM lineitem")
def t5_order_trials(spark, d):
    return ma.order_trials(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_partkey", True).select("l_orderkey", "l_linenumber", "l_partkey", F.col("place").cast("long").alias("place"))


@query("WITH m AS (SELECT p_brand, p_type, avg(p_retailprice) AS s FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_type) AS r FROM m) SELECT p_brand, p_type, round(s, 6) AS p_retailprice FROM k WHERE r = 1")
def t6_best_model(spark, d):
    return ma.best_model(table(spark, d, "part"), ["p_brand"], "p_type", "p_retailprice").withColumn("p_retailprice", r6("p_retailprice"))


@query(f"WITH {CAT}, u AS (SELECT o_orderkey, unnest(string_split(probes, ',')) AS f, generate_subscripts(string_split(probes, ','), 1) - 1 AS probe FROM cat) SELECT o_orderkey, probe FROM u WHERE f = '1'")
def u0_unwrap_probes(spark, d):
    return ma.unwrap_probes(catalog(spark, d), "probes").select("o_orderkey", F.col("probe").cast("long").alias("probe"))


@query("SELECT l_partkey + 1000 * (l_linenumber % 2) AS unit, count(*) AS n FROM lineitem GROUP BY 1")
def u1_merge_probes(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit"), (F.col("l_linenumber") % 2).alias("probe"))
    return ma.merge_probes(li, "probe", "unit").groupBy("unit").agg(F.count("*").alias("n"))


@query(f"WITH {PTS} SELECT CASE unit WHEN 'click' THEN 'first' ELSE 'second' END AS session_name, id, CASE unit WHEN 'click' THEN round(v, 6) END AS v FROM pts WHERE unit IN ('click', 'view')")
def u2_concat_trials(spark, d):
    p = points(spark, d)
    return ma.concat_trials({"first": p.where("unit = 'click'").select("id", r6("v").alias("v")), "second": p.where("unit = 'view'").select("id")})


@query("(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def u3_set_operations(spark, d):
    o = table(spark, d, "orders")
    both = o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))
    return both.subtract(table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity > 25 AS congruent FROM lineitem")
def u4_condition_combinations(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).alias("congruent")).distinct()


@query("""SELECT p_brand, count(*) FILTER (p_size <= 20) AS low, count(*) FILTER (p_size > 20) AS high FROM part GROUP BY 1""")
def u5_pivot(spark, d):
    p = table(spark, d, "part").withColumn("band", F.when(F.col("p_size") <= 20, "low").otherwise("high"))
    return p.groupBy("p_brand").pivot("band", ["low", "high"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT p_brand, 'n' AS measure, count(*)::DOUBLE AS value FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'size', sum(p_size)::DOUBLE FROM part GROUP BY 1""")
def u5_unpivot(spark, d):
    w = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").cast("double").alias("n"), F.sum("p_size").cast("double").alias("size"))
    return w.unpivot("p_brand", ["n", "size"], "measure", "value")


TREE = """tree AS (SELECT 0 AS id, NULL::INT AS parent UNION ALL SELECT 1 + r_regionkey, 0 FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey FROM nation UNION ALL SELECT 1000 + c_custkey::INT, 100 + c_nationkey FROM customer),
 clo AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM tree UNION ALL SELECT c.ancestor, t.id, c.depth + 1 FROM clo c JOIN tree t ON t.parent = c.descendant)"""


def _tree(spark, d):
    root = spark.range(1).select(F.lit(0).alias("id"), F.lit(None).cast("int").alias("parent"))
    r = table(spark, d, "region").select((1 + F.col("r_regionkey")).cast("int").alias("id"), F.lit(0).alias("parent"))
    n = table(spark, d, "nation").select((100 + F.col("n_nationkey")).cast("int").alias("id"), (1 + F.col("n_regionkey")).cast("int").alias("parent"))
    c = table(spark, d, "customer").select((1000 + F.col("c_custkey")).cast("int").alias("id"), (100 + F.col("c_nationkey")).cast("int").alias("parent"))
    return root.unionByName(r).unionByName(n).unionByName(c)


@query(f"WITH RECURSIVE {TREE} SELECT ancestor, descendant, depth FROM clo")
def g1_closure(spark, d):
    return rg.closure(_tree(spark, d))


@query(f"WITH RECURSIVE {TREE} SELECT descendant, depth FROM clo WHERE ancestor = 2 AND depth > 0")
def g1_descendants(spark, d):
    return rg.descendants(rg.closure(_tree(spark, d)), 2)


@query(f"WITH RECURSIVE {TREE} SELECT descendant FROM clo WHERE depth = 0 AND descendant NOT IN (SELECT ancestor FROM clo WHERE depth = 1)")
def g1_leaves(spark, d):
    return rg.leaves(rg.closure(_tree(spark, d)))


@query(f"""WITH RECURSIVE {TREE}, li AS (SELECT id FROM tree WHERE id BETWEEN 1 AND 3 OR id % 100 = 7), up AS (SELECT descendant, arg_min(ancestor, depth) AS t FROM clo JOIN li ON li.id = ancestor GROUP BY 1),
 u AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * (1000 + o_custkey::INT) AS region FROM orders) SELECT o_orderkey, sign(region)::INT * coalesce(t, 0) AS mapped FROM u LEFT JOIN up ON abs(region) = descendant""")
def g2_map_regions(spark, d):
    t = _tree(spark, d)
    u = table(spark, d, "orders").select("o_orderkey", (F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1) * (1000 + F.col("o_custkey").cast("int"))).alias("region"))
    return rg.map_regions(u, rg.closure(t), t.where("id BETWEEN 1 AND 3 OR id % 100 = 7"), 0).select("o_orderkey", "mapped")


@query(f"WITH RECURSIVE {TREE}, v AS (SELECT id, id % 13 * 1.5::DOUBLE AS value FROM tree WHERE id % 3 = 0) SELECT descendant, round(quantile_cont(value, 0.5), 6) AS value FROM clo JOIN v ON v.id = ancestor GROUP BY 1")
def g3_propagate_down(spark, d):
    t = _tree(spark, d)
    v = t.where("id % 3 = 0").select("id", (F.col("id") % 13 * 1.5).cast("double").alias("value"))
    return rg.propagate_down(v, rg.closure(t)).withColumn("value", r6("value"))


@query(f"""WITH RECURSIVE e AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
 c AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, [covar_pop(x, x), covar_pop(x, y), covar_pop(x, z), covar_pop(x, y), covar_pop(y, y), covar_pop(y, z), covar_pop(x, z), covar_pop(y, z), covar_pop(z, z)] AS m FROM e GROUP BY 1),
 {first_component("line", "c", "label", 3)}, d AS (SELECT label, vec_id, [x - mx, y - my, z - mz] AS d, v FROM e JOIN c USING (label) JOIN line USING (label))
 SELECT label, vec_id, round(list_dot_product(d, v), 6) AS along, round(sqrt(greatest(list_dot_product(d, d) - list_dot_product(d, v) ** 2, 0)), 6) AS distance FROM d""")
def g4_fit_line(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")])
    return rg.project(e, rg.fit_line(e, ["label"], ["x", "y", "z"]), ["label"], ["x", "y", "z"]).select("label", "vec_id", r6("along").alias("along"), r6("distance").alias("distance"))


@query()
def m24_greedy_match(spark, d):
    e = _long(spark, d).withColumn("day", F.col("vec_id") % 2).withColumn("days", F.lit("0-1"))
    return ma.greedy_match_columns(e.where("day = 0"), e.where("day = 1"), ["days"], "pix", "vec_id", "x")


__all__ = ["Window"]
