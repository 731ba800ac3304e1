"""Rasters and summaries over events (points), lineitem (trials), orders (sessions), part and embeddings (units)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evtspark.operators import raster as ra
from evtspark.operators import summary as su
from evtspark.plans.registry import PTS, REFS, points, query, r6, refs, table
from evtspark.plans.selection_plans import CAT, catalog
from evtspark.staging import stage

H = 3600.0


def _ev(spark, d):
    return refs(spark, d).select("session", F.col("id").alias("event"), F.col("t").alias("t0"))


def _pts(spark, d):
    return points(spark, d).where("unit IN ('click', 'view')").select("session", "unit", "t")


RASTER = f"""{PTS}, {REFS}, p AS (SELECT session, unit, t FROM pts WHERE unit IN ('click', 'view')),
 u AS (SELECT DISTINCT session, unit FROM p), grid AS (SELECT r.session, r.id AS event, u.unit, b AS bin FROM refs r JOIN u USING (session), range(0, 6) AS g(b)),
 hit AS (SELECT r.session, r.id AS event, p.unit, CAST(floor((p.t - r.t + 21600.0) / 7200.0) AS BIGINT) AS bin FROM refs r JOIN p ON p.session = r.session AND p.t >= r.t - 21600.0 AND p.t <= r.t + 21600.0),
 c AS (SELECT session, event, unit, bin, count(*) AS n FROM hit WHERE bin BETWEEN 0 AND 5 GROUP BY 1, 2, 3, 4),
 ras AS (SELECT grid.session, grid.event, grid.unit, grid.bin, coalesce(c.n, 0) AS n FROM grid LEFT JOIN c USING (session, event, unit, bin))"""


def _raster(spark, d):
    return ra.raster_counts(_pts(spark, d), _ev(spark, d), ["session"], 6 * H, 6 * H, 2 * H)


@query(f"WITH {RASTER} SELECT event, unit, bin, n FROM ras")
def a1_raster_counts(spark, d):
    return _raster(spark, d).select("event", "unit", F.col("bin").cast("long").alias("bin"), F.col("n").cast("long").alias("n"))


@query(f"WITH {PTS} SELECT unit, CAST(floor(t / 86400) AS BIGINT) AS x_bin, CAST(floor(v / 50) AS BIGINT) AS y_bin, count(*) AS n, round(sum(v), 4) AS w FROM pts GROUP BY 1, 2, 3")
def a2_bincount2d(spark, d):
    p = points(spark, d)
    n = ra.bincount2d(p, "t", "v", 86400.0, 50.0, by=["unit"])
    w = ra.bincount2d(p, "t", "v", 86400.0, 50.0, weight=F.col("v"), by=["unit"]).withColumnRenamed("n", "w")
    return n.join(w, ["unit", "x_bin", "y_bin"]).select("unit", "x_bin", "y_bin", "n", F.round("w", 4).alias("w"))


@query(f"WITH {RASTER} SELECT unit, event % 4 AS condition, bin, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd, round(stddev_pop(n) / sqrt(count(*)), 6) AS sem, count(*) AS n_trials FROM ras GROUP BY 1, 2, 3")
def a3_psth(spark, d):
    """Mean point count per condition and bin around reference events."""
    r = _raster(spark, d).withColumn("condition", F.col("event") % 4)
    return ra.psth(r, ["unit", "condition", "bin"]).select("unit", "condition", "bin", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("sem").alias("sem"), "n_trials")


@query(f"WITH {RASTER} SELECT event, unit, bin, round(n - avg(n) FILTER (bin < 3) OVER (PARTITION BY event, unit), 6) AS n FROM ras")
def a4_subtract_baseline(spark, d):
    return ra.subtract_baseline(_raster(spark, d), ["event", "unit"], 3).select("event", "unit", "bin", r6("n").alias("n"))


@query(f"WITH {PTS} SELECT unit, CAST(floor(v / 20) AS BIGINT) AS depth_bin, CAST(floor(t / 86400) AS BIGINT) AS time_bin, count(*) AS n, unit || '_' || CAST(floor(v / 20) AS BIGINT) AS key FROM pts GROUP BY ALL")
def a5_depth_time_counts(spark, d):
    return ra.depth_time_counts(points(spark, d), ["unit"], "v", "t", 20.0, 86400.0)


TR = """tr AS (SELECT l_orderkey AS session, l_orderkey * 1000 + l_partkey AS trial, l_suppkey % 5 AS subject, ['coherent', 'visual', 'auditory'][1 + l_partkey % 3] AS kind, 1 + l_suppkey % 2 AS side,
 CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS response, CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS feedback,
 l_extendedprice / 1000.0 AS rt, CAST(l_quantity AS INT) % 5 AS level, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_shipdate FROM lineitem)"""


def _trials(spark, d):
    li = table(spark, d, "lineitem")
    kinds = F.array(F.lit("coherent"), F.lit("visual"), F.lit("auditory"))
    return li.select(
        F.col("l_orderkey").alias("session"), (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("trial"), (F.col("l_suppkey") % 5).alias("subject"), F.get(kinds, (F.col("l_partkey") % 3).cast("int")).alias("kind"),
        (1 + F.col("l_suppkey") % 2).alias("side"), F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("response"),
        F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("feedback"), (F.col("l_extendedprice") / 1000.0).alias("rt"),
        (F.col("l_quantity").cast("int") % 5).alias("level"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), "l_shipdate",
    )


@query(f"""WITH {TR}, s AS (SELECT subject, least(count(*) FILTER (side = 1), count(*) FILTER (side = 2)) AS m FROM tr GROUP BY 1)
 SELECT subject, count(*) FILTER (response <> 0) AS n_go, count(*) FILTER (response = 0) AS n_nogo, round(avg((feedback + 1) / 2.0) FILTER (response <> 0 AND kind = 'coherent'), 6) AS accuracy_coherent,
 round(avg((feedback + 1) / 2.0) FILTER (response <> 0 AND kind = 'visual'), 6) AS accuracy_visual, round(avg((feedback + 1) / 2.0) FILTER (response <> 0 AND kind = 'auditory'), 6) AS accuracy_auditory, max(m) AS n_equal FROM tr JOIN s USING (subject) GROUP BY 1""")
def a6_session_performance(spark, d):
    t = _trials(spark, d)
    out = su.session_performance(t, ["subject"], "kind", "side", "feedback", "response")
    m = t.groupBy("subject").agg(F.least(F.sum((F.col("side") == 1).cast("long")), F.sum((F.col("side") == 2).cast("long"))).alias("n_equal"))
    return out.join(m, "subject").select("subject", "n_go", "n_nogo", *[r6(f"accuracy_{k}").alias(f"accuracy_{k}") for k in ("coherent", "visual", "auditory")], "n_equal")


@query(f"WITH {TR}, m AS (SELECT subject, side, median(rt) AS median FROM tr GROUP BY 1, 2) SELECT subject, side, round(m.median, 6) AS median, round(quantile_cont(abs(rt - m.median), 0.5), 6) AS mad FROM tr JOIN m USING (subject, side) GROUP BY 1, 2, 3")
def a7_rt_summary(spark, d):
    return su.rt_summary(_trials(spark, d), ["subject", "side"], "rt").select("subject", "side", r6("median").alias("median"), r6("mad").alias("mad"))


@query("SELECT p_brand, count(*) AS n_units, count(*) FILTER (p_size > 20) AS n_good, count(*) FILTER (p_size > 20 AND p_retailprice > 1500) AS n_metric_good FROM part GROUP BY 1")
def a8_unit_yield(spark, d):
    return su.unit_yield(table(spark, d, "part"), ["p_brand"], F.col("p_size") > 20, (F.col("p_size") > 20) & (F.col("p_retailprice") > 1500))


@query("""WITH r AS (SELECT DISTINCT p_brand, p_size FROM part), s AS (SELECT p_brand, p_size - lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS dd FROM r), m AS (SELECT p_brand, coalesce(max(dd) = 2, false) AS single_type FROM s GROUP BY 1)
 SELECT p_brand, min(p_retailprice) AS x_min, max(p_retailprice) AS x_max, min(p_size) AS y_min, max(p_size) AS y_max, any_value(single_type) AS single_type FROM part JOIN m USING (p_brand) GROUP BY 1""")
def a9_channel_extent(spark, d):
    return su.channel_extent(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size", 2)


@query(f"""WITH {RASTER}, z AS (SELECT unit, bin, (avg(n) FILTER (event % 2 = 0) - avg(n) FILTER (event % 2 = 1)) / nullif(stddev_pop(n) FILTER (event % 2 = 0), 0) AS z FROM ras GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY abs(z) DESC, bin) AS r FROM z WHERE z IS NOT NULL) SELECT unit, round(z, 6) AS z FROM k WHERE r = 1""")
def a10_lr_difference(spark, d):
    r = _raster(spark, d).withColumn("side", F.when(F.col("event") % 2 == 0, "R").otherwise("L"))
    return su.lr_difference(r, ["unit"], "side", "n").select("unit", r6("z").alias("z"))


@query(f"WITH {TR} SELECT kind, level, subject, CASE WHEN count(*) >= 800 THEN round(avg(CASE WHEN response = 2 THEN 1.0 ELSE 0 END), 6) END AS mean, count(*) AS n FROM tr GROUP BY 1, 2, 3")
def a11_condition_mean(spark, d):
    out = su.condition_mean(_trials(spark, d), ["kind", "level", "subject"], (F.col("response") == 2).cast("double"), 800)
    return out.withColumn("mean", r6("mean"))


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) SELECT a.l_returnflag, b.l_linestatus, q.l_quantity, count(c.l_quantity) AS n FROM (SELECT DISTINCT l_returnflag FROM c) a, (SELECT DISTINCT l_linestatus FROM c) b, (SELECT DISTINCT l_quantity FROM c) q
 LEFT JOIN c ON c.l_returnflag = a.l_returnflag AND c.l_linestatus = b.l_linestatus AND c.l_quantity = q.l_quantity GROUP BY 1, 2, 3""")
def j13_condition_grid(spark, d):
    return su.condition_grid(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"])


@query(f"""WITH {TR}, k AS (SELECT CASE WHEN level = 0 THEN 'blank' ELSE kind END AS kind, level, response FROM tr),
 s AS (SELECT kind AS series, level, response FROM k WHERE kind <> 'blank' UNION ALL SELECT s, level, response FROM k, (VALUES ('visual'), ('coherent')) v(s) WHERE kind = 'blank')
 SELECT series, level, round(avg(CASE WHEN response = 2 THEN 1.0 ELSE 0 END), 6) AS p_right, count(*) AS n FROM s GROUP BY 1, 2""")
def a12_psychometric(spark, d):
    t = _trials(spark, d).withColumn("kind", F.when(F.col("level") == 0, "blank").otherwise(F.col("kind")))
    return su.psychometric(t, "kind", "level", (F.col("response") == 2).cast("double")).withColumn("p_right", r6("p_right"))


@query("SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1, 2")
def a13_group_mean(spark, d):
    return su.group_mean(table(spark, d, "part"), ["p_brand", "p_type"], "p_retailprice").withColumn("mean", r6("mean"))


@query("SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1")
def a13_value_counts(spark, d):
    return su.value_counts(table(spark, d, "lineitem"), "l_quantity")


@query(f"""WITH {PTS}, m AS (SELECT session, unit, quantile_cont(v, 0.5) AS depth, quantile_cont(t / 4000, 0.5) AS x FROM pts GROUP BY 1, 2)
 SELECT session, unit, round(depth, 6) AS depth, round(x, 6) AS x, (SELECT k FROM (VALUES (0, 0.0), (1, 200.0), (2, 400.0), (3, 600.0)) s(k, p) ORDER BY abs(m.x - p), k LIMIT 1) AS shank FROM m""")
def a14_unit_position(spark, d):
    p = points(spark, d).withColumn("x", F.col("t") / 4000)
    return su.unit_position(p, ["session", "unit"], "v", "x").select("session", "unit", r6("depth").alias("depth"), r6("x").alias("x"), "shank")


@query(f"""WITH {PTS}, w AS (SELECT session, t, CASE WHEN v >= 0.3 * max(v) OVER (PARTITION BY session) THEN v * v ELSE 0 END AS w FROM pts) SELECT session, round(sum(w * t) / sum(w), 4) AS centre FROM w GROUP BY 1""")
def a15_centre_of_mass(spark, d):
    return su.centre_of_mass(points(spark, d), ["session"], "v", "t", power=2).select("session", F.round("centre", 4).alias("centre"))


@query(f"WITH {TR}, n AS (SELECT kind, level::DOUBLE AS level, coalesce(CASE WHEN response > 0 THEN response END, -1000)::DOUBLE AS response, count(*) AS n FROM tr GROUP BY 1, 2, 3) SELECT level, response, sum(n)::BIGINT AS n, dense_rank() OVER (ORDER BY level, response) AS class_id FROM n GROUP BY 1, 2 HAVING sum(n) >= 100")
def a16_condition_classes(spark, d):
    t = _trials(spark, d).withColumn("response", F.when(F.col("response") > 0, F.col("response")))
    return su.condition_classes(t, ["level", "response"], 100)


@query(f"""WITH {TR}, p AS (SELECT session, list_sort(list(DISTINCT kind)) AS s FROM tr GROUP BY 1), b AS (SELECT s FROM p GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1) SELECT session, trial, ln FROM tr WHERE session IN (SELECT session FROM p WHERE s = (SELECT s FROM b))""")
def a17_modal_parameter_set(spark, d):
    return su.modal_parameter_set(_trials(spark, d), ["session"], ["kind"]).select("session", "trial", "ln")


@query(f"WITH {CAT}, s AS (SELECT subject, left(expDate, 7) AS day, o_orderkey, o_orderkey % 11 AS dur FROM cat), r AS (SELECT *, rank() OVER (PARTITION BY subject, day ORDER BY dur DESC) AS k FROM s) SELECT o_orderkey FROM r WHERE k = 1")
def a18_longest_per_day(spark, d):
    s = catalog(spark, d).withColumn("day", F.substring("expDate", 1, 7)).withColumn("dur", F.col("o_orderkey") % 11)
    return su.longest_per_day(s, ["subject"], "day", "dur").select("o_orderkey")


@query(f"""WITH {CAT}, s AS (SELECT subject, o_orderkey, expDate, o_orderkey % 97 AS a, o_orderkey % 97 + 8 AS z, o_orderkey * 7 % 101 AS n FROM cat),
 m AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY subject ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM s),
 g AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY a, z) AS grp FROM m), y AS (SELECT subject, grp, avg(n) AS m FROM g GROUP BY 1, 2), b AS (SELECT subject, grp, row_number() OVER (PARTITION BY subject ORDER BY m DESC, grp) AS r FROM y),
 k AS (SELECT g.*, row_number() OVER (PARTITION BY g.subject ORDER BY n DESC, expDate DESC, a) AS r FROM g JOIN b ON b.subject = g.subject AND b.grp = g.grp AND b.r = 1) SELECT subject, n FROM k WHERE r = 1""")
def a19_best_yield_per_position(spark, d):
    k = F.col("o_orderkey")
    s = catalog(spark, d).select("subject", "o_orderkey", "expDate", (k % 97).alias("a"), (k % 97 + 8).alias("z"), (k * 7 % 101).alias("n"))
    return su.best_yield_per_position(s, ["subject"], "a", "z", "expDate", "n").select("subject", "n")


@query(f"""WITH {CAT}, s AS (SELECT *, least(round((o_orderkey % 5760) / 720.0), 7) * 720 AS snapped, flag = 'F' AS chronic FROM cat), r AS (SELECT *, row_number() OVER (PARTITION BY subject, snapped ORDER BY expDate, o_orderkey) AS k FROM s WHERE chronic)
 SELECT o_orderkey, CAST(snapped AS DOUBLE) AS snapped FROM r WHERE k = 1 UNION ALL SELECT o_orderkey, CAST(snapped AS DOUBLE) FROM s WHERE NOT chronic""")
def a20_unique_positions(spark, d):
    s = catalog(spark, d).withColumn("bottom", F.col("o_orderkey") % 5760)
    return su.unique_positions(s, ["subject"], "bottom", F.col("flag") == "F", ["expDate", "o_orderkey"]).select("o_orderkey", "snapped")


@query(f"""WITH {PTS}, c AS (SELECT session, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS n FROM pts GROUP BY 1, 2) SELECT session, round(regr_slope(log10(n), day), 6) AS slope, round(regr_intercept(log10(n), day), 6) AS intercept FROM c GROUP BY 1 HAVING count(DISTINCT day) > 2""")
def a21_decay_fit(spark, d):
    c = points(spark, d).groupBy("session", F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"))
    return su.decay_fit(c, ["session"], "day", "n").select("session", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("SELECT l_returnflag, round(1 - var_pop(l_extendedprice - l_quantity * 1500) / var_pop(l_extendedprice), 6) AS ve FROM lineitem GROUP BY 1")
def a22_variance_explained(spark, d):
    li = table(spark, d, "lineitem").withColumn("pred", F.col("l_quantity") * 1500)
    return su.variance_explained(li, ["l_returnflag"], "l_extendedprice", "pred").withColumn("ve", r6("ve"))


EMB = "em AS (SELECT vec_id, label, unnest(range(64)) AS pix, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _long(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("pix", "x")).withColumn("x", F.col("x").cast("double"))


def label_corr(spark, d, best=None):
    """Correlations of every vector with those of the next label; the ``best`` of each by ``corr_of_packed``. Vectors are packed once for both sides."""
    packed = stage(su.packed_columns(_long(spark, d), ["label"], "vec_id", "pix", "x"))
    labels = packed.select("label").distinct().select("label", ((F.col("label") + 1) % 10).alias("_next"))
    following = packed.withColumnRenamed("label", "_next").join(F.broadcast(labels), "_next").drop("_next")
    return su.corr_of_packed(packed.where("label IS NOT NULL"), following, ["label"], best=best)


@query(f"WITH {EMB} SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(corr(a.x, b.x), 6) AS r FROM em a JOIN em b ON a.pix = b.pix AND b.label = (a.label + 1) % 10 GROUP BY 1, 2, 3")
def a23_corr_matrix(spark, d):
    return label_corr(spark, d).withColumn("r", r6("r"))


@query(f"""WITH {EMB}, rep AS (SELECT label, pix, x, row_number() OVER (PARTITION BY label, pix ORDER BY vec_id) AS k FROM em), m AS (SELECT label, pix, avg(x) FILTER (k % 2 = 1) AS o, avg(x) FILTER (k % 2 = 0) AS e, avg(x) AS a FROM rep GROUP BY 1, 2),
 s AS (SELECT label, corr(o, e) AS signal FROM m GROUP BY 1), r AS (SELECT rep.label, pix, (k - 1) // 2 AS p, max(x - a) FILTER (k % 2 = 1) AS o, max(x - a) FILTER (k % 2 = 0) AS e FROM rep JOIN m USING (label, pix) GROUP BY 1, 2, 3), n AS (SELECT label, corr(o, e) AS noise FROM r GROUP BY 1)
 SELECT label, round(signal, 6) AS signal, round(noise, 6) AS noise FROM s JOIN n USING (label)""")
def a24_signal_noise_corr(spark, d):
    e = _long(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("label", "pix").orderBy("vec_id")))
    return su.signal_noise_corr(e, ["label"], "pix", "k", "x").select("label", r6("signal").alias("signal"), r6("noise").alias("noise"))


@query(f"""WITH {RASTER}, x AS (SELECT session, unit, event, bin, n - avg(n) OVER (PARTITION BY session, unit, event % 3, bin) AS v FROM ras), lags AS (SELECT unnest([-2, -1, 0, 1, 2]) AS lag),
 l AS (SELECT i.session, i.unit AS a, j.unit AS b, lag, CASE WHEN var_pop(i.v) > 1e-12 AND var_pop(j.v) > 1e-12 THEN corr(i.v, j.v) END AS r FROM x i JOIN x j ON i.session = j.session AND i.event = j.event AND i.unit <> j.unit JOIN lags ON i.bin = j.bin + lag GROUP BY 1, 2, 3, 4),
 k AS (SELECT *, max(r) FILTER (lag = 0) OVER (PARTITION BY session, a, b) AS zero, row_number() OVER (PARTITION BY session, a, b ORDER BY round(abs(r), 12) DESC, abs(lag), lag) AS place FROM l WHERE r IS NOT NULL)
 SELECT session, a, b, lag, round(r, 6) + 0.0::DOUBLE AS r, round(r - zero, 6) + 0.0::DOUBLE AS gain FROM k WHERE place = 1""")
def a24_lagged_noise_corr(spark, d):
    r = _raster(spark, d).withColumn("stim", F.col("event") % 3)
    found = su.lagged_noise_corr(r, ["session"], "unit", ["event"], ["stim"], "bin", "n", [-2, -1, 0, 1, 2], blocks=1)
    return found.withColumns({"r": r6("r") + 0.0, "gain": r6("gain") + 0.0})  # no zero below zero


@query(f"""WITH {EMB}, k AS (SELECT label, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS u, pix, x FROM em), f AS (SELECT label, u, pix % 32 AS p, x, pix // 32 AS half FROM k),
 c AS (SELECT i.label, i.half, i.u AS a, j.u AS b, corr(i.x, j.x) AS r FROM f i JOIN f j ON i.label = j.label AND i.half = j.half AND i.p = j.p AND i.u < j.u GROUP BY 1, 2, 3, 4)
 SELECT x.label, round(CASE WHEN count(*) > 3 THEN corr(x.r, y.r) END, 6) AS stability FROM c x JOIN c y ON x.label = y.label AND x.a = y.a AND x.b = y.b AND x.half = 0 AND y.half = 1 GROUP BY 1""")
def a25_correlation_stability(spark, d):
    e = _long(spark, d).withColumn("half", F.floor(F.col("pix") / 32)).withColumn("p", F.col("pix") % 32)
    found = su.stability_of_columns(e.where("half = 0"), e.where("half = 1"), "p", "vec_id", "x", ["label"])
    return found.withColumn("stability", r6("stability"))


RF = f"{RASTER}, ct AS (SELECT unit, event % 4 AS x, event % 3 AS y, event, sum(n) FILTER (bin >= 3) AS resp, sum(n) FILTER (bin < 3) AS base FROM ras GROUP BY 1, 2, 3, 4)"


@query(f"WITH {RF} SELECT unit, x, y, round(avg(resp) - avg(base), 6) AS response, round(abs((avg(resp) - avg(base)) / nullif(stddev_pop(base), 0)), 6) AS z FROM ct GROUP BY 1, 2, 3")
def a26_rf_map(spark, d):
    c = _raster(spark, d).groupBy("unit", (F.col("event") % 4).alias("x"), (F.col("event") % 3).alias("y"), "event").agg(F.sum(F.when(F.col("bin") >= 3, F.col("n"))).alias("resp"), F.sum(F.when(F.col("bin") < 3, F.col("n"))).alias("base"))
    return ra.rf_map(c, ["unit"], "x", "y", "resp", "base").select("unit", "x", "y", r6("response").alias("response"), r6("z").alias("z"))


TUNE = f"{RASTER}, m AS (SELECT unit, event % 5 AS angle, event % 2 AS fold, bin, avg(n) AS m FROM ras GROUP BY 1, 2, 3, 4), tu AS (SELECT unit, angle, fold, max(abs(m)) AS tuning FROM m GROUP BY 1, 2, 3)"


def _tuning(spark, d):
    r = _raster(spark, d).withColumn("angle", F.col("event") % 5).withColumn("fold", F.col("event") % 2)
    return ra.tuning_curve(r, ["unit", "fold"], "angle")


@query(f"WITH {TUNE} SELECT unit, fold, angle, round(tuning, 6) AS tuning FROM tu")
def a27_tuning_curve(spark, d):
    return _tuning(spark, d).withColumn("tuning", r6("tuning"))


@query(f"""WITH {TUNE}, f AS (SELECT unit, (arg_max(angle, (tuning, -angle))) AS hi, arg_min(angle, (tuning, angle)) AS lo FROM tu WHERE fold = 0 GROUP BY 1),
 v AS (SELECT unit, max(tuning) FILTER (angle = hi) AS h, max(tuning) FILTER (angle = lo) AS l FROM tu JOIN f USING (unit) WHERE fold = 1 GROUP BY 1) SELECT unit, round((h - l) / nullif(h + l, 0), 6) AS selectivity FROM v""")
def a28_selectivity(spark, d):
    return ra.selectivity(_tuning(spark, d), ["unit"], "angle", "fold").withColumn("selectivity", r6("selectivity"))


@query(f"""WITH {PTS}, g AS (SELECT session, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS dd FROM pts), n AS (SELECT session, CAST(floor(log10(dd) * 5) AS BIGINT) AS bin, count(*) AS n FROM g WHERE dd > 0 GROUP BY 1, 2) SELECT session, bin, round(n / sum(n) OVER (PARTITION BY session), 6) AS share FROM n""")
def a29_isi_histogram(spark, d):
    return ra.isi_histogram(points(spark, d), ["session"], "t").withColumn("share", r6("share"))


@query(f"WITH {PTS} SELECT session, round(sqrt(avg(v * v)), 6) AS rms, round(94 + 20 * log10(sqrt(avg(v * v)) / 20), 6) AS spl FROM pts GROUP BY 1")
def a30_rms(spark, d):
    return su.rms(points(spark, d), ["session"], "v", 20.0, 94.0).select("session", r6("rms").alias("rms"), r6("spl").alias("spl"))


@query(f"""WITH {PTS}, m AS (SELECT session, median(v) AS m FROM pts GROUP BY 1), a AS (SELECT session, m, median(abs(v - m)) AS mad FROM pts JOIN m USING (session) GROUP BY 1, 2) SELECT id, round((v - m) / mad, 6) AS z FROM pts JOIN a USING (session) WHERE mad > 0""")
def a31_robust_zscore(spark, d):
    return su.robust_zscore(points(spark, d), ["session"], "v").select("id", r6("z").alias("z"))


@query(f"WITH {PTS}, s AS (SELECT session, avg(v) AS a, stddev_pop(v) AS sd FROM pts GROUP BY 1) SELECT id, round((v - a) / sd, 6) AS z FROM pts JOIN s USING (session) WHERE sd > 0")
def a31_zscore(spark, d):
    return su.zscore(points(spark, d), ["session"], "v").select("id", r6("z").alias("z"))


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS rate FROM orders GROUP BY 1")
def a32_defect_rate(spark, d):
    return su.defect_rate(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F").withColumn("rate", r6("rate"))


@query("""WITH m AS (SELECT c_custkey AS subject, 's' || c_custkey % 20 AS s0, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 's' || c_custkey % 7 END AS s1, '2020-01-' || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') AS i0, CASE WHEN c_custkey % 5 = 0 THEN 'Permanent' ELSE '2021-02-03' END AS e0 FROM customer),
 u AS (SELECT subject, 0 AS probe, s0 AS serial, i0 AS implanted, CASE WHEN e0 = 'Permanent' THEN '2100-01-01' ELSE e0 END AS explanted FROM m UNION ALL SELECT subject, 1, s1, i0, '2022-03-04' FROM m WHERE s1 <> '') SELECT * FROM u""")
def a33_probe_history(spark, d):
    k = F.col("c_custkey")
    m = table(spark, d, "customer").select(
        k.alias("subject"), F.concat(F.lit("s"), (k % 20).cast("string")).alias("P0_serial"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("s"), (k % 7).cast("string"))).alias("P1_serial"),
        F.concat(F.lit("2020-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0")).alias("P0_implantDate"), F.when(k % 5 == 0, "Permanent").otherwise("2021-02-03").alias("P0_explantDate"), F.lit("2022-03-04").alias("P1_explantDate"),
    ).withColumn("P1_implantDate", F.col("P0_implantDate"))
    return su.probe_history(m)


@query(f"""WITH {CAT}, s AS (SELECT subject, expDate, o_orderkey % 3600 AS dur FROM cat), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY expDate DESC, dur DESC) AS k FROM s WHERE dur > 600) SELECT subject, expDate, dur FROM r WHERE k = 1 AND date_diff('day', expDate::DATE, DATE '2001-06-01') <= 400""")
def a34_ready_report(spark, d):
    s = catalog(spark, d).withColumn("dur", F.col("o_orderkey") % 3600)
    return su.ready_report(s, ["subject"], "expDate", "dur", "2001-06-01", days=400).select("subject", "expDate", "dur")


@query(f"""WITH {CAT}, s AS (SELECT subject, CAST(row_number() OVER w AS INT) AS "index", last_value(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY expDate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM cat WINDOW w AS (PARTITION BY subject ORDER BY expDate, o_orderkey))
 SELECT "index", round(avg(CASE WHEN coalesce(st, 0) > 1 THEN 1.0 ELSE 0 END), 6) AS share FROM s GROUP BY 1""")
def a35_training_progress(spark, d):
    s = catalog(spark, d).withColumn("stage", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 4))
    return su.training_progress(s, "subject", ["expDate", "o_orderkey"], "stage", 1).withColumn("share", r6("share"))


@query(f"""WITH {PTS}, k AS (SELECT DISTINCT session AS unit, CAST(floor(t / 86400 / 5) AS BIGINT) AS day FROM pts WHERE unit = 'purchase'), n AS (SELECT day, count(*) AS n FROM k GROUP BY 1), p AS (SELECT a.day AS d1, b.day AS d2, count(*) AS m FROM k a JOIN k b USING (unit) WHERE a.day < b.day GROUP BY 1, 2)
 SELECT d2 - d1 AS gap, round(quantile_cont(m, 0.5), 6) AS matches, round(quantile_cont(m / n, 0.5), 6) AS share FROM p JOIN n ON n.day = p.d1 GROUP BY 1""")
def a36_match_stability(spark, d):
    k = refs(spark, d).select(F.col("session").alias("unit"), F.floor(F.col("t") / 86400 / 5).alias("day")).distinct()
    return su.match_stability(k, "unit", "day").select("gap", r6("matches").alias("matches"), r6("share").alias("share"))


@query(f"WITH {TR}, s AS (SELECT subject, kind, avg(rt) FILTER (response = 2) - avg(rt) FILTER (response = 1) AS dd FROM tr GROUP BY 1, 2) SELECT subject, round(avg(dd), 6) AS difference FROM s GROUP BY 1")
def a37_choice_difference(spark, d):
    return su.choice_difference(_trials(spark, d), ["subject"], "kind", "response", "rt").withColumn("difference", r6("difference"))


@query(f"""WITH {TR} SELECT subject, CASE WHEN rt <= 30 THEN 'fast' ELSE 'slow' END AS speed, round(avg(CASE WHEN response = 2 THEN 1.0 ELSE 0 END) FILTER (level = 1) - avg(CASE WHEN response = 2 THEN 1.0 ELSE 0 END) FILTER (level = 2), 6) AS dominance FROM tr GROUP BY 1, 2""")
def a38_dominance(spark, d):
    return su.dominance(_trials(spark, d), ["subject"], F.col("level") == 2, F.col("level") == 1, F.col("response") == 2, "rt", 30.0).withColumn("dominance", r6("dominance"))


@query(f"WITH {TR} SELECT subject, kind, side, round(median(rt), 6) AS median, round(avg(rt), 6) AS mean, count(*) AS n FROM tr GROUP BY 1, 2, 3 HAVING count(*) > 1900")
def a39_rt_by_condition(spark, d):
    return su.rt_by_condition(_trials(spark, d), ["subject", "kind", "side"], "rt", 1900).select("subject", "kind", "side", r6("median").alias("median"), r6("mean").alias("mean"), "n")


@query(f"WITH {TR}, p AS (SELECT subject, median(rt) AS p FROM tr GROUP BY 1), m AS (SELECT subject, kind, median(rt) AS m FROM tr GROUP BY 1, 2) SELECT subject, kind, round(m - p, 6) AS difference, round(m / p, 6) AS ratio FROM m JOIN p USING (subject)")
def a40_relative_rt(spark, d):
    return su.relative_rt(_trials(spark, d), ["subject"], "kind", "rt").select("subject", "kind", r6("difference").alias("difference"), r6("ratio").alias("ratio"))


@query(f"WITH {TR}, n AS (SELECT kind, response, count(*) AS n FROM tr GROUP BY 1, 2) SELECT kind, round(max(n) / sum(n), 6) AS accuracy FROM n GROUP BY 1")
def a41_baseline_accuracy(spark, d):
    return su.baseline_accuracy(_trials(spark, d), ["kind"], "response").withColumn("accuracy", r6("accuracy"))


@query("WITH x AS (SELECT (p_size - 25) / 5.0 AS l FROM part) SELECT CAST(CASE WHEN l < -4 THEN 0 WHEN l >= 4 THEN 9 ELSE floor(l + 4) + 1 END AS BIGINT) AS bin, round(avg(1 / (1 + exp(-l))), 6) AS p, count(*) AS n FROM x GROUP BY 1")
def a42_binned_calibration(spark, d):
    x = table(spark, d, "part").withColumn("l", (F.col("p_size") - 25) / 5.0)
    return su.binned_calibration(x, "l", -4.0, 4.0, 8).select("bin", r6("p").alias("p"), "n")


@query("""WITH b AS (SELECT range AS bin FROM range(0, 12)), u AS (SELECT CAST(floor(p_size / 5) AS BIGINT) AS bin, arg_min(p_brand, p_partkey) AS region FROM part WHERE p_size < 60 GROUP BY 1) SELECT bin, coalesce(region, '0') AS region FROM b LEFT JOIN u USING (bin)""")
def a43_region_per_depth(spark, d):
    return su.region_per_depth(table(spark, d, "part"), "p_partkey", "p_size", "p_brand", [5.0 * k for k in range(13)])


@query(f"WITH {PTS}, i AS (SELECT session, v, row_number() OVER (PARTITION BY session ORDER BY t, id) - 1 AS i FROM pts) SELECT session, i // 4 AS block, round(avg(v), 6) AS mean FROM i GROUP BY 1, 2")
def a44_block_mean(spark, d):
    p = points(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("session").orderBy("t", "id")) - 1)
    return su.block_mean(p, ["session"], "i", "v", 4).withColumn("mean", r6("mean"))


@query(f"""WITH {PTS}, c AS (SELECT session, t / 86400 AS day, v FROM pts) SELECT session, CAST(CASE WHEN day > 0 AND day < 7 THEN 0 WHEN day > 7 AND day < 21 THEN 1 WHEN day > 21 AND day < 40 THEN 2 END AS INT) AS bin, round(avg(v), 6) AS mean FROM c WHERE (day > 0 AND day < 7) OR (day > 7 AND day < 21) OR (day > 21 AND day < 40) GROUP BY 1, 2""")
def a45_binned_mean(spark, d):
    p = points(spark, d).withColumn("day", F.col("t") / 86400)
    return su.binned_mean(p, ["session"], "day", "v", [0.0, 7.0, 21.0, 40.0]).withColumn("mean", r6("mean"))


@query(f"WITH {CAT} SELECT subject, min(expDate) AS first_day, max(expDate) AS last_day FROM cat GROUP BY 1")
def a46_date_extent(spark, d):
    return su.date_extent(catalog(spark, d), ["subject"], "expDate")


@query(f"WITH {TR} SELECT subject - 2 AS power, level, round(avg(CASE WHEN response = 2 THEN 1.0 ELSE 0 END), 6) AS mean, count(*) AS n FROM tr WHERE response > 0 GROUP BY 1, 2")
def a47_power_curve(spark, d):
    t = _trials(spark, d).where("response > 0").withColumn("power", F.col("subject") - 2)
    return su.condition_mean(t, ["power", "level"], (F.col("response") == 2).cast("double")).withColumn("mean", r6("mean"))


@query("""WITH r AS (SELECT p_brand, count(*) AS n, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0 END) AS s FROM part GROUP BY 1 HAVING count(*) > 30), q AS (SELECT unnest(['Brand#11', 'Brand#22', 'Brand#99']) AS p_brand) SELECT p_brand, coalesce(n, 0) AS n, round(coalesce(s, 0), 6) AS share FROM q LEFT JOIN r USING (p_brand)""")
def a48_region_fractions(spark, d):
    return su.region_fractions(table(spark, d, "part"), "p_brand", "p_size", 25, 30, ["Brand#11", "Brand#22", "Brand#99"]).withColumn("share", r6("share"))


@query(f"WITH {CAT} SELECT subject, count(DISTINCT o_orderkey) AS n_sessions, count(DISTINCT expDate) AS n_days FROM cat GROUP BY 1")
def a49_subject_counts(spark, d):
    return su.subject_counts(catalog(spark, d), "subject", "o_orderkey", "expDate")


def _taps_sql(sigma: float) -> str:
    return ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in ra.gaussian_kernel(sigma))


@query(f"WITH {RASTER}, tap(k, w) AS (VALUES {_taps_sql(1.0)}) SELECT a.event, a.unit, a.bin, round(sum(b.n * w), 6) AS smooth FROM ras a CROSS JOIN tap JOIN ras b ON b.event = a.event AND b.unit = a.unit AND b.bin = a.bin - k GROUP BY 1, 2, 3")
def w13_smooth_counts(spark, d):
    return ra.smooth_counts(_raster(spark, d).drop("session"), ["event", "unit"], 1.0).withColumn("smooth", r6("smooth"))
