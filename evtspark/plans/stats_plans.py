"""Statistics and fits over events, lineitem, embeddings and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtspark.operators import fits as fi
from evtspark.operators import stats as st
from evtspark.plans.registry import PTS, REFS, first_component, points, query, r6, refs, table
from evtspark.plans.summary_plans import RASTER, TR, _long, _raster, _trials

N = 20


def _h(row: str, s: str = "s") -> str:
    return f"(({row} * 7919 + 104729) * ({s} * 2 + 1) * 31 + {s} * 15485863) % 1000003"


SHUF = f"sh AS (SELECT s::BIGINT AS s FROM range(0, {N + 1}) g(s))"
STAT_P = "ob AS (SELECT k, stat AS observed FROM st WHERE s = 0) SELECT k, round(observed, 6) AS observed, round(avg(CASE WHEN st.stat > observed THEN 1.0 ELSE 0 END), 6) AS p FROM st JOIN ob USING (k) WHERE s > 0 GROUP BY 1, 2"


@query(f"""WITH {RASTER}, {SHUF}, tl AS (SELECT DISTINCT unit AS k, event, CASE WHEN event % 3 = 0 THEN 1 ELSE 0 END AS s1 FROM ras), sz AS (SELECT k, least(sum(s1), sum(1 - s1)) AS n FROM tl GROUP BY 1),
 fs AS (SELECT * FROM (SELECT tl.*, n, row_number() OVER (PARTITION BY tl.k, s1 ORDER BY event) AS r FROM tl JOIN sz USING (k)) WHERE r <= n),
 tr_ AS (SELECT fs.*, s, CASE WHEN s = 0 THEN s1 = 1 ELSE row_number() OVER (PARTITION BY k, s ORDER BY CASE WHEN s = 0 THEN 0 ELSE {_h('event')} END, event) <= n END AS lab FROM fs, sh),
 m AS (SELECT k, s, lab, bin, avg(ras.n) AS m FROM ras JOIN tr_ ON tr_.k = ras.unit AND tr_.event = ras.event GROUP BY 1, 2, 3, 4), st AS (SELECT k, s, max(abs(m)) FILTER (lab) - max(abs(m)) FILTER (NOT lab) AS stat FROM m GROUP BY 1, 2), {STAT_P}""")
def m1_response_test(spark, d):
    r = _raster(spark, d).drop("session")
    return st.response_test(r.withColumnRenamed("unit", "k"), ["k"], "event", F.col("event") % 3 == 0, "n", N).select("k", r6("observed").alias("observed"), r6("p").alias("p"))


@query(f"""WITH {TR}, {SHUF}, q AS (SELECT subject AS k, kind, level, trial * 10 + ln AS rid, CASE WHEN response = 2 THEN 1 ELSE 0 END AS a, pk % 97 AS v FROM tr WHERE response > 0),
 b AS (SELECT k, kind, level, sum(a) AS na, count(*) AS nn FROM q GROUP BY 1, 2, 3 HAVING min(a) = 0 AND max(a) = 1), r AS (SELECT q.*, na, nn, rank() OVER (PARTITION BY k, kind, level ORDER BY v) + (count(*) OVER (PARTITION BY k, kind, level, v) - 1) / 2.0 AS rk FROM q JOIN b USING (k, kind, level)),
 t AS (SELECT r.*, s, CASE WHEN s = 0 THEN a = 1 ELSE row_number() OVER (PARTITION BY k, kind, level, s ORDER BY CASE WHEN s = 0 THEN 0 ELSE {_h('rid')} END, rid) <= na END AS i FROM r, sh),
 u AS (SELECT k, kind, level, s, nn, sum(rk) FILTER (i) - na * (na + 1) / 2.0 AS u FROM t GROUP BY k, kind, level, s, nn, na), w AS (SELECT k, s, sum(u) / sum(nn) AS u FROM u GROUP BY 1, 2), o AS (SELECT k, u AS o FROM w WHERE s = 0)
 SELECT k, round(o, 6) AS u, round((count(*) FILTER (w.u < o) + 1) / (count(*) + 1), 6) AS p FROM w JOIN o USING (k) WHERE s > 0 GROUP BY 1, o""")
def m2_combined_condition_u(spark, d):
    t = _trials(spark, d).where("response > 0").select(F.col("subject").alias("k"), "kind", "level", (F.col("trial") * 10 + F.col("ln")).alias("rid"), "response", (F.col("pk") % 97).alias("v"))
    return st.combined_condition_u(t, ["k"], ["kind", "level"], F.col("response") == 2, "v", "rid", N).select("k", r6("u").alias("u"), r6("p").alias("p"))


@query(f"""WITH {PTS}, {REFS}, n AS (SELECT r.id AS event, p.unit, count(*) FILTER (p.t >= r.t) AS po, count(*) FILTER (p.t < r.t) AS pr FROM refs r JOIN pts p ON p.session = r.session AND p.unit IN ('click', 'view') AND p.t BETWEEN r.t - 21600 AND r.t + 43200 GROUP BY 1, 2),
 d AS (SELECT unit, po / 43200.0::DOUBLE - pr / 21600.0::DOUBLE AS dd FROM n), e AS (SELECT unit, dd, round(abs(dd), 12) AS ab FROM d WHERE dd <> 0), r AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY ab) + (count(*) OVER (PARTITION BY unit, ab) - 1) / 2.0 AS rk FROM e)
 , ti AS (SELECT unit, sum(t * t * t - t) AS c FROM (SELECT unit, ab, count(*)::DOUBLE AS t FROM e GROUP BY 1, 2) GROUP BY 1), w AS (SELECT unit, coalesce(sum(rk) FILTER (dd > 0), 0)::DOUBLE AS w, count(*) AS n FROM r GROUP BY 1)
 SELECT unit, round(w, 6) AS w_plus, n, round((w - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - c / 48), 6) AS z FROM w JOIN ti USING (unit)""")
def m3_paired_pre_post(spark, d):
    ev = refs(spark, d).select("session", F.col("id").alias("event"), F.col("t").alias("t0"))
    p = points(spark, d).where("unit IN ('click', 'view')").select("session", "unit", "t")
    return st.paired_pre_post(p, ev, ["session"], [], "unit", "event", 21600.0, 43200.0).select("unit", r6("w_plus").alias("w_plus"), "n", r6("z").alias("z"))


@query(f"""WITH {RASTER}, {SHUF}, ev AS (SELECT unit AS k, event, sum(n) AS v FROM ras GROUP BY 1, 2), sz AS (SELECT k, count(*) FILTER (event % 2 = 0) AS n FROM ev GROUP BY 1),
 t AS (SELECT ev.*, s, CASE WHEN s = 0 THEN event % 2 = 0 ELSE row_number() OVER (PARTITION BY k, s ORDER BY CASE WHEN s = 0 THEN 0 ELSE {_h('event')} END, event) <= n END AS i FROM ev JOIN sz USING (k), sh), st AS (SELECT k, s, abs(avg(v) FILTER (i) - avg(v) FILTER (NOT i)) AS stat FROM t GROUP BY 1, 2), {STAT_P}""")
def m4_permute_labels_test(spark, d):
    v = _raster(spark, d).groupBy(F.col("unit").alias("k"), "event").agg(F.sum("n").alias("v"))
    return st.difference_test(v, ["k"], "event", F.col("event") % 2 == 0, "v", N).select("k", r6("observed").alias("observed"), r6("p").alias("p"))


@query(f"""WITH {PTS}, b AS (SELECT session % 12 AS session, unit, CAST(floor(t / 86400) AS BIGINT) AS bin, count(*)::DOUBLE AS x FROM pts WHERE unit IN ('click', 'view') GROUP BY 1, 2, 3), y AS (SELECT session % 12 AS session, CAST(floor(t / 86400) AS BIGINT) AS bin, avg(v) AS y FROM pts WHERE unit = 'purchase' GROUP BY 1, 2),
 r AS (SELECT b.session, b.unit, y.session AS o, round(corr(x, y), 9) AS r FROM b JOIN y USING (bin) GROUP BY 1, 2, 3), w AS (SELECT session, unit, r AS own FROM r WHERE session = o AND r IS NOT NULL)
 SELECT w.session, w.unit, round(own, 6) AS own, round(avg(CASE WHEN abs(r.r) > abs(own) THEN 1.0 ELSE 0 END), 6) AS p FROM w JOIN r ON r.session = w.session AND r.unit = w.unit AND r.o <> r.session AND r.r IS NOT NULL GROUP BY 1, 2, 3""")
def m5_session_permutation_corr(spark, d):
    p = points(spark, d).withColumn("session", F.col("session") % 12).withColumn("bin", F.floor(F.col("t") / 86400))
    x = p.where("unit IN ('click', 'view')").groupBy("session", "unit", "bin").agg(F.count("*").cast("double").alias("x"))
    y = p.where("unit = 'purchase'").groupBy("session", "bin").agg(F.avg("v").alias("y"))
    return st.session_permutation_corr(x, y, "session", "unit", "bin", "x", "y").select("session", "unit", r6("own").alias("own"), r6("p").alias("p"))


@query(f"""WITH {PTS}, {SHUF}, q AS (SELECT unit AS k, id, v, id % 3 = 0 AS a FROM pts), sz AS (SELECT k, count(*) FILTER (a) AS n FROM q GROUP BY 1), t AS (SELECT q.*, s, CASE WHEN s = 0 THEN a ELSE row_number() OVER (PARTITION BY k, s ORDER BY CASE WHEN s = 0 THEN 0 ELSE {_h('id')} END, id) <= n END AS i FROM q JOIN sz USING (k), sh),
 st AS (SELECT k, s, abs(avg(v) FILTER (i) - avg(v) FILTER (NOT i)) AS stat FROM t GROUP BY 1, 2), {STAT_P}""")
def m6_lr_permutation_test(spark, d):
    p = points(spark, d).withColumnRenamed("unit", "k")
    return st.difference_test(p, ["k"], "id", F.col("id") % 3 == 0, "v", N).select("k", r6("observed").alias("observed"), r6("p").alias("p"))


@query(f"""SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id', '1')}, doc_id) - 1) % 5 AS fold FROM labels""")
def m7_cv_split(spark, d):
    return st.cv_split(table(spark, d, "labels"), ["quality"], "doc_id", 5).select("doc_id", F.col("fold").cast("long").alias("fold"))


@query("SELECT doc_id, ntile(4) OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS fold FROM labels")
def m7_contiguous_folds(spark, d):
    return st.contiguous_folds(table(spark, d, "labels"), ["toxic"], "doc_id", 4).select("doc_id", F.col("fold").cast("long").alias("fold"))


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
 SELECT l_returnflag, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def m25_rank_corr(spark, d):
    return st.rank_corr(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("rho", r6("rho"))


@query(f"""WITH {PTS}, {SHUF}, t AS (SELECT unit, s, v, percent_rank() OVER (PARTITION BY unit, s ORDER BY {_h('id')}, id) AS p FROM pts, sh WHERE s > 0) SELECT unit, CAST(s AS INT) AS shuffle, round(avg(v), 6) AS mean FROM t WHERE p < 0.5 GROUP BY 1, 2""")
def m26_resample_latencies(spark, d):
    return st.resample_latencies(points(spark, d), ["unit"], "id", "v", N).withColumn("mean", r6("mean"))


@query("SELECT l_returnflag, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t, count(*) AS n FROM lineitem GROUP BY 1")
def m27_paired_t(spark, d):
    return st.paired_t(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax").withColumn("t", r6("t")).drop("p")


@query("""WITH p AS (SELECT l_returnflag, l_linenumber, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT l_returnflag, sum(n * m) / sum(n) AS g, sum(n) AS t, count(*) AS k FROM p GROUP BY 1)
 SELECT l_returnflag, round((sum(n * (m - g) ** 2) / (k - 1)) / (sum(n * v) / (t - k)), 6) AS f, k - 1 AS df_between, CAST(t - k AS BIGINT) AS df_within FROM p JOIN g USING (l_returnflag) GROUP BY l_returnflag, k, t""")
def m28_one_way_anova(spark, d):
    return st.one_way_anova(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber", "l_extendedprice").withColumn("f", r6("f")).drop("p")


DESIGN = f"""{PTS}, ev AS (SELECT session % 6 AS session, unit AS feature, CAST(floor(t / 21600) AS BIGINT) AS bin, v / 100 AS value FROM pts WHERE unit IN ('purchase', 'click')),
 des AS (SELECT session, bin + lag AS bin, feature || '@' || CASE WHEN lag < 0 THEN '-' ELSE '+' END || lpad(abs(lag)::VARCHAR, 3, '0') AS feature, sum(value) AS value FROM ev, (SELECT unnest([-1, 0, 1]) AS lag) GROUP BY 1, 2, 3 HAVING sum(value) <> 0)"""


def _design(spark, d):
    p = points(spark, d).where("unit IN ('purchase', 'click')")
    ev = p.select((F.col("session") % 6).alias("session"), F.col("unit").alias("feature"), F.floor(F.col("t") / 21600).alias("bin"), (F.col("v") / 100).alias("value"))
    return fi.event_design(ev, ["session"], "feature", "bin", "value", (-1, 1))


def _counts(spark, d):
    p = points(spark, d).where("unit NOT IN ('purchase', 'click')").withColumn("session", F.col("session") % 6)
    return p.groupBy("session", F.floor(F.col("t") / 21600).alias("bin"), "unit").agg(F.count("*").cast("double").alias("y"))


def _folded(df):
    return df.withColumn("fold", F.col("bin") % 2)


@query(f"WITH {DESIGN} SELECT session, bin, feature, round(value, 6) AS value FROM des")
def m9_event_design(spark, d):
    return _design(spark, d).withColumn("value", r6("value"))


@query(f"WITH {DESIGN} SELECT a.session, a.bin % 2 AS fold, a.feature AS f1, b.feature AS f2, round(sum(a.value * b.value), 6) AS g FROM des a JOIN des b ON a.session = b.session AND a.bin = b.bin GROUP BY 1, 2, 3, 4")
def m10_gram(spark, d):
    return fi.gram(_folded(_design(spark, d)), ["session"]).withColumn("g", r6("g"))


@query()
def m10_ridge_fit(spark, d):
    return fi.ridge_fit(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", [0.1, 1.0, 10.0])


@query()
def m10_lasso_fit(spark, d):
    return fi.ridge_fit(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", [0.01, 0.1], kind="lasso")


@query()
def m11_reduced_rank_fit(spark, d):
    return fi.ridge_fit(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", [1.0], rank=1)


@query()
def m12_kernel_significance(spark, d):
    return fi.kernel_significance(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", [1.0], ["purchase", "click"])


@query("""SELECT l_orderkey AS session, l_returnflag || '@' || (l_linenumber - 4) AS feature, round(avg(l_discount), 6) AS coef, l_returnflag AS event, l_linenumber - 4 AS lag FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linenumber""")
def m13_kernel_table(spark, d):
    """Coefficients of lags before and after events told apart."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session"), F.concat_ws("@", "l_returnflag", (F.col("l_linenumber") - 4).cast("int")).alias("feature"))
    return fi.response_kernels(li.agg(r6(F.avg("l_discount")).alias("coef")))


@query()
def m13_response_kernels(spark, d):
    return fi.response_kernels(fi.ridge_fit(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", [1.0]))


@query(f"""WITH {TR}, c AS (SELECT subject, kind, level, trial % 2 AS fold, avg(rt) AS y FROM tr GROUP BY 1, 2, 3, 4),
 m AS (SELECT *, avg(y) OVER (PARTITION BY subject, kind) AS v, avg(y) OVER (PARTITION BY subject, level) AS a, avg(y) OVER (PARTITION BY subject) AS g FROM c WHERE fold = 0),
 j AS (SELECT m.subject, t.y, unnest(['full', 'vis', 'aud', 'additive', 'baseline']) AS model, unnest([m.y, m.v, m.a, m.v + m.a - m.g, m.g]) AS p FROM m JOIN c t ON t.subject = m.subject AND t.kind = m.kind AND t.level = m.level AND t.fold = 1)
 SELECT subject, model, round(1 - var_pop(y - p) / var_pop(y), 6) AS ve FROM j GROUP BY 1, 2""")
def m8_additive_models(spark, d):
    """The SQL's means are the designs' fits where every subject has all cells, as here."""
    t = _trials(spark, d).groupBy("subject", "kind", "level", (F.col("trial") % 2).alias("fold")).agg(F.avg("rt").alias("rt"))
    return fi.additive_models(t, ["subject"], "kind", "level", "rt").withColumn("ve", r6("ve"))


@query()
def m14_fit_tuning(spark, d):
    c = _raster(spark, d).groupBy("unit", "bin").agg(F.avg("n").alias("n"))
    return fi.fit_tuning(c, ["unit"], "bin", "n")


@query()
def m14_tuning_folds(spark, d):
    """Curves of even events fitted, those of even and of odd ones explained."""
    c = _raster(spark, d).withColumn("fold", F.col("event") % 2).groupBy("unit", "bin", "fold").agg(F.avg("n").alias("n"))
    return fi.fit_tuning(c, ["unit"], "bin", "n", fold="fold")


@query()
def m15_fit_rf(spark, d):
    e = _long(spark, d).groupBy("label", (F.col("pix") % 8).alias("x"), F.floor(F.col("pix") / 8).alias("y")).agg(F.avg("x").alias("z"))
    return fi.fit_rf(e, ["label"], "x", "y", "z")


def _pc1_sql(trial: str) -> str:
    """w(unit, trial, weight), weights of the trials that ``trial`` numbers; the raster has all six bins of a trial."""
    return f"""WITH RECURSIVE {RASTER}, cells AS (SELECT unit, {trial} AS trial, bin, sum(n)::DOUBLE AS n FROM ras GROUP BY 1, 2, 3),
 pairs AS (SELECT a.unit, a.bin * 6 + b.bin AS e, sum(a.n * b.n) AS x FROM cells a JOIN cells b ON a.unit = b.unit AND a.trial = b.trial GROUP BY 1, 2), gram AS (SELECT unit, list(x ORDER BY e) AS m FROM pairs GROUP BY 1),
 {first_component("pc", "gram", "unit", 6)}, s AS (SELECT unit, trial, abs(sum(n * v[bin + 1])) AS s FROM cells JOIN pc USING (unit) GROUP BY 1, 2),
 w AS (SELECT unit, trial, s / sqrt(sum(s * s) OVER (PARTITION BY unit)) AS weight FROM s)"""


@query(_pc1_sql("event % 50") + " SELECT unit, trial, round(weight, 6) AS weight FROM w")
def m16_pc1_weights(spark, d):
    """Trials are numbered anew from 0 to 49; the rasters of one number are added."""
    r = _raster(spark, d).groupBy("unit", (F.col("event") % 50).alias("trial"), "bin").agg(F.sum("n").alias("n"))
    return fi.pc1_weights(r, ["unit"], "trial", "n").withColumn("weight", r6("weight"))


@query(_pc1_sql("event") + " SELECT unit, trial % 7 AS azimuth, round(avg(weight), 6) AS weight FROM w GROUP BY 1, 2")
def m16_mean_weights(spark, d):
    r = _raster(spark, d).groupBy("unit", "event", "bin").agg(F.sum("n").alias("n"))
    trials = r.select("event", (F.col("event") % 7).alias("azimuth")).distinct()
    return fi.mean_weights(fi.pc1_weights(r, ["unit"], "event", "n"), trials, ["unit"], "event", "azimuth").withColumn("weight", r6("weight"))


@query(f"""WITH {TR} SELECT subject, round((avg(rt) FILTER (kind = 'coherent') - avg(rt) FILTER (kind = 'visual') - avg(rt) FILTER (kind = 'auditory')) / sqrt(var_pop(rt) FILTER (kind = 'visual') + var_pop(rt) FILTER (kind = 'auditory')), 6) AS "index" FROM tr GROUP BY 1""")
def m17_enhancement_index(spark, d):
    return fi.enhancement_index(_trials(spark, d), ["subject"], "kind", "rt").withColumn("index", r6("index"))


def _cells(spark, d, cond="true"):
    t = _trials(spark, d).where("response > 0").where(cond)
    vis = (F.col("level") - 2) / 4.0
    return t.groupBy("subject", vis.alias("vis"), (F.col("side") * 2 - 3).cast("double").alias("aud")).agg(F.sum((F.col("response") == 2).cast("double")).alias("n_right"), F.count("*").cast("double").alias("n"))


@query()
def m18_choice_glm(spark, d):
    return fi.choice_glm(_cells(spark, d), ["subject"], [0.5, 1.0, 2.0])


@query()
def m19_glm_compare(spark, d):
    return fi.glm_compare(_cells(spark, d, "pk % 3 > 0"), _cells(spark, d, "pk % 3 = 0"), ["subject"], [1.0])


@query()
def m19_bilateral_additivity(spark, d):
    t = _trials(spark, d).where("response > 0").withColumns({"place": (F.col("pk") % 3 - 1).cast("int"), "laser": F.col("ln") % 2 == 0})
    cells = t.groupBy("subject", "place", "laser", ((F.col("level") - 2) / 4.0).alias("vis"), (F.col("side") * 2 - 3).cast("double").alias("aud"))
    cells = cells.agg(F.sum((F.col("response") == 2).cast("double")).alias("n_right"), F.count("*").cast("double").alias("n"))
    return fi.bilateral_additivity(cells, ["subject"], "place", "laser", [1.0])


@query()
def m20_neurometric_fit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"), F.size(F.split("text", "\n")).cast("double").alias("lines"), F.length(F.regexp_replace("text", "[a-z ]", "")).cast("double").alias("other"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").withColumn("fold", F.col("doc_id") % 2)
    return fi.neurometric_fit(rows, ["n", "lines", "other"], "quality", "fold")


@query(f"""WITH {PTS}, {REFS}, p AS (SELECT session, unit, t FROM pts WHERE unit IN ('click', 'view')), u AS (SELECT DISTINCT session, unit FROM p),
 c AS (SELECT r.session, r.id AS event, u.unit, (SELECT count(*) FROM p WHERE p.session = r.session AND p.unit = u.unit AND p.t >= r.t AND p.t < r.t + 21600.0) / 21600.0 AS rate FROM refs r JOIN u USING (session)),
 z AS (SELECT session, event, unit, (rate - avg(rate) OVER (PARTITION BY session, unit)) / nullif(stddev_pop(rate) OVER (PARTITION BY session, unit), 0) AS z FROM c)
 SELECT r.session, r.id AS event, round(r.t, 6) AS t0, round(coalesce(max(z) FILTER (z.unit = 'click'), 0), 6) AS click, round(coalesce(max(z) FILTER (z.unit = 'view'), 0), 6) AS view FROM refs r LEFT JOIN z ON z.session = r.session AND z.event = r.id GROUP BY 1, 2, 3""")
def m21_predictor_table(spark, d):
    from evtspark.operators.raster import raster_counts
    from evtspark.plans.summary_plans import _ev, _pts

    rates = raster_counts(_pts(spark, d), _ev(spark, d), ["session"], 0.0, 21600.0, 21600.0, rate=True)
    found = fi.predictor_table(_ev(spark, d), rates, ["session"], "event", "unit", ["click", "view"])
    return found.select("session", "event", *[r6(c).alias(c) for c in ("t0", "click", "view")])


@query()
def m22_windowed_decoding(spark, d):
    r = _raster(spark, d)
    trials = r.select("session", "event").distinct().withColumn("y", (F.col("event") % 2).cast("double"))
    return fi.windowed_decoding(r, trials, ["session"], "event", "unit", "y", 3, 1, 6)
