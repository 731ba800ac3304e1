"""Catalogue, unit and trial selection over customer (subjects), orders (sessions), part (units) and lineitem (trials)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtspark.operators import selection as sel
from evtspark.plans.registry import PTS, points, query, r6, table

NOW = "2001-01-01"
CAT = """cat AS (SELECT o_orderkey, o_custkey AS subject, strftime(o_orderdate, '%Y-%m-%d') AS expDate, o_orderkey % 5 AS expNum, o_orderpriority AS expDef, o_orderstatus AS flag, o_orderkey % 3 || ',' || o_orderkey % 2 AS probes FROM orders)"""
MAIN = """main AS (SELECT c_custkey AS subject, CAST(c_custkey % 2 AS VARCHAR) AS IsActive, CASE WHEN c_custkey % 3 = 0 THEN 'P3B' ELSE 'P24' END AS P0_type,
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE (1995 + c_custkey % 5) || '-06-15' END AS P0_implantDate, c_mktsegment AS grp FROM customer)"""


def catalog(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", F.col("o_custkey").alias("subject"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("expDate"), (F.col("o_orderkey") % 5).alias("expNum"),
        F.col("o_orderpriority").alias("expDef"), F.col("o_orderstatus").alias("flag"),
        F.concat_ws(",", (F.col("o_orderkey") % 3).cast("string"), (F.col("o_orderkey") % 2).cast("string")).alias("probes"),
    )


def main(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("subject"), (k % 2).cast("string").alias("IsActive"), F.when(k % 3 == 0, "P3B").otherwise("P24").alias("P0_type"),
        F.when(k % 4 == 0, "").otherwise(F.concat((1995 + k % 5).cast("string"), F.lit("-06-15"))).alias("P0_implantDate"), F.col("c_mktsegment").alias("grp"),
    )


def _keys(df):
    return df.select("o_orderkey")


@query(f"WITH {CAT}, {MAIN} SELECT o_orderkey FROM cat WHERE subject IN (SELECT subject FROM main WHERE IsActive = '1')")
def p1_select_active_subjects(spark, d):
    return _keys(sel.select_subjects(catalog(spark, d), main(spark, d), "allActive"))


@query(f"WITH {CAT}, {MAIN} SELECT o_orderkey FROM cat WHERE subject IN (SELECT subject FROM main WHERE regexp_matches(P0_implantDate, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND P0_type <> 'P3B')")
def p1_select_implanted_subjects(spark, d):
    return _keys(sel.select_subjects(catalog(spark, d), main(spark, d), "implanted"))


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE expDate BETWEEN '1997-01-01' AND '1997-12-31'")
def p2a_select_date_range(spark, d):
    return _keys(sel.select_dates(catalog(spark, d), "1997-01-01:1997-12-31", NOW))


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE expDate::DATE >= DATE '2001-01-01' - 400")
def p2a_select_previous_days(spark, d):
    return _keys(sel.select_dates(catalog(spark, d), "previous400", NOW))


@query(f"WITH {CAT}, r AS (SELECT o_orderkey, dense_rank() OVER (PARTITION BY subject ORDER BY expDate DESC) AS r FROM cat) SELECT o_orderkey FROM r WHERE r <= 2")
def p2b_last_dates(spark, d):
    return _keys(sel.last_dates(catalog(spark, d), 2, ["subject"]))


@query(f"WITH {CAT}, r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY subject ORDER BY expDate, o_orderkey) AS r FROM cat) SELECT o_orderkey FROM r WHERE r <= 3")
def p2b_first_rows(spark, d):
    return _keys(sel.last_rows(catalog(spark, d), 3, ["subject"], ["expDate", "o_orderkey"], first=True))


@query(f"WITH {CAT}, {MAIN} SELECT o_orderkey, date_diff('day', P0_implantDate::DATE, expDate::DATE) AS days_since_implant FROM cat JOIN (SELECT * FROM main WHERE P0_implantDate <> '') m USING (subject) WHERE expDate >= P0_implantDate")
def p2c_post_implant(spark, d):
    return sel.post_implant(catalog(spark, d), main(spark, d)).select("o_orderkey", "days_since_implant")


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE date_diff('day', expDate::DATE, DATE '{NOW}') <= 365")
def p2d_last_days(spark, d):
    return _keys(sel.last_days(catalog(spark, d), 365, NOW))


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE regexp_matches(expDef, '^1') OR regexp_matches(expDef, 'LOW')")
def p3_select_protocol_regex(spark, d):
    return _keys(sel.select_protocol(catalog(spark, d), ["^1", "LOW"]))


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE lower(expDef) IN ('1-urgent', '5-low')")
def p3_select_protocol_alias(spark, d):
    return _keys(sel.select_protocol(catalog(spark, d), ["u", "5-LOW"], regex=False, aliases={"u": ["1-URGENT"]}))


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE expNum IN (1, 3)")
def p4_select_numbers(spark, d):
    return _keys(sel.select_numbers(catalog(spark, d), [1, 3]))


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE contains(probes, '1')")
def p5_select_status(spark, d):
    return _keys(sel.select_status(catalog(spark, d), "probes", "1"))


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE NOT contains(flag, 'F')")
def p5_select_status_not(spark, d):
    return _keys(sel.select_status(catalog(spark, d), "flag", "~F"))


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE contains(flag || probes, '2')")
def p6_select_align_any(spark, d):
    return _keys(sel.select_align_any(catalog(spark, d), ["flag", "probes"], "2"))


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE contains(expDef, 'MED')")
def p7_select_rig(spark, d):
    return _keys(sel.select_rig(catalog(spark, d), "MED", "expDef"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def p8_filter_rows(spark, d):
    li = table(spark, d, "lineitem")
    return sel.filter_rows(li, (F.col("l_quantity") > 45) & (F.col("l_discount") < 0.02)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT p_brand FROM part GROUP BY 1 HAVING avg(CASE WHEN contains(p_type, 'A') THEN 1.0 ELSE 0 END) > 0.5")
def p9_session_in_region(spark, d):
    return sel.session_in_region(table(spark, d, "part"), ["p_brand"], "p_type", "A", 0.5)


@query("""WITH u AS (SELECT p_partkey, ['SCs', 'SCop', 'SCzo', 'SCiw', 'SCdg', 'MRN'][1 + p_partkey % 6] AS a FROM part)
 SELECT p_partkey, CASE WHEN contains(a, 'SCs') OR contains(a, 'SCo') OR contains(a, 'SCzo') THEN 'SCs' WHEN contains(a, 'SCi') THEN 'SCi' WHEN contains(a, 'SCd') THEN 'SCd' ELSE 'nontarget' END AS region FROM u""")
def p10_region_3class(spark, d):
    names = F.array(*[F.lit(x) for x in ("SCs", "SCop", "SCzo", "SCiw", "SCdg", "MRN")])
    a = F.get(names, (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", sel.region_3class(a).alias("region"))


@query("""SELECT p_partkey, CASE WHEN p_size > 45 OR coalesce(p_retailprice > 1900, false) THEN 'noise' WHEN p_size > 10 AND coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END >= 1000, false) THEN 'good' ELSE 'mua' END AS quality FROM part""")
def p11_unit_quality(spark, d):
    u = table(spark, d, "part").withColumn("snr", F.when(F.col("p_partkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")))
    return sel.unit_quality(u, {"p_size": (">", 45), "p_retailprice": (">", 1900)}, {"p_size": (">", 10), "snr": (">=", 1000)}).select("p_partkey", "quality")


#: Order lines as trials: answer by return flag, sides and levels from quantity and discount.
TR = """tr AS (SELECT l_orderkey AS session, l_linenumber AS trial, l_partkey AS pk, l_suppkey % 2 = 0 AS valid, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS resp,
 (l_partkey % 3 - 1) * 30.0::DOUBLE + 30 * (l_suppkey % 3 - 1) AS aud, CAST(l_quantity AS INT) % 5 / 10.0::DOUBLE AS contrast, (l_suppkey % 3 - 1) * 60.0::DOUBLE AS vis_az, l_tax AS rt, l_discount AS d, l_extendedprice AS price FROM lineitem)"""


def trials(spark, d):
    li = table(spark, d, "lineitem")
    resp = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    side = (F.col("l_suppkey") % 3 - 1).cast("double")
    return li.select(
        F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("trial"), F.col("l_partkey").alias("pk"), (F.col("l_suppkey") % 2 == 0).alias("is_validTrial"), resp.alias("response_direction"),
        ((F.col("l_partkey") % 3 - 1).cast("double") * 30 + 30 * side).alias("stim_audAzimuth"), (F.col("l_quantity").cast("int") % 5 / F.lit(10.0)).alias("stim_visContrast"), (side * 60).alias("stim_visAzimuth"),
        F.col("l_tax").alias("rt"), F.col("l_discount").alias("d"), F.col("l_extendedprice").alias("price"),
    )


@query(f"WITH {TR} SELECT session, trial, pk FROM tr WHERE valid AND resp <> 0 AND abs(aud) <> 30 AND rt >= 0.02 AND rt <= 0.06")
def p12_valid_active_trials(spark, d):
    return sel.valid_active_trials(trials(spark, d), 0.02, 0.06).select("session", "trial", "pk")


@query(f"WITH {TR} SELECT session, trial, pk FROM tr WHERE valid AND rt IS NOT NULL AND contrast IN (0.1, 0.4)")
def p13_select_trials(spark, d):
    return sel.select_trials(trials(spark, d), "rt", contrast=[0.1, 0.4]).select("session", "trial", "pk")


@query(f"WITH {TR} SELECT session, trial, pk, round(contrast * sign(vis_az), 6) AS visDiff, sign(aud) AS audDiff, round(price / 1000 - least(d, rt), 6) AS rt, round(price / 1000 - d, 6) AS rt_aud FROM tr")
def p14_derive_trials(spark, d):
    t = trials(spark, d).drop("rt").withColumns({"timeline_choiceMoveOn": F.col("price") / 1000, "timeline_audPeriodOn": F.col("d"), "stim_laser1_power": F.lit(None).cast("double"), "stim_laserPosition": F.lit(None).cast("double")})
    t = t.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("trial"), F.col("l_partkey").alias("pk"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("timeline_visPeriodOn")), ["session", "trial", "pk", "price"])
    return sel.derive_trials(t).select("session", "trial", "pk", r6("visDiff").alias("visDiff"), "audDiff", r6("rt").alias("rt"), r6("rt_aud").alias("rt_aud"))


@query(f"""WITH {PTS}, c AS (SELECT session, unit AS camera, count(*) > 12 AS ht, avg(v) > 40 AS hv FROM pts GROUP BY 1, 2),
 r AS (SELECT session, camera, row_number() OVER (PARTITION BY session ORDER BY list_position(['view', 'click', 'purchase'], camera)) AS k FROM c WHERE ht AND hv AND camera IN ('view', 'click', 'purchase')) SELECT session, camera FROM r WHERE k = 1""")
def p15_best_camera(spark, d):
    c = points(spark, d).groupBy("session", F.col("unit").alias("camera")).agg((F.count("*") > 12).alias("has_times"), (F.avg("v") > 40).alias("has_values"))
    return sel.best_camera(c, ["session"], ["view", "click", "purchase"]).select("session", "camera")


@query("""SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS ml, round(embedding[2]::DOUBLE, 6) AS ap, sign(embedding[1]::DOUBLE - 0.01) AS hemi, coalesce(n_name, 'unregistered') AS region FROM embeddings LEFT JOIN nation ON n_nationkey = label * 5""")
def p16_format_units(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("mlapdv"), (F.col("label") * 5).alias("region_id"))
    r = table(spark, d, "nation").select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("region"))
    return sel.format_units(u, r, midline=0.01).select("vec_id", r6("ml").alias("ml"), r6("ap").alias("ap"), "hemi", "region")


_KIND = "CASE WHEN a = 0 AND v = 0 THEN 'blank' WHEN v = 0 THEN 'auditory' WHEN a = 0 THEN 'visual' WHEN a * v > 0 THEN 'coherent' ELSE 'conflict' END"


@query(f"WITH {TR}, k AS (SELECT sign(aud) AS a, sign(vis_az) * contrast AS v FROM tr) SELECT {_KIND} AS kind, count(*) AS n FROM k GROUP BY 1")
def p17_trial_type(spark, d):
    t = trials(spark, d)
    kind = sel.trial_type("task", F.signum("stim_audAzimuth"), F.signum("stim_visAzimuth") * F.col("stim_visContrast"))
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {TR}, k AS (SELECT CASE WHEN trial % 3 = 0 THEN -1000 ELSE aud END AS a, CASE WHEN trial % 4 = 0 THEN -1000 ELSE vis_az END AS v FROM tr)
 SELECT CASE WHEN a = -1000 AND v = -1000 THEN 'noStim' WHEN v = -1000 THEN 'auditory' WHEN a = -1000 THEN 'visual' WHEN a = v THEN 'coherent' ELSE 'conflict' END AS kind, count(*) AS n FROM k GROUP BY 1""")
def p17_trial_type_azimuth(spark, d):
    a = F.when(F.col("trial") % 3 == 0, -1000.0).otherwise(F.col("stim_audAzimuth"))
    v = F.when(F.col("trial") % 4 == 0, -1000.0).otherwise(F.col("stim_visAzimuth"))
    return trials(spark, d).groupBy(sel.trial_type("azimuth", a, v).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {TR} SELECT session, trial, pk, CASE WHEN f = 0 THEN 0 WHEN f > 0 THEN c ELSE 3 - c END AS response FROM (SELECT *, 1 + pk % 2 AS c, trial % 3 - 1 AS f FROM tr)")
def p18_recode_response(spark, d):
    return trials(spark, d).select("session", "trial", "pk", sel.recode_response(1 + F.col("pk") % 2, F.col("trial") % 3 - 1).alias("response"))


@query(f"WITH {TR} SELECT session, trial, pk FROM tr WHERE session IN (SELECT session FROM tr GROUP BY 1 HAVING count(*) FILTER (valid) > 3)")
def p19_session_criteria(spark, d):
    return sel.session_criteria(trials(spark, d), ["session"], F.col("is_validTrial"), 3).select("session", "trial", "pk")


@query(f"WITH {TR}, m AS (SELECT session, count(*) AS n, avg(rt) AS rt FROM tr GROUP BY 1) SELECT session FROM m WHERE n >= 4 AND rt <= 0.045")
def p20_quality_gate(spark, d):
    m = trials(spark, d).groupBy("session").agg(F.count("*").alias("n"), F.avg("rt").alias("rt"))
    return sel.quality_gate(m, {"n": 4}, {"rt": 0.045}).select("session")


@query(f"WITH {CAT}, m AS (SELECT c_custkey AS subject, c_acctbal AS power FROM customer WHERE c_custkey % 3 = 1) SELECT o_orderkey, round(coalesce(power, 0), 6) AS power FROM cat LEFT JOIN m USING (subject)")
def p21_opto_sessions(spark, d):
    m = table(spark, d, "customer").where("c_custkey % 3 = 1").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("power"))
    return sel.attach_default(catalog(spark, d), m, ["subject"], {"power": 0.0}).select("o_orderkey", r6("power").alias("power"))


_RANK = "ev AS (SELECT session, id, t, row_number() OVER (PARTITION BY session ORDER BY t, id) AS trial FROM pts)"


@query(f"WITH {PTS}, {_RANK} SELECT e.id, round(e.t - s.t, 6) AS t, e.trial - 1 AS trial FROM ev e JOIN ev s ON s.session = e.session AND s.trial = 2 WHERE e.trial >= 2")
def p22_drop_first_trial(spark, d):
    from pyspark.sql import Window

    ev = points(spark, d).withColumn("trial", F.row_number().over(Window.partitionBy("session").orderBy("t", "id")))
    starts = ev.select("session", "trial", F.col("t").alias("t_start"))
    return sel.drop_first_trial(ev, starts, ["session"]).select("id", r6("t").alias("t"), F.col("trial").cast("long").alias("trial"))


@query(f"WITH {CAT} SELECT CASE WHEN contains(expDef, 'URGENT') THEN 'task' WHEN contains(expDef, '-') AND contains(expDef, 'LOW') THEN 'passive' WHEN contains(expDef, 'N') THEN 'noise' ELSE 'unknown' END AS class, count(*) AS n FROM cat GROUP BY 1")
def p23_protocol_class(spark, d):
    c = sel.protocol_class(F.col("expDef"), [("URGENT", "task"), ("LOW", "passive"), ("N", "noise")])
    return catalog(spark, d).groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {TR}, k AS (SELECT session, trial, pk, sign(vis_az) * contrast AS vis, sign(aud) AS aud, pk % 5 = 0 AS is_laser FROM tr), n AS (SELECT vis, aud, is_laser, count(*) AS n FROM k GROUP BY 1, 2, 3),
 g AS (SELECT *, dense_rank() OVER (ORDER BY vis, aud, is_laser) AS type_id FROM n WHERE n >= 2)
 SELECT session, trial, pk, greatest(vis, 0) AS visR, greatest(-vis, 0) AS visL, CASE WHEN aud > 0 AND is_laser THEN 1 ELSE 0 END AS audR_opto, type_id FROM k JOIN g USING (vis, aud, is_laser)""")
def p24_glm_predictors(spark, d):
    t = trials(spark, d).select("session", "trial", "pk", (F.signum("stim_visAzimuth") * F.col("stim_visContrast")).alias("vis"), F.signum("stim_audAzimuth").alias("aud"), (F.col("pk") % 5 == 0).alias("is_laser"))
    return sel.glm_predictors(t).select("session", "trial", "pk", "visR", "visL", "audR_opto", "type_id")


@query("SELECT p_partkey, round(p_retailprice * CASE p_brand WHEN 'Brand#11' THEN 2.5 WHEN 'Brand#22' THEN 0.5 ELSE 1 END, 6) AS amp FROM part")
def p25_rescale_amplitude(spark, d):
    u = table(spark, d, "part").withColumn("amp", F.col("p_retailprice"))
    return sel.rescale_amplitude(u, {"Brand#11": 2.5, "Brand#22": 0.5}, "p_brand", "amp").select("p_partkey", r6("amp").alias("amp"))
