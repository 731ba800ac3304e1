"""Signal and window operators over the events, lineitem and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtspark.operators import signal as sg
from evtspark.plans.registry import ORACLE_SQL, PTS, REFS, points, query, r6, refs, table

S = ["session"]
ORDER = ["t", "id"]
W = "(PARTITION BY session ORDER BY t, id)"


def _w(frame: str) -> str:
    return f"(PARTITION BY session ORDER BY t, id ROWS BETWEEN {frame})"


def _trials(spark, d):
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    return one.select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").cast("int").alias("trial"), ((F.col("l_linenumber") - 1) % 3 + 1).cast("int").alias("repeat_num"), flag.alias("response"))


LI = "li AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {LI}, t AS (SELECT l_orderkey AS session, l_linenumber AS trial, (l_linenumber - 1) % 3 + 1 AS rep, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS resp FROM li),
 r AS (SELECT *, sum(CASE WHEN rep = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY trial) AS run, trial = max(trial) OVER (PARTITION BY session) AS is_last FROM t)
 SELECT session, trial, rep = 1 OR coalesce(max(CASE WHEN rep = 1 AND resp = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session, run) = 1
  AND trial = min(CASE WHEN resp <> 0 AND NOT is_last THEN trial END) OVER (PARTITION BY session, run), false) AS valid FROM r""")
def w1_valid_trials(spark, d):
    return sg.valid_trials(_trials(spark, d), S).select("session", "trial", "valid")


@query(f"WITH {PTS} SELECT id, round(last_value(CASE WHEN v > 50 THEN v END IGNORE NULLS) OVER {_w('UNBOUNDED PRECEDING AND CURRENT ROW')}, 6) AS v FROM pts")
def w2_fill_forward(spark, d):
    p = points(spark, d).withColumn("v", F.when(F.col("v") > 50, F.col("v")))
    return sg.fill_forward(p, S, ORDER, "v").select("id", r6("v").alias("v"))


@query(f"""WITH {LI} SELECT l_orderkey AS session, l_linenumber AS trial, coalesce(lag(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS prev_response FROM li""")
def w3_previous_trial(spark, d):
    return sg.previous_trial(_trials(spark, d), S, ["trial"], ["response"]).select("session", "trial", "prev_response")


@query(f"""WITH {LI}, t AS (SELECT l_orderkey AS session, l_linenumber AS trial, l_returnflag = 'R' AS f, coalesce(lag(l_returnflag = 'R') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), false) AS post FROM li)
 SELECT session, trial, post, post AND NOT f AS post_only FROM t""")
def w4_post_flag(spark, d):
    t = _trials(spark, d).withColumn("flag", F.col("response") == 2)
    return sg.post_flag(t, S, ["trial"], "flag").select("session", "trial", "post", "post_only")


@query(f"WITH {PTS} SELECT id, coalesce(sum(CASE WHEN unit = 'view' THEN 1 ELSE 0 END) OVER {_w('1 PRECEDING AND CURRENT ROW')} = 2, false) AS in_run FROM pts")
def w5_run_flag(spark, d):
    p = points(spark, d).withColumn("c", F.col("unit") == "view")
    return sg.run_flag(p, S, ORDER, "c", 2).select("id", "in_run")


@query(f"""WITH {PTS}, c AS (SELECT *, CASE WHEN v > 30 THEN 1 ELSE 0 END AS x FROM pts),
 s AS (SELECT id, session, t, CASE
  WHEN count(*) OVER {_w('UNBOUNDED PRECEDING AND 1 PRECEDING')} >= 2 AND count(*) OVER {_w('CURRENT ROW AND UNBOUNDED FOLLOWING')} >= 1 AND sum(x) OVER {_w('2 PRECEDING AND 1 PRECEDING')} = 2 AND x = 0 THEN 1
  WHEN count(*) OVER {_w('UNBOUNDED PRECEDING AND 1 PRECEDING')} >= 1 AND count(*) OVER {_w('CURRENT ROW AND UNBOUNDED FOLLOWING')} >= 2 AND sum(x) OVER {_w('1 PRECEDING AND 1 PRECEDING')} = 0 AND sum(x) OVER {_w('CURRENT ROW AND 1 FOLLOWING')} = 2 THEN -1 ELSE 0 END AS switch FROM c)
 SELECT id, switch, CAST(sum(abs(switch)) OVER {W} AS BIGINT) AS block FROM s""")
def w6_switch_points(spark, d):
    p = points(spark, d).withColumn("c", F.col("v") > 30)
    return sg.switch_points(p, S, ORDER, "c", 2, 1).select("id", "switch", F.col("block").cast("long").alias("block"))


@query(f"""WITH {PTS}, s AS (SELECT id, session, t, coalesce(last_value(CASE WHEN v > 80 THEN 1 WHEN v < 20 THEN -1 END IGNORE NULLS) OVER {_w('UNBOUNDED PRECEDING AND CURRENT ROW')}, 0) AS state FROM pts),
 b AS (SELECT *, lag(state) OVER {W} AS before FROM s)
 SELECT id, state, coalesce(state <> before AND state <> 0 AND before <> 0, false) AS flip FROM b""")
def w7_schmitt(spark, d):
    return sg.schmitt(points(spark, d), S, ORDER, "v", 20.0, 80.0).select("id", "state", "flip")


@query(f"""WITH {PTS}, e AS (SELECT *, CASE WHEN v > 50 THEN 1 ELSE 0 END AS up FROM pts) SELECT id, coalesce(up - lag(up) OVER {W}, 0) AS edge FROM e""")
def w8_edges(spark, d):
    return sg.edges(points(spark, d), S, ORDER, "v", 50.0).select("id", "edge")


@query(f"""WITH {PTS}, x AS (SELECT id, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS dt FROM pts) SELECT id FROM x WHERE dt IS NULL OR dt >= 3600""")
def w9_debounce(spark, d):
    return sg.debounce(points(spark, d), S, "t", 3600.0).select("id")


@query(f"""WITH {PTS}, p AS (SELECT *, CASE WHEN v > 50 THEN 1 ELSE -1 END AS pol FROM pts), n AS (SELECT *, lag(pol) OVER {W} AS b, lead(pol) OVER {W} AS a FROM p)
 SELECT id, pol FROM n WHERE CASE WHEN pol = 1 THEN coalesce(b <> pol, true) ELSE coalesce(a <> pol, true) END""")
def w10_drop_repeat_polarity(spark, d):
    p = points(spark, d).withColumn("pol", F.when(F.col("v") > 50, 1).otherwise(-1))
    return sg.drop_repeat_polarity(p, S, ORDER, "pol").select("id", "pol")


PERIODS = """x AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY t) <= 14400 THEN 0 ELSE 1 END AS new FROM pts),
 p AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session ORDER BY t) AS BIGINT) AS period FROM x), per AS (SELECT session, period, min(t) AS start, max(t) AS stop, count(*) AS n FROM p GROUP BY 1, 2)"""


@query(f"WITH {PTS}, {PERIODS} SELECT session, period, round(start, 6) AS start, round(stop, 6) AS stop, n FROM per")
def w11_sessionize(spark, d):
    return sg.sessionize(points(spark, d), S, "t", 14400.0).select("session", F.col("period").cast("long").alias("period"), r6("start").alias("start"), r6("stop").alias("stop"), "n")


@query(f"""WITH {PTS}, {PERIODS}, m AS (SELECT *, abs(stop - start - 7200) / 7200.0 AS mm FROM per),
 k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY mm, start) AS r FROM m WHERE mm < 1) SELECT session, round(start, 6) AS start, round(mm, 6) AS mismatch FROM k WHERE r = 1""")
def w11_closest_period(spark, d):
    per = sg.sessionize(points(spark, d), S, "t", 14400.0)
    return sg.closest_period(per, S, 7200.0).select("session", r6("start").alias("start"), r6("mismatch").alias("mismatch"))


@query(f"WITH {PTS} SELECT id, round(avg(v) OVER {_w('2 PRECEDING AND 2 FOLLOWING')}, 6) AS smooth FROM pts")
def w12_moving_average(spark, d):
    return sg.moving_average(points(spark, d), S, ORDER, "v", 5).select("id", r6("smooth").alias("smooth"))


@query(f"WITH {PTS} SELECT id, round(median(v) OVER {_w('2 PRECEDING AND 2 FOLLOWING')}, 6) AS smooth FROM pts")
def w12_moving_median(spark, d):
    return sg.moving_median(points(spark, d), S, ORDER, "v", 5).select("id", r6("smooth").alias("smooth"))


@query(f"WITH {PTS} SELECT id, round((v - lag(v) OVER (PARTITION BY session ORDER BY t)) / nullif(t - lag(t) OVER (PARTITION BY session ORDER BY t), 0), 6) AS velocity FROM pts")
def w14_velocity(spark, d):
    return sg.velocity(points(spark, d), S, "t", "v").select("id", r6("velocity").alias("velocity"))


@query("SELECT o_orderkey, round((CASE WHEN o_orderkey * 7919 % 4294967296 > 2147483648 THEN o_orderkey * 7919 % 4294967296 - 4294967296 ELSE o_orderkey * 7919 % 4294967296 END) * 360.0::DOUBLE / 4096, 6) AS deg FROM orders")
def w14_unwrap_counter(spark, d):
    raw = F.col("o_orderkey") * 7919 % 4294967296
    return table(spark, d, "orders").select("o_orderkey", r6(sg.wheel_degrees(sg.unwrap_counter(raw))).alias("deg"))


def _onset_sql() -> str:
    parts = []
    for name, sign in (("l", -1), ("r", 1)):
        f = _w("CURRENT ROW AND 1 FOLLOWING")
        parts.append(f"CASE WHEN coalesce(avg({sign} * dv) OVER {f} >= 5 AND min({sign} * dv) OVER {f} >= 0 AND sum({sign} * dv) OVER {f} > 0, false) THEN 1 ELSE 0 END AS {name}")
    q = _w("1 PRECEDING AND CURRENT ROW")
    on = lambda n: f"lead({n}) OVER {W} = 1 AND sum({n}) OVER {q} = 0 AND count(*) OVER {q} = 2"
    return f"""WITH {PTS}, d AS (SELECT *, v - lag(v) OVER {W} AS dv FROM pts), a AS (SELECT *, {', '.join(parts)} FROM d),
 o AS (SELECT id, CASE WHEN {on('l')} THEN 1 WHEN {on('r')} THEN 2 END AS direction FROM a) SELECT id, direction FROM o WHERE direction IS NOT NULL"""


@query(_onset_sql())
def w15_movement_onsets(spark, d):
    return sg.movement_onsets(points(spark, d), S, ORDER, "v", win=2, threshold=5.0, quiet=2).where("direction IS NOT NULL").select("id", "direction")


@query(f"""WITH {PTS}, {REFS}, f AS (SELECT r.id AS onset, p.t, p.v, r.v AS v0, row_number() OVER (PARTITION BY r.id ORDER BY p.t) AS k FROM refs r JOIN pts p ON p.session = r.session AND p.t BETWEEN r.t AND r.t + 86400 AND abs(p.v - r.v) > 25)
 SELECT onset, round(t, 6) AS t_cross, CASE WHEN v < v0 THEN 1 ELSE 2 END AS direction FROM f WHERE k = 1""")
def w16_first_crossing(spark, d):
    on = refs(spark, d).select("session", F.col("id").alias("onset"), F.col("t").alias("t0"), F.col("v").alias("v0"))
    return sg.first_crossing(points(spark, d).select("session", "t", "v"), on, S, "t", "v", 25.0, 86400.0).select("onset", r6("t_cross").alias("t_cross"), "direction")


@query(f"""WITH {PTS}, {REFS}, o AS (SELECT session, t FROM pts WHERE unit = 'click'), tr AS (SELECT session, id, t AS t_stim, t + 43200 AS t_cross FROM refs)
 SELECT id, round((SELECT max(o.t) FROM o WHERE o.session = tr.session AND o.t < tr.t_cross), 6) AS t_choice, round((SELECT min(o.t) FROM o WHERE o.session = tr.session AND o.t > tr.t_stim), 6) AS t_first FROM tr""")
def w17_choice_movement(spark, d):
    tr = refs(spark, d).select("session", "id", F.col("t").alias("t_stim"), (F.col("t") + 43200).alias("t_cross"))
    return sg.choice_movement(tr, points(spark, d).where("unit = 'click'"), S).select("id", r6("t_choice").alias("t_choice"), r6("t_first").alias("t_first"))


@query(f"""WITH {PTS}, s AS (SELECT session, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS dt FROM pts), x AS (SELECT * FROM s WHERE dt IS NOT NULL), m AS (SELECT session, quantile_cont(dt, 0.5) AS m FROM x GROUP BY 1)
 SELECT session, count(*) FILTER (dt > 1.4 * m) AS n_gaps, CAST(sum(CASE WHEN dt > 1.4 * m THEN round(dt / nullif(m, 0)) - 1 ELSE 0 END) AS BIGINT) AS missed FROM x JOIN m USING (session) GROUP BY 1""")
def w18_frame_gaps(spark, d):
    return sg.frame_gaps(points(spark, d), S, "t")


RANGES = "rg AS (SELECT session, id, t AS a, t + v * 600 AS z FROM pts)"


@query(f"""WITH {PTS}, {RANGES}, n AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY session ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM rg),
 g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY a, z) AS grp FROM n) SELECT session, CAST(grp AS BIGINT) AS range_group, round(min(a), 6) AS a, round(max(z), 6) AS z, count(*) AS n FROM g GROUP BY 1, 2""")
def w19_merge_ranges(spark, d):
    r = points(spark, d).select("session", F.col("t").alias("a"), (F.col("t") + F.col("v") * 600).alias("z"))
    return sg.merged(r, S, "a", "z").select("session", F.col("range_group").cast("long").alias("range_group"), r6("a").alias("a"), r6("z").alias("z"), "n")


@query(f"""WITH RECURSIVE {PTS}, {RANGES}, o AS (SELECT session, a, z, row_number() OVER (PARTITION BY session ORDER BY a, z) AS k FROM rg),
 f AS (SELECT session, k, a, z, z AS first, 0 AS g FROM o WHERE k = 1 UNION ALL SELECT o.session, o.k, o.a, o.z, CASE WHEN o.a > f.first THEN o.z ELSE f.first END, CASE WHEN o.a > f.first THEN f.g + 1 ELSE f.g END FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1)
 SELECT session, round(a, 6) AS a, round(z, 6) AS z, g AS range_group FROM f""")
def w19_merge_ranges_first_stop(spark, d):
    r = points(spark, d).select("session", F.col("t").alias("a"), (F.col("t") + F.col("v") * 600).alias("z"))
    return sg.merge_ranges(r, S, "a", "z", extend=False).select("session", r6("a").alias("a"), r6("z").alias("z"), "range_group")


@query(f"""WITH {PTS}, {REFS} SELECT p.id, max(CASE WHEN r.id IS NULL THEN 0 ELSE 1 END) AS inside FROM pts p LEFT JOIN refs r ON r.session = p.session AND p.t >= r.t AND p.t < r.t + 36000 WHERE p.unit = 'view' GROUP BY 1""")
def w20_digitise(spark, d):
    iv = refs(spark, d).select("session", F.col("t").alias("t_on"), (F.col("t") + 36000).alias("t_off"))
    return sg.digitise(points(spark, d).where("unit = 'view'").select("session", "id", "t"), iv, S).select("id", "inside")


@query(f"""WITH {PTS}, n AS (SELECT id, unit, lag(unit) OVER {W} AS b, lead(unit) OVER {W} AS a FROM pts) SELECT id FROM n WHERE NOT coalesce(a = unit AND b = unit, false)""")
def w21_compact_repeats(spark, d):
    return sg.compact_repeats(points(spark, d), S, ORDER, "unit").select("id")


@query(f"""WITH {PTS}, m AS (SELECT unit, CAST(floor(t / 86400) AS BIGINT) AS day, v - 50 AS shift FROM pts), p AS (SELECT unit, day, quantile_cont(shift, 0.5) AS step FROM m GROUP BY 1, 2)
 SELECT unit, day, round(step, 6) AS step, round(sum(step) OVER (PARTITION BY unit ORDER BY day), 6) AS drift FROM p""")
def w22_cumulative_drift(spark, d):
    m = points(spark, d).select("unit", F.floor(F.col("t") / 86400).alias("day"), (F.col("v") - 50).alias("shift"))
    return sg.cumulative_drift(m, ["unit"], "day", "shift").select("unit", "day", r6("step").alias("step"), r6("drift").alias("drift"))


@query(f"""WITH {PTS}, s AS (SELECT session, min(t) AS s0, max(t) AS s1 FROM pts WHERE unit = 'click' GROUP BY 1), e AS (SELECT session, min(t) AS d0, max(t) AS d1 FROM pts WHERE unit = 'view' GROUP BY 1),
 j AS (SELECT session, (d1 - d0) / nullif(s1 - s0, 0) AS slope, d0, s0 FROM s JOIN e USING (session)) SELECT session, round(slope, 6) AS slope, round(d0 - slope * s0, 4) AS intercept, coalesce(abs(slope - 1) <= 0.01, false) AS accepted FROM j""")
def w23_affine_clock(spark, d):
    p = points(spark, d)
    return sg.affine_clock(p.where("unit = 'click'"), p.where("unit = 'view'"), S).select("session", r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), "accepted")


@query()
def w24_robust_align(spark, d):
    p = points(spark, d).where("unit = 'click'")
    late = p.withColumn("t", F.col("t") * 1.00001 + 12.5).where("id % 17 <> 3")
    return sg.robust_align(p, late, S, threshold=60.0)


@query()
def w25_motion_periods(spark, d):
    return sg.motion_periods(points(spark, d), S, "t", "v")


@query(f"""WITH {PTS}, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t) AS r FROM pts), b AS (SELECT session, avg(v) + 0.5 * stddev_samp(v) AS lo, avg(v) + 1.0 * stddev_samp(v) AS hi FROM k WHERE r <= 20 GROUP BY 1),
 s AS (SELECT p.session, t, last_value(CASE WHEN v > hi THEN 1 WHEN v < lo THEN -1 END IGNORE NULLS) OVER (PARTITION BY p.session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM pts p JOIN b USING (session)),
 f AS (SELECT session, t, coalesce(state, 0) AS state, coalesce(state <> lag(state) OVER (PARTITION BY session ORDER BY t) AND state <> 0, false) AS flip FROM s),
 g AS (SELECT *, sum(CASE WHEN flip THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t) AS run FROM f), u AS (SELECT session, run, min(t) AS a, max(t) AS z FROM g WHERE state = 1 GROUP BY 1, 2)
 SELECT session, round(a, 6) AS ramp_on, round(z, 6) AS ramp_off FROM u WHERE z - a > 0.1""")
def w26_pulse_ramps(spark, d):
    return sg.pulse_ramps(points(spark, d), S, "t", "v", rows=20, low=0.5, high=1.0).select("session", r6("ramp_on").alias("ramp_on"), r6("ramp_off").alias("ramp_off"))


@query(f"""WITH {PTS}, a AS (SELECT CAST(floor(t / 21600) AS BIGINT) AS bin, avg(v) AS x FROM pts GROUP BY 1), b AS (SELECT CAST(floor(t / 21600) AS BIGINT) AS bin, count(*) AS y FROM pts WHERE unit = 'purchase' GROUP BY 1)
 SELECT lag, round(corr(x, y), 6) AS r FROM a, (SELECT unnest([-1, 0, 1, 2]) AS lag), b WHERE b.bin - lag = a.bin GROUP BY 1""")
def w27_shifted_correlation(spark, d):
    p = points(spark, d).withColumn("bin", F.floor(F.col("t") / 21600))
    a = p.groupBy("bin").agg(F.avg("v").alias("x"))
    b = p.where("unit = 'purchase'").groupBy("bin").agg(F.count("*").alias("y"))
    return sg.shifted_correlation(a, b, [], "bin", "x", "y", [-1, 0, 1, 2]).select("lag", r6("r").alias("r"))


@query(f"""WITH {PTS}, n AS (SELECT session, unit, count(*) AS n FROM pts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY abs(n - 15), unit) AS r FROM n) SELECT session, unit, n FROM r WHERE r = 1""")
def w28_best_reference_channel(spark, d):
    return sg.best_reference_channel(points(spark, d), S, "unit", F.lit(15))


@query("""WITH f AS (SELECT label, vec_id, unnest(range(64)) AS pix, unnest(embedding) > 0.1 AS bright FROM embeddings), b AS (SELECT *, lag(bright) OVER (PARTITION BY label, pix ORDER BY vec_id) AS before FROM f)
 SELECT label, vec_id, CAST(pix // 8 AS BIGINT) AS "row", CAST(pix % 8 AS INT) AS col, (pix % 8) * 7.5 AS azimuth, (pix // 8) * 7.5 AS elevation FROM b WHERE bright AND NOT coalesce(before, false)""")
def w29_detect_onsets_2d(spark, d):
    frames = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x > 0.1).alias("pix_on"))
    return sg.detect_onsets_2d(frames, ["label"], "vec_id", "pix_on", 8)


@query(f"""WITH {PTS}, {REFS}, tr AS (SELECT session, id AS trial, t AS t_on, t + 7200 AS t_off FROM refs), c AS (SELECT unnest([0.0, 7200.0, 14400.0]::DOUBLE[]) AS pad),
 n AS (SELECT tr.session, trial, pad, count(p.id) AS n FROM tr CROSS JOIN c LEFT JOIN pts p ON p.session = tr.session AND p.unit = 'view' AND p.t >= t_on AND p.t <= t_off + pad GROUP BY 1, 2, 3),
 b AS (SELECT session, pad, count(*) FILTER (n <> 1) AS n_bad FROM n GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n_bad, pad) AS r FROM b) SELECT session, pad, n_bad FROM k WHERE r = 1""")
def w30_best_end_extension(spark, d):
    tr = refs(spark, d).select("session", F.col("id").alias("trial"), F.col("t").alias("t_on"), (F.col("t") + 7200).alias("t_off"))
    return sg.best_end_extension(tr, points(spark, d).where("unit = 'view'").select("session", "t"), S, [0.0, 7200.0, 14400.0], 1)


# The same rows from slices of a day or two of each session, which are tasks of their own.


@query(ORACLE_SQL["w2_fill_forward"])
def w2_fill_forward_sliced(spark, d):
    p = points(spark, d).withColumn("v", F.when(F.col("v") > 50, F.col("v")))
    return sg.fill_forward(p, S, ORDER, "v", bucket=86400.0).select("id", r6("v").alias("v"))


@query(ORACLE_SQL["w7_schmitt"])
def w7_schmitt_sliced(spark, d):
    return sg.schmitt(points(spark, d), S, ORDER, "v", 20.0, 80.0, bucket=86400.0).select("id", "state", "flip")


@query(ORACLE_SQL["w11_sessionize"])
def w11_sessionize_sliced(spark, d):
    per = sg.sessionize(points(spark, d), S, "t", 14400.0, bucket=172800.0)
    return per.select("session", F.col("period").cast("long").alias("period"), r6("start").alias("start"), r6("stop").alias("stop"), "n")


@query(ORACLE_SQL["w15_movement_onsets"])
def w15_movement_onsets_sliced(spark, d):
    found = sg.movement_onsets(points(spark, d), S, ORDER, "v", win=2, threshold=5.0, quiet=2, bucket=172800.0)
    return found.where("direction IS NOT NULL").select("id", "direction")


@query(ORACLE_SQL["w19_merge_ranges"])
def w19_merge_ranges_sliced(spark, d):
    r = points(spark, d).select("session", F.col("t").alias("a"), (F.col("t") + F.col("v") * 600).alias("z"))
    found = sg.merged(r, S, "a", "z", bucket=86400.0)
    return found.select("session", F.col("range_group").cast("long").alias("range_group"), r6("a").alias("a"), r6("z").alias("z"), "n")


@query(ORACLE_SQL["w19_merge_ranges_first_stop"])
def w19_first_stop_sliced(spark, d):
    r = points(spark, d).select("session", F.col("t").alias("a"), (F.col("t") + F.col("v") * 600).alias("z"))
    return sg.merge_ranges(r, S, "a", "z", extend=False, bucket=86400.0).select("session", r6("a").alias("a"), r6("z").alias("z"), "range_group")


@query(ORACLE_SQL["w20_digitise"])
def w20_digitise_sliced(spark, d):
    iv = refs(spark, d).select("session", F.col("t").alias("t_on"), (F.col("t") + 36000).alias("t_off"))
    return sg.digitise(points(spark, d).where("unit = 'view'").select("session", "id", "t"), iv, S, bucket=86400.0).select("id", "inside")
