"""Time joins over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtspark.operators import timejoin as tj
from evtspark.plans.registry import PTS, REFS, points, query, r6, refs

DAY = 86400.0


def _views(spark, d):
    p = points(spark, d)
    return p.where("unit IN ('click', 'view')"), refs(spark, d)


def _asof_sql(pick: str) -> str:
    return f"""WITH {PTS}, {REFS}, l AS (SELECT * FROM pts WHERE unit = 'view'),
 m AS (SELECT l.id, l.t, (SELECT max(r.t) FROM refs r WHERE r.session = l.session AND r.t < l.t) AS a,
   (SELECT min(r.t) FROM refs r WHERE r.session = l.session AND r.t >= l.t) AS z FROM l)
 SELECT id, round({pick}, 6) AS t_match FROM m"""


@query(_asof_sql("CASE WHEN z IS NULL OR t - a <= z - t THEN coalesce(a, z) ELSE z END"))
def j3_asof_nearest(spark, d):
    left = points(spark, d).where("unit = 'view'")
    return tj.asof_join(left, refs(spark, d), ["session"], bucket=DAY).select("id", r6("match.t").alias("t_match"))


@query(_asof_sql("a"))
def j3_asof_previous(spark, d):
    left = points(spark, d).where("unit = 'view'")
    return tj.asof_join(left, refs(spark, d), ["session"], mode="previous").select("id", r6("match.t").alias("t_match"))


@query(_asof_sql("z"))
def j3_asof_next(spark, d):
    left = points(spark, d).where("unit = 'view'")
    return tj.asof_join(left, refs(spark, d), ["session"], mode="next").select("id", r6("match.t").alias("t_match"))


@query(_asof_sql("CASE WHEN z IS NULL OR t - a <= z - t THEN CASE WHEN abs(coalesce(a, z) - t) <= 21600 THEN coalesce(a, z) END ELSE CASE WHEN z - t <= 21600 THEN z END END"))
def j3_asof_tolerance(spark, d):
    left = points(spark, d).where("unit = 'view'")
    return tj.asof_join(left, refs(spark, d), ["session"], tolerance=21600.0).select("id", r6("match.t").alias("t_match"))


#: Seconds that a session's rows are dealt out by.
WEEK = 604800.0
TRIALS = "tr AS (SELECT session, id AS trial, t AS t_on, lead(t) OVER (PARTITION BY session ORDER BY t) AS t_off FROM refs)"


def trials(spark, d):
    """Purchases as trials that last until the session's next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("t")
    return refs(spark, d).select("session", F.col("id").alias("trial"), F.col("t").alias("t_on"), F.lead("t").over(w).alias("t_off"))


@query(f"""WITH {PTS}, {REFS}, {TRIALS}
SELECT tr.session, tr.trial, count(p.id) AS n, round(coalesce(sum(p.v), 0), 6) AS total FROM tr LEFT JOIN pts p
 ON p.session = tr.session AND p.unit = 'click' AND p.t >= tr.t_on AND p.t < tr.t_off GROUP BY 1, 2""")
def j4_bucket_by_interval(spark, d):
    tr = trials(spark, d)
    clicks = points(spark, d).where("unit = 'click'").select("session", "id", "t", "v")
    inside = tj.bucket_by_interval(clicks, tr, ["session"], bucket=WEEK)
    per = inside.groupBy("session", F.col("interval.trial").alias("trial")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    out = tr.join(per, ["session", "trial"], "left")
    return out.select("session", "trial", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("total", F.lit(0.0))).alias("total"))


@query(f"""WITH {PTS}, {REFS} SELECT r.id AS event, p.id AS point, round(p.t - r.t, 6) AS dt FROM refs r JOIN pts p
 ON p.session = r.session AND p.unit = 'view' AND p.t BETWEEN r.t - 21600 AND r.t + 21600""")
def j5_peri_event_join(spark, d):
    ev = refs(spark, d).select("session", F.col("id").alias("event"), F.col("t").alias("t0"))
    pts = points(spark, d).where("unit = 'view'").select("session", F.col("id").alias("point"), "t")
    return tj.peri_event_join(pts, ev, ["session"], 21600.0, 21600.0).select("event", "point", r6("dt").alias("dt"))


CLOCK = "cm AS (SELECT session, t AS t_src, t * 1.0001 + v AS t_dst FROM refs)"


@query(f"""WITH {PTS}, {REFS}, {CLOCK}, l AS (SELECT * FROM pts WHERE unit = 'view'),
 a AS (SELECT l.id, max(c.t_src) AS s, arg_max(c.t_dst, c.t_src) AS d FROM l JOIN cm c ON c.session = l.session AND c.t_src <= l.t GROUP BY 1),
 z AS (SELECT l.id, min(c.t_src) AS s, arg_min(c.t_dst, c.t_src) AS d FROM l JOIN cm c ON c.session = l.session AND c.t_src > l.t GROUP BY 1)
 SELECT l.id, round(CASE WHEN a.s IS NULL THEN l.t + z.d - z.s WHEN z.s IS NULL THEN l.t + a.d - a.s
   ELSE a.d + (l.t - a.s) * (z.d - a.d) / (z.s - a.s) END, 4) AS t_aligned FROM l LEFT JOIN a USING (id) LEFT JOIN z USING (id)""")
def j6_align_clock(spark, d):
    cm = refs(spark, d).select("session", F.col("t").alias("t_src"), (F.col("t") * 1.0001 + F.col("v")).alias("t_dst"))
    left = points(spark, d).where("unit = 'view'")
    return tj.align_clock(left, cm, ["session"], bucket=WEEK).select("id", F.round("t_aligned", 4).alias("t_aligned"))


@query(f"""WITH {PTS}, {REFS}, s AS (SELECT session, t, v FROM pts WHERE unit = 'click'),
 q AS (SELECT r.session, r.id AS event, g AS lag, r.t + g AS x FROM refs r, (SELECT unnest([-7200.0, 0.0, 7200.0]::DOUBLE[]) AS g)),
 a AS (SELECT event, lag, max(t) AS s, arg_max(v, t) AS d FROM q JOIN s ON s.session = q.session AND s.t <= x GROUP BY ALL),
 z AS (SELECT event, lag, min(t) AS s, arg_min(v, t) AS d FROM q JOIN s ON s.session = q.session AND s.t > x GROUP BY ALL)
 SELECT event, lag, round(CASE WHEN a.s IS NULL THEN z.d WHEN z.s IS NULL THEN a.d ELSE a.d + (x - a.s) * (z.d - a.d) / (z.s - a.s) END, 4) AS sample
 FROM q LEFT JOIN a USING (event, lag) LEFT JOIN z USING (event, lag)""")
def j7_sample_signal(spark, d):
    ev = refs(spark, d).select("session", F.col("id").alias("event"), F.col("t").alias("t0"))
    sig = points(spark, d).where("unit = 'click'").select("session", "t", "v")
    return tj.sample_signal(sig, ev, ["session"], [-7200.0, 0.0, 7200.0], bucket=WEEK).select("event", "lag", F.round("sample", 4).alias("sample"))


@query(f"""WITH {PTS}, {REFS}, {TRIALS} SELECT p.id, tr.trial FROM pts p LEFT JOIN tr ON tr.session = p.session AND p.t >= tr.t_on AND p.t < tr.t_off
 WHERE p.unit = 'view'""")
def j17_label_bins(spark, d):
    bins = points(spark, d).where("unit = 'view'").select("session", "id", "t")
    return tj.label_bins(bins, trials(spark, d), ["session"], bucket=WEEK).select("id", "trial")


@query("""SELECT count(*) AS n FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_brand = b.p_brand AND a.p_type = b.p_type
 AND a.p_size < b.p_size + 5 AND b.p_size < a.p_size + 5""")
def j16_ranges_overlap(spark, d):
    from evtspark.plans.registry import table

    p, size = table(spark, d, "part"), F.col("p_size")
    return tj.count_overlaps(p, ["p_brand", "p_type"], "p_partkey", size, size + 5)
