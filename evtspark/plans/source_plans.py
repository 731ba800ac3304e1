"""Sources, sinks, scalar functions and streams over the driver's tables and what Spark writes from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtspark.functions import scalars as sc
from evtspark.plans.registry import PTS, query, r6, table
from evtspark.plans.selection_plans import CAT, MAIN, catalog, main
from evtspark.schemas import strings
from evtspark.sources import catalog as so
from evtspark.streaming import jobs


@query("SELECT o_custkey % 10 AS subject, strftime(o_orderdate, '%Y-%m-%d') AS expDate, CAST(o_orderkey AS VARCHAR) AS expNum FROM orders")
def s1_read_catalog(spark, d):
    """The catalogue written as a CSV folder per subject, with old-style dates, and read back."""
    path = jobs.workspace(spark)
    o = table(spark, d, "orders")
    so.write_catalog(o.select((F.col("o_custkey") % 10).alias("subject"), F.date_format("o_orderdate", "yyyy_MM_dd").alias("expDate"), F.col("o_orderkey").alias("expNum")), path)
    return so.read_catalog(spark, path, strings(["expDate", "expNum"])).select(F.col("subject").cast("long").alias("subject"), "expDate", "expNum")


@query(f"WITH {MAIN} SELECT CAST(subject AS VARCHAR) AS subject, IsActive, P0_type FROM main")
def s2_read_main(spark, d):
    path = jobs.workspace(spark)
    main(spark, d).select(F.col("subject").cast("string"), "IsActive", "P0_type").write.csv(path, header=True)
    return so.read_main(spark, path, strings(["subject", "IsActive", "P0_type"]))


@query(f"WITH {PTS} SELECT session, round(v, 6) AS v FROM pts WHERE unit = 'view' AND session IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)")
def s3_read_objects(spark, d):
    from evtspark.plans.registry import points, refs

    root = jobs.workspace(spark)
    points(spark, d).where("unit = 'view'").write.parquet(f"{root}/probe0/spikes")
    got = so.read_objects(spark, root, {"probe0": {"spikes": ["session", "v"]}}, refs(spark, d).where("v > 100"))
    return got["probe0.spikes"].withColumn("v", r6("v"))


@query("SELECT o_orderkey, o_orderstatus, len(string_split(o_orderpriority, '-')) AS n FROM orders")
def s4_s5_split_trials(spark, d):
    """A trial table split into main and large columns, and read back whole."""
    path = jobs.workspace(spark)
    t = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.split("o_orderpriority", "-").alias("parts"))
    so.write_trials(t, path, ["o_orderkey"])
    return so.read_trials(spark, path, ["o_orderkey"], full=True).select("o_orderkey", "o_orderstatus", F.size("parts").cast("long").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, CAST(o_orderkey % 3 AS VARCHAR) AS alignBlock, CAST(o_custkey % 3 AS VARCHAR) AS extractSpikes FROM orders), f AS (SELECT o_orderkey, 'alignBlock' AS step FROM c WHERE alignBlock = '2' UNION ALL SELECT o_orderkey, 'extractSpikes' FROM c WHERE extractSpikes = '2')
 SELECT o_orderkey, step, CASE WHEN step = 'alignBlock' AND o_orderkey % 2 = 0 THEN 'failed ' || o_orderkey END AS message FROM f""")
def s6_fetch_errors(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(k, (k % 3).cast("string").alias("alignBlock"), (F.col("o_custkey") % 3).cast("string").alias("extractSpikes"))
    m = table(spark, d, "orders").where(k % 2 == 0).select(k, F.lit("alignBlock").alias("step"), F.concat(F.lit("failed "), k.cast("string")).alias("message"))
    return so.fetch_errors(c, m, ["alignBlock", "extractSpikes"], ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_partkey >> 0) & 1 AS INT) AS line0, CAST((l_partkey >> 3) & 1 AS INT) AS line3 FROM lineitem")
def s9_unpack_bits(spark, d):
    return so.unpack_bits(table(spark, d, "lineitem").withColumn("w", F.col("l_partkey").cast("int")), "w", [0, 3]).select("l_orderkey", "l_linenumber", "l_partkey", "line0", "line3")


@query(f"WITH {CAT} SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE flag END AS flag FROM cat")
def s10_upsert_catalog(spark, d):
    c = catalog(spark, d).select("o_orderkey", "flag")
    return so.upsert_catalog(c, c.where("o_orderkey % 7 = 0").withColumn("flag", F.lit("new")), ["o_orderkey"])


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE o_orderkey % 7 <> 0")
def s11_delete_rows(spark, d):
    c = catalog(spark, d).select("o_orderkey")
    return so.delete_rows(c, c.where("o_orderkey % 7 = 0"), ["o_orderkey"])


@query("""WITH t AS (SELECT l_orderkey, l_suppkey % 3 AS server, sum(l_partkey) AS bytes FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY bytes DESC, server) AS r FROM t)
 SELECT l_orderkey, server, CAST(bytes AS BIGINT) AS bytes FROM r WHERE r = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def s12_discover_new(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("server"), "l_partkey")
    known = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return so.discover_new(li, known, ["l_orderkey"], "server", "l_partkey")


@query("""SELECT l_orderkey, CASE WHEN max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 THEN '1' WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN '2' WHEN min(l_linenumber) < 2 THEN '0' ELSE 'NaN' END AS done FROM lineitem GROUP BY 1""")
def s13_probe_status(spark, d):
    return so.probe_status(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", F.col("l_linenumber"), {"done": ("A", "R")}, young=2)


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE (subject, expNum) IN ((1, 1), (2, 3), (4, 0))")
def s14_named_cohort(spark, d):
    return so.named_cohort(catalog(spark, d), [(1, 1), (2, 3), (4, 0)], ["subject", "expNum"]).select("o_orderkey")


@query(f"WITH {CAT} SELECT o_orderkey FROM cat WHERE (subject, expNum) IN (SELECT subject, expNum FROM cat WHERE flag = 'P')")
def s15_selection(spark, d):
    path, c = jobs.workspace(spark), catalog(spark, d)
    so.save_selection(c.where("flag = 'P'"), ["subject", "expNum"], path)
    return so.load_selection(c, ["subject", "expNum"], path).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 2 ELSE 0 END AS tag FROM orders WHERE (o_orderkey % 4 IN (0, 2)) OR o_orderkey % 10 = 1")
def s16_stage_queue(spark, d):
    o = table(spark, d, "orders")
    queue = o.where("o_orderkey % 4 IN (0, 1, 2)").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("tag"))
    return so.stage_queue(queue, o.where("o_orderkey % 4 = 2 OR o_orderkey % 10 = 1").select("o_orderkey"), "o_orderkey")


@query("SELECT c_custkey, 'b' AS v FROM customer")
def s17_write_versioned(spark, d):
    path, c = jobs.workspace(spark), table(spark, d, "customer").select("c_custkey")
    for stamp in ("2024-01-01", "2024-02-01"):
        so.write_versioned(c.withColumn("v", F.lit("a" if stamp < "2024-02" else "b")), path, stamp)
    return so.read_latest(spark, path)


@query("SELECT p_brand AS session, count(*) AS n, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1")
def s18_collect_fits(spark, d):
    path = jobs.workspace(spark)
    table(spark, d, "part").groupBy(F.col("p_brand").alias("session")).agg(F.count("*").alias("n"), r6(F.avg("p_retailprice")).alias("score")).write.partitionBy("session").parquet(path)
    return so.collect_fits(spark, path).select(F.col("session").cast("string").alias("session"), "n", "score")


@query("SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'only_a' WHEN p_partkey % 7 = 0 THEN 'different' ELSE 'same' END AS status FROM part")
def h1_compare_trees(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").cast("binary").alias("content"))
    b = p.where("path % 5 <> 0").withColumn("content", F.when(F.col("path") % 7 == 0, F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content")))
    return so.compare_trees(p, b)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, round(1 / (1 + exp(-(o_orderkey % 7 - 3)::DOUBLE)), 6) AS sig, round(exp(-0.5 * ((o_orderkey % 9 - 4) / 2.0) ** 2), 6) AS gau, printf('aud_azimuth_%d_dpower_%.2f', CAST(o_orderkey % 3 AS INT), (o_orderkey % 5) / 4.0::DOUBLE) AS tag, md5(o_orderpriority) AS hash FROM orders""")
def f_scalars(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k, sc.tolerant_date(F.date_format("o_orderdate", "dd/MM/yyyy")).cast("string").alias("day"), r6(sc.sigmoid((k % 7 - 3).cast("double"))).alias("sig"), r6(sc.gaussian((k % 9).cast("double"), 4.0, 2.0)).alias("gau"),
        sc.condition_tag(k % 3, (k % 5) / 4.0).alias("tag"), F.md5(F.col("o_orderpriority").cast("binary")).alias("hash"),
    )


@query("""SELECT o_orderkey, map_size AS n_keys, state, priority, text FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS map_size,
 CASE WHEN o_orderkey % 3 = 0 THEN 'open' ELSE o_orderstatus END AS state, o_orderpriority AS priority,
 '{"key":' || o_orderkey || ',"status":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS text FROM orders)""")
def f_maps_and_json(spark, d):
    """Settings as JSON text over defaults, a third of the texts broken, and a struct written as text."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    given = F.when(status.isNull(), F.lit("no json")).otherwise(F.to_json(F.struct(status.alias("state"), F.lit("1").alias("version"))))
    defaults = F.create_map(F.lit("state"), F.lit("open"), F.lit("priority"), F.col("o_orderpriority"))
    both = o.withColumn("all", sc.merge_maps(defaults, sc.load_json(given, "map<string,string>")))
    text = sc.dump_json(F.struct(F.col("o_orderkey").alias("key"), status.alias("status")))
    return both.select("o_orderkey", F.size("all").alias("n_keys"), F.col("all")["state"].alias("state"), F.col("all")["priority"].alias("priority"), text.alias("text"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 64), lambda i: abs(embedding[i + 1]::DOUBLE - embedding[i]::DOUBLE))), 4) AS total, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS top FROM embeddings")
def f_arrays(spark, d):
    e = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    total = F.aggregate(sc.diff(F.col("x")), F.lit(0.0), lambda a, v: a + F.abs(v))
    return e.select("vec_id", F.round(total, 4).alias("total"), sc.argmax(F.col("x")).alias("top"))


@query("SELECT user_id, event_type, count(*) AS n_files FROM events GROUP BY 1, 2")
def st1_discover(spark, d):
    path = jobs.workspace(spark)
    jobs.discover(jobs.event_stream(spark, d), ["user_id", "event_type"], path)
    return spark.read.parquet(f"{path}/v=0")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x)
 SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM p GROUP BY user_id, k""")
def st2_gap_sessions(spark, d):
    s = jobs.collect(jobs.gap_sessions(jobs.event_stream(spark, d), ["user_id"], "4 hours", "10 days"), "complete")
    return s.select("user_id", F.unix_micros("start").alias("start"), "n")


@query(f"""WITH {PTS}, s AS (SELECT id, session, t, coalesce(last_value(CASE WHEN v > 80 THEN 1 WHEN v < 20 THEN -1 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM pts),
 b AS (SELECT *, lag(state) OVER (PARTITION BY session ORDER BY t, id) AS before FROM s) SELECT session AS user_id, state, count(*) AS n FROM b WHERE state <> before AND state <> 0 AND before <> 0 GROUP BY 1, 2""")
def st3_hysteresis(spark, d):
    flips = jobs.collect(jobs.hysteresis(jobs.event_stream(spark, d), "user_id", 20.0, 80.0))
    return flips.groupBy("user_id", "state").agg(F.count("*").alias("n"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1, 2")
def st4_window_counts(spark, d):
    w = jobs.collect(jobs.window_counts(jobs.event_stream(spark, d), ["event_type"], "6 hours", "1 day"), "complete")
    return w.select("event_type", F.unix_micros("start").alias("start"), "n", r6("rms").alias("rms"))


@query("SELECT r.event_id AS trial, p.event_id AS point FROM events r JOIN events p ON p.user_id = r.user_id AND r.event_type = 'purchase' AND p.event_type = 'view' AND p.ts >= r.ts AND p.ts <= r.ts + INTERVAL 6 HOUR")
def st5_interval_join(spark, d):
    s = jobs.event_stream(spark, d)
    t = jobs.event_stream(spark, d)
    return jobs.collect(jobs.interval_join(s.where("event_type = 'view'"), t.where("event_type = 'purchase'"), "user_id", "6 HOURS", "1 day"))


@query(f"""WITH {PTS}, s AS (SELECT session % 5 AS file, row_number() OVER (PARTITION BY session % 5 ORDER BY id) - 1 AS sample, CAST(id % 20011 AS INT) AS a, CAST(session % 997 AS INT) - 500 AS b FROM pts WHERE unit = 'view')
 SELECT 'rec' || file AS file, sample, 0 AS channel, a AS v FROM s UNION ALL SELECT 'rec' || file, sample, 1, b FROM s""")
def s7_read_interleaved(spark, d):
    """Two channels of samples written as raw int16 files and read back."""
    from evtspark.plans.registry import points

    root = jobs.workspace(spark)
    p = points(spark, d).where("unit = 'view'").select(F.concat(F.lit("rec"), F.col("session") % 5).alias("file"), "id", (F.col("id") % 20011).cast("int").alias("a"), (F.col("session") % 997 - 500).cast("int").alias("b"))
    so.write_interleaved(p, "file", "id", ["a", "b"], root).collect()  # a row per file
    got = so.read_interleaved(spark, root, 2)
    return got.select(F.regexp_extract("path", r"([^/]*)\.bin$", 1).alias("file"), "sample", "channel", "v")


@query("SELECT CAST(o_custkey % 50 AS VARCHAR) AS subject, 'order' || o_orderkey AS name, o_orderstatus AS value FROM orders")
def s8_read_keyvalue(spark, d):
    """A key=value file per subject, some keys with a tilde, written as text and read back."""
    root = jobs.workspace(spark)
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("subject"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "~").otherwise(""), F.lit("order"), "o_orderkey", F.lit("="), "o_orderstatus").alias("value"))
    o.repartition("subject").write.partitionBy("subject").text(root)
    got = so.read_keyvalue(spark, root).select(F.regexp_extract("path", "subject=([0-9]+)", 1).alias("subject"), F.explode("meta").alias("name", "value"))
    return got
