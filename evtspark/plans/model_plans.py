"""Choice models, the choice of predictors and unit matching over lineitem, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtspark.operators import additive as ad
from evtspark.operators import choice as ch
from evtspark.operators import fits as fi
from evtspark.operators import kernels as ke
from evtspark.operators import unitmatch as um
from evtspark.operators.summary import corr_matrix
from evtspark.plans.registry import PTS, query, table
from evtspark.plans.stats_plans import _counts, _design, _folded, _h
from evtspark.plans.summary_plans import TR, _long, _trials

#: Trials as in the other plans: vis is the level about 2, aud the side, both over their largest size; five folds dealt by choice.
CELLS = f"""{TR}, o AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY session, ln, pk, rt) AS rid, (level - 2) / 2.0::DOUBLE AS vis, (side * 2 - 3)::DOUBLE AS aud, CASE response WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS side_, response, feedback FROM tr),
 f AS (SELECT *, (row_number() OVER (PARTITION BY subject, response ORDER BY {_h("rid", "1")}, rid) - 1) % 5 AS fold, count(*) OVER (PARTITION BY subject, response) AS many FROM o),
 pre AS (SELECT *, coalesce(lag(side_) OVER (PARTITION BY subject ORDER BY rid), 0) AS prev_choice, coalesce(lag(feedback) OVER (PARTITION BY subject ORDER BY rid), 0) AS prev_outcome FROM f WHERE many > 1),
 cells AS (SELECT subject, vis, aud, prev_choice, prev_outcome, fold, sum(CASE WHEN side_ = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS n_right, count(*)::DOUBLE AS n FROM pre WHERE side_ <> 0 GROUP BY ALL)"""


def _cells(spark, d):
    """A subject is a fifth of all trials: they are numbered, dealt to folds and looked back on in slices."""
    from evtspark.operators.scan import scan
    from evtspark.operators.stats import ORDERS, cv_split
    from evtspark.staging import stage

    order = ["session", "ln", "pk", "rt"]
    t = _trials(spark, d).select("subject", *order, (F.col("level") - 2).alias("vis"), (F.col("side") * 2 - 3).alias("aud"), "response", "feedback")
    numbered = stage(scan(t, ["subject"], order, 20_000.0, {"rid": ("sum", F.lit(1).cast("long"))}).drop(*order))
    folded = stage(cv_split(numbered, ["subject", "response"], "rid", 5, width=ORDERS))
    return ch.choice_cells(folded, ["subject"], ["rid"], "vis", "aud", "response", "feedback", "fold", bucket=20_000.0)


@query(f"WITH {CELLS} SELECT subject, vis, aud, CAST(prev_choice AS INT) AS prev_choice, CAST(prev_outcome AS INT) AS prev_outcome, CAST(fold AS INT) AS fold, n_right, n FROM cells")
def m18_choice_cells(spark, d):
    return _cells(spark, d).withColumn("fold", F.col("fold").cast("int"))


@query(f"""WITH {CELLS}, k AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fold), p AS (SELECT subject, k.fold, sum(n_right) FILTER (cells.fold <> k.fold) AS r, sum(n) FILTER (cells.fold <> k.fold) AS n, sum(n_right) FILTER (cells.fold = k.fold) AS tr, sum(n) FILTER (cells.fold = k.fold) AS tn FROM cells, k GROUP BY ALL)
 SELECT subject, CAST(fold AS INT) AS fold, round(ln(r / (n - r)), 5) AS bias, round(-(r * log2(r / n) + (n - r) * log2(1 - r / n)) / n, 5) AS train_loss, round(-(tr * log2(r / n) + (tn - tr) * log2(1 - r / n)) / tn, 5) AS test_loss, n AS n_train, coalesce(tn, 0) AS n_test FROM p""")
def m18_bias_model(spark, d):
    fits = ch.fit_choice_models(_cells(spark, d), ["subject"], ["bias"], folds=5)
    return fits.select("subject", "fold", F.round(F.col("params")["bias"], 5).alias("bias"), F.round("train_loss", 5).alias("train_loss"), F.round("test_loss", 5).alias("test_loss"), "n_train", "n_test")


@query(f"""WITH {CELLS}, c AS (SELECT subject, vis, aud, sum(n_right) AS r, sum(n) AS n FROM cells GROUP BY ALL), a AS (SELECT subject, aud, sum(r) AS r, sum(n) AS n FROM c GROUP BY ALL)
 SELECT subject, 'pairs' AS model, round(sum(-(CASE WHEN r > 0 THEN r * log2(r / n) ELSE 0 END + CASE WHEN r < n THEN (n - r) * log2(1 - r / n) ELSE 0 END)) / sum(n), 4) AS train_loss FROM c GROUP BY 1
 UNION ALL SELECT subject, 'aud_levels', round(sum(-(CASE WHEN r > 0 THEN r * log2(r / n) ELSE 0 END + CASE WHEN r < n THEN (n - r) * log2(1 - r / n) ELSE 0 END)) / sum(n), 4) FROM a GROUP BY 1""")
def m18_saturated_models(spark, d):
    fits = ch.fit_choice_models(_cells(spark, d), ["subject"], ["pairs", "aud_levels"])
    return fits.select("subject", "model", F.round("train_loss", 4).alias("train_loss"))


@query()
def m18_choice_models(spark, d):
    return ch.compare_choice_models(ch.fit_choice_models(_cells(spark, d), ["subject"], list(ch.MODELS), folds=5), ["subject"])


@query()
def m20_neurometric_models(spark, d):
    x = F.col("text")
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", (F.ln(F.col("n_chars") + 1) / 10).alias("visR"), (F.size(F.split(x, "\n")) / 100).alias("visL"),
        *[(F.try_divide(F.length(F.regexp_replace(x, f"[^{c}]", "")), F.length(x)) * 10).alias(f"n_{k}") for k, c in enumerate(("aeiou", "0-9", "A-Z", ".,;:", "#*$%&|<>"))],
    )
    rows = docs.join(table(spark, d, "labels"), "doc_id").withColumns({"audR": (F.col("toxic") == 1).cast("double"), "test": F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0})
    return ch.neurometric_models(rows, ["lang"], "quality", "test", ["visR", "visL", "audR"], ["visR", "visL"], [f"n_{k}" for k in range(5)], "doc_id")


def _days(spark, d):
    """Embeddings dealt to four days; labels are units, components are stimuli."""
    return _long(spark, d).select((F.col("vec_id") % 4).alias("day"), F.col("label").alias("unit"), F.col("pix").alias("stim"), F.floor(F.col("vec_id") / 4).alias("rep"), "x")


@query()
def m23_match_units(spark, d):
    w = um.shared_weights(_days(spark, d), "day", "unit", "stim", "x", 8)
    return um.match_days(w, "day", "unit", isolation=0.0, least=0.0)


@query("""WITH e AS (SELECT vec_id % 4 AS day, label AS unit, vec_id // 4 AS rep, unnest(range(64)) AS stim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT day, unit, stim, avg(x) FILTER (rep % 2 = 1) AS o, avg(x) FILTER (rep % 2 = 0) AS v, sum(x) AS s, count(*) AS n FROM e GROUP BY 1, 2, 3)
 SELECT day, unit, round(sum(s) / sum(n), 6) AS rate, round(corr(o, v), 6) AS reliability FROM m GROUP BY 1, 2 HAVING sum(s) / sum(n) > -1 AND corr(o, v) > 0.0""")
def m23_reliable_units(spark, d):
    kept = um.reliable_units(_days(spark, d), "day", "unit", "stim", "rep", "x", least_rate=-1.0, least=0.0)
    return kept.withColumns({c: F.round(c, 6) for c in ("rate", "reliability")})


@query()
def m24_fingerprint_match(spark, d):
    """Components' correlations over the vectors of a label, on even and odd vectors; the first ten components are matched before."""
    e = _long(spark, d).withColumn("half", F.col("vec_id") % 2)
    side = lambda k: corr_matrix(e.where(F.col("half") == k), e.where(F.col("half") == k), "vec_id", "pix", "pix", "x", by=["label"], blocks=1)
    seeds = e.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("a")).withColumn("b", F.col("a"))
    return um.fingerprint_match(side(0), side(1), seeds, ["label"])


@query()
def m10_elastic_net(spark, d):
    return ke.gram_fit(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", "elastic", (0.01, 0.1), l1_ratios=(0.2, 0.8))


@query()
def m10_reduce_then_ridge(spark, d):
    return ke.gram_fit(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", "reduced_ridge", (0.1, 10.0), ranks=(1, 2))


@query(f"""WITH {PTS}, c AS (SELECT session % 6 AS session, CAST(floor(t / 21600) AS BIGINT) AS bin, unit, count(*) AS y FROM pts WHERE unit NOT IN ('purchase', 'click') GROUP BY 1, 2, 3), m AS (SELECT session, unit, avg(y) AS m, count(*) AS k FROM c WHERE bin % 2 = 0 GROUP BY 1, 2)
 SELECT session, unit, round(m, 6) AS coef, round(1 - sum((y - m) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)), 6) AS r2 FROM c JOIN m USING (session, unit) WHERE bin % 2 = 1 GROUP BY session, unit, m""")
def m10_mean_model(spark, d):
    fits = ke.gram_fit(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", "mean")
    return fits.select("session", "unit", F.round("coef", 6).alias("coef"), F.round("r2", 6).alias("r2"))


@query()
def m12_resolved_significance(spark, d):
    return ke.resolved_significance(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", 1.0, {"purchase": ["purchase"], "any": ["purchase", "click"]}, "purchase")


@query()
def m12_leave_out_comparison(spark, d):
    return ke.leave_out_comparison(_folded(_design(spark, d)), _folded(_counts(spark, d)), ["session"], "unit", 1.0, {"purchase": ["purchase"], "click": ["click"]})


def _psth(spark, d):
    """Mean times by subject, level (0: no visual stimulus), side (or none) and a bin of the part, odd and even trials apart."""
    t = _trials(spark, d).withColumns({"vis": F.when(F.col("level") > 0, F.col("level")), "aud": F.when(F.col("kind") != "visual", F.col("side")), "bin": F.col("pk") % 4, "fold": F.col("session") % 2})
    return t.groupBy("subject", "vis", "aud", "bin", "fold").agg(F.avg("rt").alias("rt"))


@query()
def m8_additive_designs(spark, d):
    return ad.additive_designs(_psth(spark, d), ["subject"], "vis", "aud", "bin", "rt")


@query()
def m8_winning_design(spark, d):
    return ad.winning_design(ad.additive_designs(_psth(spark, d), ["subject"], "vis", "aud", "bin", "rt"), ["subject"])


@query(f"""WITH {TR}, p AS (SELECT subject, CASE WHEN level > 0 THEN level END AS vis, CASE WHEN kind <> 'visual' THEN side END AS aud, pk % 4 AS bin, session % 2 AS fold, avg(rt) AS y FROM tr GROUP BY ALL),
 c AS (SELECT count(*) AS k FROM (SELECT DISTINCT vis, aud FROM p)), m AS (SELECT subject, bin, sum(y) / any_value(k) AS m FROM p, c WHERE fold = 0 GROUP BY 1, 2), t AS (SELECT b.subject, b.y, coalesce(a.y, 0) AS r, m.m FROM p b LEFT JOIN p a ON a.subject = b.subject AND a.bin = b.bin AND a.vis IS NOT DISTINCT FROM b.vis AND a.aud IS NOT DISTINCT FROM b.aud AND a.fold = 0 LEFT JOIN m ON m.subject = b.subject AND m.bin = b.bin WHERE b.fold = 1)
 SELECT subject, 'retest' AS model, round(1 - var_pop(y - r) / var_pop(y), 6) AS ve FROM t GROUP BY 1 UNION ALL SELECT subject, 'baseline', round(1 - var_pop(y - m) / var_pop(y), 6) FROM t GROUP BY 1""")
def m8_retest_and_baseline(spark, d):
    scores = ad.additive_designs(_psth(spark, d), ["subject"], "vis", "aud", "bin", "rt").where("model IN ('retest', 'baseline')")
    return scores.withColumn("ve", F.round("ve", 6))


@query(f"""WITH {TR}, r AS (SELECT subject, kind, rt, row_number() OVER (PARTITION BY subject, kind ORDER BY session, ln, pk, rt) - 1 AS i FROM tr), z AS (SELECT subject, count(*) FILTER (kind = 'visual') AS nv, count(*) FILTER (kind = 'auditory') AS na, avg(rt) FILTER (kind = 'coherent') AS m FROM tr GROUP BY 1),
 d AS (SELECT z.*, {_h("d", "2")} % nv AS iv, {_h("d", "3")} % na AS ia FROM z, range(0, 2000) g(d)) SELECT d.subject, round((any_value(m) - avg(v.rt + a.rt)) / stddev_pop(v.rt + a.rt), 6) AS "index" FROM d JOIN r v ON v.subject = d.subject AND v.kind = 'visual' AND v.i = iv JOIN r a ON a.subject = d.subject AND a.kind = 'auditory' AND a.i = ia GROUP BY 1""")
def m17_enhancement_bootstrap(spark, d):
    return fi.enhancement_bootstrap(_trials(spark, d), ["subject"], "kind", "rt", ["session", "ln", "pk", "rt"], draws=2000).withColumn("index", F.round("index", 6))
