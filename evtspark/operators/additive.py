"""Additive designs of responses to visual and auditory conditions, fitted by one hat matrix each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DESIGNS = ("retest", "vis_aud", "vis", "aud", "aud_any", "vis_aud_any", "baseline", "nonlinear")


def hat_matrices(conditions: list[tuple], ridge: float = 0.0):
    """{design: matrix} that takes mean responses to ``conditions`` (vis, aud; None for absent) to fitted ones.

    vis, aud: a column per place; aud_any: one for any sound; nonlinear: both senses'
    columns and one per condition whose places agree; all have a baseline. 'retest'
    leaves responses as they are. ``ridge`` adds that times the identity to a
    design's rows, its square to the normal equations.
    """
    import numpy as np

    is_ = lambda k, x: np.array([c[k] == x for c in conditions], float)
    places = [sorted({c[k] for c in conditions if c[k] is not None}) for k in (0, 1)]
    one, sound = np.ones(len(conditions)), np.array([c[1] is not None for c in conditions], float)
    vis, aud = ([is_(k, x) for x in places[k]] for k in (0, 1))
    agree = [is_(0, x) * is_(1, x) for x in places[0] if x in places[1]]
    columns = {"vis_aud": [*vis, *aud], "vis": vis, "aud": aud, "aud_any": [sound], "vis_aud_any": [*vis, sound], "baseline": [], "nonlinear": [*vis, *aud, *agree]}
    out = {"retest": np.eye(len(conditions))}
    for name, own in columns.items():
        x = np.stack([*own, one], 1)
        out[name] = x @ np.linalg.pinv(x.T @ x + ridge * ridge * np.eye(x.shape[1]), rcond=1e-10) @ x.T
    return out


def additive_designs(psth: DataFrame, by: list[str], vis: str, aud: str, bin_col: str, value: str, fold: str = "fold", ridge: float = 0.0) -> DataFrame:
    """(by, model, ve): explained variance on fold 1, over conditions and bins, of each design fitted bin by bin on fold 0.

    ``psth(by, vis, aud, bin, fold, value)`` are mean responses; a null place is an
    absent stimulus. A condition that a key and bin has no response to counts 0 in
    fits and is left out of the test. What is sent to tasks has as many rows as
    conditions squared. ve is null where the test does not vary.
    """
    names = [(r[0], r[1]) for r in psth.select(vis, aud).distinct().orderBy(vis, aud).collect()]
    spark = psth.sparkSession
    kinds = [psth.schema[c].dataType.simpleString() for c in (vis, aud)]
    index = spark.createDataFrame([(k, *n) for k, n in enumerate(names)], f"_c int, _v {kinds[0]}, _a {kinds[1]}")
    hats = hat_matrices(names, ridge) if names else {}
    hat = spark.createDataFrame([(m, o, i, float(h[o, i])) for m, h in hats.items() for o in range(len(names)) for i in range(len(names)) if abs(h[o, i]) > 1e-14], "model string, _o int, _c int, _h double")
    rows = psth.join(F.broadcast(index), F.col(vis).eqNullSafe(F.col("_v")) & F.col(aud).eqNullSafe(F.col("_a"))).select(*by, F.col(bin_col).alias("_b"), F.col(fold).alias("_f"), "_c", F.col(value).cast("double").alias("_y"))
    told = rows.where("_f = 0").join(F.broadcast(hat), "_c").groupBy(*by, "_b", "model", F.col("_o").alias("_c")).agg(F.sum(F.col("_h") * F.col("_y")).alias("_p"))
    test = rows.where("_f = 1 AND _y IS NOT NULL").crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in DESIGNS], "model string")))
    both = test.join(told, [*by, "_b", "model", "_c"], "left").na.fill(0.0, ["_p"])
    ve = 1 - F.try_divide(F.var_pop(F.col("_y") - F.col("_p")), F.var_pop("_y"))
    return both.groupBy(*by, "model").agg(ve.alias("ve"))


def winning_design(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, model, ve): the design of largest ve, retest aside; of equals (to nine places) the one that comes first in DESIGNS."""
    place = F.array_position(F.array(*[F.lit(m) for m in DESIGNS]), F.col("model"))
    best = F.max_by(F.struct("model", "ve"), F.struct(F.round("ve", 9), -place))
    return scores.where("model <> 'retest' AND ve IS NOT NULL").groupBy(*by).agg(best.alias("_x")).select(*by, "_x.model", "_x.ve")
