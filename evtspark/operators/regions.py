"""The region tree: closure, mapping to listed regions, propagation, and lines in space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtspark.staging import stage


def closure(regions: DataFrame, ident: str = "id", parent: str = "parent") -> DataFrame:
    """(ancestor, descendant, depth), each region also its own ancestor at depth 0; joined level by level to the fixed point."""
    edges = regions.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(ident))).select(F.col(parent).alias("ancestor"), F.col(ident).alias("descendant"))
    step = regions.select(F.col(ident).alias("ancestor"), F.col(ident).alias("descendant"), F.lit(0).alias("depth"))
    out, depth = step, 0
    while True:
        depth += 1
        step = step.withColumnRenamed("descendant", "_m").join(edges.select(F.col("ancestor").alias("_m"), "descendant"), "_m").select("ancestor", "descendant", F.lit(depth).alias("depth"))
        step = stage(step)  # a level is computed once, for its rows and for the next one
        if step.isEmpty():
            return out
        out = out.unionByName(step)


def descendants(tree: DataFrame, region: int) -> DataFrame:
    return tree.where((F.col("ancestor") == region) & (F.col("depth") > 0)).select("descendant", "depth")


def ancestors(tree: DataFrame, region: int) -> DataFrame:
    return tree.where((F.col("descendant") == region) & (F.col("depth") > 0)).select("ancestor", "depth")


def leaves(tree: DataFrame) -> DataFrame:
    inner = tree.where("depth = 1").select(F.col("ancestor").alias("descendant")).distinct()
    return tree.where("depth = 0").select("descendant").join(inner, "descendant", "left_anti")


def map_regions(units: DataFrame, tree: DataFrame, listed: DataFrame, root: int, region: str = "region") -> DataFrame:
    """``units`` with ``mapped``: the nearest listed region at or above, the root if none is; negative ids are the other side; null stays null."""
    up = tree.join(listed.select(F.col("id").alias("ancestor")), "ancestor").groupBy("descendant").agg(F.min_by("ancestor", "depth").alias("_to"))
    out = units.join(up, F.abs(F.col(region)) == F.col("descendant"), "left")
    side = F.when(F.col(region) < 0, -1).otherwise(1)
    return out.withColumn("mapped", F.when(F.col(region).isNotNull(), side * F.coalesce("_to", F.lit(root)))).drop("descendant", "_to")


def propagate_down(values: DataFrame, tree: DataFrame, value: str = "value") -> DataFrame:
    """(descendant, value): median of the values of the region's ancestors, itself included."""
    return tree.join(values.withColumnRenamed("id", "ancestor"), "ancestor").groupBy("descendant").agg(F.percentile(value, 0.5).alias(value))


def fit_line(points: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """(by, centre, direction): principal line of each group's points, from covariance sums and a small eigenvector per group."""
    x, y, z = (F.col(a) for a in axes)
    sums = points.groupBy(*by).agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate((x, y, z))], *[F.covar_pop(axes[i], axes[j]).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])
    keys = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in by)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            c = np.array([[pdf[f"c{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)], float).transpose(2, 0, 1)
            v = np.linalg.eigh(c)[1][:, :, 2] if len(c) else np.empty((0, 3))
            top = np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1)
            out = pdf[by].copy()
            out["centre"] = pdf[["m0", "m1", "m2"]].to_numpy(float).tolist()
            out["direction"] = (v * np.where(top < 0, -1, 1)).tolist()
            yield out

    return sums.mapInPandas(solve, f"{keys}, centre array<double>, direction array<double>")


def project(points: DataFrame, lines: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """``points`` with ``along``, the place along the group's line, and ``distance`` from it."""
    out = points.join(lines, by)
    diff = [F.col(a) - F.get("centre", F.lit(k)) for k, a in enumerate(axes)]
    along = sum(d * F.get("direction", F.lit(k)) for k, d in enumerate(diff))
    rest = sum(d * d for d in diff) - along * along
    return out.withColumn("along", along).withColumn("distance", F.sqrt(F.greatest(rest, F.lit(0.0)))).drop("centre", "direction")
