"""Models of left and right choices: a table of forms, fitted on counted cells, and the choice of predictors.

Trials become counts per condition in Spark; a fit sees one key's cells, whatever
the number of trials. Every form is one function of its parameters with its
derivatives, so that all folds and starting exponents of a key are one batch of
damped Newton steps. Predictions are column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtspark.operators.scan import scan


@dataclass(frozen=True)
class ChoiceModel:
    """A form of the log-odds of right.

    vis, aud: '' (absent), 'one' (a weight times the signed size), 'split' (a weight
    per side) or 'levels' (a weight per level). Visual sizes are raised to a fitted
    power; auditory ones count by their sign under 'one'. history: of 'choice' (the
    choice before), 'win_stay' (times its outcome) and 'outcomes' (apart after
    success and failure). conflict: 'rescaled' (weights of both senses multiplied
    where they agree and where they conflict), 'silent' (no visual part in conflict)
    or 'silent_rescaled' (and the auditory one multiplied). pairs: a weight per
    combination of levels. single: fitted without trials of both senses.
    """

    vis: str = ""
    aud: str = ""
    history: tuple[str, ...] = ()
    conflict: str = ""
    pairs: bool = False
    single: bool = False


MODELS = {
    "bias": ChoiceModel(),
    "vis": ChoiceModel("one"),
    "aud": ChoiceModel("", "one"),
    "simple": ChoiceModel("one", "one"),
    "split_vis": ChoiceModel("split", "one"),
    "split_aud": ChoiceModel("one", "split"),
    "split": ChoiceModel("split", "split"),
    "split_single": ChoiceModel("split", "split", single=True),
    "split_silent": ChoiceModel("split", "split", conflict="silent"),
    "split_silent_rescaled": ChoiceModel("split", "split", conflict="silent_rescaled"),
    "split_rescaled": ChoiceModel("split", "split", conflict="rescaled"),
    "split_choice": ChoiceModel("split", "split", ("choice",)),
    "split_win_stay": ChoiceModel("split", "split", ("choice", "win_stay")),
    "split_outcomes": ChoiceModel("split", "split", ("outcomes",)),
    "levels": ChoiceModel("levels", "levels"),
    "vis_levels": ChoiceModel("levels"),
    "aud_levels": ChoiceModel("", "levels"),
    "split_vis_aud_levels": ChoiceModel("split", "levels"),
    "pairs": ChoiceModel(pairs=True),
}
#: Where a power of the visual size may lie, and where fits begin.
POWERS, STARTS = (0.0, 3.0), (0.4, 1.0, 2.0)
SCALES = ("agree_vis", "conflict_vis", "agree_aud", "conflict_aud")
CELL, TEXTS = ("vis", "aud", "prev_choice", "prev_outcome"), ("vis_text", "aud_text", "pair_text")


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Dealt by key over a set number of tasks: few bytes can be much work, which is not to be put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def choice_cells(trials: DataFrame, by: list[str], order: list[str], vis: str, aud: str, response: str, feedback: str, fold: str | None = None, bucket: float | None = None) -> DataFrame:
    """(by, vis, aud, prev_choice, prev_outcome[, fold], n_right, n): trials counted by condition.

    Sizes are over the key's largest. ``response`` is 1 for left, 2 for right; other
    trials are not counted, though they stand before others. prev_choice is -1, 1 or,
    before the first trial and after trials without a choice, 0; prev_outcome is the
    feedback before, 0 at first. With ``bucket`` trials are cut into slices of so much of
    the first of ``order``, which must leave no ties, and no key is sorted by one task.
    """
    side = F.when(F.col(response) == 2, 1).when(F.col(response) == 1, -1).otherwise(0)
    past = {"prev_choice": side, "prev_outcome": F.coalesce(F.col(feedback), F.lit(0))}
    if bucket is None:
        w = Window.partitionBy(*by).orderBy(*order)
        told = trials.withColumns({"_side": side} | {n: F.lag(c).over(w) for n, c in past.items()})
    else:
        told = scan(trials.withColumn("_side", side), by, order, bucket, {n: ("lag", c) for n, c in past.items()})
    keys = [*by, *CELL, *(["fold"] if fold else [])]
    rows = told.select(*by, F.col(vis).alias("vis"), F.col(aud).alias("aud"), "_side", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in past], *([F.col(fold).alias("fold")] if fold else []))
    # sizes are over the largest of all trials, those without a choice too: rows of equal values are counted before they are divided
    n = rows.groupBy(*keys).agg(F.sum((F.col("_side") == 1).cast("double")).alias("n_right"), F.sum((F.col("_side") != 0).cast("double")).alias("n"))
    whole = Window.partitionBy(*by)
    size = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(F.abs(c)).over(whole)), F.lit(0.0)).cast("double")
    sized = n.select(*by, *[size(c).alias(c) for c in ("vis", "aud")], *keys[len(by) + 2 :], "n_right", "n")
    return sized.where("n > 0").groupBy(*keys).agg(F.sum("n_right").alias("n_right"), F.sum("n").alias("n"))


def choice_entropy(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, bits): sum of p log2 p over both sides: what a guess by frequency alone gets."""
    p = F.try_divide(F.sum("n_right"), F.sum("n"))
    part = lambda q: F.when(q > 0, q * F.log2(q)).otherwise(0.0)
    return cells.groupBy(*by).agg((part(p) + part(1 - p)).alias("bits"))


def parameters(model: ChoiceModel, vis: list[str], aud: list[str], pairs: list[str]) -> list[str]:
    """Names of a form's parameters for the levels that a key has, named by their text."""
    names = ["bias"]
    names += {"": [], "one": ["vis"], "split": ["vis_right", "vis_left"], "levels": [f"vis={x}" for x in vis]}[model.vis]
    names += ["power"] if model.vis in ("one", "split") else []
    names += {"": [], "one": ["aud"], "split": ["aud_right", "aud_left"], "levels": [f"aud={x}" for x in aud]}[model.aud]
    names += [f"pair={x}" for x in pairs] if model.pairs else []
    names += {"": [], "silent": [], "silent_rescaled": ["conflict_aud"], "rescaled": list(SCALES)}[model.conflict]
    return names + [x for h in model.history for x in {"choice": ["prev_choice"], "win_stay": ["prev_win"], "outcomes": ["prev_success", "prev_failure"]}[h]]


def log_odds(model: ChoiceModel, names: list[str], theta, cells: dict):
    """(eta, slopes) for a batch of parameters: log-odds of every cell, and their derivatives by every parameter."""
    import numpy as np

    v, a = cells["vis"], cells["aud"]
    at = {n: i for i, n in enumerate(names)}
    get = lambda n: theta[:, at[n], None]
    slopes = np.zeros((len(theta), len(v), len(names)))
    slopes[:, :, at["bias"]] = 1
    power = get("power") if "power" in at else np.ones((len(theta), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.where(v == 0, 0.0, np.abs(v) ** power)
        grown = np.where(v == 0, 0.0, size * np.log(np.abs(v)))
    seen = {"vis": size * np.sign(v), "vis_right": size * (v > 0), "vis_left": -size * (v < 0)}
    heard = {"aud": np.sign(a), "aud_right": np.abs(a) * (a > 0), "aud_left": -np.abs(a) * (a < 0)}
    seen |= {n: (cells["vis_text"] == n[4:]).astype(float) for n in names if n.startswith("vis=")}
    heard |= {n: (cells["aud_text"] == n[4:]).astype(float) for n in names if n.startswith("aud=")}
    agree, conflict = np.sign(v * a) > 0, np.sign(v * a) < 0
    one = np.ones((len(theta), len(v)))
    scale = {"vis": one, "aud": one}
    if model.conflict == "rescaled":
        scale = {s: np.where(agree, get(f"agree_{s}"), np.where(conflict, get(f"conflict_{s}"), one)) for s in ("vis", "aud")}
    elif model.conflict:
        scale["vis"] = one * ~conflict
        if model.conflict == "silent_rescaled":
            scale["aud"] = np.where(conflict, get("conflict_aud"), one)
    eta = get("bias") * one
    for sense, part in (("vis", seen), ("aud", heard)):
        bare = np.zeros_like(eta)
        for n, x in part.items():
            if n in at:
                bare = bare + get(n) * x
                slopes[:, :, at[n]] = scale[sense] * x
        if sense == "vis" and "power" in at:
            own = sum((get(n) * np.sign(seen[n]) * grown for n in ("vis", "vis_right", "vis_left") if n in at), np.zeros_like(eta))
            slopes[:, :, at["power"]] = scale["vis"] * own
        for n, where in ((f"agree_{sense}", agree), (f"conflict_{sense}", conflict)):
            if n in at:
                slopes[:, :, at[n]] = bare * where
        eta = eta + scale[sense] * bare
    before, outcome = cells["prev_choice"], cells["prev_outcome"]
    rest = {"prev_choice": before, "prev_win": before * outcome, "prev_success": before * (outcome == 1), "prev_failure": before * (outcome == -1)}
    rest |= {n: (cells["pair_text"] == n[5:]).astype(float) for n in names if n.startswith("pair=")}
    for n, x in rest.items():
        if n in at:
            slopes[:, :, at[n]] = x
            eta = eta + get(n) * x
    return eta, slopes


def bits_lost(eta, right, n):
    """Mean -log2 p of each of a batch; nan without trials."""
    import numpy as np

    total = n.sum(-1)
    loss = (n * np.logaddexp(0, eta) - right * eta).sum(-1) / np.log(2)
    return np.where(total > 0, loss / np.maximum(total, 1e-300), np.nan)


def newton(model: ChoiceModel, names: list[str], start, free, cells: dict, right, n, steps: int = 200):
    """Parameters of the least loss for a batch of counts, from a batch of starts, by Newton steps damped each on its own."""
    import numpy as np

    theta, own = start.copy(), np.flatnonzero(free)
    power = names.index("power") if "power" in names else None
    damp, small = np.full(len(theta), 1e-3), 1e-9
    cost = lambda t: (n * np.logaddexp(0, e := log_odds(model, names, t, cells)[0]) - right * e).sum(1) + small / 2 * (t * t).sum(1)
    now = cost(theta)
    for _ in range(steps):
        eta, slopes = log_odds(model, names, theta, cells)
        p = 1 / (1 + np.exp(-np.clip(eta, -40, 40)))
        x = slopes[:, :, own]
        slope = ((right - n * p)[:, None, :] @ x)[:, 0] - small * theta[:, own]
        bend = x.transpose(0, 2, 1) @ (x * (n * p * (1 - p))[:, :, None])
        diagonal = np.einsum("bpp->bp", bend)
        bend = bend + np.eye(len(own)) * (damp[:, None] * diagonal + 1e-10 * diagonal.max(1, keepdims=True) + small)[:, None, :]
        new = theta.copy()
        new[:, own] += np.clip(np.linalg.solve(bend, slope[:, :, None])[:, :, 0], -4, 4)
        if power is not None:
            new[:, power] = np.clip(new[:, power], *POWERS)
        then = cost(new)
        better = then < now
        gain = np.where(better, now - then, 0)
        theta, now = np.where(better[:, None], new, theta), np.where(better, then, now)
        damp = np.clip(np.where(better, damp / 5, damp * 6), 1e-12, 1e9)
        if (gain <= 1e-13 * (1 + now)).all() and (better | (damp > 1e3)).all():
            break
    return theta


def fit_choice_models(cells: DataFrame, by: list[str], models: list[str], folds: int = 0, fixed: DataFrame | None = None, free: list[str] | None = None) -> DataFrame:
    """(by, model, fold, params, train_loss, test_loss, n_train, n_test) for every model of ``MODELS`` named.

    Fold -1 is fitted on all cells; with ``folds``, fold k on the cells of the other
    folds and tested on its own (``cells.fold`` from 0). Losses are mean -log2 p in
    bits, null without trials. With ``fixed`` (fits of fold -1) parameters begin, and
    those not in ``free`` stay, at its values. A power is sought from several starts,
    the least loss stays. A group is one key's cells for one model.
    """
    kinds = [f"{k} {cells.schema[k].dataType.simpleString()}" for k in by]
    schema = ", ".join([*kinds, "model string, fold int, params map<string,double>, train_loss double, test_loss double, n_train double, n_test double"])
    texts = {"vis_text": F.col("vis").cast("string"), "aud_text": F.col("aud").cast("string"), "pair_text": F.concat_ws(",", F.col("vis").cast("string"), F.col("aud").cast("string"))}
    rows = cells.withColumns({c: F.lit(0) for c in ("prev_choice", "prev_outcome", "fold") if c not in cells.columns})
    rows = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    past = F.col("model").isin([m for m in models if MODELS[m].history])  # other models need no cells apart by what was before
    rows = rows.withColumns({c: F.when(past, F.col(c)).otherwise(0) for c in ("prev_choice", "prev_outcome")})
    rows = rows.groupBy(*by, "model", *CELL, "fold").agg(F.sum("n_right").alias("n_right"), F.sum("n").alias("n")).withColumns(texts)
    if fixed is not None:
        rows = rows.join(fixed.where("fold = -1").select(*by, "model", F.map_entries("params").alias("_fixed")), [*by, "model"])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        name = pdf["model"].iloc[0]
        model = MODELS[name]
        own = {c: pdf[c].to_numpy(float) for c in CELL} | {c: pdf[c].to_numpy(str) for c in TEXTS}
        names = parameters(model, *(sorted(set(own[c])) for c in TEXTS))
        right, n, fold = (pdf[c].to_numpy(float) for c in ("n_right", "n", "fold"))
        known = {e["key"]: e["value"] for e in pdf["_fixed"].iloc[0]} if "_fixed" in pdf else {}
        begin = np.array([known.get(x, 1.0 if x in SCALES or x == "power" else 1e-4) for x in names])
        may = np.array([free is None or x in free for x in names])
        parts = range(-1, folds)
        starts = STARTS if "power" in names and may[names.index("power")] and not known else (None,)
        batch = np.tile(begin, (len(parts) * len(starts), 1))
        if starts[0] is not None:
            batch[:, names.index("power")] = np.tile(starts, len(parts))
        used = np.array([fold != k for k in parts]) & ~(model.single & (own["vis"] != 0) & (own["aud"] != 0))
        train = np.repeat(used, len(starts), 0)
        theta = newton(model, names, batch, may, own, right * train, n * train) if may.any() else batch
        eta = log_odds(model, names, theta, own)[0]
        loss = bits_lost(eta, right * train, n * train).reshape(len(parts), -1)
        best = np.where(np.isnan(loss), np.inf, loss).argmin(1) + np.arange(len(parts)) * len(starts)
        out = []
        for k, b in zip(parts, best, strict=True):
            test = fold == k
            out.append([*(pdf[c].iloc[0] for c in by), name, k, dict(zip(names, theta[b].tolist(), strict=True)), float(loss.ravel()[b]), float(bits_lost(eta[b], right * test, n * test)), (n * train[b]).sum(), (n * test).sum()])
        return pd.DataFrame(out, columns=[*by, "model", "fold", "params", "train_loss", "test_loss", "n_train", "n_test"])

    made = _spread(rows, [*by, "model"]).groupBy(*by, "model").applyInPandas(solve, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("train_loss", "test_loss")})


def log_odds_column(model: str, vis: Column, aud: Column, prev_choice: Column, prev_outcome: Column, params: Column) -> Column:
    """The form's log-odds of right as an expression; a parameter that ``params`` lacks (a level not fitted) counts 0."""
    form = MODELS[model]
    get = lambda n: F.coalesce(params[n], F.lit(0.0))
    level = lambda kind, text: F.coalesce(F.try_element_at(params, F.concat(F.lit(f"{kind}="), text)), F.lit(0.0))
    size = F.pow(F.abs(vis), get("power"))
    by_side = lambda x, sense: F.when(x > 0, get(f"{sense}_right")).when(x < 0, -get(f"{sense}_left")).otherwise(0.0)
    seen = {"": F.lit(0.0), "one": get("vis") * size * F.signum(vis), "split": by_side(vis, "vis") * size, "levels": level("vis", vis.cast("string"))}[form.vis]
    heard = {"": F.lit(0.0), "one": get("aud") * F.signum(aud), "split": by_side(aud, "aud") * F.abs(aud), "levels": level("aud", aud.cast("string"))}[form.aud]
    sign = F.signum(vis * aud)
    if form.conflict == "rescaled":
        seen, heard = (x * F.when(sign > 0, get(f"agree_{s}")).when(sign < 0, get(f"conflict_{s}")).otherwise(1.0) for x, s in ((seen, "vis"), (heard, "aud")))
    elif form.conflict:
        seen = F.when(sign < 0, 0.0).otherwise(seen)
        heard = heard * F.when((sign < 0) & F.lit(form.conflict == "silent_rescaled"), get("conflict_aud")).otherwise(1.0)
    past = get("prev_choice") * prev_choice + get("prev_win") * prev_choice * prev_outcome
    past = past + prev_choice * F.when(prev_outcome == 1, get("prev_success")).when(prev_outcome == -1, get("prev_failure")).otherwise(0.0)
    pair = level("pair", F.concat_ws(",", vis.cast("string"), aud.cast("string"))) if form.pairs else F.lit(0.0)
    return get("bias") + seen + heard + past + pair


def choice_probability(points: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """``points`` (by, vis, aud[, prev_choice, prev_outcome]) with ``model``, ``fold`` and ``p_right`` under every fit of their key."""
    given = points.withColumns({c: F.lit(0) for c in ("prev_choice", "prev_outcome") if c not in points.columns})
    told = given.join(fits.select(*by, "model", F.col("fold").alias("_fold"), "params"), by)
    eta = F.lit(None).cast("double")
    for m in MODELS:
        eta = F.when(F.col("model") == m, log_odds_column(m, *(F.col(c).cast("double") for c in CELL), F.col("params"))).otherwise(eta)
    return told.withColumn("p_right", 1 / (1 + F.exp(-eta))).drop("params")


def compare_choice_models(fits: DataFrame, by: list[str]) -> DataFrame:
    """(by, model, loss, place): losses on the folds left out, weighted by their trials, the least first; equal ones by name."""
    told = fits.where("fold >= 0 AND test_loss IS NOT NULL").groupBy(*by, "model").agg((F.sum(F.col("test_loss") * F.col("n_test")) / F.sum("n_test")).alias("loss"))
    return told.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("loss", 9), "model")))


# -- predictors of a choice ----------------------------------------------------------------------------


def logistic(x, y, use, penalty: float = 1.0, steps: int = 40):
    """Weights (b, p) of ridge logistic regressions on a batch of designs (b, n, p), each on the rows that ``use`` (b, n) marks; no intercept of their own."""
    import numpy as np

    w = np.zeros((len(x), x.shape[2]))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((x @ w[:, :, None])[:, :, 0], -40, 40)))
        slope = (((y - p) * use)[:, None, :] @ x)[:, 0] - penalty * w
        bend = x.transpose(0, 2, 1) @ (x * (p * (1 - p) * use)[:, :, None]) + penalty * np.eye(x.shape[2])
        step = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return w


def sparse_logistic(x, y, penalty: float = 1.0, steps: int = 300):
    """Weights of the logistic regression with the sum of their sizes as penalty, the last column (a constant) included: coordinate steps on the squared error that bends as much as the loss can."""
    import numpy as np

    w, eta = np.zeros(x.shape[1]), np.zeros(len(x))
    bend = np.maximum((x * x).sum(0) / 4, 1e-12)
    for _ in range(steps):
        most = 0.0
        for j in range(x.shape[1]):
            slope = x[:, j] @ (1 / (1 + np.exp(-np.clip(eta, -40, 40))) - y)
            new = w[j] - slope / bend[j]
            new = np.sign(new) * max(abs(new) - penalty / bend[j], 0.0)
            if new != w[j]:
                eta += x[:, j] * (new - w[j])
                most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-8:
            break
    return w


def scores(y, eta) -> tuple[float, float, float, float]:
    """(log loss, AUC by average ranks, accuracy, balanced accuracy) in nats and shares; nan where one class is absent."""
    import numpy as np

    if len(set(y.tolist())) < 2:
        return (np.nan,) * 4
    loss = np.mean(np.logaddexp(0, eta) - y * eta)
    _, place, count = np.unique(eta, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n1 = y.sum()
    auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
    right = (eta > 0) == (y == 1)
    return loss, auc, right.mean(), (right[y == 1].mean() + right[y == 0].mean()) / 2


def forward_selection(x, y, fold, candidates: list[int], gain: float) -> list[int]:
    """Columns in the order taken: each time the one that tells most left-out rows right, while that adds ``gain`` to their share; of equals the first."""
    import numpy as np

    folds, taken, best = np.unique(fold), [], -np.inf
    one = np.ones((len(x), 1))
    use = np.array([fold != k for k in folds], float)
    while candidates:
        share = []
        for j in candidates:
            design = np.c_[x[:, [*taken, j]], one]
            w = logistic(np.repeat(design[None], len(folds), 0), y, use)
            hit = (np.einsum("np,bp->bn", design, w) > 0) == (y == 1)
            share.append(np.mean([hit[b, fold == k].mean() for b, k in enumerate(folds)]))
        if max(share) - best < gain:
            break
        best = max(share)
        taken.append(candidates[int(np.argmax(share))])
        candidates = [j for j in candidates if j != taken[-1]]
    return taken


POWER_GRID = [round(0.1 * k, 2) for k in range(1, 20)]


def neurometric_models(
    trials: DataFrame, by: list[str], label: str, test: str, stimuli: list[str], powered: list[str], neurons: list[str], order: str,
    selector: str = "forward", gains: tuple[float, ...] = (0.01,), thresholds: tuple[float, ...] = (0.2,), folds: int = 5,
) -> DataFrame:
    """(by, model, part, n, log_loss, auc, accuracy, balanced_accuracy, power, setting, taken, weights): what stimuli, neurons and both tell of a choice.

    Models: bias, stim, neur and all. Rows with ``test`` are left out of every choice
    and fit (part 'test'). The power of the columns ``powered`` is the one of least
    log loss over inner stratified folds in model stim, and stays for all. Neurons
    that vary by 0.001 at least are chosen forward ('gain' of left-out accuracy) or by
    a sparse regression ('lasso', size over a threshold); with several gains or
    thresholds that of least inner log loss counts. Weights have a penalty of half
    their squares, the bias too. Nulls count 0; rows without a label go. A group is
    one key's trials by its columns.
    """
    import numpy as np

    columns = [*stimuli, *neurons]
    kinds = [f"{k} {trials.schema[k].dataType.simpleString()}" for k in by]
    measures = ["log_loss", "auc", "accuracy", "balanced_accuracy"]
    schema = ", ".join([*kinds, "model string, part string, n long", *(f"{m} double" for m in measures), "power double, setting double, taken array<string>, weights map<string,double>"])
    rows = trials.where(F.col(label).isNotNull()).select(*by, F.col(order).alias("_o"), F.col(label).cast("double").alias("_y"), F.col(test).alias("_t"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])

    def solve(pdf):
        import pandas as pd

        from evtspark.operators.fits import stratified_folds

        pdf = pdf.sort_values("_o", kind="stable")
        y, out, learn = pdf["_y"].to_numpy(float), pdf["_t"].to_numpy(bool), ~pdf["_t"].to_numpy(bool)
        x = {c: pdf[c].to_numpy(float) for c in columns}
        one = np.ones(len(y))
        fold = np.full(len(y), -1)
        if learn.sum() >= folds:
            fold[learn] = stratified_folds(y[learn], folds, 0)
        inner = np.array([learn & (fold != k) for k in range(folds)], float)

        def design(names, power):
            raised = [np.sign(x[c]) * np.abs(x[c]) ** power if c in powered else x[c] for c in names]
            return np.stack([*raised, one], 1)

        def inner_loss(m):
            w = logistic(np.repeat(m[None], folds, 0), y, inner)
            told = [scores(y[fold == k], m[fold == k] @ w[k])[0] for k in range(folds)]
            return np.nanmean(told) if np.isfinite(told).any() else np.inf

        power = min(POWER_GRID, key=lambda p: (round(inner_loss(design(stimuli, p)), 12), p)) if stimuli and learn.any() else 1.0
        varying = [c for c in neurons if learn.any() and np.var(x[c][learn]) > 0.001]

        def choose(base):
            found = []
            own = np.stack([x[c][learn] for c in varying], 1) if varying else np.zeros((learn.sum(), 0))
            weights = sparse_logistic(np.c_[own, np.ones(len(own))], y[learn]) if selector == "lasso" and varying else None
            for s in thresholds if selector == "lasso" else gains:
                taken = [varying[j] for j in np.flatnonzero(np.abs(weights[:-1]) > s)] if weights is not None else []
                if selector == "forward" and varying:
                    taken = [varying[j] for j in forward_selection(own, y[learn], fold[learn], list(range(len(varying))), s)]
                found.append((round(inner_loss(design([*base, *taken], power)), 12), s, taken))
            return min(found, key=lambda f: f[:2])[1:]

        none = (np.nan, [])
        made = []
        for name, base, (setting, taken), p in (("bias", [], none, np.nan), ("stim", stimuli, none, power), ("neur", [], choose([]), np.nan), ("all", stimuli, choose(stimuli), power)):
            names = [*base, *taken]
            m = design(names, power)
            w = logistic(m[None], y, learn[None].astype(float))[0]
            told = dict(zip([*names, "bias"], w.tolist(), strict=True))
            for part, rows_ in (("train", learn), ("test", out)):
                made.append([*(pdf[c].iloc[0] for c in by), name, part, int(rows_.sum()), *scores(y[rows_], m[rows_] @ w), p, setting, taken, told])
        return pd.DataFrame(made, columns=[*by, "model", "part", "n", *measures, "power", "setting", "taken", "weights"])

    done = _spread(rows, by).groupBy(*by).applyInPandas(solve, schema)
    return done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (*measures, "power", "setting")})
