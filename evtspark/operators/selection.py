"""Selecting subjects, sessions, units and trials. Conditions that meet a missing value count as false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def number(c: Column) -> Column:
    """NaN as null, so that comparisons with it are false."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def select_subjects(catalog: DataFrame, main: DataFrame, which: str | list[str], subject: str = "subject") -> DataFrame:
    """Sessions of 'all', 'allActive' or 'implanted' subjects, or of the named ones."""
    if which == "all":
        return catalog
    if isinstance(which, list):
        return catalog.where(F.col(subject).isin(which))
    if which == "allActive":
        keep = main.where("IsActive = '1'")
    else:
        keep = main.where(F.col("P0_implantDate").rlike(r"\d{4}-\d{2}-\d{2}") & (F.col("P0_type") != "P3B"))
    return catalog.join(keep.select(subject).distinct(), subject, "left_semi")


def select_dates(catalog: DataFrame, spec: str | list[str], now: str, col: str = "expDate") -> DataFrame:
    """'all', a day, 'a:b' inclusive, 'previousN' days back from ``now``, or a list of days."""
    day = F.to_date(F.col(col))
    if isinstance(spec, list):
        return catalog.where(F.date_format(day, "yyyy-MM-dd").isin(spec))
    if spec == "all":
        return catalog
    if spec.startswith("previous"):
        return catalog.where(day >= F.date_sub(F.to_date(F.lit(now)), int(spec.removeprefix("previous"))))
    first, _, last = spec.partition(":")
    return catalog.where(day.between(F.to_date(F.lit(first)), F.to_date(F.lit(last or first))))


def last_dates(catalog: DataFrame, n: int, by: list[str], col: str = "expDate", first: bool = False) -> DataFrame:
    """Sessions of each key's last (or first) n different days."""
    w = Window.partitionBy(*by).orderBy(F.asc(col) if first else F.desc(col))
    return catalog.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")


def last_rows(catalog: DataFrame, n: int, by: list[str], order: list[str], first: bool = False) -> DataFrame:
    """Each key's last (or first) n rows."""
    w = Window.partitionBy(*by).orderBy(*[F.asc(c) if first else F.desc(c) for c in order])
    return catalog.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def post_implant(catalog: DataFrame, main: DataFrame, subject: str = "subject", date: str = "expDate", implant: str = "P0_implantDate") -> DataFrame:
    """Sessions on or after the subject's implant day, with ``days_since_implant``; subjects without one go."""
    when = main.select(subject, F.to_date(F.when(F.col(implant).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(implant))).alias("_d")).where("_d IS NOT NULL")
    return catalog.join(when, subject).withColumn("days_since_implant", F.datediff(F.to_date(F.col(date)), "_d")).where("days_since_implant >= 0").drop("_d")


def last_days(catalog: DataFrame, n: int, now: str, col: str = "expDate") -> DataFrame:
    """Sessions within n days before ``now``."""
    return catalog.where(holds(F.datediff(F.to_date(F.lit(now)), F.to_date(F.col(col))) <= n))


#: Short names of protocols, and the protocol names that they stand for.
ALIASES = {
    "t": ["multiSpaceWorld_checker_training", "multiSpaceWorld_checker", "multiSpaceWorld", "multiSpaceSwitchWorld", "multiSpaceWorld_checker_training_block"],
    "p": ["AVPassive_ckeckerboard_postactive", "AVPassive_checkerboard_extended"],
    "s": ["spontaneousActivity"],
    "i": ["imageWorld_AllInOne", "imageWorld_lefthemifield", "imageWorld2"],
    "n": ["sparseNoise", "AP_sparseNoise"],
}


def select_protocol(catalog: DataFrame, spec: list[str], col: str = "expDef", regex: bool = True, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Rows whose protocol matches any of the patterns, or equals any of the (aliased) names without regard to case."""
    if regex:
        found = F.lit(False)
        for pattern in spec:
            found = found | F.col(col).rlike(pattern)
        return catalog.where(holds(found))
    names = [n.lower() for s in spec for n in aliases.get(s, [s])]
    return catalog.where(holds(F.lower(F.col(col)).isin(names)))


def select_numbers(catalog: DataFrame, numbers: list, col: str = "expNum") -> DataFrame:
    return catalog.where(holds(F.col(col).isin(numbers)))


def select_status(catalog: DataFrame, col: str, value: str) -> DataFrame:
    """Rows whose flag contains ``value``, or, with a leading ~, does not; null flags go."""
    hit = F.col(col).contains(value.lstrip("~"))
    return catalog.where(holds(~hit if value.startswith("~") else hit))


def select_align_any(catalog: DataFrame, cols: list[str], value: str) -> DataFrame:
    """Rows with ``value`` in any of the flag columns."""
    return catalog.where(F.concat_ws("", *cols).contains(value))


def select_rig(catalog: DataFrame, part: str, col: str = "rigName") -> DataFrame:
    return catalog.where(holds(F.col(col).contains(part)))


def filter_rows(df: DataFrame, cond: Column) -> DataFrame:
    return df.where(holds(cond))


def session_in_region(units: DataFrame, by: list[str], region: str, name: str, min_fraction: float, good: Column | None = None, substring: bool = True) -> DataFrame:
    """Keys whose share (``min_fraction`` up to 1) or count (over 1) of units in the region is strictly larger than it."""
    hit = F.col(region).contains(name) if substring else F.col(region) == name
    rows = units.where(holds(good)) if good is not None else units
    measure = F.avg if min_fraction <= 1 else F.sum
    return rows.groupBy(*by).agg(measure(holds(hit).cast("double")).alias("_m")).where(F.col("_m") > min_fraction).select(*by)


def region_3class(acronym: Column) -> Column:
    """Superficial, intermediate or deep; the first that matches."""
    superficial = acronym.contains("SCs") | acronym.contains("SCo") | acronym.contains("SCzo")
    return F.when(superficial, "SCs").when(acronym.contains("SCi"), "SCi").when(acronym.contains("SCd"), "SCd").otherwise("nontarget")


#: Fixed values. Limits of unit metrics: (metric, comparison that makes noise) and (metric, comparison that good units pass).
NOISE = {"nPeaks": (">", 2), "nTroughs": (">", 1), "isSomatic": ("!=", 1), "spatialDecaySlope": (">", -0.003), "waveformDuration_peakTrough": ("outside", (100, 800)), "waveformBaselineFlatness": (">", 0.3)}
GOOD = {"nSpikes": (">=", 300), "fractionRPVs_estimatedTauR": ("<=", 0.1), "rawAmplitude": (">=", 20), "percentageSpikesMissing_gaussian": ("<=", 20), "signalToNoiseRatio": (">=", 0.1), "presenceRatio": (">=", 0.2)}


def _test(metric: str, rule: tuple) -> Column:
    op, limit = rule
    c = number(F.col(metric))
    tests = {">": lambda: c > limit, ">=": lambda: c >= limit, "<=": lambda: c <= limit, "<": lambda: c < limit, "!=": lambda: c.isNull() | (c != limit), "outside": lambda: (c < limit[0]) | (c > limit[1])}
    return holds(tests[op]())


def unit_quality(units: DataFrame, noise: dict | None = None, good: dict | None = None) -> DataFrame:
    """``quality``: noise if any noise rule holds, good if all good rules do, else mua. A missing metric holds no rule but ``!=``."""
    bad = fine = None
    for m, rule in (noise or NOISE).items():
        bad = _test(m, rule) if bad is None else bad | _test(m, rule)
    for m, rule in (good or GOOD).items():
        fine = _test(m, rule) if fine is None else fine & _test(m, rule)
    return units.withColumn("quality", F.when(bad, "noise").when(fine, "good").otherwise("mua"))


def valid_active_trials(trials: DataFrame, rt_min: float | None = None, rt_max: float | None = None, no_change_of_mind: bool = False) -> DataFrame:
    """Valid answered trials off 30 degrees (a missing azimuth passes), reaction time within the inclusive range."""
    cond = F.col("is_validTrial") & (F.col("response_direction") != 0) & (F.coalesce(F.abs(number(F.col("stim_audAzimuth"))), F.lit(-1.0)) != 30)
    if no_change_of_mind:
        cond = cond & (F.col("timeline_firstMoveDir") == F.col("timeline_choiceMoveDir"))
    if rt_min is not None:
        cond = cond & (number(F.col("rt")) >= rt_min)
    if rt_max is not None:
        cond = cond & (number(F.col("rt")) <= rt_max)
    return trials.where(holds(cond))


def select_trials(trials: DataFrame, onset: str, contrast: list[float] | None = None, spl: list[float] | None = None) -> DataFrame:
    """Valid trials with an onset whose values match at two decimals: contrast is cut, sound level rounded."""
    cond = F.col("is_validTrial") & number(F.col(onset)).isNotNull()
    if contrast is not None:
        cond = cond & F.floor(F.round(F.col("stim_visContrast") * 100, 6)).isin([int(round(c * 100, 6)) for c in contrast])
    if spl is not None:
        cond = cond & F.round(F.col("stim_audAmplitude") * 100).cast("long").isin([round(c * 100) for c in spl])
    return trials.where(holds(cond))


def derive_trials(trials: DataFrame, reverse: bool = False) -> DataFrame:
    """Signed differences, reaction times and signed power; mirrored where ``reverse`` and no power of the session is positive."""
    out = trials.withColumns({
        "visDiff": F.coalesce(number(F.col("stim_visContrast")) * F.signum(number(F.col("stim_visAzimuth"))), F.lit(0.0)),
        "audDiff": F.coalesce(F.signum(number(F.col("stim_audAzimuth"))), F.lit(0.0)),
        "rt": F.col("timeline_choiceMoveOn") - F.least("timeline_audPeriodOn", "timeline_visPeriodOn"),
        "rt_aud": F.col("timeline_choiceMoveOn") - F.col("timeline_audPeriodOn"),
        "signed_power": F.coalesce(F.col("stim_laser1_power"), F.lit(0.0)) * F.signum(F.coalesce(F.col("stim_laserPosition"), F.lit(0.0))),
    })
    if not reverse:
        return out
    mirror = F.max("signed_power").over(Window.partitionBy("session")) <= 0
    flip = lambda c: F.when(mirror, -F.col(c)).otherwise(F.col(c))
    choice = F.when(mirror & F.col("response_direction").isin(1, 2), 3 - F.col("response_direction")).otherwise(F.col("response_direction"))
    return out.withColumns({"visDiff": flip("visDiff"), "audDiff": flip("audDiff"), "response_direction": choice})


def best_camera(cameras: DataFrame, by: list[str], order: list[str], camera: str = "camera") -> DataFrame:
    """Each session's first camera, in priority order, that has times and values; sessions without one go."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(camera))
    usable = cameras.where(F.col("has_times") & F.col("has_values") & (rank > 0)).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(rank)))
    return usable.where("_r = 1").drop("_r")


def trial_type(mode: str, aud: Column, vis: Column) -> Column:
    """Kind of a trial from signed sides ('task'), locations ('passive') or azimuth codes ('azimuth', -1000 for none)."""
    if mode == "task":
        return F.when((aud == 0) & (vis == 0), "blank").when(vis == 0, "auditory").when(aud == 0, "visual").when(aud * vis > 0, "coherent").otherwise("conflict")
    none = (lambda c: c.isNull()) if mode == "passive" else (lambda c: number(c).isNull() | (c == -1000))
    return F.when(none(aud) & none(vis), "noStim").when(none(vis), "auditory").when(none(aud), "visual").when(aud == vis, "coherent").otherwise("conflict")


def recode_response(correct: Column, feedback: Column) -> Column:
    """0 none, 1 left, 2 right, from the correct side (1, 2) and the feedback (-1, 0, 1)."""
    return F.when(feedback == 0, 0).when(feedback > 0, correct).otherwise(3 - correct)


def session_criteria(trials: DataFrame, by: list[str], kept: Column, minimum: int = 150) -> DataFrame:
    """Trials of the keys with more than ``minimum`` usable ones."""
    good = trials.groupBy(*by).agg(F.sum(holds(kept).cast("int")).alias("_n")).where(F.col("_n") > minimum)
    return trials.join(good.select(*by), by, "left_semi")


def quality_gate(metrics: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Rows whose metrics reach the lower and keep the upper cut-offs; missing counts are 0."""
    cond = F.lit(True)
    for c, x in least.items():
        cond = cond & (F.coalesce(F.col(c), F.lit(0)) >= x)
    for c, x in most.items():
        cond = cond & holds(F.col(c) <= x)
    return metrics.where(cond)


def attach_default(rows: DataFrame, meta: DataFrame, by: list[str], defaults: dict[str, float]) -> DataFrame:
    """``rows`` with the metadata of their key, defaults where there is none."""
    out = rows.join(meta, by, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def drop_first_trial(events: DataFrame, starts: DataFrame, by: list[str], on: str = "t", trial: str = "trial") -> DataFrame:
    """Events from trial 2 on, times and trial numbers counted from there."""
    second = starts.where(F.col(trial) == 2).select(*by, F.col("t_start").alias("_t2"))
    kept = events.join(second, by).where((F.col(on) >= F.col("_t2")) & (F.col(trial) >= 2))
    return kept.withColumns({on: F.col(on) - F.col("_t2"), trial: F.col(trial) - 1}).drop("_t2")


def protocol_class(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The class of the first rule whose text the name contains; 'unknown' if none."""
    out = F.when(name.contains(rules[0][0]), rules[0][1])
    for part, kind in rules[1:]:
        out = out.when(name.contains(part), kind)
    return out.otherwise("unknown")


def glm_predictors(trials: DataFrame, vis: str = "vis", aud: str = "aud", flag: str = "is_laser") -> DataFrame:
    """Side-split predictors, their products with the perturbation flag, and the trial type's number; types with one trial go."""
    split = {"visR": F.greatest(F.col(vis), F.lit(0)), "visL": F.greatest(-F.col(vis), F.lit(0)), "audR": (F.col(aud) > 0).cast("int"), "audL": (F.col(aud) < 0).cast("int")}
    out = trials.withColumns(split | {"bias": F.lit(1)})
    out = out.withColumns({f"{c}_opto": F.col(c) * F.col(flag).cast("int") for c in [*split, "bias"]})
    kinds = out.groupBy(vis, aud, flag).agg(F.count("*").alias("_n")).where("_n >= 2").withColumn("type_id", F.dense_rank().over(Window.orderBy(vis, aud, flag)))
    return out.join(kinds.drop("_n"), [vis, aud, flag])


def rescale_amplitude(units: DataFrame, factors: dict[str, float], source: str, col: str) -> DataFrame:
    """``col`` times the factor of its source; 1 for others."""
    pairs = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])
    return units.withColumn(col, F.col(col) * F.coalesce(F.try_element_at(pairs, F.col(source)), F.lit(1.0)))


def format_units(units: DataFrame, regions: DataFrame | None = None, midline: float = 5700.0) -> DataFrame:
    """ml, ap, dv from the location vector, hemisphere by side of the midline (0 unregistered), and the mapped region."""
    at = lambda k: F.get(F.col("mlapdv"), F.lit(k))
    out = units.withColumns({"ml": at(0), "ap": at(1), "dv": at(2), "hemi": F.coalesce(F.signum(at(0) - midline), F.lit(0.0))})
    if regions is not None:
        out = out.join(regions, "region_id", "left").withColumn("region", F.coalesce("region", F.lit("unregistered")))
    return out
