"""Losses of simulated years and annual exceedance curves.

A simulated day row is (keys, sim, day, pred[, obs]); keys hold whatever is compared (run,
method, threshold label). All windows are over one simulated year. Losses are workers x
wage x days, so days are counted first and priced once per simulation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import ratio
from tideledger.operators import features as feat
from tideledger.operators.resample import draw_days, seasonal_candidates
from tideledger.session import durable

COMPONENTS = ("fp", "fn", "tp")


def sim_loss_days(days: DataFrame, keys: Sequence[str], flag: str = "pred",
                  min_days: int = 1) -> DataFrame:
    """Per simulated year: days in runs of at least `min_days`, run counts, fired days."""
    year = Window.partitionBy(*keys, "sim").orderBy("day")
    runs = Window.partitionBy(*keys, "sim", "__g")
    on = F.col(flag) == 1
    start = on & (F.coalesce(F.lag(flag).over(year), F.lit(0)) != 1)
    step = F.when(F.col(flag) == F.lag(flag).over(year), 0).otherwise(1)
    marked = (days.withColumns({"__start": start, "__step": step})
                  .withColumn("__g", F.sum("__step").over(year))
                  .withColumn("__len", F.count(F.lit(1)).over(runs)))
    long_run = F.col("__len") >= min_days
    return marked.groupBy(*keys, "sim").agg(
        F.count_if(on & long_run).alias("loss_days"),
        F.count_if(F.col("__start")).alias("n_events"),
        F.count_if(F.col("__start") & long_run).alias("n_loss_events"),
        F.count_if(on).alias("event_days"))


def sim_component_days(days: DataFrame, keys: Sequence[str], min_days: int = 1) -> DataFrame:
    """Per simulated year and category: days in runs of at least `min_days`, and run counts.

    fp: fired and open; fn: not fired and closed; tp: fired and closed. A run is a stretch of
    one category, so a change of category ends it.
    """
    year = Window.partitionBy(*keys, "sim").orderBy("day")
    runs = Window.partitionBy(*keys, "sim", "__g")
    code = (F.when((F.col("pred") == 1) & (F.col("obs") == 0), "fp")
             .when((F.col("pred") == 0) & (F.col("obs") == 1), "fn")
             .when((F.col("pred") == 1) & (F.col("obs") == 1), "tp").otherwise("tn"))
    step = F.when(F.col("__code") == F.lag("__code").over(year), 0).otherwise(1)
    marked = (days.withColumn("__code", code).withColumn("__step", step)
                  .withColumn("__g", F.sum("__step").over(year))
                  .withColumn("__len", F.count(F.lit(1)).over(runs)))
    aggs = []
    for c in COMPONENTS:
        mine = F.col("__code") == c
        aggs += [F.count_if(mine & (F.col("__len") >= min_days)).alias(f"{c}_days"),
                 F.count_if(mine & (F.col("__step") == 1)).alias(f"{c}_events")]
    return marked.groupBy(*keys, "sim").agg(*aggs)


def price(losses: DataFrame, exposure: DataFrame, on: Sequence[str], days: str = "loss_days",
          out: str = "loss") -> DataFrame:
    """days x workers x wage; the exposure table has one row per run."""
    return (losses.join(exposure.select(*on, "n_workers", "daily_wage"), list(on))
                  .withColumn(out, F.col("n_workers") * F.col("daily_wage") * F.col(days)))


def component_losses(component_days: DataFrame, exposure: DataFrame, keys: Sequence[str],
                     on: Sequence[str]) -> DataFrame:
    """Long (keys, sim, component, loss, n_events); insurance = fp + tp."""
    unit = F.col("n_workers") * F.col("daily_wage")
    parts = [F.struct(F.lit(c).alias("component"), (unit * F.col(f"{c}_days")).alias("loss"),
                      F.col(f"{c}_events").alias("n_events")) for c in COMPONENTS]
    parts.append(F.struct(
        F.lit("insurance").alias("component"),
        (unit * (F.col("fp_days") + F.col("tp_days"))).alias("loss"),
        (F.col("fp_events") + F.col("tp_events")).alias("n_events")))
    priced = component_days.join(exposure.select(*on, "n_workers", "daily_wage"), list(on))
    return priced.select(*keys, "sim", F.inline(F.array(*parts)))


def exceedance_rank(losses: DataFrame, keys: Sequence[str], loss: str = "loss",
                    tie: str = "sim") -> DataFrame:
    """Losses in descending order with probability rank / (n + 1)."""
    whole = Window.partitionBy(*keys)
    rank = F.row_number().over(whole.orderBy(F.desc(loss), tie))
    return (losses.withColumns({"rank": rank, "__n": F.count(F.lit(1)).over(whole)})
                  .withColumn("probability", F.col("rank") / (F.col("__n") + 1)).drop("__n"))


def exceedance_ecdf(losses: DataFrame, keys: Sequence[str], loss: str = "loss",
                    tie: str = "sim") -> DataFrame:
    """Ascending losses with 1 - i/n and its inverse, the return period (null at the end)."""
    whole = Window.partitionBy(*keys)
    i = F.row_number().over(whole.orderBy(loss, tie))
    return (losses.withColumns({"i": i, "n": F.count(F.lit(1)).over(whole)})
                  .withColumn("exceedance", (F.col("n") - F.col("i")) / F.col("n"))
                  .withColumn("return_period", F.try_divide(F.lit(1.0), F.col("exceedance"))))


def loss_at_probability(curve: DataFrame, keys: Sequence[str], q: float = 0.01) -> DataFrame:
    """Smallest loss whose exceedance probability is at most q."""
    return curve.groupBy(*keys).agg(
        F.min(F.when(F.col("probability") <= q, F.col("loss"))).alias("loss"))


def quantile_curve(losses: DataFrame, keys: Sequence[str], points: int = 100,
                   loss: str = "loss") -> DataFrame:
    """Monotone percentile curve of a bounded set of losses on an even grid."""
    steps = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    raw = (losses.groupBy(*keys).agg(F.percentile(loss, steps).alias("__c"))
                 .select(*keys, F.posexplode("__c").alias("step", "__v")))
    up = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return raw.select(*keys, "step", (F.lit(1.0) - F.col("step") / (points - 1))
                      .alias("probability"), F.max("__v").over(up).alias("loss"))


def annual_summary(losses: DataFrame, keys: Sequence[str], loss: str = "loss",
                   also: Sequence[Column] = ()) -> DataFrame:
    """Mean, population sd, extremes, median, p95, p99 and share of loss-free years.

    Further aggregates of the same rows can ride along in `also`.
    """
    return losses.groupBy(*keys).agg(
        *also,
        F.count(F.lit(1)).alias("n_simulations"), F.avg(loss).alias("mean_loss"),
        F.stddev_pop(loss).alias("std_loss"), F.max(loss).alias("max_loss"),
        F.min(loss).alias("min_loss"), F.median(loss).alias("median_loss"),
        F.percentile(loss, F.lit(0.95)).alias("p95_loss"),
        F.percentile(loss, F.lit(0.99)).alias("p99_loss"),
        F.avg((F.col(loss) == 0).cast("double")).alias("zero_prob"))


def component_summary(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`annual_summary` per component with the mean number of events."""
    return annual_summary(components, [*keys, "component"],
                          also=[F.avg("n_events").alias("mean_events")])


# ---- whole analyses ------------------------------------------------------------------------

def simulate(daily: DataFrame, keys: Sequence[str], payload: Sequence[str], n_sims: int,
             seed: int = 0, **sizes) -> DataFrame:
    """Seasonal block bootstrap of the payload columns."""
    return draw_days(seasonal_candidates(daily, keys, payload, **sizes), keys, n_sims, seed)


def single_rule_losses(days: DataFrame, thresholds: DataFrame, exposure: DataFrame,
                       keys: Sequence[str], value: str, min_days: int = 1,
                       labels: Sequence[str] = ()) -> DataFrame:
    """Annual losses of `value > threshold` on simulated days.

    With `labels` in `thresholds` (several thresholds per key) all of them are evaluated on
    the same simulated days, and the threshold stays in the result.
    """
    # written first: a table of known size, so the days need not move to meet it
    fired = days.join(durable(thresholds), list(keys)).withColumn(
        "pred", F.coalesce((F.col(value) > F.col("threshold")).cast("int"), F.lit(0)))
    by = [*keys, *labels, "threshold"] if labels else list(keys)
    return price(sim_loss_days(fired, by, "pred", min_days), exposure, keys)


def scaled_thresholds(thresholds: DataFrame, factor: float = 0.85) -> DataFrame:
    return thresholds.withColumn("threshold", F.col("threshold") * factor)


def threshold_labels(fold_thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each fold's threshold plus their mean, median and p75: (keys, threshold_label, threshold)."""
    folds = fold_thresholds.select(
        *keys, F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("threshold_label"),
        "threshold")
    packed = fold_thresholds.groupBy(*keys).agg(
        F.avg("threshold").alias("mean"), F.median("threshold").alias("median"),
        F.percentile("threshold", F.lit(0.75)).alias("p75"))
    return folds.unionByName(packed.unpivot(list(keys), ["mean", "median", "p75"],
                                            "threshold_label", "threshold"))


def sweep_table(losses: DataFrame, observed_mean: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per threshold: loss statistics, event counts and the gap to the observed mean loss."""
    by = [*keys, "threshold_label"]
    return (losses.groupBy(*by)
                  .agg(F.first("threshold").alias("threshold"),
                       F.avg("loss").alias("mean_loss"), F.median("loss").alias("median_loss"),
                       F.percentile("loss", F.lit(0.99)).alias("p99_loss"),
                       F.avg("n_events").alias("mean_events"))
                  .join(observed_mean, list(keys))
                  .withColumn("gap", F.abs(F.col("mean_loss") - F.col("observed_mean"))))


def aggregate_curves(curves: DataFrame, runs: str = "run", reference: DataFrame | None = None,
                     ) -> DataFrame:
    """Sum over runs of the loss at the point nearest to each reference probability.

    `curves` has probability and loss on any grid of its own. Points and reference are sorted
    together within each run; a reference takes the last point before or the first one after it,
    whichever is nearer, the lower probability on ties (differences below 1e-12 tie), and of points of equal probability
    the one of the greatest loss. Without a reference the grid of the run with most points is used (the first by name).
    """
    curves = curves.where(F.col("probability").isNotNull())
    sizes = durable(curves.groupBy(runs).agg(F.count(F.lit(1)).alias("__n")))
    if reference is None:
        finest = sizes.orderBy(F.desc("__n"), runs).limit(1).select(runs)
        reference = curves.join(F.broadcast(finest), runs, "left_semi")  # one row
    # the result's own rows before the sum: one per run and reference point
    names = sizes.select(F.col(runs).alias("__run"))
    asked = (reference.select("probability").distinct().crossJoin(names)
             .select(F.col("__run").alias(runs), "probability", F.lit(None).cast("double").alias("loss"), F.lit(1).alias("__asked")))
    points = curves.groupBy(runs, "probability").agg(F.max(F.col("loss").cast("double")).alias("loss")).withColumn("__asked", F.lit(0))
    point = F.when(F.col("__asked") == 0, F.struct("probability", "loss"))
    order = Window.partitionBy(runs).orderBy("probability", "__asked")
    swept = points.unionByName(asked).withColumns({
        "__low": F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "__high": F.first(point, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))}).where("__asked = 1")
    down, up = F.col("probability") - F.col("__low.probability"), F.col("__high.probability") - F.col("probability")
    loss = F.when(up.isNull() | (down <= up + 1e-12), F.col("__low.loss")).otherwise(F.col("__high.loss"))
    return swept.groupBy("probability").agg(F.sum(loss).alias("aggregate_loss"), F.count(F.lit(1)).alias("n_runs"))


# ---- triggers recomputed inside each simulated year -----------------------------------------

def trigger_value(keys: Sequence[str], order: str, value: str, transform: str, window: int,
                  lag: int) -> Column:
    """Engineered trigger from its lineage: a window transform, then a lag."""
    made = {"none": lambda: F.col(value),
            "persistence": lambda: feat.persistence(keys, order, value, window),
            "rolling_mean": lambda: feat.rolling_mean(keys, order, value, window),
            "rolling_std": lambda: feat.rolling_std(keys, order, value, window),
            "trend": lambda: feat.trend(keys, order, value, window),
            "abs_change": lambda: feat.abs_change(keys, order, value, window),
            "rel_change": lambda: feat.rel_change(keys, order, value, window)}[transform]()
    return made


def resampled_trigger(daily: DataFrame, keys: Sequence[str], value: str, n_sims: int,
                      transform: str, window: int = 0, lag: int = 0, seed: int = 0,
                      adjust: str = "deseasonalized_detrended", climatology: str = "base",
                      obs: str = "y") -> DataFrame:
    """Simulated days with the trigger rebuilt from the resampled base feature.

    Only the trigger's own lineage is computed. climatology='base' fits season and trend on
    the observed series and applies them by each sampled row's own date; 'sim' fits them on
    the simulated year, where every calendar day occurs once, so the deseasonalised value is
    constant. Labels are sampled with the same rows.
    """
    keys = list(keys)
    series = daily
    if climatology == "base" and adjust != "none":
        series = feat.deseasonalize(series, keys, "date", value, "__d")
        if adjust == "deseasonalized_detrended":
            series = feat.detrend(series, keys, "date", "__d", "__e")
        series = series.withColumn("__x", F.col("__e" if adjust.endswith("detrended") else "__d"))
    else:
        series = series.withColumn("__x", F.col(value))
    days = simulate(series.select(*keys, "date", "__x", F.col(obs).alias("obs")), keys,
                    ["__x", "obs"], n_sims, seed)
    by = [*keys, "sim"]
    if climatology == "sim" and adjust != "none":
        whole = Window.partitionBy(*by)
        own_day = Window.partitionBy(*by, "day")
        days = days.withColumn("__x", F.col("__x") - F.avg("__x").over(own_day)
                               + F.avg("__x").over(whole))
        if adjust == "deseasonalized_detrended":
            days = feat.detrend(days, by, "day", "__x", "__x")
    made = days.withColumn("trigger", trigger_value(by, "day", "__x", transform, window, lag))
    if lag:
        made = made.withColumn("trigger", feat.lagged(by, "day", "trigger", lag))
    return made.drop("__x")


# ---- run-level matching ---------------------------------------------------------------------

def runs_with_overlap(days: DataFrame, keys: Sequence[str], order: str, flag: str,
                      other: str) -> DataFrame:
    """Runs of `flag` with their length and whether any of their days has `other` set.

    Two runs overlap exactly when they share a day, so no join of runs is needed.
    """
    series = Window.partitionBy(*keys).orderBy(order)
    own = series
    return (days.withColumn("__pos", F.row_number().over(series))
                .where(F.col(flag) == 1)
                .withColumn("__g", F.col("__pos") - F.row_number().over(own))
                .groupBy(*keys, "__g")
                .agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"),
                     F.count(F.lit(1)).alias("run_days"),
                     F.max(F.col(other).cast("int")).alias("overlaps")).drop("__g"))


def event_match(days: DataFrame, keys: Sequence[str], order: str = "date") -> DataFrame:
    """Run-level matches: (keys, outcome, run_start, run_end, run_days).

    tp: fired run touching a closure; fp: fired run touching none; fn: closure no run touches.
    """
    fired = runs_with_overlap(days, keys, order, "pred", "obs").withColumn(
        "outcome", F.when(F.col("overlaps") == 1, "tp").otherwise("fp"))
    missed = (runs_with_overlap(days, keys, order, "obs", "pred").where(F.col("overlaps") == 0)
              .withColumn("outcome", F.lit("fn")))
    return fired.unionByName(missed).drop("overlaps")


def event_match_summary(matches: DataFrame, exposure: DataFrame, keys: Sequence[str],
                        on: Sequence[str]) -> DataFrame:
    """Counts, cost sums and p99 cost per outcome."""
    return (price(matches, exposure, on, "run_days", "cost")
            .groupBy(*keys, "outcome")
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum("cost").alias("total_cost"),
                 F.avg("cost").alias("mean_cost"),
                 F.percentile("cost", F.lit(0.99)).alias("p99_cost")))


def cost_shares(component_means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of false and true alarms in the closure cost; missed closures apart."""
    def part(c):
        return F.sum(F.when(F.col("component") == c, F.col("mean_loss")).otherwise(0.0))
    wide = component_means.groupBy(*keys).agg(part("fp").alias("fp"), part("tp").alias("tp"),
                                              part("fn").alias("fn"))
    return wide.select(*keys, ratio(F.col("fp"), F.col("fp") + F.col("tp"), 0.0).alias("fp_share"),
                       ratio(F.col("tp"), F.col("fp") + F.col("tp"), 0.0).alias("tp_share"),
                       F.col("fn").alias("fn_cost"))


def aep_curve(daily: DataFrame, exposure: DataFrame, keys: Sequence[str], value: str,
              percentile: float, n_sims: int, min_days: int = 1, seed: int = 0) -> DataFrame:
    """Whole chain for one trigger: threshold, resampled years, runs, losses, exceedance ranks.

    The day rows are written first: threshold, blocks and slots all read them.
    """
    daily = durable(daily)
    thresholds = daily.groupBy(*keys).agg(F.percentile(value, F.lit(percentile)).alias("threshold"))
    days = simulate(daily, keys, [value], n_sims, seed)
    losses = single_rule_losses(days, thresholds, exposure, keys, value, min_days)
    return exceedance_rank(losses, keys)
