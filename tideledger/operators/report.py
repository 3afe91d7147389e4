"""Comparison tables across runs, methods and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import ratio, with_metrics
from tideledger.operators.quantiles import exact_percentiles
from tideledger.session import durable


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   k: int = 10) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def topk_global(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def best_per_group(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Label with the highest score per group; the smallest label on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), label)
    return (df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
              .select(*keys, F.col(label).alias("winner"), F.col(score).alias("best_score")))


def rule_coverage(rules: DataFrame, min_runs: int = 6, share: float = 0.6,
                  single_recall: float = 0.60, multi_recall: float = 0.55) -> DataFrame:
    """Rules (rule_id, run, recall, rule_type) found in enough runs with enough recall."""
    runs = rules.select("run").distinct().groupBy().agg(F.count(F.lit(1)).alias("__runs"))
    agg = rules.groupBy("rule_id").agg(
        F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"),
        F.countDistinct("run").alias("runs_present"), F.min("rule_type").alias("rule_type"))
    need = F.greatest(F.lit(min_runs), F.floor(F.col("__runs") * share))
    floor = F.when(F.col("rule_type") == "single", single_recall).otherwise(multi_recall)
    return (agg.join(F.broadcast(runs), how="cross")  # one row
               .where((F.col("runs_present") >= need) & (F.col("mean_recall") >= floor))
               .drop("__runs"))


def coverage_distribution(rules: DataFrame) -> DataFrame:
    """How many rules occur in 1, 2, ... runs."""
    return (rules.groupBy("rule_id").agg(F.countDistinct("run").alias("runs_present"))
                 .groupBy("runs_present").agg(F.count(F.lit(1)).alias("n_rules")))


def component_breakdown(components: DataFrame, last_year: DataFrame,
                        keys: Sequence[str]) -> DataFrame:
    """tp / fp / fn rows: mean, sample sd, p95, p99, max, loss-based recall, last-year counts."""
    stats = (components.where(F.col("component") != "insurance")
             .groupBy(*keys, "component").agg(
                 F.avg("loss").alias("mean_loss"), F.stddev_samp("loss").alias("std_loss"),
                 F.percentile("loss", F.lit(0.95)).alias("p95"),
                 F.percentile("loss", F.lit(0.99)).alias("p99"), F.max("loss").alias("max_loss")))
    tp = F.sum(F.when(F.col("component") == "tp", F.col("mean_loss")).otherwise(0.0))
    fn = F.sum(F.when(F.col("component") == "fn", F.col("mean_loss")).otherwise(0.0))
    whole = stats.groupBy(*keys).agg(ratio(tp, tp + fn, 0.0).alias("loss_recall"))
    return stats.join(whole, list(keys)).join(last_year, list(keys))


def last_year_counts(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed and predicted event days in the last year of each key's series."""
    years = days.withColumn("__y", F.year("date"))
    last = years.groupBy(*keys, "__y").agg(F.sum("obs").alias("observed_last_year"),
                                           F.sum("pred").alias("predicted_last_year"))
    w = Window.partitionBy(*keys).orderBy(F.desc("__y"))
    return last.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r", "__y")


def run_observed_ratio(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """Per run: total predicted loss over the mean observed yearly loss."""
    p = predicted.groupBy("run").agg(F.sum("loss").alias("predicted_total"))
    o = observed.groupBy("run").agg(F.avg("observed_loss").alias("observed_mean"))
    return p.join(o, "run").withColumn("ratio", ratio(F.col("predicted_total"),
                                                      F.col("observed_mean"), 0.0))


def aggregate_metrics(observed: DataFrame, simulated: DataFrame) -> DataFrame:
    """metric / value rows: mean, p95, p99 and max of observed and simulated totals."""
    def stats(df, col, name):
        wide = df.groupBy().agg(
            F.avg(col).alias(f"{name}_mean"), F.percentile(col, F.lit(0.95)).alias(f"{name}_p95"),
            F.percentile(col, F.lit(0.99)).alias(f"{name}_p99"), F.max(col).alias(f"{name}_max"))
        return wide.unpivot([], wide.columns, "metric", "value")
    return stats(observed, "loss", "observed").unionByName(stats(simulated, "loss", "simulated"))


def weighted_mean_loss(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    return curve.groupBy(*keys).agg(
        ratio(F.sum(F.col("loss") * F.col("probability")), F.sum("probability"))
        .alias("weighted_mean_loss"))


def method_ranking(means: DataFrame, keys: Sequence[str], loss: str = "mean_loss") -> DataFrame:
    """Rank of each method by mean loss and its improvement over the worst one in percent."""
    whole = Window.partitionBy(*keys)
    worst = F.max(loss).over(whole)
    return means.withColumns({
        "rank": F.rank().over(whole.orderBy(loss)),
        "improvement_vs_worst": ratio(worst - F.col(loss), worst, 0.0) * 100})


def method_comparison(rows: DataFrame, key: str = "run", method: str = "method",
                      value: str = "mean_loss") -> DataFrame:
    """Pairwise percent improvement of method a over method b within a run."""
    a = rows.select(key, F.col(method).alias("method_a"), F.col(value).alias("__a"))
    b = rows.select(key, F.col(method).alias("method_b"), F.col(value).alias("__b"))
    return (a.join(b, key).where(F.col("method_a") < F.col("method_b"))
             .select(key, "method_a", "method_b",
                     (ratio(F.col("__b") - F.col("__a"), F.col("__b"), 0.0) * 100)
                     .alias("improvement_pct")))


def winner_counts(rows: DataFrame, key: str, method: str, value: str) -> DataFrame:
    """How many runs each method wins with the lowest value."""
    w = Window.partitionBy(key).orderBy(value, method)
    return (rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
                .groupBy(method).agg(F.count(F.lit(1)).alias("wins")))


def totals_row(counts: DataFrame, key: str = "run", label: str = "TOTAL") -> DataFrame:
    """Confusion counts per key plus a totals row; the metrics come after the totals."""
    rolled = counts.rollup(key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")],
                                    F.grouping(key).alias("__g"))
    named = rolled.withColumn(key, F.when(F.col("__g") == 1, label).otherwise(F.col(key)))
    return with_metrics(named.drop("__g"))


def group_metrics(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and p99 of a bounded set of losses per group."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean_loss"),
                                   F.percentile(value, F.lit(0.99)).alias("p99_loss"))


def closest_threshold(rows: DataFrame, keys: Sequence[str], simulated: str, observed: str,
                      tie: str) -> DataFrame:
    """Row whose simulated loss is nearest to the observed one, per key."""
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col(simulated) - F.col(observed)), tie)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")


def coalesce_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """First non-null among the alias columns that exist."""
    return df.withColumns({out: F.coalesce(*[F.col(c) for c in names if c in df.columns])
                           for out, names in aliases.items()})


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def region_sum_observed(yearly: DataFrame, year: str = "year", loss: str = "observed_loss",
                        run: str = "run", common_years: bool = False) -> DataFrame:
    """Sum over runs per year, optionally only for the years every run has."""
    per_year = yearly.groupBy(year).agg(F.sum(loss).alias("loss"),
                                        F.countDistinct(run).alias("n_runs"))
    if not common_years:
        return per_year
    runs = yearly.select(run).distinct().groupBy().agg(F.count(F.lit(1)).alias("__all"))
    return (per_year.join(F.broadcast(runs), how="cross")  # one row
                    .where(F.col("n_runs") == F.col("__all")).drop("__all"))


def region_sum_simulated(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum over runs at equal rank of the sorted curves."""
    return curves.groupBy(*keys, "rank").agg(F.sum("loss").alias("loss"),
                                             F.count(F.lit(1)).alias("n_runs"))


def loss_histogram(losses: DataFrame, keys: Sequence[str], loss: str = "loss",
                   bins: int = 30) -> DataFrame:
    """Density histogram between the smallest and the largest loss of each key."""
    whole = losses.groupBy(*keys).agg(F.min(loss).alias("__lo"), F.max(loss).alias("__hi"),
                                      F.count(F.lit(1)).alias("__n"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    spot = F.least(F.coalesce(F.floor(F.try_divide(F.col(loss) - F.col("__lo"), width)), F.lit(0)),
                   F.lit(bins - 1))
    return (losses.join(whole, list(keys)).withColumn("bin", spot.cast("int"))
                  .groupBy(*keys, "bin", "__lo", "__hi", "__n")
                  .agg(F.count(F.lit(1)).alias("n"))
                  .select(*keys, "bin", "n", (F.col("__lo") + F.col("bin") * width).alias("left"),
                          ratio(F.col("n"), F.col("__n") * width, 0.0).alias("density")))


def loss_density(losses: DataFrame, keys: Sequence[str], loss: str = "loss",
                 points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth n^(-1/5) times the sample sd.

    Losses are whole multiples of one day's loss, so equal ones are collapsed to a count
    first; the grid then meets distinct losses (at most days per year + 1), not simulations.
    """
    stats = (losses.groupBy(*keys)
                   .agg(F.min(loss).alias("__lo"), F.max(loss).alias("__hi"),
                        F.count(F.lit(1)).alias("__n"), F.stddev_samp(loss).alias("__sd"))
                   .where(F.col("__sd") > 0))
    grid = stats.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumns({
        "x": F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("step") / (points - 1),
        "__h": F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))})
    atoms = losses.groupBy(*keys, F.col(loss).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    z = (F.col("x") - F.col("__v")) / F.col("__h")
    return (grid.join(atoms, list(keys))
                .groupBy(*keys, "step", "x", "__n", "__h")
                .agg(F.sum(F.col("__c") * F.exp(-z * z / 2)).alias("__s"))
                .select(*keys, "step", "x",
                        (F.col("__s") / (F.col("__n") * F.col("__h")
                                         * F.sqrt(F.lit(2.0) * F.pi()))).alias("density")))


def metric_spread(folds: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sd, min and max of each metric over folds, one row per metric."""
    long = folds.unpivot(list(keys), list(metrics), "metric", "__m")
    return long.groupBy(*keys, "metric").agg(
        F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("std"),
        F.min("__m").alias("min"), F.max("__m").alias("max"))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sd, extremes and exact quartiles per key, for any number of rows."""
    basic = durable(df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max")))
    marks = exact_percentiles(df, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75},
                              sizes=basic.select(*keys, "n"))
    return basic.join(marks, list(keys))
