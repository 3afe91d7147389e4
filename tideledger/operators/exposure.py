"""Who loses what on a closed day: wages, workers, group parameters, yearly losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import canonical_port, half_even, list_item_count
from tideledger.operators.quantiles import exact_percentiles
from tideledger.operators.runs import run_lengths, with_run_length

# Ordered spelling repairs of port names.
PORT_NAME_REPAIRS = [
    ("CALETA_EL_CHACO", "CALETA_EL_CHACHO"),
    ("CALETA_CULEBRAS", "COLETA_CULEBRAS"),
    ("CALETA_LOBITOS_(TALARA)", "CALETA_LOBITOS"),
    ("CALETA_SAN_ANDRÉS", "CALETA_SAN_ANDRES"),
    ("CALLAO", "DPA_CALLAO"),
    ("CHORRILLOS", "DPA_CHORRILLOS"),
    ("ENSENADA_DE_SECHURA", "ENSENADA_SECHURA"),
    ("PUERTO_MATARANI_(MUELLE_OCEAN_FISH)", "MUELLE_OCEAN_FISH"),
    ("PUNTA_PICATA", "TERMINAL_PESQUERO_PUNTA_PICATA"),
]
# A port left out of the wage table, days per month, fishing days factor.
DROPPED_PORT = "PUERTO_SUPE"
DAYS_PER_MONTH = 30
WAGE_DIVISOR = 3.5


def wage_params(wages: DataFrame, repairs=tuple(PORT_NAME_REPAIRS), dropped: str = DROPPED_PORT,
                ) -> DataFrame:
    """port_name, daily_wage, n_workers, daily_loss from (caleta, port_name, w_p50, workers).

    `port_name` on input is the list of ports that share the province's workers.
    """
    name = canonical_port(F.col("caleta"))
    return (wages.where(name != dropped)
                 .select(canonical_port(F.col("caleta"), repairs).alias("port_name"),
                         (F.col("w_p50") / DAYS_PER_MONTH).alias("daily_wage"),
                         half_even(F.col("fishermen_province")
                                   / list_item_count(F.col("port_name"))).alias("n_workers"))
                 .withColumn("daily_loss", F.col("n_workers") * F.col("daily_wage")))


def wage_medians(params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Medians over the port table (one row per port: bounded)."""
    return params.groupBy(*keys).agg(
        F.median("daily_wage").alias("daily_wage"), F.median("n_workers").alias("n_workers"),
        F.median("daily_loss").alias("daily_loss"))


def wage_median_fill(params: DataFrame, names: DataFrame) -> DataFrame:
    """Rows at the medians for the named ports, added to the table."""
    medians = F.broadcast(wage_medians(params))  # one row
    filled = names.select("port_name").join(medians, how="cross")
    return params.select("port_name", "daily_wage", "n_workers", "daily_loss").unionByName(filled)


def group_exposure(params: DataFrame, run_ports: DataFrame, divisor: float = WAGE_DIVISOR,
                   default: float = 1.0) -> DataFrame:
    """Per run: workers = sum; wage = (sum of wages / number of listed ports) / divisor.

    Listed ports count in the divisor whether or not they have a wage row.
    """
    listed = run_ports.groupBy("run").agg(F.count(F.lit(1)).alias("n_listed"))
    found = (run_ports.join(params, "port_name")
                      .groupBy("run").agg(F.sum("n_workers").alias("__n"),
                                          F.sum("daily_wage").alias("__w")))
    return (listed.join(found, "run", "left")
                  .select("run", "n_listed",
                          F.coalesce("__n", F.lit(default)).alias("n_workers"),
                          F.coalesce(F.col("__w") / F.col("n_listed") / divisor,
                                     F.lit(default)).alias("daily_wage")))


def ports_in_group(df: DataFrame, run_ports: DataFrame) -> DataFrame:
    return df.join(run_ports.select("port_name").distinct(), "port_name", "left_semi")


def median_by(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per key for raw rows of any number."""
    return exact_percentiles(df, keys, value, {out: 0.5})


def with_default_economics(ports: DataFrame, params: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each port's wage row, or the default row where it has none."""
    cols = ("daily_wage", "n_workers", "daily_loss")
    fallback = defaults.agg(*[F.first(c).alias(f"__{c}") for c in cols])
    return (ports.join(F.broadcast(fallback), how="cross")  # one row
                 .join(params, "port_name", "left")
                 .withColumns({c: F.coalesce(c, f"__{c}") for c in cols})
                 .drop(*[f"__{c}" for c in cols]))


def economic_daily(labelled: DataFrame, params: DataFrame, defaults: DataFrame,
                   flag: str = "event_dummy_1") -> DataFrame:
    """Daily label with workers, wage and the loss of a closed day."""
    ports = labelled.select("port_name").distinct()
    known = with_default_economics(ports, params, defaults)
    return (labelled.join(known, "port_name")
                    .select("port_name", "date", F.col(flag).alias("event_dummy_1"), "n_workers",
                            "daily_wage", "daily_loss"))


def economic_yearly(daily: DataFrame, keys: Sequence[str] = ("port_name",)) -> DataFrame:
    """Per year: event days, rate, loss = days x daily loss."""
    return (daily.groupBy(*keys, F.year("date").alias("year"))
                 .agg(F.sum("event_dummy_1").alias("event_days"),
                      F.avg("event_dummy_1").alias("event_rate"),
                      F.max("daily_loss").alias("daily_loss"))
                 .withColumn("yearly_loss", F.col("event_days") * F.col("daily_loss")))


def economic_total(daily: DataFrame, keys: Sequence[str] = ("port_name",)) -> DataFrame:
    """Over all days: days, event days and their rate, exposure, and the whole loss = event days x daily loss."""
    return (daily.groupBy(*keys)
                 .agg(F.count(F.lit(1)).alias("n_days"), F.sum("event_dummy_1").alias("event_days"),
                      F.avg("event_dummy_1").alias("event_rate"), F.max("n_workers").alias("n_workers"),
                      F.max("daily_wage").alias("daily_wage"), F.max("daily_loss").alias("daily_loss"))
                 .withColumn("total_loss", F.col("event_days") * F.col("daily_loss")))


def yearly_observed_loss(labelled: DataFrame, keys: Sequence[str], exposure: DataFrame,
                         flag: str = "event_dummy_1", min_days: int = 1) -> DataFrame:
    """Loss of the observed runs of at least `min_days`, cut at year ends; 0 in quiet years."""
    days = labelled.withColumn("year", F.year("date"))
    by = [*keys, "year"]
    return (with_run_length(days, by, "date", flag, "__len")
            .groupBy(*by)
            .agg(F.count_if((F.col("__len") >= min_days) & (F.col("__len") > 0)).alias("loss_days"))
            .join(exposure, list(keys))
            .select(*by, "loss_days", (F.col("n_workers") * F.col("daily_wage")
                                       * F.col("loss_days")).alias("observed_loss")))


def loss_stats(losses: DataFrame, keys: Sequence[str], loss: str) -> DataFrame:
    """Distribution of a bounded set of losses (years or simulations) per key.

    zero / high / extreme count losses equal to 0, above the p75 and above the p90.
    """
    whole = Window.partitionBy(*keys)
    marked = losses.withColumns({
        "__p75": F.percentile(loss, F.lit(0.75)).over(whole),
        "__p90": F.percentile(loss, F.lit(0.90)).over(whole)})
    quant = [F.percentile(loss, F.lit(p)).alias(f"p{int(p * 100)}")
             for p in (0.25, 0.75, 0.90, 0.95, 0.99)]
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(loss).alias("total"), F.avg(loss).alias("mean"),
        F.median(loss).alias("median"), F.stddev_samp(loss).alias("sd"),
        F.min(loss).alias("min"), F.max(loss).alias("max"), *quant,
        F.count_if(F.col(loss) == 0).alias("zero_years"),
        F.count_if(F.col(loss) > F.col("__p75")).alias("high_years"),
        F.count_if(F.col(loss) > F.col("__p90")).alias("extreme_years"),
        F.try_divide(F.stddev_samp(loss), F.avg(loss)).alias("cv"))


def loss_tier(losses: DataFrame, keys: Sequence[str], loss: str) -> DataFrame:
    """High above the p75, else Medium above the p25, else Low."""
    whole = Window.partitionBy(*keys)
    p25 = F.percentile(loss, F.lit(0.25)).over(whole)
    p75 = F.percentile(loss, F.lit(0.75)).over(whole)
    return losses.withColumn("tier", F.when(F.col(loss) > p75, "High")
                                      .when(F.col(loss) > p25, "Medium").otherwise("Low"))


def impute_from_unit_cost(df: DataFrame, events: Column, loss: Column, unit_cost: Column,
                          p99: Column, p99_factor: float = 2.5) -> DataFrame:
    """Fill events from loss and loss from events by a unit cost; p99 = factor x mean loss."""
    return df.withColumns({
        "events_filled": F.coalesce(events.cast("double"), F.try_divide(loss, unit_cost)),
        "loss_filled": F.coalesce(loss, events * unit_cost),
        "p99_filled": F.coalesce(p99, F.coalesce(loss, events * unit_cost) * p99_factor),
        "is_estimated": (events.isNull() | loss.isNull() | p99.isNull()).cast("int"),
    })


def observed_runs(labelled: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    return run_lengths(labelled, keys, "date", flag)
