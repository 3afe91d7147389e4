"""Roles the supplied tables play in the engine.

readings    one reading per order (source A) or per line (source B); port = order priority
events      hourly-like stream, port = event type
closures    port-days whose mean net line price is among the top 4 %; 1 to 3 days long
exposure    customers of the region standing behind a port

Daily means are snapped to a fine grid: the last bits of a distributed mean depend on the
order in which partial sums meet, and comparisons with a threshold must not.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.functions.scalars import snapped
from tideledger.operators import features as feat
from tideledger.operators.aep import (component_losses, exceedance_rank, price,
                                      sim_component_days, sim_loss_days)
from tideledger.operators.exposure import median_by, yearly_observed_loss
from tideledger.operators.labels import label_days
from tideledger.operators.resample import draw_days, seasonal_candidates
from tideledger.operators.rules import top_features
from tideledger.operators.search import fold_threshold_search, time_series_folds
from tideledger.session import durable

# Price units per metre of wave height. The odd divisor keeps scaled prices off decimal
# ties, where two engines may round differently.
UNIT = 31250.7
PORTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CLOSURE_SHARE = 0.96
PORT = ["port_name"]
N_FOLDS = 6
N_SIMS = 200
MIN_DAYS = 2
METHOD_LEVELS = [0.75, 0.85, 0.95]
BASE_FEATURES = ["swh_mean_a", "swh_max_a", "swh_min_a", "swh_mean_b", "swh_max_b", "swh_min_b"]
FEATURES = [*BASE_FEATURES, "swh_mean_b_persistence_3", "swh_max_b_lag_1"]


class Roles:
    """Lazy role tables over one folder of the supplied tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def readings_a(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderpriority").alias("port_name"), F.col("o_orderdate").alias("ts"),
            F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("reading_id"),
            (F.col("o_totalprice") / UNIT).alias("swh"))

    @cached_property
    def readings_b(self) -> DataFrame:
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("date"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("reading_id"),
            (F.col("l_extendedprice") / UNIT).alias("swh"),
            (F.col("l_quantity") / 7.3).alias("swe"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) / UNIT).alias("net"))
        ports = self.table("orders").select(F.col("o_orderkey").alias("k"),
                                            F.col("o_orderpriority").alias("port_name"))
        return lines.join(ports, "k").drop("k")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("port_name"), "ts", F.to_date("ts").alias("date"),
            F.col("value").alias("swh"))

    @cached_property
    def daily_a(self) -> DataFrame:
        """Port-days, written once: the raw table is read once however often they are used."""
        return durable(self.readings_a.groupBy("port_name", "date").agg(
            snapped(F.avg("swh")).alias("swh_mean"), F.max("swh").alias("swh_max"),
            F.min("swh").alias("swh_min"), F.count(F.lit(1)).alias("n_obs")))

    @cached_property
    def daily_b(self) -> DataFrame:
        return durable(self.readings_b.groupBy("port_name", "date").agg(
            snapped(F.avg("swh")).alias("swh_mean"), F.max("swh").alias("swh_max"),
            F.min("swh").alias("swh_min"), snapped(F.avg("net")).alias("net_mean"),
            F.count(F.lit(1)).alias("n_obs")))

    @cached_property
    def closures(self) -> DataFrame:
        cut = self.daily_b.groupBy("port_name").agg(
            F.percentile("net_mean", F.lit(CLOSURE_SHARE)).alias("cut"))
        return (self.daily_b.join(cut, "port_name").where(F.col("net_mean") > F.col("cut"))
                .select("port_name", "date", F.year("date").alias("year"),
                        (1 + F.col("n_obs") % 3).cast("double").alias("duracion"),
                        F.lit(1).alias("event_dummy_1")))

    @cached_property
    def labelled(self) -> DataFrame:
        """Source A days with y = 1 on closed days."""
        return label_days(self.daily_a, self.closures, PORT, "y")

    @cached_property
    def model_days(self) -> DataFrame:
        """Both sources side by side with the label: the table between preparation and search.

        Search and simulation read it many times, so its lineage is cut here.
        """
        a = self.labelled.select("port_name", "date", "y", *[
            F.col(c).alias(f"{c}_a") for c in ("swh_mean", "swh_max", "swh_min")])
        b = self.daily_b.select("port_name", "date", *[
            F.col(c).alias(f"{c}_b") for c in ("swh_mean", "swh_max", "swh_min")])
        return durable(a.join(b, ["port_name", "date"]))

    @cached_property
    def fan_days(self) -> DataFrame:
        """Model days with two engineered features."""
        return self.model_days.withColumns({
            "swh_mean_b_persistence_3": snapped(
                feat.persistence(PORT, "date", "swh_mean_b", 3)),
            "swh_max_b_lag_1": feat.lagged(PORT, "date", "swh_max_b", 1)})

    @cached_property
    def long(self) -> DataFrame:
        """(port_name, date, y, feature, value) of base and a few engineered features."""
        return feat.to_long(self.fan_days, ["port_name", "date", "y"], FEATURES)

    @cached_property
    def folded(self) -> DataFrame:
        """Model days with six expanding folds."""
        return time_series_folds(self.model_days, PORT, N_FOLDS)

    @cached_property
    def long_folded(self) -> DataFrame:
        return self.long.join(self.folded.select("port_name", "date", "test_fold"),
                              ["port_name", "date"])

    @cached_property
    def best_thresholds(self) -> DataFrame:
        return durable(fold_threshold_search(self.long_folded, PORT, N_FOLDS))

    @cached_property
    def ranked(self) -> DataFrame:
        """Features of each port ranked by their largest value."""
        return top_features(self.long.groupBy("port_name", "feature")
                            .agg(F.max("value").alias("score")), PORT, "score")

    @cached_property
    def fired(self) -> DataFrame:
        """Model days with the p75 trigger as pred and the label as obs."""
        return (self.model_days.join(self.trigger_thresholds(), "port_name")
                .select("port_name", "date", F.col("y").alias("obs"),
                        (F.col("swh_mean_b") > F.col("threshold")).cast("int").alias("pred"),
                        "swh_mean_b", "threshold"))

    @cached_property
    def candidates(self) -> DataFrame:
        return seasonal_candidates(self.model_days, PORT, ["swh_mean_b", "y"])

    @cached_property
    def sim_days(self) -> DataFrame:
        return draw_days(self.candidates, PORT, N_SIMS)

    @cached_property
    def sim_fired(self) -> DataFrame:
        return (self.sim_days.join(self.trigger_thresholds(), "port_name")
                .withColumn("pred", (F.col("swh_mean_b") > F.col("threshold")).cast("int"))
                .withColumnRenamed("y", "obs"))

    @cached_property
    def sim_losses(self) -> DataFrame:
        return price(sim_loss_days(self.sim_fired, PORT, "pred", MIN_DAYS), self.exposure, PORT)

    @cached_property
    def components(self) -> DataFrame:
        return component_losses(sim_component_days(self.sim_fired, PORT, MIN_DAYS),
                                self.exposure, PORT, PORT)

    @cached_property
    def curves(self) -> DataFrame:
        return exceedance_rank(self.sim_losses, PORT)

    @cached_property
    def obs_yearly(self) -> DataFrame:
        return yearly_observed_loss(self.labelled, PORT, self.exposure, "y")

    @cached_property
    def methods(self) -> DataFrame:
        """Three trigger levels as competing methods: (port_name, method, threshold)."""
        marks = {f"p{int(p * 100)}": p for p in METHOD_LEVELS}
        wide = self.model_days.groupBy("port_name").agg(
            *[F.percentile("swh_mean_b", F.lit(p)).alias(m) for m, p in marks.items()])
        return wide.unpivot(["port_name"], list(marks), "method", "threshold")

    @cached_property
    def method_days(self) -> DataFrame:
        return self.model_days.join(self.methods, "port_name").select(
            "port_name", "method", "date", F.col("y").alias("obs"),
            (F.col("swh_mean_b") > F.col("threshold")).cast("int").alias("pred"))

    @cached_property
    def method_years(self) -> DataFrame:
        """Predicted loss per port, method and year."""
        days = self.method_days.groupBy("port_name", "method", F.year("date").alias("year")).agg(
            F.sum("pred").alias("loss_days"))
        return price(days, self.exposure, PORT)

    @cached_property
    def base_long(self) -> DataFrame:
        """Source A in long form: three base features."""
        return feat.to_long(self.daily_a, ["port_name", "date"],
                            ["swh_mean", "swh_max", "swh_min"])

    @cached_property
    def exposure(self) -> DataFrame:
        """Workers and daily wage behind each port: five rows."""
        names = F.element_at(F.array(*[F.lit(p) for p in PORTS]), F.col("n_regionkey") + 1)
        return (self.table("customer").join(self.table("nation"),
                                            F.col("c_nationkey") == F.col("n_nationkey"))
                .groupBy(names.alias("port_name"))
                .agg(F.count(F.lit(1)).alias("n_workers"),
                     F.round(F.avg("c_acctbal") / 105, 2).alias("daily_wage")))

    @cached_property
    def wages(self) -> DataFrame:
        """caleta, port_name (list), w_p50, fishermen_province by nation."""
        people = self.table("customer").select(F.col("c_nationkey").alias("n_nationkey"),
                                               "c_acctbal")
        counts = people.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("workers"))
        return (self.table("nation")
                .join(median_by(people, ["n_nationkey"], "c_acctbal", "w_p50"), "n_nationkey")
                .join(counts, "n_nationkey")
                .select(F.replace(F.lower("n_name"), F.lit("_"), F.lit(" ")).alias("caleta"),
                        F.concat_ws(",", F.col("n_name"),
                                    F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
                         .alias("port_name"),
                        "w_p50", F.col("workers").cast("double").alias("fishermen_province"),
                        "n_regionkey"))

    @cached_property
    def run_ports(self) -> DataFrame:
        """Ports (nations) of each run (region), plus one listed port without a wage row."""
        listed = self.table("nation").select(
            F.concat(F.lit("run_g"), F.col("n_regionkey") + 1).alias("run"),
            F.upper("n_name").alias("port_name"))
        extra = (self.table("region")
                 .select(F.concat(F.lit("run_g"), F.col("r_regionkey") + 1).alias("run"),
                         F.concat(F.lit("HARBOUR_"), F.col("r_name")).alias("port_name")))
        return listed.unionByName(extra)

    def trigger_thresholds(self, value: str = "swh_mean_b", p: float = 0.75) -> DataFrame:
        """Percentile of a model-day column per port, as the trigger threshold."""
        return self.model_days.groupBy("port_name").agg(
            F.percentile(value, F.lit(p)).alias("threshold"))
