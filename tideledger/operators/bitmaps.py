"""Rules as bit sets of days: firing, smoothing, confusion counts, correlation and votes by whole words.

The days of a series are numbered in order; a set is an array of 64-day words, a few dozen numbers for
years of days. Values meet their thresholds once per feature and fold; every rule then combines
the sets of its slots, so neither days nor comparisons are repeated per rule. A feature without a row
on a day does not fire there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import with_metrics
from tideledger.operators.rules import rule_slots
from tideledger.session import durable

def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _bit(on: Column) -> Column:
    """The day's bit in its word, where `on`."""
    return F.when(on, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("__day") % 64).cast("int"))).otherwise(_zero())


def _words(bits: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """Maps word -> bits per group."""
    return bits.groupBy(*by).agg(*[F.map_from_entries(F.collect_list(F.struct("__word", c))).alias(c) for c in columns])


def day_sets(rows: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(by, date, __day, y) of every day, and (by, n_words, all_days, events) as sets."""
    by = list(by)
    order = Window.partitionBy(*by).orderBy("date")
    days = durable(rows.groupBy(*by, "date").agg(F.max("y").alias("y")).withColumn("__day", (F.row_number().over(order) - 1).cast("bigint")))
    cells = days.groupBy(*by, F.floor(F.col("__day") / 64).cast("int").alias("__word")).agg(
        F.bit_or(_bit(F.lit(True))).alias("all_days"), F.bit_or(_bit(F.col("y") == 1)).alias("events"))
    packed = _words(cells, by, "all_days", "events").withColumn("n_words", F.size("all_days"))
    return days, durable(packed.select(*by, "n_words", _filled("all_days").alias("all_days"), _filled("events").alias("events")))


def _filled(words: str) -> Column:
    """The map's words in order, 0 where it has none."""
    return F.transform(F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: F.coalesce(F.try_element_at(F.col(words), i), _zero()))


def feature_sets(rows: DataFrame, thresholds: DataFrame, keys: Sequence[str], by: Sequence[str],
                 days: DataFrame, sets: DataFrame) -> DataFrame:
    """keys, feature, fold, fired: the days on which each feature passes each of its thresholds.

    `by` are the columns that name a series of days: the keys, with `fold` where each fold has its own days.
    """
    on = [*keys, "feature"] + (["fold"] if "fold" in by else [])
    limits = thresholds.select(*keys, "feature", "fold", "threshold")
    above = rows.join(limits, on).where(F.col("value") > F.col("threshold")).select(*keys, "feature", "fold", "date")
    cells = (above.join(days.drop("y"), [*by, "date"])
             .groupBy(*keys, "feature", "fold", F.floor(F.col("__day") / 64).cast("int").alias("__word"))
             .agg(F.bit_or(_bit(F.lit(True))).alias("fired")))
    packed = _words(cells, [*keys, "feature", "fold"], "fired")
    return (limits.drop("threshold").join(packed, [*keys, "feature", "fold"], "left")
            .join(sets.select(*by, "n_words"), list(by))
            .withColumn("fired", F.coalesce("fired", F.create_map().cast("map<int,bigint>")))
            .select(*keys, "feature", "fold", _filled("fired").alias("fired")))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def without(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def size_of(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w))


def combine_sets(rule_type: Column, slots: Column, logic: Column) -> Column:
    """A rule's days from the sets of its slots, in slot order."""
    a, b, c = [F.get(slots, F.lit(i)) for i in range(3)]
    steps = F.arrays_zip(F.slice(slots, F.lit(2), F.size(slots)).alias("f"), logic.alias("op"))
    chain = F.aggregate(steps, a, lambda acc, s: F.when(s.getField("op") == "AND", both(acc, s.getField("f")))
                        .otherwise(either(acc, s.getField("f"))))
    return (F.when(rule_type == "single", a).when(rule_type == "and_2", both(a, b)).when(rule_type == "or_2", either(a, b))
             .when(rule_type == "majority_3", either(both(a, b), both(c, either(a, b))))
             .when(rule_type == "piecewise", either(both(a, b), without(c, b))).otherwise(chain))


def _moved(bits: Column, later: bool) -> Column:
    """Every day's bit on the day after it (or, not `later`, on the day before)."""
    def word(w: Column, i: Column) -> Column:
        if later:
            carry = F.coalesce(F.when(i > 0, F.get(bits, i - 1)), _zero())
            return F.shiftleft(w, 1).bitwiseOR(F.shiftrightunsigned(carry, 63))
        carry = F.coalesce(F.get(bits, i + 1), _zero())
        return F.shiftrightunsigned(w, 1).bitwiseOR(F.shiftleft(carry, 63))

    return F.transform(bits, word)


def long_runs(df: DataFrame, bits: str, days: int) -> DataFrame:
    """`bits` with only the days that lie in a run of at least `days` days."""
    df = df.withColumn("__start", F.col(bits))
    for _ in range(days - 1):
        df = df.withColumn("__start", both(F.col(bits), _moved(F.col("__start"), later=False)))
    # a run's days follow its starts
    df = df.withColumn(bits, F.col("__start"))
    for _ in range(days - 1):
        df = df.withColumn(bits, either(F.col("__start"), _moved(F.col(bits), later=True)))
    return df.drop("__start")


def rule_sets(rules: DataFrame, fired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, rule_id, rule_type, fold, days of every rule and fold in which all of its slots have a threshold."""
    slots = rule_slots(rules, keys).join(fired, [*keys, "feature"])
    packed = slots.groupBy(*keys, "rule_id", "fold").agg(
        F.first("rule_type").alias("rule_type"), F.first("logic").alias("logic"), F.first("n_slots").alias("n_slots"),
        F.array_sort(F.collect_list(F.struct("slot", "fired"))).alias("__s")).where(F.size("__s") == F.col("n_slots"))
    parts = packed.withColumn("__f", F.transform("__s", lambda s: s.getField("fired")))
    return parts.select(*keys, "rule_id", "rule_type", "fold", combine_sets(F.col("rule_type"), F.col("__f"), F.col("logic")).alias("days"))


def rule_fold_metrics(rules: DataFrame, thresholds: DataFrame, long: DataFrame, keys: Sequence[str],
                      smooth_days: int = 2) -> DataFrame:
    """Confusion counts and metrics per (keys, rule_id, fold) on the test folds."""
    rows = long.where(F.col("test_fold") >= 0).select(*keys, "feature", F.col("test_fold").alias("fold"), "date", "value", "y")
    by = [*keys, "fold"]
    days, sets = day_sets(rows, by)
    fired = durable(feature_sets(rows, thresholds, keys, by, days, sets))
    flagged = rule_sets(rules, fired, keys)
    if smooth_days > 1:
        flagged = long_runs(flagged, "days", smooth_days)
    counted = flagged.join(sets, by).withColumns({
        "tp": size_of(both(F.col("days"), F.col("events"))), "fp": size_of(without(F.col("days"), F.col("events"))),
        "__pos": size_of(F.col("events")), "__all": size_of(F.col("all_days"))}).withColumns({
            "fn": F.col("__pos") - F.col("tp")}).withColumn("tn", F.col("__all") - F.col("tp") - F.col("fp") - F.col("fn"))
    return with_metrics(counted.select(*keys, "rule_id", "rule_type", "fold", "tp", "fp", "fn", "tn"))


def first_fold_sets(rules: DataFrame, thresholds: DataFrame, long: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each rule's days over the whole series with the thresholds of its first complete fold; also the days and their sets."""
    days, sets = day_sets(long, keys)
    fired = durable(feature_sets(long, thresholds, keys, list(keys), days, sets))
    every = rule_sets(rules, fired, keys)
    first = Window.partitionBy(*keys, "rule_id")
    chosen = every.withColumn("__first", F.min("fold").over(first)).where(F.col("fold") == F.col("__first")).drop("__first", "fold")
    return chosen, days, sets


def pair_correlation(ranked: DataFrame, sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of each ranked rule's days with those ranked before it, 0 if one is flat.

    `ranked` is (keys, rank, days); the ranks are capped, so pairs are too, and a pair is two short arrays.
    """
    a = ranked.select(*keys, F.col("rank").alias("a"), F.col("days").alias("da"))
    b = ranked.select(*keys, F.col("rank").alias("b"), F.col("days").alias("db"))
    pairs = a.join(b, list(keys)).where("a < b").join(sets.select(*keys, "all_days"), list(keys))
    n, sa, sb = size_of(F.col("all_days")), size_of(F.col("da")), size_of(F.col("db"))
    cov = n * size_of(both(F.col("da"), F.col("db"))) - sa * sb
    var = (n * sa - sa * sa).cast("double") * (n * sb - sb * sb)
    return pairs.select(*keys, "a", "b", F.coalesce(F.try_divide(cov.cast("double"), F.sqrt(var)), F.lit(0.0)).alias("corr"))


def ensemble_table(kept: DataFrame, days: DataFrame, keys: Sequence[str], columns: int = 15, at_least: int = 3) -> DataFrame:
    """Per day the votes, whether `at_least` rules fire, and each kept rule's prediction, name and F1.

    `kept` is (keys, rank, rule_name, f1_mean, days); rules are numbered in rank order, and columns beyond the
    last rule are null.
    """
    packed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "rule_name", "f1_mean", "days"))).alias("__rules"))

    def fires(rule: Column) -> Column:
        word = F.get(rule["days"], F.floor(F.col("__day") / 64).cast("int"))
        return F.call_function("shiftrightunsigned", word, (F.col("__day") % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")).cast("int")

    wide = days.join(packed, list(keys)).withColumn("votes", F.aggregate("__rules", F.lit(0), lambda a, r: a + fires(r)))
    own = []
    for i in range(columns):
        rule = F.get("__rules", F.lit(i))
        own += [fires(rule).alias(f"rule_{i + 1}_pred"), rule["rule_name"].alias(f"rule_{i + 1}_name"), rule["f1_mean"].alias(f"rule_{i + 1}_f1")]
    return wide.select(*keys, "date", "votes", (F.col("votes") >= at_least).cast("int").alias("ensemble_pred"), *own)
