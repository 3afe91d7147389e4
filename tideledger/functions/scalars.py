"""Scalar column helpers: guarded arithmetic, rounding, text clean-up, hash draws."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN sorts above every number in Spark, so `NaN > t` would fire; null does not."""
    fix = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    return df.withColumns(fix)


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den, null (or `default`) when the denominator is zero or null."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def finite_or_null(col: Column) -> Column:
    """Infinite and NaN values become null."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


def contains_to(col: Column, needle: str, canonical: str) -> Column:
    """Replace the whole value when it contains `needle`."""
    return F.when(F.contains(col, F.lit(needle)), F.lit(canonical)).otherwise(col)


def replace_chain(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Ordered literal (not regex) substring replacements."""
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def canonical_port(col: Column, pairs: Iterable[tuple[str, str]] = ()) -> Column:
    """Upper case, spaces to underscores, then the ordered replacements."""
    return replace_chain(F.replace(F.upper(col), F.lit(" "), F.lit("_")), pairs)


def list_item_count(col: Column, sep: str = ",") -> Column:
    """Number of items in a separated list."""
    return F.size(F.split(col, sep))


def half_even(col: Column, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(col, digits)


def snapped(col: Column, bits: int = 27) -> Column:
    """Nearest multiple of 2^-bits: drops the last bits of a distributed mean.

    Those bits depend on the order in which partial sums meet; a retried task must not move
    a value across a threshold.
    """
    grid = float(2 ** bits)
    return F.floor(col * grid + 0.5) / grid


def parse_number_list(col: Column) -> Column:
    """'[np.float64(1.5), 2]' -> array(1.5, 2.0)."""
    plain = F.regexp_replace(col, r"np\.float64\(([^)]*)\)", "$1")
    return F.from_json(plain, "array<double>")


def rule_feature_name(col: Column) -> Column:
    """Feature behind a single-rule name such as 'Single: f > threshold'."""
    return F.trim(F.replace(F.replace(col, F.lit(" > threshold"), F.lit("")),
                            F.lit("Single: "), F.lit("")))


def rule_identity(kind: Column, features: Column, operators: Column, logic: Column,
                  threshold: Column) -> Column:
    """Identity string of a rule; thresholds count for single rules only."""
    single = F.concat_ws("|", F.lit("single"), F.array_join(features, "+"),
                         threshold.cast("string"))
    multi = F.concat_ws("|", F.lit("multi"), F.array_join(features, "+"),
                        F.array_join(operators, "+"), F.array_join(logic, "+"))
    return F.when(kind == "single", single).otherwise(multi)


def rule_parts(text: Column) -> dict[str, Column]:
    """Features, operators and connectives of 'a > t1 AND b <= t2 OR c > t3'."""
    cond = F.lit(r"([A-Za-z0-9_]+)\s*(>=|<=|>|<)")
    return {
        "features": F.regexp_extract_all(text, cond, F.lit(1)),
        "operators": F.regexp_extract_all(text, cond, F.lit(2)),
        "logic": F.regexp_extract_all(text, F.lit(r"\s(AND|OR)\s"), F.lit(1)),
    }


def run_number(col: Column) -> Column:
    """7 from 'run_g7'."""
    return F.regexp_extract(col, r"(\d+)$", 1).cast("int")


def run_prefix(col: Column) -> Column:
    """'run_g' from 'run_g7'."""
    return F.regexp_extract(col, r"^(.*?)\d*$", 1)


def hash_draw(*parts: Column) -> Column:
    """32-bit non-negative draw, a function of its arguments alone.

    A retried task, another partitioning or another engine gives the same number.
    """
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts: Column) -> Column:
    """Uniform draw in [0, 1)."""
    return hash_draw(*parts) / F.lit(4294967296.0)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp, 0.0)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn, 0.0)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn, 0.0)


def accuracy(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return ratio(tp + tn, tp + fp + tn + fn, 0.0)


def with_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall, accuracy, F1 and specificity from tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns({
        "precision": precision(tp, fp),
        "recall": recall(tp, fn),
        "accuracy": accuracy(tp, fp, tn, fn),
        "f1": f1(tp, fp, fn),
        "specificity": ratio(tn, tn + fp, 0.0),
    })


def confusion_aggs(pred: Column, obs: Column) -> list[Column]:
    """tp, fp, tn, fn as mergeable aggregates over 0/1 flags."""
    return [
        F.count_if((pred == 1) & (obs == 1)).alias("tp"),
        F.count_if((pred == 1) & (obs == 0)).alias("fp"),
        F.count_if((pred == 0) & (obs == 0)).alias("tn"),
        F.count_if((pred == 0) & (obs == 1)).alias("fn"),
    ]


def default_if_missing(col: Column, default) -> Column:
    return F.coalesce(col, F.lit(default))
