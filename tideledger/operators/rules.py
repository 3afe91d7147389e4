"""Rule predicates and rule generators.

A rule is a row: (keys, rule_id, rule_type, features, logic, rule_name). `features` lists one
feature per slot; every slot compares its feature with its own threshold by `>`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import hash_uniform


# ---- predicates: a missing value or threshold never fires ----------------------------------

def fires(value: Column, threshold: Column, op: str = ">") -> Column:
    test = {">": value > threshold, "<": value < threshold, ">=": value >= threshold,
            "<=": value <= threshold}[op]
    return F.coalesce(test, F.lit(False))


def rule_and(a: Column, b: Column) -> Column:
    return a & b


def rule_or(a: Column, b: Column) -> Column:
    return a | b


def rule_majority(*conds: Column, at_least: int = 2) -> Column:
    total = F.lit(0)
    for c in conds:
        total = total + c.cast("int")
    return total >= at_least


def rule_piecewise(when_high: Column, switch: Column, when_low: Column) -> Column:
    """`when_high` where the switch feature fires, else `when_low`."""
    return F.when(switch, when_high).otherwise(when_low)


def rule_multi(conds: Sequence[Column], logic: Sequence[str]) -> Column:
    """Left-associative chain of conditions: ((c0 op0 c1) op1 c2) ..."""
    out = conds[0]
    for op, cond in zip(logic, conds[1:]):
        out = (out & cond) if op == "AND" else (out | cond)
    return out


def chain_fired(fired: Column, logic: Column) -> Column:
    """`rule_multi` over array columns: fired booleans and connectives."""
    steps = F.arrays_zip(F.slice(fired, F.lit(2), F.size(fired)).alias("f"), logic.alias("op"))
    return F.aggregate(
        steps, F.element_at(fired, 1),
        lambda acc, s: F.when(s.getField("op") == "AND", acc & s.getField("f"))
                        .otherwise(acc | s.getField("f")))


def combine_slots(rule_type: Column, fired: Column, logic: Column) -> Column:
    """Outcome of a rule row from its slot booleans, in slot order."""
    s = [F.get(fired, F.lit(i)) for i in range(3)]
    return (F.when(rule_type == "single", s[0])
             .when(rule_type == "and_2", s[0] & s[1])
             .when(rule_type == "or_2", s[0] | s[1])
             .when(rule_type == "majority_3", rule_majority(*s))
             .when(rule_type == "piecewise", F.when(s[1], s[0]).otherwise(s[2]))
             .otherwise(chain_fired(fired, logic)))


# ---- generators ----------------------------------------------------------------------------
# All work on a ranked list (keys, feature, pos) with pos = 0, 1, 2 ... per key.

def _rule(kind, features, logic, name) -> list[Column]:
    feats = F.array(*features)
    return [F.concat_ws("|", F.lit(kind), F.array_join(feats, "+")).alias("rule_id"),
            F.lit(kind).alias("rule_type"), feats.alias("features"),
            F.array(*[F.lit(x) for x in logic]).cast("array<string>").alias("logic"),
            name.alias("rule_name")]


def _at(ranked: DataFrame, keys, alias: str) -> DataFrame:
    return ranked.select(*keys, F.col("pos").alias(f"p_{alias}"), F.col("feature").alias(alias))


def single_rules(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    f = F.col("feature")
    return ranked.select(*keys, *_rule("single", [f], [], F.concat(f, F.lit(" > threshold"))))


def _and_or(pairs: DataFrame, keys, kinds=("and_2", "or_2"), extra=()) -> tuple:
    a, b = F.col("a"), F.col("b")
    both = pairs.select(*keys, *extra, *_rule(kinds[0], [a, b], ["AND"],
                        F.concat(a, F.lit(" > t1 AND "), b, F.lit(" > t2"))))
    either = pairs.select(*keys, *extra, *_rule(kinds[1], [a, b], ["OR"],
                          F.concat(a, F.lit(" > t1 OR "), b, F.lit(" > t2"))))
    return both, either


def wide_rules(ranked: DataFrame, keys: Sequence[str], max_rules: int = 500) -> DataFrame:
    """Singles; ordered pairs AND, plus OR where (i + j) % 7 = 0; consecutive triples.

    Pair rules stop at min(200, max_rules/2) in (i, j) order and triple rules at
    min(60, max_rules/6). Only the leading features that can reach the cap are paired.
    """
    keys = list(keys)
    cap2, cap3 = min(200, max_rules // 2), min(60, max_rules // 6)
    sized = ranked.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    left = (sized.where(F.col("pos") * (F.col("__n") - 1) < cap2)
                 .select(*keys, F.col("pos").alias("i"), F.col("feature").alias("a"),
                         F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int")))
                          .alias("j"))
                 .where(F.col("i") != F.col("j")))
    right = ranked.select(*keys, F.col("pos").alias("j"), F.col("feature").alias("b"))
    pairs = left.join(right, [*keys, "j"])
    order = ["i", "j"]
    both, either = _and_or(pairs, keys, extra=order)
    either = either.where((F.col("i") + F.col("j")) % 7 == 0)
    seq = Window.partitionBy(*keys).orderBy("i", "j", "__or")
    two = (both.withColumn("__or", F.lit(0)).unionByName(either.withColumn("__or", F.lit(1)))
               .withColumn("__seq", F.row_number().over(seq))
               .where(F.col("__seq") <= cap2).drop("i", "j", "__or", "__seq"))
    step = Window.partitionBy(*keys).orderBy("pos")
    triples = (ranked.withColumns({"b": F.lead("feature", 1).over(step),
                                   "c": F.lead("feature", 2).over(step)})
                     .where(F.col("c").isNotNull() & (F.col("pos") < -(-cap3 // 2))))
    a, b, c = F.col("feature"), F.col("b"), F.col("c")
    majority = triples.select(*keys, *_rule(
        "majority_3", [a, b, c], [],
        F.concat(F.lit("Majority of "), F.concat_ws(", ", a, b, c))))
    piecewise = triples.select(*keys, *_rule(
        "piecewise", [a, b, a], [],
        F.concat(a, F.lit(" > t1 if "), b, F.lit(" > t2 else "), a, F.lit(" > t3"))))
    return (single_rules(ranked, keys).unionByName(two)
            .unionByName(majority).unionByName(piecewise))


# Name patterns of the feature themes and how many names each pairing takes.
THEMES = {
    "extreme": r"_max_|_p(85|90|95)",
    "temporal": r"_trend_|_persistence_|_change_",
    "anomaly": r"anom_",
    "source": r"_sw$|_wa",
}
THEME_SIZES = {"extreme": 8, "temporal": 8, "anomaly": 5, "source": 8}
PAIRINGS = [("extreme", 8, "temporal", 8), ("extreme", 8, "anomaly", 5),
            ("source", 4, "temporal", 4), ("anomaly", 5, "temporal", 5)]


def themed_rules(ranked: DataFrame, keys: Sequence[str], max_rules: int = 250,
                 or_share: float = 0.3, seed: int = 0, themes=None) -> DataFrame:
    """Singles; pairs across themes (OR for a hashed share); triples of the top twelve.

    Theme groups hold at most eight names, so the pairs are bounded.
    """
    keys = list(keys)
    themes = themes or THEMES
    cap2, cap3 = min(80, max_rules // 3), min(25, max_rules // 8)
    marked = None
    for name, pattern in themes.items():
        part = ranked.where(F.col("feature").rlike(pattern)).withColumn("theme", F.lit(name))
        marked = part if marked is None else marked.unionByName(part)
    place = F.row_number().over(Window.partitionBy(*keys, "theme").orderBy("pos")) - 1
    marked = marked.withColumn("place", place).where(F.col("place") < 8)
    pairing = F.array(*[F.struct(F.lit(n).alias("pairing"), F.lit(a).alias("ta"),
                                 F.lit(min(na, THEME_SIZES[a])).alias("na"),
                                 F.lit(b).alias("tb"),
                                 F.lit(min(nb, THEME_SIZES[b])).alias("nb"))
                        for n, (a, na, b, nb) in enumerate(PAIRINGS)])
    left = (marked.withColumn("__p", F.explode(pairing)).select("*", "__p.*")
                  .where((F.col("theme") == F.col("ta")) & (F.col("place") < F.col("na")))
                  .select(*keys, "pairing", F.col("place").alias("i"), F.col("feature").alias("a")))
    right = (marked.withColumn("__p", F.explode(pairing)).select("*", "__p.*")
                   .where((F.col("theme") == F.col("tb")) & (F.col("place") < F.col("nb")))
                   .select(*keys, "pairing", F.col("place").alias("j"), F.col("feature").alias("b")))
    pairs = left.join(right, [*keys, "pairing"]).where(F.col("a") != F.col("b"))
    order = ["pairing", "i", "j"]
    both, either = _and_or(pairs, keys, extra=order)
    drawn = hash_uniform(F.lit(seed), F.col("pairing"), F.element_at("features", 1),
                         F.element_at("features", 2)) < or_share
    seq = Window.partitionBy(*keys).orderBy("pairing", "i", "j", "__or")
    two = (both.withColumn("__or", F.lit(0))
               .unionByName(either.where(drawn).withColumn("__or", F.lit(1)))
               .withColumn("__seq", F.row_number().over(seq))
               .where(F.col("__seq") <= cap2).drop(*order, "__or", "__seq"))
    step = Window.partitionBy(*keys).orderBy("pos")
    triples = (ranked.withColumns({"b": F.lead("feature", 1).over(step),
                                   "c": F.lead("feature", 2).over(step)})
                     .where(F.col("c").isNotNull() & F.col("pos").isin(0, 3, 6))
                     .where(F.col("pos") / 3 < cap3))
    a, b, c = F.col("feature"), F.col("b"), F.col("c")
    majority = triples.select(*keys, *_rule(
        "majority_3", [a, b, c], [], F.concat(F.lit("Majority of "), F.concat_ws(", ", a, b, c))))
    return single_rules(ranked, keys).unionByName(two).unionByName(majority)


def double_rules(ranked: DataFrame, keys: Sequence[str], max_rules: int = 50) -> DataFrame:
    """Unordered pairs of the top singles, AND then OR, in rank order up to the cap."""
    keys = list(keys)
    sized = ranked.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    left = (sized.where(F.col("pos") < F.col("__n") - 1)
                 .select(*keys, F.col("pos").alias("i"), F.col("feature").alias("a"),
                         F.explode(F.sequence((F.col("pos") + 1).cast("int"),
                                              (F.col("__n") - 1).cast("int"))).alias("j")))
    pairs = left.join(ranked.select(*keys, F.col("pos").alias("j"), F.col("feature").alias("b")),
                      [*keys, "j"])
    both, either = _and_or(pairs, keys, ("double_AND", "double_OR"), extra=["i", "j"])
    seq = Window.partitionBy(*keys).orderBy("i", "j", "__or")
    return (both.withColumn("__or", F.lit(0)).unionByName(either.withColumn("__or", F.lit(1)))
                .withColumn("__seq", F.row_number().over(seq))
                .where(F.col("__seq") <= max_rules).drop("i", "j", "__or", "__seq"))


def triple_rules(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """f1 AND f2 AND f3, and (f1 AND f2) OR f4, over the top four; none with fewer features."""
    top = (ranked.where(F.col("pos") < 4).groupBy(*keys)
                 .agg(F.array_sort(F.collect_list(F.struct("pos", "feature"))).alias("__t"))
                 .where(F.size("__t") == 4))
    f = [F.get("__t", F.lit(i)).getField("feature") for i in range(4)]
    join = lambda a, op, b: F.concat(a, F.lit(f" {op} "), b)
    all_three = top.select(*keys, *_rule("triple_AND", f[:3], ["AND", "AND"],
                                         join(join(f[0], "AND", f[1]), "AND", f[2])))
    mixed = top.select(*keys, *_rule("triple_AND_OR", [f[0], f[1], f[3]], ["AND", "OR"],
                                     join(join(f[0], "AND", f[1]), "OR", f[3])))
    return all_three.unionByName(mixed)


def rule_slots(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per rule slot: (keys, rule_id, rule_type, logic, n_slots, slot, feature)."""
    return rules.select(*keys, "rule_id", "rule_type", "logic",
                        F.size("features").alias("n_slots"),
                        F.posexplode("features").alias("slot", "feature"))


def top_features(scores: DataFrame, keys: Sequence[str], score: str, n: int | None = None,
                 ) -> DataFrame:
    """Ranked list (keys, feature, pos) by score descending, name as the tie break."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "feature")) - 1
    ranked = scores.select(*keys, "feature", place.alias("pos"))
    return ranked if n is None else ranked.where(F.col("pos") < n)
