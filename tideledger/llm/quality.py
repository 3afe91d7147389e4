"""Quality rules whose cutoffs are certified on labelled documents.

Each rule scores a document in thousandths (higher is worse) and rejects it above a cutoff. For
every stratum and rule the cutoffs are tested from the loosest on. The null hypothesis of a cutoff
is "this rule rejects more than `risk / rules` of the good documents of the stratum"; its exact
p-value after k false rejections among n good documents is P(Binomial(n, risk / rules) <= k).
False rejections grow as a cutoff gets stricter, so testing in this order needs no correction
inside a chain, and the error level is shared out equally among the chains (Bonferroni). With
probability 1 - `error` every certified cutoff of every stratum keeps its promise; the rules of a
stratum together reject at most `risk` of its good documents.
Among its certified cutoffs a rule takes the one that rejects most: bad documents count one, good
ones `-good_weight`, ties go to the loosest. A rule without a certified, useful cutoff is off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.llm.common import BLANK_CHARS, let, words_of
from tideledger.session import durable

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Bits of a sort key that hold a word's place; longer texts take the plain path.
PLACE_BITS = 20
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Cutoffs in thousandths, loosest first.
CUTOFFS = {
    "symbols": [3000, 2000, 1500, 1000, 750, 500, 400, 300, 200, 100],
    "repeats": [490, 450, 400, 350, 300, 250, 200, 150],
    "dup_lines": [950, 900, 800, 700, 600, 500, 400, 300],
    "long_words": [15000, 12000, 10000, 9000, 8500, 8000, 7500, 7000],
    "short_words": [-1500, -2000, -2500, -3000, -3250, -3500, -3750, -4000],
}


@dataclass(frozen=True)
class Promise:
    """Most good documents of a stratum that may be rejected, and the chance to break that."""

    risk: float = 0.05
    error: float = 0.1
    good_weight: int = 10


def _covered(places: Column) -> Column:
    """Words in the three-word windows that start at the sorted places."""
    last = F.size(places) - 1
    return F.aggregate(
        F.sequence(F.lit(0), last), F.lit(0).cast("long"),
        lambda total, j: total + F.when(
            j < last, F.least(F.lit(3), F.get(places, j + 1) - F.get(places, j))).otherwise(3))


def _same_window(words: Column, a: Column, b: Column) -> Column:
    return F.forall(F.sequence(F.lit(0), F.lit(2)),
                    lambda k: F.get(words, a + k) == F.get(words, b + k))


def _repeats_by_text(words: Column, starts: Column) -> Column:
    """Places of repeated windows by the words themselves: exact for any length, but slower."""
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"),
        F.get(words, i + 2).alias("c"), i.alias("i"))))

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    return let(windows, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, j: equal(x, F.get(s, j + 1)) | ((j > 0) & equal(x, F.get(s, j - 1)))),
        lambda x: x["i"])))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows found twice or more, the first one included.

    Windows are sorted as one number each: the upper bits of their hash, then their place. What
    falls together is compared word by word; on any difference the text takes the plain path.
    """
    place_mask = (1 << PLACE_BITS) - 1

    def same_key(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0, F.lit(False))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(place_mask)).cast("int")

    def counted(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def sorted_keys(h: Column) -> Column:
            # no equal hashes, no repeats: most texts end here
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<long>")).otherwise(
                F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~place_mask)).bitwiseOR(i.cast("long")))))

        hits = let(let(hashes, sorted_keys), lambda s: F.filter(s, lambda x, j: same_key(x, F.get(s, j + 1)) | (
            (j > 0) & same_key(x, F.get(s, j - 1)))))

        def checked(h: Column) -> Column:
            clash = F.exists(F.sequence(F.lit(0), F.size(h) - 1), lambda j: same_key(
                F.get(h, j), F.get(h, j + 1)) & ~_same_window(w, place(F.get(h, j)), place(F.get(h, j + 1))))
            places = F.when(clash, _repeats_by_text(w, starts)).otherwise(
                F.sort_array(F.transform(h, place)))
            return F.when(F.size(h) == 0, F.lit(0).cast("long")).otherwise(let(places, _covered))

        return (F.when(F.size(w) < 4, F.lit(0).cast("long"))
                .when(F.size(w) > place_mask, let(_repeats_by_text(w, starts), lambda p: F.when(
                    F.size(p) == 0, F.lit(0).cast("long")).otherwise(_covered(p))))
                .otherwise(let(hits, checked)))

    return let(words, counted)


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(text: Column) -> Column:
    """The five counts and the number of lines with a word, as one struct; a null text has none."""
    text = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0)
    counts = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return let(counts, lambda c: let(let(lines, of_lines), lambda n: F.struct(
        c["n_words"].alias("n_words"),
        (F.length(text) - _removed(text, BLANK_CHARS)).cast("long").alias("word_chars"),
        _removed(text, SYMBOLS).cast("long").alias("n_symbols"),
        n["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
        n["n_lines"].alias("n_lines"))))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (
        100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def scores(m: Column) -> dict[str, Column]:
    """Each rule's score in whole thousandths; without words all are 0."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, F.lit(0).cast("long")).otherwise(
            F.floor(1000 * part / F.greatest(whole, F.lit(1))).cast("long"))

    length = share(m["word_chars"], m["n_words"])
    return {"symbols": share(m["n_symbols"], m["n_words"]),
            "repeats": share(m["n_repeat_words"], m["n_words"]),
            "dup_lines": share(m["n_dup_lines"], m["n_lines"]),
            "long_words": length, "short_words": -length}


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back to x >= 1."""
    z = x + 8
    back = F.lit(0.0)
    for k in range(8):
        back = back + F.ln(x + k)
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k); 1 where k is not below the mean (never certified).

    The largest term is P(= k); the others follow by ratios, downwards. Below the mean they fall
    like exp(-j*j / 2n) at least, so terms after 40 * sqrt(n) vanish in a double.
    """
    n, k = n.cast("double"), k.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + (
        k * math.log(p) + (n - k) * math.log1p(-p))
    low = F.greatest(F.lit(1.0), k - F.ceil(40 * F.sqrt(n)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    ratio = F.when(k < 1, F.lit(1.0)).otherwise(F.aggregate(
        F.sequence(k.cast("long"), low.cast("long"), F.lit(-1).cast("long")), start, step,
        lambda acc: acc["total"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * ratio)


def chain_counts(rows: DataFrame, cutoffs: dict[str, list[int]]) -> DataFrame:
    """Per stratum, rule and cutoff: good and bad documents, and those of each that it rejects.

    `rows` has stratum, good (boolean) and one score per rule. A score is placed among its rule's
    cutoffs once; sums over places give all cutoffs, so nothing is repeated per cutoff.
    """
    placed = F.array(*[F.struct(
        F.lit(rule).alias("rule"),
        sum((F.when(F.col(rule) > c, 1).otherwise(0) for c in values), F.lit(0)).alias("place"))
        for rule, values in cutoffs.items()])
    counts = (rows.select("stratum", "good", F.explode(placed).alias("p"))
              .groupBy("stratum", F.col("p.rule").alias("rule"), F.col("p.place").alias("place"))
              .agg(F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad")))
    grid = F.explode(F.array(*[F.struct(
        F.lit(rule).alias("rule"), F.lit(len(values) - j).alias("place"),
        F.lit(c).cast("long").alias("cutoff"))
        for rule, values in cutoffs.items() for j, c in enumerate(values)]))
    cells = counts.select("stratum").distinct().select("stratum", grid.alias("g")).select("stratum", "g.*")
    span = F.explode(F.sequence(F.lit(0), F.col("place")))
    # a score's place counts the cutoffs below it: the loosest cutoff has the highest place
    up = (counts.withColumn("at", span).groupBy("stratum", "rule", F.col("at").alias("place"))
          .agg(F.sum("good").alias("good_hit"), F.sum("bad").alias("bad_hit")))
    total = up.where("place = 0").select("stratum", "rule", F.col("good_hit").alias("n_good"),
                                         F.col("bad_hit").alias("n_bad"))
    return (cells.join(total, ["stratum", "rule"])
            .join(up, ["stratum", "rule", "place"], "left")
            .fillna(0, ["good_hit", "bad_hit"]))


def certified_cutoffs(rows: DataFrame, cutoffs: dict[str, list[int]] = CUTOFFS,
                      promise: Promise = Promise()) -> DataFrame:
    """stratum, rule, cutoff: the chosen certified cutoff of every rule that has one."""
    counts = chain_counts(rows, cutoffs)
    strata = counts.agg(F.count_distinct("stratum").alias("n_strata"))
    p_value = binomial_tail(F.col("n_good"), F.col("good_hit"), promise.risk / len(cutoffs))
    gain = F.col("bad_hit") - promise.good_weight * F.col("good_hit")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("place"))
    return (counts.crossJoin(F.broadcast(strata))  # one row
            .withColumns({"p_value": p_value, "gain": gain})
            .where((F.col("p_value") <= promise.error / (len(cutoffs) * F.col("n_strata")))
                   & (F.col("gain") > 0))
            .withColumn("r", F.row_number().over(best)).where("r = 1")
            .select("stratum", "rule", "cutoff"))


def measured(docs: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum ('' for null) and the struct `m` of counts of every row."""
    return docs.select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"),
                       measures(F.col(text)).alias("m"))


def labelled_scores(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of the labelled documents that pass the base rules.

    Rows without a label are left out; a document with several labels is good if all say so.
    """
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.min("quality") >= 1).alias("good")))
    return (rows.where(~base_failed(F.col("m"))).join(known, "doc_id")
            .select("stratum", "good", *[c.alias(k) for k, c in scores(F.col("m")).items()]))


def fit(rows: DataFrame, labels: DataFrame, cutoffs: dict[str, list[int]] = CUTOFFS,
        promise: Promise = Promise()) -> DataFrame:
    """One row per stratum with a column per rule: its cutoff, or null where it is off.

    Written, so that Spark knows its size (strata x rules) when it chooses the join.
    """
    found = certified_cutoffs(labelled_scores(rows, labels), cutoffs, promise)
    return durable(found.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in cutoffs]))


def judge(rows: DataFrame, cuts: DataFrame, cutoffs: dict[str, list[int]] = CUTOFFS) -> DataFrame:
    """Adds base_failed, rule (the first rule that rejects, else null) and kept.

    `rows` has stratum and m, and any other columns; every row comes back once.
    """
    rule = F.lit(None).cast("string")
    for name, score in reversed(list(scores(F.col("m")).items())):
        if name in cutoffs:
            rule = F.when(score > F.col(f"cut_{name}"), F.lit(name)).otherwise(rule)
    failed = base_failed(F.col("m"))
    return (rows.join(cuts, "stratum", "left")
            .withColumns({"base_failed": failed, "rule": rule})
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of docs that all rules keep; columns as before.

    Counts are made once and written beside the rows: a filter on them, pushed into the scan, would make
    them again for each of its conditions. Documents without the stratum column are one stratum.
    """
    names = docs.columns
    level = F.coalesce(F.col(stratum), F.lit("")) if stratum in names else F.lit("")
    rows = durable(docs.select(F.struct(*names).alias("row"), level.alias("stratum"), measures(F.col(text)).alias("m"))
                   .withColumn("doc_id", F.col("row.doc_id")))
    cuts = fit(rows.select("doc_id", "stratum", "m"), labels)
    return judge(rows, cuts).where("kept").select("row.*")
