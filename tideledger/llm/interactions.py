"""Audit of how filters overlap: what each removes, at each place of each order.

Every document becomes a mask of the filters that it fails, and masks are counted per part. For
each part a diagram is built over those counts: one level per filter, a pass and a fail edge per
node, counts at the leaves; nodes with equal edges are one node, and each node holds the sum below
it. Exchanging two neighbouring levels touches the nodes of these levels only, so all orders are
visited by one exchange each. In an order's diagram the path of pass edges tells the steps: a
node's fail edge leads to what its filter removes there, its pass edge to what is kept.

Only counts per (part, mask), at most 2^filters a part, reach a Python worker; the documents stay
in the JVM. A null text is empty, a null part the empty string. A document that has no id is never
an earlier copy and has no label. Repeated rows count each; rows of one id are no copies of each other.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideledger.llm.common import let, words_of
from tideledger.session import durable

WEIGHTS = ("n", "good", "toxic")
#: Orders are factorial(filters), so more filters than this are refused.
MOST_FILTERS = 7
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


class CountDiagram:
    """Count-weighted decision diagram over failure masks (bit j: fails filter j)."""

    def __init__(self, n_filters: int, cells: dict[int, tuple[int, ...]]):
        self.order = list(range(n_filters))
        self.weight: list[tuple[int, ...]] = []
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in self.order]
        leaves: dict[tuple[int, ...], int] = {}
        empty = (0,) * (len(next(iter(cells.values()))) if cells else 1)
        row = [self._leaf(leaves, cells.get(self._mask(path), empty)) for path in range(1 << n_filters)]
        for level in reversed(range(n_filters)):
            known: dict[tuple[int, int], int] = {}
            row = [self._node(level, known, row[i], row[i + 1]) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _mask(self, path: int) -> int:
        """The path's top bit belongs to the first level."""
        last = len(self.order) - 1
        return sum(1 << j for j in self.order if path >> (last - j) & 1)

    def _leaf(self, known: dict, weight: tuple[int, ...]) -> int:
        if weight not in known:
            known[weight] = len(self.weight)
            self.weight.append(weight)
        return known[weight]

    def _node(self, level: int, known: dict, passed: int, failed: int) -> int:
        edges = (passed, failed)
        if edges not in known:
            known[edges] = len(self.weight)
            self.weight.append(tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed])))
            self.levels[level][known[edges]] = edges
        return known[edges]

    def swap(self, level: int) -> None:
        """Exchanges the filters of `level` and the next; nodes above keep their edges."""
        upper, lower = self.levels[level], self.levels[level + 1]
        self.levels[level + 1] = {}
        known: dict[tuple[int, int], int] = {}
        for node, (passed, failed) in upper.items():
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            upper[node] = (self._node(level + 1, known, pp, fp), self._node(level + 1, known, pf, ff))
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weights removed, weights kept) down the path of pass edges."""
        found, node = [], self.root
        for level, filter_no in enumerate(self.order):
            node, failed = self.levels[level][node]
            found.append((filter_no, self.weight[failed], self.weight[node]))
        return found


def neighbour_swaps(n: int) -> Iterator[int]:
    """Places to exchange so that all n! orders are visited, each by one exchange from the last.

    The last element sweeps through all places; at each end the others take their own next step.
    """
    if n < 2:
        return
    inner, down = neighbour_swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        try:
            place = next(inner)
        except StopIteration:
            return
        yield place + (1 if down else 0)  # the sweeper stands in front after a sweep down
        down = not down


def part_steps(cells: dict[int, tuple[int, ...]], names: Sequence[str]) -> list[tuple]:
    """filter_order, step and the counts of COUNTS, for every order and step of one part."""
    k = len(names)
    diagram = CountDiagram(k, cells)
    seen: list[tuple[list[int], list]] = [(diagram.order.copy(), diagram.steps())]
    for place in neighbour_swaps(k):
        diagram.swap(place)
        seen.append((diagram.order.copy(), diagram.steps()))
    fails, alone, share = [0] * k, [0] * k, [0] * k
    for _, steps in seen:
        fails[steps[0][0]] = steps[0][1][0]   # first: removes all that fail it
        alone[steps[-1][0]] = steps[-1][1][0]  # last: removes what fails nothing else
        for j, removed, _ in steps:
            share[j] += removed[0]
    return [("".join(names[j] for j in order), place, kept[0], removed[0], fails[j] - removed[0], alone[j],
             removed[1], removed[2], share[j])
            for order, steps in seen for place, (j, removed, kept) in enumerate(steps, 1)]


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 200 words; B: under half of the words differ; C: over 3 % capitals; D: holds a symbol."""
    text = F.coalesce(text, F.lit(""))

    def kept(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    few = let(words_of(text), lambda w: F.struct(
        (F.size(w) < 200).alias("A"), (100 * F.size(F.array_distinct(w)) < 50 * F.size(w)).alias("B")))
    capitals = kept("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return {"few": few, "C": 100 * capitals.cast("long") > 3 * F.length(text), "D": kept("#$%&*|") > 0}


def failure_masks(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask (bits of A to E), good and toxic of every row of docs.

    E, identical to the text of a smaller id, is a join on ids: each distinct text names its least
    id, so a text that a third of all rows share is one row on that side.
    """
    found = text_failures(F.col(text))
    facts = durable(docs.select(
        F.col("doc_id").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        found["few"].alias("few"), found["C"].alias("c"), found["D"].alias("d"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest")))
    bits = sum((F.when(c, F.lit(1 << j)).otherwise(0)
                for j, c in enumerate([F.col("few.A"), F.col("few.B"), F.col("c"), F.col("d")])), F.lit(0))
    facts = facts.select("doc_id", "part", bits.alias("mask"), "digest")
    known = facts.where("doc_id is not null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    no = F.lit(False)
    joined = (known.join(marks, "doc_id", "left").join(firsts, ["doc_id", "digest"], "left")
              .select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"),
                      F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")))
    return joined.union(facts.where("doc_id is null").select("part", "mask", no, no))


def audit_orders(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every part, filter order and step with its counts.

    `masks` has part, mask (bit j: fails filter names[j]), good and toxic, one row per document.
    """
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(names)}: {factorial(len(names))} orders a part")
    names = list(names)
    cells = (masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"),
                                               F.count_if("toxic").alias("toxic"))
             .groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("cells")))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["filter_order", "step", *COUNTS]
        for batch in batches:
            for part, found in zip(batch["part"], batch["cells"]):
                table = {int(c["mask"]): tuple(int(c[w]) for w in WEIGHTS) for c in found}
                out = pd.DataFrame(part_steps(table, names), columns=columns)
                out.insert(0, "part", part)
                yield out

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return cells.mapInPandas(steps, f"part string, filter_order string, step int, {kinds}")
