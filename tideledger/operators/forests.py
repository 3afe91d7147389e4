"""Histogram trees of all runs and ensembles at once, one level of every tree per aggregate.

Features are cut into bins by each run's own percentiles (every value its own bin where a run has few). Rows
of a run lie in blocks of arrays; trees lie in chunks of one run and ensemble. A level is one job:
every block counts weights and labels by (open node, drawn feature, bin) for the trees of its run, the counts are
added up per chunk, and the best cut of each open node opens two more. So the number of jobs is the
depth of the deepest tree, however many runs, ensembles and trees there are, and only counts are shuffled.

Resampling weights (Poisson), drawn features and random cuts come from hashes of seed, tree, node and row,
so a retry grows the same trees. A forest takes the best cut by Gini impurity; extra-trees draw one cut a feature,
uniform between the least and greatest bin of the node; boosted trees fit gradients round by round.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideledger.session import durable, ship_library

BINS = 64
#: Trees of a chunk, and rows of a block: a run of fewer rows is one block.
CHUNK_TREES = 50
BLOCK_ROWS = 1 << 16


@dataclass(frozen=True)
class Ensemble:
    """Parameters of one ensemble; `features` is a share, or 'sqrt', of the features drawn at each node."""

    name: str
    trees: int = 1
    depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: float | str = 1.0
    resample: bool = False
    random_cuts: bool = False
    boosted: bool = False
    rate: float = 0.3
    seed: int = 42

    def drawn(self, n_features: int) -> int:
        return max(1, int(n_features ** 0.5 if self.features == "sqrt" else self.features * n_features))


def _mixed(*parts) -> np.ndarray:
    """64-bit hash of broadcast integer arrays."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


#: P(Poisson(1) <= k) for k = 0..7.
_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040.0]))


class Chunk:
    """Some trees of one run and ensemble: nodes as arrays, and the nodes that wait for their cut."""

    def __init__(self, ensemble: Ensemble, first: int, n_trees: int, n_features: int):
        self.e, self.first, self.n_features = ensemble, first, n_features
        shape = (n_trees, 1)
        self.feature, self.cut, self.child = (np.full(shape, -1, np.int32) for _ in range(3))
        self.value = np.zeros(shape)
        self.size = np.ones(n_trees, np.int32)
        self.depth = 0
        # boosted trees wait for their turn
        self.turn = 0
        self.open_tree = np.arange(1 if ensemble.boosted else n_trees)
        self.open_node = np.zeros(len(self.open_tree), np.int32)
        self.root_weight = np.zeros(n_trees)
        self.importance = np.zeros((n_trees, n_features))
        self.gain = np.zeros(n_trees)

    def drawn(self) -> np.ndarray:
        """Features drawn at each open node."""
        h = _mixed(self.e.seed, (self.first + self.open_tree)[:, None], self.open_node[:, None], np.arange(self.n_features)[None])
        return np.argsort(h, axis=1, kind="stable")[:, :self.e.drawn(self.n_features)]

    def leaves(self, x: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """Node of each row in each of these trees."""
        node = np.zeros((len(trees), len(x)), np.int32)
        tree, row = trees[:, None], np.arange(len(x))[None]
        while True:
            f = self.feature[tree, node]
            inner = f >= 0
            if not inner.any():
                return node
            right = x[row, np.maximum(f, 0)] > self.cut[tree, node]
            node = np.where(inner, self.child[tree, node] + right, node)

    def margins(self, x: np.ndarray, upto: int) -> np.ndarray:
        trees = np.arange(upto)
        return self.value[trees[:, None], self.leaves(x, trees)].sum(axis=0) if upto else np.zeros(len(x))

    def counts(self, x: np.ndarray, y: np.ndarray, rid: np.ndarray) -> np.ndarray:
        """Two sums by open node, drawn feature and bin: weight and positives, or Hessian and gradient."""
        drawn = self.drawn()
        n_open, m = drawn.shape
        trees = np.unique(self.open_tree)
        slot = np.full((len(trees), self.feature.shape[1]), -1)
        slot[np.searchsorted(trees, self.open_tree), self.open_node] = np.arange(n_open)
        at = slot[np.arange(len(trees))[:, None], self.leaves(x, trees)]
        if self.e.boosted:
            p = 1 / (1 + np.exp(-self.margins(x, self.turn)))
            one, two = np.broadcast_to(p * (1 - p), at.shape), np.broadcast_to(p - y, at.shape)
        else:
            if self.e.resample:
                u = _uniform(_mixed(self.e.seed + 1, (self.first + trees)[:, None], rid[None]))
                one = np.searchsorted(_POISSON, u, side="right").astype(np.float64)
            else:
                one = np.ones(at.shape)
            two = one * y[None]
        tree, row = np.nonzero((at >= 0) & (one > 0))
        at, one, two = at[tree, row], one[tree, row], two[tree, row]
        out = np.zeros((2, n_open * m * BINS))
        for j in range(m):
            key = (at * m + j) * BINS + x[row, drawn[at, j]]
            out[0] += np.bincount(key, one, minlength=out.shape[1])
            out[1] += np.bincount(key, two, minlength=out.shape[1])
        return out

    def _gains(self, sums: np.ndarray):
        """Gain of each cut, (weight, second sum) of node and left side; impossible cuts gain -1."""
        e = self.e
        left = np.cumsum(sums, axis=3)[..., :-1]
        total = sums.sum(axis=3, keepdims=True)
        right = total - left
        if e.boosted:
            def score(s):
                return s[1] ** 2 / (s[0] + 1.0)

            # rows are not counted; a side needs some Hessian
            fits = (left[0] > 1e-9) & (right[0] > 1e-9) & ((left[0] >= 1.0) & (right[0] >= 1.0))
            gain = score(left) + score(right) - score(total)
        else:
            def gini(s):
                return 2 * s[1] * (s[0] - s[1]) / np.maximum(s[0], 1e-300)

            fits = (left[0] >= max(e.min_leaf, 1)) & (right[0] >= max(e.min_leaf, 1))
            gain = gini(total) - gini(left) - gini(right)
        if e.random_cuts:
            used = sums[0] > 0
            low, high = used.argmax(axis=2), BINS - 1 - used[:, :, ::-1].argmax(axis=2)
            u = _uniform(_mixed(e.seed + 2, (self.first + self.open_tree)[:, None], self.open_node[:, None], self.drawn()))
            chosen = low + np.floor(u * (high - low)).astype(int)
            fits = fits & (np.arange(BINS - 1)[None, None] == chosen[:, :, None])
        return np.where(fits, gain, -1.0), total[:, :, 0, 0], left

    def _value(self, one, two):
        return -self.e.rate * two / (one + 1.0) if self.e.boosted else two / np.maximum(one, 1e-300)

    def grow(self, counts: np.ndarray) -> None:
        """Cuts the open nodes by their counts; their impure children are open then."""
        e, n_open = self.e, len(self.open_tree)
        drawn = self.drawn()
        m = drawn.shape[1]
        sums = counts.reshape(2, n_open, m, BINS)
        gain, total, left = self._gains(sums)
        flat = np.round(gain, 9).reshape(n_open, -1)
        # equal gains: the first feature by number, then the lowest cut
        place = np.where(flat >= flat.max(axis=1, keepdims=True), np.repeat(drawn, BINS - 1, axis=1) * BINS
                         + np.tile(np.arange(BINS - 1), m)[None], 1 << 30).argmin(axis=1)
        j, cut = place // (BINS - 1), place % (BINS - 1)
        best = gain[np.arange(n_open), j, cut]
        if self.depth == 0:
            self.root_weight[self.open_tree] = total[0]
            self.gain[self.open_tree] = best / np.maximum(total[0], 1e-300)
        self.value[self.open_tree, self.open_node] = self._value(*total)
        enough = total[0] >= (0 if e.boosted else e.min_split)
        split = (best > 1e-9) & enough & (True if e.depth is None else self.depth < e.depth)
        tree, node, f, cut = self.open_tree[split], self.open_node[split], drawn[np.arange(n_open), j][split], cut[split]
        side = left[:, split, j[split], cut]
        other = total[:, split] - side
        # two new nodes each, numbered within their tree in order
        rank = np.zeros(len(tree), int)
        if len(tree):
            starts = np.flatnonzero(np.diff(tree, prepend=-1))
            rank = np.arange(len(tree)) - np.repeat(starts, np.diff(np.append(starts, len(tree))))
        child = self.size[tree] + 2 * rank
        np.add.at(self.size, tree, 2)
        wide = int(self.size.max())
        if wide > self.feature.shape[1]:
            grow = ((0, 0), (0, wide - self.feature.shape[1]))
            self.feature, self.cut, self.child = (np.pad(a, grow, constant_values=-1) for a in (self.feature, self.cut, self.child))
            self.value = np.pad(self.value, grow)
        self.feature[tree, node], self.cut[tree, node], self.child[tree, node] = f, cut, child
        np.add.at(self.importance, (tree, f), best[split] / np.maximum(self.root_weight[tree], 1e-300))
        for s, part in ((0, side), (1, other)):
            self.value[tree, child + s] = self._value(*part)
        one = np.concatenate([side, other], axis=1)
        trees, nodes = np.concatenate([tree, tree]), np.concatenate([child, child + 1])
        self.depth += 1
        impure = np.ones(len(trees), bool) if e.boosted else (one[1] > 0) & (one[1] < one[0]) & (one[0] >= e.min_split)
        if e.depth is not None and self.depth >= e.depth:
            impure[:] = False
        order = np.lexsort((nodes[impure], trees[impure]))
        self.open_tree, self.open_node = trees[impure][order], nodes[impure][order].astype(np.int32)
        if e.boosted and not len(self.open_tree) and self.turn + 1 < len(self.size):
            self.turn, self.depth = self.turn + 1, 0
            self.open_tree, self.open_node = np.array([self.turn]), np.zeros(1, np.int32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values over the trees; boosted: their probability."""
        trees = np.arange(len(self.size))
        summed = self.value[trees[:, None], self.leaves(x, trees)].sum(axis=0)
        return 1 / (1 + np.exp(-summed)) if self.e.boosted else summed

    def importances(self) -> np.ndarray:
        """Sum over the trees of shares of the impurity taken away."""
        whole = self.importance.sum(axis=1, keepdims=True)
        return np.where(whole > 0, self.importance / np.maximum(whole, 1e-300), 0.0).sum(axis=0)


def bin_edges(rows: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int = BINS) -> DataFrame:
    """keys and `edges`: per feature the distinct percentiles that cut the run's values (gaps as 0) into bins.

    With fewer than `bins` distinct values the edges are the values themselves.
    """
    marks = [k / bins for k in range(1, bins)]
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    # a run's rows are the days of a port, so its distinct values are few
    return rows.groupBy(*keys).agg(F.array(*[F.when(
        F.count_distinct(v) < bins, F.array_sort(F.collect_set(v))).otherwise(F.array_distinct(F.percentile(v, marks)))
        for v in values]).alias("edges"))


def pack(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, order: Sequence[str]) -> DataFrame:
    """Blocks of binned rows of one run: keys, n, x, y and row id (a hash of `order`)."""
    ship_library(rows.sparkSession)
    keys, width = list(keys), len(features)
    edges = durable(bin_edges(rows.where(F.col(label).isNotNull()), keys, features))

    def bin_of(i: int, value: Column) -> Column:
        return F.size(F.filter(F.get("edges", F.lit(i)), lambda e: e < value))

    placed = F.array(*[bin_of(i, F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for i, f in enumerate(features)])
    per_run = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("__blocks"))
    rid = F.xxhash64(*order)
    chosen = (rows.where(F.col(label).isNotNull()).join(edges, keys).join(durable(per_run), keys)
              .select(*keys, placed.alias("x"), F.col(label).cast("double").alias("y"), rid.alias("rid"),
                      F.pmod(rid, F.col("__blocks")).alias("__block"))
              .repartition(*keys, "__block").sortWithinPartitions(*keys, "__block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = None, []
        for batch in batches:
            own = list(zip(*[batch.column(k).to_pylist() for k in [*keys, "__block"]]))
            cuts = [0, *[i for i in range(1, len(own)) if own[i] != own[i - 1]], len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if own[a] != names:
                    if held:
                        yield out(names, held, batch)
                    names, held = own[a], []
                part = batch.slice(a, b - a)
                held.append((part.column("x").flatten().to_numpy().astype(np.uint8).reshape(-1, width),
                             part.column("y").to_numpy(), part.column("rid").to_numpy()))
            last = batch
        if held:
            yield out(names, held, last)

    def out(names, held, batch) -> pa.RecordBatch:
        arrays = [np.concatenate(v) for v in zip(*held)]
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i]], batch.schema.field(k).type) for i, k in enumerate(keys)] + [pa.array([len(arrays[0])], pa.int32())]
            + [pa.array([v.tobytes()], pa.binary()) for v in arrays], names=[*keys, "n", "x", "y", "rid"])

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return durable(chosen.mapInArrow(run, f"{types}, n int, x binary, y binary, rid binary"))


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple]:
    for n, x, y, rid in zip(*[batch.column(c).to_pylist() for c in ("n", "x", "y", "rid")]):
        yield np.frombuffer(x, np.uint8).reshape(n, -1), np.frombuffer(y), np.frombuffer(rid, np.int64)


def grow(blocks: DataFrame, keys: Sequence[str], n_features: int, ensembles: Sequence[Ensemble]) -> DataFrame:
    """keys, ensemble, chunk, tree (the grown Chunk): one row per run, ensemble and CHUNK_TREES of its trees."""
    spark, keys = blocks.sparkSession, list(keys)
    chunks = [(n, at, pickle.dumps(Chunk(e, at, e.trees if e.boosted else min(CHUNK_TREES, e.trees - at), n_features)))
              for n, e in enumerate(ensembles) for at in range(0, 1 if e.boosted else e.trees, CHUNK_TREES)]
    fresh = spark.createDataFrame([(*c, True) for c in chunks], "ensemble int, chunk int, tree binary, open boolean")
    state = durable(blocks.select(*keys).distinct().crossJoin(F.broadcast(fresh)))  # as many rows as the parameters say
    key_types = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    ids = [*keys, "ensemble", "chunk"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = batch.column("tree").to_pylist()
            for i, block in enumerate(_arrays(batch)):
                sums = pickle.loads(trees[i]).counts(*block)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ids), pa.array([sums.tobytes()], pa.binary())],
                                                 names=[*ids, "sums"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, sums = [], batch.column("sums").to_pylist()
            for tree, found in zip(batch.column("tree").to_pylist(), sums):
                chunk = pickle.loads(tree)
                chunk.grow(sum(np.frombuffer(s) for s in found))
                trees.append((pickle.dumps(chunk), bool(len(chunk.open_tree))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array([t for t, _ in trees], pa.binary()),
                                              pa.array([o for _, o in trees])], names=[*ids, "tree", "open"])

    done = []
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not state.isEmpty():
        work = state.repartition(tasks, *ids).join(blocks, keys)
        partial = work.select(*ids, "tree", "n", "x", "y", "rid").mapInArrow(count, f"{key_types}, ensemble int, chunk int, sums binary")
        added = partial.groupBy(*ids).agg(F.collect_list("sums").alias("sums"))
        grown = durable(state.join(added, ids).select(*ids, "tree", "sums").mapInArrow(
            step, f"{key_types}, ensemble int, chunk int, tree binary, open boolean"))
        done.append(grown.where("not open"))
        state = grown.where("open")
    out = state  # empty here
    for d in done:
        out = out.union(d)
    return out.drop("open")


def importances(grown: DataFrame, keys: Sequence[str], features: Sequence[str], ensembles: Sequence[Ensemble]) -> DataFrame:
    """keys, ensemble, feature, importance: mean over the ensemble's trees, summing to 1."""
    keys, names = list(keys), list(features)
    ids = [*keys, "ensemble"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [pickle.loads(t).importances().tolist() for t in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(sums, pa.list_(pa.float64()))], names=[*ids, "sums"])

    types = ", ".join(f"`{k}` {grown.schema[k].dataType.simpleString()}" for k in keys)
    summed = grown.mapInArrow(run, f"{types}, ensemble int, sums array<double>")
    flat = (summed.select(*ids, F.posexplode("sums").alias("place", "v")).groupBy(*ids, "place").agg(F.sum("v").alias("v")))
    whole = flat.join(flat.groupBy(*ids).agg(F.sum("v").alias("all")), ids)
    label = F.array(*[F.lit(f) for f in names])
    return whole.select(*ids, F.get(label, F.col("place")).alias("feature"),
                        F.when(F.col("all") > 0, F.col("v") / F.col("all")).otherwise(0.0).alias("importance"))


def probabilities(blocks: DataFrame, grown: DataFrame, keys: Sequence[str], ensembles: Sequence[Ensemble]) -> DataFrame:
    """keys, ensemble, rid, probability of every row: the mean of its leaves' shares of positives."""
    keys = list(keys)
    ids = [*keys, "ensemble"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = batch.column("tree").to_pylist()
            for i, (x, _, rid) in enumerate(_arrays(batch)):
                found = pickle.loads(trees[i]).probabilities(x)
                same = pa.array(np.full(len(x), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in ids), pa.array(rid), pa.array(found)],
                                                 names=[*ids, "rid", "p"])

    types = ", ".join(f"`{k}` {grown.schema[k].dataType.simpleString()}" for k in keys)
    parts = grown.join(blocks, keys).select(*ids, "tree", "n", "x", "y", "rid").mapInArrow(
        run, f"{types}, ensemble int, rid long, p double")
    trees = F.array(*[F.lit(1 if e.boosted else e.trees) for e in ensembles])
    return parts.groupBy(*ids, "rid").agg((F.sum("p") / F.first(F.get(trees, F.col("ensemble")))).alias("probability"))


def root_cuts(grown: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The first cut of every tree that has one: keys, ensemble, tree, feature, bin, gain (as a share of all rows) and
    probability_low, probability_high, the values of its two sides."""
    keys, names = list(keys), list(features)
    ids = [*keys, "ensemble"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("tree").to_pylist()):
                chunk = pickle.loads(t)
                cut = np.flatnonzero(chunk.feature[:, 0] >= 0)
                first = chunk.feature[cut, 0]
                same = pa.array(np.full(len(cut), i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(same) for c in ids), pa.array((cut + chunk.first).astype(np.int32)),
                     pa.array([names[f] for f in first], pa.string()), pa.array(chunk.cut[cut, 0]),
                     pa.array(chunk.gain[cut]), *(pa.array(chunk.value[cut, chunk.child[cut, 0] + side]) for side in (0, 1))],
                    names=[*ids, "tree", "feature", "bin", "gain", "probability_low", "probability_high"])

    types = ", ".join(f"`{k}` {grown.schema[k].dataType.simpleString()}" for k in keys)
    return grown.mapInArrow(run, f"{types}, ensemble int, tree int, feature string, bin int, gain double, "
                                  "probability_low double, probability_high double")
