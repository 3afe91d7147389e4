"""Logistic regressions of all runs, feature sets, folds and variants at once.

A model is a (run, set, fold, part, variant): it trains on the run's rows with `test_fold < fold` whose
calibration part is not `part`. Rows are packed once into blocks of one run as arrays. A step is one job for all
models that still move: every block adds up loss, gradient and Hessian of each model of its run,
and the sums per model, a few hundred numbers, are solved for the next point. So the number of jobs
is that of the slowest model's steps, and rows are neither copied per model nor shuffled.

Steps are Newton's with halving until the objective falls; with an L1 penalty the quadratic model
is minimised by coordinate steps with soft thresholds. Objectives are the reference library's: the sum of log losses, plus
|w|^2 / (2 C) without the intercept, or |w| / C with it.

Platt's sigmoid of held-out scores is the same kind of fit with two coefficients and smoothed targets.
Models whose training rows are of one class are not fitted. Keys must not be null; gaps in features
count as 0, rows without a label are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideledger.session import durable, ship_library

# Penalties of the logistic variants (kind, C).
VARIANTS: dict[str, tuple[str, float]] = {
    "L2": ("l2", 1.0), "L1": ("l1", 1.0), "L2_Strong": ("l2", 0.1), "L2_Weak": ("l2", 10.0), "none": ("none", 1.0)}
#: Fold of a model that trains on all rows, and part of one that holds none out.
ALL_FOLDS, NO_PART = 1 << 20, -1
MODEL = ["set", "fold", "part", "variant"]
TOLERANCE = 1e-9
MODEL_TYPE = "set string, fold int, part int, variant string"
BLOCK_TYPE = "n int, x binary, y binary, fold binary, part binary"


def grid(sets: Sequence[str] = ("all",), folds: Sequence[int] = (ALL_FOLDS,), parts: Sequence[int] = (NO_PART,),
         variants: Sequence[str] = ("L2",)) -> list[tuple]:
    """The models of each run as (set, fold, part, variant)."""
    return [(s, f, p, v) for s in sets for f in folds for p in parts for v in variants]


def pack(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, fold: Column | None = None,
         part: Column | None = None) -> DataFrame:
    """Blocks of rows of one run; a fold of -1 trains in every fold."""
    ship_library(rows.sparkSession)
    keys = list(keys)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    chosen = (rows.where(F.col(label).isNotNull())
              .select(*keys, x.alias("x"), F.col(label).cast("double").alias("y"),
                      (F.lit(-1) if fold is None else fold).cast("int").alias("fold"),
                      (F.lit(0) if part is None else part).cast("int").alias("part"))
              .sortWithinPartitions(*keys))
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            y, fold, part = (batch.column(c).to_numpy() for c in ("y", "fold", "part"))
            spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
            at = pa.array([a for a, _ in spans], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in keys), pa.array([b - a for a, b in spans], pa.int32())]
                + [pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for v in (x, y, fold, part)],
                names=[*keys, *[c.split()[0] for c in BLOCK_TYPE.split(", ")]])

    types = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys)
    return durable(chosen.mapInArrow(run, f"{types}, {BLOCK_TYPE}"))


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(index, x, y, fold, part) of each block in a batch."""
    columns = [batch.column(c).to_pylist() for c in ("n", "x", "y", "fold", "part")]
    for i, (n, x, y, fold, part) in enumerate(zip(*columns)):
        yield (i, np.frombuffer(x).reshape(n, -1), np.frombuffer(y), np.frombuffer(fold, np.int32), np.frombuffer(part, np.int32))


def _trains(fold: np.ndarray, part: np.ndarray, model: Mapping) -> np.ndarray:
    return (fold < model["fold"]) & (part != model["part"])


def _held(fold: np.ndarray, part: np.ndarray, model: Mapping) -> np.ndarray:
    return (fold < model["fold"]) & (part == model["part"])


def moments_of(x, y, fold, part, model) -> np.ndarray:
    """Rows, positives, those of the held part, sums and squares of features."""
    on, held = _trains(fold, part, model), _held(fold, part, model)
    return np.concatenate([[on.sum(), y[on].sum(), held.sum(), y[held].sum()], x[on].sum(axis=0), (x[on] ** 2).sum(axis=0)])


def _sums(design: np.ndarray, target: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of weighted log losses at one point."""
    z = design @ at
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    loss = (weight * (np.logaddexp(0, z) - target * z)).sum()
    curve = weight * p * (1 - p)
    return np.concatenate([[loss], design.T @ (weight * (p - target)), ((design * curve[:, None]).T @ design).ravel()])


def base_sums(x, y, fold, part, model) -> np.ndarray:
    on = _trains(fold, part, model)
    design = np.column_stack([np.ones(int(on.sum())), x[on][:, model["columns"]]])
    weight = np.where(y[on] > 0, model["weight_pos"], model["weight_neg"])
    return _sums(design, y[on], weight, np.array(model["at"]))


def sigmoid_sums(x, y, fold, part, model) -> np.ndarray:
    on = _held(fold, part, model)
    base = np.array(model["base"])
    score = base[0] + x[on][:, model["columns"]] @ base[1:]
    target = np.where(y[on] > 0, model["target_pos"], model["target_neg"])
    return _sums(np.column_stack([np.ones(len(score)), score]), target, np.ones(len(score)), np.array(model["at"]))


def _accumulated(sums, keys: Sequence[str], models=None):
    """Worker that adds up `sums` per run and model over neighbouring blocks of one run."""
    names = [*keys, *MODEL, "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_key, held = None, {}

        def out() -> pa.RecordBatch:
            rows = [(*run_key, *m, v.tolist()) for m, v in held.items()]
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

        for batch in batches:
            schema = pa.schema([*(batch.schema.field(k) for k in keys), ("set", pa.string()), ("fold", pa.int32()),
                                ("part", pa.int32()), ("variant", pa.string()), ("sums", pa.list_(pa.float64()))])
            owners = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            own = models or batch.column("models").to_pylist()
            for i, *block in _blocks_of(batch):
                if owners[i] != run_key:
                    if held:
                        yield out()
                    run_key, held = owners[i], {}
                for model in (models or own[i]):
                    name = tuple(model[c] for c in MODEL)
                    found = sums(*block, model)
                    held[name] = held[name] + found if name in held else found
        if held:
            yield out()

    return run


def _total(partial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums per run and model; a list holds one entry per task."""
    lists = partial.groupBy(*keys, *MODEL).agg(F.collect_list("sums").alias("l"))
    sums = F.transform(F.get("l", F.lit(0)), lambda _, i: F.aggregate("l", F.lit(0.0), lambda a, v: a + v[i]))
    return lists.select(*keys, *MODEL, sums.alias("sums"))


def _minimum_with_l1(slope: np.ndarray, curve: np.ndarray, at: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Step to the least of a quadratic plus sum(l1 * |at + step|), coordinate by coordinate."""
    step = np.zeros_like(at)
    for _ in range(500):
        most = 0.0
        for j in range(len(at)):
            rest = slope[j] + curve[j] @ step - curve[j, j] * step[j]
            pull = at[j] * curve[j, j] - rest
            new = np.sign(pull) * max(abs(pull) - l1[j], 0.0) / max(curve[j, j], 1e-12) - at[j]
            most = max(most, abs(new - step[j]))
            step[j] = new
        if most < 1e-12:
            break
    return step


def advance(state: dict, sums: np.ndarray) -> dict:
    """The model's next point, from the sums at its present one."""
    at = np.array(state["at"])
    d = len(at)
    ridge, l1 = np.array(state["ridge"]), np.array(state["l1"])
    objective = sums[0] + 0.5 * (ridge * at ** 2).sum() + (l1 * np.abs(at)).sum()
    out = dict(state, steps=state["steps"] + 1)
    if state["best"] is None or objective <= state["objective"] + 1e-12 * abs(state["objective"]):
        slope, curve = sums[1:1 + d] + ridge * at, sums[1 + d:].reshape(d, d) + np.diag(ridge)
        step = (_minimum_with_l1(slope, curve, at, l1) if l1.any() else
                -np.linalg.lstsq(curve, slope, rcond=1e-14)[0])
        out |= {"best": at.tolist(), "objective": float(objective), "direction": step.tolist(), "length": 1.0,
                "done": bool(np.abs(step).max() <= TOLERANCE * (1 + np.abs(at).max())),
                "at": (at + step).tolist()}
    else:
        length = state["length"] / 2
        best, step = np.array(state["best"]), np.array(state["direction"])
        out |= {"length": length, "at": (best + length * step).tolist(), "done": length < 1e-6}
    return out


_STATE = ("columns array<int>, base array<double>, weight_pos double, weight_neg double, target_pos double, target_neg double, "
          "ridge array<double>, l1 array<double>, at array<double>, best array<double>, direction array<double>, "
          "objective double, length double, steps int, done boolean")
_FIELDS = [c.split()[0] for c in _STATE.split(", ")]


def _solve(blocks: DataFrame, state: DataFrame, keys: Sequence[str], sums, max_steps: int) -> DataFrame:
    """State after the last step; one written table and one small question a step."""
    keys = list(keys)
    schema = state.schema
    state = durable(state)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = row.pop("sums")
                rows.append(row if found is None or row["done"] else advance(row, np.array(found)))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([batch.schema.field(c) for c in [*keys, *MODEL, *_FIELDS]]))

    for _ in range(max_steps):
        moving = state.where(~F.col("done"))
        if moving.isEmpty():
            break
        by_run = moving.groupBy(*keys).agg(F.collect_list(F.struct(
            *MODEL, "columns", "base", "weight_pos", "weight_neg", "target_pos", "target_neg", "at")).alias("models"))
        partial = blocks.join(by_run, keys).mapInArrow(
            _accumulated(sums, keys), _key_types(blocks, keys) + f", {MODEL_TYPE}, sums array<double>")
        state = durable(state.join(_total(partial, keys), [*keys, *MODEL], "left").mapInArrow(step, schema))
    return state


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def fit(blocks: DataFrame, keys: Sequence[str], features: Sequence[str], models: Sequence[tuple],
        sets: Mapping[str, Sequence[str]] | None = None, balanced: bool = False, standardised: bool = False,
        max_steps: int = 100, only: DataFrame | None = None) -> DataFrame:
    """keys, set, fold, part, variant, n, pos, n_held, pos_held, columns, w (intercept first), steps, converged.

    `balanced` weighs both classes alike; `standardised` penalises coefficients as if each feature had
    been scaled to unit variance on the model's training rows. `only` names the (set, variant) that each run
    is to have.
    """
    keys = list(keys)
    ship_library(blocks.sparkSession)
    sets = dict(sets or {"all": features})
    at = {f: i for i, f in enumerate(features)}
    width = len(features)
    named = [dict(zip(MODEL, m)) for m in dict.fromkeys((s, f, p, "") for s, f, p, _ in [(next(iter(sets)), *m[1:]) for m in models])]
    spots = _total(blocks.mapInArrow(_accumulated(moments_of, keys, named),
                                     _key_types(blocks, keys) + f", {MODEL_TYPE}, sums array<double>"), keys)
    sums = F.col("sums")
    spots = spots.select(*keys, "fold", "part", sums[0].alias("n"), sums[1].alias("pos"), sums[2].alias("n_held"),
                         sums[3].alias("pos_held"), F.slice("sums", 5, width).alias("s"),
                         F.slice("sums", 5 + width, width).alias("q")).where("pos > 0 and pos < n")
    wanted = F.explode(F.array(*[F.struct(
        F.lit(s).alias("set"), F.lit(f).alias("fold"), F.lit(p).alias("part"), F.lit(v).alias("variant"),
        F.array(*[F.lit(at[c]) for c in sets[s]]).alias("columns"), F.lit(VARIANTS[v][0]).alias("kind"),
        F.lit(VARIANTS[v][1]).alias("c")) for s, f, p, v in models]))
    spec = (spots.select(*keys).distinct().select(*keys, wanted.alias("m")).select(*keys, "m.*")
            .join(spots, [*keys, "fold", "part"]))
    if only is not None:
        spec = spec.join(only.select(*keys, "set", "variant"), [*keys, "set", "variant"], "left_semi")
    one = F.array(F.lit(1.0))
    zero = F.array(F.lit(0.0))
    mean = lambda j: F.get("s", j) / F.col("n")
    spread = (F.transform("columns", lambda j: F.greatest(F.get("q", j) / F.col("n") - mean(j) * mean(j), F.lit(0.0)))
              if standardised else F.transform("columns", lambda _: F.lit(1.0)))
    nil = F.transform("columns", lambda _: F.lit(0.0))
    ridge = F.when(F.col("kind") == "l2", F.concat(zero, F.transform(spread, lambda v: v / F.col("c")))).otherwise(F.concat(zero, nil))
    l1 = F.when(F.col("kind") == "l1", F.transform(F.concat(one, spread), lambda v: F.sqrt(v) / F.col("c"))).otherwise(F.concat(zero, nil))
    share = F.lit(0.5) * F.col("n")
    empty = F.lit(None).cast("array<double>")
    state = spec.select(
        *keys, *MODEL, "columns", empty.alias("base"),
        (share / F.col("pos") if balanced else F.lit(1.0)).alias("weight_pos"),
        (share / (F.col("n") - F.col("pos")) if balanced else F.lit(1.0)).alias("weight_neg"),
        F.lit(1.0).alias("target_pos"), F.lit(0.0).alias("target_neg"), ridge.alias("ridge"), l1.alias("l1"),
        F.concat(zero, nil).alias("at"), empty.alias("best"), empty.alias("direction"), F.lit(None).cast("double").alias("objective"),
        F.lit(1.0).alias("length"), F.lit(0).alias("steps"), F.lit(False).alias("done"))
    done = _solve(blocks, state, keys, base_sums, max_steps)
    counts = spots.select(*keys, "fold", "part", "n", "pos", "n_held", "pos_held")
    return durable(done.join(counts, [*keys, "fold", "part"]).select(
        *keys, *MODEL, *[F.col(c).cast("long").alias(c) for c in ("n", "pos", "n_held", "pos_held")], "columns",
        F.col("best").alias("w"), "steps", F.col("done").alias("converged")))


def calibrate(blocks: DataFrame, fits: DataFrame, keys: Sequence[str], max_steps: int = 100) -> DataFrame:
    """The fits that hold rows out, with the sigmoid (intercept, slope) of their held-out scores."""
    keys = list(keys)
    neg = F.col("n_held") - F.col("pos_held")
    nil = F.array(F.lit(0.0), F.lit(0.0))
    empty = F.lit(None).cast("array<double>")
    state = fits.where(f"part <> {NO_PART} and n_held > 0").select(
        *keys, *MODEL, "columns", F.col("w").alias("base"), F.lit(1.0).alias("weight_pos"), F.lit(1.0).alias("weight_neg"),
        ((F.col("pos_held") + 1) / (F.col("pos_held") + 2)).alias("target_pos"), (1 / (neg + 2)).alias("target_neg"),
        nil.alias("ridge"), nil.alias("l1"), F.array(F.ln((F.col("pos_held") + 1) / (neg + 1)), F.lit(0.0)).alias("at"),
        empty.alias("best"), empty.alias("direction"), F.lit(None).cast("double").alias("objective"),
        F.lit(1.0).alias("length"), F.lit(0).alias("steps"), F.lit(False).alias("done"))
    done = _solve(blocks, state, keys, sigmoid_sums, max_steps)
    lines = done.select(*keys, *MODEL, F.col("best").alias("sigmoid"))
    return durable(fits.join(lines, [*keys, *MODEL]))


def margin(features: Sequence[str], weights: str = "w", columns: str = "columns") -> Column:
    """Intercept plus weighted features of a row joined with a fit."""
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return F.get(weights, F.lit(0)) + F.aggregate(
        F.zip_with(columns, F.slice(weights, F.lit(2), F.size(columns)), lambda j, w: F.get(x, j) * w), F.lit(0.0), lambda a, v: a + v)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def scored(rows: DataFrame, fits: DataFrame, keys: Sequence[str], features: Sequence[str], fold: str | None = None,
           out: str = "probability") -> DataFrame:
    """Rows with set, variant (and fold) and the probability of every fit of their run.

    With `fold`, a row meets the fits of its own test fold only. Calibrated fits are averaged over their parts.
    """
    keys = list(keys)
    on = fits.withColumnRenamed("fold", "__fold")
    cond = [rows[k] == on[k] for k in keys] + ([rows[fold] == on["__fold"]] if fold else [])
    z = margin(features)
    calibrated = "sigmoid" in fits.columns
    if calibrated:
        # parts of one model side by side, so that rows are not multiplied by them
        on = on.groupBy(*keys, "set", "__fold", "variant", "columns").agg(
            F.collect_list(F.struct("w", "sigmoid")).alias("__fits"))
        cond = [rows[k] == on[k] for k in keys] + ([rows[fold] == on["__fold"]] if fold else [])
        x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])

        def one(f: Column) -> Column:
            score = F.get(f["w"], F.lit(0)) + F.aggregate(F.zip_with(
                "columns", F.slice(f["w"], F.lit(2), F.size("columns")), lambda j, w: F.get(x, j) * w), F.lit(0.0), lambda a, v: a + v)
            return sigmoid(F.get(f["sigmoid"], F.lit(0)) + F.get(f["sigmoid"], F.lit(1)) * score)

        probability = F.aggregate("__fits", F.lit(0.0), lambda a, f: a + one(f)) / F.size("__fits")
    else:
        probability = sigmoid(z)
    kept = [rows[c] for c in rows.columns if c not in ("set", "variant", "n_parts", out)]
    n_parts = (F.size("__fits") if calibrated else F.lit(1)).alias("n_parts")
    return rows.join(on, cond).select(*kept, "set", "variant", n_parts, probability.alias(out))
