"""Faults of conversations and their least-cost repair.

Rows of a conversation are taken by turn (nulls first; equal turns by role, then the text's hash). Each
row's first fault counts: blank, duplicate (role and text came earlier in the conversation), truncated
(the last visible character is none of `.!?`). `convaudit` says what edits cost and picks the least.

Only short rows (a hash in place of the text) are sorted, over range partitions, and cut into segments
of at most SEGMENT rows of one conversation. A conversation in several segments is put together from
what each says of the four states: costs across it from the last segment back, then the state that
each is entered with from the first on. So no task holds a conversation, however long; one row is made
per segment. Texts are shuffled once, into their order, and pass as a stream. (A SHA-256 of a whole
conversation is a chain by definition: its bytes pass through one task, but are not held.)

Null roles and texts are one space, null conversation ids one conversation. Rows repeated as a whole are
duplicates, counted before the sort. Roles go by their first character: s, u, a, or none of them. An
empty table gives no rows; a conversation of which no row is left has zeros and an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideledger.llm import convaudit
from tideledger.llm.common import BLANK_CHARS
from tideledger.session import durable

#: Rows of a segment; a conversation of n rows is put together from n / SEGMENT rows.
SEGMENT = 1024
#: Rows worked side by side in one call.
AT_ONCE = 1 << 16
FAULTS = ("blank", "duplicate", "truncated")
#: Bits of a row's code above its initial's number (0 to 3).
BLANK, CUT, FIRST = 4, 8, 16
ROLES = {"u": "user", "a": "assistant"}
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of test rows: some dropped, emptied, cut, repeated or of another role."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    case = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    role, text = [F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")]
    text = F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.where(case != 0).select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    role, text = [F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")]
    return rows.select("conv_id", "turn", role.alias("role"), F.unhex(F.md5(text)).alias("hash"), text.alias("text"))


def _code(text: Column) -> Column:
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    shown = F.rtrim(text, F.lit(BLANK_CHARS))
    cut = ~F.substring(shown, -1, 1).isin(".", "!", "?")
    return initial + F.when(shown == "", BLANK).when(cut, CUT).otherwise(0)


def _placed(keyed: DataFrame) -> DataFrame:
    """Distinct rows with their number, in order over range partitions: part, then seq."""
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "hash"]
    short = keyed.groupBy(*order).agg(F.count(F.lit(1)).alias("times"), F.max(_code(F.col("text"))).alias("code"))
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return durable(short.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
                   .withColumns({"part": F.spark_partition_id(), "seq": seq}))


def _segments(placed: DataFrame) -> DataFrame:
    """One row per (conv_id, part, block): its rows in order."""
    block = F.floor(F.col("seq") / SEGMENT).alias("block")
    first = (placed.where(F.col("code").bitwiseAND(BLANK) == 0).groupBy("conv_id", "role", "hash")
             .agg(F.min(F.struct("part", "seq")).alias("at"))
             .select("conv_id", F.col("at.part").alias("part"), F.col("at.seq").alias("seq"),
                     F.lit(FIRST).alias("code"), F.lit(0).cast("long").alias("times")))
    both = placed.select("conv_id", "part", "seq", "code", "times").union(first)
    return (both.groupBy("conv_id", "part", block)
            .agg(F.sort_array(F.collect_list(F.struct("seq", "code", "times"))).alias("rows")))


class _Batch:
    """Arrays of the rows of several segments."""

    def __init__(self, rows: pa.ListArray):
        flat = rows.flatten()
        lengths = np.diff(rows.offsets.to_numpy())
        seg = np.repeat(np.arange(len(rows)), lengths)
        seq, code, times = (flat.field(i).to_numpy() for i in range(3))
        starts = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (seq[1:] != seq[:-1])])[:len(seg)])
        # a row and its mark as the first of its kind stand side by side
        code, times = (np.add.reduceat(x, starts) if len(starts) else x[:0] for x in (code, times))
        self.seg, self.seq, self.times = seg[starts], seq[starts], times
        self.lengths = np.bincount(self.seg, minlength=len(rows))
        self.initial, self.blank, first = code & 3, (code & BLANK) > 0, (code & FIRST) > 0
        self.must_go = self.blank | ~first
        self.cut = ((code & CUT) > 0) & ~self.must_go

    def arrays(self):
        return self.initial, self.must_go, self.cut, self.lengths

    def add(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.seg, values, minlength=len(self.lengths)).astype(np.int64)

    def illegal(self) -> np.ndarray:
        """Adjacent roles that may not follow each other, inside each segment."""
        inside = self.seg[1:] == self.seg[:-1]
        bad = _illegal(self.initial[:-1], self.initial[1:]) & inside
        return self.add(self.times - 1) + np.bincount(self.seg[1:][bad], minlength=len(self.lengths))

    def faults(self) -> list[np.ndarray]:
        again = np.where(self.blank, 0, self.times - ~self.must_go)
        return [self.add(np.where(self.blank, self.times, 0)), self.add(again), self.add(self.cut)]


def _illegal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    pair = before * 4 + after
    return (pair != 1 * 4 + 2) & (pair != 2 * 4 + 3) & (pair != 3 * 4 + 2)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of segments with at most AT_ONCE rows together."""
    offsets = batch.column("rows").offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _slices(whole):
            found = _Batch(batch.column("rows"))
            costs = convaudit.crossing_costs(*found.arrays()).reshape(-1)
            ends = np.cumsum(found.lengths)
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * 16, pa.array(costs))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "part", "block")), lists,
                 pa.array(found.initial[ends - found.lengths].astype(np.int32)), pa.array(found.initial[ends - 1].astype(np.int32))],
                names=["conv_id", "part", "block", "costs", "head", "tail"])


def _borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs beyond each segment of a conversation, and illegal pairs of roles across its start."""
    for batch in batches:
        for conv_id, found in zip(batch["conv_id"], batch["found"]):
            beyond, out = convaudit.CLOSED, []
            for k in range(len(found) - 1, -1, -1):
                s = found[k]
                bad = int(k > 0 and _illegal(found[k - 1]["tail"], s["head"]))
                out.append((conv_id, s["part"], s["block"], list(map(int, beyond)), k == 0, k == len(found) - 1, bad))
                costs = np.array(s["costs"], np.int64).reshape(4, 4)
                beyond = (costs + beyond).min(axis=1)
            yield pd.DataFrame(out, columns=["conv_id", "part", "block", "beyond", "opens", "closes", "across"])


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment: counts, and per state it may be entered with (null: never) the exit, cost and steps.

    A step is (seq, letter, times): the edits before a row's own are inserts with the row's seq; seq -1
    is the end of the conversation.
    """
    for whole in batches:
        for batch in _slices(whole):
            found = _Batch(batch.column("rows"))
            n = batch.num_rows
            beyond = batch.column("beyond").flatten().to_numpy().reshape(-1, 4)
            opens, closes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "closes"))
            optimal, target = convaudit.optimal_arcs(*found.arrays(), beyond, closes)
            best = convaudit.costs_to_end(*found.arrays(), beyond)
            layers = np.concatenate([[0], np.cumsum(found.lengths + 1)])[:-1]
            wanted = np.ones((n, 4), bool)
            wanted[opens, 1:] = False
            seg, state = np.nonzero(wanted)
            entry, _, node, letter = convaudit.least_paths(optimal, target, layers[seg] * 4 + state)
            last = letter < 0
            # rows by layer; the layer after a segment's rows has none
            row_of = np.full(len(best), -1)
            row_of[np.setdiff1d(np.arange(len(best)), layers + found.lengths)] = np.arange(len(found.seq))
            row = row_of[node // 4]
            step_seq = np.where(row < 0, -1, found.seq[row] if len(found.seq) else -1)
            times = np.where((row < 0) | (letter == convaudit.I), 1, found.times[row] if len(found.seq) else 1)
            new = np.where(convaudit.FILLED[node % 4] == convaudit.AFTER_U, ord("u"), ord("a"))
            letters = np.frombuffer(convaudit.LETTERS.encode(), np.uint8)[np.maximum(letter, 0)]
            kept = ~last
            counts = np.bincount(entry[kept], minlength=len(seg))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            steps = pa.StructArray.from_arrays(
                [pa.array(step_seq[kept]), pa.array(letters[kept].astype(np.int32)), pa.array(times[kept]),
                 pa.array(new[kept].astype(np.int32))], names=["seq", "letter", "times", "new"])
            ways = pa.StructArray.from_arrays(
                [pa.array(state.astype(np.int32)), pa.array((node[last] % 4).astype(np.int32)),
                 pa.array(best[layers[seg], state]), pa.ListArray.from_arrays(offsets, steps)],
                names=["enter", "leave", "cost", "steps"])
            each = np.concatenate([[0], np.cumsum(wanted.sum(axis=1))]).astype(np.int32)
            repeats = found.add(found.times - 1) * 3
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "part", "block", "opens")), *map(pa.array, found.faults()),
                 pa.array(found.illegal() + batch.column("across").to_numpy()), pa.array(repeats), pa.ListArray.from_arrays(each, ways)],
                names=["conv_id", "part", "block", "opens", *FAULTS, "illegal", "repeats", "ways"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state that each segment of a conversation is entered with."""
    for batch in batches:
        for conv_id, found in zip(batch["conv_id"], batch["found"]):
            state, out = convaudit.START, []
            for s in found:
                out.append((conv_id, s["part"], s["block"], state))
                state = dict(zip(s["enter"], s["leave"]))[state]
            yield pd.DataFrame(out, columns=["conv_id", "part", "block", "enter"])


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    on = a["conv_id"].eqNullSafe(b["conv_id"])
    for k in keys:
        on &= a[k] == b[k]
    return on


class Repair:
    """The plan of a table's repair: `steps` (one row per segment) and `placed` (one row per distinct row)."""

    def __init__(self, rows: DataFrame):
        self.keyed = _keyed(rows)
        self.id_type = self.keyed.schema["conv_id"].dataType.simpleString()
        self.placed = _placed(self.keyed)
        segments = durable(_segments(self.placed))
        key = f"conv_id {self.id_type}, part int, block long"
        # conversations of several segments: longer than SEGMENT or over a partition's or block's end
        counted = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id")
        long = segments.join(counted, _same(segments, counted), "left_semi")
        crossed = long.mapInArrow(_crossings, f"{key}, costs array<long>, head int, tail int")
        together = crossed.groupBy("conv_id").agg(F.sort_array(F.collect_list(
            F.struct("part", "block", "costs", "head", "tail"))).alias("found"))
        borders = durable(together.mapInPandas(
            _borders, f"{key}, beyond array<long>, opens boolean, closes boolean, across long"))
        yes = F.lit(True)
        closed = F.array(*[F.lit(int(c)).cast("long") for c in convaudit.CLOSED])
        ready = segments.join(borders, _same(segments, borders, "part", "block"), "left").select(
            segments["conv_id"], segments["part"], segments["block"], "rows", F.coalesce("beyond", closed).alias("beyond"),
            F.coalesce("opens", yes).alias("opens"), F.coalesce("closes", yes).alias("closes"),
            F.coalesce("across", F.lit(0).cast("long")).alias("across"))
        step = "struct<seq: long, letter: int, times: long, new: int>"
        counts = ", ".join(f"{c} long" for c in (*FAULTS, "illegal", "repeats"))
        ways = durable(ready.mapInArrow(_audited, (
            f"{key}, opens boolean, {counts}, ways array<struct<enter: int, leave: int, cost: long, steps: array<{step}>>>")))
        many = ways.join(counted, _same(ways, counted), "left_semi")
        chained = many.select("conv_id", "part", "block", F.col("ways.enter").alias("enter"), F.col("ways.leave").alias("leave"))
        together = chained.groupBy("conv_id").agg(F.sort_array(F.collect_list(
            F.struct("part", "block", "enter", "leave"))).alias("found"))
        entered = durable(together.mapInPandas(_entries, f"{key}, enter int"))
        chosen = ways.join(entered, _same(ways, entered, "part", "block"), "left")
        state = F.coalesce("enter", F.lit(convaudit.START))
        way = F.get(F.filter("ways", lambda w: w["enter"] == state), F.lit(0))
        self.steps = durable(chosen.select(ways["conv_id"], ways["part"], ways["block"], "opens", *FAULTS, "illegal", "repeats",
                                           way["cost"].alias("cost"), way["steps"].alias("steps")))

    def _summaries(self, ids: DataFrame) -> DataFrame:
        """Every conversation of `ids` once, with its counts, cost, audit and the turns added at its end."""
        def spelled(s: Column) -> Column:
            # copies of a row go with it
            one = F.chr(s["letter"].cast("long"))
            return F.concat(one, F.repeat(F.lit("D"), (s["times"] - 1).cast("int")))

        audit = F.array_join(F.transform("steps", spelled), "")
        late = F.array_join(F.transform(F.filter("steps", lambda s: s["seq"] == -1), lambda s: F.chr(s["new"].cast("long"))), "")
        parts = self.steps.groupBy("conv_id").agg(
            *[F.sum(c).alias(c) for c in (*FAULTS, "illegal")],
            F.sum(F.col("repeats") + F.when(F.col("opens"), F.col("cost")).otherwise(0)).alias("cost"),
            F.sort_array(F.collect_list(F.struct("part", "block", audit.alias("audit"), late.alias("late")))).alias("found"))
        audits = parts.select(
            "conv_id", *FAULTS, "illegal", "cost", F.array_join("found.audit", "").alias("audit"),
            F.array_join("found.late", "").alias("late"), F.lit(None).cast("long").alias("gaps"))
        gaps = (self.placed.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
                .select("conv_id", "gaps"))
        seen = ids.select("conv_id").distinct()
        whole = audits.unionByName(gaps, allowMissingColumns=True).unionByName(seen, allowMissingColumns=True)
        # each source gives a conversation one row, with values in its own columns
        return whole.groupBy("conv_id").agg(
            *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")],
            *[F.coalesce(F.max(c), F.lit("")).alias(c) for c in ("audit", "late")])

    def ordered(self, ids: DataFrame) -> DataFrame:
        """Texts, edits and summaries of each conversation, one after the other in one partition.

        The edit of a row (kind 0) stands before its text (kind 1); the summary is last.
        """
        step = F.col("steps").alias("steps")
        own = F.filter(step, lambda s: s["seq"] >= 0)
        flat = self.steps.select("part", F.explode(own).alias("s")).select("part", "s.*")
        edits = flat.groupBy("part", "seq").agg(
            F.max(F.when(F.col("letter") != ord("I"), F.col("letter"))).alias("letter"),
            F.max(F.when(F.col("letter") == ord("R"), F.col("new"))).alias("new"),
            F.max(F.when(F.col("letter") == ord("I"), F.col("new"))).alias("one"),
            F.sum(F.when(F.col("letter") == ord("I"), 1).otherwise(0)).alias("n_before"))
        # two inserted turns are always user, then assistant
        before = F.when(F.col("n_before") == 2, "ua").when(F.col("n_before") == 1, F.chr(F.col("one").cast("long"))).otherwise("")
        names = self.placed.select("conv_id", "turn", "role", "hash", "part", "seq")
        kept = edits.where(F.col("letter") != ord("D")).join(names, ["part", "seq"]).select(
            "conv_id", "turn", "role", "hash", F.lit(0).alias("kind"), before.alias("before"),
            F.chr(F.col("new").cast("long")).alias("new"))
        texts = self.keyed.withColumn("kind", F.lit(1))
        summed = self._summaries(ids).select("conv_id", F.lit(2).alias("kind"), F.col("late").alias("before"), F.struct(
            *[c.split()[0] for c in SUMMARY.split(", ")]).alias("summary"))
        mixed = texts.unionByName(kept, allowMissingColumns=True).unionByName(summed, allowMissingColumns=True)
        last = (F.col("kind") == 2).alias("last")
        return (mixed.select("*", last).repartition("conv_id")
                .sortWithinPartitions("conv_id", "last", "turn", "role", "hash", "kind")
                .select("conv_id", "kind", "role", "text", "before", "new", "summary"))


def _turns(rows: pa.RecordBatch, taken: list[bool]) -> Iterator[tuple]:
    """(index, role, text) of repaired turns in order, and (index, None, None) at each conversation's end.

    `taken` holds, from batch to batch, the edit that waits for its text.
    """
    columns = [rows.column(c).to_pylist() for c in ("kind", "role", "text", "before", "new")]
    for i, (kind, role, text, before, new) in enumerate(zip(*columns)):
        if kind == 1:
            if taken:
                yield i, ROLES.get(taken.pop(), role), text
            continue
        for c in before:
            yield i, ROLES[c], ""
        if kind == 0:
            taken.append(new)
        else:
            yield i, None, None


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the repaired conversations."""
    repair = Repair(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, place = [], 0
        for batch in batches:
            at, places, roles, texts = [], [], [], []
            for i, role, text in _turns(batch, waiting):
                if role is None:
                    place = 0
                    continue
                at.append(i)
                places.append(place)
                roles.append(role)
                texts.append(text)
                place += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(pa.array(at, pa.int64())), pa.array(places, pa.int64()), pa.array(roles, pa.string()),
                 pa.array(texts, pa.string())], names=["conv_id", "place", "role", "text"])

    return repair.ordered(rows).mapInArrow(work, f"conv_id {repair.id_type}, place long, role string, text string")


def audits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Every conversation of `ids` (else of rows): counts of faults, cost, audit, and the repaired text's SHA-256."""
    repair = Repair(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, digest, empty = [], hashlib.sha256(), True
        for batch in batches:
            ends, hashes = [], []
            for i, role, text in _turns(batch, waiting):
                if role is None:
                    ends.append(i)
                    hashes.append(digest.hexdigest())
                    digest, empty = hashlib.sha256(), True
                    continue
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
            at = pa.array(ends, pa.int64())
            summary = batch.column("summary").take(at)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(at), *summary.flatten(), pa.array(hashes, pa.string())],
                                             names=["conv_id", *[c.split()[0] for c in SUMMARY.split(", ")], "repaired_sha256"])

    return repair.ordered(rows if ids is None else ids).mapInArrow(
        work, f"conv_id {repair.id_type}, {SUMMARY}, repaired_sha256 string")
