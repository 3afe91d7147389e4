"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit where more than half of the hashes of its word shingles have
one. Two fingerprints within `radius` bits share a number that is within half of it of both (flip
half of the differing bits), and two that share one are within `radius` of each other. So every
distinct fingerprint emits all numbers of its ball of half the radius; equal numbers meet.

A ball of 64 bits and radius 2 has 2,081 numbers. They are dealt by their upper bits, of which a ball
has few: a fingerprint is sent once to each value of those bits, and the lower bits are filled
in where the value has arrived. The upper bits taken grow with the count of fingerprints, so that a
value's numbers stay few; a value that still has more than `GROUP` of them is divided by its next
bits before its numbers are made, as often as needed, so memory is bounded at any size or skew.
Equal numbers are linked in a chain, not in pairs, and each link's distance is verified.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.llm.components import components
from tideledger.session import durable

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Most numbers made at once in a task, and the count aimed at for a value of the upper bits.
GROUP = 4_000_000
AIM = 500_000
#: Hashes whose bits are counted at once.
BITS_AT_ONCE = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a whole text; 0 without words.

    A-Z are lower-cased, words are what stands between ASCII blanks; repeated shingles count each
    time; fewer words than a shingle has make one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    join = b" ".join
    if len(words) <= size:
        return digest(join(words), seed)
    n = len(words) - size + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BITS_AT_ONCE):
        hashes = np.array([digest(join(words[i:i + size]), seed)
                           for i in range(at, min(n, at + BITS_AT_ONCE))], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    value = np.packbits((2 * counts > n).astype(np.uint8))
    return int.from_bytes(value.tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE,
                      seed: int = SEED) -> DataFrame:
    """doc_id, text_key and fp (the fingerprint's 64 bits as a long) of every row.

    text_key tells rows of one doc_id with different texts apart.
    """
    rows = docs.select("doc_id", F.col(text).alias("t"), F.xxhash64(text).alias("text_key"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t")
            values = [_signed(fingerprint(texts[i].as_py(), size, seed)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(values, pa.int64())],
                ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, f"doc_id {id_type}, text_key long, fp long")


@functools.cache
def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of `bits` bits with at most `radius` bits set."""
    found = [sum(1 << b for b in chosen) for r in range(min(radius, bits) + 1)
             for chosen in itertools.combinations(range(bits), r)]
    return np.array(found, dtype=np.uint64)


def _equal_neighbours(numbers: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of owners of equal numbers, each with the next one only."""
    ordered = np.sort(numbers)
    if not (ordered[1:] == ordered[:-1]).any():
        return owners[:0], owners[:0]
    order = np.argsort(numbers, kind="stable")
    same = numbers[order][1:] == numbers[order][:-1]
    return owners[order][:-1][same], owners[order][1:][same]


def _links(fps: np.ndarray, free: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints that may still flip `free[i]` of their `low` lowest bits."""
    made = sum(int((free == r).sum()) * len(masks(low, r)) for r in np.unique(free).tolist())
    if len(fps) < 2:
        return
    if made > GROUP and low > 0:
        bit = np.uint64(1) << np.uint64(low - 1)
        have = (fps & bit) != 0
        for side in (False, True):
            # those on this side stay; the others get here by flipping the bit
            left = np.where(have == side, free, free - 1)
            keep = left >= 0
            yield from _links(fps[keep], left[keep], low - 1)
        return
    below = np.uint64((1 << low) - 1)
    numbers, owners = [], []
    for r in np.unique(free).tolist():
        own = fps[free == r]
        ball = masks(low, r)
        numbers.append(((own & below)[:, None] ^ ball[None, :]).ravel())
        owners.append(np.repeat(own, len(ball)))
    yield _equal_neighbours(np.concatenate(numbers), np.concatenate(owners))


def upper_bits(distinct: int, radius: int = RADIUS) -> int:
    """Upper bits to deal by: some AIM numbers for each of their values."""
    ball = len(masks(64, radius // 2))
    return int(np.clip(np.ceil(np.log2(max(1, distinct * ball / AIM))), 1, 24))


def near_pairs(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (a < b): links between distinct fingerprints that join all within `radius` bits.

    `fps` has one long column `fp` of distinct values. Every returned pair is within the radius;
    two fingerprints within it are linked or joined by a chain of such links.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even")
    upper = upper_bits(fps.count(), radius)
    low = 64 - upper
    flips = masks(upper, half)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = np.bitwise_count(flips).astype(np.int8)
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            step = max(1, GROUP // len(flips))
            for at in range(0, len(values), step):
                own = values[at:at + step]
                slot = ((own >> np.uint64(low))[:, None] ^ flips[None, :]).ravel().astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(np.repeat(own, len(flips)).view(np.int64)),
                     pa.array(np.tile(half - spent, len(own)).astype(np.int8))], ["slot", "fp", "free"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def linked(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
            own = np.concatenate([r[0] for r in rows]).view(np.uint64)
            free = np.concatenate([r[1] for r in rows])
            for a, b in _links(own, free, low):
                true = (np.bitwise_count(a ^ b) <= radius) & (a != b)
                if true.any():
                    a, b = a[true].view(np.int64), b[true].view(np.int64)
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

        held, slot = [], None
        for batch in batches:
            slots = batch["slot"].to_numpy()
            cuts = np.flatnonzero(np.diff(slots)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(slots)]):
                if hi == lo:
                    continue
                if held and slots[lo] != slot:
                    yield from linked(held)
                    held = []
                slot = slots[lo]
                held.append((batch["fp"].to_numpy()[lo:hi], batch["free"].to_numpy()[lo:hi].astype(np.int64)))
        if held:
            yield from linked(held)

    dealt = (fps.select("fp").mapInArrow(deal, "slot int, fp long, free byte")
             .repartition(max(parts, (1 << upper) // 256), "slot").sortWithinPartitions("slot"))
    return dealt.mapInPandas(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", size: int = SHINGLE, seed: int = SEED,
                    radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, fp and component_id (least doc_id reachable by links) of every row.

    Null and blank texts have fingerprint 0 and are linked like any other. A null doc_id counts as
    greater than all; a component of such rows alone has a null id. Equal rows all come back.
    """
    rows = durable(with_fingerprints(docs, text, size, seed))
    least = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    members = components(near_pairs(least.select("fp"), radius))
    roots = (least.join(members.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    heads = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(roots.join(heads, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without those that have a nearer-numbered near-duplicate; columns as before.

    Of each component the rows of the least doc_id stay (equal rows of one doc_id are one
    document). Only the dropped rows' keys are joined back.
    """
    found = near_duplicates(docs, text, size, radius=radius)
    gone = durable(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
                   .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    # one plan at every size: what goes grows with the corpus, so it is never broadcast
    return docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (
        F.xxhash64(text) == F.col("__key")), "left_anti")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
