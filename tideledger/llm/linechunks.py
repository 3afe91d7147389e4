"""Line dedup by content-defined chunks of lines.

Lines are hashed, and a rolling hash over the last `WINDOW` line hashes ends a chunk wherever it
falls on a multiple of `DIVISOR`; a line of at least `LONG_WORDS` words is a chunk of its own. Borders depend on
the lines next to them only, so a passage that moved into another text is cut at the same lines.
A chunk counts if it has two lines with words or more, or is such a long line. Of all equal chunks
of the corpus the first one (least doc_id, then text key, then place) stays, the others are taken
out. Hashes only propose: chunks of one hash are compared byte by byte before any goes.

A passage of short lines has few chunks that are the same wherever it stands, or none. With
`passages`, the least runs of two lines or more that reach `LONG_WORDS` words are proposed too: from each line
with words on, and up to each. Every passage of so many words is a union of such runs, and a run
goes only if all of it stands in one earlier place. The first place of a line is in no such run, so
every line stays once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.session import durable

WINDOW = 2
DIVISOR = 3
LONG_WORDS = 50
MIN_LINES = 2
#: Odd multiplier of the rolling hash and the shift that picks its well-mixed bits.
STEP = 0x9E3779B97F4A7C15
#: Text sent on in one batch.
BATCH_CHARS = 4 << 20


def rolling(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of each line and the `window - 1` before it (as many as there are)."""
    step = np.uint64(STEP)
    total, weight = np.zeros(len(hashes), dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(window):
            moved = np.zeros(len(hashes), dtype=np.uint64)
            moved[back:] = hashes[:len(hashes) - back] if back else hashes
            total += moved * weight
            weight = weight * step
        return (total ^ (total >> np.uint64(29))) * step


def chunk_lines(text: str | None, window: int = WINDOW, divisor: int = DIVISOR,
                long_words: int = LONG_WORDS) -> tuple[list[str], list[tuple[int, int]]]:
    """Lines of a text and its chunks as (first line, line after the last); a null text is empty."""
    lines = (text or "").split("\n")
    if len(lines) == 1:
        return lines, [(0, 1)]
    hashes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], dtype=np.uint64)
    ends = (rolling(hashes, window) >> np.uint64(33)) % np.uint64(divisor) == 0
    ends[-1] = True
    for i, line in enumerate(lines):
        if len(line) >= 2 * long_words - 1 and len(line.split()) >= long_words:
            ends[i] = True
            if i:
                ends[i - 1] = True
    cuts = (np.flatnonzero(ends) + 1).tolist()
    return lines, list(zip([0, *cuts[:-1]], cuts))


def counts_as_chunk(lines: list[str], min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> bool:
    if sum(1 for x in lines if x and not x.isspace()) >= min_lines:
        return True
    return len(lines) == 1 and len(lines[0].split()) >= long_words


def candidates(text: str | None) -> list[tuple[int, str]]:
    """(place, chunk text) of the chunks that count."""
    lines, spans = chunk_lines(text)
    return [(k, "\n".join(lines[a:b])) for k, (a, b) in enumerate(spans) if counts_as_chunk(lines[a:b])]


def least_runs(lines: list[str], long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """The least runs of lines with `long_words` words from each line on and up to each line, as (first, after the last).

    They begin and end with a line that has words, and have two of these at least: a line that has
    enough alone is a chunk of its own.
    """
    sizes = [len(x.split()) for x in lines]
    worded = [i for i, n in enumerate(sizes) if n]
    found, total, first = set(), 0, 0
    for last, i in enumerate(worded):
        total += sizes[i]
        fits = False
        # the run up to line i gives up its first lines while enough words are left
        while total >= long_words:
            fits = True
            found.add((worded[first], i + 1))  # from its first line on, no shorter run is enough
            total -= sizes[worded[first]]
            first += 1
        if not fits and first and last >= first:
            # the least run up to here takes in lines that were given up
            back, at = total, first
            while back < long_words and at:
                at -= 1
                back += sizes[worded[at]]
            if back >= long_words:
                found.add((worded[at], i + 1))
    return sorted((a, b) for a, b in found if b - a > 1)


def _digest(data: bytes, seed: int = 0) -> bytes:
    return xxhash.xxh3_128_digest(data, seed)


def _proposed(text: str | None, passages: bool) -> Iterator[tuple[int, bytes, list[str]]]:
    """(place, hash, lines): chunks that count at even places and, with `passages`, least runs at odd ones.

    Lines are hashed once, chunks and runs by their lines' hashes.
    """
    lines, spans = chunk_lines(text)
    hashes = [_digest(x.encode("utf-8", "surrogatepass")) for x in lines]
    for k, (a, b) in enumerate(spans):
        if counts_as_chunk(lines[a:b]):
            yield 2 * k, _digest(b"".join(hashes[a:b])), lines[a:b]
    if passages and len(lines) > 1:
        for k, (a, b) in enumerate(least_runs(lines)):
            yield 2 * k + 1, _digest(b"".join(hashes[a:b]), 1), lines[a:b]


def chunk_rows(docs: DataFrame, text: str = "text", passages: bool = False) -> DataFrame:
    """doc_id, text_key, place, h of every chunk that counts and, with `passages`, of every least run."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, h = [], [], []
            for i, value in enumerate(batch.column("t").to_pylist()):
                for k, hashed, _ in _proposed(value, passages):
                    owner.append(i)
                    place.append(k)
                    h.append(hashed)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("text_key").take(take),
                 pa.array(place, pa.int32()), pa.array(h, pa.binary())], ["doc_id", "text_key", "place", "h"])

    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {id_type}, text_key long, place int, h binary")


def _marks(rows: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """Per document the places of chunks and runs that occur elsewhere (`same`) and of those to take out (`gone`)."""
    at = F.struct("doc_id", "text_key", "place")
    again = (rows.groupBy("h").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    if but is not None:
        again = again.join(but, "h", "left_anti")
    again = durable(again.drop("n"))
    found = rows.join(again, "h").withColumn("gone", ~at.eqNullSafe(F.col("first")))
    return (found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
            .agg(F.collect_list("place").alias("__same"),
                 F.collect_list(F.when(F.col("gone"), F.col("place"))).alias("__gone")))


def _marked(docs: DataFrame, text: str, marks: DataFrame) -> DataFrame:
    """docs with __same and __gone (null without a repeated chunk), written."""
    keyed = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key"))
    # one plan at every size: the marks grow with the corpus, so they are never broadcast
    return durable(docs.join(durable(marks).hint("merge"), keyed, "left").drop("__id", "__key"))


def _clashes(marked: DataFrame, text: str) -> DataFrame:
    """Hashes whose chunks are not all equal, byte by byte: grouped by the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, chunks, size = [], [], 0
            for value, same in zip(batch.column("t").to_pylist(), batch.column("__same").to_pylist()):
                wanted = set(same)
                for k, hashed, chunk in _proposed(value, any(p % 2 for p in wanted)):
                    if k in wanted:
                        h.append(hashed)
                        chunks.append("\n".join(chunk))
                        size += len(chunks[-1])
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(chunks, pa.string())], ["h", "chunk"])
                    h, chunks, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(chunks, pa.string())], ["h", "chunk"])

    texts = (marked.where("__same is not null").select(F.col(text).alias("t"), "__same")
             .mapInArrow(run, "h binary, chunk string"))
    return texts.groupBy("h", "chunk").agg(F.lit(1).alias("one")).groupBy("h").count().where("count > 1").select("h")


def without_places(text: str, gone: list[int]) -> tuple[str, int]:
    """The text without the chunks and passages at these places, and how many lines went."""
    lines, spans = chunk_lines(text)
    out: set[int] = set()
    for k in gone:
        if k % 2 == 0:
            out.update(range(*spans[k // 2]))
    runs = least_runs(lines) if any(k % 2 for k in gone) else []
    for k in gone:
        if k % 2:
            out.update(range(*runs[k // 2]))
    left = [x for i, x in enumerate(lines) if i not in out]
    return "\n".join(left), len(lines) - len(left)


def dedup_lines(docs: DataFrame, text: str = "text", passages: bool = False) -> DataFrame:
    """docs with repeated chunks taken out of `text`, and columns removed_lines, removed_chunks.

    With `passages`, whole repeated passages of LONG_WORDS words or more on two lines or more go too; their
    lines count in removed_lines.

    Every row comes back, with an empty text if all of it was repeated; null texts stay null. Equal
    rows (doc_id and text) count as one document, so they keep the same chunks. Chunks that
    share a hash but differ all stay.
    """
    docs = docs.drop("removed_lines", "removed_chunks")
    rows = durable(chunk_rows(docs, text, passages))
    marked = _marked(docs, text, _marks(rows))
    clashes = durable(_clashes(marked, text))
    if not clashes.isEmpty():
        marked = _marked(docs, text, _marks(rows, clashes))
    names = docs.columns
    column = names.index(text)
    schema = docs.schema
    schema = schema.add("removed_lines", "long").add("removed_chunks", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__gone").to_pylist()
            texts = batch.column(column).to_pylist()
            lines = [0] * len(texts)
            for i, gone in enumerate(lists):
                if gone:
                    texts[i], lines[i] = without_places(texts[i], gone)
            columns = [batch.column(n) if j != column else pa.array(texts, pa.string())
                       for j, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(lines, pa.int64()), pa.array([sum(k % 2 == 0 for k in g or ()) for g in lists], pa.int64())],
                [*names, "removed_lines", "removed_chunks"])

    return marked.select(*names, "__gone").mapInArrow(run, schema)


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with repeated chunks and passages taken out; columns as before, n_chars follows the text."""
    out = dedup_lines(docs, text, passages=True).drop("removed_lines", "removed_chunks")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(kind))
    return out.select(*docs.columns)
