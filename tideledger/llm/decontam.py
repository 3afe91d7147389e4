"""Benchmark decontamination: passages of the corpus as queries against an index of test items.

The index is an inverted BM25 index of the test items, a few thousand words to some millions; the
corpus never becomes an index. An item's term weights are divided by the score of the item for
itself, so a passage that holds the whole item scores 1 and one threshold fits items of any length.
Every training passage is a query: windows of `2 * span` words every `span` words, where span is
the least power of two times 32 that holds the item, so an occurrence of an item always lies
inside some window. All items above the threshold are found (no top-k) by block-max WAND: postings
lie in blocks of items with the maximum weight of each term; blocks whose maxima cannot reach the
threshold are passed over (all windows of a batch at once), the others are walked by pivots.
What is found is verified: five-word shingles of question and answer are looked up around the window.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideledger.session import durable

K1, B = 1.2, 0.75
#: Least BM25 score of a window, as a share of the item's score for itself.
THRESHOLD = 0.5
SHINGLE = 5
#: Least share of an item's shingles in the text around the window.
OVERLAP = 0.8
#: Least share of the answer's words there.
ANSWER_OVERLAP = 0.5
SPAN = 32
BLOCK = 4
#: Text of test items that one index may hold (postings take some twenty times that in memory); a larger benchmark
#: is searched index by index.
INDEX_BYTES = 8 << 20
#: Share of the threshold that frequent terms may reach together without being looked up first.
FREQUENT_SHARE = 0.4
#: Proofs of items that a task keeps; others are made again from their text.
KEPT_PROOFS = 4096
#: Words scored at once in a task.
CHUNK_WORDS = 1 << 18

WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the last sentence or line is the answer, all before it the question.

    An item of one sentence is all question.
    """
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if WORD.search(p)]
    if len(parts) < 2:
        return words(text), []
    return words(" ".join(parts[:-1])), words(parts[-1])


def shingles(tokens: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    if not tokens:
        return set()
    if len(tokens) <= size:
        return {tuple(tokens)}
    return {tuple(tokens[i:i + size]) for i in range(len(tokens) - size + 1)}


def bm25_weight(tf: Column, length: Column, average: Column, n: Column, df: Column) -> Column:
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def postings(items: DataFrame) -> DataFrame:
    """item_id, word, weight: normalised BM25 weights of all items, built as grouped counts.

    `item_id` is any key that names one text; items without a key or a text have none.
    """
    id_type = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the same words() as for queries and proofs: another tokenizer's terms would never be met
        for batch in batches:
            found = [words(x) for x in batch.column("t").to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(owner, pa.int64())),
                 pa.array([w for x in found for w in x], pa.string())], ["item_id", "word"])

    tokens = (items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
              .select("item_id", F.col("text").alias("t")).mapInArrow(cut, f"item_id {id_type}, word string"))
    counts = tokens.groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    lengths = counts.groupBy("item_id").agg(F.sum("tf").alias("length"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weighted = (counts.join(lengths, "item_id").join(df, "word").crossJoin(F.broadcast(corpus))  # one row
                .withColumn("weight", bm25_weight(F.col("tf"), F.col("length"), F.col("average"),
                                                  F.col("n"), F.col("df"))))
    own = Window.partitionBy("item_id")
    return weighted.select("item_id", "word", (F.col("weight") / F.sum("weight").over(own)).alias("weight"))


@dataclass
class Index:
    """Inverted index of the items of one span, with block maxima."""

    span: int
    items: list
    terms: dict[str, int]
    starts: np.ndarray
    docs: np.ndarray
    weights: np.ndarray
    places: list = field(init=False)
    scores: list = field(init=False)
    block_starts: np.ndarray = field(init=False)
    block_ids: np.ndarray = field(init=False)
    block_max: np.ndarray = field(init=False)
    base: np.ndarray = field(init=False)
    rare: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.places, self.scores = self.docs.tolist(), self.weights.tolist()
        n_terms, n_blocks = len(self.terms), max(1, -(-len(self.items) // BLOCK))
        term = np.repeat(np.arange(n_terms), np.diff(self.starts))
        key = term * n_blocks + self.docs // BLOCK
        keys, at = np.unique(key, return_inverse=True)
        self.block_max = np.zeros(len(keys))
        np.maximum.at(self.block_max, at, self.weights)
        self.block_ids = keys % n_blocks
        self.block_starts = np.searchsorted(keys // n_blocks, np.arange(n_terms + 1))
        # terms of many blocks are not looked up first, as long as all of them together stay low
        self.base, self.rare = np.zeros(n_blocks), np.ones(n_terms, dtype=bool)
        for t in np.argsort(-np.diff(self.block_starts), kind="stable"):
            own = slice(self.block_starts[t], self.block_starts[t + 1])
            raised = self.base[self.block_ids[own]] + self.block_max[own]
            if raised.max(initial=0.0) > FREQUENT_SHARE * THRESHOLD:
                break
            self.base[self.block_ids[own]] = raised
            self.rare[t] = False


class Proofs:
    """Shingles of whole item, question and answer, and the answer's words, made when an item is first met."""

    def __init__(self, texts: dict):
        self.texts, self.made = texts, {}

    def __getitem__(self, item) -> tuple:
        if item not in self.made:
            if len(self.made) >= KEPT_PROOFS:
                self.made.clear()
            question, answer = split_item(self.texts[item])
            self.made[item] = (shingles(words(self.texts[item])), shingles(question), shingles(answer), set(answer))
        return self.made[item]


def build_indexes(items: list[tuple], weights: list[tuple]) -> list[tuple[Index, Proofs]]:
    """Indexes by span from (item_id, text) and (item_id, word, weight), with what verifies.

    `item_id` is any key that names one text.
    """
    texts = dict(items)
    spans: dict[int, list] = {}
    for item in sorted(texts):
        n = len(words(texts[item]))
        if n:
            spans.setdefault(SPAN << max(0, int(np.ceil(np.log2(n / SPAN)))), []).append(item)
    built = []
    terms = {w: i for i, w in enumerate(sorted({w for _, w, _ in weights}))}
    for span, members in sorted(spans.items()):
        place = {item: i for i, item in enumerate(members)}
        rows = [(w, place[item], x) for item, w, x in weights if item in place]
        rows.sort(key=lambda r: (r[0], r[1]))
        codes = np.array([terms[r[0]] for r in rows], dtype=np.int64)
        index = Index(span, members, terms, np.searchsorted(codes, np.arange(len(terms) + 1)),
                      np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows]))
        built.append((index, Proofs({item: texts[item] for item in members})))
    return built


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and which range each is of."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return starts[owner] + offset, owner


def _open_blocks(index: Index, codes: np.ndarray, windows: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(window, block) whose sum of block maxima may reach the threshold.

    `codes` are the terms of the words and `windows` the first of the two windows that hold each.
    A term counts once for each half of a window, which only raises the bound.
    """
    known = np.flatnonzero(codes >= 0)
    known = known[index.rare[codes[known]]]
    n_terms = len(index.rare)
    halves = np.unique(windows[known] * n_terms + codes[known])
    windows, terms = halves // n_terms, halves % n_terms
    at, owner = _ranges(index.block_starts[terms], index.block_starts[terms + 1])
    if not len(at):
        return []
    n_blocks = len(index.base)
    cell = windows[owner] * n_blocks + index.block_ids[at]
    cell = np.concatenate([cell, cell + n_blocks])
    gain = np.tile(index.block_max[at], 2)
    # cells are folded into a table first: what shares a place only raises the bound
    size = 1 << max(16, int(np.ceil(np.log2(len(cell) + 1))) + 2)
    folded = np.bincount(cell & (size - 1), gain, minlength=size)
    high = folded[cell & (size - 1)] + index.base[cell % n_blocks] >= threshold - 1e-9
    cells, back = np.unique(cell[high], return_inverse=True)
    sums = np.bincount(back, gain[high], minlength=len(cells)) + index.base[cells % n_blocks]
    return [(int(c // n_blocks), int(c % n_blocks)) for c in cells[sums >= threshold - 1e-9]]


def wand(index: Index, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
    """Items of a block whose score for the query terms reaches the threshold, by pivots."""
    lists = []
    for t in terms:
        lo, hi = int(index.starts[t]), int(index.starts[t + 1])
        a = bisect_left(index.places, block * BLOCK, lo, hi)
        b = bisect_left(index.places, (block + 1) * BLOCK, a, hi)
        if a < b:
            lists.append([a, b, max(index.scores[a:b])])
    found = []
    docs, weights = index.places, index.scores
    if sum(x[2] for x in lists) < threshold - 1e-9:
        return found
    while lists:
        lists.sort(key=lambda x: docs[x[0]])
        bound, pivot = 0.0, None
        for x in lists:
            bound += x[2]
            if bound >= threshold - 1e-9:
                pivot = docs[x[0]]
                break
        if pivot is None:
            break
        if docs[lists[0][0]] == pivot:
            score = 0.0
            for x in lists:
                if docs[x[0]] == pivot:
                    score += weights[x[0]]
                    x[0] += 1
            if score >= threshold - 1e-9:
                found.append((pivot, score))
        else:
            for x in lists:
                while x[0] < x[1] and docs[x[0]] < pivot:
                    x[0] += 1
        lists = [x for x in lists if x[0] < x[1]]
    return found


def _verified(proof: tuple, region: list[str]) -> tuple[float, float, float] | None:
    whole, question, answer, answer_words = proof
    own = shingles(region)
    if len(region) > SHINGLE:
        for size in {len(s) for s in (*whole, *question, *answer) if len(s) < SHINGLE}:
            own |= shingles(region, size)
    share = len(whole & own) / len(whole)
    if share < OVERLAP:
        return None
    said = len(answer_words & set(region)) / len(answer_words) if answer_words else 1.0
    if said < ANSWER_OVERLAP:
        return None
    return (share, len(question & own) / len(question) if question else 1.0,
            len(answer & own) / len(answer) if answer else 1.0)


def search(built: list[tuple[Index, dict]], texts: list[str | None],
           threshold: float = THRESHOLD) -> list[tuple]:
    """(text number, item_id, score, overlap, question overlap, answer overlap) of all leaks.

    Each pair comes once, with its best window's score among those verified.
    """
    hits: dict[tuple, tuple] = {}
    tokens: list[list[str]] = []
    first, total = 0, 0
    for i, text in enumerate([*texts, None]):
        if i == len(texts) or (total > CHUNK_WORDS and tokens):
            _search_chunk(built, tokens, first, threshold, hits)
            tokens, first, total = [], i, 0
        if i < len(texts):
            tokens.append(words(text))
            total += len(tokens[-1])
    return [(*k, *v) for k, v in sorted(hits.items())]


def _search_chunk(built, tokens, first, threshold, hits) -> None:
    sizes = np.array([len(t) for t in tokens])
    codes = np.empty(0, dtype=np.int64)
    if built:
        get = built[0][0].terms.get  # one vocabulary for all spans
        codes = np.fromiter((get(w, -1) for t in tokens for w in t), dtype=np.int64, count=int(sizes.sum()))
    for index, proofs in built:
        span = index.span
        begins = np.cumsum(sizes) - sizes
        # a text of n words has segments of `span` words; window w holds segments w - 1 and w
        slots = -(-sizes // span) + 1
        bases = np.cumsum(slots) - slots
        owner = np.repeat(np.arange(len(sizes)), sizes)
        window = bases[owner] + (np.arange(len(owner)) - begins[owner]) // span
        query: dict[int, np.ndarray] = {}
        for w, block in _open_blocks(index, codes, window, threshold):
            d = int(np.searchsorted(bases, w, side="right")) - 1
            lo = max(0, (w - int(bases[d]) - 1) * span)
            hi = min(int(sizes[d]), lo + 2 * span) if w > bases[d] else min(int(sizes[d]), span)
            if w not in query:
                own = np.unique(codes[begins[d] + lo:begins[d] + hi])
                query[w] = own[own >= 0]
            for place, score in wand(index, query[w], block, threshold):
                item = index.items[place]
                key = (first + d, item)
                if key in hits and hits[key][0] >= score:
                    continue
                proof = _verified(proofs[item], tokens[d][max(0, lo - span):hi + span])
                if proof:
                    hits[key] = (score, *proof)


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[tuple[list[tuple[Index, Proofs]], dict]]:
    """Indexes of at most `index_bytes` of test text each, one after the other, and the id of each of their keys.

    Every distinct pair of id and text is an item with its own key, null ids included. Weights come
    from the whole benchmark. Null texts and items without words are left out.
    """
    key = F.md5(F.concat_ws("\x00", F.col("item_id").isNotNull().cast("string"), F.col("item_id").cast("string"), "text"))
    items = durable(items.where("text is not null").select(key.alias("key"), "item_id", "text").dropDuplicates(["key"]))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // index_bytes) or 1
    weights = durable(postings(items.select(F.col("key").alias("item_id"), "text")))
    for k in range(shards):
        def mine(name: str, k: int = k) -> Column:
            return F.pmod(F.xxhash64(name), F.lit(shards)) == k

        part = items.where(mine("key")).select("key", "item_id", "text").collect()
        own = weights.where(mine("item_id")).select("item_id", "word", "weight").collect()
        built = build_indexes([(r.key, r.text) for r in part], [tuple(r) for r in own])
        yield built, {r.key: r.item_id for r in part}


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD,
          index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap: all verified leaks.

    One row per row of docs and leaked item id, that of the best score where an id has several texts (of
    one index); items without an id leak as the id null. Null and empty texts leak nothing, an empty benchmark
    gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType
    rows = docs.select("doc_id", F.col(text).alias("t"))
    out = None
    for built in indexes(items, index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(built)  # bounded by index_bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found, ids = shared.value
            for batch in batches:
                best: dict[tuple, tuple] = {}
                for i, key, *values in search(found, batch.column("t").to_pylist(), threshold):
                    pair = (i, ids[key])
                    best[pair] = max(best.get(pair, ()), tuple(values))
                cols = list(zip(*((*k, *v) for k, v in best.items()))) if best else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], to_arrow_type(item_type))]
                    + [pa.array(c, pa.float64()) for c in cols[2:]],
                    ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        found = rows.mapInArrow(run, f"doc_id {id_type}, item_id {item_type.simpleString()}, score double, overlap double, "
                                     "question_overlap double, answer_overlap double")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD,
          index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs without the rows that leak an item; columns as before, no shuffle."""
    column = docs.columns.index(text)
    for built in indexes(items, index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(built)  # bounded by index_bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = {h[0] for h in search(shared.value[0], batch.column(column).to_pylist(), threshold)}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
