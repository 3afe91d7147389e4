"""Token ids in Huffman-coded files.

Code lengths follow from the counts of all ids in the corpus, limited by package-merge, and codes are
canonical, so the lengths alone (one byte per id, in a file beside the data) give the code back. Data files are
sequences of blocks that decode on their own: document ids and lengths, the bit offset of every
`CHECKPOINT`-th id, then the bits. From the checkpoints all stretches of a block are decoded
side by side, one table lookup per id.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideledger.llm.bytefiles import read_bytes, write_bytes
from tideledger.session import durable

END_ID = 2
MAGIC = b"IDH1"
#: magic, bytes after this head, documents, ids, checkpoints, bytes of packed document ids, of packed lengths
HEAD = struct.Struct("<4sIIQIII")
CHECKPOINT = 128
BLOCK_IDS = 1 << 17
BLOCKS_PER_FILE = 64
#: Most distinct ids of a vocabulary: bounds what the driver holds to build the code.
MAX_VOCABULARY = 1 << 20
#: Words or units that a Python worker keeps with their ids; others are encoded for each batch of texts.
KEPT_WORDS = 500_000
DOCS_AT_ONCE = 1024


# -- code --------------------------------------------------------------------------------------


def limited_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (0 for ids that do not occur), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    merged, leaves = weights, [np.ones(len(weights), dtype=bool)]
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
        joined = np.concatenate([weights, packages])
        at = np.argsort(joined, kind="stable")
        merged = joined[at]
        leaves.append(at < len(weights))
    take = 2 * len(order) - 2
    bits = np.zeros(len(order), dtype=np.int64)
    for level in reversed(leaves):
        own = int(level[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    lengths[order] = bits
    return lengths


def code_limit(distinct: int) -> int:
    return max(16, math.ceil(math.log2(max(2, distinct))) + 2)


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    code, before = 0, int(lengths[used[0]]) if len(used) else 0
    by_length = lengths[used]
    at = 0
    while at < len(used):
        size = int(by_length[at])
        code <<= size - before
        n = int(np.searchsorted(by_length, size, side="right")) - at
        codes[used[at:at + n]] = np.arange(code, code + n, dtype=np.uint64)
        code, before, at = code + n, size, at + n
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(width, id, length) for every value of the next `width` bits."""
    width = int(lengths.max(initial=1))
    ids, sizes = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    spread = np.left_shift(1, width - lengths[used].astype(np.int64))
    n = int(spread.sum())
    ids[:n] = np.repeat(used, spread)
    sizes[:n] = np.repeat(lengths[used], spread)
    return width, ids, sizes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes one after the other, highest bit first, and each id's bit offset."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begin = ends - size
    total = int(ends[-1]) if len(ends) else 0
    word = begin >> 5
    value = codes[ids] << (64 - (begin & 31) - size).astype(np.uint64)
    n = total // 32 + 3
    # the parts of a word do not overlap, so their sum is exact in a double
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), minlength=n) + np.bincount(
        word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return words.astype(">u4").tobytes()[:(total + 7) // 8], begin


def unpack_bits(data: bytes, checkpoints: np.ndarray, n: int, table: tuple) -> np.ndarray:
    """The n ids of a bit string; all stretches between checkpoints advance together."""
    width, ids, sizes = table
    raw = np.frombuffer(data + b"\x00" * 8, dtype=np.uint8).astype(np.uint32)
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((CHECKPOINT, len(checkpoints)), dtype=np.uint32)
    at = checkpoints.astype(np.int64)
    last = n - CHECKPOINT * (len(checkpoints) - 1) if len(checkpoints) else 0
    mask = np.uint32((1 << width) - 1)
    for step in range(CHECKPOINT):
        if step == last:
            at = at[:-1]
            if not len(at):
                break
        peek = (words[at >> 3] >> (32 - width - (at & 7)).astype(np.uint32)) & mask
        out[step, :len(at)] = ids[peek]
        at = at + sizes[peek]
    return out.T.ravel()[:n]


def make_block(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """A block with its closing zero byte."""
    bits, begin = pack_bits(ids, lengths, codes)
    names = zlib.compress(json.dumps(doc_ids).encode())
    counts = zlib.compress(sizes.astype("<u4").tobytes())
    points = begin[::CHECKPOINT].astype("<u4").tobytes()
    body = names + counts + points + bits + b"\x00"
    return HEAD.pack(MAGIC, len(body), len(doc_ids), len(ids), len(points) // 4, len(names), len(counts)) + body


def read_blocks(data: bytes, table: tuple) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, lengths, ids) of every block."""
    at = 0
    while at < len(data):
        magic, size, docs, n, points, names, counts = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        a, b = at + names, at + names + counts
        c = b + 4 * points
        doc_ids = json.loads(zlib.decompress(data[at:a]))
        sizes = np.frombuffer(zlib.decompress(data[a:b]), dtype="<u4")
        checkpoints = np.frombuffer(data[b:c], dtype="<u4")
        if len(doc_ids) != docs or len(sizes) != docs:
            raise ValueError(f"damaged block before byte {at}")
        yield doc_ids, sizes, unpack_bits(data[c:at + size - 1], checkpoints, n, table)
        at += size


# -- tokens ------------------------------------------------------------------------------------


class _Codes(dict):
    """word: number; a word that is not there gets the next number and is put into `new`."""

    new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class WordIds:
    """Ids of whole texts, each distinct word or unit encoded once.

    The tokenizer cuts at white space before anything else, so a text's ids are those of its words. Where it
    puts letters to lower case and cuts by CUTS, texts of Latin-1 characters fall into its units (runs of letters,
    digits, runs of signs) instead, of which there are fewer. Words that are letters and a final stop or comma
    are encoded as lower-case letters, many at once.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĴ-ňŊ-ž]+)([.,]?)")
    CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: The same in lower-case Latin-1, with what is white space, a letter and a number there.
    UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r\x20\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size < 1 << 16 else np.dtype("<u4")
        self.closes = {i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        steps = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        cuts = [c.get("pattern", {}).get("Regex") for c in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_units = normal == ["NFC", "Replace", "Lowercase"] and cuts[:1] == [self.CUTS]
        self.clear()

    def clear(self) -> None:
        self.known = _Codes({"": 0})
        self.marks = {m: self._encode([m])[0] for m in (".", ",")} | {"": []}
        self.pool = np.empty(0, np.uint32)
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def parts(self, text: str | None) -> list[str]:
        """Units of a Latin-1 text without added tokens, words of others; each part's ids stand by themselves."""
        if text and self.by_units and not any(a in text for a in self.added):
            low = text.lower()
            try:
                low.encode("latin-1")
                return self.UNIT.findall(low)
            except UnicodeEncodeError:
                pass
        return _words(text)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> dict[str, list[int]]:
        """Ids of words of lower-case letters, many words in one call, cut where a word's last token says so."""
        found: dict[str, list[int]] = {}
        lines = [stems[i:i + 64] for i in range(0, len(stems), 64)]
        for line, ids in zip(lines, self._encode([" ".join(x) for x in lines])):
            parts: list[list[int]] = []
            at = 0
            for k, i in enumerate(ids, 1):
                if i in self.closes:
                    parts.append(ids[at:k])
                    at = k
            if len(parts) != len(line) or at != len(ids):
                parts = self._encode(line)
            found.update(zip(line, parts))
        return found

    def ids_of(self, words: list[str]) -> list[list[int]]:
        match = self.PLAIN.fullmatch
        found = self._stems([w for w in words if w.isalpha() and w.islower()])
        words_left = [w for w in words if w not in found]
        plain = {w: (m[1].lower(), m[2]) for w in words_left if (m := match(w))}
        stems = self._stems(sorted({s for s, _ in plain.values()}))
        others = [w for w in words_left if w not in plain]
        found.update(zip(others, self._encode(others)))
        found.update((w, stems[s] + self.marks[p]) for w, (s, p) in plain.items())
        return [found[w] for w in words]

    def encode(self, texts: list[str | None], end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by `end`, and their counts; null is empty."""
        split = [self.parts(x) for x in texts]
        per_doc = np.array([len(s) for s in split], dtype=np.int64)
        known, pool, starts, sizes = self.known, self.pool, self.starts, self.sizes
        room = len(known) < KEPT_WORDS
        new = known.new = []
        code = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64, count=int(per_doc.sum()))
        if new:
            ids = self.ids_of(new)
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            starts, sizes = np.append(starts, len(pool) + np.cumsum(n) - n), np.append(sizes, n)
            pool = np.append(pool, np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(n.sum())))
            if room:
                self.pool, self.starts, self.sizes = pool, starts, sizes
            else:  # for this call only
                for word in new:
                    del known[word]
        n = sizes[code]
        edges = np.concatenate([[0], np.cumsum(n)])
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        doc_ends = edges[bounds[1:]]
        flat = pool[np.repeat(starts[code] - edges[:-1], n) + np.arange(int(edges[-1]))]
        out = np.insert(flat, doc_ends, end)
        return out, doc_ends - edges[bounds[:-1]] + 1


def _words(text: str | None) -> list[str]:
    """Parts between ASCII blanks, which are white space for the tokenizer too; empty parts have no ids."""
    if not text:
        return []
    for c in "\n\t\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


_ENCODERS: dict[str, WordIds] = {}


def encoder(file: str) -> WordIds:
    if file not in _ENCODERS:
        _ENCODERS[file] = WordIds(file)
    return _ENCODERS[file]


def tokenized(docs: DataFrame, file: str, text: str = "text", end: int = END_ID) -> DataFrame:
    """doc_id, n (ids with the end id) and ids (little-endian, 2 bytes each if the vocabulary allows)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        words = encoder(file)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                ids, sizes = words.encode(part.column("t").to_pylist(), end)
                raw = ids.astype(words.dtype).tobytes()
                cuts = (np.concatenate([[0], np.cumsum(sizes)]) * words.dtype.itemsize).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()),
                     pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "n", "ids"])

    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(run, f"doc_id {id_type}, n long, ids binary")


# -- files -------------------------------------------------------------------------------------


def _counts(rows: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs in the corpus: counted per task, summed by Spark; as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=f"<u{width}")
            own = np.bincount(ids)
            if len(own) > len(total):
                own, total = total, own
            total[:len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    found = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).limit(MAX_VOCABULARY + 1).collect()
    if len(found) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} distinct ids")
    counts = np.zeros(max((r["id"] for r in found), default=-1) + 1, dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def write_ids(docs: DataFrame, path: str, file: str, text: str = "text", end: int = END_ID) -> None:
    """Encodes every text and writes path/code and path/data, in ascending doc_id order.

    Null doc_ids come first; documents of one doc_id are ordered by length, then ids.
    """
    spark = docs.sparkSession
    width = encoder(file).dtype.itemsize
    rows = durable(tokenized(docs, file, text, end))
    counts = _counts(rows, width)
    lengths = limited_lengths(counts, code_limit(int((counts > 0).sum())))
    codes = canonical_codes(lengths)
    code = spark.createDataFrame([(bytearray(zlib.compress(lengths.tobytes())),)], "value binary")
    write_bytes(code, "value", f"{path}/code", 1)
    shared = spark.sparkContext.broadcast((lengths, codes))  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value
        names, sizes, parts, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype=f"<u{width}").astype(np.int64)
            made = make_block(names, np.array(sizes), ids, lengths, codes)[:-1]  # the sink adds the zero byte
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["block"])

        for batch in batches:
            for name, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")):
                names.append(name)
                sizes.append(n)
                parts.append(ids.as_py())
                total += n
                if total >= BLOCK_IDS:
                    yield block()
                    names, sizes, parts, total = [], [], [], 0
        if names:
            yield block()

    ordered = (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "ids")
               .mapInArrow(run, "block binary"))
    write_bytes(ordered, "block", f"{path}/data", BLOCKS_PER_FILE)


def read_ids(spark: SparkSession, path: str, id_type: str = "bigint", with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it in the files), n_tokens, ids_crc32 and ids of every document.

    Files decode on their own; their places follow from the ids of the files before them.
    """
    found = read_bytes(spark, f"{path}/code").select("content").first()
    lengths = np.frombuffer(zlib.decompressobj().decompress(bytes(found[0])), dtype=np.uint8)
    shared = spark.sparkContext.broadcast(lengths)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value)
        for batch in batches:
            for part, piece, content in zip(batch.column("part").to_pylist(), batch.column("piece").to_pylist(), batch.column("content")):
                before = 0
                for names, sizes, ids in read_blocks(content.as_py(), table):
                    ends = np.cumsum(sizes.astype(np.int64))
                    begins = ends - sizes
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int64())) if (
                        with_ids) else pa.nulls(len(names), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(names), pa.int32()), pa.array([piece] * len(names), pa.int32()),
                         pa.array(names, pa.int64() if id_type == "bigint" else pa.string()), pa.array(begins + before, pa.int64()),
                         pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), lists],
                        ["part", "piece", "doc_id", "local", "n_tokens", "ids_crc32", "ids"])
                    before += int(ends[-1]) if len(ends) else 0

    files = read_bytes(spark, f"{path}/data")
    rows = files.select("part", "piece", "content").mapInArrow(
        run, f"part int, piece int, doc_id {id_type}, local long, n_tokens long, ids_crc32 long, ids array<bigint>")
    if not with_ids:
        rows = durable(rows.drop("ids"))
    own = rows.groupBy("part", "piece").agg(F.sum("n_tokens").alias("own"))
    # one row per file
    before = durable(own.withColumn("before", F.coalesce(F.sum("own").over(
        Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("own"))
    keep = ["ids"] if with_ids else []
    return rows.join(before, ["part", "piece"]).select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *keep)
