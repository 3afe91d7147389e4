"""Language of texts by a convolutional network over bytes.

A window of WINDOW bytes passes an embedding of bytes, filters of several widths, the maximum over all
places, and a softmax. The network is trained in numpy on a bounded sample: at most `Sample.docs` labelled
documents a language, least hashes first, and `Sample.windows` windows of each, spread over its whole text. A
document's prediction takes all windows of its whole text: the mean of their probabilities, weighed by bytes.

For prediction, a filter over neighbouring bytes is a sum of table rows, two bytes an entry, so a
window costs two look-ups a byte. Texts are cut into windows batch by batch; a very long text only
means more windows. A null text, one without a letter, and every text if nothing could be learned are `und`
with score 0. Rows without an id or a text are not learned from; repeated rows count once in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
#: The sample is bounded by this many languages; more are refused.
MOST_LANGUAGES = 1000
#: Slots of hashes that a language's documents are chosen in first, before its least hashes of all are.
SLOTS = 32
#: Windows scored in one go.
AT_ONCE = 1024


@dataclass(frozen=True)
class Sample:
    """Bounds of what the network is trained on, and how long."""

    docs: int = 400
    windows: int = 4
    steps: int = 320
    batch: int = 96
    seed: int = 11


@dataclass
class Network:
    """Embedding (256, d), filters by width (width, d, f), their bias, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator, size: int = 8, n_filters: int = 16) -> Network:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(languages, draw(256, size, scale=1.0), [draw(w, size, n_filters, scale=(w * size) ** -0.5) for w in WIDTHS],
                   np.zeros(n_filters * len(WIDTHS), np.float32),
                   draw(n_filters * len(WIDTHS), len(languages), scale=0.1), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of every filter in each window, and where it is; the plain way, for training."""
        x = self.embedding[windows]
        top, places = [], []
        for f in self.filters:
            width = len(f)
            n = windows.shape[1] - width + 1
            response = sum(x[:, j:j + n] @ f[j] for j in range(width))
            at = response.argmax(axis=1)
            places.append(at)
            top.append(np.take_along_axis(response, at[:, None], axis=1)[:, 0])
        return np.concatenate(top, axis=1) + self.bias, places

    def classify(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy; only the bytes at each maximum have a part in it."""
        top, places = self.pooled(windows)
        hidden = np.maximum(top, 0)
        loss = self.classify(top)
        loss[np.arange(len(wanted)), wanted] -= 1
        loss /= len(wanted)
        back = (loss @ self.out.T) * (top > 0)
        d_embedding, d_filters, at = np.zeros_like(self.embedding), [], 0
        for f, place in zip(self.filters, places):
            width, size, n = f.shape
            g = back[:, at:at + n]
            at += n
            d = np.zeros_like(f)
            for j in range(width):
                byte = np.take_along_axis(windows, place + j, axis=1)
                d[j] = np.einsum("bfd,bf->df", self.embedding[byte], g)
                np.add.at(d_embedding, byte, g[:, :, None] * f[j].T[None])
            d_filters.append(d)
        return [d_embedding, *d_filters, back.sum(axis=0), hidden.T @ loss, loss.sum(axis=0)]


def fit(windows: np.ndarray, wanted: np.ndarray, languages: list[str], sample: Sample = Sample()) -> Network:
    """Adam over batches with an equal chance for each language; some windows are cut short, as ends of texts are."""
    rng = np.random.default_rng(sample.seed)
    net = Network.fresh(languages, rng)
    groups = [np.flatnonzero(wanted == k) for k in range(len(languages))]
    mean = [np.zeros_like(w) for w in net.weights()]
    square = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, sample.steps + 1):
        drawn = rng.integers(0, len(languages), sample.batch)
        rows = np.array([groups[k][rng.integers(0, len(groups[k]))] for k in drawn])
        x = windows[rows].copy()
        short = rng.random(sample.batch) < 0.4
        x[short[:, None] & (np.arange(WINDOW) >= rng.integers(12, WINDOW, sample.batch)[:, None])] = 0
        rate = 0.02 * (1 - step / (sample.steps + 1))
        for w, g, m, s in zip(net.weights(), net.gradients(x, drawn), mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return net


def in_training(doc_id: Column) -> Column:
    """Documents to learn from: CRC-32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def training_windows(docs: DataFrame, sample: Sample = Sample(), text: str = "text", language: str = "lang") -> DataFrame:
    """lang and window (bytes) of the sample.

    The documents are chosen by hashes alone; at most sample.docs a language are then looked up, so
    that side may be broadcast.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull() & F.col(language).isNotNull()
                       & F.col(text).rlike(r"\p{L}")).where(in_training(F.col("doc_id")))
    rows = known.select("doc_id", F.col(language).cast("string").alias("lang"), F.col(text).alias("text"))
    keyed = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    chosen = keyed.select("lang", "hash", "doc_id").distinct()
    # a frequent language is first thinned out by slots of its hashes: what is left is bounded
    for by in (["lang", F.pmod("hash", F.lit(SLOTS))], ["lang"]):
        order = Window.partitionBy(*by).orderBy("hash", "doc_id")
        chosen = (chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample.docs)
                  .select("lang", "hash", "doc_id"))
    found = (keyed.join(F.broadcast(chosen), ["lang", "hash", "doc_id"]).groupBy("lang", "hash", "doc_id")
             .agg(F.min("text").alias("text")))
    data = found.select("lang", "hash", F.encode("text", "UTF-8").alias("data"))
    room = F.greatest(F.length("data") - WINDOW, F.lit(0))
    starts = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(sample.windows - 1)), lambda k: (
        room * k / max(sample.windows - 1, 1)).cast("int"))))
    return (data.select("lang", "hash", "data", starts.alias("start"))
            .select("lang", "hash", "start", F.substring("data", F.col("start") + 1, F.lit(WINDOW)).alias("window")))


def train(docs: DataFrame, sample: Sample = Sample(), text: str = "text", language: str = "lang") -> Network | None:
    """The network fitted on the sample; None where nothing is labelled."""
    found = training_windows(docs, sample, text, language).toArrow().to_pandas()
    found = found.sort_values(["lang", "hash", "start"])  # the same order in every run
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the sample is bounded by {MOST_LANGUAGES}")
    windows = np.zeros((len(found), WINDOW), np.uint8)
    for row, data in zip(windows, found["window"]):
        row[:len(data)] = np.frombuffer(data, np.uint8)
    return fit(windows, np.searchsorted(languages, found["lang"]), languages, sample)


class Scorer:
    """The network with its filters as tables over two neighbouring bytes."""

    def __init__(self, net: Network):
        self.net = net
        by_byte = [np.einsum("vd,wdf->wvf", net.embedding, f) for f in net.filters]
        pair = [(t[0][:, None] + t[1][None, :]).reshape(65536, -1) for t in by_byte]
        self.front = np.ascontiguousarray(np.concatenate(pair, axis=1))
        third, (_, _, c, d) = by_byte[1][2], by_byte[2]
        self.back = np.concatenate([np.repeat(third, 256, axis=0), (c[:, None] + d[None, :]).reshape(65536, -1)], axis=1)
        self.n = net.filters[0].shape[2]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """By window and language."""
        by_place = np.ascontiguousarray(windows.T).astype(np.intp)
        pairs = by_place[:-1] * 256 + by_place[1:]
        n, rows = self.n, len(windows)
        top = np.full((rows, self.front.shape[1]), -np.inf, np.float32)
        front, back = np.empty_like(top), np.empty((rows, self.back.shape[1]), np.float32)
        for at in range(len(pairs)):
            self.front.take(pairs[at], axis=0, out=front, mode="clip")
            if at + 3 < len(by_place):
                self.back.take(pairs[at + 2], axis=0, out=back, mode="clip")
                front[:, n:] += back
                np.maximum(top, front, out=top)
            else:  # the last places: widths that still fit
                if at + 2 < len(by_place):
                    third = front[:, n:2 * n] + self.back[by_place[at + 2] * 256, :n]
                    np.maximum(top[:, n:2 * n], third, out=top[:, n:2 * n])
                np.maximum(top[:, :n], front[:, :n], out=top[:, :n])
        return self.net.classify(top + self.net.bias)


def _text_bytes(column: pa.Array) -> list[np.ndarray]:
    """Bytes of each text, without copying them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _shares(texts: list[np.ndarray], scorer: Scorer) -> np.ndarray:
    """Mean probabilities of each text's windows, weighed by bytes; zeros for an empty one."""
    total = np.zeros((len(texts), len(scorer.net.languages)))
    windows, owner, weight = np.zeros((AT_ONCE, WINDOW), np.uint8), np.zeros(AT_ONCE, np.intp), np.zeros(AT_ONCE)
    filled = 0

    def score() -> None:
        if filled:
            found = scorer.probabilities(windows[:filled]) * weight[:filled, None]
            np.add.at(total, owner[:filled], found)

    for i, data in enumerate(texts):
        for at in range(0, len(data), WINDOW * AT_ONCE):
            piece = data[at:at + WINDOW * AT_ONCE]
            while len(piece):
                n = min(AT_ONCE - filled, -(-len(piece) // WINDOW))
                taken = piece[:n * WINDOW]
                to = windows[filled:filled + n].reshape(-1)
                to[:len(taken)] = taken
                to[len(taken):] = 0
                owner[filled:filled + n], weight[filled:filled + n] = i, WINDOW
                weight[filled + n - 1] = len(taken) - (n - 1) * WINDOW
                filled += n
                piece = piece[len(taken):]
                if filled == AT_ONCE:
                    score()
                    filled = 0
    score()
    sizes = np.array([max(len(t), 1) for t in texts], float)
    return total / sizes[:, None] if len(texts) else total


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The columns of docs but the text, with lang_pred and score (0 to 1); every row comes back once."""
    names = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(*names, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            found = np.full(batch.num_rows, UNKNOWN, object)
            score = np.zeros(batch.num_rows)
            at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if scorer and len(at):
                shares = _shares(_text_bytes(column.take(pa.array(at))), scorer)
                best = shares.argmax(axis=1)
                found[at] = np.array(net.languages, object)[best]
                score[at] = np.clip(shares[np.arange(len(at)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])

    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(work, schema)
