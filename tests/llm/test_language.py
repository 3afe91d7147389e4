import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideledger.llm import bytecnn, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small_net():
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (40, bytecnn.WINDOW)).astype(np.uint8)
    return bytecnn.fit(windows, np.arange(40) % 3, ["a", "b", "c"], bytecnn.Sample(steps=5))


def test_tables_equal_the_plain_network(small_net):
    windows = np.random.default_rng(4).integers(0, 256, (33, bytecnn.WINDOW)).astype(np.uint8)
    windows[:5, 7:] = 0
    want = small_net.classify(small_net.pooled(windows)[0])
    assert np.allclose(bytecnn.Scorer(small_net).probabilities(windows), want, atol=1e-5)


def test_gradients_equal_differences(small_net):
    windows = np.random.default_rng(5).integers(0, 256, (6, bytecnn.WINDOW)).astype(np.uint8)
    wanted = np.array([0, 1, 2, 0, 1, 2])
    # in doubles, so that small steps show
    net = bytecnn.Network(small_net.languages, small_net.embedding.astype(float), [f.astype(float) for f in small_net.filters],
                          *(w.astype(float) for w in (small_net.bias, small_net.out, small_net.out_bias)))

    def loss():
        top, _ = net.pooled(windows)
        return -np.log(net.classify(top)[np.arange(6), wanted]).mean()

    for weight, gradient in zip(net.weights(), net.gradients(windows, wanted)):
        spot = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        was, step = weight[spot], 1e-6
        weight[spot] = was + step
        up = loss()
        weight[spot] = was - step
        down = loss()
        weight[spot] = was
        assert gradient[spot] == pytest.approx((up - down) / (2 * step), rel=1e-3)


def test_all_windows_of_long_texts_count(small_net, monkeypatch):
    texts = [b"", b"x", b"ab" * 700, bytes(range(256)) * 40]
    scorer = bytecnn.Scorer(small_net)
    want = []
    for t in texts:
        parts = [t[i:i + bytecnn.WINDOW] for i in range(0, len(t), bytecnn.WINDOW)]
        rows = np.array([list(p.ljust(bytecnn.WINDOW, b"\0")) for p in parts], np.uint8).reshape(-1, bytecnn.WINDOW)
        share = scorer.probabilities(rows) if len(rows) else np.zeros((0, 3))
        want.append((share * np.array([len(p) for p in parts])[:, None]).sum(axis=0) / max(len(t), 1))
    monkeypatch.setattr(bytecnn, "AT_ONCE", 3)
    got = bytecnn._shares([np.frombuffer(t, np.uint8) for t in texts], scorer)
    assert np.allclose(got, np.array(want), atol=1e-6)


def test_held_out_documents_are_told_apart(spark):
    got = queries.op13_language_id(spark, SF).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(langs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97


def test_only_allowed_rows_are_learned_from_within_the_bound(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 80, "en" if i % 2 else "de") for i in range(300)]
                                 + [(None, "no id", "xx"), (7, None, "yy"), (9, "no language", None), (11, "12 34", "zz")] * 3
                                 + [(1, "text 1 " * 80, "en")] * 50, "doc_id long, text string, lang string")
    found = bytecnn.training_windows(docs.withColumn("hash", F.lit("own")), bytecnn.Sample(docs=5, windows=3)).collect()
    assert {r.lang for r in found} == {"en", "de"} and len(found) == 2 * 5 * 3
    ids = {int(bytes(r.window).split()[i]) for r in found for i in (1, 3) if bytes(r.window).split()[i].isdigit()}
    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)


def test_defined_results_without_letters_labels_or_rows(spark, small_net):
    rows = [(1, None), (2, ""), (3, "12 #"), (None, "é"), (5, "x" * 300000), (5, "x" * 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("n", F.lit(1))
    got = bytecnn.predict(docs, small_net)
    assert got.columns == ["doc_id", "n", "lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert [f for f in found if f[1] == "und"] == [(1, "und"), (2, "und"), (3, "und")] and len(found) == 6
    assert {(r.lang_pred, r.score) for r in bytecnn.predict(docs, None).collect()} == {("und", 0.0)}
    assert bytecnn.predict(docs.limit(0), small_net).count() == 0
    assert bytecnn.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
