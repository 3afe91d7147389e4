import gzip
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideledger.llm import idfiles, pieces, warc
from tideledger.llm.queries import tokenizer_file
from tideledger.session import shared_folder

PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "same"), (3, "http://c/\r\nX: y", "same"), (4, "http://d/", None), (5, "http://e/", ""),
         (6, "http://f/", "WARC/1.1\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "http://g/é", "é" * 70000), (8, "h", "same")]


def test_archive_round_trip_with_revisits(spark):
    path = shared_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    rows = {int(r.record_id): r for r in warc.read_archives(spark, path).collect()}
    assert len(rows) == len(PAGES)
    for i, _, html in PAGES:
        payload = (html or "").encode()
        keep = max(j for j, _, other in PAGES if (other or "") == (html or ""))
        r = rows[i]
        assert (r.gap, r.payload_bytes, r.payload_digest) == (None, len(payload), warc.base32_sha1(payload))
        assert (r.record_type, r.refers_to) == (("response", None) if i == keep else ("revisit", str(keep)))
        if i == keep:
            assert bytes(r.payload) == payload


def test_empty_tables_and_repeated_rows(spark):
    path = shared_folder(spark, "warc")
    frame = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a")], "page_id long, url string, html string")
    warc.write_archives(frame, path)
    assert sorted(r.record_type for r in warc.read_archives(spark, path).collect()) == ["response", "response", "revisit"]


def archive(n=20, packed=True):
    parts = [warc.record("response", i, "u", warc.base32_sha1(b"x" * i), i, b"x" * i) for i in range(n)]
    return [warc.member(p) if packed else p for p in parts]


def ids_of(found):
    return [int(f[3]["warc-record-id"][12:-1]) for f in found if f[0] == "record"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    parts = archive(packed=packed)
    whole = b"".join(parts)
    assert ids_of(warc.salvage(whole)) == list(range(20)) and not [f for f in warc.salvage(whole) if f[0] == "gap"]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    rng = random.Random(4)
    for _ in range(60):
        k = rng.randrange(1, 19)
        data = bytearray(whole)
        # headers of plain records carry no checksum, so there only the version line and the end are hit
        at = starts[k] + (rng.randrange(len(parts[k]) - 4) if packed else rng.choice([0, 3, 5, 7, len(parts[k]) - 2]))
        data[at] ^= 0x55
        found = list(warc.salvage(bytes(data)))
        assert set(range(20)) - set(ids_of(found)) <= {k}
        spans = sorted((f[1], f[2]) for f in found)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
        if k not in ids_of(found):
            assert [(f[1], f[2]) for f in found if f[0] == "gap"] == [(starts[k], starts[k + 1])]


def test_salvage_of_cuts_junk_and_mixtures():
    parts = archive(6)
    junk = b"junk \x1f\x8b\x08 WARC/1.1 more"
    found = list(warc.salvage(parts[0] + junk + parts[1] + b"\0\0" + archive(6, False)[2] + parts[3][:30]))
    assert ids_of(found) == [0, 1, 2]
    assert [f[2] - f[1] for f in found if f[0] == "gap"] == [len(junk), 30]
    assert ids_of(warc.salvage(gzip.compress(b"".join(archive(4, False))))) == [0, 1, 2, 3]
    assert list(warc.salvage(b"")) == [] and [f[0] for f in warc.salvage(b"abc")] == ["gap"]


def test_limited_lengths_are_optimal_and_codes_prefix_free():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 4), (2, 4), (5, 3), (30, 6), (300, 16), (1000, 11)):
        counts = rng.zipf(1.3, n).clip(max=10 ** 9)
        lengths = idfiles.limited_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
        words = [format(c, f"0{s}b") for c, s in zip(idfiles.canonical_codes(lengths).tolist(), lengths.tolist())]
        assert not any(b.startswith(a) for a, b in itertools.pairwise(sorted(words)))
        if n == 5:
            best = min(sum(c * x for c, x in zip(counts, trial)) for trial in itertools.product(range(1, 4), repeat=5)
                       if sum(2.0 ** -x for x in trial) <= 1)
            assert int((counts * lengths).sum()) == best
        heap = sorted(counts.tolist())
        if limit == 16 and n > 1:
            cost = 0
            while len(heap) > 1:
                heap.sort()
                heap = [heap[0] + heap[1], *heap[2:]]
                cost += heap[0]
            if idfiles.limited_lengths(counts, 60).max() <= 16:
                assert int((counts * lengths).sum()) == cost


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 3000).astype(np.int64)
    lengths = idfiles.limited_lengths(np.bincount(ids), 16)
    block = idfiles.make_block([5, None], np.array([n - 1, 1]), ids, lengths, idfiles.canonical_codes(lengths))
    [(names, sizes, back)] = list(idfiles.read_blocks(block, idfiles.decode_table(lengths)))
    assert names == [5, None] and sizes.tolist() == [n - 1, 1] and (back == ids).all() and block[-1] == 0


TEXTS = [(3, "The quick, brown fox. It's 12 o'clock!"), (1, None), (2, ""), (9, "  \n\t "), (4, "ÉÀß ǅ İx ﬁ e\u0301 <|endoftext|> 日本語 \u00a0x\x1cy\u2003z"),
         (7, "word " * 5000), (None, "null id"), (4, "again"), (5, "don't can't. x,y,z... A.B")]


def test_id_files_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer
    file = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    path = shared_folder(spark, "ids")
    idfiles.write_ids(spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("ids", F.lit(1)), path, file)
    got = sorted(idfiles.read_ids(spark, path).collect(), key=lambda r: r.start)
    want = {x: t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in TEXTS}
    assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    place = 0
    by_id = {}
    for i, x in TEXTS:
        by_id.setdefault(i, []).append(want[x])
    for r in got:
        assert r.start == place and r.n_tokens == len(r.ids) and list(r.ids) in by_id[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        place += r.n_tokens


def test_words_in_other_case_or_before_signs_are_encoded_once():
    from tokenizers import Tokenizer
    file = tokenizer_file("word_bpe_49k.json")
    t, words = Tokenizer.from_file(file), idfiles.WordIds(file)
    words.encode(["Word, word. WORD word"])
    assert len(words.known) == 4  # with the empty one
    latin = [chr(i) for i in range(256)]
    rng = random.Random(6)
    bits = [*latin, "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "e\u0301", "日", "क\u093c", "\u0958", "x.", "..."]
    texts = [f"a{c}{d}b" for c in latin for d in (" ", "'", "é", "")] + ["".join(rng.choices(bits, k=9)) for _ in range(5000)]
    for room in (idfiles.KEPT_WORDS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(idfiles, "KEPT_WORDS", room)
            ids, sizes = words.encode(texts)
        ends = np.cumsum(sizes)
        for x, a, b in zip(texts, (ends - sizes).tolist(), ends.tolist()):
            assert ids[a:b].tolist() == t.encode(x, add_special_tokens=False).ids + [2], x
        words.clear()


def test_no_documents(spark):
    path = shared_folder(spark, "ids")
    idfiles.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_file("word_bpe_49k.json"))
    assert idfiles.read_ids(spark, path).count() == 0


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(tokenizer_file("piece_bpe_32k.model"))


def all_segmentations(lattice, text):
    """Every way to cut the text into pieces, by trying them all."""
    read = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""

    def rest(i):
        if i == len(read):
            yield (), 0.0
        for j in range(i + 1, len(read) + 1):
            piece = lattice.ids.get(read[i:j])
            if piece is not None:
                for ids, w in rest(j):
                    yield (piece, *ids), w + lattice.weight[piece]
        if i < len(read) and read[i] not in lattice.ids:
            raw = read[i].encode()
            for ids, w in rest(i + 1):
                yield (*[lattice.bytes_at[b] for b in raw], *ids), w + lattice.byte_weight * len(raw)

    found = dict(rest(0))
    total = math.log(math.fsum(map(math.exp, found.values())))
    return {k: w - total for k, w in found.items()}


@pytest.mark.parametrize("text", ["then", "a, b", "x\ny", "日é."])
def test_samples_follow_the_lattice_without_replacement(lattice, text):
    exact = all_segmentations(lattice, text)
    n, k, total, first = 4000, 3, 0.0, {}
    for rows in pieces.sample(lattice, [text] * n, list(range(n)), k=k):
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == len(ids) == min(k, len(exact))
        assert all(abs(exact[i] - r[1]) < 1e-9 for i, r in zip(ids, rows))
        values = [r[2] for r in rows]
        assert values == sorted(values, reverse=True)
        total += math.fsum(math.exp(r[1] - r[3]) for r in rows)
        first[ids[0]] = first.get(ids[0], 0) + 1
    assert abs(total / n - 1) < 0.02  # inclusion scores weight a sample to the whole
    for ids, logp in exact.items():
        p = math.exp(logp)
        assert abs(first.get(ids, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_all_segmentations_of_a_short_text_come_out(lattice):
    exact = all_segmentations(lattice, "ab")
    [rows] = pieces.sample(lattice, ["ab"], [1], k=50)
    assert {tuple(r[0].tolist()) for r in rows} == set(exact) and all(r[3] == 0.0 for r in rows)


def test_units_and_room_do_not_change_samples(lattice, monkeypatch):
    text = "Some (odd) words, “quoted”...  and\n\tspaces ▁x 123abc😀 " * 3
    before = pieces.sample(lattice, [text, "b"], [7, 8])
    other = pieces.Lattice(tokenizer_file("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "KEPT_NODES", 0)
    pieces.sample(other, ["warm up words"], [1])
    after = pieces.sample(other, [text], [7])
    assert [r[0].tolist() for r in before[0]] == [r[0].tolist() for r in after[0]]


def test_tables_do_not_depend_on_the_units_beside(lattice):
    many = [" " + "".join(random.Random(i).choices("aeinrst", k=9)) for i in range(3000)]
    alone, beside = lattice.make([" restaurants"], 0), lattice.make([*many, " restaurants"], 0)
    for name in ("cum", "p", "logp", "piece"):
        assert alone[name].tolist() == beside[name][-len(alone[name]):].tolist(), name


def test_units_of_latin_texts_are_those_of_all_texts():
    rng = random.Random(8)
    chars = [*map(chr, range(256)), *" \n" * 30, *"abcdé_,.1²" * 10]
    for _ in range(20_000):
        text = " " + "".join(rng.choices(chars, k=12))
        assert pieces.UNIT_OF_LATIN.findall(text) == pieces.UNIT_BY_LETTERS.findall(text)


@pytest.mark.parametrize("pattern, by_letters", [(pieces.UNIT, False), (pieces.UNIT_BY_LETTERS, True)])
def test_texts_are_cut_into_the_units_of_the_patterns(lattice, monkeypatch, pattern, by_letters):
    monkeypatch.setattr(lattice, "letters_end_units", by_letters)
    rng = random.Random(9)
    chars = [*map(chr, range(256)), *" \n" * 30, *"abcdé_,.1²" * 10, *"日本▁😀\u0301ⅷ٣Ω"]
    texts = [None, "", " ", "\n", "a", "", *["".join(rng.choices(chars, k=rng.randrange(30))) for _ in range(5000)], ""]
    units, places, sizes = lattice.cut(texts)
    assert len(set(units)) == len(units)
    ends = np.cumsum(sizes)
    for text, size, end in zip(texts, sizes, ends):
        found = [units[p].decode("utf-32-le").replace(pieces.SPACE, " ") for p in places[end - size:end]]
        assert found == (pattern.findall(" " + text.replace(pieces.SPACE, " ")) if text else [])
    assert [len(x) for x in lattice.cut([None, ""])] == [0, 0, 2] and [len(x) for x in lattice.cut([])] == [0, 0, 0]


def test_samples_do_not_depend_on_the_texts_beside(lattice):
    rng = random.Random(10)
    words = ["restaurants", "the", "(odd)", "日é.", "\n", "12ab"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 300, 1500]))) for _ in range(40)]
    beside = pieces.sample(lattice, texts, list(range(40)))
    for key in range(40):
        [alone] = pieces.sample(lattice, [texts[key]], [key])
        assert [(r[0].tolist(), *r[1:]) for r in alone] == [(r[0].tolist(), *r[1:]) for r in beside[key]]


def test_random_numbers_are_drawn_for_all_texts_at_once_and_values_for_near_sets_only(lattice, monkeypatch):
    draw, values, calls, made = pieces.uniform, pieces._gumbels, [], []
    monkeypatch.setattr(pieces, "uniform", lambda keys: calls.append(1) or draw(keys))
    monkeypatch.setattr(pieces, "_gumbels", lambda u, *rest: made.append(len(u)) or values(u, *rest))
    texts = ["some restaurants and their reservations overlooking another " * 20] * 200
    pieces.sample(lattice, texts, list(range(200)))
    assert len(calls) < 100 and sum(made) < 600 * 32


def test_encode_on_tables(spark):
    rows = [(1, "Hello, world"), (1, "Hello, world"), (2, None), (3, ""), (None, "x" * 20000), (5, "▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("samples", F.lit("clash")).withColumn("sample", F.lit(1))
    out = pieces.encode(df, tokenizer_file("piece_bpe_32k.model"))
    assert out.columns == ["doc_id", "sample", "samples"]
    got = out.collect()
    assert got[0].samples == got[1].samples or len({str(r.samples) for r in got if r.doc_id == 1}) == 1
    by = {r.doc_id: r.samples for r in got}
    assert [list(s.ids) for s in by[2]] == [[]] and [list(s.ids) for s in by[3]] == [[]]
    assert len(by[None]) == 3 and all(s.round_trip for s in by[None]) and not by[5][0].round_trip
    assert pieces.encode(df.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_the_sentencepiece_query_returns_the_segmentations(spark, tmp_path):
    from tideledger.llm.queries import op6_sentencepiece
    docs = [(1, "Some plain words, and more of them."), (2, "x"), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op6_sentencepiece(spark, str(tmp_path)).selectExpr("*", "xxhash64(ids) as h").collect()
    assert {r.doc_id for r in rows if r.n_pieces} == {1, 2}
    assert all(len(r.ids) == r.n_pieces and r.h == r.ids_hash for r in rows)
    assert len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(rows)
