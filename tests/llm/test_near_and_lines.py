import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideledger.llm import linechunks, simhash
from tideledger.llm.components import components

BASE = " ".join(f"word{i}" for i in range(400))


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A b\tc d É e", BASE, "x y " * 40000])
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def roots(fps, radius=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def planted(rng, n):
    out = []
    for _ in range(n):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            g = f
            for b in rng.sample(range(64), rng.randint(0, 6)):
                g ^= 1 << b
            out.append(g)
            f = g
    return sorted(set(out))


def test_every_link_is_found_and_none_is_false(spark):
    fps = planted(random.Random(3), 120)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    pairs = simhash.near_pairs(spark.createDataFrame(signed, "fp long"))
    got = [(a % (1 << 64), b % (1 << 64)) for a, b in pairs.collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in got)
    want = roots(fps)
    joined = {f: f for f in fps}
    for _ in fps:
        for a, b in got:
            joined[a] = joined[b] = min(joined[a], joined[b])
    groups = lambda m: sorted(sorted(f for f in fps if m[f] == r) for r in set(m.values()))
    assert groups(joined) == groups(want)


def test_splitting_a_full_group_loses_nothing(monkeypatch):
    fps = np.array(planted(random.Random(5), 40), dtype=np.uint64)
    free = np.full(len(fps), 2)
    whole = {tuple(sorted(p)) for a, b in simhash._links(fps, free, 64) for p in zip(a.tolist(), b.tolist()) if p[0] != p[1]}
    monkeypatch.setattr(simhash, "GROUP", 3000)
    parts = {tuple(sorted(p)) for a, b in simhash._links(fps, free, 64) for p in zip(a.tolist(), b.tolist()) if p[0] != p[1]}
    def closed(pairs):
        m = {f: f for f in fps.tolist()}
        for _ in m:
            for a, b in pairs:
                m[a] = m[b] = min(m[a], m[b])
        return m
    assert closed(whole) == closed(parts) and whole


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    near = BASE.replace("word7 ", "other ")
    rows = [(1, BASE), (2, near), (3, BASE), (4, None), (5, ""), (6, "quite something else"), (6, "quite something else"), (None, BASE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own"))
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (5, 4), (6, 6)}
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 4, 6, 6]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def plain_dedup(rows):
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines, spans = linechunks.chunk_lines(text)
        kept = []
        for k, (a, b) in enumerate(spans):
            chunk = "\n".join(lines[a:b])
            if linechunks.counts_as_chunk(lines[a:b]):
                if seen.setdefault(chunk, (i, k)) != (i, k):
                    continue
            kept += lines[a:b]
        out.append((i, None if text is None else "\n".join(kept)))
    return out


def passages(seed=7):
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    shared = [line(9) for _ in range(40)]
    long_one = line(70)
    rows = []
    for i in range(12):
        own = [line(rng.randint(3, 12)) for _ in range(rng.randint(0, 9))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + (shared if i % 3 else [long_one]) + own[at:])))
    return rows + [(20, None), (21, ""), (22, "\n\n\n"), (23, rows[1][1]), (24, "short line\nanother"), (25, "short line\nother")], shared, long_one


def test_repeated_chunks_go_and_the_first_stays(spark):
    rows, shared, long_one = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed_lines", F.lit("clash"))
    out = linechunks.dedup_lines(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert sorted((i, r.text) for i, r in got.items()) == sorted(plain_dedup(rows))
    assert sum((r.text or "").count(long_one) for r in got.values()) == 1
    # borders inside the passage are the same wherever it stands: its inner chunks are left once
    _, spans = linechunks.chunk_lines("\n".join(shared))
    inner = ["\n".join(shared[a:b]) for a, b in spans[1:-1] if linechunks.counts_as_chunk(shared[a:b])]
    assert inner and all(sum((r.text or "").count(x) for r in got.values()) == 1 for x in inner)
    assert all(r.removed_lines == len((t or "").split("\n")) - len(r.text.split("\n")) or r.removed_lines == len(t.split("\n"))
               for (i, t) in rows if t for r in [got[i]])
    kept = linechunks.keep_first(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long"))
    assert kept.columns == ["doc_id", "text", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)
    assert linechunks.dedup_lines(docs.limit(0)).count() == 0


def test_chunks_that_share_a_hash_but_differ_stay(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a one\nb two"), (2, "c three\nd four")], "doc_id long, text string")
    rows = linechunks.chunk_rows(docs)
    same = rows.withColumn("h", F.lit(b"x"))
    marked = linechunks._marked(docs, "text", linechunks._marks(same))
    assert marked.where("size(__same) > 0").count() == 2
    without = linechunks._marks(same, spark.createDataFrame([(b"x",)], "h binary"))
    assert without.count() == 0


def test_equal_rows_are_one_document(spark):
    text = next(t for t in (f"a b {i}\nc d" for i in range(99)) if linechunks.candidates(t))
    docs = spark.createDataFrame([(1, text)] * 2 + [(2, text)], "doc_id long, text string")
    assert sorted(r.text for r in linechunks.dedup_lines(docs).collect()) == ["", text, text]


def passage_docs(counts, seed=4, repeats=4, per_line=25):
    """Passages of so many short lines, each in `repeats` documents among other lines; passages by line count."""
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n))
    shared = [[line(-(-50 // n) if n < 3 else per_line) for _ in range(n)] for n in counts]
    rows = []
    for passage in shared:
        for _ in range(repeats):
            before, after = ([line(rng.randint(3, 12)) for _ in range(rng.randint(0, 4))] for _ in range(2))
            rows.append((len(rows), "\n".join(before + passage + after)))
    return rows, shared


def test_whole_passages_of_short_lines_go_and_the_first_stays(spark):
    rows, shared = passage_docs([2, 2, 3, 3, 4, 6, 10, 20])
    rows += [(i + 100, t) for i, t in passages()[0]]
    # a blank line inside, a repeat inside one text, two equal texts, and a passage that is too short
    gap, short = ["a b " * 14 + "gap", "", "c d " * 14 + "gap"], ["seven short words stand on this line", "and five on that one"]
    rows += [(200, "\n".join(["x1", *gap, "x2", *gap, "x3"])), (201, "\n".join(["y1", *gap]))]
    rows += [(210, "z " * 30 + "\n" + "y " * 30), (211, "z " * 30 + "\n" + "y " * 30)]
    rows += [(220 + i, "\n".join([f"own {i}", *short, f"own {i} too"])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in linechunks.dedup_lines(docs, passages=True).collect()}
    got = {i: r.text for i, r in out.items()}
    lines = [x for t in got.values() for x in (t or "").split("\n")]
    whole = [*shared, passages()[1]]
    assert all(lines.count(x) == 1 for passage in whole for x in passage)
    for passage in shared:  # the first of them is whole
        assert "\n".join(passage) in got[min(i for i, t in rows if t and "\n".join(passage) in t)]
    assert got[200] == "\n".join(["x1", *gap, "x2", "x3"]) and got[201] == "y1" and got[211] == ""
    assert all(short[0] in got[i] or out[i].removed_chunks for i in (220, 221, 222))
    # nothing is lost for good
    assert {x for _, t in rows for x in (t or "").split("\n") if x.strip()} == {x for x in lines if x.strip()}
    assert {i: len((t or "").split("\n")) - out[i].removed_lines for i, t in rows if t and got[i]} == {
        i: len(got[i].split("\n")) for i, t in rows if t and got[i]}


def own_chunks(text):
    """Chunks in plain integers, from the description alone: (first line, after the last, counts)."""
    lines, spans, first = text.split("\n"), [], 0
    hashes = [xxhash.xxh64_intdigest(x.encode()) for x in lines]
    long = [len(x.split()) >= 50 for x in lines]
    for i in range(len(lines)):
        total = (hashes[i] + (hashes[i - 1] * linechunks.STEP if i else 0)) % 2 ** 64
        mixed = (total ^ (total >> 29)) * linechunks.STEP % 2 ** 64
        if (mixed >> 33) % 3 == 0 or i + 1 == len(lines) or long[i] or long[i + 1]:
            words = sum(bool(x.strip()) for x in lines[first:i + 1])
            spans.append((first, i + 1, words >= 2 or (first == i and long[i])))
            first = i + 1
    return spans


def brute_passages(rows):
    """Every run of lines with 50 words that stands whole in an earlier place goes, and every repeated chunk."""
    runs, chunks, out = set(), set(), {}
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 2, len(lines) + 1):
                if lines[a].strip() and lines[b - 1].strip() and sum(len(x.split()) for x in lines[a:b]) >= 50:
                    if tuple(lines[a:b]) in runs:
                        gone.update(range(a, b))
                    runs.add(tuple(lines[a:b]))
        for a, b, counts in own_chunks(text):
            if counts:
                if tuple(lines[a:b]) in chunks:
                    gone.update(range(a, b))
                chunks.add(tuple(lines[a:b]))
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def test_passages_equal_brute_force(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(22)) for x in "abc")
    rows = [(0, f"{a}\n{b}\n."), (1, f".\n{b}\n{c}"), (2, f"{a}\n{b}\n{c}")]
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 3, 9, 20, 30, 55]))) for _ in range(14)]
    for i in range(3, 90):
        at, size = rng.randrange(len(pool)), rng.randint(1, 6)
        rows.append((i, "\n".join([f"own {i}", *pool[at:at + size], *rng.sample(pool, rng.randint(0, 3)), f"own {i} too"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linechunks.dedup_lines(docs, passages=True).collect()}
    assert got == brute_passages(rows)
    assert got[2] == f"{a}\n{b}\n{c}"  # only its pairs of lines came before


def test_the_near_duplicate_stage_takes_five_words(spark):
    import corpus_pipeline
    rng = random.Random(5)
    bits = lambda a, b, size: (simhash.fingerprint(a, size) ^ simhash.fingerprint(b, size)).bit_count()
    pairs = []
    while {near for _, _, near in pairs} != {True, False}:  # pairs that four and five words judge differently
        words = [f"w{rng.randrange(9999)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(200), 2):
            other[at] = f"x{rng.randrange(9999)}"
        a, b = " ".join(words), " ".join(other)
        if (bits(a, b, 4) <= 4) != (bits(a, b, 5) <= 4):
            pairs.append((a, b, bits(a, b, 5) <= 4))
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p[:2])], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, p in enumerate(pairs) if not p[2]}
