import re
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from tideledger.llm import interactions

COLUMNS = ["part", "filter_order", "step", *interactions.COUNTS]
LONG = " ".join(f"w{i}" for i in range(220))
DOCS = [(1, None, None), (2, "", "en"), (3, LONG, "en"), (4, LONG, "de"), (5, "A B C " * 100, "en"), (6, "a " * 250, None),
        (7, LONG + " #", "en"), (8, LONG + " #", "en"), (8, LONG + " #", "en"), (None, LONG, "en"), (None, None, "de"),
        (9, "\x0b\n " * 9, "de"), (10, "x " * 60000 + "É", "en")]
LABELS = [(3, 1, 0), (3, None, 1), (5, 0, 1), (7, 1, None), (8, 1, 1), (None, 1, 1), (99, 1, 1)]


def plain(docs, labels):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    rows = []
    for i, t, lang in docs:
        t, w = t or "", words(t or "")
        mask = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)),
                "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", mask, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {r[0] for r in rows}:
        mine, share, lines = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                share[f] += len(gone)
                lines.append([part, "".join(order), step, len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                              sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone),
                              sum(r[3] for r in gone), f])
        out += [(*x[:-1], share[x[-1]]) for x in lines]
    return sorted(out)


def tables(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns(
                {c: F.lit("own") for c in ("mask", "digest", "good", "first", "part")}),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("own")))


def test_every_order_equals_filtering_by_loops(spark):
    masks = interactions.failure_masks(*tables(spark, DOCS, LABELS))
    assert masks.count() == len(DOCS)
    got = interactions.audit_orders(masks, "ABCDE").select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == plain(DOCS, LABELS)


def test_empty_tables(spark):
    docs, labels = tables(spark, DOCS, LABELS)
    assert interactions.audit_orders(interactions.failure_masks(docs.limit(0), labels), "ABCDE").count() == 0
    got = interactions.audit_orders(interactions.failure_masks(docs, labels.limit(0)), "ABCDE").select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == plain(DOCS, [])


@pytest.mark.parametrize("n", range(1, 6))
def test_swapped_diagrams_equal_fresh_ones(n):
    cells = {m: (m % 3, m % 2, 0) for m in range(1 << n)}
    diagram, seen = interactions.CountDiagram(n, cells), set()
    for place in [None, *interactions.neighbour_swaps(n)]:
        if place is not None:
            diagram.swap(place)
        seen.add(tuple(diagram.order))
        passed = 0
        for j, removed, kept in diagram.steps():
            now = [m for m in cells if not m & passed]
            assert removed == tuple(sum(cells[m][i] for m in now if m >> j & 1) for i in range(3))
            assert kept == tuple(sum(cells[m][i] for m in now if not m >> j & 1) for i in range(3))
            passed |= 1 << j
    assert seen == set(permutations(range(n)))


def test_equal_nodes_are_shared():
    same = interactions.CountDiagram(5, {sum(b << j for j, b in enumerate(bits)): (1, 0, 0) for bits in product((0, 1), repeat=5)})
    assert [len(level) for level in same.levels] == [1] * 5


def test_number_of_filters_is_bounded(spark):
    with pytest.raises(ValueError):
        interactions.audit_orders(spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean"), "ABCDEFGH")
