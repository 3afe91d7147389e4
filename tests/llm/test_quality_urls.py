import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideledger.llm import quality, urls

TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a b c\na b c\n\nx\nx", "the the the the the",
         "é\x0bü ñ\x0c$#", "w " * 3000, "a b c d " * 40, "- | - | -\n- | - | -", " ".join(f"w{i}" for i in range(60))]


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), len(lines))


def test_measures_equal_loops(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r[0]: tuple(r[1]) for r in df.select("doc_id", quality.measures(F.col("text"))).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(TEXTS)}


def test_plain_path_of_repeats_equals_the_fast_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t and len(t.split()) > 3], "doc_id long, text string")
    words = quality.words_of(F.col("text"))
    slow = quality.let(words, lambda w: quality.let(
        quality._repeats_by_text(w, F.sequence(F.lit(0), F.size(w) - 3)),
        lambda p: F.when(F.size(p) == 0, 0).otherwise(quality._covered(p))))
    for r in df.select(slow.alias("a"), quality.repeated_words(words).alias("b")).collect():
        assert r.a == r.b


@pytest.mark.parametrize("n,k,p", [(1, 0, 0.01), (500, 0, 0.01), (500, 3, 0.01), (20000, 150, 0.01), (300000, 2700, 0.01), (40, 1, 0.2)])
def test_binomial_tail_is_exact(spark, n, k, p):
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
                              + (n - i) * math.log1p(-p)) for i in range(k + 1)) if k < n * p else 1.0
    got = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-6)


def test_only_certified_cutoffs_reject(spark):
    good = [(i, "en", i % 200 == 0) for i in range(4000)]  # 0.5 % of the good have a score of 400
    rows = [("en", True, 400 if odd else 0) for _, _, odd in good] + [("en", False, 900)] * 300 + [("de", True, 0)] * 20 + [("de", False, 900)] * 20
    df = spark.createDataFrame(rows, "stratum string, good boolean, s long")
    found = {r.stratum: r.cutoff for r in quality.certified_cutoffs(df, {"s": [800, 500, 300]}, quality.Promise(risk=0.003)).collect()}
    assert found == {"en": 800}  # 300 breaks the promise, "de" has too few rows to certify anything
    assert quality.certified_cutoffs(df.limit(0), {"s": [800]}).count() == 0


def test_judge_returns_every_row_once_and_keeps_good(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS)] + [(5, TEXTS[13], "en")],
                                 "doc_id long, text string, lang string").withColumn("kept", F.lit("own"))
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 0)], "doc_id long, quality int")
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [5, 13]
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("example.com", "/en/a", "allow"), ("a-b.com", "/", "block"), ("com", "/en/a/b", "block"), ("top.org", "/\U0010ffff", "block"), ("top.org", "/\ud7ff", "block"),
         ("top.org", "/\U0010ffff/x", "allow")]
URLS = [None, "", "no scheme/x", "http://", "http://com", "http://com/", "http://EXAMPLE.com/en/x", "x://www.example.com/en/?q#f",
        "http://example.com/en/abc", "http://deep.www.example.com/en/abc", "http://notexample.com/en/abc", "http://a-b.com/x",
        "http://z.net/es/1", "http://z.net/fr", "http://com.net/es/", "http://x.com/en/a/b/c", "http://u:p@x.com:80/y", "http://.com/",
        "http://example.com?/en/", "a://b://c.com/", "http://example.com/en/abc",
        "http://example.com/en/\U0010ffffabc", "http://com/\U0010ffff\U0010ffff", "http://a.top.org/\U0010ffff/x/\U0010ffff",
        "http://top.org/\U0010ffff\U0010ffff", "http://top.org/\ud7ff\U0010ffff", "http://top.org/\ue000", "http://top.org/\U0010fffe"]


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_equal_a_loop_over_all_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(URLS)}
    bare = urls.judge_urls(pages, rules.limit(0)).collect()
    assert len(bare) == len(URLS) and {r.verdict for r in bare} == {"allow"}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
