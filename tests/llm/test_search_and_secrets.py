import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideledger.llm import decontam, render, secrets

VOCAB = [f"term{i}" for i in range(300)] + ["the", "of", "and", "to"] * 40


def items_and_docs(seed=11):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    items = [(i, f"{text(rng.randint(6, 70)).capitalize()}. {text(rng.randint(3, 9)).capitalize()}.") for i in range(24)]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 300))
        if i % 4 == 0:
            words = t.split(" ")
            at = rng.randint(0, len(words))
            copy = items[rng.randrange(24)][1]
            t = " ".join(words[:at] + [copy.upper() if i % 8 else copy] + words[at:])
        docs.append((i, t))
    return items + [(100, None), (None, "x y"), (101, "")], docs + [(200, None), (201, "")]


def plain_scores(items, docs):
    """Every window against every item, without an index."""
    items = [(i, decontam.words(t)) for i, t in items if i is not None and t and decontam.words(t)]
    n, avg = len(items), sum(len(w) for _, w in items) / len(items)
    df = Counter(w for _, ws in items for w in set(ws))
    weights = {}
    for i, ws in items:
        tf = Counter(ws)
        raw = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for w, c in tf.items()}
        weights[i] = {w: x / sum(raw.values()) for w, x in raw.items()}
    best = {}
    for d, t in docs:
        tokens = decontam.words(t)
        for i, ws in items:
            span = decontam.SPAN << max(0, math.ceil(math.log2(len(ws) / decontam.SPAN)))
            for at in range(-span, len(tokens), span):
                window = set(tokens[max(0, at):at + 2 * span])
                score = sum(x for w, x in weights[i].items() if w in window)
                if score >= decontam.THRESHOLD:
                    best.setdefault((d, i), []).append((score, max(0, at), at + 2 * span, span))
    return best


def test_search_equals_scoring_every_window(spark):
    items, docs = items_and_docs()
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.score for r in found}
    texts, tokens = dict(items), {d: decontam.words(t) for d, t in docs}
    want = {}
    for (d, i), windows in plain_scores(items, docs).items():
        question, answer = decontam.split_item(texts[i])
        proof = (decontam.shingles(decontam.words(texts[i])), decontam.shingles(question), decontam.shingles(answer), set(answer))
        ok = [s for s, lo, hi, span in windows if decontam._verified(proof, tokens[d][max(0, lo - span):hi + span])]
        if ok:
            want[d, i] = max(ok)
    assert got.keys() == want.keys() and len(want) >= 12
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # one index per few items finds the same
    parts = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string"), index_bytes=2000).collect()
    assert {(r.doc_id, r.item_id) for r in parts} == got.keys()


def test_words_with_combining_marks_are_found(spark):
    copies = ["भारत की राजधानी नई दिल्ली है और यह यमुना नदी के किनारे बसी हुई है। उत्तर: नई दिल्ली।",
              "cafe\u0301 re\u0301sume\u0301 de\u0301ja\u0300 e\u0301te\u0301 fe\u0302te no\u0308el pre\u0301s cle\u0301. Re\u0301ponse: de\u0301ja\u0300 e\u0301te\u0301.",
              "İstanbul İzmir İznik İnegöl İskenderun İncirlik İpsala İslahiye. İstanbul İzmir.", "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอน"]
    items = spark.createDataFrame(list(enumerate(copies)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"some words before {t} and after") for i, t in enumerate(copies)] + [(9, "plain")],
                                 "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, items).collect()}
    assert found.keys() == {(i, i) for i in range(4)} and all(abs(x - 1) < 1e-9 for x in found.values())
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [9]
    got = {(r.item_id, r.word) for r in decontam.postings(items).collect()}
    assert got == {(i, w) for i, t in enumerate(copies) for w in decontam.words(t)}


@pytest.mark.parametrize("kind", ["int", "long", "string", "short"])
def test_items_are_kept_apart_by_id_and_text(spark, kind):
    texts = [" ".join(f"{c}{i}" for i in range(30)) + f". Answer {c}{c}." for c in "abcd"]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (1, texts[1]), (2, None), (3, " ")],
                                  "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)] + [(9, texts[0] + " " + texts[1])],
                                 "doc_id long, text string")
    got = decontam.leaks(docs, items)
    assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
    found = [(r.doc_id, None if r.item_id is None else int(r.item_id)) for r in got.collect()]
    assert sorted(found, key=str) == sorted([(0, 1), (1, 1), (2, None), (3, None), (9, 1)], key=str)
    assert decontam.clean(docs, items).count() == 0


def test_clean_drops_what_leaks_and_nothing_else(spark):
    items, docs = items_and_docs()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {r.doc_id for r in decontam.leaks(frame, bench).collect()}
    out = decontam.clean(frame, bench)
    assert out.columns == frame.columns
    assert {r.doc_id for r in out.collect()} == {i for i, _ in docs} - bad
    assert decontam.clean(frame, bench.limit(0)).count() == len(docs)
    assert decontam.leaks(frame.limit(0), bench).count() == 0


def test_wand_walks_to_every_item_above_the_threshold():
    rng = random.Random(2)
    items = [(i, " ".join(rng.sample(VOCAB[:40], 12))) for i in range(30)]
    weights = [(i, w, 1 / 12) for i, t in items for w in set(t.split())]
    index = decontam.build_indexes(items, weights)[0][0]
    for _ in range(50):
        query = set(rng.sample(VOCAB[:40], 20))
        terms = [index.terms[w] for w in query if w in index.terms]
        got = {p for b in range(8) for p, _ in decontam.wand(index, terms, b, 0.5)}
        assert got == {p for p, i in enumerate(index.items) if len(query & set(items[i][1].split())) / 12 >= 0.5 - 1e-9}


SECRET_TEXTS = [None, "", "plain words: nothing = here", 'password = "abcdefghijkl"', "API_KEY:abcdef123456 token=short", "x AKIA" + "A" * 14 + " y",
                "AKIA" + "A" * 13, "0123456789abcdef" * 3, "deadbeef", 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" z',
                "password: password: password: aaaaaaaaaaaa", "PASSWD='secret=abcdefghijklmnop'"]


def plain_base(text):
    text = text or ""
    patterns = [("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
                ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(patterns)
             for m in re.finditer(p, text) if len(m[g]) >= n]
    return sorted(found)


def test_base_spans_and_digest(spark):
    docs = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id long, text string").withColumn("secrets", F.lit(1))
    for r in secrets.digest(secrets.scan(docs)).collect():
        base = plain_base(SECRET_TEXTS[r.doc_id])
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in base) for k in ("assign", "access", "hex"))
    assert secrets.scan(docs.limit(0)).count() == 0


def literals(text):
    return [text[a:b] for kind, a, b, _, _ in secrets.find(text) if kind == "literal"]


def test_assignments_reach_sensitive_names():
    assert literals('base = "Zx9kQ2mm"\nfull = base + "vT81mLp0"\ndb_pwd = full') == ["Zx9kQ2mm", "vT81mLp0"]
    assert literals('{"clientCredential": "a8F2kd91LqPz", "name": "a8F2kd91LqPz"}') == ["a8F2kd91LqPz"]
    assert literals("auth_key: Gh7Kd82mZq01\nprivateKey => 'Kd82mZq01Gh7'") == ["Gh7Kd82mZq01", "Kd82mZq01Gh7"]
    assert literals('auth_key = "your-key-here"\nprivate_key = "${VAULT}"\nauthor = "Gh7Kd82mZq01"\nthe auth key: see below') == []


def test_other_forms_of_assignment():
    a, b = "Gh7Kd82mZq01", "vT81mLp0xQ"
    for text in (f'config["pass_key"] = "{a}"', f"os.environ['AUTH_KEY']='{a}'", f'x["db"]["pwd"] = "{a}"',
                 f'db_pwd: str = "{a}"', f'const authKey: string = "{a}";', f'pwd: Optional[str] = "{a}"', f'let pwd: &str="{a}";',
                 f'pwd = other = "{a}"', f'other = pwd = "{a}"', f'self.x = cfg["pwd"] = "{a}"', f'other = x = "{a}"\ndb_pwd = x',
                 f'cfg["x"] = "{a}"\nauth_key = x', f'{{"pwd":\n  "{a}"}}', f"pwd:\n  {a}\nname: b", f'pwd = \\\n "{a}"', f'pwd = """{a}"""', f'x = (pwd = "{a}")', f'x = ["pwd": "{a}"]',
                 f"pwd = '''\n{a}\n'''\nx = 1"):
        assert [x.strip() for x in literals(text)] == [a], text
    for text in (f'pwd = "{a}" +\n  "{b}"', f'pwd = "{a}"\n  + "{b}"', f'pwd = (\n "{a}"\n "{b}"\n)'):
        assert literals(text) == [a, b], text
    assert literals(f"auth:\n  name: {a}") == [] and literals(f'pwd = ""\nname = "{a}"') == []
    assert literals(f'{{"pwd": "",\n "name": "{a}"}}') == [] and literals("auth_key: abc=Gh7Kd82mZq01") == ["abc=Gh7Kd82mZq01"]
    for text in ('a = """x\n' * 20_000, "a = (\n" * 50_000, "a:\n" * 50_000, "a = 'b' +\n" * 50_000, "a = " * 50_000):
        assert secrets.find(text) == []


def test_a_very_long_text_ends():
    assert secrets.find("a=b " * 200_000 + "é" * 10) == []


def test_layout():
    page = ("<head><title>no</title></head><p>one<p>two <b>bold</b><br>three<ul><li>x<ul><li>y</ul><li>z</ul><ol start=3><li>q<li>r</ol>"
            "<table><caption>cap</caption><tr><th>name<th>n<tr><td>long cell<td>1<td hidden>no</table><pre> k\n  l</pre>"
            "<div style='display: none'>no</div><script>no</script>x &amp; y<!-- no --></i>")
    assert render.render(page).split("\n") == [
        "one", "", "two bold", "three", "", "- x", "  - y", "- z", "", "3. q", "4. r", "", "cap", "name      | n", "long cell | 1", "", " k",
        "  l", "", "x & y"]


def test_odd_pages(spark):
    pages = ["<", "<a", "</", "<p", "a<b", "<table><td>x", "<li>x", "<" * 500, "<div>" * 3000 + "deep" + "</div>" * 3000,
             "<td>" * 300 + "cell", "<!-- open", "<script>x", "&lt;b&gt;", "<p hidden>a</p>b", None, ""]
    df = spark.createDataFrame([(i, p, "own") for i, p in enumerate(pages)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in render.visible_text(df).collect()}
    assert len(got) == len(pages) and got[14] == got[15] == "" and got[12] == "<b>" and got[13] == "b" and got[8] == "deep" and got[5] == "x"
    assert render.visible_text(df.limit(0)).count() == 0


def test_a_head_ends_without_its_end_tag():
    assert render.render("<html><head><title>T</title><p>text<p>more") == "text\n\nmore"
    assert render.render("<head><meta charset=x><link href=y><style>a</style>\n <script>b</script>\nloose text<div>more</div>") == "loose text\nmore"
    assert render.render("<head><template><p>no</template><noscript>no</noscript><head><body>yes") == "yes"
    assert render.render("<head><title>T</title></head><body>as before") == "as before"


def test_a_caption_after_the_rows_is_kept():
    assert render.render("<table><tr><td>a<td>b<caption>cap</caption></table>x").split("\n") == ["cap", "a | b", "", "x"]
    assert render.render("<table><tbody><tr><td>a</td></tr><caption>cap<tr><td>b</table>").split("\n") == ["cap", "a", "b"]


def test_no_visible_word_is_lost():
    rng = random.Random(9)
    tags = ["p", "div", "b", "ul", "li", "table", "tr", "td", "pre", "h1", "ol", "dl", "dd", "section", "tbody"]
    for _ in range(300):
        words, parts = [], []
        for _ in range(rng.randint(1, 40)):
            parts.append(f"<{'/' * (rng.random() < .4)}{rng.choice(tags)}>")
            if rng.random() < .6:
                words.append(f"w{rng.randrange(10 ** 9)}")
                parts.append(words[-1])
        assert sorted(re.findall(r"w\d+", render.render("".join(parts)))) == sorted(words)
