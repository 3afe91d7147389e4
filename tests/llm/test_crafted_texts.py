import random
import time

import pytest

from tideledger.llm import render, secrets

SECRETS = {"doubling": "k = 'a'\n" + "k = k + k\n" * 30000, "growing": "a = 'b'\n" + "x = a + " * 40000, "chain": "x = " * 60000,
           "triple quotes": "x = '''\n" * 30000, "brackets": "x = (" * 60000}
PAGES = {"open tags": "<a " * 100000, "open quotes": "<a '" * 100000 + ">", "last quote": "<a 'x>' " * 60001 + '"',
         "unclosed": "<b>" * 60000 + "</i>" * 60000, "paragraphs": "<p>" * 60000, "tables": "<table>" + "<td>x" * 60000}


@pytest.mark.parametrize("name", SECRETS)
def test_secret_scan_grows_with_the_text_only(name):
    start = time.process_time()
    secrets.find(SECRETS[name])
    assert time.process_time() - start < 20


@pytest.mark.parametrize("name", PAGES)
def test_tree_grows_with_the_page_only(name):
    start = time.process_time()
    render.build(PAGES[name])
    assert time.process_time() - start < 20


def test_joined_values_have_a_limit_and_single_ones_have_none():
    secret = "Zx9Kq3Lw8Pd2Rt6V"
    assert [f[:3] for f in secrets.find(f"a = '{secret}'\napi_token = a + 'Q7'")] == [("literal", 5, 5 + len(secret)), ("literal", 40, 42)]
    long = "".join(f"{i:x}Gk" for i in range(20000))
    assert [f[1:3] for f in secrets.find(f"db_password_value = '{long}'") if f[0] == "literal"] == [(21, 21 + len(long))]
    pieces = " + ".join(f"'{secret}{i}'" for i in range(500))
    found = [f for f in secrets.find(f"api_token = {pieces}\nsecret_copy = api_token") if f[0] == "literal"]
    assert len(found) == secrets.MOST_PIECES


def test_no_part_of_a_joined_value_is_passed_over():
    secret = "Zx9Kq3Lw8Pd2Rt6V"
    text = f"api_token = {' + '.join(f"'{secret}{i}'" for i in range(500))}\nsecret_copy = api_token"
    # the first one lies in a span of the fixed patterns
    found = secrets.find(text, limited=False)
    assert [text[a:b] for _, a, b, *_ in found[1:]] == [f"{secret}{i}" for i in range(1, 500)] and found[0][0] == "assign"
    long = "".join(f"{i:x}Gk" for i in range(20000))
    text = f"a = 'Q7'\nb = a + '{long}'\nc = b + '{secret}'\ndb_password_value = c"
    assert [text[a:b] for kind, a, b, *_ in secrets.find(text, limited=False) if kind == "literal"] == ["Q7", long, secret]
    doubled = f"k = '{secret}'\n" + "k = k + k\n" * 5000 + "api_token = k + 'Q7'"
    assert len([f for f in secrets.find(doubled, limited=False) if f[0] == "literal"]) == 2
    for text in (f"db_pwd: Optional[{', '.join('A' * 40)}] = '{secret}'", f"db_pwd = {' ' * 100}\n  '{secret}'"):
        assert [text[a:b] for kind, a, b, *_ in secrets.find(text, limited=False) if kind == "literal"] == [secret]


@pytest.mark.parametrize("name", SECRETS)
def test_whole_values_grow_with_the_text_only(name):
    start = time.process_time()
    secrets.find(SECRETS[name] + "\napi_token = k + x\n" + "api_token = api_token + api_token\n" * 5000, limited=False)
    assert time.process_time() - start < 20


def test_summaries_weigh_like_the_whole_value():
    parts = ["Zx9Kq3Lw", "x", "your-", "yo", "ur_", "exam", "ple", " ", "a b", "\n", "<", "*", "tr", "ue", "", "é", "x" * 20, "\t", "Q7" * 9]
    rng = random.Random(3)
    for _ in range(5000):
        own = rng.choices(parts, k=rng.randrange(1, 7))
        whole = secrets.Summary(own[0])
        for part in own[1:]:
            whole.add(secrets.Summary(part))
        assert whole.weight() == secrets.value_weight("".join(own)), own


def test_broken_tags_keep_the_text():
    text = lambda page: "".join(c if isinstance(c, str) else text_of(c) for c in render.build(page).children)

    def text_of(node):
        return "".join(c if isinstance(c, str) else text_of(c) for c in node.children)

    assert text("a < b and c <d") == "a < b and c <d"
    assert text("<p>one</p> <a href=\"x>two</a> three") == "one two three"
    assert text("<p title=\"a>b\">one</p>") == "one"
