"""Secrets in texts: fixed patterns, and literals that are assigned to names of secrets.

Beside the patterns, source and configuration syntax is lexed into names, literals and operators.
`name = literal`, `"name": literal`, `name: bare value`, `name => literal` and the like become
name-literal pairs, also where the name is a subscript, has a type or is one of a chain, and where the value
stands on lines after; literals joined by `+` belong to one value, and a name that was assigned earlier in
the text stands for its value, so a secret reaches the sensitive name that it is handed to. A pair is
scored by how sensitive the words of its name are and how random its value looks.

Joined values hold their parts instead of their characters, and what the score needs of a value follows from
that of its parts. So the work grows with the text, however long its values are, and no part is passed over.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, each with the group that is measured and its least length.
BASE = [
    ("assign", re.compile(
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
KINDS = {kind: i for i, kind in enumerate([*(b[0] for b in BASE), "literal"])}

#: Words of a name and how sensitive they are.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "credential": 3, "credentials": 3,
             "token": 3, "apikey": 3, "private": 2, "auth": 2, "bearer": 2, "signature": 2, "salt": 2, "access": 1,
             "key": 2, "pass": 2, "pin": 1, "session": 1, "client": 1}
#: Least sensitivity of a name, least length of a value and least score of a pair.
MIN_NAME, MIN_VALUE, MIN_SCORE = 2, 8, 5.0
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|(?:your|my|some|the)[-_ ].*|.*(?:example|changeme|placeholder|redacted|dummy).*|"
                         r"true|false|none|null|nil|undefined|[<$%{\[(].*)$")

TOKEN = re.compile(r"""
    (?P<text>"{3}(?:[^\\]|\\.)*?"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*'|`(?:[^`\\\n]|\\[^\n])*`)
  | (?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
  | (?P<set>:=|=>|={1}(?!=)|:(?!//))
  | (?P<join>\+|\.\.)
  | (?P<bare>[^\s"'`=:+,;()\[\]{}<>|&]+)
  | (?P<end>[\n,;)\]}])
  | (?P<other>\S)
""", re.X | re.S)
TRIPLE = re.compile(r"""["]{3}|'{3}""")
WHITE = re.compile(r"\s")
#: A line whose value or next literal is on the line after; a line that goes on with a literal.
PENDING = re.compile(r"(?:[=:+(\[\\]|=>|\.\.)\Z")
GOES_ON = re.compile(r"""[\x20\t]*\+[\x20\t]*["'`]|[\x20\t]*["'`]""")
#: A line that is a key of its own, or an item of a list.
NESTED = re.compile(r"""[\x20\t]*(?:-[\x20\t]|["']?[A-Za-z_$][\w$.-]*["']?[\x20\t]*(?::(?!//)|=(?!=)))""")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_weight(name: str) -> int:
    """Sensitivity of a name by its words; `api` beside `key` counts as apikey."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    if any(a == "api" and b == "key" for a, b in zip(words, words[1:])):
        words.append("apikey")
    return sum(sorted((SENSITIVE.get(w, 0) for w in set(words)), reverse=True)[:2])


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


#: For `find` with `limited` only (`scan` never sets it): most characters and literals of a joined value; the rest
#: of it is passed over, and names of such values stand for nothing later. A single literal has no limit.
MOST_JOINED, MOST_PIECES = 16_384, 64
#: Joined values beyond this many bits of length count their characters in steps of a power of two.
COUNT_BITS = 256


def value_weight(value: str) -> float:
    """How much a value looks like a secret; negative for placeholders and plain words."""
    if len(value) < MIN_VALUE or PLACEHOLDER.match(value) or " " in value.strip():
        return -math.inf
    return _looks(value, entropy(value), len(value) >= 20)


def _looks(chars: str, bits: float, long: bool) -> float:
    kinds = sum(bool(re.search(p, chars)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return bits - 2.0 + (kinds - 1) + long


class Summary:
    """What `value_weight` needs of a value; that of joined values follows from their summaries.

    Characters are counted in order of their first place. Counts are exact up to COUNT_BITS bits; beyond, they are cut
    to multiples of 2 ** shift, which moves the entropy by less than a double's own rounding.
    """

    EDGE = 16
    WORD = re.compile(r"(?i)example|changeme|placeholder|redacted|dummy")
    START = re.compile(r"(?i)(?:your|my|some|the)[-_ ]|[<$%{\[(]")

    def __init__(self, value: str) -> None:
        self.counts, self.shift, self.total = dict(Counter(value)), 0, len(value)
        self.head, self.tail = value[:self.EDGE], value[-self.EDGE:]
        self.word, self.lines = bool(self.WORD.search(value)), min(value.count("\n"), 2)
        # a blank inside, and before and after, the characters that are no white space
        bare = value.strip()
        self.empty, self.inner = not bare, " " in bare
        self.before = " " in value[:len(value) - len(value.lstrip())]
        self.after = " " in value[len(value.rstrip()):]

    def add(self, other: Summary) -> None:
        """Puts the other's value behind this one."""
        shift = max(self.shift, other.shift)
        more = other.shift - shift
        if self.shift < shift:
            self._cut(shift - self.shift)
        for c, n in other.counts.items():
            self.counts[c] = self.counts.get(c, 0) + (n >> -more)
        self.total += other.total >> -more
        if self.total.bit_length() > COUNT_BITS:
            self._cut(COUNT_BITS // 2)
        self.word = self.word or other.word or bool(self.WORD.search(self.tail + other.head))
        self.head, self.tail = (self.head + other.head)[:self.EDGE], (self.tail + other.tail)[-self.EDGE:]
        self.lines = min(self.lines + other.lines, 2)
        if self.empty or other.empty:
            self.inner = self.inner or other.inner
            self.before, self.after = (self.before or self.empty and other.before,
                                       other.after or other.empty and self.after)
        else:
            self.inner = self.inner or other.inner or self.after or other.before
            self.after = other.after
        self.empty = self.empty and other.empty

    def _cut(self, bits: int) -> None:
        self.counts = {c: n >> bits for c, n in self.counts.items()}
        self.total >>= bits
        self.shift += bits

    def copy(self) -> Summary:
        made = Summary.__new__(Summary)
        made.__dict__.update(self.__dict__)
        made.counts = dict(self.counts)
        return made

    def _placeholder(self) -> bool:
        if not self.shift and self.total <= self.EDGE:
            return bool(PLACEHOLDER.match(self.head))
        if self.lines > self.tail.endswith("\n"):
            return False
        chars = set(self.counts) - {"\n"}
        return self.word or bool(self.START.match(self.head)) or chars <= {"x", "X"} or chars in ({"*"}, {"."})

    def weight(self) -> float:
        """`value_weight` of the value."""
        if not self.shift and self.total < MIN_VALUE or self._placeholder() or self.inner:
            return -math.inf
        shares = [n / self.total for n in self.counts.values() if n]
        return _looks("".join(self.counts), -sum(p * math.log2(p) for p in shares), self.shift > 0 or self.total >= 20)


class Value:
    """A literal with its span, or several values joined; `number` grows from parts to what is joined from them."""

    __slots__ = ("number", "text", "span", "parts", "blank", "size", "pieces")

    def __init__(self, number: int, text: str, span: tuple[int, int]) -> None:
        self.number, self.text, self.span, self.parts = number, text, span, ()
        self.blank, self.size, self.pieces = WHITE.search(text) is not None, len(text), 1

    @classmethod
    def joined(cls, number: int, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        made = cls.__new__(cls)
        made.number, made.text, made.span, made.parts = number, None, None, tuple(parts)
        made.blank = any(p.blank for p in parts)
        # no more than the limits need
        made.size = min(sum(p.size for p in parts), MOST_JOINED + 1)
        made.pieces = min(sum(p.pieces for p in parts), MOST_PIECES + 1)
        return made


def best_names(told: list[tuple[str, float, Value]]) -> dict[tuple[int, int], tuple[str, float]]:
    """span: (name, score) of each literal whose values, handed to the names told with their weights, score enough.

    Each value is summed up once, parts first, and kept no longer than another needs it; then the best name, the
    first one of equal score, goes from each value to its parts.
    """
    found: dict[int, Value] = {}
    stack = [value for *_, value in told]
    while stack:
        value = stack.pop()
        if value.number not in found:
            found[value.number] = value
            stack += value.parts
    order = [found[k] for k in sorted(found)]
    needed = Counter(p.number for v in order for p in v.parts)
    wanted = {value.number for *_, value in told}
    weights: dict[int, float] = {}
    sums: dict[int, Summary] = {}
    for value in order:
        if value.parts:
            first, *rest = value.parts
            own = sums[first.number].copy()
            for p in rest:
                own.add(sums[p.number])
            for p in value.parts:
                needed[p.number] -= 1
                if not needed[p.number]:
                    del sums[p.number]
            if value.number in wanted:
                weights[value.number] = own.weight()
        else:
            own = Summary(value.text) if needed[value.number] else None
            if value.number in wanted:
                weights[value.number] = value_weight(value.text)
        if needed[value.number]:
            sums[value.number] = own
    best: dict[int, tuple[float, int]] = {}
    for i, (_, weight, value) in enumerate(told):
        score = weight + weights[value.number]
        if score >= MIN_SCORE:
            best[value.number] = max(best.get(value.number, (score, -i)), (score, -i))
    literals = {}
    for value in reversed(order):
        if value.number in best:
            own_best = best[value.number]
            for p in value.parts:
                best[p.number] = max(best.get(p.number, own_best), own_best)
            if value.span and value.span[1] > value.span[0]:
                literals[value.span] = (told[-own_best[1]][0], own_best[0])
    return literals


def pairs(text: str, limited: bool = False) -> Iterator[tuple[str, Value]]:
    """(name, value) of every assignment, with earlier names put in.

    Only runs of lines that can assign are lexed. A line goes on in the next one where a value, a joined
    literal or a line in brackets is still to come, or a triple quote is open.
    """
    known: dict[str, Value] = {}
    numbers = itertools.count()
    start, n = 0, len(text)
    never: set[str] = set()
    while start <= n:
        end = _line_end(text, start)
        if "=" in text[start:end] or ":" in text[start:end]:
            end = _run_end(text, start, end, never)
            yield from _run_pairs(text, start, end, known, numbers, limited)
        start = end + 1


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _run_end(text: str, start: int, end: int, never: set[str]) -> int:
    """End of the last line that the value begun on this line may reach; `never`: quotes not found again."""
    at = start
    while True:
        while (m := TRIPLE.search(text, at, end)) and m.group() not in never:
            shut = text.find(m.group(), m.end())
            if shut < 0:
                never.add(m.group())
                break
            at = shut + 3
            end = max(end, _line_end(text, at))
        if end >= len(text):
            return end
        after = _line_end(text, end + 1)
        line = text[end + 1:after]
        last = at + len(text[at:end].rstrip(" \t\r"))
        if PENDING.search(text, max(start, last - 2), last):
            # a nested key begins a run of its own
            if not line.strip() or NESTED.match(line):
                return end
        elif not GOES_ON.match(line) or NESTED.match(line) or text[max(start, end - 1):end] not in ('"', "'", "`"):
            return end
        at, end = end + 1, after


def _typed(tokens: list, i: int) -> int:
    """Place of the = after a type that starts at i, or -1: blank before it or a literal after it, brackets shut."""
    depth = 0
    for j in range(i, len(tokens) - 1):
        kind, word, a, _ = tokens[j]
        if kind == "set":
            if word != "=" or depth or j == i:
                return -1
            return j if a > tokens[j - 1][3] or tokens[j + 1][0] == "text" else -1
        if kind == "text" or word == "\n" or kind == "end" and not depth:
            return -1
        depth += (word in ("[", "(", "<")) - (word in ("]", ")", ">"))
        if depth < 0:
            return -1
    return -1


def _unquoted(word: str) -> tuple[str, int]:
    """A literal's inside and the length of its quotes."""
    width = 3 if len(word) >= 6 and word[:3] in ('"""', "'''") else 1
    return word[width:-width], width


def _run_pairs(text: str, start: int, end: int, known: dict[str, Value], numbers: Iterator[int],
               limited: bool) -> Iterator[tuple[str, Value]]:
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]

    def target(i: int) -> int:
        """Place after the set token if a name starts at i, or 0."""
        if i + 1 < len(tokens) and tokens[i][0] in ("name", "text"):
            shut = tokens[i][0] == "text" and tokens[i + 1][1] == "]"
            if i + 1 + shut < len(tokens) and tokens[i + 1 + shut][0] == "set":
                return i + 2 + shut
        return 0

    i = 0
    while i + 2 < len(tokens):
        at = target(i)
        if not at:
            i += 1
            continue
        names = []
        while at:
            names.append(_unquoted(tokens[i][1])[0] if tokens[i][0] == "text" else tokens[i][1])
            i = at
            if tokens[at - 1][1] == ":" and (typed := _typed(tokens, at)) > 0:
                names += [tokens[typed - 1][1]] if tokens[typed - 1][0] == "name" else []
                i = typed + 1
            # the next name of a chain: set apart by a blank, or the literal follows; subscripts start with their base
            k = i
            if k + 3 < len(tokens) and tokens[k][0] == "name" and tokens[k + 1][1] == "[" and tokens[k + 2][0] == "text":
                k += 2
            at = target(k)
            if at and not (tokens[at - 1][1] in ("=", ":=") and (
                    tokens[at - 1][2] > tokens[at - 2][3] or at < len(tokens) and tokens[at][0] == "text")):
                at = 0
            i = k if at else i
        parts, size, pieces, more, exact, whole, depth = [], 0, 0, True, True, True, 0
        while more and i < len(tokens):
            kind, word, a, b = tokens[i]
            if word == "\n" or word in ("(", "[", "\\") and not parts:
                depth += word in ("(", "[")
                i += 1
                if target(i):
                    break  # a pair of its own
                continue
            if kind == "text":
                inside, width = _unquoted(word)
                part = Value(next(numbers), inside, (a + width, b - width))
            elif kind == "name" and word in known:
                part = known[word]
            elif kind in ("name", "bare"):
                # a bare value goes on over what is not blank
                j = i
                while j + 1 < len(tokens) and tokens[j + 1][2] == tokens[j][3] and tokens[j + 1][0] in (
                        "name", "bare", "join", "set", "other"):
                    j += 1
                i, b = j, tokens[j][3]
                part = Value(next(numbers), text[a:b], (a, b))
                exact = False
            else:
                break
            if limited and parts and (size + part.size > MOST_JOINED or pieces + part.pieces > MOST_PIECES):
                exact = whole = False  # what comes after the limit is read, but no part of the value
            elif whole:
                parts.append(part)
                size += part.size
                pieces += part.pieces
            i += 1
            ahead = i
            while ahead < len(tokens) and tokens[ahead][1] in ("\n", "\\"):
                ahead += 1
            more = ahead + 1 < len(tokens) and tokens[ahead][0] == "join"
            if more:
                i = ahead + 1
            elif kind == "text" and ahead < len(tokens) and tokens[ahead][0] == "text" and (depth or ahead > i) and not target(ahead):
                more, i = True, ahead
        if parts:
            value = Value.joined(next(numbers), parts)
            for name in names:
                if whole and (exact or not value.blank):
                    known[name] = value
                elif not whole:
                    known.pop(name, None)
                yield name, value


def find(text: str | None, limited: bool = True) -> list[tuple[str, int, int, str | None, float | None]]:
    """(kind, start, end, name, score) of all secrets by start, kind, end; end exclusive, in code points.

    A null text is empty. Literals inside a span of the fixed patterns are not told twice. `limited` passes over
    parts of joined values beyond MOST_JOINED and MOST_PIECES; without it every part counts.
    """
    text = text or ""
    found: list[tuple] = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end(), None, None))
    told = sorted((a, b) for _, a, b, _, _ in found)
    named = [(name, name_weight(name), value) for name, value in pairs(text, limited)]
    literals = best_names([n for n in named if n[1] >= MIN_NAME])
    for (a, b), (name, score) in literals.items():
        if not any(x <= a and b <= y for x, y in told):
            found.append(("literal", a, b, name, score))
    return sorted(found, key=lambda s: (s[1], KINDS[s[0]], s[2]))


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                ("name", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and secrets (array of kind, start, end, name, score) of every row, joined values in full."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("kind", "start", "end", "name", "score")
        for batch in batches:
            rows = [[dict(zip(fields, s)) for s in find(x.as_py(), limited=False)] for x in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, SPAN_TYPE)], ["doc_id", "secrets"])

    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(
        run, f"doc_id {id_type}, secrets array<struct<kind: string, start: long, end: long, name: string, score: double>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"] != "literal")

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in BASE]
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
