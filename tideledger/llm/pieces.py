"""Distinct sampled segmentations into SentencePiece pieces, by Gumbel top-k over the lattice.

The lattice of a text has every piece of the model at every place where it fits, and byte pieces for characters
that are no piece. A segmentation's probability is proportional to the product of its pieces'
weights; the model file ranks its pieces, and a piece of rank r weighs (r + RANK_SHIFT) ** -theta (Zipf's law; bytes take
the last rank). Pieces never cross the start of a blank or a line, so the lattice factors into units;
a unit's table (backward sums and each node's choice probabilities) is made once and kept.

The k segmentations of greatest log probability plus independent Gumbel noise are a sample
without replacement. They are found by A* over sets of segmentations that share their first
choices: a set's priority is its greatest perturbed value, drawn top-down (truncated by its
parent's), which the backward sums make exact. The best set yields its best path; the rest of it
falls apart into one set per choice along that path. Noise comes from a hash of seed, row key, sample and
place: the same rows give the same samples on any partitioning and after any retry.

For k samples the log inclusion score is log(1 - exp(-exp(log p - kappa))), kappa being the
greatest perturbed value left (minus infinity, so a score of 0, if nothing is left).
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: What the units of a text with blanks for SPACE are, by patterns; the third does for Latin-1 texts what the second does
#: for all. `Lattice.cut` finds the same units by kinds of characters.
UNIT = re.compile("\n|\x20+[^\x20\n]*|[^\x20\n]+")
_LETTER = r"[^\W\d_]"
_OTHER = r"(?:[\W\d_](?<![\x20\n]))"
UNIT_BY_LETTERS = re.compile(rf"\n|\x20+{_OTHER}*{_LETTER}*|{_OTHER}+{_LETTER}*|{_LETTER}+")
_LATIN = "".join(c for c in map(chr, range(256)) if re.match(_LETTER, c))
UNIT_OF_LATIN = re.compile(f"\x20[{_LATIN}]+|\x20+[^\x20\n{_LATIN}]*[{_LATIN}]*|\n|[^\x20\n{_LATIN}]+[{_LATIN}]*|[{_LATIN}]+")
K = 3
THETA = 1.0
SEED = 42
RANK_SHIFT = 2.7
#: Nodes (some 90 bytes each) kept by a Python worker.
KEPT_NODES = 800_000
#: Choices made with one random number, choices of a path (first and later) and paths split at once, and the greatest
#: noise that `uniform` can give.
FRESH_STEPS = 4
SPLIT_AT_FIRST = 16
SPLIT_AT_ONCE = 512
PATHS_AT_ONCE = 256
MAX_NOISE = 37.0
#: Characters read and walked at once.
CHARS_AT_ONCE = 1 << 18

#: Bits of a code point.
_POINT_BITS = 21
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from an array of 64-bit keys."""
    x = keys * _GOLDEN + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def row_key(seed: int, key) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{key}".encode("utf-8", "surrogatepass"))


_OTHER_KIND, _LETTER_KIND, _BLANK_KIND, _LINE_KIND = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    kinds = np.full(0x110000, _OTHER_KIND, dtype=np.uint8)
    for run in re.finditer(f"{_LETTER}+", np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")):
        kinds[run.start():run.end()] = _LETTER_KIND
    kinds[[0x20, ord(SPACE)]] = _BLANK_KIND
    kinds[0x0A] = _LINE_KIND
    return kinds


class _Numbers(dict):
    """unit: number; a unit that is not there gets the next number and is put into `new`."""

    new: list[bytes] = []

    def __missing__(self, unit: bytes) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class Lattice:
    """Choice tables of units, made for many units at once.

    A unit has a node per character. A node's edges are the pieces that start there, likeliest first: `p`
    is an edge's probability given the node, `cum` the sum up to it, `target` the node that follows (-1 at
    the unit's end), `piece` the id (below zero: the bytes of character -1 - piece).
    """

    def __init__(self, model_file: str, theta: float = THETA) -> None:
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=model_file)
        n = self.model.vocab_size()
        self.bytes_at = [0] * 256
        self.ids: dict[str, int] = {}
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.ids[piece] = i
        # a byte below 128 is a character by itself wherever it stands
        self.pieces = np.full(n, None, dtype=object)
        for i, w in [(self.bytes_at[b], chr(b)) for b in range(128) if self.bytes_at[b]] + [(i, w) for w, i in self.ids.items()]:
            self.pieces[i] = w.replace(SPACE, " ")
        self.words = pa.array(self.pieces.tolist(), pa.large_string())
        order = sorted(self.ids.values(), key=lambda i: (-self.model.get_score(i), i))
        self.weight = {i: -theta * math.log(r + RANK_SHIFT) for r, i in enumerate(order)}
        self.byte_weight = -theta * math.log(len(order) + RANK_SHIFT)
        self.letters_end_units = all(not (a.isalpha() and not b.isalpha()) for w in self.ids for a, b in zip(w, w[1:]))
        # by length: all heads of pieces as (place of the head without its last character, that character), with the id
        # of those that are a piece (else -1)
        self.heads: list[tuple[np.ndarray, np.ndarray]] = []
        shorter = {"": 0}
        for size in range(1, max(map(len, self.ids), default=0) + 1):
            heads = sorted((shorter[w[:-1]] << _POINT_BITS | ord(w[-1]), w) for w in {w[:size] for w in self.ids if len(w) >= size})
            self.heads.append((np.array([x for x, _ in heads], dtype=np.int64),
                               np.array([self.ids.get(w, -1) for _, w in heads], dtype=np.int64)))
            shorter = {w: n for n, (_, w) in enumerate(heads)}
        self.ascii_ids = np.array(self.bytes_at[:128], dtype=np.int32)
        self.log_weight = np.array([self.weight.get(i, 0.0) for i in range(n)])
        self.clear()

    def clear(self) -> None:
        self.units = _Numbers()
        self.starts = np.empty(0, np.int64)
        self.nodes = self.edges = 0
        self.rows = {"first": np.zeros(1 << 16, np.int64), "cum": np.empty(1 << 18), "p": np.empty(1 << 18),
                     "logp": np.empty(1 << 18), "target": np.empty(1 << 18, np.int32), "piece": np.empty(1 << 18, np.int32)}

    def _put(self, own: dict) -> None:
        """Writes a table behind the kept rows; they are kept too once `nodes` and `edges` move on."""
        for name, values in own.items():
            at = self.nodes if name == "first" else self.edges
            if at + len(values) > len(self.rows[name]):
                grown = np.zeros(max(2 * len(self.rows[name]), at + len(values)), dtype=self.rows[name].dtype)
                grown[:at] = self.rows[name][:at]
                self.rows[name] = grown
            self.rows[name][at:at + len(values)] = values

    def _edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges by place: how many each has, their characters and ids; pieces that fit and bytes of what is no piece."""
        found = []
        live, head = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        for size, (known, ids) in enumerate(self.heads, 1):
            if size > 1:
                inside = np.flatnonzero(live + size <= ends.take(live))
                live, head = live.take(inside), head.take(inside)
            if not len(live):
                break
            key = head << _POINT_BITS | points.take(live + (size - 1))
            head = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = np.flatnonzero(known.take(head) == key)
            live, head = live.take(hit), head.take(hit)
            piece = ids.take(head)
            whole = np.flatnonzero(piece >= 0)
            found.append((live.take(whole), size, piece.take(whole)))
        bare = np.ones(len(points), dtype=bool)
        if found:
            bare[found[0][0]] = False
        bare = np.flatnonzero(bare)
        found.append((bare, 1, -1 - points[bare]))
        counts = np.zeros(len(points), dtype=np.int64)
        for place, _, _ in found:
            counts[place] += 1
        free = np.cumsum(counts) - counts
        sizes, pieces = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64)
        for place, size, piece in found:
            at = free[place]
            sizes[at], pieces[at] = size, piece
            free[place] = at + 1
        return counts, sizes, pieces

    def make(self, units: list[str], first_node: int) -> dict:
        """Table of the units, nodes counted from `first_node`."""
        return self._make([u.replace(" ", SPACE).encode("utf-32-le", "surrogatepass") for u in units], first_node)

    def _make(self, units: list[bytes], first_node: int) -> dict:
        points = np.frombuffer(b"".join(units), dtype=np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units], dtype=np.int64) // 4
        ends = np.repeat(np.cumsum(sizes), sizes)
        widths, size, piece = self._edges(points, ends)
        n, first = len(points), np.concatenate([[0], np.cumsum(widths)])
        place = np.repeat(np.arange(n), widths)
        weight = self.log_weight[np.maximum(piece, 0)]
        raw = np.flatnonzero(piece < 0)
        own = points[place[raw]]
        weight[raw] = self.byte_weight * np.where(own < 0x80, 1, np.where(own < 0x800, 2, np.where(own < 0x10000, 3, 4)))
        after = place + size
        stop = ends[place] == after
        # backward sums, all places of one distance to the end of their unit together
        left = ends - np.arange(n)
        by = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        wide = widths[by]
        begin = np.concatenate([[0], np.cumsum(wide)])
        order = np.repeat(first[by] - begin[:-1], wide) + np.arange(len(place))
        follow, weight = np.where(stop, n, after)[order], weight[order]
        sums = np.zeros(n + 1)
        mass = np.empty(len(place))
        steps = np.flatnonzero(np.diff(left[by], prepend=0, append=-1)).tolist()
        for x, y in zip(steps, steps[1:]):
            a, b = int(begin[x]), int(begin[y])
            at, w = begin[x:y] - a, wide[x:y]
            m = weight[a:b] + sums[follow[a:b]]
            top = np.maximum.reduceat(m, at)
            total = top + np.log(np.add.reduceat(np.exp(m - np.repeat(top, w)), at))
            sums[by[x:y]] = total
            mass[order[a:b]] = m - np.repeat(total, w)
        # likeliest first, nodes of one width together
        order = np.arange(len(place))
        for w in range(2, int(widths.max(initial=0)) + 1):
            rows = first[np.flatnonzero(widths == w)][:, None] + np.arange(w)
            order[rows] = np.take_along_axis(rows, np.argsort(-mass[rows], axis=1, kind="stable"), axis=1)
        after, piece, stop, p = after[order], piece[order], stop[order], np.exp(mass[order])
        # each node's sums by themselves, so that they do not depend on the units made together
        cum, k = p.copy(), 1
        at = np.flatnonzero(widths > 1)
        while len(at):
            edge = first[at] + k
            cum[edge] += cum[edge - 1]
            k += 1
            at = at[widths[at] > k]
        cum[first[1:] - 1] = 2.0
        target = np.where(stop, -1, after + first_node)
        # a byte that is a character by itself is put out as it stands
        single = np.flatnonzero((piece < 0) & (piece >= -128))
        piece[single] = self.ascii_ids[-1 - piece[single]]
        return {"first": first, "cum": cum, "p": p, "logp": np.log(p), "target": target.astype(np.int32),
                "piece": piece.astype(np.int32)}

    def cut(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct units (UTF-32) of the texts as the model reads them (a blank in front, blanks as SPACE), the places
        of all units among these, and how many each text has.

        No piece crosses the borders: a blank or line starts a unit, and so does what follows a
        letter without being one, if the model has no piece that joins the two.
        """
        read = [" " + x if x else "" for x in texts]
        points = np.frombuffer("".join(read).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = _kinds().take(points)
        line, blank = kinds == _LINE_KIND, kinds == _BLANK_KIND
        begins = line.copy()
        begins[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        if self.letters_end_units:
            begins[1:] |= (kinds[1:] == _OTHER_KIND) & (kinds[:-1] == _LETTER_KIND)
        borders = np.cumsum([0, *map(len, read)])
        begins[borders[:-1][np.diff(borders) > 0]] = True
        begins = np.flatnonzero(begins)
        units = pa.Array.from_buffers(pa.large_binary(), len(begins), [
            None, pa.py_buffer(np.append(begins, len(points)) * 4), pa.py_buffer(np.where(blank, np.uint32(ord(SPACE)), points))])
        coded = units.dictionary_encode()
        _, ends, data = coded.dictionary.buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[:len(coded.dictionary) + 1].tolist() if len(begins) else []
        data = data.to_pybytes() if data else b""
        return ([data[a:b] for a, b in zip(ends, ends[1:])], coded.indices.to_numpy().astype(np.int64),
                np.diff(np.searchsorted(begins, borders)))

    def tables(self, units: list[bytes]) -> tuple[dict, np.ndarray]:
        """A table that holds all these units (UTF-32), and each one's first node.

        New units are kept for later texts while there is room; beyond that they serve this call only.
        """
        room, new = self.nodes < KEPT_NODES, []
        self.units.new = new
        code = np.fromiter(map(self.units.__getitem__, units), dtype=np.int64, count=len(units))
        starts = self.starts
        if new:
            own = self._make(new, self.nodes)
            own["first"] = own["first"] + self.edges
            starts = np.append(starts, self.nodes + np.cumsum([0, *map(len, new)])[:-1] // 4)
            self._put(own)
            if room:
                self.starts = starts
                self.nodes += len(own["first"]) - 1
                self.edges += len(own["cum"])
            else:
                for unit in new:
                    del self.units[unit]
        return self.rows, starts[code]

    def ids_of(self, pieces: np.ndarray) -> np.ndarray:
        """Pieces with characters below zero put out as bytes."""
        at = np.flatnonzero(pieces < 0)
        if not len(at):
            return pieces
        raw = [[self.bytes_at[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] for i in pieces[at].tolist()]
        return np.insert(np.delete(pieces, at), np.repeat(at - np.arange(len(at)), [len(r) for r in raw]),
                         [i for r in raw for i in r]).astype(np.int32)


def walk(t: dict, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled edges from each start node to the end of its unit: how many each has, and all in order.

    One number serves several choices: what is left of it inside the chosen edge's share is uniform again.
    """
    owners, edges = [], []
    at, node, step = np.arange(len(nodes)), nodes, 0
    counts = np.zeros(len(nodes), dtype=np.int64)
    while len(at):
        if step % FRESH_STEPS == 0:
            u = uniform(keys[at] + np.uint64(step * int(_MIX1) & (1 << 64) - 1))
        edge = t["first"].take(node)
        rest = np.flatnonzero(t["cum"].take(edge) <= u)
        while len(rest):
            further = edge[rest] + 1
            edge[rest] = further
            rest = rest[t["cum"].take(further) <= u[rest]]
        owners.append(at)
        edges.append(edge)
        node = t["target"].take(edge)
        on = np.flatnonzero(node >= 0)
        step += 1
        counts[at] = step
        if not len(on):
            break
        at, node = at[on], node[on].astype(np.int64)
        if step % FRESH_STEPS:
            chosen, u = edge[on], u[on]
            # the share of an edge ends at cum, but the last one's is put to 2 and ends at 1
            p = t["p"].take(chosen)
            below = np.minimum(t["cum"].take(chosen), 1.0) - p
            u = np.clip((u - below) / p, 2.0 ** -53, 1 - 2.0 ** -53)
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.int64)
    for step, (at, edge) in enumerate(zip(owners, edges)):
        out[begin[at] + step] = edge
    return counts, out


def _gumbels(u: np.ndarray, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Greatest perturbed value of sets of log mass `place`, given that none exceeds `bound`."""
    return -np.logaddexp(-bound, -(place - np.log(-np.log(u))))


class _Search:
    """Sets of segmentations of one text, by their greatest perturbed value."""

    def __init__(self, key: int, k: int) -> None:
        self.key, self.k, self.heap, self.found = key, k, [], []

    def least(self) -> float:
        """The worst value that counts; what is below cannot come out."""
        return -self.heap[-1][0] if len(self.heap) > self.k else -math.inf

    def wait(self, values: np.ndarray, depths: np.ndarray, sample: int, edges: np.ndarray, start: int, barred: tuple) -> None:
        """Puts the k + 1 best of these sets into wait; more of them cannot count."""
        if len(values) > self.k + 1:
            best = np.argpartition(-values, self.k)[:self.k + 1]
            values, depths = values[best], depths[best]
        for value, depth in zip(values.tolist(), depths.tolist()):
            self.heap.append((-value, sample, depth, (int(edges[depth]),) + (barred if depth == start else ())))
        self.heap.sort()
        del self.heap[self.k + 1:]


def _bases(keys: np.ndarray, sample: int, salt: int) -> np.ndarray:
    """What the keys of a sample's random numbers begin with, by search; the places are added to it."""
    return keys ^ np.uint64((sample * 4 + salt + 1) * int(_MIX2) & (1 << 64) - 1)


def _add_paths(t: dict, paths: list[tuple[_Search, np.ndarray, np.ndarray, float, int, tuple]]) -> None:
    """Takes a sampled path (edges, their log p, value) of each search and splits the rest of its set, from choice `start` on.

    Each path is a row by itself, so what lies beside it does not change its numbers.
    """
    todo = []
    for s, edges, logp, value, start, barred in paths:
        s.found.append((edges, float(logp.sum()), value))
        todo.append((s, edges, logp, value, start, barred, start, float(logp[:start].sum())))
    width = SPLIT_AT_FIRST
    while todo:
        following = []
        for at in range(0, len(todo), PATHS_AT_ONCE):
            following += _split(t, todo[at:at + PATHS_AT_ONCE], width)
        todo, width = following, SPLIT_AT_ONCE


def _split(t: dict, todo: list[tuple], most: int) -> list[tuple]:
    """Splits the next choices (at most `most`) of each path; returns the paths that go on."""
    done = np.array([x[-2] for x in todo])
    sizes = np.minimum(np.array([len(x[1]) for x in todo]) - done, most)
    width = int(sizes.max())
    if not width:
        return []
    part = np.zeros((len(todo), width))
    part[np.arange(width) < sizes[:, None]] = np.concatenate([x[2][x[-2]:x[-2] + most] for x in todo])
    left = -np.expm1(part)
    for n, (_, _, _, _, start, barred, at, _) in enumerate(todo):
        if at == start and barred:
            left[n, 0] -= sum(float(t["p"][e]) for e in barred)
    before = np.array([x[-1] for x in todo])
    upto = np.cumsum(part, axis=1)
    # a node with one choice has nothing left; what rounding leaves is less than this
    row, column = np.nonzero(left > 1e-12)
    place = (before[:, None] + upto - part)[row, column] + np.log(left[row, column])
    depth = column + done[row]
    bases = _bases(np.array([x[0].key for x in todo], dtype=np.uint64), len(todo[0][0].found) - 1, 1)
    u = uniform(depth.astype(np.uint64) * _GOLDEN + bases[row])
    # a value is at most place - log(-log u), which is below place - log(1 - u): most cannot pass the worst set in wait
    least = np.array([x[0].least() for x in todo])
    near = np.flatnonzero(np.log1p(-u) < place - least[row] + 1e-6)
    row, depth = row[near], depth[near]
    values = _gumbels(u[near], place[near], np.array([x[3] for x in todo])[row])
    borders = np.searchsorted(row, np.arange(len(todo) + 1)).tolist()
    for (s, edges, _, _, start, barred, _, _), a, b in zip(todo, borders, borders[1:]):
        if b > a:
            s.wait(values[a:b], depth[a:b], len(s.found) - 1, edges, start, barred)
    # Noise is at most MAX_NOISE, and a set's mass is at most that of the choices before it: once
    # that is too low to pass the worst set in wait, no later set can.
    before = before + upto[np.arange(len(todo)), sizes - 1]
    on = np.flatnonzero(before + MAX_NOISE > np.array([x[0].least() for x in todo]))
    return [(*todo[n][:-2], int(done[n] + sizes[n]), float(before[n])) for n in on.tolist() if done[n] + sizes[n] < len(todo[n][1])]


def _other_edge(t: dict, node: int, barred: tuple, u: float) -> int:
    """An edge of the node that is not barred, by probability."""
    lo, hi = int(t["first"][node]), int(t["first"][node + 1])
    edges = [e for e in range(lo, hi) if e not in barred]
    weights = [float(t["p"][e]) for e in edges]
    goal = u * sum(weights)
    for e, w in zip(edges, weights):
        goal -= w
        if goal < 0:
            return e
    return edges[-1]


def sample(lattice: Lattice, texts: list[str | None], keys: list, k: int = K, seed: int = SEED) -> list[list[tuple]]:
    """Per text up to k distinct segmentations as (ids, log p, perturbed value, log inclusion), best first.

    A text with fewer segmentations gives all of them; an empty or null one its only, empty one. All texts
    are held and walked together: `encode` hands over CHARS_AT_ONCE characters, or one longer text, at a time.
    """
    units, places, sizes = lattice.cut(texts)
    t, first = lattice.tables(units)
    nodes, starts = first[places], np.cumsum(sizes) - sizes
    searches = [_Search(row_key(seed, key), k) for key in keys]
    row_keys = np.array([s.key for s in searches], dtype=np.uint64)
    # (text, value, parent sample, depth, barred edges); all of a round have as many samples
    todo = [(i, -math.log(-math.log(u)), -1, 0, ()) for i, u in enumerate(uniform(_bases(row_keys, 0, 2)).tolist())]
    number = 0
    while todo:
        who = np.array([i for i, *_ in todo], dtype=np.int64)
        own_keys = row_keys[who]
        heads, inner, begin = [np.empty(0, np.int64)] * len(todo), np.full(len(todo), -1), np.zeros(len(todo), np.int64)
        if number:
            depths = np.array([depth for *_, depth, _ in todo], dtype=np.uint64)
            numbers = uniform(depths * _GOLDEN + _bases(own_keys, number, 3)).tolist()
            for n, (i, _, parent, depth, barred) in enumerate(todo):
                edges = searches[i].found[parent][0]
                after = t["target"][edges[:depth]]
                unit = int(np.count_nonzero(after < 0))
                # the node that the barred edges leave from
                node = int(nodes[starts[i] + unit]) if not depth or after[-1] < 0 else int(after[-1])
                edge = _other_edge(t, node, barred, numbers[n])
                heads[n] = np.append(edges[:depth], edge)
                inner[n] = t["target"][edge]
                begin[n] = unit + (inner[n] < 0)
        # the units left of each text, the first one from its inner node
        spans = sizes[who] - begin
        borders = np.concatenate([[0], np.cumsum(spans)])
        place = np.arange(borders[-1]) + np.repeat(begin - borders[:-1], spans)
        own = nodes[place + np.repeat(starts[who], spans)]
        own[borders[:-1][inner >= 0]] = inner[inner >= 0]
        counts, edge = walk(t, own, place.astype(np.uint64) * _GOLDEN + np.repeat(_bases(own_keys, number, 0), spans))
        cuts = np.concatenate([[0], np.cumsum(counts)])[borders].tolist()
        if number:
            tails = [edge[a:b] for a, b in zip(cuts, cuts[1:])]
            edge = np.concatenate([x for pair in zip(heads, tails) for x in pair])
            cuts = np.cumsum([0, *[len(h) + len(x) for h, x in zip(heads, tails)]]).tolist()
        logp = t["logp"].take(edge)
        _add_paths(t, [(searches[i], edge[a:b], logp[a:b], value, depth, barred)
                       for (i, value, _, depth, barred), a, b in zip(todo, cuts, cuts[1:])])
        following, number = [], number + 1
        for i, *_ in todo:
            s = searches[i]
            if number < k and s.heap:
                top, sample_no, at, bars = heapq.heappop(s.heap)
                following.append((i, -top, sample_no, at, bars))
        todo = following
    results = []
    for s in searches:
        kappa = -s.heap[0][0] if s.heap else -math.inf
        rows = []
        for edges, logp, value in s.found:
            ids = lattice.ids_of(t["piece"].take(edges))
            x = logp - kappa
            score = 0.0 if x > 40 else math.log(-math.expm1(-math.exp(x))) if x > -30 else x
            rows.append((ids, logp, value, score))
        results.append(rows)
    return results


def decode(lattice: Lattice, ids: np.ndarray) -> str:
    """The text of an array of ids; runs of bytes are read as UTF-8 by the model."""
    try:
        return "".join(lattice.pieces[ids].tolist())[1:]
    except TypeError:  # no character by itself
        return lattice.model.decode(ids.tolist())


_LATTICES: dict[tuple, Lattice] = {}


def lattice_of(model_file: str, theta: float = THETA) -> Lattice:
    """One lattice per worker process, model and theta."""
    if (model_file, theta) not in _LATTICES:
        _LATTICES[model_file, theta] = Lattice(model_file, theta)
    return _LATTICES[model_file, theta]


SAMPLE_TYPE = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()),
                                  ("log_inclusion", pa.float64()), ("round_trip", pa.bool_())]))


def encode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", k: int = K, theta: float = THETA,
           seed: int = SEED) -> DataFrame:
    """docs without `text`, with `samples`: up to k segmentations of each row's whole text.

    round_trip says whether decoding gives the text back (a literal U+2581 comes back as a blank). Equal
    rows get equal samples; a null key is a key like any other. A column `samples` of docs is replaced.
    """
    docs = docs.drop("samples") if text != "samples" else docs
    others = [c for c in docs.columns if c != text]
    fields = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text] + [
        "samples array<struct<ids: array<int>, log_prob: double, perturbed: double, log_inclusion: double, round_trip: boolean>>"])
    key_at, text_at = docs.columns.index(key), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model_file, theta)
        for batch in batches:
            begin, sizes = 0, pc.fill_null(pc.utf8_length(batch.column(text_at)), 0).to_pylist()
            while begin < batch.num_rows:
                end, size = begin, 0
                while end < batch.num_rows and (end == begin or size < CHARS_AT_ONCE):
                    size += sizes[end]
                    end += 1
                part = batch.slice(begin, end - begin)
                texts = part.column(text_at).to_pylist()
                found = sample(lattice, texts, part.column(key_at).to_pylist(), k, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(j) for j, c in enumerate(docs_columns) if c != text] + [_samples(lattice, texts, found)],
                    [*others, "samples"])
                begin = end

    docs_columns = docs.columns
    return docs.mapInArrow(run, fields)


def _same(lattice: Lattice, texts: list, found: list[list[tuple]], lists: pa.ListArray) -> list[bool]:
    """Whether each sample decodes to its text."""
    words = lattice.words.take(lists.values)
    if words.null_count:  # bytes that are no character by themselves
        return [(x or "") == decode(lattice, s[0]) for x, own in zip(texts, found) for s in own]
    # the words stand one behind the other
    _, offsets, data = words.buffers()
    data = data.to_pybytes() if data else b""
    cuts = np.frombuffer(offsets, dtype=np.int64)[lists.offsets.to_numpy()].tolist() if len(words) else [0] * (len(lists) + 1)
    raw = [x for x, own in zip([(x or "").encode("utf-8", "surrogatepass") for x in texts], found) for _ in own]
    return [x == data[a + 1:b] for x, a, b in zip(raw, cuts, cuts[1:])]


def _samples(lattice: Lattice, texts: list, found: list[list[tuple]]) -> pa.Array:
    rows = [s for own in found for s in own]
    ids = [s[0] for s in rows]
    lists = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()),
        pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
    back = _same(lattice, texts, found, lists)
    structs = pa.StructArray.from_arrays(
        [lists, *[pa.array([s[c] for s in rows], pa.float64()) for c in (1, 2, 3)], pa.array(back, pa.bool_())],
        ["ids", "log_prob", "perturbed", "log_inclusion", "round_trip"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)


def exploded(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per sample: key, sample (0 the first), n_pieces, log_prob, log_inclusion, round_trip, ids."""
    return (encoded.select(key, F.posexplode("samples").alias("sample", "s"))
            .select(key, "sample", F.size("s.ids").alias("n_pieces"), "s.log_prob", "s.log_inclusion", "s.round_trip", "s.ids"))
