"""Least-cost edits of role sequences, and the least audit among them by prefix doubling.

A conversation is a sequence of rows; its repaired roles must read `(s?(ua)+)?`. Edits of rows are K
(keep, 0), R (other role, 2), D (delete, 3), between rows I (insert, 2); a truncated row that stays
adds 1; some rows must go. The automaton of the pattern has four states, and a node is (row, state).

1. The cost DP gives each node its least cost to the end; arcs that lose nothing are optimal.
2. Nodes are ranked by the least audit of 1, 2, 4, ... letters that optimal arcs spell from them: a
   rank of twice the length is the dense rank of (own rank, rank of the node that many letters on).
   Arcs that leave a node differ in their letter, so the letters lead to one node; the end ranks
   below all letters.
3. The least path takes at each node the optimal arc of the least (letter, rank of its target). Its
   nodes at all distances follow from doubled pointers, largest power first.

Many segments of conversations are worked side by side in arrays. A segment may end at a border
inside its conversation; the costs beyond come as a vector over the four states.
"""

from __future__ import annotations

import numpy as np

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Next state by an inserted or changed role, which is user after all but a user.
FILLED = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
#: Next state by a kept row's initial (other, s, u, a) in each state; -1: not allowed.
KEPT = np.array([[-1, -1, -1, -1], [AFTER_S, -1, -1, -1], [AFTER_U, AFTER_U, -1, AFTER_U], [-1, -1, AFTER_A, -1]])
FAR = 1 << 40
#: Costs at the end of a conversation: closed states, or one or two inserted turns.
CLOSED = np.array([0, 4, 2, 0])
LETTERS = "DIKR"
D, I, K, R = range(4)


def _row_costs(ahead: np.ndarray, initial: np.ndarray, must_go: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Cost by letter (axis 1) and state of each row, given the costs of the layer after it."""
    cost = np.full((len(ahead), 4, 4), FAR)
    cost[:, D] = 3 + ahead
    stays = np.where(must_go, FAR, cut.astype(np.int64))[:, None]
    cost[:, R] = 2 + stays + ahead[:, FILLED]
    to = KEPT[initial]
    cost[:, K] = np.where(to < 0, FAR, stays + np.take_along_axis(ahead, np.maximum(to, 0), axis=1))
    return cost


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    """Least cost when up to two turns may be inserted first."""
    once = cost[:, FILLED]
    return np.minimum(np.minimum(cost, 2 + once), 4 + once[:, FILLED])


def costs_to_end(initial: np.ndarray, must_go: np.ndarray, cut: np.ndarray, lengths: np.ndarray,
                 border: np.ndarray) -> np.ndarray:
    """Least cost of every (layer, state); a segment of n rows has n + 1 layers, one after the other."""
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    layers = firsts + np.arange(len(lengths))
    best = np.empty((len(initial) + len(lengths), 4), np.int64)
    best[layers + lengths] = border
    order = np.argsort(-lengths, kind="stable")
    by_length = lengths[order]
    for back in range(1, int(by_length[0]) + 1 if len(order) else 1):
        on = order[:np.searchsorted(-by_length, -back, side="right")]
        row, layer = firsts[on] + lengths[on] - back, layers[on] + lengths[on] - back
        cost = _row_costs(best[layer + 1], initial[row], must_go[row], cut[row])
        best[layer] = _with_inserts(cost.min(axis=1))
    return np.minimum(best, FAR)


def crossing_costs(initial, must_go, cut, lengths) -> np.ndarray:
    """Per segment, the least cost from each state before it to each state after it."""
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) + np.arange(len(lengths))
    out = np.empty((len(lengths), 4, 4), np.int64)
    for state in range(4):
        unit = np.full((len(lengths), 4), FAR)
        unit[:, state] = 0
        out[:, :, state] = costs_to_end(initial, must_go, cut, lengths, unit)[firsts]
    return out


def optimal_arcs(initial, must_go, cut, lengths, border, ends) -> tuple[np.ndarray, np.ndarray]:
    """(optimal, target) by node and letter; `ends` tells segments that close their conversation."""
    best = costs_to_end(initial, must_go, cut, lengths, border)
    n_layers = len(best)
    closing = np.cumsum(lengths + 1) - 1
    is_row = np.ones(n_layers, bool)
    is_row[closing] = False
    layer = np.flatnonzero(is_row)
    cost = np.full((n_layers, 4, 4), FAR)
    cost[layer] = _row_costs(best[layer + 1], initial, must_go, cut)
    may_insert = is_row.copy()
    may_insert[closing] = ends
    cost[may_insert, I] = 2 + best[may_insert][:, FILLED]
    node = np.arange(n_layers)[:, None] * 4
    target = np.empty((n_layers, 4, 4), np.int64)
    target[:, D] = node + 4 + np.arange(4)
    target[:, I] = node + FILLED
    target[:, R] = node + 4 + FILLED
    to = np.zeros((n_layers, 4), np.int64)
    to[layer] = np.maximum(KEPT[initial], 0)
    target[:, K] = node + 4 + to
    optimal = (cost == best[:, None, :]) & (cost < FAR)
    by_node = (0, 2, 1)
    return optimal.transpose(by_node).reshape(-1, 4), target.transpose(by_node).reshape(-1, 4)


def ranks_by_doubling(optimal: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rank of each node by its least whole audit; nodes without an arc have the rank of the empty one."""
    nodes = np.arange(len(optimal))
    alive = optimal.any(axis=1)
    letter = optimal.argmax(axis=1)
    rank = np.where(alive, letter + 1, 0)
    ahead = np.where(alive, target[nodes, letter], nodes)
    while True:
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[ahead], return_inverse=True)
        further = ahead[ahead]
        if np.array_equal(further, ahead):
            return rank
        ahead = further


def least_paths(optimal: np.ndarray, target: np.ndarray, entries: np.ndarray):
    """(entry, distance, node, letter) of all nodes on the least path from each entry node, in order.

    The node where a path ends comes last, with letter -1.
    """
    nodes = np.arange(len(optimal))
    rank = ranks_by_doubling(optimal, target)
    size = int(rank.max(initial=0)) + 1
    value = np.where(optimal, np.arange(4) * size + rank[np.where(optimal, target, 0)], 4 * size)
    letter = value.argmin(axis=1)
    alive = optimal.any(axis=1)
    letter[~alive] = -1
    end = len(nodes)  # one node after all ends
    jumps = [np.append(np.where(alive, target[nodes, letter], end), end)]
    while (jumps[-1] != end).any():
        jumps.append(jumps[-1][jumps[-1]])
    entry, far, at = np.arange(len(entries)), np.zeros(len(entries), np.int64), np.asarray(entries)
    for power in range(len(jumps) - 1, -1, -1):
        on = jumps[power][at]
        live = on != end
        entry = np.concatenate([entry, entry[live]])
        far = np.concatenate([far, far[live] + (1 << power)])
        at = np.concatenate([at, on[live]])
    order = np.lexsort((far, entry))
    return entry[order], far[order], at[order], letter[at[order]]
