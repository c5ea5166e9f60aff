"""A linear-chain conditional random field with two states, in vectorised numpy.

State 1 is "toxic". A token's emission is the weight of its word for state 1 (0 for
state 0); ``trans[i, j]`` is the log potential of going from i to j; the state before
a text is 0. Forward-backward is exact on texts of any length: texts are cut into
segments, all segments run side by side, each segment's 2 x 2 transfer matrix links
it to its neighbours, and a second sweep starts from the true vectors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SEGMENT = 128


class Chain(NamedTuple):
    marginals: np.ndarray
    pairs: np.ndarray


def forward_backward(logits: np.ndarray, offsets: np.ndarray, trans: np.ndarray, pairs: bool = False) -> Chain:
    """P(state 1) of each token, and with ``pairs`` the expected transitions (2 x 2) of all texts."""
    n = np.diff(offsets)
    k = -(-n // SEGMENT)
    total = int(k.sum())
    if not total:
        return Chain(np.zeros(0), np.zeros((2, 2)))
    first = np.cumsum(k) - k
    doc = np.repeat(np.arange(len(n)), k)
    which = np.arange(total) - first[doc]
    start = offsets[:-1][doc] + which * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][doc] - start)
    at = start[None, :] + np.arange(SEGMENT)[:, None]
    on = np.arange(SEGMENT)[:, None] < size[None, :]
    e = np.ones((SEGMENT, total))
    e[on] = np.exp(np.clip(logits, -30, 30))[at[on]]
    t00, t01, t10, t11 = np.exp(trans).ravel()

    m = [np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)]
    for i in range(SEGMENT):
        a, b, c, d = m
        new = [a * t00 + b * t10, (a * t01 + b * t11) * e[i], c * t00 + d * t10, (c * t01 + d * t11) * e[i]]
        scale = 1 / np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
        m = [np.where(on[i], x * scale, y) for x, y in zip(new, m, strict=True)]

    before = np.zeros((2, total))
    after = np.ones((2, total))
    row = np.array([np.ones(len(n)), np.zeros(len(n))])
    col = np.ones((2, len(n)))
    for j in range(int(k.max())):
        d = np.flatnonzero(k > j)
        s = first[d] + j
        before[:, s] = row[:, d]
        x = np.array([row[0, d] * m[0][s] + row[1, d] * m[2][s], row[0, d] * m[1][s] + row[1, d] * m[3][s]])
        row[:, d] = x / x.sum(axis=0)
        s = first[d] + k[d] - 1 - j
        after[:, s] = col[:, d]
        x = np.array([m[0][s] * col[0, d] + m[1][s] * col[1, d], m[2][s] * col[0, d] + m[3][s] * col[1, d]])
        col[:, d] = x / x.sum(axis=0)

    alpha = np.empty((SEGMENT, 2, total))
    a0, a1 = before
    for i in range(SEGMENT):
        x0, x1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * e[i]
        scale = 1 / (x0 + x1)
        a0, a1 = np.where(on[i], x0 * scale, a0), np.where(on[i], x1 * scale, a1)
        alpha[i, 0], alpha[i, 1] = a0, a1
    out = np.zeros(len(logits))
    expected = np.zeros((2, 2))
    b0, b1 = after
    for i in range(SEGMENT - 1, -1, -1):
        live = on[i]
        p0, p1 = alpha[i, 0] * b0, alpha[i, 1] * b1
        out[at[i][live]] = (p1 / (p0 + p1))[live]
        u0, u1 = b0, b1 * e[i]
        if pairs:
            q0, q1 = (alpha[i - 1] if i else before)[:, live]
            cell = np.array([[q0 * t00 * u0[live], q0 * t01 * u1[live]], [q1 * t10 * u0[live], q1 * t11 * u1[live]]])
            expected += (cell / cell.sum(axis=(0, 1))).sum(axis=2)
        x0, x1 = t00 * u0 + t01 * u1, t10 * u0 + t11 * u1
        scale = 1 / (x0 + x1)
        b0, b1 = np.where(live, x0 * scale, b0), np.where(live, x1 * scale, b1)
    return Chain(out, expected)


def train(
    words: np.ndarray, offsets: np.ndarray, states: np.ndarray, has: tuple[np.ndarray, np.ndarray], features: int, rounds: int = 40, rate: float = 0.5, decay: float = 1e-3
) -> tuple[np.ndarray, float, np.ndarray]:
    """(feature weights, bias, transitions) by penalised maximum likelihood of labelled tokens, with adaptive gradient steps.

    ``words`` numbers the word of each token; ``has`` lists (word, feature) pairs.
    """
    kinds = int(words.max(initial=-1)) + 1
    weights, bias, trans = np.zeros(features), -2.0, np.zeros((2, 2))
    seen_w, seen_b, seen_t = np.full(features, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    prior = np.concatenate([[0], states[:-1]])
    prior[offsets[:-1][offsets[:-1] < len(states)]] = 0
    observed = np.zeros((2, 2))
    np.add.at(observed, (prior, states), 1)
    for _ in range(rounds):
        logits = bias + np.bincount(has[0], weights[has[1]], kinds)
        chain = forward_backward(logits[words], offsets, trans, pairs=True)
        rest = np.bincount(words, states - chain.marginals, kinds)
        g = np.bincount(has[1], rest[has[0]], features) - decay * weights
        b = float(rest.sum())
        h = observed - chain.pairs - decay * trans
        h[0, 0] = 0  # one potential is fixed
        seen_w, seen_b, seen_t = seen_w + g * g, seen_b + b * b, seen_t + h * h
        weights += rate * g / np.sqrt(seen_w)
        bias += rate * b / np.sqrt(seen_b)
        trans = trans + rate * h / np.sqrt(seen_t)
    return weights, bias, trans
