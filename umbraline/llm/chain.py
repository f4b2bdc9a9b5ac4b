"""Linear-chain conditional random fields over many sequences at once.

Sequences lie end to end in flat arrays.  To run forward-backward over all of them with
few array operations, every sequence is cut into blocks of ``BLOCK`` steps: the product
of each block's step matrices is built for all blocks together, a short walk over the
blocks of each sequence gives the messages at the block borders, and the steps inside
the blocks are filled in, again for all blocks together.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 32


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)


def messages(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages, and the emission factors, for each step.

    emission (n, k) and transition (k, k) are log-potentials; lengths are those of the
    sequences, all at least 1.  Both messages are normalised at each step.  A single sequence
    may be a piece of a longer one: ``before`` is the forward message of the step before it, and
    ``after`` the backward message of its last step.
    """
    n, k = emission.shape
    factor = np.exp(emission - emission.max(1, keepdims=True))
    t = np.exp(transition - transition.max())
    lengths = np.asarray(lengths, np.int64)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    total = int(blocks.sum())
    rank = np.arange(total) - np.repeat(first, blocks)
    begin = np.repeat(start, blocks) + rank * BLOCK
    size = np.minimum(BLOCK, np.repeat(start + lengths, blocks) - begin)
    place = begin[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < size[:, None]
    e = np.ones((total, BLOCK, k))
    e[real] = factor[place[real]]
    # Products of the step matrices of each block; the first step of a sequence has no transition.
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    linked = rank > 0 if before is None else np.ones(total, bool)
    product[linked] = product[linked] @ t
    product *= e[:, 0][:, None, :]
    for i in range(1, BLOCK):
        on = np.flatnonzero(real[:, i])
        if not len(on):
            break
        step = (product[on] @ t) * e[on, i][:, None, :]
        product[on] = step / step.sum((1, 2), keepdims=True)
    # Messages at the borders of the blocks, rank by rank.
    into, back = np.ones((total, k)), np.ones((total, k))
    if before is not None:
        into[0] = before
    if after is not None:
        back[-1] = after
    order = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[order], np.arange(int(blocks.max(initial=0)) + 1))
    last = rank == np.repeat(blocks, blocks) - 1
    for r in range(len(bounds) - 1):
        own = order[bounds[r] : bounds[r + 1]]
        go = own[~last[own]]
        into[go + 1] = _norm((into[go][:, None, :] @ product[go])[:, 0])
    for r in range(len(bounds) - 2, 0, -1):
        own = order[bounds[r] : bounds[r + 1]]
        back[own - 1] = _norm((product[own] @ back[own][:, :, None])[:, :, 0])
    # Inside the blocks.
    alpha, beta = np.empty((total, BLOCK, k)), np.ones((total, BLOCK, k))
    a = np.where(linked[:, None], into @ t, into) * e[:, 0]
    alpha[:, 0] = a = _norm(a)
    for i in range(1, BLOCK):
        a = np.where(real[:, i][:, None], _norm((a @ t) * e[:, i]), a)
        alpha[:, i] = a
    b = back
    for i in range(BLOCK - 1, -1, -1):
        beta[:, i] = b
        b = np.where(real[:, i][:, None], _norm((e[:, i] * b) @ t.T), b)
    return alpha[real], beta[real], factor


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability of each label at each step, by forward-backward."""
    if not len(emission):
        return np.zeros_like(emission, dtype=float)
    alpha, beta, _ = messages(emission, lengths, transition)
    return _norm(alpha * beta)


def marginals_in_pieces(piece: Callable[[int], np.ndarray], n: int, transition: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``marginals`` of one sequence whose emissions come in ``n`` pieces, from the last piece to the first.

    ``piece(j)`` gives the emissions of the j-th (perhaps of no steps), and is asked twice.  Messages
    at the borders are handed on, so the result is that of the whole sequence, and no more than
    one piece is held at once.
    """
    t = np.exp(transition - transition.max())
    before: list[np.ndarray | None] = [None]
    for j in range(n):
        emission = piece(j)
        before.append(messages(emission, [len(emission)], transition, before[-1])[0][-1] if len(emission) else before[-1])
    after = None
    for j in range(n - 1, -1, -1):
        emission = piece(j)
        if len(emission):
            alpha, beta, factor = messages(emission, [len(emission)], transition, before[j], after)
            yield j, _norm(alpha * beta)
            after = _norm((factor[0] * beta[0]) @ t.T)


def expectations(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of all steps, and expected transition counts over all sequences."""
    alpha, beta, factor = messages(emission, lengths, transition)
    t = np.exp(transition - transition.max())
    later = np.ones(len(emission), bool)
    later[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = False
    at = np.flatnonzero(later)
    left, right = alpha[at - 1], factor[at] * beta[at]
    z = np.maximum(((left @ t) * right).sum(1, keepdims=True), 1e-300)
    return _norm(alpha * beta), ((left / z).T @ right) * t


class Adam:
    """Stochastic gradient steps with running moments (Kingma and Ba, 2015)."""

    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, weights: np.ndarray, gradient: np.ndarray) -> None:
        m = self.m.setdefault(name, np.zeros_like(weights))
        v = self.v.setdefault(name, np.zeros_like(weights))
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient * gradient - v)
        weights += self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)
