"""Training of a product quantiser's words in one subspace: seeding, minibatch epochs, Lloyd rounds and an anisotropic refinement.

The rows are a bounded sample; each subspace is trained by a task of its own.
"""

from __future__ import annotations

import numpy as np

#: Rows that seeding looks at, and candidates of which it takes the best for each word.
SEEDED, CANDIDATES = 20_000, 7
EPOCHS, BATCH, LLOYD, REFINE = 8, 8192, 25, 10
#: Numbers that a matrix of rows by words, or of rows' outer products, has at once.
NUMBERS = 1 << 20


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ words.T + (words**2).sum(axis=1), 0)


def _own(x: np.ndarray, words: np.ndarray, costs) -> tuple[np.ndarray, np.ndarray]:
    """Each row's word of least cost, and the cost, for a slice of rows at a time."""
    own, least, step = np.empty(len(x), np.int64), np.empty(len(x)), max(1, NUMBERS // len(words))
    for at in range(0, len(x), step):
        c = costs(x[at : at + step], words)
        own[at : at + step] = c.argmin(axis=1)
        least[at : at + step] = c[np.arange(len(c)), own[at : at + step]]
    return own, least


def _outer(u: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of outer products of the rows of each run; runs are summed some at a time, and one of many rows in slices."""
    out, step = np.zeros((len(starts), u.shape[1], u.shape[1])), max(1, NUMBERS // u.shape[1] ** 2)
    ends, i = np.append(starts[1:], len(u)), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        if ends[i] - starts[i] > step:
            j = i + 1
            for at in range(starts[i], ends[i], step):
                some = u[at : min(at + step, ends[i])]
                out[i] += some.T @ some
        else:
            some = u[starts[i] : ends[j - 1]]
            out[i:j] = np.add.reduceat(some[:, :, None] * some[:, None, :], starts[i:j] - starts[i], axis=0)
        i = j
    return out


def seeds(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Greedy k-means++: each next word is, of a few rows drawn by squared distance, the one that leaves the least total."""
    if len(x) > SEEDED:
        x = x[rng.choice(len(x), SEEDED, replace=False)]
    words = [x[rng.integers(len(x))]]
    near = _distances(x, words[0][None])[:, 0]
    while len(words) < n:
        total = near.sum()
        at = rng.choice(len(x), CANDIDATES, p=near / total) if total > 0 else rng.integers(0, len(x), CANDIDATES)
        left = np.minimum(near, _distances(x, x[at]).T)
        best = int(left.sum(axis=1).argmin())
        words.append(x[at[best]])
        near = left[best]
    return np.array(words)


def epochs(x: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Minibatches: a word is the running mean of all rows that were nearest it."""
    words, seen = words.copy(), np.zeros(len(words))
    for _ in range(EPOCHS):
        some = x[rng.choice(len(x), min(BATCH, len(x)), replace=False)]
        own = _own(some, words, _distances)[0]
        n = np.bincount(own, minlength=len(words))
        sums = np.stack([np.bincount(own, some[:, j], len(words)) for j in range(x.shape[1])], axis=1)
        seen += n
        met = n > 0
        words[met] += (sums[met] - n[met, None] * words[met]) / seen[met, None]
    return words


def lloyd(x: np.ndarray, words: np.ndarray, rounds: int = LLOYD) -> np.ndarray:
    """Means of the nearest rows, until nothing moves; a word without rows takes the row that is farthest from its own."""
    words = words.copy()
    for _ in range(rounds):
        own, near = _own(x, words, _distances)
        n = np.bincount(own, minlength=len(words))
        new = np.stack([np.bincount(own, x[:, j], len(words)) for j in range(x.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
        dead = np.flatnonzero(n == 0)
        new[dead] = x[np.argsort(-near, kind="stable")[: len(dead)]]
        if np.abs(new - words).max() < 1e-9:
            break
        words = new
    return words


def anisotropic_costs(x: np.ndarray, words: np.ndarray, eta: float) -> np.ndarray:
    """[row, word]: squared residual, that along the row counted eta times, less what doesn't depend on the word."""
    t = x @ words.T
    size = np.maximum((x**2).sum(axis=1), 1e-30)
    return (words**2).sum(axis=1) - 2 * eta * t + (eta - 1) / size[:, None] * t * t


def refine(x: np.ndarray, words: np.ndarray, eta: float, rounds: int = REFINE) -> np.ndarray:
    """Words of least anisotropic cost, by turns: rows to words, then each word from its normal equations, all solved at once."""
    words, was = words.copy(), None
    d = x.shape[1]
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-15)[:, None]
    for _ in range(rounds):
        own = _own(x, words, lambda some, w: anisotropic_costs(some, w, eta))[0]
        if was is not None and (own == was).all():
            break
        was, order = own, np.argsort(own, kind="stable")
        n = np.bincount(own, minlength=len(words))
        met, starts = np.flatnonzero(n), (np.cumsum(n) - n)[n > 0]
        a = n[met, None, None] * np.eye(d) + (eta - 1) * _outer(unit[order], starts) + 1e-9 * np.eye(d)
        b = np.add.reduceat(eta * x[order], starts, axis=0)
        words[met] = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    return words


def train(x: np.ndarray, n: int, eta: float, rng: np.random.Generator) -> np.ndarray:
    words = lloyd(x, epochs(x, seeds(x, n, rng), rng))
    return refine(x, words, eta) if eta > 1 else words
