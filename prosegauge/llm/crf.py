"""A linear-chain conditional random field with two states, in numpy.

State 1 is wanted text. Scores of a sequence are the sum of each position's
feature weights for its state, of the transitions, and of the states at both ends.
"""

from __future__ import annotations

import numpy as np


class Chain:
    def __init__(self, size: int):
        self.emit = np.zeros((size, 2))
        self.move = np.zeros((2, 2))
        self.ends = np.zeros((2, 2))  # start, end

    def scores(self, features: list[list[int]]) -> np.ndarray:
        """Each position's score by state. Every position has at least one feature."""
        flat = np.fromiter((f for x in features for f in x), np.int64)
        starts = np.cumsum([0] + [len(x) for x in features[:-1]])
        return np.add.reduceat(self.emit[flat], starts, axis=0)

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the best sequence of states; ties go to state 0."""
        (m00, m01), (m10, m11) = self.move.tolist()
        (s0, s1), (e0, e1) = self.ends.tolist()
        rows = scores.tolist()
        a, b = rows[0][0] + s0, rows[0][1] + s1
        back = []
        for x, y in rows[1:]:
            from_a = (a + m00 >= b + m10, a + m01 >= b + m11)
            a, b = (a + m00 if from_a[0] else b + m10) + x, (a + m01 if from_a[1] else b + m11) + y
            back.append(from_a)
        state = int(b + e1 > a + e0)
        path = [state]
        for from_a in reversed(back):
            state = 0 if from_a[state] else 1
            path.append(state)
        return path[::-1]

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each position's probability of a state, and the expected transitions."""
        n = len(scores)
        ahead, behind = np.empty((n, 2)), np.empty((n, 2))
        ahead[0], behind[-1] = scores[0] + self.ends[0], self.ends[1]
        for t in range(1, n):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + self.move, axis=0) + scores[t]
        for t in range(n - 2, -1, -1):
            behind[t] = np.logaddexp.reduce(self.move + scores[t + 1] + behind[t + 1], axis=1)
        total = np.logaddexp.reduce(ahead[-1] + self.ends[1])
        state = np.exp(ahead + behind - total)
        pair = np.exp(ahead[:-1, :, None] + self.move + (scores[1:] + behind[1:])[:, None, :] - total)
        return state, pair.sum(axis=0)

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-3, seed: int = 0) -> Chain:
        """Stochastic ascent on the log-likelihood, steps scaled as by AdaGrad."""
        rng = np.random.default_rng(seed)
        seen = [np.full_like(x, 1e-2) for x in (self.emit, self.move, self.ends)]
        for _ in range(rounds):
            for k in rng.permutation(len(pages)):
                features, states = pages[k]
                state, pair = self.marginals(self.scores(features))
                truth = np.eye(2)[states]
                flat = np.fromiter((f for x in features for f in x), np.int64)
                owner = np.repeat(np.arange(len(features)), [len(x) for x in features])
                up = np.zeros_like(self.emit)
                np.add.at(up, flat, (truth - state)[owner])
                moves = np.zeros((2, 2))
                np.add.at(moves, (states[:-1], states[1:]), 1)
                edges = np.array([truth[0] - state[0], truth[-1] - state[-1]])
                for x, s, g in zip((self.emit, self.move, self.ends), seen, (up, moves - pair, edges), strict=True):
                    g = g - decay * x
                    s += g * g
                    x += rate * g / np.sqrt(s)
        return self
