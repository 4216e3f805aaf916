"""Linear-chain conditional random field: fitted by gradient steps on the exact likelihood, decoded by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Scores of a chain: ``weights`` (features x states), ``step`` (state to state), ``start`` (first state), and the
    mean and spread by which features are brought to one scale."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.hstack([z, np.ones((len(z), 1))]) @ self.weights


def viterbi(chain: Chain, e: np.ndarray) -> list[int]:
    """The best states for emission scores (places x states); ties take the lower state."""
    if not len(e):
        return []
    step = chain.step.tolist()
    states = range(len(step))
    rows = e.tolist()
    best = [a + b for a, b in zip(chain.start.tolist(), rows[0])]
    back = []
    for row in rows[1:]:
        came, now = [], []
        for s in states:
            value, at = best[0] + step[0][s], 0
            for r in states[1:]:
                if best[r] + step[r][s] > value:
                    value, at = best[r] + step[r][s], r
            came.append(at)
            now.append(value + row[s])
        back.append(came)
        best = now
    state = max(states, key=lambda s: (best[s], -s))
    out = [state]
    for came in reversed(back):
        state = came[state]
        out.append(state)
    return out[::-1]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], states: int = 2, *, rounds: int = 100, rate: float = 0.1, penalty: float = 1e-3, longest: int = 40) -> Chain:
    """Fit on labelled sequences (places x features); those longer than ``longest`` are cut into pieces of it."""
    cut = [(x[i : i + longest], y[i : i + longest]) for x, y in zip(sequences, labels) for i in range(0, len(x), longest)]
    width = sequences[0].shape[1]
    flat = np.concatenate([x for x, _ in cut])
    centre, scale = flat.mean(0), np.maximum(flat.std(0), 1e-6)
    n, t = len(cut), max(len(x) for x, _ in cut)
    x = np.zeros((n, t, width + 1))
    y = np.zeros((n, t), np.int64)
    live = np.zeros((n, t))
    for i, (a, b) in enumerate(cut):
        x[i, : len(a), :width] = np.clip((a - centre) / scale, -6, 6)
        x[i, : len(a), width] = 1
        y[i, : len(a)] = b
        live[i, : len(a)] = 1
    one = np.eye(states)[y] * live[..., None]
    seen_step = np.einsum("nts,ntr->sr", one[:, :-1], one[:, 1:])
    theta = [np.zeros((width + 1, states)), np.zeros((states, states)), np.zeros(states)]
    m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for k in range(1, rounds + 1):
        w, step, start = theta
        e = x @ w
        forward = np.zeros((n, t, states))
        forward[:, 0] = start + e[:, 0]
        for j in range(1, t):
            new = _logsum(forward[:, j - 1, :, None] + step, 1) + e[:, j]
            forward[:, j] = np.where(live[:, j, None] > 0, new, forward[:, j - 1])
        total = _logsum(forward[:, -1], 1)
        backward = np.zeros((n, t, states))
        pairs = np.zeros((states, states))
        for j in range(t - 2, -1, -1):
            ahead = step + (e[:, j + 1] + backward[:, j + 1])[:, None, :]
            on = live[:, j + 1] > 0
            backward[:, j] = np.where(on[:, None], _logsum(ahead, 2), 0)
            pairs += (np.exp(forward[:, j, :, None] + ahead - total[:, None, None]) * on[:, None, None]).sum(0)
        at = np.exp(forward + backward - total[:, None, None]) * live[..., None]
        grads = [np.einsum("ntf,nts->fs", x, at - one) / live.sum() + penalty * w, (pairs - seen_step) / live.sum() + penalty * step, (at[:, 0] - one[:, 0]).sum(0) / live.sum() + penalty * start]
        for p, g, a, b in zip(theta, grads, m, v):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
    return Chain(theta[0], theta[1], theta[2], centre, scale)
