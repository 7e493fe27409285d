"""A character tagger in numpy: bidirectional LSTM, CRF transitions, trained by gradient descent.

Windows are arrays (batch, time) of character classes, padded at the end with class 0. Everything here is small
and runs inside one task or on the driver; texts come in through `pii`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EACH = " \n.,:;@+-_()[]/\\%#*&$!?='\"<>|"
PAD, OTHER, DIGIT, LOWER, UPPER, LETTER = range(6)
N_CLASSES = 6 + len(_EACH)
#: Gradients are scaled down to this length.
LARGEST_STEP = 5.0
_TABLE = np.full(128, OTHER, dtype=np.int8)
_TABLE[[ord(c) for c in "0123456789"]] = DIGIT
_TABLE[ord("a"):ord("z") + 1], _TABLE[ord("A"):ord("Z") + 1] = LOWER, UPPER
_TABLE[[ord(c) for c in _EACH]] = 6 + np.arange(len(_EACH))


def classes(text: str) -> np.ndarray:
    """The class of every character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], LETTER).astype(np.int8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Weights; the first axis of the recurrent ones is the direction."""

    inputs: np.ndarray  # (2, classes, 4 hidden)
    recurrent: np.ndarray  # (2, hidden, 4 hidden)
    output: np.ndarray  # (2 hidden, tags)
    bias: np.ndarray  # tags
    start: np.ndarray  # tags
    transitions: np.ndarray  # (tags, tags)

    @classmethod
    def random(cls, n_tags: int, hidden: int, rng: np.random.Generator) -> "Tagger":
        inputs = rng.normal(scale=0.3, size=(2, N_CLASSES, 4 * hidden))
        inputs[:, :, hidden:2 * hidden] += 1.0  # remember by default
        return cls(inputs, rng.normal(scale=0.5 / np.sqrt(hidden), size=(2, hidden, 4 * hidden)),
                   rng.normal(scale=0.3 / np.sqrt(hidden), size=(2 * hidden, n_tags)), np.zeros(n_tags), np.zeros(n_tags),
                   np.zeros((n_tags, n_tags)))

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.output, self.bias, self.start, self.transitions]

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Scores (batch, time, tags); with `keep` also what the gradient needs."""
        n, length = x.shape
        hidden = self.recurrent.shape[1]
        both = np.stack([x, x[:, ::-1]])
        on = (both != PAD)[..., None].astype(float)
        pre = np.stack([self.inputs[d][both[d]] for d in range(2)])
        h, c = np.zeros((2, n, hidden)), np.zeros((2, n, hidden))
        seen, kept = np.empty((2, n, length, hidden)), []
        for t in range(length):
            z = pre[:, :, t] + h @ self.recurrent
            gates, g = _sigmoid(z[..., :3 * hidden]), np.tanh(z[..., 3 * hidden:])
            i, f, o = gates[..., :hidden], gates[..., hidden:2 * hidden], gates[..., 2 * hidden:]
            before = (h, c)
            c = (f * c + i * g) * on[:, :, t]
            tanh_c = np.tanh(c)
            h = o * tanh_c * on[:, :, t]
            seen[:, :, t] = h
            if keep:
                kept.append((*before, i, f, o, g, tanh_c))
        features = np.concatenate([seen[0], seen[1][:, ::-1]], axis=2)
        scores = features @ self.output + self.bias
        return (scores, features, both, on, kept) if keep else scores

    def _chain(self, scores: np.ndarray, on: np.ndarray):
        """Scaled forward and backward sums of the CRF, the potentials they use, and the log of the total."""
        n, length, tags = scores.shape
        top = scores.max(axis=2, keepdims=True)
        potential, step = np.exp(scores - top), np.exp(self.transitions)
        alpha, beta = np.empty((n, length, tags)), np.ones((n, length, tags))
        scale = np.ones((n, length, 1))
        now = np.exp(self.start) * potential[:, 0]
        for t in range(length):
            if t:
                now = np.where(on[:, t, None], (now @ step) * potential[:, t], now)
            scale[:, t] = now.sum(axis=1, keepdims=True)
            now = now / scale[:, t]
            alpha[:, t] = now
        for t in range(length - 2, -1, -1):
            ahead = (beta[:, t + 1] * potential[:, t + 1]) @ step.T
            beta[:, t] = np.where(on[:, t + 1, None], ahead / ahead.sum(axis=1, keepdims=True), beta[:, t + 1])
        total = np.log(scale).sum(axis=(1, 2)) + (top[..., 0] * on).sum(axis=1)
        return alpha, beta, potential, step, total

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """The probability of every tag at every character."""
        alpha, beta, *_ = self._chain(self.emissions(x), x != PAD)
        both = alpha * beta
        return both / both.sum(axis=2, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean negative log likelihood of the tags y, and its gradient by every weight."""
        scores, features, both, on, kept = self.emissions(x, keep=True)
        n, length, tags = scores.shape
        inside = x != PAD
        alpha, beta, potential, step, total = self._chain(scores, inside)
        marginal = alpha * beta
        marginal /= marginal.sum(axis=2, keepdims=True)
        gold = np.eye(tags)[y]
        pairs = inside[:, 1:]
        reached = alpha[:, :-1, :, None] * step * (potential[:, 1:] * beta[:, 1:])[:, :, None, :]
        reached /= reached.sum(axis=(2, 3), keepdims=True)
        met = (reached * pairs[..., None, None]).sum(axis=(0, 1))
        met_gold = np.zeros((tags, tags))
        np.add.at(met_gold, (y[:, :-1][pairs], y[:, 1:][pairs]), 1.0)
        of_path = (np.take_along_axis(scores, y[..., None], 2)[..., 0] * inside).sum(axis=1) + self.start[y[:, 0]]
        of_path += (self.transitions[y[:, :-1], y[:, 1:]] * pairs).sum(axis=1)
        d_scores = (marginal - gold) * inside[..., None] / n
        d_features = d_scores @ self.output.T
        grads = [np.zeros_like(self.inputs), np.zeros_like(self.recurrent), np.einsum("bth,btk->hk", features, d_scores),
                 d_scores.sum(axis=(0, 1)), (marginal[:, 0] - gold[:, 0]).sum(axis=0) / n, (met - met_gold) / n]
        hidden = self.recurrent.shape[1]
        d_seen = np.stack([d_features[..., :hidden], d_features[:, ::-1, hidden:]])
        known = np.eye(N_CLASSES)[both]
        d_h, d_c = np.zeros((2, n, hidden)), np.zeros((2, n, hidden))
        for t in range(length - 1, -1, -1):
            h0, c0, i, f, o, g, tanh_c = kept[t]
            m = on[:, :, t]
            d_h = (d_h + d_seen[:, :, t]) * m
            d_c = (d_c + d_h * o * (1 - tanh_c * tanh_c)) * m
            d_z = np.concatenate([d_c * g * i * (1 - i), d_c * c0 * f * (1 - f), d_h * tanh_c * o * (1 - o), d_c * i * (1 - g * g)], axis=2)
            for d in range(2):
                grads[0][d] += known[d, :, t].T @ d_z[d]
            grads[1] += h0.transpose(0, 2, 1) @ d_z
            d_h, d_c = d_z @ self.recurrent.transpose(0, 2, 1), d_c * f
        return float((total - of_path).mean()), grads


def train(x: np.ndarray, y: np.ndarray, n_tags: int, hidden: int, steps: int, batch: int, rate: float, seed: int) -> Tagger:
    """Adam over random batches; the rate falls to a tenth along a cosine."""
    rng = np.random.default_rng(seed)
    model = Tagger.random(n_tags, hidden, rng)
    first = [np.zeros_like(w) for w in model.weights()]
    second = [np.zeros_like(w) for w in model.weights()]
    for k in range(1, steps + 1):
        pick = rng.integers(0, len(x), size=min(batch, len(x)))
        used = int((x[pick] != PAD).any(axis=0).sum())
        _, grads = model.gradient(x[pick, :used], y[pick, :used])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * (0.55 + 0.45 * np.cos(np.pi * k / steps))
        for w, g, a, b in zip(model.weights(), grads, first, second):
            g = g * min(1.0, LARGEST_STEP / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= now * (a / (1 - 0.9 ** k)) / (np.sqrt(b / (1 - 0.99 ** k)) + 1e-8)
    return model


def best_path(log_posteriors: np.ndarray, allowed: np.ndarray, may_start: np.ndarray) -> np.ndarray:
    """The likeliest tag sequence (time,) among those whose steps are allowed."""
    length, tags = log_posteriors.shape
    step = np.where(allowed, 0.0, -np.inf)
    came = np.zeros((length, tags), dtype=np.int8)
    now = log_posteriors[0] + np.where(may_start, 0.0, -np.inf)
    for t in range(1, length):
        through = now[:, None] + step
        came[t] = through.argmax(axis=0)
        now = through[came[t], np.arange(tags)] + log_posteriors[t]
    out = np.zeros(length, dtype=np.int8)
    out[-1] = now.argmax()
    for t in range(length - 1, 0, -1):
        out[t - 1] = came[t, out[t]]
    return out
