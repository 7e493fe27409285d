"""Eigendecompositions that are kept up to date by rank-one terms (small matrices, inside one task)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(float).eps
_STEPS = 100


def secular_roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_i^2 / (p_i - x) for ascending, distinct poles and z without zeros.

    Root j lies between pole j and the next (the last one below the last pole plus |z|^2). Returns the roots and the
    matrix root_j - pole_i, which is exact to the last bits, as each root is sought as a distance from its nearer pole.
    """
    k = len(poles)
    squares = z * z
    ends = np.append(poles[1:], poles[-1] + squares.sum())
    gaps = ends - poles
    apart = poles[:, None] - poles[None, :]  # pole i less pole j
    middle = 1 + np.sum(squares[:, None] / (apart - gaps[None, :] / 2), axis=0)
    upper = (middle < 0) & (np.arange(k) < k - 1)  # the root is nearer to the next pole
    origin = np.where(upper, np.minimum(np.arange(k) + 1, k - 1), np.arange(k))
    distance = poles[:, None] - poles[origin][None, :]  # pole i less the origin of root j
    low = np.where(upper, -gaps / 2, np.where(middle < 0, gaps / 2, 0.0))
    high = np.where(upper, 0.0, np.where(middle < 0, gaps, gaps / 2))
    left, right = distance[np.arange(k), np.arange(k)], np.where(upper, 0.0, gaps)
    below = np.arange(k)[:, None] <= np.arange(k)[None, :]
    at = (low + high) / 2
    todo = np.ones(k, dtype=bool)
    for _ in range(_STEPS):
        ratio = z[:, None] / (distance - at[None, :])
        terms = squares[:, None] / (distance - at[None, :])
        slopes = ratio * ratio
        value = 1 + terms.sum(axis=0)
        todo &= np.abs(value) > 4 * _EPS * k * (1 + np.abs(terms).sum(axis=0))
        low, high = np.where(todo & (value < 0), at, low), np.where(todo & (value > 0), at, high)
        todo &= high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if not todo.any():
            break
        psi, phi = np.where(below, slopes, 0).sum(axis=0), np.where(below, 0, slopes).sum(axis=0)
        a, b = left - at, right - at  # the two poles around the root, seen from here
        rest = value - a * psi - b * phi
        p, q = a * a * psi, b * b * phi
        # rest + p / (left - x) + q / (right - x) = 0, a quadratic equation for the step from here
        linear = rest * (a + b) + p + q
        constant = rest * a * b + p * b + q * a
        root = np.sqrt(np.maximum(linear * linear - 4 * rest * constant, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(linear > 0, 2 * constant / (linear + root), (linear - root) / (2 * rest))
        new = at + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        at = np.where(todo, np.where(inside, new, (low + high) / 2), at)
    away = at[None, :] - distance
    away = np.where(away == 0, np.finfo(float).tiny, away)
    return poles[origin] + at, away


@dataclass
class Spectrum:
    """n vectors: their mean, and eigenvalues and eigenvectors (columns) of the sum of squares about it."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> "Spectrum":
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, vector: np.ndarray) -> None:
        """One more vector: a rank-one term along its distance from the mean so far."""
        away = vector - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.rank_one(away * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: "Spectrum") -> None:
        """The vectors of another spectrum: a rank-one term for each of its eigenpairs, and one for the means' distance."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.rank_one(np.sqrt(value) * vector)
        n, away = self.n + other.n, other.mean - self.mean
        if self.n:
            self.rank_one(away * np.sqrt(self.n * other.n / n))
        self.mean, self.n = self.mean + away * (other.n / n), n

    def rank_one(self, term: np.ndarray) -> None:
        """Adds the outer product of a vector with itself."""
        z = self.vectors.T @ term
        norm = float(z @ z)
        if norm == 0:
            return
        scale = max(float(self.values[-1]), norm)
        self._deflate_equal(z, scale)
        on = np.abs(z) * np.sqrt(norm) > 8 * _EPS * scale  # the other eigenpairs do not feel the term
        if not on.any():
            return
        poles = self.values[on]
        roots, away = secular_roots(poles, z[on])
        # weights for which these roots are exact keep the vectors orthogonal
        size = len(poles)
        apart = poles[None, :] - poles[:, None]
        np.fill_diagonal(apart, 1.0)
        logs = np.log(np.abs(away)).sum(axis=1) - np.log(np.abs(apart)).sum(axis=1)
        weights = np.where(z[on] < 0, -1.0, 1.0) * np.exp(logs / 2)
        turn = weights[:, None] / away
        turn /= np.sqrt((turn * turn).sum(axis=0))[None, :]
        self.values[on] = np.maximum(roots, 0)
        self.vectors[:, on] = self.vectors[:, on] @ turn if size > 1 else self.vectors[:, on]
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _deflate_equal(self, z: np.ndarray, scale: float) -> None:
        """Turns the vectors of (nearly) equal eigenvalues so that only the last of them meets the term."""
        equal = np.diff(self.values) <= 8 * _EPS * scale
        start = 0
        while start < len(z):
            end = start + 1
            while end < len(z) and equal[end - 1]:
                end += 1
            if end - start > 1:
                part = z[start:end]
                length = np.sqrt(part @ part)
                if length > 0:
                    mirror = part.copy()
                    mirror[-1] += length if mirror[-1] >= 0 else -length
                    mirror /= np.sqrt(mirror @ mirror)
                    block = self.vectors[:, start:end]
                    self.vectors[:, start:end] = block - 2 * np.outer(block @ mirror, mirror)
                    z[start:end - 1], z[end - 1] = 0.0, -length if part[-1] >= 0 else length
                self.values[start:end] = self.values[start:end].mean()
            start = end
