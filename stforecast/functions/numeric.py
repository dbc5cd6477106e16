"""Numpy helpers used inside grouped Spark tasks."""

from __future__ import annotations

import numpy as np

# Seeded draws use integer arithmetic modulo this prime, so the same seed gives the
# same value in any engine, for any partitioning, and after a lost task is re-run.
PRIME = 2147483647
KEY_FACTORS = (7919, 104729, 1299709, 15485863, 32452843, 49979687)
MIX_SHIFTS = (48271, 69621)


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y), linear beyond the ends."""
    n = len(x)
    if n == 1:
        return np.full(len(at), y[0])
    h = np.diff(x)
    slope = np.diff(y) / h
    curv = np.zeros(n)
    if n > 2:
        # tridiagonal system for the interior second derivatives
        diag = 2.0 * (h[:-1] + h[1:])
        rhs = 6.0 * np.diff(slope)
        for i in range(1, n - 2):
            f = h[i] / diag[i - 1]
            diag[i] -= f * h[i]
            rhs[i] -= f * rhs[i - 1]
        curv[n - 2] = rhs[-1] / diag[-1]
        for i in range(n - 4, -1, -1):
            curv[i + 1] = (rhs[i] - h[i + 1] * curv[i + 2]) / diag[i]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    b = (at - x[k]) / h[k]
    a = 1.0 - b
    inside = a * y[k] + b * y[k + 1] + (
        (a**3 - a) * curv[k] + (b**3 - b) * curv[k + 1]
    ) * h[k] ** 2 / 6.0
    left = y[0] + (at - x[0]) * (slope[0] - h[0] * (2 * curv[0] + curv[1]) / 6.0)
    right = y[-1] + (at - x[-1]) * (slope[-1] + h[-1] * (curv[-2] + 2 * curv[-1]) / 6.0)
    return np.where(at < x[0], left, np.where(at > x[-1], right, inside))


def ridge_solutions(gram: np.ndarray, cross: np.ndarray, ridges) -> list[np.ndarray]:
    """``cross (gram + r I)^-1`` for every r, each solved alone: the list does not matter."""
    eye = np.eye(gram.shape[0])
    return [np.linalg.solve(gram + r * eye, cross.T).T for r in ridges]


def squared_evens(x: np.ndarray) -> np.ndarray:
    """Copy with entries 2, 4, ... of the last axis squared."""
    z = np.array(x, dtype=float, copy=True)
    z[..., 1::2] **= 2
    return z


def padded_terms(terms) -> np.ndarray:
    """Index lists of monomials as one array, short ones padded with -1 (a constant one)."""
    width = max((len(t) for t in terms), default=0)
    out = np.full((len(terms), max(width, 1)), -1)
    for f, term in enumerate(terms):
        out[f, : len(term)] = term
    return out


def monomials(lin: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Products of the chosen linear terms for every row of ``lin``."""
    lin = np.concatenate([lin, np.ones((*lin.shape[:-1], 1))], axis=-1)
    out = lin[..., terms[:, 0]]
    for k in range(1, terms.shape[1]):
        out = out * lin[..., terms[:, k]]
    return out


def seeded_normal_array(*parts) -> np.ndarray:
    """The draws of ``columns.seeded_normal`` for arrays of keys."""

    def uniform(*keys) -> np.ndarray:
        x = np.int64(12345)
        for factor, key in zip(KEY_FACTORS, keys, strict=False):
            x = x + np.asarray(key, dtype=np.int64) % PRIME * np.int64(factor)
        x = x % PRIME
        for shift in MIX_SHIFTS:
            x = (x * x + x * np.int64(shift) + 11) % PRIME
        return (x + 0.5) / PRIME

    return np.sqrt(-2.0 * np.log(uniform(*parts, 1))) * np.cos(2.0 * np.pi * uniform(*parts, 2))


class LeakyNet:
    """Weights of one recurrent net: ``levels`` of (input, recurrent, leak)."""

    def __init__(self, sizes, leaks, n_inputs, level, kind, i, j, w):
        self.sizes = [int(s) for s in sizes]
        self.leaks = [float(a) for a in leaks]
        level, kind, i, j, w = (np.asarray(v) for v in (level, kind, i, j, w))
        self.inputs, self.recurrent = [], []
        for l, size in enumerate(self.sizes):
            fan_in = int(n_inputs) if l == 0 else self.sizes[l - 1]
            for store, code, width in ((self.recurrent, 0, size), (self.inputs, 1, fan_in)):
                m = np.zeros((size, width))
                pick = (level == l) & (kind == code)
                m[i[pick].astype(int), j[pick].astype(int)] = w[pick].astype(float)
                store.append(m)

    def start(self, copies: int | None = None) -> list[np.ndarray]:
        return [np.zeros(s if copies is None else (s, copies)) for s in self.sizes]

    def drive(self, u: np.ndarray) -> np.ndarray:
        """First-level input term for a stack of input rows."""
        return u @ self.inputs[0].T

    def advance(self, state: list[np.ndarray], drive: np.ndarray) -> list[np.ndarray]:
        """One step; a deeper level sees this step's state of the level above it."""
        out = []
        for l, x in enumerate(state):
            push = drive if l == 0 else self.inputs[l] @ out[l - 1]
            a = self.leaks[l]
            out.append((1.0 - a) * x + a * np.tanh(self.recurrent[l] @ x + push))
        return out


class NetStack:
    """Nets of equal sizes that read the same inputs and advance as stacked products."""

    def __init__(self, nets: list[LeakyNet]):
        self.sizes, self.count = nets[0].sizes, len(nets)
        self.units = sum(self.sizes)
        levels = range(len(self.sizes))
        self.inputs = [np.stack([net.inputs[l] for net in nets]) for l in levels]
        self.recurrent = [np.stack([net.recurrent[l] for net in nets]) for l in levels]
        self.leaks = [np.array([[net.leaks[l]] for net in nets]) for l in levels]

    def start(self) -> list[np.ndarray]:
        return [np.zeros((self.count, s)) for s in self.sizes]

    def drive(self, u: np.ndarray) -> np.ndarray:
        """First-level input terms (steps, nets, units) of a stack of input rows."""
        flat = self.inputs[0].reshape(-1, self.inputs[0].shape[2])
        return (u @ flat.T).reshape(len(u), self.count, self.sizes[0])

    def advance(self, state: list[np.ndarray], drive: np.ndarray) -> list[np.ndarray]:
        """One step of all nets; a deeper level sees this step's state of the level above it."""
        out = []
        for l, x in enumerate(state):
            push = drive if l == 0 else (self.inputs[l] @ out[l - 1][:, :, None])[:, :, 0]
            inner = (self.recurrent[l] @ x[:, :, None])[:, :, 0] + push
            out.append((1.0 - self.leaks[l]) * x + self.leaks[l] * np.tanh(inner))
        return out
