"""Hashed n-gram features and linear classifiers, for languages and quality."""

from __future__ import annotations

import numpy as np

#: Odd multipliers that mix the code points of an n-gram, one for each place.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)
#: Code points whose n-grams are hashed in one step.
STEP = 1 << 20
_POWER_BASE = 0x9E3779B97F4A7C15 | 1


def ngram_slots(points: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Slot of each n-gram; ``slots`` is a power of two."""
    if len(points) < n:
        return np.empty(0, dtype=np.uint32)
    mixed = np.full(len(points) - n + 1, n * 0x9E37, dtype=np.uint32)
    for i in range(n):
        part = points[i : len(points) - n + 1 + i] * _MIX[i]
        part ^= part >> np.uint32(15)
        mixed = (mixed ^ part) * _MIX[(i + 1) % len(_MIX)]
    return mixed >> np.uint32(33 - slots.bit_length())


def counted(points: np.ndarray, orders: tuple[int, ...], slots: int) -> np.ndarray:
    """Counts of hashed n-grams of all orders; long arrays are counted in overlapping steps."""
    total = np.zeros(slots, dtype=np.int64)
    for n in orders:
        for start in range(0, max(1, len(points) - n + 1), STEP):
            found = ngram_slots(points[start : start + STEP + n - 1], n, slots)
            total += np.bincount(found, minlength=slots)
    return total


def word_keys(points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit key, the start and the end of each run of ``inside`` code points."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_keys(points, starts, ends), starts, ends


def span_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span of code points.

    Keys are polynomials in an odd base, taken from one running sum: the sum
    over a span, divided by the base to the power of its start.
    """
    up, down = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    keys = (sums[ends] - sums[starts]) * down[starts]
    keys ^= keys >> np.uint64(31)
    return keys * np.uint64(0xBF58476D1CE4E5B9)


_tables: dict[str, np.ndarray] = {}


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < length:
        size = max(1 << 16, 1 << (length - 1).bit_length())
        inverse = pow(_POWER_BASE, -1, 1 << 64)
        for name, base in (("up", _POWER_BASE), ("down", inverse)):
            table = np.ones(size, dtype=np.uint64)
            done, factor = 1, base
            while done < size:
                table[done : 2 * done] = table[:done] * np.uint64(factor)
                done, factor = 2 * done, factor * factor % (1 << 64)
            _tables[name] = table
    return _tables["up"], _tables["down"]


def scaled(counts: np.ndarray) -> np.ndarray:
    """Rows of square roots of counts, scaled to length one."""
    roots = np.sqrt(counts.astype(np.float32))
    length = np.sqrt((roots * roots).sum(axis=-1, keepdims=True))
    return roots / np.maximum(length, 1e-9)


def logistic(rows: np.ndarray, bits: np.ndarray, steps: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic classifier per column of ``bits`` (0 or 1).

    All columns are fitted at once by Adam on the whole sample; classes of a
    column weigh the same. Everything is fixed, so reruns agree.
    """
    weights = np.zeros((rows.shape[1], bits.shape[1]), dtype=np.float32)
    bias = np.zeros(bits.shape[1], dtype=np.float32)
    share = np.clip(bits.mean(axis=0), 1e-3, 1 - 1e-3)
    each = np.where(bits == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    moments = [np.zeros_like(p) for p in (weights, weights, bias, bias)]
    for step in range(1, steps + 1):
        slope = (sigmoid(rows @ weights + bias) - bits) * each / len(rows)
        for p, g, m, v in (
            (weights, rows.T @ slope + decay * weights, moments[0], moments[1]),
            (bias, slope.sum(axis=0), moments[2], moments[3]),
        ):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights, bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def platt(margins: np.ndarray, truth: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities, by damped Newton steps on smoothed labels."""
    up, down = truth.sum(), len(truth) - truth.sum()
    goal = np.where(truth == 1, (up + 1) / (up + 2), 1 / (down + 2))
    design = np.stack([margins, np.ones_like(margins)], axis=1).astype(np.float64)
    start = np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = design @ at
        return float((np.logaddexp(0, z) - goal * z).sum() + 5e-4 * ((at - start) ** 2).sum())

    found = start
    for _ in range(steps):
        p = sigmoid(design @ found)
        slope = design.T @ (p - goal) + 1e-3 * (found - start)
        bend = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        while np.abs(step).max() > 1e-9 and loss(found - step) > loss(found):
            step = step / 2
        found = found - step
    return float(found[0]), float(found[1])


def with_share(shift: float, seen: float, share: float) -> float:
    """A shift for a population in which label 1 is as common as ``share``, not as in the sample."""
    seen, share = (float(np.clip(x, 0.01, 0.99)) for x in (seen, share))
    return shift + float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
