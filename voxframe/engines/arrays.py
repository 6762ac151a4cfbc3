"""Array forms of the volume operators, for work inside a padded chunk. Vectors are (3, z, y, x) in millimetres."""

from __future__ import annotations

import numpy as np

from voxframe.operators.stats import FLOOR, SHARE
from voxframe.operators.stencil import gaussian_kernel


def sample(volume: np.ndarray, places: np.ndarray, boundary: str = "constant", cval: float = 0.0) -> np.ndarray:
    """Trilinear values of (..., z, y, x) at places (3, ...): constant outside, or clamped to the ends (nearest)."""
    shape = np.array(volume.shape[-3:])
    far = (shape - 1).reshape(3, *[1] * (places.ndim - 1))
    inside = ((places >= 0) & (places <= far)).all(0)
    at = np.clip(places, 0, far)
    low = np.minimum(np.floor(at).astype(np.int64), np.maximum(far - 1, 0))
    part = at - low
    high = np.minimum(low + 1, far)
    flat = np.ascontiguousarray(volume).reshape(*volume.shape[:-3], -1)
    strides = (int(shape[1] * shape[2]), int(shape[2]), 1)
    keys = [[low[d] * s, high[d] * s] for d, s in enumerate(strides)]
    rest = [[1 - part[d], part[d]] for d in range(3)]
    out = np.zeros(volume.shape[:-3] + places.shape[1:])
    for cz in (0, 1):
        for cy in (0, 1):
            key, weight = keys[0][cz] + keys[1][cy], rest[0][cz] * rest[1][cy]
            for cx in (0, 1):
                out += np.take(flat, key + keys[2][cx], axis=-1) * (weight * rest[2][cx])
    return out if boundary == "nearest" else np.where(inside, out, cval)


def identity(shape: tuple[int, int, int]) -> np.ndarray:
    return np.indices(shape, dtype=float)


def warp(image: np.ndarray, u: np.ndarray, spacing: float, cval: float = 0.0) -> np.ndarray:
    """image(x + u(x)), per channel."""
    return sample(image, identity(u.shape[1:]) + u / spacing, "constant", cval)


def compose(inner: np.ndarray, outer: np.ndarray, spacing: float) -> np.ndarray:
    """inner(x) + outer(x + inner(x)); ends clamp."""
    return inner + sample(outer, identity(inner.shape[1:]) + inner / spacing, "nearest")


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian over the last three axes, ends repeated."""
    if sigma <= 0:
        return a
    kernel = np.array(gaussian_kernel(sigma))
    return separable(a, kernel)


def separable(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The same odd taps along the last three axes, ends repeated."""
    r = len(kernel) // 2
    for axis in range(a.ndim - 3, a.ndim):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        wide, n = np.pad(a, pad, mode="edge"), a.shape[axis]
        at = [slice(None)] * a.ndim
        out = np.zeros(a.shape)
        for i, k in enumerate(kernel):
            at[axis] = slice(i, i + n)
            out += k * wide[tuple(at)]
        a = out
    return a


def clamp(u: np.ndarray, most: float | None) -> np.ndarray:
    """Vectors no longer than `most`, directions kept."""
    if not most or most <= 0:
        return u
    size = np.sqrt((u * u).sum(0))
    return u * np.where(size > most, most / np.maximum(size, 1e-30), 1.0)


def gradients(stack: np.ndarray, spacing: float) -> np.ndarray:
    """(channels, 3, z, y, x); 0 along an axis of one voxel."""
    out = np.zeros((stack.shape[0], 3, *stack.shape[1:]))
    for d in range(3):
        if stack.shape[1 + d] > 1:
            out[:, d] = np.gradient(stack, spacing, axis=1 + d)
    return out


def jacobian(u: np.ndarray, spacing: float) -> np.ndarray:
    g = gradients(u, spacing) + np.eye(3)[:, :, None, None, None]
    return np.linalg.det(np.moveaxis(g, (0, 1), (-2, -1)))


def fold_fraction(u: np.ndarray, spacing: float) -> float:
    return float((jacobian(u, spacing) <= 0).mean())


def pool(a: np.ndarray, factor: int) -> np.ndarray:
    """Means over cubes along the last three axes, ragged ends padded with the last plane."""
    if factor == 1:
        return a
    pad = [(0, 0)] * (a.ndim - 3) + [(0, -n % factor) for n in a.shape[-3:]]
    a = np.pad(a, pad, mode="edge")
    shape = a.shape[:-3] + tuple(x for n in a.shape[-3:] for x in (n // factor, factor))
    return a.reshape(shape).mean((-1, -3, -5))


def resized(u: np.ndarray, shape: tuple[int, int, int], scale: float) -> np.ndarray:
    """A field known on every scale-th voxel (or the reverse) on another lattice."""
    return sample(u, identity(shape) * scale, "nearest")


def local_normalise(a: np.ndarray, radius: int) -> np.ndarray:
    box = np.full(2 * radius + 1, 1.0 / (2 * radius + 1))
    mean = separable(a, box)
    return (a - mean) / (np.sqrt(np.maximum(separable(a * a, box) - mean * mean, 0)) + 1e-6)


def tissue_fraction(a: np.ndarray, threshold: float = 0.0) -> float:
    limit = threshold if threshold > 0 else max(FLOOR, SHARE * float(a.max(initial=0)))
    return float((a > limit).mean()) if a.size else 0.0
