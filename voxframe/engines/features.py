"""Feature channels of a patch: intensity, self-similarity, samples of channels, and side-by-side stacks."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

from voxframe.engines import arrays as A


def normalise_channels(x: np.ndarray, method: str = "l2") -> np.ndarray:
    """Each voxel's channels by length (l2), to mean 0 and deviation 1 (standard), or as they are (none)."""
    if method == "none":
        return x
    if method == "l2":
        return x / np.maximum(np.sqrt((x * x).sum(0, keepdims=True)), 1e-6)
    if method == "standard":
        return (x - x.mean(0, keepdims=True)) / np.maximum(x.std(0, keepdims=True), 1e-6)
    raise ValueError(f"no normalisation {method!r}")


class Extractor:
    """(z, y, x) to (channels, z, y, x); `reach` is how far a voxel's features look."""

    channels, reach = 1, 0

    def __call__(self, patch: np.ndarray) -> np.ndarray:
        return patch[None]

    def aligned(self, low: int, size: int) -> tuple[int, int]:
        """The interval that must be read so that features do not depend on where a chunk begins."""
        return low - self.reach, size + 2 * self.reach


#: The local variance counts as no less and no more than the patch's mean one divided, or multiplied, by this.
SPREAD_RANGE = 1000.0


class SelfSimilarity(Extractor):
    """Twelve channels: how unlike the patches around pairs of neighbours are, relative to the local variance."""

    channels = 12

    def __init__(self, radius: int = 1, dilation: int = 2, method: str = "l2") -> None:
        self.radius, self.dilation, self.method = radius, dilation, method
        self.reach = dilation + radius

    def __call__(self, patch: np.ndarray) -> np.ndarray:
        d, box = self.dilation, np.full(2 * self.radius + 1, 1.0 / (2 * self.radius + 1))
        wide = np.pad(patch.astype(float), d, mode="edge")
        around = {}
        for axis, sign in itertools.product(range(3), (-1, 1)):
            pick = [slice(d, d + n) for n in patch.shape]
            pick[axis] = slice(d + sign * d, d + sign * d + patch.shape[axis])
            around[axis, sign] = wide[tuple(pick)]
        pairs = [(p, q) for p, q in itertools.combinations(around, 2) if p[0] != q[0]]
        distance = np.stack([A.separable((around[p] - around[q]) ** 2, box) for p, q in pairs])
        spread = distance.mean(0)
        usual = max(float(spread.mean()), 1e-12)
        spread = np.clip(spread, usual / SPREAD_RANGE, usual * SPREAD_RANGE)
        out = np.exp(-distance / spread)
        return normalise_channels(out / np.maximum(out.max(0, keepdims=True), 1e-8), self.method)


class Combined(Extractor):
    """Several extractors side by side, the channels of some of them sampled anew for each pass."""

    def __init__(self, parts: list[Extractor], method: str = "l2") -> None:
        self.parts, self.method = parts, method
        self.channels, self.reach = sum(p.channels for p in parts), max(p.reach for p in parts)

    def __call__(self, patch: np.ndarray) -> np.ndarray:
        return normalise_channels(np.concatenate([p(patch) for p in self.parts]), self.method)


class Sampled(Extractor):
    """k channels of another extractor, drawn for a pass."""

    def __init__(self, inner: Extractor, k: int, seed: int = 0, depth: int = 0, iteration: int = 0) -> None:
        self.inner, self.channels, self.reach = inner, k, inner.reach
        self.pick = stratified_pick([inner.channels], k, seed, depth, iteration)

    def __call__(self, patch: np.ndarray) -> np.ndarray:
        return self.inner(patch)[self.pick]


def stratified_pick(groups: list[int], k: int, seed: int, depth: int, iteration: int) -> np.ndarray:
    """k of all channels, shared among groups in proportion (largest remainders first), drawn inside each group."""
    total = sum(groups)
    if k >= total:
        return np.arange(total)
    exact = [k * g / total for g in groups]
    quota = [int(e) for e in exact]
    for i in sorted(range(len(groups)), key=lambda i: (quota[i] - exact[i], i))[: k - sum(quota)]:
        quota[i] += 1
    rng, out, start = np.random.default_rng([seed, depth, iteration]), [], 0
    for g, q in zip(groups, quota, strict=True):
        out += sorted((start + rng.choice(g, q, replace=False)).tolist())
        start += g
    return np.array(out, np.int64)


EXTRACTORS: dict[str, Callable[[], Extractor]] = {"intensity": Extractor, "mind": SelfSimilarity}


def extractor(spec: str, seed: int = 0, depth: int = 0, iteration: int = 0) -> Extractor:
    """An extractor from its spec: names joined by +, @k for a sample of k of its channels (intensity+mind@6)."""
    parts = []
    for word in spec.split("+"):
        name, _, k = word.strip().partition("@")
        if name not in EXTRACTORS:
            raise ValueError(f"no features {name!r}; there are {sorted(EXTRACTORS)}")
        one = EXTRACTORS[name]()
        parts.append(Sampled(one, int(k), seed, depth, iteration) if k else one)
    return parts[0] if len(parts) == 1 else Combined(parts)


def receptive_field(make: Extractor, size: int = 24, threshold: float = 0.01, seed: int = 0) -> int:
    """How far a change of the middle voxel is felt above a share of its peak."""
    base = np.random.default_rng(seed).random((size,) * 3)
    other = base.copy()
    mid = size // 2
    other[mid, mid, mid] += 1
    delta = np.abs(make(other) - make(base)).max(0)
    at = np.argwhere(delta > threshold * delta.max())
    return int(np.abs(at - mid).max())


def principal(cov: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n main directions (n, channels) of a covariance, their signs fixed, and the shares of variance."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:n]
    basis = vectors[:, order].T
    basis = basis * np.where(basis[np.arange(len(basis)), np.abs(basis).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return basis, values[order] / max(float(values.sum()), 1e-30)
