"""Zarr arrays and OME multiscale metadata, read with the standard library, NumPy and zstandard.

A store is read through a function from a key to bytes (None if absent), so it may lie anywhere. Chunks are plain,
gzip, zlib or zstd; other compressors are refused by name.
"""

from __future__ import annotations

import gzip
import itertools
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from voxframe.functions.scalar import MICROMETRES

Get = Callable[[str], bytes | None]


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


UNPACK: dict[str, Callable[[bytes], bytes]] = {"gzip": gzip.decompress, "zlib": zlib.decompress, "zstd": _zstd}


@dataclass
class ZarrArray:
    """A lazy array: boxes are assembled from the chunks that they meet."""

    get: Get
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    fill: float
    key: Callable[[tuple[int, ...]], str]
    unpack: tuple[str, ...] = ()
    order: str = "C"
    names: tuple[str, ...] | None = None

    def chunk(self, at: tuple[int, ...]) -> np.ndarray:
        raw = self.get(self.key(at))
        if raw is None:
            return np.full(self.chunks, self.fill, self.dtype)
        for kind in self.unpack:
            raw = UNPACK[kind](raw)
        return np.frombuffer(raw, self.dtype).reshape(self.chunks, order=self.order)

    def box(self, low: tuple[int, ...], high: tuple[int, ...]) -> np.ndarray:
        """The voxels of a half-open box, cut at the array's ends."""
        low, high = tuple(max(0, a) for a in low), tuple(min(n, b) for n, b in zip(self.shape, high, strict=True))
        out = np.full([max(0, b - a) for a, b in zip(low, high, strict=True)], self.fill, self.dtype)
        for at in itertools.product(*[range(a // c, -(-b // c)) for a, b, c in zip(low, high, self.chunks, strict=True)]):
            start = [i * c for i, c in zip(at, self.chunks, strict=True)]
            first, last = [max(a, s) for a, s in zip(low, start, strict=True)], [min(b, s + c) for b, s, c in zip(high, start, self.chunks, strict=True)]
            here = tuple(slice(f - a, e - a) for f, e, a in zip(first, last, low, strict=True))
            out[here] = self.chunk(at)[tuple(slice(f - s, e - s) for f, e, s in zip(first, last, start, strict=True))]
        return out

    def boxes(self) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
        """The chunks' boxes: a task each."""
        for at in itertools.product(*[range(-(-n // c)) for n, c in zip(self.shape, self.chunks, strict=True)]):
            low = tuple(i * c for i, c in zip(at, self.chunks, strict=True))
            yield low, tuple(min(n, a + c) for n, a, c in zip(self.shape, low, self.chunks, strict=True))


def _known(kinds: list[str]) -> tuple[str, ...]:
    if strange := [k for k in kinds if k not in UNPACK]:
        raise ValueError(f"chunks packed with {', '.join(strange)} are not read")
    return tuple(kinds)


def open_array(get: Get) -> ZarrArray:
    """The array whose metadata lies at the root of a store, version 2 or 3."""
    if (raw := get("zarr.json")) is not None:
        m = json.loads(raw)
        if m.get("node_type") != "array":
            raise ValueError("a group, not an array")
        order, kinds = "<", []
        for codec in m["codecs"]:
            if codec["name"] == "bytes":
                order = ">" if codec.get("configuration", {}).get("endian") == "big" else "<"
            elif codec["name"] != "crc32c":
                kinds.insert(0, codec["name"])
        how = m.get("chunk_key_encoding", {"name": "default"})
        join = how.get("configuration", {}).get("separator", "/" if how["name"] == "default" else ".")
        head = ["c"] if how["name"] == "default" else []
        return ZarrArray(get, tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), np.dtype(m["data_type"]).newbyteorder(order), m.get("fill_value") or 0, lambda at: join.join([*head, *map(str, at)]), _known(kinds), names=tuple(m["dimension_names"]) if m.get("dimension_names") else None)
    if (raw := get(".zarray")) is None:
        raise ValueError("no array here")
    m = json.loads(raw)
    packed = m.get("compressor")
    kinds = [packed["id"]] if packed else []
    join = m.get("dimension_separator", ".")
    return ZarrArray(get, tuple(m["shape"]), tuple(m["chunks"]), np.dtype(m["dtype"]), m.get("fill_value") or 0, lambda at: join.join(map(str, at)), _known(kinds), m.get("order", "C"))


# --- multiscale metadata ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dataset:
    """One level of a multiscale image: where it is, its voxel size and first voxel (um; z, y, x)."""

    path: str
    scale_um: tuple[float, float, float] | None
    translation_um: tuple[float, float, float]


def axes(multiscale: dict) -> list[tuple[str, str | None]]:
    """(name, unit) of each axis, from `axes` or, in newer files, from the first coordinate system."""
    listed = multiscale.get("axes") or next((s["axes"] for s in multiscale.get("coordinateSystems", [])), None)
    if listed is None:
        return [(n, None) for n in "tczyx"]
    return [(a, None) if isinstance(a, str) else (a["name"], a.get("unit")) for a in listed]


def flattened(transforms: list[dict]) -> list[dict]:
    """Transformations in order, sequences taken apart."""
    out = []
    for t in transforms:
        out += flattened(t["transformations"]) if t.get("type") == "sequence" else [t]
    return out


def spatial(names: list[str], values: list[float]) -> tuple[float, float, float]:
    return tuple(float(values[names.index(a)]) for a in "zyx")


def datasets(attributes: dict) -> list[Dataset]:
    """The levels of the first multiscale image, in the order of the file."""
    whole = attributes.get("ome", attributes)
    scales = whole.get("multiscales")
    if not scales:
        raise ValueError("no multiscale image")
    m = scales[0]
    listed = axes(m)
    names, units = [n for n, _ in listed], dict(listed)
    if any(a not in names for a in "zyx"):
        raise ValueError("an image needs axes z, y and x")
    known = [MICROMETRES.get((units[a] or "").lower()) for a in "zyx"]
    out = []
    for d in m["datasets"]:
        scale, shift, told = np.ones(3), np.zeros(3), False
        for t in flattened([*d.get("coordinateTransformations", []), *m.get("coordinateTransformations", [])]):
            if t.get("type") == "scale":
                s = np.array(spatial(names, t["scale"]))
                scale, shift, told = scale * s, shift * s, True
            elif t.get("type") == "translation":
                shift = shift + np.array(spatial(names, t["translation"]))
        if told and all(known):
            unit = np.array(known, float)
            out.append(Dataset(d["path"], tuple((scale * unit).tolist()), tuple((shift * unit).tolist())))
        else:  # without a unit nothing is known about sizes
            out.append(Dataset(d["path"], None, (0.0, 0.0, 0.0)))
    return out


def volume_box(array: ZarrArray, names: list[str], low: tuple[int, int, int], high: tuple[int, int, int]) -> np.ndarray:
    """A (z, y, x) box of an array with named axes; others must have one entry."""
    for n, size in zip(names, array.shape, strict=True):
        if n not in "zyx" and size != 1:
            raise ValueError(f"axis {n} has {size} entries; one is read")
    where = {a: i for i, a in enumerate("zyx")}
    got = array.box(tuple(low[where[n]] if n in where else 0 for n in names), tuple(high[where[n]] if n in where else 1 for n in names))
    kept = [n for n in names if n in where]
    got = got.reshape([s for n, s in zip(names, got.shape, strict=True) if n in where])
    return got.transpose([kept.index(a) for a in "zyx"])
