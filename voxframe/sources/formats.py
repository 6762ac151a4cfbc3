"""Volume files read and written with the standard library and NumPy: NIfTI, TIFF stacks, PNG sheets."""

from __future__ import annotations

import gzip
import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

import numpy as np

Read = Callable[[int, int], bytes]

# Fixed values of the NIfTI-1 header: type codes and unit codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
NIFTI_UNITS = {0: 1.0, 1: 1e3, 2: 1.0, 3: 1e-3}
# Fixed values of the TIFF format: sizes of field types and sample formats.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
TIFF_CODES = {1: "B", 3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


@dataclass
class Volume:
    """An array (z, y, x), its voxel size and the place of its first voxel, in mm."""

    data: np.ndarray
    voxel_mm: tuple[float, float, float] | None = None
    origin_mm: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Layout:
    """Where a file keeps its planes: one list of (offset, bytes) a plane, how they are packed, and how values are scaled."""

    shape: tuple[int, int, int]
    dtype: str
    strips: list[list[tuple[int, int]]]
    packed: bool = False
    slope: float = 1.0
    shift: float = 0.0
    voxel_mm: tuple[float, float, float] | None = None
    origin_mm: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def plane(self, read: Read, z: int) -> np.ndarray:
        """One plane; nothing else of the file is read."""
        parts = [read(at, n) for at, n in self.strips[z]]
        raw = b"".join(zlib.decompress(p) if self.packed else p for p in parts)
        a = np.frombuffer(raw, self.dtype, self.shape[1] * self.shape[2]).reshape(self.shape[1:])
        return a if (self.slope, self.shift) == (1.0, 0.0) else a * self.slope + self.shift


def nifti_layout(read: Read) -> Layout:
    """A single-volume NIfTI-1 file's layout, from its header; axes (x, y, z) on disk become (z, y, x)."""
    data = read(0, 352)
    for order in "<>":
        if struct.unpack(order + "i", data[:4])[0] == 348:
            break
    else:
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack(order + "8h", data[40:56])
    shape = dim[1 : 1 + dim[0]]
    if any(n > 1 for n in shape[3:]):
        raise ValueError("more than one volume in the file")
    shape = (tuple(shape) + (1, 1, 1))[:3]
    kind = struct.unpack(order + "h", data[70:72])[0]
    if kind not in NIFTI_TYPES:
        raise ValueError(f"NIfTI type {kind} is not read")
    pix = struct.unpack(order + "8f", data[76:108])
    offset, slope, inter = struct.unpack(order + "3f", data[108:120])
    unit = NIFTI_UNITS.get(data[123] & 7, 1.0)
    moved = struct.unpack(order + "3f", data[268:280])
    size = shape[0] * shape[1] * np.dtype(NIFTI_TYPES[kind]).itemsize
    return Layout(tuple(shape[::-1]), order + NIFTI_TYPES[kind], [[(int(offset) + z * size, size)] for z in range(shape[2])], False, slope or 1.0, inter,
                  tuple(abs(p) * unit for p in pix[3:0:-1]), tuple(m * unit for m in moved[::-1]))


def tiff_layout(read: Read) -> Layout:
    """The pages of a grey TIFF, plain or deflated, from its directories."""
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    if order is None or struct.unpack(order + "H", read(2, 2))[0] != 42:
        raise ValueError("no TIFF header")
    at, pages = struct.unpack(order + "I", read(4, 4))[0], []
    while at:
        count = struct.unpack(order + "H", read(at, 2))[0]
        entries, tags = read(at + 2, 12 * count + 4), {}
        for i in range(count):
            tag, kind, n = struct.unpack(order + "HHI", entries[12 * i : 12 * i + 8])
            if kind in TIFF_CODES:
                size = TIFF_SIZES[kind] * n
                value = entries[12 * i + 8 : 12 * i + 12]
                raw = value[:size] if size <= 4 else read(struct.unpack(order + "I", value)[0], size)
                tags[tag] = struct.unpack(f"{order}{n}{TIFF_CODES[kind]}", raw)
        packed = tags.get(259, (1,))[0]
        if packed not in (1, 8, 32946) or tags.get(277, (1,))[0] != 1:
            raise ValueError("only grey pages, plain or deflated, are read")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(tags.get(258, (8,))[0] // 8)
        pages.append(((tags[257][0], tags[256][0]), order + kind, packed != 1, list(zip(tags[273], tags[279], strict=True))))
        at = struct.unpack(order + "I", entries[12 * count :])[0]
    if len({p[:3] for p in pages}) != 1:
        raise ValueError("pages of one size and type make a volume")
    (h, w), kind, packed, _ = pages[0]
    return Layout((len(pages), h, w), kind, [p[3] for p in pages], packed)


def layout(path: str, read: Read) -> Layout:
    """A file's layout by its name."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".nii"):
        return nifti_layout(read)
    if name.endswith((".tif", ".tiff")):
        return tiff_layout(read)
    raise ValueError(f"{Path(path).name} is no volume file that is known here")


def reader(file: BinaryIO) -> Read:
    """Reads ranges of an open file, packed by gzip or not (then by going through what lies before)."""
    packed = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    source = gzip.GzipFile(fileobj=file) if packed else file

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    return read


def _whole(found: Layout, read: Read) -> np.ndarray:
    return np.stack([found.plane(read, z) for z in range(found.shape[0])])


def read_nifti(data: bytes) -> Volume:
    """A single-volume NIfTI-1 file."""
    read = reader(io.BytesIO(data))
    found = nifti_layout(read)
    return Volume(_whole(found, read), found.voxel_mm, found.origin_mm)


def nifti_head(shape: tuple[int, int, int], dtype: np.dtype, voxel_mm: tuple[float, float, float] | None = None, origin_mm: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> bytes:
    """The header of a NIfTI-1 file; each axis has 32767 voxels at most."""
    if max(shape) > 32767:
        raise ValueError("NIfTI-1 axes are 16-bit numbers")
    code = next((k for k, t in NIFTI_TYPES.items() if np.dtype(t) == dtype), None)
    if code is None:
        raise ValueError(f"{dtype} has no NIfTI type")
    vz, vy, vx = voxel_mm or (1.0, 1.0, 1.0)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, 8 * dtype.itemsize)
    struct.pack_into("<8f", head, 76, 1, vx, vy, vz, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[123] = 2
    oz, oy, ox = origin_mm
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, vx, 0, 0, ox, 0, vy, 0, oy, 0, 0, vz, oz)
    struct.pack_into("<3f", head, 268, ox, oy, oz)
    head[344:348] = b"n+1\0"
    return bytes(head)


def write_planes(out: BinaryIO, planes: Iterator[np.ndarray], shape: tuple[int, int, int], kind: str, dtype: str | np.dtype, voxel_mm: tuple[float, float, float] | None = None, origin_mm: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """Writes a NIfTI-1 or TIFF file plane by plane; no more than one of them is held."""
    dtype = np.dtype(dtype)
    if kind == "nii":
        out.write(nifti_head(shape, dtype, voxel_mm, origin_mm))
        for page in planes:
            out.write(np.ascontiguousarray(page).astype(dtype.newbyteorder("<")).tobytes())
        return
    size = shape[1] * shape[2] * dtype.itemsize
    if 8 + shape[0] * (size + 200) > 0xFFFFFFFF:
        raise ValueError("a TIFF file holds 4 GB; write a folder of slices or NIfTI")
    form, at = {"u": 1, "i": 2, "f": 3}[dtype.kind], 8
    out.write(b"II*\0" + struct.pack("<I", at + size + size % 2))
    for z, page in enumerate(planes):
        out.write(np.ascontiguousarray(page).astype(dtype.newbyteorder("<")).tobytes() + b"\0" * (size % 2))
        tags = [(256, 4, shape[2]), (257, 4, shape[1]), (258, 3, 8 * dtype.itemsize), (259, 3, 1), (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, shape[1]), (279, 4, size), (339, 3, form)]
        body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) if k == 4 else struct.pack("<HHIHH", t, k, 1, v, 0) for t, k, v in tags)
        at += size + size % 2 + len(body) + 4
        out.write(body + struct.pack("<I", 0 if z == shape[0] - 1 else at + size + size % 2))


def write_nifti(volume: Volume) -> bytes:
    """A NIfTI-1 file."""
    a = np.asarray(volume.data)
    a = a.astype("f4") if a.dtype == np.float16 or a.dtype == bool else a
    out = io.BytesIO()
    write_planes(out, iter(a), a.shape, "nii", a.dtype, volume.voxel_mm, volume.origin_mm)
    return out.getvalue()


def read_tiff(data: bytes) -> np.ndarray:
    """The pages of a grey TIFF as (z, y, x)."""
    read = reader(io.BytesIO(data))
    return _whole(tiff_layout(read), read)


def write_tiff(stack: np.ndarray) -> bytes:
    """(z, y, x) as an uncompressed grey TIFF, one strip a page."""
    a = np.asarray(stack)
    a = a.astype("u1") if a.dtype == bool else a
    out = io.BytesIO()
    write_planes(out, iter(a), a.shape, "tif", a.dtype)
    return out.getvalue()


def natural(name: str) -> list:
    """A sort key under which slice 10 comes after slice 9."""
    return [int(p) if p.isdigit() else p for p in re.split(r"([0-9]+)", name)]


def read_stack(files: dict[str, bytes]) -> np.ndarray:
    """Single-page TIFFs by name, in natural order, as one volume."""
    return np.concatenate([read_tiff(files[n]) for n in sorted(files, key=natural)])


def write_png(image: np.ndarray) -> bytes:
    """Grey (y, x) or RGB (y, x, 3) bytes as PNG."""
    a = np.ascontiguousarray(np.asarray(image, np.uint8))
    colour = 2 if a.ndim == 3 else 0
    rows = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)], 1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", a.shape[1], a.shape[0], 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def grey(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """A windowed grey ramp, 0 to 255."""
    return np.rint(np.clip((image - low) / max(high - low, 1e-12), 0, 1) * 255).astype(np.uint8)


def heat(image: np.ndarray, top: float, gave_up: np.ndarray | None = None) -> np.ndarray:
    """A dark-to-bright colour ramp; voxels that gave up are tinted blue."""
    stops = np.array([[0, 0, 0], [96, 0, 32], [208, 48, 0], [255, 176, 32], [255, 255, 224]], float)
    t = np.clip(np.nan_to_num(image) / max(top, 1e-12), 0, 1) * (len(stops) - 1)
    i = np.minimum(t.astype(int), len(stops) - 2)
    rgb = stops[i] + (stops[i + 1] - stops[i]) * (t - i)[..., None]
    if gave_up is not None:
        rgb = rgb * (1 - gave_up[..., None]) + np.array([64, 96, 255.0]) * gave_up[..., None]
    return np.rint(rgb).astype(np.uint8)


def open_volume(path: str, data: bytes) -> Volume:
    """A file's volume by its name: NIfTI or TIFF, gzip allowed."""
    read = reader(io.BytesIO(data))
    found = layout(path, read)
    return Volume(_whole(found, read), found.voxel_mm, found.origin_mm)
