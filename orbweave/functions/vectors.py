"""Arrow columns to NumPy and back, for the functions that run in Python workers."""

from __future__ import annotations

import numpy as np


def longs(array) -> tuple[np.ndarray, np.ndarray]:
    """Values as uint64 bit patterns (0 for null), and which are not null."""
    good = ~np.asarray(array.is_null())
    return array.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), good


def to_longs(values: np.ndarray, good: np.ndarray):
    import pyarrow as pa

    return pa.array(values.view(np.int64), pa.int64(), mask=~good)


def matrix(array, width: int | None, kind=np.float32, null=np.nan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column as rows of ``width``: the matrix, which rows are null, which have another width.

    Without a width, rows may differ in it: all count as fitting, padded with zeros to the longest.
    """
    import pyarrow.compute as pc

    absent = np.asarray(array.is_null())
    size = pc.list_value_length(array).fill_null(-1).to_numpy(zero_copy_only=False)
    if width is None and len(set(size[~absent].tolist())) > 1:
        out = np.zeros((len(array), int(size.max())), kind)
        flat = array.flatten().fill_null(null).to_numpy(zero_copy_only=False).astype(kind)
        out[np.arange(out.shape[1]) < size[:, None]] = flat
        return out, absent, np.zeros(len(array), bool)
    if width is None:
        width = int(size[~absent][0]) if (~absent).any() else 0
    fits = size == width
    out = np.zeros((len(array), width), kind)
    if fits.any() and width:
        kept = array if fits.all() else array.filter(fits)
        out[fits] = kept.flatten().fill_null(null).to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
    return out, absent, ~fits & ~absent


def lists(values: np.ndarray, kind, mask: np.ndarray | None = None):
    """Rows of a matrix as a list column; rows in ``mask`` are null."""
    import pyarrow as pa

    n, width = values.shape
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    flat = pa.array(np.ascontiguousarray(values).ravel(), kind)
    return pa.ListArray.from_arrays(ends, flat, mask=None if mask is None else pa.array(mask))


def hex_text(high: np.ndarray, low: np.ndarray, digits: int) -> np.ndarray:
    """The last ``digits`` hex digits of each 128-bit number."""
    raw = np.stack([high, low], 1).astype(">u8").tobytes().hex().encode()
    chars = np.frombuffer(raw, "S1").reshape(-1, 32)[:, 32 - digits :]
    return np.ascontiguousarray(chars).view(f"S{digits}").ravel().astype(f"U{digits}")


def from_hex(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(t.zfill(32) for t in texts)), ">u8").reshape(-1, 2).astype(np.uint64)
    return raw[:, 0], raw[:, 1]
