"""Page indexes as bytes: runs and boxes in differences of variable length.

Numbers are stored seven bits a byte, lowest first, a set eighth bit saying that more
follow. Runs go row by row: how many a row has, then for each the gap since the end of
the one before it and its length. Boxes go in their order: the difference of the top and
left edges to those of the box before, folded to positive numbers, then width, height,
ink and, for clusters, members. A glyph's run takes two bytes.
"""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 to 2**35 - 1 as bytes."""
    v = np.asarray(values, np.int64)
    if len(v) and (v.min() < 0 or v.max() >= 1 << 35):
        raise ValueError("a number is out of range")
    size = 1 + sum((v >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(v) else 0, np.uint8)
    begin = end - size
    for k in range(5):
        have = size > k
        out[begin[have] + k] = (v[have] >> 7 * k & 0x7F) | np.where(size[have] > k + 1, 0x80, 0)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The numbers of ``pack``."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 0x80
    if not last[-1]:
        raise ValueError("the bytes end within a number")
    end = np.flatnonzero(last)
    begin = np.concatenate([[0], end[:-1] + 1])
    if int((end - begin).max()) > 4:
        raise ValueError("a number is too long")
    out = (raw[begin] & 0x7F).astype(np.int64)
    for k in range(1, 5):
        more = np.flatnonzero(end - begin >= k)
        if not len(more):
            break
        out[more] |= (raw[begin[more] + k] & 0x7F).astype(np.int64) << 7 * k
    return out


def fold(x: np.ndarray) -> np.ndarray:
    """Small positive numbers for small differences of either sign."""
    return np.where(x < 0, -2 * x - 1, 2 * x)


def unfold(x: np.ndarray) -> np.ndarray:
    return np.where(x & 1, -(x + 1) // 2, x // 2)


def pack_runs(runs: np.ndarray, h: int) -> bytes:
    """Runs (y, x0, x1) in row-major order, ends inclusive, of an image with h rows."""
    y, x0, x1 = runs.T if len(runs) else np.zeros((3, 0), np.int64)
    per_row = np.bincount(y, minlength=h) if h else np.zeros(0, np.int64)
    before = np.concatenate([[0], x1[:-1]])[: len(y)]
    new_row = np.ones(len(y), bool)
    new_row[1:] = y[1:] != y[:-1]
    gap = x0 - np.where(new_row, 0, before)
    return pack(np.concatenate([per_row, np.stack([gap, x1 - x0], 1).ravel()]))


def unpack_runs(data: bytes, h: int) -> np.ndarray:
    v = unpack(data)
    per_row, rest = v[:h], v[h:].reshape(-1, 2)
    y = np.repeat(np.arange(h), per_row)
    if len(y) != len(rest):
        raise ValueError("the rows' counts and the runs differ")
    # ends are sums of gaps and lengths within a row: those of the whole page, less what earlier rows add
    ends = np.cumsum(rest.sum(1))
    first = np.cumsum(per_row) - per_row
    base = np.concatenate([[0], ends])[first]
    x1 = ends - np.repeat(base, per_row)
    return np.stack([y, x1 - rest[:, 1], x1], 1)


def pack_boxes(boxes: np.ndarray) -> bytes:
    """Rows x0, y0, x1, y1 and further numbers that are not negative."""
    if not len(boxes):
        return b""
    b = boxes.astype(np.int64)
    step = np.diff(b[:, :2], axis=0, prepend=np.zeros((1, 2), np.int64))
    return pack(np.concatenate([fold(step), b[:, 2:4] - b[:, :2], b[:, 4:]], 1).ravel())


def unpack_boxes(data: bytes, columns: int) -> np.ndarray:
    v = unpack(data).reshape(-1, columns)
    low = np.cumsum(unfold(v[:, :2]), axis=0)
    return np.concatenate([low, low + v[:, 2:4], v[:, 4:]], 1)
