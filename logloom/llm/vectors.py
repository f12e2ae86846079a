"""Blocks of vectors in the shared folder, for operators that join vectors block by block.

A block file holds the vectors of one task, in order, as one array that other
tasks memory-map; a manifest row per file carries what planning needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width, valid): lists of one column, short ones padded with zeros.

    Integers stay integers, other numbers become doubles.  Not valid: null lists
    and lists that hold null or non-finite components.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    flat = column.flatten()
    missing = np.asarray(flat.is_null().to_numpy(zero_copy_only=False), bool)
    if pa.types.is_integer(flat.type):
        values, bad = flat.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), missing
    else:
        values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), float)
        bad = missing | ~np.isfinite(values)
    width = int(lengths.max()) if n else 0
    out = np.zeros((n, width), values.dtype)
    row = np.repeat(np.arange(n), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.where(bad, 0, values)
    valid[row[bad]] = False
    return out, valid


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, rows scaled by powers of two): a row of zeros stays zero.

    The scaling brings the largest component near 1, so that no square over- or
    underflows, and leaves the digits of all but vanishing components as they are.
    """
    if not x.size:
        return x, x
    exponent = np.frexp(np.abs(x).max(1))[1][:, None]
    half = exponent // 2  # in two steps: one power of two may itself be out of range
    scaled = np.ldexp(np.ldexp(x, -half), half - exponent)
    length = np.linalg.norm(scaled, axis=1)
    return scaled / np.where(length > 0, length, 1)[:, None], scaled
