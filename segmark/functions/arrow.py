"""Arrow helpers for the vectorised functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lists_to_numpy(column: pa.Array, values: np.ndarray) -> list[np.ndarray]:
    """Split flattened list values back into one array per row (NULL counts as empty)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    return [values[e - n : e] for n, e in zip(lengths, ends)]


def shared_codes(left: pa.Array, right: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    """Integer codes for two columns of label lists, equal labels sharing a code."""
    a, b = left.flatten().cast(pa.string()), right.flatten().cast(pa.string())
    joined = pa.concat_arrays([a, b]).dictionary_encode()
    codes = joined.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    return (
        lists_to_numpy(left, codes[: len(a)]),
        lists_to_numpy(right, codes[len(a) :]),
        joined.dictionary,
    )


def list_column(parts: list[np.ndarray], values: pa.Array) -> pa.Array:
    """A list column from per-row lengths and the flattened values."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
