"""Arrow helpers of the operators that need Python: columns in, columns out, no row objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def int_lists(values: list, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    """List column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
