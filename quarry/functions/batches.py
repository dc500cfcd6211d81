"""Arrow columns through Python in slices, so that Python's own objects are few at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

#: Values that are Python objects at once.
SLICE = 256


def in_slices(values: pa.Array, make: Callable[[list], pa.Array], size: int = SLICE) -> pa.Array:
    """What make gives for the values, slice by slice, as one array."""
    if len(values) <= size:
        return make(values.to_pylist())
    return pa.concat_arrays([make(values.slice(i, size).to_pylist()) for i in range(0, len(values), size)])
