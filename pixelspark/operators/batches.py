"""Record batches of Arrow functions, and work that is done once for inputs that are alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: Bytes of inputs and results that one function keeps in a task.
KEPT_BYTES = 8 << 20


def _size(x: Any) -> int:
    return sum(map(_size, x)) if isinstance(x, tuple) else 50 + (len(x) if isinstance(x, bytes | str) else 0)


class Once:
    """A function of bytes and numbers alone, and what it gave for the inputs so far: up to ``most`` bytes, then it forgets
    them all. An input that is raised on isn't kept. Rows dealt out by content find their like in their own task."""

    def __init__(self, work: Callable, most: int = KEPT_BYTES) -> None:
        self.work, self.most, self.known, self.size = work, most, {}, 0

    def __call__(self, *args: Any) -> Any:
        found = self.known.get(args, self)
        if found is self:
            found = self.work(*args)
            own = _size(args) + _size(found)
            if self.size + own > self.most:
                self.known, self.size = {}, 0
            if own <= self.most:
                self.known[args] = found
                self.size += own
        return found


#: Bytes of pixels or files that a record batch gathers.
BATCH_BYTES = 8 << 20


def batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], heavy: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``BATCH_BYTES`` in the column ``heavy``, one row at least."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for row in rows:
        held.append(row)
        size += len(row[heavy] or b"")
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
