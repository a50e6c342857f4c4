"""What a Python worker holds: small parts of a batch at a time, and nothing that other work has left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

ROWS = 512  # rows of a batch that are handled at once, whatever the session's batch size
KEPT: list[Callable[[], None]] = []  # functions that free what a module keeps in a worker from task to task


def let_go() -> None:
    """Free what other operators keep; they load it again when they need it."""
    for free in KEPT:
        free()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that the lists and columns made of one stay small."""
    let_go()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
