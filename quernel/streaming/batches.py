"""The line protocol: relation paths up to `Done`, then queries; `F` ends a batch.

An empty line ends a batch as well. Queries after the last `F` are answered at
the end of the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from quernel.engine import Engine

LOADED = "Done"
FLUSH = "F"


def batches(lines: Iterable[str]) -> Iterator[list[str]]:
    pending: list[str] = []
    for line in lines:
        text = line.strip()
        if text in (FLUSH, ""):
            if pending:
                yield pending
            pending = []
        else:
            pending.append(text)
    if pending:
        yield pending


def serve(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    """Result lines, batch by batch."""
    source = iter(lines)
    for line in source:
        if line.strip() == LOADED:
            break
        if line.strip():
            engine.load(line.strip())
    for batch in batches(source):
        yield from engine.run(batch)
