"""Rows made in Python tasks, handed on before many are held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

HELD = 1 << 20  # characters and hundreds of rows that a task gathers before it hands them on


def handing(rows: Callable[..., Iterator[tuple]], given: list[str], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas: the rows of each row's ``given`` values, in frames of about ``HELD`` characters, whatever the batch holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, size = [], 0
            for values in zip(*(batch[c] for c in given), strict=True):
                for row in rows(*values):
                    own.append(row)
                    size += 100 + sum(len(x) for x in row if isinstance(x, str))
                    if size > HELD:
                        yield pd.DataFrame(own, columns=columns)
                        own, size = [], 0
            if own:
                yield pd.DataFrame(own, columns=columns)

    return run
