"""Column sets and stored tables: ordered names, subsets, guards, appended blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..sources import io


def ordered_names(*lists: list[str]) -> list[str]:
    """All names in the order of their first appearance, each once."""
    return list(dict.fromkeys(n for names in lists for n in names))


def subset(names: list[str], importance: dict[str, float] | None = None, top: int | None = None, without: tuple[str, ...] = ()) -> list[str]:
    """The `top` names by importance (of equals the first; unknown is 0), or all, less those that begin with one of `without`."""
    if top is not None:
        names = sorted(names, key=lambda n: -(importance or {}).get(n, 0.0))[:top]
    return [n for n in names if not n.startswith(tuple(without))] if without else list(names)


def enough(df: DataFrame, rows: int = 0, columns: int = 0) -> bool:
    """Whether a table has so many rows and columns; stops counting at `rows`."""
    return len(df.columns) >= columns and (rows == 0 or df.limit(rows).count() >= rows)


def softmax(x: list[float]) -> list[float]:
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def append_block(stored: str, block: DataFrame, key: str, out: str) -> list[str]:
    """Writes the table at `stored` with the columns of block joined by key to `out`, a new place; what block has already
    takes its place. Returns the columns in order."""
    old = io.scan_parquet(block.sparkSession, stored)
    new = [c for c in block.columns if c != key]
    names = ordered_names(old.columns, new)
    io.write_features(old.drop(*new).join(block, key, "left").select(*names), out, floats=False)
    return names
