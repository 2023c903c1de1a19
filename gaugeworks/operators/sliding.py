"""Medians and deviations of sliding frames, by a sorted frame that slides.

A frame's values are kept in order while a row enters and one leaves, so a row
costs a search and not a sort of its frame: the median is read off the middle,
and the median deviation off the two sorted runs on either side of it. Every
series is one group, in order; its task holds the series and one frame.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def middle(ordered: list[float]) -> float:
    """Median of a sorted list that is not empty."""
    n = len(ordered)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def deviation(ordered: list[float], centre: float) -> float:
    """Median distance of the values of a sorted list from ``centre``. Those at
    or below it, going down, and those above, going up, are two lists of sorted
    distances; a rank among both is found by halving."""
    n, cut = len(ordered), bisect_right(ordered, centre)

    def ranked(k: int) -> float:
        low, high = max(0, k + 1 - (n - cut)), min(k + 1, cut)
        while low < high:
            below = (low + high) // 2
            if centre - ordered[cut - 1 - below] < ordered[cut + k - below] - centre:
                low = below + 1
            else:
                high = below
        out = centre - ordered[cut - low] if low else 0.0
        return max(out, ordered[cut + k - low] - centre) if low <= k else out

    first = ranked((n - 1) // 2)
    return first if n % 2 else (first + ranked(n // 2)) / 2


@dataclass(frozen=True)
class Frame:
    """The last ``window`` rows, the row's own included, or, if ``prior``, those
    strictly before it. Null under ``least`` values; nulls are rows without one."""

    column: str
    window: int
    least: int
    prior: bool = False

    def slide(self, values: np.ndarray, spread: bool) -> tuple[list, list]:
        """Median and median deviation of each row's frame."""
        x, held, medians, spreads = values.tolist(), [], [], []
        for i, v in enumerate(x):
            if not self.prior and v == v:
                insort(held, v)
            gone = i - self.window - self.prior
            if gone >= 0 and x[gone] == x[gone]:
                del held[bisect_left(held, x[gone])]
            centre = middle(held) if held and len(held) >= self.least else None
            medians.append(centre)
            if spread:
                spreads.append(None if centre is None else deviation(held, centre))
            if self.prior and v == v:
                insort(held, v)
        return medians, spreads


def medians(df: DataFrame, keys: list[str], frames: dict[str, Frame], spreads: dict[str, str] | None = None, order: str = "hour_utc") -> DataFrame:
    """``df`` with the median of each frame in the column it is named by, and
    the median deviation of some in the columns that ``spreads`` names. NaN
    counts as null. The frames of a row are those of its keys, by ``order``."""
    spreads = spreads or {}
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for n in frames for c in (n, spreads.get(n)) if c]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        for name, frame in frames.items():
            values = table.column(frame.column).cast(pa.float64()).to_numpy(zero_copy_only=False)
            centre, spread = frame.slide(values, name in spreads)
            table = table.append_column(name, pa.array(centre, pa.float64()))
            if name in spreads:
                table = table.append_column(spreads[name], pa.array(spread, pa.float64()))
        return table

    return df.groupBy(*keys).applyInArrow(run, schema)
