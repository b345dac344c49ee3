"""Medians of wide sliding windows by a rank index, block by block.

A window of w rows sorted anew for every row costs w log w a row and holds w values a row in memory. Here a block of rows
(with the rows its windows reach into) is one Arrow table; its values' ranks are laid out once as binary levels, and a
window's k-th value is found by one step per level, whatever the window's width.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sensorloom.operators.scale import spread

BLOCK = 16_384


class RankIndex:
    """Answers the k-th smallest of any stretch of ``values``; absent ones (``present`` false) count nowhere."""

    def __init__(self, values: np.ndarray, present: np.ndarray) -> None:
        self.before = np.concatenate([[0], np.cumsum(present)])
        kept = values[present]
        order = np.argsort(kept, kind="stable")  # NaN last, as in Spark's order
        self.ordered = kept[order]
        ranks = np.empty(len(kept), dtype=np.int64)
        ranks[order] = np.arange(len(kept))
        self.levels = []
        for bit in range(max(len(kept) - 1, 0).bit_length() - 1, -1, -1):
            one = (ranks >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            self.levels.append((bit, zeros))
            ranks = np.concatenate([ranks[one == 0], ranks[one == 1]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Values of rank ``k`` (from 0) among the present values of positions ``[low, high)``, given as counts."""
        low, high, k, rank = low.copy(), high.copy(), k.copy(), np.zeros(len(k), dtype=np.int64)
        for bit, zeros in self.levels:
            left, right = zeros[low], zeros[high]
            down = k < right - left
            rank += np.where(down, 0, 1 << bit)
            k -= np.where(down, 0, right - left)
            low = np.where(down, left, zeros[-1] + low - left)
            high = np.where(down, right, zeros[-1] + high - right)
        return self.ordered[rank]

    def medians(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(medians, how many values each is of) of positions ``[low, high)``; a median of none means nothing."""
        low, high = self.before[low], self.before[high]
        seen = high - low
        out, some = np.full(len(seen), np.nan), seen > 0
        at = low[some], high[some]
        out[some] = (self.kth(*at, (seen[some] - 1) // 2) + self.kth(*at, seen[some] // 2)) / 2.0
        return out, seen


def window(n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``[low, high)`` of the rows from ``first`` to ``last`` around each of ``n`` rows."""
    at = np.arange(n)
    return np.clip(at + first, 0, n), np.clip(at + last + 1, 0, n)


def per_block(
    df: DataFrame, keys: Sequence[str], order: str, value: str, added: str,
    work: Callable[[np.ndarray, np.ndarray], list], before: int, after: int, block: int = BLOCK,
) -> DataFrame:
    """Add columns (``added`` as a schema string) that ``work`` makes of a block's values and their presence, in order.

    ``order`` counts a series' rows or grid steps one by one; windows reach at most ``before`` and ``after`` rows. ``work``
    returns one (array, present) pair for each added column.
    """
    import pyarrow as pa

    extra = StructType.fromDDL(added)
    schema = StructType([*df.schema.fields, *extra.fields])
    names = extra.fieldNames()

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table[order].to_numpy(), kind="stable")))
        cells = table[value].combine_chunks()
        present = cells.is_valid().to_numpy(zero_copy_only=False)
        made = work(cells.fill_null(0).to_numpy(zero_copy_only=False).astype(float), present)
        for name, (cell, there) in zip(names, made):
            table = table.append_column(name, pa.array(cell, mask=~there))
        home = table["_home"].to_numpy() == table["_block"].to_numpy()
        return table.filter(pa.array(home)).drop_columns(["_home", "_block"])

    return spread(df, order, before, after, block).groupBy(*keys, "_block").applyInArrow(run, schema)
