"""The next row in the order of a key, without one task that sees all rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a block is meant to hold, and the most blocks.
ROWS = 256
BLOCKS = 1 << 13


class Blocks:
    """Blocks of rows in the order of a long key, cut at quantiles of the keys, so that dense, sparse and clustered keys are dealt out alike.

    The cuts are a constant of at most ``BLOCKS`` longs. Rows without a key come first, in the order of ``other`` (a hash, as a long), whose range is
    cut evenly. Blocks are numbered in order: a row's block is never above that of a later row.
    """

    def __init__(self, rows: DataFrame, key: str):
        self.rows, self.key = rows, key
        n = rows.count()
        self.bits = min(max(1, (n // ROWS).bit_length()), BLOCKS.bit_length() - 1)
        size = 1 << self.bits
        shares = ", ".join(f"{k / size!r}D" for k in range(1, size))
        cuts = rows.select(F.expr(f"percentile_approx(`{key}`, array({shares}), {max(10_000, 4 * size)})").alias("q")).first()["q"] or []
        # Some keys may repeat, or fall together as doubles: blocks between equal cuts stay empty.
        self.cuts = sorted(cuts) + [2**63 - 1] * (size - 1 - len(cuts))

    def of(self, other: Column) -> Column:
        """The block of a row: by binary search among the cuts."""
        cuts = F.from_json(F.lit(json.dumps(self.cuts)), "array<bigint>")
        key = F.col(self.key)
        # How many cuts are at or below the key: a bit at a time, from the highest.
        found = F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(self.bits))]), F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= key, at + step).otherwise(at))
        size = 1 << self.bits
        free = F.least(F.floor((other / F.lit(2.0**64) + 0.5) * size).cast("int"), F.lit(size - 1)) - size
        return F.when(key.isNull(), free).otherwise(found)


def next_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (block int, any repeats) -> (block, next_block): the next larger one that occurs; after the last, the first.

    At most twice ``BLOCKS`` different ones exist, whatever the table holds, so one task puts them in order.
    """
    own = blocks.select("block").distinct()
    rim = Window.orderBy("block")
    least = F.first("block").over(rim.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return own.select("block", F.coalesce(F.lead("block").over(rim), least).alias("next_block"))
