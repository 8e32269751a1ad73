"""Sets of numbered rows as bitmaps, so that large rows can be told apart where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.ranking import bounded

#: Short rows that a bitmap of 4096 bytes counts for when a broadcast is decided.
SHORT_ROWS = 64


def numbered_once() -> Column:
    """``row``: a number of each row. It must be written before it is used, since it changes with the partitions."""
    return F.monotonically_increasing_id().alias("row")


def marks(rows: DataFrame) -> DataFrame:
    """``at, bits``: the set of the numbers ``rows(row)``, a bit a number; numbers of one partition are dense."""
    found = rows.groupBy(F.bitmap_bucket_number("row").alias("at"))
    return found.agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))


def marked(rows: DataFrame, of: DataFrame, n: int, inside: bool = True) -> DataFrame:
    """The rows whose number is in a set of ``n`` bitmaps, or those whose is not. The bitmaps go to the rows."""
    place = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1
    same = F.bitmap_bucket_number("row") == F.col("at")
    return rows.join(bounded(of, n * SHORT_ROWS), same & there, "left_semi" if inside else "left_anti")
