"""Message ids: decimal strings that compare as numbers and hold their time in the upper bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the id layout: milliseconds of its epoch, and bits below the time.
EPOCH_MS = 1420070400000
TIME_SHIFT = 22


def id_num(col: Column) -> Column:
    """The id as a number; null where it is none."""
    return F.when(col.rlike(r"^\d+$"), col).try_cast("decimal(20,0)")


def to_ms(id_long: Column) -> Column:
    return F.shiftrightunsigned(id_long, TIME_SHIFT) + F.lit(EPOCH_MS)


def from_ms(ms: Column) -> Column:
    return F.shiftleft(ms.cast("bigint") - F.lit(EPOCH_MS), TIME_SHIFT)


def ms_to_id(ms: int) -> int:
    return (ms - EPOCH_MS) << TIME_SHIFT


def id_to_ms(number: int) -> int:
    return (number >> TIME_SHIFT) + EPOCH_MS


def valid_id(col: Column) -> Column:
    """17 to 19 digits."""
    return col.rlike(r"^[0-9]{17,19}$")


def order_position(df: DataFrame, by: list[str], seq: str, id_col: str = "id") -> DataFrame:
    """df with `position` from 1, per batch named by `by`: ids in numeric order, or as text if any id of the batch is no number; equal ids keep their seq."""
    whole = Window.partitionBy(*by)
    odd = F.bool_or(id_num(F.col(id_col)).isNull()).over(whole)
    df = df.withColumns({"_num": id_num(F.col(id_col)), "_odd": odd})
    order = whole.orderBy(F.when(~F.col("_odd"), F.col("_num")), F.when(F.col("_odd"), F.col(id_col)), seq)
    return df.withColumn("position", F.row_number().over(order)).drop("_num", "_odd")
