"""Station dictionary (A7, A8): a dense number in place of a station's id.

A rollup repeats the station once per field value in the long form of its
modes.  A number of four bytes takes the place of the text there, in the
shuffles and in the grouping; the text comes back at the end, one row per
bucket.  The dictionary is append-only (`stationlake.sinks.tables.extend_codes`):
a station keeps its number for good, so numbers may be kept beside the data.

Both joins are equi-joins with one row per station.  Spark broadcasts the
dictionary where its files are small enough and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.schema import STATION_CODE, STATION_COL


def unlisted(codes: DataFrame, rows: DataFrame) -> DataFrame:
    """The stations of ``rows`` that the dictionary lacks, once each; a null
    station has no number."""
    return (rows.select(STATION_COL).filter(F.col(STATION_COL).isNotNull()).distinct()
            .join(codes, STATION_COL, "left_anti"))


def numbered(parts: DataFrame, first: int) -> DataFrame:
    """(station, code): numbers from ``first`` on, without gaps, in the order
    of the ids.

    ``parts`` holds the stations by range partition (``_part``, fixed on
    disk).  Only the sizes of the partitions meet in one window, a row each.
    """
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(STATION_COL))
    return (parts.withColumn("_place", place).join(offsets, "_part")
            .select(STATION_COL, (F.lit(first) + F.col("_before") + F.col("_place") - 1).cast("int").alias(STATION_CODE)))


def _code_or_error() -> Column:
    missing = F.raise_error(F.concat(F.lit("the station dictionary lacks "), F.col(STATION_COL)))
    known = F.col(STATION_CODE).isNotNull() | F.col(STATION_COL).isNull()
    return F.when(known, F.col(STATION_CODE)).otherwise(missing.cast("int"))


def coded(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """``rows`` with the station's number in the station column.  A station
    that the dictionary lacks is an error; a null station stays null."""
    others = [F.col(f"`{c}`") for c in rows.columns if c != STATION_COL]
    return (rows.join(codes.select(STATION_COL, STATION_CODE), STATION_COL, "left")
            .select(_code_or_error().alias(STATION_COL), *others))


def decoded(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """The inverse of `coded`, columns in the same order."""
    names = codes.select(F.col(STATION_COL).alias("_name"), STATION_CODE)
    back = [F.col("_name").alias(STATION_COL) if c == STATION_COL else F.col(f"`{c}`") for c in rows.columns]
    return rows.join(names, rows[STATION_COL] == names[STATION_CODE], "left").select(*back)
