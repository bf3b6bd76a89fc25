"""Coordinates, carriers' call records and the provenance of loaded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Carrier, its columns for caller and callee, its time format.
CALL_RECORDS = (
    ("SKT", "CALLING_NO", "CALLED_NO", "yyyyMMddHHmmss"),
    ("KT", "FROM_NUM", "TO_NUM", "yyyy-MM-dd HH:mm:ss"),
    ("LGU", "ORIG_NO", "TERM_NO", "yyyyMMddHHmmss"),
)


def with_coordinates(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """latitude and longitude as numbers; rows in which one cannot be read are dropped."""
    parse = lambda c: F.trim(F.col(c).cast("string")).try_cast("double")
    return df.withColumns({lat: parse(lat), lng: parse(lng)}).filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())


def carrier_of(columns: list[str]) -> str | None:
    """The carrier whose column names a call record has."""
    return next((c for c, caller, callee, _ in CALL_RECORDS if {caller, callee} <= set(columns)), None)


def call_records(df: DataFrame, time_col: str = "TIME") -> DataFrame:
    """(carrier, caller, callee, ts) of one carrier's records; a time that cannot be read is null."""
    name = carrier_of(df.columns)
    if name is None:
        raise ValueError(f"no carrier has the columns {df.columns}")
    _, caller, callee, form = next(r for r in CALL_RECORDS if r[0] == name)
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), "[^0-9+]", "")
    return df.select(F.lit(name).alias("carrier"), number(caller).alias("caller"), number(callee).alias("callee"), F.try_to_timestamp(F.col(time_col), F.lit(form)).alias("ts"))


def with_provenance(edges: DataFrame, source: Column, timestamp: Column, per: list[str], order: list[str]) -> DataFrame:
    """Edges with source, timestamp, seq (their place among those of one ``per``, in a stated order) and created_at."""
    seq = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return edges.select("*", source.alias("source"), timestamp.alias("timestamp"), seq.cast("long").alias("seq"), F.current_timestamp().alias("created_at"))
