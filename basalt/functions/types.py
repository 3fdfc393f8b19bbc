"""The closed list of data types: their Spark types, text formats and nulls.

All functions give columns. Nulls are Spark's; null_sentinels() reads tables whose nulls are particular values.
A time with its offset is struct(millis, offset_ms): Spark's TIME has no zone and no Parquet form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = T.StructType([T.StructField("millis", T.IntegerType()), T.StructField("offset_ms", T.IntegerType())])
RID = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
#: fixed values: names of the types
TYPES: dict[str, T.DataType] = {
    "SMALL_INT": T.ShortType(), "INT": T.IntegerType(), "BIG_INT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
    "CHAR": T.StringType(), "VAR_CHAR": T.StringType(), "DATE": T.DateType(), "TIME": TIME, "TIMESTAMP": T.TimestampNTZType(), "RID": RID,
}
ARITHMETIC = ("SMALL_INT", "INT", "BIG_INT", "FLOAT", "DOUBLE")
DAY_MS = 24 * 60 * 60 * 1000
_CLOCK = r"^(\d{1,2}):(\d{2}):(\d{2})"
_OFFSET = r"\(UTC ([+-])(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\)\s*$"


def field(name: str, kind: str, nullable: bool = True, unique: bool = False) -> T.StructField:
    """A column; unique is information, not enforced by Spark."""
    return T.StructField(name, TYPES[kind], nullable, {"unique": unique, "type": kind})


def _fit(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.raise_error(F.concat(F.lit(f"more than {length} characters: "), text))).otherwise(text)


def char(text: Column, length: int) -> Column:
    """Padded with blanks to length; longer is an error."""
    return F.rpad(_fit(text, length), length, " ")


def varchar(text: Column, length: int) -> Column:
    """Trimmed at both ends; longer is an error."""
    return _fit(F.trim(text), length)


def char_equals(left: Column, right: Column) -> Column:
    """CHAR comparison ignores the padding."""
    return F.rtrim(left) == F.rtrim(right)


def _time_from_text(text: Column) -> Column:
    def number(pattern: str, group: int) -> Column:
        got = F.regexp_extract(text, pattern, group)
        return F.when(got == "", 0).otherwise(got.try_cast("int"))

    millis = (number(_CLOCK, 1) * 3600 + number(_CLOCK, 2) * 60 + number(_CLOCK, 3)) * 1000
    offset = (number(_OFFSET, 2) * 3600 + number(_OFFSET, 3) * 60 + number(_OFFSET, 4)) * 1000
    offset = F.when(F.regexp_extract(text, _OFFSET, 1) == "-", -offset).otherwise(offset)
    right = text.rlike(_CLOCK) & (millis < DAY_MS) & (number(_CLOCK, 2) < 60) & (number(_CLOCK, 3) < 60)
    return F.when(text.isNull(), F.lit(None)).when(right, F.struct(millis.cast("int").alias("millis"), offset.cast("int").alias("offset_ms"))).otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)))


def from_text(text: Column, kind: str, length: int | None = None) -> Column:
    """Parse; text that is not of the type is an error, null stays null."""
    if kind == "CHAR":
        return char(text, length or 1024)
    if kind == "VAR_CHAR":
        return varchar(text, length or 1024)
    if kind == "DATE":
        return F.to_date(text, "y-M-d")
    if kind == "TIMESTAMP":
        return F.to_timestamp_ntz(text, F.lit("y-M-d H:mm:ss.SSS"))
    if kind == "TIME":
        return _time_from_text(text)
    if kind == "RID":
        raise ValueError("row locators can't be parsed")
    return F.trim(text).cast(TYPES[kind])


def to_text(value: Column, kind: str) -> Column:
    if kind == "DATE":
        return F.date_format(value, "yyyy-MM-dd")
    if kind == "TIMESTAMP":
        return F.date_format(value, "yyyy-M-d H:mm:ss.SSS")
    if kind == "TIME":
        off, clock = value["offset_ms"], value["millis"] / 1000
        part = F.abs(off) / 1000
        text = F.format_string("%d:%02d:%02d", F.floor(clock / 3600), F.floor(clock / 60) % 60, F.floor(clock) % 60)
        zone = F.format_string(" (UTC %s%d:%02d:%02d)", F.when(off < 0, "-").otherwise("+"), F.floor(part / 3600), F.floor(part / 60) % 60, F.floor(part) % 60)
        return F.when(value.isNotNull(), F.concat(text, zone))
    if kind == "RID":
        return F.concat(F.lit("("), value["file"], F.lit("."), value["row"].cast("string"), F.lit(")"))
    return value.cast("string")


def time_instant(value: Column) -> Column:
    """Milliseconds that order times across offsets."""
    return value["millis"].cast("long") - value["offset_ms"]


def time_part(value: Column, part: str) -> Column:
    if part == "offset":
        return value["offset_ms"]
    seconds = F.floor(value["millis"] / 1000).cast("int")
    return {"hour": F.floor(seconds / 3600), "minute": F.floor(seconds / 60) % 60, "second": seconds % 60}[part].cast("int")


def date_part(value: Column, part: str) -> Column:
    """year, month (from 0) or day"""
    return {"year": F.year(value), "month": F.month(value) - 1, "day": F.dayofmonth(value)}[part]


def null_sentinels(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Smallest integers and NaN become nulls, for tables that were exported with such marks."""
    least = {"SMALL_INT": -(1 << 15), "INT": -(1 << 31), "BIG_INT": -(1 << 63)}
    out = {}
    for c, kind in kinds.items():
        if kind in least:
            out[c] = F.when(F.col(c) != F.lit(least[kind]), F.col(c))
        elif kind in ("FLOAT", "DOUBLE"):
            out[c] = F.when(~F.isnan(c), F.col(c))
    return df.withColumns(out)
