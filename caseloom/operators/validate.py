"""Rules that check and normalise columns, compiled into one projection; what fails is set aside with its reasons.

A rule has the form that a value is brought to and the condition that the form has to meet. All rules of a table are one
array of errors, so a row is read once however many there are; valid and rejected rows are written in one pass, apart, and counted by
the same pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from caseloom.operators.paths import shared_path


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    normal: Callable[[Column], Column]
    holds: Callable[[Column], Column]
    required: bool = True


def _text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def _phone(c: Column) -> Column:
    """Digits only, an international prefix taken back to 0, and hyphens put in."""
    digits = F.regexp_replace(F.regexp_replace(_text(c), r"^\+82", "0"), r"[^0-9]", "")
    return F.regexp_replace(digits, r"^(02|0[0-9]{2})([0-9]{3,4})([0-9]{4})$", "$1-$2-$3")


def _time(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"^(\d{4}-\d{2}-\d{2}) ", "$1T")


def case_number(column: str) -> Rule:
    return Rule("case_number", column, _text, lambda c: c.rlike(r"^\d{4}-\d{6}$"))


def account(column: str) -> Rule:
    return Rule("account", column, lambda c: F.regexp_replace(_text(c), r"\s", ""), lambda c: c.rlike(r"^[0-9-]{10,20}$") & c.rlike(r"^[0-9].*[0-9]$"))


def phone(column: str) -> Rule:
    return Rule("phone", column, _phone, lambda c: c.rlike(r"^(02|0[0-9]{2})-[0-9]{3,4}-[0-9]{4}$"))


def amount(column: str) -> Rule:
    return Rule("amount", column, lambda c: F.regexp_replace(_text(c), r"[,\s]", ""), lambda c: c.rlike(r"^[0-9]+(\.[0-9]{1,2})?$") & c.rlike(r"[1-9]"))


def iso_time(column: str) -> Rule:
    """A date and time in the ISO form that is also a day of the calendar."""
    return Rule("iso_time", column, _time, lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?$") & F.try_to_timestamp(F.regexp_replace(c, "T", " ")).isNotNull())


def checked(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with the rules' columns in their normal form, and ``errors``: the names of the rules that do not hold.

    An empty value breaks a required rule and no other. The normal form is computed once, below the conditions.
    """
    normal = {r.column: r.normal(F.col(f"`{r.column}`")) for r in rules}
    d = rows.select(*[normal[c].alias(c) if c in normal else F.col(f"`{c}`") for c in rows.columns])

    def error(r: Rule) -> Column:
        c = F.col(f"`{r.column}`")
        empty = c.isNull() | (c == "")
        return F.when(empty, F.lit(r.name) if r.required else F.lit(None)).when(~F.coalesce(r.holds(c), F.lit(False)), F.lit(r.name))

    return d.withColumn("errors", F.array_compact(F.array(*[error(r) for r in rules])))


def split(rows: DataFrame, rules: list[Rule], path: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(valid, rejected, counts): both kinds of rows from one scan, written apart below ``path``, and how many rows broke each rule."""
    spark = rows.sparkSession
    path, seen = path or shared_path(spark), Observation("validation")
    d = checked(rows, rules)
    names = [r.name for r in rules]
    d = d.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") == 0).alias("valid"), *[F.count_if(F.array_contains("errors", n)).alias(n) for n in names])
    d.withColumn("ok", F.size("errors") == 0).write.partitionBy("ok").parquet(path)
    both = spark.read.schema(d.schema.add("ok", "boolean")).parquet(path)
    return both.filter("ok").drop("ok", "errors"), both.filter("not ok").drop("ok"), dict(seen.get)
