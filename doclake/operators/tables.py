"""Tables of text cells, and their renderings. A table is array<array<string>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import size, strip

STATS = "numeric_count", "sum", "avg", "max", "min"


def clean(table: Column) -> Column:
    """Null cells empty, others stripped; null and empty rows dropped."""
    rows = F.filter(table, lambda r: F.coalesce(F.size(r), F.lit(0)) > 0)
    return F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))


def filled_rows(table: Column) -> Column:
    return F.filter(table, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))


def sheet_text(name: Column, table: Column) -> Column:
    head = F.concat(F.lit("\n[工作表: "), name, F.lit("]"))
    return F.array_join(F.concat(F.array(head), F.transform(filled_rows(table), lambda r: F.array_join(r, "\t", ""))), "\n")


def markdown(table: Column) -> Column:
    """A pipe table whose first row is the header; rows are neither padded nor escaped."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.size(F.get(table, F.lit(0)))), "|"), F.lit("|"))
    body = F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), row)
    return F.when(F.size(table) > 0, F.array_join(F.concat(F.array(row(F.get(table, F.lit(0))), rule), body), "\n")).otherwise("")


def _quoted(cell: Column, alone: Column) -> Column:
    special = cell.rlike('[",\r\n]') | (alone & (cell == ""))
    return F.when(special, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv(tables: Column) -> Column:
    """All tables one after the other, an empty row after each; CRLF, quoted where needed."""
    row = lambda r: F.concat(F.array_join(F.transform(r, lambda c: _quoted(F.coalesce(c, F.lit("")), F.size(r) == 1)), ","), F.lit("\r\n"))
    return F.array_join(F.transform(tables, lambda t: F.concat(F.array_join(F.transform(t, row), ""), F.lit("\r\n"))), "")


def txt(table: Column) -> Column:
    return F.array_join(F.transform(table, lambda r: F.concat(F.lit("  "), F.array_join(r, " | ", ""))), "\n")


def number_stats(cells: DataFrame, keys: list[str], value: str = "num") -> DataFrame:
    """Of the numeric cells by key; groups without one are left out."""
    v = F.col(value)
    exact = F.sum(v.cast("decimal(28,6)"))
    rows = cells.where(v.isNotNull()).groupBy(*keys)
    return rows.agg(F.count("*").alias("numeric_count"), exact.cast("double").alias("sum"), (exact.cast("double") / F.count("*")).alias("avg"), F.max(v).alias("max"), F.min(v).alias("min"))


def assemble(rows: DataFrame, key: str, order: str, text: Column, sep: str) -> DataFrame:
    """(key, text, parts): texts joined in order whatever order they arrive in."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), text.alias("text"))))
    grouped = rows.groupBy(key).agg(ordered.alias("parts"))
    return grouped.select(key, F.array_join(F.transform("parts", lambda p: p["text"]), sep).alias("text"), size(F.col("parts")).alias("parts"))
