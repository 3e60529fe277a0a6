"""Columns of tables that users give: any names, any types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name that may hold dots, blanks and backticks."""
    return "`" + name.replace("`", "``") + "`"


def every(df: DataFrame) -> list[Column]:
    """All columns of a table, by quoted name."""
    return [F.col(quoted(c)) for c in df.columns]


def text_of(columns: list[Column]) -> Column:
    """The columns of a row as JSON: an order of rows whatever the types, maps too, which have none of their own."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
