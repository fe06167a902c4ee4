"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SQL names of the column types that occur in exports and tables.
SQL_TYPE_NAMES = {
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def sql_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ArrayType):
        return sql_type(data_type.elementType) + "[]"
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    name = data_type.simpleString()
    return SQL_TYPE_NAMES.get(name, name.upper())


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def rows_from(one_row: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn one row of aggregates into several report rows, all from the same pass."""
    entries = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    return one_row.select(F.inline(F.array(*entries)))


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return all_of(left[k].eqNullSafe(right[k]) for k in keys)
