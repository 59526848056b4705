"""Column names: quoting, cleaning, normalising."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "__rid"


def q(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def clean_column_name(name: object, position: int) -> str:
    """White space collapsed; an empty or missing name becomes columna_{position + 1}."""
    text = re.sub(r"\s+", " ", "" if name is None else str(name)).strip()
    return text if text and text.lower() != "nan" else f"columna_{position + 1}"


def normalize_names(names: list[str]) -> list[str]:
    """Snake case in ASCII; names that collide get _1, _2 and so on."""
    out: list[str] = []
    for k, name in enumerate(names):
        plain = unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode().lower()
        base = re.sub(r"[^0-9a-z]+", "_", plain).strip("_") or f"columna_{k + 1}"
        found, n = base, 0
        while found in out:
            n += 1
            found = f"{base}_{n}"
        out.append(found)
    return out


def is_bool(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.BooleanType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def is_integer(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.IntegralType)


def is_datetime(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.StringType, T.CharType, T.VarcharType))


def is_nested(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_numeric(df, c)]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_text(df, c)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_datetime(df, c)]


def as_label(c: Column) -> Column:
    """The value as a category; a missing one is the category 'nan'."""
    return F.coalesce(c.cast("string"), F.lit("nan"))
