"""Text to number, date and truth value, as null-safe expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for "missing" in profiles and recipes, and when a file is read.
BLANK_TOKENS = ["", " ", "  ", "-", "--", "n/a", "na", "null", "none", "nan", "sin dato", "desconocido", "?", "."]
NA_STRINGS = [
    "", " ", "  ", "NA", "N/A", "n/a", "na", "NaN", "nan", "NULL", "null", "None", "none", "-", "--", "?", "#N/A", "#NULL!", "#DIV/0!",
    "sin dato", "SIN DATO", "Sin Dato", "desconocido", "DESCONOCIDO", "S/D", "s/d", ".",
]
TRUE_WORDS = ["1", "true", "si", "sí", "yes", "y", "t", "verdadero"]
FALSE_WORDS = ["0", "false", "no", "n", "f", "falso"]
DAY_FIRST = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d/M/yyyy HH:mm", "d/M/yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy"]
MONTH_FIRST = ["M/d/yyyy", "M-d-yyyy", "M/d/yyyy HH:mm", "M/d/yyyy HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy"]
ISO = ["yyyy-MM-dd", "yyyy/M/d", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd"]


#: What ``\\s`` and ``\\p{Z}`` stand for.
WHITE = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space at the ends, Unicode blanks included; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.lower(stripped(c)).isin(BLANK_TOKENS), F.lit(False))


def is_na_token(c: Column) -> Column:
    return F.coalesce(c.isin(NA_STRINGS), F.lit(False))


def cleaned_number(c: Column) -> Column:
    """A number's text in plain notation: the last of , and . is the decimal mark, % divides by 100 (see parse_number)."""
    s = F.regexp_replace(stripped(c), r"[^\d,.\-+eE%]", "")
    s = F.rtrim(s)
    digits = F.regexp_replace(s, "%", "")
    comma, dot = F.instr(F.reverse(digits), ","), F.instr(F.reverse(digits), ".")
    both = (comma > 0) & (dot > 0)
    decimal_comma = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    decimal_dot = F.replace(digits, F.lit(","), F.lit(""))
    return F.when(both & (comma < dot), decimal_comma).when(both, decimal_dot).when(comma > 0, F.replace(digits, F.lit(","), F.lit("."))).otherwise(digits)


def parse_number(c: Column) -> Column:
    value = cleaned_number(c).try_cast("double")
    percent = F.endswith(F.regexp_replace(stripped(c), r"[^\d,.\-+eE%]", ""), F.lit("%"))
    found = F.when(percent, value / 100).otherwise(value)
    return F.when(F.isnan(found), None).otherwise(found)


def has_letters(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


LONGEST_DATE = 64  # no format matches a longer text


def date_shape(pattern: str) -> str:
    """A regular expression that every text of a date format fits: a failed parse costs an exception, a look at the shape doesn't.

    Numbers may carry a sign and any digits from their least count on, months in words are anything but digits; literals stand in either case.
    """
    if re.fullmatch(r"[A-Za-z]+", pattern):  # numbers without anything between
        return rf"^[+-]?[\d+-]{{{len(pattern)},}}$"
    out = ""
    for part in re.findall(r"'[^']*'|y+|M+|d+|H+|m+|s+|.", pattern):
        if part[0] == "'":
            out += re.escape(part[1:-1])
        elif part.startswith("MMM"):
            out += r"\D+"
        elif part[0] in "yMdHms":
            out += rf"[+-]?\d{{{len(part)},}}"
        else:
            out += re.escape(part)
    return f"(?i)^{out}$"


def parse_datetime(c: Column, day_first: bool = True) -> Column:
    formats = [*ISO, *((DAY_FIRST + MONTH_FIRST) if day_first else (MONTH_FIRST + DAY_FIRST))]
    s = stripped(c.cast("string"))
    s = F.when(F.length(s).between(6, LONGEST_DATE), s)
    return F.coalesce(*[F.when(s.rlike(date_shape(f)), F.try_to_timestamp(s, F.lit(f))) for f in formats]).cast("timestamp_ntz")


def parse_bool(c: Column) -> Column:
    s = F.lower(stripped(c.cast("string")))
    return F.when(s.isin(TRUE_WORDS), True).when(s.isin(FALSE_WORDS), False)


def to_float(c: Column) -> Column:
    """As double, NaN taken for missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)
