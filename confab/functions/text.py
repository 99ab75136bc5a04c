"""String and number expressions with the semantics of the browser's language."""
from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a trim removes: the Unicode class without U+0085, and the byte order mark.
_BLANK = r"[\t\n\u000B\f\r    -     　﻿]+"


def trim(text: Column) -> Column:
    """Without white space at both ends, also no-break spaces and the byte order mark; plain trim() only knows U+0020."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANK}", ""), rf"{_BLANK}\z", "")


def length_utf16(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the first plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def role_label(role: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(role, 1, 1)), F.substr(role, F.lit(2)))


def split_list(text: Column, separator: str = ",") -> Column:
    """Parts between separators, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, separator), trim), lambda p: p != "")


def join_keeping(parts: Column, separator: str) -> Column:
    """Joined parts; a null part is empty but keeps its separators (array_join would skip it)."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit(""))), separator)


def encode_component(text: Column) -> Column:
    """Percent encoding of a URI component: spaces as %20, and ! ' ( ) * ~ as they are."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves towards positive infinity: -2.5 gives -2."""
    return F.floor(x + F.lit(0.5))


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy, hh:mm a")


def file_stamp(ts: Column) -> Column:
    """An ISO time that can stand in a file name."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "[:.]", "-")


def to_fixed(digits: int):
    """A vectorised function: a non-negative double with so many decimals, rounded half up on its exact binary value."""
    unit = Decimal(1).scaleb(-digits)

    @F.pandas_udf("string")
    def fixed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else format(Decimal(v).quantize(unit, ROUND_HALF_UP), "f"))

    return fixed
