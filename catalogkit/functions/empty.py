"""Three notions of an empty value, kept apart by name.

``has_value``  - coverage: null, "", [], 0 and false hold none; a blank string does.
``is_blank``   - merging: null, white space, a word for nothing, or []; 0 is a value.
``is_unset``   - profiles: exactly null, "" or [].
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: lower-cased words that stand for no value
NOTHING = ("null", "none", "n/a", "不明")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once; a column that an expression names twice may be worked out twice."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def has_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        test = c != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    elif isinstance(kind, T.BooleanType):
        test = c
    elif isinstance(kind, T.NumericType):
        test = c != 0
    else:
        test = F.lit(True)
    return F.coalesce(c.isNotNull() & test, F.lit(False))


def is_blank(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        text = F.lower(strip(c))
        test = (text == "") | text.isin(*NOTHING)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(c) == 0
    else:
        test = F.lit(False)
    return F.coalesce(c.isNull() | test, F.lit(True))


def is_unset(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        test = c == ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(c) == 0
    else:
        test = F.lit(False)
    return F.coalesce(c.isNull() | test, F.lit(True))
