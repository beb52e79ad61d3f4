"""Field paths, truth and equality of loosely typed records as Catalyst expressions, and small run-time tests."""

from __future__ import annotations

import collections.abc
import functools
import inspect
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"[^.\[\]]+")


def split_field_path(path: str) -> list[str]:
    """'a.b[0]' to ['a', 'b', '0']; quotes and a leading dot go. A key that holds a dot can't be addressed."""
    if not isinstance(path, str):
        raise TypeError(f"a field path must be a string, got {type(path).__name__}")
    return _STEP.findall(path.replace('"', "").replace("'", ""))


def kind_of(df: DataFrame, path: str) -> T.DataType | None:
    """The type at a path of df's rows, or None if the schema has no such path."""
    steps, kind = split_field_path(path), df.schema
    for s in steps:
        if isinstance(kind, T.StructType) and s in kind.names:
            kind = kind[s].dataType
        elif isinstance(kind, T.ArrayType) and s.isdigit():
            kind = kind.elementType
        elif isinstance(kind, T.MapType):
            kind = kind.valueType
        elif isinstance(kind, T.VariantType):
            return kind
        else:
            return None
    return kind


def path_column(df: DataFrame, path: str) -> Column:
    """The value at a path: struct fields, array places (null beyond the end), map keys, variant members. Unknown paths are null."""
    first, *steps = split_field_path(path)
    if first not in df.columns:
        return F.lit(None)
    out, kind = F.col(f"`{first}`"), df.schema[first].dataType
    for i, s in enumerate(steps):
        if isinstance(kind, T.StructType) and s in kind.names:
            out, kind = out.getField(s), kind[s].dataType
        elif isinstance(kind, T.ArrayType) and s.isdigit():
            out, kind = F.get(out, F.lit(int(s))), kind.elementType
        elif isinstance(kind, T.MapType):
            out, kind = F.try_element_at(out, F.lit(s)), kind.valueType
        elif isinstance(kind, T.VariantType):
            rest = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in steps[i:])
            return F.try_variant_get(out, f"${rest}", "string")
        else:
            return F.lit(None)
    return out


class Fields:
    """Columns of a record by attribute or key: what a callable predicate or key gets, so that it builds an expression."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str) -> Column:
        return self[name]

    def __getitem__(self, path: str) -> Column:
        return path_column(self._df, path)


def column_of(df: DataFrame, what: Column | str | Callable[[Fields], Column]) -> Column:
    """A Column as it is, a string as a path, a callable by what it builds from the fields."""
    if isinstance(what, Column):
        return what
    if isinstance(what, str):
        return path_column(df, what)
    found = what(Fields(df))
    return found if isinstance(found, Column) else F.lit(found)


def condition_of(df: DataFrame, what: Column | str | Callable[[Fields], Column]) -> Column:
    """Like column_of(), but a string is an SQL condition."""
    return F.expr(what) if isinstance(what, str) else column_of(df, what)


def type_of(df: DataFrame, column: Column) -> T.DataType:
    return df.select(column.alias("c")).schema["c"].dataType


def truthy(column: Column, kind: T.DataType) -> Column:
    """Whether a value counts as true: no null, false, zero, NaN or empty string; arrays and records do, empty ones too. Never null."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return column.isNotNull() & ~F.isnan(column) & (column != 0)
    if isinstance(kind, T.NumericType):
        return column.isNotNull() & (column != 0)
    if isinstance(kind, T.StringType):
        return column.isNotNull() & (column != "")
    if isinstance(kind, T.NullType):
        return F.lit(False)
    return column.isNotNull()


def escape_reg_exp(text: str) -> str:
    """A pattern that matches the text literally, in Java's regular expressions too: they let any non-letter be escaped."""
    return re.escape(text)


def traverse(record: Any, path: str | list[str], default: Any = None) -> Any:
    """The value at a path of nested dicts and lists; default where the path is absent."""
    for s in split_field_path(path) if isinstance(path, str) else path:
        if isinstance(record, dict) and s in record:
            record = record[s]
        elif isinstance(record, (list, tuple, str)) and str(s).isdigit() and int(s) < len(record):
            record = record[int(s)]
        else:
            return default
    return record


def get(record: Any, path: str, default: Any = None) -> Any:
    return traverse(record, path, default)


def make_getter(path: str | Callable, default: Any = None) -> Callable[[Any], Any]:
    if callable(path):
        return path
    steps = split_field_path(path)
    return lambda record: traverse(record, steps, default)


def has(record: Any, key: str) -> bool:
    if isinstance(record, DataFrame):
        return key in record.columns
    return record is not None and (key in record if isinstance(record, dict) else hasattr(record, key))


def is_defined(x: Any) -> bool:
    return x is not None


def is_iterable(x: Any) -> bool:
    return isinstance(x, collections.abc.Iterable)


def is_async_iterable(x: Any) -> bool:
    return isinstance(x, collections.abc.AsyncIterable)


def is_promise(x: Any) -> bool:
    return inspect.isawaitable(x)


def is_function(x: Any) -> bool:
    return callable(x)


def is_string(x: Any) -> bool:
    return isinstance(x, str)


def is_error(x: Any) -> bool:
    return isinstance(x, BaseException)


def is_readable(x: Any) -> bool:
    return hasattr(x, "read")


partial = functools.partial


def ncurry(n: int, fn: Callable, *given: Any) -> Callable:
    """fn that gathers arguments over calls until there are n."""

    def more(*args: Any) -> Any:
        every = (*given, *args)
        return fn(*every) if len(every) >= n else ncurry(n, fn, *every)

    return more


def curry(fn: Callable) -> Callable:
    """ncurry() with the number of arguments that fn has no defaults for."""
    return ncurry(sum(p.default is p.empty for p in inspect.signature(fn).parameters.values()), fn)
