"""Type names of table schemas, and the parsing of their literals, as Spark types and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The type names that schemas may use.
TYPES: dict[str, T.DataType] = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "DECIMAL": T.DecimalType(19, 4), "VARCHAR": T.StringType(), "CHAR": T.StringType(), "BOOL": T.BooleanType(),
    "DATE": T.DateType(), "TIME": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "INTLIST": T.ArrayType(T.IntegerType()), "LONGLIST": T.ArrayType(T.LongType()), "FLOATLIST": T.ArrayType(T.FloatType()), "DOUBLELIST": T.ArrayType(T.DoubleType()),
}


class UnknownType(ValueError):
    pass


def data_type(name: str) -> T.DataType:
    try:
        return TYPES[name.strip().upper()]
    except KeyError:
        raise UnknownType(name) from None


def schema(fields: list[tuple[str, str]]) -> T.StructType:
    """(name, type name) pairs as a schema; names may not repeat."""
    names = [n for n, _ in fields]
    if len({n.lower() for n in names}) != len(names):
        raise ValueError(f"repeated field in {names}")
    return T.StructType([T.StructField(n, data_type(t)) for n, t in fields])


def decimal(text: Column) -> Column:
    """A decimal with four digits; further digits are cut, not rounded."""
    cut = F.regexp_replace(F.trim(text), r"^([+-]?\d*)(\.\d{0,4})?\d*$", "$1$2")
    return F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), cut.try_cast("decimal(19,4)"))


def decimal_multiply(a: Column, b: Column) -> Column:
    """Product of two decimals with four digits, cut towards zero."""
    return _cut(a.cast("decimal(19,4)") * b.cast("decimal(19,4)"))


def decimal_divide(a: Column, b: Column) -> Column:
    """Quotient of two decimals with four digits, cut towards zero; null for a zero divisor."""
    scaled = F.call_function("div", (a.cast("decimal(19,4)") * 10000 * 10000).cast("decimal(38,0)"), F.nullif((b.cast("decimal(19,4)") * 10000).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))
    return (scaled.cast("decimal(28,4)") / 10000).cast("decimal(19,4)")


def _cut(x: Column) -> Column:
    return (F.when(x < 0, -F.floor(-x * 10000)).otherwise(F.floor(x * 10000)).cast("decimal(28,4)") / 10000).cast("decimal(19,4)")


def parse(text: Column, kind: str) -> Column:
    """The value that a text field of a CSV file has; null if it is malformed."""
    name = kind.strip().upper()
    target = data_type(name)
    if name == "DECIMAL":
        return decimal(text)
    if name == "BOOL":
        return F.when(text == "True", F.lit(True)).when(text == "False", F.lit(False))
    if isinstance(target, T.ArrayType):
        return F.from_json(text, target.simpleString())
    if name in ("VARCHAR", "CHAR"):
        return text
    if name == "DATE":
        return F.try_to_date(F.trim(text), "yyyy-MM-dd")
    if name == "TIME":
        return F.when(F.trim(text).rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), F.trim(text))
    return F.trim(text).try_cast(target)


def spelled(column: Column, target: T.DataType) -> Column:
    """A value as text: booleans True and False, lists [1, 2]."""
    if isinstance(target, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column.cast("string")
