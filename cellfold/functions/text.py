"""Values as text: JSON, one-line renderings, number formats."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words for doubles that are no number.
NOT_A_NUMBER, INFINITE, MINUS_INFINITE = "nan", "inf", "-inf"

MAX_DECIMALS = 17


def shortest(value: Column) -> Column:
    """The shortest text that reads back as the same double.

    Plain digits unless the exponent form is shorter: 100, 0.25, 1e+05.  The
    digits are Java's; before Java 19 those are one too many for a few doubles.
    """
    v = value.cast("double")
    text = F.abs(v).cast("string")
    # Spark writes 0.001 … 10 million plainly; of those, only a single digit
    # before five or six zeros is shorter with an exponent.
    plain = F.regexp_replace(text, r"\.0$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "^([1-9])0{5}$", "$1e+05"), "^([1-9])0{6}$", "$1e+06")
    # Everything else is d.ddE±p.
    digits = F.regexp_replace(F.regexp_extract(text, "^([^E]*)", 1), r"\.0$|\.", "")
    power = F.regexp_extract(text, "E(.*)$", 1).try_cast("int")
    # Plain digits of a large whole number are those of its exact value.
    whole = F.when(F.abs(v) < F.lit(9.2e18), F.abs(v)).cast("bigint").cast("string")
    far = _placed(digits, power, whole)
    shown = F.when(F.contains(text, F.lit("E")), far).otherwise(plain)
    negative = (v < 0) | (v.cast("string") == "-0.0")
    return (F.when(F.isnan(v), F.lit(NOT_A_NUMBER)).when(v == float("inf"), F.lit(INFINITE))
            .when(v == float("-inf"), F.lit(MINUS_INFINITE))
            .when(negative, F.concat(F.lit("-"), shown)).otherwise(shown))


def _placed(digits: Column, power: Column, whole: Column) -> Column:
    """``d.dd * 10 ** power`` in whichever form is shorter, plain when they tie."""
    n = F.length(digits)
    plain_size = F.when(power < 0, n + 1 - power).otherwise(F.greatest(power + 1, n + 1))
    plain_size = F.when((power >= 0) & (power == n - 1), n).otherwise(plain_size)
    science_size = n + F.when(n > 1, 3).otherwise(2) + F.when(F.abs(power) > 99, 3).otherwise(2)
    plain = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(power >= n - 1, F.coalesce(whole, F.rpad(digits, power + 1, F.lit("0"))))
        .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    )
    science = F.concat(
        F.regexp_replace(digits, "^(.)(.+)$", "$1.$2"),
        F.when(power < 0, F.lit("e-")).otherwise("e+"),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")),
    )
    return F.when(plain_size <= science_size, plain).otherwise(science)


def _is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def element_text(value: Column, kind: T.DataType) -> Column:
    """One-line text of a value of any type: ``{a=1, b=[1, 2]}``."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}="), element_text(value[f.name], f.dataType)) for f in kind]
        inner = F.concat_ws(", ", *parts) if parts else F.lit("")
        return F.concat(F.lit("{"), inner, F.lit("}"))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(F.coalesce(value, F.array().cast(kind)), lambda e: element_text(e, kind.elementType))
        return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    if _is_float(kind):
        return F.coalesce(shortest(value), F.lit(""))
    if isinstance(kind, T.BinaryType):
        return F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(value))), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def json_text(value: Column, kind: T.DataType) -> Column:
    """A value as JSON on one line, written type by type.

    Numbers are the shortest text; NaN and the infinities, which JSON has no
    number for, are the words "nan", "inf" and "-inf".
    """
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{json.dumps(f.name, ensure_ascii=False)}: "), json_text(value[f.name], f.dataType)) for f in kind]
        inner = F.concat_ws(", ", *parts) if parts else F.lit("")
        return F.coalesce(F.concat(F.lit("{"), inner, F.lit("}")), F.lit("null"))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(F.coalesce(value, F.array().cast(kind)), lambda e: json_text(e, kind.elementType))
        return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    if _is_float(kind):
        v = value.cast("double")
        special = F.isnan(v) | (F.abs(v) == float("inf"))
        return F.coalesce(F.when(special, F.concat(F.lit('"'), shortest(v), F.lit('"'))).otherwise(shortest(v)), F.lit("null"))
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return F.coalesce(value.cast("string"), F.lit("null"))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value.cast("string"), F.lit("null"))
    text = element_text(value, kind) if isinstance(kind, T.BinaryType) else value.cast("string")
    # Spark writes the string literal, escapes included, as the value of a one-field object.
    quoted = F.to_json(F.struct(text.alias("s")))
    return F.when(value.isNull(), F.lit("null")).otherwise(
        F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def format_float(value: Column, how: str = "shortest", decimals: int = 6) -> Column:
    """A double as text; what is not finite has no decimals."""
    if how == "shortest":
        return shortest(value)
    if how not in ("fixed", "scientific"):
        raise ValueError(f"there is no format {how}")
    places = min(max(decimals, 0), MAX_DECIMALS)
    text = F.format_string(f"%.{places}{'f' if how == 'fixed' else 'e'}", value.cast("double"))
    finite = F.abs(value) < float("inf")
    return F.when(finite, text).otherwise(shortest(value))
