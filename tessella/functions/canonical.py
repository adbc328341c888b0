"""Canonical JSON of nested columns and its hash: one text for each value, whatever the order of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that JSON strings escape by a letter; other control characters are escaped by number.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(text: Column) -> Column:
    """A JSON string; only quotes, backslashes and control characters are escaped, in lower case."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    whole = plain
    for code in range(32):
        c = chr(code)
        whole = F.replace(whole, F.lit(c), F.lit(SHORT.get(c, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), whole).otherwise(plain), F.lit('"'))


def number(value: Column) -> Column:
    """A fixed form for floating numbers: up to nine decimals, no zeros at the end but one after the point; others as null."""
    fixed = F.regexp_replace(F.regexp_replace(F.round(value, 9).cast("decimal(38,9)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(F.isnan(value) | (F.abs(value) >= 1e28), F.lit(None)).otherwise(F.when(value == 0, "0.0").otherwise(fixed))


def canonical(value: Column, kind: T.DataType) -> Column:
    """``value`` of type ``kind`` as JSON without white space, keys sorted at every level; null is ``null``."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f'"{f.name}":'), canonical(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(F.transform_keys(value, lambda k, _: k.cast("string"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), canonical(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (T.BooleanType, T.DecimalType, *NUMBERS)):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(value.cast("double"))
    elif isinstance(kind, T.BinaryType):
        text = quoted(F.base64(value))
    else:
        text = quoted(value.cast("string"))
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def canonical_text(json: Column) -> Column:
    """JSON text of any shape with keys sorted at every level and no white space; null if it is none."""
    return F.to_json(F.try_parse_json(json))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
