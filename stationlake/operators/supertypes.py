"""Common supertypes of column types, for unions of tables whose schemas have
evolved apart (U1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers by width, with the decimal digits that hold any value.
_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_REAL = (T.FloatType, T.DoubleType)


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, (*_WHOLE, *_REAL, T.DecimalType))


def _common_number(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, _REAL) or isinstance(b, _REAL):
        # A float holds whole numbers of two bytes exactly, and no others.
        small = all(isinstance(t, (T.FloatType, T.ByteType, T.ShortType)) for t in (a, b))
        return T.FloatType() if small else T.DoubleType()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        a, b = (t if isinstance(t, T.DecimalType) else T.DecimalType(_WHOLE[type(t)], 0) for t in (a, b))
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else T.DoubleType()
    return a if _WHOLE[type(a)] >= _WHOLE[type(b)] else b


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The smallest type that holds the values of both; TypeError if there is none.

    Symmetric and associative but for decimals too wide to meet exactly, which
    meet as doubles.  Binary data, intervals and instants (``timestamp``, whose
    text depends on the session zone) meet only their own kind; an instant and
    a date or zoneless time have no common type.
    """
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if _is_number(a) and _is_number(b):
        return _common_number(a, b)
    kinds = {type(a), type(b)}
    if kinds == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    texts = (T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)
    if T.StringType in kinds and all(_is_number(t) or isinstance(t, texts) for t in (a, b)):
        return T.StringType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType),
                         a.valueContainsNull or b.valueContainsNull)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema(a, b)
    raise TypeError(f"no type holds both {a.simpleString()} and {b.simpleString()}")


def common_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    """The fields of ``a``, then those that only ``b`` has, each with its
    common type; a field that one side lacks may be null."""
    fields = []
    for f in a.fields:
        if f.name in b.fieldNames():
            other = b[f.name]
            fields.append(T.StructField(f.name, common_type(f.dataType, other.dataType), f.nullable or other.nullable))
        else:
            fields.append(T.StructField(f.name, f.dataType, True))
    fields += [T.StructField(f.name, f.dataType, True) for f in b.fields if f.name not in a.fieldNames()]
    return T.StructType(fields)


def cast_to(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """``c`` of type ``have`` as the supertype ``want``; struct fields that it
    lacks are null, and null stays null at every depth."""
    if have == want:
        return c
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: cast_to(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(
            cast_to(e["key"], have.keyType, want.keyType).alias("key"),
            cast_to(e["value"], have.valueType, want.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        fields = [(cast_to(c[f.name], have[f.name].dataType, f.dataType) if f.name in have.fieldNames()
                   else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c.cast(want)
