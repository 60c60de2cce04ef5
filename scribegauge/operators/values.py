"""Annotated values: JSON text to tagged keys, and what is wrong with it, by VARIANT probes.

:func:`canonical_state` reads plain forms by one pattern each; whatever else
there is goes through a VARIANT, whose kinds and fields are probed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import LATERALITY, NUMERIC_TYPES
from .readings import RATIO, let, nothing, plain_digits, ratio, shortest, unit_of

#: What Python's decimal type reads as a finite number, and as none.
NUMERAL = r"^\s*[+-]?(\p{Nd}+(\.\p{Nd}*)?|\.\p{Nd}+)([eE][+-]?\p{Nd}+)?\s*$"
NOT_FINITE = r"(?i)^\s*[+-]?(inf(inity)?|s?nan\p{Nd}*)\s*$"


def quoted(text: Column) -> Column:
    """A text as Python shows it."""
    plain = F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'))
    return F.when(text.isNull(), "None").when(text.contains("'") & ~text.contains('"'), double).otherwise(plain)


def kind_of(value: Column) -> Column:
    """JSON kind of a variant: STRING, BOOLEAN, OBJECT, ARRAY, VOID or a numeric type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _number_fault(value: Column) -> Column:
    text = F.regexp_replace(F.replace(text_of(value), F.lit(","), F.lit(".")), "_", "")
    shown = F.when(kind_of(value) == "STRING", quoted(text_of(value))).otherwise(F.coalesce(text_of(value), F.to_json(value), F.lit("None")))
    good = F.coalesce(text.rlike(NUMERAL) | text_of(value).rlike(RATIO), F.lit(False)) & kind_of(value).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE")
    return (
        F.when(kind_of(value) == "BOOLEAN", "a clinical number cannot be a boolean")
        .when(good, nothing())
        .when(text.rlike(NOT_FINITE), "a clinical number must be finite")
        .otherwise(F.concat(F.lit("not a clinical number: "), shown))
    )


def number_text(value: Column) -> Column:
    """A valid number or ratio as the body of its key."""
    text = F.trim(F.regexp_replace(F.replace(text_of(value), F.lit(","), F.lit(".")), "_", ""))
    powered = F.coalesce(plain_digits(text).try_cast("decimal(38,18)").cast("string"), text)
    return F.when(text.rlike(RATIO), ratio(text)).when(text.rlike("[eE]"), shortest(powered)).otherwise(shortest(F.regexp_replace(text, r"^([+-]?)\.", "$10.")))


def _parts(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _quantity_fault(value: Column) -> Column:
    def judged(parts: Column) -> Column:
        unit, amount = F.try_element_at(parts, F.lit("unit")), F.try_element_at(parts, F.lit("value"))
        return (
            F.when(F.array_sort(F.map_keys(parts)) != F.array(F.lit("unit"), F.lit("value")), "a quantity needs exactly value and unit")
            .when(unit_of(F.lower(text_of(unit))).isNull(), F.concat(F.lit("unknown clinical unit: "), quoted(text_of(unit))))
            .otherwise(_number_fault(amount))
        )

    return let(_parts(value), judged)


def shape_fault(kind: Column, value: Column) -> Column:
    """What contradicts the kind of a value at first sight (null value: nothing)."""
    is_object = kind_of(value) == "OBJECT"
    both = let(_parts(value), lambda p: F.map_contains_key(p, "value") & F.map_contains_key(p, "unit"))
    return (
        F.when(value.isNull() | (kind_of(value) == "VOID"), "canonical value is required")
        .when((kind == "NEGATION") & (kind_of(value) != "BOOLEAN"), "NEGATION canonical must be boolean")
        .when((kind == "LATERALITY") & ~((kind_of(value) == "STRING") & text_of(value).isin(*LATERALITY)), "invalid LATERALITY canonical")
        .when((kind == "DOSE") & ~F.when(is_object, both).otherwise(False), "DOSE requires a value/unit object")
    )


def value_fault(kind: Column, value: Column) -> Column:
    """Why a value of the right shape is invalid."""
    numeric = F.when(kind_of(value) == "OBJECT", _quantity_fault(value)).otherwise(_number_fault(value))
    blank = ~((kind_of(value) == "STRING") & (text_of(value) != ""))
    return F.when(kind.isin(*NUMERIC_TYPES), numeric).when(
        ~kind.isin("NEGATION", "LATERALITY") & blank, F.concat(kind, F.lit(" canonical must be a non-empty string"))
    )


def value_key(kind: Column, value: Column) -> Column:
    """Tagged key of a valid value."""
    parts = _parts(value)
    measured = let(parts, lambda p: F.concat(F.lit("q:"), number_text(p["value"]), F.lit("|"), unit_of(F.lower(text_of(p["unit"])))))
    bare = let(number_text(value), lambda n: F.concat(F.when(n.contains("/"), "r:").otherwise("n:"), n))
    return (
        F.when(kind.isin(*NUMERIC_TYPES), F.when(kind_of(value) == "OBJECT", measured).otherwise(bare))
        .when(kind == "NEGATION", F.concat(F.lit("b:"), text_of(value)))
        .otherwise(F.concat(F.lit("t:"), text_of(value)))
    )


#: Plain forms of a quantity, and of a flag or a side.
PLAIN_QUANTITY = r'^\{"value": ?"?([+-]?[0-9]+(?:\.[0-9]+)?|[0-9]+/[0-9]+)"?, ?"unit": ?"([^"\\]+)"\}$'
STATE = "struct<shape:string,fault:string,key:string>"


def _state(shape: Column, fault: Column, key: Column) -> Column:
    return F.struct(shape.alias("shape"), fault.alias("fault"), key.alias("key"))


def canonical_state(kind: Column, canonical: Column) -> Column:
    """``STATE`` of an annotated value: the fault of its shape, the fault of its value, and its key."""
    amount, unit = F.regexp_extract(canonical, PLAIN_QUANTITY, 1), unit_of(F.lower(F.regexp_extract(canonical, PLAIN_QUANTITY, 2)))
    measured = let(amount, lambda a: F.concat(F.lit("q:"), F.when(a.contains("/"), ratio(a)).otherwise(shortest(a)), F.lit("|"), unit))
    plain_flag = (kind == "NEGATION") & canonical.isin("true", "false")
    plain_side = (kind == "LATERALITY") & canonical.isin(*(f'"{side}"' for side in LATERALITY))
    probed = let(F.try_parse_json(canonical), lambda v: _state(shape_fault(kind, v), value_fault(kind, v), value_key(kind, v)))
    return (
        F.when(plain_flag, _state(nothing(), nothing(), F.concat(F.lit("b:"), canonical)))
        .when(plain_side, _state(nothing(), nothing(), F.concat(F.lit("t:"), F.replace(canonical, F.lit('"'), F.lit("")))))
        .when(kind.isin(*NUMERIC_TYPES) & canonical.rlike(PLAIN_QUANTITY) & unit.isNotNull(), _state(nothing(), nothing(), measured))
        .otherwise(probed)
    )
