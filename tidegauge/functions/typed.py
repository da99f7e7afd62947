"""JSON text by its types, with VARIANT: values that compare as they mean, whatever the order of their fields and the way numbers are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.columns import col


def frozen(json: Column | str) -> Column:
    """JSON as one text for all that are equal: fields by name, numbers without needless zeros, no spaces. Null for what is no JSON."""
    return F.to_json(F.try_parse_json(col(json)))


def fields(json: Column | str) -> Column:
    """The fields of a JSON object with their values frozen, as a map of text; null for anything else."""
    whole = F.try_variant_get(F.try_parse_json(col(json)), "$", "map<string,variant>")
    return F.transform_values(whole, lambda _, v: F.to_json(v))


def items(json: Column | str) -> Column:
    """The items of a JSON array, frozen; null for anything else."""
    return F.transform(F.try_variant_get(F.try_parse_json(col(json)), "$", "array<variant>"), lambda v: F.to_json(v))


def is_text(value: Column) -> Column:
    return F.startswith(value, F.lit('"'))


def text_of(value: Column | str) -> Column:
    """What a frozen text value says, without quotes and escapes; null for numbers, objects and the rest."""
    v = col(value)
    return F.when(is_text(v), F.try_variant_get(F.try_parse_json(v), "$", "string"))


def number_of(value: Column | str) -> Column:
    """A frozen number, or a text that reads as one."""
    v = col(value)
    return F.coalesce(text_of(v), F.when(~v.isin("true", "false"), v)).try_cast("double")


def texts_in(json: Column | str) -> Column:
    """All text values at any depth, in the order of the frozen text; names of fields are none."""
    tokens = F.regexp_extract_all(frozen(json), F.lit(r'"(?:[^"\\]|\\.)*":?'), F.lit(0))
    return F.transform(F.filter(tokens, lambda t: ~F.endswith(t, F.lit(":"))), text_of)


def same(a: Column, b: Column) -> Column:
    """Whether two frozen values are equal; numbers are by value, so 1e3 is 1000, and a text is no number."""
    numbers = ~is_text(a) & ~is_text(b) & (a.try_cast("double") == b.try_cast("double"))
    return F.coalesce((a == b) | numbers, F.lit(False))


def written(**values: Column) -> Column:
    """An object of typed columns as a map of frozen values; null columns are the value null."""
    pairs = [x for name, v in values.items() for x in (F.lit(name), F.coalesce(_one(v), F.lit("null")))]
    return F.create_map(*pairs)


def _one(v: Column) -> Column:
    # to_json writes structs, so that the value goes as the only field and comes out frozen.
    return F.element_at(fields(F.to_json(F.struct(v.alias("v")))), "v")


def object_of(values: Column) -> Column:
    """A map of frozen values as JSON text."""
    pairs = F.transform(F.map_entries(values), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
    # A key is written as the only item of an array, to have its escapes.
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.regexp_replace(p, r"^\[(\"(?:[^\"\\\\]|\\\\.)*\")\]", "$1")), ","), F.lit("}"))


def array_of(values: Column) -> Column:
    """An array of frozen values as JSON text."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit("null"))), ","), F.lit("]"))


def at_path(json: Column, path: Column) -> Column:
    """What stands at a path such as a.b[3] or a[0][1].c, frozen; null where it leads nowhere."""
    steps = F.regexp_extract_all(path, F.lit(r"\[\d+\]|[^.\[\]]+"), F.lit(0))

    def walk(v: Column, step: Column) -> Column:
        place = F.regexp_extract(step, r"^\[(\d+)\]$", 1)
        inner = F.try_parse_json(v)
        item = F.to_json(F.get(F.try_variant_get(inner, "$", "array<variant>"), place.try_cast("int")))
        field = F.to_json(F.element_at(F.try_variant_get(inner, "$", "map<string,variant>"), step))
        return F.when(place != "", item).otherwise(field)

    return F.aggregate(steps, frozen(json), walk)
