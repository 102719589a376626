"""Reading JSON out of model replies: arrays, truncated arrays, fenced objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip

#: The patterns by which replies are read, which results must agree with.
ARRAY = r"(?s)\[\s*\{.*\}\s*\]"
FLAT_OBJECT = r"(?s)\{[^{}]*\}"
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
WIDEST_OBJECT = r"(?s)\{.*\}"
RETRY = r"(?i)retry[^\d]*(\d+)"


def array_text(c: Column) -> Column:
    """The widest bracketed array of objects, else the whole text."""
    found = F.regexp_extract(c, ARRAY, 0)
    return F.when(found != "", found).otherwise(c)


def json_array(c: Column, element: str) -> Column:
    """Array of structs, or null when the text holds none."""
    return F.from_json(array_text(c), f"array<{element}>")


def salvage(c: Column, element: str) -> Column:
    """As json_array; from a truncated reply, the complete flat objects it holds."""
    flat = F.transform(F.regexp_extract_all(c, F.lit(FLAT_OBJECT), F.lit(0)), lambda o: F.from_json(o, element))
    whole = json_array(c, element)
    return F.when(whole.isNotNull() & (F.size(whole) > 0), whole).otherwise(F.filter(flat, lambda o: o.isNotNull()))


def json_object(c: Column, schema: str) -> Column:
    """A fenced object, else the whole text, else from the first to the last brace."""
    def read(x: Column) -> Column:
        s = F.from_json(F.nullif(strip(x), F.lit("")), schema)
        first = schema.split(",")[0].split()[0]
        return F.when(s[first].isNotNull(), s)

    fence = F.regexp_extract(c, FENCED_OBJECT, 1)
    return F.coalesce(read(fence), read(c), read(F.regexp_extract(c, WIDEST_OBJECT, 0)))


def headlines(c: Column) -> Column:
    """The stripped non-empty strings of an object's headlines list; empty when there is none."""
    got = json_object(c, "headlines array<string>")["headlines"]
    return F.coalesce(F.filter(F.transform(got, strip), lambda h: h != ""), F.array().cast("array<string>"))


def retry_delay(c: Column) -> Column:
    """Seconds to wait that an error names, plus 5; 65 without a number."""
    return F.coalesce(F.try_add(F.nullif(F.regexp_extract(c, RETRY, 1), F.lit("")).try_cast("int"), F.lit(5)), F.lit(65))


def error_class(c: Column) -> Column:
    return F.when(c.contains("429"), "rate").when(c.contains("503") | c.contains("UNAVAILABLE"), "unavailable").otherwise("other")
