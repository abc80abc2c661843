"""Breadcrumb and brand JSON to names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false"}
_BLANKS_IN_JSON = " \t\r\n"
# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _raw_names(text: Column) -> Column:
    """Names of the JSON objects in a list; elements that are no object give NULL.

    The first parse covers lists of objects and nulls. A list that also holds
    scalars or lists fails it as a whole, and only then the second one runs.
    """
    objects = F.from_json(text, "array<struct<name:string>>", _STRICT)["name"]
    mixed = F.transform(
        F.from_json(text, "array<string>", _STRICT),
        lambda element: F.get_json_object(element, "$.name"),
    )
    return F.coalesce(objects, mixed)


def _bracketed(text: Column, opening: str, closing: str) -> Column:
    bare = F.trim(text, F.lit(_BLANKS_IN_JSON))
    return bare.startswith(opening) & bare.endswith(closing)


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def breadcrumb_names(text: Column) -> Column:
    """JSON list of ``{"name": …}`` to an array of names; anything but a list is NULL."""
    return F.when(_bracketed(text, "[", "]"), F.array_compact(_raw_names(text)))


def breadcrumb_path(text: Column, lower: bool = True) -> Column:
    """JSON list of ``{"name": …}`` to ``a,b,c``; lower case and stripped unless told not to."""
    # array_join leaves NULL names out, so no array_compact is needed here.
    path = F.when(_bracketed(text, "[", "]"), F.array_join(_raw_names(text), ","))
    return strip(F.lower(path)) if lower else path


def brand_names(text: Column) -> Column:
    """JSON list of brand objects, or one object, to an array of names."""
    readable = _bracketed(text, "[", "]") | _bracketed(text, "{", "}")
    return F.when(readable, F.array_compact(_raw_names(text)))


def last_name(names: Column) -> Column:
    """Deepest breadcrumb, NULL when there is none."""
    return F.try_element_at(names, F.lit(-1))


def literal_list(text: Column) -> Column:
    """A list written as a Python literal (``['A', 'B']``) to an array of text."""
    return F.from_json(
        text,
        "array<string>",
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )
