"""JSON-LD record building from a parsed document.

A raw document is one JSON text per row.  ``try_parse_json`` turns it into a
VARIANT (NULL when broken), and every field is picked with variant paths, so a
field that is an object in one file and a list in the next needs no schema.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from subjex.functions.text import py_strip

# Marker of the domain-code subject strings, the code dropped,
# the prefix removed from subject ids, and the language of a record without one.
LINSEARCH_MARKER = "classificationName=linsearch:mapping"
DROPPED_CODE = "rest"
GND_PREFIX = "gnd:"
UNDETERMINED = "und"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def field(node, key: str) -> Column:
    """A member of a JSON object as VARIANT (NULL when absent)."""
    return F.try_variant_get(_c(node), f'$["{key}"]', "variant")


def kind(v) -> Column:
    """Upper-case type name of a VARIANT value: STRING, ARRAY<..>, OBJECT<..>, ..."""
    return F.schema_of_variant(_c(v))


def truthy(v) -> Column:
    """Python truthiness of a JSON value: non-empty string / list / object,
    non-zero number, true."""
    s = F.try_variant_get(_c(v), "$", "string")
    k = kind(v)
    return (F.when(_c(v).isNull(), F.lit(False))
             .when(k == F.lit("STRING"), s != F.lit(""))
             .otherwise(~s.isin("[]", "{}", "false", "0", "0.0", "null")))


def as_string(v) -> Column:
    """A string value; a list gives its first element (list-valued ``@type`` or
    ``language`` would stop the reference)."""
    first = F.when(kind(v).startswith("ARRAY"), F.try_variant_get(_c(v), "$[0]", "string"))
    return F.coalesce(first, F.try_variant_get(_c(v), "$", "string"))


def as_text(v) -> Column:
    """A string, or the items of a list joined with one space."""
    return F.coalesce(F.array_join(F.try_variant_get(_c(v), "$", "array<string>"), " "),
                      F.try_variant_get(_c(v), "$", "string"))


def main_node(doc) -> Column:
    """The first node of ``@graph`` with a truthy ``@type`` and ``title``."""
    graph = F.try_variant_get(_c(doc), '$["@graph"]', "array<variant>")
    picked = F.filter(graph, lambda n: truthy(field(n, "@type")) & truthy(field(n, "title")))
    return F.get(picked, 0)


def record_id(file_name) -> Column:
    """File name without its last extension (a leading dot is not one)."""
    return F.regexp_replace(_c(file_name), r"(?<=.)\.[^.]*$", "")


def record_type(type_value) -> Column:
    """The part after the last ``:``."""
    return F.substring_index(_c(type_value), ":", -1)


def language_code(uri) -> Column:
    """Last non-empty path segment of a language URI; ``und`` when none."""
    segs = F.filter(F.split(F.coalesce(_c(uri), F.lit("")), "/"), lambda s: s != F.lit(""))
    return F.coalesce(F.get(F.reverse(segs), 0), F.lit(UNDETERMINED))


def subject_ids(subject) -> Column:
    """``@id`` of an object, or of every object with one in a list; the
    ``gnd:`` prefix removed; order and repeats kept; other shapes give []."""
    as_list = F.try_variant_get(_c(subject), "$", "array<variant>")
    obj_id = F.try_variant_get(_c(subject), '$["@id"]', "string")
    from_list = F.transform(
        F.filter(as_list, lambda d: kind(d).startswith("OBJECT")
                 & F.try_variant_get(d, '$["@id"]', "string").isNotNull()),
        lambda d: F.replace(F.try_variant_get(d, '$["@id"]', "string"), F.lit(GND_PREFIX), F.lit("")))
    from_obj = F.when(kind(subject).startswith("OBJECT") & (F.coalesce(obj_id, F.lit("")) != ""),
                      F.array(F.replace(obj_id, F.lit(GND_PREFIX), F.lit(""))))
    return F.coalesce(from_list, from_obj, F.array().cast("array<string>"))


def domain_codes(subject) -> Column:
    """P7 + F3 + F4: codes of the marked subject strings (text after the last
    ``)``, stripped), without ``rest``; a single string counts as a list of one."""
    items = F.coalesce(F.try_variant_get(_c(subject), "$", "array<string>"),
                       F.when(kind(subject) == F.lit("STRING"),
                              F.array(F.try_variant_get(_c(subject), "$", "string"))),
                       F.array().cast("array<string>"))
    marked = F.filter(items, lambda s: F.contains(s, F.lit(LINSEARCH_MARKER)))
    codes = F.transform(marked, lambda s: py_strip(F.substring_index(s, ")", -1)))
    return F.filter(codes, lambda c: c != F.lit(DROPPED_CODE))
