"""Full text preprocessing (T6, T7): clean, tokenise, route by language, drop stop
words, normalise terms, join with spaces.

Several text fields of a record are processed together, in the row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjex.functions import text as X
from subjex.operators.terms import MAX_BROADCAST_TERMS, StemFn, stem_tokens, suffix_stem, suffix_stem_tokens  # noqa: F401
from subjex.session import ship_package

MODES = ("standard", "umlaut")


def route_exact(lang) -> Column:
    """T7 routing: German only for exactly ``de``."""
    return F.when(F.coalesce(X._c(lang), F.lit("")) == "de", F.lit("de")).otherwise(F.lit("en"))


def field_tokens(text, route: Column, mode: str = "standard") -> Column:
    """Tokens of one field after cleaning and stop-word removal (before stemming)."""
    if mode == "standard":
        toks = X.word_tokens(X.clean(text))
    elif mode == "umlaut":
        toks = X.split_whitespace(X.clean_umlaut(text))
    else:
        raise ValueError("mode must be one of: " + " | ".join(MODES))
    return X.remove_stop_words(toks, route)


def preprocess_fields(df: DataFrame, key: str, fields: dict[str, str], lang: str,
                      mode: str = "standard", stem: StemFn = suffix_stem,
                      keep: tuple[str, ...] | None = None) -> DataFrame:
    """``key``, the ``keep`` columns (default: all columns but the
    inputs) and one preprocessed text column per ``fields`` entry (output name ->
    input column).

    Terms are normalised in the row, by the default rule as a column expression, by any
    other one in a worker (``stem_tokens``); tokens are never exploded.  With another rule,
    the records of one key come out as one, their tokens by position.
    """
    if keep is None:
        keep = tuple(c for c in df.columns if c != key and c not in fields.values())
    route = X.route_language(lang) if mode == "standard" else route_exact(lang)
    if stem is suffix_stem:
        # the default rule is a column expression: everything stays in the row
        r = df.select(key, *keep, route.alias("_route"), *[F.col(c) for c in set(fields.values())])
        toks = r.select(key, *keep, "_route", *[field_tokens(F.col(src), F.col("_route"), mode).alias(f"_t{i}")
                                                for i, src in enumerate(fields.values())])
        outs = [F.array_join(suffix_stem_tokens(F.col(f"_t{i}"), F.col("_route")), " ").alias(name)
                for i, name in enumerate(fields)]
        return toks.select(key, *keep, *outs)
    ship_package(df.sparkSession)
    r = df.select(key, *keep, route.alias("_route"), *[F.col(c) for c in set(fields.values())])
    toks = r.select(key, *keep, "_route", *[field_tokens(F.col(src), F.col("_route"), mode).alias(f"_t{i}")
                                            for i, src in enumerate(fields.values())])
    names = [f"_t{i}" for i in range(len(fields))]
    none = F.expr("cast(array() as array<string>)")
    # a record with a missing field has no tokens
    whole = F.when(reduce(and_, [F.col(n).isNotNull() for n in names]), F.struct(*names)) \
        .otherwise(F.struct(*[none.alias(n) for n in names]))
    toks = toks.select(key, *keep, "_route", whole.alias("_t"))
    terms = F.struct(*[stem_tokens(stem)(F.col(f"_t.{n}"), F.col("_route")).alias(n) for n in names])
    grouped = toks.select(key, *keep, terms.alias("_r")).groupBy(key, *keep).agg(F.collect_list("_r").alias("_s"))
    outs = [F.array_join(_in_order(F.transform("_s", _field(n))), " ").alias(name) for n, name in zip(names, fields)]
    return grouped.select(key, *keep, *outs)


def _field(name: str):
    return lambda r: r[name]


def _in_order(lists: Column) -> Column:
    """The terms of a key's records by position; of one record, its terms as they are."""
    placed = F.flatten(F.transform(lists, lambda a: F.transform(a, lambda t, i: F.struct(i.alias("pos"), t.alias("t")))))
    return F.when(F.size(lists) == 1, F.element_at(lists, 1)).otherwise(F.transform(F.array_sort(placed), lambda x: x["t"]))
