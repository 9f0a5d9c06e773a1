"""Per-term normalisation in the row or through a term dictionary.

A stemmer or lemmatiser is per-term Python.  ``stem_tokens`` runs it in the row.  Instead of calling it for every
token, the distinct ``(lang, token)`` pairs form a dictionary; the function runs
once per entry in ``mapInPandas`` and the result is joined back on
``(lang, token)``.  Frequent tokens are skewed join keys on the token side: they are split
by salt (``skew.salted_join``), the dictionary's one row per key repeated per salt.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.operators.encoders import slices
from subjex.operators.skew import hot_keys, salted_join
from subjex.session import ship_package

StemFn = Callable[[str, str], str]

# The normalised dictionary is broadcast only below this measured row count.
MAX_BROADCAST_TERMS = 2_000_000

# Terms a worker remembers while it normalises token arrays.
REMEMBERED_TERMS = 1 << 17

# Default term normaliser: a small suffix-stripping rule that stays a column
# expression.  ``snowball.snowball_stem``, or any other ``(lang, token) -> term``
# function, can be passed instead.  Suffixes are tried in order; the stem keeps
# at least MIN_STEM characters.
SUFFIXES = {"de": ("ungen", "ung", "en", "er", "es", "e", "s"),
            "en": ("ing", "ed", "es", "s")}
MIN_STEM = 3


def suffix_stem(lang: str, token: str) -> str:
    for suf in SUFFIXES.get(lang, SUFFIXES["en"]):
        if token.endswith(suf) and len(token) - len(suf) >= MIN_STEM:
            return token[: -len(suf)]
    return token


def _suffix_rule(token, lang: str):
    expr = None
    for suf in SUFFIXES[lang]:
        cond = F.endswith(token, F.lit(suf)) & (F.length(token) - len(suf) >= MIN_STEM)
        val = F.left(token, F.length(token) - len(suf))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(token)


def suffix_stem_col(token, lang):
    """``suffix_stem`` as a column expression: the same rule without a Python worker."""
    return F.when(lang == F.lit("de"), _suffix_rule(token, "de")).otherwise(_suffix_rule(token, "en"))


def suffix_stem_tokens(tokens, lang):
    """The rule over a token array; the language is tested once per row."""
    return F.when(lang == F.lit("de"), F.transform(tokens, lambda t: _suffix_rule(t, "de"))) \
        .otherwise(F.transform(tokens, lambda t: _suffix_rule(t, "en")))


def stem_tokens(stem: StemFn):
    """A function of (token array, language) columns: the array of terms, by any Python rule.

    Nothing is shuffled: the rule runs once per distinct (language, token) of some rows where
    the record is, and a worker remembers the last terms.  A token without a term stays.
    """
    @F.arrow_udf("array<string>")
    def run(tokens: pa.Array, lang: pa.Array) -> pa.Array:
        known = lru_cache(REMEMBERED_TERMS)(stem)
        out = []
        for a, n in slices(tokens):
            part = tokens.slice(a, n)
            size = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            word, route = part.flatten().dictionary_encode(), lang.slice(a, n).dictionary_encode()
            words, routes = word.dictionary.to_pylist(), route.dictionary.to_pylist()
            key = np.repeat(route.indices.to_numpy(zero_copy_only=False).astype(np.int64), size) * max(len(words), 1) \
                + word.indices.to_numpy(zero_copy_only=False)
            distinct, place = np.unique(key, return_inverse=True)
            pairs = [(routes[k // len(words)], words[k % len(words)]) for k in distinct.tolist()]
            terms = pa.array([t if (term := known(r, t)) is None else term for r, t in pairs], pa.string())
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), terms.take(pa.array(place))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))
    return run


def build_term_dictionary(df: DataFrame, lang: str, tokens: str) -> DataFrame:
    """``(lang, token)`` - the distinct terms of a tokenised table; repeats within a record go
    before they become rows."""
    return df.select(F.col(lang).alias("lang"), F.explode(F.array_distinct(tokens)).alias("token")).distinct()


def stem_dictionary(dictionary: DataFrame, stem: StemFn = suffix_stem) -> DataFrame:
    """``(lang, token, term)`` - the function applied once per distinct term."""
    ship_package(dictionary.sparkSession)
    def run(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf["term"] = [stem(l, t) for l, t in zip(pdf["lang"], pdf["token"])]
            yield pdf
    return dictionary.mapInPandas(run, "lang STRING, token STRING, term STRING")


def normalize_terms(df: DataFrame, key: str, lang: str, tokens: str, dictionary: DataFrame,
                    out: str = "terms") -> DataFrame:
    """Replace each token by its dictionary term, keeping token order.

    Tokens are exploded with their position, joined with the dictionary and
    regrouped per record (one group per record, bounded by its length).
    Records without tokens keep an empty list.
    """
    ex = df.select(key, F.col(lang).alias("lang"), F.posexplode(tokens).alias("pos", "token"))
    load = ex.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(ex, dictionary, ["lang", "token"], hot_keys(load, ["lang", "token"]), how="left")
    grouped = (joined.groupBy(key)
                     .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("term", "token")
                                                                .alias("t")))).alias("_s"))
                     .select(key, F.col("_s.t").alias(out)))
    return (df.join(grouped, key, "left")
              .withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>"))))


def normalize(df: DataFrame, key: str, lang: str, tokens: str, stem: StemFn = suffix_stem,
              out: str = "terms") -> DataFrame:
    """T4: dictionary build + per-term function + join back."""
    dictionary = stem_dictionary(build_term_dictionary(df, lang, tokens), stem)
    return normalize_terms(df, key, lang, tokens, dictionary, out)
