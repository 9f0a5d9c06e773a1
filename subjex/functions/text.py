"""Row-local text expressions: cleaning, tokens, stop words, prompts.

All functions return ``Column`` expressions built from Spark SQL built-ins, so
they run inside whole-stage codegen and need no Python worker.  The only
per-term Python step (stemming) lives in ``subjex.operators.terms``.
"""

from __future__ import annotations

import functools
import unicodedata
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for equal results).
#
# Whitespace as Python's ``str.split()``/``str.strip()`` sees it: tab, newline,
# vertical tab, form feed, carriage return, the four information separators,
# space, next-line, no-break space, ogham space, en quad .. hair space, line and
# paragraph separators, narrow no-break space, medium mathematical space,
# ideographic space.  Literal characters, so the class is the same in Java regex
# and RE2 (DuckDB).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = f"[{WS_CHARS}]"

# Letters that Unicode does not decompose, by script, as ASCII (lower case input):
# Latin, then Cyrillic and Greek letter by letter.
TRANSLIT_LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "đ": "d", "ħ": "h", "ı": "i",
                  "ĸ": "k", "ł": "l", "ŋ": "ng", "ø": "o", "ŧ": "t", "ĳ": "ij", "ŀ": "l", "µ": "u"}
TRANSLIT_CYRILLIC = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z",
                     "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
                     "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch",
                     "ш": "sh", "щ": "shch", "ы": "y", "э": "e", "ю": "iu",
                     "я": "ia", "і": "i", "є": "ie", "ґ": "g", "й": "i", "ё": "e", "ї": "i"}
TRANSLIT_GREEK = {"α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th",
                  "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
                  "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps",
                  "ω": "o"}

# Word-tokenizer splits that survive cleaning (only [a-z0-9 ] is left, so the
# punctuation rules do nothing): word -> two tokens.
CONTRACTION_SPLITS = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"),
                      ("lem", "me"))
# "wanna" is split when white space follows it; the tokenizer pads the text with spaces
# first, so the end of the text counts.
CONTRACTION_SPLIT_BEFORE_SPACE = (("wan", "na"),)

# Prompt wording and record-type names of the classification prompt.
PROMPT_TYPE_NAMES = (("Article", "article"), ("Book", "book"),
                     ("Conference", "conference paper"), ("Report", "report"),
                     ("Thesis", "thesis"))
PROMPT_DEFAULT_TYPE = "article"
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "
SEP = " [SEP] "
# ---------------------------------------------------------------------------

#: Blocks whose lower-case letters, digits and marks are mapped by their decomposition:
#: Latin-1 to Latin Extended-B, Greek, Cyrillic, Latin Extended Additional, super- and subscripts.
_DECOMPOSED = ((0xA0, 0x250), (0x370, 0x400), (0x400, 0x460), (0x1E00, 0x1F00), (0x2070, 0x20A0))


def _ascii_of(ch: str) -> str | None:
    """The ASCII letters and digits a character stands for, None when there are none."""
    table = TRANSLIT_LATIN | TRANSLIT_CYRILLIC | TRANSLIT_GREEK
    if ch in table:
        return table[ch]
    base = [c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)]
    out = "".join(table.get(c, c) for c in base)
    return out.lower() if out and out.isascii() and out.isalnum() else None


_MAP = {chr(c): to for a, b in _DECOMPOSED for c in range(a, b) if (to := _ascii_of(chr(c))) is not None}
#: Combining marks vanish, so decomposed letters come out like composed ones.
_MAP |= {chr(c): "" for c in range(0x300, 0x370)}
_SINGLE = {k: v for k, v in sorted(_MAP.items()) if len(v) == 1}
_GONE = "".join(k for k, v in sorted(_MAP.items()) if not v)
#: Characters without a target at the end of ``translate``'s list are deleted (both engines).
TRANSLIT_FROM = "".join(_SINGLE) + _GONE
TRANSLIT_TO = "".join(_SINGLE.values())
TRANSLIT_MULTI = tuple((k, v) for k, v in sorted(_MAP.items()) if len(v) > 1)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip()`` does
    (``btrim`` over the whitespace set: no regex)."""
    return F.btrim(_c(x), F.lit(WS_CHARS))


_OTHER_WS = WS_CHARS.replace(" ", "")


def split_whitespace(x) -> Column:
    """``str.split()``: every whitespace character becomes a space (``translate``,
    character-level), then a split on the single space (no regex), empty
    strings dropped."""
    spaced = F.translate(_c(x), _OTHER_WS, " " * len(_OTHER_WS))
    return F.filter(F.split(spaced, " "), lambda t: t != F.lit(""))


def whitespace_tokens(x) -> Column:
    """``text.lower().split()`` - lower case, split on whitespace runs, no cleaning."""
    return split_whitespace(F.lower(_c(x)))


def transliterate(x) -> Column:
    col = F.translate(_c(x), TRANSLIT_FROM, TRANSLIT_TO)
    for src, dst in TRANSLIT_MULTI:
        col = F.replace(col, F.lit(src), F.lit(dst))
    return col


def clean(x) -> Column:
    """Lower, transliterate Latin, Cyrillic and Greek letters to ASCII, anything else but
    letters and digits to one space, trim."""
    col = transliterate(F.lower(_c(x)))
    col = F.regexp_replace(col, "[^a-z0-9]+", " ")
    return F.btrim(col, F.lit(" "))


def split_contractions(x) -> Column:
    """One regex pass: a space after the first part of each listed word (the
    second part must follow, then a word end - or a space for the last kind)."""
    alts = [rf"{a}(?={b}\b)" for a, b in CONTRACTION_SPLITS]
    alts += [rf"{a}(?={b}(?: |$))" for a, b in CONTRACTION_SPLIT_BEFORE_SPACE]
    return F.regexp_replace(_c(x), r"\b(?:" + "|".join(alts) + ")", "$0 ")


def word_tokens(cleaned) -> Column:
    """Tokens of cleaned text (only ``[a-z0-9 ]`` left), with contraction splits."""
    return F.filter(F.split(split_contractions(cleaned), " "), lambda t: t != F.lit(""))


def route_language(lang) -> Column:
    """T5: ``de*`` -> German rules, everything else -> English."""
    return F.when(F.startswith(F.coalesce(_c(lang), F.lit("")), F.lit("de")), F.lit("de")) \
        .otherwise(F.lit("en"))


@functools.lru_cache(maxsize=None)
def default_stop_words(language: str) -> tuple[str, ...]:
    """The default list of ``StopWordsRemover``, kept as a word file in ``subjex/data``.

    It stands in for the reference's list and can be replaced by any sequence of words.
    """
    path = resources.files("subjex") / "data" / f"stopwords_{language}.txt"
    lines = path.read_text(encoding="utf-8").splitlines()
    return tuple(w for w in (x.strip() for x in lines) if w and not w.startswith("#"))


def transliterate_word(word: str) -> str:
    """The cleaner's transliteration applied to a Python string (lower case)."""
    return "".join(_MAP.get(c, c) for c in word)


def remove_stop_words(tokens, lang_route, de_words=None, en_words=None,
                      transliterate_list: bool = False) -> Column:
    """Drop stop words of the routed language (``de`` or ``en``).

    The lists are a few hundred words; ``isin`` over literals becomes a hash-set
    lookup (``InSet``) per token - in-row, no join, no shuffle.  Text is
    transliterated before this step, so list words with umlauts never match (as
    in the reference); ``transliterate_list`` transliterates the list as well.
    """
    de = list(de_words or default_stop_words("german"))
    en = list(en_words or default_stop_words("english"))
    if transliterate_list:
        de = sorted({transliterate_word(w) for w in de})
        en = sorted({transliterate_word(w) for w in en})
    # the list is chosen once per row, not per token
    return F.when(_c(lang_route) == F.lit("de"), F.filter(_c(tokens), lambda t: ~t.isin(*de))) \
        .otherwise(F.filter(_c(tokens), lambda t: ~t.isin(*en)))


def clean_umlaut(x) -> Column:
    """T7 cleaning: lower, delete everything but letters, umlauts, sharp s and whitespace."""
    return F.regexp_replace(F.lower(_c(x)), f"[^a-zA-ZäöüÄÖÜß{WS_CLASS[1:-1]}]", "")


def truncate_tokens(tokens, n: int) -> Column:
    """Keep the first ``n`` tokens."""
    return F.slice(_c(tokens), 1, n)


# ---------------------------------------------------------------------------
# Projections: text assembly and prompts

def as_text(x) -> Column:
    """A string field that may be missing: null becomes the empty string."""
    col = _c(x)
    return F.coalesce(col, F.lit(""))


def assemble_text(*fields) -> Column:
    """P10: strip each field, join the non-empty ones with `` [SEP] ``."""
    parts = [F.nullif(py_strip(as_text(f)), F.lit("")) for f in fields]
    return F.concat_ws(SEP, *parts)


def query_prefix(x, enabled: bool = True) -> Column:
    """``query: `` prefix for e5-style encoders when enabled."""
    return F.concat(F.lit(QUERY_PREFIX), _c(x)) if enabled else _c(x)


def passage_prefix(x) -> Column:
    """``passage: `` prefix for vocabulary text."""
    return F.concat(F.lit(PASSAGE_PREFIX), _c(x))


def flatten_abstract(abstract) -> Column:
    """A list-valued abstract is joined with one space, by the value's type.

    The field is a VARIANT, in which a list and a string that looks like one differ: the
    string "[2019]" stays as it is.
    """
    col = _c(abstract)
    as_list = F.when(F.startswith(F.schema_of_variant(col), F.lit("ARRAY")), F.try_variant_get(col, "$", "array<string>"))
    return F.coalesce(F.array_join(as_list, " "), F.try_variant_get(col, "$", "string"), F.lit(""))


def retrieval_query_text(title, abstract) -> Column:
    """``query: {title} {abstract}``."""
    return F.concat(F.lit(QUERY_PREFIX), pair_text(title, abstract))


def pair_text(title, abstract) -> Column:
    """``{title} {abstract}`` (text side of rerank pairs and BM25 query)."""
    return F.concat(as_text(title), F.lit(" "), as_text(abstract))


def language_tagged_query(title, abstract, lang) -> Column:
    """``query: [EN] {title}. {abstract}``; EN when the code starts with ``en``."""
    tag = F.when(F.startswith(F.coalesce(_c(lang), F.lit("")), F.lit("en")), F.lit("[EN]")) \
        .otherwise(F.lit("[DE]"))
    return F.concat(F.lit(QUERY_PREFIX), tag, F.lit(" "), as_text(title), F.lit(". "),
                    as_text(abstract))


def zero_shot_text(title, abstract) -> Column:
    """``{title}. {abstract}``."""
    return F.concat(as_text(title), F.lit(". "), as_text(abstract))


def prompt_text(title, abstract, lang, rec_type) -> Column:
    """``This is a {English|German} {type}. {title} </s> {abstract}``.

    ``title`` and ``abstract`` are expected to be preprocessed already (T6).
    """
    lang_name = F.when(F.startswith(F.lower(F.coalesce(_c(lang), F.lit(""))), F.lit("en")),
                       F.lit("English")).otherwise(F.lit("German"))
    type_map = F.create_map(*[F.lit(v) for kv in PROMPT_TYPE_NAMES for v in kv])
    type_name = F.coalesce(F.try_element_at(type_map, _c(rec_type)), F.lit(PROMPT_DEFAULT_TYPE))
    return F.concat(F.lit("This is a "), lang_name, F.lit(" "), type_name, F.lit(". "),
                    as_text(title), F.lit(" </s> "), as_text(abstract))
