"""SQL building blocks for the DuckDB oracle, mirroring the Spark operators."""

from __future__ import annotations

from subjex.functions.text import WS_CLASS
from subjex.operators.lexical import BM25_B, BM25_EPSILON, BM25_K1, MINMAX_EPS


def ws_tokens_sql(expr: str) -> str:
    """T9 in DuckDB: lower, split on whitespace runs, drop empty strings."""
    return (f"list_filter(regexp_split_to_array(lower({expr}), '{WS_CLASS}+'), "
            f"lambda t: t <> '')")


def bm25_ctes(labels: str, label_id: str, label_text: str,
              queries: str, query_key: str, query_text: str) -> str:
    """CTEs ``post(term, id, w)``, ``stats(n, avgdl)`` and ``bm25(key, id, score)``."""
    k1, b, eps = BM25_K1, BM25_B, BM25_EPSILON
    return f"""
ltok as (select {label_id} as lid, {ws_tokens_sql(label_text)} as toks from {labels}),
ldl as (select lid, len(toks) as dl from ltok),
stats as (select count(*) as n, avg(dl) as avgdl from ldl),
ltf as (select lid, term, count(*) as tf
        from (select lid, unnest(toks) as term from ltok) group by lid, term),
ldf as (select term, count(*) as df from ltf group by term),
idfraw as (select term, ln(stats.n - df + 0.5) - ln(df + 0.5) as idf_raw from ldf, stats),
avgidf as (select avg(idf_raw) as a from idfraw),
idf as (select term, case when idf_raw < 0 then {eps} * a else idf_raw end as idf
        from idfraw, avgidf),
post as (select ltf.term, ltf.lid,
           idf.idf * ltf.tf * {k1 + 1.0} / (ltf.tf + {k1} * ({1.0 - b} + {b} * ldl.dl / stats.avgdl)) as w
         from ltf join idf on ltf.term = idf.term join ldl on ltf.lid = ldl.lid, stats),
qtok as (select {query_key} as qkey, unnest({ws_tokens_sql(query_text)}) as term from {queries}),
qf as (select qkey, term, count(*) as qf from qtok group by qkey, term),
bm25 as (select qkey, lid, sum(qf.qf * post.w) as score, count(*) as shared
         from qf join post on qf.term = post.term group by qkey, lid),
lterms as (select lid, count(*) as label_terms from ltf group by lid)"""


def minmax_ctes(n_labels_sql: str = "(select n from stats)") -> str:
    """``mm(qkey, mn, den)`` over bm25, zeros included when fewer labels matched."""
    return f"""
mmagg as (select qkey, count(*) as cnt, min(score) as mn0, max(score) as mx0 from bm25 group by qkey),
mm as (select qkey,
         case when cnt < {n_labels_sql} then least(mn0, 0.0) else mn0 end as mn,
         (case when cnt < {n_labels_sql} then greatest(mx0, 0.0) else mx0 end)
         - (case when cnt < {n_labels_sql} then least(mn0, 0.0) else mn0 end) + {MINMAX_EPS} as den
       from mmagg)"""


def cosine_sql(a: str, b: str) -> str:
    """Cosine of two float lists in double precision."""
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
    na = f"sqrt(list_sum(list_transform({a}, lambda x: x::double * x::double)))"
    nb = f"sqrt(list_sum(list_transform({b}, lambda x: x::double * x::double)))"
    return f"({dot} / greatest({na} * {nb}, 1e-12))"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_str(w) for w in words) + "]"


def clean_sql(expr: str) -> str:
    """T1 in DuckDB."""
    from subjex.functions.text import TRANSLIT_FROM, TRANSLIT_MULTI, TRANSLIT_TO
    col = f"translate(lower({expr}), {sql_str(TRANSLIT_FROM)}, {sql_str(TRANSLIT_TO)})"
    for src, dst in TRANSLIT_MULTI:
        col = f"replace({col}, {sql_str(src)}, {sql_str(dst)})"
    col = f"regexp_replace({col}, '[^a-z0-9]+', ' ', 'g')"
    return f"regexp_replace({col}, '^ | $', '', 'g')"


def word_tokens_sql(cleaned: str) -> str:
    """T2 in DuckDB: contraction splits, split on space, drop empty strings."""
    from subjex.functions.text import CONTRACTION_SPLIT_BEFORE_SPACE, CONTRACTION_SPLITS
    col = cleaned
    for a, b in CONTRACTION_SPLITS:
        col = f"regexp_replace({col}, '\\b({a})({b})\\b', '\\1 \\2', 'g')"
    for a, b in CONTRACTION_SPLIT_BEFORE_SPACE:
        col = f"regexp_replace({col}, '\\b({a})({b})( |$)', '\\1 \\2\\3', 'g')"
    return f"list_filter(string_split({col}, ' '), lambda t: t <> '')"


def route_sql(lang: str) -> str:
    """T5: de* -> de, else en."""
    return f"(case when starts_with(coalesce({lang}, ''), 'de') then 'de' else 'en' end)"


def stop_filter_sql(tokens: str, route: str) -> str:
    """Drop the stop words of the routed language."""
    from subjex.functions.text import default_stop_words
    de = sql_list(default_stop_words("german"))
    en = sql_list(default_stop_words("english"))
    return (f"(case when {route} = 'de' then list_filter({tokens}, lambda t: not list_contains({de}, t)) "
            f"else list_filter({tokens}, lambda t: not list_contains({en}, t)) end)")


def stem_sql(tokens: str, route: str) -> str:
    """T4 with the default suffix rule."""
    from subjex.operators.terms import MIN_STEM, SUFFIXES

    def rule(lang):
        parts = " ".join(
            f"when suffix(t, {sql_str(suf)}) and length(t) - {len(suf)} >= {MIN_STEM} "
            f"then left(t, length(t) - {len(suf)})" for suf in SUFFIXES[lang])
        return f"list_transform({tokens}, lambda t: case {parts} else t end)"
    return f"(case when {route} = 'de' then {rule('de')} else {rule('en')} end)"


def preprocess_sql(text: str, lang: str) -> str:
    """The full pipeline as one DuckDB expression."""
    route = route_sql(lang)
    toks = stop_filter_sql(word_tokens_sql(clean_sql(text)), route)
    return f"array_to_string({stem_sql(toks, route)}, ' ')"
