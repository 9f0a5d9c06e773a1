"""Registered text-normalisation and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjex.functions import text as X
from subjex.operators.preprocess import preprocess_fields
from subjex.operators.snowball import snowball_stem
from subjex.operators.terms import build_term_dictionary, stem_dictionary, suffix_stem_col
from subjex.plans import fixtures as fx
from subjex.plans.catalog import register
from subjex.plans.sqlparts import (clean_sql, route_sql, stem_sql, stop_filter_sql,
                                   word_tokens_sql, ws_tokens_sql)
from subjex.sources.tables import table

WS = X.WS_CLASS
MAX_TOKENS = 512


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_STEPS = f"""c1 as (select doc_id, lang, {clean_sql('text')} as c from documents),
c2 as (select doc_id, lang, {route_sql('lang')} as route, {word_tokens_sql('c')} as toks from c1),
c3 as (select doc_id, route, {stop_filter_sql('toks', 'route')} as kept from c2),
c4 as (select doc_id, route, {stem_sql('kept', 'route')} as terms from c3)"""


@register("t1_clean", f"select doc_id, {clean_sql('text')} as cleaned from documents")
def t1_clean(spark, sf_dir):
    """Lower, transliterate, non-alphanumerics to one space, trim."""
    return _docs(spark, sf_dir).select("doc_id", X.clean("text").alias("cleaned"))


@register("t2_word_tokens", f"""
with {_STEPS}
select doc_id, cast(len(toks) as integer) as n_tokens, array_to_string(toks, ' ') as tokens from c2""")
def t2_word_tokens(spark, sf_dir):
    """Word tokens of the cleaned text."""
    t = _docs(spark, sf_dir).select("doc_id", X.word_tokens(X.clean("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("t3_stop_words", f"""
with {_STEPS}
select doc_id, cast(len(kept) as integer) as n_kept, array_to_string(kept, ' ') as kept from c3""")
def t3_stop_words(spark, sf_dir):
    """T3 + T5: stop words of the routed language removed."""
    d = _docs(spark, sf_dir)
    kept = X.remove_stop_words(X.word_tokens(X.clean("text")), X.route_language("lang"))
    return d.select("doc_id", kept.alias("k")).select(
        "doc_id", F.size("k").alias("n_kept"), F.array_join("k", " ").alias("kept"))


@register("t5_language_route", f"select doc_id, {route_sql('lang')} as route from documents")
def t5_language_route(spark, sf_dir):
    """T5: de* -> German rules, all else English."""
    return _docs(spark, sf_dir).select("doc_id", X.route_language("lang").alias("route"))


@register("t4_term_dictionary", f"""
with {_STEPS},
dict as (select distinct route as lang, unnest(kept) as token from c3)
select lang, token, {stem_sql('[token]', 'lang')}[1] as term from dict""")
def t4_term_dictionary(spark, sf_dir):
    """T4: distinct (language, token) pairs with their normalised term."""
    d = _docs(spark, sf_dir)
    route = X.route_language("lang")
    t = d.select(route.alias("lang"), X.remove_stop_words(X.word_tokens(X.clean("text")), route)
                 .alias("toks"))
    dictionary = build_term_dictionary(t, "lang", "toks")
    return dictionary.withColumn("term", suffix_stem_col(F.col("token"), F.col("lang")))


@register("t4_snowball_terms")
def t4_snowball_terms(spark, sf_dir):
    """T4 + E3: the term dictionary of all documents with the Snowball stem of each term."""
    route = X.route_language("lang")
    t = _docs(spark, sf_dir).select(route.alias("lang"), X.remove_stop_words(X.word_tokens(X.clean("text")), route).alias("toks"))
    return stem_dictionary(build_term_dictionary(t, "lang", "toks"), snowball_stem)


@register("t6_snowball_preprocess")
def t6_snowball_preprocess(spark, sf_dir):
    """T6 with Snowball stems: the stemmer runs once per distinct term, joined back to the tokens."""
    d = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    return preprocess_fields(d, "doc_id", {"pre": "text"}, "lang", stem=snowball_stem, keep=()).select("doc_id", "pre")


@register("t6_preprocess", f"""
with {_STEPS}
select doc_id, array_to_string(terms, ' ') as pre from c4""")
def t6_preprocess(spark, sf_dir):
    """Clean -> tokens -> stop words -> terms -> joined with spaces."""
    d = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    return preprocess_fields(d, "doc_id", {"pre": "text"}, "lang", keep=()).select("doc_id", "pre")


_UMLAUT = f"""u1 as (select doc_id, (case when coalesce(lang, '') = 'de' then 'de' else 'en' end) as route,
              list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-ZäöüÄÖÜß{WS[1:-1]}]', '', 'g'),
                                               '{WS}+'), lambda t: t <> '') as toks from documents),
u2 as (select doc_id, route, {stop_filter_sql('toks', 'route')} as kept from u1),
u3 as (select doc_id, {stem_sql('kept', 'route')} as terms from u2)"""


@register("t7_preprocess_umlaut", f"""
with {_UMLAUT}
select doc_id, array_to_string(terms, ' ') as pre from u3""")
def t7_preprocess_umlaut(spark, sf_dir):
    """The alternate preprocess (keeps umlauts, deletes digits, German only for 'de')."""
    d = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    return preprocess_fields(d, "doc_id", {"pre": "text"}, "lang", mode="umlaut", keep=()) \
        .select("doc_id", "pre")


_SPLIT = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda t: t <> '')"


@register("t8_truncate", f"""
with s as (select doc_id, {_SPLIT} as toks from documents)
select doc_id, cast(len(toks) as integer) as n_tokens,
       array_to_string(toks[1:{MAX_TOKENS}], ' ') as head from s""")
def t8_truncate(spark, sf_dir):
    """Token count and the first 512 whitespace tokens."""
    s = _docs(spark, sf_dir).select("doc_id", X.split_whitespace("text").alias("t"))
    return s.select("doc_id", F.size("t").alias("n_tokens"),
                    F.array_join(X.truncate_tokens("t", MAX_TOKENS), " ").alias("head"))


@register("t9_lexical_tokens", f"""
with s as (select doc_id, {ws_tokens_sql('text')} as toks from documents)
select doc_id, cast(len(toks) as integer) as n_tokens, array_to_string(toks, ' ') as tokens from s""")
def t9_lexical_tokens(spark, sf_dir):
    """Lower-cased whitespace tokens, as used by BM25."""
    s = _docs(spark, sf_dir).select("doc_id", X.whitespace_tokens("text").alias("t"))
    return s.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


# ---------------------------------------------------------------------------
# Prompts and text assembly over rec

def _strip_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


@register("p10_text_assembly", f"""
with {fx.REC_SQL}
select id, concat_ws(' [SEP] ', nullif({_strip_sql('title')}, ''), nullif({_strip_sql('abstract')}, '')) as text
from rec""")
def p10_text_assembly(spark, sf_dir):
    """P10: stripped fields joined with [SEP], empty ones skipped."""
    return fx.rec(spark, sf_dir).select("id", X.assemble_text("title", "abstract").alias("text"))


@register("p11_query_prefix", f"""
with {fx.REC_SQL}
select id, 'query: ' || concat_ws(' [SEP] ', nullif({_strip_sql('title')}, ''),
                                  nullif({_strip_sql('abstract')}, '')) as text from rec""")
def p11_query_prefix(spark, sf_dir):
    """e5-style query prefix on the assembled text."""
    return fx.rec(spark, sf_dir).select(
        "id", X.query_prefix(X.assemble_text("title", "abstract"), True).alias("text"))


@register("p12_passage_prefix", f"""
with {fx.VOCAB_SQL} select gnd_id, 'passage: ' || label_text as emb_text from vocab""")
def p12_passage_prefix(spark, sf_dir):
    """Passage prefix on vocabulary text."""
    return fx.vocab(spark, sf_dir).select("gnd_id", X.passage_prefix("label_text").alias("emb_text"))


@register("p13_abstract_flatten", f"""
with {fx.REC_SQL}
select id, case when doc_id % 2 = 0 then substring(abstract, 1, 100) || ' ' || substring(abstract, 101)
                else abstract end as abstract from rec""")
def p13_abstract_flatten(spark, sf_dir):
    """List-valued abstracts (JSON text of a list) joined with one space."""
    r = fx.rec(spark, sf_dir)
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array(
        F.substring("abstract", 1, 100), F.expr("substring(abstract, 101)")))) \
        .otherwise(F.to_json(F.array("abstract")).substr(F.lit(2), F.length(F.to_json(F.array("abstract"))) - 2))
    return r.select("id", X.flatten_abstract(F.parse_json(raw)).alias("abstract"))


@register("p14_retrieval_text", f"""
with {fx.REC_SQL}
select id, 'query: ' || title || ' ' || abstract as query_text, title || ' ' || abstract as pair_text from rec""")
def p14_retrieval_text(spark, sf_dir):
    """Retrieval query text and rerank pair text."""
    return fx.rec(spark, sf_dir).select("id", X.retrieval_query_text("title", "abstract").alias("query_text"),
                                        X.pair_text("title", "abstract").alias("pair_text"))


@register("p15_language_tagged", f"""
with {fx.REC_SQL}
select id, 'query: ' || (case when starts_with(language, 'en') then '[EN]' else '[DE]' end) || ' '
           || title || '. ' || abstract as text from rec""")
def p15_language_tagged(spark, sf_dir):
    """Language-tagged retrieval text."""
    return fx.rec(spark, sf_dir).select(
        "id", X.language_tagged_query("title", "abstract", "language").alias("text"))


@register("p16_zero_shot_text", f"""
with {fx.REC_SQL} select id, title || '. ' || abstract as text from rec""")
def p16_zero_shot_text(spark, sf_dir):
    """Zero-shot text."""
    return fx.rec(spark, sf_dir).select("id", X.zero_shot_text("title", "abstract").alias("text"))


_TYPE_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in X.PROMPT_TYPE_NAMES)


@register("p17_prompt", f"""
with {fx.REC_SQL},
r1 as (select id, language, type, {route_sql('language')} as route,
         {word_tokens_sql(clean_sql('title'))} as ttoks, {word_tokens_sql(clean_sql('abstract'))} as atoks from rec),
r2 as (select *, {stop_filter_sql('ttoks', 'route')} as tk, {stop_filter_sql('atoks', 'route')} as ak from r1),
r3 as (select *, array_to_string({stem_sql('tk', 'route')}, ' ') as tp,
                 array_to_string({stem_sql('ak', 'route')}, ' ') as ap from r2)
select id, 'This is a ' || (case when starts_with(lower(coalesce(language, '')), 'en') then 'English' else 'German' end)
       || ' ' || coalesce(case type {_TYPE_CASE} end, '{X.PROMPT_DEFAULT_TYPE}') || '. '
       || tp || ' </s> ' || ap as prompt from r3""")
def p17_prompt(spark, sf_dir):
    """Classification prompt over preprocessed title and abstract."""
    r = fx.rec(spark, sf_dir)
    pre = preprocess_fields(r, "id", {"tp": "title", "ap": "abstract"}, "language",
                            keep=("language", "type"))
    return pre.select("id", X.prompt_text("tp", "ap", "language", "type").alias("prompt"))



