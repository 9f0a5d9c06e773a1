"""Registered record-building, vocabulary, class-list and label-encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjex.functions.records import language_code
from subjex.operators.decode import long_form
from subjex.operators.labels import code_indices, multi_hot
from subjex.plans import fixtures as fx
from subjex.plans.catalog import register
from subjex.sources import jsonld as J
from subjex.sources import vocab as V
from subjex.sources.tables import table

WS = fx.sql_ws()


def _records(spark, sf_dir):
    return J.extract_records(J.parse_documents(fx.jsonld_docs(spark, sf_dir)))


def _flat(df):
    return df.select("id", "type", "language", "title", "abstract",
                     F.array_join("gnd_subject_ids", "|").alias("gnd_subject_ids"),
                     F.array_join("linsearch_codes", "|").alias("linsearch_codes"))


@register("p1_p7_jsonld_records", f"""
with {fx.REC_SQL}, {fx.JSONLD_EXPECTED_SQL}
select * from expected""")
def p1_p7_jsonld_records(spark, sf_dir):
    """S2 + P1-P7 + F2-F4: JSON-LD documents to corpus records (list columns joined by |)."""
    return _flat(_records(spark, sf_dir))


@register("s2_jsonld_rejects", f"""
with {fx.REC_SQL}
select '3A' || id || '.v1.jsonld' as file_name from rec where doc_id % 17 = 0""")
def s2_jsonld_rejects(spark, sf_dir):
    """Documents that do not parse are set aside, by file name."""
    return J.rejects(J.parse_documents(fx.jsonld_docs(spark, sf_dir)))


def _exclusion_raw(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("source") == "src0")
    path = F.concat(F.lit("raw/"), F.col("source"), F.lit("/3A"), F.col("doc_id").cast("string"),
                    F.lit(".v1.jsonld"))
    # one exclusion document per listed file, each holding a one-element Records list
    js = d.select(F.to_json(F.struct(F.array(path).alias("Records"))).alias("value"))
    return js.select(F.from_json("value", "Records ARRAY<STRING>").alias("j")).select("j.Records")


@register("s3_exclusion_names", """
select distinct '3A' || cast(doc_id as varchar) || '.v1.jsonld' as file_name
from documents where source = 'src0'""")
def s3_exclusion_names(spark, sf_dir):
    """S3 + U2: base names of the paths in exclusion lists."""
    return J.exclusion_names(_exclusion_raw(spark, sf_dir))


@register("j1_excluded_corpus", f"""
with {fx.REC_SQL}, {fx.JSONLD_EXPECTED_SQL}
select e.id, e.type from expected e join documents d on e.id = '3A' || cast(d.doc_id as varchar) || '.v1'
where d.source <> 'src0'""")
def j1_excluded_corpus(spark, sf_dir):
    """Files on the exclusion list are removed before parsing (anti join)."""
    docs = J.drop_excluded(fx.jsonld_docs(spark, sf_dir), J.exclusion_names(_exclusion_raw(spark, sf_dir)))
    return J.extract_records(J.parse_documents(docs)).select("id", "type")


_URI_SQL = """case doc_id % 4
    when 0 then 'http://id.loc.gov/vocabulary/iso639-1/' || lang
    when 1 then 'http://id.loc.gov/vocabulary/iso639-1/' || lang || '/'
    when 2 then '' else null end"""


@register("p4_language_code", f"""
select doc_id, case when doc_id % 4 in (0, 1) then lang else 'und' end as language from documents""")
def p4_language_code(spark, sf_dir):
    """Language code from a URI (trailing slash, empty, missing)."""
    d = table(spark, sf_dir, "documents")
    uri = F.expr(_URI_SQL)
    return d.select("doc_id", language_code(uri).alias("language"))


# ---------------------------------------------------------------------------
# Vocabulary

def vocab_raw(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    words = F.split("text", " ")
    return b.select(
        i.alias("pos"),
        F.when(i % 7 == 3, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("gnd:"), (i % 25).cast("string"))).alias("Code"),
        F.when(i % 11 == 5, F.lit("")).otherwise(F.array_join(F.slice(words, 1, 3), " ")).alias("Name"),
        F.when(i % 3 == 0, F.array().cast("array<string>"))
         .when(i % 3 == 1, F.array(F.array_join(F.slice(words, 4, 2), " "))).otherwise(F.slice(words, 4, 2)).alias("Alternate Name"),
        F.when(i % 2 == 0, F.concat(F.lit("Class "), (i % 5).cast("string"))).alias("Classification Name"),
        F.when(F.size(words) > 5, F.array_join(F.slice(words, 6, F.greatest(F.size(words) - 5, F.lit(1))), " ")).alias("Definition"))


_VOCAB_RAW_SQL = f"""raw as (select item_id as pos,
   case when item_id % 7 = 3 then null else 'gnd:' || cast(item_id % 25 as varchar) end as code,
   case when item_id % 11 = 5 then '' else array_to_string(string_split(text, ' ')[1:3], ' ') end as name,
   case item_id % 3 when 0 then []::varchar[] when 1 then [array_to_string(string_split(text, ' ')[4:5], ' ')]
        else string_split(text, ' ')[4:5] end as alt,
   case when item_id % 2 = 0 then 'Class ' || cast(item_id % 5 as varchar) end as cls,
   case when len(string_split(text, ' ')) > 5 then array_to_string(string_split(text, ' ')[6:], ' ') end as defin
 from benchmark),
ent as (select pos, string_split(code, ':')[-1] as gnd_id,
   regexp_replace(concat_ws('. ', coalesce(name, ''), nullif(coalesce(array_to_string(alt, ' | '), ''), ''),
                            nullif(coalesce(cls, ''), ''),
                            case when coalesce(defin, '') <> '' then 'Definition: ' || defin end),
                  '^{WS}+|{WS}+$', '', 'g') as label_text
   from raw where coalesce(code, '') <> ''),
ent2 as (select * from ent where label_text <> '')"""


@register("p8_label_entries", f"""
with {_VOCAB_RAW_SQL}
select pos, gnd_id, label_text, 'passage: ' || label_text as emb_text from ent2""")
def p8_label_entries(spark, sf_dir):
    """S7 + P8 + P9 + P12 + F5: authority entries to (id, embedding text, label text)."""
    return V.vocabulary_entries(vocab_raw(spark, sf_dir)) \
        .select("pos", "gnd_id", "label_text", "emb_text")


@register("s12_label_index", f"""
with {_VOCAB_RAW_SQL},
last as (select gnd_id, label_text, row_number() over (partition by gnd_id order by pos desc) as rn
         from ent2)
select gnd_id, label_text, 'passage: ' || label_text as emb_text from last where rn = 1""")
def s12_label_index(spark, sf_dir):
    """S12 + A10: one label text per id, the last entry winning."""
    return V.label_index(vocab_raw(spark, sf_dir))


# ---------------------------------------------------------------------------
# Class lists and code maps

def _class_text(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    labels = F.array_sort(F.collect_set("label"))
    lines = F.flatten(F.transform(labels, lambda l: F.when(
        l % 3 == 0, F.array(F.concat(F.lit("  c"), l.cast("string"), F.lit(" ")), F.lit("   ")))
        .otherwise(F.array(F.concat(F.lit("c"), l.cast("string"))))))
    return e.agg(F.concat_ws("\n", lines).alias("value"))


_CLASSES_SQL = """classes as (select cast(row_number() over (order by label) - 1 as integer) as class_idx,
                           'c' || cast(label as varchar) as class
                    from (select distinct label from embeddings))"""


@register("s8_class_list", f"""
with {_CLASSES_SQL} select class_idx, class from classes""")
def s8_class_list(spark, sf_dir):
    """Class list text - strip, drop blank lines, keep order, number from 0."""
    return V.class_list_from_text(_class_text(spark, sf_dir))


@register("s9_code_map", f"""
with {_CLASSES_SQL} select class, class_idx from classes""")
def s9_code_map(spark, sf_dir):
    """JSON code -> index map."""
    e = table(spark, sf_dir, "embeddings")
    labels = F.array_sort(F.collect_set("label"))
    entries = F.transform(labels, lambda l, i: F.struct(F.concat(F.lit("c"), l.cast("string")), i))
    js = e.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    return V.code_map_from_json(js).select("class", F.col("class_idx").cast("int"))


@register("p18_multi_hot", f"""
with {fx.REC_SQL}, {fx.JSONLD_EXPECTED_SQL}, {_CLASSES_SQL}
select e.id, c.class_idx, cast(e.linsearch_codes = c.class as integer) as y
from expected e, classes c""")
def p18_multi_hot(spark, sf_dir):
    """Domain codes of each record as a multi-hot row over the class list."""
    classes = V.class_list_from_text(_class_text(spark, sf_dir))
    mh = multi_hot(_records(spark, sf_dir), "linsearch_codes", classes)
    return long_form(mh.select("id", "y"), "id", "y")


@register("j2_code_lookup", f"""
with {fx.REC_SQL}, {fx.JSONLD_EXPECTED_SQL}, {_CLASSES_SQL}
select e.id, c.class_idx from expected e join classes c on e.linsearch_codes = c.class""")
def j2_code_lookup(spark, sf_dir):
    """Code -> class index; unknown codes dropped."""
    classes = V.class_list_from_text(_class_text(spark, sf_dir))
    return code_indices(_records(spark, sf_dir), "id", "linsearch_codes", classes) \
        .select("id", F.col("class_idx").cast("int"))


@register("a1_corpus_counts", f"""
with {fx.REC_SQL}
select count(*) as files, sum(case when doc_id % 17 = 0 then 1 else 0 end)::bigint as rejected,
       sum(case when doc_id % 17 <> 0 and (doc_id % 13 = 0 or title = '') then 1 else 0 end)::bigint
         as no_main_node,
       sum(case when doc_id % 17 <> 0 and doc_id % 13 <> 0 and title <> '' then 1 else 0 end)::bigint
         as records
from rec""")
def a1_corpus_counts(spark, sf_dir):
    """A1: files read, rejected, without main node, and records written."""
    return J.corpus_counts(J.parse_documents(fx.jsonld_docs(spark, sf_dir)))


@register("s6_load_split", f"""
with {fx.REC_SQL}, {fx.JSONLD_EXPECTED_SQL}
select id, concat_ws(' [SEP] ',
         nullif(regexp_replace(title, '^{WS}+|{WS}+$', '', 'g'), ''),
         nullif(regexp_replace(abstract, '^{WS}+|{WS}+$', '', 'g'), '')) as text,
       linsearch_codes as labels
from expected""")
def s6_load_split(spark, sf_dir):
    """A split as (id, text, labels) - fields joined with [SEP], labels as strings."""
    from subjex.sources.sinks import load_split
    sp = load_split(_records(spark, sf_dir), ["title", "abstract"], "linsearch_codes")
    return sp.select("id", "text", F.array_join("labels", "|").alias("labels"))
