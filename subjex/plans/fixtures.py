"""Inputs derived inside Spark from the given tables, and the same derivations in SQL.

Each Spark-side fixture reads whole tables; the SQL-side text is the equivalent
for the DuckDB oracle (views ``documents``, ``benchmark``, ``embeddings``, ...).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.functions.text import WS_CLASS, whitespace_tokens
from subjex.operators.decode import MAX_CLASSES, bounded_collect
from subjex.operators.encoders import TfIdfEncoder, term_buckets
from subjex.operators.zeroshot import class_centroids
from subjex.session import spread, written
from subjex.sources.tables import table


def sql_ws() -> str:
    """The whitespace class as a SQL string body (no quotes inside)."""
    return WS_CLASS


# ---------------------------------------------------------------------------
# rec: corpus-like records from documents

REC_TYPES = ("Article", "Book", "Conference", "Report", "Thesis", "Other")


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    type_col = F.element_at(F.array(*[F.lit(t) for t in REC_TYPES]),
                            (F.col("doc_id") % len(REC_TYPES) + 1).cast("int"))
    return d.select(F.col("doc_id").cast("string").alias("id"), "doc_id",
                    F.col("lang").alias("language"), type_col.alias("type"),
                    F.substring("text", 1, 60).alias("title"),
                    F.expr("substring(text, 61)").alias("abstract"))


REC_SQL = """rec as (
  select cast(doc_id as varchar) as id, doc_id, lang as language,
    case doc_id % 6 when 0 then 'Article' when 1 then 'Book' when 2 then 'Conference'
                    when 3 then 'Report' when 4 then 'Thesis' else 'Other' end as type,
    substring(text, 1, 60) as title, substring(text, 61) as abstract
  from documents)"""


# ---------------------------------------------------------------------------
# vocab: the subject vocabulary from benchmark

def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("gnd_id"), F.col("text").alias("label_text"))


VOCAB_SQL = "vocab as (select cast(item_id as varchar) as gnd_id, text as label_text from benchmark)"


# ---------------------------------------------------------------------------
# vectors of every document and every vocabulary entry: one TF-IDF encoder fitted on the
# whole texts of both, by a bucket rule that both engines have.

VECTOR_DIM = 240


def record_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the buckets of their terms: texts are split and hashed once, into a
    written table; the encoder is fitted on it and the vectors follow from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return written(spread(docs).withColumn("_b", term_buckets(whitespace_tokens("text"), VECTOR_DIM)), "record-buckets")


def text_encoder(spark: SparkSession, sf_dir: str, buckets: DataFrame | None = None) -> TfIdfEncoder:
    """Fitted on the whole texts of ``buckets`` (``record_buckets``) and the vocabulary."""
    buckets = record_buckets(spark, sf_dir) if buckets is None else buckets
    labels = table(spark, sf_dir, "benchmark").select(term_buckets(whitespace_tokens("text"), VECTOR_DIM).alias("b"))
    return TfIdfEncoder.of_buckets(buckets.select(F.col("_b").alias("b")).unionByName(labels), VECTOR_DIM)


def label_vectors(spark: SparkSession, sf_dir: str, encoder: TfIdfEncoder | None = None) -> DataFrame:
    return (encoder or text_encoder(spark, sf_dir)).transform(vocab(spark, sf_dir), "label_text")


def record_vectors(spark: SparkSession, sf_dir: str, encoder: TfIdfEncoder | None = None,
                   buckets: DataFrame | None = None) -> DataFrame:
    buckets = record_buckets(spark, sf_dir) if buckets is None else buckets
    encoder = encoder or text_encoder(spark, sf_dir, buckets)
    return buckets.select("doc_id", "text", "lang", encoder.vector(F.col("_b"), spark).alias("embedding"))


def stored_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every row and dimension of ``embeddings``, as the queries (vec_id) and as the items
    searched (neighbor_id); a row is its own nearest neighbour."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e, e.withColumnRenamed("vec_id", "neighbor_id")


def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` as a label vector (gnd_id, embedding)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("gnd_id"), "embedding")


#: ``lvec(gnd_id, label_text, embedding)`` and ``rvec(doc_id, text, lang, embedding)``.
TEXT_VEC_SQL = f"""entext as (
  select 'r' as side, cast(doc_id as varchar) as id, text from documents
  union all select 'l', cast(item_id as varchar), text from benchmark),
entok as (select side, id, unnest(list_filter(regexp_split_to_array(lower(text), '{sql_ws()}+'), lambda t: t <> '')) as t from entext),
entf as materialized (
  select side, id, ('0x' || substr(md5(t), 1, 8))::bigint % {VECTOR_DIM} as b, count(*) as tf from entok group by 1, 2, 3),
enidf as (select b.b, ln((n.n + 1)::double / (count(f.b) + 1)::double) as idf
  from range({VECTOR_DIM}) b(b) left join entf f on f.b = b.b, (select count(*) as n from entext) n group by b.b, n.n),
envec as materialized (
  select e.side, e.id, list(coalesce(f.tf, 0)::double * i.idf order by i.b) as embedding
  from (select distinct side, id from entext) e cross join enidf i
  left join entf f on f.side = e.side and f.id = e.id and f.b = i.b group by 1, 2),
lvec as (select cast(item_id as varchar) as gnd_id, text as label_text, embedding
  from benchmark join envec on side = 'l' and id = cast(item_id as varchar)),
rvec as (select doc_id, text, lang, embedding
  from documents join envec on side = 'r' and id = cast(doc_id as varchar))"""


# ---------------------------------------------------------------------------
# prob / gold / logits: classification fixtures from all embeddings, over the classes
# found in the table.  A class is scored by the cosine of the whole vector with the class
# mean; probabilities are rounded, so that equal vectors are equal in any engine.

SCORE_DECIMALS = 9
N_MODELS = 3


def class_labels(spark: SparkSession, sf_dir: str) -> list[int]:
    """The distinct labels in order; the position is the class index."""
    rows = bounded_collect(table(spark, sf_dir, "embeddings").select("label").distinct(), MAX_CLASSES, "labels")
    return sorted(r["label"] for r in rows)


def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(class_labels(spark, sf_dir))), "class_idx int, label int")


def class_cosines(spark: SparkSession, sf_dir: str):
    """A function of a vector column: its cosines with the class means, in class order.

    The means are classes x dimensions numbers, bounded by the class count.
    """
    means = bounded_collect(class_centroids(table(spark, sf_dir, "embeddings"), "label", "embedding"), MAX_CLASSES, "class means")
    matrix = np.array([r["embedding"] for r in sorted(means, key=lambda r: r["class_idx"])])
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).tolist()
    add = lambda s, x: s + x

    def cosines(column: str):
        v = F.col(column).cast("array<double>")
        norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
        return F.transform(F.lit(matrix), lambda m: F.round(
            F.aggregate(F.zip_with(v, m, lambda x, y: x * y), F.lit(0.0), add) / norm, SCORE_DECIMALS))
    return cosines


def probabilities(cosines):
    return F.transform(cosines, lambda c: F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-8.0) * c)), SCORE_DECIMALS))


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    cos = class_cosines(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), cos("embedding").alias("_cos"))
    return e.select("id", probabilities(F.col("_cos")).alias("probs"))


def _cosine(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
    norm = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x::double * x::double)))"
    return f"({dot} / greatest({norm(a)} * {norm(b)}, 1e-12))"


CLASS_SQL = """fxc as (select label, row_number() over (order by label) - 1 as class_idx
  from (select distinct label from embeddings)),
fxpos as (select label, pos, avg(x::double) as x
  from (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding) as x from embeddings)
  group by label, pos),
fxmean as (select c.class_idx, list(p.x order by p.pos) as mean from fxpos p join fxc c using (label) group by 1),
fxcos as (select e.vec_id as id, m.class_idx, round(""" + _cosine("e.embedding", "m.mean") + f""", {SCORE_DECIMALS}) as cos
  from embeddings e, fxmean m)"""

PROB_SQL = f"""{CLASS_SQL},
prob as (select id, list(round(1.0::double / (1.0::double + exp(-8.0::double * cos)), {SCORE_DECIMALS}) order by class_idx) as probs
  from fxcos group by id)"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = class_labels(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    own = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    e = e.select(F.col("vec_id").alias("id"), own.alias("_own"))
    return e.select("id", F.transform(
        F.sequence(F.lit(0), F.lit(len(labels) - 1)),
        lambda j: ((j == F.col("_own")) | (j == (F.col("_own") + F.col("id")) % len(labels))).cast("int")).alias("y"))


GOLD_SQL = """gold as (
  select e.vec_id as id, list_transform(range(k.n), lambda j:
    ((j = c.class_idx) or (j = (c.class_idx + e.vec_id) % k.n))::int) as y
  from embeddings e join fxc c using (label), (select count(*) as n from fxc) k)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cos = class_cosines(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), cos("embedding").alias("_cos"))
    return (e.select("id", F.posexplode("_cos").alias("class_idx", "_c"))
             .select("id", "class_idx", "_c", F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))).alias("model_id"))
             .select("model_id", "id", "class_idx", ((F.col("model_id") + 1) * F.lit(4.0) * F.col("_c")).alias("logit")))


LOGITS_SQL = f"""{CLASS_SQL},
logits as (select m as model_id, id, class_idx, (m + 1) * 4.0::double * cos as logit from fxcos, range({N_MODELS}) a(m))"""


# ---------------------------------------------------------------------------
# jsonld: raw JSON-LD documents built from rec (Spark side only; the oracle
# computes the expected record columns from rec).

LANG_URI = "http://id.loc.gov/vocabulary/iso639-1/"
MARK = "(classificationName=linsearch:mapping)"


def jsonld_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rec(spark, sf_dir)
    d = F.col("doc_id")
    code = F.concat(F.lit("c"), (d % 10).cast("string"))
    lang_uri = F.when(d % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(LANG_URI), F.col("language"), F.when(d % 2 == 0, F.lit("/")).otherwise(F.lit(""))))
    main_json = F.to_json(F.struct(F.concat(F.lit("http://example.org/"), F.col("id")).alias("@id"),
                                   F.concat(F.lit("bibo:"), F.col("type")).alias("@type"),
                                   lang_uri.alias("language"), F.col("title"), F.col("abstract")))
    dsub = (F.when(d % 3 == 0, F.concat(F.lit(',"dcterms:subject":{"@id":"gnd:'), F.col("id"), F.lit('"}')))
             .when(d % 3 == 1, F.concat(F.lit(',"dcterms:subject":[{"@id":"gnd:'), F.col("id"),
                                        F.lit('-1"},"skip",{"x":1},{"@id":"gnd:7"}]')))
             .otherwise(F.lit("")))
    subj = (F.when(d % 4 == 0, F.concat(F.lit(f',"subject":"{MARK}'), code, F.lit(' "')))
             .when(d % 4 == 1, F.concat(F.lit(',"subject":["(classificationName=other:scheme)x1","'
                                              f'{MARK}rest","{MARK}'), code, F.lit('"]')))
             .otherwise(F.lit("")))
    m = F.col("_main")
    full = F.concat(F.expr("substring(_main, 1, length(_main) - 1)"), dsub, subj, F.lit("}"))
    head = F.lit('{"@context":{"bibo":"http://purl.org/ontology/bibo/"},"@graph":[{"@id":"_:b0"},')
    doc = (F.when(d % 17 == 0, F.concat(F.lit('{"@graph":['), m))
            .when(d % 13 == 0, F.concat(head, F.lit('{"@type":"bibo:Article","note":"no title"}]}')))
            .otherwise(F.concat(head, full, F.lit("]}"))))
    return (r.withColumn("_main", main_json)
             .select(F.concat(F.lit("3A"), F.col("id"), F.lit(".v1.jsonld")).alias("file_name"),
                     doc.alias("doc")))


JSONLD_EXPECTED_SQL = """rec_ok as (select * from rec where doc_id % 17 <> 0 and doc_id % 13 <> 0 and title <> ''),
expected as (
  select '3A' || id || '.v1' as id, type,
    case when doc_id % 5 = 0 then 'und' else language end as language,
    title, abstract,
    case doc_id % 3 when 0 then id when 1 then id || '-1|7' else '' end as gnd_subject_ids,
    case when doc_id % 4 in (0, 1) then 'c' || cast(doc_id % 10 as varchar) else '' end as linsearch_codes
  from rec_ok)"""
