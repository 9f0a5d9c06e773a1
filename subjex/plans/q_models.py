"""Registered model-fitting, streaming and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjex.functions.vectors import sq_norm
from subjex.operators import decode as D
from subjex.operators.classify import embed_hashing, load_model, predict_proba, save_model, train_domains
from subjex.operators.labels import balanced_weights
from subjex.operators.suggest import suggest_dense
from subjex.plans import fixtures as fx
from subjex.plans import q_classify, q_dense  # noqa: F401  (their oracle SQL is reused)
from subjex.plans.catalog import REGISTRY, register
from subjex.session import scratch_path
from subjex.sources.sinks import read_embeddings, write_embeddings
from subjex.sources.tables import table
from subjex.streaming.stream import stream_to_table, table_stream

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
EMB_SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


@register("a9_class_weights", f"""
with {fx.CLASS_SQL}, {fx.GOLD_SQL},
yl as (select unnest(range(len(y))) as class_idx, unnest(y) as y from gold),
c as (select class_idx, count(*) as n, sum(y) as n_pos from yl group by class_idx)
select cast(class_idx as integer) as class_idx,
       round(case when n_pos > 0 then n / (2.0::double * n_pos) end, 6) as w_pos,
       round(case when n - n_pos > 0 then n / (2.0::double * (n - n_pos)) end, 6) as w_neg from c""")
def a9_class_weights(spark, sf_dir):
    """Balanced class weights n / (2 n_pos), n / (2 n_neg)."""
    g = fx.gold(spark, sf_dir)
    yl = g.select(F.posexplode("y").alias("class_idx", "y")) \
        .select(F.col("class_idx").cast("int"), "y")
    w = balanced_weights(yl)
    return w.select("class_idx", F.round("w_pos", 6).alias("w_pos"), F.round("w_neg", 6).alias("w_neg"))


@register("c1_embed_hashing")
def c1_embed_hashing(spark, sf_dir):
    """Built-in hashed TF-IDF encoder over whole document texts, L2-normalised."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = embed_hashing(d, "text", dim=256)
    return e.select("doc_id", F.size("embedding").alias("dim"),
                    F.round(F.sqrt(sq_norm("embedding")), 6).alias("norm"))


@register("c1_tfidf_vectors", f"""
with {fx.TEXT_VEC_SQL},
n as (select doc_id, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 1e-12) as len from rvec)
select doc_id, b.b::integer as pos, round(embedding[b.b + 1] / len, 6) as x
from n, range({fx.VECTOR_DIM}) b(b) where embedding[b.b + 1] <> 0""")
def c1_tfidf_vectors(spark, sf_dir):
    """The normalised TF-IDF vector of every document's whole text, its non-zero entries."""
    e = fx.record_vectors(spark, sf_dir).select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    return e.where("x <> 0").select("doc_id", "pos", F.round("x", 6).alias("x"))


def _train(spark, sf_dir):
    """Fit on four fifths of the vectors, thresholds and scores on the others (hash folds)."""
    e = table(spark, sf_dir, "embeddings")
    data = e.join(fx.gold(spark, sf_dir), e.vec_id == F.col("id")).select("id", "embedding", "y")
    fold = F.pmod(F.xxhash64("id"), F.lit(5))
    n = len(fx.class_labels(spark, sf_dir))
    return data, train_domains(data.where(fold > 0), data.where(fold == 0), "id", "embedding", "y", n)


@register("c14_train_domains")
def c14_train_domains(spark, sf_dir):
    """C14 + C2 + C3 + C5: fit one-vs-rest, thresholds on dev, dev micro / macro F1."""
    _, res = _train(spark, sf_dir)
    m = res.dev_metrics.first()
    return res.thresholds.select("class_idx", F.round("threshold", 6).alias("threshold"),
                                 F.lit(round(m["dev_f1_micro"], 6)).alias("dev_f1_micro"),
                                 F.lit(round(m["dev_f1_macro"], 6)).alias("dev_f1_macro"))


@register("c4_predict_proba")
def c4_predict_proba(spark, sf_dir):
    """C4 + S17: the model is stored and loaded, then scores all classes in one pass."""
    data, res = _train(spark, sf_dir)
    path = scratch_path(spark, "domain-model")
    save_model(res.model, fx.class_table(spark, sf_dir), path)
    model, _ = load_model(spark, path)
    p = predict_proba(data, "embedding", model)
    return D.long_form(p.select("id", "probs"), "id", "probs", "prob")


# ---------------------------------------------------------------------------
# streaming

def _prob_stream(spark, sf_dir):
    s = table_stream(spark, sf_dir, "embeddings", EMB_SCHEMA)
    cos = fx.class_cosines(spark, sf_dir)
    return s.select(F.col("vec_id").alias("id"), fx.probabilities(cos("embedding")).alias("probs"))


@register("x1_stream_decode", REGISTRY["c10_decode_topk"][1])
def x1_stream_decode(spark, sf_dir):
    """Row-local decoding (top-3) on a file stream equals the batch result."""
    s = _prob_stream(spark, sf_dir).select("id", D.decode("probs", "topk", k=3).alias("labels"))
    out = stream_to_table(spark, s, "x1-decode")
    return D.long_form(out, "id", "labels")


@register("x1_stream_suggest", REGISTRY["h3_dense_suggest"][1])
def x1_stream_suggest(spark, sf_dir):
    """Dense suggestion per micro-batch (foreachBatch) equals the batch result."""
    labels = fx.stored_labels(spark, sf_dir)
    recs = table_stream(spark, sf_dir, "embeddings", EMB_SCHEMA).select("vec_id", "embedding")

    def per_batch(batch):
        return suggest_dense(batch, "vec_id", "", "embedding", labels, topk=10)

    out = stream_to_table(spark, recs, "x1-suggest", per_batch)
    return out.select("vec_id", "rank", "gnd_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------------------
# S11 + F7: embeddings sink partitioned by split, one split read back

@register("s11_f7_split_read", """
select vec_id, label from embeddings where label >= 7""")
def s11_f7_split_read(spark, sf_dir):
    """S11 + F7: write vectors partitioned by split, read one split (partition pruning)."""
    e = table(spark, sf_dir, "embeddings")
    split = F.when(F.col("label") >= 7, F.lit("dev")).otherwise(F.lit("train"))
    path = scratch_path(spark, "s11-embeddings")
    write_embeddings(e.withColumn("split", split), path)
    return read_embeddings(spark, path, "dev").select("vec_id", "label")


@register("w8_seeded_sample", "select doc_id, lang from documents order by md5('42:' || doc_id), doc_id limit 100")
def w8_seeded_sample(spark, sf_dir):
    """A seeded, repeatable sample of 100 documents (sampling is the feature)."""
    from subjex.operators.ranking import seeded_sample
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return seeded_sample(d, "doc_id", 100, seed=42)
