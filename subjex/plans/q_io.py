"""Registered sink, source, stored-model and stored-index queries: written, read back, used."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from subjex.functions import text as X
from subjex.operators import decode as D
from subjex.operators.classify import embed
from subjex.operators.encoders import LsaEncoder
from subjex.operators.label_index import LabelIndex, build_label_index
from subjex.operators.metrics import confusion, micro_macro, per_label_f1
from subjex.operators.pair_scorer import LateInteraction
from subjex.operators.ranking import debug_limit
from subjex.operators.suggest import suggest_dense, suggest_subjects
from subjex.plans import fixtures as fx
from subjex.plans import q_classify as QC
from subjex.plans import q_dense as QD
from subjex.plans import q_records as QR
from subjex.plans.catalog import REGISTRY, register
from subjex.session import scratch_path, spread
from subjex.sources.sinks import (CORPUS_SCHEMA, read_jsonl, read_thresholds, write_corpus, write_metrics,
                                  write_thresholds)
from subjex.sources.tables import table

_RECORDS = REGISTRY["p1_p7_jsonld_records"][1]


@register("s4_s5_jsonl_corpus", _RECORDS)
def s4_s5_jsonl_corpus(spark, sf_dir):
    """S4 + S5 + S10: the corpus as gzip JSON lines, written and read back."""
    path = scratch_path(spark, "corpus-jsonl")
    write_corpus(QR._records(spark, sf_dir), path, "json")
    return QR._flat(read_jsonl(spark, path, CORPUS_SCHEMA))


@register("s10_corpus_table", _RECORDS)
def s10_corpus_table(spark, sf_dir):
    """The corpus as a Parquet table, written and read back."""
    path = scratch_path(spark, "corpus")
    write_corpus(QR._records(spark, sf_dir), path)
    return QR._flat(spark.read.parquet(path))


@register("s15_metrics_files", f"""
with {QC._LP}, {QC._SWEEP}, {QC._DEC_C7}, {QC._metric_sql('dec')}
select cast(class_idx as integer) as class_idx, round(pc.f1, 5) as f1, round(mm.micro_f1, 6) as micro_f1,
       round(mm.macro_f1, 6) as macro_f1 from pc, mm""")
def s15_metrics_files(spark, sf_dir):
    """The metric bundle and the per-class report, written as files and read back."""
    path = scratch_path(spark, "metrics")
    conf = confusion(QC._aligned_c7(spark, sf_dir))
    write_metrics(micro_macro(conf), per_label_f1(conf), path)
    m = spark.read.json(f"{path}/metrics").first()
    per = spark.read.schema("class_idx INT, f1 DOUBLE").json(f"{path}/per_class")
    return per.select("class_idx", "f1", F.lit(round(m["micro_f1"], 6)).alias("micro_f1"),
                      F.lit(round(m["macro_f1"], 6)).alias("macro_f1"))


@register("s16_thresholds_file", f"""
with {QC._LP}, {QC._SWEEP}, {QC._DEC_C7}, {QC._metric_sql('dec')}
select cast(class_idx as integer) as class_idx, round(threshold, 6) as threshold,
       round(micro_f1, 6) as dev_f1_micro, round(macro_f1, 6) as dev_f1_macro from c5, mm""")
def s16_thresholds_file(spark, sf_dir):
    """Thresholds with the scores they reach on the dev split, written and read back."""
    path = scratch_path(spark, "thresholds")
    thr = QC._c5(spark, sf_dir)
    mm = micro_macro(confusion(QC._aligned_c7(spark, sf_dir)))
    write_thresholds(thr, path, mm.select(F.col("micro_f1").alias("dev_f1_micro"), F.col("macro_f1").alias("dev_f1_macro")))
    stored, dev = read_thresholds(spark, path, metrics=True)
    d = dev.first()
    return stored.select("class_idx", F.round("threshold", 6).alias("threshold"),
                         *[F.lit(round(d[c], 6)).alias(c) for c in ("dev_f1_micro", "dev_f1_macro")])


@register("w9_debug_limit", "select doc_id, lang from documents order by doc_id limit 50")
def w9_debug_limit(spark, sf_dir):
    """The first 50 documents by id (the cut is the feature)."""
    return debug_limit(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@register("v2_stored_index_topk", REGISTRY["v1_dense_topk"][1])
def v2_stored_index_topk(spark, sf_dir):
    """S12 + V2 + V3: an index built, saved and loaded; with every cell probed it is exact."""
    queries, _ = fx.stored_vectors(spark, sf_dir)
    path = scratch_path(spark, "label-index")
    build_label_index(fx.stored_labels(spark, sf_dir), n_cells=16).save(path)
    index = LabelIndex.load(spark, path)
    return index.search(queries, "vec_id", "embedding", QD.TOPK, nprobe=16) \
        .select("vec_id", "gnd_id", "rank", F.round("score", 6).alias("score"))


def _subject_index(spark, sf_dir):
    """(records, stored label index, encoder): one encoder for labels and documents."""
    records = fx.rec(spark, sf_dir)
    vocab = fx.vocab(spark, sf_dir).withColumn("emb_text", X.passage_prefix("label_text"))
    texts = records.select(X.pair_text("title", "abstract").alias("t")).unionByName(vocab.select(F.col("label_text").alias("t")))
    encoder = LsaEncoder.fit(spread(texts), "t", dim=64)
    path = scratch_path(spark, "subject-index")
    build_label_index(encoder.transform(vocab, "emb_text"), n_cells=4, m=16).save(path)
    return records, LabelIndex.load(spark, path), encoder


@register("h2_text_to_subjects")
def h2_text_to_subjects(spark, sf_dir):
    """Text in, subjects out: one latent semantic encoder for labels and documents, a stored
    index with cells and residual codes, hybrid suggestion for every document."""
    records, index, encoder = _subject_index(spark, sf_dir)
    return suggest_subjects(records, "id", "title", "abstract", index, encoder, topk=QD.TOPK, nprobe=2)


@register("r1_pair_scorer")
def r1_pair_scorer(spark, sf_dir):
    """R1 + E2 + J4: dense candidates on encoded texts, the first five pairs of a record scored
    by late interaction over its whole text."""
    docs, labels = QD._inputs(spark, sf_dir)
    texts = docs.select("text").unionByName(labels.select(F.col("label_text").alias("text")))
    scorer = LateInteraction(LsaEncoder.fit(spread(texts), "text", dim=64))
    out = suggest_dense(docs, "doc_id", "text", "embedding", labels, topk=QD.TOPK, rerank_n=QD.RERANK, scorer=scorer)
    return out.select("doc_id", "rank", "gnd_id", F.round("score", 6).alias("score"))


class _GramEncoder:
    """A model for the encoder plug-in that needs no files: counts of letter triples by hash."""

    def __call__(self, texts):
        out = np.zeros((len(texts), 64), np.float32)
        for i, t in enumerate(texts):
            raw = np.frombuffer((t or "").lower().encode(), np.uint8).astype(np.int64)
            if len(raw) >= 3:
                out[i] = np.bincount((raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) % 64, minlength=64)
        return out


@register("e1_plugged_encoder")
def e1_plugged_encoder(spark, sf_dir):
    """E1 + C1: any text encoder in batches; here letter triples of the whole texts, normalised."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return embed(d, "text", _GramEncoder, 64).select("doc_id", "embedding")
