"""Query of the learned quality rules."""

from pyspark.sql import functions as F

from subjex.llm import rules
from subjex.llm.common import read
from subjex.session import written


def op5_quality_rules(spark, sf_dir):
    """Statistics of every document once, rules learned from labels.quality, both verdicts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(rules.statistics(docs).drop("text"), "quality-statistics")
    labels = read(spark, sf_dir, "labels").where("quality is not null") \
        .select("doc_id", (F.col("quality") == 0).cast("int").alias("poor"))
    train = written(stats.where(f"not ({rules.BASE_FAILED})").join(labels, "doc_id"), "quality-labelled")
    learned = rules.learn(train, "poor")
    rule = rules.decision_list(learned)
    failed = F.expr(rules.BASE_FAILED)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


QUERIES = {"op5_quality_rules": (op5_quality_rules, None)}
