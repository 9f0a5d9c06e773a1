import collections
import random

from helpers import WORD, prose, table
from pyspark.sql import functions as F

from subjex.llm import rules


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover))


def test_statistics_against_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\ny\nx\n\n \nx", "é#*$ ü|<>\x0b\x0cq\x1cz", "a b c d", prose(1, 30_000, 40)]
    texts += [" ".join(r.choice("abcd") for _ in range(r.randrange(40))) + "\n" * r.randrange(3) + "tail" for _ in range(80)]
    got = rules.statistics(table(spark, list(enumerate(texts)) + [(3, "a"), (None, "a b")]).drop("n_words", "_s")).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(row["text"])
    assert rules.statistics(table(spark, []).drop("n_words", "_s")).count() == 0


def test_learns_a_planted_list(spark):
    r = random.Random(9)
    rows = [{f: r.random() for f in rules.FEATURES} for _ in range(3000)]
    for x in rows:
        x["poor"] = int(x["symbol_rate"] > 0.8 or x["distinct_rate"] <= 0.25 and x["upper_rate"] > 0.5)
    df = spark.createDataFrame(rows)
    learned = rules.learn(df, "poor")
    assert 2 <= len(learned) <= 12
    verdict = df.withColumn("hit", rules.decision_list(learned) > 0)
    wrong = verdict.where(F.col("hit").cast("int") != F.col("poor")).count()
    assert wrong < 150


def test_without_both_classes_no_rule(spark):
    schema = ", ".join(f"{f} double" for f in rules.FEATURES) + ", poor int"
    assert rules.learn(spark.createDataFrame([], schema), "poor") == []
    assert rules.learn(spark.createDataFrame([tuple([0.5] * len(rules.FEATURES) + [0])] * 9, schema), "poor") == []
    df = spark.range(1).withColumn("x", rules.decision_list([]))
    assert df.first()["x"] == 0
