"""Property tests: text expressions against Python on random Unicode strings."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from subjex.functions import text as X

# letters, digits, punctuation, accented letters and every whitespace kind
ALPHABET = st.sampled_from(list("abcXYZ09.,-'") + list("äÖßéñœ") + list(X.WS_CHARS))
BATCH = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=20, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(BATCH)
def test_split_and_strip_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    rows = df.select("i", X.whitespace_tokens("t").alias("w"), X.py_strip("t").alias("s")) \
        .orderBy("i").collect()
    for r, t in zip(rows, texts):
        assert r["w"] == t.lower().split()
        assert r["s"] == t.strip()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(BATCH)
def test_clean_is_ascii_alnum_words(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    rows = df.select("i", X.clean("t").alias("c"), X.word_tokens(X.clean("t")).alias("w")) \
        .orderBy("i").collect()
    for r in rows:
        c = r["c"]
        assert c == c.strip() and "  " not in c
        assert all(ch.isascii() and (ch.isalnum() or ch == " ") for ch in c)
        assert " ".join(r["w"]) == c or any(w in ("can", "gim", "gon", "got", "lem", "wan") for w in r["w"])
