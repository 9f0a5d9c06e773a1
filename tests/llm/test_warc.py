import hashlib

from helpers import CLASH
from pyspark.sql import functions as F

from subjex.llm import warc

PAGE = "page_id long, url string, html string"


def round_trip(spark, rows, path, clash=True):
    df = spark.createDataFrame(rows, PAGE)
    if clash:
        df = df.withColumns({c: F.lit(c) for c in (*CLASH, "payload", "payload_digest", "refers_to")})
    warc.write_archives(warc.resolve(df), path)
    return warc.read_archives(spark, path).collect()


def test_revisits_against_brute_force(spark, tmp_dir):
    big, other = "x" * 1000, "ü" * 600
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "http://c", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other), (9, "u", other),
            (10, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb" * 40), (11, "u", "tail\r\n\r\n"), (None, "u", big), (None, "v", "z" * 2000)]
    got = round_trip(spark, rows, tmp_dir + "/a")
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        h = h or ""
        best = top[h] if len(h.encode()) >= 1000 and top[h] >= 0 and top[h] != i else None
        want.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if best is not None else "response", best))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    texts = {(r["page_id"], r["payload"]) for r in got if r["record_type"] == "response"}
    assert (10, rows[10][2]) in texts and (11, rows[11][2]) in texts and (6, "") in texts


def test_empty(spark, tmp_dir):
    assert round_trip(spark, [], tmp_dir + "/e") == []
