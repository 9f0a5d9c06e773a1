"""Query of the WARC operator."""

from subjex.llm import warc
from subjex.llm.common import read
from subjex.session import scratch_path


def op1_warc_revisits(spark, sf_dir):
    """Write a WARC record per page with revisits resolved, read the archives back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.resolve(read(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
           from pages),
b as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as best
      from p)
select page_id, payload_bytes, payload_digest,
       case when best = page_id then 'response' else 'revisit' end as record_type,
       case when best <> page_id then best end as refers_to
from b
"""
QUERIES = {"op1_warc_revisits": (op1_warc_revisits, SQL)}
