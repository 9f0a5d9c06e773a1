"""Query of the Jaccard join."""

from subjex.llm.common import read
from subjex.llm.jaccard_join import jaccard_join


def op11_multi_order_jaccard_join(spark, sf_dir):
    """Groups of documents linked at 0.85 on four-word shingle sets."""
    return jaccard_join(read(spark, sf_dir, "documents"), 85)


SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[][] when len(w) < 4 then [w]
         else list_transform(range(1, len(w) - 2), lambda i: w[i:i+3]) end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b
      where 100 * c.shared >= 85 * (x.n + y.n - c.shared)),
r(node, seen) as (select doc_id, doc_id from w union select l.b, r.seen from r join l on l.a = r.node),
m as (select node, min(seen) as component_id from r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from w left join n using (doc_id) join m on m.node = w.doc_id
"""
QUERIES = {"op11_multi_order_jaccard_join": (op11_multi_order_jaccard_join, SQL)}
