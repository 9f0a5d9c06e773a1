"""Query of the ball-tree search."""

from subjex.llm.ball_search import rank_documents
from subjex.llm.common import read

TOP = 50


def op12_ball_tree_search(spark, sf_dir):
    """The 50 best documents of every benchmark item, over all documents."""
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), TOP)


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
SQL = f"""
with d as materialized (select row_number() over () as row, doc_id, {_TERMS} as terms from documents),
n as materialized (select row, doc_id, len(terms)::bigint as n from d),
c as (select count(*)::bigint as docs, sum(n)::bigint as len from n where n > 0),
tf as materialized (select row, t, count(*)::bigint as tf from (select row, unnest(terms) as t from d) group by 1, 2),
w as materialized (select t, cast(floor(1000 * ln((2 * c.docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
      from tf, c group by t, c.docs),
i as (select distinct item_id, t from (select item_id, unnest({_TERMS}) as t from benchmark)),
s as (select i.item_id, n.row, n.doc_id,
        cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * n.n * c.docs) // c.len)))) as bigint) as score
      from i join tf using (t) join w using (t) join n using (row), c group by 1, 2, 3),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rnk from s where score > 0)
select item_id, cast(rnk as integer) as rank, doc_id, score from r where rnk <= {TOP}
"""
QUERIES = {"op12_ball_tree_search": (op12_ball_tree_search, SQL)}
