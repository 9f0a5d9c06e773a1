"""Query of the substring deduplication."""

from subjex.llm.common import read
from subjex.llm.substrings import remove_repeats


def op8_block_anchor_dedup(spark, sf_dir):
    """Remove every word that a repeated window of 35 words covers."""
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 33)) as i, w from w where len(w) >= 35),
h as (select doc_id, i, list_aggregate(w[i:i+34], 'string_agg', ' ') as s from p),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by s) as n from h) where n > 1),
c as (select distinct doc_id, unnest(range(i, i + 35)) as i from r),
g as (select doc_id, list(i) as gone from c group by 1)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(len(g.gone), 0)::bigint as n_removed,
       sha256(coalesce(list_aggregate(case when g.gone is null then w.w else
         list_transform(list_filter(list_zip(w.w, range(1, len(w.w) + 1)), lambda x: not list_contains(g.gone, x[2])), lambda x: x[1]) end,
         'string_agg', ' '), '')) as kept_sha256
from w left join g using (doc_id)
"""
QUERIES = {"op8_block_anchor_dedup": (op8_block_anchor_dedup, SQL)}
