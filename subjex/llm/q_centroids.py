"""Query of the centroid clustering."""

from subjex.llm.centroids import cluster
from subjex.llm.common import read

CENTERS, ROUNDS = 40, 5


def op13_mean_deviation_clusters(spark, sf_dir):
    """Five exact rounds over all vectors of 64 finite components, then the last assignment."""
    return cluster(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, CENTERS, ROUNDS, 256, "2")


def _rounds() -> str:
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""
a{r} as materialized (
  select p.row, p.vec_id, min((p.d, p.c)) as best from (
    select v.row, v.vec_id, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) as d
    from v, c{r} c) p group by 1, 2)""")
        if r < ROUNDS:
            out.append(f"""
s{r} as materialized (
  select c, list(x order by pos) as v from (
    select a.best[2] as c, pos, cast((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) as bigint) as x
    from a{r} a join (select row, generate_subscripts(v, 1) as pos, unnest(v) as x from v) e using (row) group by 1, 2)
  group by 1),
c{r + 1} as materialized (select c.c, coalesce(s.v, c.v) as v from c{r} c left join s{r} s using (c))""")
    return ",".join(out)


SQL = f"""
with v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v
  from embeddings where len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id), v) - 1 as c, v from v
  order by sha256('2:' || vec_id), v limit {CENTERS}),
{_rounds()},
p as (select row, vec_id, best[2] as c, best[1] as d from a{ROUNDS})
select p.vec_id, cast(p.c as integer) as cluster, cast(p.d as bigint) as distance,
       cast(sum(p.d) over (partition by p.c) as bigint) as cluster_inertia,
       cast(sum(p.d) over () as bigint) as inertia,
       sha256(array_to_string(c.v, ',')) as centroid_sha256
from p join c{ROUNDS} c on c.c = p.c
"""
QUERIES = {"op13_mean_deviation_clusters": (op13_mean_deviation_clusters, SQL)}
