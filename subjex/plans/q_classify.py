"""Registered decode, threshold, metric and ensemble queries (prob / gold / logits fixtures)."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjex.operators import decode as D
from subjex.operators.ensemble import ensemble_logits, score_ensemble
from subjex.operators.metrics import (align, classification_report, confusion, evaluate,
                                      per_label_f1)
from subjex.operators.thresholds import (GRID, fit_thresholds_exact, fit_thresholds_grid,
                                         long_probs, mean_threshold, pr_sweep)
from subjex.plans import fixtures as fx
from subjex.plans.catalog import REGISTRY, register
from subjex.session import written

K = 3
GLOBAL_THR = 0.7
P_MIN = 0.55
UNION_K = 2


def dbl(x: float) -> str:
    """An exact double literal for DuckDB (long decimals would parse as DECIMAL)."""
    return f"'{float(x)!r}'::double"


# ---------------------------------------------------------------------------
# SQL parts

_LP = f"""{fx.PROB_SQL}, {fx.GOLD_SQL},
lp as (select p.id, unnest(range(len(p.probs))) as class_idx, unnest(p.probs) as p, unnest(g.y) as y
       from prob p join gold g on p.id = g.id),
rk as (select *, row_number() over (partition by id order by p desc, class_idx) as prk from lp)"""

_SWEEP = """vals as (select class_idx, p, sum(y) as pos, sum(1 - y) as neg from lp group by class_idx, p),
cum as (select class_idx, p as threshold,
          sum(pos) over (partition by class_idx order by p desc
                         rows between unbounded preceding and current row) as tps,
          sum(neg) over (partition by class_idx order by p desc
                         rows between unbounded preceding and current row) as fps,
          sum(pos) over (partition by class_idx) as pos_total
        from vals),
sw as (select *, case when tps + fps > 0 then tps / (tps + fps) else 0.0 end as precision,
          case when pos_total > 0 then tps / pos_total else 1.0 end as recall from cum),
sw2 as (select *, 2.0::double * precision * recall / (precision + recall + 1e-9) as f1 from sw),
c5 as (select class_idx, threshold from (
         select *, row_number() over (partition by class_idx order by f1 desc, threshold) as rn
         from sw2) where rn = 1)"""

_GRID_VALUES = ", ".join(dbl(t) for t in GRID)


def _grid_sql(src: str, p: str = "p") -> str:
    return f"""grid as (select unnest([{_GRID_VALUES}]) as threshold, unnest(range(1, {len(GRID) + 1})) as i),
gf as (select s.class_idx, g.i, g.threshold,
         sum(case when s.{p} >= g.threshold then s.y else 0 end) as tp,
         sum(case when s.{p} >= g.threshold then 1 else 0 end) as pred,
         sum(s.y) as pos_total
       from {src} s, grid g group by s.class_idx, g.i, g.threshold),
gf2 as (select *, case when pos_total + pred > 0 then 2.0::double * tp / (pos_total + pred)
                       else 0.0 end as f1 from gf),
c6 as (select class_idx, case when f1 > 0 then threshold else 0.5 end as threshold from (
         select *, row_number() over (partition by class_idx order by f1 desc, i) as rn from gf2)
       where rn = 1)"""


def _ensure1_sql(dec: str) -> str:
    return f"""nsum as (select id, sum(yhat) as n from {dec} group by id),
ens1 as (select d.id, d.class_idx, d.y,
           case when n.n = 0 then cast(r.prk = 1 as integer) else d.yhat end as yhat
         from {dec} d join nsum n on d.id = n.id
         join rk r on d.id = r.id and d.class_idx = r.class_idx)"""


def _metric_sql(dec: str) -> str:
    return f"""conf as (select class_idx, sum(y * yhat) as tp, sum((1 - y) * yhat) as fp,
           sum(y * (1 - yhat)) as fn, sum(y) as support, sum(yhat) as predicted
         from {dec} group by class_idx),
pc as (select *, case when predicted <> 0 then tp / predicted else 0.0 end as precision,
         case when support <> 0 then tp / support else 0.0 end as recall,
         case when support + predicted <> 0 then 2.0::double * tp / (support + predicted)
              else 0.0 end as f1 from conf),
mm as (select
         case when sum(support) + sum(predicted) <> 0
              then 2.0::double * sum(tp) / (sum(support) + sum(predicted)) else 0.0 end as micro_f1,
         avg(f1) as macro_f1,
         case when sum(predicted) <> 0 then sum(tp) / sum(predicted) else 0.0 end as micro_precision,
         case when sum(support) <> 0 then sum(tp) / sum(support) else 0.0 end as micro_recall,
         avg(precision) as macro_precision, avg(recall) as macro_recall from pc)"""


_DEC_C7 = "dec as (select lp.id, lp.class_idx, lp.y, cast(lp.p >= c5.threshold as integer) as yhat " \
          "from lp join c5 on lp.class_idx = c5.class_idx)"


def _long(dec: str, col: str = "yhat") -> str:
    return f"select id, cast(class_idx as integer) as class_idx, cast({col} as integer) as y from {dec}"


# ---------------------------------------------------------------------------
# Spark side helpers

def _pg(spark, sf_dir):
    return fx.prob(spark, sf_dir).join(fx.gold(spark, sf_dir), "id")


def _lp(spark, sf_dir):
    return long_probs(_pg(spark, sf_dir), "id", "probs", "y")


def _decoded(spark, sf_dir, expr):
    return D.long_form(fx.prob(spark, sf_dir).select("id", expr.alias("labels")), "id", "labels")


def _c5(spark, sf_dir):
    return fit_thresholds_exact(_lp(spark, sf_dir))


# ---------------------------------------------------------------------------
# Thresholds

@register("w5_pr_sweep", f"""
with {_LP}, {_SWEEP}
select cast(class_idx as integer) as class_idx, round(threshold, 6) as threshold,
       cast(tps as bigint) as tps, cast(fps as bigint) as fps, round(precision, 6) as precision,
       round(recall, 6) as recall, round(f1, 6) as f1
from sw2""")
def w5_pr_sweep(spark, sf_dir):
    """Precision-recall sweep per class over distinct probabilities."""
    sw = pr_sweep(_lp(spark, sf_dir))
    return sw.select("class_idx", F.round("threshold", 6).alias("threshold"),
                     F.col("tps").cast("long"), F.col("fps").cast("long"),
                     F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                     F.round("f1", 6).alias("f1"))


@register("c5_thresholds_exact", f"""
with {_LP}, {_SWEEP}
select cast(class_idx as integer) as class_idx, round(threshold, 6) as threshold from c5""")
def c5_thresholds_exact(spark, sf_dir):
    """Best-F1 threshold per class from the PR sweep."""
    return _c5(spark, sf_dir).select("class_idx", F.round("threshold", 6).alias("threshold"))


@register("c6_thresholds_grid", f"""
with {_LP}, {_grid_sql('lp')}
select cast(class_idx as integer) as class_idx, round(threshold, 6) as threshold from c6""")
def c6_thresholds_grid(spark, sf_dir):
    """Best grid threshold per class (strict improvement, 0.5 default)."""
    return fit_thresholds_grid(_lp(spark, sf_dir)) \
        .select("class_idx", F.round("threshold", 6).alias("threshold"))


@register("a7_mean_threshold", f"""
with {_LP}, {_SWEEP}
select round(avg(threshold), 6) as avg_threshold from c5""")
def a7_mean_threshold(spark, sf_dir):
    """Mean of the fitted thresholds."""
    return mean_threshold(_c5(spark, sf_dir)).select(F.round("avg_threshold", 6).alias("avg_threshold"))


# ---------------------------------------------------------------------------
# Decoding

@register("c7_decode_threshold", f"""
with {_LP}, {_SWEEP}, {_DEC_C7}
{_long('dec')}""")
def c7_decode_threshold(spark, sf_dir):
    """Per-class thresholds (fitted by C5)."""
    thr = D.threshold_list(_c5(spark, sf_dir))
    return _decoded(spark, sf_dir, D.decode("probs", "threshold", thr))


@register("c8_decode_threshold_ensure1", f"""
with {_LP}, {_SWEEP}, {_DEC_C7}, {_ensure1_sql('dec')}
{_long('ens1')}""")
def c8_decode_threshold_ensure1(spark, sf_dir):
    """Thresholds, arg-max when a row is empty."""
    thr = D.threshold_list(_c5(spark, sf_dir))
    return _decoded(spark, sf_dir, D.decode("probs", "threshold_ensure1", thr))


@register("c9_decode_global", f"""
with {_LP}
select id, cast(class_idx as integer) as class_idx, cast(p >= {dbl(GLOBAL_THR)} as integer) as y from lp""")
def c9_decode_global(spark, sf_dir):
    """One global threshold."""
    return _decoded(spark, sf_dir, D.decode("probs", "global", thr=GLOBAL_THR))


@register("c10_decode_topk", f"""
with {_LP}
select id, cast(class_idx as integer) as class_idx, cast(prk <= {K} as integer) as y from rk""")
def c10_decode_topk(spark, sf_dir):
    """Top-k classes."""
    return _decoded(spark, sf_dir, D.decode("probs", "topk", k=K))


@register("c11_decode_topk_minp", f"""
with {_LP},
dec as (select id, class_idx, y, cast(prk <= {K} and p >= {dbl(P_MIN)} as integer) as yhat from rk),
{_ensure1_sql('dec')}
{_long('ens1')}""")
def c11_decode_topk_minp(spark, sf_dir):
    """C11: top-k with a minimum probability, arg-max fallback."""
    return _decoded(spark, sf_dir, D.decode("probs", "topk_minp", k=K, p_min=P_MIN))


_MODE_QUERIES = {"threshold": "c7_decode_threshold", "threshold_ensure1": "c8_decode_threshold_ensure1",
                 "global": "c9_decode_global", "topk": "c10_decode_topk", "topk_minp": "c11_decode_topk_minp"}


@register("c13_decode_dispatch", "\nunion all\n".join(
    f"select '{mode}' as mode, '{D.mode_suffix(mode, K, GLOBAL_THR, P_MIN)}' as suffix, x.* from ({REGISTRY[q][1]}) x"
    for mode, q in _MODE_QUERIES.items()))
def c13_decode_dispatch(spark, sf_dir):
    """Every decode mode through the dispatch, with the suffix of its metrics file."""
    thr = D.threshold_list(_c5(spark, sf_dir))
    probs = written(fx.prob(spark, sf_dir), "probabilities")
    # one array per mode, a record's five decodings stay in its row
    modes = F.array(*[F.struct(F.lit(mode).alias("mode"), F.lit(D.mode_suffix(mode, K, GLOBAL_THR, P_MIN)).alias("suffix"),
                               D.decode("probs", mode, thr, K, GLOBAL_THR, P_MIN).alias("labels")) for mode in _MODE_QUERIES])
    each = probs.select("id", F.explode(modes).alias("m")).select("id", "m.*")
    return each.select("mode", "suffix", "id", F.posexplode("labels").alias("class_idx", "y")) \
        .select("mode", "suffix", "id", F.col("class_idx").cast("int"), F.col("y").cast("int"))


@register("c12_decode_threshold_or_topk", f"""
with {_LP}, {_grid_sql('lp')}
select r.id, cast(r.class_idx as integer) as class_idx,
       cast(r.p >= c6.threshold or r.prk <= {UNION_K} as integer) as y
from rk r join c6 on r.class_idx = c6.class_idx""")
def c12_decode_threshold_or_topk(spark, sf_dir):
    """C12 + U1: grid thresholds united with the top-2 classes."""
    thr = D.threshold_list(fit_thresholds_grid(_lp(spark, sf_dir)))
    return _decoded(spark, sf_dir, D.apply_thresholds_or_topk("probs", thr, UNION_K))


@register("w6_row_topk", f"""
with {_LP}
select id, cast(prk as integer) as rank, cast(class_idx as integer) as class_idx from rk where prk <= {K}""")
def w6_row_topk(spark, sf_dir):
    """The k best class indices of each probability array, best first."""
    p = fx.prob(spark, sf_dir).select("id", D.topk_indices("probs", K).alias("top"))
    return p.select("id", F.posexplode("top").alias("rank", "class_idx")) \
        .select("id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("class_idx").cast("int"))


@register("w7_argmax", f"""
with {_LP}
select id, cast(class_idx as integer) as class_idx from rk where prk = 1""")
def w7_argmax(spark, sf_dir):
    """Arg-max class (first on ties)."""
    return fx.prob(spark, sf_dir).select("id", D.argmax("probs").alias("class_idx"))


# ---------------------------------------------------------------------------
# Metrics

def _aligned_c7(spark, sf_dir):
    thr = D.threshold_list(_c5(spark, sf_dir))
    pred = fx.prob(spark, sf_dir).select("id", D.decode("probs", "threshold", thr).alias("labels"))
    return align(pred, fx.gold(spark, sf_dir), "id")


@register("a2_confusion", f"""
with {_LP}, {_SWEEP}, {_DEC_C7}, {_metric_sql('dec')}
select cast(class_idx as integer) as class_idx, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
       cast(fn as bigint) as fn, cast(support as bigint) as support,
       cast(predicted as bigint) as predicted from conf""")
def a2_confusion(spark, sf_dir):
    """A2: confusion counts per class of the C7 decoding."""
    return confusion(_aligned_c7(spark, sf_dir))


_METRIC_COLS = ("micro_f1", "macro_f1", "micro_precision", "micro_recall", "macro_precision",
                "macro_recall")


@register("c15_evaluate", f"""
with {_LP}, {_SWEEP}, {_DEC_C7}, {_metric_sql('dec')}
select {', '.join(f'round({c}, 6) as {c}' for c in _METRIC_COLS)} from mm""")
def c15_evaluate(spark, sf_dir):
    """C15 + A3 + A4: micro and macro precision, recall and F1."""
    thr = D.threshold_list(_c5(spark, sf_dir))
    pred = fx.prob(spark, sf_dir).select("id", D.decode("probs", "threshold", thr).alias("labels"))
    m = evaluate(pred, fx.gold(spark, sf_dir), "id")
    return m.select(*[F.round(c, 6).alias(c) for c in _METRIC_COLS])


@register("a6_classification_report", f"""
with {_LP}, {_SWEEP}, {_DEC_C7}, {_metric_sql('dec')},
samp as (select id, sum(y * yhat) as tp, sum(y) as t, sum(yhat) as p from dec group by id),
sa as (select avg(case when p <> 0 then tp / p else 0.0 end) as precision,
              avg(case when t <> 0 then tp / t else 0.0 end) as recall,
              avg(case when t + p <> 0 then 2.0::double * tp / (t + p) else 0.0 end) as f1 from samp),
tot as (select sum(support) as support,
           case when sum(support) <> 0 then sum(support * precision) / sum(support) else 0.0 end as w_p,
           case when sum(support) <> 0 then sum(support * recall) / sum(support) else 0.0 end as w_r,
           case when sum(support) <> 0 then sum(support * f1) / sum(support) else 0.0 end as w_f1
        from pc),
rep as (
  select cast(class_idx as varchar) as label, precision, recall, f1, support from pc
  union all select 'micro avg', micro_precision, micro_recall, micro_f1, (select support from tot) from mm
  union all select 'macro avg', macro_precision, macro_recall, macro_f1, (select support from tot) from mm
  union all select 'weighted avg', w_p, w_r, w_f1, support from tot
  union all select 'samples avg', precision, recall, f1, (select support from tot) from sa)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
       cast(support as bigint) as support from rep""")
def a6_classification_report(spark, sf_dir):
    """Per-class precision / recall / F1 / support plus the average rows."""
    rep = classification_report(_aligned_c7(spark, sf_dir))
    return rep.select("label", F.round("precision", 6).alias("precision"),
                      F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


@register("a5_per_label_f1", f"""
with {_LP}, {_SWEEP}, {_DEC_C7}, {_metric_sql('dec')}
select cast(class_idx as integer) as class_idx, round(f1, 5) as f1 from pc""")
def a5_per_label_f1(spark, sf_dir):
    """A5: per-class F1 rounded to 5 digits."""
    return per_label_f1(confusion(_aligned_c7(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Ensemble

_ENS = f"""{fx.LOGITS_SQL}, {fx.GOLD_SQL},
ens as (select id, class_idx, avg(logit) as logit from logits group by id, class_idx),
ensp as (select *, 1.0::double / (1.0::double + exp(-logit)) as prob from ens)"""


@register("a8_logit_ensemble", f"""
with {_ENS}
select id, cast(class_idx as integer) as class_idx, round(logit, 6) as logit, round(prob, 6) as prob
from ensp""")
def a8_logit_ensemble(spark, sf_dir):
    """A8 + M1: mean logit over three models, then sigmoid."""
    e = ensemble_logits(fx.logits(spark, sf_dir))
    return e.select("id", F.col("class_idx").cast("int"), F.round("logit", 6).alias("logit"),
                    F.round("prob", 6).alias("prob"))


_ENS_DEC = f"""{_ENS},
lpe as (select e.id, e.class_idx, e.prob, g.y[e.class_idx + 1] as y
        from ensp e join gold g on e.id = g.id),
{_grid_sql('lpe', 'prob')},
erk as (select *, row_number() over (partition by id order by prob desc, class_idx) as prk from lpe),
edec as (select r.id, r.class_idx, r.y, r.prob,
           cast(r.prob >= c6.threshold or r.prk <= {UNION_K} as integer) as yhat
         from erk r join c6 on r.class_idx = c6.class_idx)"""


@register("s14_domain_predictions", f"""
with {_ENS_DEC}
select id, cast(class_idx as integer) as class_idx, yhat as label, round(prob, 6) as prob from edec""")
def s14_domain_predictions(spark, sf_dir):
    """S14 + C12: ensemble predictions - labels and probabilities rounded to 6 digits."""
    res = score_ensemble(fx.logits(spark, sf_dir), fx.logits(spark, sf_dir), fx.gold(spark, sf_dir),
                         fx.gold(spark, sf_dir), topk=UNION_K)
    p = res.predictions
    z = F.arrays_zip(F.col("labels").alias("label"), F.col("probs").alias("prob"))
    return p.select("id", F.posexplode(z).alias("class_idx", "z")) \
        .select("id", F.col("class_idx").cast("int"), F.col("z.label").cast("int").alias("label"),
                F.col("z.prob").alias("prob"))


@register("c16_ensemble_metrics", f"""
with {_ENS_DEC}, {_metric_sql('edec')}
select round(macro_f1, 5) as macro_f1, round(micro_f1, 5) as micro_f1,
       (select round(avg(threshold), 5) from c6) as avg_threshold from mm""")
def c16_ensemble_metrics(spark, sf_dir):
    """Calibrate on the logits, decode thresholds + top-2, score macro / micro F1."""
    res = score_ensemble(fx.logits(spark, sf_dir), fx.logits(spark, sf_dir), fx.gold(spark, sf_dir),
                         fx.gold(spark, sf_dir), topk=UNION_K)
    return res.metrics



