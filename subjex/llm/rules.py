"""Learned decision lists over text statistics, DataFrame functions only.

Sequential covering: a rule is a conjunction of thresholds on statistics; it is grown on
one part of the labelled rows by FOIL gain, pruned on the other by dropping the condition
whose loss helps most, and accepted while its precision there holds; the rows it covers
leave, and the next rule follows.  The list comes out as one ordered conditional expression.

Only binned counts per (statistic, bin) reach the driver: statistics x bins numbers a step.

Defined results: a null or empty text has no words and fails the base rule; without labels
of both classes no rule is learned and the base rule alone decides; rows without a label
are judged but not learned from; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import ASCII_WS, let, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _missing(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more: sort the windows, mark those
    that equal a neighbour, count the distinct word places that they cover."""
    def marked(s):
        here = lambda j: F.get(s, j)["win"]
        same = lambda j: F.coalesce(here(j) == here(j - 1), F.lit(False)) | F.coalesce(here(j) == here(j + 1), F.lit(False))
        return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), same), lambda j: let(
            F.get(s, j)["at"], lambda at: F.array(at, at + 1, at + 2))))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("win"), i.alias("at")))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(
        F.size(F.array_distinct(let(F.sort_array(windows), marked)))).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the ratios that rules may use; ``docs`` keeps its columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(ASCII_WS)) != "")
    out = docs.withColumn("_s", let(words(body), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"))))
    out = out.withColumn("_l", let(lines, lambda x: F.struct(
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"))))
    blank = F.length(F.translate(body, ASCII_WS, ""))
    out = out.withColumns({
        "n_words": F.col("_s.n_words"), "n_repeat_words": F.col("_s.n_repeat_words"),
        "n_dup_lines": F.col("_l.n_dup_lines"), "word_chars": blank.cast("long"),
        "n_symbols": _missing(body, SYMBOLS), "n_upper": _missing(body, UPPER), "n_bangs": _missing(body, "!"),
        "n_distinct_words": F.col("_s.n_distinct_words"), "n_lines": F.col("_l.n_lines")}).drop("_s", "_l")
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.withColumns({
        "mean_word": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"),
        "distinct_rate": per("n_distinct_words", "n_words"), "upper_rate": per("n_upper", "word_chars"),
        "bang_rate": per("n_bangs", "n_words"), "log_words": F.log1p(F.col("n_words").cast("double"))})


FEATURES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate",
            "bang_rate", "log_words")
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def learn(rows: DataFrame, positive: str, features: tuple[str, ...] = FEATURES, bins: int = 24,
          max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 5,
          max_rows: int = 200_000, seed: int = 7) -> list[list[tuple[str, str, float]]]:
    """Rules for ``positive`` (0/1 column) as lists of (feature, ``>`` or ``<=``, threshold).

    ``rows`` is read once per step and must be cheap (a written table).  Beyond
    ``max_rows`` labelled rows a hash sample of about that many is taken.
    """
    total = rows.count()
    key = F.xxhash64(*features, F.lit(seed))
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1_000_000)) < int(1e6 * max_rows / total))
    points = [i / bins for i in range(1, bins)]
    asked = [F.percentile_approx(F.when(F.col(positive) == c, F.col(f)), points).alias(f"{f}_{c}")
             for f in features for c in (0, 1)]
    got = rows.agg(*asked).first()
    if any(got[f"{f}_{c}"] is None for f in features for c in (0, 1)):
        return []
    cuts = {f: sorted(set(got[f"{f}_0"]) | set(got[f"{f}_1"])) for f in features}


    def over(f):
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[f]]), lambda c: F.col(f) > c))
    binned = rows.select(
        (F.pmod(key, F.lit(3)) == 0).alias("prune"), F.col(positive).cast("int").alias("y"),
        # the bin is the number of cuts under the value: value > cuts[b] holds exactly for bins over b
        *[over(f).alias(f) for f in features])
    cells = binned.groupBy("prune", *features).agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).coalesce(8).persist()

    def test(cond):
        f, op, b = cond
        return F.col(f) > b if op == ">" else F.col(f) <= b

    def all_of(conds):
        out = F.lit(True)
        for c in conds:
            out = out & test(c)
        return out

    def counts(df, conds_list):
        """(p, n) under each conjunction, in one aggregate."""
        exprs = [F.coalesce(F.sum(F.when(all_of(c), F.col(k))), F.lit(0)).alias(f"{k}{i}")
                 for i, c in enumerate(conds_list) for k in ("p", "n")]
        r = df.agg(*exprs).first()
        return [(r[f"p{i}"], r[f"n{i}"]) for i in range(len(conds_list))]

    def grow(df):
        conds: list = []
        while len(conds) < max_conditions:
            here = df.where(all_of(conds))
            long = here.select("p", "n", F.explode(F.array(*[
                F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features])).alias("x"))
            table = {(r["f"], r["b"]): (r["p"], r["n"]) for r in
                     long.groupBy("x.f", "x.b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}
            p0 = sum(v[0] for k, v in table.items() if k[0] == features[0])
            n0 = sum(v[1] for k, v in table.items() if k[0] == features[0])
            if not p0 or not n0:
                break
            best, gain = None, 1e-6
            for f in features:
                low_p = low_n = 0
                for b in range(len(cuts[f])):
                    p, n = table.get((f, b), (0, 0))
                    low_p, low_n = low_p + p, low_n + n
                    for op, (cp, cn) in (("<=", (low_p, low_n)), (">", (p0 - low_p, n0 - low_n))):
                        if cp >= min_covered:
                            g = cp * (math.log2(cp / (cp + cn)) - math.log2(p0 / (p0 + n0)))
                            if g > gain:
                                best, gain = (f, op, b), g
            if best is None:
                break
            conds.append(best)
        return conds

    def worth(pn):
        return (pn[0] - pn[1]) / (pn[0] + pn[1]) if sum(pn) else -1.0

    growing, pruning = cells.where("not prune"), cells.where("prune")
    found = []
    while len(found) < max_rules:
        conds = grow(growing)
        if not conds:
            break
        while len(conds) > 1:
            shorter = [conds[:i] + conds[i + 1:] for i in range(len(conds))]
            now, *after = counts(pruning, [conds, *shorter])
            i = max(range(len(after)), key=lambda k: (worth(after[k]), after[k][0]))
            if worth(after[i]) < worth(now):
                break
            conds = shorter[i]
        (p, n), = counts(pruning, [conds])
        if p + n == 0 or p / (p + n) < min_precision:
            break
        found.append(conds)
        growing, pruning = growing.where(~all_of(conds)), pruning.where(~all_of(conds))
    cells.unpersist()
    return [[(f, op, float(cuts[f][b])) for f, op, b in conds] for conds in found]


def rule_column(rule) -> Column:
    out = F.lit(True)
    for f, op, x in rule:
        out = out & (F.col(f) > x if op == ">" else F.col(f) <= x)
    return out


def decision_list(rules) -> Column:
    """The number of the first rule that holds (from 1), 0 when none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule_column(rule), F.lit(i)).otherwise(out)
    return out
