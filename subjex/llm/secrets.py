"""Secret scan: fixed patterns plus sliding-window Shannon entropy, built-in functions only.

Base kinds are ``assign``, ``access`` and ``hex``.  The method adds ``entropy`` spans: a
candidate is a maximal run of token characters with a letter and a digit, its character
class (hex, alnum, token) sets the threshold, and a window of fixed width moves over it.
The entropy of the next window comes from that of the last by the counts of the character
that leaves and the one that enters (``S = sum n log2 n`` changes by two terms each).
Windows at or over the threshold are joined to spans.  Candidates on the allow list, and
spans inside a base span, are left out.

Defined results: a null or empty text has no spans; offsets are code points, end
exclusive; other columns pass through unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import let

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a window of 20 characters must reach, by the character class of its candidate.
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "token": 3.7}
_TOKEN = "A-Za-z0-9+/_=-"
CANDIDATE = (rf"(?<![{_TOKEN}])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[{_TOKEN}]{{{WINDOW},}}")
#: Candidates that hold one of these (any case) are no secrets: placeholders, licence paths, UUIDs.
ALLOW = (r"example", r"placeholder", r"dummy", r"x{6,}", r"0{8,}", r"licenses?/",
         r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")

_SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Steps that one fold appends to an array; longer ones are cut into blocks of this many.
BLOCK = 256


def _blocks(n: Column) -> Column:
    """Numbers of the blocks of ``n`` things."""
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def _running(lengths: Column) -> Column:
    """Sums of an int array before each entry.  Appending copies, so blocks are summed on their
    own and their totals once more: n * BLOCK copies instead of n * n."""
    def sums(values):
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("before"))
        return F.aggregate(values, start, lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))
    parts = F.transform(_blocks(F.size(lengths)), lambda b: sums(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    return let(parts, lambda p: F.flatten(F.zip_with(
        p, sums(F.transform(p, lambda x: x["at"]))["before"], lambda x, base: F.transform(x["before"], lambda n: n + base))))


def _placed(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` with their places: array of struct(start, hit).

    The text between matches (``split``) and the matches themselves alternate, so
    running sums of their lengths give the starts.
    """
    def place(found):
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
        before = _running(F.zip_with(gaps, found, lambda g, h: g + F.length(h)))
        starts = F.zip_with(before, gaps, lambda n, g: n + g)
        return F.when(F.size(found) == 0, F.expr("cast(array() as array<struct<start:int,hit:string>>)")) \
            .otherwise(F.zip_with(starts, found, lambda s, h: F.struct(s.alias("start"), h.alias("hit"))))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _spans(places: Column, kind: str) -> Column:
    return F.transform(places, lambda p: F.struct(
        p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
        (p["start"] + F.length(p["hit"])).alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, in order of start and kind."""
    none = F.expr(f"cast(array() as {_SPAN})")
    # Matching a hit again gives its group 2.
    value = lambda hit: F.regexp_extract(hit, ASSIGN, 2)
    assign = F.when(F.rlike(text, F.lit(ASSIGN)), _spans(
        F.filter(_placed(text, ASSIGN), lambda p: F.length(value(p["hit"])) >= 6), "assign")).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(
        F.filter(_placed(text, ACCESS), lambda p: F.length(p["hit"]) >= 20), "access")).otherwise(none)
    # Runs under 24 characters fail, so asking for 24 in the pattern finds the same runs.
    long_hex = HEX[:-1] + "{24,}"
    hexes = F.when(F.rlike(text, F.lit(long_hex)), _spans(_placed(text, long_hex), "hex")).otherwise(none)
    return F.sort_array(F.concat(assign, access, hexes))


def _nlogn(n: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(n * F.log2(n.cast("double")))


def _chars(text: Column) -> Column:
    """The characters of ``text``, split once."""
    return F.filter(F.split(text, ""), lambda c: c != "")


#: Token characters in the order of their count's place.
ALPHABET = "".join(chr(c) for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-")


def _hot_windows(hit: Column, threshold: Column, width: int) -> Column:
    """Joined [start, end) ranges of the windows of ``hit`` at or over ``threshold`` bits.

    The counts of a window's characters are carried along, packed into a few 64-bit words
    (``bits`` each): a step takes the leaving one and the entering one by a shift, and changes
    two words.  ``BLOCK`` windows make a fold, and the ranges of neighbouring folds are joined
    at the end, so the time is linear in the candidate's length.
    """
    bits = width.bit_length()
    per = 63 // bits
    words = -(-len(ALPHABET) // per)
    place = F.lit([max(ALPHABET.find(chr(c)), 0) for c in range(128)])
    empty = F.array(*[F.lit(0).cast("long") for _ in range(words)])
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c % per) * bits)
    ranges = "cast(array() as array<struct<start:int,end:int>>)"

    def count(counts, c):
        return F.call_function("shiftright", F.get(counts, F.floor(c / per).cast("int")), (c % per) * bits).bitwiseAND(F.lit((1 << bits) - 1))

    def changed(counts, c, sign):
        return F.transform(counts, lambda w, j: w + F.when(j == F.floor(c / per), sign * one(c)).otherwise(F.lit(0).cast("long")))

    def ends(acc):
        return F.when(acc["to"] > 0, F.concat(acc["done"], F.array(
            F.struct(acc["from"].alias("start"), acc["to"].alias("end"))))).otherwise(acc["done"])

    def note(acc, counts, total, i):
        hot = F.lit(math.log2(width)) - total / width >= threshold - 1e-9
        joins = (acc["to"] > 0) & (i <= acc["to"])
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(hot & ~joins, i).otherwise(acc["from"]).alias("from"),
            F.when(hot, i + width).otherwise(acc["to"]).alias("to"),
            F.when(hot & ~joins, ends(acc)).otherwise(acc["done"]).alias("done"))

    def fold(codes, block):
        """Ranges of the windows that start at block * BLOCK and the following ones."""
        begin = block * BLOCK
        first = F.aggregate(F.slice(codes, begin + 1, F.lit(width)), empty, lambda acc, c: changed(acc, c, 1))

        def total(counts):
            return F.aggregate(F.sequence(F.lit(0), F.lit(len(ALPHABET) - 1)), F.lit(0.0),
                               lambda acc, c: acc + _nlogn(count(counts, c)))

        def step(acc, i):  # the window that starts at i, from the one at i - 1
            leaves, enters = F.get(codes, i - 1), F.get(codes, i + width - 1)

            def left(counts, gone):
                n = count(counts, enters)
                total = acc["sum"] - _nlogn(gone) + _nlogn(gone - 1) + _nlogn(n + 1) - _nlogn(n)
                return note(acc, changed(counts, enters, 1), total, i)
            return let(changed(acc["counts"], leaves, -1), lambda c: left(c, count(acc["counts"], leaves)))
        start = let(first, lambda c: note({"to": F.lit(0), "from": F.lit(0), "done": F.expr(ranges)}, c, total(c), begin))
        last = F.least(begin + BLOCK - 1, F.size(codes) - width)
        moves = F.when(last > begin, F.sequence(begin + 1, last)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(moves, start, step, ends)

    def join(found):
        at = lambda i: F.get(found, i)
        starts = F.filter(found, lambda r, i: (i == 0) | (r["start"] > at(i - 1)["end"]))
        stops = F.filter(found, lambda r, i: (i == F.size(found) - 1) | (at(i + 1)["start"] > r["end"]))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))
    return let(F.transform(_chars(hit), lambda ch: F.get(place, F.ascii(ch))), lambda codes: let(
        F.flatten(F.transform(_blocks(F.size(codes) - width + 1), lambda b: fold(codes, b))), join))


def entropy_spans(text: Column, base: Column, width: int = WINDOW, thresholds: dict | None = None,
                  allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of high entropy that no base span holds."""
    limits = THRESHOLDS | (thresholds or {})
    allowed = "(?i)" + "|".join(f"(?:{a})" for a in allow)

    def of(place):
        hit = place["hit"]
        limit = F.when(F.rlike(hit, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), limits["hex"]) \
            .when(F.rlike(hit, F.lit("^[A-Za-z0-9]+$")), limits["alnum"]).otherwise(limits["token"])
        # bound once a candidate: the fold below names it in every step
        return F.transform(let(limit, lambda least: _hot_windows(hit, least, width)), lambda r: F.struct(
            (place["start"] + r["start"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"),
            (place["start"] + r["end"]).alias("end")))
    places = F.filter(_placed(text, CANDIDATE), lambda p: ~F.rlike(p["hit"], F.lit(allowed)))
    found = F.flatten(F.transform(places, of))
    new = F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return F.when(F.rlike(text, F.lit(CANDIDATE)), new).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: struct(base, spans) of struct(start, kind, end) arrays; kind indexes ``KINDS``."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, let(base_spans(body), lambda base: F.struct(
        base.alias("base"),
        F.sort_array(F.concat(base, entropy_spans(body, base))).alias("spans"))))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch of touching spans replaced by ``mark``; null stays null.
    The text is split into characters once, and the parts between spans are slices of them."""
    def parts(chars):
        """The text before each span that starts a stretch, with the mark, and the rest."""
        before = let(_reach(spans), lambda r: F.transform(spans, lambda s, i: F.when(
            s["start"] >= F.get(r, i),
            F.concat(F.array_join(F.slice(chars, F.get(r, i) + 1, s["start"] - F.get(r, i)), ""), F.lit(mark))).otherwise("")))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        rest = F.array_join(F.slice(chars, end + 1, F.greatest(F.size(chars) - end, F.lit(0))), "")
        return F.concat(F.array_join(before, ""), rest)
    return F.when(F.size(spans) == 0, text).otherwise(let(_chars(text), parts))


def _reach(spans: Column) -> Column:
    """The largest end of the spans before each one, 0 for the first; in blocks, as ``_running``."""
    def largest(ends):
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("before"))
        return F.aggregate(ends, start, lambda acc, e: F.struct(
            F.greatest(acc["at"], e).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))
    ends = F.transform(spans, lambda s: s["end"])
    parts = F.transform(_blocks(F.size(spans)), lambda b: largest(F.slice(ends, b * BLOCK + 1, BLOCK)))
    return let(parts, lambda p: F.flatten(F.zip_with(
        p, largest(F.transform(p, lambda x: x["at"]))["before"], lambda x, base: F.transform(x["before"], lambda n: F.greatest(n, base)))))
