"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Only DataFrame functions are used. Base spans are matches of three patterns. The battery then looks at every run of 20
or more token characters that no base span touches: the encoding is inferred from the characters, and three statistics
are tested against uniform symbols of its alphabet: chi-squared of the symbol counts, the number of runs above and below
the middle symbol, and the serial correlation of neighbours; they make one p-value. Discoveries are controlled twice,
apart for each doubling of the length, as long runs are told apart more easily. The Benjamini-Hochberg procedure on the
p-values, at rate ``BATTERY``, rejects that a run is random: of the runs turned down, at most that share was random.
Against the hypothesis of ordinary text, the likelihood ratio of uniform symbols to the characters' frequencies in
letter-only runs of the whole corpus is an e-value; the e-BH procedure at rate ``RATE`` controls the share of ordinary
text among the runs let through, whatever the dependence (e-values are taken down to whole logarithms, at most ``TOP``,
and statistics to tenths, which only makes both stricter). A run that is let through and not turned down is a span.

Cases: null text is empty. Positions are code points, ends exclusive. Very long texts: positions come from two-level
prefix sums, so the work is close to linear. Repeated rows are scanned each. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, release

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
RATE = 0.01
BATTERY = 0.001
TOP = 400
STEP = 256
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def matches(text: Column, pattern: str, make) -> Column:
    """An array with ``make(match, start)`` for each non-overlapping match; nulls that it returns are left out."""
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(text, pattern, f"{mark}$0{mark}"), mark, -1)

    def from_pieces(p: Column) -> Column:
        lens = F.transform(p, lambda x: F.length(x).cast("long"))

        def from_lens(n: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / STEP)), lambda b: _sum(F.slice(n, (b * STEP + 1).cast("int"), STEP)))

            def from_blocks(sums: Column) -> Column:
                def start(i: Column) -> Column:
                    block = F.floor(i / STEP).cast("int")
                    return _sum(F.slice(sums, F.lit(1), block)) + _sum(F.slice(n, block * STEP + 1, (i % STEP).cast("int")))

                at = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
                return F.transform(at, lambda i: make(F.element_at(p, (i + 1).cast("int")), start(i)))

            return let(blocks, from_blocks)

        return let(lens, from_lens)

    found = F.filter(let(pieces, from_pieces), lambda x: x.isNotNull())
    return F.when(text.rlike(pattern), found)


def _span(kind: int, least: Column | None = None):
    def make(m: Column, start: Column) -> Column:
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"))
        return F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8, span) if kind == 0 else span

    return make


_SPANS = "array<struct<start:long,kind:int,end:long>>"
_RUNS = "array<struct<start:long,end:long,run:string>>"


def _or_none(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.expr(f"cast(array() as {kind})"))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, runs): base spans, and the runs that none of them touches."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), "\u0001", "\u0002")
    base = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *(_or_none(matches(F.col("text"), p, _span(k)), _SPANS).alias(KINDS[k]) for k, p in enumerate((ASSIGN, ACCESS, HEX))))
    runs = matches(F.col("text"), RUN, lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("run")))
    runs = _or_none(runs, _RUNS)
    touched = F.concat("assign", "access", "hex")
    free = F.when(F.size(touched) == 0, runs).otherwise(let(touched, lambda t: F.filter(runs, lambda r: ~F.exists(t, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))))
    return base.select("doc_id", "assign", "access", "hex", free.alias("runs"))


def text_frequencies(found: DataFrame) -> dict[str, float]:
    """Frequency of each token character in letter-only runs, with a floor for the others; 64 numbers at most."""
    words = found.select(F.explode("runs").alias("r")).select(F.regexp_replace("r.run", "[-_]", "+").alias("w")).where("w rlike '^[A-Za-z+/]+$'")
    got = {r[0]: r[1] for r in words.select(F.explode(F.split("w", "")).alias("c")).groupBy("c").count().collect() if r[0]}
    total = sum(got.values()) + 64 * 0.5
    return {c: (got.get(c, 0) + 0.5) / total for c in ALPHABETS["base64"]}


def _tested(r: Column, frequency: dict[str, float]) -> Column:
    """(start, end, band, tenths, log_e) of a run; tenths: the joint statistic of the battery, standard normal for a random run."""
    symbols = F.translate(r["run"], "-_", "+/")
    alphabet = F.lit(ALPHABETS["base64"])
    for name, pattern in (("base36", "^[a-z0-9]+$"), ("upper", "^[A-Z0-9]+$"), ("lower", "^[a-z]+$"), ("HEX", "^[0-9A-F]+$"), ("hex", "^[0-9a-f]+$")):
        alphabet = F.when(symbols.rlike(pattern), ALPHABETS[name]).otherwise(alphabet)
    log_p = F.create_map(*(F.lit(x) for c, p in sorted(frequency.items()) for x in (c, math.log(p))))
    chars = F.filter(F.split(symbols, ""), lambda c: c != "")

    def statistics(x: Column, size: Column) -> Column:
        """How far the symbol numbers x are from uniform symbols of an alphabet of that size, in tenths."""
        n = F.size(x).cast("double")
        square = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
        z_chi = (size / n * square - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        changes = F.aggregate(pairs, F.lit(0.0), lambda a, w: a + ((w["p"] < size / 2) != (w["q"] < size / 2)).cast("double"))
        z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        middle = (size - 1) / 2
        serial = F.aggregate(pairs, F.lit(0.0), lambda a, w: a + (w["p"] - middle) * (w["q"] - middle))
        z_serial = serial / ((size * size - 1) / 12) / F.sqrt(n - 1)
        # The sum of three squares, by the cube-root approximation of chi-squared.
        joint = (F.pow((z_chi * z_chi + z_runs * z_runs + z_serial * z_serial) / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / math.sqrt(2 / 27)
        return F.greatest(F.lit(-100), F.least(F.lit(1000), F.floor(joint * 10))).cast("int")

    def tested(c: Column) -> Column:
        def given(a: Column) -> Column:
            size = F.length(a).cast("double")
            log_e = F.aggregate(c, F.lit(0.0), lambda s, x: s - F.coalesce(F.element_at(log_p, x), F.lit(0.0))) - F.size(c) * F.log(size)
            number = F.transform(c, lambda x: F.instr(a, x) - 1)
            return F.struct(
                r["start"].alias("start"),
                r["end"].alias("end"),
                F.floor(F.log2(F.size(c).cast("double"))).cast("int").alias("band"),
                let(number, lambda x: statistics(x, size)).alias("tenths"),
                F.least(F.lit(TOP), F.greatest(F.lit(-1), F.floor(log_e))).cast("int").alias("log_e"),
            )

        return let(alphabet, given)

    return let(chars, tested)


def thresholds(counts: dict[int, dict[int, int]], rate: float = RATE) -> dict[int, int]:
    """For each length band, the least whole log e-value that e-BH lets through; ``counts``: band -> log e-value -> runs."""
    out: dict[int, int] = {}
    for band, of in sorted(counts.items()):
        m, k = sum(of.values()), 0
        for log_e in sorted(of, reverse=True):
            k += of[log_e]
            if log_e >= 0 and log_e >= math.log(m / (rate * k)):
                out[band] = log_e
    return out


def rejections(counts: dict[int, dict[int, int]], rate: float = BATTERY) -> dict[int, int]:
    """For each length band, the least statistic (in tenths) that Benjamini-Hochberg rejects; ``counts``: band -> tenths -> runs."""
    out: dict[int, int] = {}
    for band, of in sorted(counts.items()):
        m, k = sum(of.values()), 0
        for tenths in sorted(of, reverse=True):
            k += of[tenths]
            if 0.5 * math.erfc(tenths / 10 / math.sqrt(2)) <= rate * k / m:
                out[band] = tenths
    return out


def _histogram(tested: DataFrame, value: str) -> dict[int, dict[int, int]]:
    """Runs by band and value; both are few by their kind."""
    out: dict[int, dict[int, int]] = {}
    for band, x, n in tested.select(F.explode("tested").alias("t")).groupBy("t.band", f"t.{value}").count().collect():
        out.setdefault(band, {})[x] = n
    return out


def secret_scan(docs: DataFrame, rate: float = RATE, battery: float = BATTERY) -> DataFrame:
    """(doc_id, assign, access, hex, random): arrays of spans (start, kind, end) for each row of ``docs(doc_id, text)``."""
    found = cut(found_spans(docs.select("doc_id", "text")))
    frequency = text_frequencies(found)
    tested = cut(found.select("doc_id", "assign", "access", "hex", F.transform("runs", lambda r: _tested(r, frequency)).alias("tested")))
    release(found)
    least, most = thresholds(_histogram(tested, "log_e"), rate), rejections(_histogram(tested, "tenths"), battery)

    def bound(of: dict[int, int], band: Column, none: int) -> Column:
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sorted(of.items()) for x in kv)), band), F.lit(none)) if of else F.lit(none)

    good = F.filter("tested", lambda t: (t["log_e"] >= bound(least, t["band"], TOP + 1)) & (t["tenths"] < bound(most, t["band"], 1 << 20)))
    spans = F.transform(good, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return tested.select("doc_id", "assign", "access", "hex", spans.alias("random"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
