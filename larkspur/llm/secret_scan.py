"""Secret scans in Spark's own functions alone.

Base findings come from three patterns. The randomness battery adds runs of encoded characters that look uniformly
random: for each such run an encoding is inferred, and a chi-squared test of uniformity over its alphabet, a runs test
about the alphabet's middle and a test of serial correlation are combined into one p-value of "drawn uniformly".
False discoveries among the rejections are controlled by Benjamini and Hochberg's rule, within each class of lengths
(long runs give more power, so one cut for all lengths would let short ones pass); what is not rejected is a finding.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base patterns: kind, pattern, fewest characters of the match, its group that has the secret.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of fewer characters fails as a whole, so the length can stand in the pattern
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH = 12

#: Runs that the battery tests: 20 characters and more, with at least two digits and two letters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
LENGTHS = (20, 28, 40, 64)
FALSE_DISCOVERY_RATE = 0.05
#: p-values are counted in this many steps for each power of two; the BH cut is rounded down to a step.
STEPS = 16
LEAST_P = 1e-18

_SPANS = "array<struct<s:int,k:int,e:int,token:string>>"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points; [] where there are none."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["token"]), F.lit(0))
        one = F.array(F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["token"].alias("token")))
        return F.struct(end.alias("at"), F.when(x["token"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).cast(_SPANS).alias("out"))

    none = F.array().cast(_SPANS)
    spans = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]
    return F.when(text.rlike(pattern), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """Findings of the three patterns, sorted by start and kind."""
    assign = F.filter(_found(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["token"], ASSIGN, 2)) >= ASSIGN_LENGTH)
    return F.array_sort(F.concat(assign, _found(text, ACCESS, 1), _found(text, HEX, 2)))


def _upper_tail(z: Column) -> Column:
    """P(N > z) by Abramowitz and Stegun's formula 7.1.26."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    half = 0.5 * F.exp(-x * x) * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.when(z >= 0, half).otherwise(1 - half)


def randomness(token: Column) -> Column:
    """The battery's combined p-value: how well the token agrees with uniform draws from its inferred alphabet."""
    alphabet = (
        F.when(token.rlike("^[0-9a-f]+$"), F.lit(_DIGITS + _LOWER[:6]))
        .when(token.rlike("^[0-9A-F]+$"), F.lit(_DIGITS + _UPPER[:6]))
        .when(token.rlike("^[A-Z2-7]+=*$"), F.lit(_UPPER + _DIGITS[2:8]))
        .when(token.rlike("^[0-9a-z]+$"), F.lit(_DIGITS + _LOWER))
        .when(token.rlike("^[0-9A-Za-z]+$"), F.lit(_DIGITS + _UPPER + _LOWER))
        .when(token.rlike("[_-]"), F.lit(_UPPER + _LOWER + _DIGITS + "-_"))
        .otherwise(F.lit(_UPPER + _LOWER + _DIGITS + "+/"))
    )
    body = F.rtrim(token, F.lit("="))

    def places(x: Column) -> Column:
        chars = F.filter(F.split(x["body"], ""), lambda c: c != "")
        return F.struct(F.transform(chars, lambda c: (F.instr(x["alphabet"], c) - 1).cast("double")).alias("at"), F.length(x["alphabet"]).cast("double").alias("k"))

    def tests(x: Column) -> Column:
        at, k = x["at"], x["k"]
        n = F.size(at).cast("double")
        zero = F.lit(0.0)
        squares = F.aggregate(F.array_distinct(at), zero, lambda a, v: a + F.pow(F.size(F.filter(at, lambda w: w == v)).cast("double"), F.lit(2.0)))
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        half, middle = k / 2, (k - 1) / 2
        turns = F.size(F.filter(pairs, lambda p: (p["a"] >= half) != (p["b"] >= half))).cast("double")
        runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = F.aggregate(pairs, zero, lambda a, p: a + (p["a"] - middle) * (p["b"] - middle)) / ((k * k - 1) / 12 * F.sqrt(n - 1))
        least = F.least(_upper_tail(chi), 2 * _upper_tail(F.abs(runs)), 2 * _upper_tail(F.abs(serial)))
        return F.greatest(F.lit(LEAST_P), F.least(F.lit(1.0), 3 * least))

    return _let(_let(F.struct(body.alias("body"), alphabet.alias("alphabet")), places), tests)


def candidates(text: Column) -> Column:
    """Runs that the battery tests, with p."""
    mixed = F.filter(_found(text, CANDIDATE, 3), lambda x: (F.length(F.regexp_replace(x["token"], "[^0-9]", "")) >= 2) & (F.length(F.regexp_replace(x["token"], "[^A-Za-z]", "")) >= 2) & (F.length(F.rtrim(x["token"], F.lit("="))) >= LENGTHS[0]))
    return F.transform(mixed, lambda x: F.struct(x["s"], x["k"], x["e"], x["token"], randomness(x["token"]).alias("p")))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS[1:], 1):
        out = F.when(n >= least, i).otherwise(out)
    return out


def cuts(docs: DataFrame) -> list[float]:
    """For each class of lengths the largest p that is rejected, over all candidates of docs.

    The driver gets counts for at most len(LENGTHS) * STEPS * 60 steps, whatever the input.
    """
    p = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c"))
    step = F.floor(-F.log2("c.p") * STEPS).cast("int")
    counts = p.groupBy(_length_class(F.col("c.e") - F.col("c.s")).alias("class"), step.alias("step")).count().collect()
    out = []
    for i in range(len(LENGTHS)):
        steps = sorted((r["step"], r["count"]) for r in counts if r["class"] == i)
        total, seen, cut = sum(c for _, c in steps), 0, 0.0
        for s, c in reversed(steps):  # from the smallest p
            seen += c
            p_most = 2.0 ** (-s / STEPS)
            if p_most * total <= FALSE_DISCOVERY_RATE * seen:
                cut = p_most
        out.append(cut)
    return out


def spans(text: Column, rejected: list[float]) -> Column:
    """struct(base, all): the base findings, and those plus the battery's, each sorted by start and kind."""

    def extra(x: Column) -> Column:
        def stays(c: Column) -> Column:
            cut = F.lit(rejected[0])
            for i, least in enumerate(LENGTHS[1:], 1):
                cut = F.when(c["e"] - c["s"] >= least, rejected[i]).otherwise(cut)
            return (c["p"] > cut) & ~F.exists(x["base"], lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

        random = F.transform(F.filter(x["tested"], stays), lambda c: F.struct(c["s"], c["k"], c["e"], c["token"]))
        return F.struct(x["base"].alias("base"), F.array_sort(F.concat(x["base"], random)).alias("all"))

    return _let(F.struct(base_spans(text).alias("base"), candidates(text).alias("tested")), extra)


def _count(spans_: Column, kind: int) -> Column:
    """Number of findings of a kind. The lambda has one parameter: Spark gives a second one the element's index."""
    return F.size(F.filter(spans_, lambda x: x["k"] == kind)).cast("long")


def _joined(spans_: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored).

    n_assign, n_access, n_hex count the base findings, base_sha256 digests their places, spans lists all findings as
    kind:start:end in code points. Null and empty texts have none: counts 0, spans ''. Long texts are scanned whole. Findings
    of equal start come in the order of KINDS. Repeated rows give repeated results; no rows give no rows. Nothing is shuffled but the counts behind the cuts.
    """
    docs = docs.select("doc_id", "text")
    found = docs.select("doc_id", spans(F.coalesce("text", F.lit("")), cuts(docs)).alias("f"))
    base = F.col("f.base")
    number = [_count(base, k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *number, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("f.all")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each finding of text replaced by mark and n_chars counted anew; rows and columns stay.

    Findings that overlap or touch become one mark. Null texts stay null. n_chars changes only in rows with findings.
    """

    def rebuilt(x: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            fresh = s["s"] >= acc["at"]
            gap = F.when(fresh, F.concat(F.substring(x["text"], acc["at"] + 1, s["s"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["e"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

        return _let(F.aggregate(x["all"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add), lambda a: F.concat(a["out"], F.substring(x["text"], a["at"] + 1, F.length(x["text"]))))

    found = spans(F.coalesce("text", F.lit("")), cuts(docs.select("text")))["all"]
    text = _let(F.struct(F.col("text").alias("text"), found.alias("all")), lambda x: F.when(F.size(x["all"]) > 0, rebuilt(x)).otherwise(x["text"]))
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
