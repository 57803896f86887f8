"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Patterns give the base spans. Further spans are long runs of key characters that a first-order Markov model of random
strings explains better than one of ordinary identifiers, by MARGIN nats a character. Both are trained from labelled
strings: random are those under base spans of a sample of the documents, and generated ones (hex, base 32 and base 64 of
digests), which cover the alphabets that the sample lacks; ordinary are the identifiers around base spans. A fifth of the
strings, by hash, is held out, and `held_out` tells how the models do on them. The models are tables of character pairs;
their ratios, in hundredths, are one literal array. Everything is built from DataFrame functions: matches are set apart by
a marker character, which texts cannot hold, as theirs is replaced by another control character first (neither is part
of any pattern).

A null text counts as empty and has no spans; very long texts are scanned whole. Repeated rows get equal rows, null ids
theirs. Spans of equal start are in order of their kinds. Spans of a kind do not overlap; those of the
Markov kind overlap no base span. With an empty table the result is empty. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.storage import stage

#: Kinds, their patterns, and the group and least length of it that a match needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
#: Cheap tests for a match that is long enough, to leave texts without one alone.
GATES = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "markov": "[A-Za-z0-9+/_=-]{20}"}

RUN, MARGIN = "[A-Za-z0-9+/_=-]{20,}", 0.6
#: For the models: generated strings of each shape, different texts that are searched for base spans, those of them
#: whose identifiers are read, and the characters of a text (at a place that its hash chooses) that are read of it then.
RANDOM_STRINGS, SECRET_DOCS, SAMPLE_DOCS, SAMPLE_DOC_CHARS = 3_000, 50_000, 1_000, 20_000

#: Added to the count of every pair.
FLOOR = 0.5

_LOW, _SIDE = 32, 95  # printable ASCII
_MARK, _OTHER = "\x01", "\x02"


def _spans(text: Column, pattern: str, group: int, least: int, gate: str, score=None) -> Column:
    """Array of (start, stop) of the leftmost matches whose group is long enough."""
    kind = "array<struct<start:int,stop:int>>"
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)

    def step(a: Column, x: Column) -> Column:
        stop = a["at"] + F.length(x)
        ok = a["inside"] & (F.length(F.regexp_extract(x, pattern, group)) >= least)
        if score is not None:
            ok = ok & score(x)
        span = F.array(F.struct(a["at"].alias("start"), stop.alias("stop"))).cast(kind)
        return F.struct(stop.alias("at"), (~a["inside"]).alias("inside"), F.when(ok, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(kind).alias("out"))
    found = F.aggregate(pieces, begin, step, lambda a: a["out"])
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(kind))


def labelled(docs: DataFrame) -> DataFrame:
    """(s, label, held_out): label is found or generated (random strings), or identifier.

    Texts are drawn by hash, in proportion to the number of different ones, so copies neither add to the sample nor thin it.
    """
    spark = docs.sparkSession
    kinds = docs.agg(F.approx_count_distinct("text", 0.02)).first()[0]
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    upto = lambda n: int((1 << 30) * min(1.0, n / max(1, kinds)))
    wide = docs.where(place < max(upto(SECRET_DOCS), upto(SAMPLE_DOCS))).select("text")
    start = F.pmod(F.xxhash64("text", F.lit("excerpt")), F.greatest(F.lit(1), F.length("text") - SAMPLE_DOC_CHARS + 1)) + 1
    excerpt = F.substring("text", start.cast("int"), F.lit(SAMPLE_DOC_CHARS))
    gated = F.col("text").rlike(GATES["assign"]) | F.col("text").rlike(GATES["access"]) | F.col("text").rlike(GATES["hex"])

    def values(pattern: str, group: int, least: int) -> Column:
        return F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda s: F.length(s) >= least)

    whole = F.concat(*[values(p, g, least) for _, p, g, least in KINDS])
    around = excerpt
    for _, pattern, _, _ in KINDS[:2]:
        around = F.regexp_replace(around, pattern, " ")
    around = F.regexp_replace(around, "[0-9a-f]{32,}", " ")
    names = F.regexp_extract_all(around, F.lit("([A-Za-z_][A-Za-z0-9_/-]{3,})"), F.lit(1))
    found = wide.where(gated).select(F.explode(whole).alias("s")).distinct().select("s", F.lit("found").alias("label"))
    once = wide.where(place < upto(SAMPLE_DOCS)).select(F.xxhash64("text").alias("h"), names.alias("names")).dropDuplicates(["h"])
    plain = once.select(F.explode("names").alias("s")).select("s", F.lit("identifier").alias("label"))
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    shapes = F.array(base64, F.translate(base64, "+/", "-_"), F.substring(digest, 1, 40), F.upper(F.substring(F.regexp_replace(base64, "[+/=]", ""), 1, 24)))
    made = spark.range(RANDOM_STRINGS).select(F.explode(shapes).alias("s"), F.lit("generated").alias("label"))
    every = found.unionByName(plain).unionByName(made)
    return stage(every.withColumn("held_out", F.pmod(F.xxhash64("s", F.lit("held")), F.lit(5)) == 0), "labelled-strings")


def _ratios(strings: DataFrame) -> list[int]:
    """Log-likelihood ratios, in hundredths of a nat, of a character given the one before (95 x 95), from labelled strings."""
    ordinary = F.col("label") == "identifier"
    cases = F.when(ordinary, F.array("s", F.initcap("s"), F.upper("s"))).otherwise(F.array("s"))
    rows = strings.where("length(s) > 1").select(ordinary.alias("ordinary"), F.explode(cases).alias("s"))
    at = F.sequence(F.lit(1), F.length("s") - 1)
    two = rows.select("ordinary", F.explode(F.transform(at, lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("p"))
    counts: dict[bool, dict[tuple[int, int], int]] = {False: {}, True: {}}
    for ordinary, p, n in two.where("p RLIKE '^[ -~]{2}$'").groupBy("ordinary", "p").count().collect():  # at most 2 * 95 * 95 rows
        counts[ordinary][ord(p[0]) - _LOW, ord(p[1]) - _LOW] = n
    models = []
    for ordinary in (False, True):
        sums = [0.0] * _SIDE
        for (a, _), n in counts[ordinary].items():
            sums[a] += n
        models.append([math.log((counts[ordinary].get((a, b), 0) + FLOOR) / (sums[a] + FLOOR * _SIDE)) for a in range(_SIDE) for b in range(_SIDE)])
    return [round(100 * (x - y)) for x, y in zip(*models, strict=True)]


def train(spark: SparkSession, docs: DataFrame) -> list[int]:
    """The table of ratios, from the labelled strings that are not held out."""
    return _ratios(labelled(docs).where("NOT held_out"))


def held_out(docs: DataFrame, least: int = 8) -> dict[str, tuple[int, int]]:
    """By label the held-out strings of `least` characters or more, and how many of them the models take for random."""
    strings = labelled(docs)
    test = _looks_random(_ratios(strings.where("NOT held_out")))
    rows = strings.where("held_out").where(F.length("s") >= least).groupBy("label")
    return {r[0]: (r[1], r[2]) for r in rows.agg(F.count(F.lit(1)), F.count_if(test(F.col("s")))).collect()}


def _looks_random(ratios: list[int]):
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")

    def test(run: Column) -> Column:
        codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - _LOW)
        codes = F.filter(codes, lambda c: c >= 0)

        def step(a: Column, c: Column) -> Column:
            more = F.when(a["before"] >= 0, F.get(table, a["before"] * _SIDE + c)).otherwise(F.lit(0))
            return F.struct(c.alias("before"), (a["sum"] + more).alias("sum"))

        begin = F.struct(F.lit(-1).alias("before"), F.lit(0).alias("sum"))
        return F.aggregate(codes, begin, step, lambda a: a["sum"]) > F.lit(int(100 * MARGIN)) * (F.length(run) - 1)

    return test


def scan(docs: DataFrame, ratios: list[int] | None = None) -> DataFrame:
    """doc_id and spans: an array of (start, kind_at, stop, kind) by start, then kind; code points, stop exclusive."""
    if ratios is None:
        ratios = train(docs.sparkSession, docs)
    base = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), _MARK, _OTHER).alias("text"))
    cols = [_spans(F.col("text"), pattern, group, least, GATES[kind]).alias(kind) for kind, pattern, group, least in KINDS]
    cols.append(_spans(F.col("text"), RUN, 0, 20, GATES["markov"], _looks_random(ratios)).alias("markov"))
    found = base.select("doc_id", *cols)
    clear = F.filter(
        "markov", lambda m: ~F.exists(F.concat(*[k for k, *_ in KINDS]), lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
    )
    found = found.withColumn("markov", clear)

    def named(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind_at"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    kinds = [*[k for k, *_ in KINDS], "markov"]
    return found.select("doc_id", F.array_sort(F.concat(*[named(i, k) for i, k in enumerate(kinds)])).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "markov")
