"""Secret scans (operator 7), in DataFrame functions only.

Three base rules find assigned values, access keys and hex runs. Two character Markov models, one of random strings and
one of ordinary identifiers, are trained from labelled samples; a run of key-like characters whose log-likelihood ratio
favours the random model is added as kind ``markov``. The ratio is a lookup in one constant table of letter pairs.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # 20 characters or more
HEX = "[0-9a-f]{24,}"
#: Whole runs of key-like characters, 16 or more, with a digit and a letter: what the models judge.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = "[A-Za-z_]{8,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: Training takes about so many documents, spread over the table, for each label; letters are smoothed by SMOOTHING.
LABELLED_DOCUMENTS, SMOOTHING = 20_000, 0.5
#: Share of a uniform choice mixed into the random model, so that it isn't tied to the kinds of keys in the sample.
UNIFORM = 0.5
#: A run is flagged above this ratio in all, and this ratio per letter pair.
MIN_RATIO, MIN_MEAN_RATIO = 8.0, 0.5


#: Matches that are walked through together: arrays that grow by a match at a time are copied at each.
WALKED = 64


def _walked(items: Column, step, kind: str) -> Column:
    """What step makes of each item in turn: step(at, item) gives the next at (an int, 0 at first) and a value of this kind."""

    def part(block: Column, at: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            after, value = step(a["at"], x)
            return F.struct(after.alias("at"), F.concat(a["out"], F.array(value)).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), F.expr(f"cast(array() AS array<{kind}>)").alias("out")), one)

    blocks = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / WALKED).cast("int")),
        F.expr(f"cast(array() AS array<struct<at:int,out:array<{kind}>>>)"),
        lambda b, k: F.concat(b, F.array(part(F.slice(items, k * WALKED + 1, F.lit(WALKED)), F.coalesce(F.get(b, F.size(b) - 1)["at"], F.lit(0))))),
    )
    return F.when(F.size(items) == 0, F.expr(f"cast(array() AS array<{kind}>)")).otherwise(F.flatten(F.transform(blocks, lambda b: b["out"])))


def _spans(text: Column, pattern: str, kind: int, values: Column | None = None, least: int = 0) -> Column:
    """Spans (start, kind, stop, value) of all matches, leftmost and non-overlapping; those with a shorter value dropped.

    split() and regexp_extract_all() find the same matches; the pieces between them give the places (code points).
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    values = found if values is None else values
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), F.arrays_zip(found.alias("m"), values.alias("v")), lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m["m"]).alias("len"), m["v"].alias("v")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        stop = at + x["gap"] + x["len"]
        return stop, F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["v"].alias("value"))

    walked = _walked(pairs, step, "struct<start:int,kind:int,stop:int,value:string>")
    return F.filter(walked, lambda s: F.length(s["value"]) >= least)


_BASE = ("assign", "access", "hex")


def base_spans(text: Column) -> Column:
    """A struct of the base spans of each kind: assign, access, hex."""
    return F.struct(
        _spans(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), 6).alias("assign"),
        _spans(text, ACCESS, 1).alias("access"),
        _spans(text, HEX, 2).alias("hex"),
    )


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """The ratio table, log P(b | a, random) - log P(b | a, identifier), for each pair of ALPHABET.

    Labelled samples: what the base rules match is random; the words of eight letters or more of the same documents are
    identifiers. Both come from about LABELLED_DOCUMENTS documents chosen by a hash of the text. The counts, at most two
    per pair, are all that reaches the driver.
    """
    step = max(1, docs.count() // LABELLED_DOCUMENTS)
    chosen = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(step)) == 0)
    spans = chosen.withColumn("base", base_spans(F.col("t")))
    random = F.transform(F.concat(*(f"base.{k}" for k in _BASE)), lambda s: F.struct(F.lit(1).alias("label"), s["value"].alias("w")))
    plain = F.transform(F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(0)), lambda w: F.struct(F.lit(0).alias("label"), w.alias("w")))
    words = spans.select(F.explode(F.concat(random, plain)).alias("x")).groupBy("x.label", "x.w").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.select("label", "n", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substr(w, i, 2))")).alias("pair"))
    counted = pairs.groupBy("label", "pair").agg(F.sum("n").alias("n")).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()
    size = len(ALPHABET)
    tally = {k: [[0.0] * size for _ in range(size)] for k in (0, 1)}
    place = {c: i for i, c in enumerate(ALPHABET)}
    for r in counted:
        tally[r.label][place[r.pair[0]]][place[r.pair[1]]] += r.n
    chance = {}
    for k, rows in tally.items():  # pairs fall back on how frequent their second letter is
        seconds = [SMOOTHING + sum(row[b] for row in rows) for b in range(size)]
        single = [n / sum(seconds) for n in seconds]
        chance[k] = [[(row[b] + single[b]) / (sum(row) + 1) for b in range(size)] for row in rows]
    out = [math.log(UNIFORM / size + (1 - UNIFORM) * chance[1][a][b]) - math.log(chance[0][a][b]) for a in range(size) for b in range(size)]
    return out


def _ratio(value: Column, table: Column) -> Column:
    at = lambda i: F.instr(F.lit(ALPHABET), F.substr(value, i, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, at(i) * len(ALPHABET) + at(i + 1)))


def secret_spans(docs: DataFrame, ratios: list[float], text: str, column: str = "secrets") -> DataFrame:
    """Adds a struct: assign, access and hex (the base spans of each kind), base and all, arrays of (start, kind, stop,
    value) by start and then kind as listed in KINDS. text must not be null.

    Markov spans that overlap a base span are left out; base spans always stay.
    """
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    base, both = fresh(docs, "base_spans"), fresh(docs, "base_list")
    found = docs.withColumn(base, base_spans(F.col(text))).withColumn(both, F.array_sort(F.concat(*(F.col(base)[k] for k in _BASE))))
    runs = _spans(F.col(text), RUN, 3)
    free = F.filter(runs, lambda r: ~F.exists(F.col(both), lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))
    random = F.filter(free, lambda r: (_ratio(r["value"], table) > MIN_RATIO) & (_ratio(r["value"], table) > MIN_MEAN_RATIO * (F.length(r["value"]) - 1)))
    whole = F.struct(*(F.col(base)[k].alias(k) for k in _BASE), F.col(both).alias("base"), F.array_sort(F.concat(F.col(both), random)).alias("all"))
    return found.withColumn(column, whole).drop(base, both)


def span_list(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document.

    Null and empty texts have no spans (base_sha256 is the digest of the empty string). Each row is judged by itself, so
    repeated rows and ids give repeated rows. An empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body_text"))
    found = secret_spans(rows, train(docs, text), "body_text")
    return found.select(
        "doc_id",
        *(F.size(f"secrets.{k}").cast("long").alias(f"n_{k}") for k in _BASE),
        F.sha2(span_list(F.col("secrets.base")), 256).alias("base_sha256"),
        span_list(F.col("secrets.all")).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each secret span of text replaced by [REDACTED:kind]; overlapping spans become one, named by the first.

    A null text stays null. All rows and columns are kept.
    """
    body, secrets = fresh(docs, "body"), fresh(docs, "secrets")
    found = secret_spans(docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))), train(docs, text), body, secrets)
    names, spans = F.array(*[F.lit(k) for k in KINDS]), F.col(secrets)["all"]

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.concat(F.substr(F.col(body), at + 1, s["start"] - at), F.lit("[REDACTED:"), F.get(names, s["kind"]), F.lit("]"))
        return F.greatest(at, s["stop"]), F.when(s["start"] >= at, piece).otherwise(F.lit(""))

    rest = F.substr(F.col(body), F.array_max(F.transform(spans, lambda s: s["stop"])) + 1, F.length(body))
    cleaned = F.when(F.size(spans) == 0, F.col(text)).otherwise(F.concat(F.array_join(_walked(spans, step, "string"), ""), rest))
    return found.withColumn(text, cleaned).select(*docs.columns)
