"""Secrets in texts: three patterns, and character Markov models that find random strings which no pattern names; DataFrame functions only.

The models are tables of transitions from one character to the next. One is trained on ordinary identifiers, one on the strings of
each pattern, which label them as random; a pattern without strings leaves its model uniform. A long run of identifier characters is
added if its mean log-likelihood ratio of the best random model to the ordinary one passes what nearly all ordinary identifiers
stay under that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ._stage import input_partitions, stage

#: Kinds in the order in which spans of one start are listed; the last one is the models'.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs of their letters are whole matches or none, so that their least length may be part of the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
#: Characters of an assigned value at least, of a run that the models judge, and of an ordinary identifier that they learn from.
VALUE, RUN, IDENTIFIER = 8, 16, 8
LETTERS = "[A-Za-z0-9+/_=-]"
ALPHABET, CODES = 67, 128
#: The part of ordinary strings kept for the threshold, one in; the part of these that stays under it (more would let secrets among
#: them raise it); how many times each transition counts before any is seen.
HELD_OUT, QUANTILE, PRIOR = 4, 0.99, 0.5
#: Bytes of input for each ordinary string to choose from where only some are asked for; a text has several times as many.
BYTES_EACH = 400
#: Matches that are numbered at once.
BLOCK = 256
_SPAN = "array<struct<start:int,end:int,found:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _placed(gaps: Column, found: Column) -> Column:
    """Start, end and text of matches from the texts before each of them; in blocks, so that long lists aren't copied for each match."""

    def step(done: Column, x: Column) -> Column:
        start = done["end"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("end"), F.concat(done["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("found")))).alias("out"))

    def add(done: Column, b: Column) -> Column:
        return F.struct((done["end"] + b["end"]).alias("end"), F.concat(done["out"], F.array(F.struct(done["end"].alias("base"), b["out"].alias("out")))).alias("out"))

    def whole(steps: Column) -> Column:
        none = F.struct(F.lit(0).alias("end"), F.array().cast(_SPAN).alias("out"))
        first = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<struct<base:int,out:{_SPAN}>>").alias("out"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, BLOCK), none, step))
        based = F.aggregate(blocks, first, add, lambda done: done["out"])
        return F.flatten(F.transform(based, lambda b: F.transform(b["out"], lambda x: _moved(x, b["base"]))))

    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    return F.when(F.size(found) > 0, _let(steps, whole)).otherwise(F.array().cast(_SPAN))


def _moved(span: Column, by: Column) -> Column:
    return F.struct((span["start"] + by).alias("start"), (span["end"] + by).alias("end"), span["found"].alias("found"))


def spans(text: Column, pattern: str) -> Column:
    """Start, end (code points, exclusive) and text of the leftmost matches that don't overlap."""
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _placed(F.split(text, pattern, -1), found))


def _assignments(docs: DataFrame, *columns: str) -> DataFrame:
    """columns, text (null: empty), hits: what ASSIGN matches, gaps: the texts between. Texts without its words aren't matched."""
    text = docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))
    low = text.withColumn("low", F.lower("text"))
    named = reduce(or_, (F.col("low").contains(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")))
    hits = F.when(named, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    cut = low.withColumn("hits", hits).drop("low")
    return cut.withColumn("gaps", F.when(F.size("hits") > 0, F.split("text", ASSIGN, -1)).otherwise(F.array("text")))


def _searched(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex: spans by pattern; runs: long runs outside them, for the models."""
    at = _assignments(docs, "doc_id").withColumn("all", _placed(F.col("gaps"), F.col("hits")))
    # texts between assignments, and where they begin; most texts are one
    begins = F.concat(F.array(F.lit(0)), F.transform("all", lambda x: x["end"]))
    run = F.flatten(F.zip_with("gaps", begins, lambda gap, begin: F.transform(spans(gap, f"{LETTERS}{{{RUN},}}"), lambda x: _moved(x, begin))))
    ran = at.withColumn("ran", run)
    # letters of the other patterns are letters of a run, so that a span of theirs lies within one, or within an assignment
    has = lambda pattern: F.exists("ran", lambda x: x["found"].rlike(pattern)) | (F.size("hits") > 0)
    named = lambda pattern: F.when(has(pattern), spans(F.col("text"), pattern)).otherwise(F.array().cast(_SPAN))
    return ran.select(
        "doc_id",
        F.filter("all", lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= VALUE).alias("assign"),
        named(ACCESS).alias("access"),
        named(HEX).alias("hex"),
        # a run without letter is a number
        F.filter("ran", lambda x: ~x["found"].rlike(f"{ACCESS}|{HEX}") & x["found"].rlike("[A-Za-z]")).alias("runs"),
    )


def ordinary_identifiers(docs: DataFrame, most: int | None = None) -> DataFrame:
    """h, word: all runs of identifier characters, a letter among them, outside what the patterns find, and hashes of row and place; with most, those with the least hashes."""
    gap = _assignments(docs, "doc_id").select("doc_id", F.posexplode("gaps").alias("gap", "text"))
    word = gap.select("doc_id", "gap", F.posexplode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{IDENTIFIER},}}"), F.lit(0))).alias("place", "word"))
    ordinary = word.where(~F.col("word").rlike(f"{ACCESS}|{HEX}") & F.col("word").rlike("[A-Za-z]"))
    if most is None:
        return ordinary.select(F.xxhash64("doc_id", "gap", "place", "word").alias("h"), "word")
    return _sampled(ordinary, most, 1 / input_partitions(docs, BYTES_EACH * most), "doc_id", "gap", "place", "word")


def _sampled(rows: DataFrame, most: int, part: float, *by: str) -> DataFrame:
    """The rows with the least hashes, of which only about that part is looked at, so that what meets in one task has a bound."""
    hashed = rows.select(F.xxhash64(*by).alias("h"), "word")
    low = hashed if part >= 1 else hashed.where(F.col("h") < int((part - 0.5) * 2.0**64))
    return low.orderBy("h", "word").limit(most)


def _codes(word: Column) -> Column:
    return F.transform(F.split(word, ""), lambda c: F.ascii(c))


class SecretModel(NamedTuple):
    table: DataFrame  #: one row: ratios, an array for each random kind with the log-likelihood ratio of code a to code b at a * 128 + b
    threshold: float


def _ratio(word: Column, ratios: Column) -> Column:
    """The largest mean log-likelihood ratio of word's transitions; null if it has none."""
    codes = _codes(word)
    places = F.transform(F.slice(codes, 2, F.size(codes)), lambda b, i: F.element_at(codes, i + 1) * CODES + b + 1)
    mean = lambda table: F.aggregate(places, F.lit(0.0), lambda total, i: total + F.element_at(table, i)) / F.size(places)
    return F.when(F.size(codes) > 1, F.array_max(F.transform(ratios, mean)))


def learn_secrets(found: DataFrame, ordinary: DataFrame) -> SecretModel:
    """Models from all spans of _searched and all ordinary identifiers (word). Equal strings are counted first."""
    value = lambda kind: F.regexp_extract("x.found", ASSIGN, 2) if kind == "assign" else F.col("x.found")
    rows = ordinary.select(F.lit("ordinary").alias("kind"), "word")
    for kind in KINDS[:3]:
        # values of assignments may hold a dot, which no run does
        rows = rows.union(found.select(F.explode(kind).alias("x")).select(F.lit(kind).alias("kind"), F.explode(F.split(value(kind), "\\.")).alias("word")))
    words = rows.groupBy("kind", "word").agg(F.count("*").alias("n"))
    own = (F.col("kind") == "ordinary") & (F.pmod(F.xxhash64("word"), F.lit(HELD_OUT)) == 0)
    strings = stage(words.withColumn("held", own), "secret-strings")
    codes = strings.where("NOT held").select("kind", "n", _codes(F.col("word")).alias("c"))
    steps = codes.select("kind", "n", F.explode(F.transform(F.slice("c", 2, F.size("c")), lambda b, i: F.struct(F.element_at("c", i + 1).alias("a"), b.alias("b")))).alias("s"))
    counts = steps.groupBy("kind", "s.a", "s.b").agg(F.sum("n").alias("n"))
    # from here on at most 4 kinds of 67 x 67 transitions, whatever the input
    after = counts.groupBy("kind", "a").agg(F.sum("n").alias("of"))
    kinds = F.explode(F.array(*map(F.lit, (*KINDS[:3], "ordinary"))))
    codes = found.sparkSession.range(CODES * CODES, numPartitions=1).select("id", F.floor(F.col("id") / CODES).cast("int").alias("a"), (F.col("id") % CODES).cast("int").alias("b"), kinds.alias("kind"))
    every = codes.join(counts, ["kind", "a", "b"], "left").join(after, ["kind", "a"], "left")
    log = F.log((F.coalesce("n", F.lit(0)) + PRIOR) / (F.coalesce("of", F.lit(0)) + PRIOR * ALPHABET))
    each = every.groupBy("id").agg(*(F.max(F.when(F.col("kind") == k, log)).alias(k) for k in (*KINDS[:3], "ordinary")))
    tables = [F.transform(F.array_sort(F.collect_list(F.struct("id", (F.col(k) - F.col("ordinary")).alias("r")))), lambda x: x["r"]).alias(k) for k in KINDS[:3]]
    table = stage(each.agg(*tables).select(F.array(*KINDS[:3]).alias("ratios")), "secret-model")
    score = _with(strings.where("held"), table).select(_ratio(F.col("word"), F.col("ratios")).alias("score"), "n")
    edge = exact_quantiles(score, "score", {"t": QUANTILE}, weight="n").first()["t"]
    return SecretModel(table, max(0.0, edge or 0.0))


def _with(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows and the model's one row, a megabyte at most whatever the input."""
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(table.withColumn("one", F.lit(1))), "one").drop("one")


def find_secrets(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """doc_id, base and secrets for every row of docs (doc_id, text): arrays of start, kind, end (code points, exclusive) and score, by start, then by kind.

    base: what the patterns find, leftmost matches without overlap for each kind, whole matches; those with too short a value don't
    count, but nothing else is found in them. secrets: these and the runs that the models add (kind model), outside the others (runs
    without a letter are numbers, and not judged); only they have a score. Without a model one is learnt from all strings of docs.
    Null and empty texts have no secrets; rows with equal or missing doc_id are rows of their own. An empty table gives an empty
    result. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    found = stage(_searched(docs), "secret-spans")
    model = model or learn_secrets(found, ordinary_identifiers(docs))
    judged = _with(found, model.table)
    listed = lambda kind, score: lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), score(x).alias("score"))
    none = lambda x: F.lit(None).cast("double")
    base = F.concat(*(F.transform(k, listed(k, none)) for k in KINDS[:3]))
    scored = F.transform("runs", listed("model", lambda x: _ratio(x["found"], F.col("ratios"))))
    added = F.filter(scored, lambda x: x["score"] > model.threshold)
    plain = lambda spans: F.transform(F.array_sort(spans), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["score"].alias("score")))
    return judged.select("doc_id", plain(base).alias("base"), plain(F.concat(base, added)).alias("secrets"))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
