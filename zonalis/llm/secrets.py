"""Secret scan with SQL functions only: patterns, and Markov models of characters.

The base patterns find assignments, access keys and long hexadecimal strings.  Beside
them, every long run of key characters outside these is scored by two character Markov models,
one of random strings and one of ordinary identifiers: the log-likelihood ratio of its
transitions decides, first for the whole run and else for each of its segments between
``/ _ = -``.  Both models are counted from labelled samples: random strings are
the values that the base patterns find in a bounded sample of ``SAMPLE`` texts and strings
drawn from digests; ordinary ones are the other words of those texts, and rules of one character.

Positions come from splitting the text by a pattern and adding up the lengths of pieces and
matches, so they count code points.  Running sums go by blocks and long runs by overlapping pieces,
so time grows with a text's length and its matches, not with their squares.  Everything runs inside the JVM.

Defined results: a null text is scanned as an empty one and has no span.  Spans of one kind never
overlap; spans of different kinds may, but a ``random`` span only stands where no base
span does.  Repeated rows each get their own result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SEGMENT = r"[A-Za-z0-9+]{20,}"
ASSIGNED = 12

#: Texts of the sample, strings drawn, least log-likelihood ratio in nats, and least per character.
SAMPLE, DRAWN, LEAST, LEAST_EACH = 2000, 2000, 15.0, 0.5
#: Codes of characters; characters of the candidates; pseudo-count of a transition.
CODES, LETTERS, PSEUDO = 128, 67, 0.5
#: Ordinary runs of one character, as in rules between paragraphs: one of each, of this length.
RULE = 9
MASK = "[secret]"
#: What base spans cover, at least; hexadecimal digits behind an access key may belong to one that begins inside.
_COVER = rf"{ASSIGN.replace('+)', '{12,})')}|AKIA[A-Z0-9]{{14,}}[0-9a-f]*|{HEX}"
#: Entries of a block of a running sum, and characters of a piece of a text or a run.
BLOCK, PIECE = 512, 256
_FAR = (1 << 31) - 1
_SPANS = "array<struct<s:int,k:int,e:int>>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, least: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` over all values up to each one, in blocks: an array grows by copies, so it is kept short."""
    start = F.struct(F.lit(least).alias("last"), F.array().cast("array<int>").alias("out"))

    def grow(state, value):
        last = join(state["last"], value)
        return F.struct(last.alias("last"), F.concat(state["out"], F.array(last)).alias("out"))

    def blocks(own):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(own, b * BLOCK + 1, F.lit(BLOCK)), start, grow, lambda state: state["out"]))

    def whole(inside):
        ends = F.aggregate(F.transform(inside, lambda part: F.element_at(part, -1)), start, grow, lambda state: state["out"])
        before = F.slice(F.concat(F.array(F.lit(least)), ends), F.lit(1), F.size(inside))
        return F.flatten(F.zip_with(inside, before, lambda part, b: F.transform(part, lambda x: join(x, b))))

    return _with(values, lambda own: F.when(F.size(own) > 0, _with(blocks(own), whole)).otherwise(F.array().cast("array<int>")))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, match) for the leftmost non-overlapping matches."""

    def found(whole):
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        ends = _running(F.zip_with(pieces, whole, lambda p, m: F.length(p) + F.length(m)), 0, _sum)
        return F.zip_with(ends, whole, lambda e, m: F.struct((e - F.length(m)).alias("s"), m.alias("match")))

    every = _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast("array<struct<s:int,match:string>>"))


def _span(start: Column, rank: int, match: Column) -> Column:
    return F.struct(start.alias("s"), F.lit(rank).alias("k"), (start + F.length(match)).alias("e"))


def _spans(matches: Column, rank: int) -> Column:
    return F.transform(matches, lambda x: _span(x["s"], rank, x["match"]))


def _base(text: Column) -> list[Column]:
    long_enough = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGNED
    found = [F.filter(_matches(text, ASSIGN), long_enough), _matches(text, ACCESS), _matches(text, HEX)]
    return [_spans(m, k) for k, m in enumerate(found, 1)]


def _overlapping(word: Column) -> Column:
    """The word in pieces that each begin with the last character of the one before."""
    return F.regexp_extract_all(word, F.lit(rf"(?s)(?=(.{{1,{PIECE + 1}}})).{{1,{PIECE}}}"), F.lit(1))


def _transitions(words: DataFrame, word: str) -> dict[tuple[int, int], int]:
    """Counts of neighbouring characters: at most CODES squared rows."""
    chars = words.select(F.explode(_overlapping(F.col(word))).alias("piece")).select(F.transform(F.split("piece", ""), F.ascii).alias("codes"), F.length("piece").alias("n"))
    pairs = chars.filter("n > 1").select(F.explode(F.zip_with(F.slice("codes", F.lit(1), F.col("n") - 1), F.slice("codes", F.lit(2), F.col("n") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pair"))
    return {(r["a"], r["b"]): r["count"] for r in pairs.groupBy("pair.a", "pair.b").count().collect() if r["a"] < CODES and r["b"] < CODES}


def drawn(spark: SparkSession, n: int = DRAWN) -> DataFrame:
    """Random strings in the usual alphabets, the same on every call."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    plain = F.translate(F.base64(F.unhex(digest)), "=", "")
    kinds = [F.substring(digest, 1, 40), plain, F.translate(plain, "+/", "-_"), F.translate(F.upper(plain), "+/", "09"), F.translate(plain, "+/", "xY")]
    return spark.range(0, n, 1, 4).select(F.explode(F.array(*kinds)).alias("word"))


def _rules(spark: SparkSession) -> DataFrame:
    letters = F.char(F.col("id"))
    return spark.range(CODES).select(F.repeat(letters, F.lit(RULE)).alias("word")).filter(letters.rlike("[A-Za-z0-9+/_=-]"))


def train(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of all transitions: random over ordinary, CODES rows of CODES values."""
    spark = docs.sparkSession
    total = docs.count()
    chance = F.xxhash64("text", F.lit(6)).bitwiseAND(F.lit((1 << 53) - 1))
    texts = docs.select(F.col(text).alias("text")).filter("text is not null").withColumn("chance", chance)
    # Twice as many as wanted by rate, each text once, then exactly by rank.
    some = texts.filter(F.col("chance") < int((1 << 53) * min(1.0, 2.0 * sample / max(total, 1)))).dropDuplicates(["chance"]).orderBy("chance").limit(sample)
    values = some.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))).alias("word")).filter(F.length("word") >= ASSIGNED)
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = some.select(F.explode(F.regexp_extract_all(cleaned, F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0))).alias("word"))
    counts = [_transitions(values.union(drawn(spark)), "word"), _transitions(ordinary.union(_rules(spark)), "word")]
    from_code = [[sum(c.get((a, b), 0) for b in range(CODES)) for a in range(CODES)] for c in counts]

    def log_p(k: int, a: int, b: int) -> float:
        return math.log((counts[k].get((a, b), 0) + PSEUDO) / (from_code[k][a] + PSEUDO * LETTERS))

    return [log_p(0, a, b) - log_p(1, a, b) for a in range(CODES) for b in range(CODES)]


def log_ratio(word: Column, ratios: list[float]) -> Column:
    """Sum of the transitions' log-likelihood ratios; ``word`` is ASCII and has two characters or more."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def of_piece(total, piece):
        codes = F.transform(F.split(piece, ""), F.ascii)
        steps = F.zip_with(F.slice(codes, F.lit(1), F.length(piece) - 1), F.slice(codes, F.lit(2), F.length(piece) - 1), lambda a, b: F.get(table, a * CODES + b))
        return F.aggregate(steps, total, _sum)

    return F.aggregate(_overlapping(word), F.lit(0.0), of_piece)


def _random(text: Column, ratios: list[float]) -> Column:
    """Spans of runs, or else of their segments, whose ratio says that they are random."""
    blank = lambda m: F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit(""))
    rest = F.array_join(F.zip_with(F.split(text, _COVER, -1), F.regexp_extract_all(text, F.lit(_COVER), F.lit(0)), lambda p, m: F.concat(p, blank(m))), "")
    rest = F.when(text.rlike(_COVER), rest).otherwise(text)
    is_random = lambda word: log_ratio(word, ratios) >= F.greatest(F.lit(LEAST), LEAST_EACH * F.length(word))

    def of_run(x):
        parts = F.filter(_matches(x["match"], SEGMENT), lambda y: is_random(y["match"]))
        return F.when(is_random(x["match"]), F.array(_span(x["s"], 4, x["match"]))).otherwise(F.transform(parts, lambda y: _span(x["s"] + y["s"], 4, y["match"])))

    return F.when(text.rlike(CANDIDATE), F.flatten(_with(rest, lambda r: F.transform(_matches(r, CANDIDATE), of_run)))).otherwise(F.array().cast(_SPANS))


def _united(base: Column, random: Column) -> Column:
    """All spans by start and kind, but for random ones that meet a base span."""

    def apart(both):
        ends = _running(F.transform(both, lambda x: F.when(x["k"] < 4, x["e"]).otherwise(0)), 0, F.greatest)
        starts = F.reverse(_running(F.reverse(F.transform(both, lambda x: F.when(x["k"] < 4, x["s"]).otherwise(_FAR))), _FAR, F.least))
        marked = F.zip_with(both, F.arrays_zip(ends.alias("end"), starts.alias("start")), lambda x, y: F.struct(x.alias("x"), ((x["k"] < 4) | (y["end"] <= x["s"]) & (y["start"] >= x["e"])).alias("stays")))
        return F.transform(F.filter(marked, lambda m: m["stays"]), lambda m: m["x"])

    return F.when(F.size(random) > 0, _with(F.array_sort(F.concat(base, random)), apart)).otherwise(base)


def find_secrets(docs: DataFrame, ratios: list[float], *, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two arrays of (s, k, e): the base spans, and all spans, by start and then kind."""
    body, names = fresh(docs, "body"), [fresh(docs, f"own_{k}") for k in KINDS]
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns(dict(zip(names, [*_base(F.col(body)), _random(F.col(body), ratios)], strict=True)))
    out = out.withColumn(base, F.array_sort(F.concat(*names[:3])))
    return out.withColumn(spans, _united(F.col(base), F.col(names[3]))).select(*docs.columns, base, spans)


def span_text(spans: str | Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind) + 1)).cast("long")


def redacted(text: Column, spans: str, mask: str = MASK) -> Column:
    """The text with every stretch covered by spans replaced by ``mask``; as it was without spans.

    What stays is put together from pieces of the text, so no span looks through all of it.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(own, a, b):
        one, two = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        head, tail = F.coalesce(F.get(own, one), F.lit("")), F.coalesce(F.get(own, two), F.lit(""))
        inside = F.array_join(F.slice(own, one + 2, F.greatest(two - one - 1, F.lit(0))), "")
        apart = F.concat(F.substr(head, a - one * PIECE + 1, F.lit(PIECE)), inside, F.substr(tail, F.lit(1), b - two * PIECE))
        return F.when(one == two, F.substr(head, a - one * PIECE + 1, b - a)).otherwise(apart)

    def build(own, ends):
        before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(spans))
        kept = F.zip_with(before, F.col(spans), lambda at, x: F.when(x["s"] >= at, F.concat(between(own, at, x["s"]), F.lit(mask))).otherwise(""))
        return F.array_join(F.concat(kept, F.array(between(own, F.element_at(ends, -1), F.length(text)))), "")

    ends = _running(F.transform(spans, lambda x: x["e"]), 0, F.greatest)
    once = _with(pieces, lambda own: _with(ends, lambda e: build(own, e)))
    return F.when(F.size(spans) > 0, once).otherwise(text)


def redact(docs: DataFrame, ratios: list[float], *, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with the secrets in its texts masked; other columns as they were."""
    base = fresh(docs, "base")
    spans = fresh(docs, "spans")
    found = find_secrets(docs, ratios, text=text, base=base, spans=spans)
    return found.withColumn(text, redacted(F.col(text), spans, mask)).select(*docs.columns)
