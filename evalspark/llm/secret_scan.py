"""Secret scan in Spark's own functions: patterns, and windowed entropy of candidate strings.

Base kinds are fixed patterns. The entropy kind looks at long runs of key
characters: a window of twenty characters slides over the run, the Shannon
entropy of its characters is kept up to date from the counts of the character
that enters and the one that leaves, and the largest value is held against the
limit of the run's character class. An allow-list of well-known harmless forms
suppresses candidates; it never touches the base kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.llm.tables import texts

# The base patterns. Letters of the assignment's words match in either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 6
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

# Bits per character that a window must reach, by class. Measured on 600 random strings each, the best window of
# twenty letters of either case has 3.5 bits or more in 99 of 100, of twenty lower-case ones 3.2; of twenty
# hexadecimal digits 3.0 in 95 of 100; of twenty letters of either case and digits 3.8 in 95 of 100; of twenty
# lower-case letters and digits 3.45 in 99 of 100.
LIMITS = {"hex": 3.0, "mixed": 3.8, "lower": 3.45, "letters": 3.2}

# Frequent pairs of letters in words of English, German, French and Spanish. Random letters make one of them in about
# a sixth of their pairs; a run of letters with this share or more is made of words.
WORD_PAIRS = """th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic
ne ea ra ce li ch ll be ma si om ur ei ge ie un di ss au us qu el la ta os ue ad do ns nc ui ai ac ci da em il ec tr pr ca pe
et no po sc so su ho rs ut lo ol ab am mo ct ry ay ke ag ty ul"""
WORD_SHARE = 0.45

# The allow-list: harmless forms of a candidate, and what may stand right before one.
HARMLESS = "|".join((
    r"(?i)(example|sample|placeholder|dummy|changeme|your[_-]|xxxx|0000000|redacted|lorem)",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)(abcdefghij|0123456789|qwertyuiop)",
    r"^[0-9=_-]+$",
))
# A candidate in the path of a URL, on the same run of non-blanks; not its user part, host or query.
IN_URL = r"://[^\x00-\x20/?#@]*/[^\x00-\x20?#]*(?![\s\S])"
BEFORE = rf"(?i)((sha-?1|sha-?256|sha-?384|sha-?512|md5|commit|revision|integrity)[ :=\"'-]*(?![\s\S])|{IN_URL})"
# A part of a path that looks like a key all the same.
KEY_PART = r"(^|/)(?=[^/]*[0-9])(?=[^/]*[a-z])(?=[^/]*[A-Z])[^/]{20,}"
BEFORE_CHARS = 64
BLOCK = 256  # array entries that are folded together, so that the work grows with the matches and not their square


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(items: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` entries."""
    def cut(held: Column) -> Column:
        count = F.ceil(F.size(held) / BLOCK).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda k: F.slice(held, k * BLOCK + 1, F.lit(BLOCK)))

    return bound(items, cut)


def carried(values: Column, zero: Column, merge) -> Column:
    """For every entry of a short array what ``merge`` makes of all entries before it."""
    start = F.struct(zero.alias("now"), F.array(zero).alias("all"))
    return F.aggregate(values, start, lambda state, v: F.struct(
        merge(state["now"], v).alias("now"), F.concat(state["all"], F.array(merge(state["now"], v))).alias("all")), lambda state: state["all"])


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches as (start, end, value, before): code points, end exclusive.

    The pieces between the matches give the places: block by block from zero,
    then shifted by the lengths of the blocks before. ``value`` is the text of
    ``group``; ``before`` is the end of the piece in front.
    """
    kind = "array<struct<start:bigint,end:bigint,value:string,before:string>>"
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("whole"), value.alias("value")),
        lambda x: F.struct(
            F.length(x["piece"]).cast("bigint").alias("skip"), F.length(x["whole"]).cast("bigint").alias("size"), x["value"].alias("value"),
            F.right(x["piece"], F.lit(BEFORE_CHARS)).alias("before")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["skip"]
        end = begin + x["size"]
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    def placed(folded: Column) -> Column:
        shift = carried(F.transform(folded, lambda b: b["at"]), F.lit(0).cast("bigint"), lambda n, v: n + v)
        return F.flatten(F.zip_with(folded, F.slice(shift, F.lit(1), F.size(folded)), lambda b, by: F.transform(b["found"], lambda m: F.struct(
            (m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"), m["before"].alias("before")))))

    found = bound(F.transform(blocks(steps), lambda some: F.aggregate(some, start, step)), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def outside(candidates: Column, base: Column) -> Column:
    """The candidates that lie within no base span; both come in order of their start.

    All spans are walked in one order with the farthest end of a base span so far,
    block by block from the farthest end of the blocks before.
    """
    kind = "array<struct<start:bigint,end:bigint,value:string,before:string>>"
    item = lambda x, order, value, before: F.struct(
        x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), value.alias("value"), before.alias("before"))
    none = F.lit(None).cast("string")
    walk = F.array_sort(F.concat(
        F.transform(base, lambda b: item(b, 0, none, none)), F.transform(candidates, lambda m: item(m, 1, m["value"], m["before"]))))
    zero = F.lit(-1).cast("bigint")
    far = lambda now, x: F.when(x["order"] == 0, F.greatest(now, x["end"])).otherwise(now)
    def step(state: Column, x: Column) -> Column:
        free = (x["order"] == 1) & (x["end"] > state["far"])
        one = F.array(F.struct(x["start"], x["end"], x["value"], x["before"])).cast(kind)
        return F.struct(far(state["far"], x).alias("far"), F.when(free, F.concat(state["kept"], one)).otherwise(state["kept"]).alias("kept"))

    def kept(cut: Column) -> Column:
        ends = F.transform(cut, lambda some: F.aggregate(some, zero, far))
        before = F.slice(carried(ends, zero, lambda now, v: F.greatest(now, v)), F.lit(1), F.size(cut))
        return F.flatten(F.zip_with(cut, before, lambda some, by: F.aggregate(
            some, F.struct(by.alias("far"), F.array().cast(kind).alias("kept")), step, lambda state: state["kept"])))

    return bound(blocks(walk), kept)


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits, of the characters in any window of ``window`` characters; null if there is none.

    The sum of n*log2(n) over the counts changes only by the terms of the
    character that enters and the one that leaves.
    """
    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    places = F.transform(F.slice(F.split(value, ""), 1, F.length(value)), lambda c: F.instr(F.lit(ALPHABET), c))
    # every character with the one that leaves as it enters; none (0) leaves while the first window fills
    moves = F.transform(
        F.arrays_zip(places.alias("enters"), F.slice(F.concat(F.array_repeat(F.lit(0), window), places), 1, F.length(value)).alias("leaves")),
        lambda x, i: F.struct(x["enters"].alias("enters"), x["leaves"].alias("leaves"), (i >= window - 1).alias("full")))

    def step(state: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        less = F.get(state["counts"], leaves)
        more = F.get(state["counts"], enters) - (leaves == enters).cast("int")
        total = state["sum"] + F.when(leaves > 0, term(less - 1) - term(less)).otherwise(F.lit(0.0)) + term(more + 1) - term(more)
        counts = F.transform(state["counts"], lambda n, k: F.when(
            k > 0, n + (k == enters).cast("int") - (k == leaves).cast("int")).otherwise(n))
        entropy = F.when(x["full"], F.lit(math.log2(window)) - total / window)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(state["best"], entropy).alias("best"))

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("best"))
    return F.aggregate(moves, start, step, lambda state: state["best"])


def character_class(value: Column) -> Column:
    """hex, lower (lower-case letters with digits), mixed (other letters with digits), or letters."""
    digits = value.rlike(r"[0-9]")
    return F.when(value.rlike(r"^[0-9a-fA-F]+$"), "hex").when(
        digits & value.rlike(r"[a-z]") & ~value.rlike(r"[A-Z]"), "lower").when(digits & value.rlike(r"[A-Za-z]"), "mixed").otherwise("letters")


def of_words(value: Column) -> Column:
    """Whether the letters of a run are those of words, by the share of frequent pairs."""
    letters = F.lower(F.regexp_replace(value, "[^A-Za-z]", ""))
    pairs = F.transform(F.sequence(F.lit(1), F.length(letters) - 1), lambda i: F.substr(letters, i, F.lit(2)))
    common = F.filter(pairs, lambda p: F.instr(F.lit(" ".join(WORD_PAIRS.split())), p) > 0)
    return F.when(F.length(letters) < 2, True).otherwise(F.size(common) >= WORD_SHARE * F.size(pairs))


def secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, added``, arrays of (start, rank, end, kind) in order.

    ``base`` holds the spans of the fixed patterns (an assignment's span is its
    whole match; values under six characters fail), ``added`` those of the
    entropy kind outside all base spans. Places are code points, end exclusive.
    A null or empty text has none. ``rank`` is the kind's place in KINDS.
    """
    span = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"

    def named(found: Column, kind: str) -> Column:
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(span)

    text = F.col("text")
    assigned = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE)
    found = texts(docs).select(
        "doc_id", named(assigned, "assign").alias("a"), named(matches(text, ACCESS), "access").alias("k"),
        named(matches(text, HEX), "hex").alias("h"), matches(text, CANDIDATE).alias("candidates"))
    based = found.select("doc_id", F.array_sort(F.concat("a", "k", "h")).alias("base"), "candidates")

    def hot(m: Column) -> Column:
        kind = character_class(m["value"])
        limit = F.lit(None).cast("double")
        for name, bits in LIMITS.items():
            limit = F.when(kind == name, bits).otherwise(limit)
        harmless = m["value"].rlike(HARMLESS) | m["before"].rlike(BEFORE) & ~(m["before"].rlike(IN_URL) & m["value"].rlike(KEY_PART))
        high = F.coalesce(window_entropy(m["value"], window) >= limit, F.lit(False))
        return ~harmless & high & F.when(kind.isin("letters", "lower"), ~of_words(m["value"])).otherwise(True)

    return based.withColumn("free", outside(F.col("candidates"), F.col("base"))).select(
        "doc_id", "base", named(F.filter("free", hot), "entropy").alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
