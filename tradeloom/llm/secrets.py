"""Secret scan by patterns and by sliding-window Shannon entropy, in DataFrame functions alone.

Patterns find assignments, access keys and long hexadecimal runs: the base spans. They are then blanked out of the text,
and every run of hexadecimal or base-64 characters left is a candidate: a window slides over it, the counts of its
characters change by one leaving and one entering, and with them the sum of c * log2(c), from which the window's entropy
follows at once. A candidate whose best window reaches the limit of its class is a secret, unless the allow list names it.

Spans are code points, end exclusive. Nothing here costs more than n * log(n) for a text of n characters: places are
running sums taken in steps of doubling width, texts are put together from blocks, and no pattern repeats a group by
recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"


@dataclass(frozen=True)
class EntropyClass:
    """A class of characters: its candidates' pattern, the window's width (63 at most) and the bits that its best window needs."""

    kind: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}", 24, 2.8),
    EntropyClass("entropy_base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}", 24, 3.9),
)

#: Candidates that are no secrets: without a digit or without a letter; UUIDs; words or short numbers joined by
#: one of `/_-=`; dates with times; samples that say so in a part of their own (unless another part is a longer run than a
#: window: 25 letters and digits, with a digit) or at their end.
ALLOWED = (
    r"^[^0-9]*+$",
    r"^[^A-Za-z]*+$",
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"^[/_=-]*+(?:(?:[A-Za-z]++|[0-9]{1,4}+)(?:[/_=-]++|$))++$",
    r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9-]++Z?$",
    r"(?i)^(?!.*?(?<![A-Z0-9])(?=[A-Z]*+[0-9])[A-Z0-9]{25}).*?(?:^|[/_=-])(?:example|sample|placeholder|x{6,}|1234567890?)(?:[/_=-]|$)",
    r"EXAMPLE(?:KEY)?$",
)
#: Kinds in their order for equal starts.
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))

#: Code points in a block of a text that is put together again.
BLOCK = 1024
_PLACES = "array<struct<start:int,end:int,match:string>>"
_KINDS = "array<struct<start:int,kind:int,end:int>>"
#: The counts of a window: six bits each, ten in a number, for the codes 0 to 127.
_BITS, _FIELDS, _NUMBERS = 6, 10, 13


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """At each place of an array the total, by an associative ``add``, of the values up to there.

    Each round adds what stands 1, 2, 4, ... places before: log2(n) rounds of n additions.
    """
    rounds = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda back: back < F.size(values))
    return F.aggregate(rounds, values, lambda acc, back: F.transform(acc, lambda x, i: F.when(i >= back, add(x, F.get(acc, i - back))).otherwise(x)))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the matches from left to right; the lengths between them give the places."""

    def places(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        lengths = F.zip_with(gaps, found, lambda gap, match: F.length(gap) + F.length(match))
        ends = _let(lengths, lambda x: _running(x, lambda a, b: a + b))
        return F.zip_with(found, ends, lambda match, end: F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match")))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)).otherwise(F.array().cast(_PLACES))


def _of_kind(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _replaced(text: Column, spans: Column, put: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with put(start, end, reach) in the place of each span; reach is the greatest end before it.

    spans come by start and may overlap. The text is cut into blocks once, so a piece costs its own length and a block.
    """

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")

        def part(k: Column) -> Column:
            low = F.greatest(a - k * BLOCK, F.lit(0))
            return F.substring(F.get(blocks, k), low + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - low)

        return F.when(a < b, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

    def built(blocks: Column) -> Column:
        def with_reach(reach: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            pieces = F.transform(spans, lambda x, i: F.concat(piece(blocks, before(i), x["start"]), put(x["start"], x["end"], before(i))))
            return F.concat(F.array_join(pieces, ""), piece(blocks, F.array_max(reach), F.length(text)))

        return _let(_let(F.transform(spans, lambda x: x["end"]), lambda ends: _running(ends, F.greatest)), with_reach)

    return F.when(F.size(spans) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), built)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in the place of the spans: all other places stay."""
    return _replaced(text, spans, lambda start, end, reach: F.repeat(F.lit(" "), F.greatest(end - F.greatest(start, reach), F.lit(0))))


def window_entropy(text: Column, window: int, enough: float = 99.0) -> Column:
    """The largest Shannon entropy (bits) of any ``window`` characters in a row; of all, if there are fewer.

    The search ends at the first window with ``enough`` bits. A step takes one character out and one in: it changes
    two counts, and the sum of c * log2(c) by the terms of these. Characters beyond ASCII count as one. window: 63 at most.
    """

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def changed(state: Column, code: Column, by: int) -> Column:
        number, bits = F.floor(code / _FIELDS).cast("int"), F.lit(_BITS) * (code % _FIELDS)
        had = F.call_function("shiftright", F.get(state["n"], number), bits).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))
        one = F.call_function("shiftleft", F.lit(by).cast("long"), bits)
        counts = F.transform(state["n"], lambda v, k: F.when(k == number, v + one).otherwise(v))
        return F.struct(counts.alias("n"), (state["s"] + term(had + by) - term(had)).alias("s"), state["best"].alias("best"))

    size = F.least(F.length(text), F.lit(window))
    zero = F.lit(0.0).cast("double")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), _NUMBERS).alias("n"), zero.alias("s"), zero.alias("best"))

    def best_of(codes: Column, size: Column) -> Column:
        steps = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(codes, i - window)).alias("old"), (i + 1 >= size).alias("full")))

        def step(acc: Column, x: Column) -> Column:
            without = F.when(x["old"].isNotNull(), changed(acc, x["old"], -1)).otherwise(acc)
            now = _let(without, lambda s: changed(s, x["new"], 1))
            best = lambda s: F.when(x["full"], F.greatest(s["best"], F.log2(size) - s["s"] / size)).otherwise(s["best"])
            return F.when(acc["best"] >= enough, acc).otherwise(_let(now, lambda s: F.struct(s["n"].alias("n"), s["s"].alias("s"), best(s).alias("best"))))

        return F.aggregate(steps, start, step, lambda acc: acc["best"])

    codes = F.transform(F.split(text, ""), lambda c: F.least(F.ascii(c), F.lit(127)))
    return F.when(F.length(text) > 0, _let(codes, lambda c: _let(size, lambda n: best_of(c, n)))).otherwise(F.lit(0.0))


def _secret(c: EntropyClass):
    def test(x: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | x["match"].rlike(pattern)
        few = F.log2(F.size(F.array_distinct(F.split(x["match"], "")))) < c.bits  # no window can have more bits than that
        return F.when(allowed | few, False).otherwise(window_entropy(x["match"], c.window, c.bits) >= c.bits)

    return test


def scan(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """docs and the columns _text (null: empty), _base and _added: arrays of (start, kind, end) in order, kind numbering KINDS.

    What base spans, or spans of a class before, leave of a run of characters is a candidate of its own.
    """
    df = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("_text")
    value = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2))
    df = df.withColumn("_assign", _of_kind(F.filter(_matches(text, ASSIGN), lambda x: value(x) >= 8), 0))
    df = df.withColumn("_access", _of_kind(_matches(text, ACCESS), 1)).withColumn("_hex", _of_kind(_matches(text, HEX), 2))
    df = df.withColumn("_base", F.sort_array(F.concat("_assign", "_access", "_hex"))).drop("_assign", "_access", "_hex")
    df = df.withColumn("_left", _blanked(text, F.col("_base"))).withColumn("_added", F.array().cast(_KINDS))
    for number, c in enumerate(classes):
        df = df.withColumn("_new", _of_kind(F.filter(_matches(F.col("_left"), c.pattern), _secret(c)), 3 + number))
        if number + 1 < len(classes):
            df = df.withColumn("_left", _blanked(F.col("_left"), F.col("_new")))
        df = df.withColumn("_added", F.sort_array(F.concat("_added", "_new")))
    return df.drop("_new", "_left")


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row.

    Base spans are whole matches of the three patterns, from left to right without overlap for each kind, that are
    long enough (an assignment by its value). spans: base and entropy spans as kind:start:end, by start, then
    kind. Null and empty texts have none (an empty string, and its hash). Very long texts are searched whole;
    repeated rows get equal results; an empty table gives an empty result; further columns of docs are ignored.
    """
    df = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long")
    return df.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_entropy"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by the mark (overlapping spans by one); n_chars, if there, follows the text.

    A null text stays null, an empty one empty; texts are searched and rewritten whole, whatever their length; repeated
    rows get equal results; an empty table gives an empty result. Other columns go through, whatever their names, but
    for _text, _base, _added, _assign, _access, _hex, _left, _new and _clean, which must not be there.
    """
    df = scan(docs).withColumn("_base", F.sort_array(F.concat("_base", "_added")))
    df = df.withColumn("_clean", _replaced(F.col("_text"), F.col("_base"), lambda start, end, reach: F.when(start >= reach, F.lit(mark)).otherwise("")))
    some = F.size("_base") > 0
    columns = []
    for f in docs.schema.fields:
        c = F.col(f.name)
        if f.name == "text":
            c = F.when(some, F.col("_clean")).otherwise(c).alias("text")
        elif f.name == "n_chars":
            c = F.when(some, F.length("_clean").cast(f.dataType)).otherwise(c).alias("n_chars")
        columns.append(c)
    return df.select(*columns)
