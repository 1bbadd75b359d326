"""Filter interaction audit: what each of five filters removes, in every order of them, and its Shapley value.

A filter condition depends on a document alone (duplicates: on the table), never on what other filters removed. So one
number per coalition of filters, the documents that at least one of its members fails, says everything about every
order. The 32 coalitions are tabulated once per part; differences of two of them are the steps of an order, and the
Shapley values are the solution of kernel-weighted least squares over all coalitions (Lundberg and Lee, 2017; Charnes et
al., 1988), constrained to add up to what all filters remove, solved in rational numbers.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Limits of the conditions.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
_DUPLICATE = 1 << FILTERS.index("E")


def own_failures(text: Column) -> list[Column]:
    """Conditions A to D, which need only the text itself."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < LEAST_WORDS, distinct * 100 < n * LEAST_DISTINCT, capitals * 100 > F.length(text) * MOST_CAPITALS, text.rlike("[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per source and set of failed filters (bit i: the i-th of FILTERS).

    Texts leave the scan as a digest and four bits. Copies of a text are told by its SHA-256; within a text and source
    they are pre-aggregated before the digests meet, so a text that a third of the documents share is a few rows. Rows
    without a doc_id meet no label, are dealt out by their place and have no smaller or larger doc_id: E spares them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own_failures(text))), F.lit(0))
    nowhere = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    rows = docs.select("doc_id", nowhere.alias("place"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("doc_id", "place", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("place", F.lit(-1).cast("long"))
    false = F.lit(False)
    rows = rows.join(marks, ["doc_id", "place"], "left").withColumns({"good": F.coalesce("good", false), "toxic": F.coalesce("toxic", false)})
    known = F.col("doc_id").isNotNull()
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    least = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    texts = texts.join(least, "digest")
    copies = F.col("known") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + _DUPLICATE).alias("mask"), F.col("copies").alias("n"))))
    cells = texts.withColumn("copies", copies).select("part", "good", "toxic", split.alias("x")).select("part", "x.mask", "x.n", F.when(F.col("good"), F.col("x.n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("x.n")).otherwise(0).alias("toxic"))
    return cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def shapley_solution(n: int) -> tuple[list[list[int]], list[int], int]:
    """(rows, last, denominator) of the constrained least squares for n players.

    With b_j, the sum over the proper coalitions that hold j of kernel times value, and v, the value of all: player i gets
    (rows[i] . b + last[i] * v) / denominator. Kernels of a coalition of s players: (n - 1) / (comb(n, s) * s * (n - s)).
    The normal equations with the multiplier of the efficiency constraint are inverted exactly, by elimination.
    """
    kernel = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    pairs = [[sum(kernel[bin(m).count("1")] for m in range(1, 2**n - 1) if m >> i & 1 and m >> j & 1) for j in range(n)] for i in range(n)]
    size = n + 1
    square = [[*pairs[i], Fraction(1)] for i in range(n)] + [[Fraction(1)] * n + [Fraction(0)]]
    both = [row + [Fraction(int(i == j)) for j in range(size)] for i, row in enumerate(square)]
    for i in range(size):
        pivot = next(r for r in range(i, size) if both[r][i] != 0)
        both[i], both[pivot] = both[pivot], both[i]
        both[i] = [x / both[i][i] for x in both[i]]
        for r in range(size):
            if r != i and both[r][i]:
                both[r] = [x - both[r][i] * y for x, y in zip(both[r], both[i], strict=True)]
    inverse = [row[size:] for row in both]
    whole = lcm(*(x.denominator for row in inverse for x in row))
    return [[int(x * whole) for x in row[:n]] for row in inverse[:n]], [int(row[n] * whole) for row in inverse[:n]], whole


def audit(table: DataFrame, names: str = FILTERS) -> DataFrame:
    """Rows of all orders and steps from (part, mask, n, good, toxic): see filter_interactions()."""
    n, full = len(names), 2 ** len(names) - 1
    hit = lambda c: F.sum(F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col(c)).otherwise(0)).alias(c)
    cells = table.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(full))))
    unique = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only{i}") for i in range(n)]
    coalitions = cells.groupBy("part", "coalition").agg(hit("n"), hit("good"), hit("toxic"), F.sum("n").alias("all"), *unique)
    parts = coalitions.groupBy("part").agg(F.max("all").alias("all"), F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic"))).alias("t"), *(F.max(f"only{i}").alias(f"only{i}") for i in range(n)))
    # the weighted sums, as whole numbers of 1/scale, and the solution times n!, the sum over all orders
    kernel = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    scale = lcm(*(k.denominator for k in kernel.values()))
    value = lambda m, c="n": F.element_at("t", m + 1)[c]
    weighted = {f"b{i}": sum((value(F.lit(m)) * int(kernel[bin(m).count("1")] * scale) for m in range(1, full) if m >> i & 1), F.lit(0)) for i in range(n)}
    rows, last, whole = shapley_solution(n)
    solved = [(sum((F.col(f"b{j}") * rows[i][j] for j in range(n)), F.lit(0)) + value(F.lit(full)) * (last[i] * scale)) * factorial(n) for i in range(n)]
    parts = parts.withColumns(weighted).withColumns({f"s{i}": x for i, x in enumerate(solved)})
    parts = parts.withColumn("of", F.array(*(F.struct(F.col(f"only{i}").alias("unique"), F.expr(f"s{i} div {whole * scale}").alias("shapley")) for i in range(n))))
    steps = [(order, k, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    literal = F.array(*(F.struct(F.lit("".join(names[i] for i in o)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(before).alias("before"), F.lit(f).alias("f")) for o, k, before, f in steps))
    s = parts.select("part", "all", "t", "of", F.explode(literal).alias("s")).select("part", "all", "t", "of", "s.*", F.expr("before | shiftleft(1, f)").alias("after"), F.expr("shiftleft(1, f)").alias("bit"))
    gain = lambda c: value(F.col("after"), c) - value(F.col("before"), c)
    own = F.element_at("of", F.col("f") + 1)
    return s.select(
        "part", "filter_order", "step", (F.col("all") - value(F.col("after"))).alias("kept"), gain("n").alias("removed"), (value(F.col("bit")) - gain("n")).alias("redundant"),
        own["unique"].alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), own["shapley"].alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every step of all 120 orders of five filters, per source: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley (all long but the first three).

    A document fails A under 200 words, B with fewer distinct words than half of its words, C with more than 2 % capitals
    A-Z among its code points, D with one of #$%&*|, E if a row with a smaller doc_id has the same text. A null text is an
    empty one (it fails A, and E after another); a null source is the part ''. Of repeated rows with one doc_id and text
    none is a copy of another. Several labels of one doc_id count if one of them says so; labels of no document count
    nothing. shapley is the sum of the filter's removals over all orders. An empty table has no parts and gives no rows.
    Texts are read whole; only the columns doc_id, text and source of docs are used.
    """
    return audit(failures(docs, labels))
