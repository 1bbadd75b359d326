"""Jaccard self-join of word n-gram sets by signature trees.

1. Documents with equal sets form a class (a digest of the set); only classes are compared.
2. Which n-grams do several classes hold, and how many? Hashes go, packed, to parts of the hash space. A class
   of which too few n-grams occur elsewhere can link with nothing and drops out, most of a corpus.
3. In the order by rarity, two linked classes share one of each one's first |A| - ceil(t|A|) + 1 n-grams.
   Classes joined by such n-grams, directly or through others, form a block.
4. In a block, signature trees find the links: a node holds the OR of its members' n-gram bitmaps and the range
   of their sizes. Two trees (or a tree and itself) are descended together; a pair of nodes goes as soon as the
   largest overlap that bitmaps and sizes allow is too small. Pairs of documents that remain are compared
   exactly, unless links found before already join them: what is asked for is components, so a group of m
   near copies costs about m comparisons.

A block larger than a tree is cut into chunks. Chunks are joined with themselves, then one representative for
each component of a chunk is treated alike, again and again: large groups are known then, though not all links. At
last, in a block of a few chunks, every class outside its largest group meets all chunks. Larger blocks aren't compared
whole: there the classes that share an n-gram of step 3 and aren't all in one group make a tree for that n-gram, so a
class comes as often as it has such n-grams, however large its block. An n-gram of more classes than a tree holds is
split by ranges of sizes and into chunks; only chunks whose sizes can link meet. Both ways find all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shared import kept, release_shuffles

#: Classes in one signature tree and hashes in it (a larger set is alone); n-gram hashes in one part of the hash space,
#: and the least number of parts.
TREE = 4096
TREE_HASHES = 4_000_000
#: Chunks of a block that still meet each other; beyond, a class would come more often than by its n-grams.
PAIRED = 8
PART_HASHES = 4_000_000
PARTS = 48
FAN = 8
BITS = 1024
#: Node pairs looked at in one step; bounds the memory of a descent.
PAIRS = 1 << 17


@dataclass(frozen=True)
class Threshold:
    """Sets link when 100 * intersection >= percent * union."""

    percent: int = 75

    def least(self, n: np.ndarray | int):
        """The least overlap of a set of n with any linked set."""
        return -(-self.percent * n // 100)

    def possible(self, overlap: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Can sets with this overlap, of n elements together, link?"""
        return (100 + self.percent) * overlap >= self.percent * n


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word k-grams of each text, end to end, and the n+1 offsets.

    Fewer than k words: the whole sequence is one element. No words: none.
    """
    data, offsets = W.packed(texts)
    data = W.lowered(data)
    starts, ends, first = W.spans(data, offsets)
    words = W.span_hashes(data, starts, ends)
    grams, n = W.window_hashes(words, k), np.diff(first)
    short = np.zeros(len(n), np.uint64)
    for j in range(1, k):
        some = np.flatnonzero(n == j)
        short[some] = W.window_hashes(words, j, seed=1000)[first[some]] if len(some) else 0
    sets, sizes = [], np.zeros(len(n) + 1, np.int64)
    for d, m in enumerate(n.tolist()):
        if m >= k:
            own = np.unique(grams[first[d] : first[d] + m - k + 1])
        else:
            own = short[d : d + min(m, 1)]
        sets.append(own)
        sizes[d + 1] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(sizes)


def _digests(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    raw = hashes.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _class_ids(digests: list[bytes | None]) -> list[int | None]:
    return [None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in digests]


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, class (null for an empty set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.wide(batch):
                hashes, offsets = shingles(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(_class_ids(_digests(hashes, offsets)), pa.int64())], names=["doc_id", "n_shingles", "class"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, class long")


def _blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _dealt(docs: DataFrame, k: int, parts: int) -> DataFrame:
    """Rows of packed hashes: for each slice and part of the hash space the classes, their counts and the top 48 bits of
    their hashes there; and a row of its own part for each slice with the sizes of its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        for batch in batches:
            for some in W.wide(batch):
                hashes, offsets = shingles(some.column("text"), k)
                ids = _class_ids(_digests(hashes, offsets))
                fresh = [d for d, c in enumerate(ids) if c is not None and not (c in seen or seen.add(c))]
                if not fresh:
                    continue
                number += 1
                cls, n = np.array([ids[d] for d in fresh], np.int64), np.diff(offsets)[fresh]
                own = np.concatenate([hashes[offsets[d] : offsets[d + 1]] for d in fresh])
                which = np.repeat(np.arange(len(fresh)), n)
                part = (own % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                own, which, part = own[order], which[order], part[order]
                cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
                rows = [(-1 - number, number, _blob(cls), _blob(n.astype(np.uint32)), b"")]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    here = which[a:b]  # sorted
                    at = np.union1d(np.flatnonzero(here[1:] != here[:-1]) + 1, np.arange(0, b - a, 65535))  # counts of 16 bits
                    rows.append((int(part[a]), number, _blob(cls[here[at]]), _blob(np.diff(at, append=b - a).astype(np.uint16)), _blob(own[a:b].view(np.uint8).reshape(-1, 8)[:, 2:])))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *[pa.binary()] * 3], strict=True)], names=["part", "slice", "cls", "cnt", "tok"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part long, slice long, cls binary, cnt binary, tok binary")


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one part: the hashes that several classes hold, with the number of these classes, back to each slice."""
    names = ["slice", "cls", "cnt", "tok", "df"]
    part = key[0].as_py()
    if part < 0:
        return pa.table({"slice": rows["slice"], "cls": rows["cls"], "cnt": rows["cnt"], "tok": pa.nulls(len(rows), pa.binary()), "df": pa.nulls(len(rows), pa.binary())})
    cls, cnt = _joined(rows["cls"], np.int64), _joined(rows["cnt"], np.uint16).astype(np.int64)
    raw = _joined(rows["tok"], np.uint8).reshape(-1, 6)
    tok = np.zeros((len(raw), 8), np.uint8)
    tok[:, 2:] = raw
    tok = tok.view(np.uint64)[:, 0] ^ np.uint64(part)  # parts may need more than the 16 bits that are free
    slices = np.repeat(rows["slice"].to_numpy(), [len(x) // 8 for x in rows["cls"].to_pylist()])
    order = np.lexsort((slices, cls))  # a class that several slices hold counts once, in its first slice
    new = np.concatenate([[True], cls[order][1:] != cls[order][:-1]])
    keep = np.zeros(len(cls), bool)
    keep[order] = slices[order] == slices[order][new][np.cumsum(new) - 1]
    of = np.repeat(np.arange(len(cls)), cnt)
    some = keep[of]
    tok, of = tok[some], of[some]
    order = np.argsort(tok, kind="stable")
    t = tok[order]
    first = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
    df = np.diff(np.flatnonzero(first), append=len(t))
    df = np.repeat(df, df)
    many = df > 1
    order, df = order[many], df[many]
    back = np.lexsort((order, slices[of[order]]))
    order, df = order[back], df[back]
    of, tok = of[order], tok[order]
    again = np.lexsort((tok, of, slices[of]))
    of, tok, df = of[again], tok[again], df[again]
    out = []
    if len(of):
        s = slices[of]
        cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = of[a:b]
            at = np.concatenate([[0], np.flatnonzero(here[1:] != here[:-1]) + 1])
            out.append((int(s[a]), _blob(cls[here[at]]), _blob(np.diff(at, append=b - a).astype(np.uint32)), _blob(tok[a:b]), _blob(df[a:b].astype(np.uint32))))
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 4], strict=True)], names=names)


def _candidates(limit: Threshold):
    """Of one slice: the classes that can link at all, their shared hashes by rarity, and which of these to join on."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = [x is None for x in rows["tok"].to_pylist()]
        sizes = rows.filter(pa.array(own))
        rows = rows.filter(pa.array([not x for x in own]))
        cls, n = _joined(sizes["cls"], np.int64), _joined(sizes["cnt"], np.uint32).astype(np.int64)
        size = dict(zip(cls.tolist(), n.tolist(), strict=True))
        of = np.repeat(_joined(rows["cls"], np.int64), _joined(rows["cnt"], np.uint32).astype(np.int64))
        tok, df = _joined(rows["tok"], np.uint64), _joined(rows["df"], np.uint32)
        order = np.lexsort((tok, df, of))
        of, tok = of[order], tok[order]
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else [0]
        out: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            c = int(of[a])
            total, common = size[c], b - a
            least = limit.least(total)
            if common < least:
                continue
            prefix = total - least + 1 - (total - common)  # hashes of no other class come first
            out.append((c, total, _blob(np.sort(tok[a:b])), tok[a : a + prefix].astype(np.int64)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], strict=True)], names=["class", "n", "tok", "prefix"])

    return run


class _Joined:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class SignatureTree:
    """Sets in order of their sizes under nodes of FAN children; a node has the OR of the bitmaps below it, the
    range of the sizes, and the most n-grams that share a bit with another of the same set."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray]):
        m = len(tokens)
        count = np.array([len(t) for t in tokens], np.int64)
        flags = np.zeros((m, BITS), bool)
        flags[np.repeat(np.arange(m), count), (W.mix(np.concatenate(tokens)) % np.uint64(BITS)).astype(np.int64)] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        extra = count - flags.sum(1)
        self.levels = [(bits, sizes, sizes, extra, count)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra, count = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at), np.maximum.reduceat(count, at)))

    def labelled(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest label below each node, by level."""
        out = [(labels, labels)]
        for _ in self.levels[1:]:
            low, high = out[-1]
            at = np.arange(0, len(low), FAN)
            out.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        return out

    def descend(self, limit: Threshold, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of sets i < j that the bounds leave, and the largest overlap that each may have, some at a time.

        Nodes whose members all have one label aren't compared with each other."""
        named = self.labelled(labels)
        kids = np.arange(FAN)
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            depth, x, y = todo.pop()
            if len(x) > PAIRS:
                todo += [(depth, x[PAIRS:], y[PAIRS:]), (depth, x[:PAIRS], y[:PAIRS])]
                continue
            bits, low, high, extra, count = self.levels[depth]
            first, last = named[depth]
            keep = (first[x] != last[x]) | (first[y] != last[y]) | (first[x] != first[y])
            keep &= (100 * high[x] >= limit.percent * low[y]) & (100 * high[y] >= limit.percent * low[x])
            x, y = x[keep], y[keep]
            most = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(extra[x], extra[y])
            most = np.minimum(most, np.minimum(count[x], count[y]))
            keep = limit.possible(most, low[x] + low[y])
            x, y, most = x[keep], y[keep], most[keep]
            if depth == 0:
                keep = x < y
                yield x[keep], y[keep], most[keep]
            elif len(x):
                below = len(self.levels[depth - 1][1])
                x, y = (x[:, None, None] * FAN + kids[:, None] + 0 * kids).ravel(), (y[:, None, None] * FAN + kids + 0 * kids[:, None]).ravel()
                ok = (x <= y) & (y < below)
                todo.append((depth - 1, x[ok], y[ok]))


def tree_links(sizes: np.ndarray, tokens: list[np.ndarray], group: np.ndarray, outside: np.ndarray | None, limit: Threshold) -> list[tuple[int, int]]:
    """Links (numbers of sets) that join sets not yet in one group; enough of them for the same components as all links.

    outside: if given, only pairs of an outside and an inside set are compared.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, group, tokens = sizes[order], group[order], [tokens[i] for i in order]
    side = None if outside is None else outside[order]
    first: dict[int, int] = {}
    joined = _Joined(len(sizes))
    for a, g in enumerate(group.tolist()):
        joined.join(a, first.setdefault(g, a))
    links = []

    def compare(a: int, b: int) -> None:
        if joined.find(a) == joined.find(b):
            return
        overlap = len(np.intersect1d(tokens[a], tokens[b], assume_unique=True))
        if 100 * overlap >= limit.percent * (int(sizes[a]) + int(sizes[b]) - overlap):
            joined.join(a, b)
            links.append((int(order[a]), int(order[b])))

    if len(sizes) <= FAN:  # a leaf: nothing to prune
        for a in range(len(sizes)):
            for b in range(a + 1, len(sizes)):
                if (side is None or side[a] != side[b]) and limit.percent * int(sizes[b]) <= 100 * int(sizes[a]):
                    compare(a, b)
        return links
    tree = SignatureTree(sizes, tokens)
    step = 1
    while step < len(sizes) and side is None:  # sets of like sizes first: near copies join before the trees are descended
        for a in range(len(sizes) - step):
            if limit.percent * int(sizes[a + step]) <= 100 * int(sizes[a]):
                compare(a, a + step)
        step *= 4
    for i, j, most in tree.descend(limit, np.array([joined.find(a) for a in range(len(sizes))])):
        if side is not None:
            some = side[i] != side[j]
            i, j, most = i[some], j[some], most[some]
        some = limit.possible(most, sizes[i] + sizes[j])
        i, j, most = i[some], j[some], most[some]
        for at in np.argsort(-most, kind="stable").tolist():
            compare(int(i[at]), int(j[at]))
    return links


def _join_units(sets: DataFrame, limit: Threshold) -> DataFrame:
    """Links (u, v) within each unit, as stars: each set that links join to others, and the least class of these.
    sets: unit, class, n, tok, grp, outside (null or boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in W.grouped(batches, "unit"):
            if len(unit) < 2:
                continue
            cls = unit["class"].to_numpy()
            outside = None if unit["outside"].null_count else unit["outside"].to_numpy(zero_copy_only=False).astype(bool)
            links = tree_links(unit["n"].to_numpy(), [np.frombuffer(t, np.uint64) for t in unit["tok"].to_pylist()], unit["grp"].to_numpy(), outside, limit)
            if links:
                by_class = np.argsort(cls, kind="stable")  # the least number of a union is its least class
                place = np.empty(len(cls), np.int64)
                place[by_class] = np.arange(len(cls))
                joined = _Joined(len(cls))
                for a, b in links:
                    joined.join(int(place[a]), int(place[b]))
                own = np.array(sorted({int(place[x]) for link in links for x in link}))
                root = np.array([joined.find(int(x)) for x in own])
                u, v = cls[by_class[own]], cls[by_class[root]]
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    columns = ["unit", "class", "n", "tok", "grp", "outside"]
    return sets.select(*columns).repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u long, v long")


def _trees(count: str, hashes: str):
    """How many trees so many classes with so many hashes need."""
    return F.greatest(F.ceil(F.col(count) / TREE), F.ceil(F.col(hashes) / TREE_HASHES))


def _chunked(blocks: DataFrame, seed: int) -> DataFrame:
    """blocks (class, n, block, ...) with chunks (their number) and chunk: hashed, about a tree each."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("in_block"), F.sum("n").alias("hashes")).select("block", _trees("in_block", "hashes").alias("chunks"))
    return blocks.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(seed)), F.col("chunks")))


def _paired_units(every: DataFrame) -> DataFrame:
    """unit, class, grp, outside: chunks of the classes outside their block's largest group, with all chunks of the block.
    every: block, class, n, grp, chunk."""
    main = every.groupBy("block", "grp").count().groupBy("block").agg(F.max_by("grp", F.struct("count", "grp")).alias("main"))
    outside = every.join(main, "block").where("grp <> main").select("class", "n", "block", "grp")
    some = kept(_chunked(outside, 101).select("class", "block", "grp", F.col("chunk").alias("a")))
    every = every.select("class", "block", "grp", F.col("chunk").alias("b"))
    pairs = kept(some.select("block", "a").distinct().join(every.select("block", "b").distinct(), "block"))
    unit = F.xxhash64("block", "a", "b", F.lit(7)).alias("unit")
    left = some.join(pairs, ["block", "a"]).select(unit, "class", "grp", F.lit(True).alias("outside"))
    right = every.join(pairs, ["block", "b"]).select(unit, "class", "grp", F.lit(False).alias("outside"))
    return left.unionByName(right)


def _gram_units(held: DataFrame, limit: Threshold) -> DataFrame:
    """unit, class, grp, outside of the classes that have to meet. held: gram, class, n, grp."""
    grams = held.groupBy("gram").agg(F.count("*").alias("in_gram"), F.sum("n").alias("hashes"), F.min("grp").alias("a"), F.max("grp").alias("b")).where("a <> b")
    mixed = held.join(grams.select("gram", (_trees("in_gram", "hashes") > 1).alias("hot")), "gram")
    few = mixed.where("not hot").select(F.xxhash64("gram", F.lit(7)).alias("unit"), "class", "grp", F.lit(None).cast("boolean").alias("outside"))
    # sizes of linked sets lie in one band or in two neighbouring ones; a little wider, so that rounding does no harm
    band = F.floor(F.log("n") / F.log(F.lit(101.0 / limit.percent))).cast("int")
    hot = mixed.where("hot").drop("hot").withColumn("band", band)
    bands = hot.groupBy("gram", "band").agg(F.count("*").alias("in_band"), F.sum("n").alias("hashes")).select("gram", "band", _trees("in_band", "hashes").alias("chunks"))
    hot = hot.join(bands, ["gram", "band"]).withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(9)), F.col("chunks")))
    cells = bands.select("gram", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    other = cells.select("gram", F.col("band").alias("band2"), F.col("chunk").alias("chunk2"))
    pairs = cells.join(other, "gram").where("band2 = band + 1 or (band2 = band and chunk2 >= chunk)").withColumn("unit", F.xxhash64("gram", "band", "chunk", "band2", "chunk2"))
    alone = (F.col("band") == F.col("band2")) & (F.col("chunk") == F.col("chunk2"))
    left = hot.join(pairs, ["gram", "band", "chunk"]).select("unit", "class", "grp", F.when(~alone, True).alias("outside"))
    right = hot.join(pairs.where(~alone).select("gram", F.col("band2").alias("band"), F.col("chunk2").alias("chunk"), "unit"), ["gram", "band", "chunk"]).select("unit", "class", "grp", F.lit(False).alias("outside"))
    return few.unionByName(left).unionByName(right)


def block_components(sets: DataFrame, blocks: DataFrame, held: DataFrame, limit: Threshold) -> DataFrame:
    """(class, component) of the classes that links join to others. sets: class, n, tok; blocks: class, block; held: class,
    gram (the n-grams that a class is joined on)."""
    unset = F.lit(None).cast("boolean").alias("outside")
    chunked = kept(_chunked(blocks.join(sets.select("class", "n"), "class"), 0))
    units = chunked.select("class", F.xxhash64("block", "chunk").alias("unit"), F.col("class").alias("grp"), unset)
    links = kept(_join_units(sets.join(units, "class"), limit))
    large = kept(chunked.where("chunks > 1").select("class", "n", "block"))
    before = large.count()
    if not before:  # every block is one tree, and its stars are its components
        return links.select(F.col("u").alias("class"), F.col("v").alias("component"))
    seed, members = 0, before
    while True:  # representatives of the components, until they no longer get fewer
        seed += 1
        group = kept(large.join(components(links).withColumnRenamed("id", "class"), "class", "left").select("class", "n", "block", F.coalesce("component", "class").alias("grp")))
        ones = group.groupBy("block", "grp").agg(F.min_by("n", "class").alias("n"), F.min("class").alias("class"))
        n = ones.count()
        if n > 0.9 * members or n <= large.select("block").distinct().count():
            break
        members = n
        units = _chunked(ones, seed).select("class", F.xxhash64("block", "chunk").alias("unit"), "grp", unset)
        links = kept(links.union(_join_units(sets.join(units, "class"), limit)))
    sizes = _chunked(group, 102)
    few = sizes.where(F.col("chunks") <= PAIRED)
    units = _paired_units(kept(few.drop("chunks")))
    if sizes.where(F.col("chunks") > PAIRED).limit(1).count():
        many = sizes.where(F.col("chunks") > PAIRED).select("class", "n", "grp")
        units = units.unionByName(_gram_units(kept(held.join(many, "class").select("gram", "class", "n", "grp")), limit))
    links = kept(links.union(_join_units(sets.join(units, "class"), limit)))
    return components(links).select(F.col("id").alias("class"), "component")


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id that links reach, itself included.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct word k-grams
    (A-Z lower-cased; fewer than k words: the whole sequence as one). Null, empty and wordless texts have
    n_shingles 0 and link with nothing. Equal texts, and rows repeated with the same doc_id, link. Very long
    texts are one set each, held whole. An empty table gives an empty result; further columns of docs are
    ignored. docs is read three times and has to be a stored table (the same rows each time).

    N-grams go by 48 bits of a hash and its part of the hash space, which holds about PART_HASHES: one in some 140 million
    equals another by chance, whatever the size of docs. Classes go by 64 bits of a digest of theirs.
    """
    limit = Threshold(percent)
    own = kept(sets_of(docs, k))
    total = own.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(PARTS, -(-total // PART_HASHES))
    shared = _dealt(docs, k, parts).groupBy("part").applyInArrow(_shared, "slice long, cls binary, cnt binary, tok binary, df binary")
    sets = kept(shared.groupBy("slice").applyInArrow(_candidates(limit), "class long, n long, tok binary, prefix array<long>"))
    del shared
    release_shuffles(docs.sparkSession)  # those of the hashes are larger than docs and not read again
    held = sets.select("class", F.explode("prefix").alias("gram"))
    least = held.groupBy("gram").agg(F.min("class").alias("v"), F.count("*").alias("times")).where("times > 1")
    edges = held.join(least, "gram").where("class <> v").select(F.col("class").alias("u"), "v").distinct()
    blocks = kept(components(edges).select(F.col("id").alias("class"), F.col("component").alias("block")))
    joined = block_components(sets.select("class", "n", "tok"), blocks, held, limit)
    ids = own.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    ids = ids.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ids.join(named, "component").select("class", "component_id")
    # a class may hold a third of all rows: the narrow table on the other side is unique in the key
    return own.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The documents, with their own columns, one of each component: the one with the component's doc_id.

    Null, empty and wordless texts stay, and so do rows without a doc_id. Where doc_ids repeat, rows that repeat a text too
    are one document. Very long texts are compared whole; an empty table gives an empty result. Columns of any names go
    through, but for _stay and _same, which must not be there.
    """
    found = kept(ngram_jaccard(docs.select("doc_id", "text"), k, percent))
    release_shuffles(docs.sparkSession)  # before the texts are shuffled
    stay = found.where("doc_id = component_id or n_shingles = 0").select(F.col("doc_id").alias("_stay"))
    rows = docs.join(stay.distinct(), F.col("doc_id") == F.col("_stay"), "left_semi")
    n, ids = found.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n > ids:  # narrow rows tell; only then are texts compared
        rows = rows.withColumn("_same", F.xxhash64("text")).dropDuplicates(["doc_id", "_same"]).drop("_same")
    return rows.unionByName(docs.where("doc_id is null"))
