"""Clustering around centroids; each vector finds its nearest centroid by the threshold algorithm (Fagin et al., 2001).

Every dimension has the list of centroids sorted by their value there. A vector walks all lists outward from its own
value, one centroid of each list at a time; a centroid met for the first time gets its exact distance. What no list has
shown yet is in each dimension at least as far as the last centroid met there, so once the sum of these squared frontier
gaps strictly exceeds the best exact distance, no unseen centroid can win or tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: Components below this go through 64-bit arithmetic (64 squared gaps fit), larger ones through whole numbers of any size.
SMALL = 1 << 26
#: Components have to fit 64 bits.
_LARGEST = float(1 << 62)
_LONG = (1 << 63) - 1


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest row of c for each row of x; of equal distances the smaller number."""
    if max((int(np.abs(a).max()) if a.size else 0) for a in (x, c)) >= SMALL:
        x, c, far, kind = x.astype(object), c.astype(object), 1 << 200, object
    else:
        x, c, far, kind = x.astype(np.int64), c.astype(np.int64), _LONG, np.int64
    (n, width), k = x.shape, len(c)
    order = np.argsort(c, axis=0, kind="stable")
    value = np.take_along_axis(c, order, axis=0)
    right = np.empty((n, width), np.int64)
    for j in range(width):
        right[:, j] = np.searchsorted(value[:, j], x[:, j])
    left = right - 1
    best, number = np.empty(n, kind), np.zeros(n, np.int64)
    row, exact = np.arange(n), np.full((n, k), far, kind)
    seen, lists = np.zeros((n, k), bool), np.arange(width)
    while len(row):
        gap_left = np.where(left >= 0, x - value[np.maximum(left, 0), lists], far)
        gap_right = np.where(right < k, value[np.minimum(right, k - 1), lists] - x, far)
        to_left = gap_left <= gap_right
        at = np.where(to_left, left, right)
        left, right = left - to_left, right + ~to_left
        met = np.zeros_like(seen)
        met[np.repeat(np.arange(len(row)), width), order[at, lists].ravel()] = True
        vector, centroid = np.nonzero(met & ~seen)
        gaps = x[vector] - c[centroid]
        exact[vector, centroid] = (gaps * gaps).sum(1)
        seen |= met
        frontier = np.minimum(gap_left, gap_right)
        nearest_, found = exact.argmin(1), exact.min(1)
        done = ((frontier * frontier).sum(1) > found) | seen.all(1)
        best[row[done]], number[row[done]] = found[done], nearest_[done]
        go = ~done
        row, x, exact, seen, left, right = row[go], x[go], exact[go], seen[go], left[go], right[go]
    return number, best


def vectors(df: DataFrame, dimensions: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, q): vectors with exactly so many components, none null or non-finite, as whole numbers floor(scale * x)."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < _LARGEST)
    some = df.where((F.size("embedding") == dimensions) & F.forall("embedding", fits))
    return some.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _first(rows: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors with the least hashes of `1:<vec_id>`; ids that are null come last, equal ids by their components."""
    hashed = rows.select("q", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"))
    return [list(r.q) for r in hashed.orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()]


def _moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round. Each task sends one row of sums per cluster and dimension; the driver gets their totals."""
    c, width = np.array(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(c), np.int64), np.zeros((len(c), width), object)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, width)
                number, _ = nearest(x, c)
                for k in np.unique(number):
                    some = x[number == k]
                    n[k] += len(some)
                    sums[k] += some.sum(0) if np.abs(some).max() < SMALL else some.astype(object).sum(0)
        held = np.flatnonzero(n)
        if len(held):
            total = pa.array([str(s) for s in sums[held].ravel()]).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, width)), pa.array(np.tile(np.arange(width), len(held))), pa.array(np.repeat(n[held], width)), total], names=["k", "j", "n", "total"])

    found = rows.select("q").mapInArrow(run, "k long, j long, n long, total decimal(38,0)").groupBy("k", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [list(x) for x in centroids]
    for r in found.collect():
        out[r.k][r.j] = int(r.total) // r.n
    return out


def cluster_vectors(df: DataFrame, clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Kept are vectors of exactly ``dimensions`` components, none null, NaN or infinite (nor of 2**62 / scale and more: such a
    one has no 64-bit whole number). Centroids start as the kept vectors with the least hashes; ``rounds`` times every
    vector goes to the nearest centroid and every non-empty centroid to the exact floor of its vectors' means; then vectors
    are assigned once more. Equal distances go to the smaller number. With fewer vectors than ``clusters``, each starts one.
    Repeated rows count as often as they come; a null vec_id stays. distance is null where it or a sum doesn't fit 64 bits.
    An empty table gives no rows. Columns other than vec_id and embedding aren't read.

    A round is a pass over the vectors; whatever their number and wherever they crowd, a task sends clusters x dimensions
    sums. The assigned ids and distances are written to the checkpoint folder, since inertias and rows both need them.
    """
    rows = vectors(df, dimensions, scale)
    centroids = _first(rows, clusters)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).where("false")
    for _ in range(rounds):
        centroids = _moved(rows, centroids)
    c = np.array(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(_rows(batch, dimensions), c)
                some = pa.array([int(d) if d <= _LONG else None for d in distance], pa.int64()) if distance.dtype == object else pa.array(distance)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), some], names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    assigned = kept(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"))
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}
    long = lambda v: F.lit(int(v) if v is not None and abs(v) <= _LONG else None).cast("long")
    whole = None if any(v is None for v in sums.values()) else sum(sums.values())
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    digests = [F.lit(hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for x in centroids]
    return assigned.select("vec_id", "cluster", "distance", of([long(sums.get(k, 0)) for k in range(len(centroids))]).alias("cluster_inertia"), long(whole).alias("inertia"), of(digests).alias("centroid_sha256"))
