"""Nearest neighbours by cosine: inverted lists scanned with adaptive dimensions.

Vectors are scaled to unit length and turned by a random rotation, after which the first d of D
coordinates are a fair sample of a distance.  A scan of a list reads them in column blocks: after
each block a hypothesis test compares the distance so far, scaled up to all D coordinates, with the
distance of the k-th best found, and candidates that are surely farther are left.  What remains
gets its exact cosine from the original vectors.

Lists are found by k-means on a bounded sample; every row is indexed.  How many lists are probed is
fitted on the same sample, as the number that holds ``recall`` of its exact neighbours.  A first
pass scans the nearest list of each query, a second one all others, with the bound of the first.
Lists are cut into chunks of rows, and the queries of a list into blocks, so no task holds a whole
list, however many copies of one vector there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: Rows of the sample on which lists and probes are fitted (or 20 for each list), the most lists, rows of a chunk and queries of a block.
#: Lists grow with the root of the rows, up to 67 million rows; beyond that each list grows.
SAMPLE, LISTS, CHUNK, BLOCK = 20_000, 4096, 4096, 16_384
COLUMNS = 16  # coordinates in a column block
SLACK = 1e-9  # of squared distances, for rounding
FOUND = "query_id bigint, vec_id bigint, score double"


def matrix(column, dim: int) -> np.ndarray:
    """A column of equally long arrays as doubles."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(array.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosines of paired rows, each from its two rows alone, so that equal vectors give equal values."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest_lists(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=k)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, all_lists: bool = False) -> np.ndarray:
    """For each row the nearest list, or all lists, nearest first."""
    out = []
    for lo in range(0, len(x), 4096):
        d = (centres * centres).sum(axis=1) - 2 * x[lo : lo + 4096] @ centres.T
        out.append(np.argsort(d, axis=1, kind="stable") if all_lists else d.argmin(axis=1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, 1), np.int64)


def n_lists(n_rows: int, lists: int = LISTS) -> int:
    return min(lists, max(1, math.isqrt(n_rows) // 2))


def fit_index(sample: np.ndarray, n_rows: int, k: int, recall: float, lists: int = LISTS) -> tuple[np.ndarray, int]:
    """Centres of the lists and the number of lists to probe."""
    count = min(n_lists(n_rows, lists), max(1, len(sample) // 20))
    x = unit(sample)
    centres = kmeans(x, count)
    if count == 1:
        return centres, 1
    queries = x[np.random.default_rng(1).choice(len(x), min(400, len(x)), replace=False)]
    near = np.argsort(-(queries @ x.T), axis=1)[:, 1 : k + 1]
    home = nearest_lists(x, centres)[:, 0]
    place = np.argsort(nearest_lists(queries, centres, True), axis=1)  # of each list in a query's order
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return centres, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def scan(base_ids, base, base_raw, query_ids, queries, query_raw, bound, k, confidence=2.1, rows=1024, at_once=512):
    """The k nearest of ``base`` for each query, those surely beyond ``bound`` (squared distance) left out.

    base and queries are unit and rotated, the raw ones are the original vectors.  Returns arrays
    (query position, vec_id, score), nearest first, ties to the smaller vec_id.
    """
    dim = base.shape[1]
    out_q, out_id, out_score = [], [], []
    for q0 in range(0, len(queries), at_once):
        q, ids, raw = queries[q0 : q0 + at_once], query_ids[q0 : q0 + at_once], query_raw[q0 : q0 + at_once]
        limit = bound[q0 : q0 + at_once].copy()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b0 in range(0, len(base), rows):
            b = base[b0 : b0 + rows]
            dense, done = np.zeros((len(q), len(b))), 0
            qi = None
            while done < dim:
                end = min(dim, done + COLUMNS)
                bb, qq = b[:, done:end], q[:, done:end]
                if qi is None:
                    dense += (qq * qq).sum(axis=1)[:, None] + (bb * bb).sum(axis=1) - 2 * (qq @ bb.T)
                else:
                    diff = qq[qi] - bb[bi]
                    part = part + (diff * diff).sum(axis=1)
                done = end
                scale = 1.0 if done == dim else (1 + confidence / math.sqrt(done)) ** 2 * done / dim
                most = limit * scale + SLACK
                if qi is None:
                    keep = dense <= most[:, None]
                    if done == dim or keep.sum() < 0.25 * keep.size:
                        qi, bi = np.nonzero(keep)
                        part = dense[qi, bi]
                else:
                    keep = part <= most[qi]
                    qi, bi, part = qi[keep], bi[keep], part[keep]
            other = base_ids[b0 + bi] != ids[qi]
            qi, bi = qi[other], bi[other]
            if not len(qi):
                continue
            score = np.concatenate([cosine(base_raw[b0 + bi[i : i + 65536]], raw[qi[i : i + 65536]]) for i in range(0, len(qi), 65536)])
            qs, vs, ss = (np.concatenate(p) for p in zip(best, (qi, base_ids[b0 + bi], score), strict=True))
            order = np.lexsort((vs, -ss, qs))
            qs, vs, ss = qs[order], vs[order], ss[order]
            first = np.searchsorted(qs, qs)
            top = np.arange(len(qs)) - first < k
            best = qs[top], vs[top], ss[top]
            at, place = np.unique(best[0], return_index=True)
            full = np.bincount(best[0], minlength=len(q))[at] >= k
            limit[at[full]] = np.minimum(limit[at[full]], 2 - 2 * best[2][place[full] + k - 1] + SLACK)
        out_q.append(best[0] + q0)
        out_id.append(best[1])
        out_score.append(best[2])
    return (np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_id, out_score))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.97, sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows of ``vectors`` (vec_id, embedding) for each row of ``queries`` (the same columns): query_id, rank, vec_id, score.

    Nearness is the cosine in double precision, ties go to the smaller vec_id, and rows with the query's
    own vec_id are no candidates.  Rows with a null id, and vectors null, zero, of another length
    than most, or holding null or non-finite components take no part.  Fewer than k candidates are
    all returned, none give none.  Query rows with one id are one query, with the vector first in order; rows of
    ``vectors`` with one id are candidates each for itself, so an id may be found twice.  Other columns are not read;
    an empty table gives an empty result.
    """
    spark = vectors.sparkSession

    def proper(df: DataFrame) -> DataFrame:
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))

    base = proper(vectors)
    sizes = base.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n_rows = sizes
    base = base.filter(F.size("embedding") == dim)
    asked = proper(queries).filter(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, 20 * n_lists(n_rows))).select("embedding").toArrow()
    centres, probes = fit_index(matrix(rows.column("embedding"), dim), n_rows, k, recall)
    turn = rotation(dim)
    fixed = spark.sparkContext.broadcast((centres, turn))

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = nearest_lists(unit(matrix(batch.column("embedding"), dim)), fixed.value[0])[:, 0]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(own, pa.int32())], names=["vec_id", "embedding", "list"])

    indexed = materialize(map_arrow(base, index, "vec_id bigint, embedding array<double>, list int"))
    held = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}
    list_sizes = np.array([held.get(i, 0) for i in range(len(centres))])

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = nearest_lists(unit(matrix(batch.column("embedding"), dim)), fixed.value[0], True)
        # As many lists as were fitted, and at least those that hold k rows besides the query.
        enough = (np.cumsum(list_sizes[order], axis=1) < k + 1).sum(axis=1) + 1
        lists = [o[: max(probes, e)].tolist() for o, e in zip(order, enough, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "embedding", "lists"])

    probing = materialize(map_arrow(asked, probe, "query_id bigint, embedding array<double>, lists array<int>"))

    def search(left: DataFrame) -> DataFrame:
        """left: query_id, embedding, list, bound."""
        asks = {r["list"]: r["count"] for r in left.groupBy("list").count().collect()}
        cells = [(i, max(1, -(-int(n) // CHUNK)), max(1, -(-asks.get(i, 0) // BLOCK))) for i, n in enumerate(list_sizes) if n and asks.get(i)]
        grid = F.broadcast(spark.createDataFrame(cells, "list int, chunks int, blocks int"))
        cuts = indexed.join(grid, "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
        cuts = cuts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("chunks", "blocks")
        asked_of = left.join(grid, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        asked_of = asked_of.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "blocks")

        def cell(b: pa.Table, q: pa.Table) -> pa.Table:
            if b.num_rows and q.num_rows:
                raw, query_raw = matrix(b.column("embedding"), dim), matrix(q.column("embedding"), dim)
                ids, query_ids = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for t, c in ((b, "vec_id"), (q, "query_id")))
                bound = q.column("bound").to_numpy().astype(np.float64)
                at, vec, score = scan(ids, unit(raw) @ fixed.value[1], raw, query_ids, unit(query_raw) @ fixed.value[1], query_raw, bound, k)
                found = [query_ids[at.astype(np.int64)], vec.astype(np.int64), score.astype(np.float64)]
            else:
                found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.Table.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

        keys = ["list", "chunk", "block"]
        return cuts.groupBy(*keys).cogroup(asked_of.groupBy(*keys)).applyInArrow(cell, FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = probing.select("query_id", "embedding", F.element_at("lists", 1).alias("list"), F.lit(4.0 + SLACK).alias("bound"))
    first = materialize(search(home).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
    if len(centres) == 1:
        return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    bounds = first.filter(F.col("rank") == k).select("query_id", (2 - 2 * F.col("score") + SLACK).alias("kth"))
    rest = probing.join(bounds, "query_id", "left").select(
        "query_id", "embedding", F.explode(F.slice("lists", 2, len(centres))).alias("list"), F.coalesce("kth", F.lit(4.0 + SLACK)).alias("bound")
    )
    found = first.select("query_id", "vec_id", "score").unionByName(search(rest))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
