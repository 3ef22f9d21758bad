"""Sharding by vector bin packing.

Equal texts form a group that stays on one shard.  A group's vector is its bytes, tokens and rows.
Groups that hold a thousandth or so of the table are packed by name; all smaller ones are hashed into a
bounded number of cells, which are packed as one group each.  Groups and cells (bounded in number,
whatever the size of the table) are placed on the driver, largest first: each goes to the shard at
which the dot product of its vector with the shard's residual capacity is highest, every dimension being measured
in shares of the whole.  A group that is more than a whole shard in any dimension cannot be kept
together, so its rows are dealt over pieces, which are placed like groups.

The place of a row in its shard is the offset of its cell plus its rank in the cell; large cells
are ranked in parts, so that no task holds more than about ``1 / parts`` of the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

#: Cells of small groups, the share of the table (one part in so many) above which a group has a name, and parts.
CELLS, NAMED, PARTS = 8192, 4096, 1024
#: How much bytes, tokens and rows count in the dot product: the law is near equal bytes.
WEIGHTS = (8.0, 1.0, 1.0)


def place(vectors: list[tuple[float, ...]], n_shards: int) -> list[int]:
    """Vector bin packing: the shard of each vector.

    The residual capacity of a shard is what it still lacks of its equal share in each dimension;
    dimensions are weighted by ``WEIGHTS``.
    Where all dot products are negative (the shards are over-full) the same rule takes the least
    full one.  Ties go to the first shard; vectors are taken by size, then position.
    """
    if not vectors:
        return []
    shares = np.array(vectors, np.float64)
    totals = shares.sum(axis=0)
    shares /= np.where(totals > 0, totals, 1)
    left = np.full((n_shards, shares.shape[1]), 1.0 / n_shards)
    out = [0] * len(vectors)
    for i in np.argsort(-shares.max(axis=1), kind="stable"):
        out[i] = best = int((left @ (shares[i] * WEIGHTS)).argmax())
        left[best] -= shares[i]
    return out


def assign_shards(docs: DataFrame, n_shards: int = 8, cells: int = CELLS, named: int = NAMED, parts: int = PARTS) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text) on a shard: doc_id, size, text_crc32, tokens, shard, slot, split.

    ``size`` is the text's UTF-8 bytes plus 1, a null text counts as an empty one, and empty and very long texts
    are groups like others.  ``slot`` numbers a shard's rows from 0 without gaps.  ``split`` tells rows of a
    group too large for one shard: one with more than a shard's equal share of bytes, tokens or rows.  Repeated
    rows, and rows with equal or null ids, are separate rows of one group; which of them gets which slot isn't
    fixed.  Other columns are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            n_words(F.col("text")).alias("tokens"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(1), text).alias("g2"),
        )
    )
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    totals = [max(1, t or 0) for t in rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()]
    share = F.greatest(*(F.col(c) / t for c, t in zip(("bytes", "tokens", "rows"), totals, strict=True)))
    # In each dimension fewer than ``named`` groups are that large, so this list is bounded.
    large = groups.withColumn("share", share).filter(F.col("share") > 1 / named).select("g1", "g2", "share").collect()
    spec, at = [], cells
    for r in sorted(large, key=lambda r: (-r["share"], r["g1"], r["g2"])):
        pieces = int(np.ceil(r["share"] * n_shards * 4)) if r["share"] * n_shards > 1 else 1
        spec.append((r["g1"], r["g2"], at, pieces))
        at += pieces
    names = spark.createDataFrame(spec, "g1 long, g2 long, first long, pieces int")
    cell = F.coalesce(F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces")), F.pmod(F.col("g1"), F.lit(cells)))
    placed = rows.join(F.broadcast(names), ["g1", "g2"], "left").withColumn("cell", cell)
    sums = placed.groupBy("cell").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("cell").collect()
    shard_of = place([(r["bytes"], r["tokens"], r["rows"]) for r in sums], n_shards)
    step = max(1, totals[2] // parts)
    plan = [(int(r["cell"]), s, -(-r["rows"] // step)) for r, s in zip(sums, shard_of, strict=True)]
    cut = spark.createDataFrame(plan, "cell long, shard int, parts int")
    placed = placed.join(F.broadcast(cut), "cell").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")))
    counts = {(r["cell"], r["part"]): r["n"] for r in placed.groupBy("cell", "part").agg(F.count("*").alias("n")).collect()}
    starts, used = [], [0] * n_shards
    shards = {c: s for c, s, _ in plan}
    for (c, p), n in sorted(counts.items()):
        starts.append((int(c), int(p), used[shards[c]]))
        used[shards[c]] += n
    offsets = spark.createDataFrame(starts, "cell long, part long, start long")
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("row"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(offsets), ["cell", "part"])
        .select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), (F.coalesce("pieces", F.lit(1)) > 1).alias("split"))
    )
