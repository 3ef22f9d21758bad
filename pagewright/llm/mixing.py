"""Mixing sources to target weights.

The words of each source, its documents laid end to end, are cut into blocks of a fixed length.  A
source's target is its weighted share of the whole, at most ``limit`` times its own size; what is
cut off is reshared by weight.  Targets are cut into slots of a block each, the last one in part, and
all slots are dealt to the output shards by a pseudorandom permutation, so every shard has as many
slots as any other (the last may have fewer) and its counts of the sources are a multinomial draw without
replacement: targets are met to the word, whatever the draw.  The draw is made first; then a source's
slots are numbered shard by shard, by the counts drawn, and mapped to its blocks: in epochs of all
blocks, each in an order of its own, a pseudorandom permutation of the block numbers.  Slots are
joined to the blocks by source and index.

All numbers are drawn by integer arithmetic that any SQL engine repeats, so the same table always
gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, words

#: A multiplicative generator: state * MULTIPLIER mod MODULUS (fixed values of the Lehmer generator).
MULTIPLIER, MODULUS = 48271, 2147483647


def draw(x: str, seed: str | int) -> str:
    """SQL for a pseudorandom integer in [0, MODULUS) from an integer that isn't negative, by three Lehmer steps."""
    v = f"(({x}) % {MODULUS}L)"
    for k in range(3):
        v = f"((({v} + ({seed} + 1) * {(k + 1) * 7919}L) * {MULTIPLIER}L) % {MODULUS}L)"
    return v


def rounds(x: str, a: str, b: str, key: str) -> str:
    """SQL for one pass of a two-digit Feistel network over [0, a * b): three times the low digit by the high one and back."""
    low = f"(s.l + {draw(f's.r + {key}', 'k')}) % {a}"
    both = f"transform(array({low}), l -> named_struct('l', l, 'r', (s.r + {draw(f'l + {key}', '(k + 10)')}) % {b}))[0]"
    return f"aggregate(sequence(0L, 2L), named_struct('l', ({x}) % {a}, 'r', ({x}) div {a}), (s, k) -> {both}, s -> s.l + {a} * s.r)"


def permuted(j: str, n: str, key: str) -> Column:
    """A pseudorandom bijection of [0, n): Feistel passes over a domain a * b >= n, walked until the value is below n.

    With a the root of n rounded up and b = n / a rounded up, fewer than a numbers of the domain
    are not below n, so 64 steps reach one for n up to 4096, and beyond that miss with a
    probability under 64 ** -64.
    """
    a = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    domain = f"named_struct('n', CAST({n} AS BIGINT), 'a', {a}, 'b', CAST(ceil({n} / {a}) AS BIGINT), 'key', CAST({key} AS BIGINT))"
    walk = f"aggregate(sequence(0, 64), CAST({j} AS BIGINT), (x, i) -> CASE WHEN i > 0 AND x < d.n THEN x ELSE {rounds('x', 'd.a', 'd.b', 'd.key')} END)"
    return F.expr(f"transform(array({domain}), d -> {walk})[0]")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, limit: int = 3) -> DataFrame:
    """(source, source_size) with ``target``: weights repeat over the sources by code point, null last.

    Each source gets the same multiple of its weight unless that is above ``limit`` times its size;
    this is the point at which resharing the excess by weight ends.  The window runs over the
    sources, not over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    table = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(table, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * limit)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (total - capped) / free)
    # A source is at its limit where even the level of its own step is above it.
    own = level.withColumn("at_cap", F.col("level") * F.col("weight") >= F.col("cap"))
    first = F.max(F.when(~F.col("at_cap"), F.col("level"))).over(Window.partitionBy())
    return own.select("source", "source_size", F.when(F.col("at_cap"), F.col("cap").cast("double")).otherwise(first * F.col("weight")).alias("target"), "rank")


def plan_blocks(docs: DataFrame, block: int = 1024, cell_rows: int = 4096, seed: int = 7, n_shards: int = 64, shard_slots: int = 8192) -> tuple[DataFrame, DataFrame]:
    """The spans of documents in blocks, and the slots that take blocks.

    ``docs`` has doc_id, source, size and g1, g2, a hash of the row.  Returns (rows, slots): rows are
    the documents with source_size, target, rank (of the source) and start (words of the source
    before it); slots are (rank, epoch, slot, block, words, shard, place), ``words`` being how many of the
    block's words the slot takes.  There are ``n_shards`` shards, or as many more as hold ``shard_slots`` each.

    The words before a document are summed in two steps, over cells of about ``cell_rows`` documents
    of a source and inside a cell, so that no task holds all documents of a source.
    """
    sized = materialize(docs)  # the texts are read and counted once
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(per_source.select("source", "source_size"))
    info = targets.join(per_source.select(F.col("source").alias("s2"), "n_docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    info = materialize(info.withColumn("cells", F.ceil(F.col("n_docs") / cell_rows).cast("long")))
    rows = sized.join(info.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "n_docs")
    rows = rows.withColumn("cell", F.expr(draw(f"abs(coalesce(CAST(doc_id AS BIGINT), 0L) % {MODULUS}L)", seed)) % F.col("cells"))
    cell_sums = rows.groupBy("rank", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_starts = cell_sums.select("rank", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_start"))
    inside = Window.partitionBy("rank", "cell").orderBy("doc_id", "size", "g1").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(cell_starts, ["rank", "cell"])
        .withColumn("start", F.col("cell_start") + F.col("inside"))
        .drop("cell", "cells", "cell_start", "inside")
    )
    size, whole = F.col("source_size"), F.floor(F.col("source_size") / block).cast("long")
    src = info.filter(F.col("source_size") > 0).select("rank", "source_size", whole.alias("whole"), F.ceil(size / block).cast("long").alias("blocks"), F.round("target").cast("long").alias("words"))
    src = src.withColumn("epochs", F.floor(F.col("words") / F.col("source_size")).cast("long")).withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    src = src.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    by_rank = Window.orderBy("rank")  # over sources
    src = src.withColumn("first", F.sum("slots").over(by_rank) - F.col("slots")).withColumn("all", F.sum("slots").over(Window.partitionBy()))
    src = src.withColumn("shard_size", F.ceil(F.col("all") / F.greatest(F.lit(n_shards), F.ceil(F.col("all") / shard_slots))).cast("long"))
    # Slots are made in runs, so that a source with very many blocks is not unrolled in one row.
    run = 4096
    runs = src.filter(F.col("slots") > 0).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / run).cast("long"))))
    spread = runs.repartition(max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "rank", "run")
    slots = spread.withColumn("at", F.explode(F.sequence(F.col("run") * run, F.least(F.col("run") * run + run, F.col("slots")) - 1)))
    slots = slots.withColumn("dealt", permuted("(first + at)", "all", f"{seed + 1}L"))
    slots = materialize(slots.withColumn("shard", F.floor(F.col("dealt") / F.col("shard_size")).cast("long")).withColumn("place", F.col("dealt") - F.col("shard") * F.col("shard_size")).drop("run", "at", "dealt", "first", "all", "shard_size"))
    # The counts drawn for each shard and source, and where the source's slots of the shard begin.
    counts = slots.groupBy("rank", "shard").agg(F.count("*").alias("drawn"))
    begins = counts.select("rank", "shard", (F.sum("drawn").over(Window.partitionBy("rank").orderBy("shard")) - F.col("drawn")).alias("begin"))
    turn = F.row_number().over(Window.partitionBy("rank", "shard").orderBy("place")) - 1
    slots = slots.join(begins, ["rank", "shard"]).withColumn("number", F.col("begin") + turn)
    slots = slots.withColumn("epoch", F.floor(F.col("number") / F.col("blocks")).cast("long")).withColumn("slot", F.col("number") - F.col("epoch") * F.col("blocks"))
    # The short block at the end of a source keeps its place; the others are permuted.
    key = f"(rank * 1009L + epoch * 9176L + {seed}L)"
    mapped = F.when(F.col("slot") < F.col("whole"), permuted("slot", "whole", key)).otherwise(F.col("slot"))
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    left = F.col("rest") - F.col("slot") * block
    slots = materialize(
        slots.withColumn("block", mapped)
        .withColumn("words", F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.least(length, left)))
        .select("rank", "epoch", "slot", "block", "words", "shard", "place")
    )
    return materialize(rows), slots


def taken_words(docs: DataFrame, block: int = 1024, **options) -> DataFrame:
    """doc_id, source, g1, g2, size, source_size, target, taken, shards and spans for every row of ``docs`` (doc_id, source, text).

    g1 and g2 are hashes of doc_id, source and text.

    ``spans`` lists what is taken of the document as (epoch, lo, hi, shard, place): word positions from 0, ``hi``
    excluded, and where the slot stands in the mix; ``shards`` are the shards, in order, that get words of it.  A null or blank text has size 0 and gives nothing; a null source is a source of its
    own, the last; repeated rows are documents of their own, and rows alike in id, size and source may change places.  No word is taken more often than the
    limit of ``source_targets``, so no document gives more than that many times its size.  An empty table gives an
    empty result.
    """
    text = F.col("text").cast("string")
    sized = docs.select(
        "doc_id", "source", n_words(text).alias("size"), *(F.xxhash64(F.lit(k), "doc_id", "source", text).alias(g) for k, g in enumerate(("g1", "g2")))
    )
    rows, slots = plan_blocks(sized, block, **options)
    # (rank, start) names a document with words: starts of such documents differ within a source.
    some = rows.filter(F.col("size") > 0)
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    spans = some.select("rank", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    spans = spans.select(
        "rank", "start", "block",
        F.greatest(F.col("start") - F.col("block") * block, F.lit(0)).alias("lo"),
        F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)).alias("hi"),
    )
    hits = spans.join(slots, ["rank", "block"]).filter(F.col("words") > F.col("lo"))
    hi = F.least("hi", "words")
    base = F.col("block") * block - F.col("start")
    per_doc = hits.groupBy("rank", "start").agg(
        F.sum(hi - F.col("lo")).alias("taken"),
        F.array_sort(F.collect_list(F.struct("epoch", (base + F.col("lo")).alias("lo"), (base + hi).alias("hi"), "shard", "place"))).alias("spans"),
        F.array_sort(F.collect_set("shard")).alias("shards"),
    )
    empty = F.array().cast("array<struct<epoch:bigint,lo:bigint,hi:bigint,shard:bigint,place:bigint>>")
    key = F.when(F.col("size") > 0, F.col("start")).otherwise(-1)
    return (
        rows.withColumn("key", key)
        .join(per_doc.withColumnRenamed("start", "key"), ["rank", "key"], "left")
        .select("doc_id", "source", "g1", "g2", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"), F.coalesce("spans", empty).alias("spans"))
    )


def mixed_documents(docs: DataFrame, block: int = 1024, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs`` (n_chars, if there, follows the text).

    A document gives one row for each epoch that takes words of it: the whole text where the epoch
    takes all its words, else the words taken, joined by single spaces.  Documents of which nothing
    is taken are left out.
    """
    text = F.col("text").cast("string")
    keys = ["__g1", "__g2"]
    same = Window.partitionBy(*keys).orderBy("__n0")
    held = docs.select("*", *(F.xxhash64(F.lit(k), "doc_id", "source", text).alias(g) for k, g in enumerate(keys)))
    held = held.withColumn("__n0", F.lit(0)).withColumn("__n", F.row_number().over(same)).drop("__n0")
    taken = taken_words(docs, block, **options).filter("taken > 0")
    taken = taken.select(F.col("g1").alias("__g1"), F.col("g2").alias("__g2"), F.col("size").alias("__size"), F.col("spans").alias("__spans"), F.lit(0).alias("__n0"))
    taken = taken.withColumn("__n", F.row_number().over(same)).drop("__n0")
    parts = held.join(taken, [*keys, "__n"]).withColumn("__epoch", F.explode(F.array_distinct(F.transform("__spans", lambda s: s["epoch"]))))
    own = F.filter("__spans", lambda s: s["epoch"] == F.col("__epoch"))
    count = F.aggregate(own, F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"])
    cut = F.array_join(
        F.flatten(F.transform(own, lambda s: F.slice(F.col("__words"), (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), " "
    )
    parts = parts.withColumn("__whole", count == F.col("__size")).withColumn("__words", F.when(~F.col("__whole"), words(text)))
    out = parts.withColumn("text", F.when(F.col("__whole"), text).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
