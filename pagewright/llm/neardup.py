"""Near-duplicate documents: BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its five-word shingles.  BagMinHash gives every shingle a Poisson
process over time and weight: the weight axis is discretised at 1, 2, 4, 8, ..., a block between
two levels is a process of its own whose rate is the block's length, and a point of a block is
passed down the halves of the block, one bit of its draw for each, to the unit step it belongs to.
A point counts for a document if its step is below the shingle's weight there.  Points come in
order of time and each falls to one component of the signature, which keeps the earliest; a process
is left as soon as its time exceeds every component, so a long document costs little more than one
draw for each shingle.  Two documents agree in a component with the probability of their weighted
Jaccard similarity.

Signatures are cut into bands; documents equal in a band meet in a bucket.  Classes are found in
three passes, each of which only looks at what the one before left apart: within a bucket all are
compared with one centre; then those outside the bucket's largest class with a few centres of that
class; then every pair of different classes, pairs of small buckets one by one, those of large
ones in blocks of bounded size whose overlaps are one matrix product.  A block returns a spanning
forest of its links, so what is emitted grows with the documents, not with their pairs.  No two
classes that a link joins stay apart.  Every link is verified on the shingles of the whole texts;
both ways divide the same whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_CHARS, materialize
from .graph import components

SHINGLE = 5
#: At a similarity of 0.8 a pair shares none of the 24 bands of 4 with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Buckets of at most so many documents are compared as pairs; blocks of larger ones hold about so many documents and shingles.
PAIR_BUCKET, BLOCK_DOCS, BLOCK_SHINGLES = 48, 1024, 400_000
#: Centres of the largest class that the rest of a bucket is compared with.
CENTRES = 4

_white = np.zeros(256, bool)
_white[[ord(c) for c in WHITE_CHARS]] = True
_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every five-word shingle; a text of fewer words, but any, has one of them all."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    white = _white[data]
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word_of = np.cumsum(np.bincount(starts, minlength=len(data))) - 1
    place = np.arange(len(data)) - starts[np.maximum(word_of, 0)]
    powers = np.cumprod(np.full(int(place[~white].max()) + 2, 0x100000001B3, _U))
    part = np.where(white, _U(0), (data.astype(_U) + _U(1)) * powers[np.where(white, 0, place)])
    words = mix64(np.add.reduceat(part, starts))
    doc = np.searchsorted(begins, starts, "right") - 1
    counts = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(counts) - counts
    at = np.arange(len(words))
    full = at + SHINGLE <= (first + counts)[doc]
    at = at[full | ((counts[doc] < SHINGLE) & (at == first[doc]))]
    end = np.minimum(at + SHINGLE, (first + counts)[doc[at]])
    value = np.zeros(len(at), _U)
    for k in range(SHINGLE):
        inside = at + k < end
        value = np.where(inside, mix64(value * _U(_GOLDEN) + words[np.where(inside, at + k, 0)] + _U(k + 1)), value)
    return doc[at], value


def weighted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, shingle) pairs with their counts."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.concatenate((at, [len(doc)])))


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures, one line for each document: the time of the first point in each component (infinite without shingles)."""
    best = np.full(n_docs * size, np.inf)
    # One process for each block of the weight axis that begins below the weight: [0, 1), [1, 2), [2, 4), ...
    levels = [(0, 1)] + [(1 << b, 2 << b) for b in range(int(weight.max()).bit_length())] if len(weight) else []
    procs = []
    for block, (low, high) in enumerate(levels):
        has = np.flatnonzero(weight > low)
        procs.append((has, np.full(len(has), block), np.full(len(has), float(high - low)), np.full(len(has), low)))
    if not procs:
        return best.reshape(n_docs, size)
    own, block, rate, low = (np.concatenate(x) for x in zip(*procs, strict=True))
    own_doc, own_weight = doc[own], weight[own]
    seed = mix64(value[own] + block.astype(_U) * _U(0xD6E8FEB86659FD93))
    time = np.zeros(len(own))
    drawn = step = 0
    while len(own_doc):
        take = 1 if step < 4 else 16
        step += 1
        number = (np.arange(drawn + 1, drawn + 1 + take, dtype=_U) * _U(_GOLDEN))[None, :]
        drawn += take
        r = mix64(seed[:, None] + number)
        gap = -np.log1p(-(r >> _U(11)).astype(np.float64) * 2.0**-53) / rate[:, None]
        gap[:, 0] += time
        times = np.cumsum(gap, axis=1)
        r2 = mix64(r + _U(0xA0761D6478BD642F))
        part = (r2 >> _U(32)).astype(np.int64) % size
        unit_step = low[:, None] + ((r2 & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[:, None]).astype(np.int64)
        counts = (unit_step < own_weight[:, None]).ravel()
        np.minimum.at(best, (own_doc[:, None] * size + part).ravel()[counts], times.ravel()[counts])
        time = times[:, -1]
        live = time < best.reshape(n_docs, size).max(axis=1)[own_doc]
        own_doc, own_weight, seed, time, rate, low = own_doc[live], own_weight[live], seed[live], time[live], rate[live], low[live]
    return best.reshape(n_docs, size)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(_U).reshape(len(sig), bands, -1)
    key = np.arange(1, bands + 1, dtype=_U)[None, :].repeat(len(sig), 0)
    for k in range(bits.shape[2]):
        key = mix64(key * _U(_GOLDEN) + bits[:, :, k])
    return key.view(np.int64)


def sign(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles, band keys) of texts, about a megabyte at a time."""
    sizes, keys = [], []
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars < 1 << 20):
            chars += len(texts[hi])
            hi += 1
        doc, value = shingles(texts[lo:hi])
        sizes.append(np.bincount(doc, minlength=hi - lo))
        keys.append(band_keys(signatures(*weighted(doc, value), hi - lo)))
        lo = hi
    return np.concatenate(sizes), np.concatenate(keys)


def overlap(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The weighted Jaccard similarity of pairs of texts; 0 where neither has words."""
    out = []
    lo = 0
    while lo < len(pairs):
        hi, chars = lo, 0
        while hi < len(pairs) and (hi == lo or chars < 1 << 20):
            chars += len(pairs[hi][0]) + len(pairs[hi][1])
            hi += 1
        doc, value, count = weighted(*shingles([t for p in pairs[lo:hi] for t in p]))
        pair = doc // 2
        total = np.bincount(pair, count, minlength=hi - lo)
        order = np.lexsort((doc, value, pair))
        p, v, c = pair[order], value[order], count[order]
        twin = np.flatnonzero((p[1:] == p[:-1]) & (v[1:] == v[:-1]))
        shared = np.bincount(p[twin], np.minimum(c[twin], c[twin + 1]), minlength=hi - lo)
        out.append(shared / np.maximum(total - shared, 1))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0)


def _signed(docs: DataFrame) -> DataFrame:
    kept = ("doc_id", "text", "g1", "g2")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes, keys = sign([t or "" for t in batch.column("text").to_pylist()])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(sizes, pa.int64()), flat], names=[*kept, "size", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, text string, g1 bigint, g2 bigint, size bigint, keys array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with the similarity of their texts (node, text)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = overlap(list(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"])

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, similarity double")


def forest(joined: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    left = np.ones(len(joined), bool)
    out = []
    for start in range(len(joined)):
        if left[start]:
            left[start] = False
            queue = [start]
            while queue:
                at = queue.pop()
                new = np.flatnonzero(joined[at] & left)
                left[new] = False
                out += [(at, int(x)) for x in new]
                queue += new.tolist()
    return out


def block_links(texts: list[str], components: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of components that join what the links between ``left`` and ``right`` (flags of texts) join.

    A link is a similarity of ``threshold`` or more.  There are fewer pairs than components.
    """
    doc, value, count = weighted(*shingles(texts))
    # The k-th occurrence of a shingle is an element of its own, so that overlaps of multisets are overlaps of sets.
    doc, value = np.repeat(doc, count), np.repeat(value, count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    totals = np.bincount(doc, minlength=len(texts)).astype(np.float64)
    _, element, seen = np.unique(mix64(value + nth.astype(_U) * _U(_GOLDEN)), return_inverse=True, return_counts=True)
    shared = seen[element] > 1
    kept, element = np.unique(element[shared], return_inverse=True)
    doc = doc[shared]
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    place_of_row, place_of_column = np.full(len(texts), -1), np.full(len(texts), -1)
    place_of_row[rows], place_of_column[columns] = np.arange(len(rows)), np.arange(len(columns))
    common = np.zeros((len(rows), len(columns)), np.float32)  # whole numbers below 2 ** 24
    order = np.argsort(element, kind="stable")
    doc, element = doc[order], element[order]
    for lo in range(0, len(kept), 4096):
        part = slice(*np.searchsorted(element, (lo, lo + 4096)))
        d, e = doc[part], element[part] - lo
        a, b = np.zeros((len(rows), 4096), np.float32), np.zeros((len(columns), 4096), np.float32)
        own = place_of_row[d] >= 0
        a[place_of_row[d[own]], e[own]] = 1
        own = place_of_column[d] >= 0
        b[place_of_column[d[own]], e[own]] = 1
        common += a @ b.T
    exact = common.astype(np.float64)
    union = np.maximum(totals[rows][:, None] + totals[columns][None, :] - exact, 1)
    names, number = np.unique(components, return_inverse=True)
    joined = np.zeros((len(names), len(names)), bool)
    i, j = np.nonzero(exact / union >= threshold)
    joined[number[rows[i]], number[columns[j]]] = True
    joined |= joined.T
    return [(int(names[i]), int(names[j])) for i, j in forest(joined)]


def _in_blocks(placed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the components of large buckets: placed (bucket, node, size, component, main, rest_chunks, main_chunks).

    The rest of a bucket meets itself and the main component; the main component doesn't meet itself.
    """
    rest = F.col("component") != F.col("main")
    own = F.when(rest, F.pmod(F.xxhash64("node"), F.col("rest_chunks"))).otherwise(F.col("rest_chunks") + F.pmod(F.xxhash64("node"), F.greatest("main_chunks", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(rest, F.col("rest_chunks") + F.col("main_chunks")).otherwise(F.col("rest_chunks")) - 1)
    rows = placed.withColumn("chunk", own).withColumn("other", F.explode(others))
    rows = rows.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "component")

    def block(pdf):
        import pandas as pd

        first = pdf.chunk.to_numpy() == pdf.i.to_numpy()
        second = pdf.chunk.to_numpy() == pdf.j.to_numpy()
        found = block_links(pdf.text.tolist(), pdf.component.to_numpy(), first, second, threshold)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    joined = rows.join(texts, "node").select("bucket", "i", "j", "chunk", "component", "text")
    return joined.groupBy("bucket", "i", "j").applyInPandas(block, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets whose documents are not all in one component, with ``component`` and the bucket's largest one, ``main``."""
    placed = members.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = counted.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    return materialize(placed.join(main.select("bucket", "main"), "bucket"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The class of every row of ``docs`` (doc_id, text): doc_id, class_id, class_size, n_shingles, kept, g1, g2.

    Two texts are linked if they are equal, or if their five-word shingles (multisets) have a weighted
    Jaccard similarity of ``threshold`` or more; classes are the connected components.  ``class_id``
    is the smallest doc_id of the class, ``class_size`` its rows, and ``kept`` is true for one row of
    each class, one with that id.  A text of fewer
    than five words has one shingle of all; texts without words (null counts as empty) are linked only if
    equal.  Rows without id are placed like others, and their class's id is null if none of it has one.
    Repeated rows belong to one class, and at most one of them is kept; ties between rows change nothing
    else.  Other columns are not read.  An empty table gives an empty result.  g1 and g2 are hashes of the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.withColumn("g1", F.xxhash64("text")).withColumn("g2", F.xxhash64(F.lit(1), F.col("text")))
    rows = materialize(_signed(own).withColumn("row", F.monotonically_increasing_id()))
    # The first row of a text stands for it.
    nodes = materialize(rows.groupBy("g1", "g2").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    heads = rows.filter("size > 0").withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi")
    keyed = heads.select("node", "size", F.explode("keys").alias("bucket"))
    near = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)  # noqa: E731  a similarity is at most the smaller size over the larger
    met = keyed.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre <> last").select("bucket", "centre")
    members = materialize(keyed.join(met, "bucket"))
    texts = materialize(rows.select(F.col("row").alias("node"), "text").join(members.select("node").distinct(), "node", "left_semi"))
    sizes = members.select(F.col("node").alias("centre"), F.col("size").alias("centre_size")).distinct()

    def compared(pairs: DataFrame) -> DataFrame:
        """The verified links of (node, size, centre)."""
        pairs = pairs.filter("node <> centre").distinct().join(sizes, "centre").filter(near(F.col("size"), F.col("centre_size")))
        pairs = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        return _verified(pairs, texts).filter(F.col("similarity") >= threshold).select("a", "b")

    links = materialize(compared(members.select("node", "size", "centre")))
    placed = _apart(members, links)
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(k)), "node"))["node"].alias(f"c{k}") for k in range(CENTRES)]
    centres = placed.filter("component = main").groupBy("bucket").agg(*picks)
    centres = centres.select("bucket", F.explode(F.array_distinct(F.array(*(f"c{k}" for k in range(CENTRES))))).alias("centre"))
    more = compared(placed.filter("component <> main").select("bucket", "node", "size").join(centres, "bucket").select("node", "size", "centre"))
    links = materialize(links.unionByName(more))
    # Every pair of different components in a bucket that no bound excludes.
    placed = _apart(members.select("bucket", "node", "size"), links)
    rest = F.col("component") != F.col("main")
    chunks = lambda own: F.greatest(F.ceil(F.count(F.when(own, 1)) / BLOCK_DOCS), F.ceil(F.sum(F.when(own, F.col("size"))) / BLOCK_SHINGLES), F.lit(0)).cast("int")
    shape = placed.groupBy("bucket").agg(F.count("*").alias("members"), chunks(rest).alias("rest_chunks"), chunks(~rest).alias("main_chunks"))
    placed = materialize(placed.join(shape, "bucket"))
    x, y = placed.filter((F.col("members") <= PAIR_BUCKET) & rest).alias("x"), placed.filter(F.col("members") <= PAIR_BUCKET).alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    cross = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & once & (F.col("x.component") != F.col("y.component")) & near(F.col("x.size"), F.col("y.size")))
    cross = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    last = _verified(cross, texts).filter(F.col("similarity") >= threshold).select("a", "b")
    last = last.unionByName(_in_blocks(placed.filter(F.col("members") > PAIR_BUCKET), texts, threshold))
    final = components(links.unionByName(last))
    classed = materialize(nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node")))
    known = classed.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = classed.join(known, "component").select("g1", "g2", "component", "class_id", "class_size")
    out = materialize(rows.select("row", "doc_id", "size", "g1", "g2").join(known, ["g1", "g2"]))
    chosen = out.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.min("row").alias("row"))
    out = out.join(chosen.select("row", F.lit(True).alias("chosen")), "row", "left")
    return out.select("doc_id", "class_id", "class_size", F.col("size").alias("n_shingles"), F.coalesce("chosen", F.lit(False)).alias("kept"), "g1", "g2")


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``classes`` (of ``near_duplicates(docs)``) keeps: one for each class."""
    names = [f"__{n}{'_' * max(map(len, docs.columns), default=0)}" for n in ("g1", "g2", "id")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = (F.xxhash64(text), F.xxhash64(F.lit(1), text), F.xxhash64(F.col("doc_id").cast("long")))
    kept = classes.filter("kept").select(*(c.alias(n) for c, n in zip((F.col("g1"), F.col("g2"), F.xxhash64("doc_id")), names, strict=True)))
    # Repeated rows have equal names; one of them is kept.
    return docs.withColumns(dict(zip(names, own, strict=True))).join(kept.distinct(), names, "left_semi").dropDuplicates(names).drop(*names)
