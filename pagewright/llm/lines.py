"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Two lines are linked if they are equal or if their edit distance is within a threshold that depends
on the shorter one.  Edits of shorter lines are counted in characters; those of lines of enough words
in words, and their number grows with the words.  If a line is cut into threshold-plus-one segments
(of characters or words), one of them must occur unchanged in any line within the threshold, at a
place that the lengths confine.  So each line indexes its own segments and probes, for every length
that a partner may have, the substrings at those places.  Lines meet in buckets by (length, segment,
substring).

Within a bucket all lines are compared with its most frequent one; links are joined into components.
Lines outside the largest component of a bucket are compared with a few of its lines, and what is
still apart with all lines of the bucket in other components.  Pairs first pass exact filters (lengths,
a banded table of distances, words that the other lacks) inside the join; what is left is verified by a banded
bit-parallel edit distance, of characters or words.

Of every class of linked lines one occurrence stays: the first in the document with the smallest id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .graph import components

#: Lines of fewer characters are linked only to equal ones, if at all; from the second length on two edits are allowed, before one.
MIN_CHARS, TWO_EDITS = 20, 40
#: Word edits allowed from so many words on (the shorter line decides), in order.
WORD_EDITS = ((15, 1), (30, 2), (90, 3))
#: From so many words on only words count.
LONG = 30
#: Lines of the largest component that the others of a bucket are compared with.
CENTRES = 4
#: Bits of the table that says whether a line met another, at most (16 MB when broadcast).
MAX_BITS = 1 << 27

_TOP = 61  # bit of the lowest row of the band
_MASK = (1 << (_TOP + 1)) - 1
_ALL = 1 << 30


def threshold(length: str) -> str:
    """SQL for the character edits allowed to a pair whose shorter line has this length."""
    return f"(CASE WHEN {length} >= {TWO_EDITS} THEN 2 ELSE 1 END)"


def word_threshold(words: str) -> str:
    """SQL for the word edits allowed to a pair whose shorter line has so many words."""
    return "(CASE " + " ".join(f"WHEN {words} >= {low} THEN {t}" for low, t in reversed(WORD_EDITS)) + " ELSE 0 END)"


def _segments(kind: int, t: int, low: int, high: int) -> str:
    """SQL for the array of segments that a line indexes or probes for a shorter partner of ``low`` to ``high``, with t edits.

    For a partner of length l and segment i at p: between the segments before i at most i
    edits fall, and after it t - i, so its place x obeys |x - p| <= i and |x - p - (L - l)| <= t - i.
    """
    rows = []
    for shorter in range(t + 1):
        for i in range(t + 1):
            for move in range(max(-i, shorter - (t - i)), min(i, shorter + (t - i)) + 1):
                own = int(shorter == move == 0)
                rows.append(f"named_struct('kind', {kind}, 'parts', {t + 1}, 'low', {low}, 'high', {high}, 'shorter', {shorter}, 'i', {i}, 'move', {move}, 'own', {own}L)")
    return f"array({', '.join(rows)})"


def _all_segments(kind: int, size: str, classes: list[tuple[int, int, int]]) -> str:
    """SQL for the array of the segments for all classes (low, high, edits) that a line of ``size`` may need."""
    branches = [f"WHEN {size} BETWEEN {low + t} AND {high} THEN {_segments(kind, t, low, high)}" for low, high, t in classes]
    every = ", ".join(_segments(kind, t, low, high) for low, high, t in classes)
    return f"(CASE {' '.join(branches)} WHEN {size} >= {classes[0][0]} THEN concat({every}) ELSE array() END)"


def line_hash(line: str = "line") -> Column:
    """The hash that names a line; its lowest bit is free for a flag."""
    return F.xxhash64(line).bitwiseAND(F.lit(-2).cast("long"))


def keyed_lines(lines: DataFrame) -> DataFrame:
    """(key, v) for every segment that a line of ``lines`` (line) indexes or probes: v is its hash, plus one for its own segments.

    Pieces are cut from fixed-width codes, four bytes for a character, one for the hash of a word, so
    that a cut costs no walk along the line.  Codes that agree by chance only make lines meet for nothing.
    """
    coded = lines.select(line_hash().alias("h1"), "line", F.split("line", " ").alias("z")).withColumn("m", F.size("z"))
    chars = F.expr(f"CASE WHEN m < {LONG + 2} THEN encode(line, 'UTF-32') END")
    words = F.expr(f"CASE WHEN m >= {WORD_EDITS[0][0]} THEN CAST(array_join(transform(z, w -> chr(hash(w) & 127)), '') AS BINARY) END")
    coded = coded.select("h1", "m", chars.alias("u"), words.alias("v")).withColumn("n", F.expr("length(u) div 4"))
    ends = [*(low - 1 for low, _ in WORD_EDITS[1:]), _ALL]
    of_chars = _all_segments(0, "n", [(MIN_CHARS, TWO_EDITS - 1, 1), (TWO_EDITS, _ALL, 2)])
    of_words = _all_segments(1, "m", [(low, high, t) for (low, t), high in zip(WORD_EDITS, ends, strict=True)])
    # A pair of which one line has fewer than LONG words and that is within two characters has at most two words more.
    listed = F.expr(f"CASE WHEN m < {WORD_EDITS[0][0]} THEN {of_chars} WHEN m >= {LONG + 2} THEN {of_words} ELSE concat({of_chars}, {of_words}) END")
    # The segments are unrolled first, so that cutting one is a small expression.
    spread = coded.select("h1", "u", "v", "n", "m", F.explode(listed).alias("s")).withColumn("size", F.expr("CASE WHEN s.kind = 0 THEN n ELSE m END - s.shorter"))
    spread = spread.filter("size BETWEEN s.low AND s.high")
    # Later segments are longer by one where the size doesn't divide.
    place = F.expr("CAST(s.i * (size div s.parts) + greatest(0, s.i - s.parts + size % s.parts) + s.move AS INT)")
    cut = spread.select("h1", "u", "v", "s", "size", place.alias("place"), F.expr("CAST((size + s.i) div s.parts AS INT)").alias("width"))
    piece = "CASE WHEN s.kind = 0 THEN substring(u, 4 * place + 1, 4 * width) ELSE substring(v, place + 1, width) END"
    return cut.select(F.expr(f"xxhash64(s.kind, size, s.i, {piece})").alias("key"), F.col("h1").bitwiseOR(F.col("s.own")).alias("v"))


def edit_distance(a: str, b: str, t: str) -> str:
    """SQL for the edit distance of two arrays of characters, ``a`` not shorter than ``b``, if it is at most t; else more than t.

    Vertical differences of a band around the diagonal are bits of two integers, advanced for one
    character of b at a time: the lowest row of the band, t rows below the diagonal, is bit 61; the
    last t columns follow the bottom row of the table instead.
    """
    match = " + ".join(f"(CASE WHEN i + {d} >= 0 AND i + {d} < size({a}) AND abs({d}) <= {t} AND {a}[greatest(0, least(i + {d}, size({a}) - 1))] = {b}[i] THEN shiftleft(1L, {_TOP} - {t} + ({d})) ELSE 0L END)" for d in range(-3, 4))
    # Intermediate vectors are bound by transforms over one element, each being computed once for a character.
    d0 = f"((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {_MASK}L"
    hp, hn, half = f"(s.vn | ~(d0 | s.vp)) & {_MASK}L", "d0 & s.vp", "shiftright(d0, 1)"
    diagonal = f"CASE WHEN (d0 & {1 << _TOP}L) = 0 THEN 1 ELSE 0 END"
    bottom = f"CASE WHEN (h.p & {{edge}}) <> 0 THEN 1 WHEN (h.n & {{edge}}) <> 0 THEN -1 ELSE 0 END".format(edge=f"shiftleft(1L, {_TOP} - {t} + size({a}) - 1 - s.i)")
    moved = f"CASE WHEN s.i < size({a}) - {t} THEN {diagonal} ELSE {bottom} END"
    state = f"named_struct('vp', (h.n | ~(h.r | h.p)) & {_MASK}L, 'vn', h.r & h.p, 'd', s.d + {moved}, 'i', s.i + 1)"
    step = f"transform(array({d0}), d0 -> transform(array(named_struct('p', {hp}, 'n', {hn}, 'r', {half})), h -> {state})[0])[0]"
    start = f"named_struct('vp', shiftleft(shiftleft(1L, {t} + 1) - 1L, {_TOP} - {t}), 'vn', 0L, 'd', least({t}, size({a})), 'i', 0)"
    return f"CASE WHEN size({b}) = 0 THEN size({a}) ELSE aggregate(transform(sequence(0, size({b}) - 1), i -> {match}), {start}, (s, m) -> {step}, s -> s.d) END"


def maybe_near(a: str, b: str) -> Column:
    """Whether two lines, structs of line, n (characters) and z (words), may be linked: false only for those that are not."""
    n, m = f"least({a}.n, {b}.n)", f"least(size({a}.z), size({b}.z))"
    chars = f"({m} < {LONG} AND abs({a}.n - {b}.n) <= {threshold(n)} AND levenshtein({a}.line, {b}.line, {threshold(n)}) >= 0)"
    t = word_threshold(m)
    lacks = lambda x, y: f"size(array_except({x}.z, {y}.z)) <= {t}"
    return F.expr(f"{chars} OR (abs(size({a}.z) - size({b}.z)) <= {t} AND {t} > 0 AND {lacks(a, b)} AND {lacks(b, a)})")


def near(a: str, b: str) -> Column:
    """Whether two lines, structs like those of ``maybe_near``, are within the threshold, of words or of characters."""
    n, m = f"least({a}.n, {b}.n)", f"least(size({a}.z), size({b}.z))"
    # The longer one comes first.
    order = lambda x, y, longer: f"'p', CASE WHEN {longer} THEN {x} ELSE {y} END, 'q', CASE WHEN {longer} THEN {y} ELSE {x} END"
    words = f"named_struct('t', CAST({word_threshold(m)} AS INT), 'least', 1, 'apart', abs(size({a}.z) - size({b}.z)), {order(f'{a}.z', f'{b}.z', f'size({a}.z) >= size({b}.z)')})"
    chars = f"named_struct('t', CAST(CASE WHEN {m} < {LONG} THEN {threshold(n)} ELSE -1 END AS INT), 'least', 0, 'apart', abs({a}.n - {b}.n), {order(f'split({a}.line, {chr(39) * 2})', f'split({b}.line, {chr(39) * 2})', f'{a}.n >= {b}.n')})"
    return F.expr(f"exists(array({words}, {chars}), v -> v.t >= v.least AND v.apart <= v.t AND {edit_distance('v.p', 'v.q', 'v.t')} <= v.t)")


def _spelled(line: str) -> Column:
    return F.struct(F.col(line).alias("line"), F.length(line).alias("n"), F.split(line, " ").alias("z"))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are within the threshold."""
    side = lambda k: texts.select(F.col("h1").alias(k), F.col("line").alias(f"l{k}"))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", _spelled("la").alias("sa"), _spelled("lb").alias("sb"))
    return both.filter(maybe_near("sa", "sb")).filter(near("sa", "sb")).select("a", "b")


def _possible(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose h1 may be one of ``ids`` (h1): a bitmap of bounded size tells which aren't; it saves time only."""
    spark = rows.sparkSession
    bits = 1 << 15
    wanted = min(MAX_BITS, 32 * max(1, ids.count()))
    while bits < wanted:
        bits *= 2
    # The lowest bit of a hash is none of its own.
    slot = F.pmod(F.shiftright("h1", 1), F.lit(bits).cast("long"))
    table = ids.select((slot + 1).alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bitmap"))
    held = [(r["part"], np.frombuffer(bytes(r["bitmap"]), "<i8").tolist()) for r in table.collect()]
    table = spark.createDataFrame(held, "__part long, __bits array<long>")
    names = rows.columns
    spot = rows.withColumn("__x", slot + 1).withColumn("__part", F.expr("bitmap_bucket_number(__x)")).withColumn("__bit", F.expr("CAST(bitmap_bit_position(__x) AS INT)"))
    spot = spot.join(F.broadcast(table), "__part").filter("(shiftright(__bits[shiftright(__bit, 6)], __bit & 63) & 1) = 1")
    return spot.select(*names)


def _texts_of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(h1, line, copies) of ``lines`` (line) whose hash is in ``ids`` (h1)."""
    spot = _possible(lines.select("line", line_hash().alias("h1")), ids)
    return spot.groupBy("h1", "line").agg(F.count("*").alias("copies")).join(ids, "h1", "left_semi")


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets whose lines are not all in one component, with ``component`` and the bucket's largest one, ``main``."""
    placed = members.join(components(links).withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counted.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    return materialize(placed.join(main.select("key", "main"), "key"))


def line_links(docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between different lines of ``docs`` (text), as their hashes, that join all classes.

    Lines of a class need not all be linked to each other, but no class is cut.  A hash stands for a line with an error of
    about 2 ** -63 for each pair of lines.
    """
    lines = docs.select(F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("line")).filter(F.length("line") >= MIN_CHARS)
    keyed = keyed_lines(lines.groupBy("line").agg(F.lit(1).alias("one")))
    met = Window.partitionBy("key")
    keyed = keyed.withColumn("first", F.min("v").over(met)).withColumn("last", F.max("v").over(met)).withColumn("all", F.bit_or("v").over(met))
    # Two lines at least, and an own segment.
    members = materialize(keyed.filter("shiftright(first, 1) <> shiftright(last, 1) AND (all & 1) = 1").select("key", F.expr("v & -2L").alias("h1"), F.expr("(v & 1) = 1").alias("own")))
    texts = materialize(_texts_of(lines, materialize(members.select("h1").distinct())))
    ranked = members.join(texts.select("h1", "copies"), "h1").groupBy("key").agg(F.max(F.struct("copies", "h1"))["h1"].alias("b"))
    links = materialize(_linked(members.select("key", F.col("h1").alias("a")).join(ranked, "key").filter("a <> b"), texts))
    placed = _apart(members, links)
    picks = [F.min(F.struct(F.xxhash64("h1", F.lit(k)), "h1"))["h1"].alias(f"c{k}") for k in range(CENTRES)]
    centres = placed.filter("component = main").groupBy("key").agg(*picks)
    centres = centres.select("key", F.explode(F.array_distinct(F.array(*(f"c{k}" for k in range(CENTRES))))).alias("b"))
    links = materialize(links.unionByName(_linked(placed.filter("component <> main").select("key", F.col("h1").alias("a")).join(centres, "key"), texts)))
    placed = _apart(members, links)
    spelled = materialize(placed.join(texts.select("h1", "line"), "h1").withColumn("s", _spelled("line")).drop("line"))
    x, y = spelled.filter("component <> main").alias("x"), spelled.alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.h1") < F.col("y.h1"))
    met = (F.col("x.key") == F.col("y.key")) & once & (F.col("x.component") != F.col("y.component")) & (F.col("x.own") | F.col("y.own"))
    cross = x.join(y, met & maybe_near("x.s", "y.s"))
    cross = cross.select(F.col("x.h1").alias("a"), F.col("y.h1").alias("b"))
    return links.unionByName(_linked(cross, texts))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """What line deduplication drops from every row of ``docs`` (doc_id, text).

    Returns doc_id, g1, g2 (hashes of doc_id and text), n_lines (\\n-split lines), n_dropped, dropped
    (their positions from 0), kept_in (ids of the documents that keep a line of their classes) and shared: (pos, class_id) of
    every line that has an equal or linked one, by position; class_id is the least hash of the class's lines.

    Blank lines are kept.  Lines of fewer than 20 characters are linked to equal ones.  Of a class the first
    occurrence in the document of smallest id stays; documents without id come last, and repeated rows are
    documents of their own, one of which keeps the line.  A null text is one empty line; an empty table gives an
    empty result.  Very long lines are read whole.  Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hashes = F.expr(r"transform(split(text, '\n'), l -> CASE WHEN l RLIKE '[^\\x20\\x09-\\x0D]' THEN struct(xxhash64(l) & -2L AS h1, xxhash64(1, l) AS h2) END)")
    rows = materialize(
        own.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("g1"), F.xxhash64(F.lit(1), "doc_id", F.col("text")).alias("g2"), hashes.alias("lines"))
    )
    classes = components(line_links(own)).withColumnRenamed("node", "h1")
    spread = rows.select("row", "doc_id", F.posexplode("lines").alias("pos", "l")).filter("l IS NOT NULL").select("row", "doc_id", "pos", "l.h1", "l.h2")
    # Linked lines are told by one hash, others by both; of the others only those that occur again are shuffled.
    linked = _possible(spread, classes.select("h1")).join(classes, "h1").select("row", "doc_id", "pos", F.col("component").alias("k1"), F.lit(0).cast("long").alias("k2"))
    linked = materialize(linked)
    again = spread.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1").drop("n").join(classes, "h1", "left_anti")
    again = materialize(again)
    repeated = _possible(spread, again.select("h1")).join(again, ["h1", "h2"])
    first = linked.groupBy("k1").agg(F.min("doc_id").alias("first_doc"))
    columns = ["row", "doc_id", "pos", "k1", "k2", "first_doc"]
    marked = materialize(linked.join(first, "k1").select(columns).unionByName(repeated.withColumnsRenamed({"h1": "k1", "h2": "k2"}).select(columns)))
    stays = marked.filter(F.col("doc_id").eqNullSafe(F.col("first_doc"))).groupBy("k1", "k2").agg(F.min(F.struct("row", "pos")).alias("at"))
    marked = marked.join(stays.select("at.row", "at.pos", F.lit(True).alias("stays")), ["row", "pos"], "left").withColumn("gone", F.col("stays").isNull())
    gone = lambda c: F.when(F.col("gone"), F.col(c))
    per_row = marked.groupBy("row").agg(
        F.array_sort(F.collect_list(gone("pos"))).alias("dropped"), F.array_sort(F.collect_set(gone("first_doc"))).alias("kept_in"), F.array_sort(F.collect_list(F.struct("pos", F.col("k1").alias("class_id")))).alias("shared")
    )
    out = rows.select("row", "doc_id", "g1", "g2", F.size("lines").cast("long").alias("n_lines")).join(per_row, "row", "left")
    filled = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select(
        "doc_id", "g1", "g2", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"), filled("kept_in", "array<bigint>"), filled("shared", "array<struct<pos:int,class_id:bigint>>")
    )


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``dedup_lines(docs)`` drops taken out of the text (and n_chars, if there, following it).

    Documents that had words and keep none are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = Window.partitionBy("__g1", "__g2").orderBy("__turn")
    keys = ["__g1", "__g2", "__n"]
    held = docs.withColumn("__g1", F.xxhash64(F.col("doc_id").cast("long"), text)).withColumn("__g2", F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), text))
    held = held.withColumn("__turn", F.lit(0)).withColumn("__n", F.row_number().over(same)).drop("__turn")
    cut = found.select(F.col("g1").alias("__g1"), F.col("g2").alias("__g2"), F.col("dropped").alias("__dropped"), F.size("dropped").alias("__turn")).withColumn("__n", F.row_number().over(same)).drop("__turn")
    out = held.join(cut, keys)
    left = F.expr("transform(array(split(text, '\n')), z -> array_join(transform(array_except(sequence(0, size(z) - 1), __dropped), i -> z[i]), '\n'))[0]")
    out = out.withColumn("__left", F.when(F.size("__dropped") == 0, F.col("text")).otherwise(left))
    has_word = lambda c: c.rlike(r"[^\x20\x09-\x0D]")
    out = out.filter((F.size("__dropped") == 0) | has_word(F.col("__left")) | ~has_word(text)).withColumn("text", F.col("__left"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
