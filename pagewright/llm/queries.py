"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extraction, lines, mixing, neardup, neighbours, pieces, quality, sharding, surrogates, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are: ``PAGEWRIGHT_TOKENIZERS``, or the installed package."""
    if folder := os.environ.get("PAGEWRIGHT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), out_ids=None)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).drop("g1", "g2")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A fresh key, unless the session names one: surrogates of one run can't be told from outside.
    key = spark.conf.get("spark.pagewright.surrogate.key", None) or secrets.token_hex(32)
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(docs, rules).select("doc_id", *columns)


def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op5_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op6_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken_words(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


# Written apart from the operator: a draw is a fold over a list, a pass of the permutation a fold over structs.
_LEHMER = "list_reduce([({x}) % 2147483647, {c}, 2 * {c}, 3 * {c}], lambda s, d: ((s + d) * 48271) % 2147483647)"


def _pass(x: str, key: str) -> str:
    lehmer = lambda v, c: _LEHMER.format(x=v, c=c)
    left = f"((s.l + {lehmer(f's.r + {key}', '((e.k + 1) * 7919)')}) % a)"
    right = f"((s.r + {lehmer(f'{left} + {key}', '((e.k + 11) * 7919)')}) % b)"
    folded = f"list_reduce([{{'l': {x} % a, 'r': {x} // a, 'k': -1}}] || list_transform(range(3), lambda k: {{'l': 0::BIGINT, 'r': 0::BIGINT, 'k': k}}), lambda s, e: {{'l': {left}, 'r': {right}, 'k': e.k}})"
    return f"list_transform([{folded}], lambda z: z.l + a * z.r)[1]"


OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s
), w AS (
  SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM r
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM w
), t AS (
  SELECT *, CASE WHEN level * weight >= cap THEN cap::DOUBLE
    ELSE (max(CASE WHEN level * weight < cap THEN level END) OVER ()) * weight END AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.rank, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY t.rank ORDER BY {_LEHMER.format(x="abs(coalesce(d.doc_id, 0) % 2147483647)", c="63352")} % ceil(t.n_docs / 4096)::BIGINT, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT rank, source_size, source_size // 1024 AS whole, ceil(source_size / 1024)::BIGINT AS blocks, round(target)::BIGINT AS words FROM t WHERE source_size > 0
), e AS (
  SELECT *, words // source_size AS epochs, words % source_size AS rest FROM c
), e2 AS (
  SELECT *, epochs * blocks + ceil(rest / 1024)::BIGINT AS slots FROM e
), e3 AS (
  SELECT *, (sum(slots) OVER (ORDER BY rank))::BIGINT - slots AS first, (sum(slots) OVER ())::BIGINT AS n FROM e2
), e4 AS (
  SELECT *, ceil(n / greatest(64, ceil(n / 8192)))::BIGINT AS shard_size FROM e3
), g AS (
  SELECT *, first + unnest(range(slots)) AS point FROM e4
), deal AS (
  SELECT rank, point, n, ceil(sqrt(n::DOUBLE))::BIGINT AS a, ceil(n / ceil(sqrt(n::DOUBLE)))::BIGINT AS b, point AS x, 0 AS step FROM g
  UNION ALL
  SELECT rank, point, n, a, b, {_pass("x", "8")} AS x, step + 1 FROM deal WHERE step = 0 OR x >= n
), dealt AS (
  SELECT g.*, deal.x // shard_size AS shard, deal.x % shard_size AS place FROM g JOIN deal ON deal.point = g.point AND deal.step > 0 AND deal.x < g.n
), f AS (
  SELECT *, row_number() OVER (PARTITION BY rank ORDER BY shard, place) - 1 AS number FROM dealt
), h AS (
  SELECT *, number // blocks AS epoch, number % blocks AS slot, greatest(ceil(sqrt(whole::DOUBLE))::BIGINT, 1) AS a,
    greatest(ceil(whole / greatest(ceil(sqrt(whole::DOUBLE)), 1))::BIGINT, 1) AS b FROM f
), walk AS (
  SELECT rank, number, whole, a, b, rank * 1009 + epoch * 9176 + 7 AS k, slot AS x, 0 AS step FROM h WHERE slot < whole
  UNION ALL
  SELECT rank, number, whole, a, b, k, {_pass("x", "k")} AS x, step + 1 FROM walk WHERE step = 0 OR x >= whole
), b AS (
  SELECT h.rank, h.shard, coalesce(walk.x, h.slot) AS block, CASE WHEN epoch < epochs THEN least(1024, source_size - coalesce(walk.x, h.slot) * 1024)
    ELSE least(1024, source_size - coalesce(walk.x, h.slot) * 1024, rest - slot * 1024) END AS words
  FROM h LEFT JOIN walk ON walk.rank = h.rank AND walk.number = h.number AND walk.step > 0 AND walk.x < walk.whole
), x AS (
  SELECT rank, start, size, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) AS block FROM p WHERE size > 0
), y AS (
  SELECT x.rank, x.start, sum(greatest(0, least(x.start + x.size - x.block * 1024, b.words) - greatest(x.start - x.block * 1024, 0)))::BIGINT AS taken,
    list_sort(list_distinct(list(b.shard) FILTER (WHERE b.words > greatest(x.start - x.block * 1024, 0)))) AS shards
  FROM x JOIN b ON x.rank = b.rank AND x.block = b.block GROUP BY x.rank, x.start
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(y.taken, 0)::BIGINT AS taken, coalesce(y.shards, []::BIGINT[])::BIGINT[] AS shards
FROM p LEFT JOIN y ON p.rank = y.rank AND p.start = y.start AND p.size > 0
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    params = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, params).select("doc_id", "held_out", "score", "predicted")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", "dropped", "kept_in", "shared")


QUERIES = {"op1_bagminhash": op1_bagminhash, "op2_surrogates": op2_surrogates, "op3_decision_list": op3_decision_list, "op4_adaptive_scan": op4_adaptive_scan, "op5_vector_sharding": op5_vector_sharding, "op6_block_mixing": op6_block_mixing, "op7_piece_encoding": op7_piece_encoding, "op8_toxicity": op8_toxicity, "op9_main_text": op9_main_text, "op10_line_edit_join": op10_line_edit_join}

ORACLES: dict[str, str] = {"op6_block_mixing": OP6_SQL}
