"""The corpus pipeline: five stages from raw documents to token digests.

Every stage is written as Parquet and read again as the input of the next.  In all of them a null text counts
as an empty one, whole texts are read however long, repeated rows and rows without id are documents of
their own, columns beside those named here are carried along, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import lines, mixing, neardup, pieces, toxicity
from pagewright.llm.common import materialize, table
from pagewright.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; empty texts have a score like others, equal texts go or stay together."""
    params = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, params).filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has too, but for a few edits, are cut out of the texts; documents left without a word go.

    Of equal or linked lines that of the smallest id stays, without id the last; blank lines and documents that had no word stay.
    """
    return lines.without_lines(docs, lines.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: one with the smallest id; texts without words are copies only of equal ones."""
    return neardup.keep_one(docs, materialize(neardup.near_duplicates(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: documents are repeated, cut or left out.

    A null source is a source of its own; a document gives a row for each epoch that takes words of it, none at most if it has no word.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids, given by digests, with those of the texts decoded from them; an empty text has no ids."""
    return pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), out_ids=None).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("piece_encoding", encode),
]

#: SQL has no recurrent network, edit join at this size, signature or tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
