import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm.pieces import Encoder, encode_documents, read_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENC = Encoder(read_model(PATH))


@pytest.mark.parametrize("text", ["", " ", "  a  b", "▁x", "a▁b", "a\tb\nc", "\x00ab", "<s>hello</s>", "<0x41>", " " * 40, "a" + " " * 33 + "b", "\n\n  \n x", "É́ 日本語 😀 ok", "x" * 500, "the the", "�　"])
def test_same_as_the_library(text):
    assert ENC.encode(text) == LIB.encode(text)
    assert ENC.decode(ENC.encode(text)) == LIB.decode(LIB.encode(text)) == ENC.decode_parts(ENC.encode_parts(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefghinorst .,\n\t▁éßñ#$%&*日😀A1"), max_size=60))
def test_random_texts(text):
    assert ENC.encode(text) == LIB.encode(text)
    assert ENC.decode_parts(ENC.encode_parts(text)) == LIB.decode(LIB.encode(text))


def test_table(spark):
    texts = [(1, "Hello there"), (2, None), (3, ""), (1, "Hello there"), (4, "schön " * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    rows = encode_documents(docs, PATH).collect()
    assert len(rows) == 5
    for r in rows:
        ids = LIB.encode(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    assert encode_documents(docs.limit(0), PATH).count() == 0
