import functools

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meetspark.llm import tokens

ODD = ["", " ", "a ", " x", "a  b", "a\n b", "don't  do\tit \n\n q ", "\x1c a", "é\x85 b", "x <|endoftext|> y<|endoftext|>z", "<|endoftext|> <|endoftext|>", "日本語 テキスト", "a" * 5000, "b c " * 30000, "퟿ 😀  😀", "a b. c, d### e!!! .. x1. 's. don't. é. ª. 2. f. <|endoftext|>. a<|endoftext|>, .. b", " ," * 9]


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokens.resolve(tokens.TOKENIZER))


def test_ids_are_those_of_the_library(library):
    encoder = tokens.encoder_of(tokens.TOKENIZER)
    want = [library.encode(x, add_special_tokens=False).ids for x in ODD * 2]
    assert [x.tolist() for x in encoder.ids(pa.array(ODD * 2))] == want
    assert encoder.counts(pa.array(["x", *ODD, *ODD])[1:]).tolist() == list(map(len, want))
    assert [len(x) for x in encoder.ids(pa.array([None, "a"]))] == [0, 1] and list(encoder.ids(pa.array([], pa.string()))) == []


@given(st.lists(st.lists(st.sampled_from([*"abZ09 .,'-_()\n\t\x00éß½ª°“…日😀Ω", "'s", "'ll", "<|endoftext|>", "\u0301", "\xa0", "\u2028"]), max_size=12).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_of_texts_of_all_kinds_of_characters(texts):
    encoder = tokens.encoder_of(tokens.TOKENIZER)
    assert [x.tolist() for x in encoder.ids(pa.array(texts, pa.string()))] == [x.ids for x in _plain().encode_batch(texts, add_special_tokens=False)]


@functools.cache
def _plain():
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokens.resolve(tokens.TOKENIZER))


def test_memory_is_bounded_and_harmless(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 5)
    monkeypatch.setattr(tokens, "MEMO_PARTS", 5)
    encoder = tokens.Encoder(tokens.TOKENIZER)
    texts = [f"word{i} and word{i % 3} again" for i in range(50)]
    for text in texts:
        assert encoder.counts(pa.array([text])).tolist() == [len(library.encode(text).ids)]
    assert len(encoder.memo) < 20 and len(encoder.parts) < 20 and encoder.pool.runs < 60


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(name):
    encoder = tokens.encoder_of(name)
    texts = ["Hello  World", "", "a b c"]
    if name.endswith(".json"):
        import tokenizers

        plain = tokenizers.Tokenizer.from_file(tokens.resolve(name))
        want = [len(plain.encode(x, add_special_tokens=False).ids) for x in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=tokens.resolve(name)).encode(texts)]
    assert encoder.counts(pa.array(texts)).tolist() == want


def test_count_tokens_of_odd_tables(spark, library):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(None, "a b"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted(tuple(r) for r in tokens.count_tokens(docs).na.fill(-1).collect())
    want = sorted((-1 if i is None else i, len((x or "").encode()), n := len(library.encode(x or "").ids), n > 1024) for i, x in rows)
    assert got == want
    assert tokens.count_tokens(docs.limit(0)).collect() == []
