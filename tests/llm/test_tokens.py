import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factsheet.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = tokens.Encoder(PATH)
PLAIN = Tokenizer.from_file(PATH)


@given(st.lists(st.integers(0, (1 << 24) - 1), max_size=70), st.integers(1, 24))
def test_pack_round_trip(ids, width):
    ids = np.array([i % (1 << width) for i in ids], np.uint32)
    assert tokens.unpack(tokens.pack(ids, width), width, len(ids)).tolist() == ids.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aé'sßΣİ1²\x1c\x85́ .!-<|>ſ\n", max_size=30)), max_size=4))
def test_words_alone_give_the_ids_of_the_text(texts):
    ids, ends = ENCODER.encode(texts, 1)
    expected = [PLAIN.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == expected


@pytest.mark.parametrize("text", ["straße", "Größe's aß ßa", "éß1ßs", "ÀÖØ öøÿ a×b÷c", "\x00\x7fa"])
def test_every_latin_letter_is_one(text):
    assert ENCODER.encode([text], 1)[0].tolist()[:-1] == PLAIN.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_text_as_the_library_reads_them():
    text = "a <|endoftext|> b<|startoftext|>c it's O'Clock"
    assert ENCODER.encode([text], 1)[0].tolist()[:-1] == PLAIN.encode(text, add_special_tokens=False).ids


def test_shard_random_access():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49408, 20_000).astype(np.uint32)
    ends = np.array([5, 5, 9000, 20_000])
    shard = tokens.Shard(tokens.shard_bytes([1, 2, 3, 4], ends, ids, 16))
    assert [shard.document(k).tolist() for k in range(4)] == [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
    assert shard.ids(8190, 8195).tolist() == ids[8190:8195].tolist()


ROWS = [(3, "Hi there", "x"), (None, "no id", "y"), (1, None, "z"), (2, "", "w"), (3, "Hi there", "x"), (9, "word " * 40_000, "l")]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_documents_from_the_files(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    tokens.write_tokens(docs, str(tmp_path / "t"), PATH)
    found = tokens.document_digests(tokens.read_tokens(spark, str(tmp_path / "t"))).collect()
    got = sorted([(r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found], key=lambda r: r[2])
    at, expected = 0, []
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        expected.append((key is not None, key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected
