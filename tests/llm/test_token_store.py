import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from keyloom.llm import token_store
from keyloom.llm.common import scratch
from keyloom.llm.token_store import Encoder, FileWriter, from_planes, read_chunk, read_index, read_tokens, to_planes, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello world", "l'été naïve: don't,we'LL 12a3 ½x. (a)\n\tb", " 's 'tis it''s", "a\u00a0b c\u00add\x1fe", "x<|endoftext|>y <|endoftext|>", "Straße\n„q“ \u0301e ǅ ‿ ٣", " leading", "trailing ", "two  spaces", "a\nb\n\nc \t d", "don't we'll <|endoftext|> end", "Ünïcödé 日本語  x", "x" * 5000, "word " * 3000, "\n", " ", "a \n b"]
SCHEMA = "doc_id bigint, text string, start int, ids string"


def plain_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library():
    encoder = Encoder(PATH)
    assert encoder.by_word and encoder.by_part
    for _ in range(2):  # with an empty and a filled memory
        assert encoder.encode(pa.array(TEXTS)).to_pylist() == plain_ids(TEXTS)


def test_encoder_equals_library_on_signs_in_any_order_and_forgets(monkeypatch):
    rng, signs = random.Random(4), " \n\t'.,ab1Zé½ß-_²\u00a0\u00ad日<|"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 12))) + " " + "".join(rng.choice("abcé'1") for _ in range(6)) for _ in range(3000)]
    monkeypatch.setattr(token_store, "_REMEMBER", 20_000)
    encoder = Encoder(PATH)
    for at in range(0, len(texts), 500):
        assert encoder.encode(pa.array(texts[at : at + 500])).to_pylist() == plain_ids(texts[at : at + 500])
        assert encoder.words.nbytes + encoder.ids.nbytes <= 20_000


def test_texts_are_dealt_by_bytes():
    texts = ["a" * 40, "", "b" * 500, "c" * 30, "d" * 30, "e" * 30, "é" * 20]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + n)), pa.array(texts[k : k + n], pa.string())], ["id", "text"]) for k, n in ((0, 4), (4, 0), (4, 3))]
    dealt = [(i.to_pylist(), t.to_pylist()) for i, t in token_store._by_bytes(iter(batches), 100)]
    assert sum((i for i, _ in dealt), []) == list(range(7)) and sum((t for _, t in dealt), []) == texts
    assert [i for i, _ in dealt] == [[0, 1], [2], [3, 4, 5], [6]]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    for n in (1, 7, 64, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        planes = to_planes(ids, bits)
        assert len(planes) == (32 if bits else 4)
        assert np.array_equal(from_planes(planes, n, bits), ids)


def test_chunks_are_read_on_their_own():
    class Out(io.BytesIO):
        def close(self):
            pass

    out = Out()
    writer = FileWriter(out, 100, False, 3)
    docs = [np.arange(k * 7, dtype=np.uint32) for k in range(20)]
    for k, ids in enumerate(docs):
        writer.add([k], np.array([len(ids)]), ids)
    size = writer.close()
    index = read_index(out, size)
    every = np.concatenate(docs)
    assert np.array_equal(read_chunk(out, index, 3), every[300:400])
    assert np.array_equal(np.concatenate([read_chunk(out, index, k) for k in range(len(index["chunks"]))]), every)
    with pytest.raises(ValueError, match="cut short"):
        read_index(io.BytesIO(out.getvalue()[:-1]), size - 1)


@pytest.mark.parametrize("bits", [False, True])
def test_store_matches_plain_encoding(spark, bits):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)], 1, "x") for i in range(101)] + [(5, "tie", 1, "x"), (5, "tie", 1, "x"), (None, None, None, None)]
    uri = scratch(spark, "t")
    write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(5), uri, PATH, block=256, bits=bits)
    got = sorted(read_tokens(spark, uri).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    plain, at = Tokenizer.from_file(PATH), 0
    left = sorted((r[0] if r[0] is not None else -1, tuple(plain.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        left.remove((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)))
        at += r.n_tokens
    assert not left


def test_empty_table(spark):
    uri = scratch(spark, "t")
    assert write_tokens(spark.createDataFrame([], SCHEMA), uri, PATH).count() == 0
    assert read_tokens(spark, uri).count() == 0
