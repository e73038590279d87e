import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from tapeloom.llm import bpe_stream, token_counts, token_store, vocab

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def _ids(path, texts):
    return [e.ids for e in vocab.tokenizer(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def _words(ids):
    return np.array(ids, "<u4").tobytes()


@given(hs.lists(hs.integers(0, 2**32 - 1), max_size=70))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(values):
    assert token_store.unpack(*token_store.pack(np.array(values, np.uint32)), len(values)).tolist() == values


def test_one_to_four_bytes_a_value():
    control, data = token_store.pack(np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1]))
    assert (len(control), len(data)) == (2, 1 + 1 + 2 + 2 + 3 + 4 + 4)


def test_counts_equal_the_library(odd):
    rows = odd.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(i), len(i) > 50) for r, i in zip(rows, _ids(WORD, [r["text"] for r in rows]), strict=True)), key=str)
    assert sorted(map(tuple, token_counts.count_tokens(odd, WORD, 50).collect()), key=str) == want


def test_counts_of_a_sentencepiece_file(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    texts = ["", "the cat  sat", None, "été 日本\n<s> </s>"]
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert got == {k: len(own.encode(t or "")) for k, t in enumerate(texts)}


def test_long_texts_are_split_at_white_space():
    enc = vocab.encoder(WORD)
    text = ("Some words, and (more) of them. " * 400).encode()
    data = np.frombuffer(text, np.uint8)
    whole = enc.encode(data, np.array([0, len(data)]), ids=False)[1][0]
    assert token_counts.lengths(enc, data, np.array([0, len(data)]), limit=101)[0] == whole == len(_ids(WORD, [text.decode()])[0])


def test_store_reads_back_in_order(spark, odd, tmp_path):
    path = str(tmp_path / "store")
    token_store.write(odd, path, WORD, 1, vocab_size=49_408, parts=3)
    got = token_store.read(spark, path).collect()
    rows = odd.select("doc_id", "text").collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], _words([*i, 1])) for r, i in zip(rows, _ids(WORD, [r["text"] for r in rows]), strict=True))
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in rows], key=lambda x: -1 if x is None else x)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()


def test_digest_checksums(spark, odd):
    rows = odd.filter("doc_id = 9").select("text").collect()
    want = zlib.crc32(_words([*_ids(WORD, [rows[0]["text"]])[0], 1]))
    assert {r["ids_crc32"] for r in token_store.digest(spark, odd, WORD, 1, 49_408).filter("doc_id = 9").collect()} == {want}


def test_empty_tables(spark, none, tmp_path):
    assert token_counts.count_tokens(none, WORD).count() == 0
    assert bpe_stream.digest(none, BYTE).count() == 0
    token_store.write(none, str(tmp_path / "e"), WORD, 1, vocab_size=49_408)
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0


def test_stream_equals_the_library(odd):
    rows = odd.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], len(i), hashlib.sha256(_words(i)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r, i in zip(rows, _ids(BYTE, [r["text"] for r in rows]), strict=True)), key=str)
    assert sorted(map(tuple, bpe_stream.digest(odd, BYTE).collect()), key=str) == want


def test_encode_decode_round_trip(odd):
    got = bpe_stream.decode(bpe_stream.encode(odd, BYTE), BYTE)
    want = sorted(((r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_and_long_runs(seed):
    r = random.Random(seed)
    t = bpe_stream.transducer(BYTE)
    texts = ["".join(r.choice("abthein  \n\té日.!'sl0\x85 　") for _ in range(r.randint(0, 80))) for _ in range(400)]
    texts += ["".join(r.choice("abcdetnhi") for _ in range(3000)), "the" * 900, " " * 700, "!?" * 900]
    assert t.encode(texts) == [_words(i) for i in _ids(BYTE, texts)]


def test_a_small_block_gives_the_same_tokens(monkeypatch):
    monkeypatch.setattr(bpe_stream, "BLOCK", 3)
    t = bpe_stream.transducer(BYTE)
    word = b"internationalizationofthethings" * 30
    assert t._streams([word]) == [_words(_ids(BYTE, [word.decode()])[0])]


def test_lookahead_of_small_lists():
    # ab; then (ab)c: a "c" after "ab" changes a token two bytes back
    assert bpe_stream.sufficient_lookahead([0, 3], [1, 2], [3, 4], {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}, {0, 1, 2}) == 2
    # bc; then a(bc): what follows "b" decides whether "a" merges, two bytes back
    assert bpe_stream.sufficient_lookahead([1, 0], [2, 3], [3, 4], {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}, {0, 1, 2}) == 2
    with pytest.raises(ValueError):
        bpe_stream.sufficient_lookahead([5], [1], [6], {}, {0, 1})


def test_decoder_is_incremental_and_replaces_broken_bytes():
    t = bpe_stream.transducer(BYTE)
    r = random.Random(4)
    ids = [r.randrange(50_257) for _ in range(3000)]
    want = vocab.tokenizer(BYTE).decode(ids, skip_special_tokens=False)
    assert "".join(t.decode_stream(ids)) == t.decode(_words(ids), block=7) == want


def test_blocks_of_many_empty_documents(spark, tmp_path):
    """200,000 null texts are one token each; a block holds them without adding up their sizes again and again."""
    import time

    docs = spark.range(200_000).selectExpr("id as doc_id", "cast(null as string) as text")
    began = time.time()
    token_store.write(docs, str(tmp_path / "nulls"), WORD, 1, vocab_size=49_408, parts=1)
    got = token_store.read(spark, str(tmp_path / "nulls"))
    assert got.count() == 200_000 and got.agg({"start": "max"}).first()[0] == 199_999
    assert time.time() - began < 60


def test_rows_without_an_id_are_dealt_out(spark, tmp_path):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    token_store.write(docs, str(tmp_path / "s"), WORD, 1, vocab_size=49_408, parts=3)
    blocks = spark.read.parquet(str(tmp_path / "s") + "/blocks")
    assert blocks.select("part").distinct().count() == 3 and token_store.read(spark, str(tmp_path / "s")).count() == 3000


def test_tables_of_results_are_deleted_when_the_caller_is_done(spark, odd):
    from tapeloom.llm import packing, prefix_trie, scratch

    before = len(scratch._KEPT)
    talk = spark.createDataFrame([(20, 0, "user", "a b")], "conv_id long, turn long, role string, text string")
    with scratch.kept():
        assert packing.pack(odd, BYTE).count() and prefix_trie.shared(talk).count() == 2
        made = scratch._KEPT[before:]
        assert made
    assert len(scratch._KEPT) == before
    for t in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.path)
        assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
