import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import tokens

SCHEMA = "doc_id long, text string, ids string, _bucket string, width int"


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def direct(path, texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 0] for e in Tokenizer.from_file(path).encode_batch(list(texts), add_special_tokens=False)]


ODD = ["", " ", "a  b", "a   b\n", "a \n b", "\n \n x", "x ", " x", "a  b", "a\x1c b", "\t\t a", "it's  he'll", "<|endoftext|> x", "日本語 テキスト", "a\r\n b", "  lead", "end \n", "a　 b", "12 34.5%%% !!", "a\n  b", "a  \nb", "  x", "\x85 y z"]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab Z9'.s,\n\t\xa0é—²日ſ\x1c", max_size=30), max_size=6))
def test_any_text_encodes_as_the_library_does(path, texts):
    assert [np.frombuffer(x, "<u2").tolist() for x in tokens.encoder(path).encode_all(texts)] == direct(path, texts)


def test_long_texts_are_cut_before_spaces(path, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 10)
    texts = ["one two three four five six seven", "a" * 50, "x " + "b" * 40 + " y\n z", " lead words in here"]
    assert [np.frombuffer(x, "<u2").tolist() for x in tokens.Encoder(path).encode_all(texts)] == direct(path, texts)


def test_chunks_encode_as_the_library_does(path, spark, small):
    texts = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    got = [np.frombuffer(x, "<u2").tolist() for x in tokens.Encoder(path).encode_all(texts)]
    assert got == direct(path, texts)


def test_chunks_with_equal_hashes_encode_as_the_library_does(path):
    # a Thue-Morse word of 1,024 letters and its complement have one polynomial hash modulo 2^64, whatever the base
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"x {other} y {word}", "plain text", f"{word} {word}"]
    enc = tokens.Encoder(path)
    for batch in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode_all(batch)] == direct(path, batch)


def test_texts_whose_chunks_share_a_key_go_to_the_tokenizer(path, monkeypatch):
    keys = tokens.Encoder._keys

    def few(joined, words, starts, sizes):
        found, long = keys(joined, words, starts, sizes)
        found[long] = np.uint64(1) << np.uint64(63)
        return found, long

    monkeypatch.setattr(tokens.Encoder, "_keys", staticmethod(few))
    texts = ["abcdefgh abcdefghi", "abcdefghi", "short words only", "x" * 90 + "y", "x" * 90 + "z", "abcdefgh"]
    enc = tokens.Encoder(path)
    for batch in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode_all(batch)] == direct(path, batch)


def test_cache_is_forgotten_when_full(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 40)
    enc = tokens.Encoder(path)
    for i in range(5):
        texts = [f"one two{i} three four{i} five", "six seven eight"]
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode_all(texts)] == direct(path, texts)


def test_code_lengths_are_optimal_or_limited():
    counts = np.array([5, 9, 12, 13, 16, 45, 0])
    assert tokens.code_lengths(counts, 10).tolist() == [4, 4, 3, 3, 3, 1, 0]
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    limited = tokens.code_lengths(fib, 5)
    assert limited.max() == 5 and (2.0 ** -limited.astype(float)).sum() <= 1
    assert tokens.code_lengths(np.array([0, 7]), 5).tolist() == [0, 1]
    assert tokens.code_lengths(np.ones(9), 3).max() == 4  # more ids than codes of three bits
    with pytest.raises(ValueError):
        tokens.encode_block([1], [np.zeros(4, np.uint32)], np.zeros(1, np.uint64), np.array([17], np.uint8), 4096)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    docs = [rng.zipf(1.3, n).clip(0, 999).astype(np.uint32) for n in (1, 127, 128, 129, 5000)]
    lengths = tokens.code_lengths(np.bincount(np.concatenate(docs)), 12)
    ids, sizes, flat = tokens.Decoder(lengths).block(tokens.encode_block([1, None, 3, 4, -5], docs, tokens.canonical_codes(lengths), lengths))
    assert ids == [1, None, 3, 4, -5] and sizes.tolist() == [len(d) for d in docs] and (flat == np.concatenate(docs)).all()


def test_matches_brute_force(path, spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(map(tuple, tokens.round_trip(docs, path).collect()))
    start, want = 0, []
    for (doc_id, _), ids in zip(rows, direct(path, [t for _, t in rows]), strict=True):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_edge_rows(path, spark, tmp_path):
    rows = [(7, None, "", "", 1), (None, "null id", "", "", 1), (3, "same", "", "", 1), (3, "same", "", "", 1), (1, "word " * 100_000, "", "", 1)]
    tokens.write_ids(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", path, block_ids=64)
    got = tokens.read_ids(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 3, 3, 7]
    assert got[4].ids == [0] and got[2].ids == got[3].ids
    assert [r.start for r in got] == [sum(len(x.ids) for x in got[:i]) for i in range(5)]
    assert tokens.round_trip(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_rows_of_one_id_have_an_order_of_their_own(path, spark):
    texts = ["one", "two words here", "three of them now", "one", ""]
    rows = [(i, t, "", "", 1) for i in (3, None) for t in texts] + [(-9, "first", "", "", 1), (9, "last", "", "", 1)]
    found = [sorted(map(str, tokens.round_trip(spark.createDataFrame(order, SCHEMA).repartition(n), path).collect())) for order, n in ((rows, 1), (rows[::-1], 3))]
    assert found[0] == found[1] and len(found[0]) == 12
    starts = sorted((r.start, r.n_tokens) for r in tokens.round_trip(spark.createDataFrame(rows, SCHEMA), path).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
