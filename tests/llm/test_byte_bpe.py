import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridpv.llm import byte_bpe
from edge import edge_docs, empty_docs, with_clashes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


def test_perfect_hash_is_minimal_and_resolves_every_token(vocabulary):
    found = vocabulary.hash.candidates(vocabulary.tokens)
    assert (found == np.arange(len(vocabulary.tokens))).all()
    assert sorted(vocabulary.hash.key_at.tolist()) == list(range(len(vocabulary.tokens)))


def test_heap_merges_as_the_library_does(vocabulary, library):
    rnd = random.Random(5)
    for _ in range(300):
        piece = "".join(rnd.choice("abcdeéstrin中😀") for _ in range(rnd.randint(1, 30)))
        ids = [i for p in byte_bpe.regex.findall(public_tokenizers.PATTERN, piece) for i in byte_bpe.merge(p.encode(), vocabulary.ranks)]
        assert ids == library.encode_ordinary(piece)
    long = "a" * 30_000
    assert byte_bpe.merge(long.encode(), vocabulary.ranks) == library.encode_ordinary(long)


def test_chunks_never_cut_a_pre_token():
    rnd = random.Random(6)
    for _ in range(3000):
        text = "".join(rnd.choice(" \n\t\r\x0b\x1c\x85 ab'sl1é.,<|") for _ in range(rnd.randint(0, 25)))
        chunks = byte_bpe.regex.findall(byte_bpe.CHUNK, text)
        whole = byte_bpe.regex.findall(public_tokenizers.PATTERN, text)
        assert [p for c in chunks for p in byte_bpe.regex.findall(public_tokenizers.PATTERN, c)] == whole


def test_round_trip_and_ids_on_edge_rows(spark, library):
    docs = with_clashes(edge_docs(spark))
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect()
    assert len(rows) == 16
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["n_words"] == "0"  # other columns stay
    assert byte_bpe.decode(byte_bpe.encode(empty_docs(spark), PATH), PATH).count() == 0


def test_query_digests(spark, library, tmp_path):
    edge_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {(r["doc_id"], r["text"]) for r in edge_docs(spark).collect()}
    want = set()
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r) for r in byte_bpe.op1_byte_bpe(spark, str(tmp_path)).collect()} == want


def test_encoder_is_the_library_on_any_white_space_and_in_any_order(vocabulary, library):
    rnd = random.Random(7)
    encoder = byte_bpe.Encoder(vocabulary, limit=500, longest=8)
    for _ in range(60):
        texts = ["".join(rnd.choice("  \n\t\x1c\x85\u2003ab'sl1é.,<ſ中") for _ in range(rnd.randint(0, 30))) for _ in range(40)]
        texts += [None, "", " ", "  ", "   a", " a", "a ", "a  ", "a \n b", "it's, it 's", "x" * 300 + " é" * 200, "中" * 400]
        got = [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)]
        assert got == [library.encode_ordinary(t or "") for t in texts]


def test_known_chunks_cost_no_pattern_and_no_merge(vocabulary, library, monkeypatch):
    encoder = byte_bpe.Encoder(vocabulary)
    text = " ".join(f"qzx{a}kwv, éü{a}" for a in "abcdefgh") + ".\nEnd"
    first = encoder.encode([text, None])

    def never(*_):
        raise AssertionError("worked again on a known chunk")

    for name in ("find", "split"):
        monkeypatch.setattr(encoder, name, never)
    monkeypatch.setattr(vocabulary, "merge_all", never, raising=False)
    assert encoder.encode([text, None]) == first == [np.array(library.encode_ordinary(text), np.int32).tobytes(), b""]


def test_memo_keeps_no_long_chunks(vocabulary, library):
    encoder = byte_bpe.Encoder(vocabulary, longest=64)
    texts = ["a" * 5_000 + " b", "1" * 65 + "," + "c" * 64]
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert encoder.known and max(map(len, encoder.known)) <= 65


def test_letters_of_python_are_letters_of_the_pattern():
    letters = "".join(c for c in map(chr, range(0x110000)) if c.isalpha())
    assert byte_bpe.regex.fullmatch(r"\p{L}+", letters)


def test_merges_set_up_together_are_those_of_one(vocabulary):
    rnd = random.Random(8)
    pieces = ["".join(rnd.choice("abcdeéstrin中😀") for _ in range(rnd.randint(1, 60))).encode() for _ in range(2_500)]
    pieces += [b"a" * 256, b"a" * 257, b"z"]
    want = [byte_bpe.merge(p, vocabulary.ranks) for p in pieces]
    assert [np.frombuffer(x, np.int32).tolist() for x in vocabulary.encode_pieces(pieces)] == want
    with pytest.raises(KeyError):
        byte_bpe.Vocabulary([b"a", b"b", b"ab"]).encode_pieces([b"ab", b"abc"])
