import random

import public_tokenizers
import sentencepiece
from edge import edge_docs, edge_rows, empty_docs, prose, with_clashes
from tokenizers import Tokenizer, models, pre_tokenizers

from gridpv.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library():
    """The unigram tokenizer of the public library over the same pieces and scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    out = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.SPACE, prepend_scheme="always", split=True)
    return out


def test_counts_match_the_library():
    rnd = random.Random(8)
    exact, counter = library(), tc.Counter(tc.read_pieces(PATH))
    alphabet = " \n\t▁abcdefgthein.,é中😀़\x85\xa0"
    texts = ["", " ", "  ", "▁", "a  b ", prose(1, 3000)] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        assert counter.count(t) == len(exact.encode(t, add_special_tokens=False).ids), repr(t)


def test_ties_keep_the_longest_last_piece():
    """Equal scores: "ab"+"c" and "a"+"bc"; the second ends in the longer piece, both count 2;
    "abc" in one piece has the same score as three letters."""
    scores = {"a": -1.0, "b": -1.0, "c": -1.0, "abc": -3.0, "ab": -2.0, "bc": -2.0}
    own = tc.Counter(list(scores.items()))
    exact = Tokenizer(models.Unigram(list(scores.items()), unk_id=None, byte_fallback=False))
    for t in ("abc", "abcabc", "ab", "abab", "bcab", "ccab"):
        assert own.segment(t) == len(exact.encode(t).ids)


def test_edge_rows(spark):
    exact = library()
    rows = tc.count_tokens(with_clashes(edge_docs(spark)), PATH).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert r["n_tokens"] == len(exact.encode(r["text"] or "", add_special_tokens=False).ids)
    assert tc.count_tokens(empty_docs(spark), PATH).count() == 0
