"""Token counts without tokens: a count-only Viterbi search over a unigram vocabulary.

Method: an Aho-Corasick automaton enumerates the vocabulary pieces that end at each character;
dynamic programming carries the best score and the number of pieces of the path that has it.

The rules are those of the public unigram tokenizers: a space becomes U+2581, one is put before
the text if it doesn't start with it, and each U+2581 starts a new segment.  Scores add up in double
precision.  Where no piece is the single character at a place, the character may be taken as
unknown, at the least score less 10, and counts one token per UTF-8 byte (byte fallback).
Among equal scores the path whose last piece is the longest stays; the unknown character comes last.
The vocabulary is a sentencepiece model file, whose pieces and scores are used as they stand.

Segments do not touch each other, so each distinct one of a batch is counted once and a bounded
memo keeps the recent ones.  A null or empty text has no tokens.
"""

from __future__ import annotations

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from gridpv.llm.common import add_columns, read_table, slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers.
MEMO = 500_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file with their scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Tokens of one segment."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        tokens = [0] * (n + 1)
        best[0] = 0.0
        matches = self.automaton.iter(text)
        end, found = next(matches, (n, None))
        for at in range(n):
            top, start, count = None, at + 1, 0
            while end == at:
                size, score = found
                a = at + 1 - size
                score += best[a]
                if top is None or score > top or score == top and a < start:
                    top, start, count = score, a, tokens[a] + 1
                end, found = next(matches, (n, None))
            if text[at] not in self.single:
                score = best[at] + self.unknown
                if top is None or score > top:
                    top, count = score, tokens[at] + len(text[at].encode())
            best[at + 1], tokens[at + 1] = top, count
        return tokens[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        segments = (text[1:] if text[0] == " " else text).split(" ")
        try:
            return sum(map(self.memo.__getitem__, segments))
        except KeyError:
            if len(self.memo) > MEMO:
                self.memo.clear()
            for s in segments:
                if s not in self.memo:
                    self.memo[s] = self.segment(SPACE + s)
            return sum(map(self.memo.__getitem__, segments))


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out_col`` (long): the tokens of ``text_col`` under the model at ``path``."""
    sent = docs.sparkSession.sparkContext.broadcast(read_pieces(path))
    state: list[Counter] = []

    def run(batch):
        if not state:
            state.append(Counter(sent.value))
        for part in slices(batch, text_col):
            yield part, (pa.array([state[0].count(t) for t in part.column(text_col).to_pylist()], pa.int64()),)

    return add_columns(docs, f"`{out_col}` long", run)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, n_tokens under the pieces of the 32k model."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")
