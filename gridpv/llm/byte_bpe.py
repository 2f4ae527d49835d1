"""Byte-level BPE encoding and decoding.

Method: two tiers.  A minimal perfect hash over the vocabulary resolves each pre-token that is a
whole vocabulary entry; the others are merged with a heap over a linked list of their bytes.

The vocabulary is a rank file (base64 token, space, rank per line); its path is a parameter, the
driver reads it and sends the tables to the tasks as one broadcast, whose size is that of the
vocabulary.  Texts are cut at spaces into chunks first, which no match of the pre-token
pattern crosses; each distinct chunk of a slice is encoded once, and a bounded memo keeps
the recent short ones.  A null text is an empty one and gives no ids.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.llm.common import add_columns, mix, read_table, slices, span_hashes

#: Chunks and pre-tokens that a worker remembers between slices, and the characters of the longest.
MEMO = 600_000
LONGEST = 64
#: Pre-tokens that are merged together.
MERGED = 1_000
#: Bytes of text in a slice.
SLICE = 1 << 19
#: White space as the pre-token pattern treats it: a chunk is a run of other characters with at
#: most one space before it, or white space that no such run takes.
CHUNK = r" ?\S+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank.  Ranks have to be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"{path}: ranks are not 0 to {len(pairs) - 1}")
    return tokens


def bytes_hashes(items: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in items], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(items), np.uint8), ends - [len(x) for x in items], ends)


class PerfectHash:
    """Maps each of ``n`` keys to its own slot of ``n`` (hash and displace).

    Keys fall into buckets; larger buckets first, each looks for a displacement that sends its
    keys to free slots.  Buckets of one key name a free slot directly, as a negative number.
    """

    def __init__(self, shift: np.ndarray, key_at: np.ndarray):
        self.shift, self.key_at = shift, key_at
        self.buckets, self.size = len(shift), len(key_at)

    @classmethod
    def build(cls, keys: list[bytes], per_bucket: int = 4) -> PerfectHash:
        hashes = bytes_hashes(keys)
        n = len(keys)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys repeat")
        self = cls(np.zeros(max(1, n // per_bucket), np.int64), np.zeros(n, np.int64))
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(first)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[first[b] : first[b + 1]]
            if len(own) < 2:
                break
            tried = 0
            while True:
                steps = np.arange(tried, tried + 256)
                slots = self._slots(hashes[own][None, :], steps[:, None])
                fits = free[slots].all(axis=1)
                ranked = np.sort(slots, axis=1)
                fits &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if fits.any():
                    at = int(np.argmax(fits))
                    self.shift[b] = steps[at]
                    free[slots[at]] = False
                    self.key_at[slots[at]] = own
                    break
                tried += 256
        lone = np.flatnonzero(sizes == 1)
        slots = np.flatnonzero(free)
        self.shift[lone] = -1 - slots
        self.key_at[slots] = order[first[lone]]
        return self

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        moved = mix(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (moved % np.uint64(self.size)).astype(np.int64)

    def candidates(self, items: list[bytes]) -> np.ndarray:
        """For each item the only key that it can be."""
        hashes = bytes_hashes(items)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0)))
        return self.key_at[slots]


def join_parts(piece: bytes, ranks: dict[bytes, int], ids: list[int], joint: list[int], heap: list[int], shift: int) -> list[int]:
    """Ids of one pre-token: join the neighbours of least rank, leftmost first, until none joins.

    ``ids`` are those of its bytes (-1 for none), ``joint`` has for the part that starts at a place the heap's entry
    of that part and the next one as one token (``id << shift | place``), or -1.
    """
    n = len(piece)
    low = (1 << shift) - 1
    get = ranks.get
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))
    while heap:
        x = heappop(heap)
        i = x & low
        if joint[i] != x:
            continue  # one of the two has grown since
        j = after[i]
        after[i] = end = after[j]
        ids[i] = x >> shift
        joint[i] = joint[j] = -1
        if end < n:
            before[end] = i
            if (r := get(piece[i : after[end]])) is not None:
                joint[i] = x = r << shift | i
                heappush(heap, x)
        if i:
            k = before[i]
            if (r := get(piece[k:end])) is not None:
                joint[k] = x = r << shift | k
                heappush(heap, x)
            else:
                joint[k] = -1
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    if -1 in out:
        raise KeyError(piece)  # the vocabulary lacks one of its bytes
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``join_parts`` for a pre-token of any length."""
    shift = len(piece).bit_length()
    found = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
    joint = [-1 if r is None else r << shift | i for i, r in enumerate(found)] + [-1]
    ids = [ranks.get(piece[i : i + 1], -1) for i in range(len(piece))]
    return join_parts(piece, ranks, ids, joint, sorted(x for x in joint if x >= 0), shift)


class Vocabulary:
    """The tables of a rank file: tokens by id, ranks by token, and the perfect hash."""

    def __init__(self, tokens: list[bytes], hashing: PerfectHash | None = None):
        self.tokens = tokens
        self.hash = hashing or PerfectHash.build(tokens)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.ends = np.cumsum([len(t) for t in tokens])
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.full(256, -1)  # ids by byte, and by two bytes
        self.double = np.full(1 << 16, -1)
        for i in np.flatnonzero(self.sizes <= 2).tolist():
            t = tokens[i]
            if len(t) == 1:
                self.single[t[0]] = i
            else:
                self.double[t[0] << 8 | t[1]] = i

    def send(self, spark: SparkSession):
        """A broadcast from which tasks restore the vocabulary (``received``)."""
        return spark.sparkContext.broadcast((self.tokens, self.hash.shift, self.hash.key_at))

    @classmethod
    def received(cls, sent) -> Vocabulary:
        tokens, shift, key_at = sent.value
        return cls(tokens, PerfectHash(shift, key_at))

    def merge_all(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """``merge`` for many pre-tokens of up to 256 bytes, whose pairs of bytes are looked up together."""
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = self.double[data << 8 | np.append(data[1:], 0)]
        rank[ends - 1] = -1
        entry = np.where(rank < 0, -1, rank << 8 | np.arange(len(data)) - (ends - sizes)[owner])
        some = rank >= 0
        entries = (np.sort(owner[some] << 32 | entry[some]) & 0xFFFFFFFF).tolist()  # a sorted run is a heap
        ids, joint = self.single[data].tolist(), entry.tolist()
        at = from_ = 0
        for piece, end, to in zip(pieces, ends.tolist(), np.cumsum(np.bincount(owner, some)).astype(int).tolist(), strict=True):
            yield join_parts(piece, self.ranks, ids[at:end], joint[at:end], entries[from_:to], 8)
            at, from_ = end, to

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as 32-bit integers: the perfect hash first, the heap for what it lacks."""
        if not pieces:
            return []
        tokens, ranks = self.tokens, self.ranks
        out = [(c,) if tokens[c] == p else None for p, c in zip(pieces, self.hash.candidates(pieces).tolist(), strict=True)]
        rest = [i for i, ids in enumerate(out) if ids is None]
        short = [i for i in rest if len(pieces[i]) <= 256]
        for i in rest:
            if len(pieces[i]) > 256:
                out[i] = merge(pieces[i], ranks)
        for at in range(0, len(short), MERGED):
            part = short[at : at + MERGED]
            for i, ids in zip(part, self.merge_all([pieces[i] for i in part]), strict=True):
                out[i] = ids
        return [array("i", ids).tobytes() for ids in out]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, end to end."""
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        if not len(ids) or not total[-1]:
            return np.zeros(0, np.uint8)
        return self.blob[np.repeat(self.ends[ids] - total, sizes) + np.arange(total[-1])]


class Encoder:
    """Ids of texts, with a memo of those of their chunks and pre-tokens.

    A chunk starts at each space before a character that isn't white space.  The memo's key of a chunk is the
    chunk without that space; one that starts otherwise gets a space more as its key.  So the
    keys of a text are those of ``split(" ")``, unless white space follows a space.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN, limit: int = MEMO, longest: int = LONGEST):
        self.vocabulary, self.limit, self.longest = vocabulary, limit, longest
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(pattern).findall
        self.find = regex.compile(CHUNK).findall
        # with the public pattern a run of letters, with a space before it or not, is one pre-token
        self.letters = str.isalpha if pattern == public_tokenizers.PATTERN else lambda key: False

    @staticmethod
    def key(chunk: str) -> str:
        return chunk[1:] if chunk[0] == " " and not (chunk[1:2] or " ").isspace() else " " + chunk

    def keys(self, text: str) -> list[str]:
        """Keys of the chunks of a text whose white space may come in runs."""
        return [self.key(c) for c in self.find(text)]

    def fill(self, new: Iterable[str]) -> list[str]:
        """Put the ids of the chunks with these keys into the memo; returns the keys that are too long to stay."""
        known, letters, split = self.known, self.letters, self.split
        pieces: dict[str, str] = {}
        compound = []
        for k in new:
            chunk = k[1:] if k[0] == " " else " " + k
            if letters(k):
                pieces[k] = chunk
                continue
            parts = split(chunk)
            if len(parts) == 1:
                pieces[k] = chunk
                continue
            own = [self.key(p) for p in parts]
            compound.append((k, own))
            for x, p in zip(own, parts):
                if x not in known:
                    pieces[x] = p
        known.update(zip(pieces, self.vocabulary.encode_pieces([p.encode() for p in pieces.values()]), strict=True))
        for k, own in compound:
            known[k] = b"".join([known[x] for x in own])
        return [k for k in (*pieces, *(k for k, _ in compound)) if len(k) > self.longest]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Per text its ids, as 32-bit integers end to end."""
        known = self.known
        of, has = known.__getitem__, known.__contains__
        out: list[bytes] = []
        late: list[tuple[int, list[str]]] = []
        new: set[str] = set()
        for text in texts:
            keys = text.split(" ") if text else [""]
            keys[0] = " " + keys[0]
            try:
                out.append(b"".join(map(of, keys)))
            except KeyError:
                lacking = set(filterfalse(has, keys))
                if not all(k and (k[0] == " " or not k[0].isspace()) for k in lacking):  # a space before white space
                    keys = self.keys(text)
                    lacking = set(filterfalse(has, keys))
                new |= lacking
                late.append((len(out), keys))
                out.append(b"")
        long = self.fill(new)
        for at, keys in late:
            out[at] = b"".join(map(of, keys))
        for k in long:
            known.pop(k, None)
        if len(known) > self.limit:
            known.clear()
        return out


def encode(
    docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", ids_col: str = "ids", drop: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` with ``ids_col`` (array of int): the token ids of ``text_col``.  Columns in ``drop`` are left out."""
    sent = Vocabulary(read_ranks(path)).send(docs.sparkSession)
    state: list[Encoder] = []

    def run(batch):
        if not state:
            state.append(Encoder(Vocabulary.received(sent), pattern))
        for part in slices(batch, text_col, SLICE):
            packed = state[0].encode(part.column(text_col).to_pylist())
            offsets = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield part, (pa.ListArray.from_arrays(pa.array(offsets), values),)

    return add_columns(docs, f"`{ids_col}` array<int>", run, drop)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with ``bytes_col`` (binary): the bytes of the token ids in ``ids_col``."""
    sent = Vocabulary(read_ranks(path)).send(docs.sparkSession)
    state: list[Vocabulary] = []

    def run(batch):
        if not state:
            state.append(Vocabulary.received(sent))
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            lists = part.column(ids_col)
            yield part, ([state[0].decode(np.asarray(x.values)).tobytes() if x.is_valid else b"" for x in lists],)

    return add_columns(docs, f"`{bytes_col}` binary", run)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: token count, digest of the ids, digest of the decoded ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs, path, drop=("text",))
    return decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
