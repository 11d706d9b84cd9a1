"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

Texts are cut by the tokenizer's pattern. Pieces not met before in this worker are put, by length, into padded
numpy matrices of byte tokens; in every round each row merges its leftmost pair of minimum rank, found through a
hash table of pairs, and rows without a pair left are taken out (compaction). Pieces over ``WIDE`` bytes are merged
one at a time, a bucket of one row each, whose length costs no square of matrix cells: all places of the minimum pair at
once where that gives the same result as one after another.

Results for odd input: no rows in, no rows out; null and empty texts have no ids and decode to nothing; a text may be
of any length; repeated rows give repeated results; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import only, release, sized_slices, table

NONE = np.uint32(0xFFFFFFFF)
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
WIDE = WIDTHS[-1]
#: Pieces that a worker remembers; beyond it starts afresh. It changes no result.
REMEMBER = 100_000


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, value = (np.array(x, np.uint64) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) * 3
        self.bits = max(4, int(4 * len(found)).bit_length())
        self.key = np.full(1 << self.bits, ~np.uint64(0))
        self.value = np.full(1 << self.bits, NONE, np.uint32)
        keys = left << np.uint64(32) | right
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.key[slot[todo]] == ~np.uint64(0)
            _, first = np.unique(slot[todo], return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            put = todo[free & wins]
            self.key[slot[put]], self.value[slot[put]] = keys[put], value[put].astype(np.uint32)
            todo = todo[~(free & wins)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they don't merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot, out = self._slot(keys), np.full(keys.shape, NONE, np.uint32)
        open_ = np.arange(keys.size)
        keys, slot, flat = keys.ravel(), slot.ravel(), out.ravel()
        for _ in range(self.probes):
            at = self.key[slot[open_]]
            hit = at == keys[open_]
            flat[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (at != ~np.uint64(0))]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)


def latin_pattern(pattern: str) -> re.Pattern | None:
    """For the public pattern: its meaning on code points below U+0250, for Python's faster matcher."""
    if pattern != r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
        return None
    of = lambda kind: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)
    letter, number, space = of("L"), of("N"), "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = PairTable(self.ranks)
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.uint32)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.any_text = regex.compile(pattern)
        self.latin = latin_pattern(pattern)
        self.beyond_latin = re.compile("[ɐ-\U0010ffff]")
        self.known: dict[str, tuple[bytes, str]] = {}

    def pieces(self, text: str) -> list[str]:
        if self.latin and not self.beyond_latin.search(text):
            return self.latin.findall(text)
        return self.any_text.findall(text)

    def merge_matrix(self, tok: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """tok: padded rows of ids; returns the ids of each row after all merges."""
        out: list = [None] * len(tok)
        rows = np.arange(len(tok))
        col = np.arange(tok.shape[1] - 1)
        rank = np.where(col < (length - 1)[:, None], self.pairs.get(tok[:, :-1], tok[:, 1:]), NONE)
        while len(rows):
            j = rank.argmin(1)
            i = np.arange(len(rows))
            new = rank[i, j]
            done = new == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[rows[r]] = tok[r, : length[r]].copy()
                live = ~done
                rows, tok, rank, length, j, new = rows[live], tok[live], rank[live], length[live], j[live], new[live]
                if not len(rows):
                    break
                most = int(length.max())
                tok, rank = tok[:, :most], rank[:, : most - 1]
                i = np.arange(len(rows))
            width = tok.shape[1]
            tok[i, j] = new
            from_ = np.minimum(np.arange(width) + (np.arange(width) > j[:, None]), width - 1)
            tok = np.take_along_axis(tok, from_, 1)
            rank = np.take_along_axis(rank, np.minimum(from_[:, : width - 1], width - 2), 1) if width > 2 else rank
            rank[:, -1] = NONE if width > 1 else rank[:, -1]
            length = length - 1
            for at, ok in ((j - 1, j > 0), (j, j + 1 < length)):
                k = i[ok]
                rank[k, at[ok]] = self.pairs.get(tok[k, at[ok]], tok[k, at[ok] + 1])
            k = i[j + 1 >= length]
            rank[k, np.minimum(j[k], rank.shape[1] - 1)] = NONE
        return out

    def merge_long(self, tok: np.ndarray) -> np.ndarray:
        while len(tok) > 1:
            rank = self.pairs.get(tok[:-1], tok[1:])
            new = rank.min()
            if new == NONE:
                break
            at = np.flatnonzero(rank == new)
            if len(at) > 1:  # of overlapping places (only where both ids are equal) the leftmost count, then every second
                run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
                together = tok.copy()
                together[at] = new
                keep = np.ones(len(tok), bool)
                keep[at + 1] = False
                together = together[keep]
                around = np.flatnonzero(together == new)
                first = np.array([tok[at[0]]], np.uint32)
                fresh = [self.pairs.get(together[around[around > 0] - 1], together[around[around > 0]]), self.pairs.get(together[around[around + 1 < len(together)]], together[around[around + 1 < len(together)] + 1]), self.pairs.get(np.array([new], np.uint32), first)]
                if min((int(x.min()) for x in fresh if len(x)), default=int(NONE)) > int(new):
                    tok = together
                    continue
                at = at[:1]
            tok = np.concatenate([tok[: at[0]], [new], tok[at[0] + 2 :]]).astype(np.uint32)
        return tok

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces aren't empty."""
        out: list = [None] * len(pieces)
        size = np.array([len(p) for p in pieces])
        low = 0
        for width in WIDTHS:
            every = np.flatnonzero((size > low) & (size <= width))
            low = width
            step = max(1, (1 << 18) // width)
            for at in range(0, len(every), step):
                some = every[at : at + step]
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in some), np.uint8).reshape(-1, width)
                for i, ids in zip(some, self.merge_matrix(self.byte_id[raw], size[some]), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > WIDE):
            out[i] = self.merge_long(self.byte_id[np.frombuffer(pieces[i], np.uint8)])
        return out

    def learn(self, pieces: set[str]) -> dict[str, tuple[bytes, str]]:
        if len(self.known) + len(pieces) > REMEMBER:  # frequent pieces came early: forget the later half
            for p in list(itertools.islice(reversed(self.known), len(self.known) // 2)):
                del self.known[p]
        new = list(pieces)
        ids = self.encode_pieces([p.encode() for p in new])
        fresh = {p: (x.astype("<u4").tobytes(), " ".join(map(str, x.tolist()))) for p, x in zip(new, ids, strict=True)}
        self.known.update(fresh)
        return fresh

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """For each text its ids, and the same as decimals joined by spaces."""
        cut = [self.pieces(t) for t in texts]
        got = [list(map(self.known.get, pieces)) for pieces in cut]
        lacking = {p for pieces, have in zip(cut, got, strict=True) if None in have for p, x in zip(pieces, have, strict=True) if x is None}
        if lacking:
            fresh = self.learn(lacking)
            got = [[x or fresh[p] for p, x in zip(pieces, have, strict=True)] if None in have else have for pieces, have in zip(cut, got, strict=True)]
        out = []
        for have in got:
            ids, said = zip(*have, strict=True) if have else ((), ())
            out.append((np.frombuffer(b"".join(ids), "<u4"), " ".join(said)))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered from one array of all tokens' bytes."""
        size = self.token_len[ids]
        start = self.token_at[ids] - (np.cumsum(size) - size)
        return self.token_bytes[np.repeat(start, size) + np.arange(size.sum())].tobytes()


@functools.lru_cache(2)
def loaded(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def encode_column(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<long>) of each row of ``docs`` (doc_id, text)."""

    def rows(batches):
        bpe = loaded(rank_file, pattern)
        for piece in sized_slices(batches, "text", 1 << 20):
            ids = [x[0].astype(np.int64) for x in bpe.encode([t or "" for t in piece.column("text").to_pylist()])]
            ends = np.cumsum([0, *map(len, ids)])
            values = pa.array(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "ids"])
        release()

    return only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, ids array<long>")


def encode_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, the latter from the ids, of each row of ``docs``."""

    def rows(batches):
        bpe = loaded(rank_file, pattern)
        for piece in sized_slices(batches, "text", 1 << 20):
            n, a, b = [], [], []
            for ids, said in bpe.encode([t or "" for t in piece.column("text").to_pylist()]):
                n.append(len(ids))
                a.append(hashlib.sha256(said.encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
