"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat arrays of symbols.

A text is normalised (a word-begin mark before it, spaces become marks) and cut into words where no piece of the model
could stand. Words not met before in this worker lie one after another in a flat array of symbols. It is cut further
wherever two neighbouring characters stand side by side in no piece, as no merge ever crosses such a place. In each round
the least pair rank of each segment is found (``minimum.reduceat``), its places are merged together from the left, the
array is compacted, and segments without a pair leave. Merging all places of a pair together is the same as one after
another unless a new pair beside them would come before or with it; where one does, only the leftmost is merged.

Only BPE models without a character map, user-defined or unused pieces are taken; others raise ValueError.

Results for odd input: no rows in, no rows out; null and empty texts have only the begin and end ids and decode to
nothing; a text may be of any length; repeated rows give repeated results; a null doc_id stays null.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import NONE, PairTable
from .common import only, sized_slices, table

MARK = "▁"
#: Symbols from here on are characters that stand in no piece.
BEYOND = 1 << 22
#: Words that a worker remembers; beyond it the later half is forgotten. It changes no result.
REMEMBER = 400_000

# The library replaces every byte that isn't UTF-8 by itself.
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _every_second(at: np.ndarray) -> np.ndarray:
    """Of places in runs of neighbours, which overlap, the first, third, ... of each run."""
    run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]


class PieceBpe:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without a character map, with a begin mark and escaped spaces")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces) or not trained.byte_fallback:
            raise ValueError("only models with byte fallback and without user-defined or unused pieces")
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        size = len(model.pieces)
        chars = sorted({c for p in pieces for c in p})
        symbols = pieces | {c: size + i for i, c in enumerate(c for c in chars if c not in pieces)}
        self.pairs = PairTable(symbols)
        scores = np.array([-p.score for p in model.pieces])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.uint32)
        self.of_char = np.arange(BEYOND, BEYOND + 0x110000, dtype=np.uint32)
        for c in chars:
            self.of_char[ord(c)] = symbols[c]
        side = {int(self.of_char[ord(a)]) << 32 | int(self.of_char[ord(b)]) for p in pieces for a, b in itertools.pairwise(p)}
        self.neighbours = np.array(sorted(side), np.uint64)
        self.byte_id = np.zeros(256, np.uint32)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        # Characters without a piece of their own are spelt in bytes.
        spelt = {symbols[c]: c for c in chars if c not in pieces}
        self.spelt = lambda s: self.byte_id[np.frombuffer((spelt[s] if s < BEYOND else chr(s - BEYOND)).encode(), np.uint8)]
        self.size = size
        # Words begin at marks and line ends if no piece has one of them inside.
        inside = "".join(p.lstrip(MARK) for p in pieces)
        own = "" if "\n" in inside or any("\n" in p for p in pieces) else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{own}]*|[^{MARK}{own}]+" + (f"|{own}+" if own else "")) if MARK not in inside else re.compile(r"(?s).+")
        said = {kind.CONTROL: lambda p: b"", kind.UNKNOWN: lambda p: trained.unk_surface.encode(), kind.BYTE: lambda p: bytes([int(p.piece[3:5], 16)])}
        shown = [said.get(p.type, lambda p: p.piece.replace(MARK, " ").encode())(p) for p in model.pieces]
        self.token_len = np.array([len(t) for t in shown], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.silent = np.array([p.type == kind.CONTROL for p in model.pieces])
        self.marked = np.array([p.type == kind.NORMAL and p.piece.startswith(MARK) for p in model.pieces])
        self.known: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of pairs and their ranks, NONE where they don't merge."""
        merged = self.pairs.get(left, right)
        return merged, np.where(merged == NONE, NONE, self.rank[np.where(merged == NONE, 0, merged)])

    def merged(self, sym: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the places where they begin. ``last`` marks the last symbol of each segment."""
        out, place = np.full(len(sym), NONE, np.uint32), np.arange(len(sym))
        new, rank = np.full(len(sym), NONE, np.uint32), np.full(len(sym), NONE, np.uint32)
        inner = np.flatnonzero(~last)
        new[inner], rank[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.append(True, last[:-1]))
            size = np.diff(np.append(start, len(sym)))
            least = np.minimum.reduceat(rank, start)
            done = np.repeat(least == NONE, size)
            if done.any():
                out[place[done]] = sym[done]
                live = ~done
                sym, place, last, new, rank = sym[live], place[live], last[live], new[live], rank[live]
                size, least = size[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            segment = np.repeat(np.arange(len(size)), size)
            at = _every_second(np.flatnonzero(rank == least[segment]))
            if len(at) > len(size):
                at = at[self._together(sym, last, new, least, segment, at)]
            sym[at] = new[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            last[at] = last[at + 1]
            at = at - np.arange(len(at))  # each merge before has taken out one symbol
            sym, place, last, new, rank = sym[stay], place[stay], last[stay], new[stay], rank[stay]
            changed = np.append(at, at[at > 0] - 1)
            ends = changed[last[changed]]
            new[ends], rank[ends] = NONE, NONE
            changed = changed[~last[changed]]
            new[changed], rank[changed] = self.pair(sym[changed], sym[changed + 1])
        where = np.flatnonzero(out != NONE)
        return out[where], where

    def _together(self, sym, last, new, least, segment, at) -> np.ndarray:
        """Which of the places ``at`` may be merged at once: all of a segment where no new pair comes before, else the first."""
        rank_of = lambda a, b: self.pair(a, b)[1]
        seg, right = segment[at], at + 2
        after = np.append(at[1:], -1) == right  # the next place begins right behind this one
        open_right = ~last[at + 1]
        bad = np.zeros(len(least), bool)
        i = np.flatnonzero(open_right)  # as it stands while the ones behind are still to come
        bad[seg[i][rank_of(new[at[i]], sym[right[i]]) <= least[seg[i]]]] = True
        i = np.flatnonzero(open_right & after)
        bad[seg[i][rank_of(new[at[i]], new[right[i]]) <= least[seg[i]]]] = True
        before = np.append(False, after[:-1])
        i = np.flatnonzero(~before & (at > 0) & ~np.append(True, last)[at])
        bad[seg[i][rank_of(sym[at[i] - 1], new[at[i]]) <= least[seg[i]]]] = True
        return ~bad[seg] | np.append(True, seg[1:] != seg[:-1])

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; words aren't empty."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym = self.of_char[code]
        word_end = np.cumsum([len(w) for w in words])
        key = sym[:-1].astype(np.uint64) << np.uint64(32) | sym[1:].astype(np.uint64)
        last = np.ones(len(sym), bool)
        if len(self.neighbours):
            near = np.minimum(np.searchsorted(self.neighbours, key), len(self.neighbours) - 1)
            last[:-1] = self.neighbours[near] != key
        last[word_end - 1] = True
        ids, place = self.merged(sym, last)
        cut = np.searchsorted(place, word_end)
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):
            parts, begin = [], 0
            for i in odd.tolist():
                parts += [ids[begin:i], self.spelt(int(ids[i]))]
                begin = i + 1
            grown = np.ones(len(ids), np.int64)
            grown[odd] = [len(p) for p in parts[1::2]]
            ids, cut = np.concatenate([*parts, ids[begin:]]), np.append(0, np.cumsum(grown))[cut]
        return np.split(ids, cut[:-1])

    def learn(self, words: set[str]) -> dict[str, bytes]:
        if len(self.known) + len(words) > REMEMBER:  # frequent words came early: forget the later half
            for w in list(itertools.islice(reversed(self.known), len(self.known) // 2)):
                del self.known[w]
        new = list(words)
        fresh = {w: x.astype("<u4").tobytes() for w, x in zip(new, self.encode_words(new), strict=True)}
        self.known.update(fresh)
        return fresh

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without those of begin and end."""
        cut = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        got = [list(map(self.known.get, words)) for words in cut]
        lacking = {w for words, have in zip(cut, got, strict=True) if None in have for w, x in zip(words, have, strict=True) if x is None}
        if lacking:
            fresh = self.learn(lacking)
            got = [[x or fresh[w] for w, x in zip(words, have, strict=True)] if None in have else have for words, have in zip(cut, got, strict=True)]
        return [np.frombuffer(b"".join(have), "<u4") for have in got]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: marks are spaces, the first one of the text falls, bytes are read as UTF-8."""
        spoken = ids[~self.silent[ids]]
        size = self.token_len[spoken]
        start = self.token_at[spoken] - (np.cumsum(size) - size)
        data = self.token_bytes[np.repeat(start, size) + np.arange(size.sum())].tobytes()
        return (data[1:] if len(spoken) and self.marked[spoken[0]] else data).decode("utf-8", "each_byte")


@functools.lru_cache(2)
def loaded(model_file: str) -> PieceBpe:
    return PieceBpe(model_file)


def _encoded(batches, model_file: str):
    """Pieces of the batches with the ids of each text, begin and end included."""
    bpe = loaded(model_file)
    begin, end = np.array([bpe.begin], "<u4"), np.array([bpe.end], "<u4")
    for piece in sized_slices(batches, "text", 1 << 20):
        yield bpe, piece, [np.concatenate([begin, x, end]) for x in bpe.encode([t or "" for t in piece.column("text").to_pylist()])]


def encode_column(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and ids (array<long>), begin and end included, of each row of ``docs`` (doc_id, text)."""

    def rows(batches):
        for _, piece, ids in _encoded(batches, model_file):
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int64)))], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, ids array<long>")


def decode_column(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids); null ids decode to nothing."""

    def rows(batches):
        bpe = loaded(model_file)
        for batch in batches:
            text = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(text, pa.string())], ["doc_id", "text"])

    return only(encoded, "doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def encode_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, the latter from the ids, of each row of ``docs``."""

    def rows(batches):
        for bpe, piece, ids in _encoded(batches, model_file):
            a = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            b = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
