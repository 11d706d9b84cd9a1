"""Token-ID files of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id and sorted, so that a task's documents follow one another; each task encodes
its texts and packs the ids into segments, which Spark's Parquet writer stores (one row a segment), so that a lost
executor's half-written files never count. A segment holds whole documents and has this layout, little-endian:

    magic "PFR1", n_docs u32, n_ids u32, n_blocks u32
    n_docs x doc_id i64 | n_docs x document start u32 | n_blocks x block byte offset u32
    blocks: minimum u32, width u8, high size u8, n_ids u16, n_exceptions u16, packed ids, places u16, high parts

In a block of up to ``BLOCK`` ids the minimum is subtracted and what is left is packed at the width that holds one of the
``PERCENTILES`` of the ids: the one that makes the block smallest. Larger ids are patched: their low bits are packed like
all others, and the exception list holds their places and their high parts, of one, two or four bytes.

Results for odd input: no rows in, no rows out; null and empty texts have the end id alone; a text of any length stays
in one segment; repeated rows are written one after another, those of one doc_id by a hash of their texts; rows with a
null doc_id come first.
"""

from __future__ import annotations

import functools
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, only, sized_slices, table

BLOCK = 16_384
PERCENTILES = (70, 80, 85, 90, 95, 97, 99, 100)
SEGMENT_IDS = 1 << 18
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
MAGIC = b"PFR1"
NULL_ID = -(2**63)


def pack(values: np.ndarray, width: int) -> bytes:
    """``width`` low bits of each value, one after another; whole bytes need no shuffling of bits."""
    if not width:
        return b""
    if width in WHOLE:
        return values.astype(WHOLE[width]).tobytes()
    n = len(values)
    if width < 16:
        # Eight values are ``width`` bytes: four of them fill one long, and the other four go on behind them.
        padded = np.zeros(-(-n // 8) * 8, np.uint32)
        padded[:n] = values
        each = padded.reshape(-1, 8).T.astype(np.uint64)
        step = np.uint64(width)
        low = each[0] | each[1] << step | each[2] << step * np.uint64(2) | each[3] << step * np.uint64(3)
        high = each[4] | each[5] << step | each[6] << step * np.uint64(2) | each[7] << step * np.uint64(3)
        out = np.empty((len(low), 2), np.uint64)
        out[:, 0] = low | high << np.uint64(4 * width)
        out[:, 1] = high >> np.uint64(64 - 4 * width)
        return out.view(np.uint8)[:, :width].tobytes()[: (n * width + 7) // 8]
    octets = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : (width + 7) // 8]
    return np.packbits(np.unpackbits(np.ascontiguousarray(octets), axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()


@functools.lru_cache(64)
def places_of(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit at which each value of a block begins."""
    at = np.arange(BLOCK, dtype=np.int64) * width
    return at >> 3, (at & 7).astype(np.uint64)


def unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    if width in WHOLE:
        return data.view(WHOLE[width])[:n].astype(np.uint32)
    # Every value lies within the eight bytes from where it begins.
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    byte, bit = places_of(width)
    longs = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    return (longs[byte[:n]] >> bit[:n]).astype(np.uint32) & np.uint32((1 << width) - 1)


HEAD = struct.Struct("<IBBHH")


def byte_size(bits: int) -> int:
    """Bytes of the least whole type that holds so many bits."""
    return 1 if bits <= 8 else 2 if bits <= 16 else 4


def chosen_width(rest: np.ndarray) -> tuple[int, int]:
    """Width to pack at and bytes of a high part: of the percentiles the one that makes the block smallest."""
    n, top = len(rest), int(rest.max()).bit_length()
    # Values below each power of two; those from 2 ** drop on are told by counts of the first eight bits.
    drop = max(0, top - 8)
    below = np.cumsum(np.bincount(rest >> np.uint32(drop), minlength=1 << (top - drop)))
    below = [int(below[(1 << (w - drop)) - 1]) if w >= drop else int(np.count_nonzero(rest < 1 << w)) for w in range(top + 1)]
    best = None
    for p in PERCENTILES:
        width = next(w for w in range(top + 1) if 100 * below[w] >= p * n)
        high = byte_size(top - width)
        cost = (n * width + 7) // 8 + (n - below[width]) * (2 + high)
        if best is None or cost < best[0]:
            best = cost, width, high
    return best[1], best[2]


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = ids - np.uint32(low)
    width, high = chosen_width(rest)
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    parts = rest[out] >> np.uint32(width) if len(out) else np.zeros(0, np.uint32)
    head = HEAD.pack(low, width, high, len(ids), len(out))
    return head + pack(rest & np.uint32((1 << width) - 1), width) + out.astype("<u2").tobytes() + parts.astype(f"<u{high}").tobytes()


def decode_block(data: memoryview) -> np.ndarray:
    low, width, high, n, n_out = HEAD.unpack_from(data)
    at, size = HEAD.size, (n * width + 7) // 8
    ids = unpack(np.frombuffer(data, np.uint8, size, at), width, n)
    at += size
    if n_out:
        ids[np.frombuffer(data, "<u2", n_out, at)] |= np.frombuffer(data, f"<u{high}", n_out, at + 2 * n_out).astype(np.uint32) << np.uint32(width)
    return ids + np.uint32(low)


def block_shapes(data: bytes) -> list[tuple[int, int, int]]:
    """Width, ids and exceptions of each block of a segment, from the blocks' heads."""
    _, _, offsets, base, _ = segment_index(data)
    heads = [HEAD.unpack_from(data, base + int(o)) for o in offsets]
    return [(width, n, n_out) for _, width, _, n, n_out in heads]


def encode_segment(doc_ids: list[int], docs: list[np.ndarray]) -> bytes:
    starts = np.cumsum([0, *map(len, docs)])[:-1]
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    blocks = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1]
    return b"".join([MAGIC, struct.pack("<III", len(docs), len(ids), len(blocks)), np.array(doc_ids, "<i8").tobytes(), starts.astype("<u4").tobytes(), offsets[: len(blocks)].astype("<u4").tobytes(), *blocks])


def segment_index(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """doc_ids, document starts (with the end), block offsets, where blocks begin, number of ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n_docs, n_ids, n_blocks = struct.unpack_from("<III", data, 4)
    at = 16
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    starts = np.append(np.frombuffer(data, "<u4", n_docs, at := at + 8 * n_docs), n_ids).astype(np.int64)
    offsets = np.frombuffer(data, "<u4", n_blocks, at := at + 4 * n_docs)
    return doc_ids, starts, offsets, at + 4 * n_blocks, n_ids


def read_ids(data: bytes, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a segment; only the blocks that hold them are decoded."""
    _, _, offsets, base, _ = segment_index(data)
    if start >= end:
        return np.zeros(0, np.uint32)
    first, last = start // BLOCK, (end - 1) // BLOCK
    view = memoryview(data)
    return np.concatenate([decode_block(view[base + int(offsets[b]) :]) for b in range(first, last + 1)])[start - first * BLOCK : end - first * BLOCK]


SPACE, SYMBOL, LETTER, NUMBER = range(4)


def kind_of(code: int) -> int:
    """What a code point below U+0130 is to the tokenizer's pattern."""
    if chr(code) in "\t\n\v\f\r \x85\xa0":
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(code))[0], SYMBOL)


class CachedEncoder:
    """Ids of whole texts by the library, asked once for each piece of letters, digits or symbols.

    The tokenizer's own rules make that exact: white space parts pieces and is dropped, lower-casing looks at one
    code point at a time, and below U+0130 texts are in normal form C. Other texts, and texts in which a special
    token's string could stand, go to the library whole. NumPy cuts the lower-cased bytes of the texts at hand into
    pieces, Arrow finds the distinct ones and those known, and new ones go to the library as the words of one text.
    """

    PARTS, JOINED, GATHER = 600_000, 256, 1 << 18
    WHOLE_ONLY = "[\x1c-\x1f\x85\xa0İ-\U0010ffff]|<\\|"

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.kinds = np.array([kind_of(i) for i in range(0x130)], np.uint8)
        #: Pieces met, where the ids of each begin (with the end), and the ids.
        self.parts, self.starts, self.ids = pa.array([], pa.large_binary()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def by_library(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts, 1 MB at a time: the library holds a multiple of what the ids take."""
        some = (x.column("text").to_pylist() for x in sized_slices([pa.record_batch([texts], ["text"])], "text", 1 << 20))
        return [np.array(e.ids, np.uint32) for x in some for e in self.library.encode_batch_fast(x, add_special_tokens=False)]

    def learn(self, parts: pa.Array) -> None:
        """Ask for new pieces, many as one text: each is a word of it to the library, which says whose an id is."""
        ids, sizes, asked = [self.ids], [], parts.to_pylist()
        for at in range(0, len(asked), self.JOINED):
            some = asked[at : at + self.JOINED]
            said = self.library.encode(b" ".join(some).decode(), add_special_tokens=False)
            n = np.bincount(said.word_ids, minlength=len(some))
            if len(n) != len(some) or not n.all():
                raise ValueError("the tokenizer doesn't take the pieces of a text for its words")
            ids.append(np.array(said.ids, np.uint32))
            sizes.append(n)
        self.parts, self.ids = pa.concat_arrays([self.parts, parts]), np.concatenate(ids)
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes)))

    def forget(self) -> None:
        """Where there are more than ``PARTS`` pieces, forget the later ones: frequent pieces came early."""
        if len(self.parts) > self.PARTS:
            left = self.PARTS // 2
            self.parts, self.starts = self.parts.take(pa.array(np.arange(left))), self.starts[: left + 1].copy()
            self.ids = self.ids[: self.starts[-1]].copy()

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Where each of the distinct pieces stands among those met, new ones included."""
        found, out = pc.index_in(self.parts, value_set=distinct), np.full(len(distinct), -1, np.int64)
        met = np.flatnonzero(found.is_valid())
        out[found.drop_null().to_numpy()] = met
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = np.arange(len(self.parts), len(self.parts) + len(new))
            self.learn(distinct.take(pa.array(new)))
        return out

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of the texts' lower-cased bytes, and how many stand before each text and in all; as the pattern

        ``'s|'t|'re|'ve|'m|'ll|'d|[letter]+|[number]|[symbol]+`` finds them: each is a run of one kind, a number is
        alone, and an apostrophe that begins a run takes the letters of its ending.
        """
        # A line's end behind each text keeps pieces, and what follows an apostrophe, within it.
        lines = pc.binary_join_element_wise(pc.utf8_lower(texts), *pa.array(["\n", ""], pa.large_string()))
        bounds = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :][: len(lines) + 1]
        octets = np.frombuffer(lines.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        kinds = np.append(self.kinds[:0x80], np.zeros(0x80, np.uint8))[octets]
        # Other code points have two bytes here, both of one kind.
        lead = np.flatnonzero(octets >= 0xC0)
        kinds[lead] = kinds[lead + 1] = self.kinds[(octets[lead].astype(np.int64) & 0x1F) << 6 | octets[lead + 1] & 0x3F]
        begins = kinds == NUMBER
        begins[0] = True
        begins[1:] |= kinds[1:] != kinds[:-1]
        begins &= (solid := kinds != SPACE)
        begins[lead + 1] = False
        mark = np.flatnonzero(octets == ord("'"))
        mark = mark[begins[mark]]
        one, two = octets[mark + 1], octets[np.minimum(mark + 2, len(octets) - 1)]
        size = np.isin(one, np.frombuffer(b"stmd", np.uint8)) + 2 * ((np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        mark, size = mark[size > 0], size[size > 0]
        begins[mark + 1] = False
        begins[mark + 1 + size] = solid[mark + 1 + size]
        before = np.searchsorted(np.flatnonzero(begins), bounds - bounds[0])
        octets, begins = octets[solid], np.flatnonzero(begins[solid])
        return pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(octets))), pa.py_buffer(octets)]), before

    def of_plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts without any of ``WHOLE_ONLY``."""
        if not len(texts):
            return []
        pieces, before = self.cut(texts)
        coded = pieces.dictionary_encode()
        places, which = self.places(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        starts, sizes = self.starts[places], np.diff(self.starts)[places]
        ends = np.append(0, np.cumsum(sizes[which]))
        out = np.empty(ends[-1], np.uint32)
        for at in range(0, len(which), self.GATHER):
            some, first = which[at : at + self.GATHER], ends[at]
            last = ends[at + len(some)]
            # Where a piece's ids are, less where they go, and then one place on for each id.
            out[first:last] = self.ids[np.repeat(starts[some] - ends[at : at + len(some)], sizes[some]) + np.arange(first, last)]
        self.forget()
        bounds = ends[before].tolist()
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.WHOLE_ONLY)
        asked, plain = iter(self.by_library(texts.filter(whole))), iter(self.of_plain(texts.filter(pc.invert(whole))))
        return [next(asked if w else plain) for w in whole.to_pylist()]


@functools.lru_cache(2)
def encoder(file: str) -> CachedEncoder:
    return CachedEncoder(file)


def segments(batches, tokenizer_file: str, end_id: int):
    enc, held_ids, held, total = encoder(tokenizer_file), [], [], 0

    def flush():
        n = [len(x) for x in held]
        return pa.RecordBatch.from_pylist([{"first_doc": held_ids[0], "last_doc": held_ids[-1], "n_ids": sum(n), "segment": encode_segment(held_ids, held)}], schema=pa.schema([("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_ids", pa.int64()), ("segment", pa.binary())]))

    end = np.array([end_id], np.uint32)
    for piece in sized_slices(batches, "text", 16 << 20, 4096):
        for doc_id, ids in zip(piece.column("doc_id").to_pylist(), enc.encode(piece.column("text")), strict=True):
            held_ids.append(NULL_ID if doc_id is None else doc_id)
            held.append(np.concatenate([ids, end]))
            total += len(held[-1])
            if total >= SEGMENT_IDS:
                yield flush()
                held_ids, held, total = [], [], 0
    if held:
        yield flush()


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text), in ascending doc_id order, into files of segments under ``path``."""
    # The text's hash deals rows that share a doc_id, or have none, over tasks.
    order = ["doc_id", F.xxhash64("text")]
    ordered = only(docs, "doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    made = ordered.mapInArrow(lambda b: segments(b, tokenizer_file, end_id), "first_doc long, last_doc long, n_ids long, segment binary")
    made.withColumn("row", F.monotonically_increasing_id()).write.mode("errorifexists").option("compression", "uncompressed").parquet(path)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files under ``path``."""

    def rows(batches):
        for piece in batches:
            for row, data in zip(piece.column("row").to_pylist(), piece.column("segment").to_pylist(), strict=True):
                doc_ids, starts, _, _, n = segment_index(data)
                ids = np.ascontiguousarray(read_ids(data, 0, n), "<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(np.full(len(doc_ids), row), pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "row", "within", "n_tokens", "ids_crc32"])

    every = spark.read.parquet(path)
    read = every.select("row", "segment").mapInArrow(rows, "doc_id long, row long, within long, n_tokens long, ids_crc32 long")
    return read.join(segment_starts(every), "row").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def segment_starts(every: DataFrame) -> DataFrame:
    """(row, before): the number of ids before each segment, from the segments' heads alone."""
    heads = every.select("row", "n_ids", F.shiftright("row", 33).alias("task"))
    tasks = heads.groupBy("task").agg(F.sum("n_ids").alias("n"))
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("ahead"))
    inside = heads.select("row", "task", (F.sum("n_ids").over(Window.partitionBy("task").orderBy("row")) - F.col("n_ids")).alias("within"))
    return inside.join(tasks, "task").select("row", (F.col("ahead") + F.col("within")).alias("before"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark)}/token_ids_{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return document_digests(spark, path)
