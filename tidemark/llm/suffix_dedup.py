"""Repeated passages by enhanced suffix arrays over sampled anchors.

A passage of ``least`` bytes that occurs twice holds the same anchor in both places: the leftmost minimum among the
hashes of its ``GRAM``-byte strings. So every window of ``least`` bytes belongs to one anchor, and only windows of
anchors whose gram occurs more than once can repeat.

1. Each task slides over its texts and packs anchors by the hash of their gram; the buckets are shuffled and anchors
   whose gram is unique go.
2. The windows of the others, as bytes with their places, are shuffled by gram. Equal windows of one task are folded
   before: they are a leaf of the interval tree (4), whose places but the earliest are told at once, and only the earliest
   goes on, as in any partial aggregate.
3. In each bucket, windows fall into classes of equal first ``least`` bytes. A class whose left neighbours all agree
   is contained in a repeat that begins further left and is skipped (left-extension diversity).
4. For the rest the suffixes are sorted and their common-prefix lengths give the interval tree by one scan with a stack;
   equal suffixes are its leaves. Where two parts of an interval meet, the later one's first suffix repeats an earlier
   text over the interval's length, and so do all places of a leaf but its first: those are the spans to remove.

``repeats`` gives the maximal repeats with all their occurrences: from the windows of 2 it takes the runs of repeated
windows, and builds the trees over the suffixes to the end of a run.

Grams that stand often in one task's texts (``HOT``), or in all (``MANY``), are sent window by window under the window's own
hash, so that a passage of any frequency is spread over buckets and its copies are folded before the shuffle: there a
leaf of the tree is a window, and neighbouring leaves make up a span. Texts that are equal
as a whole are settled by their hash before, as every copy of at least ``least`` bytes repeats the first.

Results for odd input: no rows in, no rows out; null and empty texts have no bytes and nothing removed; long texts
are scanned in pieces that overlap; repeated rows of one doc_id are one document and get its result; rows with a null
doc_id have nothing removed and cover nothing.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, only, sized_slices, table

GRAM = 32
LEAST = 100
HOT = 32
MANY = 1 << 14
PIECE = 1 << 20
#: Bytes of text that a bucket stands for on average.
BUCKET_BYTES = 8 << 20
ANCHOR = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("place", "<i8"), ("known", "u1")])
WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u4"), ("offset", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("span", "<i8")])


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x165667B19E3779F9)
    return x


def string_hashes(data: bytes, size: int) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` >= 16 bytes in ``data``."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    h = np.ndarray((n - 7,), "<u8", data, 0, (1,)).astype(np.uint64)
    have = 8
    while have * 2 <= size:
        h = _fold(h[: len(h) - have], h[have:])
        have *= 2
    if have < size:
        h = _fold(h[: n - size + 1], h[size - have : size - have + n - size + 1])
    return h


def anchors(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: hash, anchor's place, first and last window start."""
    n = len(data) - least + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    h = string_hashes(data, GRAM)
    # The place in the low bits makes minima unique and the leftmost win.
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, have = least - GRAM + 1, 1
    low = key
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:n], low[width - have : width - have + n])
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], n) - 1
    return h[at[first]], at[first], first, last


def pieces(doc: bytes, least: int):
    """(offset, bytes) so that every window of ``least`` bytes lies in just one piece."""
    for at in range(0, max(1, len(doc) - least + 1), PIECE):
        yield at, doc[at : at + PIECE + least - 1]


def packed(place, first, last, hot) -> np.ndarray:
    """One long: the anchor's place, how far back its first and last window start, and whether it is hot."""
    return place << 17 | (place - first) << 9 | (place - last) << 1 | hot


def by_bucket(batches):
    """(bucket, payloads) of rows that come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(payload)
    if held:
        yield now, held


def bucket_rows(records: np.ndarray, buckets: int):
    """Records with a hash, as one payload a bucket."""
    of = (records["hash"] >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    records, of = records[order], of[order]
    first = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1))
    ends = np.append(first[1:], len(of))
    return of[first].astype(np.int64).tolist(), [records[a:b].tobytes() for a, b in zip(first, ends, strict=True)]


PAYLOADS = ["bucket", "payload"]


def payload_batch(buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary())], PAYLOADS)


def find_anchors(batches, least: int, buckets: int, flush: int = 1 << 19):
    """Anchors of the texts, packed by bucket."""
    held, total = [], 0

    def out():
        every = np.concatenate(held)
        order = np.argsort(every["hash"], kind="stable")
        every = every[order]
        first = np.flatnonzero(np.diff(every["hash"], prepend=~every["hash"][:1]))
        size = np.diff(np.append(first, len(every)))
        hot = np.repeat(size >= HOT, size)
        # Of a gram that is hot here, one anchor tells its bucket; the rest need no partner and go anywhere.
        every["known"][hot] = 2
        tell = every[first[size >= HOT]]
        tell["known"] = 3
        loose = every[hot]
        loose["hash"] = loose["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return payload_batch(*bucket_rows(np.concatenate([every[~hot], tell, loose]), buckets))

    for batch in sized_slices(batches, "text", PIECE):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for offset, data in pieces((text or "").encode(), least):
                h, place, first, last = anchors(data, least)
                if len(h):
                    r = np.zeros(len(h), ANCHOR)
                    r["hash"], r["doc"] = h, doc_id
                    r["place"] = packed(place + offset, first + offset, last + offset, 0)
                    held.append(r)
                    total += len(r)
        if total >= flush:
            yield out()
            held, total = [], 0
    if total:
        yield out()


def repeated_anchors(batches):
    """(doc_id, place) of the anchors whose gram occurs more than once."""
    for _, payloads in by_bucket(batches):
        every = np.frombuffer(b"".join(payloads), ANCHOR)
        loose, every = every[every["known"] == 2], every[every["known"] != 2]
        every = every[np.argsort(every["hash"], kind="stable")]
        first = np.flatnonzero(np.diff(every["hash"], prepend=~every["hash"][:1])) if len(every) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(every)))
        told = (np.maximum.reduceat(every["known"], first) == 3) | (size >= MANY) if len(first) else np.zeros(0, bool)
        keep = np.repeat((size > 1) | told, size) & (every["known"] != 3)
        place = (every["place"] | np.repeat(told, size))[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([every["doc"][keep], loose["doc"]])), pa.array(np.concatenate([place, loose["place"] | 1]))], ["doc_id", "place"])


def send_windows(batches, least: int, buckets: int, fold: bool, flush: int = 8 << 20):
    """Windows of repeated anchors, packed by bucket. ``fold``: those met before in this task go as spans only."""
    spans: list[tuple[int, int]] = []
    cold: dict = {}
    hot: dict = {}

    def put(seen: dict, window: bytes, doc: int, start: int, offset: int) -> int:
        """Keep the places of a window; returns the bytes newly held."""
        key = window if fold else (window, doc, start)
        had = seen.get(key)
        if had is None:
            seen[key] = [offset, (doc, start)]
            return len(window)
        had.append((doc, start))
        return 16

    def fold_leaves(seen: dict) -> dict:
        """The earliest place of each window; the spans of its other places are told."""
        out: dict = {}
        for key, (offset, *places) in seen.items():
            places = sorted(set(places))
            if len(places) > 1:
                for length, _, _, later in interval_tree([key], [places], least):
                    spans.extend((d, at << 32 | at + length) for d, at in later)
            out[key] = (*places[0], offset)
        return out

    def singles(once: dict):
        """Every window of the distinct stretches around hot grams, by itself and in order of place."""
        single: dict = {}
        for key, (doc, start, _) in sorted(once.items(), key=lambda x: x[1]):
            stretch, run = key if fold else key[0], None
            for i in range(len(stretch) - least + 1):
                w = stretch[i : i + least]
                if not fold:
                    single[w, doc, start + i] = (doc, start + i, 0)
                elif w not in single:
                    single[w] = (doc, start + i, 0)
                elif single[w][:2] != (doc, start + i):
                    if run is None or run[1] != i:
                        if run:
                            spans.append((doc, start + run[0] << 32 | start + run[1] - 1 + least))
                        run = [i, i]
                    run[1] = i + 1
            if run:
                spans.append((doc, start + run[0] << 32 | start + run[1] - 1 + least))
        return single

    def out():
        once, single = fold_leaves(cold), singles(fold_leaves(hot))
        texts = [k if fold else k[0] for k in (*once, *single)]
        places = [*once.values(), *single.values()]
        rows, payloads = [], []
        if texts:
            gram = xxhash.xxh3_64_intdigest
            n = len(once)
            every = np.array([(gram(w[o : o + GRAM]) if i < n else gram(w), d, s, len(w), o) for i, (w, (d, s, o)) in enumerate(zip(texts, places, strict=True))], WINDOW)
            of = ((every["hash"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            for a, b in zip(first, np.append(first[1:], len(order)), strict=True):
                some = order[a:b]
                rows.append(int(of[some[0]]))
                payloads.append(struct.pack("<II", len(some), 0) + every[some].tobytes() + b"".join([texts[i] for i in some]))
        if spans:
            every = np.array(spans, SPAN)
            for at in range(0, len(every), 1 << 16):
                some = every[at : at + (1 << 16)]
                rows.append(int(some["doc"][0]) % buckets)
                payloads.append(struct.pack("<II", 0, len(some)) + some.tobytes())
        cold.clear(), hot.clear(), spans.clear()
        return payload_batch(rows, payloads)

    held = 0
    for batch in sized_slices(batches, "text", PIECE):
        for doc_id, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places")), strict=True):
            doc = text.encode()
            for p in sorted(set(places)):
                at = p >> 17
                start, end = at - (p >> 9 & 255), at - (p >> 1 & 255) + least
                held += put(hot if p & 1 else cold, doc[start:end], doc_id, start, at - start)
            if held >= flush:
                yield out()
                held = 0
    yield out()


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def interval_tree(suffixes: list[bytes], places: list[list], least: int):
    """Intervals of sorted distinct suffixes with common prefixes of ``least`` or more, by one scan with a stack.

    ``places``: those of each suffix, in order. Yields (length, first rank, last rank, later): where the parts of an
    interval meet, every part but the one with the earliest place gives its own earliest place to ``later``. A suffix of
    several places is a leaf interval.
    """
    for i, at in enumerate(places):
        if len(at) > 1:
            yield len(suffixes[i]), i, i, at[1:]
    stack: list[list] = []

    def meet(node, part):
        if part != node[2]:
            node[3].append(max(part, node[2]))
            node[2] = min(part, node[2])

    for i in range(1, len(suffixes) + 1):
        depth = common_prefix(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else 0
        left, part = i - 1, places[i - 1][0]
        while stack and stack[-1][0] > depth:
            node = stack.pop()
            meet(node, part)
            yield node[0], node[1], i - 1, node[3]
            left, part = node[1], node[2]
        if depth >= least:
            if stack and stack[-1][0] == depth:
                meet(stack[-1], part)
            else:
                stack.append([depth, left, part, []])


def suffix_classes(stretches: list[bytes], places: list[list], least: int):
    """Sorted distinct suffixes, with the places of each, of each class of equal windows whose left neighbours differ."""
    text = b"".join(stretches)
    size = np.array([len(s) for s in stretches])
    n = size - least + 1
    of = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[of] + start
    before = np.where(start > 0, np.frombuffer(text, np.uint8)[at - 1].astype(np.int16), -1)
    key = string_hashes(text, least)[at]
    order = np.argsort(key, kind="stable")
    key, before = key[order], before[order]
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    count = np.diff(np.append(first, len(key)))
    several = np.add.reduceat(np.array([len(p) for p in places])[of[order]], first) > 1
    low, high = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    diverse = several & ((low != high) | (low < 0))
    for a, m in zip(first[diverse].tolist(), count[diverse].tolist(), strict=True):
        members: dict[bytes, list] = {}
        for i in order[a : a + m].tolist():
            j = int(start[i])
            members.setdefault(stretches[of[i]][j:], []).extend((doc, place + j) for doc, place in places[of[i]])
        suffixes = sorted(members)
        yield suffixes, [sorted(set(members[x])) for x in suffixes]


def bucket_windows(payloads: list[bytes]):
    """(gram, window, doc, start) of each window sent."""
    for payload in payloads:
        n, _ = struct.unpack_from("<II", payload)
        at = 8 + n * WINDOW.itemsize
        for gram, doc, start, size, _ in np.frombuffer(payload, WINDOW, n, 8).tolist():
            yield gram, payload[at : at + size], doc, start
            at += size


def whole_groups(groups: dict[int, list], most: int = 4 << 20):
    """Groups of more than one stretch or place, some at a time so that arrays stay small."""
    stretches, places, total = [], [], 0
    for g in groups.values():
        if len(g) > 1 or len(g[0][1]) > 1:
            for window, place in g:
                stretches.append(window)
                places.append(place)
                total += len(window)
            if total >= most:
                yield stretches, places
                stretches, places, total = [], [], 0
    if stretches:
        yield stretches, places


def bucket_spans(payloads: list[bytes], least: int) -> np.ndarray:
    """Spans to remove that the windows of one bucket tell."""
    spans = [np.frombuffer(p, SPAN, k, 8) for p in payloads if (k := struct.unpack_from("<II", p)[1])]
    seen: dict[bytes, list] = {}
    for gram, window, doc, start in bucket_windows(payloads):
        seen.setdefault(window, [gram]).append((doc, start))
    groups: dict[int, list] = {}
    for window, (gram, *places) in seen.items():
        groups.setdefault(gram, []).append((window, places))
    del seen
    more: list[tuple[int, int]] = []
    for stretches, places in whole_groups(groups):
        for suffixes, at in suffix_classes(stretches, places, least):
            for length, _, _, later in interval_tree(suffixes, at, least):
                more += [(doc, start << 32 | start + length) for doc, start in later]
    return np.concatenate([*spans, np.array(more, SPAN)])


def repeated_windows(batches, least: int):
    """(doc_id, starts) of the windows that occur more than once: first and last of a run of starts, and whether a left neighbour may differ."""
    for _, payloads in by_bucket(batches):
        groups: dict[int, list] = {}
        for gram, window, doc, start in bucket_windows(payloads):
            groups.setdefault(gram, []).append((window, [(doc, start)]))
        for stretches, places in whole_groups(groups):
            size = np.array([len(s) for s in stretches])
            n = size - least + 1
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            byte = (np.cumsum(size) - size)[of] + at
            text = b"".join(stretches)
            before = np.where(at > 0, np.frombuffer(text, np.uint8)[byte - 1].astype(np.int16), -1)
            doc = np.array([p[0][0] for p in places], np.int64)[of]
            start = np.array([p[0][1] for p in places], np.int64)[of] + at
            key = string_hashes(text, least)[byte]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]))
            count = np.diff(np.append(first, len(key)))
            low, high = np.minimum.reduceat(before[order], first), np.maximum.reduceat(before[order], first)
            diverse = np.repeat((low != high) | (low < 0), count)
            more = np.repeat(count > 1, count)
            doc, start, diverse = doc[order][more], start[order][more], diverse[more]
            order = np.lexsort((start, doc))
            doc, start, diverse = doc[order], start[order], diverse[order]
            ends = np.flatnonzero((np.diff(doc) != 0) | (np.diff(start) != 1) | (np.diff(diverse.astype(np.int8)) != 0))
            if len(doc):
                a, b = np.append(0, ends + 1), np.append(ends, len(doc) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(start[a]), pa.array(start[b]), pa.array(diverse[a])], ["doc_id", "first", "last", "diverse"])


def diverse_windows(batches, least: int):
    """(window's hash, left byte, doc_id, start) of the windows whose left neighbours may differ; left is -1 at a document's start."""
    for batch in sized_slices(batches, "text", PIECE):
        out: list[tuple] = []
        for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
            doc = text.encode()
            for at in sorted({i for r in runs if r["diverse"] for i in range(r["first"], min(r["last"], len(doc) - least) + 1)}):
                out.append((xxhash.xxh3_128_digest(doc[at : at + least]), doc[at - 1] if at else -1, doc_id, at))
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["window", "left", "doc_id", "start"])


def run_suffixes(batches, least: int, most: int = 8 << 20):
    """(window's hash, suffix's hash, suffix, left, doc_id, start): from each start to the end of its run of repeated windows."""

    def rows(out):
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["window", "suffix", "bytes", "left", "doc_id", "start"])

    out: list[tuple] = []
    total = 0
    for batch in sized_slices(batches, "text", PIECE):
        for doc_id, text, runs, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs", "starts")), strict=True):
            doc, ends = text.encode(), []
            for first, last in sorted((r["first"], r["last"]) for r in runs):
                if ends and first <= ends[-1][1] + 1:
                    ends[-1][1] = max(ends[-1][1], last)
                else:
                    ends.append([first, last])
            i = 0
            for at in sorted(i for i in set(starts) if i + least <= len(doc)):
                while ends[i][1] < at:
                    i += 1
                suffix = doc[at : ends[i][1] + least]
                out.append((xxhash.xxh3_128_digest(suffix[:least]), xxhash.xxh3_128_digest(suffix), suffix, doc[at - 1] if at else -1, doc_id, at))
                total += len(suffix)
                if total >= most:
                    yield rows(out)
                    out, total = [], 0
    if out:
        yield rows(out)


def maximal_repeats(group: pa.Table, least: int) -> pa.Table:
    """(window, suffix, repeat, length): maximal repeats among the distinct suffixes of one window, one row for each suffix in it."""
    members = sorted(zip(*(group.column(c).to_pylist() for c in ("bytes", "suffix", "low", "high", "n")), strict=True))
    # A suffix with several places stands twice, so that it meets itself.
    ranked = [m for m in members for _ in range(m[4])]
    suffixes = [m[0] for m in ranked]
    out: list[tuple] = []
    for length, left, right, _ in interval_tree(suffixes, [[i] for i in range(len(suffixes))], least):
        some = ranked[left : right + 1]
        low = min(m[2] for m in some)
        if low < 0 or low != max(m[3] for m in some):
            name = hashlib.sha256(suffixes[left][:length]).hexdigest()
            out += [(s, name, length) for s in dict.fromkeys(m[1] for m in some)]
    window = group.column("window")[0].as_py()
    return pa.table([pa.array([window] * len(out), pa.binary()), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["window", "suffix", "repeat", "length"])


def remove_spans(batches, least: int):
    for batch in sized_slices(batches, "text"):
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, copy, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "is_copy", "spans")), strict=True):
            doc = (text or "").encode()
            if copy and len(doc) >= least:
                spans = [len(doc)]
            kept, at, runs = hashlib.sha256(), 0, 0
            removed, last_end = 0, -1
            for s in sorted(spans or ()):
                start, end = s >> 32, s & 0xFFFFFFFF
                if start > last_end:
                    kept.update(doc[at:start])
                    runs += 1
                    removed += end - start
                    at = last_end = end
                elif end > last_end:
                    removed += end - last_end
                    at = last_end = end
            kept.update(doc[at:])
            for k, v in zip(out, (len(doc), removed, runs, kept.hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string())], ["doc_id", *out])


def _gathered(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def bucket_count(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-total // BUCKET_BYTES))


def windows_by_bucket(base: DataFrame, least: int, buckets: int, fold: bool) -> DataFrame:
    """Sorted buckets of the windows of repeated anchors in ``base`` (doc_id, text, is_copy); copies are left out."""
    if not GRAM <= least < GRAM + 256:
        raise ValueError(f"windows have {GRAM} to {GRAM + 255} bytes")  # an anchor's way back to its windows has a byte
    found = base.where("is_copy IS NULL").select("doc_id", "text").mapInArrow(lambda b: find_anchors(b, least, buckets), "bucket long, payload binary")
    places = _gathered(found, buckets).mapInArrow(repeated_anchors, "doc_id long, place long")
    places = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    # The same columns of ``base`` as in the last join, so that both read one shuffle of the texts.
    both = base.join(places, "doc_id").select("doc_id", "text", "is_copy", "places")
    return _gathered(both.mapInArrow(lambda b: send_windows(b, least, buckets, fold), "bucket long, payload binary"), buckets)


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(repeat, length, doc_id, start): every maximal repeat of at least ``least`` bytes, with all its occurrences.

    Windows that occur more than once form runs in the documents, and a repeat lies within a run. Only starts whose
    windows have different left neighbours can begin a maximal repeat: their suffixes, to the end of the run, meet by
    first window. Equal suffixes are folded before, and occurrences joined to the intervals after, so that a passage of
    any frequency is spread. Neither ``HOT`` nor the partitioning tells in the result. A run with a period has as many
    maximal repeats as it is long, each with as many places, and takes time and room for them.
    """
    base = only(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").distinct().withColumn("is_copy", F.lit(None).cast("boolean"))
    found = windows_by_bucket(base, least, bucket_count(base), False).mapInArrow(lambda b: repeated_windows(b, least), "doc_id long, first long, last long, diverse boolean")
    runs = cut(found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "diverse")).alias("runs")))
    texts = base.join(runs, "doc_id").select("doc_id", "text", "runs")
    windows = cut(texts.mapInArrow(lambda b: diverse_windows(b, least), "window binary, left int, doc_id long, start long"))
    diverse = windows.groupBy("window").agg(F.min("left").alias("low"), F.max("left").alias("high")).where("low < 0 OR low <> high")
    starts = windows.join(diverse, "window", "left_semi").groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    kind = "window binary, suffix binary, bytes binary, left int, doc_id long, start long"
    suffixes = cut(texts.join(starts, "doc_id").mapInArrow(lambda b: run_suffixes(b, least), kind))
    place = F.struct("doc_id", "start")
    apart = suffixes.groupBy("window", "suffix").agg(F.first("bytes").alias("bytes"), F.min("left").alias("low"), F.max("left").alias("high"), F.when(F.min(place) == F.max(place), 1).otherwise(2).alias("n"))
    told = apart.groupBy("window").applyInArrow(lambda t: maximal_repeats(t, least), "window binary, suffix binary, repeat string, length long")
    return told.join(suffixes.select("window", "suffix", "doc_id", "start"), ["window", "suffix"]).select("repeat", "length", "doc_id", "start").distinct()


def suffix_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs`` (doc_id, text)."""
    docs = only(docs, "doc_id", "text")
    buckets = bucket_count(docs)
    named = docs.where("doc_id IS NOT NULL")
    hashed = named.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    # Written, so that the join deals both sides itself and can split the rows of a large group.
    first = cut(hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"))
    copies = hashed.join(first, "h").where("doc_id > first").select("doc_id").distinct().withColumn("is_copy", F.lit(True))
    base = named.join(copies, "doc_id", "left")

    def spans(batches):
        for _, payloads in by_bucket(batches):
            got = bucket_spans(payloads, least)
            yield pa.RecordBatch.from_arrays([pa.array(got["doc"]), pa.array(got["span"])], ["doc_id", "span"])

    found = windows_by_bucket(base, least, buckets, True).mapInArrow(spans, "doc_id long, span long")
    found = found.groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
    every = base.join(found, "doc_id", "left").select("doc_id", "text", "is_copy", "spans")
    nameless = docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("boolean").alias("is_copy"), F.lit(None).cast("array<bigint>").alias("spans"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return every.unionByName(nameless).mapInArrow(lambda b: remove_spans(b, least), result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
