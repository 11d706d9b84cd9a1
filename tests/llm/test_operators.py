"""Operators of the subpackage: SQL where there is any, brute force or libraries elsewhere, and odd inputs."""

import base64
import hashlib
import random
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import byte_bpe, chunk_dedup, host_rules, minhash_dedup, pfor_store, quality_gam, registry, source_mix, suffix_dedup, toxicity, url_templates
from tidemark.llm.common import table

#: Nulls, empties, blanks, one word, copies, near copies, ties, a very long text, and extra columns with clashing names.
BASE = "the quick brown fox jumps over the lazy dog and runs into the deep green forest where nobody ever finds it again at all today"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, "one", "en", "b"), (5, BASE, "en", "a"), (6, BASE, "en", "a"), (7, BASE.upper(), "en", "b"),
    (8, BASE + " extra", "en", None), (9, LONG, "en", "c"), (10, "é日本 \x1c don't ²", "fr", "c"), (11, BASE, "en", "a"), (11, BASE, "en", "a"), (None, BASE, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    extra = {c: "1" for c in ("row", "at", "id", "variant", "recipe", "size", "copies", "bucket", "class", "spans", "score", "n")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in extra.items()})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 0, 1), (9, 1, 0), (5, 1, 0), (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def tokenizer():
    import public_tokenizers

    return public_tokenizers


def operators(labels):
    p = tokenizer()
    return {
        "chunk_dedup": chunk_dedup.chunk_dedup, "near_dedup": minhash_dedup.near_dedup, "suffix_dedup": suffix_dedup.suffix_dedup, "mix": source_mix.mix_sources,
        "hosts": host_rules.host_rules, "quality": lambda d: quality_gam.quality(d, labels), "toxicity": lambda d: toxicity.toxicity(d, labels),
        "bpe": lambda d: byte_bpe.encode_digests(d, p.path("byte_bpe_50k.tiktoken"), p.PATTERN),
    }


@pytest.mark.parametrize("name", ["chunk_dedup", "near_dedup", "suffix_dedup", "mix", "hosts", "quality", "toxicity", "bpe"])
def test_odd_rows_and_no_rows(spark, odd, labels, name):
    run = operators(labels)[name]
    got = run(odd)
    assert sorted(r.doc_id or 0 for r in got.select("doc_id").collect()) == sorted(x[0] or 0 for x in ODD)
    assert run(odd.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    said = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
    assert said(got) == said(want)


def brute_spans(docs, least):
    """Removed bytes by the definition."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs.items()):
        b = (text or "").encode()
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                mark[i : i + least] = True
            seen.add(b[i : i + least])
        kept = bytes(np.frombuffer(b, np.uint8)[~mark])
        out[doc_id] = (len(b), int(mark.sum()), int((np.diff(mark.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(5)]
    docs = {i: text(r.randint(0, 60)) + r.choice(["", *shared]) + text(r.randint(0, 30)) + r.choice(["", *shared]) for i in range(80)}
    docs |= {80: "ab" * 400, 81: "ab" * 300 + "c" + "ab" * 60, 82: docs[3], 83: None, 84: "x" * 99, 85: "x" * 100, 86: "x" * 250}
    return docs


@pytest.mark.parametrize(("hot", "many"), [(2, 1 << 14), (32, 1 << 14), (10_000, 3), (10_000, 1 << 14)])
def test_suffix_spans_in_process(monkeypatch, hot, many):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    docs, least = passages(hot), 100
    want = brute_spans(docs, least)
    names = {i: t for i, t in docs.items() if t is not None}
    batch = lambda **c: pa.RecordBatch.from_arrays([pa.array(v, k) for k, v in c.values()], list(c))
    half = [dict(list(names.items())[::2]), dict(list(names.items())[1::2])]
    found = [x for h in half for x in suffix_dedup.find_anchors([batch(doc_id=(pa.int64(), list(h)), text=(pa.string(), list(h.values())))], least, 3)]
    ordered = lambda bs: pa.Table.from_batches(bs).sort_by("bucket").to_batches()
    places: dict[int, list[int]] = {}
    for b in suffix_dedup.repeated_anchors(ordered(found)):
        for d, p in zip(b.column("doc_id").to_pylist(), b.column("place").to_pylist(), strict=True):
            places.setdefault(d, []).append(p)
    sent = []
    for h in half:
        ids = [i for i in h if i in places]
        sent += list(suffix_dedup.send_windows([batch(doc_id=(pa.int64(), ids), text=(pa.string(), [h[i] for i in ids]), places=(pa.list_(pa.int64()), [places[i] for i in ids]))], least, 3, True))
    spans: dict[int, list[int]] = {}
    for _, payloads in suffix_dedup.by_bucket(ordered(sent)):
        for d, s in suffix_dedup.bucket_spans(payloads, least).tolist():
            spans.setdefault(d, []).append(s)
    ids = sorted(docs)
    last = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([docs[i] for i in ids]), pa.array([None] * len(ids), pa.bool_()), pa.array([spans.get(i) for i in ids], pa.list_(pa.int64()))], ["doc_id", "text", "is_copy", "spans"])
    for b in suffix_dedup.remove_spans([last], least):
        for r in b.to_pylist():
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def brute_repeats(docs, least):
    """Maximal repeats by the definition, length by length."""
    texts = {i: (t or "").encode() for i, t in docs.items()}
    out, length = set(), least
    now = [(i, j) for i, b in texts.items() for j in range(len(b) - least + 1)]
    while now:
        groups: dict[bytes, list] = {}
        for i, j in now:
            groups.setdefault(texts[i][j : j + length], []).append((i, j))
        now = []
        for text, places in groups.items():
            if len(places) < 2:
                continue
            left = {texts[i][j - 1] if j else -1 for i, j in places}
            right = {texts[i][j + length] if j + length < len(texts[i]) else -1 for i, j in places}
            if all(len(x) > 1 or -1 in x for x in (left, right)):
                out |= {(hashlib.sha256(text).hexdigest(), length, i, j) for i, j in places}
            now += [(i, j) for i, j in places if j + length < len(texts[i])]
        length += 1
    return out


@pytest.mark.parametrize(("hot", "parts"), [(2, 1), (32, 1), (32, 5), (1000, 3)])
def test_repeats_are_maximal_whatever_is_hot(spark, monkeypatch, hot, parts):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    common, outer = text(300), [text(120), text(150)]
    docs = {i: text(r.randint(20, 80)) + common + text(r.randint(20, 80)) for i in range(40)}
    docs |= {i: text(30) + outer[0] + common + outer[1] + text(30) for i in (40, 41)}
    docs |= {42: "ab" * 90, 43: outer[0], 44: outer[0] + "z", 45: docs[3], 46: None, 47: "", 48: common[:150] + text(40), 49: text(40) + common[150:] + common[:130]}
    rows = [*docs.items(), (45, docs[45]), (None, common)]
    # The workers take the value with the function, whose module isn't reloaded for each test.
    find = suffix_dedup.find_anchors

    def find_anchors(batches, least, buckets):
        suffix_dedup.HOT = hot
        return find(batches, least, buckets)

    monkeypatch.setattr(suffix_dedup, "find_anchors", find_anchors)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = [tuple(x) for x in suffix_dedup.repeats(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_repeats(docs, 100)


def test_suffix_dedup_and_repeats(spark):
    docs = passages(5)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == brute_spans(docs, 100)
    # Every repeat told is one: its bytes stand at each of its places, and it can't be had one byte longer everywhere.
    told: dict[str, list] = {}
    for r in suffix_dedup.repeats(df).collect():
        b = docs[r.doc_id].encode()[r.start : r.start + r.length]
        assert hashlib.sha256(b).hexdigest() == r.repeat and r.length >= 100
        told.setdefault(r.repeat, []).append((r.doc_id, r.start))
    assert told and all(len(v) > 1 for v in told.values())


def brute_components(docs, words):
    sets = {i: {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if (w := (t or "").encode().lower().split()) else set() for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup_by_brute_force(spark, words):
    r = random.Random(words)
    docs = {}
    for g in range(6):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 30, 120, 300]))]
        for _ in range(14):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = f"z{r.randrange(10_000)}"
            docs[len(docs)] = " ".join(w)
    got = minhash_dedup.near_dedup(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), words)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute_components(docs, words)


def test_odd_sketch_tells_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 4000, dtype=np.uint64))
    for share in (0.85, 0.95):
        b = np.unique(np.concatenate([a[: int(len(a) * share)], r.integers(0, 2**63, int(len(a) * (1 - share)), dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        z = sum(int(x).bit_count() for x in minhash_dedup.odd_sketch(minhash_dedup.minhash(a)).view("<u8") ^ minhash_dedup.odd_sketch(minhash_dedup.minhash(b)).view("<u8"))
        n = minhash_dedup.SKETCH_BITS
        assert abs(1 + n / 2 * np.log(1 - 2 * z / n) / (2 * minhash_dedup.SAMPLES) - true) < 0.12


def test_mix_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(1.2) * 5)), r.choice(["a"] * 6 + ["b", "c", None])) for i in range(4000)]
    got = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    assert abs(got.groupby("source", dropna=False).target.first().sum() - got["size"].sum()) < 1e-3
    for _, g in got.groupby("source", dropna=False):
        assert g.target.iloc[0] <= 3 * g["size"].sum() + 1e-6
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.05 * g.target.iloc[0], g["size"].max())
    again = source_mix.mix_sources(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string")).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mix_of_blank_documents_and_odd_ids(spark):
    rows = [(i, " " if i % 2 else "w " * 9, "a") for i in range(50)] + [(None, "x " * (i % 7), "b") for i in range(60)] + [(1000, "y y y", None)] + [(2000 + i, "", "c") for i in range(3)]
    got = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == len(rows) and all(r.copies == 0 for r in got if not r["size"]) and all(r.target == 0 for r in got if r.source == "c")
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))


def test_sources_in_order_of_code_point(spark):
    names = [None, "", "A", "a", "aa", "é", "\uffee", "\U0001f600", *[f"s{i:03}" for i in range(200)]]
    df = spark.createDataFrame([(n,) for n in names], "source string").repartition(7)
    got = {r.source: r["at"] for r in source_mix.numbered(df).collect()}
    assert got == {n: i for i, n in enumerate([*sorted(x.encode() for x in names if x is not None), None]) for n in [n.decode() if n is not None else None]}


def test_widths_are_those_of_percentiles():
    r = np.random.default_rng(3)
    for top in (1, 3, 9, 15, 16, 17, 24, 32):
        for _ in range(6):
            ids = (r.integers(0, 1 << top, 700, dtype=np.uint64) >> r.integers(0, top, 700, dtype=np.uint64)).astype(np.uint32)
            costs = {}
            for p in pfor_store.PERCENTILES:
                width = next(w for w in range(33) if 100 * int((ids < 1 << w).sum()) >= p * len(ids))
                high = pfor_store.byte_size(int(ids.max()).bit_length() - width)
                costs[width] = (700 * width + 7) // 8 + int((ids >> np.uint64(width) > 0).sum()) * (2 + high)
            width, _ = pfor_store.chosen_width(ids)
            assert costs[width] == min(costs.values())
            assert (pfor_store.decode_block(memoryview(pfor_store.encode_block(ids + np.uint32(5) if top < 32 else ids))) == (ids + np.uint32(5) if top < 32 else ids)).all()
            assert all((pfor_store.unpack(np.frombuffer(pfor_store.pack(ids & np.uint32((1 << w) - 1), w), np.uint8), w, 700) == (ids & np.uint32((1 << w) - 1))).all() for w in range(33))


def test_blocks_round_trip():
    r = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), r.integers(0, 50_000, 20_000).astype(np.uint32), np.where(r.random(9000) < 0.01, 2**32 - 1, r.integers(5, 900, 9000)).astype(np.uint32)):
        data = pfor_store.encode_segment([3, 9], [ids[:100], ids[100:]])
        assert (pfor_store.read_ids(data, 0, len(ids)) == ids).all() and (pfor_store.read_ids(data, 50, min(5000, len(ids))) == ids[50:5000]).all()
        assert pfor_store.segment_index(data)[1].tolist() == [0, min(100, len(ids)), len(ids)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_blocks_of_real_documents_are_patched(sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    ids = pfor_store.encoder(tokenizer().path("word_bpe_49k.json")).encode([t or "" for _, t in docs])
    data = pfor_store.encode_segment([d for d, _ in docs], ids)
    n, shapes = sum(map(len, ids)), pfor_store.block_shapes(data)
    assert (pfor_store.read_ids(data, 0, n) == np.concatenate(ids)).all()
    assert any(w % 8 for w, _, _ in shapes) and sum(e > 0 for _, _, e in shapes) > len(shapes) / 2
    assert len(data) / n < 2
    for (width, m, n_out), at in zip(shapes, range(0, n, pfor_store.BLOCK), strict=True):
        block = np.concatenate(ids)[at : at + m]
        assert n_out == int((block - block.min() >= 2**width).sum())


def test_pieces_are_asked_for_together():
    """The library is asked for few texts, a word is looked up once for the texts at hand, and the ids are the library's."""

    class Counted(dict):
        looks = 0

        def get(self, key):
            self.looks += 1
            return super().get(key)

    class Asked:
        def __init__(self, library):
            self.library, self.texts = library, 0

        def encode(self, text, **how):
            self.texts += 1
            return self.library.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return self.library.encode_batch_fast(texts, **how)

    enc = pfor_store.CachedEncoder(tokenizer().path("word_bpe_49k.json"))
    library, r = enc.library, random.Random(5)
    letters = [chr(i) for i in range(0x20, 0x130) if i not in (0x85, 0xA0) and chr(i) != "|"]
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(words), "", " \t\n", f"  {'  '.join(words[:500])}\r\n" * 20, "don't we'll ''s !' 12", *(f"{c}a {c} A{c}{c}" for c in letters)]
    enc.library, enc.words = Asked(library), Counted()
    got = [x.tolist() for x in enc.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert enc.library.texts < len(enc.parts) / 100 and enc.words.looks < 6000
    asked, odd = enc.library.texts, ["a\x1cb", "a\xa0b", "İ", "日本 x", "<|endoftext|> x"]
    assert [x.tolist() for x in enc.encode([*odd, texts[0]])][:-1] == [e.ids for e in library.encode_batch(odd, add_special_tokens=False)] and enc.library.texts == asked + len(odd)


def test_new_words_of_known_pieces_cost_no_calls():
    """Words are cut into pieces by arrays: 40,000 distinct words of 400 pieces take no Python call each."""
    enc = pfor_store.CachedEncoder(tokenizer().path("word_bpe_49k.json"))
    names = ["".join(x) for x in zip("abcdefghij" * 20, "klmnopqrst" * 2 * 10, [chr(97 + i // 10) for i in range(200)], strict=True)]
    texts, calls = [" ".join(f"{a}.{b}" for b in names) for a in names], 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        got = enc.encode(texts)
    finally:
        sys.setprofile(before)
    assert calls < 5000
    assert [x.tolist() for x in got] == [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_cut_as_the_library_cuts_them():
    enc, r = pfor_store.CachedEncoder(tokenizer().path("word_bpe_49k.json")), random.Random(11)
    some = ["'", "'s", "'re", "'ll", "'D", "''", ".'", "s", "e", "l", " ", "\n", "\r\x0b", "0", "12", "²", "½", "é", "Ü", "ª", "×", "Į", "#", "<", "\x00", "\x80", "word"]
    rare = ["İ", "ı", "\x1c", "\x85", "\xa0", "日本", "<|", "e\u0301", "😀", "\u212a"]
    texts = ["".join(r.choice(some) if r.random() > 0.02 else r.choice(rare) for _ in range(r.randint(0, 12))) for _ in range(4000)] + ["'", "'r", "x'", "'" * 999, "1" * 999, " " * 999]
    want = [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == want
    # Where few pieces are remembered, the others are asked for again.
    enc.PARTS = 40
    assert [x.tolist() for at in range(0, len(texts), 200) for x in enc.encode(texts[at : at + 200])] == want
    assert len(enc.parts) <= 40 and enc.starts[-1] == len(enc.ids) and enc.encode([]) == []


def test_whole_texts_go_to_the_library_by_size():
    class Asked:
        def __init__(self, library):
            self.library, self.sizes = library, []

        def encode_batch_fast(self, texts, **how):
            self.sizes.append(sum(len(t.encode()) for t in texts))
            return self.library.encode_batch_fast(texts, **how)

    enc = pfor_store.CachedEncoder(tokenizer().path("word_bpe_49k.json"))
    library, texts = enc.library, [f"{i} 日本語の文 " * 4000 for i in range(60)]
    enc.library = Asked(library)
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert max(enc.library.sizes) <= 1 << 20 and sum(enc.library.sizes) == sum(len(t.encode()) for t in texts)


def test_token_files_of_one_doc_id(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(40)] + [(None, f"none {i}") for i in range(40)] + [(8, "last"), (6, "early")]
    for parts in (1, 5):
        pfor_store.write_ids(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts), str(tmp_path / str(parts)), tokenizer().path("word_bpe_49k.json"))
    a, b = (sorted(map(str, pfor_store.document_digests(spark, str(tmp_path / p)).collect())) for p in "15")
    assert len(a) == len(rows) and a == b


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    file = tokenizer().path("word_bpe_49k.json")
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pfor_store.write_ids(docs, str(tmp_path / "ids"), file)
    t, start, want = Tokenizer.from_file(file), 0, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in pfor_store.document_digests(spark, str(tmp_path / "ids")).collect()} == want
    pfor_store.write_ids(odd.where("false"), str(tmp_path / "none"), file)
    assert pfor_store.document_digests(spark, str(tmp_path / "none")).count() == 0
    pfor_store.write_ids(odd, str(tmp_path / "all"), file)
    assert pfor_store.document_digests(spark, str(tmp_path / "all")).count() == len(ODD)


def test_bpe_against_tiktoken():
    import tiktoken

    p = tokenizer()
    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc, own, r = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.loaded(p.path("byte_bpe_50k.tiktoken"), p.PATTERN), random.Random(1)
    texts = [x[1] or "" for x in ODD] + [" " * 900, "a" * 1500, "ab" * 900, "aab" * 400, "".join(r.choice("abc") for _ in range(1500)), "".join(r.choice("=-_#") for _ in range(900))]
    texts += ["".join(r.choice("abcdefghi éßñ'日 \n\t.,!1²") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for text, (ids, said) in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(text) and said == " ".join(map(str, ids)) and own.decode(ids) == text.encode()


@pytest.mark.parametrize(("module", "label", "least"), [(quality_gam, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    sf_dir = "/root/testdata/sf0.01"
    got = module.query(spark, sf_dir).toPandas().merge(table(spark, sf_dir, "labels").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.predicted == held[label]).mean() >= least


def naive_found(lexicon, text):
    """Weights of the leftmost longest matches, word by word."""
    words, total, i = [lexicon.form(w) for w in toxicity.fold(text).split()], 0.0, 0
    said = [p.split() for p in lexicon.exceptions]
    while i < len(words):
        covered = [len(p) for p in said if words[i : i + len(p)] == p]
        if not covered:
            total += max(((len(t), w) for t, w in lexicon.weights.items() if words[i].startswith(t)), default=(0, 0.0))[1]
        i += max(covered, default=1)
    return total, len(words)


def test_automaton_matches_like_a_naive_scan():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 5)))
    for _ in range(60):
        weights = {word(): r.random() + 0.1 for _ in range(6)}
        lexicon = toxicity.Lexicon(weights, [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(25)], 1.0, 0.0)
        for _ in range(20):
            text = " ".join(r.choice([word(), *(w + word() for w in weights), *lexicon.exceptions]) for _ in range(r.randint(0, 25)))
            assert lexicon.found(text) == pytest.approx(naive_found(lexicon, text)), (weights, lexicon.exceptions, text)


def test_folding():
    forms = ["ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭", "i\u200bd\u200diot", "i\u0336d\u0336i\u0336ot", "1D10T", "іdіоt", "ⓘⓓⓘⓞⓣ", "ɪᴅɪᴏᴛ", "idi\u03bft", "ⅰⅾⅰot", "!d!0t"]
    assert {toxicity.fold(x) for x in forms} == {" idiot "} and toxicity.fold(None) == toxicity.fold(" \n") == "  "
    lexicon = toxicity.Lexicon({"idiot": 2.0, "réeux": 3.0}, ["idiot board"], 1.0, 0.0)
    assert [lexicon.found(x)[0] for x in ("ídiot", "ïdîôt's", "réeuxou", "reeuxou", "the idiot board", "the idiot boards", "videot")] == [2, 2, 3, 0, 0, 2, 0]


def test_exception_phrases_are_learned(spark):
    r = random.Random(9)
    text = lambda said: " ".join(r.choice("one two three four five six seven you killing".split()[:8]) for _ in range(12)) + said + f" n{r.randrange(10**6):x}q"
    toxic = [text(r.choice([" kill you", " you killer", " kill"])) for _ in range(60)]
    clean = [text(r.choice([""] * 80 + [" kill time", " a killdeer flies"])) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id < 60 THEN 1 ELSE 0 END AS toxic")
    lexicon = toxicity.fit_toxicity(docs, labels, known_exceptions=("KILL the lights",))
    assert list(lexicon.weights) == ["kill"] and {"kill time", "killdeer", "kill the lights"} <= set(lexicon.exceptions) and not {"kill", "killer", "kill you"} & set(lexicon.exceptions)
    assert lexicon.score(text(" kill time")) < 0.3 < lexicon.score(text(" kill you")) and lexicon.score(text(" kill the lights")) < 0.3 < lexicon.score(text(" kill the light"))


def naive_tree(at, y, f, depth, low, high):
    """Leaf values by bin: every cut is tried, every sum taken anew over the rows."""
    p = 1 / (1 + np.exp(-f))
    part = lambda a, b: ((y - p)[(at >= a) & (at < b)].sum(), (p * (1 - p))[(at >= a) & (at < b)].sum())
    worth = lambda a, b: part(a, b)[0] ** 2 / (part(a, b)[1] + quality_gam.PENALTY)
    gains = [(worth(low, k) + worth(k, high) - worth(low, high), k) for k in range(low + 1, high)] if depth else []
    best = max(gains, key=lambda g: (round(g[0], 12), -g[1]), default=(0, 0))
    if best[0] > 1e-12:
        return naive_tree(at, y, f, depth - 1, low, best[1]) | naive_tree(at, y, f, depth - 1, best[1], high)
    g, h = part(low, high)
    return dict.fromkeys(range(low, high), g / (h + quality_gam.PENALTY))


def test_boosting_by_brute_force(monkeypatch):
    monkeypatch.setattr(quality_gam, "BINS", 6)
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 3))
    y = (x[:, 0] + (x[:, 1] > 0) * (x[:, 2] > 0) * 2 + r.normal(size=150) * 0.5 > 0.7).astype(float)
    gam = quality_gam.Gam(rounds=4, pair_rounds=0, pairs=0)
    gam.tables = np.zeros((3, 6))
    gam.fit(x, y)
    f, tables, at = np.full(150, np.log(y.mean() / (1 - y.mean()))), np.zeros((3, 6)), gam.bins(x)
    for _ in range(4):
        for j in range(3):
            step = naive_tree(at[:, j], y, f, 2, 0, 6)
            tables[j] += [gam.rate * step[k] for k in range(6)]
            f = f + np.array([gam.rate * step[k] for k in at[:, j]])
    assert np.allclose(gam.tables, tables) and np.allclose(gam.score(x), 1 / (1 + np.exp(-f)))
    # A pair's tree against all cuts of one feature and, on each side, of the other.
    p = 1 / (1 + np.exp(-f))
    g, h = y - p, p * (1 - p)
    table, gain = quality_gam.pair_tree(*gam.sums(at[:, 1] * 6 + at[:, 2], y, f, 36))
    value = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality_gam.PENALTY)
    best = None
    for a, b in ((at[:, 1], at[:, 2]), (at[:, 2], at[:, 1])):
        k = max(range(1, 6), key=lambda k: (round(value(a < k) + value(a >= k), 12), -k))
        sides = [s for s in (a < k, a >= k)]
        cuts = [max(range(1, 6), key=lambda m: (round(value(s & (b < m)) + value(s & (b >= m)), 12), -m)) for s in sides]
        won = sum(value(s & (b < m)) + value(s & (b >= m)) - value(s) for s, m in zip(sides, cuts, strict=True))
        leaf = np.zeros(150)
        for s, m in zip(sides, cuts, strict=True):
            for rows in (s & (b < m), s & (b >= m)):
                leaf[rows] = g[rows].sum() / (h[rows].sum() + quality_gam.PENALTY)
        if best is None or won > best[0]:
            best = won, leaf
    assert np.isclose(gain, best[0]) and np.allclose(table[at[:, 1], at[:, 2]], best[1])


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 16))
    y = (x[:, 0] * x[:, 3] > 0).astype(float)
    gam = quality_gam.Gam(rounds=3, pair_rounds=6).fit(x, y)
    assert (0, 3) in {tuple(sorted(p[:2])) for p in gam.pairs}
    for row, got in zip(x[:40], gam.score(x[:40]), strict=True):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, gam.edges, strict=True)]
        total = gam.base + sum(gam.tables[j][b] for j, b in enumerate(bins)) + sum(t[bins[i]][bins[j]] for i, j, t in gam.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_a_repeated_labelled_row_counts_once(spark):
    from tidemark.llm.common import crc_fold, labelled_sample
    from pyspark.sql import functions as F

    docs = spark.range(5000).select(F.when(F.col("id") < 4000, 3).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    fitted = []
    sample = labelled_sample(docs, labels, "quality", 5, 0, 300)
    assert sample.select("doc_id").distinct().count() == 300 and sample.where(crc_fold(F.col("doc_id"), 5) == 0).count() == 0
    fit, quality_gam.Gam.fit = quality_gam.Gam.fit, lambda self, x, y: (fitted.append(len(y)), fit(self, x, y))[1]
    try:
        quality_gam.fit_quality(docs, labels, bound=300)
    finally:
        quality_gam.Gam.fit = fit
    assert fitted == [300]


def test_words_end_where_white_space_does(spark):
    from tidemark.llm.common import word_split
    from pyspark.sql import functions as F

    texts = ["a b \u2028", " a\tb \x85", "a \u2029 \n", "\n a b\r\n", "", " ", "a"]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(word_split(F.col("t")).alias("w")).collect()]
    assert got == [t.encode().split() and [w.decode() for w in t.encode().split()] for t in texts]


def brute_hosts(rows, most=0.5, tolerated=0.01):
    """kept of each measured row by plain arithmetic."""
    rules = {
        "short": lambda r: r["n_words"] < 10, "repeats": lambda r: 100 * r["n_repeat_words"] > 20 * r["n_words"], "symbols": lambda r: r["n_symbols"] > r["n_words"],
        "length": lambda r: r["n_words"] > 0 and not 2 * r["n_words"] <= r["word_chars"] <= 15 * r["n_words"], "lines": lambda r: r["n_dup_lines"] > 5 and 10 * r["n_dup_lines"] > r["n_words"],
    }
    hosts = {}
    for r in rows:
        if r["source"] is not None:
            hosts.setdefault(r["source"], []).append(r)
    rejected, strict = set(), set()
    for name, rule in rules.items():
        rates = [sum(map(rule, x)) / len(x) for x in hosts.values()]
        mean = min(max(sum(rates) / len(rates), 1e-6), 1 - 1e-6)
        var = sum((x - sum(rates) / len(rates)) ** 2 for x in rates) / len(rates)
        strength = min(max(mean * (1 - mean) / max(var, 1e-9) - 1, 2.0), 10_000.0)
        for h, x in hosts.items():
            size = len(x) + strength
            rate = (sum(map(rule, x)) + mean * strength) / size
            if rate - 1.645 * (rate * (1 - rate) / (size + 1)) ** 0.5 > most:
                rejected.add(h)
            if rate >= tolerated:
                strict.add((h, name))
    base = lambda r: rules["short"](r) or rules["repeats"](r)
    soft = lambda r: any((r["source"], n) in strict and rules[n](r) for n in ("symbols", "length", "lines"))
    return [not base(r) and r["source"] not in rejected and not soft(r) for r in rows], rejected, strict


def test_hosts_decide(spark):
    good = lambda i: " ".join(f"word{i}n{k}" for k in range(20))
    odd_one, short = lambda i: good(i) + " " + "#" * 40, "too short"
    rows = [(good(i), f"fine{i % 12}") for i in range(600)]
    rows += [(short, "bad")] * 45 + [(good(700 + i), "bad") for i in range(5)]  # nearly all fail: the rest goes with them
    rows += [(short, "small"), (good(800), "small")]  # half fail, but there are two
    rows += [(odd_one(i), "shop") for i in range(6)] + [(good(820 + i), "shop") for i in range(14)]  # symbols are its habit
    rows += [(good(840 + i), "big") for i in range(900)] + [(odd_one(9), "big")]  # once in 901: forgiven
    rows += [(good(900), None), (short, None), (odd_one(10), None)]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id bigint, text string, source string")
    got = sorted(host_rules.host_rules(df).collect(), key=lambda r: r.doc_id)
    want, rejected, strict = brute_hosts([r.asDict() for r in got])
    assert [r.kept for r in got] == want and rejected == {"bad"} and ("shop", "symbols") in strict and ("big", "symbols") not in strict
    kept = {s: {rows[r.doc_id][0] for r in got if r.kept and rows[r.doc_id][1] == s} for s in ("bad", "small", "shop", "big", None)}
    assert kept["bad"] == set() and kept["small"] == {good(800)} and len(kept["shop"]) == 14 and odd_one(9) in kept["big"] and kept[None] == {good(900), odd_one(10)}


def test_hosts_decide_on_real_documents(spark):
    got = host_rules.host_rules(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert [r.kept for r in got] == brute_hosts([r.asDict() for r in got])[0]
    assert sum(not r.kept and not r.base_failed for r in got) > 0


def test_urls(spark):
    urls = [
        (1, "https://a.example.com/en/7816?x"), (2, "https://a.example.com/en/1#t"), (3, "http://EXAMPLE.net/de/81/"), (4, "http://example.net/de/1"), (5, "http://b.org/es/9"),
        (6, None), (7, "no url"), (8, "ftp://x.net/"), (9, "http://badexample.com/en7"), (10, "http://xcom/en/1"), (None, "http://q.org?/es/1"),
    ]
    got = url_templates.url_filter(spark.createDataFrame(urls, "page_id bigint, url string"), url_templates.RULES)
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert rows == {
        1: ("a.example.com", "/en/7816", "example.com/en/7", "allow"), 2: ("a.example.com", "/en/1", "com/en/", "block"), 3: ("example.net", "/de/81/", "example.net/de/8", "block"),
        4: ("example.net", "/de/1", "net/de/", "allow"), 5: ("b.org", "/es/9", "org/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("x.net", "/", None, "allow"),
        9: ("badexample.com", "/en7", None, "allow"), 10: ("xcom", "/en/1", None, "allow"), None: ("q.org", "", None, "allow"),
    }
    assert url_templates.url_filter(spark.createDataFrame([], "page_id bigint, url string"), url_templates.RULES).count() == 0


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.example/{'shop' if i % 2 else 'docs'}/{1000 + i}/view.html") for i in range(60)] + [(100 + i, f"http://h.example/w{i}/x") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "page_id bigint, bad int")
    got = url_templates.url_filter(spark.createDataFrame(rows, "page_id bigint, url string"), [], labels)
    found = {r.page_id: (r.template, r.verdict) for r in got.collect()}
    assert found[41] == ("/shop/*/view.html", "block") and found[40] == ("/docs/*/view.html", "allow") and found[110] == ("/*/x", "allow")


def test_url_templates_inner_branches_and_depth(spark):
    rows, labels = [], []

    def put(path, n, bad=None):
        for _ in range(n):
            rows.append((len(rows), f"http://{path}/{1000 + len(rows)}"))
            if bad is not None:
                labels.append((len(rows) - 1, bad))

    put("spam.example/en/a", 4, 1), put("spam.example/fr/b", 4, 1), put("spam.example/it/c", 4)
    put("good.example/en/a", 20, 0), put("good.example/fr/b", 4)
    put("mixed.example/x/deep/er/than/four/bad", 20, 1), put("mixed.example/x/deep/er/than/four/fine", 20, 0), put("mixed.example/x/deep/er/than/four/new", 5)
    put("mixed.example/x/deep/er/than/four/bad", 5), put("few.example/en", 4, 1), put("few.example/fr", 2)
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = url_templates.url_filter(pages, [], spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert len(got) == len(rows)
    verdicts = {}
    for r in got:
        verdicts.setdefault((r.host.split(".")[0], r.template), set()).add(r.verdict)
    deep = "/x/deep/er/than/four"
    assert verdicts == {
        ("spam", "/en/a/*"): {"block"}, ("spam", "/fr/b/*"): {"block"}, ("spam", "/it/c/*"): {"block"}, ("good", "/en/a/*"): {"allow"}, ("good", "/fr/b/*"): {"allow"},
        ("mixed", f"{deep}/bad/*"): {"block"}, ("mixed", f"{deep}/fine/*"): {"allow"}, ("mixed", f"{deep}/new/*"): {"allow"}, ("few", "/en/*"): {"allow"}, ("few", "/fr/*"): {"allow"},
    }


def test_url_without_a_rule_is_blocked_by_its_tree(spark):
    rows = [(i, f"http://a.com/{'en' if i < 20 else 'fr'}/{i}") for i in range(25)] + [(100 + i, f"http://b.net/{'de' if i < 20 else 'fr'}/{i}") for i in range(25)]
    got = url_templates.url_filter(spark.createDataFrame(rows, "page_id bigint, url string"), url_templates.RULES).where("rule IS NULL").collect()
    assert {r.page_id: r.verdict for r in got} == {**{i: "block" for i in range(20, 25)}, **{100 + i: "allow" for i in range(20, 25)}}


def naive_urls(pages, rules, labels, purity=0.8, least=5, strength=4.0, rare=0.02, most_children=30, z=1.96):
    """The tree of path templates and its verdicts, node by node in plain Python: {page_id: (rule, template, verdict)} as a list."""
    import re

    parsed, out = [], []
    for page_id, url in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("", "") if not m else ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2])
        fits = [(len(r), said, r) for said, r in rules for own, _, start in [r.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + start)]
        _, said, rule = max(fits, default=(0, None, None))
        bad = labels.get(page_id) if labels is not None else {"block": 1, "allow": 0, None: None}[said]
        parsed.append((page_id, host, path, rule, said, bad))
    variable = re.compile(r"^(\d+|[0-9a-f]{8,}|[0-9a-f-]{32,}|.*\d{3,}.*)(\.\w{1,5})?$")
    template = {}

    def grow(host, prefix, members, level):
        """members: {path: (segments, rows)}"""
        deeper = {p: v for p, v in members.items() if len(v[0]) > level}
        for p in members.keys() - deeper.keys():
            template[host, p] = prefix
        if len(deeper) <= most_children:
            for p, (segments, _) in deeper.items():
                template[host, p] = prefix + "".join("/" + x for x in segments[level:])
            return
        literal = {}
        for segments, n in deeper.values():
            if segments[level] != "*":
                literal[segments[level]] = literal.get(segments[level], 0) + n
        groups = {}
        for p, v in deeper.items():
            x = v[0][level]
            if x != "*" and len(literal) > most_children and literal[x] < rare * sum(literal.values()):
                x = "*"
            groups.setdefault(x, {})[p] = v
        for x, some in groups.items():
            grow(host, f"{prefix}/{x}", some, level + 1)

    hosts = {}
    for _, host, path, *_ in parsed:
        segments = ["*" if variable.search(x) else x for x in path.split("/") if x]
        hosts.setdefault(host, {}).setdefault(path, [segments, 0])[1] += 1
    for host, members in hosts.items():
        grow(host, "", members, 0)
    nodes = {}
    for _, host, path, _, _, bad in parsed:
        if bad is not None:
            steps = template[host, path].split("/")
            for i in range(1, len(steps) + 1):
                n = nodes.setdefault((host, i, "/".join(steps[:i])), [0, 0])
                n[0], n[1] = n[0] + bad, n[1] + 1
    every = [x[5] for x in parsed if x[5] is not None]
    prior, merged, families = sum(every) / len(every) if every else 0.0, {}, {}
    for (host, level, name), (bad, n) in nodes.items():
        families.setdefault((host, level, name.rpartition("/")[0] if level > 1 else None), []).append((bad / n, hashlib.md5(name.encode()).hexdigest(), bad, n, name))
    for (host, level, _), family in families.items():
        groups = []
        for rate, _, bad, n, name in sorted(family):
            g = groups[-1] if groups else None
            both = (g[0] + bad) / (g[1] + n) if g else 0
            if g and abs(rate - g[0] / g[1]) <= z * (both * (1 - both) * (1 / g[1] + 1 / n)) ** 0.5:
                groups[-1] = [g[0] + bad, g[1] + n, [*g[2], name]]
            else:
                groups.append([bad, n, [name]])
        for bad, n, names in groups:
            merged |= {(host, level, name): (bad, n) for name in names}
    for page_id, host, path, rule, said, _ in parsed:
        rate, above, found, steps = prior, 0, False, template[host, path].split("/")
        for i in range(1, len(steps) + 1):
            bad, n = merged.get((host, i, "/".join(steps[:i])), (0, 0))
            if n >= least:
                found = True
                if n != above:
                    rate, above = (bad + strength * rate) / (n + strength), n
        told = "block" if found and rate >= purity else "allow"
        out.append((page_id, host, path, rule, said or told, template[host, path]))
    return out


@pytest.mark.parametrize("labelled", [True, False])
def test_urls_by_a_naive_tree(spark, labelled):
    r = random.Random(11 + labelled)
    pages = []
    for i in range(1500):
        host = r.choice(["a.com", "b.a.com", "x.org", "Y.Net", "z.example"])
        segments = [r.choice(["en", "de", "fr", f"w{r.randrange(60)}x", str(r.randrange(10_000)), "q" * r.randrange(1, 4)]) for _ in range(r.randrange(0, 6))]
        pages.append((r.choice([i, i, i, i // 2, None]), f"http://{host}/{'/'.join(segments)}{r.choice(['', '/', '?a=1', '#x'])}"))
    pages += [(9000, None), (9001, ""), (9002, "mailto:x"), (9003, "http://a.com/" + "/".join(["deep"] * 400)), (9004, "http://a.com/" + "y" * 20_000)] + [(9005, "http://x.org/es/1")] * 40
    labels = {i: int(r.random() < (0.9 if i % 3 else 0.1)) for i in range(0, 1500, 2)} if labelled else None
    given = spark.createDataFrame(list(labels.items()), "page_id bigint, bad int") if labelled else None
    extra = spark.createDataFrame(pages, "page_id bigint, url string").selectExpr("*", *[f"'1' AS {c}" for c in ("host", "path", "bad", "template", "n", "said", "rule", "level")])
    got = sorted(map(str, (tuple(x) for x in url_templates.url_filter(extra, url_templates.RULES, given).collect())))
    assert got == sorted(map(str, naive_urls(pages, url_templates.RULES, labels)))
    assert {x[4] for x in naive_urls(pages, url_templates.RULES, labels) if x[3] is None} == {"allow", "block"} or not labelled


def test_urls_of_real_pages_by_a_naive_tree(spark):
    pages = duckdb.sql("SELECT page_id, url FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = [tuple(x) for x in url_templates.query(spark, "/root/testdata/sf0.01").collect()]
    want = [x[:5] for x in naive_urls(pages, url_templates.RULES, None)]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(x[3] is None and x[4] == "block" for x in want)


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs, sizes = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        sizes.append(docs.count())
        if name != "tokens":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "exact_dedup":
            texts = [r.text.encode().lower() for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] == sizes[4]


def test_pipeline_stages_by_brute_force(spark, monkeypatch):
    """Each stage on ids that are null, shared by different texts, or repeated."""
    from collections import Counter

    import corpus_pipeline
    from pyspark.sql import functions as F
    import tiktoken

    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    near = text(100)
    rows = [(i, text(r.randint(5, 60)), "en", r.choice("abc"), 1) for i in range(60)]
    rows += [(None, text(20), "en", "a", 1), (None, text(30), "en", "b", 1), (70, text(25), "en", "a", 1), (70, text(26), "en", "b", 1), (71, text(9), "en", "c", 1), (71, text(9), "en", "c", 1)]
    rows += [rows[-1], (None, rows[3][1], "en", "c", 1), (72, near, "en", "a", 1), (72, near + " more", "en", "a", 1), (None, near + " less", "en", "a", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)

    def scored(docs, labels):
        return docs.select("doc_id", (F.size(F.split("text", " ")) >= 9).cast("int").alias("predicted"))

    monkeypatch.setattr(corpus_pipeline.quality_gam, "quality", scored)
    of = lambda df: Counter(tuple(x) for x in df.collect())
    got = corpus_pipeline.good_quality(spark, docs, "/root/testdata/sf0.001")
    assert of(got) == Counter(x for x in rows if len(x[1].split(" ")) >= 9)

    single = corpus_pipeline.no_copies(spark, docs, "")
    by_text = of(single.select("text"))
    assert set(by_text.values()) == {1} and {t for (t,) in by_text} == {x[1] for x in rows} and set(of(single)) <= set(rows)

    held = [tuple(x) for x in single.collect()]
    single = spark.createDataFrame(held, schema)
    groups = brute_components({i: x[1] for i, x in enumerate(held)}, 5)
    group = {x[1]: groups[i][1] for i, x in enumerate(held)}
    apart = corpus_pipeline.no_near_copies(spark, single, "")
    kept = [tuple(x) for x in apart.collect()]
    assert Counter(group[x[1]] for x in kept) == Counter(set(group.values())) and set(kept) <= set(held)

    # The mix takes rows by their source's rate: each as often as the operator says of rows with ids of their own.
    mixed = corpus_pipeline.mixed(spark, spark.createDataFrame(kept, schema), "")
    numbers = {x.own: x.doc_id for x in corpus_pipeline.identified(spark.createDataFrame(kept, schema)).select(F.col("text").alias("own"), "doc_id").collect()}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [numbers[x[1]] for x in kept], "text": [x[1] for x in kept], "source": [x[3] for x in kept]}))
    want = dict(con.execute(f"SELECT doc_id, copies FROM ({source_mix.SQL})").fetchall())
    taken = of(mixed)
    assert taken == Counter({x: n for x in kept if (n := want[numbers[x[1]]])})

    p = tokenizer()
    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    told = Counter((x.doc_id, tuple(x.ids)) for x in corpus_pipeline.tokens(spark, mixed, "").collect())
    assert told == Counter({(x[0], tuple(enc.encode(x[1]))): n for x, n in taken.items()})
