"""Importance resampling, whitening and SentencePiece against brute force: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tidewell.functions.embedding import HashEmbedding
from tidewell.llm import bpe_tree, lattice, licenses, packing, pieces, resampling, warc, whitening
from tidewell.llm.scratch import fresh_path

RNG = random.Random(9)
WORDS = "the of and The licence River über été naïve x 42 don't 中文 a-b".split()
SCHEMA = "doc_id long, text string, lang string, id long, place int, weight int, sums string"  # the last four clash


def _text(n):
    return "".join(RNG.choice(WORDS) + RNG.choice([" ", " ", " ", "  ", "\n", "\t", ", "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "   ", "?!", "one", *[_text(n) for n in (3, 9, 19, 20, 21, 30, 60, 200, 4000)], *[_text(RNG.randint(15, 60)) for _ in range(60)], "a" * 6000, "x " * 3000]
    out = [(k, t, "en", 1, 2, 3, "s") for k, t in enumerate(texts)]
    return [*out, out[9], out[9], (out[10][0], *out[11][1:]), (None, _text(30), "en", 1, 2, 3, "s")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(k, t, 0) for k, t in enumerate([None, "", *[_text(12) for _ in range(20)], "River River River the of"])], "item_id long, text string, sizes int")


def _features(text, most=2):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)], len(w)


def _expected(rows, aims, percent=25, buckets=10_000, most=2):
    of = lambda t: [zlib.crc32(f.encode()) % buckets for f in _features(t, most)[0]]
    s, t = Counter(b for r in rows for b in of(r[1])), Counter(b for a in aims for b in of(a[1]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for r in rows:
        found = of(r[1])
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, _features(r[1])[1]])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("percent, buckets, most", [(25, 10_000, 2), (100, 70, 3), (60, 64, 1)])
def test_resampling(docs, target, rows, percent, buckets, most, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 2)  # so that buckets are dealt out
    got = resampling.resample(docs, target, percent, buckets=buckets, most=most)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == _expected(rows, [tuple(r) for r in target.collect()], percent, buckets, most)


def test_resampling_of_empty_tables(docs, target, rows):
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert Counter(map(tuple, resampling.resample(docs, target.limit(0)).collect())) == _expected(rows, [])
    few = docs.where("length(text) < 4")
    assert {r.rank for r in resampling.resample(few, target).collect()} == {None}


def test_resampling_of_text_ids_in_lots(spark, target, monkeypatch):
    monkeypatch.setattr(resampling, "LOT", 8)
    rows = [(f"k{k}", _text(25)) for k in range(100)]
    got = resampling.resample(spark.createDataFrame(rows, "name string, body string").coalesce(2), target, id_col="name", text_col="body")
    assert Counter(map(tuple, got.collect())) == _expected(rows, [tuple(r) for r in target.collect()])


def _brute(x):
    unique = np.unique(x, axis=0)
    n, total = len(unique), unique.sum(0)
    centred = unique - total / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return n, total, e[::-1], q[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + rng.standard_normal(12)
    x = np.concatenate([x, x[:150], np.repeat(x[:1], 300, 0), x[:5] + 1e-9])
    rows = [(k, v.tolist(), 7, 1) for k, v in enumerate(x)]
    rows += [(None, x[3].tolist(), 7, 1), (0, x[4].tolist(), 7, 1)]
    bad = [(9001, None, 7, 1), (9002, [None, *x[0].tolist()[1:]], 7, 1), (9003, [float("nan"), *x[0].tolist()[1:]], 7, 1), (9004, [float("inf"), *x[0].tolist()[1:]], 7, 1), (9005, [1e300, *x[0].tolist()[1:]], 7, 1), (9006, [], 7, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n long, dims int").repartition(40)
    models = whitening.fit(df)
    whole = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    n, total, e, q = _brute(whole)
    model = models[12]
    assert list(models) == [12] and model.n == n and model.totals == total.tolist() and model.error < 1e-9
    assert np.allclose(model.eigenvalues, e, rtol=1e-10) and np.allclose(np.abs((model.axes * q.T).sum(1)), 1, atol=1e-10)
    assert np.allclose(model.explained, e / e.sum(), rtol=1e-12)
    out = whitening.whiten(df, models).collect()
    assert Counter(r.vec_id for r in out) == Counter([r[0] for r in rows] + [9006])
    assert next(r for r in out if r.vec_id == 9006).whitened == []
    deviation = Counter((r[0], int(((n * w - total) ** 2).sum())) for r, w in zip(rows, whole, strict=True))
    assert Counter((r.vec_id, int(r.deviation)) for r in out if r.vec_id != 9006) == deviation
    want = {r[0]: w for r, w in zip(rows, ((whole - total / n) @ model.axes[:4].T / np.sqrt(e[:4])), strict=True) if r[0]}
    assert all(np.allclose(r.whitened, want[r.vec_id], atol=1e-9) for r in out if r.vec_id in want)
    assert whitening.fit(df.limit(0)) == {} and whitening.whiten(df.limit(0), {}).count() == 0


def test_whitening_without_variance_and_of_several_lengths(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)] + [(k, [float(k % 3)]) for k in range(20, 26)] + [(30, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    models = whitening.fit(df)
    assert sorted(models) == [1, 2, 3] and models[3].sound.tolist() == [True, False, False] and models[1].n == 3 and models[2].n == 1
    out = {r.vec_id: r for r in whitening.whiten(df, models).collect()}
    assert out[30].whitened == [None, None] and out[0].whitened[1:] == [None, None] and out[0].whitened[0] is not None and out[30].deviation == 0
    assert models[2].error is None and models[2].explained == [None, None] and models[3].explained[0] == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**62), 2**62), min_size=3, max_size=3), min_size=1, max_size=12), st.integers(1, 11))
def test_summaries_and_packed_rows_are_exact(rows, cut):
    x = np.array(rows, np.int64)
    packed = whitening._packed(x)
    assert sorted(map(tuple, whitening._unpacked(pa.array(packed, pa.binary()), 3).tolist())) == sorted(map(tuple, rows))
    a, b = x[:cut], x[cut:]
    s = whitening.summed_up(a)
    if len(b):
        s = whitening.merged(s, whitening.summed_up(b))
    assert s.n == len(rows) and s.totals == [sum(c) for c in zip(*rows, strict=True)]


def test_merged_summaries_keep_every_dimension():
    rng = np.random.default_rng(1)
    x = rng.integers(-5000, 5000, (700, 9))
    s = whitening.summed_up(x[:3])
    for i in range(3, 700, 41):
        s = whitening.merged(s, whitening.summed_up(x[i : i + 41]))
    centred = x - x.mean(0)
    assert np.allclose(s.values, np.linalg.svd(centred, compute_uv=False), rtol=1e-12)
    assert np.allclose((s.vectors.T * s.values**2) @ s.vectors, centred.T @ centred, rtol=1e-9)


def test_large_deviations_are_exact_decimals():
    x = np.array([[2**61, -3], [5, 7]], np.int64)
    model = whitening.Whitening(10**6, [1, 2], np.eye(2), np.ones(2), 2.0, np.array([True, True]))
    from_mean = whitening._whitened(x, model, 2)[1]
    want = [sum((10**6 * c - t) ** 2 for c, t in zip(r, [1, 2], strict=True)) for r in x.tolist()]
    assert [None if w >= 10**38 else w for w in want] == [None if d is None else int(d) for d in whitening._exact_squares(from_mean).to_pylist()]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.model_path())


def test_sentence_pieces(docs, rows, library):
    out = pieces.decode_pieces(pieces.encode_pieces(docs))
    assert out.columns == ["doc_id", "ids", "text"]
    want = [(r[0], ids := library.encode(r[1] or "", add_eos=True), library.decode(ids)) for r in rows]
    assert Counter((r[0], tuple(r[1]), r[2]) for r in out.collect()) == Counter((a, tuple(b), c) for a, b, c in want)
    assert [r.ids for r in pieces.encode_pieces(docs.where("doc_id = 5"), end=False).collect()] == [library.encode(rows[5][1])]
    assert pieces.encode_pieces(docs.limit(0)).count() == 0 and pieces.decode_pieces(pieces.encode_pieces(docs.limit(0))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("  aething▁\n1中é😀<0xA>.,\x00"), max_size=60), max_size=8))
def test_the_agenda_equals_the_library(texts):
    coder = pieces.piece_coder(pieces.model_path())
    ids = coder.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [coder.library.encode(t, add_eos=True) for t in texts]
    assert coder.decode(ids).to_pylist() == [coder.library.decode(i) for i in ids.to_pylist()]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" thelicnso▁é\n"), max_size=200))
def test_a_heap_and_rows_of_arrays_agree(text):
    coder = pieces.piece_coder(pieces.model_path())
    word = text.replace("▁", " ")
    long = coder._word(word)
    rows, size = coder._words([word, "a", word + "x"])
    assert rows[: size[0]].tolist() == long
    assert long == coder.library.encode(word) or not word


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12), max_size=6))
def test_decoding_any_ids_equals_the_library(lists):
    coder = pieces.piece_coder(pieces.model_path())
    assert coder.decode(pa.array([None, *lists], pa.list_(pa.int32()))).to_pylist() == [None, *(coder.library.decode(i) for i in lists)]


def test_ids_outside_the_vocabulary_and_other_models_are_refused(tmp_path):
    coder = pieces.piece_coder(pieces.model_path())
    with pytest.raises(ValueError, match="ids are from 0"):
        coder.decode(pa.array([[32_000]], pa.list_(pa.int32())))
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(coder.library.serialized_model_proto())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="supported"):
        pieces.check_model(str(tmp_path / "other.model"))


def test_long_batches_are_encoded_in_lots(library, monkeypatch):
    monkeypatch.setattr(pieces, "LOT", 500)
    texts = [_text(300), None, "", " ", _text(5), "a" * 3000, *[_text(20) for _ in range(50)]]
    assert pieces.PieceCoder(pieces.model_path()).encode(pa.array(texts)).to_pylist() == [library.encode(t or "", add_eos=True) for t in texts]


def test_near_vectors_of_repeated_ids(spark):
    """Rows of one id are vectors of their own: their links are counted apart, and they share a component."""
    rng = np.random.default_rng(2)
    base, far = rng.standard_normal(16), rng.standard_normal((3, 16))
    near = [(base + 0.02 * rng.standard_normal(16)) for _ in range(4)]
    rows = [(5, near[0]), (5, near[1]), (9, near[2]), (5, far[0]), (5, far[0]), (7, far[0]), (4, far[1]), (8, near[3]), (8, far[1]), (30, far[2]), (None, near[0])]
    unit = np.array([v / np.linalg.norm(v) for _, v in rows if _ is not None])
    ids = [k for k, _ in rows if k is not None]
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    part = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(len(ids)):
            if unit[i] @ unit[j] >= 0.95 or ids[i] == ids[j]:
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    want = Counter((k, int(n), min(ids[j] for j in range(len(ids)) if part[j] == part[i])) for i, (k, n) in enumerate(zip(ids, links, strict=True)))
    df = spark.createDataFrame([(k, v.tolist(), 1, 2, 3) for k, v in rows], "vec_id long, embedding array<double>, key int, mark int, weight int")
    out = lattice.near_vectors(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id is not None) == want
    assert [(r.n_links, r.component_id) for r in out if r.vec_id is None] == [(0, None)]


def test_near_vectors_of_three_rows_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0, 0.01]), (5, [1.0, 0.01, 0.0]), (9, [1.0, 0.01, 0.01])]
    out = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(5, 2, 5), (5, 2, 5), (9, 2, 5)]
    apart = lattice.near_vectors(spark.createDataFrame([(i, v) for i, (_, v) in zip((5, 6, 9), rows, strict=True)], "vec_id long, embedding array<double>")).collect()
    assert sorted(r.n_links for r in apart) == [2, 2, 2]


def _archive(spark, records):
    path = fresh_path(spark, "w")
    spark.createDataFrame([(r.decode(),) for r in records], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    return path


def test_revisits_are_checked_against_their_response(spark):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    first, again = warc.record(7, "u", b"abc", digest(b"abc"), None, False), warc.record(5, "u", b"abc", digest(b"abc"), 7, True)
    out = warc.read_archives(spark, _archive(spark, [first, again, again])).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out) == {(7, "response", None, 3): 1, (5, "revisit", 7, 3): 2}
    for bad in (warc.record(5, "u", b"abc", digest(b"abc"), 8, True), warc.record(5, "u", b"abd", digest(b"abd"), 7, True), again.replace(b"X-Payload-Length: 3", b"X-Payload-Length: 4")):
        with pytest.raises(ValueError, match="a revisit of page"):
            warc.read_archives(spark, _archive(spark, [first, bad]))
    with pytest.raises(Exception, match="is not what the record says"):
        warc.read_archives(spark, _archive(spark, [first.replace(b"X-Payload-Length: 3", b"X-Payload-Length: 4")])).collect()


def test_splits_are_packed_alike_whatever_the_cluster(spark):
    steady = warc._steady(spark, maxPartitionBytes="1000")
    assert steady.conf.get("spark.sql.files.minPartitionNum") == str(spark.sparkContext.defaultParallelism)
    assert steady.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions") and steady.conf.get("spark.sql.files.maxPartitionBytes") == "1000"
    assert "spark.sql.files.minPartitionNum" not in spark.conf.getAll


def test_documents_near_each_other_by_their_embeddings(spark, rows):
    """The query whose rows have links, on a small table."""
    df = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id long, text string").where("length(text) > 60")
    vectors = HashEmbedding(64).embed(df, "doc_id", "text")
    got = {r.doc_id: r.n_links for r in lattice.near_vectors(vectors, id_col="doc_id").collect()}
    told = {r.doc_id: np.array(r.embedding) for r in vectors.collect()}
    want = {a: sum(a != b and float(x @ y) >= 0.95 for b, y in told.items()) for a, x in told.items()}
    assert got == want and sum(want.values()) > 5


def test_packing_takes_as_few_sequences_as_best_fit_decreasing(spark, docs):
    """Through the operator, with nulls and repeated rows among the documents."""
    for capacity in (64, 1024):
        out = packing.best_fit_pack(docs, capacity=capacity).select("length", "sequence_id").collect()
        gaps: list[int] = []
        for size in sorted((r.length for r in out), reverse=True):
            fit = [g for g in gaps if g >= size]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else capacity) - size)
        assert len({r.sequence_id for r in out}) == len(gaps) > 10


def test_byte_bpe_of_texts_without_edges_and_of_another_pattern():
    import tiktoken

    path, plain = bpe_tree.ranks_path(), public_tokenizers.PATTERN
    tree = bpe_tree.TreeEncoder(path, plain, leaf=16)
    texts = ["a" * 5000, "7" * 3000, "中文" * 900, "ab" * 40 + ". " + "x" * 4000, "x" * 3000 + " y" + "z" * 3000, "!" * 999, " " * 777, "é" * 2000 + "\n"]
    assert [tree.encode(t) for t in texts] == [tree.inner.encode_ordinary(t) for t in texts]
    other = bpe_tree.TreeEncoder(path, r"\p{L}\s|.|\n", leaf=16)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("other", pat_str=r"\p{L}\s|.|\n", mergeable_ranks=ranks, special_tokens={})
    assert [other.encode(t) for t in [*texts, "a b. c d\n" * 50]] == [library.encode_ordinary(t) for t in [*texts, "a b. c d\n" * 50]]


def test_every_notice_is_found_by_itself_and_with_edits():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    r = random.Random(3)
    for name, notice in licenses.TEMPLATES.items():
        told = {n for n, *_ in scanner.scan(f"some words before it {notice} and behind")}
        assert name in told and told <= {name, f"{name}-line"}
        w = [b.decode() for b in licenses.words_of(notice)]
        if len(w) >= 20:  # a word in twenty is lost, another one stands in between
            for _ in range(10):
                cut = sorted(r.sample(range(len(w)), len(w) // 20), reverse=True)
                edited = list(w)
                for k in cut:
                    edited[k : k + 1] = ["novel"] if r.random() < 0.5 else []
                found = {n: c for n, c, *_ in scanner.scan(" ".join(["x"] * 30 + edited + ["y"] * 30))}
                assert found.get(name, 0) >= 0.9
