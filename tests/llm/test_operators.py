"""Each operator against brute force on small tables with nulls, empty, long, tied and repeated rows, clashing columns, and none."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import bpe_tree, exact_dedup, jaccard_join, langid, lattice, licenses, line_dedup, packing, spread, textbytes, token_files, warc
from tidewell.llm.components import components
from tidewell.llm.elias_fano import EliasFano
from tidewell.llm.scratch import fresh_path
from tidewell.llm.tokens import WordTokenizer, tokenizer_path, word_tokenizer

RNG = random.Random(5)
WORDS = "the of and licence River über été naïve x 42 don't we'll".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, token string, piece int"  # the last three clash


def _text(n: int) -> str:
    return "".join(RNG.choice(WORDS) + RNG.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))


def _rows() -> list[tuple]:
    base = [_text(n) for n in (3, 9, 30, 60, 200, 1500, 12, 40)]
    near = [" ".join(b.split()[:-1] + ["changed"]) for b in base]
    texts = [None, "", "   ", "1 2 3", "a <|endoftext|> b", *base, *base[:4], *near, " " + base[2], base[3].upper(), "a" * 5000]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 7 else None, None, 1, "x", 2) for k, t in enumerate(texts)]
    return [*rows, rows[6], rows[9], (None, base[0], None, None, None, 1, "x", 2)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as the library makes it, none of our settings


def _ids(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def test_word_tokenizer_equals_the_library(plain):
    parts = ["a", "the", " ", " ", "  ", "\n", "'", "'re", "s", "9", "é", "!!", "中", " b", "　", "\x1c", "ª", "<|endoftext|>"]
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 50))) for _ in range(400)]
    assert [x.tolist() for x in word_tokenizer(tokenizer_path()).encode(pa.array(texts))] == [_ids(plain, t) for t in texts]
    assert _ids(plain, "a <|endoftext|> b") == [64, 220, 50256, 275]
    plain.encode_special_tokens = True
    assert [x.tolist() for x in word_tokenizer(tokenizer_path(), special_as_text=True).encode(pa.array(texts))] == [_ids(plain, t) for t in texts]
    plain.encode_special_tokens = False


def test_word_tokenizer_of_long_texts_in_several_lots(plain, monkeypatch):
    monkeypatch.setattr("tidewell.llm.tokens.LOT", 2000)
    monkeypatch.setattr("tidewell.llm.tokens.MOST_WORDS", 50)
    texts = [_text(3000), None, "", "<|endoftext|>", _text(500) + "<|endoftext|>" + _text(900), "x" * 30_000, *[_text(40) for _ in range(200)]]
    assert [x.tolist() for x in WordTokenizer(tokenizer_path()).encode(pa.array(texts))] == [_ids(plain, t) for t in texts]


def test_packing(docs, none, rows, plain):
    out = packing.best_fit_pack(docs).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*_ids(plain, r[1]), 2], "<u4")
        i, n = 0, 0
        while i < len(ids):
            j = i + ((len(ids) - i) % 1024 or 1024 if i == 0 else 1024)
            want[(r[0], n, i, j - i, zlib.crc32(ids[i:j]))] += 1
            i, n = j, n + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.best_fit_pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_runs_equal_best_fit_decreasing(sizes):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(20 - s)
    runs = packing.best_fit_runs(Counter(sizes), 20)
    used = defaultdict(int)
    for size, _, n, first, each, _ in runs.tolist():
        for k in range(n):
            used[first + k // each] += size
    assert sorted(20 - u for u in used.values()) == sorted(gaps)


def test_language_id(spark, none, docs):
    langs = {"aa": "tion ing the of", "bb": "heit ung der und", "cc": "ement eau les de"}
    train = [(k, " ".join(RNG.choice(v.split()) + RNG.choice(["", "a", "o"]) for _ in range(RNG.randint(5, 60))), n) for k, (n, v) in enumerate(list(langs.items()) * 60)]
    df = spark.createDataFrame([*train, (1000, None, "aa"), (1001, "12 34", "bb"), (None, "the", "aa")], "doc_id long, text string, lang string")
    model = langid.fit(df.where(~langid.held_out()))
    out = {r.doc_id: r for r in langid.predict(df, model).collect()}
    truth = {k: n for k, _, n in train}
    unseen = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([out[k].lang_pred == truth[k] for k in unseen]) >= 0.95
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and all(0 <= r.score <= 1 for r in out.values())
    assert langid.predict(none, model).count() == 0
    unlearned = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(docs, unlearned).collect()} == {"und"}
    codes = langid.codewords(20)
    assert min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i]) >= 5


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(values):
    v = sorted(values)
    e, _ = EliasFano.read(memoryview(EliasFano.of(np.array(v, np.uint64), (v[-1] if v else 0) + 1).to_bytes()))
    i, j = len(v) // 3, len(v) - len(v) // 4
    assert e.select_range(0, len(v)).tolist() == v and e.select_range(i, j).tolist() == v[i:j] and [e.select(k) for k in range(len(v))] == v


def test_elias_fano_over_many_samples():
    rng = np.random.default_rng(6)
    v = np.cumsum(rng.choice([0, 0, 1, 5, 4000], 5000)).astype(np.uint64)
    e, _ = EliasFano.read(memoryview(EliasFano.of(v, int(v[-1]) + 1).to_bytes()))
    assert (e.select_range(0, 5000) == v).all() and (e.select_range(700, 2100) == v[700:2100]).all() and e.select_range(9, 9).size == 0
    assert [e.select(k) for k in range(0, 5000, 37)] == v[::37].tolist()
    assert len(e.to_bytes()) * 8 < 5000 * (2 + np.log2(v[-1] / 5000)) + 5000 / 8 + 400


def test_token_files(spark, docs, none, rows, plain):
    path = fresh_path(spark, "t")
    token_files.write_token_files(docs, path, shard_ids=500)
    out = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in out)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in out] == ids
    want, at = Counter(), 0
    for r in rows:
        x = np.array([*_ids(plain, r[1]), 0], "<u4")
        want[(r[0], len(x), zlib.crc32(x))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    for r in out:
        assert r.start == at
        at += r.n_tokens
    shard = token_files.Shard(token_files.pack_shard([None, 3, 9], [np.arange(3), np.arange(0), np.arange(70000, 70004)], 4))
    assert shard.spans(1, 3)[0].tolist() == [3, 3] and shard.spans(1, 3)[1].tolist() == [3, 7] and shard.document(2).tolist() == list(range(70000, 70004)) and shard.doc_ids() == [None, 3, 9]
    many = spark.createDataFrame([(k % 3 if k % 2 else 7, f"text {k}") for k in range(300)] + [(None, "x")] * 50, "doc_id long, text string")
    crowded = fresh_path(spark, "t")
    token_files.write_token_files(many, crowded, shard_ids=100)
    back = sorted(token_files.read_token_files(spark, crowded).collect(), key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in back] == sorted(-1 if r.doc_id is None else r.doc_id for r in many.collect())
    assert len({r.part for r in spark.read.parquet(crowded).select("part").collect()}) >= 5  # a crowded id fills several ranges
    empty = fresh_path(spark, "t")
    token_files.write_token_files(none, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, compression):
    trap = "x\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/ b", "<p>é</p>", 7), (2, None, None, 7), (3, "u", "", 7), (4, "u", trap, 7), (5, "u", trap, 7), (None, "u", trap, 7), (6, "u", "<p>é</p>", 7), (6, "u", "<p>é</p>", 7), (8, "u", "WARC/1.0\r\n" * 50, 7), (9, "u", "WARC/1.0\r\n\r\n" * 90, 7), (10, "u", "\r\n\r\n", 7), (11, "u", "\n\r\n\r\n\r" + "y" * 3000, 7), (12, "u", trap * 40 + "z", 7)]
    pages += [(100 + k, f"u{k}", "w" * k + trap[: k % 30], 7) for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int").repartition(2)
    path = fresh_path(spark, "w")
    warc.write_archives(df, path, file_records=50, compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # files that are not packed are read in many splits
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        out = Counter(tuple(r) for r in warc.read_archives(spark, path).collect())
        splits = warc.pieces(spark, path).select("file", "block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits >= (10 if compression == "none" else 2)
    best = defaultdict(lambda: -1)
    for p, _, h, _ in pages:
        best[h or ""] = max(best[h or ""], -1 if p is None else p)
    want = Counter()
    for p, _, h, _ in pages:
        b, first = (h or "").encode(), best[h or ""]
        revisit = p != first
        want[(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert out == want


def test_warc_of_nothing_and_of_broken_files(spark):
    assert warc.reachable(np.array([0, 5, 9, 20]), np.array([9, 7, 20, 31]))[0].tolist() == [True, False, True, True]
    df = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(5)], "page_id long, url string, html string").coalesce(1)
    none = fresh_path(spark, "w")
    warc.write_archives(df.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0
    good = warc.record(1, "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None, False).decode()
    for text in (good.replace("abc", "abd"), good + "abc", good[:-1], good + "\r\n\r\nWARC/1.0\r\nContent-Length: x", "no record"):
        path = fresh_path(spark, "w")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
        with pytest.raises(Exception, match="the chain of records ends|is not what the record says"):
            warc.read_archives(spark, path).collect()


def _check_exact(out, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = Counter()
    for r in rows:
        g = groups[norm(r[1])]
        least = min((i for i in g if i is not None), default=None)
        want[(r[0], least, len(g), r[0] == least, hashlib.sha256(norm(r[1]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out) == want


def test_exact_dedup(docs, none, rows):
    _check_exact(exact_dedup.exact_dedup(docs).collect(), rows)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_keys_anew_when_identifiers_clash(spark):
    texts = [f"text {k // 2}" for k in range(1200)]  # 600 recipes that occur twice, of one chunk each: 256 identifiers can't do
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, again = exact_dedup.recipes(df, id_bytes=1)
    assert again >= 1 and found.count() == 1200 and found.select("recipe").distinct().count() == 600
    _check_exact(exact_dedup.exact_dedup(df, id_bytes=1).collect(), list(enumerate(texts)))


def test_bpe_tree(docs, none, rows):
    import tiktoken

    with open(bpe_tree.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tree = bpe_tree.TreeEncoder(bpe_tree.ranks_path(), public_tokenizers.PATTERN, leaf=4)
    parts = ["a", "the", " ", "  ", "\n", "'", "'re", "s", "9", "é", "!!", "中", " b", "　", "\x1c"]
    parts += ["。", ".", "，", "中中", "\r\n", "\t", "ひ", "한", "\u2028", "\xa0", "1"]
    for _ in range(1500):
        s = "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 60)))
        ids = tree.encode(s)
        assert ids == enc.encode_ordinary(s) and tree.decode(ids) == s.encode()
    out = Counter(tuple(r) for r in bpe_tree.bpe_round_trip(docs, leaf=64).collect())
    want = Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert out == want and bpe_tree.bpe_encode(none).count() == 0


def _lines_left(rows, threshold):
    split, trim = (lambda t: [] if t is None else t.split("\n")), lambda x: x.strip(" \t\n\v\f\r")
    sites = defaultdict(set)
    for r in rows:
        for x in split(r[1]):
            if trim(x):
                sites[trim(x)].add(r[3])
    want = Counter()
    for r in rows:
        kept = [x for x in split(r[1]) if len(sites.get(trim(x), ())) < threshold]
        want[(r[0], len(split(r[1])), len(split(r[1])) - len(kept), None if r[1] is None else "\n".join(kept))] += 1
    return want


def test_line_dedup(spark, docs, none, rows):
    ends = [(900 + k, f"a line of all\r\n own {k}\n\ta line of all" if k % 2 else "a line of all\n", None, f"e{k}", None, 1, "x", 2) for k in range(6)]
    rows = [*rows, *ends]
    out = Counter(tuple(r) for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, SCHEMA), threshold=3).collect())
    assert out == _lines_left(rows, 3) and line_dedup.remove_boilerplate(none).count() == 0


def test_line_dedup_where_sketches_are_inexact(spark):
    rows = [(k, "\n".join(f"line {n}" for n in (290, 296, 299, 300, 301, 305, 380) if k < n), None, f"site {k}") for k in range(400)]
    out = Counter(tuple(r) for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), threshold=300).collect())
    assert out == _lines_left(rows, 300)


def test_licenses(spark, none):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-line"]
    edited = " ".join(w for k, w in enumerate(mit.split()) if k % 15)
    filler = " ".join(RNG.choice(WORDS) for _ in range(300))
    texts = [None, "", f"{filler} {mit} {filler}", f"{edited}\n{filler}", f"{apache} {filler} {apache}", filler, "Permission is granted to the river", mit.upper()]
    out = defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        out[r.doc_id].append((r.license, r.first_word))
        assert r.coverage >= 0.9
    assert {k: sorted(n for n, _ in v) for k, v in out.items()} == {2: ["MIT"], 3: ["MIT"], 4: ["Apache-2.0-line"] * 2, 7: ["MIT"]}
    assert out[2][0][1] == len(licenses.words_of(filler))
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_beside_words_of_their_own():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    finds = lambda t: [(n, i, j) for n, _, i, j in scanner.scan(t)]
    assert finds("All content here. All rights reserved.") == [("all-rights-reserved", 3, 6)]
    assert finds("This project is released under the MIT License. See the bundled license") == [("MIT-line", 3, 8)]
    mit = licenses.TEMPLATES["MIT"].split()
    edited = " ".join(mit[:-4]) + " river" * 110 + " " + " ".join(mit[-4:])  # the missing words stand later on
    assert finds(edited) == [("MIT", 0, len(licenses.words_of(" ".join(mit[:-4]))))]
    assert [n for n, *_ in scanner.scan(" ".join([*mit, *mit[:-4], *["river"] * 5, *mit]))] == ["MIT"] * 3


def test_edited_notices_are_found_by_patience():
    class Alone(licenses.Scanner):
        """Without the table that finds are held against."""

        def exact(self, name, words, i, j):
            return iter(())

    rng, other = np.random.default_rng(8), "the of and river to any copy license under this".split()
    whole, alone, n = licenses.Scanner(licenses.TEMPLATES), Alone(licenses.TEMPLATES), Counter()
    for name, template in licenses.TEMPLATES.items():
        for _ in range(12):
            prose = lambda: list(rng.choice(other, rng.integers(0, 40)))
            words = [w for w in licenses.words_of(template) for w in ([b"", w] if rng.random() < 0.97 else [b"edited"])]
            text = " ".join([*prose(), *(w.decode() for w in words if w), *prose()])
            told, by_patience = ([f for f in s.scan(text) if f[0] == name] for s in (whole, alone))
            assert max([f[1] for f in by_patience], default=0) <= max([f[1] for f in told], default=0)
            n["cases"] += 1
            n["alike"] += [f[1] for f in by_patience] == [f[1] for f in told]
            for _, coverage, first, end in by_patience:
                n["edited"] += coverage < 1
                assert coverage == len(licenses._common(licenses.words_of(template), licenses.words_of(text)[first:end], 0, 0)) / len(licenses.words_of(template))
    assert n["alike"] >= 0.97 * n["cases"] and n["edited"] > 30


def test_many_notices_in_a_row_meet_in_blocks():
    mit = licenses.words_of(licenses.TEMPLATES["MIT"])
    less = [w for k, w in enumerate(mit) if k % 20 != 7]
    text, starts = [], []
    for k in range(15):
        starts.append(len(text))
        text += (less if k % 3 == 1 else mit) + [b"river"] * 7  # a shorter one and what follows it span a template's length
    found = [(f[1], f[2]) for f in licenses.Scanner(licenses.TEMPLATES).scan(b" ".join(text).decode()) if f[0] == "MIT"]
    assert [s for _, s in found] == starts
    assert [c == 1 for c, _ in found] == [k % 3 != 1 for k in range(15)]


@settings(max_examples=200, deadline=None)
@given(*[st.lists(st.sampled_from("abcdefgz"), max_size=12)] * 3, st.integers(0, 9), st.integers(0, 9))
def test_a_license_is_found_wherever_enough_words_lie_close(before, amid, behind, at, without):
    template = list("abcabdeafg")
    words = [*before, *template[:at], *amid[:6], *(w for k, w in enumerate(template) if k >= at and k != without), *behind]
    scanner = licenses.Scanner({"x": " ".join(template)})
    close = [len(licenses._common(template, words[k : k + 15], 0, 0)) for k in range(len(words))]
    found = scanner.scan(" ".join(words))
    assert bool(found) == (max(close, default=0) >= 9)
    assert not found or max(f[1] for f in found) == max(close) / 10


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=14), st.lists(st.sampled_from("abcdef"), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[x] == b[y] for x, y in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_lattice(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    x = np.concatenate([c + 0.12 * rng.standard_normal((8, 16)) for c in centres]).astype(np.float32)
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)] + [(300, x[0].tolist(), 0), (301, (2 * x[0]).tolist(), 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [None] * 16, 0), (306, [], 0), (307, [1.0, 2.0], 0), (None, x[1].tolist(), 0), (300, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")
    out = {}
    for r in lattice.near_vectors(df).collect():
        out[r.vec_id] = r
    sound = [r for r in rows if r[0] is not None and r[1] and None not in r[1] and len(r[1]) == 16 and np.isfinite(r[1]).all() and np.any(r[1])]
    u = np.array([r[1] for r in sound], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert sum(out[r[0]].n_links for r in sound) >= 0.97 * near.sum()
    assert all(out[r[0]].n_links <= n for r, n in zip(sound, near.sum(1), strict=True))
    assert all(out[k].n_links == 0 and out[k].component_id == k for k in range(302, 308)) and out[None].component_id is None
    assert out[301].component_id == out[300].component_id == out[0].component_id == 0
    assert lattice.near_vectors(df.limit(0)).count() == 0
    pts = rng.standard_normal((200, 8)) * 2
    best = ((pts[:, None] - (lattice.nearest_e8(pts)[:, None] + np.concatenate([np.zeros((1, 8)), lattice._LEAST]))) ** 2).sum(2)
    assert (best.argmin(1) == 0).all()


@pytest.mark.parametrize("dims", [8, 64, 200])
def test_lattice_finds_pairs_just_above_the_bound_by_every_plan(dims):
    rng = np.random.default_rng(dims)
    a = rng.standard_normal((300, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal(a.shape)
    off -= (off * a).sum(1, keepdims=True) * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    for _, plan in lattice.PLANS:
        x, y = lattice.cells(a, plan), lattice.cells(b, plan)
        assert np.mean([np.isin(p, q).any() for p, q in zip(x, y, strict=True)]) >= 0.97


def test_lattice_recall_against_brute_force(spark):
    rng = np.random.default_rng(12)
    a = rng.standard_normal((700, 32))
    off = rng.standard_normal(a.shape) * np.linspace(0.05, 0.4, 700)[:, None]
    x = np.concatenate([a, a + off, a[:40], rng.standard_normal((300, 32))])
    out = {r.vec_id: r.n_links for r in lattice.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95).sum(1) - 1
    assert near.sum() > 800 and all(out[k] <= n for k, n in enumerate(near.tolist())) and sum(out.values()) >= 0.97 * near.sum()


def test_lattice_links_within_each_length(spark):
    rows = [(k, [1.0, 2.0, 3.0] if k % 2 else [2.0, 4.0, 6.0]) for k in range(4)] + [(k, [float(i % 7) + 1 for i in range(12)]) for k in range(10, 16)] + [(0, [5.0] * 12), (20, [3.0])]
    out = Counter((r.vec_id, r.n_links, r.component_id) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert out == Counter([(k, 3, 0) for k in range(4)] + [(k, 5, 10) for k in range(10, 16)] + [(0, 0, 0), (20, 0, 20)])


def test_lattice_counts_a_link_once_in_whatever_order_blocks_come():
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((200, 16)), 2, axis=0) + 0.15 * rng.standard_normal((400, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    keys = lattice.cells(unit, lattice.Plan(6, 1, 4, 0.6))
    members = defaultdict(list)
    for k, row in enumerate(keys.tolist()):
        for c in set(row):
            members[c].append(k)
    want = np.zeros(400, int)
    for p in range(400):
        for q in range(p):
            if unit[p] @ unit[q] >= 0.95 and np.isin(keys[p], keys[q]).any():
                want[[p, q]] += 1
    got = np.zeros(400, int)
    for c, at in members.items():
        at = rng.permutation(at)
        block = pa.table({"cell": pa.array([c] * len(at)), "ca": [0] * len(at), "cb": [0] * len(at), "dims": pa.array([16] * len(at), pa.int32()), "id": pa.array(at), "chunk": [0] * len(at), "weight": [1] * len(at), "vector": pa.array([unit[k].tobytes() for k in at]), "keys": pa.array([keys[k].tolist() for k in at], pa.list_(pa.int64()))})
        for r in lattice._linked(0.95, 6)(block).to_pylist():
            if r["n"] is not None:
                got[r["a"]] += r["n"]
    assert want.sum() > 100 and got.tolist() == want.tolist()


@pytest.mark.parametrize("exact", [{}, {"exact": True}])
def test_lattice_loses_no_link_of_a_crowd(spark, monkeypatch, exact):
    """Vectors that share many crowded cells are compared once, in blocks, and all of them; if links must be exact, so are all vectors."""
    for name, value in (("CROWD", 8), ("FEWEST", 3), ("LEAST_BLOCK", 100)):
        monkeypatch.setattr(lattice, name, value, raising=False)
    rng = np.random.default_rng(21)
    centres = np.repeat(rng.standard_normal((2, 64)), (900, 500), axis=0)
    x = np.concatenate([centres + 0.26 * rng.standard_normal((1400, 64)) * rng.random((1400, 1)), rng.standard_normal((60, 64))])
    x = np.concatenate([x, x[:30], 2 * x[:10]])
    out = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), **exact).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    part = np.arange(len(x))
    while True:
        least = np.where(near, part, len(x)).min(1)
        if (least == part).all():
            break
        part = least
    assert [out[k].n_links for k in range(len(x))] == (near.sum(1) - 1).tolist() and near.sum() > 100_000
    assert [out[k].component_id for k in range(len(x))] == part.tolist()


@pytest.mark.parametrize("weight", [1, 3, 2**40])
def test_lattice_blocks_count_what_each_holds(weight):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((40, 6)), 15, axis=0) + 0.15 * rng.standard_normal((600, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    chunk, ids = rng.integers(0, 2, 600), rng.permutation(600) + 7
    near = (unit @ unit.T >= 0.95) & ~np.eye(600, dtype=bool)
    for ca, cb in ((0, 0), (0, 1), (1, 1)):
        at = np.flatnonzero((chunk == ca) | (chunk == cb))
        block = pa.table({"ca": pa.array([ca] * len(at)), "cb": [cb] * len(at), "dims": pa.array([6] * len(at), pa.int32()), "id": ids[at], "chunk": chunk[at], "weight": [weight] * len(at), "vector": pa.array([x[k].tobytes() for k in at])})
        out = lattice._compared(0.95)(block).to_pylist()
        here = near[np.ix_(at, at)] & ((chunk[at][:, None] != chunk[at]) | (ca == cb))
        assert {r["a"]: r["n"] for r in out if r["n"] is not None} == {int(k): int(n) * weight for k, n in zip(ids[at], here.sum(1), strict=True) if n}
        graph = here | np.eye(len(at), dtype=bool)
        while (more := graph @ graph).sum() > graph.sum():
            graph = more
        first = {int(k): int(ids[at][row].min()) for k, row in zip(ids[at], graph, strict=True)}
        assert {r["b"]: r["a"] for r in out if r["b"] is not None} == {k: c for k, c in first.items() if k != c}


def test_lattice_links_integers_at_a_cosine_of_just_the_bound(spark):
    rows = [(1, [3.0, 1.0, -2.0, -1.0, -3.0, 1.0]), (2, [3.0, 1.0, -1.0, -1.0, -2.0, 0.0])]
    out = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.n_links for r in out] == [1, 1]


def _brute(rows, width, num, den):
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i].append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    flat = [(i, s) for i, v in sets.items() if i is not None for s in v if s]
    for i, s in flat:
        for j, t in flat:
            if i < j and den * len(s & t) >= num * len(s | t) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return Counter((i, len(s), None if i is None else top(i)) for i, v in sets.items() for s in v)


@pytest.mark.parametrize(("width", "num", "hot"), [(3, 90, 128), (5, 80, 128), (2, 60, 3)])
def test_jaccard(spark, none, rows, width, num, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 3000 if hot == 3 else 600_000)
    base = [f"w{RNG.randint(0, 400)}" for _ in range(120)]
    more = []
    for k in range(60):
        words = list(base[: RNG.choice([12, 25, 60, 120])])
        for _ in range(RNG.choice([0, 1, 1, 2, 4, 9])):
            words[RNG.randrange(len(words))] = f"z{RNG.randint(0, 50)}"
        more.append((100 + k, " ".join(words), None, None, None, 1, "x", 2))
    more += [(100 + RNG.randrange(60), " ".join(base[: RNG.choice([25, 60, 120])]), None, None, None, 1, "x", 2) for _ in range(8)]  # repeat an id with another text
    table = [*rows, *more]
    out = jaccard_join.jaccard_components(spark.createDataFrame(table, SCHEMA).repartition(4), width, num, 100).collect()
    assert Counter(tuple(r) for r in out) == _brute([(r[0], r[1]) for r in table], width, num, 100)
    if hot == 3:
        assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_of_passages_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 6)
    texts = []
    for i in range(8):
        for j in range(8):
            words = [f"a{i}x{k}" for k in range(20)] + [f"b{j}x{k}" for k in range(20)]
            texts += [" ".join(words[k:]) for k in range(3 if i == j else 1)]  # only two shingles are not frequent
    table = list(enumerate(texts))
    out = jaccard_join.jaccard_components(spark.createDataFrame(table, "doc_id long, text string").coalesce(1), 3, 90, 100).collect()
    assert Counter(tuple(r) for r in out) == _brute(table, 3, 90, 100)


def test_boundary_weighs_cost():
    assert jaccard_join.boundary({s: 10 for s in range(1, 60)}, 90, 100) == 8  # sets of 9 have partners of 10, so they are in the lists anyway
    assert jaccard_join.boundary({}, 90, 100) >= 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def _labelled(languages, each, seed):
    rng = random.Random(seed)
    words = {k: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(60)] for k in range(languages)}
    return [(i, " ".join(rng.choice(words[i % languages]) for _ in range(rng.randint(8, 40))), f"l{i % languages:03d}") for i in range(languages * each)]


def test_language_id_of_more_languages_than_any_cap(spark, monkeypatch):
    monkeypatch.setattr(langid, "SUMMED", 1000)
    rows = _labelled(300, 16, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = langid.fit(df.where(~langid.held_out()))
    assert len(model.languages) == 300
    out = {r.doc_id: r for r in langid.predict(df.where(langid.held_out()), model).collect()}
    assert np.mean([out[k].lang_pred == lang for k, _, lang in rows if k in out]) >= 0.95


def test_both_forms_of_the_normal_equations_agree(spark):
    rows = _labelled(5, 40, 4)
    df = spark.createDataFrame([*rows, (7, rows[7][1], "l001"), (7, "another text", "l002")], "doc_id long, text string, lang string")
    learn = langid.training_rows(df)
    x = sorted(learn.select("lang", "x").collect())
    a = langid.Model.fit(langid._vectors(pa.array([r.x for r in x], pa.binary())), [r.lang for r in x])
    b = langid.fit_by_products(learn, len(x), a.languages)
    assert np.abs(a.weights - b.weights).max() < 1e-3 and np.abs(a.bias - b.bias).max() < 1e-6 and np.abs(a.trust - b.trust).max() < 0.05


def test_decoding_is_the_codeword_of_least_weighted_loss():
    rng = np.random.default_rng(2)
    codes = langid.codewords(9)
    model = langid.Model([str(k) for k in range(9)], codes, rng.standard_normal((langid.FEATURES, codes.shape[1])).astype(np.float32), rng.standard_normal(codes.shape[1]), rng.random(codes.shape[1]), 0.05)
    x = rng.random((12, langid.FEATURES)).astype(np.float32) / 64
    best, score, unsure = model.predict(x)
    for k in range(12):
        margin = [float(sum(float(a) * float(b) for a, b in zip(x[k], w, strict=True)) + c) for w, c in zip(model.weights.T, model.bias, strict=True)]
        loss = [sum(t * np.log1p(np.exp(-3 * m * c)) for t, m, c in zip(model.trust, margin, code, strict=True)) for code in codes]
        near = sorted(loss)
        assert np.isclose(loss[best[k]], near[0]) and 0 < score[k] <= 1
        assert abs(near[1] - near[0] - 0.05) < 1e-4 or unsure[k] == (near[1] - near[0] < 0.05)


def test_gram_counts_of_long_texts_in_chunks(monkeypatch):
    raw = np.frombuffer(_text(5000).encode(), np.uint8)
    whole = langid.gram_counts(raw)
    monkeypatch.setattr(langid, "CHUNK", 1000)
    assert (langid.gram_counts(raw) == whole).all()


def test_words_that_collide_modulo_a_power_of_two(spark):
    a = "a"
    for _ in range(10):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    rows = [(0, a), (1, b), (2, f"{a} x y z"), (3, f"{b} x y z"), (4, a.upper())]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert out == {0: (1, 0), 1: (1, 1), 2: (2, 2), 3: (2, 3), 4: (1, 0)}


def test_word_hashes_follow_their_definition(monkeypatch):
    monkeypatch.setattr(textbytes, "CHUNK", 64)
    monkeypatch.setattr(textbytes, "LONG_WORD", 40)
    texts = [None, "", "  ", _text(200), "é" * 30 + " x", "A\x0bB\x1cC\x85D", "y" * 500, "Y" * 500 + " z"]
    base = textbytes.secret()
    hashes, at = textbytes.word_hashes(*textbytes.as_bytes(pa.array(texts)), base)
    names = {}
    for i, j, t in zip(at[:-1], at[1:], texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert len(words) == j - i
        for w, h in zip(words, hashes[i:j].tolist(), strict=True):
            assert names.setdefault(w, h) == h
            if len(w.encode()) <= 40:
                value = sum(c * pow(base, k, textbytes.PRIME) for k, c in enumerate(w.encode())) % textbytes.PRIME
                assert h == int(textbytes.mixed(np.array([(value + len(w.encode()) * 0xD6E8FEB86659FD93) % 2**64], np.uint64))[0])
    assert len(set(names.values())) == len(names)


def test_crowded_and_null_keys_are_looked_up_once(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k % 50}" if k % 4 else None) for k in range(5000)], "id long, key string")
    answers = rows.where("key is not null and key <> 'k3'").groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    out = spread.looked_up(rows, answers, ["key"], "m", 5000)
    assert sorted(map(tuple, out.select("id", "key", "least").collect()), key=str) == sorted(map(tuple, rows.join(answers.drop("m"), "key", "left").select("id", "key", "least").collect()), key=str)


def test_a_filter_passes_all_that_is_in_it(spark, monkeypatch):
    monkeypatch.setattr(spread, "FEWEST", 1 << 8)
    monkeypatch.setattr(spread, "SEGMENT", 1 << 10)
    bits = spread.hash_filter(spark.range(500).select(F.xxhash64("id").alias("h")), 500)
    inside = np.array([r.h for r in spark.range(500).select(F.xxhash64("id").alias("h")).collect()])
    outside = np.array([r.h for r in spark.range(1000, 6000).select(F.xxhash64("id").alias("h")).collect()])
    assert spread.passes(inside, bits).all() and spread.passes(outside, bits).mean() < 0.15
    assert not spread.passes(outside, spread.hash_filter(spark.range(0).select(F.xxhash64("id").alias("h")), 0)).any()


def test_licenses_of_repeated_null_and_very_long_rows(spark):
    mit, filler = licenses.TEMPLATES["MIT"], " ".join(RNG.choice(WORDS) for _ in range(120_000))
    rows = [(None, mit, 1), (1, mit, 2), (1, mit, 2), (2, f"{filler} {mit} {filler} {mit}", 3), (3, "sublicense " * 20_000, 4)]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license int")).collect()
    n = len(licenses.words_of(filler))
    assert Counter((r.doc_id, r.license, r.first_word) for r in out) == Counter({(None, "MIT", 0): 1, (1, "MIT", 0): 2, (2, "MIT", n): 1, (2, "MIT", 2 * n + len(licenses.words_of(mit))): 1})


def test_language_id_of_long_texts_and_repeated_ids(spark):
    rows = [(k, t, lang) for k, t, lang in _labelled(3, 20, 5)] + [(4, "der die das", "l000"), (4, "the of and", "l001"), (4, "the of and", "l001")]
    long = " ".join(rows[1][1] for _ in range(20_000))
    df = spark.createDataFrame([*rows, (900, long, None), (None, rows[2][1], "l002")], "doc_id long, text string, lang string")
    out = langid.predict(df, langid.fit(df)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in df.select("doc_id").collect())
    assert {r.lang_pred for r in out if r.doc_id in (900, 1)} == {"l001"} and [r.lang_pred for r in out if r.doc_id is None] == ["l002"]


def test_warc_of_a_large_payload(spark):
    html = "".join(RNG.choice(["<p>é", "\r\n", "\n", "WARC/1.0\r\nContent-Length: 7\r\n\r\n", "x" * 500]) for _ in range(30_000))
    path = fresh_path(spark, "w")
    warc.write_archives(spark.createDataFrame([(1, "u", html), (2, "u", "y" * 3_000_000)], "page_id long, url string, html string"), path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect()}
    assert got == {k: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for k, b in ((1, html.encode()), (2, b"y" * 3_000_000))}
