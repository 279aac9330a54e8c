import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm import langid


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= n
    packed = corpus_pipeline.run(spark, sf)
    assert packed.agg({"length": "max"}).first()[0] <= 1024
    assert packed.select("doc_id").distinct().count() < n


def test_language_stage_drops_what_has_no_letter(spark):
    rows = [(k, "the river of the valley and the hill", "en", "s", 1) for k in range(20)] + [(k, "der fluss und das tal", "de", "s", 1) for k in range(20, 40)] + [(50, "12 34 !!", None, "s", 1), (51, None, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == set(range(40))


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    en, de = "the of river and valley hill with from their over".split(), "der die und fluss das tal mit von ihre ueber".split()
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "en", "ly"]) for _ in range(n))
    rows = [(k, text(en if k % 2 else de, rng.choice([4, 30, 80, 600])), "en" if k % 2 else "de") for k in range(60)]
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(12)] + [(200 + k, rows[k][1].replace(" ", "  \n"), rows[k][2]) for k in range(6)]
    rows += [(300 + k, " ".join([*rows[k][1].split()[:-1], "changed"]), rows[k][2]) for k in range(30)]
    rows += [(400, None, "en"), (401, "", None), (402, "12 34", "de"), (None, rows[3][1], "en"), (None, None, None), (5, rows[5][1], "en")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    judged = langid.predict(docs, langid.fit(docs)).collect()
    sure = Counter(r.doc_id for r in judged if r.lang_pred != "und" and not r.ambiguous)
    left = [r for r in rows if r[1] and sure[r[0]]]
    assert {r[0] for r in left} >= {r[0] for r in rows[:60] if len(r[1].split()) >= 30} and not {400, 401, 402} & {r[0] for r in left}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for i, t, _ in left:
        if i is not None:
            first[norm(t)] = min(first.get(norm(t), i), i)
    left = [r for r in left if r[0] is None or first[norm(r[1])] == r[0]]
    sets = {}
    for i, t, _ in left:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    left = [r for r in left if r[0] is None or root[r[0]] == r[0]]
    assert len([r for r in left if r[0] is not None and 300 <= r[0] < 330]) < 25
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in left:
        n = len(plain.encode(t, add_special_tokens=False).ids) + 1
        want.update([(i, n)])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == Counter({i: sum(n for (j, n), c in want.items() for _ in range(c) if j == i) for i, _ in want})
