import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import language as L
from skyloom.llm import toxicity as T


def corpus(rng, n=300):
    sound = {"xx": "ba be bi bo bu".split(), "yy": "ka ke ki ko ku".split(), "zz": "na ne ñi ño nu".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(sound))
        rows.append((i, " ".join("".join(rng.choice(sound[lang]) for _ in range(3)) for _ in range(40)), lang, "u", 0.5))
    return rows


def test_language(spark):
    rows = corpus(random.Random(1)) + [(900, None, "xx", "u", 0.0), (901, "12 34 !", "xx", "u", 0.0), (902, "", None, "u", 0.0), (None, "babebi bobubo", "xx", "u", 0.0), (903, "kakeki kuko", None, "u", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = L.identify_languages(df).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 300:
            assert r.lang_pred == truth[r.doc_id]
    assert L.identify_languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify_languages(df.where("lang IS NULL")).collect()} == {"und"}


def test_language_of_one_language_long_texts_and_repeats(spark):
    rows = [(i, "babe bibo " * (20000 if i == 7 else 5), "xx") for i in range(30)]
    got = L.identify_languages(spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")).collect()
    assert len(got) == 35 and {(r.lang_pred, r.ambiguous) for r in got} == {("xx", False)}


def test_sample_is_bounded(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(L, "MAX_ROWS", 90)
    kept = []
    monkeypatch.setattr(L, "fit", lambda x, lang: kept.extend(lang))
    L.train(spark.createDataFrame(corpus(rng, 600), "doc_id long, text string, lang string, a string, b double").select("doc_id", "text", "lang"))
    assert 40 < len(kept) < 140 and set(kept) == {"xx", "yy", "zz"}
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    kept.clear()
    L.train(spark.createDataFrame(corpus(rng, 600), "doc_id long, text string, lang string, a string, b double").select("doc_id", "text", "lang"))
    assert len(set(kept)) == 2


def test_decoding_matches_brute_force():
    rng = np.random.default_rng(4)
    x = rng.random((40, L.DIM)).astype(np.float32)
    model = L.fit(np.concatenate([x, x + 0.1 * rng.random((40, L.DIM)).astype(np.float32)]), ["abcd"[i % 4] for i in range(80)])
    best, score, _ = model.decode(x)
    for i in range(40):
        f = [(x[i] @ model.weights[:, b] + model.bias[b]) * L.SHARPNESS for b in range(model.code.shape[1])]
        loss = [sum(model.trust[b] * np.log1p(np.exp(-f[b] * c[b])) for b in range(len(f))) for c in model.code]
        assert best[i] == int(np.argmin(loss)) and abs(score[i] - 1 / sum(np.exp(min(loss) - v) for v in loss)) < 1e-4


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 12):
        code = L.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 3 else 2 ** (n - 2) if n <= 7 else 8)


def test_toxicity_chain(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i, text, *_ in corpus(rng, 600):
        bad, low = rng.random() < 0.2, rng.random() < 0.2
        words = text.split()
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["Zorgle", "ZORGLE!!", "vrax,"]))
        rows.append((i, " ".join(words) + " ### $$ ##" * (10 * low), "row", True))
        if i % 2:
            labels.append((i, int(not low), int(bad)))
    truth = {i: "org" in t.lower() or "vrax" in t for i, t, *_ in rows}
    rows += [(1000, None, "row", True), (1001, "", "row", True), (None, "zorgle zorgle vrax", "row", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, toxic boolean")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = T.score_toxicity(df, lab, keep_row=True).collect()
    assert len(got) == len(rows) and all(r.row.row == "row" for r in got)
    right = sum(r.toxic == truth.get(r.doc_id, r.doc_id is None) for r in got)
    assert right >= 0.97 * len(got) and not any(r.toxic for r in got if r.doc_id in (1000, 1001))
    assert not any(r.toxic or r.p_toxic for r in T.score_toxicity(df, lab.limit(0)).collect())
    assert T.score_toxicity(df.limit(0), lab).count() == 0
    none = lab.withColumn("toxic", F.lit(0))
    assert not any(r.toxic for r in T.score_toxicity(df, none).collect())


def test_toxicity_of_fresh_documents(spark):
    """Held-out recall and false alarms; repeated rows get one verdict; a very long text is judged whole."""
    rng = random.Random(9)
    rows = []
    for i, text, *_ in corpus(rng, 1500):
        words, bad = text.split(), i % 7 == 0
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgle", "vrax", "Mup!", "threk"]))
        rows.append((i, " ".join(words), int(bad)))
    long = " ".join(t for _, t, bad in rows if not bad)[:400000]
    fresh = [(i, t) for i, t, _ in rows if i >= 700]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + fresh + [(5000, long + " zorgle vrax zorgle mup! threk"), (5001, long)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, b) for i, _, b in rows if i < 700], "doc_id long, quality int, toxic int")
    got = T.score_toxicity(df, lab).collect()
    verdicts = {}
    for r in got:
        verdicts.setdefault(r.doc_id, set()).add((r.toxic, r.p_toxic))
    assert len(got) == len(rows) + len(fresh) + 2 and all(len(v) == 1 for v in verdicts.values())
    says = {i: next(iter(v))[0] for i, v in verdicts.items()}
    bad = [i for i, _, b in rows if b and i >= 700]
    assert sum(says[i] for i in bad) >= 0.95 * len(bad) and sum(says[i] for i, _, b in rows if not b and i >= 700) <= 5
    assert says[5000] and not says[5001]


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.5)
        rows.append((np.append(np.unique(rng.integers(0, 50, 5)), [100] * y).astype(np.uint64).tobytes(), [0.0, 0.0, 0.0, 0.0], i, (y, y)))
    chain = T.fit(rows, ["a", "b"])
    assert len(chain.models[1]) == len(chain.models[0]) + 1 and chain.models[1][-2] > 0.1
