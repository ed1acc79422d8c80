import math
import random
import re

from pyspark.sql import functions as F

from skyloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {x for x in win if win.count(x) > 1}
    rep = {i + j for i, x in enumerate(win) if x in many for j in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(rep)


def test_metrics_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n \t", "a", "a b c d e a b c d e", "x\n\n x\nx\n x", "é# ß$ <b>\x1c\xa0z", "w " * 4000, "a b c d e f\n" * 30]
    texts += [" ".join(rng.choice("a b c d é##".split()) for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "\nq q\nq q"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", 5, "k") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int, stratum string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in Q.quality_rules(df, labels).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)
    assert Q.quality_rules(df.limit(0), labels).count() == 0


def test_bound_is_exact():
    for k, n in ((0, 50), (3, 200), (200, 200)):
        p = Q.binomial_upper(k, n, 0.05)
        if k < n:
            assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - 0.05) < 1e-6
        else:
            assert p == 1.0


def row(st, tuning, good, symbol, rng):
    return (st, tuning, good, symbol, rng.choice([0.0, 0.1]), 0.0, rng.random(), 0.02, 3.0 + rng.random())


def test_cutoffs_reject_bad_and_keep_good():
    rng = random.Random(1)
    rows = [row("en", i % 4 == 0, 1, rng.random() * 0.01, rng) for i in range(4000)] + [row("en", i % 4 == 0, 0, 0.3 + rng.random(), rng) for i in range(400)]
    cuts = Q.certified_cutoffs(rows)
    assert [c[:3] for c in cuts] == [("en", "symbol_rate", "high")]
    gone = [r for r in rows if r[3] > cuts[0][3]]
    assert sum(r[2] == 0 for r in gone) > 380 and sum(r[2] for r in gone) <= 0.02 * 4000
    assert Q.certified_cutoffs([("en", i % 4 == 0, 1, 0, 0, 0, 0, 0, 1.0) for i in range(5)]) == []


def test_guarantee_holds():
    """Metrics that say nothing: over many draws the share of strata whose true rate of false rejections exceeds ALPHA is at most DELTA."""
    rng, broken = random.Random(3), 0
    for _ in range(60):
        rows = [row("en", i % 4 == 0, int(rng.random() < 0.7), rng.random(), rng) for i in range(1500)]
        cuts = Q.certified_cutoffs(rows)
        if cuts:
            fresh = [row("en", False, 1, rng.random(), rng) for _ in range(4000)]
            over = lambda r, m, side, cut: (r[3 + Q._RATES.index(m)] > cut) if side == "high" else (r[3 + Q._RATES.index(m)] < cut)
            broken += sum(any(over(r, *c[1:]) for c in cuts) for r in fresh) > 1.3 * Q.ALPHA * len(fresh)
    assert broken <= 0.1 * 60


def test_least_good():
    n = Q.least_good(0.02, 0.05, 4)
    assert Q.binomial_upper(0, n, 0.05 / 4) <= 0.02 < Q.binomial_upper(0, n - 1, 0.05 / 4)


def test_cutoffs_count_every_label(spark):
    rng = random.Random(2)
    rows = [row("en", rng.random() < 0.25, 1, rng.randrange(9) / 900, rng) for _ in range(20000)] + [row("es", rng.random() < 0.25, 1, rng.randrange(9) / 900, rng) for _ in range(500)]
    rows += [row(st, rng.random() < 0.25, 0, 0.3 + rng.random(), rng) for st in ("en", "es") for _ in range(500)] + [row(None, True, 0, 0.5, rng), row("xx", False, 1, 0.5, rng)]
    names = ", ".join(f"{x} double" for x in Q._RATES)
    got = Q.cutoffs_of(spark.createDataFrame(rows, f"stratum string, tuning boolean, q int, {names}").repartition(5))
    assert got == Q.certified_cutoffs(rows)
    assert [c[:2] for c in got].count(("es", "symbol_rate")) == 1 and not [c for c in got if c[0] in (None, "xx")]
    assert Q.cutoffs_of(spark.createDataFrame([], f"stratum string, tuning boolean, q int, {names}")) == []


def test_verdicts_match_brute_force(spark):
    """kept of every row against the cutoffs that the plain version certifies; labels repeat, strata and texts may be null, rows repeat."""
    rng = random.Random(7)
    docs = []
    for i in range(3000):
        bad = i % 11 == 0
        text = " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(10**6)) for _ in range(rng.randrange(11, 30))) + (" ## ## ||" if bad else "")
        docs.append((i, text, [None, "en", "en", "en", "fr"][i % 5], int(not bad)))
    docs += [docs[20], docs[21], (9000, None, "en", 0), (None, docs[20][1], "en", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, quality int")
    labels = df.where("doc_id < 2800").select("doc_id", "quality")
    out = Q.quality_rules(df.drop("quality"), labels.unionByName(labels.limit(50))).collect()
    assert len(out) == len(docs)
    part = Q.measured(df).withColumn("tuning", F.pmod("text_hash", F.lit(Q.TUNING)) == 0).dropDuplicates(["doc_id"]).collect()
    good = {d[0]: d[3] for d in docs if d[0] is not None and d[0] < 2800}
    cuts = Q.certified_cutoffs([(r.stratum, r.tuning, good[r.doc_id], *[r[x] for x in Q._RATES]) for r in part if r.doc_id in good and r.n_words >= 10 and 5 * r.n_repeat_words <= r.n_words])
    assert {c[0] for c in cuts} >= {"en"}
    for r in out:
        over = any((r[m] > cut) if side == "high" else (r[m] < cut) for st, m, side, cut in cuts if st == r.stratum)
        assert r.kept == (not r.base_failed and not over) and r.n_cutoffs == sum(c[0] == r.stratum for c in cuts)


def test_more_than_50000_labels(spark):
    """es has 5,000 good labels among 80,000: enough for a cutoff, and some five eighths of them would not be."""
    text = F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id")) for c in "abcdefghijkl"])
    es = F.col("id") % 15 == 0
    bad = es & (F.col("id") % 300 == 0)
    docs = spark.range(80000).select(F.col("id").alias("doc_id"), F.when(bad, F.concat(text, F.lit(" ####"))).otherwise(text).alias("text"), F.when(es, "es").otherwise("en").alias("lang"), (~bad).cast("int").alias("quality"))
    got = Q.quality_rules(docs.drop("quality"), docs.select("doc_id", "quality")).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got}[False] > 200
