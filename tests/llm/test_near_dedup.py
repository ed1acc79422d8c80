import random

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import near_dedup as N


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similarity=85):
    sets = {i: shingle_set(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= similarity * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_super_minhash_is_unbiased_and_tight():
    rng, got = np.random.default_rng(0), []
    for _ in range(60):
        a = rng.integers(0, 2**63, 150).astype(np.uint64)
        b = a.copy()
        b[:12] = rng.integers(0, 2**63, 12)
        s = N.super_minhash(np.concatenate([a, b]), np.array([0, 150, 300]))
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - 138 / 162) < 0.01
    assert np.std(got) < (138 / 162 * 24 / 162 / N.SLOTS) ** 0.5


CONTRACT = {"similarity": 85, "bands": 32, "rows": 8}


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 60, 120]))]
        for k in range(rng.choice([1, 4, 40])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((n, " ".join(w) if k % 3 else "\t".join(w).upper()))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "a b"), (n + 4, "A\nB"), (n + 5, "x " * 30000)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, n string, key int")
    for options in (CONTRACT, {}):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, **options).collect()}
        assert got == brute(rows, options.get("similarity", 80))


def test_crowded_buckets_of_truncated_copies(spark):
    """Only X links the copies of Y to the pivot: shingles that X shares with the pivot alone don't set it apart from Y."""
    rows = []
    for g in range(12):
        w = [f"g{g}w{i}" for i in range(103)]
        for text in [w, w[:102], w[:88]] + [w[:87] + [f"new{i}"] for i in range(40)]:
            rows.append((len(rows), " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **CONTRACT).collect()}
    want = brute(rows)
    assert sum(k for _, _, k in want.values()) == 12
    assert got == want


def test_links_of_crowds_without_the_pivot(spark, monkeypatch):
    """All sets are forced into one bucket: links among members that are far from the pivot come from their prefixes alone, in crowds of every size."""
    monkeypatch.setattr(N, "SALTED", 8)
    rng, rows = random.Random(4), []
    for crowd in (3, 5, 20, 60):
        base = [f"c{crowd}w{i}" for i in range(100)]
        for _ in range(crowd):
            w, start = list(base), rng.randrange(100)
            for j in range(rng.randrange(14)):
                w[(start + j) % 100] = f"new{rng.random()}"
            rows.append((len(rows) + 1, " ".join(w)))
    rows.append((0, " ".join(f"alone{i}" for i in range(100))))
    sets = spark.createDataFrame([(i, len(s), sorted(hash(x) for x in s)) for i, s in ((i, shingle_set(t)) for i, t in rows)], "id long, n long, s array<long>")
    for similarity in (80, 85, 95):
        pairs = N._meeting_prefixes(sets, sets.select("id", F.col("id").alias("comp")), similarity)
        got = {(r.a, r.b) for r in N._verified(pairs, sets).where(f"{100 + similarity} * both >= {similarity} * (na + nb)").collect()}
        full = {i: shingle_set(t) for i, t in rows}
        want = {(x, y) for x in full for y in full if x < y and 100 * len(full[x] & full[y]) >= similarity * len(full[x] | full[y])}
        assert got == want and len(want) > 10


def test_recall_of_planted_pairs(spark):
    """Pairs at and just over the thresholds: banding loses none of 600."""
    rng, rows, want = random.Random(6), [], {80: set(), 85: set()}
    for k in range(600):
        w = [f"k{k}w{i}" for i in range(rng.randrange(80, 200))]
        cut = rng.randrange(3, max(5, len(w) // 6))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-cut] + [f"x{i}k{k}" for i in range(cut // 4)]))]
        a, b = (shingle_set(t) for _, t in rows[-2:])
        for s in want:
            if 100 * len(a & b) >= s * len(a | b):
                want[s].add(2 * k + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in (CONTRACT, {}):
        got = {r.doc_id for r in N.near_duplicates(df, **options).where("NOT kept").collect()}
        assert got == want[options.get("similarity", 80)] and len(got) > 300


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (0, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in N.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(False, 0, 0, True), (False, 1, 0, False), (False, 1, 0, False)]
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert [(r.component_id, r.kept) for r in N.near_duplicates(df.where("doc_id IS NULL")).collect()] == [(None, True)]
