import random
import re
from collections import Counter

import numpy as np

from skyloom.llm import decontaminate as D


def bag(words):
    out = Counter()
    for i in range(max(1, len(words) - 4)) if words else []:
        s = tuple(words[i : i + 5])
        out[s] += sum(len(w.encode()) for w in s)
    return out


def brute(text, items):
    """Best similarity over all windows of each item's size."""
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    found = {}
    for i, t in items:
        b = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        if not b or not w or len(b) < 5 <= len(w):
            continue
        target, best = bag(b), 0.0
        for a in range(max(1, len(w) - len(b) + 1)):
            x = bag(w[a : a + len(b)])
            keys = set(x) | set(target)
            best = max(best, sum(min(x[k], target[k]) for k in keys) / sum(max(x[k], target[k]) for k in keys))
        if best >= D.SIMILARITY:
            found[i] = best
    return found


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(3, 50))) for i in range(40)] + [(40, None), (41, ""), (42, "short one")]
    docs = []
    for d in range(60):
        parts = [say(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(items[:40])[1]
            w = t.split()
            if rng.random() < 0.3:
                w = w[: max(1, int(len(w) * 0.9))]
            parts += [rng.choice([" ", "%%% ", ", "]).join(w).upper(), say(rng.randrange(40))]
        docs.append((d, rng.choice([" ", "\n", "### "]).join(parts), "h", 1))
    docs += [(60, None, "h", 1), (61, "", "h", 1), (62, "Short, ONE!", "h", 1), (63, ("x " * 5000) + items[0][1], "h", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, hits string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in D.decontaminate(df, bench).collect():
        want = brute(docs[r.doc_id][1], items)
        assert list(r.item_ids) == sorted(want), r.doc_id
        assert r.contaminated == bool(want) and abs(r.max_similarity - max(want.values(), default=0)) < 1e-9
    assert not any(r.contaminated for r in D.decontaminate(df, bench.limit(0)).collect())
    assert D.decontaminate(df.limit(0), bench).count() == 0
    spans = D.find_leaks(df.where("doc_id = 63"), bench).collect()[0].hits
    assert [docs[63][1][h.start : h.end] for h in spans] == [items[0][1]]


def test_blocks_find_all_within_radius(monkeypatch, spark):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{rng.integers(50)}" for _ in range(30))) for i in range(50)]
    index = D.Index(items)
    for p in index.prints:
        q = np.unpackbits(p)
        q[rng.choice(128, D.RADIUS, replace=False)] ^= 1
        q = np.packbits(q)
        want = np.flatnonzero(np.bitwise_count(index.prints ^ q).sum(axis=1) <= D.RADIUS)
        assert list(index.near(q)) == list(want) and len(want)
    monkeypatch.setattr(D, "ITEM_BLOCK", 7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, "a b " + t + " c d") for i, t in items], "doc_id long, text string")
    assert all(r.doc_id in r.item_ids for r in D.decontaminate(docs, bench).collect())


def test_repeats_and_a_column_called_hits(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a b {text} c", "mine")] * 3 + [(2, "other", "mine")], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(5, text)] * 2 + [(6, text), (None, text)], "item_id long, text string")
    assert sorted(tuple(r.item_ids) for r in D.decontaminate(docs, bench).collect()) == [(), (5, 6), (5, 6), (5, 6)]
    kept = D.find_leaks(docs, bench, hits_col="found")
    assert kept.columns == ["doc_id", "text", "hits", "found"] and {r.hits for r in kept.collect()} == {"mine"}


def test_recall_at_the_threshold():
    """Items with words exchanged so that the exact similarity of the window is 0.80 to 0.85: none of 500 is lost by the fingerprints."""
    rng = random.Random(2)
    items, texts = [], []
    while len(items) < 500:
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(10**rng.randrange(1, 9))}" for _ in range(rng.randrange(40, 120))]
        x = list(w)
        for i in rng.sample(range(len(w)), max(1, len(w) // 45)):
            x[i] = f"new{rng.randrange(10**6)}"
        a, b = bag(w), bag(x)
        sim = sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in set(a) | set(b))
        if 0.8 <= sim < 0.85:
            items.append((len(items), " ".join(w)))
            texts.append("lead in words here " + " ".join(x) + " and an end")
    index = D.Index(items)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert i in [h[1] for h in index.hits(raw, np.array([0, len(raw)]))]
