import importlib.util
import random

import pytest

from skyloom.llm.store import written

spec = importlib.util.find_spec("corpus_pipeline")
pytestmark = pytest.mark.skipif(spec is None, reason="no pipeline")


def corpus(spark, folder):
    rng = random.Random(8)
    vocab = [f"wo{i}rd" for i in range(500)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(30)) for i in range(4)]
    docs, labels = [], []
    for i in range(240):
        text = say(rng.randrange(40, 90))
        bad = i % 6 == 0
        docs.append((i, text + (" zorgle vrax zorgle" if bad else ""), "en", "ab"[i % 2], 0))
        if i < 200:
            labels.append((i, 1, int(bad)))
    docs += [(300 + i, docs[31 + 6 * i][1], "en", "a", 0) for i in range(4)]
    docs += [(400 + i, f"{say(20)} {items[i][1]} {say(9)}", "en", "b", 0) for i in range(4)]
    docs += [(500, None, None, None, None), (501, "", "en", "a", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    toxic, copies, leaks = {i for i in range(240) if i % 6 == 0}, {300 + i for i in range(4)}, {400 + i for i in range(4)}
    for (name, stage), gone in zip(P.STAGES, (toxic, copies, leaks)):
        docs = written(stage(spark, docs, str(tmp_path)), name)
        ids -= gone
        assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(ids), name
    mixed = written(P.STAGES[3][1](spark, docs, str(tmp_path)), "mixed")
    assert mixed.columns == columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    words = {r.source: 0 for r in docs.collect()}
    for r in mixed.collect():
        words[r.source] += len((r.text or "").split())
    assert abs(words["a"] / words["b"] - 5 / 2) < 0.1
    placed = P.STAGES[4][1](spark, mixed, str(tmp_path)).collect()
    assert len(placed) == mixed.count()
    by = {}
    for r in placed:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_all_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def test_repeated_ids_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    corpus(spark, str(tmp_path))
    say = lambda a: " ".join(f"{a}{i}" for i in range(50))
    rows = [(1, say("a")), (1, say("b")), (1, say("b")), (2, say("a") + " end"), (None, say("c")), (None, say("c")), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x", {"k": 1}, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, hits string, m map<string, int>, _row long")
    left = P.drop_near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    got = [(r.doc_id, (r.text or "-")[0], r.m, r._row) for r in left.collect()]
    assert sorted(x[1] for x in got) == ["-", "-", "a", "b", "c"] and all(x[2] == {"k": 1} and x[3] == 5 for x in got)
    clean = P.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r.hits for r in clean.collect()} == {"x"} and clean.count() == len(rows)


def test_near_duplicates_of_similarity_80(spark, tmp_path):
    import corpus_pipeline as P

    corpus(spark, str(tmp_path))
    w = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:82])), (3, " ".join(w[:75]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == [1]
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs.where("doc_id <> 2"), str(tmp_path)).collect()) == [1, 3]
