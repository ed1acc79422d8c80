import duckdb
import pandas as pd

from skyloom.llm import chat as C
from skyloom.llm.oracle import CHAT

CONV = [
    (1, 0, "user", "Hello all.\nWhich filter is best?"),
    (1, 1, "assistant", "The median one is robust.\n\nTry it."),
    (1, 2, "user", "On Monday, bob wrote:\n> The median one is  robust!\n> > Which filter is best?\nWhy is that so?"),
    (1, 3, "assistant", "It ignores outliers."),
    (1, 4, "user", "> Hello all.\n>Which filter is best?\nI ask that too."),
    (1, 5, "assistant", "Fine."),
    (1, 6, "user", "> never said\nHm."),
    (2, 0, "user", "> Try it.\nWhat?"),
    (3, 0, None, None),
    (None, 1, "user", "x"),
    (4, None, "user", "> x"),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, 1, "t") for r in CONV], "conv_id long, turn long, role string, text string, reply_to int, lines string")
    got = {(r.conv_id, r.turn): r for r in C.link_quotations(df).collect()}
    assert len(got) == len(CONV)
    pick = lambda k: (got[k].reply_to, got[k].linked, got[k].thread, got[k].quote_level, got[k].n_quoted, got[k].n_found, got[k].content)
    assert pick((1, 0)) == (None, False, 0, 0, 0, 0, "Hello all.\nWhich filter is best?")
    assert pick((1, 2)) == (1, True, 0, 2, 2, 2, "Why is that so?")
    assert pick((1, 4)) == (0, True, 4, 1, 1, 1, "I ask that too.")
    assert pick((1, 5)) == (4, False, 4, 0, 0, 0, "Fine.")
    assert pick((1, 6)) == (5, False, 4, 1, 1, 0, "Hm.")
    assert pick((2, 0)) == (None, False, 0, 1, 1, 0, "What?")
    assert pick((3, 0))[-1] == "" and got[(3, 0)].formatted == "<|user|>\n"
    assert got[(None, 1)].thread is None and got[(4, None)].thread is None
    assert C.link_quotations(df.limit(0)).count() == 0
    assert [r.turn for r in C.in_reply_order(C.link_quotations(df.where("conv_id = 1"))).collect()] == list(range(7))


def test_long_conversation_and_repeats(spark):
    rows = [(7, i, "user", f"line {i}" + (f"\n> line {i - 700}" if i % 900 == 899 else "")) for i in range(3000)] * 2
    got = C.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 6000
    for r in got:
        start = max([0] + [s for s in (899, 1799, 2699) if s <= r.turn])
        assert r.thread == start
        assert r.reply_to == (r.turn - 700 if r.turn % 900 == 899 else r.turn - 1 if r.turn else None)


def test_interleaved_threads(spark):
    answers = {1: {2: 0, 3: 1, 4: 2, 5: 3, 7: 4}, 2: {4: 0, 6: 2, 7: 4}}  # conversation: turn -> turn quoted
    rows = [(c, t, "user", (f"> line {a[t]}\n" if t in a else "") + f"line {t}") for c, a in answers.items() for t in range(8)]
    got = C.in_reply_order(C.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(r.thread, r.turn) for r in got if r.conv_id == 1] == [(0, 0), (0, 1), (0, 3), (0, 5), (0, 6), (2, 2), (2, 4), (2, 7)]
    assert [(r.thread, r.turn) for r in got if r.conv_id == 2] == [(0, 0), (0, 1), (0, 2), (0, 3), (4, 4), (4, 5), (4, 7), (6, 6)]


def test_quotations_wrapped_anew_and_in_part(spark):
    rows = [
        (1, 0, "user", "The first paragraph is long enough\nto be broken over two lines. It has a second sentence.\n\nAnother one follows."),
        (1, 2, "user", "No."),
        (1, 5, "user", "x" * 300 + " wrote at length, and later than " + "y" * 200 + ":\n> The first paragraph is\n> long enough to be broken over two lines. It has a\n> second sentence.\nAgreed."),
        (1, 6, "user", "> It has a second sentence.\nSo it has."),
        (1, 9, "user", "> nobody said that\n>> No.\nHm."),
        (1, 11, "user", "last"),
    ]
    got = {r.turn: r for r in C.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t].reply_to for t in sorted(got)] == [None, 0, 0, 0, 2, 9]
    assert (got[5].n_quoted, got[5].n_found, got[5].content) == (1, 1, "Agreed.")
    assert (got[9].n_quoted, got[9].n_found, got[9].quote_level) == (2, 1, 2)


def test_very_long_text(spark):
    text = "\n".join(f"> line {i} of the text" for i in range(30000))
    rows = [(1, 0, "user", "\n".join(f"line {i} of the text" for i in range(30000))), (1, 1, "user", "no"), (1, 2, "user", text + "\nyes")]
    got = {r.turn: r for r in C.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[2].reply_to, got[2].content, got[2].n_quoted, got[2].n_found) == (0, "yes", 1, 1)


def test_sql_gives_the_same_on_planted_quotations(spark):
    import random

    rng, rows = random.Random(11), []
    for conv in range(60):
        said = []
        for turn in sorted(rng.sample(range(40), rng.randrange(1, 14))):
            own = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(1, 9))) + rng.choice([".", "!\nAnd more. Yes", "\n\nanother part"])
            quote = ""
            if said and rng.random() < 0.6:
                mark = rng.choice(["> ", ">", "> > "])
                quote = rng.choice(["", "Ann wrote:\n"]) + "\n".join(mark + x for x in rng.choice(said).split("\n")) + "\n"
            said.append(own)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), quote + own))
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    got = C.in_reply_order(C.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    con = duckdb.connect()
    con.register("conversations", frame)
    cur = con.execute(CHAT)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=lambda r: (r[0], r[1]))
    assert sorted(names) == sorted(got[0].asDict())
    assert sorted([tuple(r[n] for n in names) for r in got], key=lambda r: (r[0], r[1])) == want
    assert sum(r.linked for r in got) > 100 and len({(r.conv_id, r.thread) for r in got}) > 80
    assert [(r.conv_id, r.position) for r in got] == sorted((r.conv_id, r.position) for r in got)
