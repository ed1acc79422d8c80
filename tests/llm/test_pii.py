import hashlib
import random
import re

from skyloom.llm import pii as P

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for k, p in KINDS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), list(KINDS).index(k), f"{k}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_matches_brute_force(spark):
    rng = random.Random(9)
    bits = "a.b@c.de x@y 1.2.3.4 999.1.1.1 00255.1.2.3 1.2.3.4.5.6.7.8 4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 +1 (415) 555-0101 +49 30 +4930123456789 é ß 😀 @ . + - 5 a@b.c_d@e.f %@a.b token 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567 \x01 \x02 \n".split(" ")
    texts = [None, "", " ", "a@b.co" * 3000, "1" * 20000, "1.1.1.1 " * 2000, "a" * 50000, "+1" + "(" * 30000, "x@" + "a." * 30000 + "a", "AB12" + "C3D4" * 10000] + [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)], "doc_id long, text string, email string, s int")
    rows = P.find_personal_data(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in KINDS]
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert P.find_personal_data(df.limit(0)).count() == 0


def test_added_spans(spark):
    secret = '"' + "0a1b2c3d4e" * 4 + '"'
    rows = [(i, f"héllo token = {secret} mail {i}@x.com card 4111111111111111 ip 10.0.0.{i} by Dr. Jane Doe") for i in range(40)] + [(99, "w" * 30 + " plain " + "word" * 9)]
    got = {r.doc_id: r for r in P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "secret:15:55" in got[3].spans.split(",")
    assert got[99].spans == "" and got[99].n_added == 0


def test_recall_by_kind(spark):
    """Planted spans of each added kind, with and without telling words before them, and decoys."""
    rng, rows, planted = random.Random(12), [], {}
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    make = {
        "secret": lambda: ("".join(rng.choice("0123456789abcdef") for _ in range(40)), ["token = ", "the "]),
        "national_id": lambda: (f"{rng.randrange(100, 900)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", ["ssn ", "the "]),
        "local_phone": lambda: (f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", ["call ", "the "]),
        "iban": lambda: (f"DE{rng.randrange(10, 99)} " + " ".join(str(rng.randrange(1000, 9999)) for _ in range(4)) + " 00", ["iban ", "the "]),
        "person": lambda: (f"Dr. {rng.choice(['Jane', 'Omar', 'Ines'])} {rng.choice(['Doe', 'Lund', 'Marsh'])}", ["from ", "the "]),
    }
    for i in range(600):
        kind = list(make)[i % 5]
        span, before = make[kind]()
        lead = " ".join(rng.choice(words) for _ in range(8)) + " " + before[i % 2]
        planted[i] = f"{kind}:{len(lead)}:{len(lead) + len(span)}"
        rows.append((i, f"{lead}{span} {rng.choice(words)}"))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(30)) + " 2024-05 12 34,5 " + "x" * 19) for i in range(200)]
    got = {r.doc_id: (set(r.spans.split(",")), r.personal) for r in P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in make:
        mine = [i for i, x in planted.items() if x.startswith(kind)]
        assert sum(planted[i] in got[i][0] for i in mine) >= 0.95 * len(mine), kind
    assert not any(got[i][1] for i in got if i >= 1000) and all(got[i][1] == (got[i][0] != {""}) for i in got)


def test_repeated_rows(spark):
    rows = [(1, "mail a@b.co now")] * 3 + [(None, "mail a@b.co now")]
    got = P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and len({(r.base_sha256, r.spans, r.n_email) for r in got}) == 1


def test_em_finds_the_bad_labeler():
    rng, counts = random.Random(0), {}
    for _ in range(5000):
        y = 1 if rng.random() < 0.6 else -1
        v = tuple(y if rng.random() < a else -y for a in (0.95, 0.9, 0.85, 0.8, 0.6))
        counts[0, v] = counts.get((0, v), 0) + 1
    prior, right, _ = P.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert abs(prior[0] - 0.6) < 0.05 and all(abs(a - b) < 0.05 for a, b in zip(right[0], (0.95, 0.9, 0.85, 0.8, 0.6)))
