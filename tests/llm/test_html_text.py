from skyloom.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/x>The menu</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<article><h1>Head   line</h1><p>First &lt;b&gt; <i>par</i>agraph
 goes&nbsp;on.<p>Second<br>line<!-- x <p> --></p><div class="ad">Buy <b>now</b></div><p>Last &amp; least.</p>
<section class="comments"><p>I disagree</p></section></article><aside>Side</aside><form><p>Name</p></form><footer>&copy; me</footer></body></html>"""


def test_article():
    assert H.main_text(PAGE)[0] == "Head line\nFirst <b> paragraph goes on.\nSecond line\nLast & least."


def test_without_article_element():
    long = "This is the story of a man and of the sea that he was in for all of the days to come by the shore."
    page = f"<div><a href=x>Home page</a> <a href=y>About</a></div><h2>A story</h2><p>{long}</p><p>Short one.</p><p>{long}</p><div class=sidebar>{long}</div><div id='footer'>The end of it</div>"
    assert H.main_text(page)[0] == f"A story\n{long}\nShort one.\n{long}"


def test_article_elements_that_do_not_hold_the_text():
    long = "This is the story of a man and of the sea that he was in for all of the days to come by the shore."
    cards = "".join(f"<article><h3><a href=/{i}>Card {i}</a></h3></article>" for i in range(3))
    assert H.main_text(f"<div class=post><h1>A story</h1><p>{long}</p><p>{long}</p></div>{cards}")[0] == f"A story\n{long}\n{long}"
    assert H.main_text(f"<article><p>{long}</p><p>Short.</p></article><p>Stray line</p><footer>Me</footer><div>{long}</div>")[0] == f"{long}\nShort.\n{long}"


def plain_decision(found):
    """The rules once more, block by block, by looking at every other block."""
    def first(b):
        words = b[0].split()
        stops = sum(w.strip(".,;:!?").lower() in H.STOP_WORDS for w in words)
        if b[2] or b[1] > 0.5 * len(b[0]):
            return -1
        return 1 if len(words) >= 60 or (len(words) >= 15 and stops >= 0.2 * len(words)) else 0

    marks, inside = [first(b) for b in found], [b[3] and not b[2] for b in found]
    has = lambda where: any(m == 1 and i == where for m, i in zip(marks, inside))
    parted = any(inside) and not (has(False) and not has(True))
    out = []
    for k, m in enumerate(marks):
        if m == 0:
            place = lambda j: sum(1 for i in range(min(j, k), max(j, k)) if not parted or inside[i] == inside[k])
            near = sorted((place(j), -x) for j, x in enumerate(marks) if x and (not parted or inside[j] == inside[k]))
            m = -near[0][1] if near else (1 if not parted or inside[k] else -1)
        out.append(m == 1)
    return out


def test_both_passes_match_brute_force():
    import random

    rng = random.Random(5)
    words = "the of and word other thing sea".split()
    for _ in range(400):
        found = []
        for _ in range(rng.randrange(12)):
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 14, 15, 30, 70])))
            found.append((text, rng.choice([0, 0, len(text)]), rng.random() < 0.2, rng.random() < 0.5))
        assert H.decide(found) == plain_decision(found)


def test_links_inside_an_article_go():
    long = "This is the story of a man and of the sea that he was in for all of the days to come by the shore."
    page = f"<article><h1>A story</h1><p>{long}</p><p>Short.</p><p>{long}</p><p><a href=/1>Read on here</a></p><p><a href=/2>And here</a></p><p>Buy now</p></article>"
    assert H.main_text(page)[0] == f"A story\n{long}\nShort.\n{long}"


def test_broken_markup():
    assert H.main_text(None)[0] == H.main_text("")[0] == ""
    assert H.main_text("<article><p>cut &am")[0] == "cut &am"
    assert H.main_text("<article><p>cut</p><p class=\"x")[0] == "cut"
    assert H.main_text("<article><p>a</p><script>never ends <p>b</p>")[0] == "a"
    assert H.main_text("<article>" + "<p>a '\" < b</p>" * 20000)[1] == 20000


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars, r.text.count("\n")) for r in H.extract_pages(df).collect())
    n = len(H.main_text(PAGE)[0])
    assert got == [(1, n, 3), (1, n, 3), (2, 0, 0)]
    assert H.extract_pages(df.limit(0)).count() == 0
