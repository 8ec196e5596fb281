"""Periodic runs, HTML extraction and spelling variants on small fixtures, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from mktlens.llm import html_text, periodic_runs, spelling
from mktlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"
PERIODIC = " ".join(["a", "b", "c"] * 10)
LONG = " ".join(f"word{i % 997}x" for i in range(30_000))
ROWS = [
    (1, PERIODIC), (2, "x y " + PERIODIC + " tail"), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, LONG), (8, " ".join(["same"] * 24)), (9, " ".join(["same"] * 23)), (1, PERIODIC),
    (10, "ÀÉ ß 漢字 " * 9), (None, PERIODIC), (11, " ".join(["p q r s t u v w"] * 3)), (12, " ".join(["p q r s t u v w"] * 3)[:-2]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, b"z", "end") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, n long, runs binary, collapsed string")


def words_of(text):
    out = re.split(f"[{SPACE}]+", (text or "").strip(SPACE))
    return [] if out == [""] else out


def brute_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        start = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and start is None:
                start = i
            elif not same and start is not None:
                length, first, start = i + q - start, start, None
                if length >= max(least, times * q):
                    found.setdefault((first, length), q)  # ascending q: the smallest period
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(400):
        n, k = rng.randrange(60), rng.choice([1, 2, 3, 5])
        ids = [rng.randrange(k) for _ in range(n)]
        if n > 5 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randrange(3, 9)
            ids = [ids[a + (i - a) % p] if i >= a else ids[i] for i in range(n)]
        least = rng.choice([2, 6, 24])
        assert periodic_runs.runs_of(np.array(ids, dtype=np.int64), least, 3) == brute_runs(ids, least)


def test_lookups_in_chunks(monkeypatch):
    ids = np.array([0, 1, 0, 0, 1] * 12 + list(range(9)) + [3] * 30)
    whole = periodic_runs.runs_of(ids)
    monkeypatch.setattr(periodic_runs, "CHUNK", 3)
    assert periodic_runs.runs_of(ids) == whole == brute_runs(ids.tolist())


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (40, 1), (200, 2), (300, 50)):
        ids = rng.integers(0, k, n)
        order, place = periodic_runs.suffix_array(ids)
        assert order.tolist() == sorted(range(n), key=lambda i: ids[i:].tolist()) and place[order].tolist() == list(range(n))


def expected_runs(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = brute_runs(words) if n < 2000 else []
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs(docs):
    got = sorted(map(tuple, periodic_runs.digests(periodic_runs.periodic_runs(docs, periodic_runs.marked_words)).collect()), key=str)
    assert zlib.crc32(b"7") % 10  # the long text is not changed, and has no run of three periods in brute_runs' reach
    long = [r for r in got if r[0] == 7]
    assert long[0][1:5] == (1, 0, 30_000, 997)
    assert [r for r in got if r[0] != 7] == sorted((expected_runs(i, t) for i, t in ROWS if i != 7), key=str)
    assert periodic_runs.digests(periodic_runs.periodic_runs(docs.limit(0))).count() == 0


def test_op11_on_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r["text"] or "").split()) < 700}
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    small = [r for r in got if r[0] in docs]
    assert sum(r[1] > 0 for r in small) > 5 and small == [expected_runs(r[0], docs[r[0]]) for r in small]


SURROUNDED = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var a = "</p><p>nor this</p>";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav></header>
<div id="cookie-notice">We use cookies &amp; more cookies to make this page better for all of you who read it</div>
%s
<aside>Side remarks that go on for a while, with words of all kinds in them</aside>
<div class="sidebar"><p>Most read this week, a long list of things that are not part of it</p></div>
<form action="/s"><label>Search</label><input name=q><button>Go</button></form>
<section class="comments"><article class="comment"><p>First! I read all of this and want to say a lot about it, at great length, so that this is long.</p></article>
<article class="comment"><p>Second comment, which is also very long and has many words in it, more than the article itself has.</p></article></section>
<footer><p>&copy; All rights reserved by whoever owns this site and its many long legal texts.</p></footer></body></html>"""
ARTICLE = """<h1>The <em>title</em>&nbsp;here</h1><p>First paragraph,&#32;which has   a <a href="/x">link</a> in &lt;it&gt;.
<p>Second one<br>after a break, unclosed<ul><li>item one<li>item <b>two</b></ul><!-- <p>no comment</p> --><script>nothing()</script><table><tr><td>cell<td>next</table><p>Short."""
TEXT = "The title here\n\nFirst paragraph, which has a link in <it>.\n\nSecond one after a break, unclosed\n\nitem one\n\nitem two\n\ncell\n\nnext\n\nShort."


@pytest.mark.parametrize("article", [f"<article>{ARTICLE}</article>", f'<div class="content-with-sidebar"><article>{ARTICLE}</article></div>', f"<main><article>{ARTICLE}</article></main>", f'<div class="post">{ARTICLE}</div>', f'<form id="page"><div>{ARTICLE}</div></form>'])
def test_article_amid_the_rest(article):
    assert html_text.main_text(SURROUNDED % article) == TEXT


@pytest.mark.parametrize("html,text", [("", ""), ("no markup &amp; at all", "no markup & at all"), ("<p>a<p>b", "a\n\nb"), ("<nav>menu</nav>", ""), ("<article>cut off in a <b>tag</b> <a hre", "cut off in a tag"), ("<p>x<!-- cut off comment <p>y", "x"), ("a < b <p>c", "a < b\n\nc"),
                                       ("<article><p>one</p></div></span></article>", "one"), ("<script>only()", ""), ("<article><p>x &amp;amp; y  \t z</article>", "x &amp; y z"), ("<div>" * 3000 + "deep", "deep")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_densest_subtree_without_marks():
    words = "some words that make up a paragraph of the article and go on for quite a while until it ends"
    body = "".join(f"<div><p>{words} {k}</p></div>" for k in range(6))
    links = "".join(f'<div><a href="/{k}">{words[:30]} {k}</a></div>' for k in range(10))
    got = html_text.main_text(f"<body><div>{links}</div><div>{body}</div><div>{links}</div></body>")
    assert got == "\n\n".join(f"{words} {k}" for k in range(6))


def test_html_extraction(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "old", 5), (2, None, None, "old", 5), (3, "u", "", "old", 5), (3, "u", "", "old", 5), (None, "v", "<p>x", "old", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.html_extraction(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", LONG, len(LONG)), (2, None, "", 0), (3, "u", "", 0), (3, "u", "", 0), (None, "v", "x", 1)], key=str)
    assert html_text.html_extraction(pages.limit(0)).count() == 0


def test_op12_on_pages(spark):
    import html

    got = {r["page_id"]: r for r in QUERIES["op12_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search("<article>(.*)</article>", r["html"], re.S).group(1)
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?p>|</?h1>", inner))
        text = "\n\n".join(p for p in parts if p)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


def edits(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, change):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if change and doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and edits(v, w)] for w in counts}
    form = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in counts if near[w]}
    form = {w: v for w, v in form.items() if counts[v] >= 5 * counts[w]}
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root))
    return out


def test_spelling_variants(spark):
    text = " ".join(["Receive "] * 150 + ["recieve receeve"] * 5 + ["receve,"] * 25 + ["reciive"] * 6 + ["short"] * 9 + ["ÀÉîõüÿ ÀÉîõüy"] * 5 + ["letters! lettres"] * 5 + ["lettere letterz"] * 30 + ["abcdef"] * 5 + ["abcdefg"] * 125 + ["abcdefgh"] * 700 + ["rarely"] * 4)
    rows = [(1, text), (2, None), (3, ""), (4, "abcdef " * 3), (4, "abcdef " * 3), (None, "rarely x×÷y×÷ " * 5), (5, "1234567 漢字漢字漢字")]
    docs = spark.createDataFrame([(i, t, "w", 2, 3) for i, t in rows], "doc_id long, text string, word string, n long, cell int")
    for change in (None, spelling.without_letter):
        assert {tuple(r) for r in spelling.spelling_variants(docs, change).collect()} == brute_variants(rows, change)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 3)
    rng = random.Random(2)
    words = {"".join(rng.choices("abcé", k=rng.choice((6, 7)))) for _ in range(150)}
    rows = [(1, " ".join(w for w in words for _ in range(rng.choice((5, 6, 40)))))]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_variants(rows, False)


def test_op13_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, SF).collect()} == brute_variants(rows, True)


