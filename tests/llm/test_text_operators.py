"""Secrets, pages, decontamination, toxicity and quality."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from folio.llm import decontam, html, quality, queries, secrets, toxicity

# -- secrets


def entropy(text):
    return -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))


def test_windows_are_those_of_brute_force():
    r = random.Random(1)
    for _ in range(40):
        text = "".join(r.choice("abcdef0123456789"[: r.randrange(2, 17)]) for _ in range(r.randrange(10, 90)))
        inside = {k for i in range(len(text) - 23) if entropy(text[i : i + 24]) >= 3.0 - 1e-9 for k in range(i, i + 24)}
        assert {k for s, e in secrets.windows(text, 24, 3.0) for k in range(s, e)} == inside


def test_base_spans():
    text = "x PassWord = 'abcdef' token: ab API_KEY=\"k-1_2.3/4\" AKIA" + "Z9" * 9 + " AKIAB deadbeef" * 1 + " " + "0a" * 12
    found = {(k, text[s:e]) for k, s, e in secrets.base_spans(text)}
    assert found == {("assign", "PassWord = 'abcdef"), ("assign", 'API_KEY="k-1_2.3/4'), ("access", "AKIA" + "Z9" * 9), ("hex", "0a" * 12)}
    # Leftmost matches don't overlap: what a failing match has taken is not tried again.
    assert secrets.base_spans("secret=token: abcdefgh") == []
    assert secrets.base_spans("ſecret=abcdefgh") == []


def test_entropy_spans_and_allow_list():
    key = "q7Rz0TnB4xWk9LmV2pYc"
    text = f"id {key} 01234567890123456789 thequickbrownfoxjumpsover"
    assert [text[s:e] for _, s, e in secrets.entropy_spans(text, [])] == [key]
    base = secrets.base_spans(f"token = {key}")
    assert secrets.entropy_spans(f"token = {key}", base) == []


def test_placeholders_suppress_only_what_overlaps_them():
    key = "k8Zq2Lw9Xv4Rt7Yb1Nm6Pc3Hd5Js0Gf"
    for text in (f"/srv/example/keys/{key}", f"{key}/xxxxxxxx", f"0123456789{key}", f"EXAMPLE{key}"):
        at = text.index(key)
        assert any(s <= at + 1 and at + len(key) <= e or s <= at and at + len(key) - 1 <= e for _, s, e in secrets.entropy_spans(text, [])), text
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for text in (upper + upper.lower() + "0123456789+/", upper + "234567", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "Zk9" + "x" * 30):
        assert secrets.entropy_spans(text, []) == [], text


def brute_spans(text):
    """The whole contract, window by window and candidate by candidate."""
    base, spans = [], []
    for kind, pattern, least, group in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
        base += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, (re.I if kind == "assign" else 0) | re.A) if len(m[group]) >= least]
    inside = set()
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        def allowed(s):
            words = re.split("[-_/+=]", s)
            return all(re.fullmatch("[A-Za-z]?[a-z]*|[A-Z]+", w) for w in words) or not set(s) - set("0123456789+/_=-") or re.fullmatch("[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", s)

        if allowed(m[0]):
            continue
        for letters, width, bar in (("0-9a-fA-F", 24, 3.0), ("A-Za-z0-9", 20, 3.9), ("A-Za-z0-9+/_=-", 32, 4.3)):
            for run in re.finditer(f"[{letters}]{{{width},}}", m[0]):
                holders = [(p.start(), p.end()) for p in secrets.PLACEHOLDER.finditer(run[0])]
                good = [i for i in range(len(run[0]) - width + 1) if entropy(run[0][i : i + width]) >= bar - 1e-9 and not any(s < i + width and i < e for s, e in holders)]
                joined = []
                for i in good:
                    if joined and i <= joined[-1][1]:
                        joined[-1][1] = i + width
                    else:
                        joined.append([i, i + width])
                inside |= {(m.start() + run.start() + s, m.start() + run.start() + e) for s, e in joined if not allowed(run[0][s:e])}
    for s, e in sorted(inside):
        if spans and s < spans[-1][2]:
            spans[-1] = ("entropy", spans[-1][1], max(e, spans[-1][2]))
        else:
            spans.append(("entropy", s, e))
    spans = [x for x in spans if not any(b <= x[1] and x[2] <= f for _, b, f in base)]
    return sorted(base + spans, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))


def test_the_whole_scan_is_that_of_brute_force(spark, tmp_path):
    r = random.Random(12)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefgh-_/", "AbC0123456789+/=_-", "ABCDEFGHIJ0123456789", "AB-", "é \n"]
    starts = ["", "token = ", "API_key:'", "AKIA", "secret=", "example", "password\": \"", "x"]
    texts = [" ".join(r.choice(starts) + "".join(r.choice(r.choice(alphabets[:6]) if r.random() < 0.2 else a) for _ in range(r.randrange(5, 70))) for a in r.choices(alphabets, k=7)) for _ in range(150)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = set()
    for row in queries.op7_secret_scan(spark, str(tmp_path)).collect():
        want = brute_spans(texts[row.doc_id])
        written = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert row.spans == written(want)
        assert row.base_sha256 == hashlib.sha256(written([x for x in want if x[0] != "entropy"]).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(x[0] == k for x in want) for k in ("assign", "access", "hex"))
        seen |= {x[0] for x in want}
    assert seen == set(secrets.KINDS)


@pytest.mark.parametrize("word", ["ab", "A", "AB", "Ab", "aB", ""])
def test_long_runs_of_joined_words_take_no_time(word):
    for sign in "-_/":
        text = (word + sign) * 100_000
        began = time.perf_counter()
        secrets.entropy_spans(text + "9", [])
        secrets.entropy_spans(text + "z", [])
        assert time.perf_counter() - began < 20


def test_scan_odd_rows(make, odd_rows):
    assert secrets.scan(make(odd_rows)).count() == len(odd_rows)
    assert secrets.scan(make([])).count() == 0
    row = secrets.scan(make([(1, "é token=abcdef")])).first()
    assert [tuple(s) for s in row.spans] == [("assign", 2, 14)]


# -- pages


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home, here.</a></ul>
    <div class="cookie-notice">We use cookies, you know.</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>,\n text&nbsp;here.<br>More.<p>Second &lt;p&gt; one, with words; and marks.
    <script>var x = "</p>";</script><div class="ad">Buy, buy, buy.</div><!-- no --><form><p>Sign up, please.</p></form><section id="comments"><p>Nice, thanks. I agree.</p></section></article>
    <aside><p>Related, and so on.</p></aside><footer>&copy; Us, 2020.</footer></body></html>"""
    assert html.extract(page) == "Head & line\nFirst bold, text here. More.\nSecond <p> one, with words; and marks."


def test_pages_without_an_article_tag():
    body = "".join(f"<p>{prose(k, 60)}, and then; {prose(k + 9, 30)}.</p>" for k in range(4))
    page = f"<body><div id=menu><a href=x>One</a> <a href=y>Two</a></div><div class=post>{body}</div><div class=links><ul>" + "<li><a href=z>More</a></li>" * 9 + "</ul></div></body>"
    assert html.extract(page) == "\n".join(f"{prose(k, 60)}, and then; {prose(k + 9, 30)}." for k in range(4))


def test_names_of_layouts_and_headings():
    art = "<div class=post-header><h1 class=header>Title</h1></div><p>Words here, and more; of them. Yes.</p><section class=comments><article class=comment><p>Nice, thanks. I agree.</p></article></section>"
    assert html.extract(f"<body class=has-sidebar><div class='page sidebar-right'><article>{art}</article></div></body>") == "Title\nWords here, and more; of them. Yes."
    assert html.extract("<div class=menu-page><p>All of it, in here.</p></div>") == "All of it, in here."


def test_only_attributes_of_their_own_name_count():
    for said in ("style='overflow:hidden'", 'title="The hidden cost"', "data-hidden=false", "data-class=nav", 'title="id=menu class=ad"', "alt='role=\"banner\" aria-hidden=true'", "x='a'data-id=footer", "href=/a?id=nav"):
        assert html.extract(f"<body><div {said}><article><p>All of it, in here.</p></article></div></body>") == "All of it, in here.", said
    for said in ("hidden", "HIDDEN=''", "data-x='1'hidden", "role = 'banner'", "aria-hidden=true", "title='x' class=\"ad\"", "x=1 id=footer"):
        page = f"<body><div {said}><p>Not this, at all.</p></div><p>All of it, in here.</p></body>"
        assert html.extract(page) == "All of it, in here.", said


@pytest.mark.parametrize("tag", ["article", "main"])
def test_short_blocks_of_an_article_are_kept(tag):
    long = [f"{prose(k, 40)}, and; {prose(k + 9, 30)}. So, it is: yes." * 2 for k in range(5)]
    items, cells = [f"item {k} of a plain list" for k in range(10)], [f"cell {k}" for k in range(6)]
    table = "<table><tr>" + "</tr><tr>".join(f"<td>{a}</td><td>{b}</td>" for a, b in zip(cells[::2], cells[1::2])) + "</tr></table>"
    lines = [f"<p>{x}</p>" for x in long]
    art = "<h1>Head</h1>" + "".join(lines[:3]) + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + f"</ul><h2>Sub</h2>{table}<pre>x = 1</pre>" + "".join(lines[3:])
    page = f"<body><div><ul><li><a href=x>Elsewhere</a></ul></div><{tag}>{art}<div class=share>Share it</div></{tag}><div>Beneath</div></body>"
    assert html.extract(page).split("\n") == ["Head", *long[:3], *items, "Sub", *cells, "x = 1", *long[3:]]


@pytest.mark.parametrize("page", ["", "plain words", "<p", "<p>a", "</p></p>", "<!-- open", "<script>never", "<a href='>x", "< p>1 < 2</p>", "<p>" * 500 + "deep" + "</p>" * 500, "&#0;&bogus;&#xD800;"])
def test_broken_pages(page):
    assert isinstance(html.extract(page), str)


def test_names_within_an_article_that_say_more():
    held = "<h1>Head</h1><p class='share-price'>The price, it rose. So it did.</p><div class='related-work'>Work, of others. Here.</div><p class=comment-free>No, none. At all.</p>"
    gone = "<div class='ad-slot top'>Buy</div><ul class='share-buttons'><li>Send</li></ul><div id=comments-2><p>Nice, thanks. I agree.</p></div><div class='x related-posts'>Next</div>"
    assert html.extract(f"<body><article>{held}{gone}</article></body>") == "Head\nThe price, it rose. So it did.\nWork, of others. Here.\nNo, none. At all."


def test_lists_and_tables_where_no_article_is_named():
    long = [f"{prose(k, 40)}, and; {prose(k + 9, 30)}. So, it is: yes." for k in range(6)]
    items = [f"item {k}" for k in range(8)]
    body = "".join(f"<p>{x}</p>" for x in long[:3]) + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul><table><tr><td>one<td>two</table>" + "".join(f"<p>{x}</p>" for x in long[3:])
    page = f"<body><div id=top><ul><li><a href=x>Elsewhere</a></ul></div><div id=content><h2>Head</h2>{body}</div><div><a href=y>Beneath</a></div></body>"
    assert html.extract(page).split("\n") == ["Head", *long[:3], *items, "one", "two", *long[3:]]


def random_box(r, depth):
    """A random tree of an article: (tag, children or text)."""
    if depth == 0 or r.random() < 0.3:
        return ("p", [r.choice(["b", "span", "i", "a"]) if r.random() < 0.2 else None, f"w{r.randrange(1000)} {r.choice('abc')}", f"v{r.randrange(1000)}"])
    tag = r.choice(["div", "section", "ul", "table", "blockquote", "nav", "aside", "script", "form", "div"])
    if tag == "script":
        return (tag, [])
    return (tag, [random_box(r, depth - 1) for _ in range(r.randrange(1, 4))])


def written(node):
    tag, held = node
    if tag == "p":
        inner, a, b = held
        return f"<p>{a} <{inner}>{b}</{inner}></p>" if inner else f"<p>{a} {b}"
    if tag == "script":
        return "<script>var x = '<p>none</p>';</script>"
    inside = {"ul": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}.get(tag, "{}")
    return f"<{tag}>" + "".join(inside.format(written(x)) for x in held) + f"</{tag}>"


def walked(node):
    """The lines of a tree, by walking all of it."""
    tag, held = node
    if tag == "p":
        return [" ".join(held[1:])]
    return [] if tag in ("nav", "aside", "script", "form") else [line for x in held for line in walked(x)]


def test_articles_are_those_of_a_walk_over_the_tree():
    r = random.Random(15)
    for _ in range(150):
        trees = [random_box(r, 4) for _ in range(r.randrange(1, 6))]
        page = "<body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Head, of it.</h1>" + "".join(map(written, trees)) + "</article><footer>End</footer></body>"
        assert html.extract(page).split("\n") == ["Head, of it."] + [line for x in trees for line in walked(x)]


LONG = {
    "nested": "<div>" * 100_000 + "x, y. z", "no end": "<a " * 350_000, "open quotes": '<a "' * 250_000 + ">", "crossed quotes": "<a '>" * 200_000, "no title end": "<title>" * 150_000 + "x",
    "closing": "</1" * 300_000, "unknown ends": "<span>" * 50_000 + "</b>" * 50_000, "cells": "<p><table><tr><td>" + "<div>" * 100_000, "signs": "<" * 10**6, "comments": "<!--" * 250_000,
    "articles": "<nav><article>" * 50_000 + "x", "classes": "<i class='a b c d'>" * 50_000 + "x", "mixed": "<p>" + "<span>" * 50_000 + "<div>" * 50_000,
}


@pytest.mark.parametrize("kind", LONG)
def test_long_odd_pages_take_time_in_proportion(kind):
    began = time.perf_counter()
    html.extract(LONG[kind])
    assert time.perf_counter() - began < 30


def test_main_text_rows(spark):
    clash = spark.createDataFrame([(1, "u", "<p>a, b.</p>", "x", 3)], "page_id long, url string, html string, `a.b` string, id int")
    assert tuple(html.main_text(clash).first()) == (1, "u", "a, b.") and html.main_text(clash.limit(0)).count() == 0
    rows = [(1, "u", None, 1), (1, "u", "<p>a.</p>", 2), (1, "u", "<p>a.</p>", 2), (None, None, "", 3)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, ""), (1, "a."), (1, "a.")]


# -- decontamination

BENCH = [(k, prose(50 + k, 30) + f" unique{k}") for k in range(20)] + [(90, "short"), (91, None), (92, "")]


def distance(a, b):
    """Edits of a against its best part of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_find_agrees_with_brute_force(make, spark):
    r, rows = random.Random(4), []
    for i in range(30):
        doc = prose(1000 + i, 60)
        if i % 3:
            words = r.choice(BENCH[:20])[1].split()
            words = words[r.randrange(5) :] if i % 2 else words
            for _ in range(r.randrange(6)):
                words[r.randrange(len(words))] = r.choice(["x", "Alpha", "sigmas", ""])
            doc = doc[:100] + " " + " ".join(words) + ". " + doc[100:]
        rows.append((i, doc))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find(make(rows), bench).collect()}
    index = decontam.build([(k, t or "") for k, t in BENCH])
    want = {(i, item) for i, t in rows for item, s, k in zip(index.items, index.texts, index.edits) if distance(s, decontam.normal(t)) <= k}
    assert got == want and len(want) > 10


def test_excerpts_are_found_wherever_they_start():
    r, item = random.Random(6), decontam.normal(prose(60, 70))
    index = decontam.build([(7, item)])
    around = ["".join(r.choice("qwxzjk ") for _ in range(90)).strip() for _ in range(2)]
    rows = [decontam.normal(f"{around[0]} {item[at : at + 80]} {around[1]}") for at in range(len(item) - 79)]
    assert {m[0] for m in decontam.matches(rows, index)} == set(range(len(rows)))
    edited = []
    for at in range(0, len(item) - 84, 20):
        piece = list(item[at : at + 85])
        for k in r.sample(range(85), 6):
            piece[k] = r.choice(["", "7", piece[k] + "8"])
        edited.append(f"{around[0]} {''.join(piece)} {around[1]}")
    got = {m[0]: m for m in decontam.matches(edited, index)}
    segments = list(zip(index.texts, index.edits))
    assert set(got) == {i for i, t in enumerate(edited) if any(distance(s, t) <= k for s, k in segments)} == set(range(len(edited)))
    assert all(got[i][4] == min(distance(s, t) for s, _ in segments) for i, t in enumerate(edited[:10]))


def test_drop_contaminated(make, spark, odd_rows):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    df = make([*odd_rows, (50, "before " + BENCH[3][1].upper() + " after")])
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == len(odd_rows)
    assert kept.where("doc_id = 1").first().text is None
    assert decontam.drop_contaminated(make([]), bench).count() == 0
    assert decontam.find(df, bench.limit(0)).count() == 0


def test_benchmark_in_parts(make, spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART", 500)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find(make([(k, t) for k, t in BENCH]), bench).collect()}
    assert {(k, k) for k in range(20)} <= got


def test_odd_benchmarks(make, spark):
    item = prose(900, 40)
    rows = [(None, item), (None, prose(901, 40)), (5, item), (5, prose(902, 40)), (6, "Yes, ok!"), (7, None)]
    bench = spark.createDataFrame([(*x, "z") for x in rows], "item_id long, text string, doc string")
    docs = make([(1, f"{item} {prose(901, 40)} {prose(902, 40)}"), (2, "first\n\n yes OK \nlast"), (3, "yes ok then"), (4, None)])
    got = sorted((tuple(r) for r in decontam.find(docs, bench).collect()), key=str)
    assert [r[:2] for r in got] == [(1, 5), (1, None), (2, 6)] and got[2][2:] == (6, 12, 0)
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()) == [3, 4]
    named = spark.createDataFrame([("one", item)], "item_id string, text string")
    assert [tuple(r)[:2] for r in decontam.find(docs, named).collect()] == [(1, "one")]


def test_long_texts_are_searched_alone(make, spark, monkeypatch):
    monkeypatch.setattr(decontam, "BYTES", 300)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = [(k, t) for k, t in BENCH[:20]] + [(99, prose(4, 3000))]
    assert {(x.doc_id, x.item_id) for x in decontam.find(make(rows), bench).collect()} >= {(k, k) for k in range(20)}


# -- toxicity and quality

BAD = ["fubarish", "snarkword", "gritbag"]


@pytest.fixture(scope="module")
def labelled(spark):
    r, docs, labels = random.Random(8), [], []
    for i in range(1200):
        toxic = i % 8 == 0
        words = prose(5000 + i, r.randrange(5, 60)).split()
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 0 if i % 10 == 4 else 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxicity_on_held_out_rows(make, labelled):
    docs, labels = labelled
    df = make(docs)
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).where("held_out").collect()
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in got) >= 0.98 * len(got)
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and abs(kept.count() - 1050) < 20


def test_toxic_terms_in_long_runs(make, labelled, monkeypatch):
    docs, labels = labelled
    model = toxicity.fit(make(docs), labels)
    clean = prose(77, 400).replace(" ", "")
    for text in (clean, clean[:63], clean + "gammas"):
        assert toxicity.score(make([(1, text)]), model).first().predicted == 0
    for at in (0, 60, 64, 65, 1000, len(clean)):
        assert toxicity.score(make([(1, clean[:at] + "".join(BAD) + clean[at:])]), model).first().predicted == 1
    whole = set(toxicity.pieces(clean).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert set(toxicity.pieces(clean).tolist()) == whole
    cache = toxicity.Cache(toxicity.pieces)
    assert len(toxicity.features(clean, cache)) == len(whole) and not cache


def test_risk_and_gradient_are_those_of_brute_force():
    r = np.random.default_rng(5)
    rows = [[low + r.choice(3, r.integers(0, 4), replace=False) for _ in range(n)] for n, low in ((7, 0), (11, 3))]
    sides = [(np.concatenate(x).astype("i8"), np.repeat(np.arange(len(x)), [len(y) for y in x]), len(x)) for x in rows]

    def parts(theta, prior):
        z = [[theta[-1] + sum(theta[k] for k in row) for row in side] for side in rows]
        loss = lambda zs, sign: sum(math.log(1 + math.exp(-sign * x)) for x in zs) / len(zs)
        return prior * loss(z[0], 1), loss(z[1], -1) - prior * loss(z[0], -1)

    signs = set()
    for prior, shift in ((0.1, 0.0), (0.9, 0.0), (0.9, 3.0), (0.5, 1.0)):
        theta = r.normal(size=7)
        theta[:3] += shift  # positives' features
        on_positive, on_negative, g = toxicity.risk(theta, *sides, prior)
        want = parts(theta, prior)
        assert (on_positive, on_negative) == pytest.approx(want)
        goal = (lambda t: sum(parts(t, prior))) if want[1] >= 0 else lambda t: -parts(t, prior)[1]  # noqa: B023
        step = 1e-6 * np.eye(7)
        assert g == pytest.approx(np.array([(goal(theta + d) - goal(theta - d)) / 2e-6 for d in step]), abs=1e-6)
        signs.add(want[1] >= 0)
    assert signs == {True, False}


def test_the_model_does_not_depend_on_partitions(spark, make, labelled, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 30)
    monkeypatch.setattr(toxicity, "UNLABELLED", 300)
    monkeypatch.setattr(toxicity, "STEPS", 60)
    docs, labels = labelled
    first = toxicity.fit(make(docs).repartition(3), labels)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = toxicity.fit(make(docs[::-1]).repartition(5), labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first.weights and set(first.weights) == set(again.weights) and (first.bias, first.prior) == pytest.approx((again.bias, again.prior))
    assert first.weights == pytest.approx(again.weights)


def test_toxicity_odd_rows(make, labelled, odd_rows):
    _, labels = labelled
    model = toxicity.fit(make(odd_rows), labels)
    assert toxicity.score(make(odd_rows), model).count() == len(odd_rows)
    none = toxicity.fit(make([]), labels.limit(0))
    assert toxicity.score(make(odd_rows), none).where("predicted = 1").count() == 0
    assert toxicity.score(make([]), none).count() == 0


def test_held_out_fold_is_not_learned_from(make, labelled, spark):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(make(docs), flipped) == toxicity.fit(make(docs), labels)


def test_quality_weights_and_draw(make):
    rows = [(i, prose(i, 40) if i % 4 else " ".join(w + "%%%" for w in prose(i, 40).split())) for i in range(400)]
    df = make(rows)
    targets = {i for i, _ in rows if i % 4 and i % 3 == 0}
    ratio = quality.fit(df, df.where("doc_id % 4 <> 0 and doc_id % 3 = 0").select("doc_id"))
    # The two models, counted one word and one pair at a time.
    counts, one = np.ones((2, quality.BUCKETS)), quality._Words()
    for i, x in rows:
        found = quality.TOKEN.findall(x.lower())
        pair = lambda a, b: (m := (one[a] * 0x9E3779B97F4A7C15 + one[b] * 0xC2B2AE3D27D4EB4F) % 2**64) ^ m >> 33
        for bucket in [one[w] % quality.BUCKETS for w in found] + [pair(a, b) % quality.BUCKETS for a, b in zip(found, found[1:])]:
            counts[0, bucket] += 1
            counts[1, bucket] += i in targets
    share = counts / counts.sum(axis=1, keepdims=True)
    assert np.allclose(ratio, np.log(share[1] / share[0]), atol=1e-5)
    got = quality.resample(df, ratio, 0.75).collect()
    words = quality._Words()
    for r in got[:20]:
        assert r.log_weight == pytest.approx(float(ratio[quality.grams(dict(rows)[r.doc_id], words)].sum(dtype="f8")))
    assert sorted(r["rank"] for r in got) == list(range(1, 401))
    by_key = sorted(got, key=lambda r: (-r.gumbel_key, r.doc_id))
    assert [r.doc_id for r in by_key] == [r.doc_id for r in sorted(got, key=lambda r: r["rank"])]
    assert {r.doc_id for r in got if r.kept} == {i for i, _ in rows if i % 4}


def test_quality_odd_rows(make, odd_rows):
    df = make(odd_rows)
    ratio = quality.fit(df, df.select("doc_id"))
    assert quality.resample(df, ratio, 0.5).where("kept").count() == round(0.5 * len(odd_rows))
    assert quality.resample(make([]), quality.fit(make([]), make([]).select("doc_id")), 0.5).count() == 0
    assert re.fullmatch(r"-?0\.0", str(quality.resample(df, ratio, 1.0).where("doc_id = 2").first().log_weight))
