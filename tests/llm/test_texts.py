"""Operators on single texts: statistics, rules, decontamination, quality, pages, secrets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutsites.llm import decontamination, html_wrapper, quality_mil, quality_rules, secret_scan

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


TEXTS = [
    "", "a", "é 漢字 😀 x\n\na\na \na\r\na", "# | <b> & $5 %*", "x y z\n" * 9, "one two three four five six seven eight nine " * 3,
    "a b c d e f g h " * 2 + "tail", "\n\n\n", "w " * 40, "é " * 9, "\x0b\x0c\x1c a\x1fb",
]


def test_statistics_equal_brute_force(make_docs):
    docs = make_docs(list(enumerate(TEXTS)))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(docs).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(TEXTS)}


def test_rules_learn_thresholds(spark, make_docs):
    rng = random.Random(0)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(f"w{rng.randrange(9999)}" + ("$$$" if bad and i % 8 else "") for _ in range(60))
        rows.append((i, text if not (bad and i % 8 == 0) else text.upper() + "!!" * 60))
        marks.append((i, int(not bad), 0))
    docs, labels = make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    assert 1 <= len(rules) <= 4
    got = {r.doc_id: r.kept for r in quality_rules.apply(docs, rules).collect()}
    assert got == {i: i % 4 != 0 for i in range(400)}
    # The expression takes the first rule that holds.
    x = {n: np.array([30.0, 3.0]) for n in quality_rules.RATIOS}
    both = [(quality_rules.Condition("words", True, 10.0),), (quality_rules.Condition("words", True, 1.0),)]
    frame = spark.createDataFrame([(30, 1, 1, 1, 1, 1, 1, 1), (3, 1, 1, 1, 1, 1, 1, 1)], ", ".join(f"{f.name} long" for f in quality_rules.STATISTICS))
    assert [r.k for r in frame.select(quality_rules.rejects(both).alias("k")).collect()] == [1, 2]
    assert len(x) == len(quality_rules.RATIOS)


def test_rules_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(odd, labels)
    assert rules == []
    got = quality_rules.apply(odd, rules)
    assert got.count() == 11 and got.where("text is null and (n_words > 0 or kept)").count() == 0
    assert quality_rules.fit(empty, labels) == [] and quality_rules.apply(empty, []).count() == 0


def brute_hits(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    words, hit, found = split(text), set(), set()
    for name, item in items:
        own = split(item)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for s in range(len(words) - n + 1):
                if words[s : s + n] == own[k : k + n]:
                    hit |= set(range(s, s + n))
                    found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 9, 10, 11, 25])))) for i in range(12)] + [("77", ""), ("78", None), ("5", "Déjà vu, 漢字 x")]
    texts = []
    for _ in range(40):
        text = " ".join(rng.choices(vocabulary + ["out"], k=rng.randrange(60)))
        for _ in range(rng.randrange(3)):
            text += ". " + rng.choice(items[:12])[1].upper().replace(" ", ",  ")
        texts.append(text)
    return items, texts + ["vu déjà vu 漢字 X y"]


def test_decontamination_equals_brute_force(spark, make_docs, leaks, monkeypatch):
    items, texts = leaks
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for limit in (200_000, 12):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", limit)
        monkeypatch.setattr(decontamination.blocks, "__defaults__", (limit,))
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontamination.decontaminate(make_docs(list(enumerate(texts))), benchmark).collect()}
        assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_a_large_benchmark_takes_passes(spark, make_docs, leaks, odd, monkeypatch):
    """One block at a time gives what all blocks at once give, spans and cleaned texts included."""
    items, texts = leaks
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = make_docs(list(enumerate(texts)), clash=True)
    columns = ["doc_id", "text", "size", "n_words", "n_hit", "items", "spans", "cleaned"]
    want = decontamination.decontaminate(docs, benchmark)
    strange = decontamination.decontaminate(odd, benchmark).select("text", "n_hit").collect()
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (12,))
    monkeypatch.setattr(decontamination, "AT_ONCE", 2)
    blocks = list(decontamination.blocks(benchmark, "item_id", "text"))
    assert len(blocks) >= 5
    got = decontamination.decontaminate(docs, benchmark)
    assert got.columns == want.columns
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    assert sorted(map(repr, decontamination.decontaminate(odd, benchmark).select("text", "n_hit").collect())) == sorted(map(repr, strange))


def test_decontamination_cuts_spans(spark, make_docs):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    text = f"É before; {phrase.title()}! after that {phrase}"
    benchmark = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    row = decontamination.decontaminate(make_docs([(1, text)]), benchmark).first()
    raw = text.encode()
    assert [raw[s.start : s.end].decode().lower() for s in row.spans] == [phrase, phrase]
    assert row.cleaned == "É before;  ! after that  "


def test_decontamination_of_odd_rows(spark, odd, empty):
    benchmark = spark.createDataFrame([(None, "one"), (2, None), (2, "")], "item_id long, text string")
    got = decontamination.decontaminate(odd, benchmark)
    assert got.count() == 11 and {tuple(r["items"]) for r in got.where("n_hit > 0").collect()} == {("null",)}
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert decontamination.decontaminate(odd, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 37, 500)
    tree = decontamination.WaveletTree(data, 6)
    symbol, at = rng.integers(0, 64, 300), rng.integers(0, 501, 300)
    present = np.isin(symbol, data)
    want = np.array([(data[:a] == s).sum() for s, a in zip(symbol, at, strict=True)])
    assert (tree.rank(symbol, at)[present] == want[present]).all()


def test_quality_model_on_held_out_rows(spark, make_docs):
    rng = random.Random(0)
    rows, marks = [], []
    for i in range(600):
        clean = [f"word{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))]
        if i % 3 == 0:  # one bad passage spoils the document
            at = rng.randrange(len(clean))
            clean[at:at] = ["LOUD!!"] * 80
        rows.append((i, " ".join(clean)))
        marks.append((i, int(i % 3 != 0), 0))
    docs, labels = make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality_mil.fit(docs, labels)
    got = quality_mil.score(docs, model).withColumn("held", quality_mil.held_out()).collect()
    held = [r for r in got if r.held]
    assert len(held) > 100
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 != 0) for r in held]) > 0.97
    again = quality_mil.score(docs, quality_mil.fit(docs, labels)).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    model = quality_mil.Model(np.zeros(quality_mil.WIDTH, np.float32), np.ones(quality_mil.WIDTH, np.float32))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, first, y = rng.standard_normal((7, quality_mil.WIDTH)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.where(y == 1, np.log(f := model.forward(x, first)["y"]), np.log(1 - f)))
    gradient = model.gradient(model.forward(x, first), y)
    for name, g in gradient.items():
        flat, own = model.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for k in (0, len(flat) // 2, len(flat) - 1):
            old = flat[k]
            flat[k] = old + 1e-6
            up = loss()
            flat[k] = old - 1e-6
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-6 == pytest.approx(own[k], abs=1e-6)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    for model in (None, quality_mil.train([np.zeros((1, quality_mil.WIDTH), np.float32), np.ones((2, quality_mil.WIDTH), np.float32)], np.array([0.0, 1.0]))):
        got = [r.score for r in quality_mil.score(odd, model).collect()]
        assert len(got) == 11 and all(0 <= s <= 1 for s in got)
    quality_mil.fit(odd, labels)
    assert quality_mil.score(empty, None).count() == 0 and quality_mil.fit(empty, labels) is None


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body class="page">
<header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></ul></nav></header>
<div class="cookie-notice">We use cookies</div><div class="layout"><div class="sidebar"><p>Other {n} news</p></div>
<div class="content"><h2>Title {n}</h2><p>First &amp; <b>bold</b>
  text {n}.<br>Next</p><p class="note">Read our rules before you write.</p><ul><li>item {n}<li>last &lt;{n}&gt;</ul><div class="ad-slot">Buy {n}</div>
<!-- <p>hidden</p> --><form><input name=q> Search</form></div><section id="comments"><p>I like it {n}</p></section></div>
<footer>&copy; {n}</footer></body></html>"""


def test_main_text_of_hosts(spark):
    pages = [(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(8)]
    pages += [(100 + i, "https://b.example:80/x", f"<article><h1>H{i}</h1><p>Unclosed <i>one<p>two&nbsp;{i} a < b</article><div>tail") for i in range(2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).withColumn("text", F.lit("x"))
    got = {r.page_id: r for r in html_wrapper.extract(df).collect()}
    for i in range(8):
        # The note stands on all pages of the host: it is template.
        assert got[i].text == f"Title {i}\nFirst & bold text {i}. Next\nitem {i}\nlast <{i}>"
    assert got[101].text == "H1\nUnclosed one\ntwo 1 a < b"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_tree_matching_is_the_largest():
    tree = lambda s: html_wrapper.slots_of([html_wrapper.parse(s)])
    a = tree("<div><h1></h1><p></p><ul><li></ul></div><span></span>")
    b = tree("<div><p></p><table></table><ul><li></ul></div>")
    assert html_wrapper.match(a, b)[0] == 5  # root, div, p, ul, li


def test_wrappers_merge_in_any_order():
    import json

    trees = [html_wrapper.slots_of([html_wrapper.parse(PAGE.format(n=i))]) for i in range(6)]
    states = [json.dumps(t.state()) for t in trees]
    one = html_wrapper.prepared(html_wrapper.merged(states))
    two = html_wrapper.prepared(html_wrapper.merged([html_wrapper.merged(states[:2]), html_wrapper.merged(states[2:])]))
    assert one[0].pages == two[0].pages == 6 and one[1].kind == two[1].kind and one[2] == two[2]


@pytest.mark.parametrize("varying", [1, 4, 12])
def test_constant_paragraph_among_varying_siblings(spark, varying):
    rows = []
    for i in range(50):
        own = [f"<p>own {i} {k}</p>" for k in range(varying)]
        own.insert(varying // 2, "<p>same note</p>")
        rows.append((i, "http://h.example/x", f"<body><main><h1>Title {i}</h1>{''.join(own)}</main></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for r in html_wrapper.extract(df).collect():
        assert r.text.split("\n") == [f"Title {r.page_id}", *[f"own {r.page_id} {k}" for k in range(varying)]]


def test_text_twice_on_half_of_the_pages_is_no_template(spark):
    box = "<div class=x><p>{}</p></div>"
    rows = [(i, "http://h.example/x", f"<body><main><h1>Title {i}</h1>{box.format('note') * 2 * (i % 2)}{box.format(i) * 3}</main></body>") for i in range(20)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].count("note") == 2 * (i % 2) for i in range(20))


def test_odd_pages(spark):
    odd = ["", None, "plain text", "<", "<p", "<div><div>" * 3000 + "deep", "<script>never ends", "<!-- open", "a<b", "<p a='>'>x</p>", "&#x41;&nope;"]
    df = spark.createDataFrame([(i, None if i % 2 else "nourl", h) for i, h in enumerate(odd)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrapper.extract(df).collect()}
    assert len(got) == len(odd) and got[0] == got[1] == got[7] == "" and got[2] == "plain text" and got[9] == "x" and got[10] == "A&nope;"
    assert html_wrapper.extract(df.limit(0)).count() == 0


def test_secrets_from_labelled_findings(spark, make_docs):
    rng = random.Random(0)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows, labels = [], []
    for i in range(80):
        secret, noise = hexes(40), rng.choice(["internationalisation", "4785380592391139", "some-long-file-name"])
        before = f'é see {noise} and api_token = "'
        rows.append((i, f'{before}{secret}" then build {hexes(40)} ok', "src/app"))
        labels += [(i, 6, 0), (i, len(before), 1), (i, len(before) + 40 + len('" then build '), 0)]
    docs, found = make_docs(rows), spark.createDataFrame(labels, "doc_id long, start long, secret int")
    got = {(r.doc_id, r.start): r for r in secret_scan.scan(docs, found).collect()}
    assert set(got) == {(a, b) for a, b, _ in labels}
    assert all(got[a, b].is_secret == bool(s) for a, b, s in labels)
    assert all(dict(((r[0]), r[1]) for r in rows)[a][b : b + r.n_chars] == r.token for (a, b), r in got.items())


def test_secrets_of_odd_rows(odd, empty):
    got = secret_scan.scan(odd).collect()
    assert all(r.score == 0 and not r.is_secret for r in got) and {r.n_chars for r in got} == {5000}
    assert secret_scan.scan(empty).count() == 0


def test_word_pattern():
    pattern = re.compile(secret_scan.word_pattern(["the", "then", "to", "x"]))
    assert pattern.sub("", "thenthetotxq") == "tq"


def test_fits_are_bounded_by_rows(spark, make_docs):
    """A labelled id on many rows: equal rows count once, others only up to the limit."""
    rng = random.Random(3)
    good = lambda: " ".join(f"word{rng.randrange(500)}" for _ in range(150))
    bad = lambda: " ".join("#|$" for _ in range(150))
    rows = [(2, good()) for _ in range(40)] + [(3, "same text " * 60)] * 50 + [(i, good() if i % 2 else bad()) for i in range(10, 60)]
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, 0), *[(i, i % 2, 0) for i in range(10, 60)]], "doc_id long, quality long, toxic long")
    docs = make_docs(rows)
    assert quality_mil.fit(docs, labels, max_docs=30) is not None
    rules = quality_rules.fit(docs, labels, max_rows=60)
    kept = quality_rules.apply(docs, rules, ["doc_id"]).where("kept").select("doc_id").distinct().collect()
    assert {r.doc_id for r in kept} >= {i for i in range(10, 60) if i % 2} and not {r.doc_id for r in kept} & set(range(10, 60, 2))


def test_fit_reads_all_passages(spark, make_docs, monkeypatch):
    """No passage of a labelled document is left out of the fit, however long it is."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(64 * n))) for i, n in ((10, 1), (11, 170), (12, 64), (13, 65), (14, 3), (15, 200))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality long, toxic long")
    seen = []
    monkeypatch.setattr(quality_mil, "train", lambda bags, y: seen.extend(zip(map(len, bags), y.tolist())))
    quality_mil.fit(make_docs(rows), labels)
    used = [r.doc_id for r in labels.where(~quality_mil.held_out()).collect()]
    assert sorted(seen) == sorted((len(t.split()) // 64, float(i % 2)) for i, t in rows if i in used) and len(used) > 1


def extracted(spark, pages):
    df = spark.createDataFrame([(i, "http://h.example/p", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_wrapper.extract(df).collect()}


def test_class_names_count_as_a_whole(spark):
    """A word of a longer name is no mark of what is not the article; neutral words beside one are."""
    body = (
        "<div class='share-buttons'>share {n}</div><article><p>first of {n}</p><div class='market-share'>market {n}</div><p class='social-science'>science {n}</p>"
        "<p class='skip-count'>skipped {n}</p><div class='mainNav'>go {n}</div><div id='comment-list'><p>comment {n}</p></div></article>"
    )
    got = extracted(spark, [body.replace("{n}", f"number {i} of some") for i in range(6)])
    assert got == {i: "\n".join(f"{x} number {i} of some" for x in ("first of", "market", "science", "skipped")) for i in range(6)}
    assert html_wrapper.named_off("nav") and html_wrapper.named_off("topNav-bar") and not html_wrapper.named_off("main-content") and not html_wrapper.named_off("box")


@pytest.mark.parametrize("deep", [5, 119, 130, 400, 3000])
def test_what_deep_elements_hold(spark, deep):
    pages = [f"<article><p>start {i} of it</p>{'<div>' * deep}<nav><ul><li><p>menu {i}</p></li></ul></nav><p>inner text {i}</p>{'</div>' * deep}<p>end {i}</p></article>" for i in range(5)]
    got = extracted(spark, pages)
    assert all("menu" not in t for t in got.values())
    assert {i: t.split("\n") for i, t in got.items()} == {i: [f"start {i} of it", f"inner text {i}", f"end {i}"] for i in range(5)}
