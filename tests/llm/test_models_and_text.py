"""Kneser-Ney, decontamination, page text, the pipeline: against plain versions."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from rankyard.llm import decontaminate, html_text, kneser_ney


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


def plain_model(texts):
    """Interpolated modified Kneser-Ney bigrams by dictionaries."""
    pairs = Counter()
    for t in texts:
        w = ["<s>", *words(t)]
        pairs.update(zip(w, w[1:]))
    follow, total, before = defaultdict(Counter), Counter(), Counter()
    for (h, w), c in pairs.items():
        follow[h][min(c, 3)] += 1
        total[h] += c
        before[w] += 1
    count_of = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    d, e = kneser_ney.discounts(count_of(pairs)), kneser_ney.discounts(count_of(before))
    vocabulary, n = len(before), sum(before.values())
    rest = sum(e[min(c, 3)] for c in before.values()) / n
    low = lambda w: (max(before[w] - e[min(before[w], 3)], 0) / n if w in before else 0) + rest / (vocabulary + 1)

    def p(h, w):
        if h not in total:
            return low(w)
        c = pairs[h, w]
        return max(c - d[min(c, 3)], 0) / total[h] + sum(d[k] * v for k, v in follow[h].items()) / total[h] * low(w)

    return p, before


def plain_scores(texts, train):
    p, vocabulary = plain_model(train)
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for t in texts:
        w = words(t)
        yield len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w], w))
    for h in ("<s>", "the", "never seen"):
        assert sum(p(h, w) for w in vocabulary) + p(h, "?unknown?") == pytest.approx(1)


def test_kneser_ney_is_the_plain_model(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PIECE", 500)
    monkeypatch.setattr(kneser_ney, "BUCKET", 4000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    train = [r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    got = {r.doc_id: r for r in kneser_ney.learn_and_score(docs).collect()}
    for r, wanted in zip(rows, plain_scores([r.text for r in rows], train)):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.held_out) == (*wanted[:2], zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (g.base_score, g.score) == (pytest.approx(wanted[2]), pytest.approx(wanted[3]))
    assert {g.train_tokens for g in got.values()} == {sum(len(words(t)) for t in train)}
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_kneser_ney_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in kneser_ney.learn_and_score(odd).collect()}
    assert len(got) == 13 and all(np.isfinite([g.score, g.base_score]).all() for g in got.values())
    assert got[2].n_tokens == got[3].n_tokens == got[4].n_tokens == 1
    assert kneser_ney.learn_and_score(none).count() == 0
    empty = kneser_ney.score(odd, kneser_ney.learn(none)).collect()
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in empty)


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=14))
def test_alignment(a, b):
    score, i, j = decontaminate.align(np.array(a, int), np.array(b, int))
    assert score == plain_alignment(a, b)
    assert 0 <= i <= j <= len(b) and plain_alignment(a, b[i:j]) == score


def edited(rng, text, share):
    out = []
    for w in text.split():
        x = rng.random()
        out += [] if x < share / 3 else [w, "inserted"] if x < share * 2 / 3 else ["replaced"] if x < share else [w]
    return " ".join(out)


def plain_similarity(item, text):
    """The best local alignment by the full table, as a share of the item's with itself."""
    a, b = ([w for w in map(decontaminate.word, x.split()) if w] for x in (item, text))
    best, above = 0, [0] * (len(b) + 1)
    for w in a:
        row = [0]
        for j, v in enumerate(b):
            row.append(max(0, above[j] + (2 if v == w else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best / (2 * len(a))


def test_planted_copies_are_found_and_clean_documents_left(spark):
    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(3000)] + ["the", "of", "and"] * 400
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [prose(n) for n in (16, 24, 40, 60, 33, 20)]
    rows, planted = [(k, prose(rng.randrange(1, 400))) for k in range(150)], set()
    for k in range(150, 240):
        item = k % 6
        copy = items[item].upper() + "!!!" if k % 2 else edited(rng, items[item], 0.18)
        rows.append((k, f"{prose(rng.randrange(0, 300))} {copy} {prose(rng.randrange(0, 300))}"))
        if plain_similarity(items[item], rows[-1][1]) >= 0.5:  # an edit may leave less of a short item
            planted.add((k, item))
    assert len(planted) > 85
    rows += [(300 + k, f"x {items[2]}") for k in range(400)]  # a passage in most documents
    planted |= {(300 + k, 2) for k in range(400)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "the of")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert set(got) == planted
    assert all(got[k, 2].similarity == 1.0 for k in range(300, 700)) and (got[300, 2].first_word, got[300, 2].end_word) == (1, 41)
    clean = decontaminate.without_copies(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == {k for k, _ in rows} - {k for k, _ in planted} and clean.columns == docs.columns


def test_passages_at_the_threshold_have_seeds():
    """Every edit that leaves the similarity at the threshold is found, and its similarity is that of the full table."""
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    found = missed = 0
    for trial in range(250):
        item = [rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 9, 16, 30, 45)))]
        kind = trial % 5
        copy = [x for k, w in enumerate(item) for x in (("new",) if kind == 0 and k % 3 == 2 else (w, "more") if kind == 1 else () if kind == 2 and k % 3 == 2 else (w,))]
        copy = edited(rng, " ".join(copy), 0.15 * rng.randrange(1, 5)).split() if kind > 2 else copy
        text = " ".join([rng.choice(vocabulary) for _ in range(rng.randrange(90))] + copy + [rng.choice(vocabulary) for _ in range(rng.randrange(90))])
        items = decontaminate.Items([(7, " ".join(item))], 0.5)
        key, n = items.counted(pa.array([text, text[::-1], None]))
        items.keep_rare(dict(zip(key.tolist(), n.tolist())))
        got = max((x[2] for x in items.search(pa.array(["", text]))), default=0)
        wanted = plain_similarity(" ".join(item), text)
        assert got == (wanted if wanted >= 0.5 else 0), (trial, item, text)
        found, missed = found + (wanted >= 0.5), missed + (wanted < 0.5)
    assert found > 150 and missed > 20


def test_items_of_scripts_without_spaces_are_found(spark):
    rng = random.Random(3)
    han, thai = ("".join(chr(rng.randrange(a, b)) for _ in range(200)) for a, b in ((0x4E00, 0x9000), (0x0E01, 0x0E2F)))
    items = [(1, han[:30]), (2, thai[:40]), (3, "かな漢字 mixed with words"), (4, han[50:52])]
    edited_ = "".join(c for k, c in enumerate(han[:30]) if k % 5)
    rows = [(0, han[100:]), (1, f"前{han[:30]}後"), (2, f"x {thai[:40]} y"), (3, han[60:100] + edited_), (4, "かな 漢字 mixed, with words!"), (5, thai[50:]), (6, han[50:52]), (7, han[40:60])]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    apart = lambda t: " ".join(t)
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == {(1, 1): 1.0, (2, 2): 1.0, (3, 1): plain_similarity(apart(han[:30]), apart(edited_)), (4, 3): 1.0, (6, 4): 1.0}


def test_items_of_one_or_two_words_are_looked_up_whole(spark):
    items = spark.createDataFrame([(1, "Yes."), (2, "New York"), (5, "yes"), (3, "?!"), (4, "three words here")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "yes"), (1, "yes and no"), (2, "  NEW   york!"), (3, "york new"), (4, "in New York"), (5, ""), (6, None), (7, "..."), (8, "three words here")], "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.similarity, r.first_word, r.end_word) for r in decontaminate.contamination(docs, items).collect()]
    assert sorted(got) == [(0, 1, 1.0, 0, 1), (0, 5, 1.0, 0, 1), (2, 2, 1.0, 0, 2), (8, 4, 1.0, 0, 3)]
    assert {r.doc_id for r in decontaminate.without_copies(docs, items.where("item_id < 3")).collect()} == {1, 3, 4, 5, 6, 7, 8}


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    larger = SMALL.replace("0.001", "0.01")
    docs, benchmark = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in decontaminate.contamination(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 400)
    assert {tuple(r) for r in decontaminate.contamination(docs, benchmark).collect()} == whole
    joined = lambda t: f" {' '.join(filter(None, map(decontaminate.word, t.split())))} "
    items = {r.item_id: joined(r.text) for r in benchmark.collect()}
    exact = {(r.doc_id, k) for r in docs.collect() for k, x in items.items() if x in joined(r.text)}
    assert exact <= {x[:2] for x in whole}


def test_odd_contamination(odd, none, spark):
    benchmark = spark.createDataFrame([(1, "the dog barked at the cat"), (1, "der hund bellt die katze an"), (None, "a row without id"), (3, None)], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.contamination(odd, benchmark).collect())
    assert got == [("0", "1"), ("0", "1"), ("1", "1"), ("6", "1"), ("None", "None")]
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.without_copies(odd, benchmark).count() == odd.count() - 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept them all please, it is best.</div>
<div id="main"><div class="sidebar"><p>Read these other very interesting things that we wrote.</p></div>
<article><h1>Head&amp;line &eacute;</h1><p>First   para<b>graph</b>
with a <a href="x">link</a> in it.<p>Second &lt;one&gt; &#8212; and it goes on for quite a while so that it is dense.</p><ul><li>item one<li>item two</ul>
<form><input value=x><button>Send</button></form><aside>Beside the point</aside><table><tr><td>cell a<td>cell b</table><!-- <p>not this</p> --></article>
<section id="comments"><p>I am a reader and I disagree with every word of this, at length.</p></section></div><footer>&copy; 2026</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE).split("\n") == [
        "Head&line é", "First paragraph with a link in it.", "Second <one> — and it goes on for quite a while so that it is dense.", "item one", "item two", "cell a", "cell b",
    ]


def test_article_without_the_element():
    noise = "".join(f'<li><a href="/{k}">topic {k} with some words</a></li>' for k in range(40))
    page = f"<body><div class=top><ul>{noise}</ul></div><div class=content><h2>Title here</h2>" + "".join(f"<p>Paragraph {k} has many plain words in it and no links at all, as articles have.</p>" for k in range(6)) + "</div></body>"
    got = html_text.main_text(page).split("\n")
    assert got[0] == "Title here" and len(got) == 7


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b", ">", "<", "&amp", "&#x1;", "text ", "<!--", "-->", "<a href='", "<script>", "</script>", "<td>", "<br/>", "</", "\x00", "<li>", "<article>"]), max_size=30).map("".join))
def test_broken_pages_do_not_crash(page):
    assert html_text.main_text(page) == html_text.main_text(page)


def _sections(sizes, long="plain words of an article go on here "):
    texts = [(f"Heading number {k}", [f"{k}.{j} " + long * 12 for j in range(n)]) for k, n in enumerate(sizes)]
    page = "".join(f"<div><h2>{h}</h2>" + "".join(f"<p>{t}</p>" for t in ts) + "</div>" for h, ts in texts)
    return page, [x.strip() for h, ts in texts for x in (h, *ts)]


@pytest.mark.parametrize("sizes", [(5, 5, 5), (2, 9, 4), (1, 1, 1, 8)])
@pytest.mark.parametrize("outer", ["<body><div class=post>{}</div></body>", "<body>{}</body>", "<body><nav>Menu</nav><div class=post><div>{}</div></div><div><a href=x>some link elsewhere</a></div></body>"])
def test_all_sections_without_the_element(sizes, outer):
    page, wanted = _sections(sizes)
    assert html_text.main_text(outer.format(page)).split("\n") == wanted


def test_wrappers_that_hold_the_article_stay():
    page, wanted = _sections((3, 3))
    for inside in (page, f"<article>{page}</article>"):
        for name in ("has-sidebar", "form-page", "layout header-fixed"):
            side = '<div class="sidebar"><p>Read these other very interesting things that we wrote.</p></div>'
            assert html_text.main_text(f'<body><div class="{name}"><div id="page-sidebar-left">{inside}</div>{side}</div><div>Imprint</div></body>').split("\n") == wanted
    comments = "".join(f"<article class=c><p>Comment {k} disagrees with all of this at quite some length.</p></article>" for k in range(9))
    assert html_text.main_text(f'<body><article>{page}</article><div id="comments">{comments}</div></body>').split("\n") == wanted


PROBES = [
    '<section id="side-effects">{}</section>', '<p class="share-price">{}</p>', '<div class="related-work">{}</div>', '<p id="social-history">{}</p>', '<p title="the hidden cost">{}</p>',
    '<p data-id="form-3">{}</p>', "<header><h1>{}</h1></header>", "<p><label>{}</label></p>", "<p><math><mi>{}</mi></math></p>", '<ul><li><a href="x">{}</a></li></ul>', '<div class="wide"><p data-class="sidebar">{}</p></div>',
]


@pytest.mark.parametrize("probe", PROBES)
def test_parts_of_an_article_stay(probe):
    page, wanted = _sections((2, 3))
    for outer in ("<body><nav><a href=x>Home</a></nav><article>{}</article><div class=ad>Buy this now, it is cheap.</div></body>", "<body><header>Site</header><main><article>{}</article></main></body>"):
        got = html_text.main_text(outer.format(probe.format("words that must stay") + page)).split("\n")
        assert got == ["words that must stay", *wanted], got


@pytest.mark.parametrize("part", ['<div class="cookie-notice">{}</div>', '<div class="ad">{}</div>', '<ul id=comments><li>{}</li></ul>', "<aside>{}</aside>", "<form>{}</form>", "<footer>{}</footer>", '<p hidden>{}</p>', '<div class="newsletter signup-box">{}</div>', "<nav>{}</nav>"])
def test_other_parts_go(part):
    page, wanted = _sections((2, 3))
    for outer in ("<body>{0}<article>{1}{0}</article>{0}</body>", "<body>{0}<div>{1}{0}</div></body>"):
        assert html_text.main_text(outer.format(part.format("words that go away, whatever they are"), page)).split("\n") == wanted


def plain_density(node, ratio):
    """Characters, tags, characters and tags in links, and composite density, by the formula, of one node."""
    below = [c for c in node.children if not isinstance(c, str) and not c.dropped]
    counts = [plain_density(c, ratio) for c in below]
    chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) + sum(c[0] for c in counts)
    tags, links = sum(c[1] + 1 for c in counts), sum(c[3] + (n.tag == "a") for n, c in zip(below, counts))
    linked = chars if node.tag == "a" else sum(c[2] for c in counts)
    if not chars:
        return chars, tags, linked, links, 0.0
    base = math.log(chars / max(1, chars - linked) * linked + ratio * chars + math.e)
    value = chars / max(1, tags) * max(0.0, math.log(max(1.0, chars / max(1, linked) * max(1, tags) / max(1, links))) / base)
    return chars, tags, linked, links, value


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "words ", "more of them ", "<li>", "<b>", "</b>", "<td>", "<nav>", "</nav>"]), max_size=40).map("".join))
def test_densities_are_those_of_the_formula(page):
    root = html_text.parse(f"<body>{page}</body>")
    nodes = html_text.measure(root)
    assert html_text.measure(root) == nodes
    body = next(n for n in nodes if n.tag == "body")
    whole = plain_density(body, 0.0)
    ratio = whole[2] / whole[0] if whole[0] else 0.0
    for n in nodes:
        wanted = plain_density(n, ratio)
        assert (n.chars, n.tags, n.link_chars, n.link_tags) == wanted[:4] and n.density == pytest.approx(wanted[4])
        assert n.total == pytest.approx(sum(plain_density(c, ratio)[4] for c in n.children if not isinstance(c, str) and not c.dropped))


ARTICLE = "<h1>The title</h1>" + "".join(f"<p>Paragraph {k} has many plain words in it and no links at all, as articles have.</p>" for k in range(5))
READERS = [f"I am reader {k} and disagree with every word of this at quite some length." for k in range(40)]
REFERENCES = "".join(f"<li><a href=x>reference number {k}</a></li>" for k in range(5))


@pytest.mark.parametrize(
    "page,more",
    [
        (f"<body><form method=post><nav><a href=x>Home</a></nav><div>{ARTICLE}</div><input value=a><button>Go</button></form></body>", 0),
        (f"<body><div role=form><div>{ARTICLE}</div></div></body>", 0),
        (f"<body><form action=x>Search the site <input></form><div>{ARTICLE}</div></body>", 0),
        (f"<body><article>{ARTICLE}<h2 id=copyright>On copyright</h2><p>more words</p></article></body>", 2),
        (f"<body><article>{ARTICLE}<section id=search><h2>Search</h2><p>of the section</p></section></article></body>", 2),
        (f'<body><article>{ARTICLE}<p class="notice">a paragraph of that name</p></article></body>', 1),
        (f"<body><header>Site</header><div class=post><header><h1>Own title</h1></header>{ARTICLE}</div></body>", 1),
        (f"<body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div>{ARTICLE}</div></body>", 0),
        (f"<body><article>{ARTICLE}<ul>{REFERENCES}</ul></article></body>", 5),
        (f"<body><div>{ARTICLE}<h3>References</h3><ul>{REFERENCES}</ul></div></body>", 6),
        (f"<body><div>{ARTICLE}<ul>{REFERENCES}</ul></div></body>", 0),
        *((f"<body>{outer}<div class=discussion>" + "".join(form.format(t) for t in READERS) + "</div></body>", 0) for outer in (f"<article>{ARTICLE}</article>", f"<div class=post>{ARTICLE}</div>") for form in ("<div><b>Ann</b><p>{}</p></div>", "<section><span>Ann</span><p>{}</p><a href=x>Answer</a></section>")),
        (f"<body><div id=page><div>{ARTICLE}</div><ol>" + "".join(f"<li><b>Bob</b><div>{t}</div></li>" for t in READERS) + "</ol></div></body>", 0),
    ],
)
def test_what_an_article_is(page, more):
    got = html_text.main_text(page).split("\n")
    assert len(got) == 6 + more and not set(got) & set(READERS) and "Site" not in got, got


def plain_choice(root):
    """The node of the largest sum of its children's densities, the outermost of equal ones, and the path up from it, by
    plain recursion; boxes named as other parts, and what is in them, neither count nor are chosen."""
    body = next(c for c in root.children if not isinstance(c, str) and c.tag == "body")
    whole = plain_density(body, 0.0)
    ratio = whole[2] / whole[0] if whole[0] else 0.0
    best = [0.0, None]

    def visit(node):
        kept = [c for c in node.children if not isinstance(c, str) and not c.dropped]
        total = sum(plain_density(c, ratio)[4] for c in kept if not c.named)
        if plain_density(node, ratio)[0] and node.tag not in html_text.PHRASING and (best[1] is None or total > best[0]):
            best[:] = [total, node]
        for c in kept:
            if not c.named:
                visit(c)

    visit(root)
    return best[1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<div class=ad>", "<a href=x>", "</a>", "words of text ", "more of them in a row ", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<nav>menu</nav>"]), max_size=40).map("".join))
def test_the_choice_is_that_of_plain_recursion(page):
    root = html_text.parse(f"<body><p>{'a long first paragraph ' * 12}</p>{page}</body>")
    wanted = plain_choice(root)
    nodes = html_text.measure(root)
    best = max((n for n in html_text.unnamed(root, nodes) if n.chars and n.tag not in html_text.PHRASING), key=lambda n: n.total)
    assert best is wanted or best.total == pytest.approx(wanted.total)
    # Nothing that is not in the chosen subtree comes out, and all plain paragraphs in it do.
    article, threshold = html_text.chosen(root)
    text = html_text.blocks(article, threshold)
    inside = []

    def paragraphs(node):
        for c in node.children:
            if not isinstance(c, str) and not c.dropped and not c.named:
                if c.tag == "p" and c.chars and not c.link_chars and not any(not isinstance(x, str) for x in c.children):
                    inside.append(" ".join("".join(c.children).split()))
                paragraphs(c)

    paragraphs(article)
    assert not set(inside) - set(text)


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (4, "u", "plain words", "x"), (5, "u", "<p>" * 3000 + "deep" + "<div>" * 3000, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert (got[2].text, got[2].n_chars, got[None].text, got[4].text, got[5].text) == ("", 0, "", "plain words", "deep")
    assert got[1].n_chars == len(got[1].text) and html_text.extract(pages.limit(0)).count() == 0


def test_pipeline(spark):
    sf_dir = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    leaks = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert not got & leaks and len(got) > 0.8 * docs.count()
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == docs.columns


def test_stages_on_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars")
    kept = corpus_pipeline.identified(spark, docs, SMALL)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 6, 7, 8, 9, 10, 11, None}
    assert sorted(str(r.doc_id) for r in corpus_pipeline.deduplicated(spark, docs, SMALL).collect()) == sorted(str(k) for k in (0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None))
    assert corpus_pipeline.deduplicated(spark, docs.limit(0), SMALL).count() == 0
