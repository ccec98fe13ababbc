"""Template deduction: classes against whole vectors, and slots that decide whatever their names."""

import re
from collections import Counter, defaultdict

import pytest

from granary.llm import html_template

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


STORY = "An account of matter {0} and of what came of it in year {0}, told at some length so that it counts as text."


def plain(i):
    """Names tell nothing; only what the pages share does."""
    return f"""<html><body><div class="k1"><div class="q">All our sections</div><div class="q">Write to the editors</div></div>
<div class="k2"><h2>Matter {i}</h2><p>{STORY.format(i)}</p><p>Copy the address of this page</p><p>More of {i} here.</p></div>
<div class="k3">{"".join(f'<a href="/{i}{k}">elsewhere {i} {k}</a> ' for k in range(8))}</div><div class="k4">Pool {"abcd"[i % 4]} of words</div></body></html>"""


def test_slots_decide_where_names_tell_nothing(spark):
    rows = [(i, f"http://plain.org/{i}", plain(i)) for i in range(24)]
    got = texts(spark, rows)
    assert got == {i: f"Matter {i}\n\n{STORY.format(i)}\n\nMore of {i} here." for i in range(24)}
    # a single page has no template, so the shared words stay
    alone = texts(spark, rows[:1])[0]
    assert "Copy the address" in alone and "All our sections" in alone


def test_slots_against_misleading_names(spark):
    page = """<html><body><div class="has-sidebar"><main><h1>Paper {0}</h1><div class="content">Click to copy this address</div>
<p>{1}</p><section id="related-work"><p>Others wrote of {0} as well: {1}</p><p>And again {0}.</p></section></main></div>
<div id="box1">Menu of all things</div><div id="box2">Left {0} over</div></body></html>"""
    got = texts(spark, [(i, f"http://m.org/{i}", page.format(i, STORY.format(i))) for i in range(5)])
    assert got == {i: f"Paper {i}\n\n{STORY.format(i)}\n\nOthers wrote of {i} as well: {STORY.format(i)}\n\nAnd again {i}." for i in range(5)}
    # without a main element like-named boxes are told apart
    boxes = "<html><body><div id='box1'>Menu of all things</div><div id='box2'>Left {0} over</div></body></html>"
    assert texts(spark, [(i, f"http://b.org/{i}", boxes.format(i)) for i in range(5)]) == {i: f"Left {i} over" for i in range(5)}


def test_readers_comments_and_adverts_vary_but_go(spark):
    page = """<body><div class="adSlot">Buy {0} now</div><div><article><h1>News {0}</h1><p>{1}</p></article></div>
<div class="post-comments"><article>I think {0} is wrong, {1} {1}</article></div></body>"""
    got = texts(spark, [(i, f"http://c.org/{i}", page.format(i, STORY.format(i))) for i in range(4)])
    assert got == {i: f"News {i}\n\n{STORY.format(i)}" for i in range(4)}
    one = '<body><p>Only text.</p><div class="comments"><article>I say otherwise, and at length.</article></div></body>'
    assert texts(spark, [(1, "http://one.org/", one)]) == {1: "Only text."}


def test_repeated_pages(spark):
    rows = [(i, f"http://plain.org/{i}", plain(i)) for i in range(24)]
    twice = html_template.extract(spark.createDataFrame(rows + rows, SCHEMA)).collect()
    once = texts(spark, rows)
    assert Counter((r["page_id"], r["text"]) for r in twice) == {(i, t): 2 for i, t in once.items()}
    copies = [(i, f"http://same.org/{i}", plain(1)) for i in range(9)]
    assert all("Copy the address" in t for t in texts(spark, copies).values())


def plain_classes(rows):
    """Classes of paths by whole occurrence vectors; for pages of div elements only."""
    vectors = defaultdict(lambda: [0] * len(rows))
    for k, (_, _, page) in enumerate(rows):
        stack, counts = [], [Counter()]
        for close, name, cls in re.findall(r'<(/?)(div|section)(?: class="(\w+)")?>', page):
            if close:
                stack.pop()
                counts.pop()
                continue
            label = name + (f" c={cls}" if cls else "")
            counts[-1][label] += 1
            stack.append(label + (f"[{counts[-1][label]}]" if counts[-1][label] > 1 else ""))
            counts.append(Counter())
            vectors["/".join(stack)][k] = 1
    classes = defaultdict(list)
    for path, vector in vectors.items():
        if sum(vector) >= max(html_template.MIN_PAGES, len(rows) * html_template.MIN_SHARE):
            classes[tuple(vector)].append(path)
    return sorted(sorted(c) for c in classes.values())


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_those_of_whole_vectors(spark, seed):
    import random

    r = random.Random(seed)

    def box(depth):
        name = r.choice(["div", "section"])
        inner = "".join(box(depth - 1) for _ in range(r.randrange(3))) if depth else ""
        return f'<{name} class="{r.choice("ab")}">w{r.randrange(9)}{inner}</{name}>' if r.random() < 0.9 else ""

    fixed = [box(3) for _ in range(4)]
    rows = [(i, "http://h.org/", f"<div>{i}{''.join(f for f in fixed if r.random() < 0.8)}</div>") for i in range(12)]
    found = html_template.templates(spark.createDataFrame(rows, SCHEMA)).first()
    assert sorted(found["classes"]) == plain_classes(rows)


def test_deep_and_odd_pages(spark):
    deep = "<div class='ad'>" * 5000 + "x"
    rows = [(1, "http://d.org/1", deep), (2, "http://d.org/2", "<p hidden>no</p><div hidden>no</div><p>yes &lt;b&gt;</p></div></div>"), (3, "http://d.org/3", "< a <b"), (4, "", "<nav>only a menu</nav>"), (None, None, "<p>free</p>")]
    got = texts(spark, rows)
    assert got[1] == "x" and got[2] == "no\n\nyes <b>" and got[4] == "" and got[None] == "free"
