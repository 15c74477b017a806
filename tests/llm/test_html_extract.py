import html
import math
import random
import re
import statistics
import time

import pytest

from tessera.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><header>Site of sites</header>
<!-- ad 1 --><div class="ad">Buy this now, it is cheap and good and you will like it very much indeed.</div>
<article><h1>A &amp; B</h1><p>First   paragraph with
 <b>bold</b> and <a href="#">a link</a> in it, long enough to count as running text.<p>Short.</p>
<ul><li>one<li>two</ul><p>Last&nbsp;paragraph: x &lt; y &#233; caf&eacute;, and several words more of it.</p>
<div class="comments"><p>A reader says that this was a very fine article indeed, and more.</p></div></article>
<aside>Related things to read</aside><form><input><label>Mail</label></form><footer>&copy; 2020 us</footer></body></html>"""


def test_article_without_its_surroundings():
    assert H.content_blocks(PAGE) == [
        "A & B", "First paragraph with bold and a link in it, long enough to count as running text.", "Short.", "one", "two", "Last paragraph: x < y é café, and several words more of it.",
    ]


def test_pages_without_an_article_tag():
    text = "A long paragraph of plain running text that goes on for a while. " * 3
    links = "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(30))
    page = f'<body><div class="menu"><ul>{links}</ul></div><div><table><tr><td><a href="x">x</a></td></tr></table></div><div id="content"><p>{text}</p><p>Short one.</p><p>{text}</p></div><div class="cookie-notice">We use cookies, do you mind?</div></body>'
    assert H.content_blocks(page) == [text.strip(), "Short one.", text.strip()]


def test_sections_and_titles_are_kept_without_an_article_tag():
    a, b = ("Some plain running text that goes on for quite a while here. " * n for n in (6, 4))
    a, b = a.strip(), b.strip()
    nested = f"<body><div id=content><h1>T</h1><div><p>{a}</p></div><div><p>{b}</p></div></div></body>"
    assert H.content_blocks(nested) == ["T", a, b]
    beside = f"<body><h1>T</h1><div><p>{a}</p><p>{b}</p></div></body>"
    assert H.content_blocks(beside) == ["T", a, b]
    inner = f"<body><div><h1>T</h1></div><p>By me</p><div><p>{a}</p><p>{b}</p></div></body>"
    assert H.content_blocks(inner) == ["T", "By me", a, b]
    last = "One short closing section that stands in a region of its own."
    small = f"<body><div><p>{a}</p><p>{a}</p><p>{b}</p></div><div><h2>End</h2><p>{last}</p></div></body>"
    assert H.content_blocks(small) == [a, a, b, "End", last]


def test_articles_side_by_side_are_all_kept():
    a, b = ("Some plain running text that goes on for quite a while here. " * n for n in (6, 4))
    assert H.content_blocks(f"<main><article><p>{a}</p></article><article><p>{b}</p></article></main>") == [a.strip(), b.strip()]


def test_an_omitted_end_of_head_closes_it():
    text = "A long paragraph of plain running text that goes on for a while."
    for start in ("<body>", "<p>", "<div>", "", "<b>", "<noscript><link rel=x></noscript><body>"):
        assert H.content_blocks(f"<html><head><title>T</title><meta charset=utf-8><style>p{{}}</style>{start}{text}") == [text], start


def test_odd_pages():
    assert H.content_blocks(None) == H.content_blocks("") == H.content_blocks("<p></p>") == []
    assert H.content_blocks("just text") == ["just text"]
    assert H.content_blocks("<p>open <b>tags <i>everywhere") == ["open tags everywhere"]
    assert H.content_blocks("</div></p><p>x</p>") == ["x"]
    assert H.content_blocks("<article>" + "<p>word</p>" * 3000 + "</article>") == ["word"] * 3000
    deep = "<div>" * 3000 + "deep text here" + "</div>" * 3000
    assert H.content_blocks(deep) == ["deep text here"]


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in H.extract_html(df).collect()), key=str)
    text = "\n".join(H.content_blocks(PAGE))
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert H.extract_html(df.limit(0)).collect() == []


def _article(page):
    """The article's blocks of a page of the test tables, which hold one <article> each."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = re.split(r"<(?!/?(?:b|i|a|em|strong|span)\b)[^>]*>", inner)
    plain = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(b|i|a|em|strong|span)\b[^>]*>", "", x))).strip() for x in blocks]
    return [x for x in plain if x]


@pytest.mark.parametrize("tag", ["article", "main", "section", "div"])
def test_every_test_page_gives_its_article_whatever_its_tag(spark, tag):
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        page = r["html"].replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")
        assert H.content_blocks(page) == _article(r["html"])


def test_marked_sections_that_the_parser_does_not_know():
    assert H.content_blocks("<![foo bar]>x") == ["x"] and H.content_blocks("<p>a<![x]>b</p>") == ["ab"]
    assert H.content_blocks("<p>a</p><![CDATA[x]]><p>b</p><![if IE]><p>c</p><![endif]><![ never closed") == ["a", "b", "c", "<![ never closed"]


def test_a_form_around_the_page_is_no_boilerplate():
    text = "A long paragraph of plain running text that goes on for a while."
    for inner in (f"<article><h1>T</h1><p>{text}</p></article>", f"<div><h1>T</h1><p>{text}</p></div>"):
        page = f"<body><form id=aspnetForm><nav><a href=x>Menu of links</a></nav>{inner}<form><p>Mail <input></p></form><footer>f</footer></form></body>"
        assert H.content_blocks(page)[:2] == ["T", text]
    page = f"<body><div><h1>T</h1><p>{text}</p></div><form><p>Your mail please, and your name</p><button>Send</button></form></body>"
    assert H.content_blocks(page) == ["T", text]


def test_a_marked_element_around_title_and_bulk_is_no_boilerplate():
    text = "A long paragraph of plain running text that goes on for a while."
    page = f"<body><div class=header><h1>Site</h1></div><div class='main has-sidebar'><h1>T</h1><p>{text}</p><div class=sidebar><p>Other things to read here</p></div></div></body>"
    assert H.content_blocks(page) == ["T", text]


def test_an_element_that_is_never_closed_marks_nothing():
    text = "A long paragraph of plain running text that goes on for a while."
    for end in ("", "</body></html>"):
        assert text in H.content_blocks(f"<html><body><p>{text}</p><aside><p>Related</p><div><p>{text}</p></div>{end}")[-1]
    # The end of an element around it closes it too.
    assert H.content_blocks(f"<body><div><aside><p>Related</p></div><p>{text}</p></body>") == [text]


def test_deep_and_unmatched_tags_take_time_in_proportion():
    for page in ("<div>" * 8000 + "deep text" + "</div></section>" * 8000, "<div><p>text" * 8000, "<div>text" * 8000, "<ul><li>text" * 8000):
        began = time.process_time()
        assert H.content_blocks(page)
        assert time.process_time() - began < 3


def _brute(page):
    """The same choice by its definition: every sum over lines and their ancestors anew."""
    parser = H._Lines()
    parser.feed(page)
    parser.close()
    parser.flush()
    parser._end()
    parents, names, says = parser.parents, parser.names, parser.says

    def chain(r):
        return [r, *chain(parents[r])] if r > 0 else [0] if r == 0 else []

    held = lambda r, lines: [x for x in lines if r in chain(x[0])]
    sure = [x for x in parser.lines if not any(says[r] in (H._NAMED, H._COMMENTS) for r in chain(x[0]))]
    total = max(1, sum(x[3] for x in sure))

    def gone(r):
        marks = any(r in chain(k) and names[k] in ("h1", "article", "main", "form") for k in range(len(names)))
        return says[r] in (H._NAMED, H._COMMENTS) or says[r] == H._MARKED and not (marks and sum(x[3] for x in held(r, sure)) >= total / 2)

    lines = [x for x in parser.lines if not any(gone(r) for r in chain(x[0]))]
    if not lines:
        return []
    ratio = [len(x[1]) / max(1, x[2]) for x in lines]
    bell = [math.exp(-j * j / 2) for j in range(-3, 4)]
    smooth = [sum(b * ratio[min(max(k + j, 0), len(ratio) - 1)] for j, b in zip(range(-3, 4), bell)) / sum(bell) for k in range(len(ratio))]
    least = statistics.pstdev(smooth) / 2
    marked = [x >= min(max(smooth), least) for x in smooth]
    size = lambda rows: sum(len(x[1]) for x in rows)
    good = [x for x, m in zip(lines, marked) if m]
    best = max(r for r in range(len(parents)) if names[r] not in H._BLOCKS and size(held(r, good)) >= 0.9 * size(good))
    own = [m and q >= least for m, q in zip(marked, ratio)]
    strong = [x for x, o in zip(lines, own) if o]

    def comes(r):
        return r == best or r not in chain(best) and size(held(r, strong)) > size(held(r, lines)) / 2

    taken = [o or any(comes(r) for r in chain(x[0])) for x, o in zip(lines, own)]
    for k in reversed(range(len(lines) - 1)):
        taken[k] = taken[k] or names[lines[k][0]] in H._HEADINGS and taken[k + 1]
    first = taken.index(True)
    titles = [k for k in range(first) if names[lines[k][0]] == "h1"]
    for k in range(titles[-1] if titles else first, first):
        taken[k] = taken[k] or names[lines[k][0]] in H._BLOCKS - {"li"}
    return [x[1] for x, t in zip(lines, taken) if t]


def test_equals_brute_force_on_random_pages():
    r = random.Random(10)
    tags = ["div", "p", "ul", "li", "nav", "aside", "article", "section", "h1", "h2", "form", "a", "b", "span", "table", "tr", "td", "header", "footer", "div class=ad", 'div id="comments"', "div class=side-menu"]
    for _ in range(400):
        parts, stack = [], []
        for _ in range(r.randrange(1, 60)):
            x = r.random()
            if x < 0.4:
                stack.append(r.choice(tags))
                parts.append(f"<{stack[-1]}>")
            elif x < 0.65 and stack:
                parts.append(f"</{stack.pop(r.randrange(len(stack))).split()[0]}>")
            else:
                parts.append(" ".join(r.choice(("word", "of", "<br>", "text &amp; more", "running")) for _ in range(r.choice((1, 3, 30)))))
        page = "".join(parts)
        assert H.content_blocks(page) == _brute(page), page


def test_a_page_larger_than_an_arrow_batch(spark):
    blocks = [f"Paragraph {k} of plain running text." for k in range(150_000)]
    df = spark.createDataFrame([(1, "u", "<body><nav><a href=x>menu</a></nav><div>" + "".join(f"<p>{x}" for x in blocks) + "</div></body>")], "page_id long, url string, html string")
    assert H.extract_html(df).first()["text"] == "\n".join(blocks)
