import difflib
import random
from html.parser import HTMLParser

import duckdb
import pytest
from conftest import TESTDATA
from relpredict.llm import queries
from relpredict.llm.html_text import blocks, extract, shared_lines


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p>a&amp;b &eacute;&#233;</p><p>c\n\t d</p>", ["a&b éé", "c d"]),
        ("<nav><ul><li>x</nav><article><h1>T</h1><p>one<br>two<p>three</article><footer>f", ["T", "one", "two", "three"]),
        ("<div class='ad'>x</div><div id=cookie-notice>y</div><p>z</p>", ["z"]),
        ("<article><p>a</p><div class=\"comments\"><article>c</article></div></article>", ["a"]),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>in<b>si</b>de</p>", ["inside"]),
        ("<nav>never closed <article>text</article>", ["text"]),
        ("<form>q<input></form><p hidden>h</p><p style='display: none'>s</p><p>5 < 6 > 4</p>", ["5 < 6 > 4"]),
        ("<p title='a > b'>t</p><p title=it's>u</p>", ["t", "u"]),
        ("", []),
        (None, []),
        ("no markup", ["no markup"]),
        ("<script>unclosed", []),
    ],
)
def test_blocks(page, expected):
    assert texts(page) == expected


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        places = shared_lines(a, b)
        assert places == sorted(set(places)) and len(places) == longest(a, b)
        picked = [a[i] for i in places]
        assert difflib.SequenceMatcher(None, picked, b, autojunk=False) is not None
        rest = iter(b)
        assert all(x in rest for x in picked)


def page(body):
    return f"<html><body><div>Site name</div><div>{body}</div><div>All rights reserved here</div></body></html>"


def test_differencing_deletes_shared_lines_of_the_nearest_page(spark):
    rows = [
        (1, "http://a.b/x/1", page("first story " * 9)),
        (2, "http://a.b/x/2", page("second tale " * 9)),
        (3, "http://c.d/x/1", page("alone on its host " * 9)),
        (4, "http://e.f/1", page("same copy " * 9)),
        (5, "http://e.f/2", page("same copy " * 9)),
        (6, "http://g.h/1", "<nav>m</nav><article><p>Shared line</p><p>one</p></article>"),
        (7, "http://g.h/2", "<nav>m</nav><article><p>Shared line</p><p>two and more</p></article>"),
        (8, None, None),
        (8, None, None),
        (9, "odd", "<p>x</p>"),
    ]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS key", "'h' AS host")
    out = sorted((r["page_id"], r["text"]) for r in extract(frame).collect())
    whole = lambda body: f"Site name {body.strip()} All rights reserved here"
    assert out == [
        (1, ("first story " * 9).strip()),
        (2, ("second tale " * 9).strip()),
        (3, whole("alone on its host " * 9)),
        (4, whole("same copy " * 9)),
        (5, whole("same copy " * 9)),
        (6, "Shared line one"),
        (7, "Shared line two and more"),
        (8, ""),
        (8, ""),
        (9, "x"),
    ]
    assert extract(frame.limit(0)).count() == 0


def test_differencing_reaches_articles_and_crowded_templates(spark):
    template = "<div>%s</div>" % "</div><div>".join(f"menu entry {i} of this site" for i in range(9))
    bodies = ["first short story", "second short tale", "third short report"]
    marked = "<article><p>Follow us daily</p><p>{}</p></article>"
    rows = [(i, f"http://t.x/n/{i}", f"{template}<p>{b}</p>") for i, b in enumerate(bodies, 1)]
    rows += [(i + 3, f"http://m.x/n/{i}", marked.format(b + " with more to say")) for i, b in enumerate(bodies, 1)]
    rows += [(i + 6, f"http://c.x/n/{i}", f"<article><p>{'the same long story ' * 9}</p><p>{b}</p></article>") for i, b in enumerate(bodies, 1)]
    rows += [(i + 9, f"http://d.x/n/{i}", template) for i in (1, 2, 3)]
    out = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out[2] == bodies[1]  # the template holds most of its words and stands on both sides
    assert out[5] == bodies[1] + " with more to say"  # inside the article, in both neighbours
    assert out[4].startswith("Follow us") and out[6].startswith("Follow us")  # one neighbour is not several
    assert all(out[i].startswith("the same long story") for i in (7, 8, 9))
    assert all(out[i] == out[10] != "" for i in (11, 12))


class Reader(HTMLParser):
    """The article of a page by the platform's own parser: text between its tags, a break at every block."""

    BREAKS = {"p", "h1", "h2", "h3", "br", "li", "ul", "ol", "div", "tr", "td", "blockquote", "pre", "article"}
    SKIPPED = {"script", "style", "nav", "aside", "footer", "form", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.inside, self.skipped = [], False, []

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if self.skipped or tag in self.SKIPPED or {"ad", "comments", "cookie", "share", "related"} & set(classes):
            if tag != "br":
                self.skipped.append(tag)
        elif tag == "article":
            self.inside = True
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        elif tag == "article":
            self.inside = False
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.parts.append(data)


def test_query_against_the_platforms_parser(spark):
    """Every page of the smallest table; none of their lines is shared with a neighbour's article."""
    expected = {}
    for page_id, html in duckdb.connect().execute(f"SELECT page_id, html FROM '{TESTDATA}/pages.parquet'").fetchall():
        reader = Reader()
        reader.feed(html or "")
        reader.close()
        blocks_of = ["".join(p) for p in "".join(reader.parts).split("\n")]
        expected[page_id] = " ".join(b for b in (" ".join(x.split()) for x in blocks_of) if b)
    found = {r["page_id"]: r for r in queries.op4_html_text(spark, TESTDATA).collect()}
    assert set(found) == set(expected)
    different = {i: (found[i]["text"], expected[i]) for i in expected if found[i]["text"] != expected[i]}
    assert not different, (len(different), next(iter(different.items())))
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
