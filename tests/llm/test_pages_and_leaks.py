"""Main text of pages and leaked benchmark items."""

from __future__ import annotations

import html
import re

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from regionlens.llm.html_content import Weights, extract, learn_weights, main_text, parse, tally
from regionlens.llm.templates import contaminated_documents, drop_contaminated, matches
from tools.compare import canonical, oracle_connection


def article_of(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
    return "\n\n".join(b for b in (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in blocks) if b)


def test_pages_of_the_table(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    expected = {r["page_id"]: article_of(r["html"]) for r in pages.collect()}
    out = {r["page_id"]: r for r in extract(pages).collect()}
    assert {k: r["text"] for k, r in out.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


@pytest.fixture(scope="module")
def weights(spark, folder):
    return learn_weights(spark.read.parquet(f"{folder}/pages.parquet"))


TEXT = "A first sentence of some words that goes on for a while. " * 3


def test_without_marked_article(weights):
    page = f"""<html><body><div id="topmenu" class="menu"><a href=x>Home</a> <a href=y>News</a></div><div class=side-bar><p>{TEXT}</p></div>
    <div id=content><h1>Title &amp; more</h1><p>{TEXT}<p>Second&nbsp;one <i>in</i>line.<form>Name <input></form><div class="advert">Buy</div><p>Third.</div>
    <section id="comments"><p>{TEXT}</p></section><footer><p>Foot</p></footer></body></html>"""
    text = " ".join(TEXT.split())
    assert main_text(page, weights) == f"Title & more\n\n{text}\n\nSecond one inline.\n\nThird."


@pytest.mark.parametrize("page", ["", "plain words", "<", "<p", "<p>a<b", "<!-- x", "<script>if (a<b) '</p>'", "</p></p>", "<p a='>'>x</p>", "<![CDATA[x]]>", "<p>" * 3000 + "x"])
def test_broken_markup(weights, page):
    assert isinstance(main_text(page, weights), str)


def test_references_and_script(weights):
    page = "<article><p>5 &lt; 6 &eacute;&#233;&#x1F600; a\n\t b</p><script>var s = '<p>no</p>';</script><style>p{}</style><p>c<br>d</p><!-- no --></article>"
    assert main_text(page, weights) == "5 < 6 éé😀 a b\n\nc d"


def test_pages_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>some words here</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    out = sorted((tuple(r) for r in extract(pages).collect()), key=str)
    assert out == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "some words here", 15)], key=str)
    assert extract(pages.where("false")).count() == 0


UNNAMED = re.compile(r' (?:class|id|role)=("[^"]*"|\S+?)(?=[ >])')
BOILERPLATE = re.compile(r"<(/?)(?:nav|footer|header|aside|form)\b")


@pytest.mark.parametrize("unnamed", [False, True])
@pytest.mark.parametrize("divs", [False, True])
@pytest.mark.parametrize("unmarked", [False, True])
def test_pages_without_their_marks(spark, folder, weights, unnamed, divs, unmarked):
    """The expected text is cut from the page as it was; the extraction sees it without class words, element names or the mark."""
    for row in spark.read.parquet(f"{folder}/pages.parquet").select("html").collect():
        page = UNNAMED.sub("", row["html"]) if unnamed else row["html"]
        page = BOILERPLATE.sub(r"<\1div", page) if divs else page
        page = re.sub(r"<(/?)article", r"<\1div", page) if unmarked else page
        assert main_text(page, weights) == article_of(row["html"])


def test_the_weights_decide(spark, folder, weights):
    pages = [r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").select("html").limit(20).collect()]
    for neutral in (Weights({"": 1.0}, {}), Weights({"": -1.0}, {})):
        assert all(main_text(p, neutral) != main_text(p, weights) for p in pages)


LINE = " ".join(TEXT.split())


@pytest.mark.parametrize("part, text", [
    (f"<div class='related-work'><p>{TEXT}</p></div>", LINE),
    (f"<p class=alert>{TEXT}</p>", LINE),
    (f"<section class='discussion'><h2>Discussion</h2><p>{TEXT}</p></section>", f"Discussion\n\n{LINE}"),
    (f"<div class='page-header'><h1>The title of it</h1></div><p>{TEXT}</p>", f"The title of it\n\n{LINE}"),
    ("<table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>5</td></tr></table>", "Year\n\nSum\n\n1999\n\n5"),
    ("<p class=notice>Short note.</p><pre>x = 1\n y = 2</pre>", "Short note.\n\nx = 1 y = 2"),
    (f"<aside class=sidebar><p>{TEXT * 9}</p></aside><p>Last words.</p>", "Last words."),
    ("<div class=advert>Buy one now</div><form>Name <input><button>Send</button></form><p>Last words.</p>", "Last words."),
    (f"<p>Last words.</p><section><h3>Comments</h3><ol><li><p>{TEXT}</p></li></ol></section>", "Last words."),
])
def test_parts_of_an_article(weights, part, text):
    page = f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A title here</h1><p>{TEXT}</p>{part}</article><footer>Foot</footer></body>"
    assert main_text(page, weights) == f"A title here\n\n{LINE}\n\n{text}"


def test_comments_without_class(weights):
    page = f"<body><article><h1>Title</h1><p>{TEXT}</p></article><h3>Comments</h3><ol><li><p>{TEXT}</p></li></ol></body>"
    assert main_text(page, weights) == f"Title\n\n{LINE}"
    assert main_text(page.replace("article", "div"), weights) == f"Title\n\n{LINE}"


def test_a_long_page(weights):
    page = f"<nav><a>x</a></nav><article>{f'<p>{TEXT}</p>' * 20_000}</article><footer>f</footer>"
    assert main_text(page, weights) == "\n\n".join([LINE] * 20_000)


def test_best_region_is_the_best_of_all(weights):
    """The scan against all contiguous regions, with tags that cost more than the words behind them give."""
    own = Weights({"": -1.0, "block=p": 2.0, "block=li": 1.5}, {"p": 0.5, "ul": 4.0, "li": 1.0, "div": 6.0})
    page = "<p>a b<p>c</p><div>junk</div><p>d e f g</p><ul><li>h</li><li>i j k l</li></ul><p>m n</p><div><div><p>o</p></div></div>"
    parts = parse(page)
    scores = [own.of(p.features) * p.words if not isinstance(p, tuple) else -own.tags.get(p[0], 0.1) for p in parts]
    spans = [(i, j) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)]
    i, j = max(spans, key=lambda s: sum(scores[s[0] : s[1]]))
    assert main_text(page, own) == "\n\n".join(p.text for p in parts[i:j] if not isinstance(p, tuple) and own.of(p.features) > 0)


def test_labels_are_counted_once_a_page(spark):
    page = "<nav><a>x</a></nav><article><p>one two</p></article><footer>f</footer>"
    counts = tally(parse(page))
    assert counts["block=p\tin=p\tmarked\tsize=0", True] == 1 and counts["<footer>", False] == 2
    pages = spark.createDataFrame([(i, "u", page) for i in range(50)], "page_id long, url string, html string").repartition(5)
    assert learn_weights(pages).words == Weights.fit(counts).words
    assert learn_weights(pages, labelled=0).words == learn_weights(pages.where("false")).words == Weights.fit({}).words


ITEM = "A train leaves Boston at 9 km per hour and meets Alice after 12 hours of riding through the long green valley"


@pytest.fixture
def benchmark(spark):
    rows = [(1, ITEM), (2, "too short to find"), (3, None), (None, "a nameless item that has more than eight plain words in it"), (1, ITEM)]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS key", "1 AS h")


def kinds(documents, benchmark, texts):
    out = contaminated_documents(documents(list(enumerate(texts))), benchmark).collect()
    return {r["doc_id"]: (r["item_id"], r["kind"]) for r in out}


def test_leaks(documents, benchmark):
    other = ITEM.replace("9", "75").replace("12", "31.5").replace("Boston", "Denver").replace("Alice", "Robert").replace("km", "miles")
    clash = ITEM.replace("Boston", "Denver").replace("Alice", "Denver")
    texts = [f"Some words before. {ITEM}. And after.", f"Quite another start. {other}", f"Here: {clash}", "nothing of the kind " * 20, f"{' '.join(ITEM.split()[:9])} and then something else", None, ""]
    assert kinds(documents, benchmark, texts) == {0: (1, "exact"), 1: (1, "re-parameterised")}
    kept = drop_contaminated(documents(list(enumerate(texts))), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 5, 6} and kept.columns == documents([]).columns


def test_inconsistent_slots_are_reported(documents, benchmark):
    clash = ITEM.replace("Boston", "Denver").replace("Alice", "Denver")
    rows = matches(documents([(1, f"Here: {clash}")]), benchmark).collect()
    assert [(r["consistent"], r["contaminated"]) for r in rows] == [(False, False)]


def test_leaks_odd_rows(documents, benchmark):
    rows = [(None, f"x. {ITEM}"), (4, f"x. {ITEM}"), (4, f"x. {ITEM}"), (5, "it is a nameless item that has more than eight plain words in it")]
    found = sorted(str((r["doc_id"], r["item_id"])) for r in contaminated_documents(documents(rows), benchmark).collect())
    assert found == ["(4, 1)", "(None, 1)"]
    assert contaminated_documents(documents([]), benchmark).count() == 0
    assert contaminated_documents(documents(rows), benchmark.where("false")).count() == 0


def test_leaks_equal_sql(spark, folder):
    name = "op8_template_decontamination"
    frame = queries()[name](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("CartesianProduct", "NestedLoop", "Python", "Arrow") if w in plan]
    theirs: duckdb.DuckDBPyRelation = oracle_connection(folder).sql(oracle_sql()[name])
    assert canonical(frame.toPandas()) == canonical(theirs.to_df()) and frame.count() > 0
