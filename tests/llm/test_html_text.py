import html
import random
import re

import pytest
from pyspark.sql import functions as F

from citeframe.llm import html_text, queries

WEIGHT = html_text.weights({})


def test_best_run_against_all_runs():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 3]) for _ in range(rng.randrange(12))]
        a, b = html_text.best_run(s)
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best
        if best > 0:
            assert a == min(i for i in range(len(s)) for j in range(i + 1, len(s) + 1) if sum(s[i:j]) == best)


def text(page):
    return html_text.main_text(page, WEIGHT)


def test_leaves_out_what_is_no_article():
    page = """<html><head><title>t</title><script>if (a < b) document.write("<p>no</p>")</script><style>p{}</style></head>
    <body><header>Site <b>name</b></header><nav><ul><li><a href="/">Home</a><li><a href=x>Other</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site to do things</div>
    <article><header><h1>The &amp; title</h1></header><p>First paragraph of some length,<br>two   lines &lt;here&gt;.
    <p>Second one <i>with</i> <b>marks</b> and a <a href="y">link</a> in it. <script>x()</script>
    <div class="ad-slot">Buy this now please</div><form><input value=1>Send <button>Go</button></form>
    <ul><li>item one is long enough</li><li>item two is too</li></ul><!-- a comment <p>no</p> -->
    <p>Last&nbsp;words&#33; caf&eacute;</p><section id="comments"><p>A reader says much, much more than needed.</p></section></article>
    <aside>About us</aside><footer>&copy; Site</footer></body></html>"""
    assert text(page) == (
        "The & title\n\nFirst paragraph of some length, two lines <here>.\n\nSecond one with marks and a link in it.\n\n"
        "item one is long enough\n\nitem two is too\n\nLast words! café"
    )


def test_odd_pages():
    assert text(None) == text("") == text("<p></p>") == text("<!-- x") == text("<script>var a") == text("<") == ""
    assert text("just words") == "" or text("just words") == "just words"
    assert text("<p>one two three four") == "one two three four"
    assert text("<p>one two three</p></p></div><p>four five six &am") == "one two three\n\nfour five six &am"
    assert text("<p>a < b and 'c' is \" d</p>") == "a < b and 'c' is \" d"
    deep = "<div>" * 5000 + "<p>deep words are here" + "</div>" * 5000
    assert text(deep) == "deep words are here"
    assert text("<p>" + "long words here " * 50000) == ("long words here " * 50000).strip()


def test_unclosed_quotes_do_not_take_long():
    text('<a href="' * 3000 + "<p>words at the end of it all")


def test_weights_come_from_labelled_pages():
    pages = ["<td>in cells many words</td>".join(["<article>", "</article>"]) + "<p>out out out out</p>" * 3] * 4
    learnt = html_text.weights(html_text.label_counts([*pages, None, "", "<p>unlabelled</p>"]))
    assert learnt["w:td"] > 0.8 and learnt["w:p"] < 0 and learnt["t:td"] > learnt["t:p"]


def plain(page):
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)[1]
    parts = [html.unescape(re.sub(r"<[^>]+>", " ", p)) for p in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = queries.op9_html_extraction(spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.url, r.text) == (pages[r.page_id].url, plain(pages[r.page_id].html))
        assert r.n_chars == len(r.text)


def test_marks_of_content_are_not_needed(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()
    learnt = html_text.weights(html_text.label_counts(r.html for r in pages))
    for r in pages:
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(bare, learnt) == plain(r.html)


def test_rows_with_nulls_and_no_rows(spark):
    rows = [(1, "u", None), (1, "u", "<article><p>same words here</p></article>"), (None, None, ""), (1, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    found = html_text.extract_pages(pages)
    assert sorted((r.text, r.n_chars) for r in found.collect()) == [("", 0), ("", 0), ("", 0), ("same words here", 15)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_class_words_switch_off_no_article():
    story = "<h1>Head line</h1><p>Some words of the story itself.</p><p>More of the same story follows here.</p>"
    want = "Head line\n\nSome words of the story itself.\n\nMore of the same story follows here."
    wrappers = ("class='has-sidebar'", "id=page class='no-sidebar'", "class='post comments-open'", "class='content widget'", "class=sidebar")
    for attributes in wrappers:
        for inner, found in ((story, want), (f"<article>{story}</article>", want), (story[story.index("<p>") :], want.partition("\n\n")[2])):
            assert text(f"<body><nav>Menu</nav><div {attributes}>{inner}</div></body>") == found, (attributes, inner)
    section = "<section id='share-price'><p>The price of a share rose.</p></section>"
    assert text(f"<article>{story}{section}<p>Last words of it.</p></article>") == f"{want}\n\nThe price of a share rose.\n\nLast words of it."
    for mark in ("class='ad-slot'", "id=comments", "class='x share-buttons'", "class='comment-list'", "role=search", "class=ad300", "class='p hidden' hidden"):
        assert text(f"<article>{story}<div {mark}><p>Not a part of it</p></div></article>") == want, mark
    replies = "<section id=comments><article class=comment><p>A reader's words</p></article></section>"
    assert text(f"<article>{story}{replies}</article>") == want


def test_words_of_any_block_count(spark, sf):
    lines = ["One two three four five six.", "Seven <b>eight</b> nine ten.", "And the last line."]
    want = [re.sub("<[^>]+>", "", x) for x in lines]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()
    for weight in (WEIGHT, html_text.weights(html_text.label_counts(r.html for r in pages))):
        for block in ("div", "section", "td", "li", "center", "dd"):
            page = "<body><nav>Menu</nav>" + "".join(f"<{block}>{x}</{block}>" for x in lines) + "</body>"
            assert html_text.main_text(page, weight) == "\n\n".join(want), block
        rows = "".join(f"<tr><td>{x}</td></tr>" for x in lines)
        assert html_text.main_text(f"<html><body><table><tbody>{rows}</tbody></table></body></html>", weight) == "\n\n".join(want)
        for page in (f"<html><body>{'<br>'.join(lines)}</body></html>", "<br>".join(lines)):
            assert html_text.main_text(page, weight) == " ".join(want)
        assert html_text.main_text(" ".join(want), weight) == " ".join(want)
        assert html_text.main_text("just words", weight) == "just words"
        # Such blocks at the start and the end of an article.
        page = f"<body><div>{lines[0]}</div><p>{lines[1]}</p><div>{lines[2]}</div></body>"
        assert html_text.main_text(page, weight) == "\n\n".join(want)
        # Rows of links do not.
        links = "".join(f"<a href={i}>Link</a> | " for i in range(9))
        assert html_text.main_text(f"<body><div>{links}</div>{page}<div>{links}</div>", weight) == "\n\n".join(want)
    out = html_text.weights(html_text.label_counts(["<div>out of it</div><article><p>in it</p></article>"] * 99))
    assert html_text.main_text("<div>Only words of a block that labelled pages never have in content</div>", out).startswith("Only words")


def test_only_raw_text_runs_to_the_end():
    two = "Words before the icon\n\nand the words after it"
    for name in ("template", "svg", "math", "canvas", "select", "button", "object", "audio", "video"):
        for later in ("", f"<{name}>x</{name}>"):
            for icon in (f"<{name} id='x'/>", f"<{name} width=1 / >", f"<div><{name}>Go</div>", f"<{name}>Go", f"<{name}><a>Go</a><i>x</{name}>", f"</{name}>"):
                page = f"<body><p>Words before the icon</p>{icon}<p>and the words after it</p>{later}</body>"
                assert text(page) == two, page
        assert text(f"<p>one two <{name}><g>no</b></{name}> three four") == "one two three four"
        assert text(f"<p>one two <{name}>Go</p>three four five") == "one two\n\nthree four five"
    drawing = "<svg>" + "<path d='M0'></path>" * 900 + "</svg>"
    assert text(f"<p>one two {drawing} three four</p>") == "one two three four"
    for name in ("script", "style", "textarea", "title", "noscript", "iframe"):
        assert text(f"<p>one two three</p><{name}><p>not this</p>") == "one two three"


_ARTICLE = [f"The {w} of the harbour town was rebuilt in the spring by people who lived there" for w in "market bridge school tower garden mill".split()]


@pytest.mark.parametrize("share", [0.1, 0.5, 3.0])
@pytest.mark.parametrize("kind", ['div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="sidebar"',
                                  'section class="cookie-notice"', 'div class="related"', 'div role="complementary"'])
@pytest.mark.parametrize("first", [False, True])
def test_boilerplate_of_any_size_is_left_out(share, kind, first):
    n = max(1, round(share * len(_ARTICLE)))
    item = "li" if kind.startswith("ol") else "p"
    other = f"<{kind}>" + "".join(f"<{item}>I read this {i} times and liked it every time, thank you all</{item}>" for i in range(n)) + f"</{kind.split()[0]}>"
    text = "".join(f"<p>{p}</p>" for p in _ARTICLE)
    for body in (f"<div>{text}</div>", f"<article><h1>Town</h1>{text}</article>"):
        page = f"<body>{other}{body}</body>" if first else f"<body>{body}{other}</body>"
        got = html_text.main_text(page, html_text.weights({}))
        assert got.removeprefix("Town\n\n") == "\n\n".join(_ARTICLE)


def test_a_page_of_one_marked_part_keeps_its_text():
    for kind in ('div class="comments"', 'section id="sidebar"'):
        page = f"<body><{kind}><p>{_ARTICLE[0]}</p><p>{_ARTICLE[1]}</p></{kind.split()[0]}></body>"
        assert html_text.main_text(page, html_text.weights({})) == "\n\n".join(_ARTICLE[:2])
