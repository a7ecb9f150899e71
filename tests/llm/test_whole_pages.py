"""Pages of which a part was lost, and generated ones whose article is known."""

import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm import html

LONG = "This is a long sentence, with words, and it goes on; as articles do, for a while. " * 4


def test_pages_without_article_keep_all_content():
    many = "".join(f"<p>{k} {LONG}</p>" for k in range(19))
    got = html.main_text(f"<body><h1>Title</h1><div>{many}</div><div><p>last {LONG}</p></div></body>").split("\n")
    assert got[0] == "Title" and len(got) == 21 and got[-1].startswith("last")
    assert html.main_text(f"<body><ul><li>Menu</ul><h1>Title</h1><div>{many}</div></body>").split("\n")[:2][0] == "Title"
    got = html.main_text(f"<body><section>{many}</section><section><p>short, but {LONG}</p></section></body>")
    assert "short, but" in got


def test_article_keeps_its_header_and_marked_content():
    got = html.main_text(f'<article><header class="entry-header"><h1>Title</h1></header><div class="content widget"><p>One. {LONG}</p><p>Two. {LONG}</p></div><div class="related"><a href=a>More</a></div></article>').split("\n")
    assert got[0] == "Title" and [x[:4] for x in got[1:]] == ["One.", "Two."]


def test_comments_are_no_article_and_names_only_suggest():
    got = html.main_text(f'<body><article><p>One. {LONG}</p></article><article class="comment"><p>Nice. {LONG}</p></article></body>')
    assert got.startswith("One.") and "Nice." not in got
    for mark in ('class="header-image-post"', 'id="search-results"', 'class="widget share"'):
        got = html.main_text(f"<body><nav>Menu</nav><div {mark}><h1>Title</h1><p>One. {LONG}</p><p>Two. {LONG}</p></div><div class=ad>Buy, now.</div></body>").split("\n")
        assert [x[:4] for x in got] == ["Titl", "One.", "Two."]
    assert "Nice" not in html.main_text(f"<body><div><p>One. {LONG}</p></div><section id=comments><p>Nice. {LONG}</p><p>Nice. {LONG}</p></section>")
    assert html.main_text(f"<div class=comments><p>Only. {LONG}</p></div>").startswith("Only.")


def starts(page):
    return [x[:5] for x in html.main_text(page).split("\n")]


def test_elements_only_suggest():
    text = f"<h1>Title</h1><p>One.. {LONG}</p><p>Two.. {LONG}</p>"
    teasers = "<article><h3>Card one</h3><p>Short, so.</p></article><article><h3>Card two</h3><p>Short, too.</p></article>"
    whole = ["Title", "One..", "Two.."]
    assert starts(f'<body><div class="content">{text}</div><div>{teasers}</div></body>') == whole
    assert starts(f'<body><form id="aspnetForm"><nav><a href=/>Home</a></nav><div>{text}</div></form></body>') == whole
    assert starts(f'<body><form action=/s><label>Search this, now</label></form><div>{text}</div></body>') == whole
    assert starts(f'<body><div class="overflow hidden wide" title="the hidden door">{text}</div></body>') == whole
    for hidden in ("hidden", 'hidden=""', 'class="x" hidden', "hidden id=a"):
        assert starts(f"<body><div {hidden}><p>Gone. {LONG}</p></div><div>{text}</div></body>") == whole
    assert starts(f'<body><div class="page-header"><h1>Title</h1></div><div><p>One.. {LONG}</p><p>Two.. {LONG}</p></div></body>') == whole
    assert starts(f"<body><ul><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>About</a></ul>{text}</body>") == whole
    assert starts(f"<body><div>{text}</div><div><h2>3 Comments</h2><p>Nice. {LONG}</p><p>Good.</p></div></body>") == whole
    assert starts(f"<body><div>{text}<h3>Comments (2)</h3><p>Nice, one.</p><p>Good.</p></div></body>") == whole


def test_formulas_objects_and_quoted_authors():
    page = f"<article><p>Let <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> hold, {LONG}</p><p>See <object data=a>the figure</object> here, {LONG}</p><blockquote><p>Said. {LONG}</p><footer>An Author</footer></blockquote></article>"
    got = html.main_text(page).split("\n")
    assert got[0].startswith("Let x = 2 hold, This") and got[1].startswith("See the figure here, This") and got[-1] == "An Author" and len(got) == 4


@given(st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_generated_pages_give_their_article(seed):
    """Pages put together from blocks whose text is known, with optional end tags and other parts around them."""
    rng = random.Random(seed)
    sentence = lambda: "".join(rng.choice(["Some", "Other", "Many", "Über"]) + "".join(f" {rng.choice(['word', 'more', 'line', 'über', 'x&amp;y'])}" for _ in range(rng.randrange(4, 14))) + rng.choice([". ", ", so. ", "! "]) for _ in range(rng.randrange(2, 6))).strip()
    plain = lambda t: t.replace("&amp;", "&")
    blocks, expected = [], ["Title of it"]
    for _ in range(rng.randrange(3, 12)):
        t = sentence()
        cut = t.find(" ") + 1
        kind = rng.choice(["p", "open", "h2", "ul", "quote", "b"])
        if kind == "ul":
            items = [sentence() for _ in range(rng.randrange(1, 4))]
            blocks.append("<ul>" + "".join(f"<li>{x}" + rng.choice(["", "</li>"]) for x in items) + "</ul>")
            expected += map(plain, items)
            continue
        blocks.append({"p": f"<p>{t}</p>", "open": f"<p>{t}", "h2": f"<h2>{t}</h2>", "quote": f"<blockquote><p>{t}</p></blockquote>", "b": f"<p>{t[:cut]}<b>{t[cut:]}</b></p>"}[kind])
        expected.append(plain(t))
    article = "<h1>Title of it</h1>" + "\n".join(blocks)
    whole = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", '<div class="post">{}</div>', "<main>{}</main>"]).format(article)
    before = "".join(rng.sample(["<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", "<header><a href=/>Site</a></header>", '<div class="cookie-notice"><p>We use cookies, yes.</p></div>', "<script>if (a < b) { x('</p>') }</script>", "<ul><li><a href=/x>One</a></li><li><a href=/y>Two</a></li><li><a href=/z>Three</a></li></ul>", '<form action=/s><label>Search</label><input></form>'], rng.randrange(0, 5)))
    after = "".join(rng.sample(["<aside><p>Read this, too.</p></aside>", "<footer>&copy; me</footer>", "<form><p>Name</p><input></form>", '<div id="comments"><p>I like it, a lot.</p></div>', '<div class="related-posts"><a href=/c>Next</a></div>', "<!-- gone -->", '<div><h3>2 comments</h3><p>Well, I like it.</p></div>', "<div><article><h3>Next</h3><p>More, soon.</p></article></div>"], rng.randrange(0, 5)))
    body = rng.choice(["{}", "{}", '<form id="aspnetForm" method=post>{}</form>', '<div class="page hidden-sm" title="not hidden">{}</div>']).format(before + whole + after)
    assert html.main_text(f"<html><head><title>T</title></head><body>{body}</body></html>").split("\n") == expected


def test_deep_pages_take_memory_in_proportion():
    page = lambda n: "<div>" * n + f"<p>Deep. {LONG}</p>" + "<p>x</span></b>" * n
    peaks = []
    for n in (5000, 20000):
        tracemalloc.start()
        assert html.main_text(page(n)).startswith("Deep.")
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0]


def test_repeated_rows_and_very_long_pages(spark):
    long = "<article>" + f"<p>One. {LONG}</p>" * 4000 + "</article>"
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, None, "<p>a")], "page_id int, url string, html string")
    got = sorted((r.page_id, r.n_chars) for r in html.extract_pages(df).collect())
    assert got[0] == got[1] and got[0][1] > 1_000_000 and got[2] == (2, 1)
