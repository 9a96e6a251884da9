"""Main text of pages: layouts, the part that ratios play, and odd rows."""

import random

import pytest

from tracelogic.llm import html_text


def test_html():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p>First <b>bold
    text<br>here.<p>Second&nbsp;para.</p><form><input><label>Search</label></form></article><aside>Also read this</aside><section id="comments"><p>Nice post! I really liked this very long comment here.</p></section><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\n\nFirst bold text here.\n\nSecond para."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("just text") == "just text"


LONG = " ".join(f"sentence number {i} of the text." for i in range(40))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<div id=content><h1>Head</h1><p class=lede>Lede.</p><div class=body><p>{LONG}</p><p>{LONG}</p></div></div>", ["Head", "Lede.", LONG, LONG]),
        (f"<div id=content><div class=body>{f'<p>{LONG}</p>' * 12}</div><div class=more><p>{LONG}</p></div></div>", [LONG] * 13),
        (f"<div id=page><ul><li><a href=/>Home</a></li></ul><div class=top><h1>Head</h1></div><div class=body><p>{LONG}</p><p>Short.</p></div><ul><li><a href=/x>Next</a></li></ul></div>", ["Head", LONG, "Short."]),
        (f"<main><h1>Day</h1><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p></article></main>", ["Day", LONG, LONG, LONG]),
        (f"<h1>Day</h1><article><p>{LONG}</p><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p></article>", ["Day", LONG, LONG, "B", LONG]),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><div><h2>Second</h2><p>{LONG}</p></div>", [LONG, LONG, "Second", LONG]),
        (f"<div class='content has-sidebar'><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>", [LONG]),
        (f"<div class='layout no-sidebar'><p>{LONG}</p></div><div class='site-header'><p>{LONG}</p></div>", [LONG]),
        (f"<article><div class=entry-header><h1>Head</h1></div><p>{LONG}</p></article>", ["Head", LONG]),
        (f"<div><div class=entry-header><h1>Head</h1></div><div><p>{LONG}</p></div></div>", ["Head", LONG]),
    ],
)
def test_html_layouts(body, want):
    assert html_text.main_text(f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>Footer</footer></body></html>").split("\n\n") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>x</title><p>{LONG}</p><p>{LONG}</p>", [LONG, LONG]),
        (f"<body><div class='layout with-sidebar'><p>{LONG}</p><p>{LONG}</p></div></body>", [LONG, LONG]),
        (f"<body><div class='post comments-open'><h1>Head</h1><p>{LONG}</p></div><div class=comments><p>Nice post! {LONG[:300]}</p></div></body>", ["Head", LONG]),
        (f"<body><div class=post-header><h1>Head</h1></div><div><p>{LONG}</p></div></body>", ["Head", LONG]),
        (f"<body><article><h1>Head</h1><p>{LONG}</p><div class=social-history><p>{LONG}</p></div><div class=social-links><a href=/f>Follow us on this</a></div></article></body>", ["Head", LONG, LONG]),
        (f"<body><main><p>{LONG}</p><div class=related-work><p>{LONG}</p></div><div class=related><p>Short.</p></div></main></body>", [LONG, LONG]),
        (f"<body><div class=sidebar-wrapper><h1>Head</h1><p>{LONG}</p></div><div class=side><a href=/>Home</a></div></body>", ["Head", LONG]),
        (f"<body><article><p>{LONG}</p></article><section id=comments><h2>Two</h2><p>{LONG}</p></section></body>", [LONG]),
    ],
)
def test_names_only_support_the_ratios(page, want):
    assert html_text.main_text(page).split("\n\n") == want


SOUP = f"<body><div><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>More</a></div><div><div>Log in</div><div>Our offers</div><div>Call us</div></div><div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div><div>All rights</div><div>Terms</div><div>Imprint</div></div></body>"


def test_ratios_decide_where_tags_and_names_say_nothing(monkeypatch):
    want = [LONG, "Short one.", LONG]
    assert html_text.main_text(SOUP).split("\n\n") == want
    monkeypatch.setattr(html_text, "ratios", lambda lines: [1.0] * len(lines))
    assert html_text.main_text(SOUP).split("\n\n") != want


def test_clusters():
    r = random.Random(4)
    ratio = [r.uniform(0, 6) for _ in range(20)] + [r.uniform(80, 200) for _ in range(12)] + [r.uniform(0, 6) for _ in range(20)]
    got, sure = html_text.cluster(ratio)
    assert all(got[20:32]) and not any(got[:16]) and not any(got[36:])
    assert all(sure[20:32]) and not any(sure[:20]) and not any(sure[32:])
    assert html_text.cluster([3.0])[0] == [True] and html_text.cluster([0.0, 0.0])[0] == [False, False]


def test_rows_of_pages(spark):
    long = "<p>" + "</p><p>".join(f"{i} {LONG}" for i in range(400)) + "</p>"
    pages = [(1, "u", f"<article>{long}</article>", 5), (1, "u", f"<article>{long}</article>", 5), (None, None, None, 6), (2, "v", "", 7), (3, "w", "<p>a <b>b<i>c</p></b> d&lt;&#233;&nbsp;e<p>f", 8), (4, "x", "<script>only</script><!-- x -->", 9), (5, "y", "<div>" * 500, 1)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, html_text.extract(rows).collect()), key=str)
    want = "\n\n".join(f"{i} {LONG}" for i in range(400))
    assert got == sorted([(1, "u", want, len(want)), (1, "u", want, len(want)), (None, None, "", 0), (2, "v", "", 0), (3, "w", "a bc\n\nd<\u00e9 e\n\nf", 14), (4, "x", "", 0), (5, "y", "", 0)], key=str)
    assert html_text.extract(rows.limit(0)).count() == 0
