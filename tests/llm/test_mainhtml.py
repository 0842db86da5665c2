import pytest

from hexlytics.llm.mainhtml import extract, main_text, smoothed
import numpy as np

LONG = "This sentence is long enough to count as the content of an article, and goes on a little."


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"),
    (f"<article><h1>T</h1><p>{LONG}</p><p>Sh.</p></article>", f"T {LONG} Sh."),
    (f"<nav><a href=x>Home</a></nav><article><p><b>{LONG}<br><p>a &amp; b&nbsp;c</article>"
     "<footer>&copy; x</footer>", f"{LONG} a & b c"),
    (f"<article><p>x<b>y</b>z</p><p>{LONG}</p>", f"xyz {LONG}"),
    (f"<article><p>{LONG}</p><script>var t='</p>';</script><style>p{{}}</style>"
     "<!-- note --><form>Mail <input></form></article>", LONG),
    (f"<div class='cookie-notice'>We use cookies {LONG}</div><main><p>{LONG}</p></main>", LONG),
    (f"<article><p>{LONG}</p><section class=comments><article><p>Nice {LONG}</p></article>"
     "</section></article>", LONG),
    (f"<div id=sidebar><p>{LONG}</p></div><div class=post><p>{LONG} One.</p><p>Two.</p></div>",
     f"{LONG} One. Two."),
    (f"<header>Site</header><article><header><h1>Head</h1></header><p>{LONG}</p></article>",
     f"Head {LONG}"),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><a href=a>one</a> <a href=b>two</a></div>",
     f"{LONG} {LONG}"),
    ("<article><p>Short.</article>", "Short."),
    (f"<article><p>{LONG}\n\t more</p><ul><li>one<li>two</ul></article>", f"{LONG} more one two"),
])
def test_pages(html, text):
    assert main_text(html) == text


LONGER = " ".join([LONG] * 8)


@pytest.mark.parametrize("html,text", [
    (f"<main><h1>Title</h1><p>Lead.</p><article><p>{LONGER}</p></article><p>End.</p></main>",
     f"Title Lead. {LONGER} End."),
    (f"<h1>Title</h1><article><p>{LONGER}</p></article>", f"Title {LONGER}"),
    (f"<article><p>{LONGER}</p></article><article><p>Short.</p></article>"
     "<article><h2>Third</h2><p>Short too.</p></article>", f"{LONGER} Short. Third Short too."),
    (f"<body><h1>Title</h1><div><p>{LONGER}</p><p>{LONGER}</p></div><h2>More</h2>"
     "<div><p>Short.</p></div><section><p>One.</p><p>Two.</p><p>Three.</p><p>Four.</p></section>",
     f"Title {LONGER} {LONGER} More Short. One. Two. Three. Four."),
    (f"<body><div><p>Short first.</p></div><div><p>x</p><p>y</p><p>z</p></div><div><p>{LONGER}"
     "</p></div><div><a href=a>one</a> <a href=b>two</a></div>", f"Short first. x y z {LONGER}"),
    (f"<body><div><p>{LONGER}</p></div><div><a href=a>some links here</a></div>"
     f"<div><h2>Head</h2><p>Sh.</p></div><div class=ad>{LONG}</div>", f"{LONGER} Head Sh."),
    (f"<body><h1>T</h1><ul><li><a href=a>{LONG}</a></ul><div>{LONG}</div>", f"T {LONG}"),
    ("<div><a href=a>one</a> <a href=b>two</a></div><div><a href=c>three</a></div>",
     "one two three"),
    (f"<nav><a href=x>Home</a></nav><div><div>Cell.</div><p>{LONGER}</p></div><footer>x</footer>",
     f"Cell. {LONGER}"),
])
def test_short_blocks_stay(html, text):
    assert main_text(html) == text


def test_long_page():
    body = "".join(f"<p>{LONG} {k}</p>" for k in range(5000))
    out = main_text(f"<body><nav>menu</nav><article>{body}</article></body>")
    assert out.startswith(LONG) and out.endswith("4999") and out.count(LONG) == 5000


def test_smoothing_keeps_a_constant():
    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0)


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (None, None, None), (1, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'old' AS main_text", "1 AS text")
    out = extract(df)
    assert sorted((r["main_text"], r["text"]) for r in out.collect()) == [("", 1), ("", 1), (LONG, 1)]
    assert extract(df.limit(0)).count() == 0


LINKS = "".join(f"<li><a href=/{k}>Another story number {k}</a></li>" for k in range(8))


@pytest.mark.parametrize("html,text", [
    (f'<body><div id="content" class="page-with-sidebar"><h1>T</h1><p>{LONGER}</p></div>', f"T {LONGER}"),
    (f'<body><div class="sidebar"><p>{LONGER}</p></div><footer>x</footer>', LONGER),
    (f"<body><aside><p>Aside.</p><article><p>{LONG}</p></article><footer>x</footer>", LONG),
    (f"<body><aside><article><p>Teaser {LONG}</p></article></aside><article><p>{LONGER}</p></article>", LONGER),
    (f'<article><p>{LONG}</p><section class="related-work"><h2>Related work</h2><p>{LONG} 2</p></section>'
     f'<p id="notice-period">{LONG} 3</p><div class="side-by-side"><p>Left.</p><p>Right.</p></div></article>',
     f"{LONG} Related work {LONG} 2 {LONG} 3 Left. Right."),
    (f'<article><p>{LONG}</p><div style="color: red; display: none">{LONG}</div></article>', LONG),
    (f'<article><p>{LONG}</p><div class="dfp-slot">Buy this. {LONG}</div><p>End.</p></article>', f"{LONG} End."),
    (f'<article><p>{LONGER}</p></article><section><h2>Discussion</h2><article class="c"><p>Nice. {LONG}</p></article>'
     f'<article class="c"><p>No. {LONG}</p></article></section>', LONGER),
    (f'<article><p>{LONGER}</p><h2>Comments</h2><article class="c"><p>Nice.</p></article></article>', LONGER),
    (f"<article><p>{LONG}</p><h2>Discussion</h2><p>{LONG} 2</p></article>", f"{LONG} Discussion {LONG} 2"),
    (f"<article><p>{LONG}</p><p>{LONG}</p><h3>More</h3><ul>{LINKS}</ul><h2>Next</h2><p>{LONG}</p></article>",
     f"{LONG} {LONG} Next {LONG}"),
    (f"<article><p>{LONG}</p><ul><li><a href=a>One source</a></li></ul></article>", f"{LONG} One source"),
    (f"<body><div><p>{LONGER}</p></div><div>© 2024 Somebody. All rights.</div>", LONGER),
    (f"<body><form><div><p>{LONGER}</p><input><select><option>x</select></div></form>", LONGER),
    (f"<article><p>Short.</p></article><div class=comments><p>{LONGER}</p></div>", "Short."),
    (f"<div class=post><p>{LONG}</p></div><div id=comments><p>{LONGER}</p></div>", LONG),
])
def test_names_are_hints_and_the_ratio_judges(html, text):
    assert main_text(html) == text


def test_pages_of_known_articles_and_chrome_with_random_names():
    import random

    rng = random.Random(10)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "labore", "magna"]
    name = lambda: "".join(rng.choice("bcdfgklmnprstvwz") + rng.choice("aeiou") for _ in range(3))
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    for _ in range(200):
        blocks = [prose(rng.randint(1, 60)) for _ in range(rng.randint(2, 12))]
        menu = "".join(f"<li><a href=/{k}>{prose(2)}</a>" for k in range(rng.randint(4, 12)))
        inner = "".join(rng.choice([f"<p>{b}</p>", f"<div class={name()}><p>{b}</p></div>", f"<p class={name()}>{b}"])
                        for b in blocks)
        outer = rng.choice(["article", "main"])
        page = (f"<body class={name()}><nav>{menu}</nav><div class={name()}><ul>{menu}</ul></div>"
                f"<{outer} class={name()}>{inner}<ul class={name()}>{menu}</ul></{outer}>"
                f"<div class='{name()} ad'>{prose(20)}</div><div><ul>{menu}</ul></div><footer>{prose(6)}</footer>")
        got, want = main_text(page), " ".join(blocks)
        assert got == want, page
