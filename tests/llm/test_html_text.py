import random
import time

import pytest
from pyspark.sql import functions as F

from marklens.llm import html_text as H

LONG = "This sentence is long enough to make the sum of text over a few lines rise above the threshold of the method. "
SHORT = "A short one."


def text_of(html, **options):
    return "\n\n".join(line.text for line in H.main_lines(H.page_lines(html), **options))


def test_article_alone_is_kept():
    html = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{x:"</p>"}</style><script>var a = "<p>no</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More menu</a></li></ul></nav><!-- note <p> -->'
        '<div class="ad">Buy now &amp; here.</div><article><h1>Head &amp; line</h1><p><b>First&nbsp;\n  para.<br><p>Caf&eacute; &#x41;&#66; 1 &lt; 2'
        "</p><p> </p><ul><li>one<li>two</ul></article><footer>&copy; me</footer></body></html>"
    )
    assert text_of(html) == "Head & line\n\nFirst para.\n\nCafé AB 1 < 2\n\none\n\ntwo"


FURNITURE = [
    "<nav>{}</nav>", "<header>{}</header>", "<footer><div>{}</div></footer>", "<aside>{}</aside>", "<form><p>{}</p></form>",
    '<div class="sidebar"><p>{}</p></div>', '<div id="cookie-notice">{}</div>', '<section class="user-comments"><p>{}</p></section>',
    '<div class="relatedPosts">{}</div>', '<p class="advert">{}</p>', '<div role="navigation">{}</div>', "<div hidden>{}</div>",
    '<div style="display: none">{}</div>', "<script>{}</script>", "<noscript>{}</noscript>", "<template><p>{}</p></template>",
    "<!-- {} -->", '<div aria-hidden="true">{}</div>', "<select><option>{}</select>", "<button>{}</button>",
]


@pytest.mark.parametrize("wrapped", FURNITURE)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='content'>{}</div>"])
def test_furniture_goes_wherever_it_stands(wrapped, around):
    furniture = wrapped.format(LONG + "furniture")
    page = "<body>" + furniture + around.format(f"<p>{LONG}<p>{SHORT}") + furniture + "</body>"
    assert text_of(page) == f"{LONG.strip()}\n\n{SHORT}"
    inside = "<body>" + around.format(f"<p>{LONG}</p>{furniture.replace('<header>', '<nav>').replace('</header>', '</nav>')}<p>{SHORT}</p>") + "</body>"
    assert text_of(inside) == f"{LONG.strip()}\n\n{SHORT}"


def test_surge_and_dive_without_an_article():
    """Lines of links and short lines far from the text are left out; short lines within it stay."""
    links = "".join(f'<div><a href="/{i}">Link number {i} to somewhere else</a></div>' for i in range(8))
    page = f"<div>Home</div>{links}<p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p>{links}<p>Tiny.</p>"
    assert text_of(page) == f"{LONG.strip()}\n\n{SHORT}\n\n{LONG.strip()}"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("", ""), ("no markup", "no markup"), ("<", "<"), ("<p", ""), ("<article>a", "a"), ("<article>a<p>b</article>c", "a\n\nb"),
        ("<article><script>x</article>", ""), ("<article>a</b></i>b</article>", "ab"), ("<article>x<a href=/>link</a> y</article>", "xlink y"),
        ("<article>&nothing &amp;amp; &#0; &#xD800;</article>", "¬hing &amp; � �"),
        ("<article>" + "<div>" * 3_000 + "deep" + "</div>" * 3_000 + "</article>", "deep"),
        ("<main><p>m</main>", "m"), ("<ARTICLE><P>Up</ARTICLE>", "Up"), ("<article><pre>a\n b</pre></article>", "a b"),
    ],
)
def test_broken_and_small_pages(html, expected):
    assert text_of(html) == expected


def test_odd_rows(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<article>é 😀</article>"), (4, "u", "<article>" + "<p>word</p>" * 50_000 + "</article>"), (1, "u", None)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(0)})
    rows = H.extracted(frame).collect()
    assert sorted(((r["page_id"], r["n_chars"]) for r in rows), key=str) == sorted([(1, 0), (1, 0), (2, 0), (None, 3), (4, 50_000 * 6 - 2)], key=str)
    assert H.extracted(frame).columns == ["page_id", "url", "text", "n_chars"]
    assert H.extracted(frame.limit(0)).count() == 0


def block_sums(weights, window):
    return [sum(weights[i : i + window]) for i in range(len(weights))]


@pytest.mark.parametrize("seed", range(6))
def test_lines_between_surge_and_dive_by_brute_force(seed):
    """Plain lines of any length: each is kept if a surge before it has not dived yet."""
    rnd = random.Random(seed)
    lines = [H.Line("x" * n, min(n, rnd.choice([0, 0, n])), rnd.random() < 0.1, False) for n in (rnd.choice([3, 20, 60, 200]) for _ in range(80))]
    weights = [0 if line.furniture else len(line.text) - line.link_length for line in lines]
    sums = block_sums(weights, 3)
    wanted = []
    for at, weight in enumerate(weights):
        starts = [i for i in range(at + 1) if sums[i] > 86 and weights[i] > 0]
        if weight and starts and any(all(sums[j] > 0 for j in range(i, at + 1)) for i in starts):
            wanted.append(at)
    kept = H.main_lines(lines)
    assert [at for at, line in enumerate(lines) if any(line is k for k in kept)] == wanted


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        # No end tag of the head, none of its start tag either, a title alone.
        (f"<html><head><title>t</title><body><p>{LONG}</p></body></html>", LONG.strip()),
        (f"<head><meta charset=utf-8><link rel=x><title>t</title><div><p>{LONG}</p></div>", LONG.strip()),
        (f"<title>t</title><style>x</style>{LONG}", LONG.strip()),
        (f"<html><head><title>t</title>{LONG}", LONG.strip()),
        # A form around the whole page, with a small one inside it named as furniture.
        (f"<body><form id=main><nav>Menu</nav><div><p>{LONG}</p><p>{SHORT}</p></div><label>Name</label></form>", f"{LONG.strip()}\n\n{SHORT}"),
        (f"<body><p>{LONG}{LONG}</p><form><p>{LONG}</p></form>", f"{LONG}{LONG}".strip()),
        # An article that holds only a teaser of the text.
        (f"<article><h1>Head</h1></article><div><p>{LONG}</p><p>{LONG}</p></div>", f"Head\n\n{LONG.strip()}\n\n{LONG.strip()}"),
        # Few words and no article.
        ("<body><h1>Title</h1><p>One.</p><p>Two.</p><footer>x</footer>", "Title\n\nOne.\n\nTwo."),
    ],
)
def test_pages_without_the_usual_marks(html, expected):
    assert text_of(html) == expected


def test_time_is_linear_in_the_page():
    """End tags without a start tag do not search all that is open."""
    started = time.process_time()
    lines = H.page_lines("<div>" * 200_000 + "text" + "</p>" * 200_000)
    assert [line.text for line in lines] == ["text"] and time.process_time() - started < 20
