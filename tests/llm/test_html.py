import itertools
import random
import time

from graphquarry.llm.html import blocks_of, default_weights, extract_main_text, features_of, main_text, minimum_cut, smoothness

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, as every site does today.</div><div class="ad">Buy this now, it is cheap and good.</div>
<article><h1>Title &amp; more</h1><p><b>Bold start<br><p>First   paragraph&nbsp;of the text, which is long enough.</p><p>Short.</p>
<blockquote>Quoted words.</blockquote></article><aside class=sidebar><p>Related things that you may like to read.</p></aside>
<section id="comments"><p>I liked this article very much, thank you.</p></section>
<form><label>Mail</label><button>Send</button></form><footer>&copy; site</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "Title & more\n\nBold start\n\nFirst paragraph of the text, which is long enough.\n\nShort.\n\nQuoted words."


def test_page_without_article():
    page = "<body><div id=menu><a href=a>A</a></div><div><p>" + "Many words stand in this sentence, as they do in prose. " * 3 + "</p><p>Yes.</p><p>" + "And here are more words of the same kind of prose. " * 3 + "</p></div><div class='footer'>Imprint</div></body>"
    text = main_text(page)
    assert text.count("\n\n") == 2 and "Yes." in text and "Imprint" not in text and "A\n" not in text


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        gains = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(labels):
            return sum(max(g, 0) if not y else max(-g, 0) for g, y in zip(gains, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(cost(x) for x in itertools.product((True, False), repeat=n))
        assert abs(cost(minimum_cut(gains, edges)) - best) < 1e-6


def test_odd_input(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>a < b <p", "x"), (4, "u", PAGE, "x"), (4, "u", PAGE, "x"), (5, "u", "<article><p>" + "word " * 50000, "x")]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 6 and [r["n_chars"] for r in out if r["page_id"] in (1, 2)] == [0, 0]
    assert [r["n_chars"] for r in out if r["page_id"] == 5] == [249999]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_missing_end_tags_and_self_closed_elements():
    body = "<article><p>Here stands a sentence of the main text, which is long enough.</p>{}<p>And here stands another one of the same kind and length.</p></article>"
    want = main_text("<body>" + body.format(""))
    assert want.count("\n\n") == 1
    assert main_text("<html><head><title>x</title><meta charset=utf-8><body>" + body.format("")) == want
    assert main_text("<head><title>x</title><style>p{}</style>" + body.format("")) == want
    for extra in ("<svg viewBox='0 0 1 1'/>", "<math />", "<svg><text>no</text></svg>", "<canvas>", "<svg a='/>'>", "<svg/><svg>no</svg>"):
        assert main_text("<body>" + body.format(extra)) == want
    assert "Drop" not in main_text("<body>" + body.format("<script>Drop"))


def test_cut_changes_labels_of_single_blocks():
    """Blocks that the classifier alone gets wrong follow their neighbours, in both directions."""
    inside = "<div><h1>Bridge</h1><p>Many words stand in this sentence, as they do in prose that is long.</p><div><a href=1>Map</a> of the place</div><p>And here are more words of the same kind of prose, as before.</p></div>"
    outside = "<div><ul><li><a href=1>Home</a></li><li>What we say of it.</li><li><a href=2>News of today</a></li><li><a href=3>Local</a></li></ul></div>"
    blocks = blocks_of(f"<body>{outside}{inside}</body>")
    alone = [g > 0 for g in features_of(blocks) @ default_weights()]
    cut = minimum_cut((features_of(blocks) @ default_weights()).tolist(), smoothness(blocks))
    texts = [b.text for b in blocks]
    assert not alone[texts.index("Map of the place")] and cut[texts.index("Map of the place")]
    assert cut == [False] * 4 + [True] * 4


def test_names_that_only_hold_a_bad_word_keep_the_article():
    text = "<p>Many words stand in this sentence, as they do in prose.</p><p>And here are more words of the same kind of prose.</p>"
    for start in ('<div class="content no-sidebar">', '<div class="content post-share-enabled">', '<div class="article-body related-enabled">', '<section class="post search-result">', '<div class="entry-header-off">', "<form id=aspnetForm>", '<div class="page-with-banner">'):
        assert main_text(f"<body>{start}<h1>On words</h1>{text}") == "On words\n\nMany words stand in this sentence, as they do in prose.\n\nAnd here are more words of the same kind of prose."
    for name in ("cookie-banner", "site-footer", "post-comments", "comment-body", "footer-widgets", "main-nav", "adSlot", "newsletter-signup"):
        assert main_text(f"<article>{text}</article><div class='{name}'><p>This is a sentence that nobody wants to see in the text.</p></div>").count("\n\n") == 1


def test_boilerplate_inside_an_article():
    text = "<p>Many words stand in this sentence, as they do in prose.</p>"
    for extra in ("<aside><h3>See also</h3><p>Other words that stand beside the text, and are long enough.</p></aside>", "<footer><p>Written by someone who likes to write about words a lot.</p></footer>", "<nav><a href=1>Next part</a></nav>", "<form><p>Give us your name, and we will write to you each day.</p><button>Send</button></form>"):
        assert main_text(f"<article>{text}{extra}{text}{text}</article>") == "\n\n".join([main_text(f"<article>{text}</article>")] * 3)


def test_long_and_broken_pages_take_linear_time():
    began = time.time()
    for page in ("<a " * 350_000, '<a b="' * 200_000 + ">", "<!--" * 250_000, "<svg>" * 100_000, "<script>" * 100_000, "</p" * 300_000, "<div>" * 100_000 + "x", "<p>x <a href=1>y</a> " * 50_000):
        main_text(page)
    rng = random.Random(4)
    minimum_cut([rng.uniform(-2, 2) for _ in range(50_000)], [(k, k + 1, 1.0) for k in range(49_999)] + [(k, k + 2, 0.5) for k in range(49_998)])
    assert time.time() - began < 30


def brute_text(page):
    """Whole pages against all labellings."""
    blocks = blocks_of(page)
    gains, edges = features_of(blocks) @ default_weights(), smoothness(blocks)

    def cost(labels):
        return sum(max(g, 0) if not y else max(-g, 0) for g, y in zip(gains, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])

    best = min(itertools.product((True, False), repeat=len(blocks)), key=cost)
    return "\n\n".join(b.text for b, y in zip(blocks, best) if y)


def test_pages_against_all_labellings():
    rng = random.Random(3)
    pieces = ["<p>Words that make a sentence of some length, as here.</p>", "<li><a href=1>Home</a></li>", "<div>Short</div>", "<h2>Heading</h2>", "<aside><p>Some words beside the text.</p></aside>", "<div class=ad>Buy it.</div>", "</div>", "<div class=content>", "<p><a href=1>Linked words</a> and others</p>"]
    for _ in range(60):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert main_text(page) == brute_text(page)
