"""Page text: small pages with known text, and the cut against all labellings."""

import random
from itertools import product

from swathkit.llm import html_text as H
from tests.llm.conftest import rows_of

PARAGRAPH = "This is a sentence of the article that goes on for quite a while, with commas, and ends in a full stop."
PAGE = f"""<!DOCTYPE html><html><head><title>A title</title><style>p {{color: red}}</style><script>var x = "<p>no</p>";</script></head>
<body><header><a href="/">Home</a><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav></header>
<!-- a comment <p>no</p> --><div class="cookie-notice">We use cookies. <button>OK</button></div>
<article><h1>The &amp; heading</h1><p>{PARAGRAPH}
   It has a <b>bold</b>&nbsp;word &#233; &eacute; and a <a href="x">link</a>.</p><div class="advert">Buy now! Only today!</div><p>{PARAGRAPH}</p>
<ul><li>First point of the list</li><li>Second point</li></ul></article>
<aside class="sidebar"><h3>Most read</h3><p>Another story that many people have read this week.</p></aside>
<section id="comments"><h2>Comments</h2><p>{PARAGRAPH} I do not agree.</p><form><label>Name</label><input name="q"></form></section>
<footer><p>Copyright 2024 Example. All rights reserved.</p></footer></body></html>"""


def test_a_page():
    assert H.main_text(PAGE) == f"The & heading {PARAGRAPH} It has a bold word é é and a link. {PARAGRAPH} First point of the list Second point"


def test_defined_results(spark):
    assert H.main_text(None) == H.main_text("") == H.main_text("   ") == ""
    assert H.main_text("just  some\ntext &lt;b&gt; 1 < 2") == "just some text <b> 1 < 2"
    assert H.main_text("<article><p>" + PARAGRAPH + "<p>" + PARAGRAPH) == f"{PARAGRAPH} {PARAGRAPH}"
    assert H.main_text("<p>" + PARAGRAPH + "<!-- open <p>no</p>") == PARAGRAPH
    assert H.main_text("<p>" + PARAGRAPH + "<script>open <p>no</p>") == PARAGRAPH
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, ""), (3, "v", "<p>" * 3000 + PARAGRAPH), (4, "w", f"<main><p>{PARAGRAPH}</p></main>"), (5, "l", "<article>" + f"<p>{PARAGRAPH}</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame([(a, b, str(c) if c is not None else None) for a, b, c in rows], "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as n_chars")
    got = rows_of(H.extract(pages), "page_id", "url", "text", "n_chars")
    assert len(got) == len(rows) and got == sorted(((a, b, H.main_text(c), len(H.main_text(c))) for a, b, c in rows), key=repr)
    assert next(r for r in got if r[0] == 5)[2] == " ".join([PARAGRAPH] * 3000)
    assert H.extract(pages.filter("false")).count() == 0


def test_query_covers_every_page(spark, sf_dir):
    got = H.op2_html_text(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(pages) and all(r.text == H.main_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)
    assert sum(bool(r.text) for r in got) > 0.9 * len(got)


def test_cut_is_minimal():
    r = random.Random(4)
    for _ in range(150):
        n = r.randint(1, 8)
        scores = [r.randint(-300, 300) / 100 for _ in range(n)]
        edges = [(a, b, r.randint(0, 200) / 100, r.randint(0, 200) / 100) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 12))) if a != b]
        cost = lambda keep: sum(abs(s) for s, k in zip(scores, keep, strict=True) if (s > 0) != k and s) + sum(x if keep[a] else y for a, b, x, y in edges if keep[a] != keep[b])  # noqa: B023, E731
        assert abs(cost(H.min_cut(scores, edges)) - min(cost(k) for k in product((False, True), repeat=n))) < 1e-6


WRAPPERS = ["page", "wrap", "outer", "container", "row", "primary", "column"]


def wrapped(inside: str, levels: int) -> str:
    return "".join(f'<div id="{x}">' for x in WRAPPERS[:levels]) + inside + "</div>" * levels


def test_names_count_at_any_depth():
    article = f'<div class="entry"><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>'
    for name in ("comments", "related", "share", "advert", "sidebar", "cookie-notice"):
        for levels in range(8):
            page = wrapped(f'{article}<div class="{name}"><p>Some more words. {PARAGRAPH}</p></div>', levels)
            assert H.main_text(page) == f"{PARAGRAPH} {PARAGRAPH}", (name, levels)
    for name in ("comments", "entry"):  # bad and good names weigh the same below seven named wrappers as below none
        shallow, deep = (H.blocks_of(wrapped(f'<div class="{name}"><p>{PARAGRAPH}</p></div>', levels))[0].element for levels in (0, 7))
        plain = H.blocks_of(f"<div><p>{PARAGRAPH}</p></div>")[0].element
        assert (deep.base, deep.good) == (shallow.base, shallow.good) != (plain.base, plain.good)
    many = wrapped('<div class="row">' * 500 + f'<div class="sidebar"><p>{PARAGRAPH}</p></div>' + "</div>" * 500, 7)
    assert H.main_text(article + many) == f"{PARAGRAPH} {PARAGRAPH}"


WORDS = "river stone market window garden letter winter summer engine paper silver morning village teacher doctor travel music".split()


def planted(r: random.Random) -> list[tuple[str, bool]]:
    """A page as (markup, is content) pieces; markup without text goes with either. Places are marked by tags, by names, or not at all."""
    words = lambda n: " ".join(r.choice(WORDS) for _ in range(n)).capitalize()
    sentences = lambda n: " ".join(words(r.randint(6, 16)) + "." for _ in range(n))
    links = lambda n: [(f'<li><a href="/x">{words(r.randint(1, 3))}</a></li>', False) for _ in range(n)]
    around = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="entry-content">', "</div>"), ("<div>", "</div>"), ('<div class="c12">', "</div>")])
    top = r.choice([("<nav>", "</nav>"), ("<div class=menu>", "</div>"), ("<ul>", "</ul>")])
    out = [(top[0], False), *links(r.randint(3, 9)), (top[1], False), (around[0], True), (f"<h1>{words(5)}</h1>", True)]
    for _ in range(r.randint(3, 9)):
        out.append((f"<p>{r.choice([sentences(r.randint(2, 5)), sentences(3), words(r.randint(1, 3))])}</p>", True))
        if r.random() < 0.15:
            out.append((f'<div class="{r.choice(["advert", "share", "related-links", "newsletter"])}"><p>{sentences(2)}</p></div>', False))
    out.append((around[1], True))
    if r.random() < 0.7:
        out += [('<section id="comments">', False), *[(f"<p>{sentences(r.randint(1, 4))}</p>", False) for _ in range(r.randint(1, 8))], ("</section>", False)]
    return [*out, ('<footer class="site-footer">', False), (f"<p>{sentences(1)}</p>", False), ("</footer>", False)]


def test_cut_against_planted_pages():
    """Blocks of 300 made-up pages whose labels are known: the cut is right, and right where the classifier alone is not."""
    r = random.Random(12)
    right = alone = moved = n = 0
    for _ in range(300):
        pieces = planted(r)
        blocks = H.blocks_of("<html><body>" + "".join(x for x, _ in pieces) + "</body></html>")
        truth = [(H.blocks_of(x)[0].text, y) for x, y in pieces if H.blocks_of(x)]
        assert [b.text for b in blocks] == [t for t, _ in truth]
        for b, keep, (_, y) in zip(blocks, H.content_blocks(blocks), truth, strict=True):
            own = H.log_odds(b) > 0
            n, right, alone, moved = n + 1, right + (keep == y), alone + (own == y), moved + (keep != own)
    print(f"blocks {n}, right by the cut {right / n:.4f}, by the classifier alone {alone / n:.4f}, moved by the cut {moved / n:.4f}")
    assert right / n > 0.97 and alone / n < 0.85 and moved / n > 0.1


def test_costs_are_fitted(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("html is not null").orderBy("page_id").limit(500).collect()
    assert max(abs(a - b) for a, b in zip(H.fit_costs([p.html for p in pages]), H.COSTS, strict=True)) < 0.1
