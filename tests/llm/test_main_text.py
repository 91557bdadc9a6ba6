import random
import re

import numpy as np

from quarterdeck.llm.main_text import Forest, extract_main_text, labelled_pages, parse, trained
from tests.llm.helpers import with_clashes

SHAPE = "page_id long, url string, html string"
PAGES = [
    ("<html><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First \n  words.<p>Second &lt;one&gt;"
     "</article><footer>&copy; x</footer></body></html>", "A & B\n\nFirst words.\n\nSecond <one>"),
    ("<div class=ad>Buy this now.</div><article><h1>T</h1><p><b>Bold words here.<br><p>More of it.</p><script>var a='<p>no</p>';</script>"
     "</article><aside class=sidebar><p>Other things to read.</p></aside>", "T\n\nBold words here.\n\nMore of it."),
    ("<body><header class=site-header><h1>Site</h1></header><div class='cookie-notice'><p>We use cookies, please agree.</p></div><main><h1>Title"
     "</h1><p>The text of the article.</p></main><section id=comments><p>A reader says so.</p></section>"
     "<form class=search><label>Search</label><input></form>", "Title\n\nThe text of the article."),
    ("", ""), (None, ""), ("<nav><a href=x>only menu</a></nav>", ""),
    ("<article><h1>Cut</h1><p>It ends in a tag <b", "Cut\n\nIt ends in a tag"),
]


def test_known_pages(spark):
    rows = [(i, f"http://x/{i}", p) for i, (p, _) in enumerate(PAGES)] + [(0, "http://x/0", PAGES[0][0]), (None, None, PAGES[0][0])]
    found = extract_main_text(with_clashes(spark.createDataFrame(rows, SHAPE))).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = PAGES[r["page_id"] or 0][1]
        assert (r["text"], r["n_chars"]) == (expected, len(expected))
    assert extract_main_text(spark.createDataFrame([], SHAPE)).count() == 0


def test_unseen_pages_of_the_grammar():
    model, right, words, kept = trained(), 0, 0, 0
    pages = labelled_pages(150, seed=900)
    for page in pages:
        tree = parse(page)
        want = [t for t, y in zip(tree.text, tree.label) if t is not None and y]
        got = [t for t in model.main_texts([re.sub(r' data-main="\w+"', "", page)])[0].split("\n\n") if t]
        right += got == want
        words += len(want)
        kept += len(set(got) & set(want))
    assert right >= 0.9 * len(pages) and kept >= 0.98 * words


def test_messages_equal_enumeration():
    """Marginals of small trees against sums over all labellings."""
    draw = np.random.default_rng(1)
    model = trained()
    for seed in range(4):
        tree = parse(random.Random(seed).choice(["<div><p>a b.</p><p>c</p></div><nav>x</nav>", "<p>a<p>b<ul><li>c<li>d</ul>", "a<div>b<div>c</div>d</div>"]))
        weights, edges = draw.standard_normal(len(model.names)), draw.standard_normal((2, 2, 2))
        forest = Forest([tree], model.names)
        p, _ = forest.marginals(weights, edges)
        n, total, ones = len(tree.parent), 0.0, np.zeros(len(tree.parent))
        own = np.bincount(forest.row, weights=weights[forest.column], minlength=n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            score = sum(own[i] * y[i] for i in range(n))
            score += sum(edges[int(forest.leaf[i]), y[q], y[i]] for i, q in enumerate(forest.parent) if q >= 0)
            total += np.exp(score)
            ones += np.exp(score) * np.array(y)
        assert np.allclose(p, ones / total)


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>Text deep down.</p>"
    long = "<article>" + "<p>Words of a block.</p>" * 5000 + "</article>"
    _, text = trained().main_texts([deep, long])
    assert text.count("\n\n") == 4999


def test_nothing_of_an_article_is_lost():
    from quarterdeck.llm.main_text import parse

    def texts(source):
        return [t for t in parse(source).text if t is not None]

    assert texts("<p>Euler: <math><mi>e</mi></math> is big.</p>") == ["Euler: e is big."]
    assert texts("<p>A <object data=x>fallback text</object> here</p><noscript><p>Kept.</p></noscript>") == ["A fallback text here", "Kept."]
    assert texts("<p>One <svg><path d='M0'>two</p><p>Three</p>") == ["One two", "Three"]
    assert texts("<p title=it's>One</p><p>Two</p><p class=\"a\"\">isn't</p>") == ["One", "Two", "isn't"]
    assert texts("<p title='a > b'>One</p><script>x</script><title>t</title><p>Two") == ["One", "Two"]
    assert texts("<p a=\"b\" c='d' e=\"f") == []


def test_closing_tags_without_a_partner_take_linear_time():
    import time

    from quarterdeck.llm.main_text import parse

    def seconds(n):
        started = time.perf_counter()
        parse("<div>" * n + "</section>" * n + "<p>x</p>" + "<p a=\"b\" " * n)
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(20_000) < 5.0
