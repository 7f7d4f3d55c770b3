import time
import tracemalloc

import pytest

from quillspark.llm.sitestyle import MIN_PAGES, extract, host_of, main_text


def page(article, extra=""):
    return f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav>{article}{extra}<footer>&copy; x</footer></body></html>"


def test_article_only():
    text = main_text(page("<div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two</b>  three<p>Four &lt;five&gt;</article>", "<section id='comments'><p>me too</p></section>"))
    assert text == "A & B\n\nOne two three\n\nFour <five>"


def test_broken_markup():
    assert main_text("<p>a<p><b>b<br><p>c") == "a\n\nb\n\nc"
    assert main_text("x < y & z") == "x < y & z"
    assert main_text("<div title='a>b'>c</div><!-- d") == "c"
    assert main_text("") == ""
    assert main_text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\n\nb\n\nc\n\nd"
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_host():
    assert host_of("https://User@Www.X.org:80/a") == "www.x.org"
    assert host_of("//y.z/q") == "y.z"
    assert host_of(None) == host_of("nonsense") == ""


def test_repeated_branch_goes_copies_stay(spark):
    box = "<div class='x1'><p>Every page says this.</p></div>"
    rows = [(i, f"http://s.org/{i}", f"<body>{box}<div class='c'><p>Story {i} has its own words {i * 7}.</p></div></body>", "e") for i in range(MIN_PAGES + 4)]
    rows += [(100 + i, f"http://copies.org/{i}", "<body><div class='c'><p>One story everywhere.</p></div></body>", "e") for i in range(9)]
    rows += [(200, None, None, "e"), (201, "http://lone.org", f"<body>{box}</body>", "e"), (0, "http://s.org/0", rows[0][2], "e")]
    got = sorted((r.page_id, r.text) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    want = [(i, f"Story {i} has its own words {i * 7}.") for i in range(MIN_PAGES + 4)] + [(100 + i, "One story everywhere.") for i in range(9)]
    assert got == sorted([*want, want[0], (200, ""), (201, "Every page says this.")])


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_importance_like_brute_force(spark):
    """Entropies of child styles and of texts below, over the different pages of a host, by plain counting."""
    import math
    import random
    from collections import Counter, defaultdict

    from quillspark.llm import sitestyle
    from quillspark.llm.siteparse import parse

    rng = random.Random(2)
    pages = []
    for i in range(40):
        extra = "<ul><li>one</li><li>two</li></ul>" if i % 4 == 0 else ""
        pages.append((i, f"http://h{i % 2}.org/{i}", f"<body><div class='box'><p>notice {i % 3}</p></div><main><div id='n{i}'><p>text {rng.random()}</p>{extra}</div></main></body>"))
    pages.append((99, "http://h0.org/copy", pages[0][2]))  # a copy counts once
    seen = defaultdict(set)
    for _, url, text in pages:
        host, root = sitestyle.host_of(url), parse(text)

        def words(node):
            return " ".join(x if isinstance(x, str) else words(x) for x in node.items)

        stack = [(root, "")]
        while stack:
            node, above = stack.pop()
            path = f"{above}/{node.style}"
            if node.parent is not None and node.name != "main" and words(node).strip():
                seen[host, path].add((words(root), tuple(x.style for x in node.items if not isinstance(x, str)), words(node)))
            stack += [(x, path) for x in node.items if not isinstance(x, str) and not sitestyle.is_furniture(x)]

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n) if n > 1 else 1.0

    def named(path):
        name = 0
        for style in path[1:].split("/"):
            name = sitestyle.path_name(name, style)
        return name

    want = {}
    for (host, path), rows in seen.items():
        share = sitestyle.PRESENTATION
        want[sitestyle._hash(host), named(path)] = (len(rows), round(share * entropy([s for _, s, _ in rows]) + (1 - share) * entropy([c for *_, c in rows]), 9))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.host, r.node): (r.n_pages, round(r.importance, 9)) for r in sitestyle.importance(table).collect()}
    assert got == want and len(want) > 8


@pytest.mark.parametrize(("page", "count"), [("<article><p>" + "word <b>x</b> " * 100_000 + "</p></article>", 200_000), ("<article>" + "<span class='a'>t " * 50_000, 50_000), ("<div>" + "<div class='b'>t" * 20_000, 20_000)])
def test_pages_of_many_pieces_and_deep_pages_take_linear_time_and_memory(page, count):
    from quillspark.llm import sitestyle

    tracemalloc.start()
    began = time.time()
    text = sitestyle.main_text(page, frozenset([1]), frozenset([2]))
    rows = list(sitestyle.style_rows(iter([("http://h.org/", page)])))
    assert len(text.split()) == count and rows
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
