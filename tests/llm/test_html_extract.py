import html as H
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from tradeloom.llm.html_extract import _countable, blocks, contents, extract_main_text, parse


def text(page, templates=()):
    return "\n\n".join(blocks(parse(page), set(templates)))


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
    <nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><article><header><h1>Head &amp; line</h1></header><p><b>One<br><p>Two  three
    four&nbsp;&eacute;<div class="comments"><p>reader</p></div><aside>side</aside><ul><li>a<li>b</ul><form>f</form></article><section id="comments">x</section><footer>&copy;</footer>"""
    assert text(page) == "Head & line\n\nOne\n\nTwo three four é\n\na\n\nb"


def test_pages_without_article_and_odd_pages():
    assert text("<body><div>a</div>b<div role=navigation>c</div><p>d <i>e</i>f</body>") == "a\n\nb\n\nd ef"
    assert text(None) == text("") == text("<p>") == text("<script>x") == ""
    assert text("a < b &lt;c&gt; &#233;") == "a < b <c> é"
    assert text("<div>" * 5000 + "deep") == "deep"


def test_template_removal_counts_hosts(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><div><span>Follow</span> the site</div><p>Own text {i}.</p><p>Twice.</p></body>" if i != 3 else "<body><p>Twice.</p><p>Only here.</p></body>") for i in range(20)]
    rows += [(100 + i, f"http://other.example/{i}", "<body><div><span>Follow</span> the site</div><p>Small host.</p></body>") for i in range(4)]
    rows += [(200, None, None), (201, "no url", ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract_main_text(pages).collect()]
    assert len(got) == len(rows)
    by = {k: (t, n) for k, t, n in got}
    assert by[5] == ("Own text 5.", 11) and by[3] == ("Only here.", 10)  # "Twice." is in 20 of 20 pages
    assert by[101][0] == "Follow the site\n\nSmall host."
    assert by[200] == by[201] == ("", 0)
    assert extract_main_text(pages.limit(0)).count() == 0


def test_copies_of_one_article_are_no_template(spark):
    rows = [(i, "https://h.example/x", f"<nav>{i}</nav><article><p>The same article.</p></article>") for i in range(40)]
    assert {r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"The same article."}


def test_recurring_furniture_goes_however_large_the_host(spark):
    """A banner with four variants, one section's notice and a class on no list, each in less than 30 % of the pages."""

    def page(i):
        banner = f"<div><p>Banner {i // 2 % 4}.</p></div>" if i % 2 else f"<div><p>Lead {i}.</p></div><div><p>More {i}.</p></div>"
        strip = f'<div class="strip">Offer {i % 3}</div>' if i % 4 == 0 else ""
        notice = "<p>Notice of the section.</p>" if i % 5 == 0 else f"<p>Middle {i}.</p>"
        return f"<article><h1>Notes</h1>{strip if i % 8 else ''}{banner}<p>Text {i}.</p>{notice}<p>Rest {i}.</p><p>End {i}.</p>{'' if i % 8 else strip}</article>"

    rows = [(i, f"https://h.example/{'law' if i % 5 == 0 else 'all'}/{i}", page(i)) for i in range(400)]
    got = {r.page_id: r.text.split("\n\n") for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, blocks_ in got.items():
        assert not any(b.startswith("Offer") or b.startswith("Notice") for b in blocks_), (i, blocks_)
        assert f"Text {i}." in blocks_ and f"Rest {i}." in blocks_ and f"End {i}." in blocks_ and (i % 5 == 0 or f"Middle {i}." in blocks_)
        assert i % 2 or f"Lead {i}." in blocks_ and f"More {i}." in blocks_
        assert i % 2 == 0 or not any(b.startswith("Banner") for b in blocks_)


def test_named_elements_are_counted():
    assert len(_countable(contents(parse('<article><aside>side</aside><div class="ad">Buy</div><p>a</p></article>')))) == 3


def test_table_cells_and_headings_that_recur_stay(spark):
    rows = [(i, f"https://h.example/{i}", f"<article><h2>Part {i % 5}</h2><table><tr><td>{'Yes' if i % 4 else 'No'} {i % 4}</td><td>{i}</td></tr></table><p>Own {i}.</p></article>") for i in range(100)]
    for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r.page_id
        assert r.text.split("\n\n") == [f"Part {i % 5}", f"{'Yes' if i % 4 else 'No'} {i % 4}", str(i), f"Own {i}."]


def test_given_pages_against_a_plain_pattern(spark):
    """The pages of the given tables hold one article of h1 and p; a pattern can read these."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(x for x in want if x)


def test_classes_of_layout_and_inline_elements_lose_no_text():
    assert text('<div class="content no-sidebar"><p>Main text.</p></div>') == "Main text."
    assert text('<div class="has-sidebar"><article><p>Main text.</p></article></div>') == "Main text."
    assert text('<article><p>The market <span class="share">share</span> grew.</p><div><span class="share">Share</span> | <a class="share">Tweet</a></div></article>') == "The market share grew."
    assert text('<form><div class="related"><article><p>Main.</p><div class="comments"><p>A long comment of a reader, far longer than the text.</p></div></article></div></form>') == "Main."
    assert text('<body><div class="page-menu-layout"><p>All the text.</p></div><div class="menu">Menu</div></body>') == "All the text."
    assert text('<section id="comments"><article><p>By a reader.</p></article></section><div class="post"><p>Text of the page.</p></div>') == "Text of the page."


def test_markup_that_never_ends():
    assert text("<p>a<!-- x <b>y</b> z") == "a"
    assert text("<p>a<!-->b<!-- c --!>d<!--->e") == "abde"
    assert text("<p>a<div class='x") == text("<p>a</") == "a"
    assert text("<p>a < b") == "a < b"
    began = time.time()
    assert text("<p>" + "<i>" * 100_000 + "x" + "</b>" * 100_000) == "x"
    assert text("<article>" + "<span>" * 50_000 + "<div>x</div>" * 50_000) == "\n\n".join("x" * 50_000)
    assert time.time() - began < 30


def random_pages(n, seed=2):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    shared = ["<span>Follow us</span>", "<p>Notice of the site</p>", '<div class="strip"><b>Offer</b> now</div>', "<div><a>One</a> | <a>Two</a></div>", "<ul><li>Home</li><li>About</li></ul>", "<p>Law <em>section</em></p>"]
    out = []
    for i in range(n):
        parts = [f"<p>{' '.join(rng.choices(words, k=9))} <em>{rng.choice(words)}</em> {i if rng.random() < 0.9 else ''}</p>" for _ in range(rng.randint(1, 4))]
        for k, x in enumerate(shared):
            if rng.random() < (0.9, 0.4, 0.2, 0.35, 0.1, 0.05)[k]:
                parts.insert(rng.choice([0, len(parts), rng.randint(0, len(parts))]), x)
        host = rng.choice(["a.example"] * 6 + ["b.example"] * 3 + ["c.example"])
        out.append((i, f"https://{host}/{rng.choice(['law', 'all', 'new'])}/{i}", f"<body><article>{''.join(parts)}</article></body>"))
    return out + [(n + i, out[i][1], out[i][2]) for i in range(30)]  # copies


def brute(pages, min_pages=10, min_share=0.3, place_share=0.5):
    """The decision on each subtree by plain counting over all pages."""
    of, sections, sizes = defaultdict(lambda: defaultdict(set)), defaultdict(set), defaultdict(set)
    slot, section_of, own = {}, defaultdict(set), {}
    for i, url, html in pages:
        root = parse(html)
        host, section = url.split("/")[2], url.split("/")[3]
        main = tuple(x.hash for x in contents(root))
        own[i] = host
        sizes[host].add(main)
        sections[host, section].add(main)
        for node, place in _countable(contents(root)).items():
            of[host][node].add(main)
            slot[host, node] = min(place, slot.get((host, node), place))
            section_of[host, node].add(section)
    gone = defaultdict(set)
    for host, nodes in of.items():
        everything, recurring = Counter(), Counter()
        for node, mains in nodes.items():
            everything[slot[host, node]] += len(mains)
            recurring[slot[host, node]] += len(mains) * (len(mains) >= min_pages)
        for node, mains in nodes.items():
            n, place = len(mains), slot[host, node]
            only = section_of[host, node]
            within = len(sections[host, next(iter(only))]) if len(only) == 1 else None
            if n >= min_pages and (n >= min_share * len(sizes[host]) or within and n >= min_share * within or place > 2 and recurring[place] >= place_share * everything[place]):
                gone[host].add(node)
    return {i: "\n\n".join(blocks(parse(html), gone[own[i]])) for i, _, html in pages}


@pytest.mark.parametrize("broadcast_nodes", [1 << 20, 0])
def test_template_removal_matches_plain_counting(spark, broadcast_nodes):
    pages = random_pages(400)
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), broadcast_nodes=broadcast_nodes).collect()}
    assert got == brute(pages)
    kept = "\n".join(got.values())
    assert "Follow us" not in kept and "Notice of the site" not in kept and "One | Two" not in kept
