import html
import re
from functools import lru_cache

from frames import SF, texts

from tabulens.llm.html import aligned, main_text, main_texts, matched, parse
from tabulens.llm.queries import op8_main_texts


def test_query_against_brute_force(spark):
    """The test pages mark their article: its blocks are cut out by pattern."""
    found = {r.page_id: r for r in op8_main_texts(spark, SF).collect()}
    for key, url, source in texts("pages", "page_id, url, html"):
        article = re.search(r"<article>(.*)</article>", source, re.DOTALL).group(1).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        text = "\n".join(b for b in blocks if b)
        r = found.pop(key)
        assert (r.url, r.text, r.n_chars) == (url, text, len(text))
    assert not found


def test_parts_that_are_not_the_main_text():
    page = """<html><head><title>t</title></head><body class="ad-free"><header><h1>Site</h1></header>
    <div id=cookie-notice>cookies</div><main><header><h1>T</h1></header><p>A &lt;b&gt; &nbsp; x<p>B
    <ul><li>one<li>two</ul><form><p>no</form><section class="comments"><p>c</p></section>
    <table><tr><td>1<td>2<tr><td>3</table><div class="advert">ad</div><script>var t="</p>";</script>tail</main>
    <aside>s</aside><footer>f</footer>"""
    assert main_text(parse(page), None, set(), set()) == "T\nA <b> x\nB\none\ntwo\n1\n2\n3\ntail"


def test_markup_as_browsers_take_it():
    page = "<p>a<br>b<div>c <span>d</span></div> 1 < 2 <a title='x>y'>l</a> &copy; <b>z <p>q</b> w <foo"
    assert main_text(parse(page), None, set(), set()) == "a b\nc d\n1 < 2 l © z\nq w"
    assert main_text(parse("<!-- <p>x</p> --><p hidden>h</p><p style='display: none'>n</p>&amp;amp;"), None, set(), set()) == "&amp;"


def test_deep_nesting_and_long_pages():
    deep = parse("<div>" * 20_000 + "x" + "</div>" * 20_000 + "<p>y")
    assert main_text(deep, None, set(), set()) == "x\ny"
    assert len(aligned(deep.skeleton(), deep.skeleton())) == len(deep.nodes)
    long = parse("<article>" + "<p>one</p><ul><li>two</ul>" * 20_000)
    assert main_text(long, None, set(), set()).count("\n") == 39_999
    aside = parse("<section>" * 300 + "<div class=ad>" * 300 + "no" + "</div>" * 300 + "yes")
    assert main_text(aside, None, set(), set()) == "yes"


def nested(key, *children):
    return [key, 0, 0, 0, 0, list(children)]


def test_matching_against_all_alignments():
    def numbered(tree, k=0):
        tree[1] = k
        for child in tree[5]:
            k = numbered(child, k + 1)
        return k

    a = nested("r", nested("x"), nested("y", nested("p"), nested("q")), nested("x"), nested("z"))
    b = nested("r", nested("y", nested("q")), nested("w"), nested("x"), nested("y", nested("p")), nested("z"))
    numbered(a), numbered(b)

    def best(one, two):
        if one[0] != two[0]:
            return 0

        @lru_cache
        def at(i, j):
            if i == len(one[5]) or j == len(two[5]):
                return 0
            return max(at(i + 1, j), at(i, j + 1), best(one[5][i], two[5][j]) + at(i + 1, j + 1))

        return 1 + at(0, 0)

    n, pairs = matched(a, b)
    assert n == best(a, b) == len(pairs) == len(set(pairs))


SHELL = "<html><body><div class=top>Welcome to the site</div><div class=x><a href=/>Home</a> <a href=/b>Other things</a></div><div class=body><p>{}</p><p>{}</p></div><div class=end>All rights</div></body></html>"


def test_template_of_a_host_without_marked_articles(spark):
    rows = [(k, f"http://h.example/{k}", SHELL.format(f"first text {k}", f"second text {k}")) for k in range(6)]
    rows += [(10, "http://lone.example/", "<div>only page</div>"), (11, None, None), (12, "no address", ""), (13, "http://h.example/z", rows[0][2])]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, id int")
    found = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert found == {
        **{k: f"first text {k}\nsecond text {k}" for k in range(6)},
        10: "only page", 11: "", 12: "", 13: "first text 0\nsecond text 0",
    }
    assert main_texts(pages.limit(0)).count() == 0


def extracted(spark, sources):
    rows = [(k, f"http://h.example/{k}", source) for k, source in enumerate(sources)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in main_texts(pages).orderBy("page_id").collect()]


def test_template_of_every_layout_and_an_odd_first_page(spark):
    one = "<div class=one><div>Rubric {}</div><p>text {}</p><div class=end>All rights 2024</div></div>"
    two = "<section class=two><div>Other notice</div><p>text {}</p><h4>Other end</h4></section>"
    sources = [one.format("A", 0).replace("2024", "1999"), *(one.format("A", k) for k in range(1, 8)), *(two.format(k) for k in range(8, 14))]
    assert extracted(spark, sources) == ["text 0\nAll rights 1999", *(f"text {k}" for k in range(1, 14))]


def test_blocks_of_a_run_are_judged_one_by_one(spark):
    links = "".join(f"<a href=/{k}>a long link to another page {k}</a> " for k in range(9))
    pages = [f"<div><p>notice of the site</p><p>text {k}</p><p>more {k}</p><p>{links}</p></div>" for k in range(5)]
    assert extracted(spark, pages) == [f"text {k}\nmore {k}" for k in range(5)]
    assert main_text(parse(pages[0]), None, set(), set()) == "notice of the site\ntext 0\nmore 0"


def test_template_inside_marked_articles_and_without_the_marks(spark):
    page = "<div class=top>Site</div><article class=post><p>Share this text</p><p>text {}</p><div>Standing notice</div></article>"
    pages = [page.format(k) for k in range(5)]
    assert extracted(spark, pages) == [f"text {k}" for k in range(5)]
    assert extracted(spark, [p.replace("article", "div") for p in pages]) == [f"text {k}" for k in range(5)]


def test_names_that_only_hold_a_word_of_an_aside():
    page = """<main><section id="related-work"><h2 id="search-algorithms">Search</h2><p>a</section>
    <div id="form-and-function"><p>b</div><div id="search"><p>c</div><div class="social-history"><p>d</div>
    <figure><pre>code</pre><figcaption>caption</figcaption></figure><div class="post share">no</div></main>"""
    said = "Search\na\nb\nc\nd\ncode\ncaption"
    assert main_text(parse(page), None, set(), set()) == said
    bare = page.replace("<main>", "").replace("</main>", "").replace(' id="search"', "")
    bare += "<div id=cookie-notice>no</div><ul class='nav-menu'><li>no</ul><h2 id=comments>Comments</h2>"
    assert main_text(parse(bare), None, set(), set()) == said + "\nComments"


def test_near_copies_keep_their_articles(spark):
    same = "".join(f"<p>paragraph {w} of a text that several pages share</p>" for w in "abcdef")
    page = "<div>Site</div><article><h1>Heading</h1>" + same + "<p>edit {}</p></article>"
    told = "Heading\n" + "\n".join(re.findall("<p>(.*?)</p>", same))
    assert extracted(spark, [page.format(k) for k in range(3)]) == [f"{told}\nedit {k}" for k in range(3)]


def test_layouts_are_aligned_with_the_most_frequent(spark):
    """A banner before the second box shifts it; matching still finds the standing text of that box."""
    plain = "<div>first {}</div><p>middle {}</p><div>standing</div><ul><li>end {}</ul>"
    more = "<h3>extra {}</h3><div>first {}</div><p>middle {}</p><div>standing</div>"
    pages = [plain.format(k, k, k) for k in range(4)] + [more.format(k, k, k) for k in range(4, 6)]
    assert extracted(spark, pages) == [
        *(f"first {k}\nmiddle {k}\nend {k}" for k in range(4)),
        *(f"extra {k}\nfirst {k}\nmiddle {k}" for k in (4, 5)),
    ]


def test_names_come_from_matched_nodes():
    one, other = parse("<div>a</div><p>b</p><div>c</div>").skeleton(), parse("<p>b</p><div>c</div>").skeleton()
    full, part = aligned(one, one), aligned(other, one)
    assert len(set(full)) == 4
    # The only box of the shorter page matches the one after the paragraph.
    assert part == [full[0], full[2], full[3]]


def test_a_form_around_the_whole_page(spark):
    page = "<form><div class=menu>Menu</div><h1>Title {0}</h1><p>long text of page {0}</p><form><p>x</p></form></form>"
    assert extracted(spark, [page.format("a")]) == ["Title a\nlong text of page a\nx"]
    assert extracted(spark, ["<p>some longer text</p><form><p>your name</p></form>"]) == ["some longer text"]
    assert extracted(spark, ["<form><label>user</label><div>password</div></form>"]) == [""]
