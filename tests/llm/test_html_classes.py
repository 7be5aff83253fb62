"""Equivalence classes of html_text: what they add to tag names and word lists."""

from routeloom.llm import html_text


def test_constant_slots_of_unmarked_templates_go(spark):
    page = "<html><body><div class='x1'><h1>Head {0}</h1><p>Text {0} of page</p><p>and {0} more words of it</p><h2>Our paper</h2><p>Printed since 1990 <b>every day</b></p><h3>By {0}</h3></div></body></html>"
    rows = [(i, f"https://h.org/{i}", page.replace("{0}", f"n{i}")) for i in range(6)]
    same = "<html><body><div class='x1'><h1>Same</h1><p>words on all pages</p></div></body></html>"
    rows += [(10 + i, f"https://same.org/{i}", same) for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head n{i}\n\nText n{i} of page\n\nand n{i} more words of it\n\nBy n{i}" for i in range(6))
    assert all(got[10 + i] == "Same\n\nwords on all pages" for i in range(4))  # the template is not all there is


def test_classes_that_are_out_of_order_or_interleaved_are_dropped(spark):
    pages = ["<i id=a>x</i><i id=b>y</i><u>t</u>", "<i id=b>x</i><i id=a>y</i><u>t</u>"] * 5
    rows = spark.createDataFrame([("h", str(i), p) for i, p in enumerate(pages)], "host string, key string, html string")
    candidates = spark.createDataFrame([("h", "i#a", "i#a", 10), ("h", "i#b", "i#a", 10), ("h", "u", "u", 10)], "host string, label string, class string, pages long")
    found = html_text.valid_classes(rows, candidates).collect()
    assert [(r.host, [tuple(x) for x in r.labels]) for r in found] == [("h", [("u", "u")])]
    rows = spark.createDataFrame([("h", str(i), "<i id=a></i><i id=b></i><i id=c></i><i id=d></i>") for i in range(5)], "host string, key string, html string")
    candidates = spark.createDataFrame([("h", "i#a", "p", 5), ("h", "i#c", "p", 5), ("h", "i#b", "q", 4), ("h", "i#d", "q", 4)], "host string, label string, class string, pages long")
    assert [x["label"] for r in html_text.valid_classes(rows, candidates).collect() for x in r.labels] == ["i#a", "i#c"]


def test_a_nested_class_returns_to_the_slot_around_it():
    classes = {"div": "div", "b": "b"}
    parts = list(html_text.pieces("<div>one<b>two</b>three</div>four"))
    slots = html_text.slot_of(html_text.tokens(parts, classes), classes)
    assert [(p[3], s) for p, s in zip(parts, slots) if p[0] == "text"] == [("one", "div"), ("two", "b"), ("three", "div"), ("four", "")]


def test_ends_that_are_implied():
    """Parts that are left out end with the next paragraph or item, or with what is around them, however deep the page is."""
    text = lambda page: html_text.main_text(page, "article").split("\n\n")
    assert text('<article><p class="notice">n<p>real text one<p>real two</article>') == ["real text one", "real two"]
    assert text('<article><ul><li class="ad">buy<li>one<li>two</ul><p>after</article>') == ["one", "two", "after"]
    assert text('<article><ul><li class="ad">buy</ul><p>after</article><p>outside') == ["after"]
    assert text("<article>" + "<i>" * 40 + "in</article>out") == ["in"]
    assert text("<article><div>a<nav>menu</div>b</article>") == ["a", "b"]  # closed by the element around it
    assert text("<article><table><tr><td>a<td>b<tr><th>c</table>d</article>") == ["a", "b", "c", "d"]
    assert text("</p></div><article><p>a</b>b</article>") == ["ab"]
    assert text("<article>" + "<p>x" * 20_000 + "</article>") == ["x"] * 20_000


def test_signs_of_tags_in_quotes_and_marks_in_sentences():
    text = lambda page: html_text.main_text(page, "article").split("\n\n")
    assert text('<article><a title="a > b">x</a> y <img alt=\'<p>\'>z</article>') == ["x y z"]
    assert text('<article><a title="open>x</a> y</article>') == ["x y"]
    assert text('<article><p>My ad was <span class="share">shared</span> text <select><option>1</select>here</article>') == ["My ad was shared text here"]
    assert text('<article><div class="related-work">kept</div><div class="related-posts">gone</div><div id="newsletter">gone</div><p class="ad">gone</article>') == ["kept"]


def test_clashing_columns_repeats_and_long_pages(spark):
    page = "<article><p>" + "word " * 100_000 + "</p></article>"
    rows = [(1, "https://h.org/1", page, "x", "y"), (1, "https://h.org/1", page, "x", "y"), (None, None, None, None, None), (2, "https://h.org/2", "", "x", "y")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string, labels string")
    got = html_text.extract(docs)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 0), (1, 499_999), (1, 499_999), (2, 0)]


def test_classes_equal_a_plain_grouping(spark):
    """Labels are one class where they occur equally often on each page, found here by comparing all pairs of labels."""
    import random

    r = random.Random(5)
    labels = [f"div#{c}" for c in "abcdefgh"]
    pages = [[x for x in labels for _ in range(1) if r.random() < (0.9 if x < "div#e" else 0.7)] for _ in range(12)]
    pages = [[*p, *(["div#b"] if "div#a" in p and "div#b" not in p else [])] for p in pages]
    pages = [[x for x in p if not (x == "div#b" and "div#a" not in p)] for p in pages]
    rows = [("h", str(i), "".join(f'<div id="{x[4:]}">t{i}</div>' for x in p)) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "host string, key string, html string")
    stats = df.mapInArrow(html_text._statistics, html_text._STATS).filter("host = 'h'").groupBy("label").agg({"pages": "sum", "vector": "bit_xor"}).collect()
    got = {}
    for x in stats:
        got.setdefault((x[1], x[2]) if isinstance(x[1], int) else x[1:], set()).add(x.label)
    vector = {x: tuple(p.count(x) for p in pages) for x in labels}
    want = [{y for y in labels if vector[y] == vector[x]} for x in labels if any(vector[x])]
    assert sorted(map(sorted, got.values())) == sorted(map(list, {tuple(sorted(w)) for w in want}))
