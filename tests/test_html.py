"""Page parsing: golden Markdown fragments, images, cards, JSON-LD order and links."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetrove import htmltree, jsonld
from pagetrove.functions import html as H
from pagetrove.functions import markdown as M
from pagetrove.operators import pages, recipes

CASES = {
    "heading_unwrap": ("<h2><strong>For the <em>base</em></strong></h2>", ["## For the base"], ["**"]),
    "space_kept": ("<p><strong>Mix.</strong> Then rest</p>", ["**Mix.** Then rest"], []),
    "space_inserted": ("<p><strong>Mix.</strong>Then rest</p>", ["**Mix.** Then rest"], []),
    "bold_link": ('<p><a href="/x"><b>Go</b></a></p>', ["[**Go**](/x)"], []),
    "two_bold_links": ('<p><b><a href="/a">A</a></b><b><a href="/b">B</a></b></p>', ["**[A](/a)**", "**[B](/b)**"], []),
    "nested_strong": ("<p><strong><strong>Once</strong></strong></p>", ["**Once**"], ["****"]),
    "em_around_strong": ("<p><em><strong>Lead</strong> tail</em></p>", ["**Lead** tail"], ["***"]),
    "accordion": ('<div><button><span class="toggle-title">Can I freeze it? +</span></button><p>Yes.</p></div>',
                  ["### Can I freeze it?", "Yes."], ["+"]),
    "summary": ("<details><summary>More ▼</summary><p>Text</p></details>", ["### More", "Text"], ["▼"]),
    "lazy_image": ('<img src="data:x" data-lazy-src="https://i/a.jpg" alt="A  b">', ["![A b](https://i/a.jpg)"], []),
    "srcset": ('<img srcset="https://i/s.jpg 1x, https://i/l.jpg 2x">', ["![](https://i/s.jpg)"], ["l.jpg"]),
    "card_stripped": ('<p>Story</p><div class="wprm-recipe-container"><p>Card</p></div>', ["Story"], ["Card"]),
    "lists": ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>x<li>y</ol>", ["- a\n  - b\n- c", "1. x\n2. y"], []),
    "quote": ("<blockquote><p>a</p><p>b</p></blockquote>", ["> a\n>\n> b"], []),
    "pre": ("<pre>if x:\n  y</pre>", ["```\nif x:\n  y\n```"], []),
    "table": ("<table><tr><th>a<th>b<tr><td>1|2</table>", ["| a | b |\n| --- | --- |\n| 1\\|2 |  |"], []),
    "one_row_table": ("<table><tr><td>a</table>", [], ["|"]),
    "junk": ('<div class="share-bar">Share</div><script>x()</script><p>Text</p>', ["Text"], ["Share", "x()"]),
    "unclosed": ("<p><b>One<p>Two", ["Two"], []),
    "figcaption": ("<figure><figcaption>Seen</figcaption></figure>", ["*Seen*"], []),
    "repeated_heading": ("<h1>T</h1><h1>T</h1><p>x</p>", ["# T\n\nx"], ["# T\n\n# T"]),
}


def test_markdown_cases(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "page_id string, html string").withColumn("url", F.lit("u"))
    out = {r.page_id: r.md for r in pages.clipped(df).select("page_id", M.join_blocks(F.col("clip.blocks")).alias("md")).collect()}
    for name, (_, must, must_not) in CASES.items():
        for m in must:
            assert m in out[name], (name, out[name])
        for m in must_not:
            assert m not in out[name], (name, out[name])


def test_card_kept_on_request():
    html = '<div class="tasty-recipes"><p>Card</p></div>'
    assert htmltree.blocks(htmltree.parse(html), drop_cards=True) == []
    assert htmltree.blocks(htmltree.parse(html), drop_cards=False)[0]["text"] == "Card"


@pytest.mark.parametrize("bad", ["", "<", "<<<>>>", "</p></div>", "<p", "&#xZZ;", "<!-- never closed", "plain"])
def test_garbage_never_raises(bad):
    htmltree.blocks(htmltree.parse(bad))


def test_deep_nesting_keeps_the_text():
    html = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert any("deep" in b["text"] for b in htmltree.blocks(htmltree.parse(html)))


def test_capture_mode_takes_last_srcset_and_noscript():
    def sources(html, mode):
        return [i["src"] for i in htmltree.images(htmltree.parse(html), mode)]
    srcset = '<img src="data:x" srcset="https://i/s.jpg 1x, https://i/l.jpg 2x">'
    assert sources(srcset, "capture") == ["https://i/l.jpg"] and sources(srcset, "render") == ["https://i/s.jpg"]
    hidden = '<p><img data-lazy=1><noscript><img src="https://i/n.jpg"></noscript></p>'
    assert sources(hidden, "capture") == ["https://i/n.jpg"] and sources(hidden, "render") == []
    assert sources('<img src="https://i/a.jpg" data-src="https://i/b.jpg">', "capture") == ["https://i/a.jpg"]


def test_last_recipe_of_an_array_wins():
    block = '[{"@type":"Recipe","name":"one","recipeIngredient":["a"]},{"@type":"Recipe","name":"two","recipeIngredient":["b"]}]'
    assert jsonld.recipe([block])["name"] == "two"


def test_broken_json_blocks_are_skipped():
    assert jsonld.recipe(["{not json", '{"@type":"Recipe","recipeInstructions":"a\\nb"}'])["instructions"] == ["a", "b"]


def test_recipe_graph_and_card(spark):
    ld = ('<script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":"Recipe","name":"Pie &amp; Mash",'
          '"recipeYield":["4","4 servings"],"prepTime":"PT15M","cookTime":"PT1H30M","recipeIngredient":["1 egg"],'
          '"recipeInstructions":[{"@type":"HowToSection","name":"A","itemListElement":[{"@type":"HowToStep","text":"Do <b>it</b>"}]}],'
          '"nutrition":{"calories":"240 calories","proteinContent":"9 grams","sodiumContent":"480"}}]}</script>')
    card = ('<div class="wprm-recipe-ingredient-group"><h4 class="wprm-recipe-ingredient-group-name">Dough:</h4>'
            '<ul><li class="wprm-recipe-ingredient"><span class="wprm-recipe-ingredient-amount">1</span>'
            '<span class="wprm-recipe-ingredient-name">egg</span></li></ul></div>')
    df = spark.createDataFrame([(1, "u", ld), (2, "u", ld + card), (3, "u", "<p>none</p>")], "page_id int, url string, html string")
    df = df.withColumn("clip", pages.clip_column()(F.col("html")))
    got = {r.page_id: r for r in recipes.extract_recipes(df, "clip").collect()}
    assert set(got) == {1, 2}
    r = got[1]
    assert (r.name, r["yield"], r.time_str) == ("Pie & Mash", "4 servings", "Prep: 15 min · Cook: 1 hr 30 min")
    assert r.instructions == ["Do it"] and r.nutrition == {"calories": "240 kcal", "protein": "9 g", "sodium": "480 mg"}
    assert got[2].ingredient_groups[0].name == "Dough" and got[2].ingredients == ["1 egg"]


def test_links_resolve_skip_and_deduplicate(spark):
    html = ('<a href="#a">x</a><a href="mailto:a@b">m</a><a href="../b?x=1&amp;y=2"> <b>B</b> </a>'
            '<a href="https://l.instagram.com/?u=https%3A%2F%2Fsite.example%2Fr">w</a><a href="/b?x=1&amp;y=2">again</a>')
    df = spark.createDataFrame([(1, "https://h.example/d/p", html)], "page_id int, url string, html string")
    got = [(r.url, r.anchor) for r in pages.links(df).orderBy("pos").collect()]
    assert got == [("https://h.example/b?x=1&y=2", "B"), ("https://site.example/r", "w")]


def test_url_join_follows_the_standard(spark):
    from urllib.parse import urljoin
    base = "http://a/b/c/d;p?q"
    refs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ";x", "", ".", "./", "..", "../", "../g", "../..",
            "../../g", "../../../g", "/./g", "/../g", "g.", "./../g", "g/./h", "g/../h", "https://x/y"]
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    got = {r.ref: r.u for r in df.select("ref", H.url_join(F.lit(base), F.col("ref")).alias("u")).collect()}
    assert {k: v for k, v in got.items() if v != urljoin(base, k)} == {}


def test_batches_of_pages_and_texts_are_passed_on_in_pieces():
    got = list(pages.clip_column().func(iter([pa.array(["<p>x</p>", None] * 300), pa.array(["<h1>y</h1>"])])))
    assert [len(g) for g in got] == [pages.PAGES, pages.PAGES, 600 - 2 * pages.PAGES, 1]
    assert got[0][0].as_py()["blocks"] == [{"kind": "para", "level": 0, "text": "x", "main": False}] and got[0][1].as_py()["blocks"] == []
    texts = list(H._unescape.func(iter([pa.array(["a &amp; b", None] * H.TEXTS)])))
    assert [len(t) for t in texts] == [H.TEXTS, H.TEXTS] and texts[1][:2].to_pylist() == ["a & b", None]


def test_elements_below_one_lie_together():
    root = htmltree.parse("<div><p>a<b>b</b></p><script>s</script></div><ul><li>c<li class='k l'>d</ul>")
    assert [n.tag for n in root.walk()] == ["#root", "div", "p", "b", "script", "ul", "li", "li"]
    assert [[n.tag for n in k.walk()] for k in root.kids] == [["div", "p", "b", "script"], ["ul", "li", "li"]]
    assert root.text() == "abcd" and [n.text() for n in root.by_class("k")] == ["d"]
