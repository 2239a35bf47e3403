"""Element trees, report texts, diffs and stems on hand-made cases."""

import random
import time
from difflib import ndiff

import pytest
from pyspark.sql import functions as F

from lexmill.functions import helpers, markup
from lexmill.functions.stemmer import stem
from lexmill.operators import changes, html, search


def _texts(page):
    return [(s["title"], s["text"].split("\n"), s["anchors"]) for s in markup.sections_of(page)]


def test_unclosed_paragraphs_and_items_are_siblings():
    assert _texts("<p>one<p>two<b> bold</b><div>x</div><p>three") == [("(intro)", ["one", "two bold", "three"], [])]
    assert _texts("<ul><li>a<li>b<li>c</ul>") == [("(intro)", ["a", "b", "c"], [])]
    assert _texts("<h2 id=t>T</h2><table><tr><td><p>a<td><p>b<tr><td>c</table>") == [("T", ["a", "b"], ["t"])]


def test_nested_lists_hold_their_items():
    page = "<ul><li>a<ul><li>b</li><li>c<ol><li>d</ol></ul></li><li>e</ul>"
    assert _texts(page) == [("(intro)", ["a b c d", "b", "c d", "d", "e"], [])]
    assert _texts("<ul><li>a<ul><li>b<li>c</ul><li>e</ul>") == [("(intro)", ["a b c", "b", "c", "e"], [])]


def test_a_parents_end_closes_its_children():
    assert _texts("<div><p>one</div>outside<p>two") == [("(intro)", ["one", "two"], [])]
    assert _texts("<section><h1>A<p>one</section><p>two</p>")[-1] == ("A one", ["one", "two"], [])
    assert _texts("<p>a</span></div> b</p>") == [("(intro)", ["a b"], [])]


def test_scripts_comments_and_entities():
    page = "<p>a &lt; b<!-- c -->d<br>e<script>x < y</script><noscript><p>no</noscript> f"
    assert _texts(page) == [("(intro)", ["a < b d e f"], [])]
    assert markup.sections_of("<title>T</title><div>only</div>") == [{"title": "(document)", "text": "T\nonly", "anchors": []}]
    assert markup.sections_of(None) == markup.sections_of("") == markup.sections_of("<p></p>") == []


def test_titles_and_bodies():
    page = "<meta property='og:title' content=' O  g '><title></title><div>a much longer block than the main one is</div><main>short</main>"
    assert markup.title_body_of(page) == ("O g", "a much longer block than the main one is")
    assert markup.title_body_of("<title>T\n t</title><p>x  y</p>") == ("T t", "T t x y")
    assert markup.title_body_of("<article>one</article><article>a longer one here</article>")[1] == "one"
    assert markup.title_body_of("<div>short</div>" * 50 + "<div>the fifty-first and longest</div>")[1] == "short"
    assert markup.main_text_of("<title> A </title><nav><p>n</nav><header><h1>no</h1></header><h1>H</h1><p>x<footer><p>f</footer>") == "A\nH\nx"


def test_broken_pages_stay_linear():
    size = lambda page: sum(len(s["text"]) for s in markup.sections_of(page))
    assert size("<ul>" + "<li>item number and text of it " * 4000) < 1_000_000
    assert size("<ul><li>item " * 2000) < 200 * 2000 * 5
    began = time.process_time()
    for page in ("<li>a " * 50_000, "<div><p>a" * 20_000, "<p>a</b>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000):
        markup.Page(page, frozenset())
    assert time.process_time() - began < 15


def test_a_page_becomes_a_record_that_is_found(spark):
    page = "<html><head><title>Terms of Service</title></head><body><h1 id='top'>Terms</h1><p>These terms apply to you.<p>We value privacy.<h2>Ads</h2><ul><li>No fraud<li>No spam</ul>"
    docs = spark.createDataFrame([(1, "file:///terms.html", page, "tos", "test", "Fixture Example"), (2, "file:///other.html", "<p>nothing here", "tos", None, "Other")], "id long, url string, body string, doc_type string, jurisdiction string, title string")
    records = html.normalize_documents(docs)
    by_id = {r.id: r for r in records.collect()}
    assert [(s.title, s.text, s.anchors) for s in by_id[1].sections] == [("Terms", "These terms apply to you.\nWe value privacy.", ["top"]), ("Ads", "No fraud\nNo spam", [])]
    assert by_id[1].doc_type == "tos" and by_id[2].jurisdiction == "global" and len(by_id[1].hash) == 40
    for name in ("source_name", "doc_type", "url", "version_date", "sections", "hash"):  # required of a normalized document
        assert all(r[name] is not None for r in by_id.values()), name
    text = F.array_join(F.transform("sections", lambda s: F.concat(s["title"], F.lit("\n"), s["text"])), "\n")
    index = search.build_index(records.select("id", text.alias("text")), "id")
    found = search.match(index, "id", any_=["terms", "privacy"])
    assert [by_id[r.id].source_name for r in found.collect()] == ["Fixture Example"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("k " + '{"className":' * 10 + '"x"' + "}" * 10 + " l", "k l"),
        ('a {"x": {"props": {"y": 1}}} b', 'a {"x": {"props": {"y": 1}}} b'),
        ('a {"props": {"className": 1}} b', "a b"),
        ('see ["$","div",null,{"a":1}] end', 'see end'),
        ('x "children": ["a", "b"] y', "x y"),
        ("a\n  {  \nb", "a\n\nb"),
        ("Childrenâs rule and Adsãs", "Children’s rule and Ads’s"),
        ("wordá next áone cá", "word — next — one c"),
        (r'say \"hi\"\tnow \\ end', 'say "hi" now \\ end'),
        ("one ]]\none ]]\n[^1]: source ]", "one\n[^1]: source ]"),
        ('tail”",;', "tail"),
        ("a​b\x07c", "abc"),
    ],
)
def test_report_texts(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(html.sanitize_report_text("t")).first()[0]
    assert got == want


def test_blobs_like_repeated_cutting():
    import re

    def plain(t, keys):
        for key in keys:
            before = None
            while before != t:
                before, t = t, re.sub(r"\{[^{}]*\}", lambda m: "" if key in m[0] else m[0], t)  # noqa: B023
        return t

    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choices(["{", "}", "k", "p", " ", "ab"], k=rng.randint(0, 25)))
        assert markup.without_blobs(t, ("k", "p")) == plain(t, ("k", "p")), t
    deep = "{" * 20_000 + "k" + "}" * 20_000
    began = time.process_time()
    assert markup.without_blobs(deep, ("k",)) == "{" * 19_999 + "}" * 19_999 and time.process_time() - began < 5


def _whole_diff(x, y):
    x, y = x.split(), y.split()
    return "" if not x or not y or x == y else " ".join(t for t in ndiff(x, y) if t[:2] in ("+ ", "- "))[:280]


def test_small_diffs_equal_the_whole_one_and_large_ones_are_bounded():
    rng = random.Random(6)
    for _ in range(200):
        x = rng.choices("alpha beta gamma delta epsilon".split(), k=rng.randint(0, 60))
        y = [w for w in x if rng.random() > 0.2] + rng.choices("zeta eta".split(), k=rng.randint(0, 3))
        assert helpers.tiny_diff_of(" ".join(x), " ".join(y)) == _whole_diff(" ".join(x), " ".join(y))
    for kinds in (50, 3000):
        x = [f"w{rng.randint(0, kinds)}" for _ in range(20_000)]
        y = rng.sample(x, len(x))
        began = time.process_time()
        assert len(helpers.tiny_diff_of(" ".join(x), " ".join(y))) == 280 and time.process_time() - began < 1
    x[15_000] = "new"
    assert helpers.tiny_diff_of(" ".join(x), " ".join([*x[:15_000], "old", *x[15_001:]])) in ("- new + old", "+ old - new")
    assert helpers.tiny_diff_of(" ".join(x), " ".join([*x[:900], *x[901:]])) == f"- {x[900]}"


def test_change_records_have_what_is_required(spark):
    df = spark.createDataFrame([("https://a.b/c", "2024-01-01", "h1", "h2", "a\nb", "a\nc"), ("https://a.b/d", "2024-01-01", None, "h2", "a\n", "a")], "url string, observed_at string, old_hash string, new_hash string, prev_text string, new_text string")
    got = changes.change_records(df).orderBy("url").collect()
    assert got[0]["diff"].split("\n") == ["--- old", "+++ new", "@@ -1,2 +1,2 @@", " a", "-b", "+c"] and got[0].material_changes and not got[1].material_changes
    assert {"url", "observed_at", "old_hash", "new_hash", "material_changes"} <= set(got[0].asDict())


STEMS = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic differentli differ vileli vile vietnamization vietnam operator oper feudalism feudal hopefulness hope formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil".split()


@pytest.mark.parametrize(("word", "want"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_published_stems(word, want):
    assert stem(word) == want


def test_other_words_stay():
    assert [stem(w) for w in ("", "is", "é", "a1s", "naïves", "42s")] == ["", "is", "é", "a1s", "naïves", "42s"]
