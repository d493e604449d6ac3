"""Pages to provisions in both markups, checks, chunks and change notes."""

import pytest

from lexspan.operators import provisions
from lexspan.sources import html

PLAIN = provisions.Markup("ti-art", "sti-art", "ti-section-*", "ti-section-1", "ti-section-2", body="normal", roman_title="doc-ti", signature="fnp_")
MARKED = provisions.Markup("title-art", "stitle-art", "title-division-*", "title-division-1", "title-division-2", label="no-parag", roman_title="title-sch*", marker="modref")

PLAIN_PAGE = """<html><body><div id="rct_1"><p>(1) A recital.</p></div>
<p class="ti-section-1">CHAPTER I</p><p class="ti-section-2">General`</p>
<p class="ti-art">Article 1</p><p class="sti-art">Scope'</p><p class="normal">1. One.</p><p class="normal">More of one.</p><p class="normal">2. Two.</p>
<p class="ti-section-1">CHAPTER II</p><p class="ti-section-2">Duties</p><p class="ti-section-1">SECTION 1</p>
<p class="ti-art">Article 2a</p><p class="normal">Unnumbered&#160;text.</p>
<div id="fnp_1"><p>Done at Brussels</p></div>
<div id="sch_I"><p class="doc-ti">SCHEDULE I</p><p class="doc-ti">Lists of <b>things</b></p><p>Body</p></div></body></html>"""
MARKED_PAGE = """<div><p class="title-division-1">CHAPTER I</p><p class="title-division-2">General</p>
<p class="title-art">Article 1</p><p class="stitle-art">Scope</p><div><span class="no-parag">1.</span> Base text.</div>
<p class="modref">▼M1 —————</p><div><span class="no-parag">2</span> New text.</div><p class="modref">▼B</p>
<p class="title-art">Article 2</p><div><span class="no-parag">1.</span> Old.</div>
<div id="sch_II"><p class="title-sch-1">SCHEDULE II</p><p>x</p></div></div>"""


def parsed(spark, page, markup):
    rows = provisions.parse(spark.createDataFrame([("d", page)], "doc string, html string"), markup)
    return [r.asDict() for r in rows.orderBy("ord").collect()]


def test_flatten_keeps_tails_in_place():
    f = html.flatten("<div>a<p>b<b>c</b>d</p>e<script>no()</script><br>f</div>g")
    assert f["text"] == "abcdefg"
    spans = {e["tag"]: f["text"][e["start"] : e["end"]] for e in f["elements"]}
    assert spans["p"] == "bcd" and spans["b"] == "c" and spans["div"] == "abcdef"
    assert html.flatten(None) == {"text": "", "elements": []}


def test_references_that_nothing_ends_stand_as_written():
    f = html.flatten('<p class="a&amp b">x&amp</p>&amp; &copy;&copy y&middot; &copyright; &amp;lt &lt5; z&#38;&<b title="&quot;">&amp')
    assert f["text"] == "x&amp& ©&copy y· &copyright; &lt &lt5; z&&&amp"
    assert f["elements"][0]["cls"] == "a&amp b" and [(e["start"], e["end"]) for e in f["elements"]] == [(0, 5), (42, 46)]


def test_plain_markup(spark):
    rows = parsed(spark, PLAIN_PAGE, PLAIN)
    assert [r["id"] for r in rows] == ["chp_I", "art_1", "art_1.1", "art_1.2", "chp_II", "art_2a", "sch_I", "rct_1"]
    by = {r["id"]: r for r in rows}
    assert by["chp_I"]["text"] == "CHAPTER I General" and by["art_1"]["title"] == "Scope" and by["art_2a"]["chapter_id"] == "chp_II"
    assert by["art_1.1"]["text"] == "1. One.More of one." and by["art_1.2"]["parent_id"] == "art_1" and by["art_1.2"]["chapter_id"] == "chp_I"
    assert "CHAPTER" not in by["art_1"]["text"] and "Done" not in by["art_2a"]["text"] and by["art_2a"]["text"].endswith("Unnumbered text.")
    assert by["sch_I"]["title"] == "Lists of things" and by["rct_1"]["text"] == "(1) A recital." and not any(r["amended"] for r in rows)


def test_marked_markup(spark):
    by = {r["id"]: r for r in parsed(spark, MARKED_PAGE, MARKED)}
    assert by["art_1"]["amended"] and not by["art_2"]["amended"] and by["art_1.2"]["amended"] and not by["art_1.1"]["amended"]
    assert by["art_1.2"]["text"] == "2 New text." and "▼" not in by["art_1"]["text"] and by["art_2"]["chapter_id"] == "chp_I"


def test_pages_without_anything(spark):
    assert parsed(spark, None, PLAIN) == [] == parsed(spark, "<p>x", MARKED)


def test_checks_name_what_disagrees(spark):
    rows = spark.createDataFrame(
        [("v", "art_1", "article", "", "Done at Brussels ▼M1"), ("v", "art_1.1", "paragraph", "", "x CHAPTER IV y"), ("v", "rct_1", "recital", "", "SECTION 2")],
        "version string, id string, kind string, title string, text string",
    )
    expected = spark.createDataFrame([("v", "article", 1), ("v", "roman", 2)], "version string, kind string, expected int")
    assert sorted(r.message for r in provisions.disagreements(rows, expected).collect()) == [
        "v: art_1 carries a consolidation marker", "v: art_1 carries the signature block", "v: art_1.1 carries a division heading", "v: expected 2 roman, parsed 0",
    ]
    with pytest.raises(ValueError, match="expected 2 roman"):
        provisions.verify(rows, expected)


def test_chunks_are_cut_at_points_and_headed(spark):
    rows = spark.createDataFrame(
        [
            ("v", "art_1", "article", "1", "Terms", "whole", None), ("v", "art_1.1", "paragraph", "1", "", "Intro (1) aaaa (2) bbbb", "art_1"), ("v", "rct_2", "recital", "2", "", "why", None),
            ("v", "art_3", "article", "3", "", "alone", None), ("v", "art_9.1", "paragraph", "1", "", "orphan", "art_9"),
        ],
        "version string, id string, kind string, number string, title string, text string, parent_id string",
    )
    got = {r.chunk_id: r.text for r in provisions.chunks(rows, 40).collect()}
    assert got == {
        "art_1.1#0": "Article 1(1) Terms\nIntro (1) aaaa", "art_1.1#1": "(2) bbbb", "rct_2": "Recital 2\nwhy", "art_3": "alone", "art_9.1": "Article 9(1)\norphan",
    }


def test_change_notes(spark):
    rows = spark.createDataFrame(
        [("original", "art_1", "article", "1", "a  b .", None), ("consolidated", "art_1", "article", "1", "a b.", None), ("original", "art_2", "article", "2", "x", None),
         ("consolidated", "art_2", "article", "2", "y", None), ("original", "rct_1", "recital", "1", "z", None)],
        "version string, id string, kind string, number string, text string, parent_id string",
    )
    got = {(r.version, r.id): r.note for r in provisions.change_notes(rows).collect()}
    assert got["original", "art_1"] is None and got["consolidated", "art_2"] == "The wording of Article 2 differs between the original and the consolidated text."
    assert got["original", "rct_1"] == "Recital 1 appears in the original text and not in the consolidated text."


def test_a_page_of_very_many_labels(spark):
    labels = "".join(f'<p class="normal">{i}. Text {i}.</p>' for i in range(1, 100_001))
    page = f'<p class="ti-art">Article 1</p>{labels}<p class="ti-art">Article 2</p><p class="normal">1. Last.</p>'
    rows = provisions.parse(spark.createDataFrame([("d", page)], "doc string, html string"), PLAIN).where("kind = 'paragraph'")
    got = {r.id: r.text for r in rows.where("id in ('art_1.1', 'art_1.77777', 'art_1.100000', 'art_2.1')").collect()}
    assert got == {"art_1.1": "1. Text 1.", "art_1.77777": "77777. Text 77777.", "art_1.100000": "100000. Text 100000.", "art_2.1": "1. Last."}
    assert rows.count() == 100_001


def test_versions_are_told_apart(spark):
    from lexspan.operators import versions

    pages = lambda page: lambda s: s.createDataFrame([("d", page)], "doc string, html string")
    sources = [versions.Source("original", pages(PLAIN_PAGE), PLAIN, {"article": 2, "recital": 1}), versions.Source("consolidated", pages(MARKED_PAGE), MARKED, {"article": 3})]
    rows = versions.load(spark, sources)
    assert {r.version for r in rows.where("id = 'art_1' and amended").collect()} == {"consolidated"}
    assert {r.version for r in versions.load(spark, sources, ("original",)).collect()} == {"original"}
    assert [r.message for r in provisions.counts_as_expected(rows, versions.expected(spark, sources)).collect()] == ["consolidated: expected 3 article, parsed 2"]
    with pytest.raises(versions.UnknownVersion, match="no source of draft"):
        versions.load(spark, sources, ("draft",))
