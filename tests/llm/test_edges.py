"""Edges of extraction, links, scores and tokens."""

import random
from array import array

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nomenlink.llm import attention_quality, html_templates, packing, url_rules

PAGES = "page_id long, url string, html string"


def _extracted(spark, bodies):
    rows = [(i, f"https://site.example/{i}", f"<html><body>{body}</body></html>") for i, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    return {r["page_id"]: r["text"] for r in html_templates.extract_pages(df).collect()}


def _words(seed, number):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(number))


@pytest.mark.parametrize("pages", [1, 6])
def test_comments_and_asides_inside_an_article_are_left_out(spark, pages):
    bodies = [
        f"<article><h1>Title {i}</h1><p>{_words(i, 40)}</p><section class='comments'><p>{_words(i + 100, 90)}</p></section>"
        f"<aside>{_words(i + 200, 30)}</aside></article>"
        for i in range(pages)
    ]
    assert _extracted(spark, bodies) == {i: f"Title {i}\n{_words(i, 40)}" for i in range(pages)}


@pytest.mark.parametrize("pages", [1, 6])
@pytest.mark.parametrize("tag", ["article", "div class=story"])
def test_a_short_article_beside_long_comments_is_the_article(spark, pages, tag):
    bodies = [
        f"<nav><a>Home</a></nav><{tag}><p>Short {_words(i, 1)}</p></{tag.split()[0]}>"
        f"<section class='comments'><p>{_words(i + 100, 200)}</p></section>"
        for i in range(pages)
    ]
    assert _extracted(spark, bodies) == {i: f"Short {_words(i, 1)}" for i in range(pages)}


@pytest.mark.parametrize("pages", [1, 6])
def test_a_line_that_stands_in_every_article_stays(spark, pages):
    bodies = [f"<header>Site</header><main><article><p>{_words(i, 30)}</p><p>Read more soon.</p></article></main>" for i in range(pages)]
    assert _extracted(spark, bodies) == {i: f"{_words(i, 30)}\nRead more soon." for i in range(pages)}


@pytest.mark.parametrize("around", ["<form>{}</form>", "<div class='content has-sidebar'>{}</div>", "{}"])
@pytest.mark.parametrize("opening", ["<article>", "<article class='post comments-open'>"])
def test_names_around_an_article_do_not_matter(spark, around, opening):
    assert _extracted(spark, [around.format(f"{opening}<p>Kept &amp; read.</p></article>")]) == {0: "Kept & read."}


def test_a_very_long_page(spark):
    text = _words(1, 150_000)
    assert _extracted(spark, [f"<article><p>{text}</p><script>{text}</script></article>"]) == {0: text}


LINKS = {
    "live": ("<link rel=canonical href='http://a.org/x'>", "http://a.org/x"),
    "upper": ("<LINK HREF=\"http://a.org/x\" REL='shortlink canonical'/>", "http://a.org/x"),
    "commented": ("<!-- <link rel=canonical href='http://a.org/x'> -->", None),
    "open comment": ("<!-- <link rel=canonical href='http://a.org/x'>", None),
    "script": ("<script>var x = \"<link rel=canonical href='http://a.org/x'>\"</script>", None),
    "textarea": ("<textarea><link rel=canonical href='http://a.org/x'></textarea>", None),
    "other attribute": ("<link rel=canonical data-href='http://b.org/' href='http://a.org/x'>", "http://a.org/x"),
    "only other": ("<link data-rel=canonical href='http://a.org/x'>", None),
    "refresh": ("<meta http-equiv=refresh content='0; url=/y'>", "http://page.net/y"),
    "sign in value": ("<link title='a > b' rel=canonical href='http://a.org/x'>", "http://a.org/x"),
    "long": ("<!--" + " canonical <link" * 20_000 + "--><link rel=canonical href='http://a.org/x'>", "http://a.org/x"),
}


def test_links_come_from_live_markup_only(spark):
    rows = [(i, f"http://page.net/{i}", html) for i, (html, _) in enumerate(LINKS.values())]
    found = {r["from_url"]: r["to_url"] for r in url_rules.page_links(spark.createDataFrame(rows, PAGES)).collect()}
    for i, (name, (_, target)) in enumerate(LINKS.items()):
        assert found.get(f"http://page.net/{i}") == target, name


def test_a_stage_keeps_columns_named_like_the_score(spark, sf, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "quality_model", lambda *_: None)  # every score is a half
    rows = [(1, "a text", 0.25, "x", None), (2, None, None, None, 7), (2, None, None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double, quality_score_0 string, SCORED int")
    kept = corpus_pipeline.quality_classifier(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert attention_quality.score_quality(docs, None).columns == ["doc_id", "text", "quality_score_0", "SCORED", "score"]


def test_repeated_ids_do_not_move_the_fit(spark):
    rows = [(i, f"{'good words here. ' * 9}" if i % 2 else "x9 !! zz " * 9) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label long")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows * 6, "doc_id long, text string").repartition(7)
    a, b = (attention_quality.score_quality(once, attention_quality.fit_quality(d, labels)).collect() for d in (once, often))
    assert {r["doc_id"]: round(r["score"], 9) for r in a} == {r["doc_id"]: round(r["score"], 9) for r in b}


def test_tokens_equal_the_whole_tokenizer(spark):
    import public_tokenizers

    words = packing._Words(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(3)
    signs = "aZéßÀ'’.,!?-_0129 \t\n\r\x0b\x0c\x1c\x85  ªº²Ⅷ中ıİ́Ω<|>…€"
    texts = ["", " ", "don't we'll x'sy", "<|endoftext|> a<|startoftext|>", "ＡＢ ﬁ", "é ́e", "É" * 3000]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abé'.,!s t2\n") for _ in range(60)) for _ in range(1000)]
    for text in texts:
        assert words.encode(text) == words._through(text), repr(text)
    assert words.direct


def test_remembered_values_are_bounded_and_right(monkeypatch):
    monkeypatch.setattr(packing, "_REMEMBERED", 3)
    asked = []
    held = packing._Remembered(lambda key: asked.append(key) or key.encode())
    for key in "abcabcdefabcxyzabc":
        assert held[key] == key.encode() and len(held) <= 3 and len(held.former) <= 3
    assert asked.count("a") < 4
    assert array("I", [1]).itemsize == 4


def test_nothing_is_left_of_a_page_without_text(spark):
    rows = [(1, None, None), (2, "no host", ""), (3, "http://x.example/", "<article></article><p> </p>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], PAGES + ", text string")
    assert {r["page_id"]: r["text"] for r in html_templates.extract_pages(df).collect()} == {1: "", 2: "", 3: ""}
    assert html_templates.extract_pages(df.where(F.lit(False))).collect() == []
