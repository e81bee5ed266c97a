"""Column functions against hand-made tables and brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from inkloom.functions import markup, strings
from inkloom.functions.sentences import chunk_text, hard_wrap, sentence_split
from inkloom.functions.urls import resolve_url
from inkloom.functions.vectors import quantise_i16


def apply(spark, function, values, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["out"] for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_slugify(spark):
    values = ["Chapter 1.01 — Arrival?", "Été  à la Plage", "éä", "x" * 70, "?!", "a" * 63 + " b", "Ω mega", "ŀ-İ"]
    assert apply(spark, strings.slugify, values) == [
        "chapter-1-01-arrival", "ete-a-la-plage", "ea", "x" * 64, "", "a" * 63 + "-", "mega", "i"
    ]
    slugs = apply(spark, strings.slugify, values)
    assert all(re.fullmatch("[a-z0-9-]{0,64}", slug) for slug in slugs)
    assert apply(spark, strings.slugify, slugs) == [slug.strip("-") for slug in slugs]


def test_slugify_unicode(spark):
    values = [" Straße_und  Weg! ", "日本 語", "a - b", "?!", ""]
    assert apply(spark, strings.slugify_unicode, values) == ["straße-und-weg", "日本-語", "a---b", "audiofile", "audiofile"]


def test_names(spark):
    assert apply(spark, strings.safe_name, [' A — B/C: "x"? ', "1.02 B"]) == ["a---b-c-x", "1.02-b"]
    assert apply(spark, strings.base_name, ["/in/My Book.part.TXT", "plain", "/in/???.txt"]) == [
        "my-book-part", "plain", "audiofile"
    ]
    titles = ["Chapter 1.01 Arrival", "Test 1.01 A", "v1.5", "3.14159 pi", "none", "x 2.10  B c"]
    assert apply(spark, strings.chapter_code, titles) == ["1.01", "1.01 A", "v1.5", "3.14159", "none", "2.10 B"]
    tags = apply(spark, lambda c: strings.clean_tag_list(c, ["epub", "pdf"]), [" PDF ,epub,x,pdf,,", ""])
    assert tags == [["pdf", "epub"], []]
    labels = ["Next Chapter →", " « PREVIOUS  page", "→"]
    assert apply(spark, strings.nav_label, labels) == ["next chapter ", " previous page", ""]


def test_html_to_text(spark):
    values = [
        "<p>a</p>\n<p>b &amp;lt; <i>c</i></p>", "<div><p>a</p></div>", "<p>a<p>b", "x<br>y<hr/>z",
        "<blockquote><br><p>a</p></blockquote>", "<div><i>t</i><p>a</p></div>",
    ]
    assert apply(spark, markup.html_to_text, values) == [
        "\na\n\n\nb &lt; c", "\na", "\nab", "x\ny\nz", "\n\na", "\nt\na"
    ]


BASE = "http://a/b/c/d;p?q"


RESOLVED = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"),
    ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"),
    (";x", "http://a/b/c/;x"), ("g;x?y#s", "http://a/b/c/g;x?y#s"), (".", "http://a/b/c/"),
    ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"),
    ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"),
    ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./g/.", "http://a/b/c/g/"),
    ("g/./h", "http://a/b/c/g/h"), ("g;x=1/../y", "http://a/b/c/y"), ("#", "http://a/b/c/d;p?q"),
    ("", ""), ("  ", ""), (None, ""), ("mailto:a@b", "mailto:a@b"), ("HTTPS://H/x", "https://H/x"),
    (" g ", "http://a/b/c/g"), ("1:2", ""), ("%zz", ""), ("é ü", "http://a/b/c/%C3%A9%20%C3%BC"),
    ("a%20b", "http://a/b/c/a%20b"), ("x\ny", ""),
]


def test_resolve_url(spark):
    got = apply(spark, lambda c: resolve_url(F.lit(BASE), c), [href for href, _ in RESOLVED])
    assert dict(zip(RESOLVED, got)) == {case: case[1] for case in RESOLVED}


SEGMENT = re.compile(r"""(?s).+?(?:[.!?]+["')\]]*\s+|\n{2,}|\Z)""", re.A)


def segments(text):
    text = re.sub(r"[ \t\f\v]+", " ", text.replace("\r\n", "\n"))
    return SEGMENT.findall(text)


def wrap(sentence, limit):
    pieces = []
    while len(sentence) > limit:
        cut = next((i for i in range(limit, 0, -1) if sentence[i] in " \n\t"), limit)
        pieces.append(sentence[:cut].strip() + "\n")
        sentence = sentence[cut:].strip()
    return pieces + [sentence] if sentence else pieces


def pack(text, limit):
    chunks, current = [], ""
    for sentence in segments(text):
        if len(current) + len(sentence) > limit and current:
            chunks.append(current)
            current = ""
        for piece in wrap(sentence, limit) if len(sentence) > limit else [sentence]:
            if len(current) + len(piece) > limit and current:
                chunks.append(current)
                current = ""
            current += piece
    return [c.strip() for c in [*chunks, current] if c.strip()]


def pack_strict(text, limit):
    limit = max(400, limit)
    chunks, current = [], ""
    for sentence in segments(text):
        if len(current) + len(sentence) > limit and current:
            chunks.append(current)
            current = ""
        while len(sentence) > limit:
            cut = sentence.rfind(" ", 0, limit)
            cut = cut if cut > 0 else limit
            chunks.append(current + sentence[:cut] + "\n")
            current, sentence = "", sentence[cut:].lstrip()
        current += sentence
    return [c.strip() for c in [*chunks, current] if c.strip()]


def texts(count, length, seed):
    rng = random.Random(seed)
    alphabet = ["a", "bc", "longer", " ", " ", "\n", "\n\n", ". ", "! ", '." ', "?", ".", "\t", "\r\n", "éü", ") ", "日本"]
    fixed = ["", " ", "\n\n", "\n\n\nlead. x", "end.\n", 'He said "no." Then left.', "word" * 300, " " + "z" * 900, "3.14 is. pi"]
    return fixed + ["".join(rng.choices(alphabet, k=rng.randrange(1, length))) for _ in range(count)]


def test_sentences_equal_brute_force(spark):
    values = texts(300, 200, 1)
    assert apply(spark, sentence_split, values) == [[s for s in segments(v)] for v in values]


@pytest.mark.parametrize("limit", [5, 17, 40, 400])
def test_chunks_equal_brute_force(spark, limit):
    values = texts(200, 600, limit)
    got = apply(spark, lambda c: chunk_text(c, limit), values)
    assert got == [pack(v, limit) for v in values]
    assert all(len(chunk) <= limit for chunks in got for chunk in chunks)


def test_strict_chunks_equal_brute_force(spark):
    values = texts(200, 3000, 7) + ["x" * 399 + "  " + "\n\n" + "y. z", ("ab " * 500) + ". next"]
    assert apply(spark, lambda c: chunk_text(c, 10, strict=True), values) == [pack_strict(v, 10) for v in values]


def test_hard_wrap_equals_brute_force(spark):
    values = [v for v in texts(200, 100, 3) if v]
    assert apply(spark, lambda c: hard_wrap(c, 12), values) == [wrap(v, 12) for v in values]


def test_chunks_lose_nothing(spark):
    values = texts(50, 2000, 11)
    for value, chunks in zip(values, apply(spark, lambda c: chunk_text(c, 60), values)):
        assert "".join("".join(chunks).split()) == "".join(value.split())


def test_quantise(spark):
    samples = [0.0, 1.0, -1.0, 2.0, -2.0, 0.5, -0.00004, 0.99999]
    got = apply(spark, quantise_i16, [samples], "array<float>")[0]
    assert got == [0, 32767, -32767, 32767, -32767, 16383, -1, 32766]
