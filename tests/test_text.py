"""Column functions against plain Python on made-up strings."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import contact, names, noise, text as tx
from docloom.operators import curation

STRINGS = [
    "", " ", "a", "Plain words here", "tab\tand\x0bmore\x0c", "line\r\nend\rother\nlast", "nb sp  two", "né à Été ÀÉ", "x @ y.com", "a＠b.org",
    "SOL and RESOLVE sol x", "I ve been", "Hi ve", "master standing", "en–dash ‘q’ “q”", "cafe\u0301 n\u0303", "#1 C++ / C# (x), y: 'z'", "a\n\n\n\nb", "日本語 text", "z" * 130,
]


def run(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", *(c.alias(f"c{k}") for k, c in enumerate(columns))).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


def clean_python(raw: str) -> str:
    t = raw.replace(" ", " ").replace("\r\n", "\n").replace("\r", "\n")
    for a, b in tx.OCR_REPAIRS:
        t = t.replace(a, b)
    t = re.sub(r"\s*@\s*", "@", t.replace("＠", "@"))
    t = re.sub(r"[^\w\s@.+#\-/(),:']", " ", t)
    return re.sub(r"\n{2,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


def test_strip_words_lines_match_python(spark):
    got = run(spark, STRINGS, tx.strip(F.col("x")), tx.words(F.col("x")), tx.lines(F.col("x")))
    for s, (stripped, words, lines) in zip(STRINGS, got):
        assert stripped == s.strip()
        assert words == s.split()
        assert lines == [ln.strip() for ln in s.splitlines() if ln.strip()]


def test_clean_text_matches_python(spark):
    assert run(spark, STRINGS, tx.clean_text(F.col("x"))) == [clean_python(s) for s in STRINGS]
    assert run(spark, [None], tx.clean_text(F.col("x"))) == [""]


def test_ocr_artifact(spark):
    name = tx.ARTIFACT
    texts = [f"Ma{name}ter {name}cience Ja{name.upper()} {name}3 a{name}3 {name} end{name}\nx", "none"]
    assert run(spark, texts, tx.repair_ocr_artifact(F.col("x")))[0] == f"Master Science Jas S3 as3 {name} ends\nx"
    many = [f"{name} " * 8, f"{name} " * 7, f"{name} " * 8 + "w " * 192, f"{name} " * 8 + "w " * 190]
    assert run(spark, many, tx.has_ocr_artifact(F.col("x"))) == [True, False, False, True]


def test_parser_quality(spark):
    texts = ["short", "a" * 100, "\x01" * 6 + "b" * 94, ""]
    flag = tx.quality_flag(F.col("x"))
    assert run(spark, texts, flag, tx.parser_confidence(flag)) == [("low_text", 0.62), ("ok", 1.0), ("noisy_symbols", 0.45), ("low_text", 0.62)]
    assert run(spark, ["other"], tx.parser_confidence(F.col("x"))) == [0.55]


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail a.b@c.org now", "a.b@c.org"),
        ("a.b @ c.org", "a.b@c.org"),
        ("write jdoe example.com today", "jdoe@example.com"),
        ("jdoe at site.travel", "jdoe@site.travel"),
        ("nothing here", None),
    ],
)
def test_first_email(spark, text, want):
    assert run(spark, [text], contact.first_email(F.col("x"))) == [want]


@pytest.mark.parametrize(
    "text, want",
    [
        ("call +20 1055512345", "+20 10 5551 2345"),
        ("010 5551 2345", "010 5551 2345"),
        ("ZIP 43215 then (614) 555-0123", "(614) 555-0123"),
        ("1-614-555-0199", "(614) 555-0199"),
        ("1-212-555-0199", None),
        ("4111 1111 1111 1111", None),
        ("555 12", None),
    ],
)
def test_first_phone(spark, text, want):
    assert run(spark, [text], contact.first_phone(F.col("x"))) == [want]


def test_format_phone(spark):
    digits = ["123", "6145550123", "01055512345", "13145550123", "12125550123", "1234567890123456", "12a4567890"]
    assert run(spark, digits, contact.format_phone(F.col("x"))) == [None, "(614) 555-0123", "010 5551 2345", "(314) 555-0123", "+12125550123", None, None]


def test_names(spark):
    texts = ["SUMMARY\nJane Doe\nx", "Acme Corp Columbus, OH\nTom Oneil", "SKILLS\n12345\nfoo@bar.com", ""]
    assert run(spark, texts, names.best_name(tx.lines(F.col("x")))) == ["Jane Doe", "Tom Oneil", None, None]
    lines = ["JANE DOE", "Jane Doe", "Acme Corp Columbus, OH", "skills", "a b c d e", "x@y.z 1"]
    assert run(spark, lines, names.name_score(F.col("x"))) == [6, 5, -9, -8, -1, -5]
    assert run(spark, ["Jo", "Jane Doe", "My Resume Doc", "Jane 7", None], names.name_is_bad(F.col("x"))) == [True, False, True, True, True]


def test_noise(spark):
    lines = ["ab", "***", "wv Hello", "WV Hello", "12 ab", "2003-2007 9 Columbus, OH", "2019 - Present", "a@b.c @ linkedin.com", "Real line here", "…—"]
    assert run(spark, lines, noise.is_noise(F.col("x"))) == [True, True, True, False, True, True, False, True, False, True]


def test_merge_dates(spark):
    cases = [["2019 - Present", "BSc"], ["2019 -", "BSc", "2020", "MSc", "PhD"], ["2019 - Present"], ["x", "2015"], ["2019", "2020", "2021 now"], []]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x array<string>")
    got = [r[0] for r in df.orderBy("i").select(noise.merge_dates(F.col("x"))).collect()]
    assert got == [["2019 - Present BSc"], ["2019 - BSc", "2020 MSc", "PhD"], [], ["x", "2015"], ["2019 2020"], []]


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([([" A", "a", "", "b  c", "B c", "b c"],)], "x array<string>")
    got = df.select(noise.dedupe_ci(F.col("x")), noise.dedupe_ws(F.col("x"))).first()
    assert got[0] == ["A", "b  c", "B c"] and got[1] == ["A", "b  c"]


def test_entity_filters(spark):
    items = ["x", "oh", "--", " Team lead ", "2014", "2010 - 2014", "Experience:", "Education", "han", "US", "a bcd", "zation", "Acme"]
    df = spark.createDataFrame([(items,)], "x array<string>")
    got = df.select(noise.clean_entities(F.col("x")), noise.clean_experience(F.col("x")), noise.clean_education(F.col("x"))).first()
    assert got[0] == [i.strip() for i in items[3:]]
    assert got[1] == ["Team lead", "Education", "Acme"]
    assert "Education" not in got[2] and "Acme" in got[2]


def test_label_slug(spark):
    assert run(spark, [" Java_Resumes ", "SAP Developer resume", "presumes"], curation.label_slug(F.col("x"))) == ["java", "sap_developer", "presumes"]
