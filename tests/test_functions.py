"""Scalar functions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import facts
from quillon.functions import text as T
from quillon.functions.vectors import cosine
from quillon.sources import ocr


def value(spark, column, **row):
    names = list(row)
    schema = ", ".join(f"{n} {'array<double>' if isinstance(row[n], list) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("r")).head()["r"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("L'avocat de la société", ["l'avocat", "société"]), ("cœur", ["ur"]), ("", []), ("de la", []), (None, []), ("a a aa aa", ["aa", "aa"])],
)
def test_tokens(spark, text, want):
    assert value(spark, T.tokens("t"), t=text) == want
    if text is not None:
        assert T.tokenize(text) == want


def test_expand_is_one_level():
    assert T.expand(["facture"]) == ["facture", "paiement", "impaye", "creance", "fournisseur"]


@pytest.mark.parametrize(("text", "want"), [("Œuvre d'été", "uvre d ete"), ("cœur", "coeur"), ("", ""), (None, None), ("ﬁn ½", "fin 1 2")])
def test_normalise(spark, text, want):
    assert value(spark, T.normalise("t"), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("le 31/02/2020 puis 1 mars 2021", None), ("8 février 2019", dt.date(2019, 2, 8)), ("12 foo 2019 puis 2020-05-06", dt.date(2020, 5, 6)),
        ("03-04/2021", dt.date(2021, 4, 3)), ("", None), (None, None), ("30 fevrier 2020 et 2020-01-01", None),
    ],
)
def test_text_date(spark, text, want):
    assert value(spark, facts.text_date("t"), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("parcs", "Extrait Kbis"), ("un seul mot: bail", None), ("avis d'imposition, facture du mois", "Avis d'imposition"), ("", None)],
)
def test_doc_type(spark, text, want):
    assert value(spark, facts.doc_type(T.normalise("t"), F.array_distinct(T.tokens("t"))), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Client Jean DUPONT et Dr Jean DUPONT", ["Jean DUPONT"]), ("Total REVENU", []), (None, []), ("Madame Anne MARTIN, Paul DURAND", ["Anne MARTIN", "Paul DURAND"])],
)
def test_persons(spark, text, want):
    assert value(spark, facts.persons("t"), t=text) == want


def test_tags(spark):
    assert value(spark, facts.tags(T.tokens("t"), F.lit("Facture")), t="facture") == ["facture"]
    assert value(spark, facts.tags(T.tokens("t"), F.lit("Bail")), t="chien") == ["bail", "morsure"]


@pytest.mark.parametrize(("text", "label", "confidence"), [("  \n", "empty", 0.0), (None, "empty", 0.0), ("Bonjour le monde. " * 100, "good", None), ("\x01\x02\x03\x04", "low", None)])
def test_quality(spark, text, label, confidence):
    q = value(spark, T.quality("t"), t=text)
    assert q["quality"] == label
    assert 0 <= q["confidence"] <= 1
    assert confidence is None or q["confidence"] == confidence


def test_clean(spark):
    assert value(spark, T.clean("t"), t="a\n\tb\0c") == "a b c"


def test_title_and_summary(spark):
    none = F.array().cast("array<string>")
    assert value(spark, facts.title(F.lit(""), none, F.lit(None).cast("date"), F.col("t"), F.lit("x.pdf")), t="--- Page 1 ---\nabc") == "--- Page 1 ---"
    assert value(spark, facts.title(F.lit(""), none, F.lit(None).cast("date"), F.col("t"), F.lit("x.pdf")), t="a") == "x.pdf"
    got = value(spark, facts.summary(F.lit("Bail"), F.array(F.lit("A B")), F.lit(dt.date(2020, 1, 2)), none, F.col("t")), t="Court. Cette phrase compte bien plus de trente-cinq lettres.")
    assert got == "Document analyse comme Bail date du 2020-01-02, concernant A B. Cette phrase compte bien plus de trente-cinq lettres."


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [1.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([], [], 0.0)])
def test_cosine(spark, a, b, want):
    assert value(spark, cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize(("text", "want"), [("ni defit", "ni de deficit"), ("un animal", "un animal"), ("un ranimal", "un l'animal"), ("Traval", "travail"), ("Cerificat", "Certificat"), ("", "")])
def test_ocr_postprocess(spark, text, want):
    assert value(spark, ocr.postprocess(F.col("t")), t=text) == want


def test_bounded_distance():
    assert ocr.bounded_distance("traval", "travail") == 1
    assert ocr.bounded_distance("aaaaaa", "bbbbbbb") == 3


def test_safe_filename_and_excerpt(spark):
    assert value(spark, T.safe_filename("t"), t="../a/b é?.pdf") == "b _.pdf"
    assert value(spark, T.safe_filename("t"), t=None) == "document"
    got = value(spark, T.excerpt("t", ["chien"]), t="x" * 200 + " chien " + "y" * 400)
    assert got.startswith("... ") and got.endswith(" ...") and "chien" in got
    assert value(spark, T.clip("t", 10, 4, 2), t="0123456789ab") == "0123\n[...]\nab"
