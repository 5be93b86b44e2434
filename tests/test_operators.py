"""Search, rights, sources, store and orphans on small tables."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon import runtime
from quillon.operators import access, analysis, dashboard, intake, orphans, search, store
from quillon.operators import matters as matters_of
from quillon.runtime import staged
from quillon.sources import engines, files, ocr, providers

T0 = dt.datetime(2020, 1, 1)
DOC = "id string, client_id string, matter_id string, title string, type string, doc_type string, summary string, persons array<string>, tags array<string>, filename string, status string, document_date date, responsible string, extra string"
PAGE = "id string, document_id string, page_number int, text string, embedding array<double>, ordinal bigint, filename string"
SEED = (
    "Le dossier concerne une attaque de chien ayant provoque une blessure. "
    "Les pieces utiles portent sur la responsabilite du proprietaire de l'animal."
)


@pytest.fixture(scope="module")
def seed(spark):
    return {
        "documents": spark.createDataFrame([("d1", "c1", "m1", None, "Note", None, None, None, None, "note.txt", "indexed", None, None, "x")], DOC),
        "pages": spark.createDataFrame([("p1", "d1", 1, SEED, None, 0, "clash")], PAGE),
        "matters": spark.createDataFrame([("m1", "Morsure", T0)], "id string, name string, created_at timestamp"),
        "clients": spark.createDataFrame([("c1", "Martin", T0)], "id string, name string, created_at timestamp"),
    }


def test_search_golden(seed):
    rows = search.search(seed, "morsure de chien", access.Rights(("c1",), ("m1",))).collect()
    assert len(rows) == 1
    assert (rows[0]["score"], rows[0]["exact_score"], rows[0]["semantic_score"]) == (0.2478, 0.189, 0.3571)
    assert rows[0]["excerpt"] == "Note " + SEED


def test_search_without_tokens_or_rights(seed):
    assert search.search(seed, "  ", access.Rights(("c1",), ())).count() == 0
    assert search.search(seed, "chien", access.Rights()).count() == 0


def test_search_ties_keep_storage_order(spark, seed):
    many = spark.createDataFrame([(f"p{i:03d}", "d1", i, "chien", None, 100 - i, "") for i in range(60)], PAGE)
    rows = search.search(seed | {"pages": many}, "chien", access.Rights((), ("m1",))).collect()
    assert len(rows) == 50
    assert {r["page_id"] for r in rows} == {f"p{i:03d}" for i in range(10, 60)}


def test_search_of_empty_tables(spark, seed):
    empty = {k: v.limit(0) for k, v in seed.items()}
    assert search.search(empty, "chien", access.Rights(("c1",), ())).count() == 0


@pytest.mark.parametrize(("client", "matter", "want"), [(None, None, True), ("", "", True), (None, "m9", False), ("c1", None, True), (None, "m1", True), ("c9", "", False)])
def test_rights_are_never_null(spark, client, matter, want):
    df = spark.createDataFrame([(client, matter)], "client_id string, matter_id string")
    assert df.select(access.Rights(("c1",), ("m1",)).visible().alias("v")).head()["v"] is want


def test_unknown_dates_pass(spark):
    df = spark.createDataFrame([(None,), (dt.date(2020, 1, 1),), (dt.date(2010, 1, 1),)], "document_date date")
    assert df.filter(access.Filters(from_date=dt.date(2015, 1, 1)).matches()).count() == 2


def test_visible_counts_match_the_predicate(spark, data):
    users, docs = spark.read.parquet(f"{data}/users.parquet"), spark.read.parquet(f"{data}/documents.parquet")
    got = {r["user_id"]: r["visible"] for r in access.visible_counts(users, docs).collect()}
    for u in list(got)[:6]:
        assert got[u] == docs.filter(access.Rights.of(users, u).visible()).count()


@pytest.mark.parametrize(("path", "mime", "want"), [("x.pdf", "text/plain", "text"), ("a/x.PDF", None, "pdf"), ("x.tif", None, "image"), ("x", "image/png", "image"), ("x.docx", None, "unsupported"), (None, None, "unsupported")])
def test_route(spark, path, mime, want):
    assert spark.createDataFrame([(path, mime)], "p string, m string").select(files.route("p", "m").alias("r")).head()["r"] == want


def test_extract(spark):
    good = "Ceci est une page de texte tout a fait lisible. " * 40
    pdf = b"%PDF /Type /Page /Type /Pages (une phrase lisible de plus de deux mots) (ab) (\x01\x02\x03\x04)"
    df = spark.createDataFrame([("a.txt", None, b"ab\xffc", None), ("b.pdf", None, b"", f"{good}\f  \f{good}"), ("c.pdf", None, pdf, None), ("d.png", None, b"", None), ("e.zip", None, None, None), ("f.txt", None, None, None)], "path string, mime_type string, content binary, layer string")
    got = {r["path"]: r for r in files.extract(df, "layer").collect()}
    assert got["a.txt"]["pages"][0]["text"] == "abc" and got["a.txt"]["status"] == "indexed"
    assert [p["page_number"] for p in got["b.pdf"]["pages"]] == [1, 2] and got["b.pdf"]["status"] == "indexed"
    assert [p["text"] for p in got["c.pdf"]["pages"]] == ["une phrase lisible de plus de deux mots"] and got["c.pdf"]["page_count"] == 1
    assert got["d.png"]["status"] == "ocr_pending" and got["e.zip"]["quality"] == "unsupported"
    assert got["f.txt"]["status"] == "low_quality" and len(got["f.txt"]["pages"]) == 1


def test_ocr_words_and_candidates(spark):
    w = "image_id string, engine string, psm string, angle int, page_num int, block_num int, par_num int, line_num int, ordinal int, text string, conf double"
    rows = [("i", "tesseract", "6", 0, 1, 1, 1, 2, 0, "deux", 90.0), ("i", "tesseract", "6", 0, 1, 1, 1, 1, 1, "un", 90.0), ("i", "tesseract", "6", 0, 1, 1, 1, 1, 2, "mot", 90.0), ("i", "tesseract", "6", 0, 1, 1, 1, 1, 3, "", 90.0), ("i", "tesseract", "6", 0, 1, 1, 1, 1, 4, "x", -1.0)]
    got = ocr.words_to_text(spark.createDataFrame(rows, w)).head()
    assert (got["raw_text"], got["words"]) == ("un mot\ndeux", 3)
    c = "image_id string, engine string, psm string, angle int, words int, confidence double, semantic double"
    best = ocr.best_candidate(spark.createDataFrame([("i", "t", "6", 0, 5, 0.5, 0.5), ("i", "t", "11", 0, 9, 0.5, 0.5), ("i", "t", "4", 0, 9, 0.4, 0.5)], c)).head()
    assert best["psm"] == "11"


def test_store_transforms(spark):
    pages = spark.createDataFrame([("p1", "d1"), ("p2", "d2")], "id string, document_id string")
    new = spark.createDataFrame([("p3", "d1")], "id string, document_id string")
    assert {r["id"] for r in store.replace_pages(pages, new, new).collect()} == {"p2", "p3"}
    made = store.create(spark.createDataFrame([("  ", T0), ("B", T0)], "name string, created_at timestamp"), "client", "Nouveau client").collect()
    assert {r["name"] for r in made} == {"Nouveau client", "B"} and all(r["id"].startswith("client_") and len(r["id"]) == 19 for r in made)
    users = spark.createDataFrame([("u", ["a"]), ("v", None)], "id string, ids array<string>")
    got = {r["id"]: r["ids"] for r in store.grant(users, "u", "ids", spark.createDataFrame([("b",), ("a",)], "id string")).collect()}
    assert got == {"u": ["a", "b"], "v": None}


def test_save_names_a_new_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = store.save(spark.range(3), path)
    before = store.current(spark, path)
    store.save(before.filter("id > 0"), path)
    assert store.current(spark, path).count() == 2
    assert spark.read.parquet(first).count() == 3  # readers of the old version are not disturbed


def test_apply_analysis_and_matter(spark):
    docs = spark.createDataFrame([("d1", "Le litige Morsure de chien avance.", "x.pdf", "", None, None, False, "t", "dt"), ("d2", None, "y.pdf", "Bail", None, "m9", True, None, None)], "id string, text string, filename string, type string, document_date date, matter_id string, matter_locked boolean, title string, doc_type string")
    matters = spark.createDataFrame([("m1", "c1", "Morsure de chien", None, T0), ("m2", "c1", "Autre", None, T0)], "id string, client_id string, name string, responsible string, created_at timestamp")
    got = {r["id"]: r for r in analysis.apply_analysis(analysis.analyse(docs, matters)).collect()}
    assert got["d1"]["matter_id"] == "m1" and got["d2"]["matter_id"] == "m9" and got["d2"]["doc_type"] == "Bail"
    none = analysis.apply_analysis(analysis.analyse(docs, matters.limit(0))).filter("id = 'd1'").head()
    assert none["matter_id"] is None


def test_payload_is_checked(spark):
    p = spark.createDataFrame([('{"title": " T ", "persons": ["a", "a", ""], "doc_date": "2020-13-01x"}',), ("no json",)], "j string").select(analysis.payload("j").alias("p")).collect()
    assert p[0]["p"]["title"] == "T" and p[0]["p"]["persons"] == ["a"] and p[0]["p"]["doc_date"] is None


def test_labels_keep_unknown_codes(spark):
    df = spark.createDataFrame([("d", "odd", None, 0.125, T0)], "id string, status string, quality string, confidence double, created_at timestamp")
    r = dashboard.labelled(df).head()
    assert (r["status_label"], r["quality_label"], r["percent"]) == ("odd", None, 13)


# --- orphans ---------------------------------------------------------------------------------------


def orphan_tables(spark, **rows):
    at = "created_at timestamp"
    schemas = {
        "clients": f"id string, name string, {at}", "matters": f"id string, client_id string, status string, {at}",
        "documents": f"id string, client_id string, matter_id string, {at}, _key string", "pages": f"id string, document_id string, {at}",
        "tasks": f"id string, matter_id string, {at}", "audit_logs": f"id string, action string, entity_id string, {at}",
    }
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in schemas.items()}


def test_orphan_reasons(spark):
    t1 = T0 + dt.timedelta(days=1)
    t = orphan_tables(
        spark,
        clients=[("C1", "a", T0)],
        matters=[("m1", "c1", "active", t1), ("m1", "c1", "active", t1 + dt.timedelta(9)), ("m2", None, "active", T0), ("m2", None, " Deleted", t1)],
        documents=[("d1", " c1 ", "M1", T0, "x"), ("d2", "c2", "m2", T0, None), ("d3", None, "  ", T0, None), ("d4", "c3", "m1", t1, None), ("d4", "c3", "m1", t1, None)],
        tasks=[("t1", "m3", T0), ("t2", "m1", None)],
        pages=[("p1", "d1", T0), ("p2", "nope", T0)],
        audit_logs=[("a", "delete_client", "C2", T0), ("b", "create_client", "c3", T0), ("c", "delete_matter", "m1", T0)],
    )
    got = {(r["table_name"], r["column_name"], r["row_id"]): r["reason"] for r in orphans.unsound_references(t).collect()}
    assert got == {
        ("documents", "matter_id", "d1"): "late", ("documents", "matter_id", "d2"): "deleted", ("documents", "client_id", "d2"): "deleted",
        ("documents", "client_id", "d4"): "missing", ("tasks", "matter_id", "t1"): "missing", ("pages", "document_id", "p2"): "missing",
    }


def test_orphan_cascade(spark):
    t = orphan_tables(
        spark,
        matters=[("m1", "gone", "active", T0)],
        documents=[("d1", None, "m1", T0, None), ("d2", None, None, T0, None)],
        pages=[("p1", "d1", T0), ("p2", "d2", T0)],
        tasks=[("t1", "m1", T0)],
    )
    got = {(r["table_name"], r["row_id"]): (r["kind"], r["depth"]) for r in orphans.cascade(t).collect()}
    assert got == {("matters", "m1"): ("direct", 0), ("documents", "d1"): ("inherited", 1), ("tasks", "t1"): ("inherited", 1), ("pages", "p1"): ("inherited", 2)}


def test_orphans_of_empty_tables(spark):
    t = orphan_tables(spark)
    assert orphans.unsound_references(t).count() == 0
    assert orphans.cascade(t).count() == 0


def test_hot_key_is_whole(spark):
    t = orphan_tables(spark, documents=[(f"d{i}", None, "lost", T0, None) for i in range(500)])
    assert orphans.unsound_references(t).filter(F.col("reason") == "missing").count() == 500


# --- intake, reprocessing, the whole corpus -------------------------------------------------------------

UPLOAD = "filename string, content binary, mime_type string, client_id string, matter_id string, type string, responsible string, document_date date, created_at timestamp"
MATTERS = "id string, client_id string, name string, responsible string, created_at timestamp"


def test_names_without_own_words_are_found(spark):
    """A matter whose name stands inside a word only, and one that has no word of its own."""
    docs = spark.createDataFrame([(1, "les parcs du canton", ["parcs", "canton"], [])], "id int, low_text string, words array<string>, labels array<string>")
    matters = spark.createDataFrame([("m1", "c", "Par", None, T0), ("m2", "c", "Zzz", None, T0), ("m3", "c", None, None, T0)], MATTERS)
    assert [(r["matter_id"], r["matter_score"]) for r in analysis.classify_matter(docs, matters).collect()] == [("m1", 0.35)]
    names = spark.createDataFrame([(f"m{i}", "parc") for i in range(5)], "matter_id string, name string")
    found = analysis.named_in(docs.selectExpr("id", "low_text", "false fiscal"), names, block=2)
    assert sorted(r["matter_id"] for r in found.collect()) == [f"m{i}" for i in range(5)]


def test_best_matter_against_every_pair(spark, monkeypatch):
    """Rare and common words, groups, names, ties, nulls and several blocks against a count of every pair."""
    rng = random.Random(5)
    words = [f"mot{i}" for i in range(40)]
    some = lambda n: [words[min(int(rng.expovariate(0.12)), 39)] for _ in range(n)]
    matters = [(f"m{i:03d}", "c", " ".join(some(rng.randint(0, 4))) or None, rng.choice([None, *words[:3]]), rng.choice([None, T0, T0 + dt.timedelta(rng.randint(0, 9))])) for i in range(150)]
    docs = []
    for i in range(120):
        t = " ".join(some(rng.randint(0, 9)))
        docs.append((i, t, list(dict.fromkeys(t.split())), rng.choice([[], ["fiscal"]])))
    want = {}
    for d, t, w, g in docs:
        best = []
        for m, _, name, who, at in matters:
            own = set(f"{name or ''} {who or ''}".split())
            hits = len(own & {*w, *g})
            named = bool(name) and name in t
            if hits or named:
                best.append((hits / max(len(own), 1) + (0.35 if named else 0.0), float("-inf") if at is None else -at.timestamp(), m))
        if best and max(best)[0] >= (0.22 if g else 0.14):
            want[d] = (max(best)[2], max(best)[0])
    rows = spark.createDataFrame(docs, "id int, low_text string, words array<string>, labels array<string>")
    table = spark.createDataFrame(matters, MATTERS)
    best = lambda block: rows.select("id", matters_of.finder(table, block)(F.col("low_text"), F.concat("words", "labels")).alias("b"), "labels").select("id", "b.*", matters_of.least_score(F.col("labels")).alias("least")).filter("matter_score >= least")
    assert {r["id"]: (r["matter_id"], r["matter_score"]) for r in analysis.classify_matter(rows, table).collect()} == want
    assert {r["id"]: (r["matter_id"], r["matter_score"]) for r in best(20).collect()} == want
    packed = matters_of.matter_words(table).toArrow()
    for common in (0, 3, 10):
        index = matters_of.MatterIndex(packed, common)
        got = list(index.best_of(pa.array([d[1] for d in docs]), pa.array([d[2] + d[3] for d in docs], pa.list_(pa.string()))))
        assert {d[0]: (b[2], b[0]) for d, b in zip(docs, got) if b and b[0] >= (0.22 if d[3] else 0.14)} == want


def test_documents_meet_matters_in_their_own_row(spark):
    """No row for each pair of a document and a matter, and no copy of the documents that is sent or written."""
    docs = spark.createDataFrame([(f"d{i}", "Litige avance.", "x.pdf", "", None, None, False) for i in range(40)], "id string, text string, filename string, type string, document_date date, matter_id string, matter_locked boolean")
    matters = spark.createDataFrame([(f"m{i}", "c", f"Litige {i}", None, T0) for i in range(30)], MATTERS)
    before = list(runtime._STAGED)
    done = analysis.analyse(docs, matters)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and runtime._STAGED == before
    assert {r["m"] for r in done.select(F.col("analysis.matter_id").alias("m")).collect()} == {"m9"}


def test_intake(spark):
    text = "Facture n 12 du 8 février 2019, total ttc 120 euros. Client Jean DUPONT. Le litige Morsure de chien avance bien."
    rows = [("a b.txt", text.encode(), "text/plain", None, None, "Auto", None, None, T0), ("x.png", b"1", "image/png", None, "m1", "Note", "R", None, T0), ("y.zip", None, None, "c9", None, None, None, None, T0), ("z.txt", b" ", "", None, None, "Auto", None, None, T0)]
    matters = spark.createDataFrame([("m1", "c1", "Morsure de chien", None, T0)], MATTERS)
    new = intake.intake(spark.createDataFrame(rows, UPLOAD), matters, "u")
    docs = {r["filename"]: r for r in new["documents"].collect()}
    a, x = docs["a b.txt"], docs["x.png"]
    assert (a["status"], a["matter_id"], a["client_id"], a["doc_type"], str(a["document_date"]), a["persons"], a["matter_locked"]) == ("indexed", "m1", "c1", "Facture", "2019-02-08", ["Jean DUPONT"], False)
    assert (x["status"], x["matter_id"], x["matter_locked"], x["type"], x["title"], x["analysis_method"]) == ("ocr_pending", "m1", True, "Note", "x.png", "")
    assert docs["y.zip"]["status"] == "error" and docs["z.txt"]["status"] == "low_quality"
    assert {(r["level"], r["message"].split(":")[0]) for r in new["alerts"].collect()} == {("warning", "x.png"), ("error", "y.zip"), ("warning", "z.txt")}
    assert sorted(r["details"]["status"] for r in new["audit_logs"].collect()) == ["error", "indexed", "low_quality", "ocr_pending"]
    assert {r["document_id"] for r in new["pages"].collect()} == {a["id"], docs["z.txt"]["id"]}
    assert new["documents"].schema == intake.intake(spark.createDataFrame([], UPLOAD), matters, "u")["documents"].schema


def test_reprocess_and_reanalyse(spark):
    matters = spark.createDataFrame([("m1", "c1", "Morsure de chien", None, T0)], MATTERS)
    rows = [("a.txt", b"Le litige Morsure de chien avance bien pour tous.", "text/plain", None, None, "Auto", None, None, T0), ("b.txt", b"Autre chose, sans rien de connu.", "text/plain", None, "m9", "Auto", None, None, T0)]
    new = {k: staged(v) for k, v in intake.intake(spark.createDataFrame(rows, UPLOAD), matters, "u").items()}
    a = new["documents"].filter("filename = 'a.txt'").head()["id"]
    fresh = spark.createDataFrame([(a, b"Note interne du 3 mars 2021 sur une analyse du dossier."), ("gone", b"x")], "id string, content binary")
    out = intake.reprocess(new["documents"], new["pages"], fresh, matters, "u", F.lit(T0))
    docs = {r["filename"]: r for r in out["documents"].collect()}
    assert len(docs) == 2 and docs["a.txt"]["doc_type"] == "Note" and docs["a.txt"]["matter_id"] is None and docs["b.txt"]["matter_id"] == "m9"
    assert {r["text"][:4] for r in out["pages"].collect()} == {"Note", "Autr"}
    assert [(r["id"], r["status"]) for r in out["report"].collect()] == [(a, "indexed")] and out["audit_logs"].head()["action"] == "reprocess"
    again = {r["filename"]: r for r in intake.reanalyse(new["documents"], new["pages"].limit(0), matters).collect()}
    assert again["a.txt"]["matter_id"] == "m1" and again["b.txt"]["title"] == new["documents"].filter("filename = 'b.txt'").head()["title"]
    once_more = {r["filename"]: r for r in intake.reanalyse(new["documents"].withColumn("matter_id", F.lit(None).cast("string")), new["pages"], matters).collect()}
    assert once_more["a.txt"]["matter_id"] == "m1"


# --- recognition engines and models ---------------------------------------------------------------------


@pytest.fixture
def fake_engines(monkeypatch):
    """One engine that reads well when the image is turned by two degrees, one that gives noise, one that fails."""
    good = "le certificat medical initial du patient constate une lesion a la suite de urgence".split()

    def turned():
        return lambda image, mode, angle: [(w, 95.0 if angle == 2 and mode == "6" else 30.0, 1, 1, 1, i // 4) for i, w in enumerate(good)] if image == b"page" else []

    def noisy():
        return lambda image, mode, angle: [("XQ", 0.5, 0, 0, 0, 0), ("trtrtrt", 0.6, 0, 0, 0, 1)]

    def failing():
        def run(image, mode, angle):
            raise ValueError("unreadable")

        return run

    monkeypatch.setitem(engines.ENGINES, "tesseract", engines.Engine(turned, lambda: True, ocr.MODES, filtered=False))
    monkeypatch.setitem(engines.ENGINES, "rapidocr", engines.Engine(noisy, lambda: True, ("rapid",)))
    monkeypatch.setitem(engines.ENGINES, "paddleocr", engines.Engine(failing, lambda: True, ("paddle",)))


def test_recognition_in_two_stages(spark, fake_engines):
    images = spark.createDataFrame([("a", b"page"), ("a", b"page"), ("b", b"other"), ("c", None)], "image_id string, content binary")
    got = engines.read_images(images, ["tesseract", "rapidocr", "paddleocr"]).collect()
    assert [(r["image_id"], r["engine"], r["psm"], r["angle"], r["quality"]) for r in got] == [("a", "tesseract", "6", 2, "good")]
    assert got[0]["raw_text"].count("\n") == 3 and engines.read_images(images.limit(0), ["tesseract"]).count() == 0


def test_waiting_documents_are_read(spark, fake_engines):
    row = lambda name, content, mime: (name, content, mime, None, None, "Auto", None, None, T0)
    up = spark.createDataFrame([row("x.png", b"page", "image/png"), row("y.png", b"no", "image/png"), row("z.pdf", b"%PDF /Type /Page", ""), row("t.txt", b"Un texte.", "")], UPLOAD)
    extracted = staged(files.extract(intake.uploaded(up)), "extracted")
    got = {r["filename"]: r for r in engines.read_waiting(extracted, ["tesseract"]).collect()}
    assert got["x.png"]["status"] == "indexed" and got["x.png"]["message"] == "OCR applique avec Tesseract, mode 6, apres correction d'inclinaison 2 degres." and len(got["x.png"]["pages"]) == 1
    assert (got["y.png"]["status"], got["y.png"]["pages"], got["y.png"]["message"]) == ("low_quality", [], engines.UNRELIABLE["image"])
    assert got["z.pdf"]["status"] == "ocr_pending" and got["t.txt"]["status"] == "indexed"  # no program draws PDF pages here
    pdf = {r["filename"]: r["id"] for r in extracted.select("id", "filename").collect()}["z.pdf"]
    drawn = spark.createDataFrame([(pdf, 1, b"page"), (pdf, 2, b"no"), (pdf, 3, b"page")], "id string, page_number int, content binary")
    read = engines.read_waiting(extracted, ["tesseract"], drawn).filter("filename = 'z.pdf'").head()
    assert (read["status"], [p["page_number"] for p in read["pages"]], read["page_count"], read["quality"]) == ("indexed", [1, 3], 3, "good")
    assert engines.read_waiting(extracted, []).filter("status = 'ocr_pending'").count() == 3


def test_engine_choice(fake_engines):
    assert engines.selected({}) == ["rapidocr", "tesseract"] and engines.selected({"DOCUMENT_OCR_ENGINE": "paddle"}) == ["paddleocr"] and engines.selected({"DOCUMENT_OCR_ENGINE": "none"}) == []
    assert engines.languages("List:\neng\nfra") == ("fra+eng", "") and engines.languages("List:\nfra")[0] == "fra" and engines.languages("")[1].startswith("Aucune") and engines.languages("x\neng")[1].startswith("Langue")


def test_engine_results():
    assert engines.parse_tsv("conf\ttext\tline_num\n96.5\tmot\t3\n\tvide\tx\n") == [("mot", 96.5, 0, 0, 0, 3), ("vide", -1.0, 0, 0, 0, 0)]

    class Page:
        def json(self):
            return {"res": {"rec_texts": ["a", "b"], "rec_scores": [0.5]}}

    assert engines.paddle_words([Page(), {"texts": ["c"], "scores": ["x"]}]) == [("a", 0.5, 0, 0, 0, 0), ("b", 0.0, 0, 0, 0, 1), ("c", 0.0, 0, 0, 0, 0)]


def test_a_model_beside_the_rules(spark, monkeypatch):
    def model():
        def run(prompts):
            assert all("Morsure" in p for p in prompts)
            return ['{"title": "Titre", "persons": ["A", "A", " "], "matter_id": "nowhere", "doc_date": "2020-13-99"}' if "chien" in p.split("Text:")[-1] else "no json" for p in prompts]

        return run

    monkeypatch.setitem(providers.MODELS, "fake", model)
    matters = spark.createDataFrame([("m1", "c1", "Morsure de chien", None, T0)], MATTERS)
    docs = spark.createDataFrame([("1", "La morsure de chien.", "f", "", None, None, False), ("2", "Autre.", "g", "", None, None, False), ("3", " ", "h", "", None, None, False)], "id string, text string, filename string, type string, document_date date, matter_id string, matter_locked boolean")
    got = {r["id"]: r["analysis"] for r in analysis.analyse_with_model(docs, matters, "fake").collect()}
    assert (got["1"]["title"], got["1"]["persons"], got["1"]["matter_id"], got["1"]["method"], got["1"]["confidence"], got["1"]["doc_date"]) == ("Titre", ["A"], "m1", "fake", 0.9, None)
    assert got["2"]["method"] == got["3"]["method"] == "local-rules" and analysis.analyse_with_model(docs, matters, "off").filter("analysis.method <> 'local-rules'").count() == 0


# --- joins and staging ------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, monkeypatch, how):
    from quillon import runtime

    rows = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 4 else f"k{i}") for i in range(80)], "id int, k string")
    side = spark.createDataFrame([("hot", 1), ("k0", 2), ("other", 3)], "k string, v int")
    want = sorted(map(tuple, rows.join(side, "k", how).collect()), key=str)
    monkeypatch.setattr(runtime, "small_enough", lambda df: False)
    assert sorted(map(tuple, runtime.spread_join(rows, side, "k", "id", how, salts=3).collect()), key=str) == want


def test_staged_tables_are_cleaned(spark):
    import os

    from quillon import runtime

    path = staged(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    before, runtime._STAGED[:] = runtime._STAGED[:-1], runtime._STAGED[-1:]
    runtime.clean(spark)
    assert not os.path.exists(path)
    runtime._STAGED[:] = before


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from quillon import runtime

    unset = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://x:7077", _jsc=SimpleNamespace(sc=lambda: unset)))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(fake)


def test_search_over_postings_is_the_same(spark, seed):
    index = staged(search.postings(seed, 4), "postings", "bucket")
    rights = access.Rights(("c1",), ("m1",))
    for query in ("morsure de chien", "attaque de chien ayant", "zzz", "", "de la"):
        want = search.search(seed, query, rights).collect()
        assert search.search_postings(index, seed, query, rights, buckets=4).collect() == want
    assert search.search_postings(index, seed, "chien", access.Rights(), buckets=4).count() == 0
    assert search.search_postings(index.limit(0), seed, "chien", rights, buckets=4).count() == 0


def test_public_state(spark):
    row = lambda *cols: spark.createDataFrame([("a", "open", T0), ("b", "done", dt.datetime(2021, 1, 1)), ("c", "indexed", None)], "id string, status string, created_at timestamp").withColumns({c: F.lit(None).cast("string") for c in cols})
    tables = {t: row() for t in ("clients", "matters", "users", "alerts", "audit_logs")} | {"documents": row("analysis_method"), "tasks": row("due_date"), "pages": row().withColumn("embedding", F.array(F.lit(1.0)))}
    state = dashboard.public_state(tables, "b", 2)
    assert [r["id"] for r in state["documents"].collect()] == ["b", "a", "c"] and [r["id"] for r in state["audit_logs"].collect()] == ["b", "a"]
    assert state["current_user"].count() == 1 and state["stats"].head()["open_tasks"] == 1 and state["stats"].head()["semantic_pages"] == 3
