import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakframe import __main__ as cli
from cloakframe.operators import ner
from cloakframe.plans import api
from cloakframe.plans import files as plans
from cloakframe.sources import docx, files, mapping_store, pdf
from cloakframe.streaming import detect


def test_formats(spark, tmp_path):
    text = "żółw {a}\nb & c"
    (tmp_path / "a.txt").write_bytes(text.encode() + b"\xff")
    (tmp_path / "b.docx").write_bytes(files.docx_bytes(text))
    (tmp_path / "c.odt").write_bytes(files.odt_bytes(text))
    rtf = spark.createDataFrame([(text,)], "t string").select(files.rtf_document(F.col("t"))).first()[0]
    (tmp_path / "d.rtf").write_text(rtf)
    (tmp_path / "e.xyz").write_bytes(b"?")
    (tmp_path / "f.docx").write_bytes(b"broken")
    got = {r.path[-5:]: (r.text, r.error) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"][0] == text + "�"
    assert got["/d.rtf"[-5:]][0] == text and got["c.odt"][0] == text and got[".docx"] is not None
    assert got["e.xyz"][0] is None and "no extractor" in got["e.xyz"][1]
    docx = files.read_files(spark, str(tmp_path), "b.docx").first()
    assert docx.text == text
    assert files.read_files(spark, str(tmp_path), "f.docx").first().error


def test_names_and_dictionary(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" James \n\njames\nEmma\n")
    assert sorted(r.entry for r in files.dictionary(spark, str(tmp_path / "l.txt"), "first_name", "uk").collect()) == ["emma", "james"]
    assert spark.createDataFrame([("/x/y.z.txt",)], "p string").select(files.output_name(F.col("p"))).first()[0] == "y.z_anon.txt"


def test_encrypted_mapping(spark):
    box = mapping_store.encrypted(spark, {"[OSOBA_1]": "Żuk"}, "pw")
    assert mapping_store.decrypted(spark, box, "pw") == {"[OSOBA_1]": "Żuk"}
    for bad, password in ((box, "other"), (box[:-9] + b"AAAAAAAAA", "pw"), (b"x" * 20, "pw")):
        with pytest.raises(mapping_store.WrongPassword):
            mapping_store.decrypted(spark, bad, password)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.pl"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    assert detect.detect_stream(stream, ["email"]).isStreaming
    q = detect.anonymise_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["email"])
    q.awaitTermination(60)
    assert {r.doc_id: r.text_out for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "[EMAIL_1]", 2: None}


# ------------------------------------------------------------------ PDF, DOCX in place, whole plans
def test_pdf_round_trip():
    text = "Zażółć (a) \\ b\n" + "\n".join(f"wiersz {k}" for k in range(120))
    pages = pdf.pages_of(pdf.pdf_bytes(text))
    assert len(pages) == 3 and "\n".join(t for _, t, _ in pages) == text
    assert pdf.pages_of(pdf.pdf_bytes("")) == [(0, "", True)]
    assert pdf.wrapped("aa bb cccccc d", 5) == ["aa bb", "cccccc", "d"]


def docx_with(parts):
    """A file whose body has a paragraph of bold and plain runs, a page number and a table, and whose header has a name."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, b="": f'<w:r>{b}<w:t xml:space="preserve">{t}</w:t></w:r>'
    body = f'<w:p>{run("Pisz: jan", "<w:rPr><w:b/></w:rPr>")}{run("@firma.pl, proszę.")}</w:p><w:p>{run("12")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("ola@firma.pl")}</w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(files.docx_bytes("x"))) as old, zipfile.ZipFile(out, "w") as z:
        for n in old.namelist():
            z.writestr(n, f"<w:document {w}><w:body>{body}</w:body></w:document>" if n == "word/document.xml" else old.read(n))
        z.writestr("word/header1.xml", f'<w:hdr {w}><w:p>{run("Sprawa jan@firma.pl")}</w:p></w:hdr>')
        z.writestr("word/media/x.bin", b"\x00\x01")
    return out.getvalue()


def test_docx_in_place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(docx_with(None))
    out = plans.anonymise_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "pw", categories=["email"], keep_layout=True, page_numbers=False, prompt=True)
    assert [(r["name"], r["error"]) for r in out.files] == [("a_anon.docx", None)] and out.counts == {"email": 3}
    made = (tmp_path / "out" / "a_anon.docx").read_bytes()
    runs = docx.runs_of(made)
    assert [t for _, k, _, t in runs if k == "header"] == ["Sprawa [EMAIL_1]"] and [t for _, k, _, t in runs if k == "table"] == ["[EMAIL_2]"]
    texts = [t for _, k, _, t in runs if k == "body"]
    assert texts[-3:] == ["Pisz: [EMAIL_1]", ", proszę.", ""] and any("[EMAIL_1], [EMAIL_2]" in t for t in texts)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.read("word/media/x.bin") == b"\x00\x01" and b"<w:b" in z.read("word/document.xml")


@pytest.mark.parametrize("one_case", [False, True])
def test_files_there_and_back(spark, tmp_path, one_case):
    (tmp_path / "in").mkdir()
    texts = {"a.txt": "a@b.pl i c@d.pl", "b.docx": "c@d.pl\nkoniec", "c.odt": "a@b.pl", "d.rtf": "żółw a@b.pl", "e.pdf": "Napisz do nas na a@b.pl koniecznie"}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(files.WRITERS[name[2:]](text))
    (tmp_path / "in" / "f.xyz").write_bytes(b"?")
    out = plans.anonymise_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "pw", one_case, categories=["email"], report=True)
    got = {r["name"]: r["error"] for r in out.files}
    assert sorted(k for k, e in got.items() if e is None) == ["a_anon.txt", "b_anon.docx", "c_anon.odt", "d_anon.rtf", "e_anon.pdf"] and "no extractor" in got["f_anon.xyz"]
    assert len(out.mappings) == len(out.reports) == (1 if one_case else 5)
    mapping = "sprawa_mapowanie.enc" if one_case else "a_mapowanie.enc"
    (tmp_path / "again").mkdir()
    for name in texts if one_case else ["a.txt"]:
        made = name.replace(".", "_anon.")
        assert "a@b.pl" not in files.READERS[name[2:]]((tmp_path / "out" / made).read_bytes())
        (tmp_path / "again" / made).write_bytes((tmp_path / "out" / made).read_bytes())
    back = plans.restore_files(spark, str(tmp_path / "again"), str(tmp_path / "out" / mapping), "pw", str(tmp_path / "back"))
    assert all(r["error"] is None for r in back)
    for name, text in texts.items() if one_case else [("a.txt", texts["a.txt"])]:
        assert files.READERS[name[2:]]((tmp_path / "back" / name.replace(".", "_anon_oryginal.")).read_bytes()) == text
    with pytest.raises(mapping_store.WrongPassword):
        plans.restore_files(spark, str(tmp_path / "again"), str(tmp_path / "out" / mapping), "no", str(tmp_path / "back"))


def test_pages_and_formats(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(pdf.pdf_bytes("\n".join(f"wiersz numer {k}" for k in range(60))))
    (tmp_path / "q.pdf").write_bytes(b"broken")
    got = sorted((r.path[-5:], r.page, r.scan, r.error is None) for r in files.read_pages(spark, str(tmp_path)).collect())
    assert got[:2] == [("p.pdf", 0, False, True), ("p.pdf", 1, False, True)] and got[2][3] is False
    assert files.readable()["pdf"] and not files.readable().get("xyz")


def test_entities_of_a_model(spark):
    def load():
        def model(text):
            return [(text.index("Anna"), text.index("Anna") + 4, "persName"), (0, 2, "OTHER"), (0, 2, "ORG")] if "Anna" in text else []

        return model

    df = spark.createDataFrame([(1, "Pani Anna, a@b.pl"), (2, None), (3, "nic")], "doc_id long, text string")
    marked = ner.with_entities(df, load)
    out = {r.doc_id: r.text_out for r in api.anonymise(marked, categories=["email", "imiona_nazwiska"]).texts.collect()}
    assert out == {1: "Pani [OSOBA_1], [EMAIL_1]", 2: None, 3: "nic"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("CLOAKFRAME_PASSWORD", "pw")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a@b.pl")
    assert cli.main(["formats"]) == 0 and "pdf: yes" in capsys.readouterr().out
    assert cli.main(["case", str(tmp_path / "in"), str(tmp_path / "out"), "--categories", "email"]) == 0
    assert (tmp_path / "out" / "a_anon.txt").read_text() == "[EMAIL_1]"
    assert cli.main(["publish", str(tmp_path / "in"), str(tmp_path / "out"), "--categories", "email"]) == 0
    assert (tmp_path / "out" / "a_anon_BIP.txt").read_text() == "E-mail A"
    assert cli.main(["restore", str(tmp_path / "out" / "a_anon.txt"), str(tmp_path / "back"), str(tmp_path / "out" / "sprawa_mapowanie.enc")]) == 0
    assert (tmp_path / "back" / "a_anon_oryginal.txt").read_text() == "a@b.pl"
