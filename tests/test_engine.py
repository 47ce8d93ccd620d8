"""Detection, numbering, rewriting and restoring, against Python's re and small models of the rules."""

import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import checksums, styles
from cloakframe.operators import layout, lexicon, rewrite, spans
from cloakframe.operators.categories import BY_CODE, chosen
from cloakframe.operators.patterns import RECOGNISERS
from cloakframe.plans import api, catalogue

TEXTS = [
    "Numer PESEL: 44051401359 do weryfikacji. 11111111111", "NIP: 526-000-12-46, IBAN PL61109010140000071219812874", "ABS123456 ABA300000 ABS223456", "😀 żuk1@Firma2.example.com, 10.0.299.7",
    "KW WA1M/00000070/0 i KRS 0000123456, tel. +48 501 234 567 a501234567b", "ul. długa i szeroka 12a, 00-950, działka nr 12/4", "", None, "\u0001 WA 12345 \u0002", "Alpha Sp. z o.o. i Urząd Miasta",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def model(text, codes):
    """The rules in plain Python."""
    valid = {"pesel": lambda v: (10 - sum(int(c) * w for c, w in zip(v, checksums.PESEL)) % 10) % 10 == int(v[10])}
    valid["nip"] = lambda v: len(d := re.sub(r"[\s-]", "", v)) == 10 and sum(int(c) * w for c, w in zip(d, checksums.NIP)) % 11 == int(d[9])
    valid["regon"] = lambda v: sum(int(c) * w for c, w in zip(v, checksums.REGON9 if len(v) == 9 else checksums.REGON14)) % 11 % 10 == int(v[-1])
    turned = lambda x: x[4:] + x[:4]
    valid["iban"] = lambda v: bool(re.match("[A-Za-z]{2}", v)) and int("".join(str(int(c, 36)) for c in turned(re.sub(r"\s", "", v)))) % 97 == 1
    valid["numery_dokumentow"] = lambda v: sum((int(c, 36)) * w for c, w in zip(v[:3] + v[4:], checksums.ID_CARD)) % 10 == int(v[3])
    found = []
    for r in RECOGNISERS:
        if r.category in codes:
            for m in re.finditer(r.pattern, text, re.IGNORECASE if r.folds_case else 0):
                if valid.get(r.category, lambda v: True)(m[0]):
                    found.append((m.start(), BY_CODE[r.category].priority, m.start() - m.end(), codes.index(r.category), r.category, m[0]))
    last, out = -1, []
    for m in sorted(found):
        if m[0] >= last:
            out.append((m[0], m[0] - m[2], m[4], m[5]))
            last = m[0] - m[2]
    return out


def test_spans_equal_the_model(spark):
    codes = chosen()
    texts = TEXTS + [r.text for r in catalogue.dossier(spark, "/root/testdata/sf0.001").limit(60).collect()]
    got = {}
    for r in spans.detect(frame(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos, r.category, r.value))
    for k, t in enumerate(texts):
        text = (t or "").replace("\u0001", "�").replace("\u0002", "�")
        assert sorted(got.get(k, [])) == sorted(model(text, codes)), t


def test_unknown_category_and_style_fail():
    with pytest.raises(ValueError):
        chosen(["nothing"])
    with pytest.raises(ValueError):
        styles.check("nothing")


def test_equal_values_share_a_token_and_come_back(spark):
    df = frame(spark, ["a@b.pl i a@b.pl, c@d.pl", "c@d.pl"])
    out = api.anonymise(df, categories=["email"])
    assert {r.doc_id: r.text_out for r in out.texts.collect()} == {0: "[EMAIL_1] i [EMAIL_1], [EMAIL_2]", 1: "[EMAIL_1]"}
    case = api.anonymise(df.withColumn("case_id", F.lit(1)), "case_id", categories=["email"])
    assert {r.doc_id: r.text_out for r in case.texts.collect()} == {0: "[EMAIL_1] i [EMAIL_1], [EMAIL_2]", 1: "[EMAIL_2]"}
    back = rewrite.restore(case.texts, case.mapping, "case_id")
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in df.collect()}


def test_removed_values_cannot_come_back(spark):
    out = api.anonymise(frame(spark, ["a@b.pl"]), style="puste", categories=["email"])
    assert out.texts.first().text_out == styles.REMOVED
    back = rewrite.restore(out.texts, out.mapping, "doc_id").first()
    assert back.text is None and not back.reversible


def test_labels_beyond_z(spark):
    got = [r.x for r in spark.range(1, 800).select(styles.letters(F.col("id")).alias("x")).collect()]
    assert got[0] == "A" and got[25] == "Z" and got[26] == "AA" and got[701] == "ZZ" and got[702] == "AAA"


def test_names_guards_and_lemmas(spark):
    lists = spark.createDataFrame(catalogue.LISTED, "kind string, lang string, entry string")
    df = frame(spark, ["Rozmawiałem z James Smith o Praha.", "Kowalski przyszedł. Widziano go z Kowalski.", "Kowalski", "Koniec.\n\nLondon ma\nLondon.", None])
    people = sorted((r.doc_id, r.start_pos, r.value) for r in lexicon.persons(df, lists, ("pl", "uk")).collect())
    assert people == [(0, 14, "James Smith"), (0, 20, "Smith"), (1, 34, "Kowalski"), (2, 0, "Kowalski")]
    assert sorted((r.doc_id, r.value) for r in lexicon.cities(df, lists, ("cz", "uk")).collect()) == [(0, "Praha"), (3, "London")]
    whole = api.anonymise(df, categories=["imiona_nazwiska", "miasta"], dictionary=lists, langs=("pl", "uk", "cz")).texts
    assert {r.doc_id: r.text_out for r in whole.collect()}[0] == "Rozmawiałem z [OSOBA_1] o [MIASTO_1]."


def test_prompt_and_page_numbers(spark):
    df = spark.createDataFrame([("a\n 12 \nStrona 1 z 3\nb",)], "text string")
    assert df.select(rewrite.without_page_numbers(F.col("text"))).first()[0] == "a\nb"
    with_prompt = F.concat(rewrite.prompt(F.array(F.lit("[B_1]"), F.lit("[A_1]"))), F.lit("\n\nx"))
    assert "[A_1], [B_1]" in df.select(with_prompt).first()[0]
    assert df.select(rewrite.without_prompt(with_prompt)).first()[0] == "x"


def test_runs(spark):
    runs = spark.createDataFrame([(1, 0, 0, "Jan"), (1, 0, 1, " Kowalski"), (1, 0, 2, " x")], "doc_id long, seg_no int, run_no int, text string")
    z = spark.createDataFrame([(1, 0, 0, 12, "[OSOBA_1]")], "doc_id long, seg_no int, start_pos int, end_pos int, placeholder string")
    assert [r.text for r in layout.splice_runs(runs, z).orderBy("run_no").collect()] == ["[OSOBA_1]", "", " x"]


def test_partitions_do_not_matter(spark):
    df = catalogue.dossier(spark, "/root/testdata/sf0.001")
    one, many = (sorted(map(tuple, api.anonymise(df.repartition(n), "case_id", categories=["pesel", "email"]).texts.select("doc_id", "text_out").collect())) for n in (1, 7))
    assert one == many
