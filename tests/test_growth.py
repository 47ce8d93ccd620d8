"""Plans whose work grows with the input only: texts searched once, nothing that grows sent to the driver, tasks that grow in number."""

import re

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import lexicon, spans
from cloakframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_searched_once_for_a_pattern(spark):
    found = spans.detect(spark.createDataFrame([(1, "AB1234567, x")], "doc_id long, text string"), ["paszporty"])
    assert [(r.start_pos, r.end_pos, r.value) for r in found.collect()] == [(0, 9, "AB1234567")]
    assert len(re.findall(r"RLIKE|regexp_replace", plan(found))) == 1 and "translate" not in plan(found)


@pytest.mark.parametrize("name", ["number_per_case", "number_per_document", "mapping_table", "rewrite_text", "restore_round_trip", "residual_tokens", "report_relation", "ai_prompt", "ai_prompt_per_file"])
def test_spans_and_texts_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(catalogue.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["number_per_case", "rewrite_text", "mapping_table"])
def test_spans_of_a_case_are_found_once(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    df.collect()
    assert plan(df).split("== Initial Plan")[0].count("Generate explode(aggregate") == 1


def test_spans_of_a_document_are_not_exchanged(spark):
    assert re.findall(r"Exchange \w+\(\w+", plan(catalogue.QUERIES["number_per_document"](spark, SF))) == ["Exchange hashpartitioning(o_orderkey"]


@pytest.mark.parametrize("name", ["lexicon_surname", "lexicon_city", "lemma_lookup"])
def test_words_stay_where_they_are(spark, name):
    """Only dictionaries are sent: words meet them by a broadcast join."""
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "BroadcastHashJoin" in text.split("Exchange hashpartitioning(o_orderkey")[0] and "SortMergeJoin" not in text.split("BroadcastExchange")[0]


def test_sentences_begin_by_what_is_before_the_word(spark):
    texts = ["Ala", " \tAla", "x. Ala", "x.\nAla", "x\n\nAla", "x\n\r\nAla", "x\n \nAla", "X Ala", "X.Ala", "x \n Ala", "Bo Ala. Bo\n\nAla"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start_pos): r.starts for r in lexicon.words(df, lexicon.WORD).collect()}

    def model(before):
        before = before.rstrip(" \t")
        return not before or before.endswith(("\n\n", "\n\r\n")) or (not before.endswith("\n") and before[-1] in ".!?")

    assert got == {(k, m.start()): model(t[: m.start()]) for k, t in enumerate(texts) for m in re.finditer(r"\b[A-Z]\w+\b", t)}


def test_a_first_name_takes_the_next_word_within_its_window(spark):
    lists = spark.createDataFrame([("first_name", "pl", "jan"), ("surname", "pl", "nowak")], "kind string, lang string, entry string")
    texts = ["x Jan  Kowal", "x Jan, Kowal", "x Jan" + " " * 38 + "Kowal", "x Jan" + " " * 39 + "Kowal", "x Jan Nowak", "Jan Jan Nowak", "Nowak"]
    got = sorted((r.doc_id, r.start_pos, r.value) for r in lexicon.persons(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lists).collect())
    assert got == sorted((k, m.start(), m[0]) for k, t in enumerate(texts) for m in _names(t))


def _names(text):
    for m in re.finditer(r"\b[A-Z]\w+\b", text):
        if m[0] == "Jan":
            after = re.match(r"\s+[A-Z]\w+", text[m.end() : m.end() + lexicon.WINDOW])
            yield re.compile(".*", re.S).match(text, m.start(), m.end() + (after.end() if after else 0))
        elif m[0] == "Nowak" and text[: m.start()].strip(" \t"):
            yield m
        elif m[0] == text:
            yield m


def test_larger_tables_make_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "TASK", 50)
    d = catalogue.dossier(spark, SF)
    assert d.rdd.getNumPartitions() == -(-d.count() // 50) > spark.sparkContext.defaultParallelism
    assert "Exchange" not in plan(d.groupBy("doc_id").agg(F.count("*"))).replace("Exchange hashpartitioning(o_orderkey", "")


def test_what_matches_begin_with_loses_none(spark):
    """Against the same patterns without the class in front, with letters that fold to ASCII ones."""
    odd = ["KRS 0000123456 Krs:1234567890", "nr ſprawy: A/1234, znak ſprawy: AB.12.24, ſygn. akt: II C 12/24", "tıktok.com/a TWİTTER.com/b @jan_1 X.COM/q", "+48 501 234 567 ١٢٣٤٥٦٧٨٩ \U0001d7cf\U0001d7d0-345", "FE80:0:0:0:0:0:0:1a 10.0.0.1", "PL 61 1090 1014 0000 0712 1981 2874", "Sąd rejonowy, ſąd okręgowy, URZĄD gminy", "HTTPS://a.b WWW.c", "a.b+c-d@e-f.pl @x.pl a@b.c.pl", "Aa-Bb Cc  Sp. z o.o. Dd S.A. Ee Ff GmbH", "WVWZZZ1JZXW123456 WVWZZZ1JZXW12345"]
    texts = odd + [r.text for r in catalogue.dossier(spark, SF).limit(20).collect()]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in spans.RECOGNISERS:
        plain = ("(?iU)" if r.folds_case else "(?U)") + r.pattern.replace("++", "+")
        assert df.where(spans.spans(F.col("text"), r.java) != spans.spans(F.col("text"), plain)).count() == 0, r
