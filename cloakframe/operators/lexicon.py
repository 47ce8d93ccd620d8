"""Recognisers by dictionary: cities, persons by first name, surnames. Words are rows, dictionaries are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import clean, folded, once, pieces, rest_of, value_of

#: What a capitalised word begins and goes on with.
CAPITAL = "[A-ZŁŚŻŹĆŃÓĄĘ]"
REST = r"[\wąćęłńóśźż]"
CITY = rf"(?U)\b{CAPITAL}[\wąćęłńóśźż\-]+(\s{CAPITAL}[\wąćęłńóśźż\-]+){{0,2}}\b"
WORD = rf"(?U)\b{CAPITAL}{REST}+\b"
NEXT = rf"(?U)^\s+({CAPITAL}{REST}+)"
WINDOW = 40


def sentence_start(gap: Column, first: Column) -> Column:
    """Whether a sentence begins behind gap, what lies between a word and the one before it (first: the text's begin): nothing, an
    empty line or a sentence's end; a single line feed doesn't. A gap of blanks follows a word, which ends no sentence."""
    before = F.rtrim(gap, F.lit(" \t"))
    return F.when(before == "", first).when(F.endswith(before, F.lit("\n\n")) | F.endswith(before, F.lit("\n\r\n")), True).when(F.endswith(before, F.lit("\n")), False).otherwise(F.right(before, F.lit(1)).isin(".", "!", "?"))


def alone(text: Column, value: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "") == value


def entries(dictionary: DataFrame, kind: str, langs) -> DataFrame:
    """The distinct entries of a kind over the chosen languages; dictionary: kind, lang, entry. Entries are trimmed and folded to
    lower case; blanks go."""
    e = dictionary.where((F.col("kind") == kind) & F.col("lang").isin(*langs)).select(F.lower(F.trim("entry")).alias("entry"))
    return e.where("entry <> ''").distinct()


def words(df: DataFrame, pattern: str) -> DataFrame:
    """The matches of pattern, a row each: doc_id, start_pos, end_pos, value, form (lower-case), starts (a sentence begins there), only
    (it is all of the text) and tail (what follows up to the end of the next match, at most WINDOW characters). No row has a text."""
    rows = once(df.select("doc_id", "text"), pieces(clean(F.col("text")), pattern), "_p")
    rows = once(rows, folded(F.col("_p")), "_m")

    def word(m, i):
        gap, following = rest_of(F.get("_p", i)), F.get("_p", i + 2)
        behind = rest_of(F.get("_p", i + 1))
        tail = F.substring(F.concat(behind, F.coalesce(value_of(following), F.lit(""))), 1, WINDOW)
        only = F.when(F.size("_m") == 1, alone(F.col("text"), m["value"])).otherwise(False)
        return F.struct(m["start"].alias("start_pos"), m["end"].alias("end_pos"), m["value"].alias("value"), F.lower(m["value"]).alias("form"), sentence_start(gap, i == 0).alias("starts"), only.alias("only"), tail.alias("tail"))

    return rows.select("doc_id", F.explode(F.transform("_m", word)).alias("w")).select("doc_id", "w.*")


def forms(listed: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """(entry): the distinct forms that are listed, and the single words one of whose lemmas is. This is a dimension: it is made once
    and sent to the words, which are many and stay where they are."""
    if lemmas is None:
        return listed
    known = lemmas.join(listed, F.col("lemma") == F.col("entry"), "left_semi").select(F.lower("form").alias("entry"))
    return listed.unionByName(known.where(~F.contains("entry", F.lit(" ")))).distinct()


def _plain(found: DataFrame, category: str) -> DataFrame:
    return found.select("doc_id", "start_pos", "end_pos", F.lit(category).alias("category"), "value")


def cities(df: DataFrame, dictionary: DataFrame, langs=("pl",), lemmas: DataFrame | None = None) -> DataFrame:
    """One to three capitalised words that are listed as a whole; not where a sentence begins unless they are all of the text."""
    listed = forms(entries(dictionary, "city", langs), lemmas)
    found = words(df, CITY).where(~F.col("starts") | F.col("only"))
    return _plain(found.join(F.broadcast(listed), F.col("form") == F.col("entry"), "left_semi"), "miasta")


def persons(df: DataFrame, dictionary: DataFrame, langs=("pl",), lemmas: DataFrame | None = None) -> DataFrame:
    """A listed first name with the capitalised word that follows within a few characters; and listed surnames by themselves, where
    no sentence begins unless they are all of the text."""
    of = lambda kind, first: forms(entries(dictionary, kind, langs), lemmas).withColumn("first", F.lit(first))
    listed = of("first_name", True).unionByName(of("surname", False)).groupBy("entry").agg(F.max("first").alias("first"))
    found = words(df, WORD).join(F.broadcast(listed), F.col("form") == F.col("entry")).where(F.col("first") | ~F.col("starts") | F.col("only"))
    value = F.when(F.col("first"), F.concat("value", F.regexp_extract("tail", NEXT, 0))).otherwise(F.col("value"))
    found = found.withColumn("value", value).withColumn("end_pos", F.col("start_pos") + F.length("value"))
    return _plain(found, "imiona_nazwiska")


#: Recognisers by dictionary, by category: each takes (df, dictionary, langs, lemmas).
RECOGNISERS = {"miasta": cities, "imiona_nazwiska": persons}


def as_extra(found: DataFrame) -> DataFrame:
    """(doc_id, extra): matches to hand to spans.detect beside the patterns'."""
    from .categories import ALL, BY_CODE

    category = lambda f: F.element_at(F.create_map(*[F.lit(x) for c in ALL for x in (c, f(c))]), F.col("category"))
    m = F.struct(F.col("start_pos").alias("start"), category(lambda c: BY_CODE[c].priority).alias("prio"), (F.col("start_pos") - F.col("end_pos")).alias("less"), category(ALL.index).alias("ord"), "category", "value")
    return found.groupBy("doc_id").agg(F.collect_list(m).alias("extra"))
