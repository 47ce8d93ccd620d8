"""Stable numbers for values, per document or across a case, by aggregation and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.styles import check, placeholder
from .spans import once, shuffled


def number(found: DataFrame, scope: str = "doc_id", order=("doc_id", "start_pos")) -> DataFrame:
    """found with number and first_value: a key is (category, lower-case value); numbers follow first occurrences.

    The spans are dealt by their key once. Both the reduction of keys to their first place and the join back read that one
    exchange, so what finds the spans runs once, and a large case ranks its distinct values only.
    """
    key = [scope, "category", "_key"]
    rows = found.withColumn("_key", F.lower("value")).repartition(*[F.col(c) for c in key])
    # The whole row is in the minimum and in the condition, which holds for any, so that both readers of the exchange ask for the same
    # columns whatever is read later; otherwise the spans would be found twice.
    rest = [c for c in rows.columns if c not in {*key, *order, "value"}]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, F.col("value").alias("_v"), *rest)).alias("_first"))
    first = first.withColumn("number", F.row_number().over(Window.partitionBy(scope, "category").orderBy("_first"))).withColumn("first_value", F.col("_first._v"))
    same = " and ".join(f"f.{c} <=> g.{c}" for c in key) + f" and hash({', '.join(f'f.`{c}`' for c in rows.columns)}, g.number) >= {-(1 << 31)}"
    out = rows.alias("f").join(shuffled(first.alias("g")), F.expr(same)).select("f.*", "g.number", "g.first_value")
    return out.drop("_key")


def number_rows(rows: DataFrame, style: str = "pelny_token") -> DataFrame:
    """rows (_m: an array of matches by place) with _z, the matches with end, number, first_value and placeholder, each row a scope of
    its own: no exchange."""
    check(style)
    key = lambda m: F.concat(m["category"], F.lit("\u0001"), F.lower(m["value"]))
    rows = once(rows, F.transform("_m", key), "_q")
    rows = once(rows, F.array_distinct("_q"), "_k")
    of = lambda k: F.substring_index(k, "\u0001", 1)
    ranked = F.flatten(F.transform(F.array_distinct(F.transform("_k", of)), lambda c: F.transform(F.filter("_k", lambda k: of(k) == c), lambda k, i: F.struct(k.alias("k"), (i + 1).cast("int").alias("n")))))
    rows = once(rows, ranked, "_n")
    rows = once(rows, F.transform("_n", lambda e: e["k"]), "_o")

    def named(m, i):
        k = F.element_at("_q", (i + 1).cast("int"))
        n = F.element_at("_n", F.array_position("_o", k).cast("int"))["n"]
        first = F.element_at("_m", F.array_position("_q", k).cast("int"))["value"]
        return F.struct(m["start"].alias("start_pos"), (m["start"] - m["less"]).alias("end_pos"), m["category"].alias("category"), m["value"].alias("value"), n.alias("number"), first.alias("first_value"), placeholder(style, m["category"], n, first).alias("placeholder"))

    return once(rows, F.transform("_m", named), "_z").drop("_q", "_k", "_n", "_o")


def placeholders(numbered: DataFrame, style: str = "pelny_token", scope: str = "doc_id", order=("doc_id", "start_pos"), compatible: bool = False) -> DataFrame:
    """numbered with placeholder. Different values with equal initials get (2), (3) and so on; compatible gives all but the
    first (2), so that the last one's mapping wins."""
    check(style)
    out = numbered.withColumn("placeholder", placeholder(style, F.col("category"), F.col("number"), F.col("first_value")))
    if style != "inicjaly":
        return out
    place = F.min(F.struct(*order)).alias("_at")
    values = out.groupBy(scope, "placeholder", "category", "first_value").agg(place)
    rank = F.row_number().over(Window.partitionBy(scope, "placeholder").orderBy("_at"))
    values = values.withColumn("_n", F.least(rank, F.lit(2)) if compatible else rank).drop("_at")
    on = [scope, "placeholder", "category", "first_value"]
    out = out.join(shuffled(values), on)
    return out.withColumn("placeholder", F.when(F.col("_n") > 1, F.concat("placeholder", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("placeholder"))).drop("_n")


def mapping(named: DataFrame, scope: str = "doc_id", order=("doc_id", "start_pos")) -> DataFrame:
    """(scope, placeholder, value, category): the first spelling; of values that share a placeholder the last one's."""
    first = named.groupBy(scope, "placeholder", "first_value", "category").agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(scope, "placeholder").agg(F.max_by("first_value", "_at").alias("value"), F.max_by("category", "_at").alias("category"))


def audit(found: DataFrame, scope: str = "doc_id", order=("doc_id", "start_pos")) -> DataFrame:
    """The mapping of removed values: a key for each occurrence, counted over the scope."""
    n = F.row_number().over(Window.partitionBy(scope).orderBy(*order))
    return found.select(scope, removed_key(n, F.col("category")).alias("placeholder"), "value", "category")


def removed_key(n: Column, category: Column) -> Column:
    return F.concat(F.lit("__usuniete_"), n.cast("string"), F.lit("__ ("), category, F.lit(")"))


def counts(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by, "category").agg(F.count("*").alias("n"))


def report(entries: DataFrame, scope: str = "doc_id") -> DataFrame:
    """Rows of a report: shown placeholder, category of removed values only, value; ordered by position in the scope."""
    removed = F.col("placeholder").startswith("__usuniete_")
    n = F.row_number().over(Window.partitionBy(scope).orderBy("placeholder"))
    category = F.when(removed, F.regexp_extract("placeholder", r"\(([^()]*)\)$", 1)).otherwise("-")
    return entries.select(scope, n.alias("row_no"), F.when(removed, F.lit("[USUNIĘTE]")).otherwise(F.col("placeholder")).alias("shown"), category.alias("category"), "value")
