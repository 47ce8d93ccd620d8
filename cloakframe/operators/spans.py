"""Span extraction and overlap resolution, inside one row: no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .categories import BY_CODE, chosen
from .patterns import RECOGNISERS, Recogniser

_OPEN, _CLOSE = "\u0001", "\u0002"
SPAN = "array<struct<start:int,end:int,value:string>>"
MATCH = "array<struct<start:int,prio:int,less:int,ord:int,category:string,value:string>>"


def clean(text: Column) -> Column:
    """The two marks can't be in a text; a character each keeps the offsets."""
    return F.replace(F.replace(text, F.lit(_OPEN), F.lit("\ufffd")), F.lit(_CLOSE), F.lit("\ufffd"))


def once(rows: DataFrame, value, name: str) -> DataFrame:
    """rows with a column: exploding an array of one keeps the optimiser from copying value into each place that uses it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def shuffled(rows: DataFrame) -> DataFrame:
    """rows for a join by exchange. They grow with the input, and sizes estimated from a small file that is built into large texts
    would have them sent to the driver and from there to every executor."""
    return rows.hint("merge")


def pieces(text: Column, pattern: str) -> Column:
    """What is before the first match, then each match, a mark and what is between it and the next one. A text without a match is one
    piece; either way it is searched once."""
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)


def value_of(piece: Column) -> Column:
    return F.substring_index(piece, _CLOSE, 1)


def rest_of(piece: Column) -> Column:
    """What follows a piece's match; the first piece has none and is all rest."""
    return F.substring_index(piece, _CLOSE, -1)


def folded(parts: Column) -> Column:
    """The matches of a text's pieces. parts is read once, so it may be an expression."""
    zero = F.struct(F.lit(-1).alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(a, part):
        end = a["pos"] + F.length(value_of(part))
        span = F.struct(a["pos"].alias("start"), end.alias("end"), value_of(part).alias("value"))
        later = F.struct((a["pos"] + F.length(part) - 1).alias("pos"), F.concat(a["out"], F.array(span)).alias("out"))
        return F.when(a["pos"] < 0, F.struct(F.length(part).alias("pos"), a["out"].alias("out"))).otherwise(later)

    return F.coalesce(F.aggregate(parts, zero, step, lambda a: a["out"]), F.array().cast(SPAN))


def spans(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap, as (start, end, value), by code points from 0. Every match is marked in one
    pass and the pieces are folded. A null text has none."""
    return folded(pieces(text, pattern))


def recognised(text: Column, r: Recogniser) -> Column:
    found = spans(text, r.java)
    return F.filter(found, lambda m: r.valid(m["value"])) if r.valid else found


def as_matches(found: Column, category: str, order: int) -> Column:
    priority = BY_CODE[category].priority if category in BY_CODE else 9
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(priority).alias("prio"), (m["start"] - m["end"]).alias("less"), F.lit(order).alias("ord"), F.lit(category).alias("category"), m["value"].alias("value"))).cast(MATCH)


def matches(text: Column, categories=None) -> Column:
    """The union of the chosen categories' recognisers; only those are in the plan."""
    codes = chosen(categories)
    text = clean(text)
    found = [as_matches(recognised(text, r), r.category, codes.index(r.category)) for r in RECOGNISERS if r.category in codes]
    return F.concat(*found) if found else F.array().cast(MATCH)


def resolve(found: Column) -> Column:
    """The earliest start wins, then priority, length and the categories' order; what overlaps a kept span goes."""
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast(MATCH).alias("kept"))
    step = lambda a, m: F.when(m["start"] >= a["end"], F.struct((m["start"] - m["less"]).alias("end"), F.concat(a["kept"], F.array(m)).alias("kept"))).otherwise(a)
    return F.aggregate(F.array_sort(found), zero, step, lambda a: a["kept"])


def found_in(text: Column, categories=None, extra: Column | None = None, resolved: bool = True) -> Column:
    """The matches of a text; extra: more of them, such as a language model's, of which the chosen categories count."""
    found = matches(text, categories)
    if extra is not None:
        wanted = chosen(categories)
        found = F.concat(found, F.filter(F.coalesce(extra, F.array().cast(MATCH)), lambda m: m["category"].isin(*wanted)))
    return resolve(found) if resolved else found


def detect(df: DataFrame, categories=None, resolved: bool = True, keys=("doc_id",), extra: Column | None = None) -> DataFrame:
    """One row for each span: keys, start_pos, end_pos, category, value. A null text has none. extra: more matches of a row,
    such as a language model's; those of other categories than the chosen ones are left out."""
    rows = df.select(*keys, F.explode(found_in(F.col("text"), categories, extra, resolved)).alias("m"))
    return rows.select(*keys, F.col("m.start").alias("start_pos"), (F.col("m.start") - F.col("m.less")).alias("end_pos"), "m.category", "m.value")
