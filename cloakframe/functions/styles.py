"""Placeholders by style, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.categories import CATEGORIES

STYLES = ("pelny_token", "etykieta", "inicjaly", "puste")
REMOVED = "[USUNIĘTE]"
INITIALS_OF = ("imiona_nazwiska", "firmy_instytucje")


def check(style: str) -> str:
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; one of {', '.join(STYLES)}")
    return style


def by_category(category: Column, field: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c.code, getattr(c, field))]), category)


def letters(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA: seven steps hold any int."""
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.chr(65 + (a["n"] - 1) % 26), a["o"]).alias("o"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(n.cast("long").alias("n"), F.lit("").alias("o")), step, lambda a: a["o"])


def masked(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(value, -2, 2)))


def initials(value: Column) -> Column:
    words = F.filter(F.split(value, r"(?U)\s+"), lambda w: (F.length(w) >= 2) & w.rlike(r"^\p{Lu}"))
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), " ")).otherwise(masked(value))


def placeholder(style: str, category: Column, number: Column, value: Column) -> Column:
    check(style)
    if style == "pelny_token":
        return F.concat(F.lit("["), by_category(category, "prefix"), F.lit("_"), number.cast("string"), F.lit("]"))
    if style == "etykieta":
        return F.concat(by_category(category, "label"), F.lit(" "), letters(number))
    if style == "inicjaly":
        return F.when(category.isin(*INITIALS_OF), initials(value)).otherwise(masked(value))
    return F.lit(REMOVED)
