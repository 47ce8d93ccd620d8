"""Check digits as Spark SQL: each function takes and returns a Column; the weighted ones are SQL that other engines read too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the digits before the check digit.
PESEL = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON9 = (8, 9, 2, 3, 4, 5, 6, 7)
REGON14 = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)
ID_CARD = (7, 3, 1, 7, 3, 1, 7, 3)


def weighted_sql(s: str, weights, places=None) -> str:
    places = places or range(1, len(weights) + 1)
    return "(" + " + ".join(f"{w} * cast(substr({s}, {p}, 1) as int)" for w, p in zip(weights, places)) + ")"


def pesel_sql(s: str) -> str:
    return f"((10 - {weighted_sql(s, PESEL)} % 10) % 10 = cast(substr({s}, 11, 1) as int))"


def nip_sql(s: str) -> str:
    return f"({weighted_sql(s, NIP)} % 11 = cast(substr({s}, 10, 1) as int))"


def regon_sql(s: str, weights) -> str:
    return f"({weighted_sql(s, weights)} % 11 % 10 = cast(substr({s}, {len(weights) + 1}, 1) as int))"


def id_card_sql(s: str) -> str:
    letters = " + ".join(f"{w} * (ascii(substr({s}, {p}, 1)) - 55)" for w, p in zip(ID_CARD[:3], (1, 2, 3)))
    return f"(({letters} + {weighted_sql(s, ID_CARD[3:], (5, 6, 7, 8, 9))}) % 10 = cast(substr({s}, 4, 1) as int))"


def _of(value: Column, keep: str, shape: str, sql) -> Column:
    """Whether value, without what keep removes, has the shape and passes the check."""
    return F.exists(F.array(F.regexp_replace(value, keep, "")), lambda s: F.when(s.rlike(shape), _apply(sql, s)).otherwise(False))


def _digit(s: Column, place: int) -> Column:
    return F.substring(s, place, 1).cast("int")


def _sum(s: Column, weights) -> Column:
    return sum((_digit(s, k + 1) * w for k, w in enumerate(weights)), F.lit(0))


def _apply(check, s: Column) -> Column:
    return check(s)


def pesel(value: Column) -> Column:
    return _of(value, "$^", r"^\d{11}$", lambda s: (10 - _sum(s, PESEL) % 10) % 10 == _digit(s, 11))


def nip(value: Column) -> Column:
    return _of(value, r"(?U)[\s-]", r"^\d{10}$", lambda s: _sum(s, NIP) % 11 == _digit(s, 10))


def regon(value: Column) -> Column:
    nine = _of(value, "$^", r"^\d{9}$", lambda s: _sum(s, REGON9) % 11 % 10 == _digit(s, 9))
    return nine | _of(value, "$^", r"^\d{14}$", lambda s: _sum(s, REGON14) % 11 % 10 == _digit(s, 14))


def iban(value: Column) -> Column:
    """Letters are 10 to 35; the running remainder of 97 is folded over the rotated characters."""

    def check(s):
        turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
        step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
        return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1

    return _of(F.upper(value), r"(?U)\s", r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$", check)


def id_card(value: Column) -> Column:
    def check(s):
        letters = sum(((F.ascii(F.substring(s, k + 1, 1)) - 55) * w for k, w in enumerate(ID_CARD[:3])), F.lit(0))
        return (letters + sum((_digit(s, k + 5) * w for k, w in enumerate(ID_CARD[3:])), F.lit(0))) % 10 == _digit(s, 4)

    return _of(F.upper(value), r"(?U)\s", r"^[A-Z]{3}\d{6}$", check)
