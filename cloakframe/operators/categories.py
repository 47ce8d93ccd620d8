"""The categories of sensitive values: a small dimension that plans read at build time."""

from __future__ import annotations

from typing import NamedTuple


class Category(NamedTuple):
    code: str
    prefix: str
    label: str
    priority: int


#: Fixed values, in the order that breaks ties.
CATEGORIES = (
    Category("imiona_nazwiska", "OSOBA", "Osoba", 6),
    Category("telefony", "TELEFON", "Telefon", 4),
    Category("paszporty", "PASZPORT", "Paszport", 2),
    Category("nip", "NIP", "NIP", 0),
    Category("firmy_instytucje", "FIRMA", "Firma", 5),
    Category("miasta", "MIASTO", "Miasto", 7),
    Category("kw", "KW", "Księga wieczysta", 1),
    Category("tablice_rejestracyjne", "TABLICA_REJ", "Tablica rejestracyjna", 3),
    Category("adresy_www", "URL", "Adres WWW", 1),
    Category("pesel", "PESEL", "PESEL", 0),
    Category("email", "EMAIL", "E-mail", 1),
    Category("prawo_jazdy", "PRAWO_JAZDY", "Prawo jazdy", 4),
    Category("regon", "REGON", "REGON", 0),
    Category("iban", "IBAN", "Konto bankowe", 0),
    Category("kody_pocztowe", "KOD_POCZTOWY", "Kod pocztowy", 3),
    Category("sygnatury_akt", "SYGNATURA_AKT", "Sygnatura akt", 2),
    Category("identyfikatory_medyczne", "ID_MEDYCZNY", "Identyfikator medyczny", 4),
    Category("konta_social", "KONTO_SOCIAL", "Konto social", 4),
    Category("adresy_pocztowe", "ADRES", "Adres", 3),
    Category("numery_dokumentow", "DOKUMENT", "Dokument", 2),
    Category("vin", "VIN", "VIN", 0),
    Category("krs", "KRS", "KRS", 1),
    Category("adresy_ip", "IP", "Adres IP", 1),
    Category("numery_dzialek", "DZIALKA", "Działka", 4),
    Category("sygnatury_adm", "SYGNATURA_ADM", "Sygnatura adm.", 4),
    Category("e_doreczenia", "E_DORECZENIE", "E-doręczenie", 0),
)
BY_CODE = {c.code: c for c in CATEGORIES}
ALL = tuple(BY_CODE)


def chosen(codes=None) -> tuple[str, ...]:
    """The codes, or all if none is given; their order breaks ties. An unknown one is an error."""
    codes = tuple(codes or ALL)
    if unknown := [c for c in codes if c not in BY_CODE]:
        raise ValueError(f"unknown categories: {', '.join(unknown)}")
    return codes
