"""Recognisers by pattern. The formats of the identifiers."""

from __future__ import annotations

from typing import NamedTuple

from ..functions import checksums


class Recogniser(NamedTuple):
    category: str
    pattern: str
    folds_case: bool = True
    valid: object = None
    #: What every match begins with, as a class: it is looked at first, which costs less than a boundary between Unicode words.
    first: str = ""

    @property
    def java(self) -> str:
        """With Unicode classes and boundaries."""
        flags = "(?iU)" if self.folds_case else "(?U)"
        return f"{flags}(?=[{self.first}])(?:{self.pattern})" if self.first else flags + self.pattern


SUFFIX = r"\b(sp\.\s?z\s?o\.?o\.?|s\.a\.|sp\.\s?k\.|sp\.\s?j\.|spółka\s?akcyjna|spółka\s?z\s?ograniczoną\s?odpowiedzialnością|ltd\.?|llc|gmbh|s\.r\.o\.?)\b"
RECOGNISERS = (
    Recogniser("pesel", r"\b\d{11}\b", True, checksums.pesel, first=r"\d"),
    Recogniser("nip", r"\b\d{3}[-\s]?\d{2,3}[-\s]?\d{2}[-\s]?\d{2,3}\b", True, checksums.nip, first=r"\d"),
    Recogniser("regon", r"\b\d{9}(\d{5})?\b", True, checksums.regon, first=r"\d"),
    Recogniser("iban", r"\b(PL\s?)?\d{2}(\s?\d{4}){6}\b", True, checksums.iban, first=r"P\d"),
    Recogniser("email", r"\b[\w.+-]++@[\w-]++\.[a-z]{2,}\b"),
    Recogniser("adresy_www", r"\b(https?://|www\.)[^\s,)]+", first=r"hw"),
    Recogniser("adresy_ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:[a-f0-9]{1,4}:){7}[a-f0-9]{1,4}\b", first=r"\da-f"),
    Recogniser("kody_pocztowe", r"\b\d{2}-\d{3}\b", first=r"\d"),
    Recogniser("telefony", r"(?<!\d)(\+48[\s-]?)?(\d{3}[\s-]\d{3}[\s-]\d{3}|\d{9})(?!\d)", first=r"+\d"),
    Recogniser("vin", r"(?=[A-HJ-NPR-Z0-9]{17}\b)\b(?=.*[A-HJ-NPR-Z])(?=.*\d)[A-HJ-NPR-Z0-9]{17}\b", False),
    Recogniser("tablice_rejestracyjne", r"\b[A-Z]{2,3}\s?[A-Z0-9]{4,5}\b", False, first=r"A-Z"),
    Recogniser("paszporty", r"\b[A-Z]{2}\d{7}\b", False, first=r"A-Z"),
    Recogniser("numery_dokumentow", r"\b[A-Z]{3}\d{6}\b", False, checksums.id_card, first=r"A-Z"),
    Recogniser("krs", r"\bKRS[\s:]?\d{10}\b|\b0{3}\d{7}\b", first=r"K0"),
    Recogniser("kw", r"\b[A-Z]{2}\d[A-Z]/\d{8}/\d\b", False, first=r"A-Z"),
    Recogniser("sygnatury_akt", r"\b[IVX]{1,4}\s?[A-Z]{1,3}\s?\d{1,5}/\d{2,4}\b", False, first=r"IVX"),
    Recogniser("numery_dzialek", r"\b(dzia[łl]k[a-zęó]*\s+(nr\.?|numer)?\s*)(\d{1,5}(/\d{1,4})?)\b", first=r"d"),
    Recogniser("e_doreczenia", r"\bAE:PL-[A-Z0-9]{5}-[A-Z0-9]{5}-[A-Z0-9]{5}-[A-Z0-9]{2}\b", False, first=r"A"),
    Recogniser("identyfikatory_medyczne", r"\bPWZ[\s:]?\d{7}\b", first=r"P"),
    Recogniser("konta_social", r"(?<!\w)@[A-Za-z0-9_.]{3,30}\b|\b(facebook|instagram|twitter|x|linkedin|tiktok)\.com/[A-Za-z0-9_.\-/]+", first=r"@fitxl"),
    Recogniser("prawo_jazdy", r"\bprawo jazdy\s+(nr\.?|numer)?\s*[:\-]?\s*([A-Z0-9]{5,15})\b", first=r"p"),
    Recogniser("sygnatury_adm", r"\b(sygn\.?\s?akt|nr\s?sprawy|znak\s?sprawy)[\s:]+([A-Za-z0-9./\-]{4,20})\b", first=r"snz"),
    Recogniser("adresy_pocztowe", r"\b(ul\.|al\.|pl\.|os\.)\s?[A-ZŁŚŻŹĆŃÓĄĘ][\wąćęłńóśźż.\-]*(\s[A-ZŁŚŻŹĆŃÓĄĘ0-9][\wąćęłńóśźż.\-]*)*\s+\d{1,4}[A-Za-z]?(/\d+)?\b", first=r"uapo"),
    Recogniser("firmy_instytucje", r"\b([A-ZŁŚŻŹĆŃÓĄĘ][\w\-]++(\s[A-Z][\w\-]++)?)\s++" + SUFFIX),
    Recogniser("firmy_instytucje", r"\b(urząd\s\w+|sąd\s(rejonowy|okręgowy|apelacyjny)|ministerstwo\s\w+|prokuratura\s\w+|starostwo\s\w+|urząd\s?gminy|urząd\s?miasta)\b", first=r"usmp"),
)
