"""Named queries over the driver's tables, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums as ck
from ..functions import styles
from ..operators import layout, lexicon, numbering, spans
from ..operators import rewrite as rw
from . import api
from .dossier import DOSSIER

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Case files of one task.
TASK = 20_000


def dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case files built from orders, dealt by their key before they are built. One small file would be one task; larger tables
    make more tasks, not longer ones, and what groups or joins by doc_id later exchanges no texts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // TASK))
    rows = orders.repartition(tasks, "o_orderkey")
    return spark.sql(DOSSIER.replace("FROM orders", "FROM {orders}").replace("chr(10)", "'\\n'"), orders=rows)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ recognisers
def _values(df: DataFrame, category: str) -> DataFrame:
    """Before overlaps are resolved: each document's values and how often it has them."""
    found = spans.detect(df, [category], resolved=False)
    return found.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def _detect(name: str, category: str, relation: str, pattern: str, group: int = 0, keep: str = "true", before: str = "text", after: str = "v"):
    """pattern: for an engine without look-around, over before; after: the value of a match v."""
    source = f"WITH dossier AS ({DOSSIER}) " if relation == "dossier" else ""
    text = before.replace("text", "html") if relation == "pages" else before
    key = "page_id" if relation == "pages" else "doc_id"
    ORACLE[name] = f"""{source}SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, {after} AS value FROM
        (SELECT {key} AS doc_id, unnest(regexp_extract_all({text}, {quoted(pattern)}, {group})) AS v FROM {relation})) WHERE {keep} GROUP BY ALL"""

    def run(spark, sf_dir):
        if relation == "dossier":
            return _values(dossier(spark, sf_dir), category)
        rows = table(spark, sf_dir, relation)
        return _values(rows.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")) if relation == "pages" else rows.select("doc_id", "text"), category)

    QUERIES[name] = run


_WORDS = r"regexp_replace(text, '([\p{L}\p{N}_]+)', '⟦\1⟧', 'g')"
_BARE = "translate(v, '⟦⟧', '')"
_DIGITS = r"regexp_replace(text, '(\d+)', '⟨\1⟩', 'g')"
_detect("detect_email", "email", "documents", r"(?i)(?:^|[^\p{L}\p{N}_])([\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[a-z]{2,})", 1)
_detect("detect_email_dossier", "email", "dossier", r"(?i)(?:^|[^\p{L}\p{N}_])([\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[a-z]{2,})", 1)
_detect("detect_ip", "adresy_ip", "documents", r"(?i)\b(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:[a-f0-9]{1,4}:){7}[a-f0-9]{1,4}\b")
_detect("detect_www", "adresy_www", "pages", r"(?i)\b(?:https?://|www\.)[^\s,)]+")
_PHONE = r"(?:\+⟨48⟩[\s-]?)?(?:⟨\d{3}⟩[\s-]⟨\d{3}⟩[\s-]⟨\d{3}⟩|⟨\d{9}⟩)"
_detect("detect_phone", "telefony", "documents", _PHONE, before=_DIGITS, after="translate(v, '⟨⟩', '')")
_detect("detect_phone_dossier", "telefony", "dossier", _PHONE, before=_DIGITS, after="translate(v, '⟨⟩', '')")
_detect("detect_plate", "tablice_rejestracyjne", "documents", r"⟦[A-Z]{2,3}[A-Z0-9]{4,5}⟧|⟦[A-Z]{2,3}⟧\s⟦[A-Z0-9]{4,5}⟧", before=_WORDS, after=_BARE)
_detect("detect_pesel", "pesel", "dossier", r"\b\d{11}\b", keep=ck.pesel_sql("value"))
_detect("detect_nip", "nip", "dossier", r"\b\d{3}[-\s]?\d{2,3}[-\s]?\d{2}[-\s]?\d{2,3}\b", keep=f"length(regexp_replace(value, '[-\\s]', '', 'g')) = 10 AND {ck.nip_sql("regexp_replace(value, '[-\\s]', '', 'g')")}")
_detect("detect_regon", "regon", "dossier", r"\b\d{9}(?:\d{5})?\b", keep=f"CASE length(value) WHEN 9 THEN {ck.regon_sql('value', ck.REGON9)} ELSE {ck.regon_sql('value', ck.REGON14)} END")
_IBAN = "cast(substr({0}, 5, 24) || '2521' || substr({0}, 3, 2) AS decimal(38,0)) % 97 = 1"
_detect("detect_iban", "iban", "dossier", r"\bPL\d{26}\b", keep=_IBAN.format("value"))
_detect("detect_id_card", "numery_dokumentow", "dossier", r"\b[A-Z]{3}\d{6}\b", keep=ck.id_card_sql("value"))
for _name, _category, _pattern in (
    ("detect_postal", "kody_pocztowe", r"\b\d{2}-\d{3}\b"),
    ("detect_passport", "paszporty", r"\b[A-Z]{2}\d{7}\b"),
    ("detect_krs", "krs", r"(?i)\bKRS[\s:]?\d{10}\b|\b0{3}\d{7}\b"),
    ("detect_land_register", "kw", r"\b[A-Z]{2}\d[A-Z]/\d{8}/\d\b"),
    ("detect_case_number", "sygnatury_akt", r"\b[IVX]{1,4}\s?[A-Z]{1,3}\s?\d{1,5}/\d{2,4}\b"),
    ("detect_parcel", "numery_dzialek", r"(?i)\bdzia[łl]k[a-zęó]*\s+(?:nr\.?|numer)?\s*\d{1,5}(?:/\d{1,4})?\b"),
    ("detect_edelivery", "e_doreczenia", r"\bAE:PL-[A-Z0-9]{5}-[A-Z0-9]{5}-[A-Z0-9]{5}-[A-Z0-9]{2}\b"),
    ("detect_medical_id", "identyfikatory_medyczne", r"(?i)\bPWZ[\s:]?\d{7}\b"),
    ("detect_driving_licence", "prawo_jazdy", r"(?i)\bprawo jazdy\s+(?:nr\.?|numer)?\s*[:\-]?\s*[A-Z0-9]{5,15}\b"),
    ("detect_admin_ref", "sygnatury_adm", r"(?i)\b(?:sygn\.?\s?akt|nr\s?sprawy|znak\s?sprawy)[\s:]+[A-Za-z0-9./\-]{4,20}\b"),
    ("detect_address", "adresy_pocztowe", r"(?i)\b(?:ul\.|al\.|pl\.|os\.)\s?[A-ZŁŚŻŹĆŃÓĄĘ][\wąćęłńóśźż.\-]*(?:\s[A-ZŁŚŻŹĆŃÓĄĘ0-9][\wąćęłńóśźż.\-]*)*\s+\d{1,4}[A-Za-z]?(?:/\d+)?\b"),
    ("detect_vin", "vin", r"\b[A-HJ-NPR-Z0-9]{17}\b"),
):
    _detect(_name, _category, "dossier", _pattern)
_detect("detect_social", "konta_social", "dossier", r"(?:^|[^\p{L}\p{N}_])(@[A-Za-z0-9_.]{3,30}\b)", 1)
_detect("institution", "firmy_instytucje", "dossier", r"(?i)⟦urząd⟧\s⟦[\p{L}\p{N}_]+⟧|⟦(?:[\p{L}\p{N}_]+)⟧(?:\s⟦[\p{L}\p{N}_]+⟧)?\s+⟦sp⟧\.\s⟦z⟧\s⟦o⟧\.⟦o⟧", before=_WORDS, after=_BARE)


# Forms that the dossier lacks, by the remainder of a key.
_SOCIAL = "CASE o_orderkey % 5 WHEN 0 THEN 'twitter.com/user_' || o_orderkey WHEN 1 THEN 'linkedin.com/in/u-' || o_orderkey WHEN 2 THEN 'x.com/a.b' || o_orderkey WHEN 3 THEN '@ab' || o_orderkey ELSE 'mail@ab' || o_orderkey END"
_SUFFIXES = ("sp. z o.o.", "S.A.", "sp. k.", "sp. j.", "spółka akcyjna", "spółka z ograniczoną odpowiedzialnością", "Ltd.", "LLC", "GmbH", "s.r.o.", "inc.")
_PLACES = ("Urząd Skarbowy", "Sąd Rejonowy", "sąd okręgowy", "Sąd Apelacyjny", "Ministerstwo Finansów", "Prokuratura Krajowa", "Starostwo Powiatowe", "Sąd Najwyższy", "Urząd gminy")


def _of_orders(select: str) -> str:
    return f"SELECT o_orderkey AS doc_id, {select} AS text FROM orders"


def _picked(values, key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(values)) + " END"


def _over_orders(spark, sf_dir, select: str) -> DataFrame:
    return spark.sql(_of_orders(select).replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def _forms(name: str, category: str, select: str, value: str, keep: str) -> None:
    """A query over texts made by select, of which value is found where keep holds."""
    ORACLE[name] = f"SELECT doc_id, value, 1::BIGINT AS n FROM (SELECT o_orderkey AS doc_id, o_orderkey, {value} AS value FROM orders) WHERE {keep}"

    def run(spark, sf_dir):
        return _values(_over_orders(spark, sf_dir, select), category)

    QUERIES[name] = run


_forms("detect_social_profiles", "konta_social", f"'Profil: ' || {_SOCIAL} || ', koniec'", _SOCIAL, "o_orderkey % 5 < 4")
_forms("detect_vin_letters_and_digits", "vin", "'VIN ' || " + (_vin := "CASE o_orderkey % 4 WHEN 0 THEN 'WVWZZZJZXWABCDEFG' WHEN 1 THEN '12345678901234567' WHEN 2 THEN 'WVWZZZ1JZXW' || lpad(cast(o_orderkey % 1000000 AS string), 6, '0') ELSE 'WVWZZZ1JZXO' || lpad(cast(o_orderkey % 1000000 AS string), 6, '0') END") + " || '.'", _vin, "o_orderkey % 4 = 2")
_forms("company_suffix", "firmy_instytucje", f"'Umowa: Alpha Beta ' || {_picked(_SUFFIXES, 'o_orderkey')} || ' i koniec'", f"'Alpha Beta ' || rtrim({_picked(_SUFFIXES, 'o_orderkey')}, '.')", f"o_orderkey % {len(_SUFFIXES)} IN (0, 4, 5, 6, 7, 8, 9)")  # a form that ends with its dot needs a letter behind it
_forms("institution_kinds", "firmy_instytucje", f"'Pismo: ' || {_picked(_PLACES, 'o_orderkey')} || ', koniec'", _picked(_PLACES, "o_orderkey"), "o_orderkey % 9 <> 7")


# ------------------------------------------------------------------ checksums
_IDS = """SELECT o_orderkey AS doc_id, lpad(cast(44051400000 + o_orderkey * 7919 AS string), 11, '0') AS pesel, lpad(cast(1000000000 + o_orderkey * 104729 AS string), 10, '0') AS nip,
 lpad(cast(100000000 + o_orderkey * 7919 AS string), 9, '0') AS regon9, lpad(cast(10000000000000 + o_orderkey * 104729 AS string), 14, '0') AS regon14,
 'PL' || lpad(cast(o_orderkey % 97 AS string), 2, '0') || lpad(cast(o_orderkey * 104729 AS string), 24, '0') AS iban, 'ABS' || lpad(cast((o_orderkey * 7919) % 1000000 AS string), 6, '0') AS id_card FROM orders"""


def _checksum(name, column, check, sql):
    @query(f"checksum_{name}", f"SELECT doc_id, {column} AS value, {sql} AS valid FROM ({_IDS})")
    def run(spark, sf_dir):
        ids = spark.sql(_IDS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
        return ids.select("doc_id", F.col(column).alias("value"), check(F.col(column)).alias("valid"))


_checksum("pesel", "pesel", ck.pesel, ck.pesel_sql("pesel"))
_checksum("nip", "nip", ck.nip, ck.nip_sql("nip"))
_checksum("regon9", "regon9", ck.regon, ck.regon_sql("regon9", ck.REGON9))
_checksum("regon14", "regon14", ck.regon, ck.regon_sql("regon14", ck.REGON14))
_checksum("iban", "iban", ck.iban, _IBAN.format("iban"))
_checksum("id_card", "id_card", ck.id_card, ck.id_card_sql("id_card"))

# ------------------------------------------------------------------ spans, overlaps, numbers
#: Categories whose spans SQL can place: (code, pattern without look-around, filter), in the order that breaks ties.
PLACED = (
    ("paszporty", r"\b[A-Z]{2}\d{7}\b", "true"),
    ("kw", r"\b[A-Z]{2}\d[A-Z]/\d{8}/\d\b", "true"),
    ("tablice_rejestracyjne", r"\b[A-Z]{2,3}\s?[A-Z0-9]{4,5}\b", "true"),
    ("pesel", r"\b\d{11}\b", ck.pesel_sql("value")),
    ("regon", r"\b\d{9}(?:\d{5})?\b", f"CASE length(value) WHEN 9 THEN {ck.regon_sql('value', ck.REGON9)} ELSE {ck.regon_sql('value', ck.REGON14)} END"),
    ("kody_pocztowe", r"\b\d{2}-\d{3}\b", "true"),
    ("krs", r"\bKRS[\s:]?\d{10}\b|\b0{3}\d{7}\b", "true"),
    ("adresy_ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "true"),
    ("numery_dzialek", r"(?i)\bdzia[łl]k[a-zęó]*\s+(?:nr\.?|numer)?\s*\d{1,5}(?:/\d{1,4})?\b", "true"),
)
CODES = tuple(c for c, _, _ in PLACED)


def _placed_sql() -> str:
    parts = []
    for k, (code, pattern, keep) in enumerate(PLACED):
        priority = next(c.priority for c in spans.BY_CODE.values() if c.code == code)
        wrapped = quoted(("(?i)(" + pattern[4:] if pattern.startswith("(?i)") else "(" + pattern) + ")")
        parts.append(f"""SELECT doc_id, case_id, s::INTEGER AS s, (s + length(value))::INTEGER AS e, {priority} AS prio, {k} AS ord, '{code}' AS category, value FROM (
          SELECT doc_id, case_id, i, split_part(x, chr(2), 1) AS value, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - (i - 2) AS s FROM (
            SELECT doc_id, case_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (
              SELECT doc_id, case_id, string_split(regexp_replace(text, {wrapped}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM dossier))) WHERE i > 1 AND {keep}""")
    return " UNION ALL ".join(parts)


_BASE = f"""WITH RECURSIVE dossier AS ({DOSSIER}), m AS ({_placed_sql()}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, prio, s - e, ord) AS rn FROM m),
nx AS (SELECT a.doc_id, a.rn, min(b.rn) AS nxt FROM r a LEFT JOIN r b ON a.doc_id = b.doc_id AND b.s >= a.e GROUP BY a.doc_id, a.rn),
w AS (SELECT doc_id, 1::BIGINT AS rn FROM r WHERE rn = 1 UNION ALL SELECT w.doc_id, nx.nxt FROM w JOIN nx ON w.doc_id = nx.doc_id AND w.rn = nx.rn WHERE nx.nxt IS NOT NULL),
kept AS (SELECT r.* FROM r JOIN w ON r.doc_id = w.doc_id AND r.rn = w.rn)"""


def _numbered_sql(scope: str, order: str) -> str:
    return f"""{_BASE}, k AS (SELECT *, lower(value) AS lv FROM kept),
f AS (SELECT {scope} AS sc, category, lv, min(({order}s)) AS pos0, arg_min(value, ({order}s)) AS v0 FROM k GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY sc, category ORDER BY pos0)::INTEGER AS number FROM f),
z AS (SELECT k.*, n.number, n.v0, n.sc, '[' || {_case(lambda c: c.prefix)} || '_' || n.number || ']' AS token FROM k JOIN n ON k.{scope} = n.sc AND k.category = n.category AND k.lv = n.lv)"""


def _case(field) -> str:
    return "CASE k.category " + " ".join(f"WHEN '{c}' THEN {quoted(field(spans.BY_CODE[c]))}" for c in CODES) + " END"


_BY_DOC = _numbered_sql("doc_id", "")
_BY_CASE = _numbered_sql("case_id", "doc_id, ")
_CASE_ORDER = ("doc_id", "start_pos")


def _found(spark, sf_dir, resolved=True):
    return spans.detect(dossier(spark, sf_dir), CODES, resolved, keys=("doc_id", "case_id"))


@query("all_matches_union", f"{_BASE} SELECT doc_id, s AS start_pos, e AS end_pos, category, value FROM m")
def all_matches_union(spark, sf_dir):
    return _found(spark, sf_dir, False).drop("case_id")


@query("resolve_overlaps", f"{_BASE} SELECT doc_id, s AS start_pos, e AS end_pos, category, value FROM kept")
def resolve_overlaps(spark, sf_dir):
    return _found(spark, sf_dir).drop("case_id")


@query("number_per_document", f"{_BY_DOC} SELECT doc_id, s AS start_pos, category, value, number, token AS placeholder FROM z")
def number_per_document(spark, sf_dir):
    """A document is a row, so its matches are numbered where they are found and none is exchanged."""
    rows = spans.once(dossier(spark, sf_dir).select("doc_id", "text"), spans.found_in(F.col("text"), CODES), "_m")
    named = numbering.number_rows(rows).select("doc_id", F.explode("_z").alias("z"))
    return named.select("doc_id", "z.start_pos", "z.category", "z.value", "z.number", "z.placeholder")


@query("number_per_case", f"{_BY_CASE} SELECT case_id, doc_id, s AS start_pos, category, value, number, token AS placeholder FROM z")
def number_per_case(spark, sf_dir):
    named = numbering.placeholders(numbering.number(_found(spark, sf_dir), "case_id", _CASE_ORDER), scope="case_id", order=_CASE_ORDER)
    return named.select("case_id", "doc_id", "start_pos", "category", "value", "number", "placeholder")


@query("mapping_table", f"{_BY_CASE} SELECT DISTINCT case_id, token AS placeholder, v0 AS value, category FROM z")
def mapping_table(spark, sf_dir):
    return api.anonymise(dossier(spark, sf_dir), "case_id", categories=CODES).mapping


@query("audit_mapping", f"{_BASE} SELECT case_id, '__usuniete_' || row_number() OVER (PARTITION BY case_id ORDER BY doc_id, s) || '__ (' || category || ')' AS placeholder, value, category FROM kept")
def audit_mapping(spark, sf_dir):
    return api.anonymise(dossier(spark, sf_dir), "case_id", "puste", CODES).mapping


@query("counts_by_category", f"{_BASE} SELECT category, count(*) AS n FROM kept GROUP BY category")
def counts_by_category(spark, sf_dir):
    return numbering.counts(_found(spark, sf_dir))


@query("counts_all_categories")
def counts_all_categories(spark, sf_dir):
    return numbering.counts(spans.detect(dossier(spark, sf_dir)))


@query("counts_documents", None)
def counts_documents(spark, sf_dir):
    return numbering.counts(spans.detect(table(spark, sf_dir, "documents")), "doc_id")


def _rewritten_sql(shown: str) -> str:
    return f""", g AS (SELECT z.doc_id, z.s, substr(d.text, coalesce(lag(z.e) OVER o, 0) + 1, z.s - coalesce(lag(z.e) OVER o, 0)) || {shown} AS piece, z.e, d.text
  FROM z JOIN dossier d ON z.doc_id = d.doc_id WINDOW o AS (PARTITION BY z.doc_id ORDER BY z.s)),
t AS (SELECT doc_id, string_agg(piece, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS text_out, count(*) AS n_hits FROM g GROUP BY doc_id)"""


@query("rewrite_text", f"{_BY_CASE}{_rewritten_sql('z.token')} SELECT doc_id, text_out, n_hits FROM t")
def rewrite_text(spark, sf_dir):
    return api.anonymise(dossier(spark, sf_dir), "case_id", categories=CODES).texts.select("doc_id", "text_out", "n_hits")


_LETTER = "chr((64 + z.number)::INTEGER)"


@query("archive_mode", f"{_BY_DOC}{_rewritten_sql(f'(SELECT {_case(lambda c: c.label)} FROM (SELECT z.category) AS k(category)) || chr(32) || {_LETTER}')} SELECT doc_id, text_out FROM t")
def archive_mode(spark, sf_dir):
    return api.archive(dossier(spark, sf_dir), CODES).select("doc_id", "text_out")


@query("restore_round_trip", f"WITH dossier AS ({DOSSIER}) SELECT doc_id, text, true AS reversible FROM dossier")
def restore_round_trip(spark, sf_dir):
    out = api.anonymise(dossier(spark, sf_dir), "case_id", categories=CODES)
    return rw.restore(out.texts, out.mapping, "case_id")


_REPORT = f"""{_BY_CASE}, e AS (SELECT DISTINCT case_id, token AS placeholder, v0 AS value FROM z)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY placeholder)::INTEGER AS row_no, placeholder AS shown, '-' AS category, value FROM e"""


@query("report_relation", _REPORT)
def report_relation(spark, sf_dir):
    return numbering.report(mapping_table(spark, sf_dir), "case_id")


_PROMPT = quoted(rw.PROMPT).replace("\n", "' || chr(10) || '")
_AFTER = f"chr(10) || chr(10) || {quoted(rw.BOUNDARY)} || chr(10) || chr(10)"


@query("ai_prompt", f"{_BY_CASE}, e AS (SELECT DISTINCT case_id, token FROM z) SELECT case_id, {_PROMPT} || string_agg(token, ', ' ORDER BY token) || {_AFTER} AS prompt FROM e GROUP BY case_id")
def ai_prompt(spark, sf_dir):
    return mapping_table(spark, sf_dir).groupBy("case_id").agg(rw.prompt(F.collect_set("placeholder")).alias("prompt"))


@query("ai_prompt_per_file", f"{_BY_CASE}{_rewritten_sql('z.token')}, e AS (SELECT DISTINCT case_id, token FROM z), d2 AS (SELECT t.*, d.case_id FROM t JOIN dossier d ON t.doc_id = d.doc_id) SELECT d2.doc_id, {_PROMPT} || string_agg(token, ', ' ORDER BY token) || {_AFTER} AS prompt FROM d2 JOIN e ON d2.case_id = e.case_id AND contains(text_out, token) GROUP BY d2.doc_id")
def ai_prompt_per_file(spark, sf_dir):
    out = api.anonymise(dossier(spark, sf_dir), "case_id", categories=CODES)
    return rw.prompts_per_file(out.texts, out.mapping, "case_id")


@query("residual_tokens", f"{_BY_CASE} SELECT doc_id, token, count(*) AS n FROM z GROUP BY ALL")
def residual_tokens(spark, sf_dir):
    out = api.anonymise(dossier(spark, sf_dir), "case_id", categories=CODES).texts
    return out.select("doc_id", F.explode(F.regexp_extract_all("text_out", F.lit(rw.TOKEN), 0)).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ styles
_NAMES = """SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'James' WHEN 1 THEN 'Emma' WHEN 2 THEN 'Jana' ELSE 'Lucas' END || ' ' ||
 CASE c_custkey % 3 WHEN 0 THEN 'Kowalski' WHEN 1 THEN 'Dvorak' ELSE 'Kent' END AS value FROM customer"""


def _style(name, column, sql):
    @query(name, f"SELECT doc_id, value, {sql} AS shown FROM ({_NAMES})")
    def run(spark, sf_dir):
        return spark.sql(_NAMES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer")).select("doc_id", "value", column().alias("shown"))


_person, _n = lambda: F.lit("imiona_nazwiska"), lambda: F.col("doc_id") + 1
_style("style_token", lambda: styles.placeholder("pelny_token", _person(), _n(), F.col("value")), "'[OSOBA_' || (doc_id + 1) || ']'")
_style("style_label", lambda: styles.placeholder("etykieta", _person(), _n(), F.col("value")), "'Osoba ' || CASE WHEN doc_id < 26 THEN chr((65 + doc_id)::INTEGER) WHEN doc_id < 702 THEN chr((65 + (doc_id - 26) // 26)::INTEGER) || chr((65 + (doc_id - 26) % 26)::INTEGER) ELSE chr((65 + (doc_id - 702) // 676)::INTEGER) || chr((65 + (doc_id - 702) // 26 % 26)::INTEGER) || chr((65 + (doc_id - 702) % 26)::INTEGER) END")
_style("style_initials", lambda: styles.placeholder("inicjaly", _person(), _n(), F.col("value")), "substr(value, 1, 1) || '. ' || substr(split_part(value, ' ', 2), 1, 1) || '.'")
_style("style_mask", lambda: styles.placeholder("inicjaly", F.lit("email"), _n(), F.col("value")), "substr(value, 1, 2) || repeat('*', length(value) - 4) || substr(value, -2)")
_style("style_blank", lambda: styles.placeholder("puste", _person(), _n(), F.col("value")), "'[USUNIĘTE]'")


@query("placeholder_collisions", f"""WITH v AS (SELECT doc_id % 10 AS scope, doc_id AS start_pos, value FROM ({_NAMES})), f AS (SELECT scope, value, min(start_pos) AS pos0 FROM v GROUP BY ALL),
p AS (SELECT *, substr(value, 1, 1) || '. ' || substr(split_part(value, ' ', 2), 1, 1) || '.' AS ph FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY scope, ph ORDER BY pos0) AS k FROM p)
SELECT scope, CASE WHEN k > 1 THEN ph || ' (' || k || ')' ELSE ph END AS placeholder, value FROM n""")
def placeholder_collisions(spark, sf_dir):
    names = spark.sql(_NAMES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    found = names.select((F.col("doc_id") % 10).alias("scope"), F.col("doc_id").alias("start_pos"), F.lit("imiona_nazwiska").alias("category"), "value")
    named = numbering.placeholders(numbering.number(found, "scope", ("start_pos",)), "inicjaly", "scope", ("start_pos",))
    return numbering.mapping(named, "scope", ("start_pos",)).select("scope", "placeholder", "value")


# ------------------------------------------------------------------ dictionaries
LISTED = (("first_name", "uk", "james"), ("first_name", "uk", "emma"), ("first_name", "cz", "jana"), ("first_name", "uk", "lucas"), ("surname", "pl", "kowalski"), ("surname", "uk", "smith"), ("city", "uk", "london"), ("city", "cz", "praha"), ("city", "uk", "milton keynes"))
LANGS = ("pl", "uk", "cz")
_ONLY = "SELECT doc_id, value, count(*) AS n FROM ({}) GROUP BY ALL"


def _lists(spark):
    return spark.createDataFrame(LISTED, "kind string, lang string, entry string")


def _grouped(found):
    return found.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def _dossier_sql(select: str) -> str:
    return f"WITH dossier AS ({DOSSIER}) {select}"


@query("lexicon_city", _dossier_sql("SELECT doc_id, value, 1::BIGINT AS n FROM (SELECT doc_id, regexp_extract(text, 'przebywa w (London|Praha|Milton Keynes) od', 1) AS value FROM dossier)"))
def lexicon_city(spark, sf_dir):
    return _grouped(lexicon.cities(dossier(spark, sf_dir), _lists(spark), LANGS))


@query("lexicon_person_anchor", _dossier_sql("SELECT doc_id, value, 1::BIGINT AS n FROM (SELECT doc_id, regexp_extract(text, 'Sprawa: ((?:James|Emma|Jana|Lucas) [^,]+),', 1) AS value FROM dossier)"))
def lexicon_person_anchor(spark, sf_dir):
    lists = _lists(spark)
    return _grouped(lexicon.persons(dossier(spark, sf_dir), lists.where("kind = 'first_name'"), LANGS))


@query("lexicon_surname", _dossier_sql("SELECT doc_id, value, 1::BIGINT AS n FROM (SELECT doc_id, regexp_extract(text, 'Sprawa: [A-Za-z]+ (Kowalski|Smith),', 1) AS value FROM dossier) WHERE value <> ''"))
def lexicon_surname(spark, sf_dir):
    return _grouped(lexicon.persons(dossier(spark, sf_dir), _lists(spark).where("kind = 'surname'"), LANGS))


@query("lemma_lookup", _dossier_sql("SELECT doc_id, value, 1::BIGINT AS n FROM (SELECT doc_id, regexp_extract(text, 'przebywa w (London|Praha) od', 1) AS value FROM dossier) WHERE value <> ''"))
def lemma_lookup(spark, sf_dir):
    lemmas = spark.createDataFrame([("london", "londyn"), ("london", "londinium"), ("praha", "praga")], "form string, lemma string")
    lists = spark.createDataFrame([("city", "pl", "londyn"), ("city", "pl", "Praga ")], "kind string, lang string, entry string")
    return _grouped(lexicon.cities(dossier(spark, sf_dir), lists, LANGS, lemmas))


@query("sentence_start_guard", _dossier_sql("""SELECT doc_id, i AS place, CASE WHEN p = '' THEN true WHEN ends_with(p, chr(10) || chr(10)) THEN true WHEN ends_with(p, chr(10)) THEN false ELSE substr(p, -1, 1) IN ('.', '!', '?') END AS starts
FROM (SELECT doc_id, i, regexp_replace(substr(text, 1, i), '[ \t]+$', '') AS p FROM (SELECT doc_id, text, unnest(range(0, length(text)))::INTEGER AS i FROM dossier)
 WHERE regexp_matches(substr(text, i + 1, 1), '[A-ZŁŚŻŹĆŃÓĄĘ]') AND (i = 0 OR NOT regexp_matches(substr(text, i, 1), '[\\p{L}\\p{N}_]')))"""))
def sentence_start_guard(spark, sf_dir):
    """Whether a sentence begins there, for each capital that begins a word of a text."""
    capitals = lexicon.words(dossier(spark, sf_dir), rf"(?U)\b{lexicon.CAPITAL}")
    return capitals.select("doc_id", F.col("start_pos").alias("place"), "starts")


@query("isolated_value", f"SELECT doc_id, value, true AS alone FROM ({_NAMES})")
def isolated_value(spark, sf_dir):
    names = spark.sql(_NAMES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return names.select("doc_id", "value", lexicon.alone(F.concat(F.lit("\t "), "value", F.lit(" \n")), F.col("value")).alias("alone"))


# ------------------------------------------------------------------ texts
@query("drop_page_numbers", _dossier_sql(r"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_full_match(l, '\s*\d{1,4}\s*') AND NOT regexp_full_match(l, '(?i)\s*strona\s+\d+\s*(z|/)\s*\d+\s*')), chr(10)) AS text FROM dossier"))
def drop_page_numbers(spark, sf_dir):
    return dossier(spark, sf_dir).select("doc_id", rw.without_page_numbers(F.col("text")).alias("text"))


@query("strip_prompt", _dossier_sql("SELECT doc_id, text FROM dossier"))
def strip_prompt(spark, sf_dir):
    with_prompt = F.concat(rw.prompt(F.array(F.lit("[A_1]"))), F.col("text"))
    return dossier(spark, sf_dir).select("doc_id", rw.without_prompt(with_prompt).alias("text"))


@query("rtf_escape", r"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(l, ''), lambda c: CASE WHEN c IN ('\', '{', '}') THEN '\' || c WHEN c <> '' AND unicode(c) > 127 THEN '\u' || unicode(c) || '?' ELSE c END), '')), '\par' || chr(10)) AS rtf FROM documents""")
def rtf_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rw.rtf_escaped(F.col("text")).alias("rtf"))


@query("conversation_pii_by_role", r"""SELECT role, count(*) AS n_turns, sum(len(regexp_extract_all(text, '(?i)\b(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:[a-f0-9]{1,4}:){7}[a-f0-9]{1,4}\b'))
 + len(regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_])([\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[a-z]{2,})', 1))
 + len(regexp_extract_all(regexp_replace(text, '(\d+)', '⟨\1⟩', 'g'), '""" + _PHONE + r"""')))::BIGINT AS n_hits FROM conversations GROUP BY role""")
def conversation_pii_by_role(spark, sf_dir):
    hits = F.size(spans.matches(F.col("text"), ["email", "adresy_ip", "telefony"])).cast("long")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(hits).alias("n_hits"))


# ------------------------------------------------------------------ layout
_RUNS = "SELECT doc_id, 0 AS seg_no, k AS run_no, substr(text, k * 17 + 1, 17) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 16) // 17))::INTEGER AS k FROM dossier)"


def _runs(spark, sf_dir):
    last = F.floor((F.length("text") + 16) / 17).cast("int") - 1
    d = dossier(spark, sf_dir).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("run_no"))
    return d.select("doc_id", F.lit(0).alias("seg_no"), "run_no", F.substr("text", F.col("run_no") * 17 + 1, F.lit(17)).alias("text"))


_SPLICED = (("NIP ", 3, 13, "[NIP_1]"), ("KRS ", -1, 13, "[KRS_1]"))


def _cut_sql(mark: str, lo: int, hi: int, token: str) -> str:
    """A run without what the span covers, as a piece of SQL over text, run_no and the whole text."""
    s, e = f"(instr(whole, '{mark}') + {lo})", f"(instr(whole, '{mark}') + {hi})"
    return f"""CASE WHEN run_no * 17 + 17 <= {s} OR run_no * 17 >= {e} THEN text
 ELSE substr(text, 1, greatest({s} - run_no * 17, 0)) || CASE WHEN run_no = {s} // 17 THEN '{token}' ELSE '' END || substr(text, (least({e} - run_no * 17, length(text)) + 1)::BIGINT) END"""


@query("run_splice", _dossier_sql(f""", u AS ({_RUNS})
SELECT u.doc_id, seg_no, run_no, CASE WHEN run_no * 17 < instr(whole, 'KRS ') - 18 THEN {_cut_sql(*_SPLICED[0])} ELSE {_cut_sql(*_SPLICED[1])} END AS text
FROM u JOIN (SELECT doc_id, text AS whole FROM dossier) d ON u.doc_id = d.doc_id""").replace(") , u AS", "), u AS"))
def run_splice(spark, sf_dir):
    d = dossier(spark, sf_dir)
    z = [d.select("doc_id", F.lit(0).alias("seg_no"), (F.instr("text", m) + lo).alias("start_pos"), (F.instr("text", m) + hi).alias("end_pos"), F.lit(t).alias("placeholder")) for m, lo, hi, t in _SPLICED]
    return layout.splice_runs(_runs(spark, sf_dir), z[0].unionByName(z[1]))


def _boxes(spark, sf_dir):
    line = dossier(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    word = line.select("doc_id", "line", F.posexplode(F.split("l", " ")).alias("word_no", "text"))
    return word.select("doc_id", F.lit(0).alias("block"), F.lit(0).alias("par"), "line", "word_no", (F.col("word_no") * 10).alias("left"), (F.col("line") * 20).alias("top"), F.lit(9).alias("width"), F.lit(12).alias("height"), "text")


@query("ocr_flat_text", _dossier_sql("SELECT doc_id, text FROM dossier"))
def ocr_flat_text(spark, sf_dir):
    return layout.flat_text(_boxes(spark, sf_dir))


@query("box_overlap", _dossier_sql(r"""SELECT doc_id, s::INTEGER AS start_pos, 2::BIGINT AS n_boxes, 10 * (length(regexp_replace(substr(text, 1, s), '[^ ]', '', 'g')))::INTEGER AS "left", 0 AS top FROM (SELECT doc_id, text, length('Sprawa: ') AS s FROM dossier)"""))
def box_overlap(spark, sf_dir):
    d = dossier(spark, sf_dir)
    end = F.instr("text", ",") - 1
    m = d.select("doc_id", F.lit(8).alias("start_pos"), end.alias("end_pos"))
    return layout.covered_boxes(layout.flat_words(_boxes(spark, sf_dir)), m)


@query("page_value_dedupe", f"{_BASE} SELECT DISTINCT doc_id, 0 AS page_no, value FROM kept")
def page_value_dedupe(spark, sf_dir):
    return layout.page_values(_found(spark, sf_dir).withColumn("page_no", F.lit(0)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their e-mail and IP addresses, phones and plates replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return api.anonymise(docs, categories=["email", "adresy_ip", "telefony", "tablice_rejestracyjne"]).texts.select("doc_id", "text_out", "n_hits")


QUERIES["anonymise_documents"] = flagship
