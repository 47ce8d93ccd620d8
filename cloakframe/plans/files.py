"""Files in, files out: read, anonymise, write, with mappings and a report beside them, and the way back."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.styles import check
from ..operators import layout, numbering
from ..operators import rewrite as rw
from ..sources import docx, files, mapping_store
from . import api

#: What is added to a file's name.
ANONYMISED, PUBLISHED, RESTORED, MAPPING, REPORT, CASE = "_anon", "_anon_BIP", "_oryginal", "_mapowanie.enc", "_raport", "sprawa"


class Written(NamedTuple):
    files: list
    mappings: list
    reports: list
    counts: dict


def _stem(path):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def _layout(spark: SparkSession, path: str, keep: bool) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text, error) of every file under path, and with keep the runs of DOCX files, whose segments' texts are the lines of
    their text then, headers, footers and tables among them."""
    flat = files.read_files(spark, path).select(F.col("path").alias("doc_id"), "suffix", "text", "error")
    if not keep:
        return flat.select("doc_id", "text", "error"), None
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path)

    def extract(batches):
        for part in batches:
            rows = []
            for name, data in zip(part["path"], part["content"]):
                try:
                    rows += [(name, seg, kind, run, text) for seg, kind, run, text in docx.runs_of(bytes(data))]
                except Exception:  # noqa: BLE001  read_files has its error
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "kind", "run_no", "text"]).astype({"seg_no": "int32", "run_no": "int32"})

    runs = content.select("path", "content").mapInPandas(extract, "doc_id string, seg_no int, kind string, run_no int, text string")
    segment = runs.groupBy("doc_id", "seg_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda r: r["text"]), "").alias("t"))
    joined = segment.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "t"))), lambda x: x["t"]), "\n").alias("_whole"))
    both = flat.join(joined, "doc_id", "left")
    return both.select("doc_id", F.coalesce("_whole", "text").alias("text"), "error"), runs


def _by_segment(runs: DataFrame, named: DataFrame) -> DataFrame:
    """The spans of the joined text, by the segment that each is in; what crosses segments is cut to the parts, the first of which takes
    the placeholder."""
    size = runs.groupBy("doc_id", "seg_no").agg(F.sum(F.length("text")).alias("n"))
    arrays = size.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "n"))).alias("s"))
    ends = F.aggregate("s", F.array().cast("array<struct<seg_no:int,a:bigint,b:bigint>>"), lambda out, x: F.concat(out, F.array(_next(out, x))))
    place = arrays.select("doc_id", F.explode(ends).alias("p")).select(F.col("doc_id").alias("_d"), "p.*")
    hit = named.join(place, F.expr("doc_id = _d and end_pos > a and start_pos < b"))
    begins = F.col("start_pos") >= F.col("a")
    return hit.select("doc_id", "seg_no", F.greatest(F.col("start_pos") - F.col("a"), F.lit(0)).cast("int").alias("start_pos"), (F.least("end_pos", "b") - F.col("a")).cast("int").alias("end_pos"), F.when(begins, F.col("placeholder")).otherwise("").alias("placeholder"))


def _next(out, x):
    begin = F.when(F.size(out) > 0, F.element_at(out, -1)["b"] + 1).otherwise(F.lit(0).cast("bigint"))
    return F.struct(x["seg_no"].alias("seg_no"), begin.alias("a"), (begin + x["n"]).alias("b"))


def _rebuilt(spark: SparkSession, path: str, runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """(doc_id, content): DOCX files with their runs' new texts."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path).select(F.col("path").alias("doc_id"), "content")
    texts = runs.groupBy("doc_id").agg(F.collect_list(F.struct("seg_no", "run_no", "text")).alias("runs"))

    def build(batches):
        for part in batches:
            made = [docx.with_runs(bytes(c), {(r["seg_no"], r["run_no"]): r["text"] for r in rs}, p or "") for c, rs, p in zip(part["content"], part["runs"], part["prompt"])]
            yield pd.DataFrame({"doc_id": part["doc_id"], "content": made})

    return content.join(texts, "doc_id").join(prompts, "doc_id", "left").mapInPandas(build, "doc_id string, content binary")


def anonymise_files(
    spark: SparkSession, path: str, folder: str, password: str | None = None, one_case: bool = False, style: str = "pelny_token", categories=None, prompt: bool = False,
    page_numbers: bool = True, keep_layout: bool = False, published: bool = False, report: bool = False, **lists,
) -> Written:
    """Every file under path anonymised under folder, in its own format, as <stem>_anon; mappings beside them, encrypted, where a password
    is given: one for each file or, of one case, one for all. published: by labels, as <stem>_anon_BIP, without mappings.

    keep_layout replaces inside the runs of DOCX files; tables, headers and footers are anonymised too. prompt puts the placeholders' list
    before each text. Files that can't be read or written come back with their error; the others aren't held up. Names have to be
    unlike under path, as all are written to one folder.
    """
    style = check("etykieta" if published else style)
    source, runs = _layout(spark, path, keep_layout)
    docs = source.where("error is null").select("doc_id", "text", F.lit(CASE).alias("case_id"))
    scope = "case_id" if one_case else "doc_id"
    out = api.anonymise(docs, scope, style, categories, page_numbers=page_numbers or keep_layout, **lists)
    name = files.output_name(F.col("doc_id"), PUBLISHED if published else ANONYMISED)
    prompts = rw.prompts_per_file(out.texts, out.mapping, scope) if prompt else docs.select("doc_id", F.lit("").alias("prompt"))
    texts = out.texts.join(prompts, "doc_id", "left").select("doc_id", name.alias("name"), F.concat(F.coalesce("prompt", F.lit("")), "text_out").alias("text"))
    if keep_layout:
        blank = (lambda r: r) if page_numbers else layout.blank_page_numbers
        spliced = blank(layout.splice_runs(runs.select("doc_id", "seg_no", "run_no", "text"), _by_segment(runs, out.spans)))
        made = _rebuilt(spark, path, spliced, prompts).select(name.alias("name"), "content", F.lit(None).cast("string").alias("error"))
        flat = texts.where(~F.lower("name").endswith(".docx"))
        made = made.unionByName(files.encoded(flat))
    else:
        made = files.encoded(texts)
    failed = source.where("error is not null").select(name.alias("name"), F.lit(None).cast("binary").alias("content"), "error")
    done = files.write_bytes(made.unionByName(failed), folder).collect()
    mappings, reports = [], []
    label = F.lit(CASE) if one_case else _stem(F.col("doc_id"))
    if password is not None and not published:
        maps = out.mapping.groupBy(scope).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("placeholder", "value")))).alias("json"))
        maps = maps.select(F.concat(F.lit(CASE) if one_case else _stem(F.col(scope)), F.lit(MAPPING)).alias("name"), "json")
        mappings = files.write_bytes(mapping_store.encrypted_rows(maps, password), folder).collect()
    if report and not published:
        rows = numbering.report(out.mapping, scope).groupBy(scope).agg(F.array_sort(F.collect_list(F.struct("row_no", F.concat_ws("  |  ", "shown", "category", "value").alias("line")))).alias("r"))
        label = F.lit(CASE) if one_case else _stem(F.col(scope))
        shown = rows.select(F.concat(label, F.lit(f"{REPORT}.pdf")).alias("name"), F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))
        reports = files.write_bytes(files.encoded(shown), folder).collect()
    return Written(done, mappings, reports, {r["category"]: r["n"] for r in out.counts.collect()})


def restore_files(spark: SparkSession, path: str, mapping: str, password: str, folder: str) -> list:
    """The files under path with the values of the encrypted mapping, as <stem>_oryginal; a file whose mapping holds removed values only has
    an error."""
    known = mapping_store.read_mapping(spark, mapping, password)
    entries = spark.createDataFrame([(CASE, k, v) for k, v in known.items()], "case_id string, placeholder string, value string")
    source = files.read_files(spark, path)
    texts = source.where("error is null").select(F.col("path").alias("doc_id"), F.lit(CASE).alias("case_id"), F.col("text").alias("text_out"))
    back = rw.restore(texts, entries, "case_id")
    name = files.output_name(F.col("doc_id"), RESTORED)
    made = files.encoded(back.where("reversible").select(name.alias("name"), "text"))
    failed = back.where("not reversible").select(name.alias("name"), F.lit("the values were removed").alias("error"))
    failed = failed.unionByName(source.where("error is not null").select(files.output_name(F.col("path"), RESTORED).alias("name"), "error"))
    return files.write_bytes(made.unionByName(failed.select("name", F.lit(None).cast("binary").alias("content"), "error")), folder).collect()
