"""Relations of documents that keep their layout: runs of a paragraph, word boxes of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rewrite import PAGE_NUMBER, PAGE_OF, spliced
from .spans import shuffled


def run_offsets(runs: DataFrame) -> DataFrame:
    """runs (doc_id, seg_no, run_no, text) with start_pos and end_pos in their segment."""
    end = F.sum(F.length("text")).over(Window.partitionBy("doc_id", "seg_no").orderBy("run_no"))
    return runs.withColumn("end_pos", end.cast("int")).withColumn("start_pos", F.col("end_pos") - F.length("text"))


def splice_runs(runs: DataFrame, replaced: DataFrame) -> DataFrame:
    """(doc_id, seg_no, run_no, text): a placeholder goes to the first run that its span touches, the other runs lose what the
    span covers. replaced: doc_id, seg_no, start_pos, end_pos, placeholder."""
    r = run_offsets(runs)
    z = replaced.select(F.col("doc_id").alias("_d"), F.col("seg_no").alias("_g"), F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"), "placeholder")
    hit = r.join(shuffled(z), F.expr("doc_id = _d and seg_no = _g and end_pos > _s and start_pos < _e"))
    first = F.row_number().over(Window.partitionBy("doc_id", "seg_no", "_s").orderBy("run_no")) == 1
    cut = F.struct((F.greatest("_s", "start_pos") - F.col("start_pos")).alias("start"), (F.least("_e", "end_pos") - F.col("start_pos")).alias("end"), F.when(first, F.col("placeholder")).otherwise("").alias("placeholder"))
    cuts = hit.select("doc_id", "seg_no", "run_no", cut.alias("c")).groupBy("doc_id", "seg_no", "run_no").agg(F.collect_list("c").alias("_c"))
    out = r.join(shuffled(cuts), ["doc_id", "seg_no", "run_no"], "left")
    return out.select("doc_id", "seg_no", "run_no", F.when(F.col("_c").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("_c"))).alias("text"))


def blank_page_numbers(runs: DataFrame) -> DataFrame:
    """runs with empty texts where their whole segment is a page number; spaces around it don't count."""
    segment = Window.partitionBy("doc_id", "seg_no").orderBy("run_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(segment), "")
    return runs.withColumn("_whole", whole).withColumn("text", F.when(F.col("_whole").rlike(PAGE_NUMBER) | F.col("_whole").rlike(PAGE_OF), "").otherwise(F.col("text"))).drop("_whole")


def flat_words(boxes: DataFrame) -> DataFrame:
    """boxes (doc_id, block, par, line, word_no, left, top, width, height, text) with start_pos and end_pos in the page's flat
    text: words of a line are parted by a space, lines by a line feed; blank words go."""
    b = boxes.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("block", "par", "line", "word_no")
    line = F.struct("block", "par", "line")
    b = b.withColumn("sep", F.when(F.lag("word_no").over(w).isNull(), "").when(F.lag(line).over(w) == line, " ").otherwise("\n"))
    end = F.sum(F.length("sep") + F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("end_pos", end.cast("int")).withColumn("start_pos", F.col("end_pos") - F.length("text"))


def flat_text(boxes: DataFrame) -> DataFrame:
    piece = F.struct("start_pos", F.concat("sep", "text").alias("t"))
    return flat_words(boxes).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "").alias("text"))


def covered_boxes(words: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, start_pos, n_boxes, left, top) for each span: the boxes of the words that it overlaps, and the first one's
    place."""
    m = found.select(F.col("doc_id").alias("_d"), F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"))
    hit = words.join(shuffled(m), F.expr("doc_id = _d and end_pos > _s and start_pos < _e"))
    box = F.min_by(F.struct("left", "top"), "start_pos")
    return hit.groupBy("doc_id", F.col("_s").alias("start_pos")).agg(F.count("*").alias("n_boxes"), box.alias("b")).select("doc_id", "start_pos", "n_boxes", "b.left", "b.top")


def page_values(found: DataFrame) -> DataFrame:
    """Each page's distinct values: what a page is searched for."""
    return found.select("doc_id", "page_no", "value").distinct()
