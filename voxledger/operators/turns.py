"""Transcript lines into dialogues and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxledger.functions import text as T
from voxledger.session import written


def lines_of(turns: DataFrame, case: str = "case_id", order: str = "dialogue_no", speaker: str = "real_speaker", dialogue: str = "dialogue") -> DataFrame:
    """(case_id, page, line_no, line): what a transcript of typed turns looks like, a label and colon before the first line of each. Rows without dialogue give no line."""
    label = F.when(F.col(speaker).isNotNull(), F.concat(F.upper(F.col(speaker)), F.lit(": "))).otherwise(F.lit(""))
    return turns.select(F.col(case).alias("case_id"), F.col(order).alias("page"), F.posexplode(F.split(F.concat(label, F.col(dialogue)), "\n")).alias("line_no", "line"))


def assemble_turns(lines: DataFrame) -> DataFrame:
    """(case_id, dialogue_no, real_speaker, dialogue) of lines (case_id, page, line_no, line).

    A speaker line opens a turn and the lines after it belong to it, across pages;
    lines before the first one, clock lines and boilerplate are dropped, as are turns
    without text or that are only an unclear mark. A line is judged as a clock time
    with its line number, as boilerplate with and without: "7 11:30 AM" is text. Pages are opened one by one, and only the count of speaker
    lines is carried between them, so a case may have any length.
    """
    live = lines.where(F.col("line").isNotNull() & ~T.is_clock_line(F.col("line"))).select("case_id", "page", "line_no", T.drop_line_number(F.trim("line")).alias("line")).where((F.col("line") != "") & ~T.is_boilerplate(F.col("line")))
    opened = live.withColumn("opens", T.is_speaker_line(F.col("line")).cast("int"))
    pages = opened.groupBy("case_id", "page").agg(F.sum("opens").alias("n"))
    earlier = pages.select("case_id", "page", F.coalesce(F.sum("n").over(Window.partitionBy("case_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("case_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = opened.withColumn("here", F.sum("opens").over(within)).join(earlier, ["case_id", "page"]).withColumn("turn", F.col("earlier") + F.col("here")).where("turn > 0")
    rest = F.when(F.col("opens") == 1, F.trim(F.expr("substring(line, locate(':', line) + 1)"))).otherwise(F.col("line"))
    parts = numbered.select("case_id", "turn", "page", "line_no", rest.alias("part"), F.when(F.col("opens") == 1, T.clean_speaker(F.substring_index("line", ":", 1))).alias("speaker"))
    joined = F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "part"))), lambda x: x["part"]), lambda p: p != ""), " ")
    turns = parts.groupBy("case_id", "turn").agg(F.max("speaker").alias("real_speaker"), F.min("page").alias("page"), joined.alias("raw"))
    kept = turns.where((F.col("raw") != "") & ~T.is_boilerplate(F.col("raw"))).withColumn("dialogue", T.clean_text(F.col("raw"))).where(~F.col("dialogue").isin("unclear", "inaudible"))
    return numbered_within(written(kept.select("case_id", "turn", "page", "real_speaker", "dialogue")), "case_id", "page", "turn", "dialogue_no").select("case_id", F.col("dialogue_no").cast("int"), "real_speaker", "dialogue")


def numbered_within(rows: DataFrame, group: str, block: str, order: str, name: str) -> DataFrame:
    """rows with a number from 1 within the group, by block and order; a task orders one block, and only counts are carried over."""
    counts = rows.groupBy(group, block).agg(F.count("*").alias("n"))
    before = counts.select(group, block, F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(group, block).orderBy(order))
    return rows.withColumn("_here", here).join(before, [group, block]).withColumn(name, F.col("_before") + F.col("_here")).drop("_before", "_here")


def manifest(turns: DataFrame, folder: str = "audio") -> DataFrame:
    """(audio_filepath, text) per case: dialogues in order, joined by a bar."""
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dialogue_no", "dialogue"))), lambda x: x["dialogue"]), " | ")
    return turns.where("dialogue is not null").groupBy("case_id").agg(ordered.alias("text")).select(F.concat(F.lit(f"{folder}/"), "case_id", F.lit(".wav")).alias("audio_filepath"), "text")
