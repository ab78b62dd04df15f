"""Queries of the eight training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxledger.llm import leaks, names, overlap, packing, pieces, splits, truncation, turns
from voxledger.llm.oracle import SQL
from voxledger.session import table, written

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every train record with a path."""
    return splits.group_records(table(spark, sf_dir, "train").select("row_id", "audio_path")).select("row_id", F.concat(F.lit("case"), F.col("component")).alias("group_case"))


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    groups = written(splits.group_records(table(spark, sf_dir, "train").select("row_id", "audio_path")))
    return groups, splits.plan_splits(groups, PROPORTIONS)


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every train record with a path."""
    groups, plan = _splits(spark, sf_dir)
    return splits.assign_splits(groups, PROPORTIONS, plan).select("row_id", F.concat(F.lit("case"), F.col("component")).alias("group_case"), "split")


def p1_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of train, and how many of them get another split once all records of validation and test are there too, and once the large groups are gone. Links of validation and test don't count."""
    groups, plan = _splits(spark, sf_dir)
    more = [table(spark, sf_dir, t).select("row_id", "audio_path") for t in ("validation", "test")]
    named = splits.name_nodes(more[0].union(more[1])).select("row_id", "audio_path", F.col("node").alias("component"))
    own = lambda g, p: splits.assign_splits(g, PROPORTIONS, p).where("component is not null").groupBy("component").agg(F.first("split").alias("split"))
    large = plan.where("entity is not null").select(F.col("entity").cast("bigint").alias("component"))
    before, after, fewer = own(groups, plan), own(groups.union(named), plan), own(groups.join(F.broadcast(large), "component", "left_anti").select("row_id", "audio_path", "component"), plan)
    both = before.join(after.withColumnRenamed("split", "_after"), "component", "left").join(fewer.withColumnRenamed("split", "_fewer"), "component", "left")
    moved = lambda c: F.sum((F.col("split") != F.col(c)).cast("bigint"))
    return both.agg(F.count("*").alias("n_groups"), F.coalesce(moved("_after"), F.lit(0)).alias("n_moved_by_more"), F.coalesce(moved("_fewer"), F.lit(0)).alias("n_moved_by_fewer"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and share of each split."""
    counts = p1_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_records"), F.countDistinct("group_case").alias("n_groups"))
    return counts.withColumn("share", F.col("n_records") / F.sum("n_records").over(Window.partitionBy(F.lit(1))))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all segments and train records over 30 seconds."""
    return pieces.oversized_pieces(table(spark, sf_dir, "segment_ctm"), table(spark, sf_dir, "train"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be cut."""
    return p2_pieces(spark, sf_dir).where("piece_no = 0").select("source_table", "item_id")


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every speaker label, and with how many other labels it shares it."""
    resolved = names.resolve_labels(names.distinct_labels(table(spark, sf_dir, "spk_dialg_json").select("real_speaker")), table(spark, sf_dir, "nicknames"))
    return resolved.withColumn("n_links", F.count("*").over(Window.partitionBy("entity")) - 1)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings of one person or organisation."""
    return names.variant_pairs(p3_entities(spark, sf_dir))


def _numbered(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    return turns.number_turns(turns.fragments(table(spark, sf_dir, "spk_dialg_json"), table(spark, sf_dir, "nicknames"), texts))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every clean turn begins and ends."""
    return turns.turn_rows(_numbered(spark, sf_dir)).select("case_id", F.col("first_dialogue_no").cast("int"), F.col("turn_in_row").cast("int"), F.col("last_dialogue_no").cast("int"))


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean turns with speaker and text."""
    return turns.turn_texts(_numbered(spark, sf_dir, texts=True))


def p4_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates of colon labels inside dialogues and of times, and whether they are slots of speakers and timestamps."""
    once = turns.placed(table(spark, sf_dir, "spk_dialg_json"))
    mined = turns.mine(once)
    nodes, _ = turns.mine_layouts(mined, turns.speakers_of(once, mined, table(spark, sf_dir, "nicknames")))
    slots = nodes.select(F.lit("speaker").alias("slot"), "layout", "n", F.col("is_speaker").alias("holds"))
    return slots.union(turns.clock_forms(mined).select(F.lit("timestamp"), "form", "n", "is_time"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split(*[table(spark, sf_dir, t) for t in ("train", "validation", "test")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a train and an evaluation row that hold the same utterance."""
    return _overlaps(spark, sf_dir).select(F.least("row_id_train", "row_id_eval").alias("row_id_a"), F.greatest("row_id_train", "row_id_eval").alias("row_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and case."""
    return overlap.report(_overlaps(spark, sf_dir))


def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequence of every document."""
    return packing.pack_items(packing.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the sequences are, by classes alone and with their room filled."""
    sized = written(packing.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    reports = [packing.fill_report(packing.pack_items(sized, fill_room=r)).select(F.lit(name).alias("packing"), "*") for name, r in (("classes", False), ("classes, room filled", True))]
    return reports[0].union(reports[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a passage of a held-out item, with the item."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each leaked item stands."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that were cut."""
    return truncation.truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut documents per source."""
    return truncation.shares(truncation.truncated(table(spark, sf_dir, "documents")))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text, whether it is cut and why."""
    return truncation.truncated(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares, "p1_moved": p1_moved, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_entities": p3_entities, "p4_found": p4_found, "p4_turns": p4_turns, "p4_layouts": p4_layouts, "p5_found": p5_found, "p5_report": p5_report, "p6_sequences": p6_sequences, "p6_fill": p6_fill, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_sources": p8_sources, "p8_documents": p8_documents}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
