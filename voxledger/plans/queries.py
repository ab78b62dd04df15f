"""Queries of the transcript operators over the given tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.functions import text as T
from voxledger.functions import vectors as V
from voxledger.operators import align, scoring, splits, turns
from voxledger.plans.oracle import SQL
from voxledger.session import table
from voxledger.sources.files import parse_segments, parse_words, pending, report_lines, stem

#: Literals put after a dialogue, by turn_id, so that every pattern occurs.
EXTRAS = [" I'm sure we're done, i'll go", " um Uh you know well", " (12%) of 1192-1195 see Section 6A2", " [UNCLEAR] [noise] [INAUDIBLE] on", " at 11:30 AM, 12.5 of 1,000; 10:15:20:30 ok?", " the 1 st, 2 nd", "... so;: be it!", " Page 12b.'"]


def extra_text() -> Column:
    pick = F.element_at(F.array(*[F.lit(x) for x in EXTRAS]), (F.col("turn_id") % len(EXTRAS) + 1).cast("int"))
    return F.concat(F.col("dialogue"), pick)


def dialogues(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "spk_dialg_json").where("dialogue is not null").select("turn_id", extra_text().alias("t"))


def text_query(f: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: dialogues(s, d).select("turn_id", f(F.col("t")).alias("text"))


def fold(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.ascii_fold(F.col("text")).alias("text"))


def basic_normal(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "train").where("transcription is not null")
    return rows.select("row_id", T.basic_normal(F.concat(F.col("transcription"), F.lit(" (aside) [x] <y> A-b!"))).alias("text"))


def speakers(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "spk_dialg_json").where("real_speaker is not null")
    return rows.select("turn_id", T.clean_speaker(F.col("real_speaker")).alias("speaker"), T.speaker_key(F.col("real_speaker")).alias("folder"))


#: Lines put after a dialogue, by its number: clock times and numbers with and without line number.
MORE_LINES = ["\n7 11:30 AM", "\n11:30 AM IST", "\n9 42\n43", "\n12 and so on", "\nat 10:15:20:30 sharp", ""]


def plain_lines(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "spk_dialg_json").groupBy("case_id", "dialogue_no").agg(F.min_by(F.struct("real_speaker", "dialogue"), "turn_id").alias("r")).select("case_id", "dialogue_no", "r.*")
    more = F.element_at(F.array(*[F.lit(x) for x in MORE_LINES]), F.col("dialogue_no") % len(MORE_LINES) + 1)
    return turns.lines_of(rows.withColumn("dialogue", F.concat("dialogue", more)))


def line_kinds(s: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return plain_lines(s, d).groupBy(T.is_boilerplate(line).alias("boilerplate"), T.is_clock_line(line).alias("clock"), T.is_speaker_line(line).alias("speaker")).agg(F.count("*").alias("n"))


def dialogue_turns(s: SparkSession, d: str) -> DataFrame:
    return turns.assemble_turns(plain_lines(s, d))


def manifest(s: SparkSession, d: str) -> DataFrame:
    once = table(s, d, "spk_dialg_json").where("dialogue is not null").groupBy("case_id", "dialogue_no").agg(F.min_by("dialogue", "turn_id").alias("dialogue"))
    return turns.manifest(once)


def catalog_keys(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "case_catalog").where("mp3_format_link is not null")
    # every other recording also as if it were on the one host whose links are rewritten
    link = F.when(F.length("case_id") % 2 == 0, F.concat("mp3_format_link", F.lit("?at=www.dropbox.com&dl=0"))).otherwise(F.concat("mp3_format_link", F.lit("?dl=0")))
    return rows.select("case_id", F.concat_ws("_", "case_id", F.date_format("hearing_date", "yyyy_MM_dd")).alias("file_key"), T.direct_link(link).alias("link"))


def numbered_cases(s: SparkSession, d: str) -> DataFrame:
    """The catalog keyed anew in the order of its dates and links."""
    rows = table(s, d, "case_catalog").select(F.col("case_id").alias("was"), "hearing_date", "mp3_format_link").withColumn("case_id", F.lit("x"))
    return splits.case_keys(rows, "hearing_date", "was").select("was", "case_id")


def catalog_counts(s: SparkSession, d: str) -> DataFrame:
    present = lambda c: F.sum(F.col(c).isNotNull().cast("bigint"))
    return table(s, d, "case_catalog").agg(F.count("*").alias("n_cases"), present("transcript_link").alias("n_transcripts"), present("mp3_format_link").alias("n_recordings"))


def ctm_lines(s: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.col("transcript"), F.lit(" "), F.lit("<space>"))
    line = F.concat_ws(" ", F.concat(F.col("case_id"), F.lit("_"), F.col("seg_no").cast("string")), F.lit("1"), F.format_string("%.2f", "start_sec"), F.format_string("%.2f", F.col("end_sec") - F.col("start_sec")), text, F.lit("NA lex NA"))
    return table(s, d, "segment_ctm").select("segment_id", line.alias("line"))


def segments(s: SparkSession, d: str) -> DataFrame:
    once = table(s, d, "segment_ctm").groupBy("case_id", "seg_no").agg(F.min_by(F.struct("start_sec", "end_sec", "transcript"), "segment_id").alias("r")).select("case_id", "seg_no", "r.*")
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return once.select("case_id", "seg_no", ms("start_sec").alias("start_ms"), ms("end_sec").alias("end_ms"), F.replace("transcript", F.lit("<space>"), F.lit(" ")).alias("text"))


def segment_word_rows(s: SparkSession, d: str) -> DataFrame:
    """Words of the segments, each 400 ms long, from the segment's start on."""
    words = segments(s, d).select("case_id", "seg_no", "start_ms", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("k", "word"))
    return words.select("case_id", (F.col("seg_no").cast("bigint") * 100_000 + F.col("k")).alias("word_no"), "word", (F.col("start_ms") + F.col("k") * 400).alias("start_ms"), (F.col("start_ms") + F.col("k") * 400 + 400).alias("end_ms"))


def segment_words(s: SparkSession, d: str) -> DataFrame:
    joined = align.attach_words(segments(s, d).drop("text"), segment_word_rows(s, d))
    return joined.groupBy("case_id", "seg_no").agg(F.count("*").alias("n_words"), F.sum("word_no").alias("sum_word_no"), F.min("word_start_ms").alias("first_ms"), F.max("word_end_ms").alias("last_ms"))


def chunks(s: SparkSession, d: str) -> DataFrame:
    packed = align.pack_chunks(align.attach_words(segments(s, d).drop("text"), segment_word_rows(s, d)))
    return packed.withColumn("length", F.round((F.col("end_ms") - F.col("start_ms")) / 1000, 2)).withColumn("file_name", align.chunk_name(number="seg_no"))


def segment_speaker(s: SparkSession, d: str) -> DataFrame:
    once = table(s, d, "spk_dialg_json").where("dialogue is not null").groupBy("case_id", "dialogue_no").agg(F.min_by("dialogue", "turn_id").alias("dialogue"))
    lowered = once.select("case_id", "dialogue_no", F.lower("dialogue").alias("dialogue"))
    return align.attach_speaker(segments(s, d), lowered)


def vad_timeline(s: SparkSession, d: str) -> DataFrame:
    return align.timeline(segments(s, d).drop("text")).select("case_id", "seg_no", "new_start_ms", "new_end_ms")


def speech_length(s: SparkSession, d: str) -> DataFrame:
    return segments(s, d).groupBy("case_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.max("end_ms").alias("whole_ms"))


def split_members(s: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(table(s, d, "train").select("row_id", "speaker"), "speaker", F.col("row_id").cast("string"))


def split_counts(s: SparkSession, d: str) -> DataFrame:
    return split_members(s, d).groupBy("speaker", "split").agg(F.count("*").alias("n"))


def scored(s: SparkSession, d: str) -> DataFrame:
    """Evaluation transcripts as references; the hypothesis loses, changes and doubles words by position, and some say much that nobody said."""
    rows = table(s, d, "validation").where("transcription is not null")
    words = T.word_list(F.col("transcription"))
    at = lambda i: F.col("row_id") + i
    heard = F.transform(words, lambda w, i: F.when(at(i) % 11 == 5, "").when(at(i) % 7 == 3, "zz").when(at(i) % 13 == 1, F.concat(w, F.lit(" "), w)).when(F.col("row_id") % 17 == 0, F.concat(w, F.lit(" yy yy"))).otherwise(w))
    return rows.select(F.col("row_id").alias("id"), F.array_join(words, " ").alias("reference"), F.array_join(F.filter(heard, lambda w: w != ""), " ").alias("hypothesis"), "audio_path")


def scored_files(s: SparkSession, d: str) -> DataFrame:
    """The same by audio file: of rows that name one file the last counts."""
    rows = scored(s, d).withColumnRenamed("id", "row_no")
    return rows.select(F.coalesce(stem(F.col("audio_path")), F.col("row_no").cast("string")).alias("id"), "row_no", "reference", "hypothesis")


def wer_distance(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).select("id", F.size(T.word_list(F.col("reference"))).cast("bigint").alias("n"), scoring.word_distance(F.col("reference"), F.col("hypothesis")).alias("wrong"))


def alignment_detail(s: SparkSession, d: str) -> DataFrame:
    return scoring.detail(scored(s, d)).withColumn("path", F.array_join(F.transform("path", lambda x: F.concat_ws("-", x["ref_pos"], x["hyp_pos"])), " "))


def report_lines_(s: SparkSession, d: str) -> DataFrame:
    return report_lines(scoring.detail(scored_files(s, d)))


def corpus_wer(s: SparkSession, d: str) -> DataFrame:
    return scoring.error_rate(scored_files(s, d), kinds=False)


def corpus_counts(s: SparkSession, d: str) -> DataFrame:
    return scoring.error_rate(scored_files(s, d))


def corpus_wer_normal(s: SparkSession, d: str) -> DataFrame:
    """Rates over texts in basic normal form; the references' capitals, marks and brackets are put in first."""
    marked = scored_files(s, d).withColumn("reference", F.concat(F.initcap("reference"), F.lit(". (Aside) [x] A-b!"))).withColumn("hypothesis", F.concat("hypothesis", F.lit(" a b")))
    return scoring.normal_error_rate(marked)


def corpus_cer(s: SparkSession, d: str) -> DataFrame:
    return scoring.char_error_rate(scored_files(s, d))


def wer_filter(s: SparkSession, d: str) -> DataFrame:
    """Labels of a rate of at most 100 %."""
    return scoring.sane_labels(wer_distance(s, d)).select("id")


def semantic(s: SparkSession, d: str) -> DataFrame:
    return scoring.semantic_scores(scored(s, d))[0]


def lookup_last(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "test").where("audio_path is not null").select(stem(F.col("audio_path")).alias("id"), "row_id", "transcription", "length")
    return splits.last_by_key(rows, "id", "row_id")


def test_files(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "train").where("audio_path is not null").select(F.regexp_extract("audio_path", r"([^/\\]*)$", 1).alias("name")).distinct()
    held = table(s, d, "test").where("audio_path is not null").select(F.regexp_extract("audio_path", r"([^/\\]*)$", 1).alias("name"))
    return files.join(held, "name", "left_semi")


def pending_files(s: SparkSession, d: str) -> DataFrame:
    name = F.concat("case_id", F.lit("_"), F.col("seg_no").cast("string")).alias("name")
    done = table(s, d, "segment_ctm").where("segment_id % 3 = 0").select(name)
    return pending(table(s, d, "segment_ctm").select(name).distinct(), done, "name")


#: The labels that the published medium and large speech models take at most.
MOST_LABELS = 448


def mixed_train(s: SparkSession, d: str) -> DataFrame:
    """Two data sets together, with the prompt of their names' language family, without labels that are too long."""
    labels = F.transform(T.word_list(F.col("transcription")), lambda w: F.length(w))
    parts = [table(s, d, t).select("row_id", labels.alias("labels"), T.prompt_family(F.lit(name)).alias("prompt")) for t, name in (("train", "sets/hindi_hearings"), ("validation", "sets/kannada_hearings"))]
    whole = splits.mix_datasets(parts, 42, F.col("row_id"))
    return whole.where(V.label_length_ok(F.col("labels"), MOST_LABELS)).select("row_id", "prompt", F.size("labels").cast("bigint").alias("n_labels"))


def eval_limit(s: SparkSession, d: str) -> DataFrame:
    """The first 50 evaluation rows in hash order: the feature is the limit."""
    return splits.first_rows(table(s, d, "test").select("row_id"), F.md5(F.col("row_id").cast("string")), 50)


def collate_labels(s: SparkSession, d: str) -> DataFrame:
    labels = F.transform(T.word_list(F.col("transcription")), lambda w: F.length(w))
    return collated(table(s, d, "validation").select("row_id", labels.alias("labels")))


def collated(rows: DataFrame) -> DataFrame:
    """(row_id, labels, inputs, attended) of rows (row_id, labels), padded to the longest; nothing is cut."""
    longest = rows.agg(F.max(F.size("labels")).alias("width"))
    padded = rows.crossJoin(F.broadcast(longest)).select("row_id", F.size("labels").alias("n"), V.pad_right(F.col("labels"), F.col("width"), 0).alias("padded"))
    masked = padded.select("row_id", V.mask_labels(F.col("padded"), F.col("n"), F.lit(2)).alias("labels"), V.shift_right(F.col("padded"), 1).alias("inputs"), F.col("n").cast("bigint").alias("attended"))
    as_text = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)
    return masked.select("row_id", as_text("labels"), as_text("inputs"), "attended")


def embedding_cosine(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(other, "vec_id").select("vec_id", F.round(V.rescale(V.cosine(F.col("embedding"), F.col("next"))), 6).alias("similarity"))


def weighted_score(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select("label", V.dot(F.col("embedding"), F.col("embedding")).alias("weight"), (F.col("vec_id") % 7 / 7).alias("mark"))
    return rows.groupBy("label").agg(F.round(F.try_divide(F.sum(F.col("weight") * F.col("mark")), F.sum("weight")), 6).alias("score"), F.count("*").alias("n"))


def mean_vector(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("position", "x"))
    return rows.groupBy("label", "position").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def mean_scores(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("lang", (F.col("n_chars") % 100).alias("bert_score"), (F.col("doc_id") % 10).alias("sema_score"))
    return scoring.summarise_scores(rows, "lang", "bert_score", "sema_score")


def ordinal_repairs(s: SparkSession, d: str) -> DataFrame:
    changed = dialogues(s, d).select((T.repair_ordinals(F.col("t")) != F.col("t")).alias("c"))
    return changed.agg(F.count("*").alias("n_dialogues"), F.sum(F.col("c").cast("bigint")).alias("n_modified"))


def row_numbers(s: SparkSession, d: str) -> DataFrame:
    return splits.row_index(table(s, d, "test").select("row_id", F.coalesce("length", F.lit(0.0)).alias("length")), "length", "row_id").select("row_id", "idx")


def train_files(s: SparkSession, d: str) -> DataFrame:
    """Rows and recorded hundredths of a second of each chunk file."""
    rows = table(s, d, "train").where("audio_path is not null and length > 0").select(stem(F.col("audio_path")).alias("id"), F.round(F.col("length") * 100).cast("bigint").alias("cs"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum("cs").alias("cs"))


def corpus_chunks(s: SparkSession, d: str) -> DataFrame:
    """From segments, words, dialogues and recordings to named chunks of the cases that have all."""
    once = table(s, d, "spk_dialg_json").where("dialogue is not null").groupBy("case_id", "dialogue_no").agg(F.min_by(F.struct("real_speaker", "dialogue"), "turn_id").alias("r")).select("case_id", "dialogue_no", "r.real_speaker", F.lower("r.dialogue").alias("dialogue"))
    audio = table(s, d, "case_catalog").where("mp3_format_link is not null").select("case_id")
    return align.aligned_chunks(segments(s, d), segment_word_rows(s, d), once, audio)


def texts_of_files(s: SparkSession, d: str) -> DataFrame:
    """The last transcription of each test file, put to the file."""
    named = table(s, d, "test").where("audio_path is not null").select(stem(F.col("audio_path")).alias("id"), "row_id", "transcription")
    return splits.with_values(named.select("id").distinct(), named, "id", "row_id")


def embedded_tokens(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "validation").select(F.col("row_id").alias("id"), F.col("transcription").alias("text"))
    return scoring.embed_tokens(rows).select("id", F.array_join("pieces", " ").alias("pieces"), F.size("vectors").alias("n_vectors"))


def embedded_texts(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "validation").select(F.col("row_id").alias("id"), F.col("transcription").alias("text"))
    return scoring.embed_texts(rows)


def speaker_files(s: SparkSession, d: str) -> DataFrame:
    names = F.sort_array(F.collect_set(stem(F.col("audio_path"))))
    return table(s, d, "test").where("speaker is not null and audio_path is not null").groupBy("speaker").agg(F.size(names).cast("bigint").alias("n_files"), F.array_join(names, "|").alias("files"))


def ctm_segments(s: SparkSession, d: str) -> DataFrame:
    return parse_segments(ctm_lines(s, d))


def ctm_words(s: SparkSession, d: str) -> DataFrame:
    return parse_words(ctm_lines(s, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_wer": corpus_wer,
    "corpus_cer": corpus_cer,
    "corpus_counts": corpus_counts,
    "corpus_wer_normal": corpus_wer_normal,
    "report_lines": report_lines_,
    "wer_distance": wer_distance,
    "wer_filter": wer_filter,
    "alignment_detail": alignment_detail,
    "semantic_scores": semantic,
    "contractions": text_query(T.expand_contractions),
    "fillers": text_query(T.drop_fillers),
    "ascii_fold": fold,
    "percent_words": text_query(T.percent_words),
    "citations": text_query(T.open_citations),
    "placeholders": text_query(T.placeholders),
    "punctuation": text_query(T.drop_punctuation),
    "ordinals": text_query(T.repair_ordinals),
    "basic_normal": basic_normal,
    "clean_text": text_query(T.clean_text),
    "speakers": speakers,
    "line_kinds": line_kinds,
    "dialogue_turns": dialogue_turns,
    "manifest": manifest,
    "catalog_keys": catalog_keys,
    "catalog_counts": catalog_counts,
    "numbered_cases": numbered_cases,
    "ctm_segments": ctm_segments,
    "ctm_words": ctm_words,
    "segment_words": segment_words,
    "segment_speaker": segment_speaker,
    "chunks": chunks,
    "corpus_chunks": corpus_chunks,
    "vad_timeline": vad_timeline,
    "speech_length": speech_length,
    "split_members": split_members,
    "split_counts": split_counts,
    "lookup_last": lookup_last,
    "texts_of_files": texts_of_files,
    "test_files": test_files,
    "pending_files": pending_files,
    "mixed_train": mixed_train,
    "eval_limit": eval_limit,
    "collate_labels": collate_labels,
    "embedding_cosine": embedding_cosine,
    "weighted_score": weighted_score,
    "mean_vector": mean_vector,
    "mean_scores": mean_scores,
    "speaker_files": speaker_files,
    "ordinal_repairs": ordinal_repairs,
    "row_numbers": row_numbers,
    "train_files": train_files,
    "embedded_texts": embedded_texts,
    "embedded_tokens": embedded_tokens,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
