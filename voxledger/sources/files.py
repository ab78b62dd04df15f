"""Sources and sinks of the transcript files.

Readers declare their schemas; malformed lines are dropped where the format says
so, never raised.
"""

from __future__ import annotations

import argparse
import io
import time
import urllib.error
import urllib.request
import wave
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Answers after which a link is tried again.
RETRIED = (500, 502, 503, 504)


def ctm_fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def parse_words(lines: DataFrame, line: str = "line") -> DataFrame:
    """start_ms, end_ms, word and all other columns, of lines with five fields or more: id, channel, start, duration, word."""
    p = ctm_fields(F.col(line))
    keep = [c for c in lines.columns if c != line]
    start, length = p[2].try_cast("double"), p[3].try_cast("double")
    return lines.where(F.size(p) >= 5).select(*keep, F.round(start * 1000).cast("bigint").alias("start_ms"), F.round((start + length) * 1000).cast("bigint").alias("end_ms"), p[4].alias("word")).where("start_ms is not null and end_ms is not null")


def parse_segments(lines: DataFrame, line: str = "line") -> DataFrame:
    """start_ms, end_ms, text and all other columns; the text runs to the first NA, <space> is a blank."""
    p = ctm_fields(F.col(line))
    rest = F.slice(p, F.lit(5), F.size(p))
    end = F.array_position(rest, F.lit("NA")).cast("int")
    text = F.array_join(F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest), " ")
    keep = [c for c in lines.columns if c != line]
    start, length = p[2].try_cast("double"), p[3].try_cast("double")
    return lines.where(F.size(p) >= 5).select(*keep, F.round(start * 1000).cast("bigint").alias("start_ms"), F.round((start + length) * 1000).cast("bigint").alias("end_ms"), F.replace(text, F.lit("<space>"), F.lit(" ")).alias("text")).where("start_ms is not null and end_ms is not null")


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def read_lines(spark: SparkSession, path: str, pattern: str = "*.ctm") -> DataFrame:
    """(case_id, line) of text files below a folder."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path).select(stem(F.input_file_name()).alias("case_id"), F.col("value").alias("line"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return parse_words(read_lines(spark, path))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return parse_segments(read_lines(spark, path))


def read_speech(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, start_ms, end_ms, name) of tab-separated speech segments; short and blank lines are dropped."""
    rows = read_lines(spark, path, "*.tsv").withColumn("p", F.split("line", "\t")).where(F.size("p") >= 2)
    ms = lambda k: F.floor(F.trim(F.col("p")[k]).try_cast("double") * 1000)
    return rows.select("case_id", ms(0).alias("start_ms"), ms(1).alias("end_ms"), F.try_element_at("p", F.lit(3)).alias("name")).where("start_ms is not null and end_ms is not null")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, dialogue_no, real_speaker, dialogue) of JSON arrays, one file per case."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select(stem(F.input_file_name()).alias("case_id"), F.from_json("value", "array<struct<real_speaker:string,dialogue:string>>").alias("turns"))
    return raw.where(~F.endswith("case_id", F.lit("_manifest"))).select("case_id", F.posexplode("turns").alias("at", "turn")).select("case_id", (F.col("at") + 1).alias("dialogue_no"), "turn.real_speaker", "turn.dialogue")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(audio_path, transcription, length) of CSV files with header; quoted commas and line breaks belong to their field."""
    return spark.read.schema("audio_path string, transcription string, length double").option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(id, hypothesis, reference) of a result CSV with or without an index column."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.select("id", "hypothesis", "reference")


def read_audio(spark: SparkSession, path: str, pattern: str = "*.wav", deep: bool = False) -> DataFrame:
    """(path, id, size, content): files by pattern; the content is read only if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower()).load(path).select("path", stem(F.col("path")).alias("id"), F.col("length").alias("size"), "content")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A case catalog in CSV, or in a workbook where a reader for one is installed."""
    schema = "case_id string, transcript_link string, mp3_format_link string, hearing_date date"
    if PurePosixPath(path).suffix.lower() in (".xls", ".xlsx"):
        rows = pd.read_excel(path)  # needs an optional reader
        rows.columns = ["case_id", "transcript_link", "mp3_format_link", "hearing_date"][: len(rows.columns)]
        return spark.createDataFrame(rows.astype(object).where(rows.notna(), None), schema)
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_pdf_lines(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(case_id, page, line_no, line) of PDF files after their first page; ``pages`` turns a file into the texts of its pages."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for case, content in zip(pdf["id"], pdf["content"]):
                out = [(case, p, n, line) for p, text in enumerate(pages(content), 1) if p > 1 for n, line in enumerate(text.split("\n"))]
                yield pd.DataFrame(out, columns=["case_id", "page", "line_no", "line"])

    return read_audio(spark, path, "*.pdf").select("id", "content").mapInPandas(read, "case_id string, page int, line_no int, line string")


def http_get(link: str, timeout: float = 30) -> bytes:
    with urllib.request.urlopen(link, timeout=timeout) as answer:
        return answer.read()


def worth_retrying(error: Exception) -> bool:
    """A server's passing trouble, or a connection that failed."""
    return error.code in RETRIED if isinstance(error, urllib.error.HTTPError) else isinstance(error, OSError)


def fetch(rows: DataFrame, get: Callable[[str], bytes] = http_get, url: str = "url", key: str = "file_key", tries: int = 4, again: Callable[[Exception], bool] = worth_retrying, pause: float = 1.0) -> DataFrame:
    """(key, content, error): what ``get`` returns for each link; tried again with growing pauses if the error is worth it; rows without link are skipped."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, link in zip(pdf[key], pdf[url]):
                content, error = None, None
                for attempt in range(tries):
                    try:
                        content, error = get(link), None
                        break
                    except Exception as e:
                        error = repr(e)[:500]
                        if attempt == tries - 1 or not again(e):
                            break
                        time.sleep(pause * 2**attempt)
                out.append((k, content, error))
            yield pd.DataFrame(out, columns=[key, "content", "error"])

    return rows.where(F.col(url).isNotNull()).select(key, url).mapInPandas(run, f"`{key}` {kind}, content binary, error string")


def transform_audio(rows: DataFrame, convert: Callable[[bytes], bytes]) -> DataFrame:
    """(path, id, content) with converted contents: transcoding, resampling, mixing down, by a codec the caller brings."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(content=[convert(c) for c in pdf["content"]])

    return rows.select("path", "id", "content").mapInPandas(run, "path string, id string, content binary")


def find_speech(audio: DataFrame, detect: Callable[[bytes], list[tuple[float, float]]]) -> DataFrame:
    """(case_id, seg_no, start_ms, end_ms): speech found in audio files by a detector the caller brings, in seconds; numbered from 1."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for case, content in zip(pdf["id"], pdf["content"]):
                found = [(case, n, int(a * 1000), int(b * 1000)) for n, (a, b) in enumerate(detect(content), 1)]
                yield pd.DataFrame(found, columns=["case_id", "seg_no", "start_ms", "end_ms"])

    return audio.select("id", "content").mapInPandas(run, "case_id string, seg_no int, start_ms bigint, end_ms bigint")


def slice_samples(samples: Column, rate: int, start_ms: Column, end_ms: Column) -> Column:
    """The samples of a time range."""
    first = F.floor(start_ms * rate / 1000).cast("int")
    return F.slice(samples, first + 1, F.greatest(F.floor(end_ms * rate / 1000).cast("int") - first, F.lit(0)))


def without_silence(samples: Column, rate: int, segments: Column) -> Column:
    """The samples of all segments, an array of struct(start_ms, end_ms), one after the other."""
    return F.flatten(F.transform(segments, lambda x: slice_samples(samples, rate, x["start_ms"], x["end_ms"])))


def wav_bytes(samples: list[float], rate: int = 16000) -> bytes:
    """Mono samples between -1 and 1 as a WAV file of 16 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes((np.clip(np.nan_to_num(np.asarray(samples, dtype=np.float64)), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def write_audio(rows: DataFrame, path: str, rate: int = 16000) -> None:
    """A WAV file per row (file_name, samples), below split and speaker where the row has them; path is a folder that all executors reach."""
    below = [c for c in ("split", "speaker") if c in rows.columns]

    def put(part: Iterator) -> None:
        fs, base = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for r in part:
            folder = "/".join([base, *[str(r[c]) for c in below]])
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{r['file_name']}") as file:
                file.write(wav_bytes(r["samples"], rate))

    rows.select("file_name", "samples", *below).foreachPartition(put)


def training_examples(rows: DataFrame, extract: Callable[[list[float]], list[list[float]]], tokenize: Callable[[str], list[int]], key: str = "id") -> DataFrame:
    """(key, input_features, labels) of rows (key, samples, transcription) by a feature extractor and a tokenizer that the caller brings; rows without either are left out."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "input_features": [extract(x) for x in pdf["samples"]], "labels": [tokenize(t) for t in pdf["transcription"]]})

    return rows.where("samples is not null and transcription is not null").select(key, "samples", "transcription").mapInPandas(run, f"`{key}` {kind}, input_features array<array<float>>, labels array<int>")


def arguments(argv: list[str], **defaults: object) -> dict[str, object]:
    """Command-line options --name value, of the type of their default; switches take true or false."""
    parser = argparse.ArgumentParser()
    for name, value in defaults.items():
        truth = lambda x: {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[x.lower()]
        parser.add_argument(f"--{name}", default=value, type=truth if isinstance(value, bool) else str if value is None else type(value))
    return vars(parser.parse_args(argv))


def read_config(path: str) -> dict[str, object]:
    """A flat YAML file of ``key: value`` lines."""
    out: dict[str, object] = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            line = line.split(" #")[0].strip()
            if ":" in line and not line.startswith("#"):
                k, v = (x.strip() for x in line.split(":", 1))
                text = v.strip("'\"")
                kinds = {"true": True, "false": False, "null": None, "": None}
                try:
                    out[k] = kinds[text.lower()] if text.lower() in kinds else int(text) if text.lstrip("-").isdigit() else float(text)
                except ValueError:
                    out[k] = text
    return out


def write_split(rows: DataFrame, path: str) -> None:
    """CSV files with header below split and speaker; what was there is replaced."""
    rows.write.mode("overwrite").partitionBy("split", "speaker").option("header", "true").option("escape", '"').csv(path)


def write_split_lists(rows: DataFrame, path: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> None:
    """A folder of CSV files (audio_path, transcription, length) with header for each split; what was there is replaced."""
    for split in splits:
        rows.where(F.col("split") == split).select("audio_path", "transcription", "length").write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}/{split}")


def save_dataset(rows: DataFrame, path: str) -> None:
    """Parquet below split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def load_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """What ``save_dataset`` has put down; of a split only its files are read."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def write_catalog(rows: DataFrame, path: str) -> None:
    """The catalog with its keys, CSV with header; the input stays as it is."""
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_speech(segments: DataFrame, path: str) -> None:
    """Tab-separated start, end (seconds) and seg1, seg2, ... of (case_id, seg_no, start_ms, end_ms), in order, below case_id; other cases there stay as they are, cases without speech have no file."""
    line = F.concat_ws("\t", F.col("start_ms") / 1000, F.col("end_ms") / 1000, F.concat(F.lit("seg"), F.col("seg_no")))
    laid = segments.select("case_id", "seg_no", line.alias("value")).repartition("case_id").sortWithinPartitions("case_id", "seg_no")
    laid.select("case_id", "value").write.mode("append").partitionBy("case_id").text(path)


def write_results(rows: DataFrame, path: str) -> None:
    """(id, hypothesis, reference) as CSV with header."""
    rows.select("id", "hypothesis", "reference").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_ids(rows: DataFrame, path: str) -> None:
    """JSON lines of the ids alone."""
    rows.select("id").write.mode("overwrite").json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_dialogues(turns: DataFrame, path: str) -> None:
    """A JSON array per case, in text files below case_id."""
    array = F.transform(F.sort_array(F.collect_list(F.struct("dialogue_no", "real_speaker", "dialogue"))), lambda x: F.struct(x["real_speaker"].alias("real_speaker"), x["dialogue"].alias("dialogue")))
    turns.groupBy("case_id").agg(F.to_json(array).alias("value")).write.mode("overwrite").partitionBy("case_id").text(path)


def report_lines(detail: DataFrame, unit: str = "word") -> DataFrame:
    """(value): four lines for every row of ``scoring.detail``: counts and rates, ref, hyp, diff. Rates of an empty reference are -."""
    number = lambda c, shown=None: F.concat(F.lit(f"{shown or c}="), F.col(c))
    percent = lambda c: F.concat(F.lit(f"{c}:"), F.coalesce(F.concat(F.col(c), F.lit("%")), F.lit("-")))
    head = F.concat(F.col("id").cast("string"), F.lit("("), F.concat_ws(",", number("n", f"n{unit}s"), *map(number, ("cor", "ins", "del", "sub"))), F.lit(") "), percent("corr"), F.lit(","), percent("wer"))
    named = [F.concat(F.lit(f"{a}:\t"), F.col(c)) for a, c in (("ref", "reference"), ("hyp", "hypothesis"), ("diff", "diff"))]
    return detail.select(F.explode(F.array(head, *named)).alias("value"))


def total_lines(total: DataFrame, unit: str = "word") -> DataFrame:
    """(value): the lines of ``scoring.error_rate``: rate and edits, of words also the rate of wrong sentences, number of sentences."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    rate = F.format_string(f"%%{'WER' if unit == 'word' else 'CER'} %s [ %d / %d, %d ins, %d del, %d sub ]", shown("rate"), "wrong", "n", "ins", "del", "sub")
    wrong = F.format_string("%%SER %s [ %d / %d ]", shown("sentence_rate"), "wrong_sentences", "sentences")
    scored = F.format_string("Scored %d sentences, 0 not present in hyp.", "sentences")
    return total.select(F.explode(F.array(rate, *([wrong] if unit == "word" else []), scored)).alias("value"))


def write_report(detail: DataFrame, total: DataFrame, path: str, unit: str = "word") -> None:
    """Text: the lines of every scored row below ``rows``, those of the whole below ``total``."""
    report_lines(detail, unit).write.mode("overwrite").text(f"{path}/rows")
    total_lines(total, unit).coalesce(1).write.mode("overwrite").text(f"{path}/total")


def write_summary(summary: DataFrame, path: str) -> None:
    """Text of (language, n_samples, mean_bert_score, mean_sema_score): a heading, then a block per language."""
    block = F.array(F.concat(F.lit("Language: "), "language"), F.format_string("Number of Samples Processed: %d", "n_samples"), F.format_string("Average BERT Score: %.4f", "mean_bert_score"), F.format_string("Average SEMA Score: %.4f", "mean_sema_score"), F.lit(""))
    heading = F.array(F.lit("Language Averages Summary"), F.lit("========================="), F.lit(""))
    lines = summary.sparkSession.range(1).select(F.lit(None).cast("string").alias("language"), F.posexplode(heading).alias("at", "value")).union(summary.select("language", F.posexplode(block).alias("at", "value")))
    lines.repartition(1).sortWithinPartitions("language", "at").select("value").write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a CSV log; the header is there once, in a file of its own."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([(",".join(rows.columns),)], "value string").coalesce(1).write.text(path)
    rows.write.mode("append").option("header", "false").option("escape", '"').csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of such a log."""
    wanted = spark.createDataFrame([], schema).schema
    header = reduce(lambda a, b: a & b, [F.col(f"_c{i}").eqNullSafe(F.lit(f.name)) for i, f in enumerate(wanted)])
    raw = spark.read.option("escape", '"').schema(", ".join(f"_c{i} string" for i in range(len(wanted)))).csv(path)
    return raw.where(~header).select(*[F.col(f"_c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(wanted)])


def append_rate(total: DataFrame, language: str, path: str) -> None:
    """A line "language WER: x %" added to a text log."""
    total.select(F.format_string("%s WER: %.2f %%", F.lit(language), "rate").alias("value")).write.mode("append").text(path)


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key isn't in done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
