"""Segment numbers as high as those of a case of many hours."""

import datetime

import pytest

from __spark_entry__ import queries

SEG = 30_000
WHEN = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("numbers"))
    seg = [(1, "case1", SEG, 10.0, 11.0, "so be it"), (2, "case1", 2**31 - 1, 20.0, 21.0, "very<space>well then")]
    spark.createDataFrame([(*x, WHEN) for x in seg], "segment_id bigint, case_id string, seg_no int, start_sec double, end_sec double, transcript string, loaded_at timestamp_ntz").write.parquet(f"{d}/segment_ctm.parquet")
    said = [(1, "case1", 5, "A", "Well, so be it then."), (2, "case1", 6, "B", "Very well then")]
    spark.createDataFrame([(*x, WHEN) for x in said], "turn_id bigint, case_id string, dialogue_no int, real_speaker string, dialogue string, loaded_at timestamp_ntz").write.parquet(f"{d}/spk_dialg_json.parquet")
    spark.createDataFrame([("case1", "t", "m", datetime.date(2024, 1, 1))], "case_id string, transcript_link string, mp3_format_link string, hearing_date date").write.parquet(f"{d}/case_catalog.parquet")
    return d


def test_chunks(spark, tables):
    got = {(r["seg_no"], r["chunk_no"], r["start_ms"], r["end_ms"], r["text"]) for r in queries()["chunks"](spark, tables).collect()}
    assert got == {(SEG, 0, 10_000, 11_200, "so be it"), (2**31 - 1, 0, 20_000, 21_200, "very well then")}


def test_corpus_chunks(spark, tables):
    got = {(r["seg_no"], r["dialogue_no"], r["text"], r["real_speaker"]) for r in queries()["corpus_chunks"](spark, tables).collect()}
    assert got == {(SEG, 5, "so be it", "A"), (2**31 - 1, 6, "very well then", "B")}


def test_segment_words(spark, tables):
    got = {(r["seg_no"], r["n_words"], r["sum_word_no"], r["first_ms"], r["last_ms"]) for r in queries()["segment_words"](spark, tables).collect()}
    assert got == {(n, 3, 3 * n * 100_000 + 3, s, s + 1200) for n, s in ((SEG, 10_000), (2**31 - 1, 20_000))}
