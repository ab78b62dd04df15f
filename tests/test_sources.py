import json
import urllib.error
import wave

import numpy as np
from pyspark.sql import functions as F

from voxledger.sources import files
from voxledger.streaming import ingest


def test_ctm(spark, tmp_path):
    (tmp_path / "case1_2023_01_02.ctm").write_text("s1 1 0.50 1.25 so<space>be<space>it NA lex NA\nshort line\ns2 1 x 1 a\ns3 1 2 1 a b NA\n")
    got = [tuple(r) for r in files.read_segments(spark, str(tmp_path)).orderBy("start_ms").collect()]
    assert got == [("case1_2023_01_02", 500, 1750, "so be it"), ("case1_2023_01_02", 2000, 3000, "a b")]
    assert files.read_words(spark, str(tmp_path)).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/c.tsv").write_text("0.5\t1.25\tseg1\n\nonly\n")
    assert [tuple(r) for r in files.read_speech(spark, str(tmp_path / "v")).collect()] == [("c", 500, 1250, "seg1")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/c.json").write_text(json.dumps([{"real_speaker": "A", "dialogue": "x"}, {"real_speaker": "B", "dialogue": "y"}]))
    (tmp_path / "j/c_manifest.json").write_text("[]")
    assert [tuple(r) for r in files.read_dialogues(spark, str(tmp_path / "j")).collect()] == [("c", 1, "A", "x"), ("c", 2, "B", "y")]
    (tmp_path / "s.csv").write_text('audio_path,transcription,length\na.wav,"one, 1,000 ""x""",2.5\n')
    assert tuple(files.read_split(spark, str(tmp_path / "s.csv")).first()) == ("a.wav", 'one, 1,000 "x"', 2.5)
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.wav").write_bytes(b"abc")
    audio = files.read_audio(spark, str(tmp_path / "w"))
    assert [tuple(r) for r in audio.select("id", "size").collect()] == [("a", 3)]
    assert bytes(files.transform_audio(audio, lambda b: b[::-1]).first()["content"]) == b"cba"
    (tmp_path / "w/d.pdf").write_bytes(b"cover|one\ntwo")
    got = files.read_pdf_lines(spark, str(tmp_path / "w"), lambda b: b.decode().split("|")).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [("d", 2, 0, "one"), ("d", 2, 1, "two")]


def test_fetch(spark):
    rows = spark.createDataFrame([("a", "http://x"), ("b", None), ("c", "bad")], "file_key string, url string")

    def get(u):
        if u == "bad":
            raise OSError("no")
        return u.encode()

    got = {r["file_key"]: (r["content"], r["error"]) for r in files.fetch(rows, get, tries=1).collect()}
    assert bytes(got["a"][0]) == b"http://x" and "no" in got["c"][1] and "b" not in got


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", "x, y", 1.0, "train", "RAO")], "audio_path string, transcription string, length double, split string, speaker string")
    files.write_split(rows, str(tmp_path / "s"))
    assert tuple(files.read_split(spark, str(tmp_path / "s/split=train/speaker=RAO")).first()) == ("a.wav", "x, y", 1.0)
    turns = spark.createDataFrame([("c", 2, "B", "y"), ("c", 1, "A", "x")], "case_id string, dialogue_no int, real_speaker string, dialogue string")
    files.write_dialogues(turns, str(tmp_path / "d"))
    assert json.loads(spark.read.text(str(tmp_path / "d")).first()[0])[0] == {"real_speaker": "A", "dialogue": "x"}
    files.append_log(rows.select("length"), str(tmp_path / "l"))
    files.append_log(rows.select("length"), str(tmp_path / "l"))
    assert sum(r[0] == "length" for r in spark.read.text(str(tmp_path / "l")).collect()) == 1
    assert [r["length"] for r in files.read_log(spark, str(tmp_path / "l"), "length double").collect()] == [1.0, 1.0]
    files.write_split_lists(rows, str(tmp_path / "three"))
    assert [files.read_split(spark, str(tmp_path / "three" / s)).count() for s in ("train", "test")] == [1, 0]
    files.save_dataset(rows, str(tmp_path / "p"))
    assert files.load_dataset(spark, str(tmp_path / "p"), "train").count() == 1 and files.load_dataset(spark, str(tmp_path / "p"), "test").count() == 0
    files.write_catalog(spark.createDataFrame([("case1", "x")], "case_id string, link string"), str(tmp_path / "cat"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "cat")).first()["case_id"] == "case1"
    files.write_ids(spark.createDataFrame([("a", "b")], "id string, more string"), str(tmp_path / "ids"))
    assert spark.read.text(str(tmp_path / "ids")).first()[0] == '{"id":"a"}'
    results = spark.createDataFrame([("a", "x, y", "z")], "id string, hypothesis string, reference string")
    files.write_results(results, str(tmp_path / "res"))
    assert tuple(files.read_results(spark, str(tmp_path / "res")).first()) == ("a", "x, y", "z")


def test_speech_files(spark, tmp_path):
    speech = spark.createDataFrame([("c", 2, 1250, 2000), ("c", 1, 500, 1000), ("d", 1, 0, 40)], "case_id string, seg_no int, start_ms bigint, end_ms bigint")
    files.write_speech(speech.where("case_id = 'c'"), str(tmp_path / "v"))
    files.write_speech(speech.where("case_id = 'd'"), str(tmp_path / "v"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "v/case_id=c")).collect()] == ["0.5\t1.0\tseg1", "1.25\t2.0\tseg2"]
    assert spark.read.text(str(tmp_path / "v/case_id=d")).count() == 1


def test_audio_out(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", [0.0, 0.5, -1.0, 2.0], "train", "RAO")], "file_name string, samples array<double>, split string, speaker string")
    files.write_audio(rows, str(tmp_path / "a"), 8000)
    with wave.open(str(tmp_path / "a/train/RAO/a.wav")) as w:
        assert (w.getframerate(), w.getnchannels(), np.frombuffer(w.readframes(9), "<i2").tolist()) == (8000, 1, [0, 16383, -32767, 32767])
    kept = F.array(*[F.struct(F.lit(a).alias("start_ms"), F.lit(b).alias("end_ms")) for a, b in ((0, 500), (1500, 2000))])
    assert spark.range(1).select(files.without_silence(F.array(*[F.lit(i) for i in range(8)]), 4, kept)).first()[0] == [0, 1, 6, 7]
    examples = spark.createDataFrame([("x", [1.0, 2.0], "a b"), ("y", None, "a")], "id string, samples array<double>, transcription string")
    got = files.training_examples(examples, lambda s: [[float(x) for x in s]], lambda t: [len(w) for w in t.split()]).collect()
    assert [tuple(r) for r in got] == [("x", [[1.0, 2.0]], [1, 1])]


def test_arguments():
    assert files.arguments(["--fp16", "false", "--batch", "4"], fp16=True, batch=8, path=None) == {"fp16": False, "batch": 4, "path": None}


def test_retries(spark):
    rows = spark.createDataFrame([("a", "busy"), ("b", "gone"), ("c", "slow")], "file_key string, url string")

    def get(link):
        raise {"busy": urllib.error.HTTPError(link, 503, "busy", None, None), "gone": urllib.error.HTTPError(link, 404, "gone", None, None), "slow": TimeoutError()}[link]

    assert [files.worth_retrying(e) for e in (urllib.error.HTTPError("x", 503, "", None, None), urllib.error.HTTPError("x", 404, "", None, None), TimeoutError(), ValueError())] == [True, False, True, False]
    assert {r["file_key"] for r in files.fetch(rows, get, tries=2, pause=0).where("error is not null").collect()} == {"a", "b", "c"}


def test_ingest_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("a", "b"):
        (src / f"{name}.ctm").write_text("s 1 0 1 x NA\n")
        ingest.take_new(ingest.arriving_segments(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("case_id").collect()) == ["a", "b"]


def test_config_and_speech(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# x\nmodel: a/b # which\nsteps: 10\nrate: 1e-5\nflag: true\nnone:\n")
    assert files.read_config(str(tmp_path / "c.yaml")) == {"model": "a/b", "steps": 10, "rate": 1e-5, "flag": True, "none": None}
    audio = spark.createDataFrame([("c", bytearray(b"x"))], "id string, content binary")
    assert [tuple(r) for r in files.find_speech(audio, lambda b: [(0.5, 1.2999)]).collect()] == [("c", 1, 500, 1299)]
    assert spark.range(1).select(files.slice_samples(F.array(*[F.lit(i) for i in range(8)]), 4, F.lit(500), F.lit(1000))).first()[0] == [2, 3]


def test_more_files(spark, tmp_path):
    (tmp_path / "cat.csv").write_text("case_id,transcript_link,mp3_format_link,hearing_date\ncase1,http://x,,2023-01-02\n")
    r = files.read_catalog(spark, str(tmp_path / "cat.csv")).first()
    assert (r["case_id"], r["mp3_format_link"], str(r["hearing_date"])) == ("case1", None, "2023-01-02")
    (tmp_path / "r.csv").write_text('index,id,hypothesis,reference\n0,a,"x, y",z\n')
    assert tuple(files.read_results(spark, str(tmp_path / "r.csv")).first()) == ("a", "x, y", "z")
    files.write_manifest(spark.createDataFrame([("a.wav", "x")], "audio_filepath string, text string"), str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"audio_filepath": "a.wav", "text": "x"}
    from voxledger.operators import scoring

    rows = spark.createDataFrame([(1, "a b", "a c"), (2, "", "")], "id bigint, reference string, hypothesis string")
    files.write_report(scoring.detail(rows), scoring.error_rate(rows), str(tmp_path / "d"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "d/rows")).collect()]
    at = lines.index("1(nwords=2,cor=1,ins=0,del=0,sub=1) corr:50.00%,wer:50.00%")
    assert lines[at + 1 : at + 4] == ["ref:\ta b", "hyp:\ta c", "diff:\ta (b->c)"] and "2(nwords=0,cor=0,ins=0,del=0,sub=0) corr:-,wer:-" in lines
    assert [r[0] for r in spark.read.text(str(tmp_path / "d/total")).collect()] == ["%WER 50.0 [ 1 / 2, 0 ins, 0 del, 1 sub ]", "%SER 50.0 [ 1 / 2 ]", "Scored 2 sentences, 0 not present in hyp."]
    files.append_rate(scoring.error_rate(rows), "English", str(tmp_path / "w"))
    files.append_rate(scoring.error_rate(rows), "English", str(tmp_path / "w"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "w")).collect()] == ["English WER: 50.00 %"] * 2
    summary = scoring.summarise_scores(spark.createDataFrame([("en", 0.5, 0.25), ("en", 1.0, 0.75)], "language string, bert_score double, sema_score double"), "language", "bert_score", "sema_score")
    files.write_summary(summary, str(tmp_path / "sum"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "sum")).collect()][3:7] == ["Language: en", "Number of Samples Processed: 2", "Average BERT Score: 0.7500", "Average SEMA Score: 0.5000"]
