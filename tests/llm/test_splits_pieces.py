import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxledger.llm import paths, pieces, splits


@pytest.mark.parametrize(
    ("path", "wanted"),
    [
        ("/srv/x/train/A/case57_2022_09_16_14_1_84b1c4cc.wav", ([57], 14, 1)),
        ("D:\\x\\train\\A\\CASE69_2023-07-09_6_0_cb9012e8.mp3", ([69], 6, 0)),
        ("file:///x/Final%20Dataset/case-11_20231120_10_0_a59efb4d.wav.bak", ([11], 10, 0)),
        ("/x/case_2024/train/sp0.9-Case%5F000014%5F2021%5F01%5F28%5F24%5F0%5F3f4a36dd.WAV", ([14], 24, 0)),
        ("./a//copy of case24+case22_2024_06_18_3_0_8ccb94b2.flac", ([24, 22], 3, 0)),
        ("case553&552_2024_06_17_7_0_97a132db.wav", ([553, 552], 7, 0)),
        ("noisy_Case_735_with_Case_734_2023_05_15_12_0_79de37ac.WAV", ([735, 734], 12, 0)),
        ("readme.txt", None),
        ("", None),
        (None, None),
    ],
)
def test_paths(path, wanted):
    assert paths.parse(path) == wanted


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_hash_to_min(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in splits.hash_to_min(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == brute_components(edges)
    assert splits.hash_to_min(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_and_splits(spark):
    name = "case{}_2022_01_01_1_0_00000000.wav".format
    rows = [(1, name(5), "x"), (2, name("9+case5"), "x"), (3, name("12+case9"), "x"), (4, name(7), "x"), (5, None, "x"), (6, "odd", "x"), (7, name(7), "x")]
    groups = splits.group_records(spark.createDataFrame(rows, "row_id bigint, audio_path string, component string").drop("component"))
    assert {r["row_id"]: r["component"] for r in groups.collect()} == {1: 5, 2: 5, 3: 5, 4: 7, 6: None, 7: 7}
    many = spark.range(4000).select(F.col("id").alias("row_id"), F.concat(F.lit("case"), F.when(F.col("id") < 1300, 1).otherwise(F.col("id") % 700), F.lit("_2022_01_01_1_0_00000000.wav")).alias("audio_path"))
    shares, all_groups = {"train": 0.8, "validation": 0.1, "test": 0.1}, splits.group_records(many)
    plan = splits.plan_splits(all_groups, shares)
    done = splits.assign_splits(all_groups, shares, plan)
    share = {r["split"]: r["n"] / 4000 for r in done.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03
    assert done.groupBy("component").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
    none = splits.group_records(many.limit(0))
    assert splits.assign_splits(none, {"train": 1.0}, splits.plan_splits(none, {"train": 1.0})).count() == 0
    # rows of new cases and many more of an old one move nothing, nor does taking half of them away
    more = many.union(spark.range(9000).select((F.col("id") + 10_000).alias("row_id"), F.concat(F.lit("case"), F.when(F.col("id") < 2000, 33).otherwise(F.col("id") + 1000), F.lit("_2022_01_01_1_0_00000000.wav"))))
    was = {r["component"]: r["split"] for r in done.collect()}
    for rows in (more, many.where("row_id % 2 = 1")):
        now = {r["component"]: r["split"] for r in splits.assign_splits(splits.group_records(rows), shares, plan).collect()}
        assert all(now[c] == s for c, s in was.items() if c in now)


def test_hot_node(spark, monkeypatch):
    monkeypatch.setattr(splits, "HOT_ROWS", 10)
    edges = [(0, i) for i in range(1, 40)] + [(100, 101), (200 + 1, 39)]
    got = {r["node"]: r["component"] for r in splits.hash_to_min(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == brute_components(edges)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12), st.integers(0, 5))
@settings(max_examples=300, deadline=None)
def test_cut_points(strength, most, overlap):
    import numpy as np

    s = np.array(strength, dtype=np.int8)
    got = pieces.cut_points(s, most, overlap)
    over = max(0, min(overlap, most - 1))
    assert got[0][0] == 0 and got[-1][1] == len(s)
    for (a, b), (c, _) in zip(got, got[1:]):
        assert b - over == c and a < c and b - a <= most
        window = [(s[i], i) for i in range(a + over, a + most)]
        assert max(window)[1] == b - 1  # the strongest, rightmost of equals
    assert got[-1][1] - got[-1][0] <= most


def test_pieces(spark):
    text = "One two three four. Five six | seven eight nine ten"
    rows = [(1, text, 40.0, "k"), (2, text, 30.0, "k"), (3, None, 61.0, "k"), (4, "", 31.0, "k"), (5, "long", 45.0, "k"), (6, text, None, "k"), (7, "a<space>b<space>c<space>d", 60.0, "k")]
    df = spark.createDataFrame(rows, "id bigint, text string, size double, kind string")
    got = {}
    for r in pieces.split_oversized(df).orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append((r["piece_text"], round(r["piece_size"], 2), r["over_limit"]))
    assert got[1] == [("One two three four. Five six", 24.0, False), ("four. Five six seven eight nine ten", 28.0, False)]
    assert 2 not in got and 6 not in got
    assert got[3] == [(None, 20.33, False)] * 3 and got[4] == [(None, 15.5, False)] * 2
    assert got[5] == [("long", 45.0, True)]
    assert [x[0] for x in got[7]] == ["a b", "b c", "c d"]
    with pytest.raises(ValueError, match="piece_no"):
        pieces.split_oversized(df.withColumn("piece_no", F.lit(1)))
    assert pieces.split_oversized(df.limit(0)).count() == 0


def test_true_lengths(spark):
    words = " ".join(["word"] * 100)
    seg = [(1, "case1", 1, 0.0, 40.0, words), (2, "case1", 1, 0.0, 40.0, words), (3, "case2", 1, 0.0, 40_000.0, words), (4, "case2", 2, 0.0, 30_000.0, words), (5, "case3", 1, 5.0, 4.0, words), (6, None, None, None, None, None)]
    name = "case{}_2022_01_01_{}_0_00000000.wav".format
    train = [(1, name(1, 1), words, 40.0), (2, name(1, 1), words, 40_000.0), (3, name(1, 1), words, 640_000.0), (4, name(2, 1), words, None), (5, name(2, 1), words, -1.0), (6, name(2, 2), words, 0.0), (7, name(9, 9), words, 41.0), (8, name(9, 9), None, None), (9, None, None, None), (10, name(1, 1), "a b", 800.0)]
    s = spark.createDataFrame(seg, "segment_id bigint, case_id string, seg_no int, start_sec double, end_sec double, transcript string")
    t = spark.createDataFrame(train, "row_id bigint, audio_path string, transcription string, length double")
    got = pieces.oversized_pieces(s, t).where("piece_no = 0").select("source_table", "item_id").collect()
    assert sorted(map(tuple, got)) == [("segment_ctm", 1), ("segment_ctm", 2), ("segment_ctm", 3)] + [("train", i) for i in (1, 2, 3, 4, 5, 7)]
    assert pieces.oversized_pieces(s.limit(0), t.limit(0)).count() == 0
