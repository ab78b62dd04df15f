import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxledger.functions import vectors as V
from voxledger.operators import align, scoring, splits, turns

WORDS = st.lists(st.sampled_from("abcd"), max_size=9)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_alignment_invariants(ref, hyp):
    n, cor, wrong, ins, dele, sub, path, diff = scoring.counts(ref, hyp)
    assert n == len(ref) == cor + sub + dele
    assert len(hyp) == cor + sub + ins
    assert wrong == sub + ins + dele == plain_distance(ref, hyp) == scoring.distance(ref, hyp)
    assert len(path) == cor and all(ref[i] == hyp[j] for i, j in path) and all(a < c and b < d for (a, b), (c, d) in zip(path, path[1:]))
    # the diff holds both texts
    sides = [re.sub(r"\(([^()]*)->([^()]*)\)", rf"\{k}", diff).replace("*", " ").split() for k in (1, 2)]
    assert sides == [ref, hyp]


def test_alignment_cases():
    assert scoring.counts(["a", "b"], ["a", "b"])[:6] == (2, 2, 0, 0, 0, 0)
    assert scoring.counts([], ["x"])[:6] == (0, 0, 1, 1, 0, 0)
    assert scoring.counts(["x"], [])[:6] == (1, 0, 1, 0, 1, 0)
    assert scoring.counts("a b".split(), "a c".split())[6:] == ([(0, 0)], "a (b->c)")
    assert scoring.counts("a b".split(), "a".split())[7] == "a (b->*)"
    # a run that differs is one gap
    assert scoring.counts("a b c".split(), "x y c".split())[6:] == ([(2, 2)], "(a b->x y) c")
    assert scoring.counts("a b c d".split(), "a d".split())[7] == "a (b c->*) d" and scoring.counts(["a"], "x a y z".split())[7] == "(*->x) a (*->y z)"


def test_rates_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, reference string, hypothesis string")
    r = scoring.error_rate(none).first()
    assert r["n"] == 0 and r["rate"] is None and r["sentence_rate"] is None
    rows = spark.createDataFrame([(1, None, "x"), (2, "A b", "a c"), (3, None, None)], "id bigint, reference string, hypothesis string")
    r = scoring.error_rate(rows).first()
    assert (r["n"], r["wrong"], r["sentences"], r["wrong_sentences"], r["rate"]) == (2, 2, 3, 2, 100.0)
    assert [x["wer"] for x in scoring.detail(rows).orderBy("id").collect()] == [None, "50.00", None]
    # of equal ids the last counts
    twice = spark.createDataFrame([(1, 1, "a b", "x y"), (1, 3, "a b", "a b"), (2, 2, "c", "d"), (1, 2, "a", "")], "id bigint, row_no int, reference string, hypothesis string")
    for r in (scoring.error_rate(twice).first(), scoring.error_rate(twice, kinds=False).first()):
        assert (r["n"], r["wrong"], r["sentences"], r["rate"]) == (3, 1, 2, 33.33)
    assert scoring.char_error_rate(twice).first()["n"] == 4 and scoring.detail(twice).count() == 2
    assert scoring.normal_error_rate(spark.createDataFrame([(1, "A-b, [x] C!", "a b c")], "id bigint, reference string, hypothesis string")).first()["rate"] == 0
    rated = spark.createDataFrame([(1, 2, 2), (2, 2, 3), (3, 0, 1)], "id bigint, n bigint, wrong bigint")
    assert [r["id"] for r in scoring.sane_labels(rated).collect()] == [1]


def test_semantic(spark):
    assert scoring.match_rate("", "") is None
    assert scoring.match_rate("abc", "abd") == pytest.approx(2 / 3)
    assert scoring.map_words("a b", "a c") == [("a", "a"), ("b", "c")]
    rows = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "a", None)], "id bigint, reference string, hypothesis string")
    good, bad = scoring.semantic_scores(rows)
    got = {r["id"]: (r["bert_score"], r["sema_score"]) for r in good.collect()}
    assert got[1] == pytest.approx((1.0, 1.0)) and got[2] == (None, None) and bad.count() == 0

    def axes(text):
        words = text.split()
        return words, np.array([[1.0, 0.0] if w in ("the", "cat") else [0.0, 1.0] for w in words])

    # two words kept, of which one counts as much as the mean tells, one replaced by an unlike one of no common letter
    _, score = scoring.semantic_score("the cat sat", "the cat the", axes)
    near, far = (2 / 5**0.5 + 1) / 2, (1 / 5**0.5 + 1) / 2
    assert score == pytest.approx((2 * near + far * 0.5 * scoring.match_rate("sat", "the")) / (2 * near + far))
    assert scoring.edit_script("kitten", "sitting") == "$itt$n-" and scoring.edit_script("abc", "") == "+++"

    def failing():
        def encode(text):
            raise ValueError("no model")

        return encode

    good, bad = scoring.semantic_scores(rows.where("id = 1"), failing)
    assert good.count() == 0 and bad.count() == 1


def test_turns(spark):
    rows = [("c", 1, 0, "front matter"), ("c", 1, 1, "JUDGE 1: 3 yes"), ("c", 1, 2, "11:00 AM IST"), ("c", 1, 3, "7 11:30 AM"), ("c", 1, 4, "8 42"), ("c", 2, 0, "4 go on."), ("c", 2, 1, "THE WITNESS:"), ("c", 2, 2, "COUNSEL 2: [UNCLEAR]"), ("c", 3, 0, "RAO: done"), ("c", 3, 1, None)]
    got = turns.assemble_turns(spark.createDataFrame(rows, "case_id string, page int, line_no int, line string"))
    assert sorted(map(tuple, got.collect())) == [("c", 1, "JUDGE", "3 yes 11:30 am go on"), ("c", 2, "RAO", "done")]
    assert turns.manifest(got).first()["text"] == "3 yes 11:30 am go on | done"


def model_chunks(start, end, words, limit):
    """The packing rule told another way: for each word, what becomes of it."""
    out, held, begin, last = [], [], start, start
    queue = list(words)
    while queue:
        a, b, w = queue[0]
        if begin >= end or a >= end:
            break
        if a >= begin and b - begin <= limit:
            held.append(w)
            last = b
            queue.pop(0)
        elif a < begin:
            queue.pop(0)
        elif held:
            out.append((begin, last, " ".join(held)))
            begin, held = last, []
        else:
            break
    return out + ([(begin, last, " ".join(held))] if held else [])


def test_packing_against_model():
    rng = random.Random(1)
    for _ in range(2000):
        at, words = rng.randint(-5, 5), []
        for k in range(rng.randint(0, 12)):
            at += rng.randint(0, 12)
            length = rng.randint(0, 14)
            words.append((at, at + length, f"w{k}"))
            at += length
        end = rng.randint(1, 90)
        assert align.chunks_of(0, end, words, 30) == model_chunks(0, end, words, 30)
    assert align.chunks_of(0, 100, [(0, 30, "a")], 30) == [(0, 30, "a")]
    assert align.chunks_of(0, 100, [(0, 31, "a"), (31, 32, "b")], 30) == []
    assert align.chunks_of(0, 100, [], 30) == []


def test_overlap_join(spark):
    rng = random.Random(2)
    s = [("c", i, a, a + rng.randint(0, 90_000)) for i in range(20) for a in [rng.randint(0, 200_000)]]
    w = [("c", i, f"w{i}", a, a + rng.randint(0, 40_000)) for i in range(60) for a in [rng.randint(0, 260_000)]]
    got = align.attach_words(spark.createDataFrame(s, "case_id string, seg_no int, start_ms bigint, end_ms bigint"), spark.createDataFrame(w, "case_id string, word_no int, word string, start_ms bigint, end_ms bigint"))
    want = sorted((x[1], y[1]) for x in s for y in w if y[4] > x[2] and y[3] < x[3])
    assert sorted((r["seg_no"], r["word_no"]) for r in got.collect()) == want


def test_containment_join(spark):
    t = spark.createDataFrame([("c", 1, "so yesterday it was"), ("c", 2, "yes we go on now"), ("d", 1, "yes")], "case_id string, dialogue_no int, dialogue string")
    s = spark.createDataFrame([("c", 1, "yes"), ("c", 2, "we go on"), ("c", 3, ""), ("c", 4, "nowhere to be found"), ("d", 1, "yes"), ("c", 5, "es we g")], "case_id string, seg_no int, text string")
    got = sorted(map(tuple, align.attach_speaker(s, t).collect()))
    assert got == [("c", 1, 1), ("c", 2, 2), ("c", 3, 1), ("c", 5, 2), ("d", 1, 1)]


def test_timeline(spark):
    s = spark.createDataFrame([("c", 1, 100, 200), ("c", 2, 500, 900), ("c", 1500, 1000, 1001)], "case_id string, seg_no int, start_ms bigint, end_ms bigint")
    assert [(r["new_start_ms"], r["new_end_ms"]) for r in align.timeline(s).orderBy("seg_no").collect()] == [(0, 100), (100, 500), (500, 501)]


@pytest.mark.parametrize(("n", "sizes"), [(4, (4, 0, 0)), (5, (3, 1, 1)), (6, (3, 2, 1)), (9, (6, 2, 1)), (10, (6, 3, 1)), (11, (6, 3, 2)), (20, (13, 5, 2)), (50, (34, 11, 5)), (100, (69, 21, 10))])
def test_split_sizes(spark, n, sizes):
    got = splits.stratified_split(spark.range(n).select("id", F.lit(None).cast("string").alias("speaker")), "speaker", F.col("id").cast("string"))
    count = dict(got.groupBy("split").count().collect())
    assert tuple(count.get(s, 0) for s in ("train", "validation", "test")) == sizes


def test_relational(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, None)], "k string, at int, v string")
    assert sorted(map(tuple, splits.last_by_key(rows, "k", "at").collect())) == [("a", 1, "z"), ("b", 2, None)]
    with pytest.raises(ValueError, match="4 rows wanted"):
        splits.first_rows(rows, F.col("at"), 4)
    assert sorted(r["at"] for r in splits.mix_datasets([rows, rows.where("at > 1")], 1, F.col("at"), 2).collect()) == [1, 2, 2, 3]
    with pytest.raises(ValueError, match="2 rows wanted"):
        splits.mix_datasets([rows, rows.where("at > 2")], 1, F.col("at"), 2)
    wanted = spark.createDataFrame([("a", 9), ("b", 8)], "k string, more int")
    assert sorted(map(tuple, splits.with_values(wanted, rows, "k", "at").collect())) == [("a", 9, "z"), ("b", 8, None)]
    with pytest.raises(ValueError, match="no value"):
        splits.with_values(wanted.union(wanted.select(F.lit("q"), "more")), rows, "k", "at")
    assert sorted((r["v"], r["case_id"]) for r in splits.case_keys(rows.where("v is not null").withColumn("case_id", F.lit("old")), "at").collect()) == [("x", "case1"), ("z", "case2")]


def test_labels_of_448(spark):
    lengths = spark.createDataFrame([(n,) for n in (0, 1, 447, 448)], "n int")
    kept = lengths.where(V.label_length_ok(F.array_repeat(F.lit(7), F.col("n")), 448))
    assert sorted(r["n"] for r in kept.collect()) == [1, 447]


def test_aligned_chunks(spark):
    seg = spark.createDataFrame([("c", 1, 0, 900, "so be it"), ("c", 2, 1000, 1400, "nowhere"), ("d", 1, 0, 500, "yes")], "case_id string, seg_no int, start_ms bigint, end_ms bigint, text string")
    words = spark.createDataFrame([("c", 1, "so", 0, 300), ("c", 2, "be", 300, 600), ("c", 3, "it", 600, 900), ("c", 4, "nowhere", 1000, 1400)], "case_id string, word_no int, word string, start_ms bigint, end_ms bigint")
    said = spark.createDataFrame([("c", 1, "A", "well"), ("c", 2, "B", "so be it then"), ("d", 1, "A", "yes")], "case_id string, dialogue_no int, real_speaker string, dialogue string")
    got = align.aligned_chunks(seg, words, said, spark.createDataFrame([("c",), ("d",)], "case_id string")).collect()
    assert [tuple(r)[:8] for r in got] == [("c", 2, 1, 0, 0, 900, "so be it", "B")] and got[0]["file_name"].startswith("c_2_0_")
    assert align.aligned_chunks(seg, words, said, spark.createDataFrame([("d",)], "case_id string")).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [5, 6, 7]), ([0.0, 0.0], [1.0, 1.0], [])], "a array<double>, b array<double>, l array<int>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.pad_right(F.col("l"), 4, 0).alias("p"), V.shift_right(F.col("l"), 1).alias("s"), V.attention(F.col("l"), 4).alias("m"), V.mask_labels(V.pad_right(F.col("l"), 4, 0), F.size("l"), F.lit(1)).alias("k"), V.label_length_ok(F.col("l"), 4).alias("ok")).collect()
    assert r[0]["c"] == pytest.approx(0.5**0.5) and r[1]["c"] is None
    assert r[0]["p"] == [5, 6, 7, 0] and r[0]["s"] == [1, 5, 6] and r[0]["m"] == [1, 1, 1, 0] and r[0]["k"] == [-100, 6, 7, -100]
    assert [x["ok"] for x in r] == [True, False] and r[1]["p"] == [0, 0, 0, 0] and r[1]["s"] == [1]


def test_more_scores(spark):
    a = np.eye(3)
    assert scoring.bert_score(a, a) == pytest.approx(1.0) and scoring.bert_score(a[:0], a) is None
    assert scoring.pool_words(["re", "##ad", "it"], np.array([[1.0], [3.0], [5.0]]), ["read", "it"]).tolist() == [[2.0], [5.0]]
    assert scoring.pool_words(["re", "##ad", "it"], np.array([[1.0], [3.0], [5.0]]), ["read it", ""]).tolist() == [[3.0], [0.0]]
    with pytest.raises(ValueError, match="spell"):
        scoring.pool_words(["re"], np.array([[1.0]]), ["other"])
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id bigint, text string")
    assert sorted((r["id"], len(r["vector"])) for r in scoring.embed_texts(rows, batch=1).collect()) == [(1, 64), (3, 64)]
    tokens = spark.createDataFrame([(1, "reading it"), (2, None)], "id bigint, text string")
    assert [(r["pieces"], len(r["vectors"])) for r in scoring.embed_tokens(tokens, most=2).collect()] == [(["readi", "##ng"], 2)]


def test_row_index(spark):
    got = splits.row_index(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), "k").collect()
    assert all(r["k"] == r["idx"] for r in got) and len(got) == 1000


def test_collated_keeps_long_labels(spark):
    from voxledger.plans.queries import collated

    rows = spark.createDataFrame([(1, list(range(1, 51))), (2, [7, 8, 9])], "row_id bigint, labels array<int>")
    got = {r["row_id"]: r for r in collated(rows).collect()}
    assert got[1]["attended"] == 50 and got[1]["labels"].split(",") == ["-100"] * 2 + [str(x) for x in range(3, 51)]
    assert got[1]["inputs"].split(",") == ["1", *[str(x) for x in range(1, 50)]]
    assert got[2]["attended"] == 3 and got[2]["labels"].split(",") == ["-100", "-100", "9"] + ["-100"] * 47
    assert got[2]["inputs"].split(",") == ["1", "7", "8", "9"] + ["0"] * 46
