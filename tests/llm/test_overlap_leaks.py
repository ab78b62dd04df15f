import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxledger.llm import leaks, overlap
from voxledger.llm.words import common_in_order, plain_words, position_masks

VERBS = "saw took held kept sold read wrote moved signed found".split()
NOUNS = ["%s%s%s%sl" % (a, b, c, e) for a in "bcdfghjklm" for b in "aeiou" for c in "nrst" for e in "aeo"]


def sentence(rng, n):
    return " ".join(rng.choice(NOUNS if i % 3 else VERBS) for i in range(n))


@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
@settings(max_examples=200, deadline=None)
def test_common_in_order(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert common_in_order(a, position_masks(b), len(b)) == t[-1][-1]


def test_plain_words():
    assert plain_words("Um, I mean it's [noise] A-b (12:30) 11:30 PM (laughs) *coughs* you know uh so") == ["its", "a", "b", "so"]
    assert plain_words("") == [] and plain_words("a<space>b") == ["a", "b"]


def test_cross_split(spark):
    rng = random.Random(5)
    base = [sentence(rng, 30) for _ in range(60)]
    stock = sentence(rng, 14)

    def noisy(t, k):
        w = t.split()
        for i in rng.sample(range(len(w)), k):
            w[i] = "zz"
        return " ".join(w)

    name = "/a/case{}_2022_01_01_{}_0_{:08x}.wav".format
    train = [(i, name(1, i, i), t) for i, t in enumerate(base)] + [(100 + i, None, stock + " " + sentence(rng, 12)) for i in range(60)] + [(200, name(3, 1, 7), None), (201, None, None), (202, None, ""), (203, None, base[0])]
    held = [(1000 + i, None, noisy(base[i], i % 6)) for i in range(40)] + [(1100 + i, None, stock + " " + sentence(rng, 12)) for i in range(60)] + [(1200, "x\\CASE-3_20220101_1_0_00000001.mp3", "short"), (1201, None, None), (1202, None, base[0].upper() + "!"), (1203, None, noisy(base[50], 12))]
    t = spark.createDataFrame(train, "row_id bigint, audio_path string, transcription string").selectExpr("*", "'x' AS words", "1 AS n_words")
    e = spark.createDataFrame([(*h, "test") for h in held], "row_id bigint, audio_path string, transcription string, split string")
    got = {(r["row_id_train"], r["row_id_eval"]) for r in overlap.cross_split(t, e).collect()}

    def same(a, b):
        a, b = plain_words(a or ""), plain_words(b or "")
        return min(len(a), len(b)) >= 16 and common_in_order(a, position_masks(b), len(b)) >= math.ceil(0.8 * max(len(a), len(b)))

    want = {(x[0], y[0]) for x in train for y in held if same(x[2], y[2])} | {(200, 1200)}
    assert got == want and len(want) > 40
    assert overlap.cross_split(t.limit(0), e).count() == 0 and overlap.cross_split(t, e.limit(0)).count() == 0
    report = {(r["split"], r["case_id"]): (r["n_pairs"], r["n_records"]) for r in overlap.report(overlap.cross_split(t, e)).collect()}
    assert report[("test", "case3")] == (1, 1)


def test_near_copies_of_one_text(spark):
    """A third of the evaluation texts are one utterance with one word changed, the same in train."""
    rng = random.Random(7)
    base = sentence(rng, 30).split()
    variants = [" ".join([*base[: k % 30], f"changed{k}", *base[k % 30 + 1 :]]) for k in range(320)]
    other = [sentence(rng, 30) for _ in range(640)]
    train = [(0, " ".join(base)), (1, variants[3]), (2, variants[200] + " more words"), (3, other[0]), (4, sentence(rng, 30))]
    t = spark.createDataFrame([(i, None, x) for i, x in train], "row_id bigint, audio_path string, transcription string")
    e = spark.createDataFrame([(1000 + i, None, x, "test") for i, x in enumerate(variants + other)], "row_id bigint, audio_path string, transcription string, split string")
    got = {(r["row_id_train"], r["row_id_eval"]) for r in overlap.cross_split(t, e).collect()}
    assert got == {(i, 1000 + k) for i in (0, 1, 2) for k in range(320)} | {(3, 1320)}


def test_matches_in_small_portions(monkeypatch):
    rng = random.Random(8)
    base = [sentence(rng, 20) for _ in range(4)]
    texts = sorted({" ".join([*b.split()[:k], "x", *b.split()[k + 1 :]]) for b in base for k in range(20)})
    shard = overlap.Passages(texts)
    whole = sorted(shard.matches(shard.numbers(texts)))
    monkeypatch.setattr(overlap, "AT_ONCE", 7)
    assert sorted(shard.matches(shard.numbers(texts))) == whole and len(whole) == 4 * 20 * 20


@pytest.mark.parametrize(("n", "wrong"), [(20, [5, 10, 15, 19]), (40, range(4, 40, 5)), (16, [4, 8, 12]), (25, [4, 9, 14, 19, 24])])
def test_spread_errors(n, wrong):
    """Every run of five words is broken, and still four fifths agree."""
    words = sentence(random.Random(n), n).split()
    changed = ["other" if i in wrong else w for i, w in enumerate(words)]
    shard = overlap.Passages([" ".join(words)])
    assert [x[:2] for x in shard.matches(shard.numbers([" ".join(changed)]))] == [(0, 0)]


@given(st.integers(16, 60), st.integers(0, 10**6))
@settings(max_examples=400, deadline=None)
def test_no_agreeing_text_is_lost(n, seed):
    """Words changed, lost and put in anywhere, in company of texts of the same few words: what agrees is met."""
    rng = random.Random(seed)
    few = NOUNS[:40]
    words = [rng.choice(few) for _ in range(n)]
    texts = {" ".join(words)} | {" ".join(rng.choice(few) for _ in range(rng.randint(16, 60))) for _ in range(20)}
    for _ in range(20):
        other = list(words)
        for _ in range(rng.randint(0, n // 4)):
            i, kind = rng.randrange(len(other)), rng.randrange(3)
            other[i : i + (kind < 2)] = [] if kind == 0 else [rng.choice(few)]
        if len(other) >= 16:
            texts.add(" ".join(other))
    texts = sorted(texts)
    shard = overlap.Passages(texts)
    got = {x[:2] for x in shard.matches(shard.numbers(texts))}
    assert got == {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if common_in_order(x.split(), position_masks(y.split()), len(y.split())) >= math.ceil(0.8 * max(len(x.split()), len(y.split())) - 1e-9)}


def test_shards_by_words(spark):
    rows = spark.createDataFrame([(i, "w " * 19 + "w", 20) for i in range(300)] + [(1000, "w " * 899 + "w", 900)], "row_id bigint, words string, n_words int")
    sizes = [r["n"] for r in overlap.laid(rows, 1000).groupBy(F.spark_partition_id()).agg(F.sum(F.size(F.split("words", " "))).alias("n")).collect()]
    assert sum(sizes) == 6900 and 5 <= len(sizes) <= 10 and max(sizes) < 2500
    assert overlap.laid(rows.limit(0), 1000).count() == 0


def test_equal_texts_are_looked_at_once(spark):
    """Copies of a text lie in one partition, their pairs come from one comparison, and every row counts."""
    rng = random.Random(11)
    base = [sentence(rng, 24) for _ in range(3)]
    near = " ".join([*base[0].split()[:-1], "other"])
    held = [base[0], near, sentence(rng, 24)]
    train = [(i, f"x/case{i % 2 + 1}_2022_01_01_7_{i % 4}_00000001.wav", base[i % 3]) for i in range(60)]
    evaluation = [(1000 + i, "case1_2022_01_01_7_0_00000002.wav" if i % 5 == 0 else None, held[i % 3], "test") for i in range(30)]
    t = spark.createDataFrame(train, "row_id bigint, audio_path string, transcription string")
    e = spark.createDataFrame(evaluation, "row_id bigint, audio_path string, transcription string, split string")
    a, b = overlap.read_records(t), overlap.read_records(e, "split")
    spread = overlap.laid(a, 50, key=overlap.TEXT).select(*overlap.TEXT, F.spark_partition_id().alias("p")).groupBy(*overlap.TEXT).agg(F.count_distinct("p").alias("n"), F.count("*").alias("rows")).collect()
    assert [(r["n"], r["rows"]) for r in spread] == [(1, 20)] * 3
    assert sorted(r["common"] for r in overlap.near_texts(a, b).collect()) == [23, 24]
    got = [(r["row_id_train"], r["row_id_eval"], r["split"], r["case_id"]) for r in overlap.cross_split(t, e).collect()]
    same = lambda x, y: (x[2] == base[0] and y[2] in held[:2]) or (y[1] is not None and x[1].startswith("x/case1_") and x[0] % 4 == 0)
    assert sorted(got, key=lambda r: r[:2]) == [(x[0], y[0], "test", y[1] and "case1") for x in train for y in evaluation if same(x, y)]


def test_coverage():
    assert overlap.covered([0, 3, 20], 5) == 8 + 5 and overlap.covered([]) == 0


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, 50)) for i in range(30)] + [(90, None), (91, ""), (92, "12 34")]
    text = dict(items)
    formula = " we have heard learned counsel at some length and perused the whole record of this matter "
    items[0] = (0, text[0] + formula)

    def part(i, a, b):
        return " ".join(text[i].split()[a:b])

    def misread(t):
        return " ".join(w[:-1] if k % 9 == 4 and len(w) > 6 else w for k, w in enumerate(t.split()))

    filler = lambda n: sentence(rng, n)
    docs = [(k, filler(200) + formula) for k in range(150)]
    docs += [(1000, filler(80) + " " + text[1] + " " + filler(80)), (1001, part(2, 10, 40)), (1002, filler(60) + " " + part(3, 0, 12)), (1003, " ".join(rng.sample(text[4].split(), 50))), (1004, text[5].upper().replace(" ", ",\n")), (1005, part(6, 0, 25) + ". " + filler(20) + " " + part(6, 25, 50)), (1006, None), (1007, ""), (1008, misread(text[7])), (1009, text[1]), (1009, text[1]), (1010, filler(30_000) + " " + text[8])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, leaks.find_leaks(d, i).collect()))
    assert got == [(1000, 1), (1001, 2), (1004, 5), (1005, 6), (1008, 7), (1009, 1), (1009, 1), (1010, 8)]
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_leaks_in_many_copies(spark):
    """A quoted part of an item isn't a formula because many documents quote it; a formula of several items is one."""
    rng = random.Random(9)
    formula = sentence(rng, 25)
    items = [(i, sentence(rng, 50)) for i in range(20)] + [(50 + i, sentence(rng, 30) + " " + formula) for i in range(8)]
    part = {i: " ".join(t.split()[:30]) for i, t in items}
    docs = [(k, sentence(rng, 80)) for k in range(800)] + [(1000 + k, sentence(rng, 60) + " " + formula + " " + sentence(rng, 20)) for k in range(100)]
    equal = sentence(rng, 40) + " " + part[1]
    docs += [(2000 + k, equal) for k in range(30)] + [(3000 + k, sentence(rng, 40) + " " + part[2] + " " + sentence(rng, 10)) for k in range(30)] + [(4000, part[3])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(map(tuple, leaks.find_leaks(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()))
    assert got == [(2000 + k, 1) for k in range(30)] + [(3000 + k, 2) for k in range(30)] + [(4000, 3)]


def test_leaks_in_few_of_many_documents(spark):
    """The space is fitted on all documents: what one of many quotes has its directions, too."""
    words = iter(["%s%s" % (a, b) for a in NOUNS for b in NOUNS])
    items = [(i, " ".join(next(words) for _ in range(25))) for i in range(40)]
    docs = [(k, "nothing of any item here") for k in range(12_000)] + [(20_000 + i, "before " + t + " after") for i, t in items]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(map(tuple, leaks.find_leaks(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()))
    assert got == [(20_000 + i, i) for i, _ in items]


def test_space_of_all_documents(spark, monkeypatch):
    rng = random.Random(11)
    texts = [leaks.item_words(sentence(rng, 30)) for _ in range(12)]
    vocabulary = leaks.Vocabulary(texts)
    pairs = leaks.Pairs([vocabulary.numbers(t) for t in texts], vocabulary.size)
    docs = [(k, b" ".join(rng.choice(texts)[: rng.randint(2, 30)]).decode()) for k in range(6_000)]
    numbered = leaks.number_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), vocabulary)
    idf = np.append(np.linspace(1, 2, pairs.size), 0)

    def features(batch):
        flat, begin, blocks = leaks.lay([np.frombuffer(x, dtype=np.uint16) for x in batch], vocabulary.size)
        return None, begin, blocks, pairs.of(flat)

    _, _, blocks, pair = features([x["ids"] for x in numbered.collect()])
    passages = leaks.window_vectors(np.vstack([np.diag(idf[:-1]), np.zeros(pairs.size)]), pair, blocks)[0]
    want = np.random.default_rng(0).standard_normal((pairs.size + 1, leaks.RANK))[:-1]
    for _ in range(leaks.ROUNDS):
        want = np.linalg.qr(passages.T @ (passages @ want))[0]
    got = leaks.fit_space(numbered.repartition(7), features, idf)[:-1]
    assert np.allclose(got @ got.T, want @ want.T, atol=0.01)


def test_candidates_beside_the_space():
    """A document that holds enough of an item's pairs is looked at whatever the space says; here it says nothing."""
    rng = random.Random(12)
    texts = [leaks.item_words(sentence(rng, 40)) for _ in range(12)] + [[], [b"alone"]]
    vocabulary = leaks.Vocabulary(texts)
    items = [vocabulary.numbers(t) for t in texts]
    pairs = leaks.Pairs(items, vocabulary.size)
    common, formula = (np.append([rng.random() < p for _ in range(pairs.size)], False) for p in (0.5, 0.3))
    formula = (common & formula) | np.isin(np.arange(pairs.size + 1), pairs.of(items[3])[:-1])
    common = common | formula
    find = leaks.Search(list(range(len(items))), items, pairs, np.zeros((pairs.size + 1, leaks.RANK), dtype=np.float32), common, formula)
    parts = [np.concatenate([items[k][: rng.randint(2, 40)] for k in rng.sample(range(12), rng.randint(1, 4))]) for _ in range(300)] + [items[0][:0]]
    flat, begin, blocks = leaks.lay(parts, vocabulary.size)
    got = {(d, k) for d, ks in find.candidates(pairs.of(flat), blocks) for k in ks}
    want = set()
    for d, part in enumerate(parts):
        held = set(pairs.of(part).tolist()) - {pairs.size}
        for k in range(12):
            own = set(pairs.of(items[k])[:-1].tolist())
            own = {p for p in own if not formula[p]} or own
            rare = {p for p in own if not common[p]}
            n, shared = len(held & rare), len(held & own - rare)
            if n + shared and n >= 0.2 * len(rare) or shared and n + shared >= 0.2 * (len(rare) + shared):
                want.add((d, k))
    assert got == want and 300 < len(want) < 12 * 300


@pytest.mark.parametrize(("a", "b"), [(b"tanslated", b"translated"), (b"refinerry", b"refinery"), (b"certifed", b"certified"), (b"judgmemt", b"judgment")])
def test_misread(a, b):
    v = leaks.Vocabulary([[b, b"other", b"um", b"12"]])
    assert v.numbers([a, b"um", b"99", b"unknownword"]).tolist() == [0, v.size]
