import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxledger.llm import packing, truncation


@given(st.lists(st.integers(1, 100), max_size=80), st.booleans())
@settings(max_examples=300, deadline=None)
def test_pack(sizes, fill_room):
    bins = packing.pack(sizes, 100, fill_room)
    load, own = {}, {}
    for s, (b, in_room) in zip(sizes, bins):
        load[b] = load.get(b, 0) + s
        if not in_room:
            own.setdefault(b, []).append(s)
    assert len(bins) == len(sizes) and all(x <= 100 for x in load.values())
    assert fill_room or not any(r for _, r in bins)
    # a container is one class's, and but for the last of each class holds its fixed count
    kinds = {b: {min(100 // s, packing.CLASSES) for s in x} for b, x in own.items()}
    assert set(own) == set(load) and all(len(k) == 1 for k in kinds.values())
    short = [min(k) for b, k in kinds.items() if min(k) < packing.CLASSES and len(own[b]) != min(k)]
    assert len(short) == len(set(short)) and all(len(own[b]) <= min(k) for b, k in kinds.items() if min(k) < packing.CLASSES)
    if fill_room:
        assert len(load) <= 1.7 * math.ceil(sum(sizes) / 100) + 4


def test_classes():
    containers = lambda *a: len({b for b, _ in packing.pack(*a)})
    assert containers([60] * 5, 100) == 5 and containers([40] * 6, 100) == 3
    assert containers([60, 60, 20, 20, 20, 20], 100) == 2 and containers([60, 60, 20, 20, 20, 20], 100, False) == 3


def test_pack_items(spark):
    rows = [(1, 5000), (2, 2048), (3, 0), (4, None), (5, 1), (5, 1), (6, 2049)] + [(100 + i, 300 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").withColumn("sequence_id", F.lit("x")).withColumn("piece_no", F.lit(9))
    got = packing.pack_items(df)
    assert {r["s"] for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("s")).where("doc_id = 1").collect()} == {5000}
    assert got.groupBy("sequence_id").agg(F.sum("n_tokens").alias("s")).where("s > 2048").count() == 0
    per = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert per[1] == 3 and per[2] == 1 and per[5] == 2 and per[6] == 2 and 3 not in per and 4 not in per and per[150] == 1
    report = packing.fill_report(got).first()
    assert report["n_tokens"] == sum(n or 0 for _, n in rows) and report["fill"] > 0.9 and report["n_in_room"] > 0
    plain = packing.fill_report(packing.pack_items(df, fill_room=False)).first()
    assert plain["n_in_room"] == 0 and plain["n_tokens"] == report["n_tokens"] and plain["n_sequences"] >= report["n_sequences"]
    assert packing.fill_report(packing.pack_items(df.limit(0))).first()["n_sequences"] == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 50_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.count_tokens(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 50_000


def test_structure():
    broken = lambda t: truncation.endings(t)[0]
    assert broken("The order was made [inaud") and broken("see the ledge (see pa") and broken("the p &am") and broken("made <br") and broken("under \\u20") and broken("the ref�") and broken("through the regist…") and broken("the pa [...]") and broken('He said "we do')
    assert not broken("He said “we do.”") and not broken("Rest (left blank)") and not broken("a < b\n(x)") and not broken("(open\nclosed line.")


def test_truncated(spark):
    whole = "The {} reviewed the ledger. It was signed by the {} in due course."
    people = ["board", "union", "state", "tenant", "lessor", "lessee", "clerk", "court", "bench", "agent"]
    rows = []
    for k in range(300):
        t = (whole.format(people[k % 10], people[k // 10 % 10]) + " ") * (1 + k % 7)
        rows.append((k, t.strip() + ("\nCourt Master" if k % 5 == 0 else ""), f"s{k % 3}"))
    lists = "\n".join(f"{i}. Ledger {i}/2001 BOARD v. Union signed course" for i in range(1, 12))
    rows += [(500, lists, "s0"), (501, lists[:-12], "s0"), (502, lists[:-3], "s0"), (503, whole.format("board", "state")[:-9], "s1"), (504, "the board reviewed the ledger it was signed in due course", "s1"), (505, "the board reviewed the", "s1"), (506, "the board reviewed the led", "s1"), (507, None, "s1"), (508, "  ", "s1"), (509, "We heard both sides.\nCourt Mas", None), (510, "We heard “the union", "s2"), (511, "We heard “the union”", "s2")]
    rows += [(600 + k, (whole.format(people[k % 10], people[k // 10]) * 9)[k : k + 200], "capped") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("reason", F.lit("x")).withColumn("cut", F.lit(True))
    got = {r["doc_id"]: r["reason"] for r in truncation.truncated(df).collect()}
    assert {k for k, r in got.items() if r} == {501, 502, 503, 505, 506, 509, 510} | set(range(600, 630))
    assert 507 not in got and 508 not in got and all(got[600 + k] == "limit" for k in range(30))
    # an older, smaller field of the same source
    two = df.union(spark.createDataFrame([(700 + k, "xy " + (whole.format(people[k % 10], people[k // 10 + 3]) * 9)[k : k + 117], "capped", "x", True) for k in range(12)], df.schema))
    got = {r["doc_id"]: r["reason"] for r in truncation.truncated(two).where("source = 'capped'").collect()}
    assert set(got.values()) == {"limit"} and len(got) == 42
    shares = {r["source"]: r["share_cut"] for r in truncation.shares(truncation.truncated(df)).collect()}
    assert shares["capped"] == 1.0 and shares[None] == 1.0
    assert truncation.truncated(df.limit(0)).count() == 0
