import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxledger.llm import edits, names, turns

NICK = [("RAVIJOTHA", "RAV"), ("RAVIJOTHA", "RAVIJ"), ("DAMIRUDEV", "DAM"), ("KARADEV", "CHOTDDI"), ("KARADASHAN", "KARA")]


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=300, deadline=None)
def test_distances(a, b):
    d = edits.levenshtein(a, b)
    assert (d == 0) == (a == b) and edits.levenshtein(b, a) == d
    assert edits.damerau(a, b, 9) <= d
    assert edits.damerau(a, b, 1) == min(edits.damerau(a, b, 9), 2)


def test_radius_join(spark):
    rng = random.Random(4)
    some = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(300)})
    got = {tuple(r) for r in names.radius_join(spark.createDataFrame([(x,) for x in some], "name string")).collect()}
    assert got == {(a, b) for a in some for b in some if a < b and edits.levenshtein(a, b) <= 2}
    assert names.radius_join(spark.createDataFrame([], "name string")).count() == 0


PEOPLE = [
    ["MS. RAVIJOTHA EKSHUSAR", "RAVIJOTHA  EKSHUSAR", "EKSHUSAR, RAVIJOTHA", "EKSHUSAR RAVIJOTHA", "MS. RAVIJ EKSHUSAR", "RAV EKSHUSAR", "R_EKSHUSAR", "Ms. Ravijotha Ekshusar", "RAVIJOTHA EKSHSUAR", "MS RAVIJOTHA EKSHUSAR (VIA VIDEO LINK)", "MS. RAVIJOTHA EKSHUSAR:"],
    ["DR. DAMIRUDEV V. EKSHUSAR", "DV EKSHUSAR", "DAM1RUDEV EKSHUSAR", "DR. D. V. EKSHUSAR", "EKSHUSAR DAMIRUDEV V."],
    ["JUSTICE KARADEV VARVEK", "VARVEK J.", "Varvek, J", "CJ K_VARVEK", "KARA. VARVEK", "HON'BLE MR. JUSTICE VARVEK"],
    ["CENTRAL TEXTILE BOARD OF ZELLTOR", "THE CENTRAL TEXTILE BOARD OF ZELLTOR", "ZELLTOR, CENTRAL TEXTILE BOARD OF", "CEN. TEXTILE BOARD, ZELLTOR", "CENTRAL TEXTLE BOARD OF ZELLTOR", "COUNSEL FOR CTB ZELLTOR", "C.T.B. ZELLTOR", "CENTRAL TEXTILE BD. OF ZELLTOR", "CENTRAL TEXTILE BOARD (ZELLTOR)"],
    ["STATE BANK OF INDIMOOR", "INDIMOOR, STATE BANK OF", "STATE BANK (INDIMOOR)", "STATE BNAK OF INDIMOOR", "ST. BANK, INDIMOOR"],
]


def test_variants(spark):
    roles = ["JUDGE 1", "COURT MASTER", "THE WITNESS", "PETITIONER'S COUNSEL 1"]
    labels = [(x, 3) for p in PEOPLE for x in p] + [(x, 9) for x in roles] + [(None, 1), (" ", 1), ("???", 1), ("X" * 5000, 1)]
    resolved = names.resolve_labels(spark.createDataFrame(labels, "label string, n bigint"), spark.createDataFrame(NICK, "given_name string, nickname string"))
    pairs = {tuple(r) for r in names.variant_pairs(resolved).collect()}
    assert pairs == {(a, b) for p in PEOPLE for a in p for b in p if a < b}
    none = names.resolve_labels(spark.createDataFrame([], "label string, n bigint"), spark.createDataFrame(NICK, "given_name string, nickname string"))
    assert none.count() == 0


ROWS = [
    (1, "c", 1, None, "before anyone spoke"),
    (2, "c", 2, "MS. RAVIJOTHA EKSHUSAR", "[10:20:30] Um, yes. (laughs) >> JUDGE 1: go on uh"),
    (3, "c", 3, None, "and on, please see NOTE: as marked"),
    (4, "c", 4, "RAV EKSHUSAR", "um... [Laughter]"),
    (5, "c", 5, None, "with this \nRAVIJOTHA  EKSHUSAR: thank you. 11:30 AM JUDGE 1: no"),
    (6, "c", 7, "JUDGE 1", "right"),
    (60, "c", 7, "JUDGE 1", "right"),
    (7, "c", 9, "EKSHUSAR, RAVIJOTHA", None),
    (8, "c", 10, "JUDGE 1", ""),
    (9, "c", 11, "R_EKSHUSAR", "(12:34) am here"),
    (10, "d", 1, "JUDGE 1", "alone"),
    (13, "d", 2, "RAV EKSHUSAR", "see NOTE: as marked"),
    (14, "d", 3, "JUDGE 1", "NOTE: as marked"),
    (11, None, 1, "JUDGE 1", "nowhere"),
    (12, "d", None, "JUDGE 1", "nowhere"),
]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_turns(spark, block):
    rows = spark.createDataFrame(ROWS, "turn_id bigint, case_id string, dialogue_no int, real_speaker string, dialogue string")
    nick = spark.createDataFrame(NICK, "given_name string, nickname string")
    numbered = turns.number_turns(turns.fragments(rows, nick, texts=True), block)
    got = sorted((r["case_id"], r["first_dialogue_no"], r["turn_in_row"], r["last_dialogue_no"]) for r in turns.turn_rows(numbered).collect())
    assert got == [("c", 1, 1, 1), ("c", 2, 1, 2), ("c", 2, 2, 5), ("c", 5, 1, 5), ("c", 5, 2, 7), ("c", 11, 1, 11), ("d", 1, 1, 1), ("d", 2, 1, 2), ("d", 3, 1, 3)]
    if block == 1000:
        texts = {(r["case_id"], r["turn_no"]): r["text"] for r in turns.turn_texts(numbered).collect()}
        assert texts[("c", 2)] == "yes." and texts[("c", 3)] == "go on and on, please see NOTE: as marked with this"
        assert texts[("c", 6)] == "am here"


def test_no_turns(spark):
    rows = spark.createDataFrame([], "turn_id bigint, case_id string, dialogue_no int, real_speaker string, dialogue string")
    nick = spark.createDataFrame(NICK, "given_name string, nickname string")
    assert turns.turn_rows(turns.number_turns(turns.fragments(rows, nick))).count() == 0


NICK_SCHEMA, ROW_SCHEMA = "given_name string, nickname string", "turn_id bigint, case_id string, dialogue_no int, real_speaker string, dialogue string"


def test_mined_slots(spark):
    """Speakers that are never typed come out of a layout that mostly holds typed ones; a typed name in a layout of marks doesn't."""
    typed = ["MS. RAVIJOTHA EKSHUSAR", "JUSTICE KARADEV VARVEK", "DR. DAMIRUDEV OSTMONT"]
    rows = [(i, "a", i, typed[i % 3], f"the matter stands over >> {typed[(i + 1) % 3]}: so be it") for i in range(30)]
    rows += [(100 + i, "b", i, typed[0], f"kindly look at {x}: as marked") for i, x in enumerate(["SCHEDULE 4", "LEDGER C", "MEMO 9"] * 6)]
    rows += [(200, "c", 1, typed[0], "we rise now >> MR. ZOLTUM QUARN: thank you >> Q: well"), (201, "c", 2, typed[1], "kindly look at JUSTICE KARADEV VARVEK: as marked"), (202, "c", 3, typed[2], "X" * 300 + " is long >> " + "VERY " * 40 + "LONG NAME: yes")]
    df, nick = spark.createDataFrame(rows, ROW_SCHEMA), spark.createDataFrame(NICK, NICK_SCHEMA)
    got = {(r["dialogue_no"], r["frag_no"]): (r["speaker"], r["text"]) for r in turns.fragments(df, nick, texts=True).where("case_id = 'c'").collect()}
    assert got[(1, 1)] == ("MR. ZOLTUM QUARN", "thank you") and got[(1, 2)] == ("Q", "well")
    assert got[(2, 0)] == (typed[1], "kindly look at JUSTICE KARADEV VARVEK: as marked") and (2, 1) not in got
    assert got[(3, 1)][0].endswith("LONG NAME")


def test_mined_times(spark):
    """Forms whose values are spread like times are cut out; numbers of the same marks aren't."""
    rng = random.Random(2)
    two = lambda: f"{rng.randrange(60):02d}"
    rows = [(i, "a", i, "JUDGE 1", f"{rng.randrange(24)}h{two()} we sit [00:{two()}:{two()}.{rng.randrange(1000):03d}] at ratio 1:{rng.randrange(100, 999)} of 3.{rng.randrange(100):02d}") for i in range(80)]
    rows += [(900, "b", 1, "JUDGE 1", "09h15"), (901, "b", 2, "JUDGE 2", "[00:01:02.500]"), (902, "b", 3, "JUDGE 3", "1:345"), (903, "b", 4, "JUDGE 4", "ummm, mm-hmm you know hmmm")]
    df, nick = spark.createDataFrame(rows, ROW_SCHEMA), spark.createDataFrame(NICK, NICK_SCHEMA)
    forms = {r["form"]: r["is_time"] for r in turns.clock_forms(turns.mine(turns.placed(df))).collect()}
    assert forms["[99:99:99.999]"] and forms["99h99"] and not forms["9:999"] and not forms["9.99"]
    got = {r["dialogue_no"]: r["text"] for r in turns.fragments(df, nick, texts=True).where("case_id = 'b'").collect()}
    assert got == {3: "1:345"}


@pytest.mark.parametrize("text", ["ummm", "hmmm, uhhh", "you know ummm", "", "--", "um yes", "umbrella", "I mean it", "i mean", "mm-hmm uh"])
def test_one_meaning_of_wordless(text):
    assert turns.has_words(text) == bool(turns.clean(text))
