import pytest
from pyspark.sql import functions as F

from voxledger.functions import text as T

CASES = [
    (T.expand_contractions, "I'll say I'm and i'll", "I'll say I am and i will"),
    (T.expand_contractions, "Aren't aren't they've", "Aren't are not they have"),
    (T.drop_fillers, "Um you know this UH works", "this  works"),
    (T.ascii_fold, "don’t café ﬁne \\u00e9", "dont cafe fine e"),
    (T.percent_words, "12% and 12.5%", "12 percent and 12.5 percent"),
    (T.open_citations, "1192-1195 and 1-2-3 (see 6A2)", "1192 to 1195 and 1 to 2 3 see 6 A2"),
    (T.open_citations, "1st Section 6A", "1 st Section 6 A"),
    (T.placeholders, "[UNCLEAR] a [unclear] b [noise]", "UNCLEAR a  b "),
    (T.drop_punctuation, "the 1 st at 11:30 AM, 1,000 is 12.5; so... ok?", "the 1st at 11:30 AM 1,000 is 12.5 so ok"),
    (T.drop_punctuation, "1 st, then", "1 st then"),
    (T.repair_ordinals, "1 st then 2 ND.'", "1st then 2ND"),
    (T.basic_normal, "A-B [x] <y> (z) c!", "a b c"),
    (T.clean_text, "I'm um sure (12%) of it. 42", "i am sure 12 percent of it"),
    (T.clean_speaker, " Judge 1 ", "JUDGE"),
    (T.speaker_key, "MR. R. FASHOLT", "FASHOLT"),
    (T.speaker_key, "J. V.", "Unknown"),
    (T.speaker_key, "A O'BRIEN", "O_BRIEN"),
    (T.drop_line_number, "12 the line", "the line"),
    (T.drop_punctuation, "at 11:30:45:50 or 10:20", "at 11:30:4550 or 10:20"),
    (T.direct_link, "https://x/t.pdf?dl=0", "https://x/t.pdf?dl=0"),
    (T.direct_link, "https://www.dropbox.com/t.mp3?dl=1", "https://www.dropbox.com/t.mp3?raw=1"),
    (T.prompt_family, "sets/gujarati_large", "indo"),
    (T.prompt_family, "sets/kannada", "dra"),
    (T.prompt_family, "sc", None),
]


@pytest.mark.parametrize(("f", "given", "wanted"), CASES)
def test_text(spark, f, given, wanted):
    df = spark.createDataFrame([(given,), (None,)], "t string").select(f(F.col("t")).alias("r"))
    assert [r[0] for r in df.collect()] == [wanted, None]


LINES = [
    ("JUDGE 1: yes", False, False, True),
    ("Mr Rao: yes", False, False, False),
    ("AT 11:30 WE MET", False, False, True),
    ("11:30 am", False, False, False),
    ("11:00 AM IST", False, True, False),
    ("42", True, True, False),
    ("End of day's proceedings", True, True, False),
    ("", False, False, False),
]


def test_line_predicates(spark):
    df = spark.createDataFrame([(x[0],) for x in LINES], "line string")
    got = df.select("line", T.is_boilerplate(F.col("line")), T.is_clock_line(F.col("line")), T.is_speaker_line(F.col("line"))).collect()
    assert [tuple(r) for r in got] == LINES
