"""Text functions of transcript cleaning, Column -> Column, all but ``ascii_fold`` inside the JVM.

Null stays null in every function; the empty text stays empty.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: contractions that are expanded, by exact case
CONTRACTIONS = {
    "aren't": "are not",
    "I'm": "I am",
    "you're": "you are",
    "we're": "we are",
    "they're": "they are",
    "there's": "there is",
    "I've": "I have",
    "you've": "you have",
    "we've": "we have",
    "they've": "they have",
    "he's": "he is",
    "she's": "she is",
    "i'll": "i will",
    "you'll": "you will",
    "we'll": "we will",
}
# fixed values: fillers
FILLERS = ["um", "uh", "you know"]

HIDDEN_COLON, HIDDEN_POINT, CLOCK_END = "\u0001", "\u0002", "\u0003"


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def expand_contractions(c: Column) -> Column:
    """The fifteen contractions written out; other cases and forms stay ("I'll" does, "i'll" doesn't)."""
    for short, full in CONTRACTIONS.items():
        c = F.regexp_replace(c, rf"\b{short}\b", full)
    return c


def drop_fillers(c: Column) -> Column:
    """Without fillers, in any case; blanks around them stay."""
    return F.trim(F.regexp_replace(c, rf"(?i)\b({'|'.join(FILLERS)})\b", ""))


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition without what ASCII lacks; literal \\uXXXX escapes are decoded first."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            if "\\u" in t:
                parts = t.split("\\u")
                t = parts[0] + "".join(chr(int(p[:4], 16)) + p[4:] if len(p) >= 4 and all(x in "0123456789abcdefABCDEF" for x in p[:4]) else "\\u" + p for p in parts[1:])
            return t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()

        return texts.map(one, na_action=None)

    # only what isn't plain ASCII goes to Python
    needs = c.rlike(r"[^\x00-\x7F]|\\u")
    return F.when(needs, fold(F.when(needs, c))).otherwise(c)


def percent_words(c: Column) -> Column:
    """"12%" as "12 percent"."""
    return squeeze(F.regexp_replace(c, r"\b(\d+)%", "$1 percent "))


def open_citations(c: Column) -> Column:
    """Parentheses away, number ranges as "a to b", other hyphens as blanks, a blank between digits and letters."""
    # fixed values: forms of ranges and citations
    c = F.regexp_replace(F.translate(c, "()", ""), r"(\d+)-(\d+)", "$1 to $2")
    c = F.translate(c, "-", " ")
    c = F.regexp_replace(c, r"(?i)\b((?:Article|Section|Page)\s+)?(\d+)([a-zA-Z])", "$1$2 $3")
    return F.regexp_replace(c, r"(?i)\b(\d+)([a-zA-Z])", "$1 $2")


def placeholders(c: Column) -> Column:
    """[UNCLEAR] and [INAUDIBLE] as words, any other bracketed text away."""
    c = F.replace(F.replace(c, F.lit("[UNCLEAR]"), F.lit("UNCLEAR")), F.lit("[INAUDIBLE]"), F.lit("INAUDIBLE"))
    return F.regexp_replace(c, r"\[[^\]\n]*\]", "")


def drop_punctuation(c: Column) -> Column:
    """Punctuation away where a word ends; clock times, decimals, ordinals and commas inside numbers stay. A clock time has three fields at most."""
    # fixed values: forms of ordinals, clock times, decimals and punctuation
    c = F.regexp_replace(c, r"(?i)(\d+)\s*(st|nd|rd|th)(?=\s|$)", "$1$2")
    c = F.regexp_replace(c, r"\b(\d{1,2}):(\d{2}):(\d{2})", f"$1{HIDDEN_COLON}$2{HIDDEN_COLON}$3{CLOCK_END}")
    c = F.regexp_replace(c, r"\b(\d{1,2}):(\d{2})", f"$1{HIDDEN_COLON}$2")
    c = F.regexp_replace(c, r"\b(\d+)\.(\d+)\b", f"$1{HIDDEN_POINT}$2")
    c = F.regexp_replace(c, r'[.,!?;"](?=\s|$|[.,!?;" ])', "")
    c = F.regexp_replace(F.regexp_replace(c, r"\.{2,}", ""), "[;:]", "")
    return squeeze(F.translate(c, HIDDEN_COLON + HIDDEN_POINT + CLOCK_END, ":."))


def repair_ordinals(c: Column) -> Column:
    """"1 st" as "1st"; the sequence .' away."""
    return F.replace(F.regexp_replace(c, r"(?i)(\b\d+)\s+((?:st|nd|rd|th)\b)", "$1$2"), F.lit(".'"), F.lit(""))


def basic_normal(c: Column) -> Column:
    """Lower case without bracketed text, marks and symbols."""
    c = F.regexp_replace(F.lower(c), r"[<\[][^>\]]*[>\]]", "")
    c = F.regexp_replace(c, r"\([^)]+\)", "")
    return squeeze(F.regexp_replace(c, r"(?U)[\p{M}\p{S}\p{P}]", " "))


def clean_text(c: Column) -> Column:
    """The whole cleaning of a dialogue, in order; trailing digits go first."""
    c = ascii_fold(F.trim(F.regexp_replace(c, r"\d+$", "")))
    c = percent_words(drop_fillers(expand_contractions(c)))
    return F.lower(drop_punctuation(placeholders(open_citations(c))))


def clean_speaker(c: Column) -> Column:
    """A label without digits, in upper case."""
    return F.upper(F.trim(F.regexp_replace(c, r"\d+", "")))


def speaker_key(c: Column) -> Column:
    """The last word of a label that has three letters and no full stop at its end, other characters as _; else Unknown."""
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda p: (F.length(p) >= 3) & ~F.endswith(p, F.lit(".")))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("Unknown")), "[^a-zA-Z0-9]", "_"))


def word_list(c: Column) -> Column:
    """Lower-case words between white space; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")


def char_list(c: Column) -> Column:
    """Lower-case characters."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), ""), lambda w: w != "")


def is_boilerplate(line: Column) -> Column:
    """A line of the transcript's producer: its credits, closing phrases, a bare number."""
    # fixed values: phrases of producers
    return F.trim(line).rlike(r"(?i)Transcribed by TERES|END OF DAY.?S PROCEEDINGS|^\d+$|END OF THIS PROCEEDING")


def is_clock_line(line: Column) -> Column:
    """A whole line that is a clock time, or boilerplate."""
    # fixed value: form of a clock time
    return F.trim(line).rlike(r"^\d{1,2}:\d{2}(:\d{2})?\s*(AM|PM)?\s*(IST|EST|GMT|UTC)?$") | is_boilerplate(line)


def is_speaker_line(line: Column) -> Column:
    """What stands before the first colon has letters, all of them capitals. "AT 11:30 WE MET" is one, by this rule."""
    t = F.trim(line)
    letters = F.regexp_replace(F.substring_index(t, ":", 1), r"[^\p{L}]", "")
    return F.contains(t, F.lit(":")) & ~is_boilerplate(line) & ~t.rlike(r"^\d+$") & (letters != "") & (letters == F.upper(letters))


def drop_line_number(line: Column) -> Column:
    """Digits and blanks at a line's start away."""
    return F.trim(F.regexp_replace(line, r"^\d+\s+", ""))


def direct_link(url: Column) -> Column:
    """A share link of one host as a link to the file itself; other links stay as they are."""
    # fixed value: the host whose links are rewritten
    return F.when(F.contains(url, F.lit("dropbox.com")), F.regexp_replace(url, r"dl=[01]", "raw=1")).otherwise(url)


def prompt_family(name: Column) -> Column:
    """indo or dra, by the first list of which a name or code stands anywhere in a data set's name; null for neither."""
    # fixed values: names and codes of languages by family
    indo = ["hindi", "gujarati", "marathi", "bengali", "hi", "gu", "bn", "mr"]
    dra = ["tamil", "telugu", "kannada", "malayalam", "ta", "te", "kn", "ml"]
    return F.when(name.rlike("|".join(indo)), "indo").when(name.rlike("|".join(dra)), "dra")
