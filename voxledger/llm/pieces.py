"""Splitting oversized items at natural boundaries.

A sparse table over the boundary strengths of a text answers "strongest cut in
this window, rightmost of equals" in constant time; from each cut the next piece
steps back by the overlap.

Defined results: an item at or under the limit gives no row; an oversized item
without words gives equal pieces with null text; a single word
longer than the limit can't be cut and is a piece of its own with over_limit true;
the overlap shrinks where a piece is too short to hold it; repeated rows each
count; null sizes are no item; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.paths import chunk_key
from voxledger.llm.turns import small
from voxledger.session import written

LIMIT = 30.0
OVERLAP = 3

#: Strength of a boundary after a word: end of turn, of sentence, pause, none.
TURN, SENTENCE, PAUSE, PLAIN = 3, 2, 1, 0
TOKEN = re.compile(r"[^\s|]+|[|\n]+|>>")
WORDY = re.compile(r"\w")
SPACE = "<space>"
#: Seconds that a spoken word takes, about; units of a recorded length, in seconds.
SECONDS_A_WORD = 0.4
UNITS = (1.0, 1e-3, 1 / 16000)


def tokens(text: str) -> tuple[list[str], np.ndarray]:
    """Words (with their punctuation) and the strength of the boundary after each."""
    words: list[str] = []
    strength: list[int] = []
    for t in TOKEN.findall(text.replace(SPACE, " ")):
        if WORDY.search(t):
            bare = t.rstrip("\"')]}”’")
            words.append(t)
            strength.append(SENTENCE if bare[-1:] in ".?!…" else PAUSE if bare[-1:] in ",;:-–—/" else PLAIN)
        elif words:
            s = TURN if t[0] in "|\n" or t == ">>" else SENTENCE if t.strip("-–—,;:/") else PAUSE
            strength[-1] = max(strength[-1], s)
    return words, np.asarray(strength, dtype=np.int8)


class StrongestCut:
    """Sparse table of rightmost maxima."""

    def __init__(self, strength: np.ndarray) -> None:
        n = len(strength)
        self.strength = strength
        self.rows = [np.arange(n, dtype=np.int32)]
        width = 1
        while 2 * width <= n:
            left, right = self.rows[-1][:-width], self.rows[-1][width:]
            self.rows.append(np.where(strength[left] > strength[right], left, right))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """Position of the greatest strength within lo..hi, the rightmost of equals."""
        k = (hi - lo + 1).bit_length() - 1
        left, right = int(self.rows[k][lo]), int(self.rows[k][hi - (1 << k) + 1])
        return left if self.strength[left] > self.strength[right] else right


def cut_points(strength: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """(first word, end) of each piece of at most ``most`` words."""
    n = len(strength)
    if n <= most:
        return [(0, n)]
    table = StrongestCut(strength)
    overlap = max(0, min(overlap, most - 1))
    pieces, first = [], 0
    while n - first > most:
        # the next piece has to begin further on than this one
        at = table.query(first + overlap, first + most - 1)
        pieces.append((first, at + 1))
        first = at + 1 - overlap
    pieces.append((first, n))
    return pieces


def split_oversized(items: DataFrame, text: str = "text", size: str = "size", limit: float = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the rows with size > limit: all other columns, piece_no from 0, n_pieces, piece_text, piece_size, over_limit.

    A piece's size is the item's size times its share of the item's words.
    """
    keep = [c for c in items.columns if c not in (text, size)]
    clash = {"piece_no", "n_pieces", "piece_text", "piece_size", "over_limit"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} already exist")
    rows = items.where(F.col(size) > limit).select(*keep, F.col(text).alias("_text"), F.col(size).cast("double").alias("_size"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep] + ["piece_no int", "n_pieces int", "piece_text string", "piece_size double", "over_limit boolean"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index, out = [], []
            for i, (t, total) in enumerate(zip(pdf["_text"], pdf["_size"])):
                words, strength = tokens(t) if t else ([], None)
                if not words:
                    pieces = [(0, 0)] * math.ceil(total / limit)
                else:
                    share = total / len(words)
                    pieces = cut_points(strength, max(1, math.floor(limit / share + 1e-9)), overlap)
                for k, (a, b) in enumerate(pieces):
                    length = share * (b - a) if words else total / len(pieces)
                    index.append(i)
                    out.append((k, len(pieces), " ".join(words[a:b]) if words else None, length, length > limit + 1e-6))
            made = pd.DataFrame(out, columns=["piece_no", "n_pieces", "piece_text", "piece_size", "over_limit"])
            yield pd.concat([pdf[keep].iloc[index].reset_index(drop=True), made], axis=1)

    return rows.mapInPandas(cut, schema)


def word_count(text: Column) -> Column:
    """Words between blanks, separators and ``<space>`` marks."""
    return F.regexp_count(F.replace(text, F.lit(SPACE), F.lit(" ")), F.lit(r"[^\s|]*\w[^\s|]*"))


def nearest_unit(length: Column, expected: Column) -> Column:
    """The unit of UNITS that brings a length nearest to what is expected, by ratio."""
    off = [F.struct(F.abs(F.log(length * u / expected)).alias("off"), F.lit(u).alias("unit")) for u in UNITS]
    return F.least(*off)["unit"]


def segment_seconds(segments: DataFrame) -> DataFrame:
    """segments with n_words and seconds.

    A case has one unit for all its times: the one that makes its words last as
    long as spoken words do. Silence within a segment only makes seconds look
    long, so the ratio is compared with a word's time on a shifted scale.
    """
    n = word_count(F.col("transcript"))
    raw = F.col("end_sec") - F.col("start_sec")
    timed = segments.withColumn("n_words", n).withColumn("_raw", F.when(raw > 0, raw))
    unit = timed.groupBy("case_id").agg((F.sum(F.when(F.col("n_words") > 0, F.col("_raw"))) / F.sum(F.when(F.col("_raw").isNotNull(), F.col("n_words")))).alias("_ratio"))
    unit = unit.select("case_id", F.when(F.col("_ratio") < 60, F.lit(1.0)).when(F.col("_ratio") < 1600, F.lit(1e-3)).otherwise(F.when(F.col("_ratio").isNull(), F.lit(1.0)).otherwise(F.lit(1 / 16000))).alias("_unit"))
    return timed.join(small(written(unit)), "case_id", "left").withColumn("seconds", F.round(F.col("_raw") * F.coalesce("_unit", F.lit(1.0)), 2)).drop("_raw", "_unit")


def train_seconds(train: DataFrame, timed: DataFrame) -> DataFrame:
    """train with seconds: the true length of every record, from its own length or its segment's.

    timed: the result of ``segment_seconds``.
    """
    key = chunk_key(F.col("audio_path"))
    rows = train.withColumn("_case", F.concat(F.lit("case"), F.try_element_at(key["cases"], F.lit(1)))).withColumn("_no", key["dialogue_no"]).withColumn("_words", word_count(F.col("transcription")))
    known = timed.where("seconds is not null").groupBy(F.col("case_id").alias("_case"), F.col("seg_no").alias("_no")).agg(F.max("seconds").alias("_whole"), F.max("n_words").alias("_seg_words"))
    joined = rows.join(known, ["_case", "_no"], "left")
    share = F.least(F.lit(1.0), F.when(F.col("_words") > 0, F.col("_words")) / F.when(F.col("_seg_words") > 0, F.col("_seg_words")))
    by_segment = F.col("_whole") * F.coalesce(share, F.lit(1.0))
    expected = F.coalesce(by_segment, SECONDS_A_WORD * F.when(F.col("_words") > 0, F.col("_words")), F.lit(10.0))
    length = F.when((F.col("length") > 0) & ~F.isnan("length"), F.col("length"))
    own = length * nearest_unit(length, expected)
    return joined.withColumn("seconds", F.round(F.coalesce(own, F.col("_whole")), 2)).drop("_case", "_no", "_words", "_whole", "_seg_words")


def oversized_pieces(segments: DataFrame, train: DataFrame, limit: float = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of segments and train records: source_table, item_id, piece_no, n_pieces, piece_text, piece_size, over_limit."""
    timed = segment_seconds(segments.select("segment_id", "case_id", "seg_no", "start_sec", "end_sec", "transcript"))
    both = timed.select(F.lit("segment_ctm").alias("source_table"), F.col("segment_id").alias("item_id"), F.col("transcript").alias("text"), F.col("seconds").alias("size")).union(
        train_seconds(train.select("row_id", "audio_path", "transcription", "length"), timed).select(F.lit("train"), "row_id", "transcription", "seconds")
    )
    return split_oversized(both, limit=limit, overlap=overlap)
