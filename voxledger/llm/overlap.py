"""Same or near-same records across splits.

Evaluation records are laid down in shards of bounded size, ordered by length.
For each shard an Aho-Corasick automaton over its passages scans the training texts
whose length allows a match; matched intervals are merged into the coverage of the
evaluation record, and the pairs are checked by the longest common subsequence of
their words. Records whose paths name the same chunk are joined by that key.

Equal texts are looked at once: they meet in one partition, by a key of 128 bits, and
what is found for texts or for chunks is spread to the rows that hold them at the end,
so that only the result grows with the product of repeated rows.

Passages are two words long, at every offset, because no longer run is certain to be
left whole: of two texts of m and n words that agree in c of them, the m - c and
n - c others break the common words into at most m + n - 2c + 1 runs, so that at
least 3c - m - n - 1 passages are shared (``shared_least``), wherever the changes
stand. Of the passages of a text, ordered from the shard's rarest to its most
frequent, so many of the last may be left out on either side; the others have to
meet. Every passage counts by this rule, however many records contain it: the
records of a passage lie in order of length, so that only those that a training text
can agree with are looked at, a bounded number at once.

Defined results: null and short texts match only by path, null paths only by
text; repeated rows each count; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.paths import parse
from voxledger.llm.words import common_in_order, plain_words, position_masks
from voxledger.session import scratch, written

LEAST_WORDS = 16
AGREE = 0.8
PASSAGE = 2
#: Words of the evaluation records in a shard, about; a longer record is a shard of its own.
SHARD_WORDS = 1_500_000
#: Words of the training records that one task holds, about.
HELD_WORDS = 3_000_000
#: Texts that are matched at once.
SCAN = 4000
CHUNK = "cases: array<bigint>, dialogue_no: int, chunk_no: int"
#: What tells texts and chunks apart.
TEXT = ("text_a", "text_b")
PLACE = ("case", "dialogue_no", "chunk_no")
#: Passages of evaluation texts that are compared with training texts at once.
AT_ONCE = 1_000_000


def agree_least(longer: np.ndarray) -> np.ndarray:
    """Words that have to agree in order, by the longer text's number of words."""
    return np.ceil(AGREE * longer - 1e-9).astype(np.int64)


def shared_least(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Passages that two texts of m and n words share at least, if they agree."""
    return 3 * agree_least(np.maximum(m, n)) - m - n - 1


def looked_at(n: np.ndarray) -> np.ndarray:
    """How many of the passages of a text of n words, rarest first, have to be looked at to meet one of any text that agrees."""
    # texts of about the same length share least; shorter and longer ones differ less in order
    return n - np.min([shared_least(n, n + k) for k in range(6)], axis=0)


def signatures(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """256 bits a text, one set for each word: a bit that a text lacks is a word that it lacks."""
    out = np.zeros((4, len(ends)), dtype=np.uint64)
    if not len(flat):
        return out
    starts = np.concatenate([[0], ends[:-1]])
    bit = (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    for k in range(4):
        own = np.where(bit // np.uint64(64) == k, np.uint64(1) << (bit % np.uint64(64)), np.uint64(0))
        out[k] = np.bitwise_or.reduceat(own, starts)
    return out


class Passages:
    """The passages of a shard of evaluation texts as an automaton over the numbers of the shard's words.

    texts must be distinct and hold LEAST_WORDS words or more. Passages are numbered
    from the rarest on. Entry p says that a passage to look at stands in text place[p];
    entries of one passage follow one another by the length of their texts, rank is
    passage * wide + length.
    """

    def __init__(self, texts: list[str]) -> None:
        self.number: dict[str, int] = {}
        words = [[self.number.setdefault(w, len(self.number)) for w in t.split(" ")] for t in texts]
        self.flat = np.fromiter((x for w in words for x in w), dtype=np.int64)
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.end = np.cumsum(self.size)
        self.signature = signatures(self.flat, self.end)
        text_of = np.repeat(np.arange(len(words)), self.size)
        at = np.flatnonzero(text_of[1:] == text_of[:-1])
        key = self.flat[at] * (len(self.number) + 1) + self.flat[at + 1]
        keys, first, passage, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        rarest = np.lexsort((keys, times))
        rank_of = np.empty(len(keys), dtype=np.int64)
        rank_of[rarest] = np.arange(len(keys))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, a, b in zip(rank_of.tolist(), self.flat[at[first]].tolist(), self.flat[at[first] + 1].tolist()):
            self.automaton.add_word((a, b), k)
        if len(keys):
            self.automaton.make_automaton()
        text, passage = rarest_first(text_of[at], rank_of[passage], looked_at(self.size))
        order = np.lexsort((self.size[text], passage))
        self.place = text[order].astype(np.int32)
        self.wide = int(self.size.max(initial=0)) + 1
        self.rank = passage[order] * self.wide + self.size[self.place]
        self.size = self.size.astype(np.int32)

    def numbers(self, texts: list[str]) -> list[tuple[int, ...]]:
        """The words of texts as the shard's numbers; one number, that no passage has, for all others."""
        known, other = self.number.get, len(self.number)
        return [tuple([known(w, other) for w in t.split(" ")]) for t in texts]

    def text(self, e: int) -> list[int]:
        return self.flat[self.end[e] - self.size[e] : self.end[e]].tolist()

    def matches(self, words: list[tuple[int, ...]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, evaluation text, words covered by shared passages, words in common order) of all that agree."""
        if not len(self.place):
            return
        find = self.automaton.iter
        hits = [[k for _, k in find(w)] for w in words]
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        met = np.fromiter(map(len, hits), dtype=np.int64, count=len(words))
        # passages that the shard hasn't got are rarer than any that it has
        owner, keys = rarest_first(np.repeat(np.arange(len(words)), met), np.fromiter((k for h in hits for k in h), dtype=np.int64, count=int(met.sum())), looked_at(size) - (size - 1 - met))
        if not len(keys):
            return
        shortest, longest = agree_least(size), np.floor((size + 1e-6) / AGREE).astype(np.int64)
        first = np.searchsorted(self.rank, keys * self.wide + np.minimum(shortest, self.wide)[owner])
        many = np.maximum(np.searchsorted(self.rank, keys * self.wide + np.minimum(longest, self.wide - 1)[owner], "right") - first, 0)
        lacking = ~signatures(np.fromiter((x for w in words for x in w), dtype=np.int64), np.cumsum(size))
        least = agree_least(np.arange(max(self.wide, int(size.max()) + 1))).astype(np.int32)
        size, owner = size.astype(np.int32), owner.astype(np.int32)
        total = np.cumsum(many)
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
        at = 0
        while at < len(keys):
            # whole texts, as many as fit
            end = int(last[max(np.searchsorted(last, at, "right"), np.searchsorted(total[last - 1], total[at] - many[at] + AT_ONCE, "right") - 1)])
            pairs = np.unique(np.concatenate([self.alike(k, min(k + step, end), owner, first, many, size, lacking, least) for step in [max(1, AT_ONCE // max(1, int(many[at:end].max())))] for k in range(at, end, step)]))
            yield from self.agreeing(pairs, words)
            at = end

    def alike(self, begin: int, end: int, owner: np.ndarray, first: np.ndarray, many: np.ndarray, size: np.ndarray, lacking: np.ndarray, least: np.ndarray) -> np.ndarray:
        """text * number of evaluation texts + evaluation text, behind some hits, without pairs whose single words differ too much.

        lacking: the signatures of the texts turned round. least: ``agree_least`` of all lengths.
        """
        n = many[begin:end]
        other = self.place[np.repeat(first[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        text = np.repeat(owner[begin:end], n)
        m = self.size[other]
        spare, lacks = m - least[np.maximum(size[text], m)], np.int16(0)
        for k in range(4):
            lacks = lacks + np.bitwise_count(self.signature[k][other] & lacking[k][text])
            fits = np.flatnonzero(lacks <= spare)
            text, other, spare, lacks = text[fits], other[fits], spare[fits], lacks[fits]
        return text.astype(np.int64) * len(self.size) + other

    def agreeing(self, pairs: np.ndarray, words: list[tuple[int, ...]]) -> Iterator[tuple[int, int, int, int]]:
        held, masks, runs = -1, {}, set()
        for t, e in zip(*(x.tolist() for x in np.divmod(pairs, len(self.size)))):
            n, m = len(words[t]), int(self.size[e])
            if t != held:
                held, masks, runs = t, position_masks(words[t]), set(zip(words[t], words[t][1:]))
            there = self.text(e)
            starts = [i for i, run in enumerate(zip(there, there[1:])) if run in runs]
            cover = covered(starts)
            # the shared passages lie in a run at least
            if len(starts) < 3 * (c := math.ceil(AGREE * max(n, m) - 1e-9)) - m - n - 1:
                continue
            common = common_in_order(there, masks, n)
            if common >= c:
                yield t, e, cover, common


def rarest_first(text: np.ndarray, passage: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, passage) of the first ``most`` passages of each text in order, without repetitions; by text."""
    order = np.lexsort((passage, text))
    text, passage = text[order], passage[order]
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    place = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
    keep = (place < most[text]) & ((np.diff(text, prepend=-1) != 0) | (np.diff(passage, prepend=-1) != 0))
    return text[keep], passage[keep]


def covered(starts: list[int], length: int = PASSAGE) -> int:
    """Words in the union of intervals of one length."""
    total, end = 0, -1
    for s in sorted(set(starts)):
        total += s + length - max(s, end)
        end = s + length
    return total


def as_uri(path: str) -> str:
    """A path as Spark writes it, as other readers want it."""
    if path.startswith("file:"):
        return "file:///" + path[len("file:") :].lstrip("/")
    return path if "://" in path else f"file://{path}"


def laid(rows: DataFrame, words: int, least: int = 1, key: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(key, words) in partitions of about so many words each, at least so many partitions, by length; a length with more than one's worth is spread by key.

    Rows of one key stay together and count once. Only the count of every length is
    sent to the driver.
    """
    lengths = sorted((r[0], r[1]) for r in rows.groupBy("n_words").agg(F.count_distinct(*key)).collect())
    all_words = sum(n * k for n, k in lengths)
    full = max(1.0, min(words, all_words / least))
    places, at = [], 0.0
    for n, k in lengths:
        # where the words of this length begin and end, in partitions
        begin, end = at, at + n * k / full
        first = math.floor(begin)
        places.append((n, first, max(1, math.ceil(end) - first)))
        at = end
    if not places:
        return rows.select(*key, "words").limit(0)
    table = rows.sparkSession.createDataFrame(places, "n_words int, first int, spread int")
    part = (F.col("first") + F.pmod(F.xxhash64(*key), F.col("spread"))).cast("int")
    return rows.join(F.broadcast(table), "n_words").repartitionById(math.ceil(at) + 1, part).select(*key, "words")


def near_texts(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(text_a_train, text_b_train, text_a_eval, text_b_eval, covered, n_words, common), once for every two texts that agree; both sides: (text_a, text_b, words, n_words)."""
    spark = train.sparkSession
    base = scratch(spark, "overlap")

    def distinct(batches: Iterator[pd.DataFrame]) -> dict[str, tuple[int, int]]:
        texts: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            texts.update(zip(pdf["words"].tolist(), zip(*(pdf[c].tolist() for c in TEXT))))
        return texts

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = distinct(batches)
        if texts:
            made = Passages(list(texts))
            yield pd.DataFrame({"shortest": [int(made.size.min())], "longest": [int(made.size.max())], "shard": [pickle.dumps((made, list(texts.values())))]})

    shards = laid(evaluation.where(F.col("n_words") >= LEAST_WORDS), SHARD_WORDS, key=TEXT)
    shards.mapInPandas(build, "shortest int, longest int, shard binary").write.option("maxRecordsPerFile", 1).parquet(base)
    places = sorted((r[0], r[1], as_uri(r[2])) for r in spark.read.schema("shortest int, longest int").parquet(base).select("shortest", "longest", F.input_file_name()).collect())
    names = [*(f"{c}_train" for c in TEXT), *(f"{c}_eval" for c in TEXT), "covered", "n_words", "common"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_of = distinct(batches)
        texts = sorted(key_of, key=lambda t: t.count(" "))
        size = [t.count(" ") + 1 for t in texts]
        for lo, hi, uri in places:
            near = [t for t, n in zip(texts, size) if lo * AGREE <= n and n * AGREE <= hi]
            if not near:
                continue
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            shard, held = pickle.loads(pyarrow.parquet.read_table(path, columns=["shard"], filesystem=fs)["shard"][0].as_py())
            for k in range(0, len(near), SCAN):
                some = near[k : k + SCAN]
                out = []
                for t, e, cover, common in shard.matches(shard.numbers(some)):
                    out.append((*key_of[some[t]], *held[e], cover, int(shard.size[e]), common))
                    if len(out) > 50_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    spread = laid(train.where(F.col("n_words") >= LEAST_WORDS), HELD_WORDS, int(spark.sparkContext.defaultParallelism), TEXT)
    return spread.mapInPandas(scan, ", ".join([*(f"{c} bigint" for c in names[:4]), *(f"{c} int" for c in names[4:])]))


def read_records(records: DataFrame, *more: str) -> DataFrame:
    """(row_id, more, chunk, words, n_words, text_a, text_b), written once: words are plain words with single blanks, null for a null text; two hashes of 64 bits stand for them."""
    kept = records.select("row_id", *more, "audio_path", "transcription")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in ("row_id", *more)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [None if t is None else plain_words(t) for t in pdf["transcription"]]
            keys = [parse(p) for p in pdf["audio_path"]]
            yield pdf[["row_id", *more]].assign(
                chunk=[k and {"cases": k[0], "dialogue_no": k[1], "chunk_no": k[2]} for k in keys],
                words=[None if w is None else " ".join(w) for w in words],
                n_words=[0 if w is None else len(w) for w in words],
            )

    parsed = kept.mapInPandas(read, ", ".join([*fields, f"chunk struct<{CHUNK}>", "words string", "n_words int"]))
    return written(parsed.withColumns({TEXT[0]: F.xxhash64("words"), TEXT[1]: F.xxhash64(F.lit(1), "words")}))


def cross_split(train: DataFrame, *evaluation: DataFrame) -> DataFrame:
    """(row_id_train, row_id_eval, split, case_id): every overlap once; the case is the one that the evaluation record's path names first.

    All tables: row_id, audio_path, transcription; evaluation also split.
    """
    held = evaluation[0].select("row_id", "split", "audio_path", "transcription")
    for e in evaluation[1:]:
        held = held.unionByName(e.select("row_id", "split", "audio_path", "transcription"))
    of_train, of_eval = ([f"{c}_{name}" for c in TEXT] for name in ("train", "eval"))

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        places = (F.try_element_at("chunk.cases", F.lit(1)).alias("case"), "chunk.dialogue_no", "chunk.chunk_no")
        return rows.select(F.col("row_id").alias(f"row_id_{name}"), *more, *places, *(F.col(c).alias(f"{c}_{name}") for c in TEXT))

    a, b = read_records(train), read_records(held, "split")
    near = written(near_texts(a, b).select(*of_train, *of_eval))
    a, b = side(a, "train"), side(b, "eval", "split").withColumn("case_id", F.concat(F.lit("case"), F.col("case")))
    by_text = near.join(a.drop(*PLACE), of_train).join(b.drop(*PLACE), of_eval)
    # of the chunks, those that the texts don't tell
    chunks = a.where("case is not null").select(*PLACE, *of_train).distinct().join(b.where("case is not null").select(*PLACE, *of_eval).distinct(), [*PLACE])
    by_path = chunks.join(near, [*of_train, *of_eval], "left_anti").join(a, [*PLACE, *of_train]).join(b, [*PLACE, *of_eval])
    return by_text.select("row_id_train", "row_id_eval", "split", "case_id").union(by_path.select("row_id_train", "row_id_eval", "split", "case_id"))


def report(overlaps: DataFrame) -> DataFrame:
    """(split, case_id, n_pairs, n_records): overlaps and evaluation records in them, per split and case."""
    per = overlaps.groupBy("split", "case_id", "row_id_eval").agg(F.count("*").alias("n"))
    return per.groupBy("split", "case_id").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_records"))
