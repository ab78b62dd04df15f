"""Edit-distance scoring of hypotheses against references.

Null texts count as empty; an empty reference has a null rate, never an error. Where
rows have a column row_no, of rows with one id the last counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions.text import basic_normal, char_list, word_list
from voxledger.operators.splits import last_by_key

ALIGNED = "n bigint, cor bigint, wrong bigint, ins bigint, del bigint, sub bigint, path array<struct<ref_pos: int, hyp_pos: int>>, diff string"
COUNTS = ("n", "cor", "ins", "del", "sub", "wrong")


def cost_table(ref: list, hyp: list) -> np.ndarray:
    """Edits between every two prefixes. Each row is one vector step: insertions along it are a running minimum."""
    number: dict = {}
    h = np.array([number.setdefault(x, len(number)) for x in hyp], dtype=np.int64)
    across = np.arange(len(hyp) + 1, dtype=np.int32)
    table = np.empty((len(ref) + 1, len(hyp) + 1), dtype=np.int32)
    table[0] = across
    for i, x in enumerate(ref, 1):
        up = table[i - 1]
        best = up + 1
        if len(hyp):
            best[1:] = np.minimum(best[1:], up[:-1] + (h != number.get(x, -1)))
        table[i] = np.minimum.accumulate(best - across) + across
    return table


def align(ref: list[str], hyp: list[str]) -> tuple[list[tuple[int | None, int | None]], int]:
    """Pairs of positions (None where a side has nothing) in order, and the number of edits.

    Equal tokens are matched; of equally cheap edits a substitution is taken before
    an insertion, an insertion before a deletion, walking back from the end.
    """
    t = cost_table(ref, hyp)
    i, j = len(ref), len(hyp)
    path: list[tuple[int | None, int | None]] = []
    while i or j:
        here = t[i, j]
        if i and j and (ref[i - 1] == hyp[j - 1] or t[i - 1, j - 1] + 1 == here):
            i, j = i - 1, j - 1
            path.append((i, j))
        elif j and (not i or t[i, j - 1] + 1 == here):
            j -= 1
            path.append((None, j))
        else:
            i -= 1
            path.append((i, None))
    return path[::-1], int(t[-1, -1])


def counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int, int, int, list[tuple[int, int]], str]:
    """(n, cor, wrong, ins, del, sub, path, diff); path has the positions of matched tokens.

    diff has matched tokens, and between two of them (ref->hyp) for the whole run that differs, * for none.
    """
    steps, wrong = align(ref, hyp)
    ins = sum(i is None for i, _ in steps)
    dele = sum(j is None for _, j in steps)
    path = [(i, j) for i, j in steps if i is not None and j is not None and ref[i] == hyp[j]]
    shown: list[str] = []
    r = h = 0
    for i, j in [*path, (len(ref), len(hyp))]:
        if r < i or h < j:
            shown.append(f"({' '.join(ref[r:i]) or '*'}->{' '.join(hyp[h:j]) or '*'})")
        if i < len(ref) and j < len(hyp):
            shown.append(ref[i])
        r, h = i + 1, j + 1
    return len(ref), len(path), wrong, ins, dele, wrong - ins - dele, path, " ".join(shown)


def distance(ref: list, hyp: list) -> int:
    """Edits between two lists; a row of the table is two whole numbers, a bit for each token of ref that tells where its cost goes up or down."""
    full = (1 << len(ref)) - 1
    if not full:
        return len(hyp)
    where: dict = {}
    for i, x in enumerate(ref):
        where[x] = where.get(x, 0) | 1 << i
    up, down, cost, last = full, 0, len(ref), len(ref) - 1
    for x in hyp:
        same = where.get(x, 0)
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(across | up)), up & across
        cost += (rises >> last & 1) - (falls >> last & 1)
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        same |= down
        up, down = falls | (full & ~(same | rises)), rises & same
    return cost


def tokens_of(text: Column, unit: str) -> Column:
    return word_list(text) if unit == "word" else char_list(text)


def aligned(ref: Column, hyp: Column, unit: str = "word") -> Column:
    """struct(n, cor, wrong, ins, del, sub, path, diff) of two texts; unit is 'word' or 'char'. n counts the reference."""
    @F.pandas_udf(ALIGNED)
    def run(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        out = []
        for r, h in zip(refs, hyps):
            *numbers, path, diff = counts(list(r), list(h))
            out.append((*numbers, [{"ref_pos": i, "hyp_pos": j} for i, j in path], diff))
        return pd.DataFrame(out, columns=["n", "cor", "wrong", "ins", "del", "sub", "path", "diff"])

    return run(tokens_of(ref, unit), tokens_of(hyp, unit))


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edits between the words of two texts, without an alignment."""
    @F.pandas_udf("bigint")
    def run(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        return pd.Series([distance(list(r), list(h)) for r, h in zip(refs, hyps)], dtype="int64")

    return run(word_list(ref), word_list(hyp))


def once_per_id(rows: DataFrame, key: str = "id", order: str = "row_no") -> DataFrame:
    """rows with one row per id, the last by ``order``; rows without that column have unique ids already."""
    return last_by_key(rows, key, order) if order in rows.columns else rows


def detail(rows: DataFrame, unit: str = "word", key: str = "id") -> DataFrame:
    """Per id of (id, hypothesis, reference): counts, rates in percent as text with two decimals (null without a reference), the texts' tokens, path and diff."""
    once = once_per_id(rows, key)
    join = " " if unit == "word" else ""
    told = once.select(key, aligned(F.col("reference"), F.col("hypothesis"), unit).alias("a"), *[F.array_join(tokens_of(F.col(c), unit), join).alias(c) for c in ("reference", "hypothesis")]).select(key, "a.*", "reference", "hypothesis")
    rate = lambda c: F.when(F.col("n") > 0, F.format_string("%.2f", F.bround(F.col(c) * 100 / F.col("n"), 2)))
    return told.select(key, "n", "cor", "ins", "del", "sub", "wrong", rate("cor").alias("corr"), rate("wrong").alias("wer"), "reference", "hypothesis", "path", "diff")


def with_rates(totals: DataFrame) -> DataFrame:
    percent = lambda a, b: F.round(F.try_divide(F.col(a) * 100, F.col(b)), 2)
    out = totals.withColumn("rate", percent("wrong", "n"))
    return out.withColumn("sentence_rate", percent("wrong_sentences", "sentences")) if "sentences" in totals.columns else out


def error_rate(rows: DataFrame, unit: str = "word", kinds: bool = True) -> DataFrame:
    """One row over (id, hypothesis, reference), each id once: n, wrong, sentences, wrong_sentences, rate and sentence_rate in percent; rates are null over nothing.

    With kinds also cor, ins, del, sub, for which every pair has to be aligned.
    """
    once = once_per_id(rows)
    if kinds:
        a = once.select(aligned(F.col("reference"), F.col("hypothesis"), unit).alias("a")).select(*[f"a.{c}" for c in COUNTS])
    else:
        edits = word_distance(F.col("reference"), F.col("hypothesis")) if unit == "word" else char_distance(F.col("reference"), F.col("hypothesis")).cast("bigint")
        a = once.select(F.size(tokens_of(F.col("reference"), unit)).cast("bigint").alias("n"), edits.alias("wrong"))
    total = a.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in a.columns], F.count("*").alias("sentences"), F.coalesce(F.sum((F.col("wrong") > 0).cast("bigint")), F.lit(0)).alias("wrong_sentences"))
    return with_rates(total)


def normal_error_rate(rows: DataFrame) -> DataFrame:
    """``error_rate`` over texts in basic normal form, without kinds."""
    return error_rate(rows.withColumns({c: basic_normal(F.col(c)) for c in ("reference", "hypothesis")}), kinds=False)


def sane_labels(rows: DataFrame, most: float = 1.0) -> DataFrame:
    """rows (n, wrong) whose error rate is at most ``most``; those without a reference have none and go."""
    return rows.where((F.col("n") > 0) & (F.col("wrong") <= F.col("n") * most))


def char_distance(ref: Column, hyp: Column) -> Column:
    """Edits between two texts in lower case, inside the JVM."""
    return F.levenshtein(F.lower(F.coalesce(ref, F.lit(""))), F.lower(F.coalesce(hyp, F.lit(""))))


def char_error_rate(rows: DataFrame) -> DataFrame:
    """One row, each id once: characters of the references, edits, rate in percent; no alignment is built."""
    total = once_per_id(rows).agg(F.coalesce(F.sum(F.length(F.coalesce("reference", F.lit("")))), F.lit(0)).alias("n"), F.coalesce(F.sum(char_distance(F.col("reference"), F.col("hypothesis")).cast("bigint")), F.lit(0)).alias("wrong"))
    return with_rates(total)


def edit_script(truth: str, guess: str) -> str:
    """Guess into truth, a mark per step: the character where kept, $ replaced, + added, - deleted; ties in the order of ``align``."""
    steps, _ = align(list(truth), list(guess))
    return "".join("-" if i is None else "+" if j is None else guess[j] if truth[i] == guess[j] else "$" for i, j in steps)


def match_rate(truth: str, guess: str) -> float | None:
    """1 minus the edits' share of the longer text; null for two empty texts."""
    longest = max(len(truth), len(guess))
    script = edit_script(truth, guess)
    return 1 - sum(c in "$+-" for c in script) / longest if longest else None


def map_words(truth: str, guess: str) -> list[tuple[str, str]]:
    """The texts cut into pieces at the blanks that both share: (piece of truth, piece of guess)."""
    path, _ = align(list(truth), list(guess))
    pairs, a, b = [], 0, 0
    for i, j in path:
        if i is not None and j is not None and truth[i] == guess[j] == " ":
            pairs.append((truth[a:i], guess[b:j]))
            a, b = i + 1, j + 1
    return [*pairs, (truth[a:], guess[b:])]


def pool_words(pieces: list[str], vectors: np.ndarray, words: list[str]) -> np.ndarray:
    """Mean vector per word, or words with blanks between, of its subword pieces in turn (those that go on in a word begin with ##); zero for an empty word."""
    out, at = [], 0
    for w in words:
        built, first = "", at
        while at < len(pieces) and built != w.strip() and w.strip():
            built += pieces[at][2:] if pieces[at].startswith("##") else f" {pieces[at]}" if built else pieces[at]
            at += 1
        if built != w.strip():
            raise ValueError(f"pieces don't spell {w!r}")
        out.append(vectors[first:at].mean(axis=0) if at > first else np.zeros(vectors.shape[1]))
    return np.array(out).reshape(len(words), vectors.shape[1])


Encoder = Callable[[str], tuple[list[str], np.ndarray]]


def semantic_score(truth: str, guess: str, encode: Encoder) -> tuple[float | None, float | None]:
    """(BERT-style score, semantic score) of two texts; encode turns a text into its pieces and their vectors in it, without special tokens.

    The texts are cut at the blanks that both share. A piece's vector is the mean of
    its subwords'; its importance is its similarity to the mean of the truth's, its
    part in the score its similarity to what it was heard as, times how well they
    match. Null if either text is blank.
    """
    truth, guess = truth.strip(), guess.strip()
    if not truth or not guess:
        return None, None
    pairs = map_words(truth, guess)
    (pieces, own), (heard, other) = encode(truth), encode(guess)
    said, got = pool_words(pieces, own, [a for a, _ in pairs]), pool_words(heard, other, [b for _, b in pairs])

    def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return (np.divide((a * b).sum(axis=1), size, out=np.zeros(len(a)), where=size > 0) + 1) / 2

    weight = likeness(said, np.broadcast_to(own.mean(axis=0), said.shape))
    mark = likeness(said, got) * [match_rate(a, b) or 0.0 for a, b in pairs]
    return bert_score(own, other), float((weight * mark).sum() / weight.sum()) if weight.sum() else None


def bert_score(ref: np.ndarray, hyp: np.ndarray) -> float | None:
    """F1 of the best cosine partners of two texts' token vectors, one row each, without weights; null if either is empty."""
    if not len(ref) or not len(hyp):
        return None
    a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (ref, hyp))
    near = a @ b.T
    recall, precision = float(near.max(axis=1).mean()), float(near.max(axis=0).mean())
    return 2 * recall * precision / (recall + precision) if recall + precision else 0.0


def embed_texts(rows: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_vectors, key: str = "id", text: str = "text", batch: int = 64) -> DataFrame:
    """(key, vector array<float>) of texts, shortest first within an Arrow batch and ``batch`` at a time; null texts have no row."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            pdf = pdf.iloc[pdf[text].str.len().argsort(kind="stable")]
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                yield pd.DataFrame({key: part[key], "vector": list(np.asarray(encode(part[text].tolist()), dtype=np.float32))})

    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, vector array<float>")


def embed_tokens(rows: DataFrame, encoder: Callable[[], Encoder] = lambda: hashed_pieces, key: str = "id", text: str = "text", most: int | None = None) -> DataFrame:
    """(key, pieces, vectors) of texts, a vector per piece; with most, an encoder's limit, only so many pieces. Null texts have no row."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            told = [encode(t) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "pieces": [p[:most] for p, _ in told], "vectors": [list(np.asarray(v[:most], dtype=np.float32)) for _, v in told]})

    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, pieces array<string>, vectors array<array<float>>")


def hashed_vectors(texts: list[str], size: int = 64) -> np.ndarray:
    """Vectors of letter trigrams by hash: an encoder that needs no model."""
    out = np.zeros((len(texts), size), dtype=np.float64)
    for i, t in enumerate(texts):
        padded = f"  {t} "
        for k in range(len(padded) - 2):
            h = zlib.crc32(padded[k : k + 3].encode())
            out[i, h % size] += 1 if h & 0x80000000 else -1
    return out


def hashed_pieces(text: str, longest: int = 5) -> tuple[list[str], np.ndarray]:
    """Pieces of at most ``longest`` letters and their vectors by hash, each a little drawn to its neighbours': a token encoder that needs no model."""
    pieces = [("##" if k else "") + w[k : k + longest] for w in re.findall(r"[^ \t\n\r\f\v]+", text) for k in range(0, len(w), longest)]
    own = hashed_vectors(pieces)
    return pieces, own + 0.25 * (np.roll(own, 1, axis=0) + np.roll(own, -1, axis=0))


def semantic_scores(rows: DataFrame, encoder: Callable[[], Encoder] = lambda: hashed_pieces, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(scored, refused): (key, bert_score, sema_score) of all rows, and (key, reference, hypothesis, error) of those that the encoder fails on.

    encoder is called once per worker, and loads what it needs there.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            out = []
            for k, t, g in zip(pdf[key], pdf["reference"], pdf["hypothesis"]):
                try:
                    out.append((k, t, g, *semantic_score(t or "", g or "", encode), None))
                except Exception as e:  # one bad row is set aside, not the job
                    out.append((k, t, g, None, None, repr(e)[:500]))
            yield pd.DataFrame(out, columns=[key, "reference", "hypothesis", "bert_score", "sema_score", "error"])

    done = rows.select(key, "reference", "hypothesis").mapInPandas(run, f"`{key}` {kind}, reference string, hypothesis string, bert_score double, sema_score double, error string")
    return done.where("error is null").select(key, "bert_score", "sema_score"), done.where("error is not null").select(key, "reference", "hypothesis", "error")


def summarise_scores(rows: DataFrame, by: str, *scores: str) -> DataFrame:
    """Per group: n_samples and the mean of each score."""
    return rows.groupBy(by).agg(F.count("*").alias("n_samples"), *[F.avg(s).alias(f"mean_{s}") for s in scores])
