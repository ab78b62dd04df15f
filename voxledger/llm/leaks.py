"""Evaluation texts leaking into training text.

Latent semantic retrieval: passages of all documents and of the held-out items are
TF-IDF vectors over the items' pairs of neighbouring words; a randomised subspace
iteration, run over partitions, gives their leading singular directions; passages
whose cosine in that space is high are candidates. So are documents that hold as
many of an item's pairs as the check asks for, as text between an item's words may
turn their passages away from it. A candidate document leaks an item if, within one stretch of it, enough of the item's words follow in the item's
order, each next to another one, and not only words of common formulas. What is
common is counted over different texts, for each item over those without a passage
of it: a passage that many documents quote isn't a formula.

Document frequencies, the space, the search and the check cover all documents and
all of each.

Defined results: null and empty texts leak nothing; an item without words is
found nowhere; repeated documents and items each count; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import math
import pickle
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.turns import small
from voxledger.llm.words import ANNOTATION, FILLERS
from voxledger.session import written

#: Words in a document's passage, and from one to the next; the same for an item's.
WINDOW, STEP = 32, 16
QUERY, QUERY_STEP = 20, 10
RANK = 64
ROUNDS = 3
#: Features whose rows of a fitting task's matrix are sent together.
FEATURES = 64
#: Bytes of word numbers that a fitting task lays end to end at once, one document at least.
AT_ONCE = 1 << 20
COSINE = 0.5
#: Share of an item's words that have to follow in order; of its pairs that are not common, likewise.
SHARE, RARE_SHARE = 0.4, 0.2
#: A pair in more than this share of the different documents is common, unless those outside hold a passage of the item; so is one in more than this share of the items.
COMMON = 0.01
#: A passage of an item may spread over so many times its words.
SPREAD = 3
#: Items searched at once; more are searched in blocks.
ITEMS = 2000
#: Words of the corpus that a task remembers the number of.
REMEMBERED = 1_000_000
#: Words shorter than this have to be spelt exactly.
MISREAD_FROM = 6


LETTERS = bytes(ord(chr(i).lower()) if chr(i).isalnum() and i < 128 else 32 for i in range(256))
QUOTES = b"'"
REMARKS = re.compile(ANNOTATION)


def item_words(text: str) -> list[bytes]:
    """Lower-case words without accents, punctuation and annotations; numbers and fillers are still there."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("\u2026", " ").replace("\u2019", "'").replace("\u2013", " ").replace("\u2014", " "))
    if "[" in text or "(" in text or "{" in text or "<" in text or "*" in text:
        text = REMARKS.sub(" ", text.replace("<space>", " "))
    return text.encode("ascii", "ignore").translate(LETTERS, QUOTES).split()


def shorter(word: bytes) -> list[bytes]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


def counts(word: bytes) -> bool:
    """Neither a number nor a filler."""
    return word.isalpha() and word.decode() not in FILLERS


class Vocabulary:
    """Numbers of the items' words; a word that is one letter off counts as the item's word. Others get the number ``size``; numbers and fillers vanish."""

    def __init__(self, items: list[list[bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        for words in items:
            for w in words:
                if counts(w):
                    self.number.setdefault(w, len(self.number))
        self.size = len(self.number)
        self.near: dict[bytes, int] = {}
        for w, n in self.number.items():
            if len(w) >= MISREAD_FROM:
                for v in shorter(w):
                    self.near.setdefault(v, n)
        self.seen: dict[bytes, int] = {}

    def __getstate__(self):
        return self.number, self.size, self.near

    def __setstate__(self, state):
        self.number, self.size, self.near = state
        self.seen = {}

    def look(self, word: bytes) -> int:
        n = self.number.get(word, self.size)
        if n == self.size:
            if not counts(word):
                n = -1
            elif len(word) >= MISREAD_FROM - 1:
                n = self.near.get(word, n)
                if n == self.size and len(word) >= MISREAD_FROM:
                    for v in shorter(word):
                        if v in self.near or v in self.number and len(v) >= MISREAD_FROM:
                            n = self.number.get(v, self.near.get(v))
                            break
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[word] = n
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers in order, without what counts for nothing."""
        known = self.seen.get
        found = np.fromiter((x if (x := known(w)) is not None else self.look(w) for w in words), dtype=np.int32, count=len(words))
        return found[found >= 0]


class Pairs:
    """Features: the pairs of neighbouring words that stand in items; ``size`` for any other pair."""

    def __init__(self, items: list[np.ndarray], words: int) -> None:
        self.words = words
        self.keys = np.unique(np.concatenate([x[:-1].astype(np.int64) * (words + 1) + x[1:] for x in items if len(x) > 1] or [np.zeros(0, dtype=np.int64)]))
        self.size = len(self.keys)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The feature at each position."""
        pair = np.full(len(ids), self.size, dtype=np.int64)
        if len(ids) > 1 and self.size:
            key = ids[:-1].astype(np.int64) * (self.words + 1) + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
            pair[:-1] = np.where(self.keys[at] == key, at, self.size)
        return pair


def lay(parts: list[np.ndarray], filler: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents end to end, each filled up to whole blocks of STEP with one filler at least: ids, begin and number of blocks of each."""
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    blocks = lengths // STEP + 1
    begin = (np.cumsum(blocks) - blocks) * STEP
    flat = np.full(int(blocks.sum()) * STEP, filler, dtype=np.int32)
    for x, s in zip(parts, begin.tolist()):
        flat[s : s + len(x)] = x
    return flat, begin, blocks


def window_vectors(rows: np.ndarray, pair: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end, the vectors of all passages, the document of each, and whether its next block is of the same one.

    A passage is a block and the next of its document; the last row of rows is zero.
    """
    owner = np.repeat(np.arange(len(blocks)), blocks)
    joined = np.append(owner[1:] == owner[:-1], False)
    grid = pair.reshape(-1, STEP)
    sums = rows[grid[:, 0]]
    for k in range(1, STEP):
        sums += rows[grid[:, k]]
    sums[:-1][joined[:-1]] += sums[1:][joined[:-1]]
    return sums, owner, joined


def add_rows(total: np.ndarray, feature: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
    """Adds to the features' rows of total the rows at the places given; the last of rows is zero.

    Each feature's places are filled up to whole eights, which are summed before the rest: ``reduceat`` over all takes five times as long.
    """
    if not len(feature):
        return
    order = np.argsort(feature.astype(np.uint16) if len(total) <= 65536 else feature, kind="stable")
    feature, at = feature[order], at[order]
    edge = np.flatnonzero(np.diff(feature, prepend=-1))
    n = np.diff(edge, append=len(feature))
    eights = (n + 7) // 8
    begin = np.cumsum(eights) - eights
    filled = np.full(int(eights.sum()) * 8, len(rows) - 1)
    filled[np.arange(len(feature)) + np.repeat(begin * 8 - edge, n)] = at
    sums = np.concatenate([rows.take(filled[k : k + 2048], axis=0).reshape(-1, 8, rows.shape[1]).sum(1) for k in range(0, len(filled), 2048)])
    total[feature[edge]] += np.add.reduceat(sums, begin, axis=0)


def portions(batch: pd.Series) -> Iterator[pd.Series]:
    """The batch in parts of at most AT_ONCE bytes, or of one document."""
    ends = batch.map(len).cumsum().to_numpy()
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, AT_ONCE + (ends[at - 1] if at else 0), side="right")))
        yield batch.iloc[at:end]
        at = end


class Search:
    """The items as query vectors, and the check of what is found."""

    def __init__(self, ids: list[int], items: list[np.ndarray], pairs: Pairs, rows: np.ndarray, common: np.ndarray, formula: np.ndarray) -> None:
        self.ids, self.items, self.pairs, self.rows = ids, items, pairs, rows
        self.special = np.append(~common[: pairs.size], False)
        self.possible = np.append(~formula[: pairs.size], False)
        vectors, self.item = [], []
        self.follow: list[dict[tuple[int, int], list[tuple[int, int]]]] = []
        self.rare: list[set[int]] = []
        self.own: list[set[int]] = []
        for k, x in enumerate(items):
            pair = pairs.of(x)
            for s in range(0, max(1, len(x) - QUERY_STEP), QUERY_STEP):
                if len(x):
                    vectors.append(rows[pair[s : s + QUERY]].sum(0))
                    self.item.append(k)
            follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for d in (1, 2):
                for i in range(len(x) - d):
                    follow.setdefault((int(x[i]), int(x[i + d])), []).append((i, i + d))
            self.follow.append(follow)
            self.own.append({int(p) for p in pair[:-1] if p < pairs.size and not formula[p]})
            self.rare.append({p for p in self.own[k] if not common[p]})
        # the items that hold each feature: those of feature p are holders[first[p] : first[p + 1]]
        pair, item = np.asarray([(p, k) for k, x in enumerate(items) for p in self.own[k] or set(pairs.of(x)[:-1].tolist()) - {pairs.size}], dtype=np.int64).reshape(-1, 2).T
        self.holders = item[np.argsort(pair, kind="stable")]
        self.first = np.searchsorted(np.sort(pair), np.arange(pairs.size + 1))
        self.n_rare = np.asarray([len(x) for x in self.rare])
        q = np.asarray(vectors, dtype=np.float32).reshape(-1, rows.shape[1])
        norm = np.linalg.norm(q, axis=1)
        keep = norm > 1e-6
        self.queries = (q[keep] / norm[keep, None]).T.copy()
        self.item = np.asarray(self.item, dtype=np.int64)[keep]

    def candidates(self, pair: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Each document that has passages of a high cosine or holds enough of an item's pairs, with the items."""
        n = len(self.items)
        vectors, owner, _ = window_vectors(self.rows, pair, blocks)
        norm = np.linalg.norm(vectors, axis=1)
        live = np.flatnonzero(norm > 1e-6)
        near = np.zeros(len(blocks) * n, dtype=bool)
        for k in range(0, len(live), 256):
            some = live[k : k + 256]
            at, query = np.divmod(np.flatnonzero(vectors[some] @ self.queries >= COSINE * norm[some, None]), max(1, self.queries.shape[1]))
            near[owner[some[at]] * n + self.item[query]] = True
        # the check would turn down what is near but holds too few pairs; an item without rare pairs asks for none
        enough = self.holding(pair, blocks)
        document, item = np.divmod(np.flatnonzero(enough | near & np.tile(self.n_rare == 0, len(blocks))), max(1, n))
        edge = np.flatnonzero(np.diff(document, prepend=-1))
        for d, items in zip(document[edge].tolist(), np.split(item, edge[1:]) if len(edge) else []):
            yield d, items.tolist()

    def holding(self, pair: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Whether the document holds as many of the item's pairs as ``leaked`` asks for, at document x items + item: text between its words may turn a passage away from the item in the space."""
        n = len(self.items)
        owner = np.repeat(np.arange(len(blocks)), blocks * STEP)
        live = np.flatnonzero(pair < self.pairs.size)
        key = np.sort(owner[live] * self.pairs.size + pair[live])
        document, feature = np.divmod(key[np.diff(key, prepend=-1) > 0], max(1, self.pairs.size))
        many = self.first[feature + 1] - self.first[feature]
        places = np.arange(many.sum()) + np.repeat(self.first[feature] - (np.cumsum(many) - many), many)
        both = np.repeat(document, many) * n + self.holders[places]
        special = np.repeat(self.special[feature], many)
        rare = np.bincount(both[special], minlength=len(blocks) * n).reshape(-1, n)
        shared = np.bincount(both[~special], minlength=len(blocks) * n).reshape(-1, n)
        enough = (rare + shared > 0) & (rare >= RARE_SHARE * self.n_rare)
        return (enough | (shared > 0) & (rare + shared >= RARE_SHARE * (self.n_rare + shared))).ravel()

    def leaked(self, items: list[int], ids: np.ndarray, pair: np.ndarray) -> Iterator[tuple[int, bool, int, list[int]]]:
        """(item, sure, rare pairs, common pairs) for those of the items of which a stretch of the document holds enough; not sure: only if common pairs count."""
        held = set(np.unique(pair[self.possible[pair]]).tolist())
        for k in items:
            rare, least = self.rare[k], RARE_SHARE * len(self.rare[k])
            n_rare, shared = len(held & rare), held & self.own[k] - rare if len(rare) < len(self.own[k]) else set()
            sure = n_rare >= least and self.leaks(k, ids, pair, rare, self.special)
            # at best just the shared ones turn out not to be common
            if sure or shared and n_rare + len(shared) >= RARE_SHARE * (len(rare) + len(shared)) and self.leaks(k, ids, pair, self.own[k], self.possible):
                yield k, sure, n_rare, sorted(shared)

    def leaks(self, k: int, ids: np.ndarray, pair: np.ndarray, rare: set[int], marked: np.ndarray) -> bool:
        """A stretch of the document holds enough of item k, and of the pairs given as rare."""
        n = len(self.items[k])
        marks = np.flatnonzero(marked[pair])
        marks = marks[[int(p) in rare for p in pair[marks]]] if len(marks) else marks
        span = SPREAD * n
        places = marks if rare else np.flatnonzero(ids < self.pairs.words)
        best, done = 0, -1
        for s in places.tolist():
            if s <= done:
                continue
            # a stretch begins at a mark; those that begin a little later lie within it
            near = places[(places >= s) & (places < s + span)]
            if rare and len(set(pair[near].tolist()) & rare) < RARE_SHARE * len(self.rare[k]):
                continue
            best = max(best, self.in_order(k, ids[max(0, s - n // 2) : s + span + n // 2].tolist()))
            if best >= SHARE * n:
                return True
            done = s + n // 4
        return False

    def in_order(self, k: int, words: list[int]) -> int:
        """Words of item k that follow in its order, each next or next but one to another."""
        follow = self.follow[k].get
        points: set[tuple[int, int]] = set()
        for d in (1, 2):
            for j in range(len(words) - d):
                for i, i2 in follow((words[j], words[j + d]), ()):
                    points.add((j, -i))
                    points.add((j + d, -i2))
        tails: list[int] = []
        for _, i in sorted(points):
            at = bisect.bisect_left(tails, -i)
            tails[at : at + 1] = [-i]
        return len(tails)


def number_documents(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, digest, ids binary): the numbers of all words of each document, 32 bits each, written once; equal texts have equal digests."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "ids": [vocabulary.numbers(item_words(t)).astype(np.uint16 if vocabulary.size < 65535 else np.int32).tobytes() for t in pdf["text"]]})

    return written(documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInPandas(read, "doc_id bigint, digest bigint, ids binary"))


def add_parts(parts: DataFrame) -> DataFrame:
    """(first, part) from the tasks' (task, first, part): the sum of each first row's parts, 64 bits a number, in the order of tasks."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for pdf in batches:
            done = []
            for first, part in zip(pdf["first"].tolist(), pdf["part"]):
                if first != at:
                    if at is not None:
                        done.append((at, total.tobytes()))
                    at, total = first, np.zeros(len(part) // 4)
                total += np.frombuffer(part, dtype=np.float32)
            yield pd.DataFrame(done, columns=["first", "part"])
        if at is not None:
            yield pd.DataFrame({"first": [at], "part": [total.tobytes()]})

    return parts.repartition("first").sortWithinPartitions("first", "task").mapInPandas(add, "first int, part binary")


def fit_space(numbered: DataFrame, features: Callable[[pd.Series], tuple], idf: np.ndarray) -> np.ndarray:
    """The leading directions (features x RANK) of the passages of all documents (ids) as TF-IDF vectors; idf ends with the zero of what is no feature."""
    size = len(idf) - 1
    basis = np.random.default_rng(0).standard_normal((size + 1, RANK)).astype(np.float32)

    def iterate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weighted = (idf[:, None] * basis).astype(np.float32)
        total = np.zeros((size + 1, RANK), dtype=np.float32)
        for pdf in batches:
            for some in portions(pdf["ids"]):
                _, _, blocks, pair = features(some)
                vectors, _, joined = window_vectors(weighted, pair, blocks)
                # a word lies in the passage of its block and in that of the block before
                both = np.vstack([vectors, np.zeros((1, RANK), dtype=np.float32)])
                both[1:-1] += np.where(joined[:-1, None], vectors[:-1], 0)
                live = np.flatnonzero(pair < size)
                add_rows(total, pair[live], both, live // STEP)
        total = (total * idf[:, None]).astype(np.float32)
        some = [k for k in range(0, len(total), FEATURES) if total[k : k + FEATURES].any()]
        yield pd.DataFrame({"task": TaskContext.get().partitionId(), "first": some, "part": [total[k : k + FEATURES].tobytes() for k in some]})

    for _ in range(ROUNDS):
        parts = numbered.select("ids").mapInPandas(iterate, "task int, first int, part binary")
        total = np.zeros((size + 1, RANK))
        for first, part in add_parts(parts).collect():
            rows = np.frombuffer(part).reshape(-1, RANK)
            total[first : first + len(rows)] = rows
        basis = np.linalg.qr(total if total.any() else basis)[0].astype(np.float32)
        if basis.shape[1] < RANK:
            basis = np.pad(basis, ((0, 0), (0, RANK - basis.shape[1])))
    return basis


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of all documents (doc_id, text) that hold a passage of an item (item_id, text)."""
    spark = documents.sparkSession
    rows = items.where("text is not null").select("item_id", "text")
    blocks = math.ceil(rows.count() / ITEMS)
    found = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        one = leaks_of_block(documents, [(r[0], r[1]) for r in part.orderBy("item_id").collect()])
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}")
    return found


def leaks_of_block(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    spark = documents.sparkSession
    texts = [item_words(t) for _, t in items]
    vocabulary = Vocabulary(texts)
    words = [vocabulary.numbers(t) for t in texts]
    pairs = Pairs(words, vocabulary.size)
    numbered = number_documents(documents, vocabulary)
    kind = np.int32 if vocabulary.size >= 65535 else np.uint16

    def features(batch: pd.Series) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        parts = [np.frombuffer(x, dtype=kind) for x in batch]
        flat, begin, blocks = lay(parts, vocabulary.size)
        return parts, begin, blocks, pairs.of(flat)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(pairs.size + 1)
        for pdf in batches:
            _, _, blocks, pair = features(pdf["ids"])
            live = np.flatnonzero(pair < pairs.size)
            key = np.unique(np.repeat(np.arange(len(blocks)), blocks * STEP)[live] * (pairs.size + 1) + pair[live])
            document, feature = np.divmod(key, pairs.size + 1)
            total += np.bincount(feature, weights=1 / pdf["copies"].to_numpy()[document], minlength=pairs.size + 1)
        at = np.flatnonzero(total[:-1])
        yield pd.DataFrame({"feature": at, "n": total[at]})

    # each of n equal texts counts 1 / n
    many = numbered.groupBy("digest").agg(F.count("*").alias("copies"))
    n_texts = many.count()
    weighed = numbered.select("digest", "ids").join(small(many.where("copies > 1")), "digest", "left").select("ids", F.coalesce("copies", F.lit(1)).alias("copies"))
    df = np.zeros(pairs.size + 1)
    for r in weighed.mapInPandas(count, "feature bigint, n double").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r[0]] = r[1]
    # pairs that stand in many different items are a formula's
    texts_of: dict[bytes, list[int]] = {}
    for k, x in enumerate(words):
        texts_of.setdefault(x.tobytes(), []).append(k)
    inside = [set(pairs.of(words[k])[:-1].tolist()) - {pairs.size} for k in range(len(items))]
    spread = np.zeros(pairs.size + 1, dtype=np.int64)
    for same in texts_of.values():
        spread[list(inside[same[0]])] += 1
    shared_by_items = spread > max(COMMON * len(texts_of), 3)
    idf = np.log((n_texts + 1) / (df + 1))
    idf[-1] = 0
    least = max(COMMON * n_texts, 3) + 1e-6
    common = df > least
    formula = common & shared_by_items

    basis = fit_space(numbered, features, idf)
    held = spark.sparkContext.broadcast(pickle.dumps(Search([i for i, _ in items], words, pairs, (idf[:, None] * basis).astype(np.float32), common, formula)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find: Search = pickle.loads(held.value)
        for big in batches:
            for at in range(0, len(big), 500):
                pdf = big.iloc[at : at + 500]
                parts, begin, blocks, pair = features(pdf["ids"])
                doc_ids, digests = pdf["doc_id"].tolist(), pdf["digest"].tolist()
                out = []
                for d, items in find.candidates(pair, blocks):
                    own = pair[begin[d] : begin[d] + len(parts[d])]
                    out.extend((doc_ids[d], digests[d], k, *more) for k, *more in find.leaked(items, parts[d], own))
                yield pd.DataFrame(out, columns=["doc_id", "digest", "item", "sure", "n_rare", "shared"])

    holds = numbered.mapInPandas(search, "doc_id bigint, digest bigint, item int, sure boolean, n_rare int, shared array<int>")
    holds = written(holds)
    held_by = holds.select("digest", "item", F.explode("shared").alias("pair")).distinct().groupBy("item", "pair").count()
    own: dict[int, list[int]] = {}
    for k, p, n in held_by.collect():
        if df[p] - n <= least:
            own.setdefault(k, []).append(p)
    rare = [len({p for p in x if not common[p]}) + len(own.get(k, [])) for k, x in enumerate(inside)]
    about = spark.createDataFrame([(k, i, own.get(k, []), rare[k]) for k, (i, _) in enumerate(items)], "item int, item_id bigint, own array<int>, all_rare int")
    quoted = F.size(F.array_intersect("shared", "own"))
    return holds.join(F.broadcast(about), "item").where(F.col("sure") | (quoted > 0) & (F.col("n_rare") + quoted >= RARE_SHARE * F.col("all_rare"))).select("doc_id", "item_id")
