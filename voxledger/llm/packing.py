"""Filling fixed-capacity containers with items.

Harmonic packing: an item of size s belongs to class k = floor(capacity / s), and a
container of class k takes exactly k such items, whatever they are, so that workers
fill their share of a class without knowing of one another. Items of class CLASSES
and beyond are one class, whose containers are filled one after the other. So every
container has a class and its fixed count; what that leaves is room. With
``fill_room``, an item goes, fullest fit first, into room that the containers of
larger items leave before its class opens a container for it; ``in_room`` tells which
did, and ``fill_report`` gives the figures with and without. Workers are shards of
bounded size; a size or source that holds a third of all items is spread over all of
them.

Only an item larger than the capacity is split: into full containers, and a rest
that is packed like an item.

Defined results: null and empty texts have no tokens and are in no container;
repeated items each count; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.session import written

CAPACITY = 2048
#: Reciprocal classes; smaller items are one class.
CLASSES = 24
#: Items that one worker packs, about.
SHARD = 20_000


@lru_cache(maxsize=4)
def encoder(ranks: str, pattern: str):
    """What encodes text by a file of ranks that was shipped to the worker; loaded once a worker."""
    import tiktoken

    with open(SparkFiles.get(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary


def count_tokens(documents: DataFrame, text: str = "text", ranks: str | None = None) -> DataFrame:
    """documents without text, with n_tokens: of a byte-level BPE whose ranks lie at ``ranks`` on the driver, by default the public 50k vocabulary; the file is shipped to the workers."""
    import public_tokenizers

    keep = [f for f in documents.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_tokens int"])
    names = [f.name for f in keep]
    path, pattern = str(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    documents.sparkSession.sparkContext.addFile(path)
    file = Path(path).name

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(file, pattern)
        for pdf in batches:
            yield pdf[names].assign(n_tokens=[0 if t is None else len(encode(t)) for t in pdf[text]])

    return documents.mapInPandas(count, schema)


def pack(sizes: list[int], capacity: int = CAPACITY, fill_room: bool = True) -> list[tuple[int, bool]]:
    """(container, in room) of each size, containers numbered from 0; all sizes are between 1 and the capacity."""
    classes: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        classes.setdefault(min(capacity // s, CLASSES), []).append(i)
    bins: list[tuple[int, bool]] = [(0, False)] * len(sizes)
    room: list[tuple[int, int]] = []  # (left, container)
    made = 0
    for k in sorted(classes):
        own: list[int] = []
        for i in sorted(classes[k], key=lambda i: -sizes[i]):
            at = bisect.bisect_left(room, (sizes[i], -1)) if fill_room else len(room)
            if at < len(room):
                left, c = room.pop(at)
                bins[i] = (c, True)
                if left > sizes[i]:
                    bisect.insort(room, (left - sizes[i], c))
            else:
                own.append(i)
        held, left = 0, 0
        for i in own:
            # a class takes its count, the smallest items what fits
            if held == k < CLASSES or left < sizes[i]:
                if held:
                    bisect.insort(room, (left, made - 1))
                made, held, left = made + 1, 0, capacity
            bins[i] = (made - 1, False)
            held, left = held + 1, left - sizes[i]
        if held:
            bisect.insort(room, (left, made - 1))
    return bins


def pack_items(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, fill_room: bool = True) -> DataFrame:
    """(key, piece_no, start_token, n_tokens, sequence_id string, in_room): every item once, or in pieces if it exceeds the capacity.

    Items are dealt to shards by hash, so that every shard sees the same mix of sizes.
    """
    live = written(items.where(F.col(size) > 0).select(key, size))
    pieces = live.select(
        key,
        F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col(size) / capacity).cast("int") - 1), lambda k: F.struct(k.alias("piece_no"), (k * capacity).alias("start_token"), F.least(F.lit(capacity), F.col(size) - k * capacity).cast("int").alias("n_tokens")))).alias("p"),
    ).select(key, "p.*")
    shards = max(1, math.ceil(live.count() / SHARD))
    kind = items.schema[key].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece_no"], kind="stable").reset_index(drop=True)
        shard = pdf["shard"].iloc[0]
        bins = pack(pdf["n_tokens"].tolist(), capacity, fill_room)
        return pdf[[key, "piece_no", "start_token", "n_tokens"]].assign(sequence_id=[f"{shard}-{b}" for b, _ in bins], in_room=[r for _, r in bins])

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(key, "piece_no"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(fill, f"`{key}` {kind}, piece_no int, start_token int, n_tokens int, sequence_id string, in_room boolean")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_sequences, n_tokens, n_documents, n_in_room, least_sequences (no packing needs fewer), fill."""
    per = packed.groupBy("sequence_id").agg(F.sum("n_tokens").alias("n"), F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0)).alias("d"), F.sum(F.col("in_room").cast("bigint")).alias("r"))
    total = per.agg(F.count("*").alias("n_sequences"), *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "n_tokens"), ("d", "n_documents"), ("r", "n_in_room"))])
    return total.withColumn("least_sequences", F.ceil(F.col("n_tokens") / capacity)).withColumn("fill", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_sequences") * capacity))
