"""Text cut off by field limits.

A stack automaton runs over each text and tells what is open at its end: brackets,
quotes, tags, entities, escapes, broken characters. What a whole text of a source
looks like is counted over all texts: lengths that pile up at a field limit, lines
that close texts without a full stop, forms of list entries, words that end
sentences. A text is cut if it stands at its source's limit, ends broken, or stops
without any of the endings that its kind of text has.

Defined results: null and blank texts are not cut; a text without source belongs
to a source of its own (null); repeated texts count each in results, once in
limits; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.turns import small
from voxledger.session import written

#: Share of a source's texts that stand at one length from which it is a limit, and share that may be longer.
LIMIT_SHARE, LONGER_SHARE = 0.005, 0.002
#: Texts that have to stand at a limit, at least.
LIMIT_LEAST = 3
#: Below a source's greatest limit, an older one: this share of its texts at one length, so many times what lengths about it have.
OLDER_SHARE, OLDER_TIMES = 0.02, 10
#: Texts, and share of the different texts, that have to end in a line for it to be a closing line.
CLOSING, CLOSING_SHARE = 5, 0.0005
#: A word seen less often than this in the corpus may be a piece of one; a word seen at least so often that ends no sentence ends no text.
RARE, FREQUENT = 3, 50
#: A mask or word is a cut form of one that goes on from it and is this many times as frequent.
CUT_FORM = 3
#: A closing line has at most so many letters and words; of a longer last line only the sentence ends within so many letters open one.
CLOSING_LETTERS, CLOSING_WORDS = 120, 20

#: Different tokens that a task counts before it hands them on.
COUNTED = 500_000

STRUCTURE = re.compile(r"[\[\](){}<>“”\n\"]")
OPENERS = {"[": "]", "(": ")", "{": "}", "<": ">", "“": "”"}
CLOSERS = {v: k for k, v in OPENERS.items()}
BROKEN = re.compile(r"(?:�|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#?\w{0,8})|<[a-zA-Z/][^<>]{0,40}|%[0-9A-Fa-f]?)\s*$")
MARKED = re.compile(r"(?:\w…|\[\s?(?:\.\.\.|…)\s?\])\s*$")
ENDED = re.compile(r"[.?!][\"'”’)\]]*\s*$")
# fixed values: abbreviations whose full stop ends no sentence
ABBREVIATION = re.compile(r"(?:^|\s)(?:v|vs|nos?|mr|ms|mrs|dr|adv|sr|smt|hon)\.\s*$|^\s*\d+\.\s*$", re.IGNORECASE)
ENTRY = re.compile(r"^\s*\d+[.)]\s")
SENTENCE_BREAK = re.compile(r"(?:[.?!][\"'”’)\]]*|”)\s+")


def plain(text: str) -> str:
    if text.isascii():
        return text
    text = text.replace("’", "'").replace("“", '"').replace("”", '"')
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def open_at_end(text: str) -> bool:
    """Something opened in the last line is not closed; a line break closes whatever is open."""
    stack: list[str] = []
    quoted = False
    for m in STRUCTURE.finditer(text):
        c = m.group()
        if c == "\n":
            stack.clear()
            quoted = False
        elif c == '"':
            quoted = not quoted
        elif c in OPENERS:
            if c != "<" or text[m.end() : m.end() + 1].isalnum() or text[m.end() : m.end() + 1] == "/":
                stack.append(c)
        elif stack and stack[-1] == CLOSERS[c]:
            stack.pop()
    return bool(stack) or quoted


def literal(line: str) -> str:
    """A line with numbers and capitalised words masked."""
    return " ".join(re.sub(r"[A-Z][\w']*", "W", re.sub(r"\d+", "9", t)) for t in plain(line).split())


def shape(line: str) -> str:
    """A line with all numbers and words masked."""
    return " ".join(re.sub(r"[a-z]+", "w", re.sub(r"[A-Z][\w']*", "W", re.sub(r"\d+", "9", t))) if t not in ("v.", "vs.") else t for t in plain(line).split())


def endings(text: str) -> tuple[bool, bool, bool, str, str | None, list[str]]:
    """(broken, ended, punctuated, last word, shape of a last list entry, masks of the ends of the last line from its first on)."""
    text = text.rstrip()
    broken = bool(BROKEN.search(text) or MARKED.search(text)) or open_at_end(text)
    line = text[text.rfind("\n") + 1 :]
    ended = bool(ENDED.search(text)) and not ABBREVIATION.search(line) or text.endswith("”") and "“" in line
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", text[text.rfind(" ", 0, max(0, len(text) - 80)) + 1 :])
    last = words[-1].lower() if words and text[-len(words[-1]) :] == words[-1] else ""
    punctuated = bool(SENTENCE_BREAK.search(text)) or any(c.isupper() for c in text)
    entry = shape(line) if ENTRY.match(line) and len(line.split()) <= 12 else None
    masks = [literal(line)] if len(line) <= CLOSING_LETTERS else []
    tail = line[-CLOSING_LETTERS:]
    masks += [literal(tail[m.end() :]) for m in SENTENCE_BREAK.finditer(tail)]
    return broken, ended, punctuated, last, entry, masks


def describe(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_chars, n_bytes, digest, broken, ended, punctuated, last, entry, masks), written once."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf[["doc_id", "source", "n_chars", "n_bytes", "digest"]].reset_index(drop=True), pd.DataFrame([endings(t) for t in pdf["text"]], columns=["broken", "ended", "punctuated", "last", "entry", "masks"])], axis=1)

    live = documents.where("trim(text) != ''").select("doc_id", "source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("digest"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return written(live.mapInPandas(read, f"doc_id {kind}, source string, n_chars int, n_bytes int, digest bigint, broken boolean, ended boolean, punctuated boolean, last string, entry string, masks array<string>"))


def usage(documents: DataFrame) -> DataFrame:
    """(kind, key, n) over all texts without their last words: 'word' and how often it stands; 'final' and how often it ends a sentence; 'entry' and how often a list entry of that shape goes before another line."""
    def told(tokens: Counter, entries: Counter) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        finals: Counter = Counter()
        for t, n in tokens.items():
            w = t.strip("\"'“”‘’()[]{}<>.,;:?!…-–—").lower()
            if w:
                words[w] += n
                if ENDED.search(t):
                    finals[w] += n
        for kind, counted in (("word", words), ("final", finals), ("entry", entries)):
            items = list(counted.items())
            for k in range(0, len(items), 10_000):
                yield pd.DataFrame([(kind, x, n) for x, n in items[k : k + 10_000]], columns=["kind", "key", "n"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: Counter = Counter()
        entries: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                tokens.update(text.split()[:-1])
                if "\n" in text:
                    for line in text.split("\n")[:-1]:
                        if len(line) < 120 and line[:1].isdigit() and ENTRY.match(line):
                            entries[shape(line)] += 1
            if len(tokens) + len(entries) > COUNTED:
                yield from told(tokens, entries)
                tokens.clear()
                entries.clear()
        yield from told(tokens, entries)

    return documents.where("trim(text) != ''").select("text").mapInPandas(count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def piles(described: DataFrame) -> DataFrame:
    """(source, unit, limit, n, stops, all, longer, about): different texts of each length, how many of them stop without an ending, all of the source, those longer, and the mean of the hundred lengths about it."""
    stops = (~F.col("ended") | F.col("broken")).cast("int").alias("stops")
    lengths = described.select("source", "digest", stops, F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("limit")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("limit")))).alias("x")).select("source", "digest", "stops", "x.*").distinct()
    counted = lengths.groupBy("source", "unit", "limit").agg(F.count("*").alias("n"), F.sum("stops").alias("stops"))
    own = Window.partitionBy("source", "unit")
    longer = F.coalesce(F.sum("n").over(own.orderBy(F.desc("limit")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    about = (F.sum("n").over(own.orderBy("limit").rangeBetween(-50, 50)) - F.col("n")) / 100
    return counted.withColumns({"all": F.sum("n").over(own), "longer": longer, "about": about}).where((F.col("n") >= LIMIT_LEAST) & (F.col("stops") * 2 >= F.col("n")))


def with_limits(d: DataFrame, limits: DataFrame) -> DataFrame:
    """d with in_chars and in_bytes, the limits of its source; a pile is a share of its source's texts, so that a source has few."""
    of_unit = lambda u: F.coalesce(F.collect_set(F.when(F.col("unit") == u, F.col("limit"))), F.array().cast("array<int>"))
    lim = limits.groupBy(F.col("source").alias("_source")).agg(of_unit("chars").alias("in_chars"), of_unit("bytes").alias("in_bytes"))
    return d.join(small(lim), d["source"].eqNullSafe(F.col("_source")), "left").drop("_source")


def field_limits(described: DataFrame) -> DataFrame:
    """(source, unit, limit), written once: lengths at which a source's texts pile up, most of them without an ending; unit is 'chars' or 'bytes'.

    Either hardly any are longer; or, for the limit of an older field, the pile of the
    texts that stand at no such limit stands out from the lengths about it.
    """
    columns = ["source", "unit", "limit"]
    last = written(piles(described).where((F.col("n") >= LIMIT_SHARE * F.col("all")) & (F.col("longer") <= LONGER_SHARE * F.col("all"))).select(*columns))
    below = with_limits(described, last).where(~F.coalesce(F.array_contains("in_chars", F.col("n_chars")) | F.array_contains("in_bytes", F.col("n_bytes")), F.lit(False)))
    older = piles(below).where((F.col("n") >= F.greatest(F.lit(2 * LIMIT_LEAST), OLDER_SHARE * F.col("all"))) & (F.col("n") >= OLDER_TIMES * F.col("about")))
    return written(last.union(older.select(*columns)))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, reason) of every document with text; reason: limit, broken, unfinished or null."""
    d = describe(documents)
    used = written(usage(documents))
    d = with_limits(d, field_limits(d))
    near = F.exists("in_bytes", lambda x: (F.col("n_bytes") > x - 4) & (F.col("n_bytes") < x)) & (F.col("n_bytes") != F.col("n_chars")) & ~F.col("ended")
    at_limit = F.array_contains("in_chars", F.col("n_chars")) | F.array_contains("in_bytes", F.col("n_bytes")) | near
    # only texts that neither stand at a limit, nor are broken, nor end as sentences do need the corpus
    d = d.withColumn("reason", F.when(F.coalesce(at_limit, F.lit(False)), "limit").when(F.col("broken"), "broken"))
    sure = d.where(F.col("reason").isNotNull() | F.col("ended")).select("doc_id", "source", "reason")
    open_ = d.where(F.col("reason").isNull() & ~F.col("ended"))

    # what is common is a share of the different texts, whatever their number
    many = max(CLOSING, math.ceil(CLOSING_SHARE * d.select("digest").distinct().count()))
    closing = d.where("reason is null").groupBy(F.try_element_at("masks", F.lit(1)).alias("mask")).agg(F.countDistinct("digest").alias("n")).where(F.col("mask").isNotNull())
    # a mask that a much more frequent one goes on from is a cut form of it
    steps = closing.select(F.col("mask").alias("whole"), F.col("n").alias("times"), F.split("mask", " ").alias("w")).where((F.size("w") > 1) & (F.size("w") <= CLOSING_WORDS) & (F.col("n") >= many))
    prefixes = steps.select("times", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.array_join(F.slice("w", 1, k), " "))).alias("mask")).groupBy("mask").agg(F.max("times").alias("longer"))
    closing = closing.where(F.col("n") >= many).join(prefixes, "mask", "left").where(F.col("longer").isNull() | (F.col("n") * CUT_FORM >= F.col("longer"))).select("mask")
    # a last word that stands in no text may still close texts; not if, after the same line, it is the beginning of a much more frequent one
    ends = open_.select("doc_id", "digest", "last", F.explode("masks").alias("mask")).join(small(closing), "mask", "left_semi")
    lasts = ends.groupBy("mask", "last").agg(F.countDistinct("digest").alias("ending")).where(F.col("ending") >= RARE)
    begun = lasts.where(F.length("last") > 1).select("mask", "ending", F.explode(F.transform(F.sequence(F.lit(1), F.length("last") - 1), lambda k: F.substring(F.col("last"), F.lit(1), k))).alias("last")).groupBy("mask", "last").agg(F.max("ending").alias("goes_on"))
    closers = lasts.join(begun, ["mask", "last"], "left").where(F.col("goes_on").isNull() | (F.col("ending") * CUT_FORM >= F.col("goes_on"))).select("mask", "last", F.lit(True).alias("closer"))
    closed = ends.join(small(closers), ["mask", "last"], "left").groupBy("doc_id").agg(F.lit(True).alias("closes"), F.coalesce(F.max("closer"), F.lit(False)).alias("closer"))

    entries = used.where("kind = 'entry'").select(F.col("key").alias("entry"), F.col("n").alias("entries"))
    words = used.where("kind = 'word'").select(F.col("key").alias("last"), F.col("n").alias("seen"))
    finals = used.where("kind = 'final'").select(F.col("key").alias("last"), F.col("n").alias("final"))
    judged = open_.select("doc_id", "source", "punctuated", "last", "entry").join(closed, "doc_id", "left").join(entries, "entry", "left").join(words, "last", "left").join(finals, "last", "left")
    piece = (F.col("last") != "") & (F.coalesce("seen", F.lit(0)) < RARE)
    never = (F.coalesce("seen", F.lit(0)) >= FREQUENT) & (F.coalesce("final", F.lit(0)) * 1000 < F.col("seen"))
    whole = (
        F.when(F.col("entry").isNotNull(), (F.coalesce("entries", F.lit(0)) >= many) & ~piece)
        .when(F.col("closes") & ((F.col("last") == "") | (F.coalesce("seen", F.lit(0)) >= RARE) | F.col("closer")), True)
        .when(~F.col("punctuated"), ~piece & ~never)
        .otherwise(False)
    )
    rest = judged.select("doc_id", "source", F.when(~whole, F.lit("unfinished")).alias("reason"))
    return sure.union(rest).select("doc_id", "source", F.col("reason").isNotNull().alias("cut"), "reason")


def shares(judged: DataFrame) -> DataFrame:
    """(source, n_documents, n_cut, share_cut)."""
    return judged.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("cut").cast("bigint")).alias("n_cut")).withColumn("share_cut", F.col("n_cut") / F.col("n_documents"))
