"""Variant spellings of names typed by people.

A label is read into parts (title, given name, middle, surname; or the words and
place of an organisation; what kinds of organisations there are is counted from the
labels). Distinct surnames and places lie in a metric space
under Levenshtein distance: each goes to the cell of its nearest pivot, boundary
names are copied to every cell that the triangle inequality can't rule out, and
within a cell a join on rings of distance to the pivot finds exactly the pairs
within the radius. Labels whose surnames are linked are then compared part by
part, and each gets the entity it agrees with.

Defined results: null and blank labels are no label; a label that names only a
role is an entity of its own, as written; a label that fits two different people
equally well is an entity of its own; repeated labels count once; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.edits import damerau, levenshtein
from voxledger.llm.splits import hash_to_min
from voxledger.session import written

#: Two single edits, or one swap of neighbours, in Levenshtein distance.
RADIUS = 2
PIVOTS = 24
#: Pivots are chosen among at most so many names; all names are joined.
PIVOT_SAMPLE = 512
#: Share of the labels "... kind OF place" in which a kind of organisation has to stand, of four letters at least, to be known in other forms.
KIND_SHARE, KIND_LETTERS = 0.0005, 4
#: The table of given names may hold at most so many rows, as every task gets it.
MOST_GIVEN = 100_000

# fixed values: words of labels
TITLES = {"JUSTICE": "J", "CJ": "J", "CJI": "J", "HON'BLE": "", "HONBLE": "", "MR": "MR", "MS": "MS", "MRS": "MS", "DR": "DR", "ADV": "ADV", "ADVOCATE": "ADV", "SR": "SR", "SHRI": "MR", "SMT": "MS", "LD": ""}
ROLES = {"JUDGE", "COUNSEL", "PETITIONER'S", "RESPONDENT'S", "APPELLANT'S", "PETITIONER", "RESPONDENT", "APPELLANT", "THE", "FOR", "WITNESS", "COURT", "MASTER", "UNIDENTIFIED", "UNKNOWN", "SPEAKER", "CLERK", "REGISTRAR", "BENCH", "INTERPRETER", "STENOGRAPHER", "REPORTER", "OFFICER"}
MISREAD = str.maketrans("013568", "OIESGB")
REMARK = re.compile(r"\((?:VIA|FOR|THROUGH|ON BEHALF)\b[^)]*\)")


@dataclass
class Parts:
    """What a label says. anchor: the surname, or an organisation's place."""

    kind: str
    anchor: str = ""
    title: str = ""
    given: str = ""  # as known to the table of given names
    starts: str = ""  # of a given name: an initial or a short form
    raw: str = ""  # a given name that the table doesn't know
    middle: str = ""
    words: tuple[str, ...] = field(default=())
    either: str = ""  # a title that two initials may stand for


def shortens(word: str, full: str) -> bool:
    """The letters of a word of two at least follow in the other's order, from its first on."""
    letters = iter(full)
    return len(word) >= 2 and word[0] == full[0] and all(x in letters for x in word)


def kinds_of_organisations(labels: DataFrame) -> list[str]:
    """The words that labels "... kind OF place" and "place, ... kind OF" (label) have there, most frequent first, without misspellings and abbreviations of one another; at most 1 / KIND_SHARE."""
    text = F.regexp_replace(F.upper("label"), r"[\s_]+", " ")
    found = labels.select(F.coalesce(F.nullif(F.regexp_extract(text, r" ([A-Z]+)[.,]* OF [^,()]+$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r", .* ([A-Z]+)[.,]* OF\s*:?$", 1), F.lit(""))).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))
    counted = written(found)
    whole = counted.agg(F.sum("n")).first()[0] or 0
    kept: list[str] = []
    for r in counted.where((F.col("n") >= KIND_SHARE * whole) & (F.length("kind") >= KIND_LETTERS)).orderBy(F.desc("n"), "kind").collect():
        if not any(damerau(r["kind"], k, 1) <= 1 or shortens(r["kind"], k) for k in kept):
            kept.append(r["kind"])
    return kept


class Reader:
    """Reads labels, knowing given names, their short forms, and kinds of organisations."""

    def __init__(self, short: dict[str, str], kinds: list[str] | None = None) -> None:
        self.kinds = kinds or []
        self.kind_seen: dict[str, str] = {}
        self.full = set(short.values())
        self.short = short
        self.seen: dict[str, str] = {}

    def given_name(self, token: str) -> str:
        """The given name that a token stands for, one edit away at most; else ''."""
        if token in self.full:
            return token
        if token in self.short:
            return self.short[token]
        if len(token) < 5:
            return ""
        if token not in self.seen:
            near = [(damerau(token, g, 1), g) for g in self.full if abs(len(g) - len(token)) <= 1]
            near = sorted(x for x in near if x[0] <= 1)
            self.seen[token] = near[0][1] if near else ""
        return self.seen[token]

    def read(self, label: str) -> Parts:
        text = re.sub(r"\s+", " ", label.upper().replace("_", " ").replace("’", "'")).strip().rstrip(":").strip()
        bare = REMARK.sub(" ", text).strip()
        remark = bare != text
        tokens = [t.strip(".,:;()") for t in bare.split()]
        tokens = [t for t in tokens if t]
        if not tokens or all(t in ROLES or t.isdigit() or len(t) == 1 for t in tokens) and any(t in ROLES for t in tokens):
            return Parts("role", text)
        bare = " ".join(t.translate(MISREAD) if re.search(r"[A-Z]", t) else t for t in bare.split())
        return self.organisation(bare) or self.person(bare, remark)

    def organisation(self, text: str) -> Parts | None:
        counsel = re.match(r"COUNSEL FOR (.+)$", text)
        rest = counsel[1] if counsel else text
        rest = re.sub(r"^THE ", "", rest)
        if m := re.match(r"((?:[A-Z]\.){2,}|[A-Z]{2,4}(?= [A-Z]{4,}$))\s*([A-Z]{3,})$", rest) if counsel or re.match(r"(?:[A-Z]\.){3,}", rest) else None:
            letters = m[1].replace(".", "")
            return Parts("org", m[2], words=tuple(letters))
        sure = True  # a person's label has no OF
        if m := re.match(r"([^,()]+?),\s*(.+) OF$", rest):
            place, words = m[1], m[2]
        elif m := re.match(r"(.+?) OF ([^,()]+)$", rest):
            words, place = m[1], m[2]
        elif m := re.match(r"(.+?)\s*\(([^()]+)\)$", rest):
            words, place, sure = m[1], m[2], False
        elif m := re.match(r"(.+),\s*([^,()]+)$", rest):
            words, place, sure = m[1], m[2], False
        else:
            return None
        parts = [w.strip(".,") for w in words.split()]
        kind = self.kind_of(parts[-1]) or (parts[-1] if sure else "")
        return Parts("org", place.strip(" .,"), words=(*parts[:-1], kind)) if len(parts) > 1 and kind else None

    def kind_of(self, word: str) -> str:
        """The kind of organisation that a word, its misspelling or its abbreviation names; else ''."""
        if word not in self.kind_seen:
            self.kind_seen[word] = next((k for k in self.kinds if damerau(word, k, 1) <= 1), "") or next((k for k in self.kinds if shortens(word, k)), "")
        return self.kind_seen[word]

    def person(self, text: str, remark: bool = False) -> Parts:
        p = Parts("person")
        comma = text.find(",")
        raw = text.replace(",", " ").split()
        if comma < 0 and len(raw) == 2 and raw[0] in ("MR", "MS", "DR", "SR") and not remark and len(raw[1].strip(".")) > 2:
            return Parts("person", raw[1].strip("."), starts=raw[0][0], middle=raw[0][1], either=TITLES[raw[0]])
        titles = []
        while raw and raw[0].strip(".") in TITLES and len(raw) > 1:
            titles.append(TITLES[raw.pop(0).strip(".")])
        if len(raw) > 1 and raw[-1].strip(".") in ("J", "JJ", "CJ") and (len(raw) == 2 and len(raw[0]) > 2 or raw[-1].strip(".") != "J"):
            raw.pop()
            titles.append("J")
        p.title = "J" if "J" in titles else "SR" if "SR" in titles else next((t for t in titles if t), "")
        if not raw:
            p.kind, p.anchor = "role", text
            return p
        whole = [t for t in raw if len(t.strip(".")) > 2 and not (t.endswith(".") and len(t) <= 6)]
        if comma > 0 and whole:
            surname = raw[0]
        elif not whole:
            surname = max(raw, key=len)
        else:
            strangers = [t for t in whole if not self.given_name(t.strip("."))]
            unclear = [t for t in whole if t.strip(".") not in self.full and t.strip(".") not in self.short]
            surname = strangers[-1] if strangers else unclear[-1] if unclear else whole[-1]
        p.anchor = surname.strip(".")
        rest = list(raw)
        rest.remove(surname)
        for t in rest:
            token = t.strip(".")
            known = "" if t.endswith(".") and token not in self.full else self.given_name(token)
            named = p.given or p.starts or p.raw
            if known:
                if not named:
                    p.given = known
                elif not p.middle:
                    p.middle = known[0]
            elif "." in token:  # initials without blanks
                letters = token.replace(".", "")
                p.starts, p.middle = (letters[:1], letters[1:2]) if not named else (p.starts, letters[:1])
            elif len(token) == 1:
                if not named:
                    p.starts = token
                elif not p.middle:
                    p.middle = token
            elif len(token) == 2 and not t.endswith("."):
                if not named:
                    p.starts, p.middle = token[0], token[1]
            elif t.endswith("."):
                if not named:
                    p.starts = token
            elif not named:
                p.raw = token
            elif not p.middle:
                p.middle = token[:1]
        return p


def agrees(a: Parts, b: Parts) -> bool:
    """Given and middle names of two labels don't contradict each other."""
    if a.middle and b.middle and a.middle != b.middle:
        return False
    if a.given and b.given:
        return a.given == b.given
    if a.raw and b.raw:
        return damerau(a.raw, b.raw, 1) <= 1
    for x, y in ((a, b), (b, a)):
        if x.starts:
            return (y.given or y.raw or y.starts or x.starts).startswith(x.starts) or bool(y.starts) and x.starts.startswith(y.starts)
        if x.raw and y.given:
            return damerau(x.raw, y.given, 2) <= 2
    return True


def resolve_people(labels: list[tuple[str, int, Parts]]) -> dict[str, str]:
    """Entities of labels whose surnames are linked.

    People are known from labels with a given name, strongest first; one that is
    an edit away from a stronger one of the same given name, and stands in few
    labels, is a misspelling of it. Then come labels with initials, then bare
    surnames, each joined to the one person it agrees with.
    """
    out: dict[str, str] = {}
    people: list[tuple[str, Parts, Counter]] = []  # id, parts, titles

    def candidates(p: Parts) -> list[tuple[str, Parts, Counter]]:
        for most in (0, 1):
            found = [x for x in people if damerau(x[1].anchor, p.anchor, 1) == most and agrees(p, x[1])]
            if len(found) > 1 and p.title:
                found = [x for x in found if x[2][p.title]] or found
            if len(found) > 1 and p.middle:
                found = [x for x in found if x[1].middle == p.middle] or found
            if found:
                return found
        return candidates(Parts("person", p.anchor, p.either)) if p.either else []

    def level(p: Parts) -> int:
        return 0 if p.given else 1 if p.raw else 2 if p.starts else 3

    groups: dict[tuple, list[tuple[str, int, Parts]]] = defaultdict(list)
    for x in labels:
        p = x[2]
        groups[(level(p), p.given, p.raw, p.starts, p.anchor)].append(x)
    for (lv, *_), members in sorted(groups.items(), key=lambda kv: (kv[0][0], -len(kv[1]), -sum(m[1] for m in kv[1]), kv[0])):
        by_middle: dict[str, list[tuple[str, int, Parts]]] = defaultdict(list)
        for m in members:
            by_middle[m[2].middle].append(m)
        named = sorted(x for x in by_middle if x)
        if lv == 0 and len(named) <= 1 or len(by_middle) == 1:
            units = [members]
        else:
            units = [by_middle[x] for x in [*named, *([""] if "" in by_middle else [])]]
        for unit in units:
            titles = Counter(m[2].title for m in unit if m[2].title)
            lead = max(unit, key=lambda m: (bool(m[2].middle), m[1], m[0]))[2]
            found = candidates(lead)
            if lv == 0 and len(unit) > 3 and all(damerau(x[1].anchor, lead.anchor, 1) for x in found):
                found = []  # spelt this way in many labels: another person
            if len(found) == 1 or lv == 0 and found:
                found[0][2].update(titles)
                if not found[0][1].middle:
                    found[0][1].middle = lead.middle
                for m in unit:
                    out[m[0]] = found[0][0]
                continue
            if len(found) > 1 and len(unit) > 1:  # each label by its own title and middle name
                left = []
                for m in unit:
                    own = candidates(m[2])
                    if len(own) == 1:
                        out[m[0]] = own[0][0]
                    else:
                        left.append(m)
                unit = left
            if not unit:
                continue
            name = f"person:{lead.anchor}/{lead.given or lead.raw or lead.starts}/{lead.middle}"
            if len(found) > 1:
                for m in unit:
                    out[m[0]] = f"label:{m[0]}"
                continue
            people.append((name, Parts("person", lead.anchor, lead.title, lead.given, lead.starts, lead.raw, lead.middle), titles))
            for m in unit:
                out[m[0]] = name
    return out


def word_agrees(a: str, b: str) -> bool:
    return a == b or len(min(a, b, key=len)) >= 2 and (a.startswith(b) or b.startswith(a)) or damerau(a, b, 1) <= 1


def resolve_organisations(labels: list[tuple[str, int, Parts]]) -> dict[str, str]:
    """Entities of organisations whose places are linked: all words agree, or the initials do."""
    out: dict[str, str] = {}
    known: list[tuple[str, tuple[str, ...], str]] = []
    full = Counter()
    for _, n, p in labels:
        full[(p.words, p.anchor)] += n
    order = sorted(labels, key=lambda x: (len("".join(x[2].words)) <= 4, -full[(x[2].words, x[2].anchor)], -len("".join(x[2].words)), x[0]))
    for label, _, p in order:
        short = len("".join(p.words)) <= 4

        def same(words: tuple[str, ...], place: str) -> bool:
            if damerau(place, p.anchor, 1) > 1 or len(words) != len(p.words):
                return False
            if short or len("".join(words)) <= 4:
                return [w[0] for w in words] == [w[0] for w in p.words]
            return all(word_agrees(x, y) for x, y in zip(words, p.words))

        found = [k for k in known if same(k[1], k[2])]
        exact = [k for k in found if k[2] == p.anchor] or found
        if exact:
            out[label] = exact[0][0]
        else:
            name = f"org:{' '.join(p.words)}/{p.anchor}"
            known.append((name, p.words, p.anchor))
            out[label] = name
    return out


def choose_pivots(names: list[str], most: int = PIVOTS) -> list[str]:
    """Names far from one another, farthest first."""
    if not names:
        return []
    names = sorted(names)
    pivots, gap = [names[0]], [levenshtein(names[0], x) for x in names]
    while len(pivots) < min(most, len(names)) and max(gap) > 0:
        far = names[max(range(len(names)), key=lambda i: (gap[i], names[i]))]
        pivots.append(far)
        gap = [min(g, levenshtein(far, x)) for g, x in zip(gap, names)]
    return pivots


def radius_join(names: DataFrame, name: str = "name", radius: int = RADIUS, pivots: int = PIVOTS) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct names within the Levenshtein radius, exactly.

    names: one row per distinct name. Each name lives in the cell of its nearest
    pivot; it is copied to a cell j when d(x, pivot j) <= d(x, own pivot) + 2 * radius.
    Within a cell, partners lie on rings at most radius apart, so that the join is
    on (cell, ring).
    """
    some = [r[0] for r in names.orderBy(F.xxhash64(name), name).limit(PIVOT_SAMPLE).select(name).collect()]
    chosen = choose_pivots(some, pivots)
    if not chosen:
        return names.select(F.col(name).alias("a"), F.col(name).alias("b")).where("false")
    all_pivots = F.array(*[F.lit(p) for p in chosen])
    far = F.transform(all_pivots, lambda p, i: F.struct(F.levenshtein(F.col("a"), p).alias("ring"), i.alias("cell")))
    homes = names.select(F.col(name).alias("a")).withColumn("_all", far).withColumn("_home", F.array_min("_all"))
    own = homes.select("a", F.col("_home.cell").alias("cell"), F.explode(F.sequence(F.col("_home.ring") - radius, F.col("_home.ring") + radius)).alias("ring"))
    copies = homes.select(F.col("a").alias("b"), F.explode(F.filter("_all", lambda x: x["ring"] <= F.col("_home.ring") + 2 * radius)).alias("_at")).select("b", "_at.cell", "_at.ring")
    near = own.join(copies, ["cell", "ring"]).where((F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= radius) & (F.levenshtein("a", "b", radius) >= 0))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def resolve_labels(labels: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(label, kind, entity) for distinct labels (label string, n bigint).

    nicknames (given_name, nickname) goes to every task; its rows are counted first.
    """
    n = nicknames.count()
    if n > MOST_GIVEN:
        raise ValueError(f"{n} nicknames; at most {MOST_GIVEN} can go to every task")
    short = {r["nickname"].upper(): r["given_name"].upper() for r in nicknames.where("nickname is not null and given_name is not null").collect()}
    live = labels.where("label is not null and trim(label) != ''")
    kinds = kinds_of_organisations(live)
    schema = "label string, n bigint, kind string, anchor string"

    def read(batches):
        reader = Reader(short, kinds)
        for pdf in batches:
            parts = [reader.read(x) for x in pdf["label"]]
            yield pd.DataFrame({"label": pdf["label"], "n": pdf["n"], "kind": [p.kind for p in parts], "anchor": [p.anchor for p in parts]})

    parsed = written(live.mapInPandas(read, schema))
    anchors = parsed.where("kind != 'role'").select(F.concat(F.substring("kind", 1, 1), F.col("anchor")).alias("name")).distinct()
    near = radius_join(anchors).where(F.substring("a", 1, 1) == F.substring("b", 1, 1))

    def check(batches):
        for pdf in batches:
            yield pdf[[damerau(a, b, 1) <= 1 for a, b in zip(pdf["a"], pdf["b"])]]

    linked = hash_to_min(near.mapInPandas(check, "a string, b string"))
    keyed = parsed.withColumn("name", F.concat(F.substring("kind", 1, 1), F.col("anchor"))).join(linked.withColumnRenamed("node", "name"), "name", "left")
    keyed = keyed.withColumn("component", F.coalesce("component", "name"))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        reader = Reader(short, kinds)
        rows = [(x, int(k), reader.read(x)) for x, k in zip(pdf["label"], pdf["n"])]
        found = {}
        found |= resolve_people([r for r in rows if r[2].kind == "person"])
        found |= resolve_organisations([r for r in rows if r[2].kind == "org"])
        return pd.DataFrame({"label": pdf["label"], "kind": pdf["kind"], "entity": [found[x] for x in pdf["label"]]})

    named = keyed.where("kind != 'role'").groupBy("component").applyInPandas(resolve, "label string, kind string, entity string")
    roles = parsed.where("kind = 'role'").select("label", "kind", F.concat(F.lit("role:"), F.regexp_replace(F.trim(F.regexp_replace("anchor", r"\s*:\s*$", "")), r"\s+", " ")).alias("entity"))
    return named.union(roles)


def distinct_labels(turns: DataFrame, speaker: str = "real_speaker") -> DataFrame:
    """(label, n)."""
    return turns.where(F.col(speaker).isNotNull()).groupBy(F.col(speaker).alias("label")).agg(F.count("*").alias("n"))


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b in byte order, of labels with one entity; no roles."""
    live = resolved.where("kind != 'role'").select("label", "entity")
    a, b = live.select(F.col("label").alias("name_a"), "entity"), live.select(F.col("label").alias("name_b"), "entity")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
