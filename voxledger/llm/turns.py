"""Speech transcripts into clean speaker turns.

Lines are laid out in a few ways: a clock time in one of several brackets, a
speaker's label and a colon after a line break, an arrow or a sentence. Templates of
them are mined from all texts. Every colon label with what stands around it is put
into a tree of fixed depth: case, token before, first letter after, number of tokens,
then the tokens themselves; a token that many lines share is itself, any other its
kind. At each node it is known what share of its values are typed speakers. From the
root on, the first node at which nearly all or nearly none are, else the deepest that
enough lines went through, tells whether its slot is a speaker's.
Likewise every form of digits and marks is a timestamp's slot if its values are
spread like hours, minutes and seconds. What stands in a slot is cut out, whoever it
names, and nothing else is; then noise is removed, and neighbouring texts of one
speaker are merged.

Defined results: a null, empty or wordless dialogue gives no turn and ends none; a
dialogue without speaker goes on with the turn before it, and opens a turn of an
unknown speaker where there is none; of rows with one (case_id, dialogue_no) the
one with the lowest turn_id counts; rows without case_id or dialogue_no have no
place and are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.names import distinct_labels, resolve_labels
from voxledger.llm.words import ANNOTATION
from voxledger.session import written

#: Rows of a case that one task orders; the state is carried over between blocks.
BLOCK = 1000
#: Tokens of a label that the tree looks at.
DEPTH = 4
#: A token in at least this share of the lines (and three) is itself in a template; a node needs this share of the lines.
SHARED, LEAST_LINES, SUPPORT = 0.005, 3, 0.0001
#: Share of a slot's values that are known speakers, from which it is a speaker slot; a node as near to all or none as this isn't divided further.
SPEAKER_SHARE, PURE = 0.5, 0.2
#: Share of a form's values that have to be times, and of sixty minutes or seconds that have to occur as far as there are values.
TIME_SHARE, TIME_SPREAD = 0.98, 0.4
#: Labels go to every task up to this many; beyond, they are joined.
BROADCAST_LABELS = 200_000

#: Digits in groups, with a day's half and zone, in one bracket or none. Patterns begin with what narrows their search.
VALUE = r"(?:\d{0,3}(?:[:.hH]\d{1,4}){1,3}[sS]?)"
HALF = r"(?:(?P<{}>\s?(?:[AaPp][Mm]|[ap]\.m\.)(?![A-Za-z]))?(?:\s(?:IST|EST|GMT|UTC)\b)?)"
NOISE = re.compile(rf"(?P<open>[\[(<])\s*(?P<held>\d{VALUE}){HALF.format('held_half')}\s*(?P<close>[\])>])|{ANNOTATION}|(?P<bare>\d(?<![\w:.].){VALUE}){HALF.format('bare_half')}(?![\w:]|\.\d)")
SPECIAL = re.compile(r"[\[({<*]|\d[:.hH]\d")
COLON = re.compile(r"\s*:(?=\s|$)")
TOKEN = re.compile(r"[\w'’.,()&/-]*\w[\w'’.,()&/-]*")
BEFORE = re.compile(r"(>>|\S)\s*$")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: um, uh, hm, er, erm, ah, mm with any number of their last letter, "you know", "i mean"; neither part of a word.
FILLER = re.compile(r"[uUhHeEaAmMyYiI](?<![\w'].)(?:(?<=[uU])(?:[mM]+|[hH]+)|(?<=[hHmM])[mM]+|(?<=[eE])[rR]+[mM]?|(?<=[aA])[hH]+|(?<=[yY])[oO][uU] [kK][nN][oO][wW]|(?<=[iI]) [mM][eE][aA][nN])(?![\w'])")
MARKS = ".,;:!?-–—"
DOUBLED = re.compile(r"[.,;:!?]\s*[,;:.]|\s[.,;:!?]")
#: What stands for a cut-out time while labels are looked for.
HOLE = "\x01"


def time_in(m: re.Match) -> tuple[str, str] | None:
    """The value of a time, and its form: brackets, number of digits and marks. None for an annotation."""
    if m["held"]:
        return m["held"], f"{m['open']}{re.sub(r'[0-9]', '9', m['held'])}{' half' if m['held_half'] else ''}{m['close']}"
    return (m["bare"], f"{re.sub(r'[0-9]', '9', m['bare'])}{' half' if m['bare_half'] else ''}") if m["bare"] else None


def time_of(value: str) -> tuple[bool, int]:
    """Whether the fields of a value can be a time (hours or minutes, then two digits below sixty, then fractions of three), and its second field."""
    fields = re.split(r"[:.hH]", value.rstrip("sS"))
    rest = fields[1:-1] if len(fields) > 2 and len(fields[-1]) == 3 else fields[1:]
    return len(fields[0]) <= 2 and int(fields[0]) < 60 and bool(rest) and all(len(x) == 2 and int(x) < 60 for x in rest), int(fields[1])


def without_noise(text: str, clocks: frozenset[str] | None) -> str:
    """Text without annotations and times, a hole where each time was; line breaks stay. With clocks, only times of those forms count."""
    if "<space>" in text:
        text = text.replace("<space>", " ")
    if not SPECIAL.search(text):
        return text

    def cut(m: re.Match) -> str:
        time = time_in(m)
        return " " if time is None else f" {HOLE} " if clocks is None or time[1] in clocks else m.group()

    return NOISE.sub(cut, text)


def has_words(text: str) -> bool:
    """A word is left that is no filler."""
    at = 0
    while m := WORD.search(text, at):
        filler = FILLER.match(text, m.start())
        if not filler:
            return True
        at = filler.end()
    return False


def clean(text: str) -> str:
    """Text without fillers, marks left alone and surplus blanks."""
    t = " ".join([w for w in FILLER.sub(" ", text.replace(HOLE, " ")).replace(">>", " ").split() if w[0].isalnum() or w.strip(MARKS)])
    if DOUBLED.search(t):
        t = re.sub(r"\s+([.,;:!?])", r"\1", t)
        t = re.sub(r"([.,;:!?])(?:\s*[,;:.])+", r"\1", t)
    return t.lstrip(" .,;:!?")


@dataclass
class Head:
    """A colon label and what stands around it."""

    start: int
    end: int
    label: str
    case: str
    before: str
    opens: str


def heads(text: str) -> list[Head]:
    """The colon labels of a text: tokens in capitals, or capitalised ones, up to a colon with white space behind it."""
    out: list[Head] = []
    floor = 0
    for m in COLON.finditer(text) if ":" in text else ():
        start, case = m.start(), ""
        while start > floor:
            gap = re.search(r"[^\S\n]*$", text[max(floor, start - 64) : start]) if case else None
            stop = start - (len(gap.group()) if gap else 0)
            at = stop
            while at > floor and not text[at - 1].isspace():
                at -= 1
            token = text[at:stop]
            if token.startswith((">>", "…")):
                token, at = token.lstrip(">…"), stop - len(token.lstrip(">…"))
            if not TOKEN.fullmatch(token):
                break
            kind = "CAPS" if token == token.upper() else "Cap" if token[:1].isupper() else ""
            if not kind or case == "CAPS" and kind == "Cap" or case == "Cap" and (token.endswith((",", ".")) and len(token) > 5):
                break
            case = "Cap" if kind == "Cap" else case or "CAPS"
            start = at
        label = text[start : m.start()]
        skip = re.match(r"(?:[^A-Za-z\s]\S*\s+|[^\w\s]+)*", label)
        start, label = start + skip.end(), label[skip.end() :].strip()
        if label and label[0].isupper():
            floor_ = text[floor:start]
            mark = BEFORE.search(floor_)
            before = "\n" if "\n" in floor_[len(floor_.rstrip()) :] else "^" if not mark else mark[1]
            if before.isalnum() or before in "'’)":
                before = re.search(r"[^\s]+\s*$", floor_)[0].strip().lower()
            opens = text[m.end() :].lstrip()[:1]
            out.append(Head(start, m.end(), label, case, before, "Word" if opens.isupper() else "word" if opens.isalnum() else "mark"))
        floor = m.end()
    return out


@dataclass
class Templates:
    """What was mined: tokens that stand for themselves, nodes of the tree and the share of speakers in them, forms of times."""

    literals: frozenset[str]
    nodes: dict[str, float]
    clocks: frozenset[str]

    def lines(self, dialogue: str | None) -> list[tuple[int, str | None, str]]:
        """(number, label, body) of a dialogue's lines: what opens it, without label, and one line per speaker slot."""
        text = without_noise(dialogue or "", self.clocks)
        found = [h for h in heads(text) if self.is_speaker(h)]
        out: list[tuple[int, str | None, str]] = [(0, None, text[: found[0].start] if found else text)]
        for k, h in enumerate(found, 1):
            out.append((k, h.label, text[h.end : found[k].start if k < len(found) else len(text)]))
        return out

    def is_speaker(self, h: Head) -> bool:
        steps = path(h.case, h.before, h.opens, h.label, self.literals)
        share = 0.0
        for k in range(1, len(steps) + 1):
            here = self.nodes.get(" / ".join(steps[:k]))
            if here is None:
                break
            share = here
            if not PURE < share < 1 - PURE:
                break
        return share >= SPEAKER_SHARE


def path(case: str, before: str, opens: str, label: str, literals: frozenset[str]) -> list[str]:
    """The steps of a line from the root of the tree."""
    def step(token: str) -> str:
        if token in literals:
            return token
        bare = token.strip("'’.,()-")
        return "<number>" if bare.isdigit() else "<letter>" if len(bare) == 1 else "<digits>" if any(x.isdigit() for x in bare) else "<word>"

    tokens = label.replace("_", " ").split()
    return [case, before if len(before) == 1 and not before.isalnum() or before in literals or before == ">>" else "<word>", opens, str(len(tokens)), *map(step, tokens[:DEPTH])]


def mine(rows: DataFrame) -> DataFrame:
    """(kind, case_of, before, opens, label, n, fits, seconds), written once: 'head' and every colon label, 'time' and every form (label) with how many of its values can be times and the minutes or seconds that occur."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            times: dict[str, list] = {}
            for d in pdf["dialogue"]:
                if SPECIAL.search(d):
                    for m in NOISE.finditer(d):
                        if not (time := time_in(m)):
                            continue
                        t = times.setdefault(time[1], [0, 0, set()])
                        ok, second = time_of(time[0])
                        t[0], t[1] = t[0] + 1, t[1] + ok
                        if ok:
                            t[2].add(second)
                found.update((h.case, h.before, h.opens, h.label) for h in heads(without_noise(d, None)))
            yield pd.DataFrame([("head", *k, n, 0, []) for k, n in found.items()] + [("time", "", "", "", k, n, fits, sorted(seconds)) for k, (n, fits, seconds) in times.items()], columns=["kind", "case_of", "before", "opens", "label", "n", "fits", "seconds"])

    counted = rows.where(F.col("dialogue").rlike(r"\d[:.hH]\d|:(\s|$)")).select("dialogue").mapInPandas(read, "kind string, case_of string, before string, opens string, label string, n bigint, fits bigint, seconds array<int>")
    return written(counted.groupBy("kind", "case_of", "before", "opens", "label").agg(F.sum("n").alias("n"), F.sum("fits").alias("fits"), F.array_distinct(F.flatten(F.collect_list("seconds"))).alias("seconds")))


def clock_forms(mined: DataFrame) -> DataFrame:
    """(form, n, is_time)."""
    spread = F.size(F.filter("seconds", lambda x: x < 60)) >= TIME_SPREAD * F.least(F.lit(60), F.col("n"))
    return mined.where("kind = 'time'").select(F.col("label").alias("form"), "n", ((F.col("fits") >= TIME_SHARE * F.col("n")) & spread).alias("is_time"))


def mine_layouts(mined: DataFrame, speakers: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """(layout, depth, n, share, is_speaker) of the tree's nodes that enough lines went through, and the tokens that stand for themselves.

    speakers: (label, entity, known). Nodes and tokens are bounded by the shares they need.
    """
    found = mined.where("kind = 'head'").select("case_of", "before", "opens", "label", "n")
    whole = found.agg(F.sum("n")).first()[0] or 0
    tokens = found.select(F.explode(F.array_distinct(F.concat(F.array("before"), F.split(F.translate("label", "_", " "), r"\s+")))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    literals = frozenset(r[0] for r in tokens.where(F.col("n") >= max(LEAST_LINES, SHARED * whole)).select("token").collect())

    @F.pandas_udf("array<string>")
    def steps(case: pd.Series, before: pd.Series, opens: pd.Series, label: pd.Series) -> pd.Series:
        all_steps = [path(*x, literals) for x in zip(case, before, opens, label)]
        return pd.Series([[" / ".join(s[:k]) for k in range(1, len(s) + 1)] for s in all_steps], dtype=object)

    known = found.join(speakers.where("known").select("label", F.lit(1).alias("hit")), "label", "left")
    nodes = known.select(F.posexplode(steps("case_of", "before", "opens", "label")).alias("depth", "layout"), "n", F.when(F.col("hit").isNotNull(), F.col("n")).otherwise(0).alias("hits"))
    counted = nodes.groupBy("layout", "depth").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("share"))
    return counted.where((F.col("depth") == 0) | (F.col("n") >= SUPPORT * whole)).withColumn("is_speaker", F.col("share") >= SPEAKER_SHARE), literals


def speakers_of(rows: DataFrame, mined: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(label, entity, known) of typed speakers and of mined labels, written once; known: the entity has a typed label."""
    typed = distinct_labels(rows).withColumn("typed", F.lit(1))
    inside = mined.where("kind = 'head'").groupBy("label").agg(F.sum("n").alias("n")).withColumn("typed", F.lit(0))
    labels = written(typed.union(inside).groupBy("label").agg(F.sum("n").alias("n"), F.max("typed").alias("typed")))
    resolved = resolve_labels(labels.select("label", "n"), nicknames).join(labels.select("label", "typed"), "label")
    return written(resolved.select("label", "entity", (F.max("typed").over(Window.partitionBy("entity")) == 1).alias("known")))


def small(df: DataFrame, most: int = BROADCAST_LABELS) -> DataFrame:
    """df, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.count() <= most else df


def placed(rows: DataFrame) -> DataFrame:
    """(turn_id, case_id, dialogue_no, real_speaker, dialogue) of rows with a place, each place once; only keys are shuffled."""
    live = rows.where("case_id is not null and dialogue_no is not null").select("turn_id", "case_id", "dialogue_no", F.when(F.trim("real_speaker") != "", F.col("real_speaker")).alias("real_speaker"), "dialogue")
    ids = live.groupBy("case_id", "dialogue_no").agg(F.sort_array(F.collect_list("turn_id")).alias("ids")).where(F.size("ids") > 1)
    later = written(ids.select(F.explode(F.slice("ids", F.lit(2), F.size("ids"))).alias("turn_id")))
    return live.join(small(later), "turn_id", "left_anti")


def fragments(rows: DataFrame, nicknames: DataFrame, texts: bool = False) -> DataFrame:
    """(case_id, dialogue_no, frag_no, entity, speaker, text), written once: the lines with words of each dialogue; entity null goes on with the one before; text only on demand.

    A label that is in no speaker's slot is part of the text.
    """
    once = placed(rows)
    mined = mine(once)
    speakers = speakers_of(once, mined, nicknames)
    nodes, literals = mine_layouts(mined, speakers)
    templates = Templates(literals, {r["layout"]: r["share"] for r in nodes.select("layout", "share").collect()}, frozenset(r["form"] for r in clock_forms(mined).where("is_time").collect()))
    kept = ["case_id", "dialogue_no", "real_speaker"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index, out = [], []
            for i, d in enumerate(pdf["dialogue"]):
                for n, label, body in templates.lines(d) if d else ():
                    if has_words(body):
                        index.append(i)
                        out.append((n, label, clean(body) if texts else None))
            own = pdf[kept].iloc[index].reset_index(drop=True)
            made = pd.DataFrame(out, columns=["frag_no", "label", "text"], dtype=object)
            yield own.assign(frag_no=made["frag_no"].astype("int32"), speaker=made["label"].where(made["label"].notna(), own["real_speaker"]), text=made["text"]).drop(columns="real_speaker")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in once.select("case_id", "dialogue_no").schema.fields)
    lines = once.select(*kept, "dialogue").mapInPandas(read, f"{fields}, frag_no int, speaker string, text string")
    entities = speakers.select(F.col("label").alias("speaker"), "entity")
    return written(lines.join(small(entities), "speaker", "left").select("case_id", "dialogue_no", "frag_no", "entity", "speaker", "text"))


def number_turns(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """parts with turn_no, counted from 1 within the case.

    A case is ordered in blocks of dialogue numbers; a block needs of those before
    it only the last speaker and the number of turns, so that a case of any length
    is spread over tasks.
    """
    parts = parts.withColumn("_block", F.floor(F.col("dialogue_no") / block))
    within = Window.partitionBy("case_id", "_block").orderBy("dialogue_no", "frag_no")
    ends = parts.groupBy("case_id", "_block").agg(F.max(F.when(F.col("entity").isNotNull(), F.struct("dialogue_no", "frag_no", "entity"))).alias("_last"))
    blocks = Window.partitionBy("case_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("case_id", "_block", F.last("_last.entity", ignorenulls=True).over(blocks).alias("_carry"), (F.count("*").over(blocks) > 0).alias("_later"))
    live = parts.join(carried, ["case_id", "_block"]).withColumn("_now", F.coalesce(F.last("entity", ignorenulls=True).over(within), F.col("_carry")))
    before = F.lag("_now").over(within)
    first = F.row_number().over(within) == 1
    opens = F.when(first, ~F.col("_later") | ~F.col("_now").eqNullSafe(F.col("_carry"))).otherwise(~F.col("_now").eqNullSafe(before))
    flagged = live.withColumn("_open", opens.cast("int")).withColumn("_count", F.sum("_open").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    sums = flagged.groupBy("case_id", "_block").agg(F.sum("_open").alias("_n")).select("case_id", "_block", F.coalesce(F.sum("_n").over(blocks), F.lit(0)).alias("_offset"))
    return flagged.join(sums, ["case_id", "_block"]).withColumn("turn_no", F.col("_offset") + F.col("_count")).withColumn("entity", F.col("_now")).drop("_block", "_carry", "_later", "_now", "_open", "_count", "_offset")


def turn_rows(numbered: DataFrame) -> DataFrame:
    """(case_id, turn_no, entity, first_dialogue_no, turn_in_row, last_dialogue_no)."""
    turns = numbered.groupBy("case_id", "turn_no").agg(F.min("dialogue_no").alias("first_dialogue_no"), F.max("dialogue_no").alias("last_dialogue_no"), F.first("entity").alias("entity"))
    return turns.withColumn("turn_in_row", F.row_number().over(Window.partitionBy("case_id", "first_dialogue_no").orderBy("turn_no")))


def turn_texts(numbered: DataFrame) -> DataFrame:
    """(case_id, turn_no, speaker, text): the label that the turn was first typed with, and its words in order."""
    at = F.struct("dialogue_no", "frag_no", "text")
    return numbered.groupBy("case_id", "turn_no").agg(
        F.min_by("speaker", F.when(F.col("speaker").isNotNull(), F.struct("dialogue_no", "frag_no"))).alias("speaker"),
        F.array_join(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["text"]), " ").alias("text"),
    )
