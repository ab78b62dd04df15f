"""Words of a text for comparing: no case, punctuation, fillers or annotations."""

from __future__ import annotations

import re

# fixed values: noise of transcripts
CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:\s?(?:AM|PM|[ap]\.m\.)(?![A-Za-z]))?(?:\s(?:IST|EST|GMT|UTC)\b)?"
BRACKETED_CLOCK = rf"[\[(<]\s*{CLOCK}\s*[\])>]"
ANNOTATION = r"\[[^\]\[]*\]|\{[^{}]*\}|<(?!space>)[^<>\n]*>|\*[A-Za-z ]+\*|\(\([^()]*\)\)|\([a-z][a-z ,.'-]*\)"
FILLERS = {"um", "umm", "uh", "uhh", "hm", "hmm", "er", "erm", "ah", "ahh", "mm", "mmm"}
FILLER_PAIRS = {("you", "know"), ("i", "mean")}

NOISE = re.compile(rf"{BRACKETED_CLOCK}|{ANNOTATION}|(?<![\d:]){CLOCK}(?![\d:])")
SPECIAL = re.compile(r"[\[{<*(:]")
APOSTROPHE = re.compile("['’]")
MARKS = re.compile(r"[\W_]+")
BARE = re.compile(r"[a-z0-9 ]*")


def plain_words(text: str) -> list[str]:
    """Lower-case words without fillers, annotations and clock times."""
    if not BARE.fullmatch(text):
        if SPECIAL.search(text):
            text = NOISE.sub(" ", text.replace("<space>", " "))
        text = MARKS.sub(" ", APOSTROPHE.sub("", text.lower()))
    words = text.split()
    if not FILLERS.isdisjoint(words):
        words = [w for w in words if w not in FILLERS]
    if "you know" in text or "i mean" in text:
        kept: list[str] = []
        for w in words:
            if kept and (kept[-1], w) in FILLER_PAIRS:
                kept.pop()
            else:
                kept.append(w)
        words = kept
    return words


def common_in_order(a: list, masks: dict, n: int) -> int:
    """Length of the longest common subsequence; masks: bit i set for each position i of an item in the other list of n items."""
    full = (1 << n) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def position_masks(items: list) -> dict:
    masks: dict = {}
    for i, x in enumerate(items):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks
