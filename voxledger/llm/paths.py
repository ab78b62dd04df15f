"""What the name of an audio chunk says: cases, dialogue number, chunk number.

File names follow ``{case}_{date}_{dialogue}_{chunk}_{8 hex digits}.{ext}``.
Folders, prefixes ("copy of", "noisy_", "sp0.9-"), upper case, zero padding,
compact or dashed dates, percent escapes, other or doubled extensions don't matter.
A file of several cases names all of them before the date.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TAIL = re.compile(r"[_\- ]\d{4}[_\-]?\d{2}[_\-]?\d{2}[_\- ](\d{1,9})[_\- ](\d{1,9})[_\- ][0-9a-f]{8}(?:\.\w+)*\s*$")
NUMBER = re.compile(r"\d{1,18}")
SCHEMA = "cases array<bigint>, dialogue_no int, chunk_no int"


def parse(path: str | None) -> tuple[list[int], int, int] | None:
    """(cases, dialogue number, chunk number), or None if the name has no such form."""
    if path is None:
        return None
    name = unquote(path) if "%" in path else path
    name = name[max(name.rfind("/"), name.rfind("\\")) + 1 :].lower()
    tail = TAIL.search(name)
    start = name.find("case")
    if not tail or start < 0 or start >= tail.start():
        return None
    cases = [int(x) for x in NUMBER.findall(name, start, tail.start())]
    return (cases, int(tail[1]), int(tail[2])) if cases else None


def chunk_key(path: Column) -> Column:
    """struct(cases, dialogue_no, chunk_no); all fields null if the name has no such form."""

    @F.pandas_udf(SCHEMA)
    def read(paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(p) or (None, None, None) for p in paths], columns=["cases", "dialogue_no", "chunk_no"]).astype({"dialogue_no": "Int32", "chunk_no": "Int32"})

    return read(path)
