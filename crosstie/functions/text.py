"""Text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from crosstie.functions.nulls import col, paste


def title_case(c: str | Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    ``initcap`` only starts a word after white space, so the text is cut into
    letter runs and separators first.
    """
    parts = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def narrative(*cols: str | Column, literal: bool = False) -> Column:
    """Merge text parts, skipping missing ones.

    ``literal=True`` reproduces the source study's text: parts are pasted with
    ``NA`` for missing values and every ``" NA"`` is removed afterwards, also
    inside words.
    """
    if literal:
        return F.regexp_replace(paste(*cols, sep=" "), " NA", "")
    return F.concat_ws(" ", *[col(c) for c in cols])


def prefix(c: str | Column, n: int) -> Column:
    return F.substring(col(c), 1, n)


def clean_name(name: str) -> str:
    """One column name in snake_case: camel humps split, other characters to ``_``."""
    name = name.replace("%", "_percent_").replace("#", "_number_")
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    if name[:1].isdigit():
        name = "x" + name
    return name or "x"


def clean_names(names) -> list[str]:
    """Clean all names; repeats get ``_2``, ``_3`` ... in order."""
    seen: dict[str, int] = {}
    out = []
    for n in map(clean_name, names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out
