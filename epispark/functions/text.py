"""Text cleaning: trimming, accent folding, label clean-up, yes/no answers."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from epispark.literals import sql_map

# Every character Python's str.strip() removes.
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
# Labels without meaning.
INVALID_LABELS = ("nan", "none", "undefined", "")


def unaccent_text(value: str) -> str:
    """ASCII part of the canonical decomposition (plain Python string)."""
    return "".join(c for c in unicodedata.normalize("NFD", value) if c.isascii())


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: each non-ASCII character whose canonical
    decomposition has an ASCII base, with that base."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        base = unaccent_text(chr(code))
        if len(base) == 1:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def strip_ws(c: Column) -> Column:
    """Trim all Unicode white space, where SQL ``trim`` removes blanks only."""
    return F.btrim(c, F.lit(WHITESPACE))


def fold_key(c: Column) -> Column:
    """Accent-free, ASCII-only, lower-case, trimmed key for joining names."""
    source, target = accent_table()
    ascii_only = F.regexp_replace(F.translate(c, source, target), r"[^\x00-\x7F]", "")
    return strip_ws(F.lower(ascii_only))


def clean_label(c: Column, unknown: str = "Não informado") -> Column:
    """Null and technical labels become ``unknown``; its spellings are unified."""
    label = strip_ws(c)
    bad = c.isNull() | F.lower(label).isin(*INVALID_LABELS)
    return F.when(bad | (fold_key(label) == unaccent_text(unknown).lower()), F.lit(unknown)).otherwise(label)


def is_valid_label(c: Column, extra: Iterable[str] = ()) -> Column:
    """False for null, technical labels and the folded spellings in ``extra``."""
    return c.isNotNull() & ~fold_key(c).isin(*INVALID_LABELS, *extra)


def is_yes(c: Column, trim: bool = False) -> Column:
    """True for any casing of 'sim'; null counts as no."""
    answer = F.trim(c) if trim else c
    return F.coalesce(F.lower(answer) == "sim", F.lit(False))


def replace_values(c: Column, values: Mapping[str, str], default: Column) -> Column:
    """Exact values replaced from a short vocabulary, a constant map in the plan."""
    return F.coalesce(sql_map(values)[c], default) if values else default
