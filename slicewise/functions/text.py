"""Text functions: stripping, tokens, set similarity, labels and prompt descriptors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # the characters that Python's str.strip() removes
WORD, PLAIN = "[a-z0-9_]+", "[a-z0-9]+"
LABELS = ("ACCEPT", "REJECT")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def blank(text: Column) -> Column:
    """Null, empty or only white space."""
    return text.isNull() | (strip(text) == "")


def tokens(text: Column, pattern: str = WORD) -> Column:
    """The distinct tokens of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def label_tokens(label: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(label), "_"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def parsed_label(text: Column) -> Column:
    """The text as a label, or null."""
    up = F.upper(strip(text))
    return F.when(up.isin(*LABELS), up)


def flipped(label: Column) -> Column:
    return F.when(label == "ACCEPT", F.lit("REJECT")).otherwise(F.lit("ACCEPT"))


def canonical_label(shape: Column) -> Column:
    return F.when(shape.isin("circle", "triangle"), F.lit("ACCEPT")).otherwise(F.lit("REJECT"))


def role_descriptor(prompt: Column) -> Column:
    """``shape=…,size=…`` of the object in the prompt's selected slot; null unless exactly one slot is selected and present once."""
    chosen = F.regexp_extract_all(prompt, F.lit(r"selected_slot=(slot_[a-z])"), F.lit(1))
    pattern = F.lit(r"(slot_[a-z]):shape=([a-z]+),size=([a-z]+)")
    slots, shapes, sizes = (F.regexp_extract_all(prompt, pattern, F.lit(k)) for k in (1, 2, 3))
    at = F.array_position(slots, F.get(chosen, F.lit(0))).cast("int") - 1
    good = (F.size(chosen) == 1) & (at >= 0) & (F.size(slots) == F.size(F.array_distinct(slots)))
    return F.when(good, F.concat(F.lit("shape="), F.get(shapes, at), F.lit(",size="), F.get(sizes, at)))


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def canonical_path(path: Column) -> Column:
    """Relative, with ``/`` only, and without empty, ``.`` or ``..`` parts, ``\\`` or ``:``."""
    return ~path.rlike(r"[\\:]") & ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))


def normalized_key(text: Column) -> Column:
    """White space collapsed, ends stripped, lower case."""
    return F.lower(F.regexp_replace(strip(text), f"[{SPACE}]+", " "))
