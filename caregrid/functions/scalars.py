"""Column functions without state; none of them is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity markers in order of precedence.
SEVERITY = [("WITHOUT CC/MCC", "NONE"), ("WITHOUT MCC", "NOT_MCC"), ("WITHOUT CC", "NOT_CC"), ("WITH CC/MCC", "CC_OR_MCC"), ("WITH MCC", "MCC"), ("WITH CC", "CC")]
#: First words of sentences that are no claims, and words without meaning of their own.
HEDGES = ["i ", "i'm ", "let me", "please", "thank", "sure", "of course"]
STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into "
    "through during before after and but or nor not so yet both either neither each every all any few more most other some such no only own same than too "
    "very just because about between this that these those it its they them their we our you your i my me he she his her which what who whom how "
).split()


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def safe_float(c: Column) -> Column:
    """'' and text that is no number are null."""
    return _blank_to_null(c.cast("string")).try_cast("double")


def safe_int(c: Column) -> Column:
    """Through a float, cut towards zero."""
    return safe_float(c).try_cast("int")


def safe_bool(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("yes", "y", "true", "1"), True).when(low.isin("no", "n", "false", "0"), False)


def safe_str(c: Column) -> Column:
    return _blank_to_null(c.cast("string"))


def trailing_tag(c: Column) -> Column:
    """What stands in parentheses at the end, else 'unknown'."""
    tag = F.regexp_extract(c, r"\(([^()]+)\)\s*$", 1)
    return F.when(tag != "", tag).otherwise("unknown")


def without_tag(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\([^()]+\)\s*$", ""))


def severity(title: Column) -> Column:
    """struct(base, status): text before the first marker and its status; no marker: the title and null."""
    base, status = F.trim(title), F.lit(None).cast("string")
    for marker, name in reversed(SEVERITY):
        hit = title.rlike(rf"(?i)\b{marker}\b")
        base = F.when(hit, F.trim(F.regexp_extract(title, rf"(?i)^(.*?)\s*\b{marker}\b", 1))).otherwise(base)
        status = F.when(hit, name).otherwise(status)
    return F.struct(base.alias("base"), status.alias("status"))


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    """The trimmed value's entry in a small table of constants."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.trim(c)), F.lit(default))


def expand_words(c: Column, table: dict[str, str]) -> Column:
    """Each white-space token is replaced by its letters' entry, if it has one."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    letters = lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z]", ""))
    return F.array_join(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.coalesce(F.try_element_at(pairs, letters(w)), w)), " ")


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.7, "High").when(c >= 0.4, "Medium").when(c > 0.1, "Low").otherwise("Ungrounded")


def keywords(c: Column, n: int, stop: list[str] = STOP) -> Column:
    """First n different lower-case words of three letters or more, stop words left out."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(stop))), 1, n)


def claims(c: Column, n: int, least: int = 20, hedges: list[str] = HEDGES) -> Column:
    """First n sentences longer than ``least`` that do not start like a hedge."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    real = F.filter(parts, lambda s: (F.length(s) > least) & ~F.exists(F.array(*map(F.lit, hedges)), lambda h: F.startswith(F.lower(s), h)))
    return F.slice(real, 1, n)


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def edge_type(c: Column) -> Column:
    """Upper-case type if it is well formed, else null."""
    up = F.upper(F.trim(c))
    return F.when(up.rlike("^[A-Z][A-Z0-9_]{0,49}$"), up)


def split_thinking(c: Column) -> Column:
    """struct(thinking, answer): blocks in think tags, joined by a blank line, and the rest."""
    blocks = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1)), lambda b: F.trim(b, F.lit(" \n\t\r")))
    whole = F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")
    rest = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    lone = ~c.contains("<think>") & c.contains("</think>")
    first = F.substring_index(c, "</think>", 1)
    think = F.when(lone, first).otherwise(whole)
    answer = F.when(lone, F.substring(c, F.length(first) + 9, F.length(c))).otherwise(rest)
    strip = lambda x: F.trim(x, F.lit(" \n\t\r"))
    return F.struct(F.nullif(strip(think), F.lit("")).alias("thinking"), strip(answer).alias("answer"))


def strip_wrapper(c: Column) -> Column:
    """Drops think blocks and code fences and keeps the span from the first { to the last }."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def key_points(c: Column) -> Column:
    """Bulleted lines after a 'Key Points' heading."""
    after = F.regexp_extract(c, r"(?is)key points:?\**\s*\n(.*)$", 1)
    lines = F.filter(F.split(after, "\n"), lambda x: x.rlike(r"^\s*[-*•]\s+\S"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•]\s+", "")))


def negated(note: Column, term: Column, cues: str, reach: int = 80) -> Column:
    """Whether a cue stands within ``reach`` characters before any mention of the term."""
    pieces = F.split(F.lower(note), F.concat(F.lit("\\Q"), F.lower(term), F.lit("\\E")), -1)
    before = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.right(p, F.lit(reach)))
    return F.exists(before, lambda p: p.rlike(cues))
