"""String columns: normalization, sentences, names, condensing.

White space is Unicode white space (``WS``); Java's ``\\s`` alone is ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python calls white space, as a Java character class.
WS = r"[\s\x0B\x1C-\x1F\u0085\p{Z}]"
NOT_WS = r"[^\s\x0B\x1C-\x1F\u0085\p{Z}]"

# Latin ligatures and their letters.
LIGATURES = {
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
}


def strip(c: Column) -> Column:
    """Unicode white space removed at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; ends stripped."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def expand_ligatures(c: Column) -> Column:
    for glyph, letters in LIGATURES.items():
        c = F.replace(c, F.lit(glyph), F.lit(letters))
    return c


def name_key(c: Column) -> Column:
    """Grouping key of a name: lower case, white space collapsed."""
    return F.lower(collapse(c))


def running_form(c: Column) -> Column:
    """A margin line with its digit runs masked, for finding running headers."""
    return F.lower(F.regexp_replace(collapse(c), r"\p{Nd}+", "#"))


def plain_text(c: Column) -> Column:
    """Lower case letters, digits and single spaces."""
    return collapse(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}\s\x1C-\x1F\u0085\p{{Z}}]", ""))


def word_text(c: Column) -> Column:
    """Lower case ASCII letters and digits; everything else is one space each."""
    return F.regexp_replace(F.lower(c), rf"[^a-z0-9\s\x1C-\x1F\u0085\p{{Z}}]", " ")


def snake_name(c: Column) -> Column:
    """First three non-empty words, joined by underscores, letters a-z only."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[ \-]", "_"), r"[^a-z_]", "")
    return F.array_join(F.slice(F.filter(F.split(letters, "_"), lambda w: w != ""), 1, 3), "_")


def is_snake_name(c: Column) -> Column:
    """One to three lower-case ASCII words joined by underscores."""
    return c.rlike(r"^[a-z]+(_[a-z]+){0,2}$")


def sentences_of(c: Column, at_semicolons: bool = False) -> Column:
    """Array of stripped, non-empty sentences: cut at white space after . ! or ? (and at ``;`` if asked)."""
    cut = rf"(?<=[.!?]){WS}+" + (rf"|;{WS}+" if at_semicolons else "")
    return F.filter(F.transform(F.split(strip(c), cut), strip), lambda s: s != "")


def snippet_sentences(c: Column, least: int = 30) -> Column:
    """Sentences of at least ``least`` characters; the whole text when none is that long."""
    kept = F.filter(sentences_of(c), lambda s: F.length(s) >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(c))


def passage_sentences(c: Column, least: int = 20) -> Column:
    """Sentences of at least ``least`` characters, possibly none."""
    return F.filter(sentences_of(c), lambda s: F.length(s) >= least)


def paragraphs_of(c: Column, least: int = 80) -> Column:
    """Blank-line separated paragraphs, collapsed, of at least ``least`` characters."""
    parts = F.transform(F.split(c, rf"\n{WS}*\n"), collapse)
    return F.filter(parts, lambda p: F.length(p) >= least)


# What page furniture holds, or begins with.
FURNITURE_TITLES = ["journal of south american earth sciences"]
FURNITURE_PREFIXES = ["contents lists available", "journal homepage:"]


def is_furniture(c: Column) -> Column:
    return is_header_or_footer(F.lower(c), FURNITURE_TITLES, FURNITURE_PREFIXES)


def is_header_or_footer(c: Column, titles: list[str], prefixes: list[str]) -> Column:
    """A line of digits only, or one that holds a title or starts with a prefix; both lists are the caller's."""
    line = strip(c)
    found = line.rlike(r"^\p{Nd}+$")
    for t in titles:
        found = found | line.contains(t)
    for p in prefixes:
        found = found | line.startswith(p)
    return found


def folder_name(c: Column) -> Column:
    """A run's name as a folder: slashes doubled underscores, control characters gone."""
    flat = F.regexp_replace(F.regexp_replace(c, r"[/\\]", "__"), r"\p{C}", "")
    return F.when(flat == "", F.lit("unknown_run")).otherwise(flat)


def condense(c: Column, most_sentences: int, most_chars: int, at_semicolons: bool = False) -> Column:
    """Leading sentences within ``most_chars``, as they are; the first always stays.

    Only a first sentence that is too long is changed: cut at a late clause, else before a word, and ended with a full stop. Empty text stays empty.
    """
    parts = F.slice(sentences_of(c, at_semicolons), 1, most_sentences)
    start = F.struct(F.lit("").alias("t"), F.lit(True).alias("open"))

    def add(acc: Column, s: Column) -> Column:
        first = acc["t"] == ""
        fits = first | (acc["open"] & (F.length(acc["t"]) + 1 + F.length(s) <= most_chars))
        joined = F.when(first, s).otherwise(F.concat(acc["t"], F.lit(" "), s))
        return F.struct(F.when(fits, joined).otherwise(acc["t"]).alias("t"), (acc["open"] & fits).alias("open"))

    least = int(most_chars * 0.6)

    def ended(text: Column) -> Column:
        head = F.substring(text, 1, most_chars)

        def at_last(mark: str) -> Column:
            return F.length(head) - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 1

        def late(mark: str) -> Column:
            return (F.instr(head, mark) > 0) & (at_last(mark) >= least)

        cut = F.when(F.instr(head, " ") > 0, F.substring(head, F.lit(1), at_last(" "))).otherwise(head)
        for mark in (", ", "; "):
            cut = F.when(late(mark), F.substring(head, F.lit(1), at_last(mark))).otherwise(cut)
        cut = F.regexp_replace(cut, "[ ,;:\\-—]+$", "")
        return F.when(F.length(text) <= most_chars, text).when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit(".")))

    # A one-element array names the text, so that it is computed once and not wherever it is read.
    return F.get(F.transform(F.array(F.aggregate(parts, start, add, lambda acc: acc["t"])), ended), 0)


def tidy_triple(c: Column) -> Column:
    """``a | b | c``: kept when it has exactly two pipes, else cut lazily at other separators."""
    text = strip(c)
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    sep = rf"(?:{WS}*[|–—,;]{WS}*|{WS}+[-–—]{WS}+)"
    pattern = rf"^(.+?)({sep})(.+?)({sep})(.+)$"
    a, b, d = (strip(F.regexp_extract(text, pattern, g)) for g in (1, 3, 5))
    joined = F.concat_ws(" | ", a, b, d)
    return F.when(pipes == 2, text).when((a != "") & (b != "") & (d != ""), joined).otherwise(text)


def without_reasoning(c: Column) -> Column:
    """Model text without its reasoning blocks, closed or stray. Tags may hold white space."""
    tags = f"{WS}*(think|thinking|reasoning|analysis){WS}*"
    out = F.regexp_replace(c, rf"(?is)<{tags}>.*?<{WS}*/{WS}*\1{WS}*>", "")
    out = F.regexp_replace(out, rf"(?is)^.*<{WS}*/{tags}>", "")
    out = F.regexp_replace(out, rf"(?is)^.*<{tags}>", "")
    return strip(out)


def without_fence(c: Column) -> Column:
    """A fenced answer without its first line and everything from the last fence on. One line is a last line, not a first one."""
    body = F.regexp_replace(F.regexp_replace(c, r"^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    return F.when(c.startswith("```"), strip(body)).otherwise(c)


def relation_text(description: Column, definition: Column) -> Column:
    """What the encoder reads of a relation."""
    return F.concat_ws(" ", F.nullif(strip(description), F.lit("")), F.nullif(strip(definition), F.lit("")))
