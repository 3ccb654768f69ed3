"""Text cleaning, splitting and light mark-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as a Unicode-aware class; Java's bare \s is ASCII only.
WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


# The characters of WS (fixed values).
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def non_empty(arr: Column) -> Column:
    return F.filter(arr, lambda x: x != "")


def strip_all(arr: Column) -> Column:
    return non_empty(F.transform(arr, strip))


def words(c: Column) -> Column:
    """White-space separated words."""
    return non_empty(F.split(c, f"{WS}+"))


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def count_word_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def count_words(c: Column) -> Column:
    return F.size(words(c))


def sentences_keep(c: Column) -> Column:
    """Sentences with their closing punctuation; line breaks also end one."""
    return strip_all(F.split(c, rf"(?<=[.?!]){WS}+|\n+"))


def sentences_drop(c: Column) -> Column:
    """Sentences without the punctuation that separates them."""
    return strip_all(F.split(c, rf"[.!?]+{WS}+"))


def paragraphs(c: Column) -> Column:
    return strip_all(F.split(c, r"\n\n+"))


def collapse_breaks(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def preprocess(c: Column) -> Column:
    """Remove page-number lines and ``Page x of y``, then collapse blanks."""
    c = F.regexp_replace(c, rf"(?dm)^{WS}*\d{{1,3}}{WS}*$", "")
    c = F.regexp_replace(c, rf"(?i)Page{WS}+\d+(?:{WS}+of{WS}+\d+)?", "")
    return strip(F.regexp_replace(collapse_breaks(c), " {2,}", " "))


def _markdown_line(line: Column) -> Column:
    numbered = rf"^(\d+(?:\.\d+)*)\.{WS}+(.+)$"
    title = strip(F.regexp_extract(line, numbered, 2))
    marks = F.when(F.regexp_extract(line, numbered, 1).contains("."), "##").otherwise("#")
    heading = (F.length(line) < 100) & ~line.rlike(r"[.!?:;]$")
    return (
        F.when(~heading | (line == ""), line)
        .when(line.rlike(numbered), F.concat_ws(" ", marks, title))
        .when(count_words(line) <= 10, F.concat(F.lit("## "), line))
        .otherwise(line)
    )


def to_markdown(c: Column) -> Column:
    """Plain text to Markdown: short unpunctuated lines become headings."""
    c = F.regexp_replace(collapse_breaks(c), " {2,}", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    lines = F.transform(F.split(c, "\n"), lambda x: _markdown_line(strip(x)))
    return strip(collapse_breaks(F.array_join(lines, "\n")))


def dedup_key(c: Column) -> Column:
    """Text equal up to case and white space."""
    return F.regexp_replace(F.lower(strip(c)), f"{WS}+", " ")


def content_hash(c: Column) -> Column:
    return F.md5(F.lower(strip(c)))


def slug(c: Column) -> Column:
    c = F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_{WS[1:-1]}-]", "")
    c = F.regexp_replace(F.regexp_replace(c, f"{WS}+", "_"), "_+", "_")
    c = F.lower(F.substring(F.regexp_replace(c, "^_+|_+$", ""), 1, 100))
    return F.when(c == "", F.lit("research_overview")).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


# The mark-up rewrites, in the order they apply.
MARKDOWN_RULES = [
    (r"(?dm)^# (.+)$", "<h1>$1</h1>"),
    (r"(?dm)^## (.+)$", "<h2>$1</h2>"),
    (r"(?dm)^### (.+)$", "<h3>$1</h3>"),
    (r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"(?d)\*(.+?)\*", "<em>$1</em>"),
    (r"```([^`]+)```", "<pre><code>$1</code></pre>"),
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"\[([^\]]+)\]\(([^\)]+)\)", '<a href="$2">$1</a>'),
]


def markdown_to_html(c: Column) -> Column:
    for pattern, replacement in MARKDOWN_RULES:
        c = F.regexp_replace(c, pattern, replacement)

    def paragraph(p: Column) -> Column:
        bare = strip(p)
        wrap = (bare != "") & ~bare.startswith("<")
        return F.when(wrap, F.concat(F.lit("<p>"), bare, F.lit("</p>"))).otherwise(p)

    return F.array_join(F.transform(F.split(c, "\n\n"), paragraph), "\n")


def clip(c: Column, n: int, tail: str = "...") -> Column:
    """First ``n`` characters, with ``tail`` only where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


def clean_section(c: Column, keep_headers: bool = False) -> Column:
    """Drop repeated section headers and whole ``### Introduction/Summary`` blocks.

    A block runs from its header to the next blank or ``###`` line, so the text
    is cut at those lines first and the unwanted headers go with their piece.
    """
    lines = F.split(c, "\n")
    header = lambda x: strip(x).isin("### Introduction", "### Summary")
    stop = lambda x: (strip(x) == "") | strip(x).startswith("###")
    repeated = lambda x: strip(x).startswith("## Abstract") | strip(x).startswith(
        "## Introduction"
    )
    if not keep_headers:
        lines = F.filter(lines, lambda x: ~repeated(x))
    marks = F.transform(
        lines, lambda x, i: F.when(header(x), i + 1).when(stop(x), -(i + 1)).otherwise(F.lit(0))
    )
    # The sign of the last mark before a line tells whether it lies in a dropped block.
    state = F.aggregate(
        marks,
        F.array().cast("array<int>"),
        lambda acc, m: F.array_append(
            acc, F.when(m != 0, m).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))
        ),
    )
    kept = F.filter(F.arrays_zip(lines.alias("l"), state.alias("s")), lambda z: z["s"] <= 0)
    return F.array_join(F.transform(kept, lambda z: z["l"]), "\n")
