"""Readable labels and Markdown escaping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from proofspark import constants as K


def label(code: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in labels.items():
        out = F.when(code == key, F.lit(value)).otherwise(out)
    return out


def category_label(category: Column) -> Column:
    return label(category, K.CATEGORY_LABELS)


def subtype_label(subtype: Column) -> Column:
    return label(subtype, K.SUBTYPE_LABELS)


def profile_label(profile: Column) -> Column:
    return label(profile, K.PROFILE_LABELS)


def level_label(level: Column) -> Column:
    return label(level, K.LEVEL_LABELS)


def feedback_label(verdict: Column) -> Column:
    return label(verdict, K.FEEDBACK_LABELS)


def location_label(loc: Column) -> Column:
    """Page and line where known, else paragraph and sentence, else the character range."""
    page, page_end = loc["page"], loc["page_end"]
    first = F.coalesce(loc["line_start"], F.when(page.isNotNull(), F.lit(1)))
    last = F.coalesce(loc["line_end"], first)
    lines = F.when(first == last, F.format_string(K.PLACE_LINE, first)).otherwise(
        F.format_string(K.PLACE_LINES, first, last)
    )
    return (
        F.when(page.isNotNull() & (page_end != page),
               F.format_string(K.PLACE_PAGES, page, first, page_end, last))
        .when(page.isNotNull() & page_end.isNull() & (last < first),
              F.format_string(K.PLACE_OPEN_PAGE, page, first))
        .when(page.isNotNull(), F.concat(F.format_string(K.PLACE_PAGE, page), lines))
        .when(first.isNotNull(), lines)
        .when(loc["paragraph_index"].isNotNull() & loc["sentence_index"].isNotNull(),
              F.format_string(K.PLACE_SENTENCE, loc["paragraph_index"] + 1, loc["sentence_index"] + 1))
        .when(loc["paragraph_index"].isNotNull(), F.format_string(K.PLACE_PARAGRAPH, loc["paragraph_index"] + 1))
        .otherwise(F.format_string(K.PLACE_CHARACTERS, loc["char_start"], loc["char_end"]))
    )


def markdown_text(value: Column) -> Column:
    """Escape ASCII punctuation; a line break stays inside the same list item."""
    escaped = F.regexp_replace(value, r"([!-/:-@\[-`{-~])", r"\\$1")
    return F.regexp_replace(escaped, r"\r\n|\r|\n", "  \n  ")


def markdown_url(value: Column) -> Column:
    """Percent-encode the UTF-8 bytes of white space, control characters and `< > \\ "`."""
    chars = F.split(value, "", -1)
    unsafe = r"""(?U)[\s\p{Cntrl}<>\\"]"""

    def encode(ch: Column) -> Column:
        return F.when(F.regexp_like(ch, F.lit(unsafe)),
                      F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")).otherwise(ch)

    return F.when(F.regexp_like(value, F.lit(unsafe)), F.array_join(F.transform(chars, encode), "")).otherwise(value)
