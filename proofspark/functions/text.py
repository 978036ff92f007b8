"""Code-point text helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Interpreted lambdas re-evaluate whatever they capture; a lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def explode_rows(df: DataFrame, array: Column, position: str, element: str, keep: list) -> DataFrame:
    """One row per array element with its 0-based position.

    An inner explode makes the optimizer add a not-empty filter that computes the array a second time; the outer form
    with the empty rows dropped afterwards computes it once.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, element)).where(F.col(position).isNotNull())


def once(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """``keep`` plus computed columns that later filters read instead of computing them again.

    Filters on a computed column are pushed below it and repeat its expression; a one-row explode stops that.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.explode_outer(F.array(made)).alias("_made")).select(
        *keep, *[F.col(f"_made.{name}").alias(name) for name in columns])


def is_blank(text: Column) -> Column:
    """True when the text holds nothing but Unicode white space."""
    return ~F.regexp_like(text, F.lit(r"(?U)\S"))


def trim_unicode(text: Column) -> Column:
    # the look-behind starts the trailing match at the head of a run only, which keeps long runs linear
    return F.regexp_replace(text, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def normalize_suggestion(text: Column) -> Column:
    """Lower-cased text without any Unicode white space."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def quoted(text: Column) -> Column:
    """The text as a regex literal."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Half-open code-point slice."""
    return F.substring(text, start + 1, end - start)


def whole_json(text: Column) -> Column:
    """The one JSON value that a text consists of, as a variant; NULL if it is none, or if anything follows it."""
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return let(values, lambda v: F.when(F.size(v) == 1, F.get(v, 0)))


def sentence_ends(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[。！？!?]"))


def valid_document_id(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\A[A-Za-z0-9_-]{1,128}\z"))


def safe_filename(name: Column) -> Column:
    """Last path part without control characters, 180 characters at most."""
    trimmed = F.regexp_replace(name, r"(?:/+\.?)+\z", "")
    base = F.regexp_extract(trimmed, r"[^/]*\z", 0)
    base = F.when(base.isin("", ".."), F.lit("document.txt")).otherwise(base)
    return F.substring(F.regexp_replace(base, r"[\x00-\x1F\x7F-\x{9F}]", ""), 1, 180)
