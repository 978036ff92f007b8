"""Finding a quote at exactly one place of a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from proofspark.functions.text import is_blank, let, quoted


def occurrence_starts(text: Column, quote: Column) -> Column:
    """0-based starts of every, also overlapping, occurrence.

    A zero-width split cuts the text in front of each occurrence, so the starts are the running piece lengths.
    """
    lengths = F.transform(
        F.split(text, F.concat(F.lit("(?="), quoted(quote), F.lit(")")), -1), lambda piece: F.length(piece)
    )
    starts = F.aggregate(
        F.slice(lengths, 1, F.size(lengths) - 1),
        F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))),
    )
    return F.when(F.startswith(text, quote), F.concat(F.array(F.lit(0)), starts)).otherwise(starts)


def locate_unique(text: Column, quote: Column, before: Column, after: Column) -> Column:
    """The 0-based start when the quote can mean one place only, else NULL.

    One occurrence wins outright, whatever the contexts say. Among several, the quote together with its contexts must
    occur once.
    """

    def single(needle: Column, otherwise: Column) -> Column:
        return let(F.position(needle, text), lambda at: F.when(at == 0, F.lit(None).cast("int"))
                   .when(F.position(needle, text, at + 1) == 0, at - 1).otherwise(otherwise))

    lead = F.coalesce(before, F.lit(""))
    framed = F.concat(lead, quote, F.coalesce(after, F.lit("")))
    narrowed = let(framed, lambda f: single(f, F.lit(None).cast("int"))) + F.length(lead)
    return F.when(~is_blank(quote), single(quote, narrowed))
