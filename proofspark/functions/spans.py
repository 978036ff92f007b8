"""Protected fragments of a chunk as arrays of half-open spans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from proofspark import constants as K
from proofspark.functions.text import is_blank, let, slice_text, trim_unicode

SPANS = "array<struct<start:int,end:int>>"


def _none() -> Column:
    return F.array().cast(SPANS)


#: Set around matches; texts that hold it themselves are searched twice instead.
_MARK = "\x01"


def pattern_spans(text: Column, pattern: str) -> Column:
    """Spans of all matches, none of which may be empty: cut at marks around the matches, gaps and matches alternate, so lengths add up."""

    def add(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"), (~acc["hit"]).alias("hit"),
            F.when(acc["hit"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def place(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), _none().alias("spans"))
        return F.when(F.size(pieces) == 1, _none()).otherwise(F.aggregate(pieces, zero, add, lambda acc: acc["spans"]))

    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    return F.when(F.contains(text, F.lit(_MARK)), _searched_twice(text, pattern)).otherwise(let(marked, place))


def _searched_twice(text: Column, pattern: str) -> Column:
    """Spans of all matches in any text: the pieces between matches and the matches alternate, so lengths add up."""

    def place(found: Column) -> Column:
        pieces = F.zip_with(
            F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap)),
            F.transform(found, lambda hit: F.length(hit)),
            lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
        )

        def add(acc: Column, piece: Column) -> Column:
            start = acc["at"] + piece["gap"]
            end = start + F.coalesce(piece["hit"], F.lit(0))
            span = F.struct(start.alias("start"), end.alias("end"))
            return F.struct(
                end.alias("at"),
                F.when(piece["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"),
            )

        zero = F.struct(F.lit(0).alias("at"), _none().alias("spans"))
        return F.when(F.size(found) == 0, _none()).otherwise(
            F.aggregate(pieces, zero, add, lambda acc: acc["spans"])
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def dollar_math_spans(text: Column) -> Column:
    """Spans of `$..$` and `$$..$$` formulas.

    An escaped dollar is consumed together with its backslash, what is left are the delimiters.
    Whether two neighbouring delimiters may close is known per pair; a pair that closed cannot close again.
    """

    def spans(body: Column) -> Column:
        token = r"(?s)\\.|\$\$|\$"
        tokens = F.filter(
            F.transform(pattern_spans(body, token), lambda t: F.struct(
                t["start"].alias("start"), t["end"].alias("end"),
                (slice_text(body, t["start"], t["start"] + 1) == "$").alias("dollar"),
            )),
            lambda t: t["dollar"],
        )

        def closes(left: Column, right: Column) -> Column:
            width = left["end"] - left["start"]
            same = width == right["end"] - right["start"]

            def valid(inner: Column) -> Column:
                inline = (
                    (trim_unicode(inner) == inner)
                    & ~F.regexp_like(inner, F.lit(K.INLINE_MATH_STOPS))
                    & ~F.regexp_like(inner, F.lit(K.AMOUNT_THEN_PROSE_PATTERN))
                    & ~F.regexp_like(slice_text(body, right["end"], right["end"] + 1), F.lit("[0-9０-９]"))
                )
                return ~is_blank(inner) & ((width == 2) | inline)

            return same & let(slice_text(body, left["end"], right["start"]), valid)

        def pair_up(marks: Column) -> Column:
            count = F.size(marks)
            pairs = F.when(count < 2, _none().cast("array<struct<start:int,end:int>>")).otherwise(_none())
            verdicts = F.transform(
                F.slice(marks, 2, F.greatest(count - 1, F.lit(0))),
                lambda right, i: F.struct(
                    F.get(marks, i)["start"].alias("start"), right["end"].alias("end"),
                    closes(F.get(marks, i), right).alias("ok"),
                ),
            )

            def keep(acc: Column, pair: Column) -> Column:
                taken = acc["open"] & pair["ok"]
                span = F.struct(pair["start"].alias("start"), pair["end"].alias("end"))
                return F.struct(
                    (~taken).alias("open"),
                    F.when(taken, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
                )

            zero = F.struct(F.lit(True).alias("open"), _none().alias("spans"))
            return F.when(count < 2, pairs).otherwise(F.aggregate(verdicts, zero, keep, lambda acc: acc["spans"]))

        return let(tokens, pair_up)

    return F.when(F.contains(text, F.lit("$")), let(text, spans)).otherwise(_none())


#: What a pattern cannot do without; a cheap look for it spares most texts the full pattern.
_HINTS = {"base": r"://|www\.|[`\\]", "academic": r"10\.|[\[［(（]", "financial": r"(?U)\d"}


def _guarded(text: Column, name: str, pattern: str) -> Column:
    return F.when(F.regexp_like(text, F.lit(_HINTS[name])), pattern_spans(text, pattern)).otherwise(_none())


def common_spans(text: Column) -> Column:
    """Spans protected whatever the profile."""
    return F.concat(_guarded(text, "base", K.BASE_PATTERN), dollar_math_spans(text))


def scene_spans(text: Column, profile: Column | str) -> Column:
    """Spans that only this profile protects."""
    if isinstance(profile, str):
        pattern = {"academic": K.ACADEMIC_PATTERN, "financial": K.FINANCIAL_PATTERN}.get(profile)
        return _guarded(text, profile, pattern) if pattern else _none()
    return F.when(profile == "academic", scene_spans(text, "academic")).when(
        profile == "financial", scene_spans(text, "financial")).otherwise(_none())


def protected_spans(text: Column, profile: Column) -> Column:
    """All spans protected for a profile; computed once per chunk."""
    return F.concat(common_spans(text), scene_spans(text, profile))


def is_protected(spans: Column, start: Column, end: Column, category: Column) -> Column:
    """Grammar quotes must lie inside one span; other quotes only need to touch one."""
    return F.when(
        category == "grammar", F.exists(spans, lambda s: (s["start"] <= start) & (s["end"] >= end))
    ).otherwise(F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start)))
