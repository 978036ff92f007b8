"""Narrowing a literal correction to the characters it changes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from proofspark import constants as K
from proofspark.functions.text import let, slice_text

# --- fixed values: what still counts as a small literal edit ---
MIN_SHARED = 4
MAX_CHANGED = 8


def _common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading elements of two arrays."""
    size = F.least(F.size(a), F.size(b))
    mismatch = F.array_position(
        F.zip_with(F.slice(a, 1, size), F.slice(b, 1, size), lambda x, y: x == y), F.lit(False)
    )
    return F.when(mismatch == 0, size).otherwise((mismatch - 1).cast("int"))


def localize_edit(category: Column, quote: Column, suggestion: Column) -> Column:
    """struct(char_offset, original_text, suggestion), or NULL when the correction is not a small literal edit."""

    def narrow(pair: Column) -> Column:
        old, new = pair["old"], pair["new"]

        def cut(prefix: Column) -> Column:
            tail_old = F.slice(old, prefix + 1, F.size(old) - prefix)
            tail_new = F.slice(new, prefix + 1, F.size(new) - prefix)

            def build(suffix: Column) -> Column:
                shared = prefix + suffix
                old_end = F.size(old) - suffix
                new_end = F.size(new) - suffix
                small = (
                    (shared >= MIN_SHARED)
                    & (shared * 4 >= F.size(old) * 3)
                    & (old_end > prefix)
                    & (old_end - prefix <= MAX_CHANGED)
                    & (new_end - prefix <= MAX_CHANGED)
                )
                was = slice_text(quote, prefix, old_end)
                becomes = slice_text(suggestion, prefix, new_end)
                return F.when(small, F.struct(
                    prefix.cast("int").alias("char_offset"),
                    was.alias("original_text"),
                    F.when(new_end == prefix, F.concat(F.lit("删除此处的“"), was, F.lit("”")))
                    .otherwise(becomes).alias("suggestion"),
                ))

            return let(_common_prefix(F.reverse(tail_old), F.reverse(tail_new)), build)

        return let(_common_prefix(old, new), cut)

    plausible = (
        category.isin(K.LITERAL_EDIT_CATEGORIES)
        & (F.abs(F.length(quote) - F.length(suggestion)) <= MAX_CHANGED)
        & (F.length(quote) > 0)
        & (F.length(suggestion) > 0)
    )
    chars = F.struct(F.split(quote, "", -1).alias("old"), F.split(suggestion, "", -1).alias("new"))
    return F.when(plausible, let(chars, narrow))
