"""Language identification by compression: the language whose dictionary makes the text smallest.

Each language has a zstandard raw-content dictionary of known texts. A text is lower-cased, reduced to its letters and
encoded once with every dictionary, in chunks so that long texts keep profiting from it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from proofspark.session import written

#: Texts a language that dictionaries are made of (those with the smallest digests of their ids), their bytes, and how far a word must lead.
FITTED, SIZE, LEAD = 1000, 1 << 15, 1.5
LEVEL, CHUNK = 9, 1000
#: Bytes that one letter saved is worth in a score; a lead of fewer bytes than MARGIN and than MARGIN_SHARE of the size is narrow.
SHARPNESS, MARGIN, MARGIN_SHARE = 0.5, 2, 0.01

_BREAKS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    return _BREAKS.sub(" ", (text or "").lower()).strip()


class Sizes:
    """Compressed size of a text with each language's dictionary; languages in the order of their names."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            known = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            known.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress)

    def of(self, clean: str) -> np.ndarray:
        parts = [(" " + clean[k : k + CHUNK] + " ").encode() for k in range(0, len(clean), CHUNK)]
        return np.array([sum(len(code(p)) for p in parts) for code in self.coders], float)


def _predict(dictionaries: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(dictionaries) if dictionaries else None
        for b in batches:
            langs, scores, narrow = [], [], []
            for text in b.column("text").to_pylist():
                clean = letters(text)
                if not clean or sizes is None:
                    langs.append("und"), scores.append(0.0), narrow.append(True)
                    continue
                x = sizes.of(clean)
                best = int(x.argmin())
                lead = np.delete(x, best).min() - x[best] if len(x) > 1 else np.inf
                langs.append(sizes.langs[best])
                scores.append(float(1 / np.exp(-SHARPNESS * np.minimum(x - x[best], 100)).sum()))
                narrow.append(bool(lead < MARGIN or lead < MARGIN_SHARE * x[best]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "narrow"])

    return run


def dictionaries(docs: DataFrame, learn: Column, fitted: int = FITTED, size: int = SIZE) -> dict[str, bytes]:
    """A raw-content dictionary of at most ``size`` bytes a language, from about ``fitted`` of its texts for which ``learn`` holds.

    A word belongs to a language if it is in LEAD times more of its sampled texts than in those of any other; the
    dictionary lists such words with the most usual ones last, where matches cost least. Lines that stray into texts of
    other languages thus teach nothing.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    rows = known.select("lang", "doc_id", "text", drawn.alias("drawn")).join(F.broadcast(counts), "lang").where(F.col("drawn") * F.col("n") < fitted)
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    found = rows.select("lang", F.explode(words).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    texts = {r["lang"]: min(r["n"], fitted) for r in counts.collect()}
    rates: dict[str, dict[str, float]] = {lang: {} for lang in texts}
    for r in found.collect():
        rates[r["lang"]][r["word"]] = r["n"] / texts[r["lang"]]
    out = {}
    for lang, own in rates.items():
        lead = [(rate, w) for w, rate in own.items() if all(rate > LEAD * other.get(w, 0.0) for name, other in rates.items() if name != lang)]
        kept, used = [], 0
        for _, w in sorted(lead, reverse=True):
            used += len(w.encode()) + 1
            if used > size:
                break
            kept.append(w)
        if used >= 8:
            out[lang] = " ".join(reversed(kept)).encode()
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, narrow) of every row, from whole texts alone.

    lang_pred is ``und`` for a null text and one without a letter, or if nothing could be learned. Ties go to the first
    language by name; ``narrow`` rejects predictions whose lead is small. A null id is not held out, repeated rows are
    repeated, other columns are ignored.
    """
    known = dictionaries(docs, ~held_out(F.col("doc_id")) if learn is None else learn)
    out = docs.select("doc_id", "text").mapInArrow(_predict(known), "doc_id bigint, lang_pred string, score double, narrow boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "narrow")
