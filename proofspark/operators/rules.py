"""Rule candidates: the rule table stands in for the first model pass."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, functions as F

from proofspark.functions.locate import occurrence_starts
from proofspark.functions.text import let, slice_text
from proofspark.schemas import CANDIDATE, RULES
from proofspark.session import opened, scratch_dir

_RULE_FIELDS = ",".join(part.strip().replace(" ", ":", 1) for part in RULES.split(","))
FIELDS = [
    "category", "grammar_subtype", "quote", "context_before", "context_after", "reason", "suggestion",
    "confidence", "evidence_source_ids",
]
#: Rules that a plan may hold as constants; more of them are searched by automata, of so many characters of rules each.
FEW, AUTOMATON_CHARS = 32, 1 << 24


def scan_rules(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``candidates``: the issue template of every rule whose needle occurs in the chunk, in rule order.

    The rules are checked inside the chunk row, without any shuffle: a few by an expression, any number of them by one
    pass over the text.
    """
    few = _few(rules)
    if few is None:
        return scan_many(chunks, rules, every_occurrence=False)
    found = let(F.col("text"), lambda text: F.transform(
        F.filter(_constant(few), lambda r: F.contains(text, r["needle"])),
        lambda r: F.struct(*[r[name].alias(name) for name in FIELDS]),
    ))
    return chunks.withColumn("candidates", found)


def scan_occurrences(chunks: DataFrame, rules: DataFrame, context: int = 12) -> DataFrame:
    """Add ``candidates``: one per occurrence of each needle, with up to ``context`` characters on both sides.

    Takes any number of rules; one chunk bounds the number of occurrences of each.
    """
    few = _few(rules)
    if few is None:
        return scan_many(chunks, rules, every_occurrence=True, context=context)

    def expand(text: Column, rule: Column) -> Column:
        size = F.length(rule["needle"])

        def at(start: Column) -> Column:
            sides = {
                "context_before": slice_text(text, F.greatest(start - context, F.lit(0)), start),
                "context_after": slice_text(text, start + size, start + size + context),
            }
            return F.struct(*[sides.get(name, rule[name]).alias(name) for name in FIELDS])

        return F.transform(occurrence_starts(text, rule["needle"]), at)

    return chunks.withColumn("candidates", let(F.col("text"), lambda text: F.flatten(F.transform(
        F.filter(_constant(few), lambda r: F.contains(text, r["needle"])), lambda r: expand(text, r)
    ))))


def _few(rules: DataFrame) -> list[Row] | None:
    """All rules in order if there are few, else nothing; no more than ``FEW`` + 1 rows come here."""
    rows = rules.orderBy("rule_no").limit(FEW + 1).collect()
    return rows if len(rows) <= FEW else None


def _constant(rows: list[Row]) -> Column:
    return F.from_json(F.lit(json.dumps([row.asDict() for row in rows])), f"array<struct<{_RULE_FIELDS}>>")


def scan_many(chunks: DataFrame, rules: DataFrame, every_occurrence: bool, context: int = 12, most: int = AUTOMATON_CHARS) -> DataFrame:
    """``candidates`` by multi-pattern automata: a pass over each chunk finds all needles of a lot, whatever their number.

    Rules are taken in their order, in lots of at most ``most`` characters (or one rule), each a file below the shared
    folder. A task holds one compiled lot: with several, it takes a batch of texts through one after the other, and the
    candidates of later lots stand behind those of earlier ones. Only the texts go to Python, the other columns stay where
    they are. A null needle never occurs, an empty one everywhere; a null text has no candidates.
    """
    folder = scratch_dir(chunks.sparkSession, "rule-lots")
    lots = 0
    for lot in _lots(rules, most):
        _store_lot(lot, folder, lots)
        lots += 1
    if not lots:
        return chunks.withColumn("candidates", F.array().cast(f"array<{CANDIDATE}>"))
    return chunks.withColumn("candidates", _automata(folder, lots, every_occurrence, context)("text"))


def _lots(rules: DataFrame, most: int) -> Iterator[list[tuple]]:
    lot, held = [], 0
    for row in rules.orderBy("rule_no").toLocalIterator():
        size = sum(len(x) for x in row if isinstance(x, str))
        if lot and held + size > most:
            yield lot
            lot, held = [], 0
        lot.append((row["needle"], *[row[name] for name in FIELDS]))
        held += size
    if lot:
        yield lot


def _store_lot(lot: list[tuple], folder: str, number: int) -> None:
    types = {"confidence": pa.int32(), "evidence_source_ids": pa.list_(pa.string())}
    names = ["needle", *FIELDS]
    table = pa.table([pa.array([rule[k] for rule in lot], types.get(name, pa.string())) for k, name in enumerate(names)], names)
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{number}.arrow") as out, pa.ipc.new_file(out, table.schema) as file:
        file.write_table(table)


#: Texts that are searched before their candidates become Arrow rows.
TEXTS_AT_ONCE = 256


def _automata(folder: str, lots: int, every: bool, context: int):
    held: dict = {}

    def compiled(number: int):
        if number not in held:
            import ahocorasick

            held.clear()
            store, root = opened(folder)
            with store.open_input_file(f"{root}/{number}.arrow") as file:
                table = pa.ipc.open_file(file).read_all().combine_chunks()
            search, first, others = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}, {}
            for n, word in enumerate(table.column("needle").to_pylist()):
                if word is not None and first.setdefault(word, n) != n:
                    others.setdefault(first[word], [first[word]]).append(n)
            anywhere = first.pop("", None)
            for word, n in first.items():
                search.add_word(word, n)
            search.make_automaton()
            sizes = pc.fill_null(pc.utf8_length(table.column("needle")), 0).to_pylist()
            templates = [table.column(f).combine_chunks() for f in FIELDS]
            held[number] = search if len(search) else None, [] if anywhere is None else others.get(anywhere, [anywhere]), others, sizes, templates
        return held[number]

    def look(texts: list[str | None], number: int) -> tuple[list[int], list[pa.Array]]:
        """How many candidates each text has, their rules, and what stands before and after them."""
        search, anywhere, others, sizes, _ = compiled(number)
        counts, chosen, before, after = [], [], [], []
        for text in texts:
            text = text or ""
            hits = [(n, 0 if not every else end + 1 - sizes[n]) for end, found in (search.iter(text) if search else ()) for n in others.get(found, (found,))]
            hits += [(n, at) for n in anywhere for at in (range(max(1, len(text))) if every else (0,))] if text else []
            hits = sorted(hits if every else set(hits))
            chosen += [n for n, _ in hits]
            if every:
                before += [text[max(0, at - context) : at] for _, at in hits]
                after += [text[at + sizes[n] : at + sizes[n] + context] for n, at in hits]
            counts.append(len(hits))
        return counts, [pa.array(chosen, pa.int32()), pa.array(before, pa.string()), pa.array(after, pa.string())]

    def candidates(parts: list[list[pa.Array]], number: int) -> pa.StructArray:
        chosen, before, after = (pa.concat_arrays(kind) for kind in zip(*parts))
        sides = {"context_before": before, "context_after": after} if every else {}
        return pa.StructArray.from_arrays([sides[f] if f in sides else t.take(chosen) for f, t in zip(FIELDS, compiled(number)[4])], FIELDS)

    @F.arrow_udf(f"array<{CANDIDATE}>")
    def scan(texts: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()  # what the batch before has freed
        parts = [texts.slice(at, TEXTS_AT_ONCE) for at in range(0, max(1, len(texts)), TEXTS_AT_ONCE)]
        counts, rows = np.zeros((lots, len(texts)), np.int64), [None] * lots
        for number in range(lots) if 0 in held or not held else range(lots - 1, -1, -1):  # begin with the lot that is compiled
            found = [look(part.to_pylist(), number) for part in parts]
            counts[number] = [n for some, _ in found for n in some]
            rows[number] = candidates([arrays for _, arrays in found], number)
        if lots > 1:
            owner = np.concatenate([np.repeat(np.arange(len(texts)), c) for c in counts])
            rows = [pa.concat_arrays(rows).take(pa.array(np.argsort(owner, kind="stable")))]
        ends = np.concatenate([[0], np.cumsum(counts.sum(0))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows[0])

    return scan


def attach_candidates(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Nest flat candidate rows below their chunk, ordered by candidate_index."""
    nested = candidates.groupBy("doc_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("candidate_index", F.struct(*FIELDS).cast(CANDIDATE).alias("c")))).alias("n")
    ).select("doc_id", "chunk_index", F.transform("n", lambda x: x["c"]).alias("candidates"))
    return chunks.join(nested, ["doc_id", "chunk_index"], "left").withColumn(
        "candidates", F.coalesce("candidates", F.array().cast(f"array<{CANDIDATE}>"))
    )
