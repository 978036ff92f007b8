"""Model response logs: envelopes, strict payloads and their validation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from proofspark import constants as K
from proofspark.functions.text import explode_rows, is_blank, let, once, trim_unicode, whole_json
from proofspark.schemas import CANDIDATE, VERDICT

BAD = "MODEL_OUTPUT_INVALID"
PROTOCOLS = ["openai_compatible", "openai_responses", "anthropic"]


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _type(v: Column, path: str) -> Column:
    """VOID for a JSON null, NULL for an absent member."""
    return F.schema_of_variant(_get(v, path, "variant"))


class _Envelope:
    """A parsed body with its inferred type. Looking up a member that isn't there is slow, so the type is asked first."""

    def __init__(self, v: Column, kind: Column, mixed: Column):
        self.v, self.kind, self.mixed = v, kind, mixed

    def get(self, path: str, kind: str = "string") -> Column:
        """A member that may be missing."""
        name = path.split(".")[-1]
        # types of mixed lists hide the names below them
        return F.when(F.contains(self.kind, F.lit(f"{name}: ")) | self.mixed, _get(self.v, path, kind))

    def type(self, path: str) -> Column:
        return F.schema_of_variant(self.get(path, "variant"))

    def absent(self, path: str) -> Column:
        return F.coalesce(self.type(path), F.lit("VOID")) == "VOID"

    def text_or_absent(self, path: str) -> Column:
        return F.coalesce(self.type(path), F.lit("VOID")).isin("VOID", "STRING")

    def tokens_ok(self, path: str) -> Column:
        return self.absent(path) | ((self.type(path) == "BIGINT") & self.get(path, "int").isNotNull())


def _part_type(p: Column) -> Column:
    return _get(p, "$.type")


def _chat(e: _Envelope) -> Column:
    choice = "$.choices[0]"
    is_text = e.type(f"{choice}.message.content") == "STRING"
    tool_calls = F.coalesce(e.type(f"{choice}.message.tool_calls"), F.lit("VOID"))
    no_calls = let(tool_calls, lambda t: (t == "VOID") | (
        t.startswith("ARRAY<") & (F.size(e.get(f"{choice}.message.tool_calls", "array<variant>")) == 0)))
    done = (
        (e.get(f"{choice}.finish_reason") == "stop") & (e.type(f"{choice}.finish_reason") == "STRING")
        & e.absent(f"{choice}.message.function_call") & no_calls
        & e.text_or_absent(f"{choice}.message.refusal")
        & is_blank(F.coalesce(e.get(f"{choice}.message.refusal"), F.lit("")))
        & e.tokens_ok("$.usage.prompt_tokens") & e.tokens_ok("$.usage.completion_tokens")
    )

    def joined(parts: Column) -> Column:
        parts_ok = F.forall(parts, lambda p: (_part_type(p) == "text") & (_type(p, "$.text") == "STRING"))
        return F.when(parts_ok, F.array_join(F.transform(parts, lambda p: _get(p, "$.text")), "\n"))

    content = F.when(is_text, e.get(f"{choice}.message.content")).otherwise(
        let(e.get(f"{choice}.message.content", "array<variant>"), joined))
    return F.struct(
        F.when(done, content).alias("content"),
        e.get("$.usage.prompt_tokens", "int").alias("prompt_tokens"),
        e.get("$.usage.completion_tokens", "int").alias("completion_tokens"),
    )


def _responses(e: _Envelope) -> Column:
    nothing = F.array().cast("array<variant>")
    # (type, status, parts) of every item, read once
    read = F.transform(F.coalesce(e.get("$.output", "array<variant>"), nothing), lambda i: F.struct(
        _part_type(i).alias("type"), _get(i, "$.status").alias("status"), F.coalesce(_get(i, "$.content", "array<variant>"), nothing).alias("parts")))

    def item_ok(item: Column) -> Column:
        message = (
            (item["status"] == "completed") & (F.size(item["parts"]) > 0)
            & F.forall(item["parts"], lambda p: (_part_type(p) == "output_text") & (_type(p, "$.text") == "STRING"))
        )
        return F.coalesce(
            F.when(item["type"] == "reasoning", item["status"].isNull() | (item["status"] == "completed"))
            .when(item["type"] == "message", message), F.lit(False))

    def said(items: Column) -> Column:
        messages = F.filter(items, lambda i: i["type"] == "message")
        text = F.array_join(
            F.flatten(F.transform(messages, lambda i: F.transform(i["parts"], lambda p: _get(p, "$.text")))), ""
        )

        def choose(text: Column, flat: Column) -> Column:
            return F.when(~is_blank(text), F.when(
                flat.isNull() | (trim_unicode(flat) == trim_unicode(text)), text)).when(F.size(messages) == 0, flat)

        flat = let(e.get("$.output_text"), lambda t: F.when(~is_blank(t), t))
        return F.when(F.forall(items, item_ok), let(text, lambda t: let(flat, lambda f: choose(t, f))))

    done = (
        (e.get("$.status") == "completed") & e.absent("$.error") & e.absent("$.incomplete_details")
        & e.text_or_absent("$.output_text")
        & e.tokens_ok("$.usage.input_tokens") & e.tokens_ok("$.usage.output_tokens")
    )
    return F.struct(
        F.when(done, let(read, said)).alias("content"),
        e.get("$.usage.input_tokens", "int").alias("prompt_tokens"),
        e.get("$.usage.output_tokens", "int").alias("completion_tokens"),
    )


def _anthropic(e: _Envelope) -> Column:
    parts = F.coalesce(e.get("$.content", "array<variant>"), F.array().cast("array<variant>"))

    def part_ok(p: Column) -> Column:
        return F.coalesce(
            ((_part_type(p) == "text") & (_type(p, "$.text") == "STRING"))
            | _part_type(p).isin("thinking", "redacted_thinking"), F.lit(False))

    def said(parts: Column) -> Column:
        texts = F.transform(F.filter(parts, lambda p: _part_type(p) == "text"), lambda p: _get(p, "$.text"))
        return F.when(F.forall(parts, part_ok), F.array_join(texts, "\n"))

    done = (e.get("$.stop_reason") == "end_turn") & e.tokens_ok("$.usage.input_tokens") & e.tokens_ok("$.usage.output_tokens")
    return F.struct(
        F.when(done, let(parts, said)).alias("content"),
        e.get("$.usage.input_tokens", "int").alias("prompt_tokens"),
        e.get("$.usage.output_tokens", "int").alias("completion_tokens"),
    )


def normalize_responses(df: DataFrame, protocol_col: str = "protocol", body_col: str = "body") -> DataFrame:
    """Replace the protocol envelope by content, prompt_tokens, completion_tokens, error_code.

    Only a normally finished answer with text counts; anything else is MODEL_OUTPUT_INVALID. Absent token counts
    stay NULL.
    """
    protocol = F.col(protocol_col)

    def opened_by(v: Column, kind: Column, mixed: Column) -> Column:
        e = _Envelope(v, kind, mixed)
        return F.when(protocol == "openai_compatible", _chat(e)).when(protocol == "openai_responses", _responses(e)).when(
            protocol == "anthropic", _anthropic(e))

    kept = [c for c in df.columns if c != body_col]
    opened = once(df, kept, _o=let(F.try_parse_json(body_col), lambda v: let(F.schema_of_variant(v), lambda kind: let(
        F.contains(kind, F.lit("VARIANT")), lambda mixed: opened_by(v, kind, mixed)))))
    good = ~is_blank(F.coalesce("_o.content", F.lit("")))
    return opened.select(
        *kept, F.when(good, F.col("_o.content")).alias("content"),
        F.when(good, F.col("_o.prompt_tokens")).alias("prompt_tokens"),
        F.when(good, F.col("_o.completion_tokens")).alias("completion_tokens"),
        F.when(~good, F.lit(BAD)).alias("error_code"),
    )


def payload_json(content: Column) -> Column:
    """The content without surrounding space and without a Markdown code fence."""
    def unfenced(trimmed: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(trimmed, r"\A(?:```json)*(?:```)*", ""), r"(?:```)*\z", "")
        return F.when(trimmed.startswith("```"), trim_unicode(bare)).otherwise(trimmed)

    # most contents are a bare object, which two bytes tell
    bare_object = content.startswith("{") & content.endswith("}")
    return F.when(bare_object, content).otherwise(let(trim_unicode(content), unfenced))


def _members(required: dict[str, str], optional: dict[str, str]) -> str:
    """Regex for the inferred JSON type of an object: known members only, required ones present, types exact."""
    fields = []
    for name in sorted([*required, *optional]):
        kind = required.get(name) or optional[name]
        member = f"(?:{name}: (?:{kind})(?:, |>))"
        fields.append(member if name in required else member + "?")
    return "OBJECT<" + "".join(fields)


TEXTS = "ARRAY<STRING>|ARRAY<VOID>"
CANDIDATE_REQUIRED = {"category": "STRING", "quote": "STRING", "reason": "STRING", "suggestion": "STRING", "confidence": "BIGINT"}
CANDIDATE_TYPE = _members(
    CANDIDATE_REQUIRED,
    {"grammar_subtype": "STRING|VOID", "context_before": "STRING|VOID", "context_after": "STRING|VOID",
     "evidence_source_ids": TEXTS},
)
VERDICT_REQUIRED = {"candidate_index": "BIGINT", "verdict": "STRING", "confidence": "BIGINT"}
VERDICT_TYPE = _members(
    VERDICT_REQUIRED,
    {"category": "STRING|VOID", "grammar_subtype": "STRING|VOID", "reason": "STRING", "suggestion": "STRING",
     "evidence_source_ids": TEXTS},
)


def _parse(df: DataFrame, member: str, struct: str, object_type: str, required: dict[str, str], element_ok, fill) -> DataFrame:
    """``member`` of the one JSON object that a content is, or error_code; judged in one step, where every value is computed once.

    The merged type of all elements settles nearly all responses: if it has known members only and no element lacks a value of
    those it must have, each element has its exact type. Any other response is judged by the types of its elements.
    """
    kept = [c for c in df.columns if c != "content"]
    merged = rf"\AARRAY<OBJECT<{member}: ARRAY<(?:{object_type}|VOID)>>>\z"
    ids = "evidence_source_ids"

    def one_by_one(j: Column) -> Column:
        def typed(v: Column) -> Column:
            items = F.try_variant_get(v, f"$.{member}", "array<variant>")
            only = F.regexp_like(F.schema_of_variant(v), F.lit(rf"\AOBJECT<{member}: ARRAY<")) & (F.size(F.json_object_keys(j)) == 1)
            return only & F.forall(items, lambda i: F.regexp_like(F.schema_of_variant(i), F.lit(rf"\A{object_type}\z")))

        return let(whole_json(j), typed)

    def all_typed(o: Column, kind: Column) -> Column:
        def filled(x: Column) -> Column:
            return functools.reduce(Column.__and__, [x[name].isNotNull() for name in required])

        # a NULL list of ids has another type than none
        listed = ~F.contains(kind, F.lit(f"{ids}: ")) | F.forall(o["x"], lambda x: x[ids].isNotNull())
        # counts the values; no object is a boolean, so none is copied
        alone = F.size(F.try_variant_get(o["v"], "$", "array<boolean>")) == 1
        return F.regexp_like(kind, F.lit(merged)) & alone & F.forall(o["x"], filled) & listed

    def judged(o: Column) -> Column:
        typed = let(F.schema_of_variant(o["v"]), lambda kind: F.when(all_typed(o, kind), F.lit(True)).otherwise(one_by_one(o["j"])))
        good = F.coalesce(typed & F.forall(o["x"], element_ok), F.lit(False))
        return let(good, lambda ok: F.struct(F.when(ok, F.transform(o["x"], fill)).alias("x"), F.when(~ok, F.lit(BAD)).alias("error_code")))

    def opened(j: Column, v: Column) -> Column:
        x = F.from_json(j, f"struct<{member}:array<{struct}>>", {"mode": "PERMISSIVE"})[member]
        none = F.struct(F.lit(None).cast(f"array<{struct}>").alias("x"), F.lit(BAD).alias("error_code"))
        return F.when(v.isNull(), none).otherwise(let(F.struct(j.alias("j"), v.alias("v"), x.alias("x")), judged))

    def read(j: Column) -> Column:
        return let(F.try_parse_json(F.concat(F.lit("["), j, F.lit("]"))), lambda v: opened(j, v))

    return once(df, kept, _r=let(payload_json(F.col("content")), read)).select(
        *kept, F.col("_r.x").alias(member), F.col("_r.error_code").alias("error_code"))


def _ids_present(x: Column) -> Column:
    return F.coalesce(F.forall(x["evidence_source_ids"], lambda i: i.isNotNull()), F.lit(True))


def _with_ids(x: Column) -> Column:
    return x.withField("evidence_source_ids", F.coalesce(x["evidence_source_ids"], F.array().cast("array<string>")))


def _candidate_ok(c: Column) -> Column:
    return (
        c["category"].isin(K.CATEGORIES) & (c["grammar_subtype"].isNull() | c["grammar_subtype"].isin(K.GRAMMAR_SUBTYPES))
        & c["confidence"].between(0, 255) & _ids_present(c)
    )


def _verdict_ok(v: Column) -> Column:
    return (
        (v["category"].isNull() | v["category"].isin(K.CATEGORIES))
        & (v["grammar_subtype"].isNull() | v["grammar_subtype"].isin(K.GRAMMAR_SUBTYPES))
        & v["verdict"].isin(K.VERDICTS) & v["confidence"].between(0, 255) & (v["candidate_index"] >= 0) & _ids_present(v)
    )


def _stored_list(output: Column, struct: str, object_type: str, element_ok) -> Column:
    """Whether a stored output is a bare list whose members all have the exact type."""
    parsed = whole_json(output)
    items = F.try_variant_get(parsed, "$", "array<variant>")
    typed = F.schema_of_variant(parsed).startswith("ARRAY<") & F.forall(items, lambda i: F.regexp_like(F.schema_of_variant(i), F.lit(rf"\A{object_type}\z")))
    return F.coalesce(typed & F.forall(F.from_json(output, f"array<{struct}>", {"mode": "PERMISSIVE"}), element_ok), F.lit(False))


def stored_candidates_ok(output: Column) -> Column:
    return _stored_list(output, CANDIDATE, CANDIDATE_TYPE, _candidate_ok)


def stored_verdicts_ok(output: Column) -> Column:
    return _stored_list(output, VERDICT, VERDICT_TYPE, _verdict_ok)


def parse_candidates(df: DataFrame) -> DataFrame:
    """``issues`` (array of candidates) from ``content``, or error_code; unknown members are refused."""
    return _parse(df, "issues", CANDIDATE, CANDIDATE_TYPE, CANDIDATE_REQUIRED, _candidate_ok, _with_ids)


def parse_verdicts(df: DataFrame) -> DataFrame:
    """``verdicts`` (array of verdicts) from ``content``, or error_code."""
    def fill(v: Column) -> Column:
        return _with_ids(v).withField("reason", F.coalesce(v["reason"], F.lit(""))).withField(
            "suggestion", F.coalesce(v["suggestion"], F.lit("")))

    return _parse(df, "verdicts", VERDICT, VERDICT_TYPE, VERDICT_REQUIRED, _verdict_ok, fill)


def _ids_ok(ids: Column) -> Column:
    return (F.size(ids) <= 16) & F.forall(ids, lambda i: F.length(i) <= 80)


def candidates_valid(issues: Column) -> Column:
    """One bad issue spoils the whole response."""
    def ok(c: Column) -> Column:
        def at_most(name: str, size: int) -> Column:
            return F.coalesce(F.length(c[name]), F.lit(0)) <= size

        return (
            ((c["category"] == "grammar") == c["grammar_subtype"].isNotNull())
            & F.length(c["quote"]).between(1, 4_000) & at_most("reason", 2_000) & at_most("suggestion", 2_000)
            & at_most("context_before", 500) & at_most("context_after", 500)
            & (c["confidence"] <= 100) & _ids_ok(c["evidence_source_ids"])
        )

    return (F.size(issues) <= K.MAX_CANDIDATES_PER_CHUNK) & F.forall(issues, ok)


def verdicts_valid(verdicts: Column, candidate_count: Column) -> Column:
    """Every candidate is answered once, within the field limits."""
    def ok(v: Column) -> Column:
        classed = F.when(v["category"].isNull(), v["grammar_subtype"].isNull()).otherwise(
            (v["category"] == "grammar") == v["grammar_subtype"].isNotNull())
        said = (v["verdict"] == "rejected") | (~is_blank(v["reason"]) & ~is_blank(v["suggestion"]))
        return (
            (v["candidate_index"] < candidate_count) & (v["confidence"] <= 100)
            & (F.length(v["reason"]) <= 2_000) & (F.length(v["suggestion"]) <= 2_000)
            & said & classed & _ids_ok(v["evidence_source_ids"])
        )

    indexes = F.transform(verdicts, lambda v: v["candidate_index"])
    return (
        (F.size(verdicts) == candidate_count) & (F.size(F.array_distinct(indexes)) == F.size(verdicts))
        & F.forall(verdicts, ok)
    )


def _checked(df: DataFrame, valid: Column) -> DataFrame:
    kept = [c for c in df.columns if c != "error_code"]
    return once(df, kept, error_code=F.coalesce("error_code", F.when(~F.coalesce(valid, F.lit(False)), F.lit(BAD))))


def check_candidates(df: DataFrame) -> DataFrame:
    """The parsed responses with error_code set where a field limit is broken."""
    return _checked(df, candidates_valid(F.col("issues")))


def check_verdicts(df: DataFrame) -> DataFrame:
    """Expects ``candidate_count``, the number of candidates sent."""
    return _checked(df, verdicts_valid(F.col("verdicts"), F.col("candidate_count")))


def split_checked(checked: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    bad = checked.where(F.col("error_code").isNotNull()).select(F.lit(stage).alias("stage"), "doc_id", "chunk_index", "error_code")
    return checked.where(F.col("error_code").isNull()).drop("error_code"), bad


def validate_candidates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good responses, rejects); store the checked responses first when both sides are used."""
    return split_checked(check_candidates(df), "candidates")


def validate_verdicts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_checked(check_verdicts(df), "verdicts")


def flatten_payload(df: DataFrame, array: str) -> DataFrame:
    """One row per candidate or verdict; a candidate's position is its candidate_index."""
    kept = [c for c in df.columns if c != array]
    rows = explode_rows(df, F.col(array), "at", "x", kept)
    fields = [f.name for f in df.schema[array].dataType.elementType.fields]
    index = [] if "candidate_index" in fields else [F.col("at").alias("candidate_index")]
    return rows.select(*kept, *index, *[F.col(f"x.{f}").alias(f) for f in fields])
