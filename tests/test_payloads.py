import json

from pyspark.sql import functions as F

from proofspark.operators import payloads as P, requests as R
from proofspark.operators.resolve import fail_documents, remap_verdicts


def normalized(spark, protocol, *bodies):
    df = spark.createDataFrame([(i, protocol, json.dumps(b) if not isinstance(b, str) else b) for i, b in enumerate(bodies)],
                               "i int, protocol string, body string")
    return [(r.content, r.prompt_tokens, r.error_code) for r in P.normalize_responses(df).orderBy("i").collect()]


BAD = (None, None, "MODEL_OUTPUT_INVALID")


def chat(content="ok", reason="stop", usage=None, **message):
    return {"choices": [{"message": {"content": content, **message}, "finish_reason": reason}], "usage": usage}


def test_chat_envelope(spark):
    got = normalized(
        spark, "openai_compatible", chat(usage={"prompt_tokens": 5}), chat(reason="length"), chat(tool_calls=[]), chat(tool_calls=[{"id": 1}]),
        chat(refusal=" "), chat(refusal="no"), chat(function_call={"name": "f"}), chat([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]),
        chat([{"type": "refusal", "text": "a"}]), chat(" "), {"choices": []}, "{", chat(5))
    assert got == [("ok", 5, None), BAD, ("ok", None, None), BAD, ("ok", None, None), BAD, BAD, ("a\nb", None, None), BAD, BAD, BAD, BAD, BAD]


def responses(items, status="completed", **more):
    return {"status": status, "output": items, **more}


def message(*texts, status="completed", kind="output_text"):
    return {"type": "message", "status": status, "content": [{"type": kind, "text": t} for t in texts]}


def test_responses_envelope(spark):
    got = normalized(
        spark, "openai_responses", responses([{"type": "reasoning"}, message("a", "b")]), responses([message("a")], "incomplete"),
        responses([message("a")], error={"x": 1}), responses([message("a", status="in_progress")]), responses([message("a", kind="refusal")]),
        responses([message("a")], output_text=" a "), responses([message("a")], output_text="b"), responses([], output_text="flat"),
        responses([{"type": "function_call"}]), responses([message()]), responses([message(" ")], output_text="x"))
    assert got == [("ab", None, None), BAD, BAD, BAD, BAD, ("a", None, None), BAD, ("flat", None, None), BAD, BAD, BAD]


def test_anthropic_envelope(spark):
    def body(parts, stop="end_turn"):
        return {"stop_reason": stop, "content": parts, "usage": {"input_tokens": 3, "output_tokens": None}}

    t = {"type": "text", "text": "a"}
    got = normalized(spark, "anthropic", body([{"type": "thinking"}, t, t]), body([t], "max_tokens"), body([{"type": "tool_use"}]), body([]))
    assert got == [("a\na", 3, None), BAD, BAD, BAD]


ISSUE = {"category": "typo", "quote": "q", "reason": "r", "suggestion": "s", "confidence": 90}


def candidate_errors(spark, *contents):
    df = spark.createDataFrame([(i, 0, c if isinstance(c, str) else json.dumps(c)) for i, c in enumerate(contents)],
                               "doc_id long, chunk_index int, content string")
    return [r.error_code is None for r in P.check_candidates(P.parse_candidates(df)).orderBy("doc_id").collect()]


def test_candidate_payloads(spark):
    def one(**over):
        return {"issues": [{**ISSUE, **over}]}

    good = [{"issues": []}, one(), "```json\n" + json.dumps(one()) + "\n```", "```\n" + json.dumps(one()) + "```",
            one(category="grammar", grammar_subtype="collocation"), one(context_before=None, evidence_source_ids=["a"] * 16), {"issues": [ISSUE] * 200}]
    bad = ["nope", {"issues": [], "x": 1}, one(extra=1), one(confidence="90"), one(confidence=101), one(quote=""), one(quote="q" * 4001),
           one(category="style"), one(category="grammar"), one(grammar_subtype="collocation"), one(context_after="c" * 501),
           one(evidence_source_ids=["a"] * 17), one(evidence_source_ids=["a" * 81]), {"issues": [ISSUE] * 201}, {"issues": [ISSUE, {**ISSUE, "reason": 3}]},
           one(confidence=90.5), {"issue": []}, {"issues": None}]
    assert candidate_errors(spark, *good) == [True] * len(good)
    assert candidate_errors(spark, *bad) == [False] * len(bad)


def test_elements_are_judged_one_by_one_where_their_merged_type_hides_something(spark):
    with_ids, without = {**ISSUE, "evidence_source_ids": ["a"]}, ISSUE
    lists = [([with_ids, without], True), ([with_ids, {**ISSUE, "evidence_source_ids": None}], False), ([with_ids, {**ISSUE, "evidence_source_ids": []}], True),
             ([{**ISSUE, "quote": None}, ISSUE], False), ([ISSUE, {k: v for k, v in ISSUE.items() if k != "reason"}], False), ([ISSUE, {**ISSUE, "confidence": 90.0}], False),
             ([ISSUE, {**ISSUE, "confidence": 10 ** 10}], False), ([ISSUE, None], False), ([None], False), ([ISSUE, {**ISSUE, "context_before": None}], True), ([ISSUE, 5], False)]
    assert candidate_errors(spark, *[{"issues": x} for x, _ in lists]) == [ok for _, ok in lists]
    one = json.dumps({"issues": [ISSUE]})
    behind = [(" ", True), (", null", False), (", " + one, False), (" x", False)]
    assert candidate_errors(spark, *[one + tail for tail, _ in behind]) == [ok for _, ok in behind]


def test_lists_of_mixed_values_hide_nothing(spark):
    """The inferred type of a mixed list names no member, but they are looked up all the same."""
    def mixed(**message):
        return {"choices": [*chat(**message)["choices"], 5]}

    got = normalized(spark, "openai_compatible", mixed(), mixed(function_call={"name": "f"}), mixed(refusal="no"), mixed(content="usage: 7, function_call: STRING"))
    assert got == [("ok", None, None), BAD, BAD, ("usage: 7, function_call: STRING", None, None)]


def test_a_merged_type_spares_the_types_of_elements(spark):
    """A row's variant is typed once, not once for each element and each step that reads it."""
    df = spark.createDataFrame([(1, 0, json.dumps({"issues": [ISSUE] * 3}))], "doc_id long, chunk_index int, content string")
    plan = P.parse_candidates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and P.parse_candidates(df).first().issues[2].quote == "q"


def test_verdict_payloads(spark):
    v = {"candidate_index": 0, "verdict": "confirmed", "confidence": 90, "reason": "r", "suggestion": "s"}
    cases = [([v], 1, True), ([v], 2, False), ([v, v], 2, False), ([{**v, "candidate_index": 1}], 1, False), ([{**v, "reason": " "}], 1, False),
             ([{**v, "verdict": "rejected", "reason": ""}], 1, True), ([{"candidate_index": 0, "verdict": "rejected", "confidence": 1}], 1, True),
             ([{**v, "category": "grammar"}], 1, False), ([{**v, "category": "grammar", "grammar_subtype": "collocation"}], 1, True),
             ([{**v, "grammar_subtype": "collocation"}], 1, False), ([{**v, "verdict": "maybe"}], 1, False), ([], 0, True)]
    df = spark.createDataFrame([(i, 0, n, json.dumps({"verdicts": x})) for i, (x, n, _) in enumerate(cases)],
                               "doc_id long, chunk_index int, candidate_count int, content string")
    got = [r.error_code is None for r in P.check_verdicts(P.parse_verdicts(df)).orderBy("doc_id").collect()]
    assert got == [ok for _, _, ok in cases]


def test_failed_chunk_fails_its_document(spark):
    resolved = spark.createDataFrame([(1, 0, 2), (1, 0, 5), (2, 0, 0)], "doc_id long, chunk_index int, candidate_index int")
    verdicts = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, 7), (2, 0, 0)], "doc_id long, chunk_index int, candidate_index int")
    good, bad = remap_verdicts(verdicts, resolved)
    assert sorted(r.candidate_index for r in good.collect()) == [2, 5]
    assert [(r.doc_id, r.error_code) for r in bad.collect()] == [(2, "MODEL_OUTPUT_INVALID")]
    assert {r.doc_id for r in fail_documents(resolved, bad).collect()} == {1}


def test_verdicts_meet_their_chunk_in_one_exchange(spark):
    """Both results come from one join by chunk; rows without a key are kept, as nothing tells that their chunk is spoilt."""
    kind = "doc_id long, chunk_index int, candidate_index int"
    resolved = spark.createDataFrame([(1, 0, 4), (1, 0, 2), (2, 0, 0), (3, 1, 9), (None, 0, 1)], kind)
    verdicts = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, 1), (2, 0, 0), (3, 0, 0), (3, 1, 0), (None, 0, 0), (1, None, 0), (4, 0, None)], kind)
    good, bad = remap_verdicts(verdicts, resolved)
    assert sorted(map(repr, (tuple(r) for r in good.collect()))) == sorted(map(repr, [(1, 0, 2), (1, 0, 4), (3, 1, 9), (None, 0, None), (1, None, None)]))
    assert sorted(repr((r.doc_id, r.chunk_index)) for r in bad.collect()) == sorted(map(repr, [(2, 0), (3, 0), (None, 0), (1, None), (4, 0)]))
    for side in (good, bad):
        plan = side._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 2


def test_registered_pass(spark):
    def echo(batches):
        for b in batches:
            yield b.assign(content=b["user_prompt"].str.len().astype(str))[["doc_id", "chunk_index", "content"]]

    R.register_pass("echo", echo)
    requests = spark.createDataFrame([(1, 0, "abc")], "doc_id long, chunk_index int, user_prompt string")
    assert R.run_pass("echo", requests, 2).collect()[0].content == "3"


def test_reference_flag_without_scope(spark):
    assert R.reference_flag(spark.range(1), None).first().reference_profile is False
    assert spark.range(1).select(R.json_string(F.lit('a"\n')).alias("j")).first().j == '"a\\"\\n"'
