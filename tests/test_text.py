import itertools
import random
import re

from pyspark.sql import functions as F

from proofspark.functions import labels as L
from proofspark.functions.edits import localize_edit
from proofspark.functions.locate import locate_unique, occurrence_starts
from proofspark.functions.spans import dollar_math_spans, is_protected, protected_spans
from proofspark.functions.text import is_blank, normalize_suggestion, safe_filename, trim_unicode
from proofspark.operators.chunk import chunk, paragraphs
from proofspark.operators.dedup import dedup_issues
from proofspark.operators.finalize import finalize
from proofspark.operators.resolve import resolve_candidates
from proofspark.operators.rules import attach_candidates, scan_rules
from proofspark.operators.segment import assemble_text, build_segments, locate
from proofspark.plans import fixtures as X
from proofspark.schemas import CANDIDATE, RULES


def rows(df):
    return [tuple(r) for r in df.collect()]


def plain_chunks(text, target=3000, hard=4000, overlap=500):
    """Straightforward chunker over a Python string."""
    spans, at = [], 0
    for gap in re.finditer(r"\n{2,}", text):
        if gap.start() > at:
            spans.append((at, gap.start()))
        at = gap.end()
    if at < len(text):
        spans.append((at, len(text)))
    out, current, previous = [], None, None

    def keep(s, e, cs, ce):
        if text[s:e].strip():
            out.append((s, e, cs, ce))

    for s, e in spans:
        if e - s > hard:
            if current:
                keep(*current)
                current = None
            at = core = s
            while True:
                end = min(at + hard, e)
                if end < e:
                    last = max(text[at + hard - overlap:end].rfind(c) for c in "。！？!?；;")
                    end = end if last < 0 else at + hard - overlap + last + 1
                following = end if end >= e else max(end - overlap, at + 1)
                middle = following + (end - following) // 2
                keep(at, end, core, middle)
                if end >= e:
                    break
                at, core = following, middle
        elif current and e - current[0] > target:
            keep(*current)
            lead = previous[1] - previous[0] <= overlap and e - previous[0] <= hard
            current = [previous[0] if lead else s, e, s, e]
        elif current:
            current[1] = current[3] = e
        else:
            current = [s, e, s, e]
        previous = (s, e)
    if current:
        keep(*current)
    return out


def test_chunker_against_plain_python(spark):
    random.seed(3)
    parts = ["字" * 700, "\n", "\n\n", "。", "！", "  　", "b" * 4700, "\n\n\n", "🧪", "c" * 300]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(200)]
    texts += ["中" * 1600 + "\n\n" + "中" * 1600 + "\n\n" + "中" * 1600, "中" * 4200 + "。后文"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk(docs).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, (r.source_start, r.source_end, r.core_start, r.core_end), r.text))
    for i, text in enumerate(texts):
        want = plain_chunks(text)
        mine = sorted(got.get(i, []))
        assert [m[1] for m in mine] == want
        assert [m[0] for m in mine] == list(range(len(want)))
        assert all(m[2] == text[m[1][0]:m[1][1]] for m in mine)


def test_chunk_limits_as_parameters(spark):
    random.seed(4)
    texts = ["".join(random.choice(["ab。", "\n\n", "x" * 25, "\n", "yz"]) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk(docs, 30, 40, 10).collect():
        got.setdefault(r.doc_id, []).append((r.source_start, r.source_end, r.core_start, r.core_end))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_chunks(text, 30, 40, 10)


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a\n\n\nb\nc\n\n"), (2, "\n\n\n"), (3, "")], "doc_id long, text string")
    assert sorted(rows(paragraphs(docs))) == [(1, 0, 0, 1), (1, 1, 4, 7), (2, 0, 0, 3)]


def candidates(spark, items):
    full = [dict({"grammar_subtype": None, "context_before": None, "context_after": None, "reason": "r", "suggestion": "s",
                  "confidence": 90, "evidence_source_ids": []}, **i) for i in items]
    return spark.createDataFrame([(f,) for f in full], f"c {CANDIDATE}")


def test_hits_around_a_chunk_border_are_owned_once(spark):
    """One paragraph in three chunks: a needle moved over both core borders is found in exactly one of them."""
    needle, size = "needle", 9000
    filler = "".join(chr(0x4E00 + k % 977) for k in range(size))
    cores = plain_chunks(filler)
    places = [border + shift for _, _, _, border in cores[:-1] for shift in range(-len(needle) - 1, 3)]
    docs = [(p, "general", filler[:p] + needle + filler[p + len(needle):]) for p in places]
    rules = spark.createDataFrame([(1, needle, "grammar", "collocation", needle, None, None, "r", "s", 90, [])], RULES)
    df = spark.createDataFrame(docs, "doc_id long, analysis_profile string, text string")
    got = resolve_candidates(scan_rules(chunk(df), rules)).collect()
    assert sorted((r.doc_id, r.char_start, r.char_end) for r in got) == [(p, p, p + len(needle)) for p in sorted(places)]


def test_locating_random_texts(spark):
    random.seed(8)
    items = []
    for i in range(400):
        text = "".join(random.choice("ab🧪\\") for _ in range(random.randint(1, 20)))
        s = random.randint(0, len(text) - 1)
        e = min(len(text), s + random.randint(1, 3))
        items.append((i, text, text[s:e], text[max(0, s - 2):s] if i % 2 else None, text[e:e + 1] if i % 3 else None))
    df = spark.createDataFrame(items, "i int, t string, q string, b string, a string")
    got = {r.i: (r.s, r.o) for r in df.select(
        "i", locate_unique(*[F.col(c) for c in "tqba"]).alias("s"), occurrence_starts(F.col("t"), F.col("q")).alias("o")).collect()}
    for i, t, q, b, a in items:
        starts = [k for k in range(len(t)) if t.startswith(q, k)]
        fits = [k for k in starts if t[:k].endswith(b or "") and t[k + len(q):].startswith(a or "")]
        want = starts[0] if len(starts) == 1 else fits[0] if len(fits) == 1 else None
        assert got[i] == (want, starts), items[i]


def protected(spark, cases):
    """cases: (text, quote, profile, category)."""
    df = spark.createDataFrame([(t, q, t.index(q), p, c) for t, q, p, c in cases], "t string, q string, s int, p string, c string")
    spans = protected_spans(F.col("t"), F.col("p"))
    return [r[0] for r in df.select(is_protected(spans, F.col("s"), F.col("s") + F.length("q"), F.col("c"))).collect()]


SCENES = ("general", "academic", "financial")
CLASSES = ("typo", "punctuation", "grammar")
#: kind: (what stands before the token, the token, what stands behind it, the scene in which it is shielded)
KINDS = {
    "link": ("https://host{n}.test/", "p{n}q", "?k={n}", None), "code": ("`", "let v{n}", " = 0`", None), "dollars": ("$", "u_{n}-w", "$", None),
    "display": ("$$\n", "u_{n}-w", "\n$$", None), "latex": ("\\(", "u_{n}-w", "\\)", None), "number mark": ("[", "{n}", "]", "academic"),
    "range mark": ("[", "{n}-9{n}", "]", "academic"), "doi": ("", "10.5{n}17/z{n}", "", "academic"), "percent": ("", "{n}.25%", "", "financial"),
    "date": ("", "2031-0{n}-17", "", "financial"),
}
NEIGHBOURS = [("早间消息", "，随后继续"), ("附注：", "。下文另述"), ("", "；收尾"), ("（见", "）")]


def test_fragments_are_shielded_in_their_scene_and_words_beside_them_are_free(spark):
    """Every kind of fragment between every pair of neighbours: the token by kind and scene, the words next to it never."""
    cases, want = [], []
    for (kind, (before, token, behind, scene)), (left, right), profile, category in itertools.product(KINDS.items(), NEIGHBOURS, SCENES, CLASSES):
        n = len(kind) % 7 + 2
        fragment = (before + token + behind).replace("{n}", str(n))
        text, inner = f"{left}晨雾 {fragment} {right}渔火", token.replace("{n}", str(n))
        for quote, shielded in ((inner, scene in (None, profile)), ("晨雾", False), ("渔火", False)):
            cases.append((text, quote, profile, category))
            want.append(shielded)
    got = protected(spark, cases)
    assert [c for c, g, w in zip(cases, got, want) if g != w] == []
    assert {True, False} == set(got)


def test_dollar_spans_are_closed_and_tidy(spark):
    """Properties of what is found in random texts, and formulas whose places are known from how the text was built."""
    random.seed(11)
    texts = ["".join(random.choice(["$", "$", "\\", "x", " ", "1", "中", "，", "\n"]) for _ in range(random.randint(1, 18))) for _ in range(600)]
    built, known = [], []
    for k in range(60):
        text, spans = "", []
        for part in random.choices(["word", "formula", "display", "escaped"], k=5):
            if part == "formula" or part == "display":
                body = f"$a_{k}+b$" if part == "formula" else f"$$a_{k}+b$$"
                spans.append((len(text) + 1, len(text) + 1 + len(body)))
                text += f"值{body}。"
            else:
                text += "文字。" if part == "word" else "\\$记号。"
        built.append(text)
        known.append(spans)
    df = spark.createDataFrame(list(enumerate(texts + built)), "i int, t string")
    found = {r.i: [(x.start, x.end) for x in r.s] for r in df.select("i", dollar_math_spans(F.col("t")).alias("s")).collect()}
    assert [found[len(texts) + k] for k in range(len(built))] == known
    for i, text in enumerate(texts):
        end = 0
        for s, e in found[i]:
            piece = text[s:e]
            width = 2 if piece.startswith("$$") and piece.endswith("$$") and len(piece) > 4 else 1
            body = piece[width:-width]
            assert s >= end and piece[:width] == piece[-width:] == "$" * width and body.strip()
            assert (len(text[:s]) - len(text[:s].rstrip("\\"))) % 2 == 0
            if width == 1:
                assert body == body.strip() and not set(body) & set("\n，")
            end = e
    assert any(found[i] for i in range(len(texts)))


def test_literal_edits(spark):
    """One changed character is pinned to its place; all else is left alone."""
    random.seed(9)
    letters = [chr(0x4E00 + k) for k in range(0, 6000, 7)]
    cases, want = [], []
    for _ in range(40):
        quote = "".join(random.sample(letters, random.randint(6, 12)))
        at, new = random.randrange(len(quote)), random.choice([c for c in letters if c not in quote])
        cases.append(("typo", quote, quote[:at] + new + quote[at + 1:]))
        want.append((at, quote[at], new))
        cases.append(("punctuation", quote + "。。", quote + "。"))
        want.append((len(quote) + 1, "。", "删除此处的“。”"))
        cases += [("grammar", quote, quote[:at] + new + quote[at + 1:]), ("typo", quote, quote), ("typo", quote, ""), ("typo", quote, quote[:at] + new + quote[at:])]
        want += [None] * 4
    cases += [("typo", "", ""), ("typo", letters[0], letters[1])]
    want += [None, None]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, c string, q string, s string")
    got = {r.k: tuple(r.e) if r.e else None for r in df.select("k", localize_edit(F.col("c"), F.col("q"), F.col("s")).alias("e")).collect()}
    assert [(c, got[k], w) for k, (c, w) in enumerate(zip(cases, want)) if got[k] != w] == []


def finalized(spark, **over):
    base = dict(doc_id=1, chunk_index=0, candidate_index=0, category="grammar", grammar_subtype="collocation", quote="胃口很沉闷", reason="a",
                suggestion="b", char_start=1, char_end=6, candidate_confidence=95, protected=False, v_category=None, v_grammar_subtype=None,
                v_verdict="confirmed", v_confidence=95, v_reason="r", v_suggestion="胃口很寡淡", v_evidence_source_ids=[])
    base.update(over)
    schema = ("doc_id long, chunk_index int, candidate_index int, category string, grammar_subtype string, quote string, reason string, "
              "suggestion string, char_start int, char_end int, candidate_confidence int, protected boolean, v_category string, "
              "v_grammar_subtype string, v_verdict string, v_confidence int, v_reason string, v_suggestion string, "
              "v_evidence_source_ids array<string>")
    return finalize(spark.createDataFrame([tuple(base.values())], schema), X.evidence(spark)).collect()


def test_levels_and_evidence(spark):
    assert finalized(spark)[0].level == "confirmed"
    assert finalized(spark, protected=True)[0].level == "suspected"
    assert finalized(spark, grammar_subtype="ambiguity")[0].level == "suspected"
    changed = finalized(spark, v_category="grammar", v_grammar_subtype="word_misuse")[0]
    assert (changed.level, changed.grammar_subtype) == ("suspected", "word_misuse")
    rescued = finalized(spark, candidate_confidence=30, v_category="grammar", v_grammar_subtype="word_order", v_confidence=90)[0]
    assert (rescued.level, rescued.confidence) == ("suspected", 90)
    assert finalized(spark, v_verdict="rejected") == [] and finalized(spark, v_confidence=49) == []
    typo = finalized(spark, category="typo", grammar_subtype=None, quote="他们再操场上跑步。", v_suggestion="他们在操场上跑步。",
                     v_evidence_source_ids=["gb-t-15834-2011", "standard-chinese-characters-2013", "standard-chinese-characters-2013"])[0]
    assert (typo.original_text, typo.suggestion, typo.char_start, typo.char_end) == ("再", "在", 3, 4)
    assert [e.source_id for e in typo.evidence_refs] == ["standard-chinese-characters-2013"]
    flipped = finalized(spark, v_category="typo", quote="他们再操场上跑步。", v_suggestion="他们在操场上跑步。")[0]
    assert (flipped.original_text, flipped.level) == ("他们再操场上跑步。", "suspected")


def plain_fold(items):
    merged = []
    for x in sorted(items, key=lambda r: (r["s"], r["e"], r["cat"], -r["conf"], r["k"])):
        hit = next((i for i, m in enumerate(merged) if (m["cat"], m["sub"], m["norm"]) == (x["cat"], x["sub"], x["norm"])
                    and m["s"] < x["e"] and x["s"] < m["e"]), None)
        if hit is None:
            merged.append(x)
        elif x["conf"] > merged[hit]["conf"]:
            merged[hit] = x
    return sorted(m["k"] for m in merged)


def test_dedup_against_plain_fold(spark):
    random.seed(2)
    docs = {}
    for d in range(120):
        docs[d] = []
        for k in range(random.randint(1, 14)):
            s = random.randint(0, 20)
            sug = random.choice(["ab", "A　b", "c"])
            docs[d].append(dict(k=k, s=s, e=s + random.randint(1, 7), cat=random.choice(["typo", "grammar"]), sub=random.choice([None, "x"]),
                                conf=random.randint(1, 4), sug=sug, norm=re.sub(r"\s", "", sug).lower()))
    flat = [(d, 0, i["k"], i["cat"], i["sub"], i["s"], i["e"], i["sug"], i["conf"]) for d, v in docs.items() for i in v]
    df = spark.createDataFrame(flat, "doc_id long, chunk_index int, candidate_index int, category string, grammar_subtype string, "
                                     "char_start int, char_end int, suggestion string, confidence int")
    got = {}
    for r in dedup_issues(df).collect():
        got.setdefault(r.doc_id, []).append(r.candidate_index)
    for d, items in docs.items():
        assert sorted(got[d]) == plain_fold(items), d


def test_segments_and_locations(spark):
    lines = spark.createDataFrame(
        [(1, 1, "第一句。第二句！", 1, False), (1, 2, "", 1, False), (1, 3, "🧪第三句？尾", 2, True), (1, 4, "末行", 2, False)],
        "doc_id long, line_no int, text string, page int, paragraph_break_after boolean")
    seg = build_segments(lines)
    assert sorted(rows(seg.select("char_start", "char_end", "page", "line", "paragraph_index"))) == [
        (0, 8, 1, 1, 0), (10, 16, 2, 3, 1), (18, 20, 2, 4, 2)]
    text = assemble_text(lines).first().text
    assert text == "第一句。第二句！\n\n🧪第三句？尾\n\n末行"
    spans = spark.createDataFrame([(1, 4, 12), (1, 15, 16), (1, 8, 9), (1, 16, 19)], "doc_id long, char_start int, char_end int")
    got = {(r.char_start, r.char_end): (r.page, r.page_end, r.line_start, r.line_end, r.paragraph_index, r.sentence_index, r.located)
           for r in locate(spans, seg).collect()}
    assert got == {(4, 12): (1, 2, 1, 3, 0, 1, True), (15, 16): (2, None, 3, 3, 1, 1, True), (8, 9): (None,) * 6 + (False,),
                   (16, 19): (2, None, 4, 4, 2, 0, True)}


def test_location_of_long_line(spark):
    lines = spark.createDataFrame([(1, 1, "长。" * 9000, None, False)], "doc_id long, line_no int, text string, page int, paragraph_break_after boolean")
    spans = spark.createDataFrame([(1, 12001, 12003)], "doc_id long, char_start int, char_end int")
    r = locate(spans, build_segments(lines)).first()
    assert (r.line_start, r.sentence_index) == (1, 6000)


def test_any_number_of_rules(spark):
    words = [f"w{i:03d}x" for i in range(150)]
    rules = spark.createDataFrame([(i, w, "typo", None, w, None, None, "r", "s", 90, []) for i, w in enumerate(words)], RULES)
    docs = spark.createDataFrame([(1, "general", "w003x and w149x"), (2, "general", "none"), (3, "general", "w010xw010x")],
                                 "doc_id long, analysis_profile string, text string")
    out = scan_rules(chunk(docs), rules).select("doc_id", F.transform("candidates", lambda c: c["quote"]).alias("q"))
    assert {r.doc_id: r.q for r in out.collect()} == {1: ["w003x", "w149x"], 2: [], 3: ["w010x"]}


def test_attach_candidates_keeps_order(spark):
    chunks = spark.createDataFrame([(1, 0, "abc")], "doc_id long, chunk_index int, text string")
    flat = candidates(spark, [{"category": "typo", "quote": q} for q in ("a", "b")]).select("c.*").withColumn("doc_id", F.lit(1)).withColumn(
        "chunk_index", F.lit(0)).withColumn("candidate_index", F.when(F.col("quote") == "a", 1).otherwise(0))
    assert [c.quote for c in attach_candidates(chunks, flat).first().candidates] == ["b", "a"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("　 \n",), ("　a b　",)], "t string")
    assert rows(df.select(is_blank(F.col("t")), trim_unicode(F.col("t")), normalize_suggestion(F.col("t")))) == [(True, "", ""), (False, "a b", "ab")]
    names = spark.createDataFrame([("/x/y\u0007z.txt",), ("a/",), ("..",), ("n" * 300,)], "n string")
    assert [r[0] for r in names.select(safe_filename(F.col("n"))).collect()] == ["yz.txt", "a", "document.txt", "n" * 180]
    md = spark.createDataFrame([("a*b\r\nc_d", 'h y<>\\"')], "m string, u string")
    assert rows(md.select(L.markdown_text(F.col("m")), L.markdown_url(F.col("u")))) == [("a\\*b  \n  c\\_d", "h%20y%3C%3E%5C%22")]


def test_marked_and_unmarked_texts_have_the_same_spans(spark):
    """Matches are found in one search; texts that hold the mark themselves are searched the other way."""
    from proofspark.functions import spans as P

    rows = ["", "$0 10% \\$5", "1%2%3%", "x 10% y", "10%", "\x0110%\x01\x01 20%", "\x01", None, "😀10%😀 20%\n30%"]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, text string")
    got = df.select("k", P.pattern_spans(F.col("text"), r"\d+%").alias("a"), P._searched_twice(F.col("text"), r"\d+%").alias("b")).orderBy("k").collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert [[tuple(s) for s in r.a] for r in got if r.a is not None] == [
        [], [(3, 6)], [(0, 2), (2, 4), (4, 6)], [(2, 5)], [(0, 3)], [(1, 4), (7, 10)], [], [(1, 4), (6, 9), (10, 13)]]
    plan = df.select(P.pattern_spans(F.col("text"), "[0-9]+%").alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]+%") == 3  # one search, and two for the rare other way


def test_reused_chunks_are_cut_once(spark, sf_dir):
    from proofspark.catalog import payload

    assert "documents.parquet" not in "".join(payload.chunk_reuse(spark, sf_dir).inputFiles())
