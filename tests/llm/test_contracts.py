"""Queries without SQL against brute force over the smallest tables, and all of them against their SQL."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

import check
from proofspark.llm import queries as Q

SQL = sorted(Q.ORACLES)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def whole(path, texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path(path))
    return [np.array([*x.ids, end], "<u4") for x in coder.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, sf_dir, name):
    rows, problem, _ = check.compare(spark, check.connect(sf_dir), sf_dir, Q.QUERIES[name], Q.ORACLES[name])
    assert problem == "" and rows > 0


def test_packing(spark, sf_dir, documents):
    ids = dict(zip(documents, whole(Q.BYTE_LEVEL, list(documents.values()), 0)))
    rows = sorted(Q.op3_packing(spark, sf_dir).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    at = 0
    for r in rows:
        assert r.sequence_id * 1024 + r.offset == at and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at += r.length
    for doc_id, own in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r.start)), key=lambda r: r.doc_id):
        end = 0
        for r in own:
            assert r.start == end and r.opens == (r.start == 0) and r.closes == (r.start + r.length == len(ids[doc_id]))
            end += r.length
        assert end == len(ids[doc_id])


def test_token_files(spark, sf_dir, documents):
    ids = dict(zip(documents, whole(Q.WORD_LEVEL, list(documents.values()), 2)))
    before = dict(zip(sorted(ids), itertools.accumulate([0, *(len(ids[d]) for d in sorted(ids))])))
    rows = Q.op10_orc(spark, sf_dir).collect()
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows} == {(d, before[d], len(x), zlib.crc32(x.tobytes())) for d, x in ids.items()}
    assert len(rows) == len(ids)


def test_tiff(spark, sf_dir, documents):
    rows = Q.op4_tiff(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        data = documents[r.doc_id].encode()
        full = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def test_secrets(spark, sf_dir, documents):
    patterns = {
        "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    for r in Q.op6_secrets(spark, sf_dir).collect():
        spans = [(m.start(), k, m.end()) for k, p in patterns.items() for m in p.finditer(documents[r.doc_id])
                 if len(m[2] if k == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[k]]
        spans.sort(key=lambda s: (s[0], list(patterns).index(s[1])))
        named = [f"{k}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in patterns)
        assert [x for x in r.spans.split(",") if x and not x.startswith("model")] == named


def test_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = Q.op2_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows) > 0


def test_language(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = Q.op5_language(spark, sf_dir).join(known, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows) > 0 and all(0 <= r.score <= 1 for r in rows)


def test_pipeline(spark, sf_dir, documents):
    """Stage by stage: what each keeps of its own input, by brute force; the last holds every id of the mixed order."""
    import corpus_pipeline as C
    from proofspark.session import scratch_dir

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in C.STAGES:
        inputs.append([tuple(r) for r in docs.collect()])
        path = scratch_dir(spark, f"test-{name}")
        out = stage(spark, docs, sf_dir)
        assert name == "pack" or out.columns == columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    accepted = {r.doc_id for r in Q.op2_quality(spark, sf_dir).where("predicted = 1").collect()}
    assert {r[0] for r in inputs[1]} == accepted and len(inputs[1]) == len(accepted)
    first = {}
    for r in sorted(inputs[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    assert sorted(inputs[2]) == sorted(first.values())
    assert len(inputs[3]) <= len(inputs[2]) and sorted(inputs[3]) == sorted(inputs[4])
    lone = {r[0] for r in components({r[0]: r[1] for r in inputs[2]})}
    assert {r[0] for r in inputs[3]} == lone
    pieces = sorted(docs.collect(), key=lambda r: (r.sequence_id, r.offset))
    ids = dict(zip([r[0] for r in inputs[4]], whole(Q.BYTE_LEVEL, [r[1] for r in inputs[4]], 0)))
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    order = [r.doc_id for r in pieces if r.opens]
    from proofspark.llm.mixing import mix

    mixed = mix(spark.createDataFrame(inputs[3], "doc_id bigint, text string, lang string, source string, n_chars bigint")).orderBy("_slot", "_start", "_row.doc_id")
    assert order == [r.doc_id for r in mixed.select("_row.doc_id").collect()]


def components(texts):
    """(smallest doc_id,) of each component by comparing all pairs that share a shingle."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, roots, holders = {}, {d: d for d in texts}, {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        sets[d] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        for g in sets[d]:
            holders.setdefault(g, []).append(d)

    def root(d):
        while roots[d] != d:
            d = roots[d]
        return d

    for a, b in {p for v in holders.values() for p in itertools.combinations(sorted(v), 2)}:
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            roots[y] = x
    return {(root(d),) for d in texts}


def test_every_query_is_checked():
    assert set(Q.QUERIES) - set(SQL) == {"op1_chat", "op2_quality", "op3_packing", "op4_tiff", "op5_language", "op6_secrets", "op10_orc", "op13_toxicity", "pipeline"}
