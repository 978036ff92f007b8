"""The store of keyed rows: replacing, interrupted writes, second writers, merging, and what is read."""

import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from proofspark.sources import store as S


def rows(spark, ids, content):
    return spark.createDataFrame([(i, str(i), content) for i in ids], "doc_id long, job_id string, content string")


def held(store):
    return {r.doc_id: r.content for r in store.read().collect()}


def test_rows_of_a_key_are_replaced(spark, tmp_path):
    store = S.KeyedStore(spark, str(tmp_path / "s"), "job_id")
    with pytest.raises(FileNotFoundError):
        store.read()
    store.replace(rows(spark, range(50), "a"))
    store.replace(rows(spark, range(40, 60), "b"))
    store.replace(rows(spark, range(45, 50), "c"))
    store.replace(rows(spark, [], "d"))
    assert held(store) == {i: "c" if 45 <= i < 50 else "b" if i >= 40 else "a" for i in range(60)}
    assert store.read().count() == 60


def test_an_interrupted_write_changes_nothing(spark, tmp_path, monkeypatch):
    """Rows are staged, then the writer dies before the manifest: readers see the old rows, and the same write succeeds later."""
    path = str(tmp_path / "s")
    store = S.KeyedStore(spark, path, "job_id")
    store.replace(rows(spark, range(10), "a"))
    monkeypatch.setattr(S.KeyedStore, "_commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.replace(rows(spark, range(5, 15), "b"))
    monkeypatch.undo()
    assert len(os.listdir(f"{path}/parts")) == 2
    assert held(S.KeyedStore(spark, path, "job_id")) == {i: "a" for i in range(10)}
    store.replace(rows(spark, range(5, 15), "b"))
    assert held(store) == {i: "b" if i >= 5 else "a" for i in range(15)}
    assert store.vacuum() == 2 and held(store)[14] == "b"


def test_a_second_writer_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    one, two = S.KeyedStore(spark, path, "job_id"), S.KeyedStore(spark, path, "job_id")
    one.replace(rows(spark, range(3), "a"))
    old = two.manifest()
    one.replace(rows(spark, range(3), "b"))
    monkeypatch.setattr(two, "manifest", lambda: old)
    with pytest.raises(Py4JJavaError):
        two.replace(rows(spark, range(3), "c"))
    assert held(one) == {i: "b" for i in range(3)}


def test_parts_are_merged(spark, tmp_path):
    """Many small writes stay few parts, and a part that is mostly replaced is written anew."""
    store = S.KeyedStore(spark, str(tmp_path / "s"), "job_id")
    store.replace(rows(spark, range(1000), "base"))
    base = store.manifest()["parts"][0]["id"]
    for k in range(20):
        store.replace(rows(spark, [2000 + k, k], f"v{k}"))
        assert len(store.manifest()["parts"]) <= 2 * S.TIER
    assert base in [p["id"] for p in store.manifest()["parts"]]  # the large part was never rewritten
    got = held(store)
    assert len(got) == 1020 and got[3] == "v3" and got[2003] == "v3" and got[500] == "base"
    store.replace(rows(spark, range(900), "new"))
    assert base not in [p["id"] for p in store.manifest()["parts"]] and held(store)[899] == "new" and held(store)[950] == "base"


def test_only_keys_of_stored_rows_are_read(spark, tmp_path):
    store = S.KeyedStore(spark, str(tmp_path / "s"), "job_id")
    store.replace(rows(spark, range(100), "a"))
    state = store.manifest()
    plan = store._live(state, state["parts"][0]).select("job_id").join(rows(spark, [1], "").select("job_id"), "job_id", "left_semi")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<job_id:string>" in text
    store.replace(rows(spark, range(10), "b"))
    state = store.manifest()
    scan = store.read().select("content").where(F.col("content") == "a")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<job_id:string,content:string>" in scan and len(state["parts"]) == 2
