"""The trie of conversation prefixes against plain Python, whatever the shards, the skeleton and the segments."""

import hashlib
import random
import zlib

import pytest

from proofspark.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn int, role string, text string, depth int, n_convs string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, digest(*x[1:])))
    paths = {}
    for conv in own:
        h, rest = zlib.crc32(str(conv).encode()) % 6, abs(conv) % 100
        family = conv - rest if conv >= 0 else conv + rest
        paths[conv] = tuple(x[1:] for x in own.get(family, [])[:h] + own[conv][h:])
    members, kids = {}, {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        under = [below[x] for x in kids.get(node, [])]
        below[node] = (sum(x[0] for x in under) or 1, (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(x[1] for x in under))
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(kids.get(node, [])), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in P.prefix_trie(df, **options).collect()), key=repr)


def made(seed):
    rng = random.Random(seed)
    ids = [None, -105, -100, 0, 1, 2, 3, 5, 99, 100, 103, 150, 200, 207, *range(300, 306)]
    return [(rng.choice(ids), rng.choice([None, *range(1, 8)]), rng.choice(["user", None]), rng.choice(["a", "a", "bb", "", None])) for _ in range(250)]


@pytest.mark.parametrize("options", [{}, {"rows": 2, "skeleton": 8}, {"segment": 2, "rows": 3, "skeleton": 16}, {"segment": 1}])
def test_random(spark, options):
    rows = made(len(options))
    assert found(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA), **options) == plain(rows)


def test_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert found(table, rows=7, skeleton=64) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_hot_path_and_long_text(spark):
    """Thousands of equal conversations, one of many turns, and a very long text; ids of the hot path are sorted over many tasks."""
    rows = [(c, t, "user", "same") for c in range(1000, 3000) for t in (1, 2)]
    rows += [(50, t, "user", f"turn {t}") for t in range(700)] + [(60, 1, "user", "long " * 200_000), (60, None, None, None)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    assert found(df, segment=64, rows=10, skeleton=32) == plain(rows)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(none) == [] and P.prefix_trie(none).columns[0] == "conv_id"
    assert found(spark.createDataFrame([(None, 1, "user", "x", 1, "")], SCHEMA)) == []


def test_skeleton_is_bounded(spark):
    rows = made(1)
    paths = P.distinct_paths(P.segments(P.rebuilt(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)), 100))
    for bound in (4, 8, 32):
        _, trie = P._sharded(paths.withColumns({c: P.F.lit(0).cast("bigint") for c in ("kids", "leaves", "saved")}), 1, 1, bound)
        assert len(trie.parent) <= bound
