"""Keyed rows that are appended to and replaced by key: folders of rows, and a manifest that names the live ones.

Nothing that a reader may see is ever changed. A write adds a folder of rows and a table of the earlier rows they replace,
and becomes visible by one rename of the next manifest; without it the folders are just not looked at. Rows are
merged in tiers of size, so each is rewritten a few times however often the store grows.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Parts of about one size that are merged into one, and the ratio of neighbouring sizes.
TIER, RATIO = 8, 8


class KeyedStore:
    """``path``/parts/<id> hold rows, ``path``/dead/<id> (part, key) rows that are replaced, ``path``/manifests/<n>.json what counts."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(path).getFileSystem(self._conf)

    def manifest(self) -> dict:
        """The newest manifest; an empty one for a new store."""
        folder = self._hadoop.Path(self.path, "manifests")
        if not self._fs.exists(folder):
            return {"version": 0, "schema": None, "parts": []}
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return {"version": 0, "schema": None, "parts": []}
        stream = self._fs.open(self._hadoop.Path(folder, f"{max(versions):012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The live rows, one a key."""
        state = self.manifest()
        if state["schema"] is None:
            raise FileNotFoundError(f"nothing is stored in {self.path}")
        return self._rows(state, state["parts"])

    def replace(self, rows: DataFrame) -> None:
        """Add ``rows``, one a key; stored rows of their keys are no longer live. All of it or nothing.

        Of the stored rows only the keys are read. A second writer at the same time fails and changes nothing.
        """
        state, part = self.manifest(), uuid.uuid4().hex
        schema = StructType.fromJson(state["schema"]) if state["schema"] else rows.schema
        rows.select(*schema.names).write.parquet(self._part(part))
        fresh = self.spark.read.schema(schema).parquet(self._part(part))
        parts = list(state["parts"])
        if parts:
            dead = uuid.uuid4().hex
            keys = [self._live(state, p).select(F.lit(p["id"]).alias("part"), self.key).join(fresh.select(self.key), self.key, "left_semi") for p in parts]
            found = keys[0]
            for other in keys[1:]:
                found = found.unionByName(other)
            found.write.partitionBy("part").parquet(os.path.join(self.path, "dead", dead))
            hit = self._counts(schema, dead)
            parts = [{**p, "dead": [*p["dead"], dead], "gone": p["gone"] + hit[p["id"]]} if p["id"] in hit else p for p in parts]
        parts.append({"id": part, "rows": fresh.count(), "dead": [], "gone": 0})
        self._commit({"version": state["version"] + 1, "schema": json.loads(schema.json()), "parts": self._merged(state, schema, parts)})

    def vacuum(self) -> int:
        """Delete folders that the newest manifest doesn't name; how many. Not while others read or write."""
        state = self.manifest()
        used = {p["id"] for p in state["parts"]} | {d for p in state["parts"] for d in p["dead"]}
        gone = 0
        for kind in ("parts", "dead"):
            folder = self._hadoop.Path(self.path, kind)
            for f in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                if f.getPath().getName() not in used:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        return gone

    def _part(self, part: str) -> str:
        return os.path.join(self.path, "parts", part)

    def _counts(self, schema: StructType, dead: str) -> dict[str, int]:
        path = os.path.join(self.path, "dead", dead)
        folders = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop.Path(path))]
        if not any(f.startswith("part=") for f in folders):
            return {}
        rows = self.spark.read.schema(StructType([schema[self.key]]).add("part", "string")).parquet(path)
        return {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # a row a part

    def _live(self, state: dict, part: dict) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        rows = self.spark.read.schema(schema).parquet(self._part(part["id"]))
        dead = [os.path.join(self.path, "dead", d, f"part={part['id']}") for d in part["dead"]]
        return rows.join(self.spark.read.schema(StructType([schema[self.key]])).parquet(*dead), self.key, "left_anti") if dead else rows

    def _rows(self, state: dict, parts: list[dict]) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        whole = [self._part(p["id"]) for p in parts if not p["dead"]]
        out = [self.spark.read.schema(schema).parquet(*whole)] if whole else []
        out += [self._live(state, p).select(*schema.names) for p in parts if p["dead"]]
        rows = out[0]
        for other in out[1:]:
            rows = rows.unionByName(other)
        return rows

    def _merged(self, state: dict, schema: StructType, parts: list[dict]) -> list[dict]:
        """Parts after merging the first tier of size that has become full, or parts that are mostly replaced."""
        tiers: dict[int, list[dict]] = {}
        for p in parts:
            tiers.setdefault(_tier(p["rows"]), []).append(p)
        chosen = next((t for _, t in sorted(tiers.items()) if len(t) >= TIER), None) or [p for p in parts if 2 * p["gone"] > p["rows"]]
        if not chosen:
            return parts
        merged = uuid.uuid4().hex
        self._rows({**state, "schema": json.loads(schema.json())}, chosen).write.parquet(self._part(merged))
        rest = [p for p in parts if p not in chosen]
        return [*rest, {"id": merged, "rows": sum(p["rows"] - p["gone"] for p in chosen), "dead": [], "gone": 0}]

    def _commit(self, state: dict) -> None:
        folder = self._hadoop.Path(self.path, "manifests")
        staged, final = self._hadoop.Path(folder, f".{uuid.uuid4().hex}"), self._hadoop.Path(folder, f"{state['version']:012d}.json")
        self._fs.mkdirs(folder)
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        never = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        # without the option to overwrite, an existing manifest of that number makes this fail
        self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(staged), self._fs.makeQualified(final), never)


def _tier(rows: int) -> int:
    tier = 0
    while rows >= RATIO:
        rows, tier = rows // RATIO, tier + 1
    return tier
