"""Tables that change together: one commit replaces parts of several keyed tables, and a reader sees all of it or nothing.

A table is Parquet folders, one or more for each bucket of its key. A version is a small manifest that names, for every
table, the folders of each bucket; writing the manifest under the next number is the commit. Whoever comes second finds
that number taken and starts again from the version that won. A change rewrites only the buckets that its keys fall in.

The manifest is renamed into place without overwriting, which HDFS and local file systems refuse if the name is taken; a
store on which renaming overwrites needs another way to take a number.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stores import overwrite_texts

BUCKETS, RETRIES = 16, 20


class Conflict(RuntimeError):
    """Another writer took the version."""


class Store:
    """Versioned tables under ``root``, a folder that all of the cluster sees. ``keys`` names each table's key column."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(root).toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _manifest(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        return sorted(int(s.getPath().getName()[:12]) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def snapshot(self, version: int | None = None) -> dict:
        """{"version", "tables": {name: {bucket: folder}}, "schemas"} of a version, the newest if None."""
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {}, "schemas": {}}
        version = known[-1] if version is None else version
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(self._manifest(version)).collect()))

    def read(self, table: str, snapshot: dict | None = None) -> DataFrame:
        """A table as it is in a snapshot, the newest if None."""
        snapshot = snapshot or self.snapshot()
        return self._of(snapshot, table, snapshot["tables"][table])

    def _of(self, snapshot: dict, table: str, buckets) -> DataFrame:
        schema = StructType.fromJson(snapshot["schemas"][table])
        folders = sorted(snapshot["tables"][table][b] for b in buckets if b in snapshot["tables"][table])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame) -> dict[str, str]:
        """Folders by bucket of newly written rows."""
        folder = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(self.keys[table])).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        parts = [s.getPath() for s in self._fs.listStatus(self._path(folder))]
        return {p.getName().split("=")[1]: p.toString() for p in parts if "=" in p.getName()}

    def _commit(self, base: dict, tables: dict, schemas: dict) -> dict:
        """Write the next manifest after ``base``, or raise Conflict."""
        new = {"version": base["version"] + 1, "tables": base["tables"] | tables, "schemas": base["schemas"] | schemas, "at": time.time()}
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        out = self._fs.create(draft, False)
        out.write(json.dumps(new).encode())
        out.close()
        try:
            self._files.rename(draft, self._path(self._manifest(new["version"])), self._no_options)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(self._path(self._manifest(new["version"]))):
                raise Conflict(f"version {new['version']} is taken") from e
            raise
        return new

    def create(self, **tables: DataFrame) -> dict:
        """The tables whole, in one commit; tables of these names are replaced."""
        return self._commit(self.snapshot(), {n: self._write(n, df) for n, df in tables.items()}, {n: df.schema.jsonValue() for n, df in tables.items()})

    def change(self, change: Callable[[dict[str, DataFrame], dict], dict[str, DataFrame]], **touched: DataFrame) -> dict:
        """One commit that rewrites the buckets of each table that ``touched`` keys fall in.

        ``touched`` has, by table, rows with that table's key. ``change`` gets the tables' rows of those buckets and the
        snapshot, and returns the new rows of each; every returned row must belong to those buckets. A conflict starts it
        again on the version that won.
        """
        hit = {t: [str(r[0]) for r in rows.select(self._bucket(self.keys[t])).distinct().collect()] for t, rows in touched.items()}
        for _ in range(RETRIES):
            base = self.snapshot()
            new = change({t: self._of(base, t, b) for t, b in hit.items()}, base)
            tables = {}
            for t, rows in new.items():
                kept = {b: f for b, f in base["tables"][t].items() if b not in hit[t]}
                tables[t] = kept | self._write(t, rows.select(*StructType.fromJson(base["schemas"][t]).names))
            try:
                return self._commit(base, tables, {})
            except Conflict:
                continue
        raise Conflict(f"no version could be taken in {RETRIES} attempts")

    def vacuum(self, keep: int = 2, older_than: float = 3600.0) -> list[str]:
        """Remove manifests but the newest ``keep``, and data folders that none of these name and no writer of the last
        ``older_than`` seconds can be about to commit. Returns the folders removed."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path(self._manifest(v)), False)
        used = {f for v in known[-keep:] for t in self.snapshot(v)["tables"].values() for f in t.values()}
        gone = []
        for t in self._fs.listStatus(self._path(f"{self.root}/data")):
            for written in self._fs.listStatus(t.getPath()):
                if written.getModificationTime() / 1000 > time.time() - older_than:
                    continue
                for part in self._fs.listStatus(written.getPath()):
                    if part.isDirectory() and part.getPath().toString() not in used:
                        self._fs.delete(part.getPath(), True)
                        gone.append(part.getPath().toString())
        return gone


def replace_texts(store: Store, changes: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> dict:
    """New texts by doc_id in one commit: documents get them and lose what was derived from the old ones, their chunks are
    cut anew. Texts of documents that are not there change nothing; the last of several texts by ``text`` counts."""
    one = changes.groupBy("doc_id").agg(F.max("text").alias("text"))

    def change(tables, _):
        there = one.join(tables["documents"].select("doc_id"), "doc_id", "left_semi")
        docs, chunks = overwrite_texts(tables["documents"], tables["chunks"], there, cut)
        return {"documents": docs, "chunks": chunks}

    return store.change(change, documents=one, chunks=one)


def delete_keys(store: Store, gone: DataFrame, key: str, *tables: str) -> dict:
    """One commit without the rows of these keys in all the tables, which are keyed by ``key``."""
    keys = gone.select(key).distinct()
    return store.change(lambda now, _: {t: rows.join(keys, key, "left_anti") for t, rows in now.items()}, **dict.fromkeys(tables, keys))


def insert_unique(store: Store, table: str, rows: DataFrame, ident: str) -> DataFrame:
    """Insert rows whose key the table does not have; (key, ``ident``) of what it holds then, for every row asked.

    Whoever loses a race reads the winner's row: the commit is tried again on the version that won, where the key is there.
    Of several new rows with one key the least ``ident`` stays. Rows with a null key are always inserted.
    """
    key = store.keys[table]
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(ident, *[c for c in rows.columns if c not in (key, ident)])).alias("_r"))
    first = first.select(key, "_r.*").select(*rows.columns).unionByName(rows.filter(F.col(key).isNull()))

    def change(tables, _):
        now = tables[table]
        return {table: now.unionByName(first.join(now.select(key), key, "left_anti").select(*now.columns))}

    done = store.change(change, **{table: first})
    return store.read(table, done).join(rows.select(key).distinct(), key, "left_semi").select(key, ident)
