"""Tables kept as a log of segments: a batch writes its own rows and which keys it takes away, and merges are tiered.

Each segment holds rows and `gone`, the keys whose older rows no longer count. What is live is
found when it is read: a row counts if no later segment took its key away. When as many
segments of one tier as `fan` have gathered, they become one of the next tier, so a row is
written once for each tier. The list of segments is a version (sources/versions.py), so a
batch shows whole or not at all.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.operators import bm25
from lodestrand.runtime import materialize, release
from lodestrand.sources import versions

#: Keys that went, with the batch that took them, up to which they are broadcast; two numbers each, so about 80 MB.
GONE_ROWS = 2_000_000


@dataclass
class SegmentLog:
    """Tables of one key that change together. tables: each one's name and the columns in whose order it lies."""

    spark: SparkSession
    path: str
    key: str
    tables: dict[str, tuple[str, ...]]
    fan: int = 4

    def state(self) -> tuple[int, dict]:
        version, manifest = versions.current(self.spark, self.path)
        return version, manifest or {"segments": [], "folders": [], "schemas": {}}

    def _read(self, manifest: dict, table: str, segments: list[dict] | None = None) -> DataFrame | None:
        """The rows of a table's segments with `__seq`, the batch that wrote them; None before there are any."""
        schema = manifest["schemas"].get(table)
        if schema is None:
            return None
        names = [s["folder"] for s in (manifest["segments"] if segments is None else segments) if table in s["tables"]]
        schema = T.StructType.fromJson(json.loads(schema))
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}/{table}" for n in names])

    def _live(self, manifest: dict, table: str, segments: list[dict] | None = None) -> DataFrame | None:
        rows, gone = self._read(manifest, table, segments), self._read(manifest, "__gone")
        if rows is None or gone is None:
            return rows
        last = gone.groupBy(F.col(self.key).alias("__key")).agg(F.max("__seq").alias("__last"))
        few = bm25.small(last, GONE_ROWS if isinstance(gone.schema[self.key].dataType, T.IntegralType) else bm25.BROADCAST_ROWS)
        later = rows.join(few, (F.col(self.key) == F.col("__key")) & (F.col("__seq") < F.col("__last")), "left_anti")
        return later

    def rows(self, table: str) -> DataFrame | None:
        """What counts of a table now; None before the first batch."""
        found = self._live(self.state()[1], table)
        return None if found is None else found.drop("__seq")

    def _write(self, folder: str, table: str, rows: DataFrame, most: int = 0) -> str:
        """Write rows in the table's order; most is a bound of their number, if one is known, by which they are dealt out."""
        order = self.tables.get(table, (self.key,))
        bm25.spread(rows, most, True, *order).sortWithinPartitions(*order).write.parquet(f"{self.path}/{folder}/{table}")
        return json.dumps(json.loads(rows.schema.json()))

    def append(self, tables: dict[str, DataFrame], gone: DataFrame | None = None, most: dict[str, int] | None = None) -> int:
        """Write a batch: rows of each table, and the keys (column `key`) whose older rows it takes away. Returns the version.

        most: bounds of tables' rows, where they are known.
        """
        version, manifest = self.state()
        seq, folder = version + 1, f"segment-{uuid.uuid4().hex}"
        if gone is not None and manifest["segments"]:
            keys = gone.select(self.key).where(F.col(self.key).isNotNull()).distinct()
            tables = {**tables, "__gone": keys}
        schemas = dict(manifest["schemas"])
        for name, rows in tables.items():
            schemas[name] = self._write(folder, name, rows.withColumn("__seq", F.lit(seq).cast("bigint")), (most or {}).get(name, 0))
        segment = {"folder": folder, "tier": 0, "tables": sorted(tables)}
        made = self._merged({"segments": [*manifest["segments"], segment], "schemas": schemas})
        made["folders"] = [s["folder"] for s in made["segments"]]
        return versions.publish(self.spark, self.path, version, made)

    def _merged(self, manifest: dict) -> dict:
        """The manifest after the merges that are due: the last segments of one tier, as soon as there are `fan` of them.

        Where a merge makes another one due, the segments of both are written once, as the last of them has it.
        """
        segments = manifest["segments"]
        tiers, due = [s["tier"] for s in segments], 0
        while len(tiers) >= self.fan and len(set(tiers[-self.fan :])) == 1:
            due = self.fan if not due else due + self.fan - 1
            tiers = [*tiers[: -self.fan], tiers[-1] + 1]
        if not due:
            return manifest
        few, rest = segments[-due:], segments[:-due]
        folder, schemas, there = f"segment-{uuid.uuid4().hex}", manifest["schemas"], []
        for name in sorted({t for s in few for t in s["tables"]} - {"__gone"}):
            most = self._read(manifest, name, few).count()  # by the files' footers
            self._write(folder, name, self._live(manifest, name, few), most)
            there.append(name)
        if rest and any("__gone" in s["tables"] for s in few):  # without older segments nothing is left to take away
            gone = self._read(manifest, "__gone", few)
            self._write(folder, "__gone", gone.groupBy(self.key).agg(F.max("__seq").alias("__seq")))
            there.append("__gone")
        return {**manifest, "segments": [*rest, {"folder": folder, "tier": tiers[-1], "tables": there}]}


class LexicalLog:
    """A lexical index that changes by batches of documents and ranks as one built anew would."""

    def __init__(self, spark: SparkSession, path: str, owner: str | None = None, fan: int = 4, **columns):
        order = {"postings": ("term", "doc_id"), "lengths": ("doc_id",)}
        self.log, self.columns, self.owner = SegmentLog(spark, path, "doc_id", order, fan), columns, owner

    def upsert(self, docs: DataFrame, purge: DataFrame | None = None) -> int:
        """Documents of a batch in place of those with their ids. purge: owners of whom only this batch's documents are to stay.

        Documents without a token count as documents of length 0. A null id is not stored.
        """
        id_col = self.columns.get("id_col", "doc_id")
        docs = docs.where(F.col(id_col).isNotNull())
        # The texts are read once; postings and lengths come from what was counted.
        counted = materialize(bm25.counted(docs, **self.columns), "counted")
        most = counted.agg(F.sum(F.size("terms"))).first()[0] or 0
        postings, lengths = bm25.each_term(counted), counted.select("doc_id", "length")
        if self.owner:
            lengths = lengths.join(docs.select(F.col(id_col).alias("doc_id"), F.col(self.owner).alias("owner")), "doc_id")
        gone = docs.select(F.col(id_col).alias("doc_id"))
        held = self.log.rows("lengths")
        if purge is not None and held is not None:
            owners = purge.select(F.col(purge.columns[0]).alias("owner")).distinct()
            gone = gone.unionByName(held.join(bm25.small(owners), "owner", "left_semi").select("doc_id"))
        version = self.log.append({"postings": postings, "lengths": lengths}, gone, {"postings": most})
        release(counted)
        return version

    def delete(self, ids: DataFrame) -> int:
        """Take away the documents of these ids (first column)."""
        return self.log.append({}, ids.select(F.col(ids.columns[0]).alias("doc_id")))

    def index(self) -> bm25.Index:
        """The index as it stands; terms' frequencies and the collection's size are of live rows."""
        postings, lengths = self.log.rows("postings"), self.log.rows("lengths")
        if postings is None:
            raise ValueError("the index has no segment")
        terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return bm25.Index(postings, terms, lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avgdl")))


class VectorLog:
    """Vectors by id with their owner and metadata, replaced by batches."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", owner: str = "owner", fan: int = 4):
        self.log, self.key, self.owner = SegmentLog(spark, path, key, {"vectors": (key,)}, fan), key, owner

    def upsert(self, rows: DataFrame, purge: bool = False, metadata: str | None = None) -> int:
        """Rows in place of those with their ids; with purge, other rows of the batch's owners go. Null values of a metadata map are dropped."""
        rows = rows.where(F.col(self.key).isNotNull())
        if metadata:
            rows = rows.withColumn(metadata, F.map_filter(metadata, lambda _, v: v.isNotNull()))
        gone, held = rows.select(self.key), self.log.rows("vectors")
        if purge and held is not None:
            owners = rows.select(self.owner).distinct()
            gone = gone.unionByName(held.join(bm25.small(owners), self.owner, "left_semi").select(self.key))
        return self.log.append({"vectors": rows}, gone)

    def delete(self, ids: DataFrame) -> int:
        return self.log.append({}, ids.select(F.col(ids.columns[0]).alias(self.key)))

    def rows(self) -> DataFrame | None:
        return self.log.rows("vectors")


class DocumentStore:
    """Documents and what belongs to them (pages, chunks, ...) in several tables, replaced and deleted together.

    A batch shows in all tables or in none: they share one version. A write that is killed
    leaves the version before it, and its folders until the next vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, tables: tuple[str, ...], key: str = "doc_id", fan: int = 4):
        self.log = SegmentLog(spark, path, key, {t: (key,) for t in tables}, fan)

    def persist(self, tables: dict[str, DataFrame]) -> int:
        """Put documents in place of those with their keys, in every table; the first table names the keys, and rows of other keys are not taken."""
        first = next(iter(self.log.tables))
        keys = tables[first].select(self.log.key).where(F.col(self.log.key).isNotNull()).distinct()
        return self.log.append({t: rows if t == first else rows.join(keys, self.log.key, "left_semi") for t, rows in tables.items()}, keys)

    def delete(self, keys: DataFrame) -> DataFrame:
        """Take documents away from every table; table, deleted: the rows of each that went."""
        keys = keys.select(F.col(keys.columns[0]).alias(self.log.key)).distinct()
        counts = None
        for t in self.log.tables:
            if (rows := self.log.rows(t)) is not None:
                n = rows.join(bm25.small(keys), self.log.key, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(t).alias("table"), "deleted")
                counts = n if counts is None else counts.unionByName(n)
        self.log.append({}, keys)
        return counts

    def rows(self, table: str) -> DataFrame | None:
        return self.log.rows(table)

    def version(self) -> int:
        return self.log.state()[0]

    def restore(self, version: int) -> int:
        """Make an earlier version the latest again, as a version of its own."""
        last, _ = versions.current(self.log.spark, self.log.path)
        return versions.publish(self.log.spark, self.log.path, last, versions.current(self.log.spark, self.log.path, version)[1])

    def vacuum(self, keep: int = 1) -> list[str]:
        return versions.vacuum(self.log.spark, self.log.path, keep)
