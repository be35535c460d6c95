"""Exact deduplication by Grace hashing.

Each input task first folds its own equal texts into one record, so a group with a
third of all rows crosses the network once per task. The records are dealt by digest;
a task that receives more than its memory budget partitions them again, by further
digest bits, to spill files until each bucket fits an open-addressing table that
compares complete contents. A second pass gives every row its class.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from lodestrand.llm import wordcore
from lodestrand.llm.rows import own, private
from lodestrand.runtime import ship

FAN_OUT = 16
Record = tuple[bytes, bytes, int | None, int, object]  # digest, content, largest doc_id, rows, the rest of a row of that id


class OpenTable:
    """Linear-probing table from complete content to (largest doc_id, rows, the rest of a row of that id)."""

    def __init__(self) -> None:
        self.mask, self.bytes = 1023, 0
        self.slots: list[int] = [-1] * 1024
        self.entries: list[list] = []

    def add(self, digest: bytes, content: bytes, doc_id: int | None, rows: int, rest: object = None) -> bool:
        """Fold a record in; true if its content is new. Of rows with one content and id the least rest, as text, stays."""
        at = int.from_bytes(digest[8:16], "little") & self.mask
        while (i := self.slots[at]) >= 0:
            e = self.entries[i]
            if e[0] == digest and e[1] == content:
                if doc_id is not None and (e[2] is None or doc_id > e[2]):
                    e[2], e[4] = doc_id, rest
                elif doc_id == e[2] and rest != e[4] and repr(rest) < repr(e[4]):
                    e[4] = rest
                e[3] += rows
                return False
            at = (at + 1) & self.mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, doc_id, rows, rest])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > self.mask:
            self._grow()
        return True

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for i, e in enumerate(self.entries):
            at = int.from_bytes(e[0][8:16], "little") & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = i


def grace(records: Iterable[Record], budget: int, folder: str | None = None, depth: int = 0) -> Iterator[Record]:
    """Classes of equal content, with at most about budget bytes held.

    When a bucket outgrows the budget its table and its remaining records go to
    FAN_OUT spill files by the next digest byte, and each file is treated alike.
    """
    table, source = OpenTable(), iter(records)
    for r in source:
        table.add(*r)
        if table.bytes > budget and depth < 32 and len(table.entries) > 1:
            break
    else:
        yield from map(tuple, table.entries)
        return
    work = tempfile.mkdtemp(prefix="grace-", dir=folder)
    try:
        paths = [f"{work}/{i}" for i in range(FAN_OUT)]
        files = [open(p, "wb") for p in paths]
        try:
            def put(r) -> None:
                part = r[0][depth // 2]
                pickle.dump(tuple(r), files[part & 15 if depth % 2 else part >> 4], pickle.HIGHEST_PROTOCOL)

            for e in table.entries:
                put(e)
            del table
            for r in source:
                put(r)
        finally:
            for f in files:
                f.close()
        for p in paths:
            yield from grace(_spilled(p), budget, work, depth + 1)
    finally:
        shutil.rmtree(work, ignore_errors=True)


def _spilled(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


_LOCAL = "digest binary, content binary, top_id bigint, n_rows bigint"
_CLASS = "text_sha256 string, top_id bigint, n_rows bigint"


def _emit(entries: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 8 MB."""
    lo, size = 0, 0
    for i, e in enumerate(entries):
        size += len(e[1])
        if size > 8 << 20 or i + 1 == len(entries):
            part = entries[lo : i + 1]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            lo, size = i + 1, 0


def _fold_local(budget: int, rest: pa.DataType | None = None):
    """Records of (id, text, the rest if any) rows, equal texts of a task as one."""
    fields = [("digest", pa.binary()), ("content", pa.binary()), ("top_id", pa.int64()), ("n_rows", pa.int64())]
    schema = pa.schema([*fields, ("rest", rest)] if rest is not None else fields)
    names = [f.name for f in rest] if rest is not None else []

    def others_of(b: pa.RecordBatch) -> Iterator:
        """The rest of each row as a tuple, which is smaller than a dict."""
        return zip(*(b.column(2).field(i).to_pylist() for i in range(len(names)))) if names else repeat(None)

    def emitted(entries: list) -> Iterator[pa.RecordBatch]:
        for e in entries if names else ():
            e[4] = dict(zip(names, e[4]))
        yield from _emit(entries, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for b in batches:
            for doc_id, text, other in zip(b.column(0).to_pylist(), (x.as_py() for x in wordcore.binary(b.column(1))), others_of(b)):
                table.add(hashlib.sha256(text).digest(), text, doc_id, 1, other)
                if table.bytes > budget:
                    yield from emitted(table.entries)
                    table = OpenTable()
        yield from emitted(table.entries)

    return run


def _fold_bucket(budget: int):
    schema = pa.schema([("text_sha256", pa.string()), ("top_id", pa.int64()), ("n_rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = ((*r, None) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for digest, _, top, rows, _ in grace(records, budget):
            if rows > 1:
                out.append((digest.hex(), top, rows))
                if len(out) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _kept_rows(budget: int, names: list[str], text_col: str, schema: pa.Schema):
    """The row that stays of each class of a bucket, whole: its content as the text, and its rest."""
    others = [name for name in names if name != text_col]
    place, width = {name: i + 1 for i, name in enumerate(others)}, len(others) + 1

    def batch(part: list) -> pa.RecordBatch:
        columns = []
        for name, field in zip(names, schema):
            if name == text_col:
                texts = pa.array([None if e[4][0] else e[1] for e in part], pa.binary())
                columns.append(texts.view(pa.string()))
            else:
                columns.append(pa.array([e[4][place[name]] for e in part], field.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rest as a tuple in the order of its fields, which is smaller than a dict.
        records = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[:4]), zip(*(b.column(4).field(i).to_pylist() for i in range(width)))))
        part, size = [], 0
        for e in grace(records, budget):
            part.append(e)
            size += len(e[1]) + 200
            if size > 8 << 20:
                yield batch(part)
                part, size = [], 0
        if part:
            yield batch(part)

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 48 << 20) -> DataFrame:
    """Groups of two or more rows with equal text: text_sha256, top_id, n_rows."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    local = slim.mapInArrow(wordcore.tidy(_fold_local(task_bytes // 3)), _LOCAL)
    return local.repartition("digest").mapInArrow(wordcore.tidy(_fold_bucket(task_bytes)), _CLASS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 48 << 20) -> DataFrame:
    """Every row with its class: the input's columns, keep_id, group_size, kept, text_sha256.

    Null text equals the empty text. Of equal texts the row with the largest id stays;
    rows that repeat both id and text share one decision. A null id never stays where
    another row of its class has an id. Input columns named like an output, in any case, are
    replaced; any other name may occur. An empty table gives no rows.
    """
    out = ("keep_id", "group_size", "kept", "text_sha256")
    sha, id_, its, top, n = private(docs, "sha", "id", "its", "top", "n")
    rows = docs.select(*own(docs), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias(sha), F.col(id_col).cast("bigint").alias(id_))
    joined = rows.join(classes(docs, id_col, text_col, task_bytes).toDF(its, top, n), F.col(sha) == F.col(its), "left")
    keep = F.when(F.col(n).isNull(), F.col(id_)).otherwise(F.col(top))
    return joined.select(
        *(x for c, x in zip(docs.columns, own(docs)) if c.lower() not in out),
        keep.alias("keep_id"),
        F.coalesce(F.col(n), F.lit(1)).cast("bigint").alias("group_size"),
        F.col(id_).eqNullSafe(keep).alias("kept"),
        F.col(sha).alias("text_sha256"),
    )


def unlike_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 48 << 20) -> DataFrame:
    """The input without exact copies: of equal texts one row, that of the largest id.

    Null text equals the empty text. A null id comes before all others; of rows that repeat
    both id and text the one whose other columns come first as text stays. All columns of
    the input are returned as they are, whatever their names; text_col is a string. An empty
    table gives no rows. Rows travel once, with their text, to where it is compared.
    """
    ship(docs.sparkSession)
    others = [x.alias(f"c{i}") for i, (c, x) in enumerate(zip(docs.columns, own(docs))) if c != text_col]
    rest = F.struct(F.col(text_col).isNull().alias("null"), *others).alias("rest")
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), rest)
    kind = slim.schema["rest"].dataType
    local = slim.mapInArrow(wordcore.tidy(_fold_local(task_bytes // 3, to_arrow_type(kind))), T.StructType([*T.StructType.fromDDL(_LOCAL), T.StructField("rest", kind)]))
    names = [text_col if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]
    return local.repartition("digest").mapInArrow(wordcore.tidy(_kept_rows(task_bytes, names, text_col, to_arrow_schema(docs.schema))), docs.schema)
