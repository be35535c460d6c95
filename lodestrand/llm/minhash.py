"""Near-duplicates by b-bit MinHash.

Equal shingle sets become one class first, so exact copies cost no comparisons. A class
keeps 192 minima: whole, hashed in 32 bands of 6, they propose candidates; as their low 4
bits, packed in 96 bytes, they estimate similarity by counting unequal nibbles, corrected
for the 1 in 16 that agree by chance. Within a bucket only a spanning forest of the
estimated links is kept, found by search over the not yet reached, so a bucket of copies
costs its size and not its square. The forests' components are then searched again
on full shingle sets, which alone decide. With 6 x 32, a pair at the threshold of 0.8
misses every band with a chance of 6e-5, and nearer pairs far more seldom.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import repeats, wordcore
from lodestrand.llm.components import connected_components
from lodestrand.llm.rows import one_each
from lodestrand.llm.wordcore import U
from lodestrand.runtime import lifetime, materialize, release, ship

BANDS, ROWS, BITS = 32, 6, 4
HASHES = BANDS * ROWS
#: Rows of a bucket or component, and bytes of their full sets, that one task compares; larger ones are dealt in blocks.
BLOCK, BLOCK_BYTES = 2_000, 32 << 20
#: Bytes of all hubs up to which they are broadcast.
HUB_BYTES = 8 << 20
_rng = np.random.default_rng(77)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(w: wordcore.Words, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer words has its whole sequence as one."""
    grams = wordcore.Grams(w.hashes())
    g = grams.of(words)
    n = np.diff(w.ptr)
    out = []
    for a, m in zip(w.ptr[:-1].tolist(), n.tolist()):
        if m >= words:
            out.append(np.unique(g[a : a + m - words + 1]))
        elif m:
            out.append(grams.spans(np.array([a]), np.array([a + m])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima (rows x HASHES) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint64)
    y = np.empty_like(flat)
    for i in range(HASHES):
        np.multiply(flat, _MUL[i], out=y)
        np.add(y, _ADD[i], out=y)
        out[:, i] = np.minimum.reduceat(y, at)
    return out


def pack(minima: np.ndarray) -> np.ndarray:
    """Low 4 bits of the minima, two to a byte."""
    low = (minima & U(15)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def agreeing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Equal nibbles of a packed signature (12 words) with each of many."""
    x = many ^ one
    x |= x >> U(2)
    x |= x >> U(1)
    return HASHES - np.bitwise_count(x & U(0x1111111111111111)).sum(1, dtype=np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from equal nibbles, corrected for chance."""
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def forest(sigs: np.ndarray, sizes: np.ndarray, percent: int, slack: float, exact: Callable | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among rows.

    A link is an estimate within slack of the threshold, sizes that allow it and, if
    given, exact(row, others). Each row is compared with those not yet reached only.
    """
    least = percent / 100 - slack
    left = np.arange(len(sizes))
    edges: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        if not len(left):
            break
        n = sizes[left]
        ok = (100 * np.minimum(n, sizes[x]) >= percent * np.maximum(n, sizes[x])) & (estimate(agreeing(sigs[x], sigs[left])) >= least)
        at = np.flatnonzero(ok)
        if exact is not None and len(at):
            at = at[exact(x, left[at])]
        if len(at):
            found = left[at].tolist()
            edges += [(x, y) for y in found]
            queue += found
            left = np.delete(left, at)
    return edges


def jaccard_checker(sets: list[np.ndarray], percent: int) -> Callable:
    """exact() for forest: 100 * intersection >= percent * union on full sets."""

    def check(x: int, others: np.ndarray) -> np.ndarray:
        mine = sets[x]
        ok = np.zeros(len(others), bool)
        lo = 0
        while lo < len(others):  # some millions of shingles at a time
            hi, total = lo, 0
            while hi < len(others) and (hi == lo or total < 2_000_000):
                total += len(sets[others[hi]])
                hi += 1
            part = [sets[y] for y in others[lo:hi]]
            flat = np.concatenate(part)
            at = np.searchsorted(mine, flat)
            at[at == len(mine)] = 0
            n = np.array([len(p) for p in part])
            common = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(n) - n)
            ok[lo:hi] = 100 * common >= percent * (len(mine) + n - common)
            lo = hi
        return ok

    return check


_SIGNED = "doc_id bigint, key binary, n_shingles bigint, set_id binary, bands array<bigint>, sig binary"


def _sign(words: int, lower: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in wordcore.word_batches(b.column(1), lower):
                sets = shingle_sets(w, words)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                ids: list = [None] * len(sets)
                sig: list = [None] * len(sets)
                offsets = np.zeros(len(sets) + 1, np.int32)
                keys = np.empty(0, np.int64)
                if len(full):
                    some = [sets[i] for i in full]
                    minima = signatures(some)
                    packed = pack(minima)
                    k = np.full((len(full), BANDS), 0, np.uint64)
                    for r in range(ROWS):
                        k = wordcore.mix(k * U(31) + minima[:, r::ROWS])
                    keys = wordcore.mix(k + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64).ravel()
                    for i, s, p in zip(full.tolist(), some, packed):
                        ids[i] = hashlib.md5(s.tobytes(), usedforsecurity=False).digest()
                        sig[i] = p.tobytes()
                    offsets[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
                lo, hi = w.first_row, w.first_row + w.rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(n), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(offsets, keys), pa.array(sig, pa.binary())], schema=schema
                )

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches in groups by their first columns."""
    now, group = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != now:
                if group:
                    yield group
                now, group = row[:keys], []
            group.append(row[keys:])
    if group:
        yield group


def _pairs(rows: list[tuple]) -> list[tuple]:
    """Rows of one group once each, by set_id."""
    return list({r[0]: r for r in rows}.values())


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), -1)


def _edge_batch(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*edges)], names=["u", "v"])


def _bucket_forest(percent: int, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for rows in _grouped(batches, 2):
            if len(rows) < 2:
                continue
            rows = _pairs(rows)
            out += [(rows[a][0], rows[b][0]) for a, b in forest(_matrix([r[2] for r in rows]), np.array([r[1] for r in rows]), percent, slack)]
            if len(out) > 50_000:
                yield _edge_batch(out)
                out = []
        if out:
            yield _edge_batch(out)

    return run


def _set_forest(percent: int, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for rows in _grouped(batches, 2):
            rows = _pairs(rows)
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            edges = forest(_matrix([r[2] for r in rows]), np.array([r[1] for r in rows]), percent, slack, jaccard_checker(sets, percent))
            out += [(rows[a][0], rows[b][0]) for a, b in edges]
            if len(out) > 50_000:
                yield _edge_batch(out)
                out = []
        if out:
            yield _edge_batch(out)

    return run


def _linked_to_hub(percent: int, slack: float, value: Broadcast | None):
    """Whether a row's full set (or, without one, its signature) links it to the hub of its group.

    Hubs come by key in a broadcast, or, where they are too many, with each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            flags = []
            for i in range(b.num_rows):
                n, sig, body = (column(c)[i].as_py() for c in ("n", "sig", "body"))
                hn, hsig, hbody = value.value[column("key")[i].as_py()] if value is not None else (column(c)[i].as_py() for c in ("hub_n", "hub_sig", "hub_body"))
                bodies = [np.frombuffer(x, np.uint64) for x in (hbody, body)] if body is not None else None
                check = jaccard_checker(bodies, percent) if bodies else None
                flags.append(bool(forest(_matrix([hsig, sig]), np.array([hn, n]), percent, slack, check)))
            keep = [c for c in b.schema.names if not c.startswith("hub_")]
            yield pa.RecordBatch.from_arrays([*(column(c) for c in keep), pa.array(flags, pa.bool_())], names=[*keep, "linked"])

    return run


def dealt(rows: DataFrame, percent: int, slack: float, block: int, name: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """rows (key, set_id, n, sig, body) with a block number, links found on the way, and what to release once both are read.

    No (key, block) has many over 2 * block rows or 2 * block_bytes of sets. In a key with
    more than half of that, every row is first compared with one of its rows, the hub. Rows
    linked to it need no comparison with each other; the rest may link to any row. Both are
    cut into blocks, and each block of the rest meets each other block of the rest and each
    block of linked rows (with the hub, which holds those together).
    """
    columns = ["key", "block", "set_id", "n", "sig", "body"]
    plain = rows.withColumn("block", F.lit(0).cast("bigint")).select(*columns)
    weight = F.sum(F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint"))
    many = (F.col("m") > block) | (F.col("b") > block_bytes)
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), weight.alias("b"), F.min("set_id").alias("hub")).where(many & (F.col("m") > 1)).select(F.col("key").alias("__key"), "hub")
    large = materialize(large, name)
    if large.isEmpty():
        release(large)
        return plain, None, []
    on = F.col("key") == F.col("__key")
    of_large = rows.join(large, on)
    hubs = of_large.where("set_id = hub").dropDuplicates(["key"]).select(F.col("key").alias("__hkey"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig"), F.col("body").alias("hub_body"))
    hubs = materialize(hubs, name)
    told, value = of_large.select("key", "set_id", "n", "sig", "body", "hub"), None
    if (hubs.agg(F.sum(F.coalesce(F.octet_length("hub_body"), F.lit(0)) + 300)).first()[0] or 0) <= HUB_BYTES:
        few = {bytes(r["__hkey"]): (r["hub_n"], bytes(r["hub_sig"]), None if r["hub_body"] is None else bytes(r["hub_body"])) for r in hubs.collect()}
        value = rows.sparkSession.sparkContext.broadcast(few)
    else:
        told = told.join(hubs, F.col("key") == F.col("__hkey")).drop("__hkey")
    fields = "key binary, set_id binary, n bigint, sig binary, body binary, hub binary, linked boolean"
    told = materialize(told.mapInArrow(wordcore.tidy(_linked_to_hub(percent, slack, value)), fields), name)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(weight / block_bytes)).cast("bigint")
    sizes = told.groupBy("key", "linked").agg(blocks.alias("blocks")).groupBy(F.col("key").alias("__key"))
    sizes = sizes.agg(F.max(F.when(F.col("linked"), F.col("blocks"))).alias("nc"), F.coalesce(F.max(F.when(~F.col("linked"), F.col("blocks"))), F.lit(0)).alias("nu"))
    mine = F.pmod(F.xxhash64("set_id"), F.when(F.col("linked"), F.col("nc")).otherwise(F.col("nu")))
    others, clusters = F.sequence(F.lit(0), F.col("nu") - 1), F.sequence(F.lit(0), F.col("nc") - 1)
    rest_rest = F.transform(others, lambda j: F.least(j, F.col("own")) * F.col("nu") + F.greatest(j, F.col("own")))
    cell = lambda c, u: F.col("nu") * F.col("nu") + c * F.col("nu") + u
    of_hub = F.flatten(F.transform(clusters, lambda c: F.transform(others, lambda u: cell(c, u))))
    which = F.when(F.col("set_id") == F.col("hub"), of_hub).when(F.col("linked"), F.transform(others, lambda u: cell(F.col("own"), u))).otherwise(F.concat(rest_rest, F.transform(clusters, lambda c: cell(c, F.col("own")))))
    spread = told.join(sizes, on).where("nu > 0").withColumn("own", mine).withColumn("block", F.explode(which)).select(*columns)
    links = told.where("linked AND set_id <> hub").select(F.col("hub").alias("u"), F.col("set_id").alias("v"))
    return plain.join(large.select("__key"), on, "left_anti").unionByName(spread), links, [large, hubs, told]


def _with_sets(words: int, lower: bool):
    schema = pa.schema([("key", pa.binary()), ("set_id", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in wordcore.word_batches(b.column(0), lower):
                part = b.slice(w.first_row, w.rows)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.tobytes() for s in shingle_sets(w, words)], pa.binary())], schema=schema)

    return run


def _components(rows: DataFrame, percent: int, slack: float, block: int, name: str, search: Callable) -> DataFrame:
    """node, label of the components of the links among the rows of each key, by a search within each block."""
    rows, links, held = dealt(rows, percent, slack, block, name)
    found = rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(wordcore.tidy(search), "u binary, v binary")
    out = connected_components(found if links is None else found.unionByName(links), name)
    release(*held)
    return out.select(F.col("node").alias("__node"), "label")


def _node() -> Column:
    """A class's name: whether its least id is null, that id, and its set, so the least node of a component has its least id."""
    number = F.lpad(F.hex(F.col("least_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    head = F.when(F.col("least_id").isNull(), F.lit("01" + "00" * 8)).otherwise(F.concat(F.lit("00"), number))
    return F.concat(F.unhex(head), F.col("set_id"))


def _least_id(node: Column) -> Column:
    """The id that a node begins with."""
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("bigint")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", number.bitwiseXOR(F.lit(-(2**63))))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.15, block: int = BLOCK
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, component, first for each row.

    Rows are linked when 100 * intersection >= percent * union of their distinct word
    shingles (words ASCII-lower-cased if lower); a text of fewer words is one shingle. A
    null text, or one without words, is linked with nothing and is its own component.
    component_id is the least id reachable (null only where no row of the component has an
    id) and kept tells the rows that have it; text_key is 128 bits of the text. component
    names the component apart from ids, which unlike rows may repeat (null where a row is
    alone in it), and first tells the rows of its least id and, at a tie, least shingle set.
    Rows that repeat an id and a text share their decision. Other columns are not read. An
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    with lifetime(docs.sparkSession) as keep:
        signed, named = _labelled(docs, words, percent, lower, id_col, text_col, slack, block)
        keep(signed, named)
    joined = signed.select("doc_id", F.col("key").alias("text_key"), "n_shingles", "set_id").join(named, F.col("set_id") == F.col("__set"), "left")
    component = F.when(F.col("__set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    first = F.col("component").isNull() | (kept & (F.col("set_id") == F.substring("component", 10, 16)))
    return joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), kept.alias("kept"), "component", first.alias("first"))


def _labelled(docs: DataFrame, words: int, percent: int, lower: bool, id_col: str, text_col: str, slack: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its set (and no bands), and the component of each set that has several rows or a link."""
    rows = repeats.keyed(docs, id_col, text_col)
    signed = materialize(rows.mapInArrow(wordcore.tidy(_sign(words, lower)), _SIGNED), "signed")
    full = signed.where("n_shingles > 0")
    # One text of each class of equal sets stands for it.
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("least_id"), F.min("key").alias("text_key"), F.count(F.lit(1)).alias("m"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialize(classes.select(_node().alias("node"), "text_key", "set_id", "m", "n", "bands", "sig"), "classes")
    bucketed = classes.select(F.explode(F.transform("bands", lambda x: x.cast("string").cast("binary"))).alias("key"), F.col("node").alias("set_id"), "n", "sig", F.lit(None).cast("binary").alias("body"))
    groups = _components(bucketed, percent, slack, block, "buckets", _bucket_forest(percent, slack))
    # Full sets of the texts that stand for classes with a candidate.
    chosen = classes.join(groups, F.col("node") == F.col("__node")).select(F.col("text_key").alias("__key"), F.col("label").alias("group"), F.col("node").alias("set_id"), "n", "sig")
    bodies = repeats.texts_of(rows).join(chosen.hint("shuffle_hash"), F.col("key") == F.col("__key")).select("text", "group", "set_id", "n", "sig")
    sets = materialize(bodies.mapInArrow(wordcore.tidy(_with_sets(words, lower)), "key binary, set_id binary, n bigint, sig binary, body binary"), "sets")
    components = _components(sets, percent, slack, block, "groups", _set_forest(percent, slack))
    release(sets)
    label = F.coalesce("label", "node")
    named = classes.join(components, F.col("node") == F.col("__node"), "left").where("m > 1 OR label IS NOT NULL").select(F.col("set_id").alias("__set"), label.alias("component"), _least_id(label).alias("component_id"))
    return signed, materialize(named, "named")


def unlike_rows(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without near-duplicates: of each component one row, that of the least id.

    Rows are told apart by id and text, so unlike texts that share an id are decided each
    for itself. A null id comes after all others; ties of the least id go to the least
    shingle set and then the least hash of the text, and of rows that repeat both id and
    text one stays. Null texts and those without words are linked with nothing and stay. All
    columns of the input are returned as they are, whatever their names. An empty table
    gives no rows.
    """
    return one_each(docs, near_duplicates(docs, words, percent, lower, id_col, text_col), id_col, text_col)
