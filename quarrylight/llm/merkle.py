"""Merkle manifest of a dataset: postorder logs written by aligned builders, proofs addressed by closed-form positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators.ranking import distributed_rank
from ..session import scratch_path, ship_package, spill

FAN = 16
# Levels that one builder makes: its block holds FAN ** LEVELS nodes of the level below.
LEVELS = 3
SIZE = 32  # bytes of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node(parts: list[bytes]) -> bytes:
    """Digest of digests: sha256 of their hex texts, one after the other."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def height(n: int, fan: int = FAN) -> int:
    """Levels above ``n`` nodes until one remains."""
    h = 0
    while n > 1:
        n, h = -(-n // fan), h + 1
    return h


def position(level, index, n: int, levels: int, fan: int = FAN):
    """Place of nodes in the postorder of a tree of ``n`` leaves and ``levels`` levels above them; arrays are taken too.

    Before a node stand all nodes of its own and lower levels up to its last leaf, and those of
    higher levels that ended before it: one division per level, no search.
    """
    index = np.asarray(index, np.int64)
    end = np.minimum((index + 1) * fan**level, n)
    place = np.full(index.shape, -1, np.int64)
    for low in range(levels + 1):
        place = place + (-(-end // fan**low) if low <= level else index // fan ** (low - level))
    return place


def postorder(digests: list[bytes], levels: int, fan: int = FAN) -> list[bytes]:
    """Nodes over ``digests`` in the order in which they are complete, the digests included."""
    log, waiting = [], [[] for _ in range(levels + 1)]

    def add(digest: bytes, level: int) -> None:
        log.append(digest)
        if level < levels:
            waiting[level].append(digest)
            if len(waiting[level]) == fan:
                done, waiting[level] = waiting[level], []
                add(node(done), level + 1)

    for digest in digests:
        add(digest, 0)
    for level in range(levels):
        if waiting[level]:
            done, waiting[level] = waiting[level], []
            add(node(done), level + 1)
    return log


def _block_levels(total: int, fan: int, levels: int) -> int:
    """A tree in several blocks needs each of them whole; one that fits a block ends at its root."""
    return levels if total > fan**levels else height(total, fan)


def _build(batches: Iterator[pa.RecordBatch], fan: int, levels: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted nodes (tree, block, index, total, digest, key, given) to a log segment per block."""
    held, now = [], None

    def segment():
        tree, block, total = now
        log = postorder([h[0] for h in held], _block_levels(total, fan, levels), fan)
        return {
            "tree": tree, "block": block, "total": total, "width": len(held), "nodes": b"".join(log), "top": log[-1],
            "keys": [h[1] for h in held], "given": [h[2] for h in held],
        }

    out = []
    for batch in batches:
        for tree, block, _, total, digest, key, given in zip(*[c.to_pylist() for c in batch.columns]):
            if (tree, block, total) != now:
                if held:
                    out.append(segment())
                held, now = [], (tree, block, total)
            held.append((digest, key, given))
        if len(out) >= 64:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        out.append(segment())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _segments(nodes: DataFrame, path: str, fan: int, levels: int) -> DataFrame:
    """Writes the log segments of ``nodes`` (tree, index, total, digest, key, given), a row per aligned block."""
    kind = nodes.schema["key"].dataType.simpleString()
    block = F.floor(F.col("index") / F.lit(fan**levels)).alias("block")
    dealt = nodes.select("tree", block, "index", "total", "digest", "key", "given").repartition("tree", "block")
    ddl = f"tree string, block long, total long, width int, nodes binary, top binary, keys array<{kind}>, given array<binary>"
    built = dealt.sortWithinPartitions("tree", "block", "index").mapInArrow(
        partial(_build, fan=fan, levels=levels, schema=_arrow(ddl)), ddl
    )
    built.write.parquet(path)
    return nodes.sparkSession.read.schema(built.schema).parquet(path)


def _tower(leaves: DataFrame, path: str, fan: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """All log segments of the trees over ``leaves``, lowest first, and (tree, top) of each tree.

    A round writes the segments of aligned blocks; their tops are the nodes of the next round, until every tree
    has one block left. Rounds grow as the logarithm of the largest tree to base ``fan ** levels``.
    """
    logs, tops, nodes = [], [], leaves
    while True:
        log = _segments(nodes, f"{path}/level={len(logs) * levels}", fan, levels)
        logs.append(log)
        many = F.col("total") > fan**levels
        tops.append(log.where(~many).select("tree", "top"))
        if log.where(many).isEmpty():
            break
        nodes = log.where(many).select(
            "tree", F.col("block").alias("index"), F.ceil(F.col("total") / F.lit(fan**levels)).alias("total"),
            F.col("top").alias("digest"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("given"),
        )
    done = tops[0]
    for more in tops[1:]:
        done = done.union(more)
    return logs, done


# Proofs


_STEPS = "array<struct<at: int, siblings: binary>>"


def _levels_of(width: int, levels: int, nodes: bytes, fan: int) -> list[list[bytes]]:
    """The digests of a block's log by level, each found at its position."""
    found = []
    for level in range(levels + 1):
        places = position(level, np.arange(-(-width // fan**level)), width, levels, fan)
        found.append([nodes[p * SIZE : (p + 1) * SIZE] for p in places.tolist()])
    return found


def _siblings(index: int, rows: list[list[bytes]], fan: int) -> list[tuple[int, bytes]]:
    """(own place in its run, the run's other digests) on every level of a block, from the node up."""
    steps = []
    for row in rows[:-1]:
        first = index // fan * fan
        steps.append((index - first, b"".join(row[first:index] + row[index + 1 : first + fan])))
        index //= fan
    return steps


def fold(digest: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The top that a digest and its siblings give."""
    for at, others in steps:
        digest = node([*_cut(others[: at * SIZE]), digest, *_cut(others[at * SIZE :])])
    return digest


def _cut(digests: bytes) -> list[bytes]:
    return [digests[i : i + SIZE] for i in range(0, len(digests), SIZE)]


def _steps_of(row) -> list[tuple[int, bytes]]:
    return [(s["at"], s["siblings"]) for s in row or ()]


def _paths(batches: Iterator[pa.RecordBatch], fan: int, levels: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments with the steps above them to (tree, index, steps) of each of their lowest nodes."""
    for batch in batches:
        for tree, block, total, width, nodes, above in zip(*[c.to_pylist() for c in batch.columns]):
            up = _steps_of(above)
            rows, out = _levels_of(width, _block_levels(total, fan, levels), nodes, fan), []
            for i in range(width):
                steps = _siblings(i, rows, fan) + up
                out.append({
                    "tree": tree, "index": block * fan**levels + i, "steps": [{"at": a, "siblings": s} for a, s in steps],
                })
            yield pa.RecordBatch.from_pylist(out, schema)


def _proofs(batches: Iterator[pa.RecordBatch], root: bytes, fan: int, levels: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Leaf segments with the steps above them to a row per leaf with its proof, folded from its given digest."""
    for batch in batches:
        for block, total, width, nodes, keys, given, above, subroot in zip(*[c.to_pylist() for c in batch.columns]):
            up, out = _steps_of(above), []
            rows = _levels_of(width, _block_levels(total, fan, levels), nodes, fan)
            tail = b"".join([s for _, s in up]).hex()
            for i in range(width):
                steps, leaf = _siblings(i, rows, fan), rows[0][i]
                proof = hashlib.sha256((b"".join([s for _, s in steps]).hex() + tail).encode()).hexdigest()
                folded = fold(given[i] or leaf, steps + up)
                out.append((keys[i], block * fan**levels + i, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def _with_steps(log: DataFrame, above: DataFrame) -> DataFrame:
    """``log`` with the steps above each block: ``above`` has (tree, index, steps) of blocks."""
    return log.join(above.withColumnRenamed("index", "block"), ["tree", "block"], "left")


# The manifest


def field(value: Column) -> Column:
    """A field as the leaf's digest takes it: ``-`` for null, else its bytes' count, a colon and its value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Digest of a row's fields, in order."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


class Manifest:
    """Log segments of all trees under ``path`` and the roots over them."""

    def __init__(self, path: str, logs: list[DataFrame], upper: list[DataFrame], sources: DataFrame, root: bytes, fan: int, levels: int):
        self.path, self.logs, self.upper, self.sources, self.root, self.fan, self.levels = path, logs, upper, sources, root, fan, levels

    def _down(self, logs: list[DataFrame], above: DataFrame) -> DataFrame:
        """(tree, index, steps) of the blocks of the lowest log, from the steps above the trees' roots."""
        run = partial(_paths, fan=self.fan, levels=self.levels, schema=_arrow(f"tree string, index long, steps {_STEPS}"))
        for log in reversed(logs[1:]):
            rows = _with_steps(log, above).select("tree", "block", "total", "width", "nodes", "steps")
            below = spill(rows.mapInArrow(run, f"tree string, index long, steps {_STEPS}"), "steps")
            # Trees of one block in the next log start there; the others go on from this one.
            known = below.select("tree").distinct()
            above = above.join(known, "tree", "left_anti").union(below)
        return above

    def proofs(self) -> DataFrame:
        """A row per leaf: ``key``, ``index`` (place in its tree), ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
        ``folded_root`` and ``verified``, all digests in lowercase hex.

        Each block's task addresses the siblings in its own segment by their positions; what stands
        above a block is joined to it once, so no leaf is shuffled.
        """
        spark = self.sources.sparkSession
        kind = self.logs[0].schema["keys"].dataType.elementType.simpleString()
        run = partial(_paths, fan=self.fan, levels=self.levels, schema=_arrow(f"tree string, index long, steps {_STEPS}"))
        # The tree over the subroots: steps above each of its blocks, then of each subroot.
        none = spark.createDataFrame([], f"tree string, index long, steps {_STEPS}")
        rows = _with_steps(self.upper[0], self._down(self.upper, none)).select("tree", "block", "total", "width", "nodes", "steps")
        over = rows.mapInArrow(run, f"tree string, index long, steps {_STEPS}").select("index", "steps")
        starts = spill(
            self.sources.join(over, self.sources["number"] == over["index"]).select("tree", F.lit(0).cast("long").alias("index"), "steps"),
            "steps",
        )
        log = _with_steps(self.logs[0], self._down(self.logs, starts))
        log = log.join(self.sources.select("tree", "subroot"), "tree")
        ddl = (
            f"key {kind}, index long, leaf string, subroot string, root string, proof_sha256 string,"
            " folded_root string, verified boolean"
        )
        columns = ["block", "total", "width", "nodes", "keys", "given", "steps", "subroot"]
        return log.select(*columns).mapInArrow(partial(_proofs, root=self.root, fan=self.fan, levels=self.levels, schema=_arrow(ddl)), ddl)


def build(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    tree_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    given: Column | None = None,
    fan: int = FAN,
    levels: int = LEVELS,
) -> Manifest | None:
    """Writes the manifest of ``docs`` under ``path`` (the shared folder if not given); None for an empty table.

    A row is a leaf, the digest of its ``fields``. The leaves of a ``tree_col`` value stand in order of ``id_col``
    (null first; rows of one id by digest, equal rows in any order, which gives the same digests). While a level has
    several nodes, each ``fan`` consecutive ones become one node of the next. The last node is
    the tree's subroot; subroots, by value (null first, then by UTF-8 bytes), are joined to the root
    in the same way. ``given`` is the digest that a proof is folded from (binary; null: the leaf itself).

    Texts are read once, for their digests; only digests are ranked and shuffled. A builder takes an aligned block of ``fan ** levels``
    nodes, so a tree of any size is dealt to many tasks, and appends nodes as they are complete: its log segment is
    one row, a node's place in it follows from sizes alone. Null and empty values differ. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, "merkle")
    named = [F.col(f"`{c}`") for c in fields]
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    leaves = spill(
        docs.select(
            tree.alias("tree"), F.col(f"`{id_col}`").alias("key"), leaf(named).alias("digest"),
            (F.lit(None) if given is None else given).cast("binary").alias("given"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "leaves",
    )
    sizes = spill(leaves.groupBy("tree").agg(F.count("*").alias("total")), "trees")
    if sizes.isEmpty():
        return None
    placed = distributed_rank(leaves, ["tree"], [F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")], "place")
    nodes = placed.join(sizes, "tree").select("tree", (F.col("place") - 1).alias("index"), "total", "digest", "key", "given")
    logs, tops = _tower(nodes, f"{path}/leaves", fan, levels)
    numbered = distributed_rank(tops.withColumn("all", F.lit(0)), ["all"], [F.col("tree")], "place")
    sources = spill(numbered.select("tree", (F.col("place") - 1).alias("number"), F.col("top").alias("subroot")), "subroots")
    n = sources.count()
    over = sources.select(
        F.lit("").alias("tree"), F.col("number").alias("index"), F.lit(n).cast("long").alias("total"), F.col("subroot").alias("digest"),
        F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("given"),
    )
    upper, root = _tower(over, f"{path}/sources", fan, levels)
    return Manifest(path, logs, upper, sources, bytes(root.first()["top"]), fan, levels)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_proofs(docs: DataFrame, every: int = 5, fields: tuple[str, ...] = FIELDS, **options) -> DataFrame:
    """Proofs of all rows, where every row whose id's CRC-32 ``every`` divides is folded from a tampered text.

    Tampering lower-cases A-Z in ``text``; a null text, and a null id, stay untampered. Rows as in :meth:`Manifest.proofs`,
    with ``doc_id`` for the key.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    changed = leaf([lower_ascii(F.col("text")) if c == "text" else F.col(f"`{c}`") for c in fields])
    manifest = build(docs, fields=fields, given=F.when(hit, changed), **options)
    if manifest is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        ddl = "index long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, {ddl}")
    return manifest.proofs().withColumnRenamed("key", "doc_id")
