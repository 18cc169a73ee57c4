"""Merkle manifest of a dataset in van Emde Boas layout (operator 13).

Every row is a leaf; the leaves of a source, in the order of their ids, are a tree whose
nodes have three children, and the roots of the sources are the leaves of one more tree. A tree is
cut into aligned blocks of ``height`` levels of edges: a block is one row of the manifest, its nodes
lie in one array of 32-byte digests in van Emde Boas order (a subtree is split at half its height,
the top half first, then the bottom halves one after another, each split in the same way).
The address arithmetic gives the places of a node's children when a block is built and of a node's
siblings when a proof is read. Roots of blocks are the leaves of the next round of
blocks, until one block is left; proofs are read in the opposite order, from the block of the root down.

A block holds at most 3 ** height leaves, so a task's memory does not grow with a source,
and a hot source is many blocks. Rows are numbered by a range partitioning and counts by partition.

Null fields are hashed as ``-``, a null id sorts first, a null source is a source of its own and
comes first. Repeated rows and equal ids are leaves of their own, equal ids in the order of their
digests. Extra columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perflog.llm.runtime import ready, stage

#: Children of a node.
FAN = 3
#: Edges between a block's root and its leaves.
HEIGHT = 8


# --- van Emde Boas layout ---------------------------------------------------------------------

def nodes_of(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN ** levels - 1) // (FAN - 1)


@cache
def layout(levels: int) -> tuple[np.ndarray, ...]:
    """Address of every node of a full tree, by depth and place in its level."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    above = levels // 2
    below = levels - above
    top, bottom = layout(above), layout(below)
    start = nodes_of(above) + np.arange(FAN ** above) * nodes_of(below)
    return top + tuple((start[:, None] + b[None, :]).ravel() for b in bottom)


def levels_for(leaves: int) -> int:
    """Levels of the smallest tree that takes ``leaves``."""
    n = 1
    while FAN ** (n - 1) < leaves:
        n += 1
    return n


def hashed(level: np.ndarray) -> np.ndarray:
    """Digests of the runs of ``FAN`` neighbours of a level (n x 32 bytes); the last run may be shorter."""
    text, step = level.tobytes().hex().encode(), 64 * FAN
    return np.frombuffer(b"".join(sha256(text[i:i + step]).digest() for i in range(0, len(text), step)), np.uint8).reshape(-1, 32)


def build_block(leaves: np.ndarray, levels: int) -> np.ndarray:
    """Array of a block over its leaves. Nodes that a full tree would have beyond them stay zero."""
    at, store = layout(levels), np.zeros((nodes_of(levels), 32), np.uint8)
    store[at[-1][:len(leaves)]] = leaves
    n = len(leaves)
    for depth in range(levels - 2, -1, -1):
        parents = hashed(store[at[depth + 1][:n]])
        n = len(parents)
        store[at[depth][:n]] = parents
    return store


def siblings(store: np.ndarray, levels: int, leaves: int) -> list[list[tuple[bytes, bytes]]]:
    """By depth from 1 on, for every node there: digests before and after it in its run, as hex text."""
    at, out = layout(levels), []
    for depth in range(1, levels):
        n = -(-leaves // FAN ** (levels - 1 - depth))
        text = store[at[depth][:n]].tobytes().hex().encode()
        ends = [min(n, i - i % FAN + FAN) * 64 for i in range(n)]
        out.append([(text[(i - i % FAN) * 64:i * 64], text[i * 64 + 64:ends[i]]) for i in range(n)])
    return out


# --- paths: one step a level, "before,after" in hex, from the leaf upwards ----------------------

def written(steps: Sequence[tuple[bytes, bytes]]) -> bytes:
    return b"".join(b"%b,%b;" % s for s in steps)


def read(path: bytes) -> list[tuple[bytes, bytes]]:
    return [tuple(s.split(b",")) for s in path.split(b";")[:-1]]


def fold(leaf: bytes, steps: Sequence[tuple[bytes, bytes]]) -> bytes:
    """Root that a leaf (hex text) leads to beside the siblings of its path."""
    for before, after in steps:
        leaf = sha256(before + leaf + after).hexdigest().encode()
    return leaf


def steps_of(below: list[list[tuple[bytes, bytes]]], i: int) -> list[tuple[bytes, bytes]]:
    """Steps of leaf ``i`` inside its block."""
    steps = []
    for level in reversed(below):
        steps.append(level[i])
        i //= FAN
    return steps


# --- trees as tables --------------------------------------------------------------------------

_BLOCKS = "__k string, __block long, __total long, __n long, __levels int, __top boolean, __nodes binary, __root binary"


def _build(height: int):
    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__rank")
        total, n = rows.column("__total")[0].as_py(), rows.num_rows
        leaves = np.frombuffer(b"".join(rows.column("__digest").to_pylist()), np.uint8).reshape(-1, 32)
        top = total <= FAN ** height
        levels = levels_for(n) if top else height + 1
        store = build_block(leaves, levels)
        return pa.table({"__k": pa.array([key[0].as_py()], pa.string()), "__block": pa.array([key[1].as_py()], pa.int64()),
                         "__total": pa.array([total], pa.int64()), "__n": pa.array([n], pa.int64()),
                         "__levels": pa.array([levels], pa.int32()), "__top": pa.array([top]),
                         "__nodes": pa.array([store.tobytes()], pa.binary()), "__root": pa.array([store[0].tobytes()], pa.binary())})
    return build


def _block(height: int) -> Column:
    return F.floor(F.col("__rank") / F.lit(FAN ** height)).cast("long").alias("__block")


def trees(nodes: DataFrame, largest: int, height: int) -> list[DataFrame]:
    """Blocks of the trees of all keys, a table by round; ``nodes``: __k, __rank, __digest, __total.

    ``largest``: leaves of the largest tree, which settles the number of rounds."""
    rounds = []
    while True:
        blocks = stage(nodes.groupBy("__k", _block(height)).applyInArrow(_build(height), _BLOCKS), "merkle-blocks")
        rounds.append(blocks)
        if largest <= FAN ** height:
            return rounds
        largest = -(-largest // FAN ** height)
        nodes = blocks.where("not __top").select(
            "__k", F.col("__block").alias("__rank"), F.col("__root").alias("__digest"),
            F.ceil(F.col("__total") / F.lit(FAN ** height)).cast("long").alias("__total"))


def _members(batches):
    """Of every block with the path of its root: the paths of its leaves, which are roots of blocks of the round before."""
    for b in batches:
        for r in b.to_pylist():
            below = siblings(np.frombuffer(r["__nodes"], np.uint8).reshape(-1, 32), r["__levels"], r["__n"])
            first = r["__block"] * r["__width"]
            yield pa.RecordBatch.from_pylist(
                [{"__k": r["__k"], "__block": first + i, "__path": written(steps_of(below, i)) + r["__path"],
                  "__subroot": r["__subroot"], "__whole": r["__whole"]} for i in range(r["__n"])],
                schema=pa.schema([("__k", pa.string()), ("__block", pa.int64()), ("__path", pa.binary()),
                                  ("__subroot", pa.binary()), ("__whole", pa.binary())]))


def with_paths(rounds: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """First-round blocks with the path of their root. ``tops``: __k, __path, __subroot, __whole of every tree."""
    above = None
    for blocks in reversed(rounds):
        known = blocks.where("__top").join(tops, "__k")
        if above is not None:
            known = known.unionByName(blocks.where("not __top").join(above, ["__k", "__block"]))
        if blocks is rounds[0]:
            return known
        above = known.withColumn("__width", F.lit(FAN ** height).cast("long")).mapInArrow(
            _members, "__k string, __block long, __path binary, __subroot binary, __whole binary")


def numbered(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, int]:
    """``rows`` with __rank (from 0, in ``order``) and __total by __k, and the largest __total.

    Rows are dealt by ranges of (__k, order), so equal neighbours apart from ``order`` are split too;
    the place in a partition is added to the rows of the key in the partitions before."""
    order = [F.col("__k"), *order]
    schema = rows.schema.names

    def place(batches):
        from pyspark import TaskContext
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            keys, local = b.column("__k").to_pylist(), np.empty(b.num_rows, np.int64)
            for i, k in enumerate(keys):
                count = count + 1 if k == last else 0
                last, local[i] = k, count
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(local)],
                                             [*schema, "__part", "__local"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        place, f"{kinds}, __part int, __local long"), "merkle-order")
    counts = placed.groupBy("__k", "__part").agg(F.count("*").alias("__c"))
    w = Window.partitionBy("__k").orderBy("__part")
    bases = counts.select("__k", "__part", (F.sum("__c").over(w) - F.col("__c")).alias("__base"),
                          F.sum("__c").over(Window.partitionBy("__k")).alias("__total"))
    largest = bases.agg(F.max("__total")).first()[0] or 0
    ranked = placed.join(bases, ["__k", "__part"]).withColumn("__rank", F.col("__base") + F.col("__local"))
    return ranked.drop("__part", "__local", "__base"), largest


# --- the dataset ------------------------------------------------------------------------------

def field(c: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its UTF-8 length, a colon and itself."""
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in values]), 256))


@dataclass
class Manifest:
    """Tables of a dataset's trees: its leaves by rank, and blocks by round of the sources' trees and of the tree over the sources."""

    leaves: DataFrame
    blocks: list[DataFrame]
    over: list[DataFrame]
    sources: DataFrame
    height: int


def build_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                   id_col: str = "doc_id", source_col: str = "source", carry: dict[str, Column] | None = None,
                   height: int = HEIGHT) -> Manifest:
    """Hash every row and build all trees. ``carry``: further columns of the leaves (named with __)."""
    ready(docs.sparkSession)
    col = {c: F.col(f"`{c}`") for c in (*fields, id_col, source_col)}
    source = col[source_col].cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), source), F.lit("-")).alias("__k"), col[id_col].alias("__id"),
        digest([col[c] for c in fields]).alias("__digest"), *[c.alias(n) for n, c in (carry or {}).items()])
    leaves = stage(leaves.withColumn("__uid", F.monotonically_increasing_id()), "merkle-leaves")
    ranked, largest = numbered(leaves, [F.col("__id").asc_nulls_first(), F.col("__digest"), F.col("__uid")])
    ranked = ranked.drop("__uid")
    blocks = trees(ranked.select("__k", "__rank", "__digest", "__total"), largest, height)
    tops = blocks[0].where("__top")
    for b in blocks[1:]:
        tops = tops.unionByName(b.where("__top"))
    sources = tops.select(F.lit("").alias("__k"), F.col("__k").alias("__source"), F.col("__root").alias("__digest"))
    sources, n = numbered(sources, [F.col("__source")])
    return Manifest(ranked, blocks, trees(sources.select("__k", "__rank", "__digest", "__total"), n, height), sources, height)


def paths(m: Manifest) -> DataFrame:
    """First-round blocks of the sources with the path of their root to the dataset's root."""
    root = m.over[-1].select("__k", F.lit(b"").alias("__path"), F.lit(None).cast("binary").alias("__subroot"), F.col("__root").alias("__whole"))
    over = with_paths(m.over, root, m.height).withColumn("__width", F.lit(FAN ** m.height).cast("long")).mapInArrow(
        _members, "__k string, __block long, __path binary, __subroot binary, __whole binary")
    tops = m.sources.join(over.withColumnRenamed("__block", "__rank"), ["__k", "__rank"]).select(
        F.col("__source").alias("__k"), "__path", F.col("__digest").alias("__subroot"), "__whole")
    return with_paths(m.blocks, tops, m.height)


def prove(m: Manifest, claimed: str, id_col: str = "doc_id") -> DataFrame:
    """For every leaf: leaf, subroot, root, proof_sha256 and what the leaf in column ``claimed`` (or, where that
    is null, the leaf itself) leads to beside the stored siblings: folded_root, verified."""
    kind = m.leaves.schema["__id"].dataType.simpleString()
    names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    width = FAN ** m.height

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, block: pa.Table) -> pa.Table:
        b = block.to_pylist()[0]
        below = siblings(np.frombuffer(b["__nodes"], np.uint8).reshape(-1, 32), b["__levels"], b["__n"])
        upper = read(b["__path"])
        beyond = b"".join(x + y for x, y in upper)
        subroot, root = b["__subroot"].hex(), b["__whole"].hex()
        leaf = [x.hex() for x in rows.column("__digest").to_pylist()]
        proof, folded = [], []
        for i, own, other in zip(rows.column("__rank").to_pylist(), leaf, rows.column("__claimed").to_pylist()):
            steps = steps_of(below, i % width)
            proof.append(sha256(b"".join(x + y for x, y in steps) + beyond).hexdigest())
            folded.append(fold(fold(own.encode() if other is None else other.hex().encode(), steps), upper).decode())
        n = len(leaf)
        return pa.table([rows.column("__id"), leaf, [subroot] * n, [root] * n, proof, folded, [x == root for x in folded]], names)

    rows = m.leaves.select("__k", _block(m.height), "__rank", "__id", "__digest", F.col(claimed).alias("__claimed"))
    return rows.groupBy("__k", "__block").cogroup(paths(m).groupBy("__k", "__block")).applyInArrow(
        run, f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """Proofs of all rows, checked after a tampering: rows whose id has an even crc32 lose the line feeds of their text."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    without = {c: F.col(f"`{c}`") for c in fields} | {text_col: F.replace(F.col(f"`{text_col}`"), F.lit("\n"), F.lit(""))}
    hit = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(hit, digest([without[c] for c in fields]))
    return prove(build_manifest(docs, fields, id_col, carry={"__tampered": tampered}, height=height), "__tampered", id_col)
