"""Jaccard join of word-shingle sets by a grouped prefix join (operator 7).

A set is ordered by a global order of its shingles: those that a corpus-wide count sketch
holds frequent come last, by level, the rest by hash. Its prefix is the first quarter.
Documents of equal sets are one class; classes with equal prefix and size are one group and
emit the prefix once. Shingles of one group only are dropped. A group that keeps too few
shared shingles to reach the threshold with any partner is dropped as well, since two sets
of similarity t have at least t * larger - (rest of the set whose prefix ends first)
prefix shingles in common. Neighbours and the first of each remaining posting list are
candidate group pairs, expanded to their members and verified on the full sets; links give
components. Then classes of different components that shared shingles connect, directly or not,
or that are one group, are a family. Families are cut into blocks by size; each two blocks near in size meet, pairs of different
components are filtered by bounds from parity bitmaps of their sets, and verified on the full sets, so no link between
components is lost, while copies within a component need not meet in pairs.

Frequent shingles go by an aggregate and a split join, all others have bounded lists. Links
and components stay distributed (bounded shares of the edges, then rounds of large-star and small-star on stored edges).

Null and empty texts have empty sets, no links, and their own id as component. Fewer words
than a shingle are one shingle. Equal ids are documents of their own; a null id is never a
component's number unless all of its ids are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perflog.llm.runtime import bitmap, chunks, few, has_bit, pow2, ready, stage, text_hash, utf8
from perflog.llm.window_dedup import gaps, ungaps
from perflog.llm.words import LOWER, SPACE, U, Words, mix

COUNTERS = 1 << 22
#: Share of a set that is its prefix, in percent (20 would do for similarity 0.8; more shared shingles prune groups).
PREFIX = 25
#: Classes in a block of a family; keys in a block, and in a bundle of meetings (a byte of map each at most).
BLOCK, BLOCK_KEYS, BUNDLE_KEYS = 2048, 1 << 20, 1 << 22
#: Rows of a meeting that are compared with all others at once.
STRIP = 256
#: Edges (of 16 bytes) that a task joins into components of their own before any rounds.
EDGES = 1 << 18
#: Numbers that a task remembers to emit most groups but once.
REMEMBERED = 1 << 20
#: Ranges of counters that the sketch is dealt by, and shingles that a task gathers before it sends a part.
RANGES, GATHER = 64, 4 << 20


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def shingle_chunks(data: np.ndarray, offs: np.ndarray, k: int):
    """Ranges of rows with the shingle hashes of each row (not yet different ones) and their edges."""
    for lo, hi in chunks(offs):
        w = Words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], SPACE, LOWER)
        at, h = w.windows(k)
        row = w.row[at]
        few = np.flatnonzero((w.count > 0) & (w.count < k))
        if len(few):  # the whole sequence is the one shingle
            row, h = np.concatenate([row, few]), np.concatenate([h, w.whole(few)])
            order = np.argsort(row, kind="stable")
            row, h = row[order], h[order]
        yield lo, hi, h, np.searchsorted(row, np.arange(hi - lo + 1))


def levels(docs: DataFrame, k: int) -> np.ndarray:
    """Level of every counter of a one-row count sketch over all shingles: 0, or log2 of a count clearly above chance.

    Counters are dealt by ranges, so no row holds more than a range and no task more than two of them; the
    driver gets the sums, whose number is fixed."""
    width = COUNTERS // RANGES

    def parts(batches):
        held, size = [], 0

        def flush():
            s, n = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(s, np.arange(RANGES + 1) * width)
            for r, a, b in zip(range(RANGES), edge[:-1], edge[1:]):
                if a < b:
                    x, c = s[a:b] - r * width, n[a:b]
                    many = c > 1
                    yield r, gaps(x), gaps(x[many]), (c[many] - 1).astype("<u4").tobytes()

        def batch():
            cols = list(zip(*flush()))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["range", "once", "again", "more"])

        for b in batches:
            data, offs = utf8(b.column(0))
            for _, _, h, _ in shingle_chunks(data, offs, k):
                if len(h):
                    held.append(slot(h))
                    size += len(h)
                if size >= GATHER:
                    yield batch()
                    held, size = [], 0
        if size:
            yield batch()

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(width, np.int64)
        for b in batches:
            for once, again, more in zip(*(b.column(b.schema.get_field_index(c)) for c in ("once", "again", "more"))):
                acc[ungaps(once.as_buffer())] += 1
                acc[ungaps(again.as_buffer())] += np.frombuffer(more.as_buffer(), "<u4")
        # a count beyond 32 bits is as frequent as one of 32 bits
        yield pa.RecordBatch.from_pydict({"range": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([np.minimum(acc, 2 ** 32 - 1).astype("<u4").tobytes()], pa.binary())})

    count, out = {}, np.zeros(COUNTERS, np.uint8)
    for r in docs.select("__text").mapInArrow(parts, "range int, once binary, again binary, more binary").groupBy("range").applyInArrow(
            add, "range int, n binary").toLocalIterator():
        count[r.range] = np.frombuffer(bytes(r.n), "<u4")
    least = 16 + 2 * sum(int(n.sum(dtype=np.int64)) for n in count.values()) / COUNTERS
    for r, n in count.items():
        often = np.flatnonzero(n >= least)
        out[r * width + often] = np.log2(n[often]).astype(np.uint8)
    return out


class Met:
    """Numbers met lately, in a table of fixed size: a later one may push one out, which is then taken for new."""

    def __init__(self):
        self.table = np.zeros(REMEMBERED, np.int64)

    def new(self, x: int) -> bool:
        at = (x ^ (x >> 31)) & (REMEMBERED - 1)
        if self.table[at] == x:
            return False
        self.table[at] = x
        return True


def ordered(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Different shingles as sorted keys: level, then hash."""
    x = np.sort((level[slot(h)].astype(U) << U(56)) | (h >> U(8)))
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def set_id(keys: np.ndarray) -> int:
    """Order-free 64-bit number of a set."""
    return int(mix(np.array([np.add.reduce(mix(keys)) + U(len(keys))], U)).view(np.int64)[0])


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps, byte by byte of all of them: the high bytes are mostly zero, which shuffles and tables compress away."""
    return np.ascontiguousarray(np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def prefix_size(n: int) -> int:
    return min(n, n * PREFIX // 100 + 1)


def figures(docs: DataFrame, k: int, level, kinds: str, names: list[str]) -> DataFrame:
    """Columns of every row with n (set size), c (class), g (group: prefix and size) and the prefix's frequent shingles."""

    def run(batches):
        lev = level.value
        for b in batches:
            data, offs = utf8(b.column(b.num_columns - 1))
            n, c, g, often = [], [], [], []
            for lo, hi, h, cut in shingle_chunks(data, offs, k):
                for i in range(hi - lo):
                    x = ordered(h[cut[i]:cut[i + 1]], lev)
                    p = x[:prefix_size(len(x))]
                    n.append(len(x))
                    c.append(set_id(x) if len(x) else 0)
                    g.append(set_id(np.append(p, U(len(x)))) if len(x) else 0)
                    often.append(p[p >> U(56) > 0].view(np.int64))
            if n:
                size = np.cumsum([0, *map(len, often)])
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(n, pa.int32()), pa.array(c, pa.int64()), pa.array(g, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(often)))],
                    [*names, "n", "c", "g", "often"])

    return docs.mapInArrow(run, kinds + ", n int, c long, g long, often array<long>")


def postings(docs: DataFrame, k: int, level) -> DataFrame:
    """tok, g and n for the prefix shingles at level 0 of every group, once per task."""

    def run(batches):
        lev, met = level.value, Met()
        for b in batches:
            data, offs = utf8(b.column(0))
            for lo, hi, h, cut in shingle_chunks(data, offs, k):
                tok, g, n = [], [], []
                for i in range(hi - lo):
                    x = ordered(h[cut[i]:cut[i + 1]], lev)
                    if not len(x):
                        continue
                    p = x[:prefix_size(len(x))]
                    group = set_id(np.append(p, U(len(x))))
                    if not met.new(group):
                        continue
                    p = p[p >> U(56) == 0]
                    tok.append(p)
                    g.append(np.full(len(p), group, np.int64))
                    n.append(np.full(len(p), len(x), np.int32))
                if tok:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.concatenate(g)),
                                                      pa.array(np.concatenate(n))], ["tok", "g", "n"])

    return docs.select("__text").mapInArrow(run, "tok long, g long, n int")


def near_size(a: str, b: str, t: int) -> Column:
    return (100 * F.least(a, b).cast("long") >= t * F.greatest(a, b).cast("long"))


def full_sets(docs: DataFrame, rows: DataFrame, ends: DataFrame, k: int, level, short: bool = False) -> DataFrame:
    """c and keys (the full ordered set, packed; its parity map if ``short``) of the classes in ``ends`` (c). Only texts of those classes are
    made sets again."""
    spark = docs.sparkSession
    texts = stage(few(rows.join(ends, "c").groupBy("c").agg(F.min("__th").alias("th"))), "ends")
    bits = spark.sparkContext.broadcast(bitmap(texts, "th", pow2(32 * max(1, texts.count()), 1 << 16, 1 << 28)))

    def sets(batches):
        lev, may, met = level.value, bits.value, Met()
        for b in batches:
            hit = has_bit(may, b.column(0).to_numpy(zero_copy_only=False))
            data, offs = utf8(b.column(1).filter(pa.array(hit)))
            for lo, hi, h, cut in shingle_chunks(data, offs, k):
                c, blob = [], []
                for i in range(hi - lo):
                    x = ordered(h[cut[i]:cut[i + 1]], lev)
                    this = set_id(x) if len(x) else 0
                    if len(x) and met.new(this):
                        c.append(this)
                        blob.append(parity_map(x) if short else packed(x))
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(blob, pa.binary())], ["c", "keys"])

    found = docs.select("__th", "__text").mapInArrow(sets, "c long, keys binary")
    return found.join(ends, "c", "left_semi").groupBy("c").agg(F.first("keys").alias("keys"))


def verify(docs: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, t: int, level) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the similarity. The sets are dealt by class once: both joins read that shuffle."""
    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    found = full_sets(docs, rows, ends, k, level)

    def compare(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= t * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    both = (pairs.join(found.select(F.col("c").alias("a"), F.col("keys").alias("x")), "a")
            .join(found.select(F.col("c").alias("b"), F.col("keys").alias("y")), "b").select("a", "b", "x", "y"))
    return both.mapInArrow(compare, "a long, b long")


def parity_map(keys: np.ndarray) -> bytes:
    """The set as bits: a bit is set where an odd number of keys falls on it. Two maps differ in at most as many bits as their
    sets differ in keys. There are four bits a key at least, a power of two in all."""
    size = max(9, int(4 * len(keys) - 1).bit_length())
    return np.packbits(np.bincount((mix(keys) >> U(64 - size)).astype(np.int64), minlength=1 << size) & 1).tobytes()


def block_links(ids: np.ndarray, parts: np.ndarray, n: np.ndarray, maps: list[bytes], second: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Pairs of classes of different components that may reach the similarity: of two blocks (``second`` tells which), or within one.

    What two sets share is bounded by their sizes and by the bits in which their maps differ, first on maps that are folded to an
    eighth and for STRIP rows with all others at once, then on whole maps for the pairs left. The bound only errs upwards, so no link is lost."""
    order = np.argsort(second, kind="stable")
    ids, parts, n, maps = ids[order], parts[order], n[order].astype(np.int64), [np.frombuffer(maps[i], np.uint8) for i in order]
    cut = int((~second).sum()) if second.any() else 0
    rows, rest = cut or len(ids), slice(cut, None)
    width = min(map(len, maps)) * 8
    bits = np.zeros((len(maps), width), np.uint8)
    for i, x in enumerate(maps):
        x = np.unpackbits(x)
        while len(x) > width:  # neighbours fall together
            x = x[0::2] ^ x[1::2]
        bits[i] = x

    def reach(total, differ):
        most = (total - differ) // 2
        return 100 * most >= t * (total - most)

    few = bits
    while few.shape[1] > max(512, width // 8):
        few = few[:, 0::2] ^ few[:, 1::2]
    few = 1 - 2 * few.astype(np.float32)
    whole = np.packbits(bits, axis=1)
    step = max(1, (1 << 24) // whole.shape[1])
    out = []
    for lo in range(0, rows, STRIP):
        strip = slice(lo, min(rows, lo + STRIP))
        may = (parts[strip, None] != parts[None, rest]) & (
            100 * np.minimum(n[strip, None], n[None, rest]) >= t * np.maximum(n[strip, None], n[None, rest]))
        if not cut:
            may = np.triu(may, 1 + lo)
        if not may.any():
            continue
        may &= reach(n[strip, None] + n[None, rest], ((few.shape[1] - few[strip] @ few[rest].T) / 2).astype(np.int64))
        i, j = np.nonzero(may)
        i, j = i + lo, j + cut
        for at in range(0, len(i), step):
            x, y = i[at:at + step], j[at:at + step]
            ok = reach(n[x] + n[y], np.bitwise_count(whole[x] ^ whole[y]).sum(axis=1, dtype=np.int64))
            out += zip(ids[x[ok]].tolist(), ids[y[ok]].tolist())
    return out


def meetings(nodes: DataFrame, t: int) -> DataFrame:
    """c, n, part, at (a meeting of two blocks, or of one with itself), second and bundle of every class in every meeting, from nodes
    (family, part, c, n).

    A family of any size is cut into blocks of about BLOCK classes of like size and BLOCK_KEYS keys, large components apart from
    others; every two blocks near in size meet, but not two of one component. Bundles hold two blocks of rows on average, and
    no more than about BUNDLE_KEYS keys."""
    # sizes of which one is ``t`` percent of the other at least are in the same or neighbouring classes
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / t + 1e-9))).cast("int")
    nodes = nodes.withColumn("step", step)
    room = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_KEYS)
    size = nodes.groupBy("family", "step", "part").agg(room.alias("m"))
    size = size.withColumn("large", F.col("m") >= 1)
    small = size.where("not large").groupBy("family", "step").agg(F.sum("m").alias("all"))
    h = F.xxhash64(F.lit(21), F.when(F.col("large"), F.col("c")).otherwise(F.col("part")))
    ways = F.ceil(F.when(F.col("large"), F.col("m")).otherwise(F.col("all")))
    nodes = nodes.join(size, ["family", "step", "part"]).join(small, ["family", "step"], "left").withColumn(
        "block", F.struct("step", F.when(F.col("large"), F.col("part")).alias("own"), F.pmod(h, ways).alias("way")))
    nodes = stage(nodes.select("family", "part", "c", "n", "block"), "blocks")
    blocks = nodes.select("family", "block").distinct()
    one, two = blocks.select("family", F.col("block").alias("x")), blocks.select("family", F.col("block").alias("y"))
    meet = one.join(two, "family").where((F.col("x") <= F.col("y")) & (F.col("y.step") - F.col("x.step") <= 1)
                                         & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False)))
    meet = meet.withColumn("at", F.xxhash64("family", "x", "y"))
    roles = meet.select("family", "at", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(False).alias("second"))))
                                                  .otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(False).alias("second")),
                                                                     F.struct(F.col("y").alias("block"), F.lit(True).alias("second"))))).alias("r"))
    roles = roles.select("family", "at", "r.block", "r.second")
    # many small meetings share a task's group; what is sent, not the number of classes, sets how many groups there are
    sizes = nodes.groupBy("family", "block").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("keys"))
    sent, keys = roles.join(sizes, ["family", "block"]).agg(F.sum("m"), F.sum("keys")).first()
    bundles = max(1, -(-(sent or 0) // (2 * BLOCK)), -(-(keys or 0) // BUNDLE_KEYS))
    return nodes.join(roles, ["family", "block"]).select("c", "n", "part", "at", "second", F.pmod("at", F.lit(bundles)).alias("bundle"))


def verify_families(docs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, t: int, level) -> DataFrame:
    """Pairs (a, b) of classes of different components of one family that may be links, from nodes (family, part, c, n), still to be
    verified on full sets; the blocks of every meeting are compared in a task by their sets' maps."""
    sent = meetings(nodes, t).join(full_sets(docs, rows, nodes.select("c").distinct(), k, level, short=True), "c")

    def go(key, table):
        table = table.sort_by("at")
        at = table.column("at").to_numpy()
        c, n, part, second = (table.column(x).to_numpy() for x in ("c", "n", "part", "second"))
        maps = table.column("keys").to_pylist()
        out = []
        for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]]))):
            out += block_links(c[lo:hi], part[lo:hi], n[lo:hi], maps[lo:hi], second[lo:hi].astype(bool), t)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return sent.groupBy("bundle").applyInArrow(go, "a long, b long")


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every different node of the edges, and the least node of its component: roots are hooked to lesser ones, then trees are made flat."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = at[:len(u)], at[len(u):], np.arange(len(node))
    while True:
        x, y = least[a], least[b]
        open_ = x != y
        if not open_.any():
            return node, node[least]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != (up := least[least])).any():
            least = up


def forest(e: DataFrame, parts: int) -> DataFrame:
    """u, v: for every node of each of ``parts`` even shares of the edges, the least node that the share joins it to."""

    def go(table):
        node, least = least_nodes(table.column("u").to_numpy(), table.column("v").to_numpy())
        more = node != least
        return pa.table({"u": node[more], "v": least[more]})

    return e.groupBy(F.pmod(F.xxhash64("u", "v"), F.lit(parts)).alias("share")).applyInArrow(go, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of ``edges`` (a, b): shares of bounded size by themselves, then, where there are
    several, rounds of large-star and small-star. So few edges need one query, not a dozen plans that the driver keeps."""
    e = stage(few(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()), "edges")
    parts = max(1, -(-e.count() // EDGES))
    e = stage(forest(e, parts) if parts == 1 else few(forest(e, parts).distinct()), "edges")
    while parts > 1:
        # done when every node points to one other, which points to none
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
            e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out + in > 1 and out > 0").isEmpty():
            break
        # large star: greater neighbours of a node go to the least one around it
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = stage(few(small.select("e.u", "e.v").where("u != v").distinct()), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
         extra: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, n_shingles, component_id, component (its number, 0 for empty sets) of every row (and columns named in ``extra``): sets of ``k``-word shingles, ASCII letters
    in lower case, are linked where 100 * intersection >= ``percent`` * union (``percent`` of at least 80)."""
    if percent < 80:
        raise ValueError("the prefix of a quarter holds for 80 percent and more")
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("__id"), *extra, text_hash(F.col(text_col)).alias("__th"), F.col(text_col).alias("__text"))
    kinds = docs.drop("__text").schema
    level = spark.sparkContext.broadcast(levels(docs, k))
    rows = stage(figures(docs, k, level, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), [f.name for f in kinds]), "figures")
    classes = rows.where("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.first("g").alias("g"), F.min("__id").alias("least"))
    members = stage(classes.select("c", "n", "g"), "classes")

    # posting lists of shingles that two groups share
    tok = Window.partitionBy("tok")
    light = (postings(docs, k, level).withColumns({"lo": F.min("g").over(tok), "hi": F.max("g").over(tok)})
             .where("lo != hi").select("tok", "g", "n").dropDuplicates(["tok", "g"]))
    heavy = rows.where(F.size("often") > 0).groupBy("g").agg(F.first("n").alias("n"), F.first("often").alias("often")).select(
        F.explode("often").alias("tok"), "g", "n")
    often = heavy.groupBy("tok").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("tok")
    lists = stage(light.unionByName(heavy.join(often, "tok").select("tok", "g", "n")), "lists")
    # t * m - (m - m // 4 - 1) shingles at least are shared with a partner, m being the larger size; n is m or less
    alive = lists.groupBy("g").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")).where(
        100 * F.col("shared") >= (percent + PREFIX - 100) * F.col("n") + 25).select("g")
    lists = stage(lists.join(alive, "g"), "alive")

    # candidates: neighbours of a posting list by size, the first that is near in size, and a group's own members
    order = Window.partitionBy("tok").orderBy("n", "g")
    near = lists.select("g", "n", F.lag("g").over(order).alias("g1"), F.lag("n").over(order).alias("n1"),
                        F.first("g").over(order).alias("g2"), F.first("n").over(order).alias("n2"))
    near = near.select("g", "n", F.explode(F.array(F.struct(F.col("g1").alias("g"), F.col("n1").alias("n")),
                                                   F.struct(F.col("g2").alias("g"), F.col("n2").alias("n")))).alias("o")).where(
        F.col("o.g").isNotNull() & (F.col("o.g") != F.col("g")) & near_size("n", "o.n", percent))
    group_pairs = near.select(F.least("g", "o.g").alias("ga"), F.greatest("g", "o.g").alias("gb")).distinct()
    first = members.groupBy("g").agg(F.min("c").alias("first"))
    pairs = (group_pairs.join(first.select(F.col("g").alias("ga"), F.col("first").alias("a")), "ga")
             .join(first.select(F.col("g").alias("gb"), F.col("first").alias("b")), "gb").select("a", "b"))
    own = members.join(first, "g").where("c != first").select(F.col("first").alias("a"), F.col("c").alias("b"))
    pairs = stage(few(pairs.unionByName(own)), "pairs")
    edges = stage(few(verify(docs, rows, pairs, k, percent, level)), "links")
    found = components(edges)

    # what is left: members of different components in one family, that is, groups that shared shingles connect, or one group by itself
    part = members.join(found, F.col("c") == F.col("node"), "left").select("c", "n", "g", F.coalesce("component", "c").alias("part"))
    family = components(lists.join(lists.groupBy("tok").agg(F.min("g").alias("b")), "tok").select(F.col("g").alias("a"), "b").distinct())
    nodes = part.join(family.select(F.col("node").alias("g"), F.col("component").alias("family")), "g", "left").withColumn(
        "family", F.coalesce("family", "g"))
    mixed = nodes.groupBy("family").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("family")
    nodes = stage(few(nodes.join(mixed, "family").select("family", "part", "c", "n")), "nodes")
    more = stage(few(verify_families(docs, rows, nodes, k, percent, level).distinct()), "across")
    more = stage(few(verify(docs, rows, more, k, percent, level)), "more")
    # links join whole components: only their numbers go through another round
    named = found.select(F.col("node"), F.col("component"))
    joins = (more.join(named.select(F.col("node").alias("a"), F.col("component").alias("pa")), "a", "left")
             .join(named.select(F.col("node").alias("b"), F.col("component").alias("pb")), "b", "left")
             .select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")))
    last = components(joins)
    found = (part.select(F.col("c").alias("node"), "part").join(last.select(F.col("node").alias("part"), "component"), "part", "left")
             .select("node", F.coalesce("component", "part").alias("component")))


    of = classes.select("c", "least").join(found, F.col("c") == F.col("node"), "left").select("c", "least", F.coalesce("component", "c").alias("part"))
    least = of.groupBy("part").agg(F.min("least").alias("component_id"))
    of = of.join(least, "part").select(F.col("c").alias("__c"), "component_id", F.col("part").alias("component"))
    out = rows.join(of, F.col("c") == F.col("__c"), "left")
    return out.select(F.col("__id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__id")).alias("component_id"),
                      F.coalesce("component", F.lit(0)).cast("long").alias("component"), *extra)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (nulls last), then text hash; of equal rows, one.
    Texts without words are kept."""
    docs = docs.withColumn("__h", text_hash(F.col(text_col)))
    verdict = stage(link(docs, id_col, text_col, k, percent, ("__h",)).where("n_shingles > 0").select(F.col(id_col).alias("__i"), "__h", "component"), "verdict")
    # null ids go last
    rank = F.struct(F.col("__i").isNull().alias("none"), F.coalesce(F.col("__i"), F.lit(0)).alias("i"), F.col("__h").alias("h"))
    groups = verdict.groupBy("component").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    found = verdict.join(groups, "component").select("__i", F.col("__h").alias("__g"), (rank == F.col("best")).alias("stays"))
    found = stage(found.groupBy("__i", "__g", "stays").agg(F.count(F.lit(1)).alias("rows")), "copies")
    same = F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__g"))
    kept = docs.join(stage(found.where("not stays").select("__i", "__g"), "gone"), same, "left_anti")
    again = stage(found.where("stays and rows > 1").select("__i", "__g"), "again")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, "__h"]))
    return kept.drop("__h")
