"""Best-fit packing by a grouping genetic algorithm on islands (operator 2).

Every document becomes token ids plus an end id and is cut into pieces of the sequence
length only if it is longer. Pieces shorter than a sequence are dealt at random into
blocks of bounded size; each block has several islands. An island holds a population of
packings of its block, a packing being the bin number of every piece. A crossover takes
whole well-filled bins from one parent, injects them into the other, removes the bins that
then hold a piece twice, and gives the displaced pieces to the fullest bin they fit in.
After an epoch each island sends its elite to the next island of the ring, by a shuffle;
the best packing of a block over all islands is used. Full pieces are sequences alone.

Null text counts as empty, so its document is the end id alone. Repeated rows and equal
ids are packed as documents of their own; an empty table gives no rows. Results are
deterministic for the same stored pieces: every random choice is seeded by block and island.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perflog.llm.runtime import chunks, ready, stage, utf8
from perflog.llm.words import LOWER, SAME, SPACE, U, Words

#: Slots of a worker's table of chunks; it is emptied when half full.
SLOTS = 1 << 22
#: A chunk put between others to find their ends again in one long encoding (a private-use character).
MARK = "\ue00f"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP = np.zeros(256, bool)
STOP[list(b",.;:!?|")] = True
ONE_PRETOKEN = regex.compile(r"\p{L}+")


def stops(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where a run of stops after an ASCII letter, up to white space or the text's end, begins: it is a pre-token of its own."""
    n = len(data)
    stop, edge = STOP[data], offs[(offs > 0) & (offs < n)]
    first, last = stop.copy(), stop.copy()
    first[1:] &= ~stop[:-1]
    last[:-1] &= ~stop[1:]
    first[edge] = stop[edge]
    last[edge - 1] = stop[edge - 1]
    x, y = np.flatnonzero(first), np.flatnonzero(last) + 1
    limit = np.zeros(n + 1, bool)
    limit[edge] = True
    limit[n] = True
    ends = limit[y] | np.append(SPACE[data], True)[y]
    return x[ends & LETTER[data[np.maximum(x - 1, 0)]] & (x > 0) & ~limit[x]]


class ChunkIds:
    """Ids of texts by their chunks between ASCII white space, for vocabularies whose pre-tokens hold none and whose
    normaliser lower-cases. A worker keeps the ids of chunks it has met in a table by 64-bit hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.empty()

    def empty(self) -> None:
        self.key, self.at = np.zeros(SLOTS, U), np.zeros(SLOTS, np.int32)
        self.place, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, "<u4")
        self.words = self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each chunk, -1 for those not met."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        slot = (h >> U(20)).astype(np.int64) & (SLOTS - 1)
        while len(todo):
            key = self.key[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.at[slot[hit]]
            go = ~hit & (key != 0)
            todo, slot = todo[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def learn(self, h: np.ndarray, words: list[str]) -> None:
        """Encode chunks not met before (different hashes, none of them 0)."""
        plain = np.array([ONE_PRETOKEN.fullmatch(w) is not None for w in words], bool)
        for which, ids_of in ((np.flatnonzero(plain), self.letters), (np.flatnonzero(~plain), self.marked)):
            for lo in range(0, len(which), 2000):
                some = which[lo:lo + 2000]
                ids, size = ids_of([words[i] for i in some])
                if self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), "<u4")])
                self.pool[self.used:self.used + len(ids)] = ids
                while self.words + len(some) > len(self.place):
                    self.place, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.place, self.size))
                self.place[self.words:self.words + len(some)] = self.used + np.cumsum(size) - size
                self.size[self.words:self.words + len(some)] = size
                todo, number = h[some], np.arange(self.words, self.words + len(some))
                slot = (todo >> U(20)).astype(np.int64) & (SLOTS - 1)
                while len(todo):
                    free = self.key[slot] == 0
                    self.key[slot[free]] = todo[free]  # of several that want a slot, the last one gets it
                    won = self.key[slot] == todo
                    self.at[slot[won]] = number[won]
                    todo, number, slot = todo[~won], number[~won], (slot[~won] + 1) & (SLOTS - 1)
                self.words += len(some)
                self.used += len(ids)

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that are one pre-token each, in one encoding."""
        e = self.tok.encode(" ".join(words), add_special_tokens=False)
        size = np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))
        return (np.array(e.ids, "<u4"), size) if len(size) == len(words) else self.marked(words)

    def marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tok.encode(f" {MARK} ".join(words), add_special_tokens=False).ids, "<u4")
        k = len(self.mark)
        ends = np.flatnonzero(np.all([ids[j:len(ids) - k + 1 + j] == m for j, m in enumerate(self.mark)], axis=0)) \
            if len(ids) >= k else np.zeros(0, np.int64)
        if len(ends) == len(words) - 1:
            keep = np.ones(len(ids), bool)
            for j in range(k):
                keep[ends + j] = False
            return ids[keep], np.append(ends, len(ids)) - np.append(0, ends + k)
        parts = [self.tok.encode(w, add_special_tokens=False).ids for w in words]  # a chunk holds the mark itself
        return np.array([x for p in parts for x in p], "<u4"), np.array([len(p) for p in parts], np.int64)

    def batch(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of whole texts in one row, and how many each text has."""
        special = b"<|" in data.tobytes()  # lower case could make a special string
        w = Words(data, offs, SPACE, SAME if special else LOWER, stops(data, offs))
        h = np.maximum(w.hash ^ U(special), U(1))
        number = self.find(h)
        if (number < 0).any():
            new, first = np.unique(np.where(number < 0, h, U(0)), return_index=True)
            new, first = (new[1:], first[1:]) if new[0] == 0 else (new, first)
            if self.words + len(new) > SLOTS // 2:
                self.empty()
                new, first = np.unique(h, return_index=True)
            words = [data[x:y].tobytes().decode() for x, y in zip(w.start[first].tolist(), w.end[first].tolist())]
            self.learn(new, words)
            number = self.find(h)
        size = self.size[number]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.place[number] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(w.count)])])


_IDS: dict[str, ChunkIds] = {}


def token_pieces(docs: DataFrame, vocabulary: str, length: int, end_id: int, id_col: str, text_col: str,
                 with_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 (and ids)."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        if vocabulary not in _IDS:
            _IDS[vocabulary] = ChunkIds(vocabulary)
        for b in batches:
            keys = b.column(0)
            data, offs = utf8(b.column(1))
            for lo, hi in chunks(offs):
                ids, count = _IDS[vocabulary].batch(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                raw, edge = ids.tobytes(), np.concatenate([[0], np.cumsum(count)]) * 4
                at, piece, n, crc, blobs = [], [], [], [], []
                for i in range(hi - lo):
                    doc = raw[edge[i]:edge[i + 1]] + end
                    for k, cut in enumerate(range(0, len(doc), 4 * length)):
                        part = doc[cut:cut + 4 * length]
                        at.append(lo + i)
                        piece.append(k)
                        n.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            blobs.append(part)
                out = [keys.take(pa.array(at)), pa.array(piece, pa.int32()),
                       pa.array([p * length for p in piece], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(blobs, pa.binary())] * with_ids, names)

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(sizes: np.ndarray, order, room: list[int], bins: np.ndarray, items, capacity: int) -> None:
    """Give ``items`` in ``order`` to the bin with the least room that takes them; open bins as needed.

    ``room``: free tokens of each bin; grows. Bins are kept in lists by free room, and a bit set of the
    rooms in use finds the least one that is large enough."""
    stacks: dict[int, list[int]] = {}
    used = 0
    for b, r in enumerate(room):
        if r > 0:
            stacks.setdefault(r, []).append(b)
            used |= 1 << r
    for j in order:
        i, s = items[j], int(sizes[j])
        above = used >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            stack = stacks[r]
            b = stack.pop()
            if not stack:
                used &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i] = b
        room[b] = r = r - s
        if r:
            stacks.setdefault(r, []).append(b)
            used |= 1 << r


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: fewer, fuller bins score higher."""
    fill = np.bincount(bins, weights=sizes)
    fill = fill[fill > 0] / capacity
    return float((fill ** 2).sum() / len(fill) ** 2 * len(fill)) if len(fill) else 1.0


def fresh(sizes: np.ndarray, capacity: int, rng, jitter: float) -> np.ndarray:
    """A packing by best fit over sizes in falling order, disturbed by ``jitter``."""
    order = np.argsort(-sizes * (1 + jitter * rng.random(len(sizes))), kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    room: list[int] = []
    best_fit(sizes, order.tolist(), room, bins, range(len(sizes)), capacity)
    return bins


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Inject well-filled bins of ``father`` into ``mother``."""
    fill = np.bincount(father, weights=sizes)
    full = np.flatnonzero(fill >= capacity * (1 - 1 / 512))
    if not len(full):
        full = np.argsort(-fill)[:max(1, len(fill) // 10)]
    pick = np.zeros(len(fill), bool)
    pick[rng.choice(full, max(1, int(len(full) * rng.uniform(0.1, 0.5))), replace=False)] = True
    came = pick[father]
    # the mother's bins that hold an injected piece would hold it twice: they go, and so do her emptiest
    gone = np.zeros(mother.max() + 1, bool)
    gone[mother[came]] = True
    own = np.bincount(mother, weights=sizes, minlength=len(gone))
    low = np.flatnonzero((own > 0) & ~gone & (own < capacity * 0.99))
    if len(low):
        gone[low] = True
    child = np.full(len(sizes), -1)
    child[came] = father[came]
    stay = ~came & ~gone[mother]
    child[stay] = mother[stay] + len(fill)
    kept, child_ids = np.unique(child[child >= 0], return_inverse=True)
    child[child >= 0] = child_ids
    free = capacity - np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=len(kept)).astype(np.int64)
    out = np.flatnonzero(child < 0)
    room = free.tolist()
    key = -sizes[out] * (1 + rng.choice([0.0, 0.02, 0.1]) * rng.random(len(out)))
    best_fit(sizes[out], np.argsort(key, kind="stable").tolist(), room, child, out, capacity)
    return child


def evolve(sizes: np.ndarray, people: list[np.ndarray], capacity: int, births: int, keep: int, rng) -> list[np.ndarray]:
    """Births one after another, each replacing the worst packing if it is better; best first.  They end early only where
    the best packing has as few bins as the sizes' sum allows, which no birth can better."""
    least = math.ceil(sizes.sum() / capacity)
    scored = sorted(((fitness(sizes, p, capacity), i, p) for i, p in enumerate(people)), key=lambda x: (-x[0], x[1]))[:keep]
    for k in range(births):
        if len(scored) < 2 or len(np.unique(scored[0][2])) <= least:
            break
        a, b = sorted(rng.choice(len(scored), 2, replace=False))
        child = crossover(sizes, scored[b][2], scored[a][2], capacity, rng)
        f = fitness(sizes, child, capacity)
        if f > scored[-1][0] and all(f != s[0] for s in scored):
            scored = sorted([*scored[:-1], (f, len(people) + k, child)], key=lambda x: (-x[0], x[1]))
    return [s[2] for s in scored]


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", block: int = 12_000, islands: int = 2, population: int = 6, epochs: int = 4,
         births: int = 24, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``block``: pieces that are packed together, at most about this many; a block's last, part-filled
    bins are the only loss that blocks cause (a few of thousands).  An island has ``births`` per epoch, a multiple of its
    ``population``; a block whose best fit is proven least spends none of them."""
    spark = ready(docs.sparkSession)
    pieces = token_pieces(docs, vocabulary, length, end_id, id_col, text_col, with_ids)
    pieces = stage(pieces.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < length)
    blocks = max(1, math.ceil(short.count() / block))
    dealt = short.select("__uid", F.col("length").cast("int").alias("size"),
                         F.pmod(F.xxhash64("__uid"), F.lit(blocks)).alias("block"))
    people = "block long, island int, place int, uids binary, sizes binary, bins binary"

    def pairs(table):
        u, s = table.column("__uid").to_numpy(), table.column("size").to_numpy().astype(np.int64)
        order = np.argsort(u, kind="stable")
        return u[order], s[order]

    def settle(key, table):
        u, s = pairs(table)
        n, rows = key[0].as_py(), []
        for k in range(islands):
            rng = np.random.default_rng([n, k, 0])
            first = [fresh(s, length, rng, 0.0 if k + i == 0 else 0.04 * (1 + k + i)) for i in range(population)]
            for i, p in enumerate(evolve(s, first, length, births, population, rng)):
                rows.append({"block": n, "island": k, "place": i, "uids": u.tobytes(), "sizes": s.astype("<i4").tobytes(),
                             "bins": p.astype("<i4").tobytes()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("place", pa.int32()),
                                                            ("uids", pa.binary()), ("sizes", pa.binary()), ("bins", pa.binary())]))

    def live(epoch):
        def go(key, table):
            rows = sorted(table.to_pylist(), key=lambda r: (r["place"], r["bins"]))
            s = np.frombuffer(rows[0]["sizes"], "<i4").astype(np.int64)
            rng = np.random.default_rng([key[0].as_py(), key[1].as_py(), epoch])
            out = evolve(s, [np.frombuffer(r["bins"], "<i4").astype(np.int64) for r in rows], length, births, population, rng)
            return pa.Table.from_pylist([rows[0] | {"place": i, "bins": p.astype("<i4").tobytes()} for i, p in enumerate(out)],
                                        schema=table.schema)
        return go

    def unfold(key, table):
        rows = table.to_pylist()
        s = np.frombuffer(rows[0]["sizes"], "<i4").astype(np.int64)
        packs = [np.frombuffer(r["bins"], "<i4").astype(np.int64) for r in sorted(rows, key=lambda r: (r["island"], r["place"]))]
        best = min(packs, key=lambda p: (len(np.unique(p)), -fitness(s, p, length)))
        order = np.argsort(best, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], best[order][1:] != best[order][:-1]]))
        total = np.cumsum(s[order]) - s[order]
        offset = np.zeros(len(s), np.int64)
        offset[order] = total - np.repeat(total[edge], np.diff(np.append(edge, len(s))))
        uids = np.frombuffer(rows[0]["uids"], np.int64)
        return pa.table({"__uid": uids, "sequence_id": (np.int64(key[0].as_py()) << 32) + best, "offset": offset})

    state = dealt.groupBy("block").applyInArrow(settle, people)
    for epoch in range(1, epochs):
        state = stage(state, "islands")
        elite = state.where("place = 0").withColumn("island", ((F.col("island") + 1) % islands).cast("int")).withColumn("place", F.lit(population))
        state = state.unionByName(elite).groupBy("block", "island").applyInArrow(live(epoch), people)
    bins = state.groupBy("block").applyInArrow(unfold, "__uid long, sequence_id long, offset long")
    placed = short.join(bins, "__uid")
    # a full piece is a sequence of its own: a number below zero, apart from those of the blocks
    alone = pieces.where(F.col("length") >= length).withColumns({"sequence_id": -1 - F.col("__uid"), "offset": F.lit(0).cast("long")})
    return placed.unionByName(alone).drop("__uid")
