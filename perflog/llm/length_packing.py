"""Shortest-pack-first packing over the histogram of lengths (operator 12).

Every document becomes token ids plus an end id. Documents longer than a sequence are cut
into whole sequences and a rest; all other pieces stay whole at first. Packing then works on the histogram
of piece lengths alone, which has at most as many rows as a sequence has tokens, whatever the
input: lengths are placed from the longest to the shortest, each piece into the shortest
pack, and packs of the same pieces are one pattern with a count. The patterns are joined back
to the pieces by the rank of a piece among those of its length.

Where lengths don't fit together (many documents a little longer than half a sequence), packs keep
room. The shortest packs are then given up, as many as it takes to fill the room of more than
``slack`` tokens in the others, and only their pieces are cut to do so; what is left over
fills sequences of powers of two. This too is settled on the patterns: pieces of the packs given up form one
stream, the rooms another, and a piece's cuts follow from its place in the stream.

Null text counts as empty, so its document is the end id alone. Repeated rows and equal
ids are documents of their own; extra columns are not read; an empty table gives no rows. Which of several pieces of one
length goes where depends on how the table is split; sequences' lengths don't.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perflog.llm.packing import ChunkIds
from perflog.llm.runtime import chunks, ready, stage, utf8
from perflog.llm.token_counts import byte_symbols
from perflog.llm.words import SPACE, U, mix, powers

#: Ids that a worker keeps at most (numbers of 32 bits).
POOL = 1 << 24
#: A chunk that is one pre-token whatever is around it.
ONE = regex.compile(r" ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}']+)")
#: Kinds of ASCII bytes between which a pre-token always ends: letters, digits, other; 0 for an apostrophe and bytes beyond ASCII.
KIND = np.array([0 if i >= 128 or i == 39 else 1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 3 for i in range(256)], np.uint8)
#: Texts that are left to the library as a whole: white space beyond ASCII, special strings.
WHOLE = re.compile(rb"<\||\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of texts that byte-level pre-tokens never cross, in order: a word with the blank before it,
    another white space right before a word, the white space before that, and white space at the end of a text.
    Words are cut where the kind of ASCII characters changes."""
    n = len(data)
    inside = ~SPACE[data]
    edge = offs[(offs > 0) & (offs < n)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    before = np.concatenate([[0], end[:-1]]) if len(end) else end
    before = np.maximum(before, offs[np.searchsorted(offs, start, "right") - 1])
    gap = start - before
    blank = (gap > 0) & (data[start - 1] == 32)
    single, body = (gap > 0) & ~blank, gap > 1
    reach = np.maximum(np.concatenate([[0], end])[np.searchsorted(start, offs[1:])], offs[:-1])
    tail = reach < offs[1:]
    kind = KIND[data]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & inside[1:] & inside[:-1] & ~first[1:]) + 1
    # a cut ends one chunk of its word and begins the next
    left = np.concatenate([start - blank, cut])
    right = np.concatenate([cut, end])
    left.sort()
    right.sort()
    x = np.concatenate([left, start[single] - 1, before[body], reach[tail]])
    y = np.concatenate([right, start[single], start[body] - 1, offs[1:][tail]])
    order = np.argsort(x, kind="stable")
    return x[order], y[order]


def by_rank(path: str):
    """The vocabulary for tiktoken, which encodes new chunks faster; None where ids don't follow the order of the merges, as it needs."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, symbols = model["vocab"], byte_symbols()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    back = {c: b for b, c in symbols.items()}
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("chunks", pat_str=r"\n|[^\n]+", mergeable_ranks=ranks, special_tokens={})


class ByteIds(ChunkIds):
    """Ids of texts for byte-level vocabularies without a normaliser; chunks met before are looked up by hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.fast = by_rank(path)
        self.feed = self.tok.encode("\n", add_special_tokens=False).ids[0]
        self.empty()

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in one row, and how many each has."""
        one = np.array([ONE.fullmatch(w) is not None for w in words], bool)
        size, flat = np.zeros(len(words), np.int64), []
        some = np.flatnonzero(one)
        if len(some):
            # a line feed between two chunks is a pre-token of its own
            text = "\n".join([words[i] for i in some.tolist()])
            if self.fast:
                ids = np.array(self.fast.encode_ordinary(text), "<u4")
                at = 2 * np.cumsum(ids == self.feed) - (ids == self.feed)
            else:
                e = self.tok.encode(text, add_special_tokens=False)
                ids, at = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
            size[some] = np.bincount(at, minlength=2 * len(some) - 1)[::2]
            flat.append(ids[at % 2 == 0])
        rest = np.flatnonzero(~one)
        if len(rest):
            parts = [e.ids for e in self.tok.encode_batch([words[i] for i in rest.tolist()], add_special_tokens=False)]
            size[rest] = [len(x) for x in parts]
            flat.append(np.array([i for x in parts for i in x], "<u4"))
        order = np.concatenate([some, rest])
        place = np.empty(len(words), np.int64)
        place[order] = np.cumsum(size[order]) - size[order]
        total = np.cumsum(size) - size
        return np.concatenate(flat)[np.repeat(place - total, size) + np.arange(size.sum())], size

    def learn(self, h: np.ndarray, words: list[str]) -> None:
        """Encode chunks not met before (different hashes, none of them 0)."""
        for lo in range(0, len(words), 4000):
            ids, size = self.encode(words[lo:lo + 4000])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), "<u4")])
            self.pool[self.used:self.used + len(ids)] = ids
            n = len(size)
            while self.words + n > len(self.place):
                self.place, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.place, self.size))
            self.place[self.words:self.words + n] = self.used + np.cumsum(size) - size
            self.size[self.words:self.words + n] = size
            todo, number = h[lo:lo + n], np.arange(self.words, self.words + n)
            slot = (todo >> U(20)).astype(np.int64) & (len(self.key) - 1)
            while len(todo):
                free = self.key[slot] == 0
                self.key[slot[free]] = todo[free]  # of several that want a slot, the last one gets it
                won = self.key[slot] == todo
                self.at[slot[won]] = number[won]
                todo, number, slot = todo[~won], number[~won], (slot[~won] + 1) & (len(self.key) - 1)
            self.words += n
            self.used += len(ids)

    def plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = byte_chunks(data, offs)
        forth, back = powers(max(len(data) + 1, 1 << 20))
        total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * forth[:len(data)], out=total[1:])
        h = np.maximum(mix((total[y] - total[x]) * back[x] ^ ((y - x).astype(U) << U(40))), U(1))
        number = self.find(h)
        if (number < 0).any():
            if self.used > POOL:
                self.empty()
                number[:] = -1
            new, at = np.unique(np.where(number < 0, h, U(0)), return_index=True)
            new, at = (new[1:], at[1:]) if new[0] == 0 else (new, at)
            if self.words + len(new) > len(self.key) // 2:
                self.empty()
                new, at = np.unique(h, return_index=True)
            raw = data.tobytes()
            self.learn(new, [raw[i:j].decode() for i, j in zip(x[at].tolist(), y[at].tolist())])
            number = self.find(h)
        size = self.size[number]
        sums = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.place[number] - sums[:-1], size) + np.arange(sums[-1])]
        return ids, np.diff(sums[np.searchsorted(x, offs)])

    def batch(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of whole texts in one row, and how many each text has."""
        raw = data.tobytes()
        odd = np.unique(np.searchsorted(offs, [m.start() for m in WHOLE.finditer(raw)], "right") - 1)
        if not len(odd):
            return self.plain(data, offs)
        parts, count, lo = [], [], 0
        for i in [*odd.tolist(), len(offs) - 1]:
            if lo < i:
                ids, n = self.plain(data[offs[lo]:offs[i]], offs[lo:i + 1] - offs[lo])
                parts.append(ids)
                count.append(n)
            if i < len(offs) - 1:
                ids = np.array(self.tok.encode(raw[offs[i]:offs[i + 1]].decode(), add_special_tokens=False).ids, "<u4")
                parts.append(ids)
                count.append([len(ids)])
            lo = i + 1
        return np.concatenate(parts), np.concatenate(count)


_IDS: dict[str, ByteIds] = {}


def token_pieces(docs: DataFrame, vocabulary: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document: whole sequences and a rest. ``__place``: the piece's number among those of its length
    in partition ``__part``; ``__ids``: its ids, for rests only."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["__id", "__part", "__uid", "__place", "start", "length", "ids_crc32", "doc_tokens", "__ids"]

    def run(batches):
        from pyspark import TaskContext
        part, made, seen = TaskContext.get().partitionId(), 0, [0] * (length + 1)
        if vocabulary not in _IDS:
            _IDS[vocabulary] = ByteIds(vocabulary)
        for b in batches:
            data, offs = utf8(b.column(1))
            for lo, hi in chunks(offs):
                ids, count = _IDS[vocabulary].batch(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                raw, edge = ids.tobytes(), np.concatenate([[0], np.cumsum(count)]) * 4
                row, rows = [], []
                for i in range(hi - lo):
                    doc = raw[edge[i]:edge[i + 1]] + end
                    for cut in range(0, len(doc), 4 * length):
                        x = doc[cut:cut + 4 * length]
                        n = len(x) // 4
                        row.append(lo + i)
                        rows.append((made, seen[n], cut // 4, n, zlib.crc32(x), len(doc) // 4, x if n < length else None))
                        made += 1
                        seen[n] += 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array([part] * len(rows), pa.int64()), pa.array(cols[0], pa.int64()),
                     *[pa.array(c, pa.int64()) for c in cols[1:6]], pa.array(cols[6], pa.binary())], names)

    out = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).mapInArrow(
        run, f"__id {kind}, __part long, __uid long, __place long, start long, length long, ids_crc32 long, doc_tokens long, __ids binary")
    return out.withColumn("__uid", F.shiftleft("__part", 36) + F.col("__uid"))


# --- packing on the histogram -----------------------------------------------------------------

#: A pattern: number of packs, and runs of (length, pieces of this length) in the order of the pieces.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def filled(runs) -> int:
    return sum(l * m for l, m in runs)


def shortest_pack_first(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of a histogram (pieces by length): the longest length first, every piece into the shortest pack.

    A step places one piece into each pack of one pattern, so the work depends on ``capacity``, not on the counts:
    a length splits one pattern and opens two at most."""
    heap: list[int] = []
    packs: dict[int, list[Pattern]] = {}

    def put(n: int, runs) -> None:
        f = filled(runs)
        if not packs.get(f):
            heapq.heappush(heap, f)
        packs.setdefault(f, []).append((n, runs))

    for l in sorted(count, reverse=True):
        left = count[l]
        while left and heap and heap[0] + l <= capacity:
            n, runs = packs[heap[0]].pop()
            if not packs[heap[0]]:
                heapq.heappop(heap)
            if left < n:
                put(n - left, runs)
            took = min(n, left)
            last = runs[-1]
            put(took, runs[:-1] + ((l, last[1] + 1),) if last[0] == l else runs + ((l, 1),))
            left -= took
        fits = capacity // l
        if left >= fits:
            put(left // fits, ((l, fits),))
        if left % fits:
            put(1, ((l, left % fits),))
    return [p for f in sorted(packs) for p in packs[f]]


def give_up(patterns: list[Pattern], capacity: int, slack: int) -> tuple[list[Pattern], list[Pattern]]:
    """Packs that stay, and the shortest ones, whose pieces fill the room of more than ``slack`` in those that stay
    and less than one sequence beyond."""
    room = lambda f: capacity - f if capacity - f > slack else 0
    kept = sorted(patterns, key=lambda p: (filled(p[1]), p[1]), reverse=True)
    need, gone = sum(n * room(filled(r)) for n, r in kept), []
    while need > 0:
        n, runs = kept.pop()
        f = filled(runs)
        k = min(n, -(-need // (f + room(f))))
        gone.append((k, runs))
        need -= k * (f + room(f))
        if k < n:
            kept.append((n - k, runs))
    return kept, gone


class Plan:
    """Where the pieces of each length go, by rank. Slots are sorted by (length, first rank); the slot of a rank
    has ``packs`` packs of ``times`` pieces each, from sequence ``sequence`` and offset ``offset`` on; in a slot of pieces
    to be cut ``sequence`` is -1 and ``offset`` the place in the stream. ``rooms``: the stream's rooms, likewise as runs."""

    def __init__(self, count: dict[int, int], capacity: int, slack: int):
        kept, gone = give_up(shortest_pack_first(count, capacity), capacity, slack)
        rank, slots, rooms, sequence = dict.fromkeys(count, 0), [], [], 0
        for n, runs in kept:
            offset = 0
            for l, m in runs:
                slots.append((l, rank[l], m, sequence, offset))
                rank[l] += n * m
                offset += l * m
            if capacity - offset > slack:
                rooms.append((capacity - offset, n, sequence, offset))
            sequence += n
        whole = sorted(((l, n * m) for n, runs in gone for l, m in runs), reverse=True)
        place = 0
        for l, n in whole:
            slots.append((l, rank[l], 1, -1, place))
            rank[l] += n
            place += l * n
        rooms.sort(key=lambda r: (-r[0], r[2]))
        left = place - sum(size * n for size, n, _, _ in rooms)
        for bit in reversed(range(max(left, 0).bit_length())):  # the rest: at most one sequence of each power of two
            if left >> bit & 1:
                rooms.append((1 << bit, 1, sequence, 0))
                sequence += 1
        assert rank == count and left >= 0
        self.slots = np.array(sorted(slots), np.int64).reshape(-1, 5)
        self.key = (self.slots[:, 0] << 48) + self.slots[:, 1]
        self.rooms = np.array(rooms, np.int64).reshape(-1, 4)
        self.at = np.concatenate([[0], np.cumsum(self.rooms[:, 0] * self.rooms[:, 1])])
        self.cut_lengths = sorted({l for l, _ in whole})

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces; sequence -1 and place in the stream for those to be cut."""
        l, first, times, sequence, offset = self.slots[np.searchsorted(self.key, (length << 48) + rank, "right") - 1].T
        k = rank - first
        return np.where(sequence < 0, -1, sequence + k // times), offset + (k % times + np.where(sequence < 0, k, 0)) * l

    def cuts(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        """Of a piece at a place of the stream: (start in the piece, length, sequence, offset) of its parts."""
        out, done = [], 0
        while done < length:
            i = int(np.searchsorted(self.at, at + done, "right")) - 1
            size, _, sequence, offset = self.rooms[i].tolist()
            k, used = divmod(at + done - int(self.at[i]), size)
            n = min(length - done, size - used)
            out.append((done, n, sequence + k, offset + used))
            done += n
        return out


def pack(docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", slack: int = 8) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``slack``: room in a sequence that is not worth cutting a document for."""
    spark = ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = stage(token_pieces(docs, vocabulary, length, end_id, id_col, text_col), "length-pieces")
    rest = pieces.where(F.col("length") < length)
    counts = rest.groupBy("__part", "length").agg(F.count("*").alias("__n"))
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}, length, slack)
    before = counts.select("__part", "length", (F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")).alias("__before"))
    ids = F.when(F.col("length").isin(plan.cut_lengths), F.col("__ids")) if plan.cut_lengths else F.lit(None).cast("binary")
    ranked = rest.withColumn("__ids", ids).join(before, ["__part", "length"]).withColumn("__rank", F.col("__place") + F.col("__before"))
    sent = spark.sparkContext.broadcast(plan)
    numbers = ["start", "length", "ids_crc32", "doc_tokens"]
    names = ["__id", *numbers, "sequence_id", "offset"]

    def place(batches):
        p = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            n, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            sequence, offset = p.place(n, rank)
            whole = np.flatnonzero(sequence >= 0)
            yield pa.RecordBatch.from_arrays([b.column("__id").take(pa.array(whole)), *[b.column(c).take(pa.array(whole)) for c in numbers],
                                              pa.array(sequence[whole]), pa.array(offset[whole])], names)
            row, parts = [], []
            for i in np.flatnonzero(sequence < 0).tolist():
                blob, start, total = (b.column(c)[i].as_py() for c in ("__ids", "start", "doc_tokens"))
                for at, m, s, o in p.cuts(int(offset[i]), int(n[i])):
                    row.append(i)
                    parts.append((start + at, m, zlib.crc32(blob[4 * at:4 * (at + m)]), total, s, o))
            if row:
                yield pa.RecordBatch.from_arrays([b.column("__id").take(pa.array(row)), *[pa.array(c, pa.int64()) for c in zip(*parts)]], names)

    placed = ranked.select("__id", *numbers, "__rank", "__ids").mapInArrow(
        place, f"__id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))
    # a whole sequence is alone: a number below zero, apart from those of the plan
    alone = pieces.where(F.col("length") >= length).select("__id", *numbers, (-1 - F.col("__uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone).withColumnRenamed("__id", id_col)
