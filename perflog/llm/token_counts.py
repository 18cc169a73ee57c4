"""Token counts by rank-synchronous array merging (operator 4).

A text falls into pre-tokens by the vocabulary's own pattern. The pre-tokens not seen before by this
worker are held together as one flat numpy array of symbol ids with a sequence number
each. One step finds every sequence's lowest-rank neighbouring pair and merges all of
that pair's places in all sequences at once; steps go on until no pair has a rank. What
is left in a sequence is its token count, which is kept by pre-token. A long pre-token (a key, a script
without blanks) is merged rank by rank as well, but alone and by lists of places.

Null text counts as empty: 0 bytes, 0 tokens. The special string of the vocabulary is one
token, as the library's default has it. Rows are handled one by one, so repeated rows,
ties and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perflog.llm.runtime import ready

#: White space (Unicode) and the pre-token pattern of the vocabulary.
WHITE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(
    r"[^\s\p", rf"[^{WHITE}\p").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
#: A text's pieces that never share a pre-token: a run of non-space with the blank before it, or white space.
PIECE = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Pieces whose counts a worker remembers; the memory is emptied when it is full.
REMEMBERED = 1_000_000


#: Bytes from which a pre-token is merged alone.
LONG = 1 << 11


def byte_symbols() -> dict[int, str]:
    """Symbol of each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others for code points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """The merges of a vocabulary as sorted arrays: pair code to rank and new symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        code = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        new = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.new = code[order], np.arange(len(code))[order], new[order]
        self.row_of = np.argsort(self.rank)
        self.byte_id = np.array([vocab[s] for _, s in sorted(byte_symbols().items())], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.seen: dict[str, int] = {}

    def counts(self, seqs: list[bytes]) -> np.ndarray:
        """Surviving symbols of every sequence of bytes, all merged in step."""
        size = np.array([len(s) for s in seqs], np.int64)
        left = size.copy()
        sym = self.byte_id[np.frombuffer(b"".join(seqs), np.uint8)].astype(np.int64)
        seq = np.repeat(np.arange(len(seqs)), size)
        none = len(self.code)
        while len(sym) > 1:
            pair = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.code, pair), none - 1)
            rank = np.append(np.where((self.code[at] == pair) & (seq[:-1] == seq[1:]), self.rank[at], none), none)
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            size = np.diff(np.append(first, len(seq)))
            least = np.minimum.reduceat(rank, first)
            hit = (rank < none) & (rank == np.repeat(least, size))
            # of overlapping places (a symbol repeated), the first, third, ... merge
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            hit &= (run % 2 == 1) | (sym != np.append(sym[1:], -1))
            gone = np.flatnonzero(hit) + 1
            sym[gone - 1] = self.new[at[gone - 1]]
            keep = np.repeat(least < none, size)  # a sequence without a rank left is done
            if len(gone):
                left -= np.bincount(seq[gone], minlength=len(left))
            keep[gone] = False
            sym, seq = sym[keep], seq[keep]
        return left

    def count_long(self, seq: bytes) -> int:
        """The same for one long sequence. Places are kept by the rank of their pair, and a step touches only the places of the
        lowest rank and their neighbours, so the work follows the merges and not steps times symbols."""
        sym = self.byte_id[np.frombuffer(seq, np.uint8)].astype(np.int64)
        end, none = len(sym), len(self.code)
        after, before = np.arange(1, end + 1), np.arange(-1, end - 1)
        live = np.ones(end, bool)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(p: np.ndarray) -> None:
            """Places of pairs, under the rows of the table that their pairs have."""
            pair = (sym[p] << 32) | sym[after[p]]
            at = np.minimum(np.searchsorted(self.code, pair), none - 1)
            known = self.code[at] == pair
            p, rank = p[known], self.rank[at[known]]
            order = np.argsort(rank, kind="stable")
            p, rank = p[order], rank[order]
            edge = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1], [True]])) if len(p) else []
            for a, b in zip(edge[:-1], edge[1:]):
                r = int(rank[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(p[a:b])

        put(np.arange(end - 1))
        while queue:
            r = heapq.heappop(queue)
            p = np.unique(np.concatenate(places.pop(r)))
            row = self.row_of[r]
            left, right = self.code[row] >> 32, self.code[row] & 0xFFFFFFFF
            p = p[live[p] & (after[p] < end) & (sym[p] == left)]
            p = p[sym[after[p]] == right]
            if left == right and len(p):
                # of overlapping places the first, third, ... merge
                start = np.concatenate([[True], after[p[:-1]] != p[1:]])
                k = np.arange(len(p))
                p = p[(k - np.maximum.accumulate(np.where(start, k, 0))) % 2 == 0]
            if not len(p):
                continue
            q = after[p]
            live[q] = False
            sym[p] = self.new[row]
            after[p] = after[q]
            inside = after[p] < end
            before[after[p[inside]]] = p[inside]
            put(np.unique(np.concatenate([before[p][before[p] >= 0], p[inside]])))
        return int(live.sum())

    def learn(self, pieces: set[str]) -> None:
        """Count the pre-tokens of pieces not met before."""
        parts = [(p, PRETOKEN.findall(p)) for p in pieces]
        flat = [s.encode() for _, x in parts for s in x]
        long = [i for i, s in enumerate(flat) if len(s) > LONG]
        n = np.zeros(len(flat), np.int64)
        if len(flat) > len(long):
            n[np.setdiff1d(np.arange(len(flat)), long)] = self.counts([s for s in flat if len(s) <= LONG])
        for i in long:
            n[i] = self.count_long(flat[i])
        edge = np.cumsum([0, *(len(x) for _, x in parts)])
        total = np.concatenate([[0], np.cumsum(n)])
        self.seen.update(zip((p for p, _ in parts), (total[edge[1:]] - total[edge[:-1]]).tolist()))

    def batch(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        pieces, base = [], []
        for t in texts:
            segments = [t]
            for s in self.special:
                if s in t:
                    segments = [y for x in segments for y in x.split(s)]
            base.append(len(segments) - 1)
            pieces.append([x for s in segments for x in PIECE.findall(s)])
        met = set().union(*pieces)
        new = met - self.seen.keys()
        if new and len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = met
        if new:
            self.learn(new)
        get = self.seen.__getitem__
        return [b + sum(map(get, x)) for b, x in zip(base, pieces)]


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row.

    ``vocabulary`` names the tokenizer file (byte-level BPE .json), which every executor has."""
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = merger(vocabulary)
        for b in batches:
            ids, col = b.column(0), b.column(1)
            lo = 0
            while lo < len(col):
                hi, size = lo, 0
                texts = []
                while hi < len(col) and (size < 1 << 20 or hi == lo):
                    texts.append(col[hi].as_py() or "")
                    size += len(texts[-1])
                    hi += 1
                n = np.array(m.batch(texts), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])
                lo = hi

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
