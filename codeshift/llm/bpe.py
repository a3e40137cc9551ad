"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Instead of merging text by text, the merges are replayed over all distinct
pieces of a batch at once.  An inverted index leads from a pair of adjacent
tokens to the places where it stands.  Pairs are taken in rank order; each
merge touches only the listed places and their two neighbours, whose new pairs
enter the index.  The ids of a piece do not depend on the other pieces, so any
split of the corpus into batches gives the same ids; a batch is bounded in
bytes, and no text leaves its task.

Defined cases: null text counts as empty and has no tokens; any bytes can be
encoded and are decoded exactly; rows that repeat and null ids are encoded row
by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, small_batches, whole_text, worker_cache
from .pieces import PieceTable, gather


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The merges of a rank file.  A pair of tokens is one number; all pairs
    that merge are kept sorted, with the rank of what they make."""

    def __init__(self, ranks: dict[bytes, int]):
        self._base = max(ranks.values()) + 1
        self._single = np.array([ranks.get(bytes([k]), -1) for k in range(256)], np.int64)
        if (self._single < 0).any():
            raise ValueError("the rank file lacks single bytes")
        made = sorted((ranks[t[:k]] * self._base + ranks[t[k:]], r) for t, r in ranks.items()
                      for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self._pairs = np.array([p for p, _ in made] + [np.iinfo(np.int64).max], np.int64)
        self._made = np.array([r for _, r in made] + [-1], np.int64)
        # Tokens that can take part in a merge of lower rank than their own.
        parts = np.stack((self._pairs[:-1] // self._base, self._pairs[:-1] % self._base))
        self._hurried = set(parts[parts > self._made[:-1]].tolist())

    def _ranks(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, -1 where there is none."""
        at = np.searchsorted(self._pairs, pairs)
        return np.where(self._pairs[at] == pairs, self._made[at], -1)

    def _lower(self, pairs: np.ndarray, rank: int) -> np.ndarray:
        made = self._ranks(pairs)
        return (made >= 0) & (made < rank)

    def _in_turn(self, rank, places, piece, ids, after, before, where, queue) -> np.ndarray:
        """Of the (sorted) places of a merge, those that may be merged now
        when a piece has several; places that have to wait are queued again."""
        base = self._base
        places, first = np.unique(places, return_index=True)
        piece = piece[first]
        if rank in self._hurried:
            # A merge that makes a pair of lower rank goes first: the other places of its piece wait.
            risky = np.full(len(places), self._lower(np.array([rank * base + rank]), rank)[0])
            for side, mine, other in ((after[after[places]], base, 1), (before[places], 1, base)):
                risky |= (side >= 0) & self._lower(np.maximum(ids[side], 0) * other + rank * mine, rank)
            if risky.any():
                wait = np.isin(piece, piece[risky])
                wait[np.unique(piece, return_index=True)[1]] = False
                if wait.any():
                    where[rank] = [places[wait]]
                    heappush(queue, rank)
                    places = places[~wait]
        meets = after[places][:-1] == places[1:]
        if meets.any():                    # runs that overlap: every other place, from the left
            heads = np.flatnonzero(np.concatenate(([True], ~meets)))
            step = np.arange(len(places)) - np.repeat(heads, np.diff([*heads, len(places)]))
            places = places[step % 2 == 0]
        return places

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has: all merges in rank order over all pieces."""
        base = self._base
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(lens) - lens
        ids = self._single[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = lens > 0
        after[(start + lens - 1)[full]] = -1      # the last token of a piece has no neighbour
        before[start[full]] = -1
        where: dict[int, list[np.ndarray]] = {}   # inverted index: rank of the pair -> its places
        queue: list[int] = []

        def index(places: np.ndarray) -> None:
            ranks = self._ranks(ids[places] * base + ids[after[places]])
            hit = ranks >= 0
            if not hit.any():
                return
            places, ranks = places[hit], ranks[hit]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, x, y in zip(ranks[[0, *cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
                if r in where:
                    where[r].append(places[x:y])
                else:
                    where[r] = [places[x:y]]
                    heappush(queue, r)

        index(np.flatnonzero(after >= 0))
        while queue:
            rank = heappop(queue)
            found = where.pop(rank)
            places = found[0] if len(found) == 1 else np.concatenate(found)
            places = places[(ids[places] >= 0) & (after[places] >= 0)]
            places = places[self._ranks(ids[places] * base + ids[after[places]]) == rank]
            if len(places) > 1:
                places.sort()
                piece = np.searchsorted(start, places, side="right")
                if (piece[1:] == piece[:-1]).any():
                    places = self._in_turn(rank, places, piece, ids, after, before, where, queue)
            nxt = after[places]
            if not len(places):
                continue
            right = after[nxt]
            ids[places], ids[nxt] = rank, -1
            after[places] = right
            inner = right >= 0
            before[right[inner]] = places[inner]
            left = before[places]
            touched = np.concatenate((places[inner], left[left >= 0]))
            if len(touched):
                index(touched)
        left = np.flatnonzero(ids >= 0)
        return ids[left], np.searchsorted(left, start + lens) - np.searchsorted(left, start)


class Codec:
    """Encoder and decoder of one rank file and split pattern.

    A blank between two words is a sure place to cut when the pattern lets a
    piece take one blank before it and no piece run on into a blank after
    other characters (``blank_cuts``); parts between blanks are then kept with
    their ids, and the pattern only splits parts not met before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, blank_cuts: bool = True):
        self._merges = Merges(ranks)
        self._find = regex.compile(pattern).findall
        self._run_on = regex.compile(r"\s ").search
        self._blank_cuts = blank_cuts
        self._table = PieceTable(self._encode_parts, 500_000)
        tokens = {r: t for t, r in ranks.items()}
        lens = np.zeros(max(tokens) + 1, np.int64)
        lens[list(tokens)] = [len(t) for t in tokens.values()]
        self._len, self._at = lens, np.cumsum(lens) - lens
        self._bytes = np.frombuffer(b"".join(tokens[r] for r in sorted(tokens)), np.uint8)

    def _encode_parts(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Parts are strings that follow a blank, or tuples of a string that doesn't."""
        split = [self._find(p[0] if isinstance(p, tuple) else " " + p) for p in parts]
        row = {p: k for k, p in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        flat, lens = self._merges.replay([p.encode("utf-8") for p in row])
        rows = np.fromiter(map(row.__getitem__, chain.from_iterable(split)), np.int64)
        total = np.concatenate(([0], np.cumsum(lens[rows])))
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return gather(flat, np.cumsum(lens) - lens, lens, rows), np.diff(total[ends], prepend=0)

    def _parts(self, text: str) -> list:
        if not self._blank_cuts or self._run_on(text):   # blanks after white space belong together
            return [(p,) for p in self._find(text)]
        parts: list = text.split(" ")
        parts[0] = (parts[0],)
        return parts

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return self._table.ids([self._parts(t) for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self._bytes, self._at, self._len, ids).tobytes()


_CODECS: dict[tuple[str, str], Codec] = worker_cache("bpe")


def codec(path: str, pattern: str) -> Codec:
    """The codec of a file, kept while its worker lives."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


_GROUP = 1 << 23  # characters replayed together


def groups_of(texts: list[str], most: int = _GROUP) -> Iterable[list[str]]:
    """The texts in order, in groups of about ``most`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids``, the little-endian unsigned 32-bit token ids."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = [i.astype("<u4").tobytes() for g in groups_of(b.column(1).to_pylist()) for i in c.encode_batch(g)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return rows.mapInArrow(freed(run, "bpe"), T.StructType([rows.schema["id"], T.StructField("ids", T.BinaryType())])) \
        .withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids and ``bytes``, the bytes the ids stand for."""
    rows = encoded.select(F.col(id_col).alias("id"), "ids")

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            raw = [c.decode(np.frombuffer(i, "<u4")) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=["id", "ids", "bytes"])

    return rows.mapInArrow(freed(run, "bpe"), T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])) \
        .withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: every text is encoded and its
    ids decoded, in one pass of one worker; only digests leave it."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            n, ids_sha, raw_sha = [], [], []
            for ids in (i for g in groups_of(b.column(1).to_pylist()) for i in c.encode_batch(g)):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                raw_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], names=names)

    out = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(freed(run, "bpe"), out).withColumnRenamed("id", id_col)
