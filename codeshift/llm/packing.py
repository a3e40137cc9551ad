"""Best-fit packing with swap-based local search.

Documents become token ids and an end id; only a document longer than a
sequence is cut, into pieces of full length and a rest.  What decides how
pieces share sequences is their length alone, so the search runs over the
histogram of lengths: at most ``capacity`` entries, however many documents
there are.  A *bin type* is a multiset of lengths with the number of sequences
filled that way.

1. Best-fit decreasing over the histogram: longest length first, into the open
   bin type with the least room that still takes it; all equal bins at once.
2. Local search over underfull bin types.  A move of one or two pieces, an
   exchange of one for one, or of two for one, is made when it raises the sum
   of squared fills; it is made in as many pairs of bins as there are.  Raising
   squared fill drains the emptier bin; a bin that gets empty is a sequence
   saved.  Every underfull type is tried against every other.  The search ends
   when no step helps or the number of bins meets its lower bound.
   So that its work does not grow with the number of documents, it is done in
   shares: of n pieces, every length gives one in g, g being n over ``SHARE``; the
   bins found for them are made g times; the few pieces that are left are treated
   in the same way with a smaller g, the last ones one by one.  Up to ``SHARE``
   pieces that is the search itself.  Where best fit alone needs no more bins, its
   types are taken.
3. Every piece finds its sequence and offset from its rank among the pieces of
   its length.  Ranks are made of two levels (length and block, with a small
   table of block counts), so no task holds all pieces of a length.

Defined cases: null text counts as empty (one piece holding the end id);
repeated rows and null ids are pieces of their own; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import groups_of
from .common import checked_broadcast, freed, materialize, shuffle_partitions, small_batches, whole_text, worker_cache
from .pieces import PieceTable

CAPACITY, END_ID = 2048, 0
SHARE = 20_000  # pieces searched at once

Type = tuple[int, ...]  # lengths in a bin, longest first


# --- the search over the histogram ----------------------------------------

def best_fit_types(lengths: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Bin types and their numbers by best-fit decreasing."""
    types: Counter = Counter()
    rooms: list[tuple[int, Type]] = []   # open types by room left

    def put(t: Type, n: int) -> None:
        if not types[t] and sum(t) < capacity:
            insort(rooms, (capacity - sum(t), t))
        types[t] += n

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            at = bisect_left(rooms, (length, ()))
            if at < len(rooms):
                room, t = rooms[at]
                fit = room // length
                # All bins of the type get one more piece, or as many bins as pieces are left get it.
                bins = min(types[t], max(1, left // fit))
                each = min(fit, left // bins)
                types[t] -= bins
                if not types[t]:
                    del types[t]
                    rooms.pop(at)
                put(t + (length,) * each, bins)
                left -= bins * each
            else:
                fit = capacity // length
                bins, rest = divmod(left, fit)
                if bins:
                    put((length,) * fit, bins)
                if rest:
                    put((length,) * rest, 1)
                left = 0
    return types


def _swap(a: Type, b: Type, out: Type, back: Type) -> tuple[Type, Type]:
    """``out`` goes from ``a`` to ``b`` and ``back`` from ``b`` to ``a``."""
    x, y = Counter(a), Counter(b)
    x.subtract(out), x.update(back)
    y.subtract(back), y.update(out)
    return tuple(sorted(x.elements(), reverse=True)), tuple(sorted(y.elements(), reverse=True))


def _parts(t: Type) -> tuple[list[Type], list[Type]]:
    """What a bin can give: nothing or one piece; two pieces."""
    c = Counter(t)
    u = sorted(c)
    return [(), *((x,) for x in u)], [(x, y) for i, x in enumerate(u) for y in u[i:] if x != y or c[x] > 1]


class _Offers:
    """What the bins of a set of types can give, as arrays over all of them."""

    def __init__(self, capacity: int):
        self.capacity, self.gone = capacity, 4 * capacity      # a fill that takes part in no step
        self.blocks: dict[Type, tuple[int, int]] = {}
        self.n = self.dead = 0
        self.sums, self.fills = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.starts: list[int] = []
        self.owners: list[Type] = []

    def add(self, t: Type, parts: list[Type]) -> None:
        end = self.n + len(parts)
        if end > len(self.sums):
            self.sums, self.fills = (np.concatenate((x, np.zeros(end, np.int64))) for x in (self.sums, self.fills))
        self.sums[self.n:end] = [sum(x) for x in parts]
        self.fills[self.n:end] = sum(t)
        if parts:
            self.blocks[t] = self.n, end
            self.starts.append(self.n)
            self.owners.append(t)
        self.n = end

    def mark(self, t: Type, fill: int) -> None:
        if t in self.blocks:
            i, j = self.blocks[t]
            self.fills[i:j] = fill

    def drop(self, t: Type) -> None:
        if t not in self.blocks:
            return
        self.mark(t, self.gone)
        i, j = self.blocks.pop(t)
        self.dead += j - i
        if self.dead > 4096 and 2 * self.dead > self.n:         # close the gaps
            live = self.fills[:self.n] < self.gone
            self.sums, self.fills = self.sums[:self.n][live], self.fills[:self.n][live]
            self.n, self.dead, self.starts, self.owners, old = len(self.sums), 0, [], [], self.blocks
            self.blocks, at = {}, 0
            for u, (i, j) in sorted(old.items(), key=lambda x: x[1]):
                self.blocks[u] = at, at + j - i
                self.starts.append(at)
                self.owners.append(u)
                at += j - i

    def best(self, fill: int, outs: np.ndarray, cells: int = 1 << 20) -> tuple[int, Type, int, int] | None:
        """For a bin filled to ``fill`` that gives one of ``outs``: gain,
        partner, place in ``outs``, place among the partner's parts."""
        if not len(outs):
            return None
        width = max(1, cells // len(outs))
        for s in range(0, self.n, width):
            sums, fills = self.sums[s:min(s + width, self.n)], self.fills[s:min(s + width, self.n)]
            shift = outs[:, None] - sums
            gain = shift * (shift + (fills - fill))
            gain[(shift > self.capacity - fills) | (shift < fill - self.capacity)] = 0
            at = int(gain.argmax())
            k, col = divmod(at, len(sums))
            if gain[k, col] > 0:
                owner = bisect_right(self.starts, s + col) - 1
                return int(gain[k, col]), self.owners[owner], k, s + col - self.starts[owner]
        return None


def search(types: Counter, capacity: int = CAPACITY) -> Counter:
    """Local search between underfull bin types, the emptiest first.  A type
    that helps no other, and is helped by none, is looked at again only as the
    partner of a type that came up later: every pair is settled at the end."""
    types = Counter({t: n for t, n in types.items() if n and t})
    left = sum(types.values())
    bound = -(-sum(sum(t) * n for t, n in types.items()) // capacity)
    few, two = _Offers(capacity), _Offers(capacity)
    heap: list[tuple[int, Type]] = []

    def enter(t: Type) -> None:
        one, pair = _parts(t)
        few.add(t, one)
        two.add(t, pair)
        heappush(heap, (sum(t), t))

    for t in sorted((t for t in types if sum(t) < capacity), key=lambda t: (-sum(t), t)):
        enter(t)
    while heap and left > bound:
        fill, a = heap[0]
        if a not in few.blocks:
            heappop(heap)
            continue
        one, pair = _parts(a)
        ones, pairs = (np.array([sum(x) for x in p], np.int64) for p in (one, pair))
        if types[a] == 1:                        # no partner of its own kind
            few.mark(a, few.gone), two.mark(a, two.gone)
        found = [(f, p, o) for f, p, o in ((few.best(fill, ones), one, 0), (two.best(fill, ones), one, 1),
                                           (few.best(fill, pairs), pair, 0)) if f]
        few.mark(a, fill), two.mark(a, fill)
        if not found:
            heappop(heap)
            continue
        (_, b, k, j), mine, kind = max(found, key=lambda x: x[0][0])
        n = types[a] // 2 if a == b else min(types[a], types[b])
        new = _swap(a, b, mine[k], _parts(b)[kind][j])
        for t in (a, b):
            types[t] -= n
        for t in new:
            if not t:
                left -= n
                continue
            types[t] += n
            if sum(t) < capacity:
                if t not in few.blocks:
                    enter(t)
                elif types[t] <= 2 * n:          # may have been single: it can now meet its own kind
                    heappush(heap, (sum(t), t))
        for t in {a, b}:
            if not types[t]:
                few.drop(t), two.drop(t)
    return Counter({t: n for t, n in types.items() if n})


def packed_types(lengths: dict[int, int], capacity: int = CAPACITY, share: int = SHARE) -> Counter:
    """Bin types and their numbers for all pieces, searched in shares.  At most
    ``share`` and one piece per length more are searched at once, and each round
    leaves under ``capacity`` / ``share`` of the round before, so rounds are few."""
    best = best_fit_types(lengths, capacity)
    if sum(best.values()) * capacity < sum(x * n for x, n in lengths.items()) + capacity:
        return best                                              # the lower bound is met
    found: Counter = Counter()
    left = {x: n for x, n in lengths.items() if n}
    while left:
        g = max(1, sum(left.values()) // share)
        while not any(n >= g for n in left.values()):
            g = -(-g // 2)
        for t, n in search(best_fit_types({x: n // g for x, n in left.items() if n >= g}, capacity), capacity).items():
            found[t] += n * g
        left = {x: n % g for x, n in left.items() if n % g}
    return found if sum(found.values()) < sum(best.values()) else best


def slots(types: Counter) -> np.ndarray:
    """Rows (length, first rank, first bin, offset), by length and rank: pieces
    of a length with ranks from ``first rank`` on go to bins from ``first bin``
    on, at ``offset``."""
    rank: Counter = Counter()
    rows, first = [], 0
    for t in sorted(types, reverse=True):
        at = 0
        for length in t:
            rows.append((length, rank[length], first, at))
            rank[length] += types[t]
            at += length
        first += types[t]
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# --- tokens -----------------------------------------------------------------

# The pre-tokenizer's pattern, read from the tokenizer's own description.
def _pattern(tokenizer) -> str:
    steps = json.loads(tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[1]["use_regex"]:
        raise ValueError("another kind of tokenizer")
    return steps[0]["pattern"]["Regex"]


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes with: printable
    Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(rest)}


# Of a text of ASCII and plain Latin letters, each byte as: letter or digit
# (a), blank, comma or full stop (,), any other sign (p), byte of another script (x).
_KIND = bytes(ord("a" if chr(c).isalnum() else " " if c in b" \t\n\x0b\f\r" else "," if c in b",." else "p") if c < 128
              else ord("a" if c < 0xC0 or 0xC3 <= c <= 0xC8 else "x") for c in range(256))
_ODD = [c.encode() for c in "×÷İ"]  # signs among the letters; a capital that becomes two characters
_SIGNS = re.compile(rb"[,p],|,p|x").search


class Words:
    """Ids of whole texts from ids of their words, where the tokenizer treats
    ASCII white space as a border that leaves no token.

    In a text of Latin letters where no comma or full stop stands beside
    another sign, these are words of their own and capitals are lowered first,
    so fewer different words remain.  New words of Latin letters are normalised
    and split here and go to the library's model as distinct pieces; all others
    go through the library as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._find = regex.compile(_pattern(self._tokenizer)).findall
        self._normalise = self._tokenizer.normalizer.normalize_str
        self._model = self._tokenizer.model.tokenize
        self._letters = _byte_letters()
        self._table = PieceTable(self._encode, 600_000)

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii() or not piece.isprintable():
            piece = piece.encode("utf-8").decode("latin-1").translate(self._letters)
        return [t.id for t in self._model(piece)]

    def _pieces(self, word: str) -> list[str] | None:
        if word.isascii():
            word = word.lower()
            return [word] if word.isalpha() else self._find(word)
        if max(word) <= "\u024f" and "\u0085" not in word and "\u00a0" not in word:
            word = self._normalise(word)
            return [word] if word.isalpha() else self._find(word)
        return None

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known: dict[str, list[int]] = {}
        found = []
        for w in words:
            w = w.decode("utf-8")
            split = self._pieces(w)
            if split is None:
                found.append(self._tokenizer.encode(w, add_special_tokens=False).ids)
                continue
            ids = []
            for p in split:
                got = known.get(p)
                if got is None:
                    got = known[p] = self._piece(p)
                ids += got
            found.append(ids)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(lens.sum())), lens

    @staticmethod
    def _split(text: str) -> list[bytes]:
        raw = text.encode("utf-8")
        if _SIGNS(raw.translate(_KIND)) or any(c in raw for c in _ODD):
            return raw.split()
        low = raw.lower() if text.isascii() else text.lower().encode("utf-8")
        return low.replace(b",", b" , ").replace(b".", b" . ").split()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return self._table.ids([self._split(t) for t in texts])


_GROUP = 1 << 21  # characters tokenised together
_WORDS: dict[str, Words] = worker_cache("packing")


def words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, on demand, ``ids`` (binary, unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = T.StructType([rows.schema["id"], T.StructField("piece", T.IntegerType()),
                        *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")),
                        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches):
        tokens = words(path)
        for b in batches:
            row, got = [], []
            texts = b.column(1).to_pylist()
            for k, ids in enumerate(i for g in groups_of(texts, _GROUP) for i in tokens.encode_batch(g)):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, s in enumerate(range(0, len(ids), capacity)):
                    raw = ids[s:s + capacity].tobytes()
                    row.append(k)
                    got.append((piece, s, len(raw) // 4, zlib.crc32(raw), raw))
            cols = [pa.array([g[k] for g in got], kind) for k, (_, kind) in enumerate(
                zip(out.fields[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *cols], names=out.names)

    return rows.mapInArrow(freed(run, "packing"), out)


def pack(rows: DataFrame, capacity: int = CAPACITY, order_by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (any columns, with ``length`` from 1 to ``capacity``) with
    sequence_id and offset."""
    spark = rows.sparkSession
    blocks = max(8, shuffle_partitions(spark))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*(order_by or rows.columns)), F.lit(blocks)).cast("int"))
    counts = materialize(rows.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("n")), "lengths")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    table = slots(packed_types(lengths, capacity))                # bounded by the shares searched
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(counts.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")), "ranks")
    within = Window.partitionBy("length", "_block").orderBy(*(order_by or rows.columns))
    ranked = (rows.withColumn("_at", F.row_number().over(within) - 1)
              .join(checked_broadcast(first), ["length", "_block"])
              .withColumn("_rank", F.col("_first") + F.col("_at")).drop("_first", "_at", "_block"))
    out = T.StructType([*ranked.drop("_rank").schema.fields, T.StructField("sequence_id", T.LongType()),
                        T.StructField("offset", T.LongType())])
    length_at, rank_at = ranked.columns.index("length"), ranked.columns.index("_rank")
    starts, ends = np.unique(table[:, 0], return_index=True)
    spans = {int(x): (i, j) for x, i, j in zip(starts, ends, [*ends[1:], len(table)])}

    def place(batches):
        for b in batches:
            length, rank = b.column(length_at).to_numpy(), b.column(rank_at).to_numpy()
            row = np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                i, j = spans[x]
                mine = length == x
                row[mine] = i + np.searchsorted(table[i:j, 1], rank[mine], side="right") - 1
            sequence = table[row, 2] + rank - table[row, 1]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != rank_at),
                                              pa.array(sequence), pa.array(table[row, 3])], names=out.names)

    return ranked.mapInArrow(freed(place), out)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (ids on demand), sequence_id, offset."""
    cut = materialize(pieces(docs, path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack(cut, capacity, ("id", "piece", "start", "length", "ids_crc32")).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        "sequence_id", "offset")
