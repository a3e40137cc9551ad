r"""Dedup of repeated word windows with a count-min prefilter.

Words are ``[^\x20\x09-\x0D]+``; a window is ``window`` consecutive words of one
document.  Each word covered by a window whose word sequence also starts earlier
(smaller id, or the same id and an earlier start) is removed; windows are judged
on the input.

1. *Chunks.*  Documents are written with their words joined by single blanks, in
   chunks of one Arrow batch, which later steps name by number.
2. *Sketch.*  Each chunk is a partition sketch of ``ROWS`` rows of counters, sent as
   its non-empty cells, sorted and delta-coded, one message per block of cells.
   Counters stop at two, all that is asked.  Owners of blocks add up the messages
   for them: the merged count-min sketch.  Its width is ``CELLS`` counters per window
   of the whole table, so its estimates are as good at any size, and it is dealt out
   by block and never sent whole to any task.  To each chunk the owners send back
   those of its cells that count two or more.
3. *Exact pass.*  A chunk meets its answers.  A window is estimated repeated when its
   cells count two or more in every row.  Estimates are never too low, so no
   repeat is lost; about one window in 70 that does not repeat passes too (two rows
   of eight cells per window).  Only these windows are grouped, in two steps.  First
   as stretches: neighbouring windows with the same leftmost least hash of half a
   window are one row, with a 128-bit digest of all their words.  Equal windows have equal
   least hashes, so what repeats meets in the bucket of that hash; equal stretches
   are settled against the first of them.  Where a bucket holds stretches that
   differ, the first of each kind is grouped window by window, by 128-bit digests.

A very common window counts once per chunk, not once per document, in the
messages and in the grouping (what starts earlier in the same chunk settles there);
joins are split by Spark where a sequence is still frequent.  Chunks are bounded, so no task holds a group or the sketch.

Defined cases: null text counts as empty; documents of fewer words than a window
keep all; rows with equal ids count as places of one document (of two equal starts
neither is earlier, so copies under one id keep the same words); null ids are one
id that comes last; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, checked_broadcast, freed, materialize, prune_by_bloom_filter, small_batches, whole_text

WINDOW = 20
ROWS, CELLS = 2, 8           # rows of the sketch, counters per window in each
BITS = 22                    # a block has two to this power counters
_CHUNK = 8 << 20             # bytes of text in a chunk
_WORDS = 500_000             # words known at once
_RNG = np.random.Generator(np.random.PCG64(13))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = _RNG.integers(1, 1 << 63, ROWS, np.uint64)


def _multipliers(window: int) -> np.ndarray:
    """Odd factors, one per place of a window."""
    return np.random.Generator(np.random.PCG64(29)).integers(1, 1 << 63, window, np.uint64) << np.uint64(1) | np.uint64(1)


class _WordHash(dict):
    """Word -> 64-bit hash, made when first met and forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Chunk:
    """The windows of some documents: ``hashes``, and for each the document and its first word."""

    def __init__(self, texts: list[bytes], window: int, known: _WordHash):
        words = [t.split(b" ") if t else [] for t in texts]
        self.n_words = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in words)])
        self.first_word = np.cumsum(self.n_words) - self.n_words
        count = np.maximum(self.n_words - window + 1, 0)
        self.doc = np.repeat(np.arange(len(words)), count)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        at = self.first_word[self.doc] + self.start
        self.hashes = _sums(flat, window)[at]
        self._flat, self._at, self._words, self._texts, self._window = flat, at, words, texts, window

    def least(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each of some windows, the least hash of its runs of half as many
        words, and where the leftmost such run stands."""
        half = max(1, self._window // 2)
        h = _sums(self._flat, half) * _MIX
        h ^= h >> np.uint64(31)
        h *= _MIX
        place, have, wide = np.arange(len(h)), 1, self._window - half + 1
        while have < wide and len(h):
            step = min(have, wide - have)
            later = h[step:] < h[:-step]
            place = np.where(later, place[step:], place[:-step])
            h = np.where(later, h[step:], h[:-step])
            have += step
        return h[self._at[which]].view(np.int64), place[self._at[which]]

    def digests(self, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """128-bit digests, as two numbers, of words lo to hi of documents (in order)."""
        got, now = [], -1
        for d, x, y in zip(doc.tolist(), lo.tolist(), hi.tolist()):
            if d != now:
                now, view = d, memoryview(self._texts[d])
                edge = np.cumsum(np.fromiter(map(len, self._words[d]), np.int64, len(self._words[d])) + 1).tolist()
                edge.append(0)                                   # edge[-1]: where the text begins
            got.append(xxhash.xxh3_128_digest(view[edge[x - 1]:edge[y - 1] - 1]))
        return np.frombuffer(b"".join(got), ">i8").astype(np.int64).reshape(-1, 2)


def _sums(flat: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words from the hashes of the words."""
    total = np.zeros(max(len(flat) - size + 1, 0), np.uint64)
    for k, m in enumerate(_multipliers(size)):
        total += flat[k:k + len(total)] * m
    return total


def cells_of(hashes: np.ndarray, row: int, blocks: int, bits: int = BITS) -> np.ndarray:
    """Number of the counter of each hash in a row of the sketch: block, then cell."""
    h = (hashes ^ _SEEDS[row]) * _MIX
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return block << np.uint64(bits) | h & np.uint64((1 << bits) - 1)


def pack(cells: np.ndarray) -> bytes:
    """Rising numbers as compressed differences, of two bytes each where they fit."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    small = not len(gaps) or int(gaps.max()) < 1 << 16
    raw = gaps.astype(np.uint16 if small else np.uint32).tobytes()
    return (b"s" if small else b"l") + len(raw).to_bytes(4, "big") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[5:], int.from_bytes(data[1:5], "big"), "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.uint16 if data[:1] == b"s" else np.uint32).astype(np.int64))


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, chunk, id, n_words, words (joined by one blank); written."""
    small_batches(docs.sparkSession, _CHUNK)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("chunk", T.LongType()), rows.schema["id"],
                        T.StructField("n_words", T.LongType()), T.StructField("words", T.StringType())])

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            chunk, n = (task << 21) + k, b.num_rows
            words = [t.split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array((chunk << 20) + np.arange(n)), pa.array(np.full(n, chunk)), b.column(0),
                 pa.array(map(len, words), pa.int64()), pa.array(map(b" ".join, words), pa.binary()).cast(pa.string())], names=out.names)

    # Whole texts: as small as can be.
    return Scratch(docs.sparkSession).table(rows.mapInArrow(freed(run), out), "chunks", compression="zstd")


def partition_sketches(table: DataFrame, window: int, blocks: int, bits: int = BITS) -> DataFrame:
    """block, chunk, cells: the sketch of each chunk as messages to the blocks."""
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("cells", T.BinaryType())])

    def messages(chunk, texts, known):
        hashes = Chunk(texts, window, known).hashes
        block, cells = [], []
        for row in range(ROWS):
            cell, times = np.unique(cells_of(hashes, row, blocks, bits), return_counts=True)
            in_block = (cell >> np.uint64(bits)).astype(np.int64)
            coded = (cell & np.uint64((1 << bits) - 1)).astype(np.int64) << 1 | (times > 1)
            edges = [0, *(np.flatnonzero(np.diff(in_block)) + 1).tolist(), len(cell)] if len(cell) else [0]
            for s, e in zip(edges, edges[1:]):
                block.append(row * blocks + int(in_block[s]))
                cells.append(pack(coded[s:e]))
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([chunk] * len(block), pa.int64()),
                                           pa.array(cells, pa.binary())], names=out.names)

    def run(batches):
        known, now, texts = _WordHash(), None, []
        for b in batches:
            for chunk, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if chunk != now and texts:
                    yield messages(now, texts, known)
                    texts = []
                now = chunk
                texts.append(text)
        if texts:
            yield messages(now, texts, known)

    return table.select("chunk", "words").mapInArrow(freed(run), out)


def merged(sketches: DataFrame, bits: int = BITS) -> DataFrame:
    """chunk, block, cells: of each message, the cells that count two or more once
    all messages for the block are added up."""
    def add(t: pa.Table) -> pa.Table:
        count = np.zeros(1 << bits, np.uint8)
        sent = [unpack(m) for m in t.column("cells").to_pylist()]
        for coded in sent:
            count[coded >> 1] = np.minimum(count[coded >> 1] + 1 + (coded & 1), 2)
        back = [pack(c[count[c] > 1]) for c in (coded >> 1 for coded in sent)]
        return pa.table({"chunk": t.column("chunk"), "block": t.column("block"), "cells": pa.array(back, pa.binary())})

    return sketches.groupBy("block").applyInArrow(add, "chunk long, block long, cells binary")


def _first(rank: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts rows equal in ``same`` side by side, earlier places first,
    and which rows (in that order) are at the first place of their kind."""
    by = np.lexsort((start, rank, *same))
    new = np.ones(len(by), bool)
    new[1:] = np.any([k[by][1:] != k[by][:-1] for k in same], axis=0)
    head = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return by, (rank[by] == rank[by][head]) & (start[by] == start[by][head])


_STRETCH = ("lo", "hi", "least", "w1", "w2")


def candidates(table: DataFrame, repeated: DataFrame, window: int, blocks: int, bits: int = BITS) -> DataFrame:
    """row, id, lo, hi, least, w1, w2: stretches of windows estimated repeated (words lo
    to hi), the first place of each in a chunk.  Rows with null w1 are words that an
    earlier place in the chunk settles."""
    out = T.StructType([T.StructField("row", T.LongType()), table.schema["id"], *(T.StructField(n, T.LongType()) for n in _STRETCH)])
    id_type = to_arrow_schema(out).field("id").type

    def judge(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids = docs.column("id").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))
        docs = docs.take(pa.array(order, pa.int64()))
        ids = [ids[k] for k in order]
        rank = np.cumsum([0, *(a != b for a, b in zip(ids, ids[1:]))]) if ids else np.zeros(0, np.int64)
        chunk = Chunk(docs.column("words").cast(pa.binary()).to_pylist(), window, _WordHash())
        told = [[np.zeros(0, np.int64)] for _ in range(ROWS)]
        for block, cells in zip(answers.column("block").to_pylist(), answers.column("cells").to_pylist()):
            told[block // blocks].append((block % blocks << bits) + unpack(cells))
        which = np.arange(len(chunk.hashes))
        for row in range(ROWS):
            known = np.unique(np.concatenate(told[row]))
            cells = cells_of(chunk.hashes[which], row, blocks, bits).astype(np.int64)
            place = np.minimum(np.searchsorted(known, cells), max(len(known) - 1, 0))
            which = which[known[place] == cells] if len(known) else which[:0]
        least, at = chunk.least(which)
        edge = np.ones(len(which), bool)                         # where a stretch begins
        edge[1:] = (which[1:] != which[:-1] + 1) | (at[1:] != at[:-1]) | (chunk.doc[which[1:]] != chunk.doc[which[:-1]])
        s = np.flatnonzero(edge)
        e = np.append(s[1:], len(which))[:len(s)] - 1
        doc, least, lo, hi = chunk.doc[which[s]], least[s], chunk.start[which[s]], chunk.start[which[e]] + window
        digest = chunk.digests(doc, lo, hi)
        by, first = _first(rank[doc], lo, digest[:, 1], digest[:, 0], least)
        doc, least, lo, hi, digest = doc[by], least[by], lo[by], hi[by], digest[by]
        rows = docs.column("row").to_numpy()
        x, y, at = runs(doc[~first], lo[~first], hi[~first])
        none = pa.nulls(len(x), pa.int64())
        return pa.table({
            "row": pa.array(np.concatenate((rows[doc[first]], rows[at]))),
            "id": pa.array([ids[k] for k in doc[first].tolist()] + [ids[k] for k in at.tolist()], id_type),
            "lo": pa.array(np.concatenate((lo[first], x))), "hi": pa.array(np.concatenate((hi[first], y))),
            **{n: pa.concat_arrays([pa.array(v[first]), none]) for n, v in (("least", least), ("w1", digest[:, 0]), ("w2", digest[:, 1]))}})

    return table.select("chunk", "row", "id", "words").groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(judge, out)


def runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of words put together: first word, word after the last, document."""
    by = np.lexsort((lo, doc))
    doc, lo, hi = doc[by], lo[by], hi[by]
    base = int(hi.max(initial=0)) + 1
    far = np.maximum.accumulate(doc * base + hi)                 # how far the ones before reach
    edge = np.ones(len(doc), bool)
    edge[1:] = doc[1:] * base + lo[1:] > far[:-1]
    s = np.flatnonzero(edge)
    last = np.append(s[1:], len(doc))[:len(s)] - 1
    return lo[s], far[last] - doc[s] * base, doc[s]


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """row, id, lo, w1, w2: the distinct windows of the spans listed."""
    out = T.StructType([T.StructField("row", T.LongType()), texts.schema["id"], *(T.StructField(n, T.LongType()) for n in ("lo", "w1", "w2"))])

    def run(batches):
        for b in batches:
            known, spans = _WordHash(), b.column(3)
            for k, text in enumerate(b.column(2).cast(pa.binary()).to_pylist()):     # one text at a time
                listed = spans[k].values
                lo = np.unique(np.concatenate([np.arange(x, y - window + 1) for x, y in
                                               zip(listed.field("lo").to_pylist(), listed.field("hi").to_pylist())]))
                digest = Chunk([text], window, known).digests(np.zeros(len(lo), np.int64), lo, lo + window)
                at = pa.array(np.full(len(lo), k))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *map(pa.array, (
                    lo, np.ascontiguousarray(digest[:, 0]), np.ascontiguousarray(digest[:, 1])))], names=out.names)

    return texts.mapInArrow(freed(run), out)


def repeated_spans(table: DataFrame, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """row, spans: runs of words to remove, for each row of ``chunked`` that has
    any.  Spans may overlap."""
    total = table.agg(F.sum(F.greatest(F.col("n_words") - (window - 1), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-total * CELLS >> bits))
    repeated = merged(partition_sketches(table, window, blocks, bits), bits)
    made = Scratch(table.sparkSession)
    found = made.table(candidates(table, repeated, window, blocks, bits), "candidates")
    settled = found.where(F.col("w1").isNull()).select("row", "lo", "hi")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("lo").alias("lo"))
    kind = ["least", "w1", "w2"]

    # Equal stretches against the first of them; which buckets hold several kinds.
    kinds = made.table(found.where(F.col("w1").isNotNull()).groupBy(*kind)
                        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), "stretches")
    several = made.table(kinds.groupBy("least").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("least"), "several")
    asked = kinds.join(checked_broadcast(several.withColumn("mixed", F.lit(True))), "least", "left").where("n > 1 OR mixed")
    judged = made.table(found.join(asked.select(*kind, "first", "mixed").hint("merge"), kind)
                         .select("row", "id", "lo", "hi", (place > F.col("first")).alias("late"), "mixed"), "judged")
    late = judged.where("late").select("row", "lo", "hi")

    # The first of each kind of a mixed bucket, window by window.
    listed = judged.where("NOT late AND mixed").groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")) \
        .where(F.size("spans") > 0)
    texts = table.select("row", "id", "words").join(listed.hint("merge"), "row")
    made.drop(kinds, several)
    windows = made.table(_windows(texts, window), "windows")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")) \
        .where("n > 1").select("w1", "w2", "first")
    later = windows.join(again.hint("merge"), ["w1", "w2"]).where(place > F.col("first")) \
        .select("row", "lo", (F.col("lo") + window).alias("hi"))
    spans = materialize(settled.unionByName(late).unionByName(later).groupBy("row")
                       .agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "word-spans")
    made.drop(found, judged, windows)
    return spans


def cut(table: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """row, n_removed, kept (the words left, joined by one blank)."""
    spans = spans.where(F.size("spans") > 0).select("row", "spans").hint("merge")
    joined = table.select("row", "words").join(spans, "row", how).select("row", "words", "spans")
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches):
        for b in batches:
            gone, kept = [], []
            for text, listed in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2)):
                words = text.split(b" ") if text else []
                if listed.is_valid and len(words):
                    edges = np.zeros(len(words) + 1, np.int64)
                    span = listed.values
                    np.add.at(edges, span.field("lo").to_numpy(), 1)
                    np.add.at(edges, span.field("hi").to_numpy(), -1)
                    stay = np.cumsum(edges[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist()) if s]
                    gone.append(len(words) - len(left)), kept.append(b" ".join(left))
                else:
                    gone.append(0), kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=out.names)

    return joined.mapInArrow(freed(run), out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one blank)."""
    prune_by_bloom_filter(docs.sparkSession)
    table = chunked(docs, id_col, text_col)
    left = cut(table, repeated_spans(table, window), "left")
    return table.select("row", "id", "n_words").join(left, "row").select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept_sha256; one row per document.  Only texts that
    lose words are moved and cut."""
    prune_by_bloom_filter(docs.sparkSession)
    table = chunked(docs, id_col, text_col)
    less = cut(table, repeated_spans(table, window)).select("row", "n_removed", F.sha2("kept", 256).alias("less"))
    whole = table.select("row", "id", "n_words", F.sha2("words", 256).alias("whole"))
    return whole.join(less.hint("merge"), "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("less", "whole").alias("kept_sha256"))
