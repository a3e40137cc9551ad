r"""WARC archives: writing, and reading by boundary-chain verification.

Writing: one record a line of Spark's text writer, the line end being the blank
lines that end a record, so files are plain WARC files and every task writes
its own.  Pages whose payload (of at least ``REVISIT`` bytes) equals that of a
page with a smaller id become revisit records.

Reading: files are split wherever the record magic stands, also inside
payloads, and may be read by many tasks.

1. Every task goes through its part of a file and emits, per magic that a
   readable header follows, a candidate: its offset and the offset where the
   next record must start.  Chains inside the part are followed at once to the
   first offset beyond it.
2. Parts get their offsets from the sums of the parts before them.
3. Reachability from the file's start is settled between parts by pointer
   jumping: links are composed with themselves, so a file of n parts takes
   log n rounds.  Each part thus learns the one offset where its chain starts.
4. Each part keeps the candidates on its chain.  A magic inside a payload is
   never reached.
5. A payload in one part was digested as it was read; one that holds the magic
   is put together from its pieces, keyed by the offset where its record ends.

Defined cases: null payloads are empty; null urls are empty; control
characters in urls are written as %20; null ids give records without a number
and come back as null; pages that repeat the smallest id of their payload are
all responses; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked_broadcast, freed, materialize, scratch_path, small_batches, whole_text

REVISIT = 100                        # bytes from which equal payloads are written once
MAGIC, CRLF = "WARC/1.1\r\n", "\r\n"
_STEP = len(MAGIC)
_URN = re.compile(rb"^<urn:page:(-?\d*)>$")


# --- writing -------------------------------------------------------------------

def revisits(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """page_id, digest, keep: the pages whose payload an earlier page holds.
    Only ids and digests move; counts fold before the shuffle."""
    large = pages.where(F.col("size") >= least).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return large.join(first.drop("n"), "digest").where("keep IS NOT NULL AND NOT page_id <=> keep").distinct()


def _record(kind: str, page: Column, url: Column, digest: Column, body: Column, refers: Column | None = None) -> Column:
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [F.lit(f"{MAGIC}WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), urn(page)),
             F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), url),
             F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest)]
    if refers is not None:
        lines += [F.concat(F.lit("WARC-Refers-To: "), urn(refers)),
                  F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
          least: int = REVISIT) -> None:
    """One archive file per task in the folder ``path``."""
    body = whole_text(payload_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.regexp_replace(whole_text(url_col), r"[\x00-\x1F\x7F]", "%20").alias("url"),
                        body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    again = materialize(revisits(rows, least), "revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "keep")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    both = rows.join(checked_broadcast(again), same, "left")
    page, url, digest = F.col("page_id"), F.col("url"), F.col("digest")
    record = F.when(F.col("keep").isNull(), _record("response", page, url, digest, F.col("body"))) \
        .otherwise(_record("revisit", page, url, digest, F.lit(""), F.col("keep")))
    both.select(record.alias("value")).write.mode("overwrite").option("lineSep", CRLF + CRLF).text(path)


# --- reading -------------------------------------------------------------------

def _header(chunk: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """Length of the header that follows a magic, and its fields; None if it isn't one."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict(line.split(b": ", 1) for line in chunk[:end].split(b"\r\n") if b": " in line)
    if not fields.get(b"Content-Length", b"").isdigit() or b"WARC-Type" not in fields or b"WARC-Record-ID" not in fields:
        return None
    return end + 4, fields


def _page(urn: bytes | None) -> int | None:
    m = _URN.match(urn or b"")
    return int(m[1]) if m and m[1] not in (b"", b"-") else None


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its part starts), value: the bytes between two magics, in order."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


_PLACED = "file string, block long, rel long, size long"
_CANDIDATE = (_PLACED + ", ends long, leaves long, type string, page_id long, uri string, refers_to long, digest string, length long, "
              "whole boolean, sha string")


def _placed(batches):
    """(file, block, offset in the part, size, value) of every chunk in turn."""
    key, rel = None, 0
    for b in batches:
        files, blocks, values = (b.column(k).to_pylist() for k in range(3))
        for f, k, v in zip(files, blocks, values):
            if (f, k) != key:
                key, rel = (f, k), 0
                size = len(v) if k == 0 else len(v) + _STEP   # before the first magic of a file there is none
            else:
                size = len(v) + _STEP
            yield f, k, rel, size, v
            rel += size


def _leaves(part: list[list]) -> None:
    """For each candidate of a part, the first offset of its chain beyond the
    part (or one that no candidate of the part has)."""
    where: dict[int, int] = {}
    for row in reversed(part):
        if row[4] is not None:
            row[5] = where[row[2]] = where.get(row[4], row[4])


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All chunks; those that a readable header starts have ``ends``."""
    out = T._parse_datatype_string(_CANDIDATE)
    schema = pa.schema([(f.name, {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()])
                        for f in out.fields])

    def run(batches):
        part, key = [], None

        def flush():
            _leaves(part)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(schema.types)], schema=schema)

        for f, block, rel, size, v in _placed(batches):
            if (f, block) != key and part:
                yield flush()
                part = []
            key = (f, block)
            row = [f, block, rel, size] + [None] * 8 + [False, None]
            head = _header(v) if size > len(v) else None
            if head:
                at, fields = head
                n = int(fields[b"Content-Length"])
                text = lambda k: fields.get(k, b"").decode("utf-8", "replace")
                row[4] = rel + _STEP + at + n + 4
                row[6:12] = [text(b"WARC-Type"), _page(fields[b"WARC-Record-ID"]), text(b"WARC-Target-URI"),
                             _page(fields.get(b"WARC-Refers-To")), text(b"WARC-Payload-Digest").removeprefix("sha256:"), n]
                if len(v) == at + n + 4:
                    row[12], row[13] = True, hashlib.sha256(v[at:at + n]).hexdigest()
            part.append(row)
        if part:
            yield flush()

    return _chunks(spark, path).mapInArrow(freed(run), out)


def _reach(links: DataFrame, rounds: int) -> DataFrame:
    """file, pos: what can be reached from the start of each file.  Every round
    doubles the length of the links."""
    reached = links.select("file").distinct().withColumn("pos", F.lit(0).cast("long"))
    for k in range(rounds):
        step = reached.join(links, ["file", "pos"]).select("file", F.col("to").alias("pos"))
        reached = materialize(reached.unionByName(step).distinct(), "reached")
        if k < rounds - 1:
            on = links.select("file", F.col("pos").alias("to"), F.col("to").alias("_to"))
            links = materialize(links.join(on, ["file", "to"]).select("file", "pos", F.col("_to").alias("to")), "links")
    return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, pos, type, page_id, uri, refers_to, digest (as
    the header says), length and sha (of the payload as read), key and whole."""
    small_batches(spark)
    found = materialize(candidates(spark, path), "candidates")
    parts = found.groupBy("file", "block").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "block", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    most = parts.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    links = found.where("ends IS NOT NULL").join(parts, ["file", "block"]) \
        .select("file", (F.col("base") + F.col("rel")).alias("pos"), (F.col("base") + F.col("leaves")).alias("to"))
    reached = _reach(links, max(0, (most - 1).bit_length()))
    # Each part's entry is the one reached offset inside it.
    r, p = reached.alias("r"), parts.alias("p")
    inside = (F.col("r.file") == F.col("p.file")) & (F.col("r.pos") >= F.col("p.base")) & (F.col("r.pos") < F.col("p.base") + F.col("p.size"))
    entries = p.join(r, inside, "left").groupBy("p.file", "p.block").agg(F.min("r.pos").alias("entry"), F.min("p.base").alias("base"))
    after = Window.partitionBy("file").orderBy("block").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # A last record that runs over several parts ends where the file's chain ends.
    last = reached.groupBy("file").agg(F.max("pos").alias("end"))
    entries = entries.join(last, "file").withColumn("next_entry", F.coalesce(F.first("entry", ignorenulls=True).over(after), F.col("end")))
    entries = entries.drop("end")

    out = found.drop("rel", "ends", "leaves", "size").schema
    out = T.StructType([*out.fields, *(T.StructField(n, T.LongType()) for n in ("pos", "key", "rel"))])

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        """The records of a part, and pieces of records, by the offset where their record ends."""
        part = part.sort_values("rel", kind="stable")
        base, entry, carry = (None if pd.isna(x) else int(x) for x in part[["base", "entry", "next_entry"]].iloc[0])
        keep, wanted, owner = [], entry, carry
        rels, ends = part["rel"].tolist(), part["ends"].tolist()
        for k, (rel, end) in enumerate(zip(rels, ends)):
            if base + rel == wanted and not pd.isna(end):
                wanted = owner = base + int(end)
                keep.append((k, base + rel, owner))
            elif owner is not None and (wanted is None or base + rel < wanted):
                keep.append((k, None, owner))
        at = [k for k, *_ in keep]
        got = part.iloc[at].drop(columns=["base", "entry", "next_entry", "ends", "leaves", "size"])
        got = got.assign(pos=pd.array([x for _, x, _ in keep], "Int64"), key=pd.array([x for *_, x in keep], "Int64"))
        return got[out.names]

    kept = found.join(entries, ["file", "block"]).groupBy("file", "block").applyInPandas(chain, out)
    kept = materialize(kept, "kept")
    # Records with the magic in their payload: their pieces are read once more.
    torn = kept.where("pos IS NOT NULL AND NOT whole").select("file", "key", F.col("length").alias("payload"))
    records = kept.where("pos IS NOT NULL")
    if torn.isEmpty():
        return records.drop("block", "rel")
    pieces = kept.join(torn, ["file", "key"]).select("file", "block", "rel", "key", "payload")
    joined = _with_values(spark, path, materialize(pieces, "pieces"))
    mended = (joined.groupBy("file", "key", "payload").agg(F.sort_array(F.collect_list(F.struct("block", "rel", "value"))).alias("all"))
              .select("file", "key", F.sha2(_payload(), 256).alias("_sha")))
    return records.join(mended, ["file", "key"], "left").withColumn("sha", F.coalesce("sha", "_sha")).drop("_sha", "block", "rel")


def _payload() -> Column:
    """The payload from a record's pieces in order: the magic stood between them."""
    raw = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["value"])), MAGIC.encode().hex().upper()))
    return F.substring(raw, (F.octet_length(raw) - F.col("payload") - 3).cast("int"), F.col("payload").cast("int"))


def _with_values(spark: SparkSession, path: str, pieces: DataFrame) -> DataFrame:
    """``pieces(file, block, rel, ...)`` with their bytes."""
    out = T._parse_datatype_string("file string, block long, rel long, value binary")

    def run(batches):
        rows, size = [], 0

        def flush():
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=out.names)

        for f, block, rel, length, v in _placed(batches):
            if length == len(v):
                continue   # what stands before the first magic of a file
            rows.append((f, block, rel, v))
            size += len(v)
            if size > 1 << 22:
                yield flush()
                rows, size = [], 0
        yield flush()

    return _chunks(spark, path).mapInArrow(freed(run), out).join(checked_broadcast(pieces), ["file", "block", "rel"])


def page_report(spark: SparkSession, pages: DataFrame, path: str | None = None, least: int = REVISIT) -> DataFrame:
    """Write the pages, read the archives back; per page: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    path = path or scratch_path(spark, "warc")
    write(pages, path, least=least)
    records = read(spark, path)
    whole = records.where("type = 'response'")
    firsts = whole.where(F.col("length") >= least).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("length").alias("_length")).distinct()
    again = records.where("type = 'revisit'").alias("r").join(
        firsts, (F.col("r.refers_to") == F.col("_id")) & (F.col("r.digest") == F.col("_sha")), "left")
    null = F.lit(None).cast("long")
    return whole.select("page_id", F.col("length").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
                        F.col("type").alias("record_type"), null.alias("refers_to")) \
        .unionByName(again.select("page_id", F.col("_length").alias("payload_bytes"), F.col("_sha").alias("payload_digest"),
                                  F.col("type").alias("record_type"), "refers_to"))
