r"""Fill-in-the-middle transformation with a sparse exception index.

A text is cut in two places and its parts are put in another order between
marks: psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm is ``<S>``
suffix ``<P>`` prefix ``<M>`` middle, plain is the text itself.  The parts are
cut after a number of units, tokens
(``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``) or code points.

Texts are handled as UTF-8 bytes and never as arrays of code points.  The index
lists only the characters of several bytes, where each starts and how many
bytes it has beyond one.  A cut in bytes becomes a cut in code points by
``searchsorted`` over that list and one subtraction, the reverse by the same
search and one addition; stretches of ASCII need no entry.  Blanks are ASCII,
so token ends are found in the bytes too.

All choices come from ``sha256("<seed>:<id>")``, so a row gets the same form
wherever it is read.  No mark can arise where two parts meet, since marks have
no common border; texts that hold a mark stay plain.  So the first marks of an
output are the ones put in, and ``restore`` rebuilds the text from output and
form alone.

Defined cases: null text counts as empty (0 units, plain); a null id hashes
like an empty id; rows that repeat get equal results; an empty table gives an
empty result; further columns are ignored.  A text is never split between
tasks, and no row needs another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, small_batches, whole_text

SEED, RATE, SPM = 42, 50, 80
# The marks of the output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


class ExceptionIndex:
    """Where the characters of several bytes stand in a UTF-8 text."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)                     # their first bytes
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate(([0], np.cumsum(excess)))     # excess of the first k of them
        self.nth = self.at - self.before[:-1]                      # the same places in code points
        self.chars = len(data) - int(self.before[-1])

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Cuts in bytes (at the edge of a character) as cuts in code points."""
        return cuts - self.before[np.searchsorted(self.at, cuts)]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Cuts in code points as cuts in bytes."""
        return cuts + self.before[np.searchsorted(self.nth, cuts)]


def token_ends(data: np.ndarray) -> np.ndarray:
    """The byte after each token."""
    if not len(data):
        return np.zeros(0, np.int64)
    blank = _BLANK[data]
    return np.append(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, len(data))


def infill(text: str, key: str, rate: int = RATE, spm: int = SPM, unit: str = "token"):
    """units, form, prefix and middle in code points (None if plain), output
    bytes of one text; ``key`` decides the form and the cuts."""
    raw = text.encode("utf-8")
    data = np.frombuffer(raw, np.uint8)
    ends = token_ends(data) if unit == "token" else None
    digest = hashlib.sha256(key.encode("utf-8")).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))
    index = None
    if ends is None:
        index = ExceptionIndex(data)
    n = index.chars if ends is None else len(ends)
    if not raw or h3 % 100 >= rate or PREFIX in raw or SUFFIX in raw or MIDDLE in raw:
        return n, "plain", None, None, raw
    index = index or ExceptionIndex(data)
    units = np.array(sorted((h1 % (n + 1), h2 % (n + 1))), np.int64)
    if ends is None:
        chars, cuts = units, index.to_bytes(units)
    else:
        cuts = np.where(units > 0, ends[units - 1], 0)
        chars = index.to_chars(cuts)
    a, b = cuts.tolist()
    form = "spm" if h4 % 100 < spm else "psm"
    parts = (SUFFIX, raw[b:], PREFIX, raw[:a]) if form == "spm" else (PREFIX, raw[:a], SUFFIX, raw[b:])
    return n, form, int(chars[0]), int(chars[1] - chars[0]), b"".join((*parts, MIDDLE, raw[a:b]))


def rebuilt(output: bytes, form: str) -> bytes:
    """The text that ``infill`` gave as ``output`` in ``form``."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    i = output.index(second, len(first))
    j = output.index(MIDDLE, i + len(second))
    one, two, middle = output[len(first):i], output[i + len(second):j], output[j + len(MIDDLE):]
    return two + middle + one if form == "spm" else one + middle + two


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
              spm: int = SPM, unit: str = "token") -> DataFrame:
    """id, n (units of the text), form, prefix_chars, middle_chars, output; one
    row per document.  ``rate`` per cent of the texts are transformed, ``spm``
    per cent of those as spm; ``unit`` is "token" or "char"."""
    if unit not in ("token", "char"):
        raise ValueError("unit must be 'token' or 'char'")
    small_batches(docs.sparkSession)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), whole_text(text_col).alias("text"))
    out = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                        T.StructField("output", T.StringType())])

    def run(batches):
        for b in batches:
            got = [infill(t, k, rate, spm, unit) for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            n, form, first, middle, text = zip(*got) if got else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=out.names)

    return rows.mapInArrow(freed(run), out).withColumnRenamed("id", id_col)


def restore(infilled: DataFrame) -> DataFrame:
    """``infilled`` and ``restored``, the text rebuilt from ``output`` and ``form``."""
    out = T.StructType([*infilled.schema.fields, T.StructField("restored", T.StringType())])
    output, form = infilled.columns.index("output"), infilled.columns.index("form")

    def run(batches):
        for b in batches:
            texts = [rebuilt(o, f) for o, f in zip(b.column(output).cast(pa.binary()).to_pylist(), b.column(form).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=out.names)

    return infilled.mapInArrow(freed(run), out)
