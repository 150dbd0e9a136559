"""The charset of raw bytes, found by statistics of byte pairs that are learned from a corpus.

The tables hold, for every charset, how often a byte follows another in the corpus's texts when these are encoded in it, apart for even and
odd offsets (which tells the two byte orders of 16-bit charsets apart). A text of unknown charset gets the charset under whose table its pairs
are likeliest among those that can decode it without an error.

Defined cases: NULL bytes have no charset. A byte order mark decides. Bytes below 0x80 without 0x00 are ``utf-8``, and so are bytes that are
valid UTF-8 without 0x00. Fewer than two bytes beyond that, or bytes that no charset decodes, have no charset (NULL), and
``decode_detected`` takes the declared one, or UTF-8. Ties go to the charset named first.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.sources.files import decode_other

CHARSETS = ("utf-8", "utf-16-le", "utf-16-be", "cp1252", "cp850", "mac-roman")
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
PAIRS = 1 << 17  # even and odd offsets, 256 x 256 pairs each
SLICE = 1 << 20  # an even number of bytes handled at a time


def _pairs(content: bytes) -> Iterator[np.ndarray]:
    """Numbers of the byte pairs at every offset, in slices, so that a long text needs little memory."""
    data = np.frombuffer(content, dtype=np.uint8)
    for at in range(0, len(data) - 1, SLICE):
        part = data[at : at + SLICE + 1].astype(np.int32)
        first, second = part[:-1], part[1:]
        numbers = (first << 8) | second
        numbers[1::2] |= 1 << 16
        yield numbers


def learn_pairs(texts: DataFrame, column: str = "text", charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """``charset, pair, n`` over all texts; a text that a charset cannot express does not count for it.

    A task holds one table of counts a charset, so the shuffle is at most 131,072 rows a charset and task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {c: np.zeros(PAIRS, dtype=np.int64) for c in charsets}
        waiting: dict[str, list[np.ndarray]] = {c: [] for c in charsets}

        def add() -> None:
            for c, parts in waiting.items():
                if parts:
                    seen[c] += np.bincount(np.concatenate(parts), minlength=PAIRS)
                    parts.clear()

        held = 0
        for batch in batches:
            for text in batch.column(0):
                value = text.as_py()
                for c in charsets if value else ():
                    try:
                        content = value.encode(c)
                    except UnicodeEncodeError:
                        continue
                    for numbers in _pairs(content):
                        waiting[c].append(numbers)
                        held += len(numbers)
                        if held >= SLICE:
                            add()
                            held = 0
        add()
        for c, counts in seen.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["charset", "pair", "n"])

    partial = texts.select(F.col(column).cast("string")).mapInArrow(count, "charset string, pair int, n long")
    return partial.groupBy("charset", "pair").agg(F.sum("n").alias("n"))


class Detector:
    """Detection by the counts of ``learn_pairs``, whose size is bounded by the charsets: half a megabyte each, sent to all tasks."""

    def __init__(self, pairs: DataFrame, charsets: Sequence[str] = CHARSETS):
        counts = {c: np.zeros(PAIRS) for c in charsets}
        for charset, part in pairs.filter(F.col("charset").isin(*charsets)).toPandas().groupby("charset"):
            counts[charset][part["pair"].to_numpy()] = part["n"].to_numpy()
        tables = {}
        for c, n in counts.items():
            rows = n.reshape(2, 256, 256) + 0.01  # pairs never seen stay possible
            tables[c] = np.log(rows / rows.sum(axis=2, keepdims=True)).reshape(-1).astype(np.float32)
        self._tables = pairs.sparkSession.sparkContext.broadcast(tables)

    def detect(self, content: Column) -> Column:
        """Name of the charset of ``content``, or NULL."""
        tables = self._tables

        @F.pandas_udf("string")
        def found(values: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else charset_of(bytes(v), tables.value) for v in values], dtype=object)

        return found(content)

    def decode_detected(self, content: Column, declared: Column | None = None) -> Column:
        """Text of ``content``: by the charset found, else the declared one, else UTF-8 with U+FFFD for bad bytes."""
        declared = F.lit(None).cast("string") if declared is None else declared
        tables = self._tables

        # One visit to Python finds the charset and decodes; UTF-8 is decoded natively and does not come back.
        @F.pandas_udf("charset string, text string")
        def found(values: pd.Series, named: pd.Series) -> pd.DataFrame:
            charsets, texts = [], []
            for value, name in zip(values, named):
                content = None if value is None else bytes(value)
                charset = None if content is None else charset_of(content, tables.value)
                charset = charset or name
                charsets.append(charset)
                texts.append(None if content is None else decode_other(content, charset))
            return pd.DataFrame({"charset": pd.Series(charsets, dtype=object), "text": pd.Series(texts, dtype=object)})

        got = found(content, declared)
        return F.coalesce(got["text"], F.when(content.isNotNull() & got["text"].isNull(), F.make_valid_utf8(content.cast("string"))))


def _decodes(content: bytes, charset: str) -> bool:
    try:
        content.decode(charset)
    except UnicodeDecodeError:
        return False
    return True


def charset_of(content: bytes, tables: dict[str, np.ndarray]) -> str | None:
    for mark, charset in MARKS:
        if content.startswith(mark):
            return charset
    if b"\0" not in content and _decodes(content, "utf-8"):
        return "utf-8"
    if len(content) < 2:
        return None
    able = [c for c in tables if _decodes(content, c)]
    score = dict.fromkeys(able, 0.0)
    for numbers in _pairs(content):
        for c in able:
            score[c] += float(tables[c][numbers].sum(dtype=np.float64))
    return max(able, key=score.__getitem__, default=None)
