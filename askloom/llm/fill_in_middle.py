"""Fill-in-middle renderings of documents, cut between lines, with line counts kept for chunks that documents share.

Cutting a text after its k-th line needs the number of its lines and the place of one line end. Both come from chunks:

- a rolling hash of the last ``WINDOW`` bytes ends a chunk wherever its upper ``CHUNK_BITS`` bits are zero, so equal passages of
  different documents fall into equal chunks; a run without such a place is cut every ``LONGEST`` bytes, counted from the chunk's start.
- a chunk's boundary summary says how many lines end in it, how many characters begin in it, and whether its last byte ends a line.
  It is made once for a chunk and kept under the chunk's hash, together with the chunk itself: a summary is taken from the table
  only if the bytes are equal, so two chunks of one hash never share it.
- sums of the summaries give the number of lines (plus an open last one), the chunk in which the k-th line ends, and the number of
  characters before it; only this chunk is looked at again.

The table is bounded by bytes and belongs to a worker; it changes no result. Work and memory are linear in a block of texts.

NULL and empty texts are plain, with n = 0 and an empty output; so are texts that contain a mark. A NULL id counts as the empty string
in the draw. Repeated rows get the same rendering each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm.words import buffers, mix, slices

MARKS = ("<P>", "<S>", "<M>")
WINDOW = 16
CHUNK_BITS = 8
LONGEST = 4096
BLOCK_BYTES = 4 << 20
KEPT_BYTES = 64 << 20
BASE = 0x9E3779B97F4A7C15

ORACLE = """
    WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS us,
                      sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    d AS (SELECT *, len(us) AS n, [('0x' || substr(h, 8 * k + 1, 8))::UBIGINT for k in range(4)] AS hs FROM u),
    c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1))::BIGINT AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1))::BIGINT AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                      WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre, coalesce(array_to_string(us[a + 1:b], ''), '') AS mid,
                 coalesce(array_to_string(us[b + 1:n], ''), '') AS suf FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending ends of the chunks of the texts ``data[offsets[i]:offsets[i + 1]]``; empty texts have none."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    rolled = data.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < WINDOW:  # a window of twice the width is two windows beside each other
        base = np.uint64(pow(BASE, width, 1 << 64))
        rolled[width:] += rolled[:-width] * base  # reads a copy made by the product
        width *= 2
    found = np.flatnonzero(mix(rolled) >> np.uint64(64 - CHUNK_BITS) == 0) + 1
    # A window that reaches into the text before is that of no passage.
    found = found[found - offsets[np.searchsorted(offsets, found, "left") - 1] >= WINDOW]
    ends = np.union1d(found, offsets[1:][np.diff(offsets) > 0])
    starts = np.concatenate([[0], ends[:-1]])
    extra = (ends - starts - 1) // LONGEST
    if extra.any():
        again = np.repeat(starts, extra)
        step = np.arange(len(again)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        ends = np.union1d(ends, again + step * LONGEST)
    return ends


def chunk_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every chunk, from its bytes alone."""
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    place = (np.arange(len(data)) - np.repeat(starts, ends - starts)).astype(np.uint64)
    weights = mix(place + np.uint64(BASE)) | np.uint64(1)
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * weights, starts)
    return mix(sums + (ends - starts).astype(np.uint64))


Summary = tuple[int, int, bool]


def summary(chunk: bytes) -> Summary:
    """Line ends and characters (counted at their first byte) of a chunk, and whether its last byte ends a line."""
    raw = np.frombuffer(chunk, np.uint8)
    return chunk.count(b"\n"), int(np.count_nonzero(raw & 0xC0 != 0x80)), chunk.endswith(b"\n")


class Summaries:
    """Boundary summaries of chunks met before, by hash, verified by content; emptied when its chunks exceed ``most`` bytes."""

    def __init__(self, most: int = KEPT_BYTES):
        self.kept: dict[int, tuple[bytes, Summary]] = {}
        self.most, self.size, self.hits = most, 0, 0

    def of(self, key: int, chunk: bytes) -> Summary:
        known = self.kept.get(key)
        if known is not None:
            if known[0] == chunk:
                self.hits += 1
                return known[1]
            return summary(chunk)  # another chunk of the same hash: the first keeps the place
        if self.size + len(chunk) + 200 > self.most:
            self.kept.clear()
            self.size = 0
        found = summary(chunk)
        self.kept[key] = chunk, found
        self.size += len(chunk) + 200
        return found


_summaries = Summaries()


class Lines:
    """Line counts of a block of texts, and the places of their line ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, summaries: Summaries):
        self.raw, self.offsets = data.tobytes(), offsets
        self.ends = chunk_ends(data, offsets)
        cuts = [0, *self.ends.tolist()]
        keys = chunk_hashes(data, self.ends).tolist()
        found = [summaries.of(k, self.raw[a:b]) for k, a, b in zip(keys, cuts, cuts[1:])]
        self.line_ends = np.cumsum([0, *(s[0] for s in found)])
        self.chars = np.cumsum([0, *(s[1] for s in found)])
        # Chunks first[i]:first[i + 1] are those of text i.
        self.first = np.searchsorted(self.ends, offsets, "right")
        ended = np.array([s[2] for s in found], bool)
        full = np.diff(offsets) > 0
        open_ = np.zeros(len(offsets) - 1, np.int64)
        open_[full] = ~ended[self.first[1:][full] - 1]
        self.count = self.line_ends[self.first[1:]] - self.line_ends[self.first[:-1]] + open_

    def cut(self, text: int, lines: int) -> tuple[int, int]:
        """Bytes and characters of the text's first ``lines`` lines."""
        begin, end, first, last = self.offsets[text], self.offsets[text + 1], self.first[text], self.first[text + 1]
        before = self.line_ends[first]
        if lines == 0:
            return 0, 0
        if lines > self.line_ends[last] - before:  # up to the open line's end
            return int(end - begin), int(self.chars[last] - self.chars[first])
        chunk = int(np.searchsorted(self.line_ends, before + lines, "left")) - 1
        start = int(self.ends[chunk - 1]) if chunk else 0
        at = start
        for _ in range(int(before + lines - self.line_ends[chunk])):
            at = self.raw.index(b"\n", at) + 1
        inside = np.frombuffer(self.raw, np.uint8, at - start, start)
        chars = int(self.chars[chunk] - self.chars[first]) + int(np.count_nonzero(inside & 0xC0 != 0x80))
        return at - int(begin), chars


def transform(
    docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: str = "7", marks: Sequence[str] = MARKS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id_column``, n (lines), form, prefix_chars, middle_chars and output (STRING) of every text.

    Of 100 texts about ``rate`` are cut, ``spm_rate`` of 100 of these suffix first. The draw depends on ``seed`` and the id alone.
    ``marks`` stand before prefix, suffix and middle; each begins with a character that it holds only there, and none is in another.
    """
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    source = source.withColumn("draw", draw)
    kind = source.schema["id"].dataType.simpleString()

    def render(text: int, lines: Lines, drawn: str) -> tuple[str, int | None, int | None, bytes]:
        whole = lines.raw[lines.offsets[text] : lines.offsets[text + 1]]
        h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
        if not whole or h3 % 100 >= rate or prefix_mark in whole or suffix_mark in whole or middle_mark in whole:
            return "plain", None, None, whole
        n = int(lines.count[text]) + 1
        (a, a_chars), (b, b_chars) = (lines.cut(text, k) for k in sorted((h1 % n, h2 % n)))
        head, middle, tail = prefix_mark + whole[:a], middle_mark + whole[a:b], suffix_mark + whole[b:]
        if h4 % 100 < spm_rate:
            return "spm", a_chars, b_chars - a_chars, tail + head + middle
        return "psm", a_chars, b_chars - a_chars, head + tail + middle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, most=BLOCK_BYTES)):
            lines = Lines(*buffers(part.column("text")), _summaries)
            form, before, middle, output = zip(*(render(k, lines, h) for k, h in enumerate(part.column("draw").to_pylist())), strict=True)
            chars = [pa.array(x, pa.int64()) for x in (before, middle)]
            columns = [part.column("id"), pa.array(lines.count), pa.array(form), *chars, pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
            del lines, output, columns

    out = source.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_column)


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that a rendering was made of."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks))  # texts that hold a mark are plain, so there are three marks
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and sha-256 of the rendering and of the text rebuilt from it."""
    made = transform(docs)

    def sha(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    rebuilt = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(rebuilt).alias("restored_sha256"))
