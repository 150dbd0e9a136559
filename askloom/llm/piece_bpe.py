"""Merge-type sentencepiece models: exact encoding by backtracking over longest matches, and decoding, in Arrow batches.

Merging applies, among all neighbours whose joint text is a piece, the one of the best score first, the leftmost of equals. Two facts
let a search find the same pieces without merging the whole text:

- pieces t1 ... tn are the merges' result if and only if every ti alone, and every pair ti ti+1 alone, merges to itself. (The first
  merge to cross a border would also be the first in the text of the two pieces at that border.)
- so the pieces of a prefix are unique, and whether a position can be gone on from depends on the position alone.

The search takes the longest piece at its position (an Aho-Corasick automaton over the reversed pieces, run once over the reversed
text, names it for all positions), then ever shorter ones, until one fits the piece before it. ``fits`` decides that by merging the
two anew, and keeps its answers. A position where nothing fits is marked in a bitfield and never tried again, so each position
fails once at most. A text is cut where no piece can span (before a run of blanks, around line feeds, both verified from
the vocabulary); a bounded table of the model keeps the ids of short parts met before.

NULL and empty texts have begin and end ids only, and decode to the empty text. Every row is encoded, repeated ones too. A character
without a piece becomes its bytes' pieces, or the unknown id, one for a run, in models without these. Models whose normalizer
changes texts beyond marking blanks, or that have user-defined or unused pieces, are refused with a ValueError.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.words import slices

MARK = "▁"
GROUP_BYTES = 1 << 20
KEPT_PARTS = 400_000
LONGEST_KEPT = 48
KEPT_PAIRS = 500_000

codecs.register_error("one-by-one", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message; a message inside is its bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def _packed(k: int) -> bytes:
    return k.to_bytes(4, "little")


class Pieces:
    """A model's pieces, and what has been learned of its texts so far."""

    def __init__(self, content: bytes):
        # Field numbers and piece types are those of the published model format.
        top = list(_fields(content))
        trainer = {k: v for f, raw in top if f == 2 for k, v in _fields(raw)}
        normalizer = {k: v for f, raw in top if f == 3 for k, v in _fields(raw)}
        rows = [dict(_fields(raw)) for f, raw in top if f == 1]
        kinds = [r.get(3, 1) for r in rows]
        plain = trainer.get(3) == 2 and not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if not plain or trainer.get(24) or {4, 5} & set(kinds):
            raise ValueError("not a merge-type model that only marks blanks")
        names = [r.get(1, b"").decode() for r in rows]
        scores = np.frombuffer(b"".join(r.get(2, b"\0\0\0\0") for r in rows), "<f4").tolist()
        self.id = {p: k for k, (p, kind) in enumerate(zip(names, kinds, strict=True)) if kind == 1}
        self.id_bytes = {p: _packed(k) for p, k in self.id.items()}
        self.order = {p: -scores[k] for p, k in self.id.items()}
        self.byte = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(names, kinds, strict=True)) if kind == 6}
        self.unknown = kinds.index(2)
        self.begin, self.end = (names.index(trainer.get(k, d).decode()) for k, d in ((46, b"<s>"), (47, b"</s>")))
        surface = {self.unknown: trainer.get(44, " ⁇ ".encode())} | {k: bytes([b]) for b, k in self.byte.items()}
        self.surface = [surface.get(k, p.replace(MARK, " ").encode() if kind == 1 else b"") for k, (p, kind) in enumerate(zip(names, kinds, strict=True))]
        self.marks = {k for k, kind in enumerate(kinds) if kind == 3}
        self.starts_blank = [kind == 1 and p.startswith(MARK) for p, kind in zip(names, kinds, strict=True)]
        self._search_tables()
        self._cuts()
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _search_tables(self) -> None:
        import ahocorasick

        whole = {p for p in self.id if len(p) > 1 and self.merge(p) == [p]}
        self.longest = ahocorasick.Automaton()
        for p in whole:
            self.longest.add_word(p[::-1], len(p))
        self.longest.make_automaton()
        # Length of the next shorter piece that a piece starts with; any single character counts as one.
        self.shorter = {p: next(k for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in whole) for p in whole}
        self.any_piece = bool(whole)

    def _cuts(self) -> None:
        spans = [p for p in self.id if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in spans):
            self.part = None
        elif any("\n" in p for p in spans):
            self.part = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        else:
            self.part = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging."""
        out, order = list(text), self.order
        while len(out) > 1:
            ranks = [order.get(a + b, np.inf) for a, b in zip(out, out[1:])]
            best = min(ranks)
            if best == np.inf:
                break
            k = ranks.index(best)
            out[k : k + 2] = [out[k] + out[k + 1]]
        return out

    def fits(self, left: str, right: str) -> bool:
        """Whether the two neighbours stay as they are when their joint text is merged anew; kept in ``pairs``."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        stay = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return stay

    def search(self, text: str) -> list[str]:
        """Pieces of a part of a normalized text."""
        n = len(text)
        longest = [1] * n
        if self.any_piece:
            for end, length in self.longest.iter(text[::-1]):
                at = n - 1 - end
                if length > longest[at]:
                    longest[at] = length
        out: list[str] = []
        known, failed = self.pairs.get, None
        at, length, last = 0, longest[0] if n else 0, None
        while at < n:
            end = at + length
            piece = text[at:end]
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                ok = last is None or known((last, piece))
                if ok is None:
                    ok = self.fits(last, piece)
            else:
                ok = False
            if ok:
                out.append(piece)
                at, last = end, piece
                length = longest[at] if at < n else 0
            elif length > 1:
                length = self.shorter[piece]
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                length = len(out.pop())
                at, last = at - length, out[-1] if out else None
        return out

    def ids_of(self, pieces: list[str]) -> bytes:
        """Ids of pieces, as little-endian unsigned 32-bit integers."""
        out = map(self.id_bytes.get, pieces)
        return b"".join([i if i is not None else self._unknown(p) for i, p in zip(out, pieces, strict=True)])

    def _unknown(self, character: str) -> bytes:
        return b"".join([_packed(self.byte[b]) for b in character.encode()]) if self.byte else _packed(self.unknown)

    def normalized(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode_parts(self, parts: set[str]) -> None:
        """Adds the ids of parts, as little-endian unsigned 32-bit integers, to ``kept``."""
        for p in parts:
            self.kept[p] = self.id_bytes[p] if p in self.shorter else self.ids_of(self.search(p))

    def encode(self, texts: list[str], group_bytes: int = GROUP_BYTES) -> Iterator[bytes]:
        """Ids of each text, with begin and end, as little-endian unsigned 32-bit integers."""
        first, last = _packed(self.begin), _packed(self.end)
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= group_bytes):
                size += len(texts[stop])
                stop += 1
            found = [self.part(t) if self.part else [t] * bool(t) for t in map(self.normalized, texts[start:stop])]
            new = set().union(*found) - self.kept.keys()
            if len(self.kept) + len(new) > KEPT_PARTS:
                self.kept.clear()
                new = set().union(*found)
            self.encode_parts(new)
            for parts in found:
                ids = b"".join(map(self.kept.__getitem__, parts))
                yield first + (ids if self.byte else self._one_unknown(ids)) + last
            for p in new:
                if len(p) > LONGEST_KEPT:
                    del self.kept[p]
            start = stop

    def _one_unknown(self, ids: bytes) -> bytes:
        """A run of unknown ids that parts left next to each other, as one."""
        a = np.frombuffer(ids, "<u4")
        again = np.zeros(len(a), bool)
        again[1:] = (a[1:] == self.unknown) & (a[:-1] == self.unknown)
        return a[~again].tobytes()

    def decode(self, ids: bytes) -> str:
        """The text that ids stand for: the first piece loses the blank that encoding puts there; bytes that are no text become U+FFFD each."""
        names = np.frombuffer(ids, "<u4").tolist()
        first = next((k for k in names if self.surface[k]), None)
        if self.marks.isdisjoint(names[1:-1]):
            runs = [names]
        else:  # bytes on both sides of a mark are not joined
            runs = [list(run) for mark, run in groupby(names, self.marks.__contains__) if not mark]
        text = "".join(b"".join(map(self.surface.__getitem__, run)).decode(errors="one-by-one") for run in runs)
        return text[1:] if first is not None and self.starts_blank[first] else text


@lru_cache(maxsize=4)
def load(content: bytes) -> Pieces:
    """The model of each content, with its own tables; two models in one worker don't meet."""
    return Pieces(content)


def encode(docs: DataFrame, content: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, n_tokens and ids (BINARY, little-endian unsigned 32-bit integers, begin and end with them) of every text.

    ``content`` is the content of a sentencepiece model file.
    """
    return round_trip(docs, content, id_column, text_column, decoded=False)


def round_trip(docs: DataFrame, content: bytes, id_column: str = "doc_id", text_column: str = "text", decoded: bool = True) -> DataFrame:
    """What ``encode`` gives, and decoded (STRING), the text that the ids decode to, from the same worker."""
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(content)
        for part in (p for batch in batches for p in slices(batch, most=GROUP_BYTES)):
            ids = list(model.encode([t or "" for t in part.column("text").to_pylist()]))
            columns = {"id": part.column("id"), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array(map(model.decode, ids), pa.string())
            yield pa.RecordBatch.from_pydict(columns)
            del ids, columns
        pa.default_memory_pool().release_unused()

    out = source.mapInArrow(run, f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, content: bytes) -> DataFrame:
    """The given columns but any named decoded, and decoded (STRING): the text that ``ids`` stand for. NULL ids decode to NULL."""
    source = encoded.drop("decoded")
    kind = f"{source.schema.simpleString()[7:-1]},decoded:string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(content)
        for batch in batches:
            texts = [None if i is None else model.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return source.mapInArrow(run, kind)


def digests(docs: DataFrame, content: bytes) -> DataFrame:
    """doc_id, n_tokens, and sha-256 of the ids and of the decoded text, of every text."""
    both = round_trip(docs, content)
    sha = F.sha2(F.col("decoded").cast("binary"), 256)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), sha.alias("decoded_sha256"))
