"""Token counts of texts by a sentencepiece model: Arrow batches in, lengths only out.

A text is split at safe boundaries: a single space (or its stand-in U+2581) between two characters that are neither. The
model's pieces hold that mark only at their start (``splits_at_spaces`` verifies this from the vocabulary), and its
normalizer must leave texts alone, so no token spans such a boundary and lengths add up exactly. A model for which this
is not so gets whole texts. Parts that a worker has not met yet are encoded in batches of about equal bytes; a bounded
table keeps the lengths of parts met before.

NULL and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
GROUP_BYTES = 4 << 20
BATCH_BYTES = 1 << 20
KEPT_PARTS = 400_000
LONGEST_KEPT = 64


@lru_cache(maxsize=2)
def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(maxsize=2)
def known_lengths(model: bytes) -> dict[str, int]:
    """One encoded length per part of text, for each model; shared by the tasks of a worker."""
    return {}


@lru_cache(maxsize=2)
def splits_at_spaces(model: bytes) -> bool:
    """Whether no piece goes on past a space and the normalizer keeps single spaces and characters as they are."""
    sp = processor(model)
    if any(MARK in sp.id_to_piece(k).lstrip(MARK) for k in range(sp.get_piece_size())):
        return False
    probe = "a ﬁ Å ① Ａ"
    return sp.normalize(probe).replace(MARK, " ").strip() == probe


def parts_of(text: str) -> list[str]:
    """The text's parts between safe boundaries."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return SAFE.split(text)
    return text.split(" ")


def balanced(parts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Parts in lists of about ``most`` characters; a longer part is a list of its own."""
    batch, size = [], 0
    for p in parts:
        if batch and size + len(p) > most:
            yield batch
            batch, size = [], 0
        batch.append(p)
        size += len(p)
    if batch:
        yield batch


def lengths(texts: list[str], model: bytes) -> list[int]:
    """Number of tokens of each text."""
    sp, split, known, out = processor(model), splits_at_spaces(model), known_lengths(model), []
    for group in balanced(texts, GROUP_BYTES):
        parts = [parts_of(t) if split else [t] for t in group]
        new = set().union(*parts) - known.keys()
        if len(known) + len(new) > KEPT_PARTS:
            known.clear()
            new = set().union(*parts)
        for batch in balanced(new, BATCH_BYTES):
            known.update(zip(batch, map(len, sp.encode(batch, num_threads=1)), strict=True))
        out += [sum(map(known.__getitem__, p)) for p in parts]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del known[p]
    return out


def count_tokens(docs: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, n_bytes, n_tokens of every text. ``model`` is the content of a sentencepiece model file."""
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("id"), sizes, pa.array(lengths(texts, model), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)
