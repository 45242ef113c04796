"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole.  The tokens of a byte-level vocabulary spell the text's bytes, so their
running lengths are their spans; the spans are joined to the document's sections by their offsets.  The default
sections are lines (a line break belongs to the line it ends); ``fields`` counts over several columns, joined by a
separator into one document, with the columns as sections.

Rule for tokens that cross a boundary: the token belongs to the section that holds its first byte.  So every token
is counted once and the sections' counts add up to the document's.

Defined results: null and empty texts have no tokens and no sections; sections may get no token (the one before took
it); names of special tokens in a text are ordinary text; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow


@dataclass(frozen=True)
class Vocabulary:
    """A rank file of a byte-level tokenizer (a path that executors can read) and the pattern that splits texts."""

    path: str
    pattern: str


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def encoder(v: Vocabulary):
    """(encoding, bytes of each token), kept in the worker process."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_colophon_encoders", {})
    if v not in kept:
        with open(v.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        kept[v] = (tiktoken.Encoding("colophon", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={}), sizes)
    return kept[v]


def spans(text: str, v: Vocabulary) -> np.ndarray:
    """Byte offsets of the tokens' first bytes, and the length of the text at the end."""
    encoding, sizes = encoder(v)
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    return np.concatenate([[0], np.cumsum(sizes[ids])]) if len(ids) else np.zeros(1, np.int64)


def attributed(offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens reach past the section of their first byte."""
    if not len(starts):
        return np.zeros(0, np.int64), 0
    first, last = offsets[:-1], offsets[1:] - 1
    section = np.searchsorted(starts, first, side="right") - 1
    return np.bincount(section, minlength=len(starts)), int((np.searchsorted(starts, last, side="right") - 1 != section).sum())


def line_starts(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(raw)]])


_COUNTS = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("section_tokens", pa.list_(pa.int64()))]
_SCHEMA = "n_bytes long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>"


def _counted(raw: bytes, text: str, starts: np.ndarray, v: Vocabulary) -> tuple:
    offsets = spans(text, v)
    counts, crossing = attributed(offsets, starts)
    return len(raw), len(offsets) - 1, len(starts), crossing, counts


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_sections, n_crossing, section_tokens) of every row, with lines as sections."""
    v = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                raw = text.encode()
                rows.append(_counted(raw, text, line_starts(raw), v))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_COUNTS))], ["doc_id", *(n for n, _ in _COUNTS)]
            )

    return docs.select("doc_id", "text").transform(arrow, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def field_token_counts(rows: DataFrame, key: str, fields: list[str], separator: str = "\n\n", vocabulary: Vocabulary | None = None) -> DataFrame:
    """As ``token_counts``, for documents made of several columns; a null column is an empty section, and a separator
    belongs to the column before it."""
    v = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in zip(*(batch.column(f"f{i}_") for i in range(len(fields))), strict=True):
                texts = [(x.as_py() or "") for x in values]
                starts = np.cumsum([0, *(len((t + separator).encode()) for t in texts[:-1])])
                text = separator.join(texts)
                out.append(_counted(text.encode(), text, starts, v))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key_"), *(pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(_COUNTS))], [key, *(n for n, _ in _COUNTS)]
            )

    picked = rows.select(F.col(key).alias("key_"), *(F.col(f).cast("string").alias(f"f{i}_") for i, f in enumerate(fields)))
    return picked.transform(arrow, run, f"{key} {rows.schema[key].dataType.simpleString()}, {_SCHEMA}")
