"""Problem 8: encode every text with a public byte-level BPE vocabulary.

The rank file is read once per Python worker from ``rank_file`` (a parameter; the file must exist on
every worker). Texts go through Arrow record batches; the ids of a batch are written into one flat
int32 buffer with offsets, so no Python list per document crosses the boundary.

Long texts are cut only where the split pattern always cuts: before a single space that stands
between two characters that are not white space, and between letters, digits and symbols of common ranges (never
behind an apostrophe, which may begin a contraction). Every match of the pattern ends there, and it never looks
back, so the pieces encode to exactly the ids of the whole text. A run of letters alone is one match and stays whole.

Defined results: null and empty texts give an empty list; blank texts give their own ids; strings
that spell special tokens are ordinary text. Extra columns are ignored. Repeated ids stay repeated.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above this many characters are encoded in pieces of about this size.
PIECE_CHARS = 65_536

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-Ωα-ωЀ-ҁ\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3"
_SYMBOLS = r"!-/:-@\[-`{-~。，、：；！？（）《》「」"
_SAFE_CUT = re.compile(rf"(?<=\S) (?=\S)|(?<=[{_LETTERS}])(?=[0-9{_SYMBOLS}])|(?<=[0-9])(?=[{_LETTERS}{_SYMBOLS}])|(?<=[{_SYMBOLS}])(?<!')(?=[0-9{_LETTERS}])")
_ENCODINGS: dict = {}


def encoding(rank_file: str = RANK_FILE):
    """The tiktoken encoding of a rank file, built once per process."""
    if rank_file not in _ENCODINGS:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[rank_file] = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[rank_file]


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of a long text, cut at safe boundaries only; the last cut may come late."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE_CUT.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, enc, limit: int = PIECE_CHARS) -> list[int]:
    """Token ids of one text."""
    if not text:
        return []
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in pieces(text, limit):
        out += enc.encode_ordinary(piece)
    return out


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """(id, ids array<int>): one row per input row. A map-only plan: no shuffle at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file)
        for batch in batches:
            rows = [encode(t, enc) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(r) for r in rows], dtype=np.int32)
            flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["_id", "ids"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", rank_file: str = RANK_FILE) -> DataFrame:
    """(id, text): the exact text of each id list; token bytes are joined raw before UTF-8 decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file)
        for batch in batches:
            texts = [enc.decode_bytes(ids or []).decode("utf-8") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    src = encoded.select(F.col(id_col).alias("_id"), "ids")
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
