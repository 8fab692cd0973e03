"""Token counts of texts by a public tokenizer's rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siteloom.session import staged

#: Where the rank file lies on every executor, and the pattern that splits text before its merges.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in pieces of about this many characters, cut before a letter or number that follows white space.
PIECE = 200_000

_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(ranks: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of a rank file, made once per process."""
    key = (ranks, pattern)
    if key not in _ENCODERS:
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[key]


def count_tokens(text: str | None, ranks: str = RANKS, pattern: str = PATTERN) -> int:
    """Tokens of a text; 0 for null and for white space alone.

    Very long texts are counted in pieces. A piece ends before a single space that a letter
    follows, where the pattern always splits, so the count is that of the whole.
    """
    if text is None or not text or text.isspace():
        return 0
    encode = encoder(ranks, pattern).encode_ordinary
    if len(text) <= PIECE:
        return len(encode(text))
    total = at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not (text[end] == " " and text[end + 1 : end + 2].isalpha() and not text[end - 1].isspace()):
            end += 1
        total += len(encode(text[at:end]))
        at = end
    return total


def token_counts(docs: DataFrame, keep: tuple[str, ...] = (), ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``doc_id``, the ``keep`` columns and ``tokens`` of every record with content, written once.

    Records are counted where they are read. Null ids and null, empty or blank texts are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_tokens(t, ranks, pattern) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *keep)], pa.array(counts, pa.int32())], names=["doc_id", *keep, "tokens"])

    fields = docs.select("doc_id", *keep).schema.simpleString()[len("struct<") : -1]
    counted = docs.select("doc_id", *keep, "text").where("doc_id is not null").mapInArrow(count, ", ".join(f.replace(":", " ", 1) for f in fields.split(",")) + ", tokens int")
    return staged(counted.where("tokens > 0"), "tokens")
