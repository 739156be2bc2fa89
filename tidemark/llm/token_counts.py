"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, so that one very long text is many short
segments, and segments are encoded in batches of about equal bytes. A boundary is
safe if no token of the vocabulary can span it:

* ``.model`` (sentencepiece): before a single space between two other characters,
  when the normaliser is the identity, a dummy prefix is added and no piece holds
  the space mark after another character. Both facts are read from the model. The
  segment then loses its space, which the dummy prefix puts back.
* ``.tiktoken`` and ``.json``: before a line's first letter after ``letter, \\n``.
  Only texts over ``LONG`` characters are cut, and only for byte-level patterns.

Counts of segments are remembered in a table of bounded size for the length of a
task; it changes no result.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, LongType

from . import common
from .sentencepiece_model import read_model

BATCH_BYTES = 1 << 20
LONG = 1 << 16
REMEMBERED = 400_000
_INNER_SPACE = re.compile(r"(?<=[^ ]) (?=[^ ])")
_LETTER_LINE = re.compile(r"(?<=[a-z])\n(?=[A-Za-z])")


class _Pieces:
    """Segment counts by the sentencepiece library."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.safe = read_model(content).splits_at_spaces()

    def segments(self, text: str) -> list[str]:
        if not self.safe:
            return [text]
        found = text.split(" ")
        return found if "" not in found else _INNER_SPACE.split(text)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoder.encode(texts, num_threads=1)]


class _Ranks:
    """Segment counts by tiktoken; special strings are ordinary text."""

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.encoder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def segments(self, text: str) -> list[str]:
        return _cut_lines(text)

    def count(self, texts: list[str]) -> list[int]:
        return [len(self.encoder.encode_ordinary(x)) for x in texts]


class _Fast:
    """Segment counts by the tokenizers library, special strings as the file says."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(content.decode())
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.byte_level = b'"ByteLevel"' in content

    def segments(self, text: str) -> list[str]:
        return _cut_lines(text) if self.byte_level else [text]

    def count(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.encoder.encode_batch(texts, add_special_tokens=False)]


def _cut_lines(text: str) -> list[str]:
    """Pieces of a long text, each but the first from the line feed between two letters on.

    Byte-level patterns keep a line feed between letters as a token of its own.
    """
    if len(text) <= LONG:
        return [text]
    cuts, last = [0], 0
    for m in _LETTER_LINE.finditer(text):
        if m.start() - last >= LONG:
            cuts.append(last := m.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def encoder(path: str, content: bytes, pattern: str | None = None):
    if path.endswith(".model"):
        return _Pieces(content)
    if path.endswith(".tiktoken"):
        if pattern is None:
            raise ValueError("a .tiktoken file needs the pattern that cuts texts into words")
        return _Ranks(content, pattern)
    if path.endswith(".json"):
        return _Fast(content)
    raise ValueError(f"unknown kind of vocabulary: {path}")


def _batches(texts: list[str]) -> Iterator[list[str]]:
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        if (size := size + len(text)) >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def text_counts(tool, texts: list[str], known: dict[str, int]) -> list[int]:
    """Tokens of each text; `known` remembers segments between calls."""
    if len(known) > REMEMBERED:
        known.clear()
    known[""] = 0
    cut = [tool.segments(t) for t in texts]
    new = list({s for segments in cut for s in segments if s not in known})
    for batch in _batches(new):
        known.update(zip(batch, tool.count(batch), strict=True))
    return [sum(map(known.__getitem__, segments)) for segments in cut]


def count_tokens(
    documents: DataFrame,
    tokenizer_path: str,
    *,
    text: str = "text",
    limit: int = 4096,
    pattern: str | None = None,
) -> DataFrame:
    """Add n_bytes, n_tokens (long) and over_limit to each row, by a map without shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated and
    all other columns pass through; a column named like an added one is replaced.
    An empty table gives an empty result. The vocabulary file has a fixed size and
    is broadcast.
    """
    spark = documents.sparkSession
    with open(tokenizer_path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in documents.columns if c not in added or c == text]
    source = documents.select(*kept)
    out_columns = [c for c in kept if c not in added]
    schema = source.select(*out_columns).schema
    for name, kind in zip(added, (LongType(), LongType(), BooleanType()), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = encoder(tokenizer_path, content.value, pattern), {}
        for batch in batches:
            column = pc.fill_null(batch.column(kept.index(text)), "")
            sizes = pc.cast(pc.binary_length(column), pa.int64())
            rows = column.to_pylist()
            counts: list[int] = []
            start = size = 0
            for i, n in enumerate(sizes.to_pylist()):  # even batches, however long the texts are
                size += n
                if size >= 8 * BATCH_BYTES or i + 1 == len(rows):
                    counts += text_counts(tool, rows[start : i + 1], known)
                    start, size = i + 1, 0
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(kept.index(c)) for c in out_columns), sizes, tokens, pc.greater(tokens, limit)],
                names=[*out_columns, *added],
            )

    return source.mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(documents, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op9_token_counts": op9}
