"""Quality rules: text statistics and tokeniser fertility with rejection bands.

Public vocabularies, trained on ordinary text, break junk into unusual pieces. For
each text three things are measured on its words:

* characters per token, by each vocabulary;
* byte-fallback share, the part of the tokens that are single bytes (vocabularies
  with byte fallback only);
* token entropy in bits, of the first vocabulary.

A text is rejected if a measure lies outside the band of its language, or else of
its script (the script of most of its letters). Entropy has a lower bound
that rises with the number of tokens, as few tokens cannot have much.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType

from . import common
from .sentencepiece_model import BYTE, read_model

REMEMBERED = 300_000
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5


@dataclass(frozen=True)
class Band:
    """Accepted values of the measures.

    characters: least and most characters per token, for each vocabulary; for n tokens the
        least counts 1 - 1/sqrt(n) times.
    fallback: the largest byte-fallback share.
    entropy: points (log2 of tokens, least bits), joined by lines and level outside.
    """

    characters: tuple[tuple[float, float], ...]
    fallback: float
    entropy: tuple[tuple[float, float], ...]

    def accepts(self, characters: list[float], fallback: float, entropy: float, tokens: int) -> bool:
        sizes, bits = zip(*self.entropy, strict=True)
        loose = 1 - max(tokens, 1) ** -0.5  # few tokens scatter more
        return (
            all(low * loose <= x <= high for x, (low, high) in zip(characters, self.characters, strict=True))
            and fallback <= self.fallback
            and entropy >= np.interp(np.log2(max(tokens, 1)), sizes, bits)
        )


#: Prose gains bits quickly up to some 160 tokens and slowly after; word lists, decorated,
#: shouted and repeated words stay below the line.
PROSE_BITS = ((4.3, 2.4), (7.32, 5.5), (8.32, 5.82), (9.32, 6.02), (10.3, 6.18), (11.3, 6.35))
FEW_BITS = ((4.3, 2.0), (7.32, 4.0), (9.32, 4.5))
#: By language, else by script. The second vocabulary cuts decorated words into more tokens.
BANDS: dict[str, Band] = {
    "en": Band(((1.6, 12.0), (1.9, 12.0)), 0.1, PROSE_BITS),
    "de": Band(((1.55, 12.0), (1.92, 12.0)), 0.1, PROSE_BITS),
    "fr": Band(((1.5, 12.0), (1.73, 12.0)), 0.1, PROSE_BITS),
    "es": Band(((1.5, 12.0), (1.78, 12.0)), 0.1, PROSE_BITS),
    "Latin": Band(((1.2, 14.0), (1.5, 14.0)), 0.3, FEW_BITS),
    "Cyrillic": Band(((0.8, 14.0), (0.8, 14.0)), 0.5, FEW_BITS),
    "Greek": Band(((0.5, 14.0), (0.5, 14.0)), 0.8, FEW_BITS),
    "Han": Band(((0.3, 10.0), (0.3, 10.0)), 0.9, FEW_BITS),
    "other": Band(((0.2, 14.0), (0.2, 14.0)), 1.0, FEW_BITS),
}
_SCRIPTS = {
    "Latin": re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]"),
    "Cyrillic": re.compile("[\u0400-\u052f]"),
    "Greek": re.compile("[\u0370-\u03ff\u1f00-\u1fff]"),
    "Han": re.compile("[\u3400-\u9fff]"),
    "other": re.compile("[^\\W\\d_A-Za-z\u00c0-\u024f\u1e00-\u1eff\u0370-\u052f\u1f00-\u1fff\u3400-\u9fff]"),
}


def script(text: str) -> str:
    """The script of most letters; the earlier in the table among equals, Latin without letters."""
    counts = {name: len(pattern.findall(text)) for name, pattern in _SCRIPTS.items()}
    return max(counts, key=counts.__getitem__)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more, first ones included."""
    size = len(words) - window + 1
    if size < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    ranks, width = ids, 1
    while width < window:  # exact: equal ranks are equal runs of `width` words
        step = min(width, window - width)
        pairs = ranks[: len(ranks) - step] * (int(ranks.max()) + 1) + ranks[step:]
        _, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        width += step
        if counts.max() == 1:
            return 0
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[ranks] > 1)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    counts = Counter(lines)
    if len(counts) == len(lines):
        return 0
    return sum(n - 1 for line, n in counts.items() if n > 1 and common.WORD_RE.search(line))


class _Vocabularies:
    """Ids by a sentencepiece model and token counts by a list of ranks, remembered by word."""

    def __init__(self, model: bytes, ranks: bytes, pattern: str):
        import base64

        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.ranks = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.fallback = np.array([k == BYTE for k in read_model(model).kinds])
        self.ids: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.counts.clear()
        new = [w for w in words if w not in self.ids]
        for word, ids in zip(new, self.pieces.encode(new, num_threads=1), strict=True):
            self.ids[word] = np.array(ids, np.int32).tobytes()
            self.counts[word] = len(self.ranks.encode_ordinary(" " + word))

    def measure(self, words: list[str], characters: int) -> tuple[list[float], float, float, int]:
        """Characters per token by both, fallback share, entropy and number of tokens."""
        ids = np.frombuffer(b"".join(map(self.ids.__getitem__, words)), np.int32)
        if not len(ids):
            return [0.0, 0.0], 0.0, 0.0, 0
        counts = np.unique(ids, return_counts=True)[1] / len(ids)
        entropy = float(-(counts * np.log2(counts)).sum())
        others = sum(map(self.counts.__getitem__, words))
        return [characters / len(ids), characters / max(others, 1)], float(self.fallback[ids].mean()), entropy, len(ids)


_ADDED = (
    ("n_words", LongType()), ("word_chars", LongType()), ("n_symbols", LongType()), ("n_dup_lines", LongType()),
    ("n_repeat_words", LongType()), ("chars_per_token", DoubleType()), ("chars_per_token_2", DoubleType()),
    ("fallback_share", DoubleType()), ("token_entropy", DoubleType()), ("band", StringType()),
    ("base_failed", BooleanType()), ("kept", BooleanType()),
)
_BATCH = 1 << 22


def judge(
    documents: DataFrame,
    model_path: str,
    ranks_path: str,
    pattern: str,
    *,
    text: str = "text",
    language: str | None = "lang",
    bands: Mapping[str, Band] = BANDS,
) -> DataFrame:
    """Add the statistics and the verdict `kept` to each row, by a map without shuffle.

    A null or empty text has no words: its counts and measures are 0, base_failed is
    true and kept false. A null or unknown language, or no such column, leaves the
    choice of band to the script. Rows, repeated ones too, and other columns pass
    through; columns named like added ones are replaced. An empty table gives an
    empty result. The vocabulary files have a fixed size and are broadcast.
    """
    context = documents.sparkSession.sparkContext
    files = [context.broadcast(open(path, "rb").read()) for path in (model_path, ranks_path)]  # noqa: SIM115
    names = [n for n, _ in _ADDED]
    needed = [text, *([language] if language in documents.columns else [])]
    out = [c for c in documents.columns if c not in names]
    kept = out + [c for c in needed if c not in out]
    schema = documents.select(*out).schema
    for name, kind in _ADDED:
        schema = schema.add(name, kind)
    bands = dict(bands)

    def row(tool: _Vocabularies, content: str, words: list[str], tongue: str | None) -> tuple:
        characters = sum(map(len, words))
        repeats = repeated_words(words)
        per_token, fallback, entropy, tokens = tool.measure(words, characters)
        failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * len(words)
        band = tongue if tongue in bands else script(content)
        good = not failed and bands[band].accepts(per_token, fallback, entropy, tokens)
        symbols = sum(map(content.count, SYMBOLS))
        return len(words), characters, symbols, repeated_lines(content), repeats, *per_token, fallback, entropy, band, failed, bool(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _Vocabularies(files[0].value, files[1].value, pattern)
        for batch in batches:
            start = size = 0
            texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
            tongues = batch.column(kept.index(needed[1])).to_pylist() if len(needed) > 1 else [None] * len(texts)
            for i, t in enumerate(texts):
                size += len(t)
                if size >= _BATCH or i + 1 == len(texts):
                    cut = [common.WORD_RE.findall(x) for x in texts[start : i + 1]]
                    tool.learn({w for words in cut for w in words})
                    rows = [row(tool, *x) for x in zip(texts[start : i + 1], cut, tongues[start : i + 1], strict=True)]
                    part = batch.slice(start, i + 1 - start)
                    made = [pa.array(x, _ARROW[type(k)]) for x, (_, k) in zip(zip(*rows, strict=True), _ADDED, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(kept.index(c)) for c in out), *made], names=[*out, *names])
                    start, size = i + 1, 0

    return documents.select(*kept).mapInArrow(common.lean(run), schema)


_ARROW = {LongType: pa.int64(), DoubleType: pa.float64(), StringType: pa.string(), BooleanType: pa.bool_()}


def judged(documents: DataFrame) -> DataFrame:
    """judge() with the public vocabularies."""
    import public_tokenizers as public

    return judge(documents, public.path("piece_bpe_32k.model"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows that judged() keeps, with their own columns only."""
    columns = documents.columns
    names = {n for n, _ in _ADDED}
    clash = {c: f"_own_{c}" for c in columns if c in names}
    rows = judged(documents.withColumnsRenamed(clash)).where("kept")
    return rows.select(*(F.col(clash.get(c, c)).alias(c) for c in columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judged(documents).drop("text", "lang")


QUERIES = {"op4_quality_rules": op4}
