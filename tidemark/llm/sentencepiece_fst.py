"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` turns a model into three transducers: the normaliser (space
handling, dummy prefix, space mark), the lexicon (one path of characters for each
piece) and byte fallback (one path of byte pieces for each other character). To
encode a text they are composed with it, which gives a lattice whose states are a
position and the last piece, and the best path in the tropical semiring is taken:
weights add along a path, and the smaller weight wins.

* unigram models: a piece weighs minus its score, an unknown character as much as
  the worst piece and ten more;
* BPE models: a piece weighs nothing after a piece with which it is stable, that
  is, if merging the characters of both, best score first and leftmost among
  equals, ends in these two pieces; otherwise it weighs infinity. A sequence
  is what BPE merging makes of a text if and only if all its neighbours are
  stable, so exactly one path is finite and a state needs to keep one last piece.

When no piece holds the space mark after another character, no path crosses the
start of a space run; the text is then composed word by word, and the best
paths of words are remembered in a table of bounded size.

Decoding runs the lexicon backwards: pieces to text, byte pieces to bytes, space
marks to spaces, without the dummy prefix.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType

from . import common
from .sentencepiece_model import BPE, BYTE, CONTROL, NORMAL, SPACE, UNIGRAM, UNKNOWN, USER, Model, read_model

REMEMBERED = 700_000
BATCH_CHARACTERS = 1 << 22
_SPACE_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")
_EXTRA_SPACES = re.compile(" +")


class Transducer:
    """A compiled model. encode() gives the ids as int32 bytes, decode() the text."""

    def __init__(self, model: Model):
        if model.charsmap or model.kind not in (UNIGRAM, BPE) or USER in model.kinds:
            raise ValueError("only unigram and BPE models with the identity normaliser and without user-defined symbols")
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = model.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        self.worst = min((model.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.by_word = model.splits_at_spaces()
        self.surface = [self._surface(p, k) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.words: dict[str, bytes] = {}  # without the space mark that each starts with
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.trie: dict = {}
        for piece in self.ids:
            node = [None, self.trie]
            for c in piece:
                node = node[1].setdefault(c, [None, {}])
            node[0] = piece

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    # The normaliser.

    def normalise(self, text: str) -> str:
        if self.model.strip_spaces:
            text = _EXTRA_SPACES.sub(" ", text).strip(" ")
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.model.escape_spaces else text

    # Composition of a text with the lexicon, and the best path.

    def _merged(self, text: str, steps: list | None = None) -> list[str]:
        """What merging makes of a few characters, by the definition of BPE; steps gets the pairs."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and self.model.scores[j] > best:
                    best, at = self.model.scores[j], i
            if at < 0:
                break
            if steps is not None:
                steps.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """The parts at one end (0 left, 1 right) of a piece while it is merged, outermost
        first, each with the score of the merge that uses it up. None if a merge scores
        more than one inside it, so that scores do not give the order of merges.
        """
        known = self.spines[side].get(piece)
        if known is None and piece not in self.spines[side]:
            known, part, score = [(piece, -math.inf)], piece, -math.inf
            while len(part) > 1 and known is not None:
                score, halves = self._last_merge(part)
                if halves is None or any(len(x) > 1 and self.model.scores[self.ids[x]] < score for x in halves):
                    known = None
                else:
                    known.append((part := halves[side], score))
            self.spines[side][piece] = known
        return known

    def _last_merge(self, piece: str) -> tuple[float, tuple[str, str] | None]:
        if piece not in self.halves:
            steps: list[tuple[str, str]] = []
            whole = self._merged(piece, steps)
            self.halves[piece] = steps[-1] if whole == [piece] else None
        return self.model.scores[self.ids[piece]], self.halves[piece]

    def _stable(self, left: str, right: str) -> bool:
        """Whether no merge crosses from a piece to the next.

        A part at the end of the left piece merges with one at the start of the right
        piece before either is used up within its own piece; of two merges of one
        score, the left one comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs.clear()
            ends, starts = self._spine(left, 1) if left else [], self._spine(right, 0)
            if ends is None or starts is None:
                known = self._merged(left + right) == [x for x in (left, right) if x]
            else:
                ids, scores, known = self.ids, self.model.scores, True
                for a, used_a in ends:
                    for b, used_b in starts:
                        at = ids.get(a + b)
                        if at is not None and scores[at] > used_a and scores[at] >= used_b:
                            known = False
            self.pairs[left, right] = known
        return known

    def _arcs(self, text: str, start: int) -> list[str]:
        """Lexicon arcs that leave a position; a character without one is an arc itself."""
        node, found = self.trie.get(text[start]), []
        if node is None or node[0] is None:
            found.append(text[start])
        end = start + 1
        while node is not None:
            if node[0] is not None:
                found.append(node[0])
            node = node[1].get(text[end]) if end < len(text) else None
            end += 1
        return found

    def _bpe_path(self, text: str) -> list[str]:
        """For each position, the last piece of the only finite path that ends there."""
        size, pairs, trie = len(text), self.pairs, self.trie
        came = [""] * (size + 1)
        for start in range(size):
            last, end = came[start], start + 1
            node = trie.get(text[start])
            if (node is None or node[0] is None) and self._stable(last, text[start]):
                came[end] = text[start]
            while node is not None:
                piece, after = node
                if piece is not None and not came[end]:
                    stable = pairs.get((last, piece))
                    if self._stable(last, piece) if stable is None else stable:
                        came[end] = piece
                if end == size:
                    break
                node = after.get(text[end])
                end += 1
        return came

    def best_path(self, text: str) -> list[str]:
        """The pieces (and unknown characters) on the best path through a text's lattice."""
        if not text:
            return []
        if self.model.kind == BPE:
            came = self._bpe_path(text)
        else:
            came, weight = [""] * (len(text) + 1), [0.0] + [math.inf] * len(text)
            for start in range(len(text)):
                for piece in self._arcs(text, start):
                    at = self.ids.get(piece)
                    w = weight[start] - (self.worst if at is None else self.model.scores[at])
                    if w < weight[end := start + len(piece)]:
                        weight[end], came[end] = w, piece
        path, end = [], len(text)
        while end:
            path.append(came[end])
            end -= len(came[end])
        return path[::-1]

    def _segment(self, text: str) -> bytes:
        out = array("i")
        for piece in self.best_path(text):
            at = self.ids.get(piece)
            if at is not None:
                out.append(at)
            elif self.model.byte_fallback:
                out.extend(self.bytes[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._segment(self.normalise(text))
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        words = text.split(" ")
        if "" in words or SPACE in text or self.model.strip_spaces:
            words = [w[1:] for w in _SPACE_RUNS.findall(self.normalise(text))]
        found = list(map(known.get, words))
        if None in found:
            for i, word in enumerate(words):
                if found[i] is None:
                    found[i] = known[word] = self._segment(SPACE + word)
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def compile_model(content: bytes) -> Transducer:
    """The transducer of a model; a process keeps the last one with what it remembers, until another stage runs in it."""
    return common.compiled(("transducer", content), lambda: Transducer(read_model(content)))


def _read(documents: DataFrame, model_path: str):
    with open(model_path, "rb") as file:
        return documents.sparkSession.sparkContext.broadcast(file.read())


def _run(frame: DataFrame, content, added: list, needed: str, make) -> DataFrame:
    """Map rows; make(transducer, values) gives the arrays of the added columns."""
    names = [n for n, _ in added]
    kept = [c for c in frame.columns if c not in names or c == needed]
    out = [c for c in kept if c not in names]
    schema = frame.select(*out).schema
    for name, kind in added:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = compile_model(content.value)
        for batch in batches:
            column = batch.column(kept.index(needed))
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else []
            start = size = 0
            for i, n in enumerate(sizes):
                size += int(n)
                if size >= BATCH_CHARACTERS or i + 1 == len(column):
                    part = batch.slice(start, i + 1 - start)
                    made = make(tool, part.column(kept.index(needed)))
                    yield pa.RecordBatch.from_arrays([*(part.column(kept.index(c)) for c in out), *made], names=[*out, *names])
                    start, size = i + 1, 0

    return frame.select(*kept).mapInArrow(run, schema)


def _lists(encoded: list[bytes]) -> tuple[pa.Array, pa.Array]:
    counts = np.array([len(x) // 4 for x in encoded], np.int64)
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    values = np.frombuffer(b"".join(encoded), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array(counts)


def encode(documents: DataFrame, model_path: str, *, text: str = "text") -> DataFrame:
    """Add token_ids (array of int) and n_tokens (long); a null or empty text has none.

    A map without shuffle: rows, repeated ones too, and all other columns pass
    through; a column named like an added one is replaced. An empty table gives an
    empty result.
    """

    def make(tool, column):
        return list(_lists([tool.encode(t or "") for t in column.to_pylist()]))

    added = [("token_ids", ArrayType(IntegerType())), ("n_tokens", LongType())]
    return _run(documents, _read(documents, model_path), added, text, make)


def decode(frame: DataFrame, model_path: str, *, ids: str = "token_ids") -> DataFrame:
    """Add decoded (text); null or no ids give an empty text, ids beyond the model fail."""

    def make(tool, column):
        return [pa.array([tool.decode(x or []) for x in column.to_pylist()], pa.string())]

    return _run(frame, _read(frame, model_path), [("decoded", StringType())], ids, make)


def round_trip(documents: DataFrame, model_path: str, *, text: str = "text") -> DataFrame:
    """encode() and decode() in one pass, with round_trip: whether the text came back.

    A null text counts as empty and comes back. Texts that hold the space mark
    itself come back with a space in its place, so for these round_trip is false.
    """

    def make(tool, column):
        texts = [t or "" for t in column.to_pylist()]
        encoded = [tool.encode(t) for t in texts]
        back = [tool.decode(np.frombuffer(x, np.int32).tolist()) for x in encoded]
        ids, counts = _lists(encoded)
        return [ids, counts, pa.array(back, pa.string()), pa.array([a == b for a, b in zip(texts, back, strict=True)])]

    added = [("token_ids", ArrayType(IntegerType())), ("n_tokens", LongType()), ("decoded", StringType()), ("round_trip", BooleanType())]
    return _run(documents, _read(documents, model_path), added, text, make)


def encoded_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, token_ids, the decoded text's digest and whether it is the text."""
    import public_tokenizers

    done = round_trip(documents.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_sentencepiece": op3}
