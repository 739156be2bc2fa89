"""Reader of sentencepiece model files (protocol-buffer wire format)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    """Pieces with scores and kinds, and the settings that decide a segmentation."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    kind: int
    byte_fallback: bool
    normaliser: str
    charsmap: bytes
    dummy_prefix: bool
    strip_spaces: bool
    escape_spaces: bool

    def splits_at_spaces(self) -> bool:
        """Whether text can be cut before any single inner space; see token_counts."""
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        return (
            self.normaliser == "identity"
            and not self.charsmap
            and self.dummy_prefix
            and self.escape_spaces
            and not any(k in (NORMAL, USER) and (inner.search(p) or " " in p) for p, k in zip(self.pieces, self.kinds, strict=True))
        )


def read_model(content: bytes) -> Model:
    pieces, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    normaliser: dict[int, int | bytes] = {}
    for field, value in _fields(content):
        if field == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            kinds.append(piece.get(3, NORMAL))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    return Model(
        tuple(pieces), tuple(scores), tuple(kinds), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)),
        normaliser.get(1, b"").decode(), normaliser.get(2, b""), bool(normaliser.get(3, 1)),
        bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)),
    )
