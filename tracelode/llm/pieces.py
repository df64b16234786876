"""Reading a SentencePiece model file, and cutting texts into parts that no piece spans."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PRE = re.compile(" *[^ ]+| +")
_SHIFT = 21


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", raw[at : at + n])[0]
            at += n


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    merges: bool = False  # trained by merging
    id_of: dict[str, int] = field(default_factory=dict)
    byte_ids: np.ndarray | None = None

    def __post_init__(self) -> None:
        # Only these can be found in a text; control pieces and the like stand for nothing in it.
        usable = (NORMAL, UNUSED)
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in usable}
        at = {p: i for i, p in enumerate(self.pieces)}
        self.byte_ids = np.array([at[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        if USER_DEFINED in self.kinds:
            raise ValueError("user-defined pieces aren't supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces with a space after another character aren't supported")
        pairs = {(ord(a) << _SHIFT) | ord(b) for p in self.id_of for a, b in zip(p, p[1:], strict=False)}
        self.bigrams = np.array(sorted(pairs), np.int64)


#: Settings that these operators implement: part and number of the field, its default, and the value that it must have.
_SETTINGS = {
    "a character map": (3, 2, b"", b""),
    "no dummy prefix": (3, 3, 1, 1),
    "removal of extra white space": (3, 4, 1, 0),
    "unescaped white space": (3, 5, 1, 1),
    "white space as suffix": (2, 24, 0, 0),
    "no byte fallback": (2, 35, 0, 1),
    "a map back": (5, 2, b"", b""),
}


def read_model(path: str | None = None) -> Model:
    """The pieces of a model file; raises where its settings ask for what isn't implemented here."""
    pieces, scores, kinds = [], [], []
    settings: dict[int, dict[int, object]] = {2: {}, 3: {}, 5: {}}
    for number, value in _fields(Path(path or default_model()).read_bytes()):
        if number in settings:
            settings[number] |= dict(_fields(value))
        elif number == 1:
            own = dict(_fields(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(own.get(2, 0.0))
            kinds.append(own.get(3, NORMAL))
    for what, (part, number, default, needed) in _SETTINGS.items():
        if settings[part].get(number, default) != needed:
            raise ValueError(f"a model with {what} isn't supported")
    return Model(pieces, np.array(scores), np.array(kinds), merges=settings[2].get(3, 1) == 2)


def pre_tokens(text: str) -> list[str]:
    """Each run of spaces with the characters up to the next, of the text with its dummy prefix; no piece spans two."""
    return _PRE.findall(" " + text.replace(SPACE, " ")) if text else []


def code_points(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, spaces as the space symbol, and the number of the token that each belongs to."""
    cps = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cps[cps == 32] = ord(SPACE)
    return cps, np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))


def breaks(cps: np.ndarray, token: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """Whether a part begins at each code point: at a new token, and between two characters that no piece has side by side."""
    first = np.ones(len(cps), bool)
    if len(cps) > 1:
        keys = (cps[:-1] << _SHIFT) | cps[1:]
        at = np.minimum(np.searchsorted(bigrams, keys), len(bigrams) - 1)
        first[1:] = (bigrams[at] != keys) | (token[1:] != token[:-1])
    return first


def utf8_lengths(cps: np.ndarray) -> np.ndarray:
    return 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)


def in_slices(texts: list, chars: int = 2_000_000) -> Iterator[list]:
    """texts in order, in lists of about that many characters, whole texts each."""
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += len(t)
        if n >= chars:
            yield own
            own, n = [], 0
    if own:
        yield own
