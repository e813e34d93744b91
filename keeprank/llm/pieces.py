"""Reading a SentencePiece model file: the fields of the protobuf that encoding needs, by its wire format."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Fixed values of the format: kinds of pieces and kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def fields(data: bytes):
    """(number, value) of a message; varints as int, fixed32 as float, the rest as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at:at + size]
            at += size
        elif kind == 5:
            yield number, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            yield number, data[at:at + 8]
            at += 8
        else:
            raise ValueError(f"wire type {kind} is not used by this format")


def parse_model(data: bytes) -> PieceModel:
    out = PieceModel()
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            out.pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        elif number == 2:
            own = dict(fields(value))
            out.model_type = own.get(3, UNIGRAM)
            out.byte_fallback = bool(own.get(35, 0))
            out.unk_id = own.get(40, 0)
        elif number == 3:
            own = dict(fields(value))
            out.charsmap = own.get(2, b"")
            out.add_dummy_prefix = bool(own.get(3, 1))
            out.remove_extra_whitespaces = bool(own.get(4, 1))
            out.escape_whitespaces = bool(own.get(5, 1))
    return out


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return parse_model(f.read())
