"""A small helper for PDF files: the literal strings that their content streams show. Fonts' character maps and packed objects are not read."""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"stream\r?\n(.*?)endstream", re.S)
_BLOCK = re.compile(rb"\bBT\b(.*?)\bET\b", re.S)
_STRING = re.compile(rb"\(((?:[^\\()]|\\.)*)\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\n", b"t": b" ", b"b": b"", b"f": b"", b"\n": b"", b"\r\n": b""}


def _unescaped(raw: bytes) -> bytes:
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1] < b"8" else _PLAIN.get(m[1], m[1]), raw)


def shown_text(data: bytes) -> str:
    """A line per text block, in the order of the file; "" if no block shows a word."""
    lines = []
    for stream in _STREAM.findall(data):
        try:
            stream = zlib.decompressobj().decompress(stream)
        except zlib.error:
            pass  # not compressed
        for block in _BLOCK.findall(stream):
            lines.append(b"".join(map(_unescaped, _STRING.findall(block))).decode("latin-1").strip())
    text = "\n".join(x for x in lines if x)
    return text if re.search(r"[^\W\d_]{2}", text) else ""
