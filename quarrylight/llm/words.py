"""Words of texts inside tasks, in blocks of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20

_CUT = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
# A-Z in lower case; every other ASCII character that is no letter or digit becomes a space.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, as Spark's functions take it."""
    return "`" + name.replace("`", "``") + "`"


def plain_words(data: bytes | None) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text, block by block: runs of ASCII letters and digits and of all other characters."""
    data, start = data or b"", 0
    while start < len(data):
        gap = _CUT.search(data, start + BLOCK)
        end = gap.start() if gap else len(data)
        yield data[start:end].translate(_PLAIN).split()
        start = end


def overlapped(blocks: Iterator[list[bytes]], size: int) -> Iterator[list[bytes]]:
    """The blocks, each with the last ``size - 1`` words before it, so that no run of ``size`` words is cut.

    A text of fewer words comes as one block.
    """
    tail: list[bytes] = []
    whole = False
    for words in blocks:
        words = tail + words
        if len(words) >= size:
            whole = True
            yield words
            words = words[len(words) - size + 1 :]
        tail = words
    if tail and not whole:
        yield tail
