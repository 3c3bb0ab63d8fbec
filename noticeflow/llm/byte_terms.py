"""Terms of whole texts by their UTF-8 bytes: every byte that is no part of a term becomes a space.

Bytes from 0x80 on only occur in characters beyond ASCII, all of which belong to terms, so no text
needs to be decoded, and bytes that are no valid UTF-8 do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"
#: Bytes of a text whose terms are held at once.
PORTION = 1 << 22


def term_table(ascii_term: bytes) -> bytes:
    """Table for ``bytes.translate``: A-Z in lower case, other bytes of terms as they are, the rest as spaces."""
    return bytes(ord(chr(b).lower()) if b < 128 and b in ascii_term else b if b >= 128 else 32 for b in range(256))


def portions(text: bytes, table: bytes, portion: int = PORTION) -> Iterator[list[bytes]]:
    """The terms of a text from left to right, a bounded part of it at a time; no term is cut."""
    at = 0
    while at < len(text):
        end = at + portion
        if end < len(text):
            part = text[at:end].translate(table)
            cut = part.rfind(b" ")
            while cut < 0:  # one term so far: go on to where it ends
                end += portion
                part = text[at:end].translate(table)
                cut = part.rfind(b" ") if end < len(text) else len(part)
            part, at = part[:cut], at + max(cut, 1)
        else:
            part, at = text[at:].translate(table), len(text)
        yield part.split()
