"""What the text operators share."""

from __future__ import annotations

import re

#: Punctuation beyond ASCII: Latin-1, general, CJK and fullwidth.
PUNCTUATION = re.compile("[\\u0080-\\u00a9\\u00ab-\\u00b4\\u00b6-\\u00b9\\u00bb-\\u00bf\\u00d7\\u00f7\\u2000-\\u206f\\u3000-\\u303f\\uff00-\\uff0f\\uff1a-\\uff20]")
#: Characters that are not seen and part no words: soft hyphen, zero-width ones, byte order mark.
INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")
#: Characters written by number.
_NUMBERED = re.compile(r"&#(x[0-9a-fA-F]{1,6}|[0-9]{1,7});")


def _numbered(m: re.Match) -> str:
    n = int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "


def characters(text: str) -> str:
    """The text with characters in place of their numeric references."""
    return _NUMBERED.sub(_numbered, text) if "&#" in text else text


def byte_words(text: str, table: bytes) -> list[bytes]:
    """The words of case-folded text as UTF-8; `table` maps the ASCII separators to spaces."""
    if not text.isascii():
        text = PUNCTUATION.sub(" ", INVISIBLE.sub("", text))
    return text.encode("utf-8", "replace").translate(table).split()
