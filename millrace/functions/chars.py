"""Regular-expression classes from characters and ranges, for Java and for RE2."""

from __future__ import annotations


def char_class(chars: str) -> str:
    """A class of single characters; all but letters and digits are written as code points."""
    return "[" + "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def fast_class(chars: str) -> str:
    """The class for Java's matcher only: one comparison tells it that an ASCII character is none of the others."""
    others = "".join(c for c in chars if not c.isascii())
    ascii_ = char_class("".join(c for c in chars if c.isascii()))[1:-1]
    return f"[{ascii_}[\\x{{80}}-\\x{{{ord(max(others)):X}}}&&{char_class(others)}]]" if others else f"[{ascii_}]"


def range_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
