"""Equation streams (MTEF versions 3 to 5) to text: characters, lines, piles, and the templates for fractions, roots and scripts."""

from __future__ import annotations

import re
import struct

from pagewright.operators.matching import clean_math_term, format_fraction

# Versions, the start of a root, record types, options, and the selectors and signs that have a text of their own.
VERSIONS, HEADER = (3, 4, 5), 28
ROOT = b"\x01\x00\x04\x00\x00\x0a"
END, LINE, CHAR, TMPL, PILE, MATRIX, EMBELL, FONT_STYLE, SIZE = 0, 1, 2, 3, 4, 5, 6, 8, 9
NUDGE, LINE_NULL, LINE_SPACING, CHAR_EMBELL, CHAR_8, CHAR_16, CHAR_NO_MTCODE = 0x08, 0x01, 0x04, 0x01, 0x04, 0x10, 0x20
FRACTIONS, SUBSCRIPTS, SUPERSCRIPTS, BOTH_SCRIPTS, ROOTS, PARENTHESES = (11,), (2, 27), (3, 28), (1, 29), (4, 10, 24), (0,)
SPACED = {0x2B: "+", 0x2D: "-", 0x2212: "-", 0x3D: "=", 0xB1: "±", 0xD7: "×", 0xF7: "÷", 0x221E: "∞", 0x2260: "≠", 0x2264: "≤", 0x2265: "≥"}
MATRIX_TEXT = "[matrix]"
# End of fixed values.


class _Reader:
    """Bytes in order; zeros after the end."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def word(self) -> int:
        return self.byte() | self.byte() << 8

    def options(self) -> int:
        """The options of a record, with the nudge that may follow them."""
        options = self.byte()
        if options & NUDGE and (self.byte(), self.byte()) == (128, 128):
            self.at += 4
        return options

    def until_end(self, item) -> list:
        out = []
        while self.at < len(self.data):
            if self.data[self.at] == END:
                self.at += 1
                break
            out.append(item())
        return out


def _record(r: _Reader) -> str:
    read = _READ.get(r.byte())
    return read(r) if read else ""


def _line_text(r: _Reader) -> str:
    options = r.options()
    if options & LINE_SPACING:
        r.word()
    return "" if options & LINE_NULL else "".join(r.until_end(lambda: _record(r)))


def _char(r: _Reader) -> str:
    options = r.options()
    if r.byte() == 128:
        r.word()
    code = 0 if options & CHAR_NO_MTCODE else r.word()
    if options & CHAR_8:
        r.byte()
    elif options & CHAR_16:
        r.word()
    if options & CHAR_EMBELL:
        r.until_end(r.byte)
    if code in SPACED:
        return f" {SPACED[code]} "
    return "" if code == 0 else "\ufffd" if 0xD800 <= code < 0xE000 else chr(code)


def _slots(r: _Reader) -> list[str]:
    return [t for t in map(str.strip, r.until_end(lambda: _record(r))) if t]


def _script(mark: str, t: str, letters: bool) -> str:
    t = clean_math_term(t)
    bare = len(t) == 1 and (t.isalnum() or not letters)
    return mark + (t if bare else f"{{{t}}}")


def _template(r: _Reader) -> str:
    r.options()
    selector = r.byte()
    if r.byte() & 0x80:
        r.byte()
    r.byte()
    slots = _slots(r)
    first, second, last = [*slots, "", ""][0], [*slots, "", ""][1], slots[-1] if slots else ""
    if selector in FRACTIONS:
        return format_fraction(first, second)
    if selector in SUPERSCRIPTS:
        return _script("^", last, True)
    if selector in SUBSCRIPTS:
        return _script("_", first, True)
    if selector in BOTH_SCRIPTS:
        return _script("_", first, False) + _script("^", second, False)
    if selector in ROOTS:
        return f"√({last})"
    inner = " ".join(slots)
    return f"({inner})" if selector in PARENTHESES else inner


def _pile(r: _Reader) -> str:
    r.options()
    r.word()
    return " \n ".join(_slots(r))


def _skipped(r: _Reader, n: int, text: str = "") -> str:
    r.at += n
    return text


def _embellishment(r: _Reader) -> str:
    r.options()
    return _skipped(r, 1)


_READ = {
    LINE: _line_text,
    CHAR: _char,
    TMPL: _template,
    PILE: _pile,
    MATRIX: lambda r: _skipped(r, 2, MATRIX_TEXT),
    EMBELL: _embellishment,
    FONT_STYLE: lambda r: _skipped(r, 2),
    SIZE: lambda r: _skipped(r, {101: 2, 100: 3}.get(r.byte(), 1)),
}


def _root(data: bytes) -> int:
    """Where the equation begins: at a line that holds a pile, else at the first line from byte 20 on; -1 if there is none."""
    return at if (at := data.find(ROOT)) >= 0 else data.find(bytes([LINE, 0]), 20)


def decode(stream: bytes | None) -> str | None:
    """text of an equation stream, its header included; null for what is no such stream or holds no equation.

    Records of no known type have no text.  Signs of sums and comparisons stand between blanks.
    """
    if not stream or len(stream) < HEADER:
        return None
    size = int.from_bytes(stream[:4], "little")
    data = stream[size if 4 <= size < len(stream) else HEADER :]
    if len(data) < 5 or data[0] not in VERSIONS or (at := _root(data)) < 0:
        return None
    try:
        text = re.sub(" +", " ", clean_math_term(_record(_Reader(data, at)))).strip()
    except RecursionError:
        return None
    return text.replace("+ -", "-").replace("- +", "-") or None


def _line(text: str) -> bytes:
    return bytes([LINE, 0]) + b"".join(bytes([CHAR, 0, 131]) + struct.pack("<H", ord(c)) for c in text) + bytes([END])


def record(body: bytes) -> bytes:
    """A stream whose root holds the given records."""
    return struct.pack("<I", HEADER) + bytes(HEADER - 4) + bytes([5, 1, 0, 5, 0]) + b"DSMT5\0\0" + ROOT + bytes([LINE, 0]) + body + bytes([END, END, END])


def template(selector: int, *slots: str) -> bytes:
    return bytes([TMPL, 0, selector, 0, 0]) + b"".join(map(_line, slots)) + bytes([END])


def fraction_record(num: str, den: str) -> bytes:
    """A stream that holds one fraction."""
    return record(template(FRACTIONS[0], num, den))
