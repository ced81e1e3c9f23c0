"""Paragraphs and table rows of RTF files by a stack of groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Fixed values of the format: destinations without text of the document, and words that stand for a character.
SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr headerf footerl footerr footerf footnote annotation listtable listoverridetable rsidtbl generator themedata colorschememapping datastore latentstyles xmlnstbl fldinst filetbl revtbl".split())
CHARACTERS = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "emspace": " ", "enspace": " ", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "~": " ", "_": "-", "-": ""}
_PART = re.compile(rb"\\'([0-9A-Fa-f]{2})|\\([A-Za-z]+)(-?\d+)? ?|\\([^A-Za-z])|([{}])|([^\\{}\r\n]+)|[\r\n]+|\\")


class NotRtf(ValueError):
    pass


def paragraphs(data: bytes) -> Iterator[tuple[str, str]]:
    """(kind, text): paragraph, table_row (cells joined by ` | `), page_break, section_break, in order.

    Bytes are of the file's code page, cp1252 where it is unknown. Groups of other destinations, and those marked as
    optional, are left out.
    """
    if not data.lstrip()[:5].startswith(b"{\\rtf"):
        raise NotRtf("no RTF")
    page, raw, text = "cp1252", bytearray(), []
    cells: list[str] | None = None
    # Of each open group: whether it is left out, and characters behind a \\u that stand in for it.
    stack, skip, fallback, owed, optional = [], False, 1, 0, False

    def flush() -> None:
        if raw:
            text.append(raw.decode(page, "replace"))
            raw.clear()

    def taken() -> str:
        flush()
        # Halves of a character from two \\u words are put together.
        own = "".join(text).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()
        text.clear()
        return own

    for m in _PART.finditer(data):
        code, word, number, sign, brace, plain = m.groups()
        if brace == b"{":
            stack.append((skip, fallback))
        elif brace == b"}":
            if stack:
                skip, fallback = stack.pop()
            owed = 0
        elif sign == b"*":
            optional = True
            continue
        elif word is not None:
            name, value = word.decode(), int(number) if number else None
            if optional or name in SKIPPED:
                skip = True
            elif name == "ansicpg" and value:
                flush()
                try:
                    b"".decode(f"cp{value}")
                    page = f"cp{value}"
                except LookupError:
                    page = "cp1252"
            elif name == "uc":
                fallback = value or 0
            elif skip:
                pass
            elif name == "u" and value is not None:
                flush()
                text.append(chr(value & 0xFFFF))
                owed = fallback
            elif name in CHARACTERS:
                flush()
                text.append(CHARACTERS[name])
            elif name == "trowd":
                cells = cells if cells is not None else []
            elif name in ("cell", "nestcell"):
                cells = [*(cells or []), taken()]
            elif name in ("row", "nestrow"):
                if row := " | ".join(x for x in cells or () if x):
                    yield "table_row", row
                cells = None
            elif name in ("par", "sect", "page"):
                if cells is not None and name == "par":
                    flush()
                    text.append(" ")  # inside a cell
                else:
                    if own := taken():
                        yield "paragraph", own
                    if name != "par":
                        yield ("page_break" if name == "page" else "section_break"), ""
        elif sign is not None:
            if not skip:
                flush()
                text.append(CHARACTERS.get(sign.decode("latin-1"), sign.decode("latin-1")))
        elif not skip and (code or plain):
            own = bytes([int(code, 16)]) if code else plain
            cut = min(owed, len(own))
            owed -= cut
            raw += own[cut:]
        optional = False
    if cells:
        yield "table_row", " | ".join(x for x in cells if x)
    if own := taken():
        yield "paragraph", own
