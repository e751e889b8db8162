"""Reading component code: brackets, functions, returned markup, object literals. All skip strings and comments.

One pattern cuts a source into strings, comments and signs; everything here walks over its matches from where it starts,
so an odd quote before that place does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: How far a function, or its parameters, are looked for, and how long one is taken to be if its end isn't found.
REACH, PARAMETERS_WITHIN, FALLBACK = 120_000, 500, 20_000

SIGNS = re.compile(
    r"""(?P<skip>//[^\r\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))|(?P<sign>[()\[\]{},;:])""",
    re.DOTALL,
)
CLOSES = {"(": ")", "[": "]", "{": "}"}
# How a component is declared, and what returns markup.
DECLARATIONS = re.compile(r"function ([A-Z][a-zA-Z0-9]{2,})\s*\(|const ([A-Z][a-zA-Z0-9]{2,})\s*=\s*\(")
RETURNS_MARKUP = re.compile(r"(?:return|=>)\s*(?=\(\s*<(?:[A-Za-z]|>)|<(?:[A-Za-z]|>)|(?:[A-Za-z_$][\w$]*\.)?jsx?s?\s*\()")


@dataclass(frozen=True)
class Function:
    """A declared component's name and its place in the source."""

    name: str
    start: int
    body: int
    end: int


def signs(source: str, start: int, end: int | None = None) -> Iterator[tuple[str, int]]:
    """Brackets and separators, with their places."""
    for m in SIGNS.finditer(source, start, len(source) if end is None else end):
        if m["sign"]:
            yield m["sign"], m.start()


def closing(source: str, at: int) -> int | None:
    """The place after the bracket that closes the one at a place; None if there's none within reach."""
    opening, depth = source[at], 0
    for sign, place in signs(source, at, min(at + REACH, len(source))):
        depth += (sign == opening) - (sign == CLOSES[opening])
        if depth == 0 and sign == CLOSES[opening]:
            return place + 1
    return None


def code_matches(pattern: re.Pattern, source: str) -> Iterator[re.Match]:
    """Matches that don't start inside a string or a comment."""
    skipped = [m.span() for m in SIGNS.finditer(source) if m["skip"]]
    k = 0
    for m in pattern.finditer(source):
        while k < len(skipped) and skipped[k][1] <= m.start():
            k += 1
        if k == len(skipped) or m.start() < skipped[k][0]:
            yield m


def body_of(source: str, start: int) -> int | None:
    """Where a function's body opens: a brace, or the parenthesis of an arrow's expression."""
    opened = source.find("(", start, start + PARAMETERS_WITHIN + 1)
    closed = closing(source, opened) if opened >= 0 else None
    if closed is None:
        return None
    m = re.compile(r"\s*(?:=>\s*)?([{(])").match(source, closed)
    return m.start(1) if m else None


def functions(source: str) -> list[Function]:
    """Declared components by place. An end that runs into the next one is cut there, unless the next is inside."""
    found = []
    for m in code_matches(DECLARATIONS, source):
        body = body_of(source, m.start())
        end = closing(source, body) if body is not None else None
        end = min(m.start() + FALLBACK, len(source)) if end is None else end
        found.append(Function(m[1] or m[2], m.start(), body if body is not None and body <= end else m.start(), end))
    cut = []
    for f, after in zip(found, [*found[1:], None], strict=False):
        overlaps = after is not None and after.start < f.end < after.end
        cut.append(Function(f.name, f.start, f.body, after.start) if overlaps else f)
    return cut


def returned(source: str) -> str:
    """What a function returns: the markup, without the parentheses around it; empty if it returns nothing."""
    m = RETURNS_MARKUP.search(source) or re.search(r"\breturn(?=\s*\()", source)
    if not m:
        return ""
    at = re.compile(r"\s*").match(source, m.end()).end()
    if source[at : at + 1] == "(" and (end := closing(source, at)) is not None:
        return source[at + 1 : end - 1].strip()
    depth = 0
    for sign, place in signs(source, at):
        if depth == 0 and sign in ";}":
            return source[at:place].strip()
        depth = max(0, depth + (sign in CLOSES) - (sign in CLOSES.values()))
    return source[at:].strip()


def returns_markup(source: str) -> bool:
    return bool(RETURNS_MARKUP.search(source))


def split(text: str, separator: str = ",") -> list[str]:
    """Parts between separators that are in no bracket, string or comment."""
    parts, start, depth = [], 0, 0
    for sign, place in signs(text, 0):
        if sign == separator and depth == 0:
            parts.append(text[start:place])
            start = place + 1
        else:
            depth = max(0, depth + (sign in CLOSES) - (sign in CLOSES.values()))
    return [*parts, text[start:]]


def unquoted(value: str) -> str:
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value


def pairs(literal: str) -> list[tuple[str, str]]:
    """Keys and values of an object literal's inside, values unquoted; what has no colon is left out."""
    split_ = (part.strip().partition(":") for part in split(literal))
    return [(unquoted(k.strip()), unquoted(v.strip())) for k, colon, v in split_ if colon]


def style_literals(source: str) -> list[str]:
    """The insides of all style={{...}}."""
    places = ((m.end() - 1, closing(source, m.end() - 1)) for m in re.finditer(r"style=\{\{", source))
    return [source[a + 1 : b - 1] for a, b in places if b is not None]


def handler_bodies(source: str, event: str) -> list[str]:
    """The insides of all handlers of an event."""
    places = ((m.end() - 1, closing(source, m.end() - 1)) for m in re.finditer(rf"\b{event}\s*=\s*\{{", source))
    return [source[a + 1 : b - 1] for a, b in places if b is not None]
