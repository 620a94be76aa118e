"""Comment and string surfaces of source text."""

from __future__ import annotations

import re
from typing import NamedTuple

#: One alternative a surface. A quote opens a literal only where no lifetime or label can stand and another quote follows within eight characters of the line.
_TOKEN = re.compile(
    r"""
      /\*(?P<block>.*?)(?:\*/|\Z)
    | //(?P<slash>[^\n]*)(?P<end1>\n|\Z)
    | (?P<quotes>\"\"\"|''')(?P<doc>(?:\\.|(?!(?P=quotes)).)*)(?P<closed1>(?P=quotes)|\Z)
    | (?P<mark>["`])(?P<text>(?:\\.|(?!(?P=mark))[^\\])*\\?)(?P<closed2>(?P=mark)|\Z)
    | (?<![&<'\w])'(?=[^\n]{0,7}')(?P<single>(?:\\.|[^'\\])*\\?)(?P<closed3>'|\Z)
    | (?:(?<=\s)|(?<![\s\S]))(?:--|\#)(?P<hash>[^\n]*)(?P<end2>\n|\Z)
    | (?P<line>\n)
    """,
    re.VERBOSE | re.DOTALL,
)


class Surfaces(NamedTuple):
    comments: str
    strings: str
    code_lines: int
    comment_lines: int
    string_literals: int


def split_code(source: str) -> Surfaces:
    """Comments and literals one after the other, and counts. Block comments keep the star of their end; unclosed literals give their text but do not count."""
    comments, strings, code, commented, literals = [], [], 0, 0, 0
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup if m.lastgroup in ("line", "block") else next(k for k in ("block", "slash", "hash", "doc", "text", "single", "line") if m[k] is not None)
        if kind == "line":
            code += 1
        elif kind == "block":
            closed = m.group().endswith("*/") and len(m.group()) >= 4
            comments.append(m["block"] + ("*" if closed else ""))
            commented += m["block"].count("\n")
        elif kind in ("slash", "hash"):
            comments.append(m[kind])
            commented += 1
        else:
            strings.append(m[kind])
            literals += bool(m[{"doc": "closed1", "text": "closed2", "single": "closed3"}[kind]])
    return Surfaces("".join(comments), "".join(strings), code, commented, literals)
