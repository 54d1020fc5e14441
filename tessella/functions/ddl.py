"""Columns of CREATE TABLE text, as a table function."""

from __future__ import annotations

import re

from pyspark.sql.functions import udtf

HEAD = re.compile(r"""create\s+table\s+(?:if\s+not\s+exists\s+)?["`\[]?(\w+)["`\]]?\s*\(""", re.I)
SKIP = re.compile(r"(primary|foreign|unique|constraint|check|key|index)\b", re.I)


def parts(body: str) -> list[str]:
    """body split at commas outside brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(body[at:k])
            at = k + 1
    return [x.strip() for x in [*out, body[at:]] if x.strip()]


def closed(text: str, at: int) -> int:
    """The place of the bracket that closes the one before `at`; the text's end if none does."""
    depth = 1
    while at < len(text) and depth:
        depth += (text[at] == "(") - (text[at] == ")")
        at += 1
    return at - (depth == 0)


@udtf(returnType="table_name string, position int, column_name string, column_type string")
class ParseDdl:
    def eval(self, text: str):
        for m in HEAD.finditer(text or ""):
            place = 0
            for x in parts(text[m.end() : closed(text, m.end())]):
                if not SKIP.match(x):
                    name, _, kind = x.partition(" ")
                    yield m[1], place, name.strip('"`[]'), re.split(r"(?i)\s+(?:not|null|primary|default|references|unique)\b", kind.strip())[0]
                    place += 1
