"""A small part of Markdown as HTML: headings, quotes, nested lists, code, bold, italics and evidence marks."""

from __future__ import annotations

import html
import re

import pandas as pd

from quillspark.functions.arrow import arrow_function

_ITEM = re.compile(r"^(\s*)(?:[-*+]|(\d+)[.)])\s+(.*)$")


def inline(text: str) -> str:
    """Marks inside a line; code keeps its characters."""
    out = []
    for k, part in enumerate(re.split(r"`([^`]+)`", text)):
        safe = html.escape(part)
        if k % 2:
            out.append(f"<code>{safe}</code>")
            continue
        safe = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", safe)
        safe = re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<em>\1</em>", safe)
        out.append(re.sub(r"\[(M\d+(?::S\d+)?)\]", r"<sup>[\1]</sup>", safe))
    return "".join(out)


def render(text: str | None) -> str:
    """HTML of a text; blank lines end paragraphs and lists, deeper items nest."""
    out: list[str] = []
    lists: list[tuple[int, str]] = []
    paragraph: list[str] = []

    def flush() -> None:
        if paragraph:
            out.append(f"<p>{' '.join(paragraph)}</p>")
            paragraph.clear()

    def leave(depth: int) -> None:
        while lists and lists[-1][0] > depth:
            out.append(f"</li></{lists.pop()[1]}>")

    for line in (text or "").replace("\r\n", "\n").split("\n"):
        item = _ITEM.match(line)
        if item:
            flush()
            depth, kind = len(item[1].expandtabs(4)), "ol" if item[2] else "ul"
            leave(depth)
            if lists and lists[-1] == (depth, kind):
                out.append("</li>")
            else:
                if lists and lists[-1][0] == depth:
                    out.append(f"</li></{lists.pop()[1]}>")
                lists.append((depth, kind))
                out.append(f"<{kind}>")
            out.append(f"<li>{inline(item[3])}")
            continue
        leave(-1)
        heading = re.match(r"^(#{1,3})\s+(.*)$", line)
        if heading or line.startswith(">") or not line.strip():
            flush()
        if heading:
            out.append(f"<h{len(heading[1])}>{inline(heading[2])}</h{len(heading[1])}>")
        elif line.startswith(">"):
            out.append(f"<blockquote>{inline(line[1:].strip())}</blockquote>")
        elif line.strip():
            paragraph.append(inline(line.strip()))
    leave(-1)
    flush()
    return "".join(out)


@arrow_function("string")
def markdown_html(text: pd.Series) -> pd.Series:
    return text.map(render, na_action=None)
