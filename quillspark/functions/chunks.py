"""Bounded pieces of long texts: packing, cutting and putting together again."""

from __future__ import annotations

import re
from collections.abc import Callable

from quillspark.functions.sentences import split_sentences

_HEADING = re.compile(r"\f|\n\s*\n|(?=^#{1,6}\s)", re.M)


def pack(pieces: list[str], limit: int, separator: int) -> list[list[str]]:
    """Pieces in order, as many together as fit a limit with a separator between them."""
    groups: list[list[str]] = []
    used = 0
    for piece in pieces:
        if groups and used + separator + len(piece) <= limit:
            groups[-1].append(piece)
            used += separator + len(piece)
        else:
            groups.append([piece])
            used = len(piece)
    return groups


def snippets(text: str | None, limit: int = 1800) -> list[str]:
    """Blocks between blank lines, form feeds or headings; long ones as packed sentences.

    A sentence that is longer than the limit is left out: a fragment would mislead.
    """
    out = []
    for block in _HEADING.split((text or "").replace("\r\n", "\n").replace("\r", "\n")):
        block = re.sub(r"[\t ]+", " ", block).strip()
        if len(block) <= limit:
            out += [block] if block else []
            continue
        run: list[str] = []
        for sentence in [*split_sentences(block), None]:
            if sentence is not None and len(sentence) <= limit:
                run.append(sentence)
                continue
            out += [" ".join(group) for group in pack(run, limit, 1)]
            run = []
    return out


def source_paragraphs(text: str | None, counts: list[int] | None = None, limit: int = 1200) -> list[str]:
    """Paragraphs of given sentence counts if these add up, else packed sentences."""
    sentences = split_sentences(text)
    counts = [c for c in counts or [] if c > 0]
    if counts and sum(counts) == len(sentences):
        ends = [sum(counts[: k + 1]) for k in range(len(counts))]
        return [" ".join(sentences[e - c : e]) for c, e in zip(counts, ends, strict=True)]
    return [" ".join(group) for group in pack(sentences, limit, 1)]


_SPACES = re.compile(r"\s*")


def _cut(text: str, begin: int, limit: int) -> int:
    """Where the piece that begins there ends: after its last sentence mark, else at its last space, if late enough; else at the limit."""
    stop, least = begin + limit + 1, begin + int(limit * 0.55)
    mark = max(text.rfind(m, begin, stop) for m in (". ", "。", "！", "？"))
    if mark >= least:
        return mark + 1
    space = text.rfind(" ", begin, stop)
    return space if space >= least else begin + limit


def split_oversized(text: str, limit: int) -> list[str]:
    """Trimmed pieces of at most ``limit`` characters, cut at sentence ends or spaces where they come late enough."""
    out, begin = [], 0
    while len(text) - begin > limit:
        at = _cut(text, begin, limit)
        out.append(text[begin:at].strip())
        begin = _SPACES.match(text, at).end()
    return [*out, text[begin:]] if begin < len(text) else out


def lossless_windows(text: str | None, limit: int) -> list[str]:
    """Contiguous windows whose concatenation is the text itself."""
    whole, out, begin = text or "", [], 0
    while len(whole) - begin > limit:
        stop, half = begin + limit, begin + limit * 0.5
        mark, space = max(whole.rfind(m, begin, stop) for m in ("\n\n", ". ", "。")), whole.rfind(" ", begin, stop)
        at = mark + 1 if mark >= half else space + 1 if space >= half else stop
        out.append(whole[begin:at])
        begin = at
    return [*out, whole[begin:]] if begin < len(whole) else out


def windows(paragraphs: list[str], limit: int = 7000) -> list[dict]:
    """Windows of paragraph pieces within a limit: text, paragraphs and whether an end is inside a paragraph."""
    limit = max(40, limit)
    pieces = []
    for number, paragraph in enumerate(paragraphs):
        parts = split_oversized(paragraph, limit)
        pieces += [(number, k, len(parts), part) for k, part in enumerate(parts)]
    out, used = [], 0
    groups: list[list[tuple]] = []
    for piece in pieces:
        if groups and used + 2 + len(piece[3]) <= limit:
            groups[-1].append(piece)
            used += 2 + len(piece[3])
        else:
            groups.append([piece])
            used = len(piece[3])
    for group in groups:
        text = group[0][3]
        for a, b in zip(group, group[1:], strict=False):
            text += (" " if a[0] == b[0] else "\n\n") + b[3]
        first, last = group[0], group[-1]
        out.append({"text": text, "first": first[0], "last": last[0], "continues_previous": first[1] > 0, "continues_next": last[1] < last[2] - 1})
    return out


def reassemble(regions: list[dict], finish: Callable[[str], str] = str) -> str:
    """Windows' cleaned texts put together: a space inside a split paragraph, else a blank line."""
    text, before = "", None
    for region in regions:
        cleaned = (region.get("cleaned") or "").strip()
        if not cleaned:
            continue
        inside = before is not None and region["continues_previous"] and before["last"] == region["first"]
        text += ("" if before is None else " " if inside else "\n\n") + cleaned
        before = region
    return finish(text).strip()


def semantic_chunks(text: str | None, limit: int) -> list[str]:
    """Blocks packed within a limit; a long block by its lines, a long line by its sentences or spaces."""
    units: list[tuple[str, str]] = []
    for block in re.split(r"\n{2,}", (text or "").strip()):
        if len(block) <= limit:
            units.append(("\n\n", block))
            continue
        for k, line in enumerate(x for x in block.split("\n") if x.strip()):
            for j, part in enumerate(split_oversized(line.strip(), limit)):
                units.append(("\n\n" if k == j == 0 else "\n" if j == 0 else " ", part))
    out: list[str] = []
    for joint, unit in units:
        if out and len(out[-1]) + len(joint) + len(unit) <= limit:
            out[-1] += joint + unit
        elif unit.strip():
            out.append(unit)
    return out


def display_groups(units: list[tuple[str, str]], topics: dict[str, int] | None = None) -> list[list[str]]:
    """Ids of ``(id, text)`` units in groups to show: up to three, about 15 to 40 words, of one topic."""
    topics, out, n = topics or {}, [], 0
    group: list[str] = []
    for key, text in units:
        size = len(text.split())
        other = group and key in topics and group[0] in topics and topics[key] != topics[group[0]]
        if group and (len(group) == 3 or n >= 40 or other or (n >= 15 and n + size > 40)):
            out.append(group)
            group, n = [], 0
        group.append(key)
        n += size
    return [*out, group] if group else out
