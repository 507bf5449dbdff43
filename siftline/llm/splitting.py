"""Cutting oversized items into pieces under a limit, at natural boundaries, with overlap.

The lines of an item form a tree: headings and list levels in Markdown, indentation and closing
brackets elsewhere; comments and annotations belong to what follows them.  Sibling subtrees are
merged from the left up to the limit, and only an oversized node is entered.  A line that is too
long is cut behind a sentence, else a blank, else a whole character.

Pieces hold at most ``limit`` UTF-8 bytes, of which up to a quarter are the end of the piece before
(whole lines, or whole words of a long line).  Without overlaps they give the item back exactly.

Defined results: null content is one empty piece; an item within the limit is one piece; a budget
that is null or unknown is medium; extra columns are dropped; repeated rows give repeated rows from
``pieces`` and one from ``found``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGETS = {"small": 256, "medium": 512, "large": 1024}
BYTES_PER_TOKEN, OVERLAP_PART = 4, 4

_HEADING = re.compile(r"(#{1,6})\s")
_CLOSES = re.compile(r"\s*(?:[)\]}]|end\b|else\b|elif\b|except\b|finally\b|catch\b)")
_LEADS = re.compile(r"\s*(?:#(?!\s*$)|//|/\*|\*|@|\"\"\"|'''|--)")


def limit_of(budget: Column) -> Column:
    """Bytes that a budget allows."""
    b = F.lower(F.trim(budget))
    named = F.coalesce(*[F.when(b == k, F.lit(v)) for k, v in BUDGETS.items()], F.when(b.rlike(r"^[0-9]{1,9}$") & (b.try_cast("int") > 0), b.try_cast("int")), F.lit(BUDGETS["medium"]))
    return (named * BYTES_PER_TOKEN).cast("long")


class _Node:
    __slots__ = ("a", "b", "children", "level")

    def __init__(self, a: int, b: int, level: int):
        self.a, self.b, self.level, self.children = a, b, level, []


def tree(lines: list[str], markdown: bool) -> _Node:
    """The item's lines as a tree; a node spans its own lines and its children's, children tile the rest."""
    root = _Node(0, len(lines), -1)
    stack, fence = [root], False
    lead: int | None = None  # first line of comments and annotations that wait for what follows
    fresh = True  # behind an empty line
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            fresh = True
            continue
        indent = len(line) - len(line.lstrip())
        heading = _HEADING.match(line) if markdown and not fence else None
        if markdown and s.startswith("```"):
            fence = not fence
        if heading:
            level = len(heading.group(1))
        elif markdown:
            level = 7 + (0 if fence or (s.startswith("```") and not fence) else indent)
            if not fresh and len(stack) > 1 and stack[-1].level >= 7 and not re.match(r"\s*(?:[-*+]|\d+[.)])\s", line):
                continue  # the same paragraph or code block
        else:
            level = indent
            if _CLOSES.match(line):
                while len(stack) > 1 and stack[-1].level > level:
                    stack.pop()
                fresh = False
                continue
            if _LEADS.match(line) and lead is None:
                lead = i
            if _LEADS.match(line) and i + 1 < len(lines) and lines[i + 1].strip():
                continue
        start = i if lead is None or markdown else lead
        lead = None
        while len(stack) > 1 and stack[-1].level >= level:
            stack.pop()
        node = _Node(start, start, level)
        stack[-1].children.append(node)
        stack.append(node)
        fresh = False

    def close(node: _Node, end: int) -> None:
        todo = [(node, end)]
        while todo:
            n, e = todo.pop()
            n.b = e
            for k, c in enumerate(n.children):
                todo.append((c, n.children[k + 1].a if k + 1 < len(n.children) else e))

    close(root, len(lines))
    return root


def _units(node: _Node, size, limit: int) -> list[tuple[int, int]]:
    """Line spans that tile the node: merged siblings within the limit, single lines at worst; a node's own lines go with what comes first in it."""
    out: list[tuple[int, int]] = []
    leads = False  # the last span is the own lines of nodes that were entered
    todo = [(node.a, node.b, node, False)]
    while todo:
        a, b, n, own = todo.pop()
        if a >= b:
            continue
        if size(a, b) <= limit or b - a == 1:
            if leads and size(out[-1][0], b) <= limit:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            leads = own
            continue
        kids = n.children if n else []
        parts: list[tuple[int, int, _Node | None]] = []
        first = kids[0].a if kids else b
        if n is not None and first > a:
            parts.append((a, first, None))
        parts += [(k.a, k.b, k) for k in kids]
        if len(parts) <= 1 and (not parts or parts[0][2] is None):  # no structure left: lines
            parts = [(i, i + 1, None) for i in range(a, b)]
        merged: list[tuple[int, int, _Node | None]] = []
        for p in parts:
            if merged and size(merged[-1][0], p[1]) <= limit:
                merged[-1] = (merged[-1][0], p[1], None)
            else:
                merged.append(p)
        headed = n is not None and bool(kids) and first > a and merged[0][1] == first
        todo += [(x, y, k, headed and i == 0) for i, (x, y, k) in reversed(list(enumerate(merged)))]
    return out


_BREAKS = (re.compile(r"[.!?;]\s"), re.compile(r"[,:]\s"), re.compile(r"\s"), re.compile(r"[,;|/&)]"))


def _cut(text: str, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    """Character spans of a long line, each within the limit."""
    out = []
    while a < b:
        piece = text[a : min(b, a + limit)].encode("utf-8", "surrogatepass")[:limit].decode("utf-8", "ignore")
        end = a + max(1, len(piece))
        if end < b:
            for rule in _BREAKS:
                found = [m.end() for m in rule.finditer(text, a + (end - a) // 2, end)]
                if found:
                    end = found[-1]
                    break
        out.append((a, min(end, b)))
        a = out[-1][1]
    return out


def split(text: str, limit: int, markdown: bool = False) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of each piece, as character positions; a final line end belongs to no piece's size."""
    utf8 = lambda s: len(s.encode("utf-8", "surrogatepass"))
    if utf8(text) <= limit:
        return [(0, 0, len(text))]
    lines = text.split("\n")
    chars, sizes = [0], [0]
    for x in lines:
        chars.append(chars[-1] + len(x) + 1)
        sizes.append(sizes[-1] + utf8(x) + 1)
    chars[-1] -= 1
    overlap = limit // OVERLAP_PART
    core = max(1, limit - overlap)
    spans: list[tuple[int, int]] = []
    for a, b in _units(tree(lines, markdown), lambda a, b: sizes[b] - sizes[a], core):
        if sizes[b] - sizes[a] <= core:
            spans.append((chars[a], chars[b]))
        else:
            spans += _cut(text, chars[a], chars[b], core)
    out, before = [], 0
    for a, b in spans:
        if a == b:  # the empty line behind a final line end
            continue
        start = a
        if out:
            start = _lead_in(text, before, a, min(overlap, limit - utf8(text[a:b])))
        out.append((start, a, b))
        before = a
    return out


def _lead_in(text: str, least: int, at: int, most: int) -> int:
    """Where a piece that begins at ``at`` begins with its overlap: whole lines if one fits, else whole words."""
    if most <= 0:
        return at
    tail = text[max(least, at - most) : at]
    while len(tail.encode("utf-8", "surrogatepass")) > most:
        tail = tail[max(1, (len(tail.encode("utf-8", "surrogatepass")) - most) // 4) :]
    start = at - len(tail)
    if start <= least:
        return max(start, least)
    line = text.find("\n", start - 1, at)
    if 0 <= line and line + 1 < at:
        return line + 1
    if text[at - 1] == "\n" or line >= 0:
        return at
    word = re.compile(r"\s").search(text, start - 1, at)
    return word.end() if word and word.end() < at else at


SCHEMA = "chunk_id string, codebase_id string, file_path string, language string, limit_bytes long, piece_no int, n_pieces int, start_line long, end_line long, overlap_chars int, content string"


def pieces(items: DataFrame) -> DataFrame:
    """One row per piece of every item."""

    def run(batches):
        for b in batches:
            c = b.to_pydict()
            rows = [[] for _ in range(11)]
            for i, text in enumerate(c["content"]):
                name, limit = c["file_path"][i] or "", c["limit_bytes"][i]
                markdown = name.lower().endswith((".md", ".markdown")) or (c["language"][i] or "").lower() == "markdown"
                cut = split(text, limit, markdown)
                first = c["start_line"][i] or 1
                line, at = first, 0
                for k, (start, core, end) in enumerate(cut):
                    line += text.count("\n", at, core)
                    at = core
                    content = text[start : end - 1] if end < len(text) and text[end - 1] == "\n" and end - 1 > core else text[start:end]
                    begin = line - text.count("\n", start, core)
                    values = (c["chunk_id"][i], c["codebase_id"][i], c["file_path"][i], c["language"][i], limit, k + 1, len(cut), begin, begin + content.count("\n"), core - start, content)
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
            kinds = [pa.string()] * 4 + [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    cols = ["chunk_id", "codebase_id", "file_path", "language", limit_of(F.col("token_budget")).alias("limit_bytes")]
    lines = [F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line")]
    all_items = items.select(*cols, *lines, F.coalesce("content", F.lit("")).alias("content"))
    large = F.octet_length("content") > F.col("limit_bytes")
    kept = all_items.filter(~large).select(*cols[:4], "limit_bytes", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), "start_line", "end_line", F.lit(0).alias("overlap_chars"), "content")
    return all_items.filter(large).mapInArrow(run, SCHEMA).unionByName(kept)


def found(items: DataFrame) -> DataFrame:
    """chunk_id of items that had to be cut."""
    return pieces(items).filter("n_pieces > 1").select("chunk_id").distinct()
