"""Cutting files into chunks: line windows with overlap, character budgets, and definitions."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as T

# Languages that are cut at definitions.
SUPPORTED = (
    "rust", "python", "javascript", "jsx", "typescript", "tsx", "go", "java", "c", "cpp", "hpp", "cc", "cxx", "ruby", "bash",
    "shell", "sh", "zsh", "json", "yaml", "yml",
)


def supported(language: Column) -> Column:
    """Whether texts of the language can be cut at definitions."""
    return F.coalesce(language.isin(list(SUPPORTED)), F.lit(False))


LINE_BYTES = 50  # what a line is taken to hold when an overlap is turned into lines

# How a definition begins, by language; the first line of a unit.
DEFINITION = {
    "rust": r"(?:pub(?:\([^)]*\))? )?(?:async |unsafe |const )*(?:fn|struct|enum|trait|impl|mod|type|union|static|macro_rules!)\b",
    "python": r"(?:async )?(?:def|class) |@",
    "javascript": r"(?:export )?(?:default )?(?:async )?(?:function|class|const|let|var) ",
    "typescript": r"(?:export )?(?:default )?(?:declare )?(?:abstract )?(?:async )?(?:function|class|const|let|var|interface|type|enum|namespace) ",
    "go": r"(?:func|type|var|const) ",
    "java": r"(?:public |private |protected |static |final |abstract )*(?:class|interface|enum|record) |    (?:public|private|protected) ",
    "c": r"[A-Za-z_][\w *]*\([^;]*$|(?:struct|enum|union|typedef) ",
    "cpp": r"[A-Za-z_][\w *:<>&]*\([^;]*$|(?:class|struct|enum|union|typedef|template|namespace) ",
    "ruby": r"(?:def|class|module) ",
    "bash": r"(?:function )?\w+ ?\(\)",
    "json": r'  "',
    "yaml": r"[\w\-]+:",
}


def windows(files: DataFrame, size: int = 50, overlap: int = 10, content: str = "content") -> DataFrame:
    """One row per window of ``size`` lines, the next one ``overlap`` lines before the last one's end.

    Adds chunk_no (from 0), start_line, end_line (from 1, inclusive) and chunk; empty and null texts give none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    n = F.size("_lines")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    at = files.withColumn("_lines", T.lines_of(content)).filter(n > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_no") * step + 1
    end = F.least(start + size - 1, n)
    return (
        at.withColumn("start_line", start.cast("long")).withColumn("end_line", end.cast("long"))
        .withColumn("chunk", F.array_join(F.slice("_lines", start, F.lit(size)), "\n")).drop("_lines")
    )


def identified(chunks: DataFrame, path: str = "file_path") -> DataFrame:
    return chunks.withColumn("chunk_id", T.chunk_id(path, "start_line", "end_line"))


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line (from 1) that holds the byte before ``offset``."""
    head = F.substring(text.cast("binary"), F.lit(1), offset.cast("int")).cast("string")
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def by_budget(lines: list[str], tokens: int) -> list[tuple[int, int]]:
    """Line spans that hold at least 4 x tokens bytes (the last may hold fewer), each beginning a few lines before the last one's end.

    Spans are looked up in the running size of the text: a span ends with the line in which its budget is reached.
    """
    budget = 4 * tokens
    overlap = max(1, budget // (4 * LINE_BYTES))
    ends = list(accumulate(len(x.encode()) + 1 for x in lines))
    out: list[tuple[int, int]] = []
    while lines and (not out or out[-1][1] < len(lines)):
        first = max(out[-1][0] + 1, out[-1][1] - overlap) if out else 0
        before = ends[first - 1] if first else 0
        out.append((first, min(len(lines), bisect_left(ends, before + budget, first) + 1)))
    return out


def by_definition(lines: list[str], tokens: int, language: str) -> list[tuple[int, int]]:
    """Line spans that end before a definition, as full as 4 x tokens bytes allow; by budget where that fails."""
    begins = re.compile(DEFINITION.get(language, DEFINITION["rust"]))
    cuts = [i for i, x in enumerate(lines) if begins.match(x)]
    cuts = [c for i, c in enumerate(cuts) if i == 0 or not lines[c - 1].startswith("@")]
    if not cuts:
        return by_budget(lines, tokens)
    edges = [0, *[c for c in cuts if c > 0], len(lines)]
    limit, out, a = tokens * 4, [], 0
    size = [0]
    for x in lines:
        size.append(size[-1] + len(x.encode()) + 1)
    for k in range(1, len(edges)):
        if k + 1 == len(edges) or size[edges[k + 1]] - size[a] > limit:
            if size[edges[k]] - size[a] > limit:
                out += [(a + x, a + y) for x, y in by_budget(lines[a : edges[k]], tokens)]
            else:
                out.append((a, edges[k]))
            a = edges[k]
    return out


def budgeted(files: DataFrame, tokens: int = 512, definitions: bool = False) -> DataFrame:
    """(file_path, language, start_line, end_line, chunk) by character budget, or by definitions within it."""

    def run(batches):
        for b in batches:
            out = [[] for _ in range(5)]
            for path, language, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                lines = (text or "").replace("\r\n", "\n").split("\n") if text else []
                lines = lines[:-1] if lines and lines[-1] == "" else lines
                spans = by_definition(lines, tokens, language or "") if definitions and (language or "") in DEFINITION else by_budget(lines, tokens)
                for x, y in spans:
                    for column, v in zip(out, (path, language, x + 1, y, "\n".join(lines[x:y])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file_path", "language", "start_line", "end_line", "chunk"])

    return files.select("file_path", "language", "content").mapInArrow(run, "file_path string, language string, start_line long, end_line long, chunk string")
