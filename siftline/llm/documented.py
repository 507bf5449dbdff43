"""Functions and methods paired with their own documentation.

A string- and comment-aware lexer blanks out strings and comments, declarations are found in what
is left, brackets and braces (indentation in Python) delimit them, and the documentation is the
comment right before the declaration (annotations and attributes may stand between) or the string
that opens a Python body.  A pair is kept if at least four words of description remain: lines with
to-do marks, tags, parameters and sections, and the words of the function's own name, don't count.

Defined results: files with other extensions, of a null path, or rejected by their grammar give no
pairs; null content is an empty file; repeated rows count once; an empty table gives an empty table;
extra columns are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.files import assemble, newest_files
from siftline.llm.grammars import LANGUAGE_OF, valid
from siftline.llm.nesting import comment_end, template_end

LEAST_WORDS = 4
EXTENSIONS = ("py", "rs", "js", "ts", "go", "java")

_SQ, _DQ = r"'(?:[^'\\\n]|\\[\s\S])*'", r'"(?:[^"\\\n]|\\[\s\S])*"'
_BLOCK, _LINE = r"/\*[\s\S]*?\*/", r"//[^\n]*"
_REGEX = r"(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
LEXERS = {
    "py": re.compile(rf"#[^\n]*|[rRbBuUfF]{{0,2}}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|{_SQ}|{_DQ})"),
    "js": re.compile(rf"{_LINE}|{_BLOCK}|`|{_SQ}|{_DQ}|{_REGEX}"),
    "java": re.compile(rf"{_LINE}|{_BLOCK}|\"\"\"[\s\S]*?\"\"\"|{_DQ}|'(?:[^'\\\n]|\\[^\n]{{1,6}}?)'"),
    "go": re.compile(rf"{_LINE}|{_BLOCK}|`[^`]*`|{_DQ}|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'"),
    "rs": re.compile(rf"{_LINE}|/\*|[bc]?r(#*)\"[\s\S]*?\"\1|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'"),
}
LEXERS["ts"] = LEXERS["js"]

_JS_KEYWORD = r"(?!(?:if|for|while|switch|catch|function|return|with|await|typeof|new|super|else|do|throw|yield|case|delete|void|import|constructor_)\b)"
DECLARED = {
    "py": re.compile(r"(?m)^[ \t]*+(?:async[ \t]++)?def[ \t]++((?!\d)\w++)"),
    "rs": re.compile(r"\bfn\s++((?:r#)?(?!\d)\w++)"),
    "go": re.compile(r"(?m)^func\s++(?:\([^)]*+\)\s*+)?((?!\d)\w++)"),
    "js": re.compile(
        rf"\bfunction\s*+\*?\s*+((?!\d)[\w$]++)\s*+[<(]|\b(?:const|let|var)\s++((?!\d)[\w$]++)\s*+(?::[^=;]++)?=\s*+(?=async\b|\(|<|(?!\d)[\w$]++\s*+=>|function\b)|"
        rf"(?m:^[ \t]*+)(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract|export|default)\s++)*+(?:\*\s*+)?{_JS_KEYWORD}(#?(?!\d)[\w$]++)\s*+(?:=\s*+(?=async\b|\(|(?!\d)[\w$]++\s*+=>)|(?=[(<]))"
    ),
    "java": re.compile(
        r"(?<![\w.])(?!(?:return|new|throw|else|case|assert|import|package|yield|instanceof|extends|implements|class)\b)"
        r"(?:(?!\d)\w++(?:\s*+\.\s*+\w++)*+(?:\s*+<(?:[^<>;{}()]|<(?:[^<>;{}()]|<[^<>;{}()]*>)*>)*+>)?(?:\s*+\[\s*+\])*+)\s++(?!(?:if|for|while|switch|catch|synchronized|new|return|try|super|this)\b)((?!\d)\w++)\s*+(?=\()"
    ),
}
DECLARED["ts"] = DECLARED["js"]
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[()\[\]{}]")
_BLANK, _SPACES, _NEXT_LINE = re.compile(r"[ \t]*"), re.compile(r"\s*"), re.compile(r"\n([ \t]*)(?=[^\s])")
_OPENING, _INDEX = re.compile(r"\s*(?:\[)?"), re.compile(r"[^:\n]*?(?:\[[^\]]*\][^:\n]*?)*:")
_LITERAL, _AFTER = re.compile(r"([A-Za-z]*)(\"\"\"|'''|\"|')"), re.compile(r"[ \t]*(?:;|#|\n|$)")
_NAME = re.compile(r"[^\W\d]*[\w$]+\s*")
_VALUE, _ARROW = re.compile(r"\s*(?:async\b\s*)?(function\b[^(]*)?"), re.compile(r"\s*(?::[^=;]*?(?:=>[^=;]*?)?)?=>\s*")
_HEAD = {
    "ts": re.compile(r"\s*(?::\s*(?:[^{};=]|\{[^{}]*\}(?=\s*[{|&\[]))*?)?(\{|;|\n)"),
    "js": re.compile(r"\s*(\{)"),
    "java": re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s@]+?)?\s*(?:default\b[^;]*)?([{;])"),
    "rs": re.compile(r"[{;]"),
    "go": re.compile(r"\{|\n"),
}


def blanked(text: str, ext: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with strings and comments blanked out, lengths and line ends kept; and where those were."""
    spans, out, at = [], [], 0
    while m := LEXERS[ext].search(text, at):
        a, b = m.span()
        piece = m.group()
        if piece == "`":
            b = template_end(text, a)
        elif piece == "/*":
            b = comment_end(text, a)
        b = len(text) if b < 0 else b
        piece = text[a:b]
        spans.append((a, b))
        out.append(text[at:a])
        out.append(re.sub(r"[^\n]", " ", piece) if "\n" in piece else " " * (b - a))
        at = b
    out.append(text[at:])
    return "".join(out), spans


@lru_cache(maxsize=2)
def _closed(code: str) -> dict[int, int]:
    """Position of each bracket that is closed -> position behind its partner; a wrong partner closes none that are open."""
    out, stack = {}, []
    for m in _BRACKET.finditer(code):
        c = m.group()
        if c in _PAIRS:
            stack.append((_PAIRS[c], m.start()))
        elif stack and stack[-1][0] == c:
            out[stack.pop()[1]] = m.end()
        else:
            stack.clear()
    return out


@lru_cache(maxsize=2)
def _opened(code: str) -> dict[int, int]:
    """Position behind each bracket that closes one -> position of that one."""
    return {b: a for a, b in _closed(code).items()}


def closing(code: str, at: int) -> int:
    """Position behind the bracket that closes the one at ``at``, or -1."""
    return _closed(code).get(at, -1)


def _words_of(name: str) -> set[str]:
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+", name)]
    return {w + e for w in words for e in ("", "s", "es", "ed", "d", "ing")} | {name.lower()}


_MARK = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|WIP|To-do)\b", re.I)
_TAG = re.compile(r"^(?:[@\\][A-Za-z]+|:[A-Za-z]+[^:\n]*:)")
_SECTION = re.compile(
    r"^(?:#+\s+\S.*|(?:Args?|Arguments|Params?|Parameters|Keyword Arg(?:ument)?s|Returns?|Yields?|Raises|Throws|Errors|Panics|Safety|Examples?|Notes?|See Also|Attributes|Warnings?|References|Usage|Exceptions)\s*:\s*|"
    r"(?:Parameters|Returns|Yields|Raises|Notes|Examples|See Also|Attributes|References))$",
    re.I,
)
_PARAMETER = re.compile(r"^(?:[*\-+]\s+)?(?:`[^`]+`|\*{0,2}[A-Za-z_]\w*(?:\s*\([^)]*\))?)\s*(?::|--?|–|—)\s+\S|^[A-Za-z_]\w*\s+:\s")


def described(lines: list[str], name: str) -> list[str]:
    """The words of description that count."""
    own, out = _words_of(name), []
    section: tuple[int, bool] | None = None  # indent of the heading, whether only indented lines belong to it
    tag = -1
    for line in lines:
        s = line.strip()
        if not s:
            continue
        indent = len(line) - len(line.lstrip())
        if _SECTION.match(s):
            section, tag = (indent, s.endswith(":")), -1
            continue
        if re.fullmatch(r"[-=~*_.#]{2,}", s):
            continue
        if section is not None:
            if section[1] and indent <= section[0] and not _PARAMETER.match(s):
                section = None
            else:
                continue
        if _TAG.match(s):
            tag = indent
            continue
        if tag >= 0 and indent > tag:
            continue
        tag = -1
        if re.match(r"^[*\-+]\s+`[^`]+`\s*(?::|-|–|—)", s):
            continue
        s = _MARK.sub(" ", s)
        for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\w*_\w+", s):
            w = w.lower()
            if w not in own:
                out.append(w)
    return out


def _block_lines(comment: str) -> list[str]:
    body = comment[3:-2] if comment.startswith("/**") else comment[2:-2]
    return [re.sub(r"^\s*\*(?!\*)\s?", "", x) if re.match(r"^\s*\*", x) else x for x in body.split("\n")]


def functions(text: str, ext: str) -> list[tuple[int, str, str, str]]:
    """(line of the name from 1, name, documentation or '', code) of each named function or method."""
    code, spans = blanked(text, ext)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line_of = lambda p: bisect_right(starts, p) - 1
    by_end = {line_of(b - 1): (a, b) for a, b in spans} if ext != "py" else {}
    opens = {a: b for a, b in spans} if ext == "py" else {}
    end_of = lambda i: starts[i + 1] - 1 if i + 1 < len(starts) else len(text)
    out = []
    for m in DECLARED[ext].finditer(code):
        g = m.lastindex or 1
        name, at = m.group(g), m.start(g)
        if ext == "py":
            found = _python(text, code, opens, m.end())
            if found:
                out.append((line_of(at) + 1, name, found[0], text[m.start() : found[1]].strip("\n")))
            continue
        stop = _body(code, m, g, ext)
        if stop < 0:
            continue
        line = line_of(at)
        doc = "" if out and out[-1][0] == line + 1 else _before(text, code, by_end, starts, end_of, line, ext)
        out.append((line + 1, name, doc, text[starts[line] : stop]))
    return out


def _python(text: str, code: str, opens: dict[int, int], at: int) -> tuple[str, int] | None:
    m = _OPENING.match(code, at)
    p = m.end()
    if code[p - 1 : p] == "[":
        p = closing(code, p - 1)
    p = code.find("(", at) if p >= 0 else -1
    p = closing(code, p) if p >= 0 else -1
    if p < 0:
        return None
    colon = _INDEX.match(code, p)
    if not colon:
        return None
    p = colon.end()
    line = text.rfind("\n", 0, at) + 1
    indent = len(_BLANK.match(text, line).group().expandtabs())
    doc, q = "", p
    while True:  # blanks, line ends and comments come before the first statement
        q = _SPACES.match(text, q).end()
        if text[q : q + 1] == "#":
            q = opens.get(q, len(text))
            continue
        break
    if q in opens:
        raw = text[q : opens[q]]
        s = _LITERAL.match(raw)
        after = _AFTER.match(text, opens[q])
        if s and not set(s.group(1).lower()) & set("bf") and after:
            doc = raw[s.end() : -len(s.group(2))]
    end = len(text)
    for x in _NEXT_LINE.finditer(code, p):  # the body ends at the first line that is not deeper
        if len(x.group(1).expandtabs()) <= indent:
            end = x.start()
            break
    return doc, end


def _body(code: str, m: re.Match, g: int, ext: str) -> int:
    """Where the declaration that begins with the match ends; -1 if it is none."""
    p = m.end(g)
    if ext in ("js", "ts"):
        if g in (2, 3) and code[p:].lstrip()[:1] not in ("(", "<") or g == 2:
            p = code.index("=", p) + 1 if "=" in code[p : m.end() + 1] else -1
            if p < 0:
                return -1
            x = _VALUE.match(code, p)
            p = x.end()
            if code[p : p + 1] == "<":
                p = code.find("(", p)
            if code[p : p + 1] == "(":
                p = closing(code, p)
            else:
                y = _NAME.match(code, p)
                p = y.end() if y else -1
            if p < 0:
                return -1
            if not x.group(1):
                y = _ARROW.match(code, p)
                if not y:
                    return -1
                p = y.end()
            p = code.find("{", p) if x.group(1) else p
            return closing(code, p) if code[p : p + 1] == "{" else (code.find("\n", p) if "\n" in code[p:] else len(code))
        p = code.find("(", p)
        p = closing(code, p) if p >= 0 else -1
        if p < 0:
            return -1
        y = _HEAD[ext].match(code, p)
        if not y or (y.group(1) != "{" and g != 1 and not re.search(r"\babstract\b", m.group())):
            return -1
        return closing(code, y.start(1)) if y.group(1) == "{" else y.end()
    if ext == "java":
        p = closing(code, code.index("(", p))
        y = _HEAD[ext].match(code, p) if p >= 0 else None
        if not y:
            return -1
        return closing(code, y.start(1)) if y.group(1) == "{" else y.end()
    opening = code.find("(", p)
    y = _HEAD[ext].search(code, max(p, closing(code, opening)) if opening >= 0 else p)
    if not y:
        return -1
    return closing(code, y.start()) if y.group() == "{" else y.end()


def _before(text: str, code: str, by_end: dict, starts: list[int], end_of, line: int, ext: str) -> str:
    """The documentation right before the declaration on a line."""
    doc: list[str] = []
    i = line - 1
    # a comment on the declaration's own line, before it
    own = [s for s in (by_end.get(line),) if s and s[0] < starts[line] + len(code[starts[line] : end_of(line)]) - len(code[starts[line] : end_of(line)].lstrip())]
    if own and text[own[0][0] : own[0][0] + 3] == "/**" and ext != "go":
        return "\n".join(_block_lines(text[own[0][0] : own[0][1]]))
    while i >= 0:
        bare = code[starts[i] : end_of(i)].strip()
        span = by_end.get(i)
        if not bare and span is not None:
            c = text[span[0] : span[1]]
            head = code[starts[i] : span[0]] if span[0] > starts[i] else ""
            if head.strip():
                break
            if ext == "go":
                if c.startswith("//"):
                    if not re.match(r"//(?:go:|line |export |extern )", c):
                        doc.append(c[2:][1:] if c[2:3] == " " else c[2:])
                    i -= 1
                    continue
                if not doc:
                    doc = _block_lines(c)[::-1]
                break
            if ext == "rs":
                if c.startswith("///") and not c.startswith("////"):
                    doc.append(c[3:])
                    i -= 1
                    continue
                if c.startswith("/**") and not c.startswith("/***") and len(c) > 4:
                    doc += _block_lines(c)[::-1]
                    i = bisect_right(starts, span[0]) - 2
                    continue
                if c.startswith("//") and not c.startswith("//!"):
                    i -= 1
                    continue
                break
            if c.startswith("/**") and not c.startswith("/***") and len(c) > 4:
                doc = _block_lines(c)[::-1]
            break
        if not bare:
            break
        if ext != "go" and (bare.startswith("@") or (ext == "rs" and bare.startswith("#["))):
            i -= 1
            continue
        if ext != "go" and re.fullmatch(r"[)\]}]+", bare):  # the end of an annotation or attribute over several lines
            k = bisect_right(starts, _opened(code).get(starts[i] + len(code[starts[i] : end_of(i)].rstrip()), -1)) - 1
            if k >= 0 and re.match(r"\s*(?:@|#\[)", code[starts[k] : end_of(k)]):
                i = k - 1
                continue
        break
    return "\n".join(doc[::-1])


SCHEMA = "codebase_id string, file_path string, line_no long, name string, documentation string, code string"


def pairs(chunks: DataFrame) -> DataFrame:
    """One row per function with documentation worth the name, in files their grammar accepts."""

    def run(batches):
        for b in batches:
            c = b.to_pydict()
            rows = [[] for _ in range(6)]
            for cb, path, s, t in zip(c["codebase_id"], c["file_path"], c["starts"], c["parts"], strict=True):
                text = assemble(s, t)
                ext = path.rsplit(".", 1)[-1].lower()
                kept = [f for f in functions(text, ext) if f[2] and len(described(f[2].split("\n"), f[1])) >= LEAST_WORDS]
                if kept and valid(text, LANGUAGE_OF[ext]):
                    for line, name, doc, code in kept:
                        for column, v in zip(rows, (cb, path, line, name, doc, code), strict=True):
                            column.append(v)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["codebase_id", "file_path", "line_no", "name", "documentation", "code"])

    files = newest_files(chunks.filter(F.col("file_path").rlike(rf"(?i)\.({'|'.join(EXTENSIONS)})$")))
    return files.select("codebase_id", "file_path", "starts", "parts").mapInArrow(run, SCHEMA)


def found(chunks: DataFrame) -> DataFrame:
    return pairs(chunks).select("codebase_id", "file_path", "line_no").distinct()
