"""Ends of comments and template literals that can hold others of their kind, to any depth."""

from __future__ import annotations

import re

_COMMENT = re.compile(r"/\*|\*/")
_IN_TEXT = re.compile(r"\\[\s\S]|`|\$\{")
_IN_CODE = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|[`{}]")
_DEEP_COMMENT = re.compile(r"/\*(?:[^*]|\*(?!/))*?/\*")
_RUST = re.compile(r"//[^\n]*|/\*|[bc]?r(#+)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'")
_SCRIPT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|`|(?:return|typeof|case|in|of|=>|[(,=:\[!&|?{};+<>*%~^-])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/")


def comment_end(text: str, at: int) -> int:
    """Behind the comment that begins at ``at``, whose inner comments are closed too; -1 if it is not closed."""
    depth = 0
    for m in _COMMENT.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


def template_end(text: str, at: int) -> int:
    """Behind the template literal that begins at ``at``, with the expressions and templates inside it; -1 if it is not closed."""
    open_braces, p = [0], at + 1  # 0 is the text of a template, more are braces of an expression inside one
    while True:
        inside = open_braces[-1] > 0
        m = (_IN_CODE if inside else _IN_TEXT).search(text, p)
        if not m:
            return -1
        p, c = m.end(), m.group()
        if c == "`":
            if inside:
                open_braces.append(0)
            else:
                open_braces.pop()
                if not open_braces:
                    return p
        elif c == "${" and not inside:
            open_braces.append(1)
        elif inside and c in "{}":
            open_braces[-1] += 1 if c == "{" else -1
            if not open_braces[-1]:
                open_braces.pop()


def flat_rust(text: str) -> str:
    """The same tokens, with comments that hold comments blanked, and raw strings of many signs made short."""
    if not _DEEP_COMMENT.search(text) and '###"' not in text:
        return text
    out, at = [], 0
    while m := _RUST.search(text, at):
        end = comment_end(text, m.start()) if m.group() == "/*" else m.end()
        if end < 0:
            return "".join([*out, text[at : m.start()], "`"])  # a sign that the language does not have
        if m.group() == "/*":
            out += [text[at : m.start()], " ", "\n" * text.count("\n", m.start(), end)]
        elif m.group(1):
            out += [text[at : m.start()], '""']
        else:
            out.append(text[at:end])
        at = end
    return "".join([*out, text[at:]])


def flat_script(text: str) -> str:
    """The same tokens, with template literals that hold expressions made plain ones."""
    out, at = [], 0
    while m := _SCRIPT.search(text, at):
        end = template_end(text, m.start()) if m.group() == "`" else m.end()
        if end < 0:
            return "".join([*out, text[at : m.start()], "`"])  # not closed: no token
        out += [text[at : m.start()], "``"] if m.group() == "`" else [text[at:end]]
        at = end
    return "".join([*out, text[at:]])
