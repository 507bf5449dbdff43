"""Imports, signatures, documentation, context and types of a chunk, as expressions over its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import lines_of


def _trimmed(content: Column) -> Column:
    return F.transform(lines_of(F.coalesce(content, F.lit(""))), lambda x: F.trim(x))


def _pick(lines: Column, pattern: str, group: int = 1, also: Column | None = None) -> Column:
    found = F.filter(lines, lambda x: x.rlike(pattern) if also is None else x.rlike(pattern))
    return F.transform(found, lambda x: F.regexp_extract(x, pattern, group))


def _none() -> Column:
    return F.array().cast("array<string>")


def _by_language(language: Column, cases: dict[tuple[str, ...], Column], otherwise: Column) -> Column:
    out = None
    for names, value in cases.items():
        out = F.when(language.isin(list(names)), value) if out is None else out.when(language.isin(list(names)), value)
    return out.otherwise(otherwise)


SCRIPTS = ("javascript", "typescript")


def imports(content: Column, language: Column) -> Column:
    """Sorted distinct imports.

    Rust: plain paths of other crates and extern crates; Python: modules; scripts: module names; Go: packages, single
    or in a block; Java: names; others: include and require lines.
    """
    x = _trimmed(content)
    rust = F.concat(_pick(x, r"^use ((?!crate::|super::|self::)[^;{]*::[^;{]*);"), F.transform(_pick(x, r"^extern crate ([^;]+);"), lambda s: F.concat(F.lit("extern crate "), s)))
    python = F.concat(_pick(x, r"^import (.+?)(?: as .*)?$"), F.transform(_pick(x, r"^from (\S+) import"), lambda s: F.concat(F.lit("from "), s, F.lit(" import ..."))))
    script = F.concat(_pick(x, r"""^import .*from ['"]([^'"]+)['"]"""), _pick(x, r"""^(?:const|let|var) .*require\(['"]([^'"]+)['"]\)"""))
    block = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?s)\bimport \((.*?)\)"), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1))))
    go = F.concat(_pick(x, r'^import (?:[\w.]+ )?"([^"]+)"'), block)
    java = _pick(x, r"^import (?:static )?([^;]+);")
    other = F.filter(x, lambda s: s.rlike(r"^(?:#include|require|include)"))
    return F.array_sort(F.array_distinct(_by_language(language, {("rust",): rust, ("python",): python, SCRIPTS: script, ("go",): go, ("java",): java}, other)))


def signatures(content: Column, language: Column) -> Column:
    """First lines of functions, in order, repeats kept."""
    x = _trimmed(content)
    rust = _pick(x, r"^((?:pub )?(?:async )?fn [^{]*?)\s*(?:\{.*)?$")
    python = _pick(x, r"^((?:async )?def [^:]*)")
    script = F.transform(
        F.filter(F.concat(_pick(x, r"^(?:export )?(?:default )?(?:async )?function\*? (\w+)\s*\("), _pick(x, r"^(?:export )?(?:const|let|var) (\w+)\s*=\s*(?:async )?(?:\(|\w+\s*=>|function)")), lambda s: s != ""),
        lambda s: F.concat(s, F.lit("(...)")),
    )
    go = _pick(x, r"^(func [^{]*?)\s*(?:\{.*)?$")
    java = F.transform(F.filter(x, lambda s: s.rlike(r"^(?:(?:public|private|protected|static|final|abstract|synchronized) )*(?!return |new |throw |else )[\w<>\[\], .?]+ \w+\([^;]*$")), lambda s: F.concat(F.regexp_extract(s, r"^(.*?\w+)\(", 1), F.lit("(...)")))
    return _by_language(language, {("rust",): rust, ("python",): python, SCRIPTS: script, ("go",): go, ("java",): java}, _none())


def doc_comments(content: Column, language: Column) -> Column:
    """Documentation: runs of Rust's line comments joined by blanks, Python's docstrings, block comments of scripts and Java, Go's comments before functions."""
    c = F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n", "\n")
    tidy = lambda a, pattern: F.filter(F.transform(a, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, pattern, " "), r"\s+", " "))), lambda s: s != "")
    rust = tidy(F.regexp_extract_all(c, F.lit(r"(?m)((?:^[ \t]*///(?!/)[^\n]*\n?)+)"), F.lit(1)), r"(?m)^[ \t]*///")
    python = tidy(F.regexp_extract_all(c, F.lit(r'(?m)^[ \t]*[rRuU]?"""((?:[^"\\]|\\.|"(?!""))*)"""'), F.lit(1)), r"\n")
    block = tidy(F.regexp_extract_all(c, F.lit(r"/\*\*(?!/)((?:[^*]|\*(?!/))*)\*/"), F.lit(1)), r"(?m)^[ \t]*\*+")
    go = tidy(F.regexp_extract_all(c, F.lit(r"(?m)((?:^//[^\n]*\n)+)(?=func )"), F.lit(1)), r"(?m)^//")
    return _by_language(language, {("rust",): rust, ("python",): python, (*SCRIPTS, "java"): block, ("go",): go}, _none())


def context(content: Column, language: Column) -> Column:
    """Enclosing definitions: modules, structs and enums; classes."""
    x = _trimmed(content)
    rust = _pick(x, r"^(?:pub(?:\([^)]*\))? )?((?:mod|struct|enum) \w+)")
    python = _pick(x, r"^(class \w+)")
    script = _pick(x, r"^(?:export )?(?:default )?(?:abstract )?(class \w+)")
    java = _pick(x, r"^(?:(?:public|private|protected|static|final|abstract) )*((?:class|interface|enum|record) \w+)")
    return _by_language(language, {("rust",): rust, ("python",): python, SCRIPTS: script, ("java",): java}, _none())


def types(content: Column, language: Column) -> Column:
    x = _trimmed(content)
    rust = _pick(x, r"^(?:pub(?:\([^)]*\))? )?type (\w+)")
    script = _pick(x, r"^(?:export )?(?:declare )?(?:interface|type) (\w+)")
    return _by_language(language, {("rust",): rust, ("typescript",): script}, _none())


def enriched(content: Column, language: Column) -> Column:
    """All of these as one struct; exports are signatures and classes."""
    s, k = signatures(content, language), context(content, language)
    return F.struct(
        imports(content, language).alias("imports"), s.alias("function_signatures"), F.concat(s, F.filter(k, lambda x: x.startswith("class "))).alias("exports"),
        k.alias("context"), types(content, language).alias("types"), doc_comments(content, language).alias("doc_comments"),
    )


def rendered(path: Column, language: Column, meta: Column, content: Column) -> Column:
    """The chunk with what is known about it, as text for an embedding."""
    part = lambda title, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{title}: "), F.array_join(a, ", "), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("File: "), path, F.lit("\nLanguage: "), F.coalesce(language, F.lit("unknown")), F.lit("\n"), part("Imports", meta["imports"]), part("Functions", meta["function_signatures"]), part("Docs", meta["doc_comments"]), F.lit("\n"), content)
