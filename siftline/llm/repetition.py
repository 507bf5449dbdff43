"""Repetition within a document, by cleaning line by line.

Each line is judged by itself: by its punctuation, as navigation, as boilerplate, as a repeat of an
earlier line, and by how many of its words lie in a run of eight words that already occurred.
Failing lines lose all their words, the others those that are repeated; a document that loses too much text is rejected.
The repeated words of the lines add up to the document's repeated share, so the share is exact, and as none of
them is kept, every document that repeats heavily is among the rejected.

Defined results: null and empty text has no words, share 0 and is kept; a null id is passed through;
CRLF counts as a line end; repeated rows give repeated rows from ``measure`` and one from ``found``;
texts are used whole, however long; extra columns are dropped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import spread

RUN, LEAST_WORDS, HEAVY, LINE_HEAVY, MOST_LOST = 8, 40, 0.3, 0.5, 0.3

WORD = re.compile(r"[^\W_]+")
_NAVIGATION = re.compile(r"^\W*(?:home|next|previous|prev|back to top|menu|skip to (?:main )?content|table of contents|read more|sign in|log ?in|sign up|share|search|contact(?: us)?|about(?: us)?)(?:\W+(?:home|next|previous|prev|menu|share|search|contact|about|login|\d+))*\W*$", re.I)
_BOILERPLATE = re.compile(r"\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|javascript is (?:disabled|required)|enable javascript|lorem ipsum|powered by \w+)\b|©", re.I)
_PUNCTUATION = re.compile(r"[^\w\s]")
_multiplier = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def repeated(ids: np.ndarray) -> np.ndarray:
    """For each word, whether it lies in a run of eight that occurred before, from an earlier word."""
    n = len(ids) - RUN + 1
    out = np.zeros(len(ids), dtype=bool)
    if n < 2:
        return out
    h = np.zeros(n, dtype=np.uint64)
    for i in range(RUN):
        h = h * _multiplier + ids[i : i + n]
        h ^= h >> np.uint64(31)
    _, first = np.unique(h, return_index=True)
    again = np.ones(n, dtype=bool)
    again[first] = False
    if again.any():
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        at = np.flatnonzero(again)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + RUN, -1)
        out = np.cumsum(edge[:-1]) > 0
    return out


def judge(text: str | None) -> dict:
    """Words, repeated words, share, lines removed by rule, share of words lost, and whether the document is rejected."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    by_line = [words(x) for x in lines]
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for ws in by_line for w in ws], dtype=np.uint64)
    marked = repeated(ids)
    at, lost, total, heavy = 0, 0, len(ids), 0
    removed = {"punctuation": 0, "navigation": 0, "boilerplate": 0, "repeated": 0}
    seen: set[tuple] = set()
    for line, ws in zip(lines, by_line, strict=True):
        k = int(marked[at : at + len(ws)].sum())
        heavy += k
        at += len(ws)
        if not line.strip():
            continue
        key = tuple(ws)
        if ws and len(_PUNCTUATION.findall(line)) > 2 * sum(map(len, ws)) or not ws:
            why = "punctuation"
        elif _NAVIGATION.match(line):
            why = "navigation"
        elif _BOILERPLATE.search(line):
            why = "boilerplate"
        elif (len(ws) >= RUN and key in seen) or k >= LINE_HEAVY * len(ws) > 0:
            why = "repeated"
        else:
            seen.add(key)
            lost += k
            continue
        seen.add(key)
        removed[why] += 1
        lost += len(ws)
    share = heavy / total if total else 0.0
    lost_share = lost / total if total else 0.0
    return {"n_words": total, "repeated_words": heavy, "share": share, **{f"removed_{k}": v for k, v in removed.items()}, "lost_share": lost_share, "rejected": total >= LEAST_WORDS and 10 * lost >= round(10 * MOST_LOST) * total}


_KINDS = [("n_words", pa.int64()), ("repeated_words", pa.int64()), ("share", pa.float64()), ("removed_punctuation", pa.int64()), ("removed_navigation", pa.int64()), ("removed_boilerplate", pa.int64()), ("removed_repeated", pa.int64()), ("lost_share", pa.float64()), ("rejected", pa.bool_())]
SCHEMA = "doc_id long, n_words long, repeated_words long, share double, removed_punctuation long, removed_navigation long, removed_boilerplate long, removed_repeated long, lost_share double, rejected boolean"


def measure(documents: DataFrame) -> DataFrame:
    """One row per document."""

    def run(batches):
        for b in batches:
            rows = [judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in _KINDS)], names=["doc_id", *(k for k, _ in _KINDS)])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, SCHEMA)


def found(documents: DataFrame) -> DataFrame:
    """doc_id of rejected documents of at least 40 words with 30 % or more of them repeated."""
    # words and share are whole numbers at heart: compare them as such
    return measure(documents).filter(f"rejected and n_words >= {LEAST_WORDS} and repeated_words * 10 >= n_words * {round(HEAVY * 10)}").select("doc_id").distinct()
