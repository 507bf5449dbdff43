"""Evaluation texts inside training text.

The n-grams (n = 6) of the test items, as 64-bit hashes, are looked up in every document; a bitmap of fixed
size drops most others before any shuffle.  Of those that occur, rare ones are seeds: all that at most ``FEW``
documents or one in ``RARE`` has, and in any case the ``PER_WINDOW`` rarest of each window of fifteen words, rarity
counted over all documents.  Seeds join documents to items; each pair is aligned by Smith-Waterman over
words around what they share, which scores edited copies and, on its diagonals, finds the longest
run of equal words.  As each window whose n-grams occur has a seed, no copy of fifteen words is missed.

An alignment with a positive score spans at most three times the item's words, so aligning that far
around the shared n-grams gives the same scores as the whole document for every alignment through one of them.

Defined results: null or empty texts, and items under fifteen words, leak nothing by copy; repeated
documents or items give one row per pair of ids; ties in rarity go to the earlier n-gram; whole texts
are used; an empty table on either side gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.repetition import words
from siftline.session import kept, spread

N, WINDOW, PER_WINDOW, RARE, FEW = 6, 15, 3, 1000, 100
SIEVE_BITS, SALTS = 26, 16  # 8 MB of bits at any size of the test set
MATCH, MISMATCH, GAP, LEAKED_SHARE = 2, -1, -1, 0.6

_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(N)], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def grams(ws: list[str], known: dict[str, int]) -> np.ndarray:
    """The hash of the n-gram that begins at each word, as int64."""
    n = len(ws) - N + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h, out = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)), np.zeros(n, np.uint64)
    for i, p in enumerate(_POWERS):
        out += h[i : i + n] * p
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def align(docs: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of word numbers from 0: the longest run of equal words, and the best Smith-Waterman score.

    All pairs go forward together, one item word at a time; -1 in a document is no word of the item.
    """
    n, m, steps = len(docs), max(map(len, items)), max(map(len, docs))
    doc, item = np.full((n, steps), -2, np.int32), np.full((n, m), -3, np.int32)
    for i, (x, y) in enumerate(zip(docs, items, strict=True)):
        doc[i, : len(x)], item[i, : len(y)] = x, y
    best, runs = np.zeros((n, steps + 1), np.int32), np.zeros((n, steps + 1), np.int32)
    score, longest = np.zeros_like(best), np.zeros_like(runs)
    along = np.arange(steps + 1, dtype=np.int32) * np.int32(-GAP)
    for j in range(m):
        same = doc == item[:, j : j + 1]
        runs[:, 1:] = (runs[:, :-1] + np.int32(1)) * same
        row = np.zeros_like(score)
        row[:, 1:] = np.maximum(score[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), score[:, 1:] + np.int32(GAP))
        np.maximum(row, 0, out=row)
        row += along  # gaps along the row
        score = np.maximum.accumulate(row, axis=1) - along
        np.maximum(longest, runs, out=longest)
        np.maximum(best, score, out=best)
    return longest.max(axis=1), best.max(axis=1)


def stretches(doc: list[str], item: list[str], doc_grams: np.ndarray, item_grams: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs to align: the document around n-grams that both have, and the item, as word numbers.

    A stretch is left out unless it has enough of the item's words for a share of LEAKED_SHARE, or enough
    shared n-grams in a row for a run of WINDOW.
    """
    at = np.flatnonzero(np.isin(doc_grams, item_grams))
    known: dict[str, int] = {}
    b = np.array([known.setdefault(w, len(known)) for w in item], dtype=np.int32)
    held = np.bincount(b, minlength=len(known))
    reach = (1 + MATCH // -GAP) * len(item)  # matches pay for that many gaps
    out = []
    while len(at):
        end = at[0] + reach
        i = 1
        while i < len(at) and at[i] - reach <= end:  # what overlaps is one stretch
            end = at[i] + reach
            i += 1
        a = np.array([known.get(w, -1) for w in doc[max(0, at[0] - reach) : end + N]], dtype=np.int32)
        matches = int(np.minimum(held, np.bincount(a[a >= 0], minlength=len(known))).sum())
        in_row = np.diff(np.flatnonzero(np.r_[True, np.diff(at[:i]) != 1, True])).max()
        if matches >= LEAKED_SHARE * len(item) or in_row >= WINDOW - N + 1:
            out.append((a, b))
        at = at[i:]
    return out


def _texts(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias(key), "text").filter(f"{key} is not null and text is not null")


def item_grams(tests: DataFrame) -> DataFrame:
    """(item_id, copy, at, gram) of every n-gram of the items; texts given under one id are told apart by ``copy``."""

    def run(batches):
        known = _Hashes()
        for b in batches:
            found = [(k, xxhash.xxh64_intdigest(t) - 2**63, grams(words(t), known)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            n = [len(g) for *_, g in found]
            cols = [np.repeat([k for k, *_ in found], n), np.repeat([c for _, c, _ in found], n), np.concatenate([np.arange(x) for x in n] or [[]]), np.concatenate([g for *_, g in found] or [[]])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["item_id", "copy", "at", "gram"])

    return tests.mapInArrow(run, "item_id long, copy long, at long, gram long")


def hits(docs: DataFrame, of_items: DataFrame) -> DataFrame:
    """(doc_id, gram), distinct, of the documents' n-grams that some item has."""
    place = F.shiftrightunsigned("gram", 64 - SIEVE_BITS)
    bits = of_items.select((place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(gram, {64 - SIEVE_BITS}), 64) as int))").alias("bit"))
    held = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # at most 2**20 rows, whatever the items
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    sieve[[r.word for r in held]] = [r.bits for r in held]
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches):
        known, bits = _Hashes(), sent.value.view(np.uint64)
        for b in batches:
            ids, found = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = grams(words(t), known)
                p = g.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
                g = np.unique(g[(bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0])
                ids.append(np.full(len(g), k, np.int64))
                found.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in (ids, found)], names=["doc_id", "gram"])

    return spread(docs).mapInArrow(run, "doc_id long, gram long").join(of_items.select("gram").distinct(), "gram", "left_semi").distinct()


def seeds(of_items: DataFrame, count: DataFrame, n_docs: int) -> DataFrame:
    """(item_id, gram): the n-grams that join items to documents."""

    def choose(batches):
        for b in batches:
            ids, out = [], []
            for k, at, gram, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                best = {g for g, x in zip(gram, n, strict=True) if x <= FEW or x * RARE <= n_docs}
                span = WINDOW - N + 1
                first = {p: i for i, p in reversed(list(enumerate(at)))}
                for p in range(max(1, (at[-1] if at else 0) - span + 2)):  # windows by their first n-gram
                    inside = [first[q] for q in range(p, p + span) if q in first]
                    best.update(gram[i] for i in sorted(inside, key=lambda i: (n[i], at[i]))[:PER_WINDOW])
                ids += [k] * len(best)
                out += best
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=["item_id", "gram"])

    one = of_items.join(count, "gram").groupBy("item_id", "copy").agg(F.array_sort(F.collect_list(F.struct("at", "gram", "n"))).alias("g"))
    return one.select("item_id", F.col("g.at"), F.col("g.gram"), F.col("g.n")).mapInArrow(choose, "item_id long, gram long").distinct()


_OUT = "doc_id long, item_id long, longest_run int, score int, share double"
_NAMES = ["doc_id", "item_id", "longest_run", "score", "share"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]


def pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item that share a seed and words enough for a leak: longest_run, Smith-Waterman score, and its share of the item's best."""
    docs, tests = _texts(documents, "doc_id"), _texts(items, "item_id").distinct()
    of_items = kept(item_grams(tests))
    found = kept(hits(docs, of_items))
    count = found.groupBy("gram").agg(F.count("*").alias("n"))
    # a common n-gram is spread over SALTS parts of its documents
    chosen = seeds(of_items, count, documents.count()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = kept(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(chosen, ["gram", "salt"]).select("doc_id", "item_id").distinct())
    texts = docs.join(both, "doc_id").select("doc_id", F.col("text").alias("doc_text"), "item_id").join(tests.withColumnRenamed("text", "item_text"), "item_id")

    def run(batches):
        known = _Hashes()
        last: tuple = (None,)
        for b in batches:
            todo = []
            for d, i, x, y in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if last[0] != x:  # the pairs of a document mostly come one after the other
                    ws = words(x)
                    last = (x, ws, grams(ws, known))
                item = words(y)
                todo += [(d, i, *pair) for pair in stretches(last[1], item, last[2], grams(item, known))]
            todo.sort(key=lambda t: (len(t[3]), len(t[2])))
            rows, at = [], 0
            while at < len(todo):
                end = at + max(1, min(64, 60_000 // max(1, len(todo[at][2]))))
                some = todo[at:end]
                run_lengths, scores = align([t[2] for t in some], [t[3] for t in some])
                rows += [(d, i, int(x), int(y), int(y) / (MATCH * len(b))) for (d, i, _, b), x, y in zip(some, run_lengths, scores, strict=True)]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)

    # few bytes but much work: as many tasks as a shuffle has
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = texts.select("doc_id", "item_id", "doc_text", "item_text").repartition(tasks, "doc_id").mapInArrow(run, _OUT)
    return scored.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in _NAMES[2:]))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of which the document copies fifteen words, or aligns with most of the item."""
    return pairs(documents, items).filter(f"longest_run >= {WINDOW} or share >= {LEAKED_SHARE}").withColumn("copied", F.col("longest_run") >= WINDOW)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with an alignment that holds fifteen equal words in a row."""
    return pairs(documents, items).filter(f"score >= {MATCH * WINDOW} and longest_run >= {WINDOW}").select("doc_id", "item_id")
