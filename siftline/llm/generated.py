"""Files nobody wrote by hand: generated, minified, vendored, or data saved as code.

One pass over the files takes, for each, what its path and first comments say, how its tokens
look (share of literals, blanks and name lengths, repetition of identifier-masked shingles) and
two shingle sets with MinHash bands: of identifier-masked token shingles and of the tokens as they are.
Comments and blanks are no tokens, so patched comments don't matter.  What a file says of itself is
looked for in the comments before its first statement, however long they are.

Then the files are clustered by banding.  Bands and the agreement of the whole signatures give candidates (of pairs
with a similarity of 0.8 the bands miss 2 in 10,000, the signatures 1 in 100,000); only for these are the files read again
and the exact similarity of the whole sets taken (0.8), which decides:

* a family of masked look-alikes within one repository is generated, its members of under 80
  tokens only if they repeat within themselves; one file that is such a family by itself counts too;
* a cluster of the same tokens in three or more repositories is vendored, whatever its paths;
* a cluster, over all repositories, of masked look-alikes that are mostly literals, by count or by
  characters, is data; one file of many literals that repeats within itself counts too.

Masked shingles take twelve tokens, as the masked alphabet is tiny; plain ones take five.
Files with equal token sets are one node before banding, so copies never make pairs; within a bucket each node
is compared with the smallest one, and with all others unless the signatures leave no doubt about that one.
Clusters are the connected components of the verified links.  ``reason`` is the first evidence found, ``cluster``
what the clusters say, whatever the file says of itself.

Defined results: files with other extensions (configuration, Markdown) never count; null content
is an empty file, which is no match for anything; repeated rows count once; null codebases are
one codebase; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.files import assemble, newest_files
from siftline.session import forget, kept

CODE = ("py", "rs", "js", "ts", "go", "java")
MASKED, PLAIN, ROWS, BANDS = 12, 5, 4, 16
SIMILAR, REPOSITORIES, FAMILY, HOT, LEAST, TELLING, BULK = 0.8, 3, 3, 1000, 30, 80, 1000
# Of 64 values of two signatures: at a similarity of 0.8 fewer than AGREE agree once in 100,000 pairs, SURE or more twice in 1,000.
AGREE, SURE = 36, 60

_DIRS = r"(?:^|/)(?:%s)/"
VENDOR_PATH = re.compile(_DIRS % r"vendor|vendored|node_modules|bower_components|third[_-]?party|3rd[_-]?party|external|externals|deps|site-packages|Pods")
BUILT_PATH = re.compile(_DIRS % r"gen|generated|__generated__|autogen|dist|build|target|out")
BUILT_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.py|_pb\.[jt]s|\.pb\.go|_grpc_pb\.[jt]s|Grpc\.java|[a-z]_\.java|\.(?:g|gen|generated|autogen|designer)\.\w+|_generated\.\w+|\.gen\.\w+|[.\-]min\.(?:js|css|mjs)|(?:^|/)(?:bundle|vendor~\w+)\.js|\.bundle\.js|\.[0-9a-f]{8,}\.js)$")
MADE = re.compile(
    r"(?im)^[ \t]*(?://[/!]?|#+|/\*[*!]?|\*|--)[ \t]*(?:(?:code |this file (?:is|was) |file )?(?:auto-?)?generated (?:by|from) (?!other|hand)\S|"
    r"[^\n]*(?<![\"'`])@generated\b|<auto-?generated\b|auto-?generated(?:\s*;|\s+(?:file|code)|\s+by)|autogenerated file|"
    r"[^\n]*\bdo not (?:edit|modify|change)\b|[^\n]*\bcreated automatically by\b|machine-(?:made|generated)\b|[^\n]*\boutput of the \S+ compiler|"
    r"automatisch (?:erzeugt|generiert)|généré automatiquement|generado automáticamente)"
)
COPIED = re.compile(
    r"(?im)^[ \t]*(?://[/!]?|#+|/\*[*!]?|\*)[ \t]*(?:vendored from|copied (?:verbatim )?from|SPDX-PackageName:|SPDX-PackageVersion:|imported from https?://|upstream:|[A-Za-z][\w.@/\-]* v?\d+\.\d+\.\d+(?:[ \t]*\|[^\n]*)?[ \t]*(?:\*/)?[ \t]*$)"
)

_KEYWORDS = frozenset(
    "def class return if else elif for while import from const let var function export async await try catch throw new struct impl fn pub use match mut self this static private public "
    "protected final int void package func range defer go type interface switch case default with as raise except in is not and or None null true false True False pass".split()
)
_STRING = r"'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|`(?:[^`\\]|\\[\s\S])*`"
_TRIPLE = r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
_TOKEN = {
    True: re.compile(rf"\s+|#[^\n]*|{_TRIPLE}|{_STRING}|[^\W\d]\w*|\d[\w.]*|[^\s\w]"),
    False: re.compile(rf"\s+|//[^\n]*|/\*[\s\S]*?\*/|{_STRING}|'[^\W\d]\w*|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|[^\s\w]"),
}
_SPACE, _NOTE, _TEXT, _NUMBER, _NAME, _WORD, _SIGN = range(7)


class _Tokens(dict):
    """Token -> its place in the arrays of kinds, lengths, hashes and hashes of masks."""

    def __init__(self, python: bool):
        super().__init__()
        self.python = python
        self._fresh(1 << 16)

    def _fresh(self, room: int) -> None:
        self.kind, self.length = np.zeros(room, np.int8), np.zeros(room, np.int64)
        self.hash, self.mask = np.zeros(room, np.uint64), np.zeros(room, np.uint64)

    def __missing__(self, t: str) -> int:
        at = len(self)
        if at == len(self.kind):
            for name in ("kind", "length", "hash", "mask"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros_like(x)]))
        c = t[0]
        if c.isspace():
            kind, mask = _SPACE, " "
        elif (c == "#" and self.python) or (t.startswith(("//", "/*")) and len(t) > 1):
            kind, mask = _NOTE, " "
        elif c in "\"'`" and len(t) > 1 and t[-1] == c:
            kind, mask = _TEXT, "s"
        elif c.isdigit():
            kind, mask = _NUMBER, "0"
        elif c.isalpha() or c in "_$":
            kind, mask = (_WORD, t) if t in _KEYWORDS else (_NAME, "i")
        else:
            kind, mask = _SIGN, t
        self.kind[at], self.length[at] = kind, len(t)
        self.hash[at], self.mask[at] = xxhash.xxh64_intdigest(t), xxhash.xxh64_intdigest(mask)
        self[t] = at
        return at

    def places(self, found: list[str]) -> np.ndarray:
        if len(self) > 300_000:  # between files, so that no place changes its meaning within one
            self.clear()
            self._fresh(1 << 16)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


_rng = np.random.default_rng(20_240_601)
_MULTIPLY = _rng.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {k: np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(k)], dtype=np.uint64) for k in (MASKED, PLAIN)}


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of all runs of k tokens (of the whole, if shorter)."""
    if len(hashes) < k:
        return np.array([np.uint64(int(hashes.sum(dtype=np.uint64)))] if len(hashes) else [], dtype=np.uint64)
    n = len(hashes) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for i, p in enumerate(_POWERS[k]):
        out += hashes[i : i + n] * p
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minhash(items: np.ndarray) -> np.ndarray:
    """The signature: for each of 64 multipliers the least product, upper half."""
    least = None
    for i in range(0, len(items), 4096):
        m = ((items[i : i + 4096, None] * _MULTIPLY[None, :]) >> np.uint64(32)).min(axis=0)
        least = m if least is None else np.minimum(least, m)
    return least


def bands(signature: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(signature[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) - 2**63 for i in range(BANDS)]


def nibbles(signature: np.ndarray) -> list[int]:
    """The last four bits of each of the 64 values, sixteen to a word."""
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return ((signature & np.uint64(15)).reshape(4, 16) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def tables() -> dict[bool, _Tokens]:
    """Token tables of a task: of Python, and of the languages whose comments look as C's."""
    return {python: _Tokens(python) for python in (True, False)}


def counted(text: str, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens, and of those that are neither blank nor comment."""
    places = tokens.places(_TOKEN[tokens.python].findall(text))
    return places, places[tokens.kind[places] > _NOTE]


def describe(text: str, path: str, known: dict[bool, _Tokens]) -> dict:
    """What one file shows by itself: reason (or None), digests, bands and signatures."""
    tokens = known[path.lower().endswith(".py")]
    places, real = counted(text, tokens)
    plain, masked = tokens.hash[real], tokens.mask[real]
    masks, words = shingles(masked, MASKED), shingles(plain, PLAIN)
    windows = max(1, len(real) - MASKED + 1)
    repeats = 1 - len(masks) / windows if len(real) > MASKED else 0.0

    kinds, lengths = tokens.kind[places], tokens.length[places]
    count, size = np.bincount(kinds, minlength=7), np.bincount(kinds, weights=lengths, minlength=7)
    n_literal, n_name = count[_TEXT] + count[_NUMBER], count[_NAME] + count[_WORD]
    code = max(1, len(text) - size[_TEXT] - size[_NOTE])
    n_held = size[_TEXT] + size[_NUMBER]
    by_count = n_literal >= 16 and n_literal / max(1, n_literal + n_name) >= 0.8
    by_size = n_held >= BULK and n_held >= 0.8 * (len(text) - size[_SPACE] - size[_NOTE])
    start = np.flatnonzero(kinds > _NOTE)
    head = text[: int(lengths[: start[0]].sum())] if len(start) else text  # every character belongs to a token

    reason = None
    if VENDOR_PATH.search(path):
        reason = "vendored path"
    elif BUILT_NAME.search(path):
        reason = "generated name"
    elif BUILT_PATH.search(path):
        reason = "built path"
    elif MADE.search(head):
        reason = "generated note"
    elif COPIED.search(head):
        reason = "vendored note"
    elif by_count and repeats >= 0.5:
        reason = "data"
    elif len(real) >= 60 and count[_NAME] and size[_SPACE] / code < 0.1 and size[_NAME] / count[_NAME] < 4:
        reason = "minified"
    elif len(real) >= 60 and repeats >= 0.62:
        reason = "generated family"
    literal = bool(by_count or by_size)
    clustered = [(len(masks) > 0) and (len(real) >= LEAST or literal), len(real) >= LEAST]
    signatures = [minhash(x) if c else None for x, c in zip((masks, words), clustered, strict=True)]
    return {
        "reason": reason,
        "repeats": repeats,
        "n_tokens": len(real),
        "telling": bool(len(real) >= TELLING or len(real) >= 60 and repeats >= 0.45),
        "literal": literal,
        "plain": _digest(words),
        "masked": _digest(masks),
        "digest": xxhash.xxh64_intdigest(plain.tobytes()) - 2**63,
        "n_masks": len(masks),
        "n_words": len(words),
        **{f"{k}_bands": bands(s) if s is not None else [] for k, s in zip(("masked", "plain"), signatures, strict=True)},
        **{f"{k}_sign": nibbles(s) if s is not None else [] for k, s in zip(("masked", "plain"), signatures, strict=True)},
    }


def _digest(items: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(items.tobytes()) - 2**63


_LONGS = pa.list_(pa.int64())
_KINDS = [
    ("reason", pa.string()), ("n_tokens", pa.int32()), ("telling", pa.bool_()), ("literal", pa.bool_()), ("plain", pa.int64()), ("masked", pa.int64()), ("digest", pa.int64()),
    ("n_masks", pa.int32()), ("n_words", pa.int32()), ("masked_bands", _LONGS), ("plain_bands", _LONGS), ("masked_sign", _LONGS), ("plain_sign", _LONGS),
]
SCHEMA = (
    "codebase_id string, file_path string, reason string, n_tokens int, telling boolean, literal boolean, plain long, masked long, digest long, "
    "n_masks int, n_words int, masked_bands array<long>, plain_bands array<long>, masked_sign array<long>, plain_sign array<long>"
)


def _code(chunks: DataFrame) -> DataFrame:
    cols = [F.coalesce("codebase_id", F.lit("")).alias("codebase_id"), *(F.col(c) for c in ("file_path", "language", "start_line", "content", "modified_at"))]
    return chunks.filter(F.col("file_path").rlike(rf"(?i)\.({'|'.join(CODE)})$")).select(*cols)


def sketches(chunks: DataFrame) -> DataFrame:
    """One row per code file with its own evidence, digests of its shingle sets, and their bands and signatures."""

    def run(batches):
        known = tables()
        for b in batches:
            c = b.to_pydict()
            rows = [describe(assemble(s, t), p, known) for p, s, t in zip(c["file_path"], c["starts"], c["parts"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in _KINDS)], names=["codebase_id", "file_path", *(k for k, _ in _KINDS)])

    return newest_files(_code(chunks)).select("codebase_id", "file_path", "starts", "parts").mapInArrow(run, SCHEMA)


def shingle_sets(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, set, items) of the files in ``wanted`` (codebase_id, file_path, masked, plain), whose columns masked and plain say which sets are needed."""

    def run(batches):
        known = tables()
        for b in batches:
            c = b.to_pydict()
            out: list[tuple] = []
            for path, starts, parts, m, p in zip(c["file_path"], c["starts"], c["parts"], c["masked"], c["plain"], strict=True):
                tokens = known[path.lower().endswith(".py")]
                _, real = counted(assemble(starts, parts), tokens)
                if m is not None:
                    out.append(("m", m, shingles(tokens.mask[real], MASKED).view(np.int64)))
                if p is not None:
                    out.append(("w", p, shingles(tokens.hash[real], PLAIN).view(np.int64)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.int64(), _LONGS), strict=True)], names=["kind", "set", "items"])

    key = ["codebase_id", "file_path"]
    files = newest_files(_code(chunks).join(wanted.select(*key), key, "left_semi")).join(wanted, key)
    return files.select("file_path", "starts", "parts", "masked", "plain").mapInArrow(run, "kind string, set long, items array<long>")


def sets_of(chunks: DataFrame, files: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The wanted sets, each taken from one of the files that have it."""

    def of(needed: DataFrame) -> DataFrame:
        some = lambda k, c: needed.filter(F.col("kind") == k).join(files.groupBy(F.col(c).alias("set")).agg(F.min(F.struct("codebase_id", "file_path")).alias("f")), "set").select("f.*", F.lit(k).alias("kind"), "set")
        one = some("m", "masked").unionByName(some("w", "plain"))
        wanted = one.groupBy("codebase_id", "file_path").agg(*(F.max(F.when(F.col("kind") == k, F.col("set"))).alias(c) for k, c in (("m", "masked"), ("w", "plain"))))
        return shingle_sets(chunks, kept(wanted))

    return of


def _bits(a: Column, b: Column) -> Column:
    """How many of sixteen nibbles differ."""
    x = a.bitwiseXOR(b)
    y = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
    return F.bit_count(y.bitwiseAND(F.lit(0x1111111111111111)))


def _agree(x: str, y: str, least: int) -> Column:
    """Whether two nodes (structs n, sign) have near enough sizes to be alike, and signatures that agree in so many values."""
    a, b = F.col(x), F.col(y)
    sizes = 10 * F.least(a["n"], b["n"]) >= round(10 * SIMILAR) * F.greatest(a["n"], b["n"])
    return sizes & (sum(_bits(a["sign"][i], b["sign"][i]) for i in range(4)) <= ROWS * BANDS - least)


# The exact Jaccard index of whole shingle sets, in whole numbers.
_CLOSE = f"{round(10 + 10 * SIMILAR)} * size(array_intersect(_x, _y)) >= {round(10 * SIMILAR)} * (size(_x) + size(_y))"


def _nodes(files: DataFrame) -> DataFrame:
    """(node, kind, set, home, bands, n, sign): what is clustered. Families within a repository, plain copies and literal files each have nodes of their own."""
    kind = lambda which, home, s, name, n: F.struct(F.lit(which[0]).alias("kind"), F.lit(which).alias("which"), home.alias("home"), F.col(s).alias("set"), F.col(f"{name}_bands").alias("bands"), F.col(f"{name}_sign").alias("sign"), F.col(n).alias("n"))
    here, nowhere = F.col("codebase_id"), F.lit("")
    every = F.array(
        F.when(F.col("n_tokens") >= LEAST, kind("w", nowhere, "plain", "plain", "n_words")),
        F.when((F.col("n_tokens") >= LEAST) & (F.col("n_masks") > 0), kind("m", here, "masked", "masked", "n_masks")),
        F.when(F.col("literal") & (F.col("n_masks") > 0), kind("ml", nowhere, "masked", "masked", "n_masks")),
    )
    each = files.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select(F.xxhash64("x.which", "x.home", "x.set").alias("node"), "x.*")
    return each.groupBy("node").agg(F.any_value(F.struct("kind", "which", "home", "set", "bands", "sign", "n")).alias("x")).select("node", "x.*")


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b), a < b: the close pairs of nodes that share a bucket, but for pairs that are both linked to its least node.

    ``nodes`` is as ``_nodes`` gives it, ``sets_of`` gives (kind, set, items) of the wanted (kind, set).
    Each node first meets the least of its bucket. Those that are not surely close to it, by their signatures, meet all
    others there, in blocks of HOT, so the connected components are those of all close pairs.
    """
    bucket = F.explode(F.transform("bands", lambda v, i: F.xxhash64("which", "home", i, v))).alias("bucket")
    keyed = nodes.select("node", bucket)
    # a bucket's least node and size come before the join, so no bucket has to be in one task
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("held")).filter("held > 1")
    held = keyed.join(shared, "bucket").select("bucket", "a", "node", F.ceil(F.col("held") / HOT).cast("int").alias("salts"))
    meet = kept(held.join(nodes.select("node", F.struct("n", "sign", "kind", "set").alias("x")), "node").withColumnRenamed("node", "b"))

    marks = meet.select(F.col("b").alias("a"), F.col("x").alias("y")).groupBy("a").agg(F.any_value("y").alias("y"))
    led = meet.filter("a < b").join(marks, "a")
    ends = (F.col("a"), F.col("b"), F.col("x.kind").alias("kind"), F.col("y.set").alias("sa"), F.col("x.set").alias("sb"))
    stars = led.filter(_agree("x", "y", AGREE)).select(*ends)
    unsure = led.filter(~_agree("x", "y", SURE)).select("bucket", "b", "x", F.expr("pmod(xxhash64(b), salts)").cast("int").alias("salt"))
    others = meet.filter("a < b").select("bucket", F.col("b").alias("c"), F.col("x").alias("y"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    met = unsure.join(others, ["bucket", "salt"]).filter((F.col("b") != F.col("c")) & _agree("x", "y", AGREE))
    low, high = (f(F.struct("b", "x"), F.struct(F.col("c").alias("b"), F.col("y").alias("x"))) for f in (F.least, F.greatest))
    rest = met.select(low.alias("l"), high.alias("h")).select(F.col("l.b").alias("a"), F.col("h.b").alias("b"), F.col("l.x.kind").alias("kind"), F.col("l.x.set").alias("sa"), F.col("h.x.set").alias("sb"))
    pairs = kept(stars.unionByName(rest).distinct())

    sets = kept(sets_of(pairs.select("kind", F.explode(F.array("sa", "sb")).alias("set")).distinct()))
    x, y = (sets.select("kind", F.col("set").alias(k), F.col("items").alias(i)) for k, i in (("sb", "_x"), ("sa", "_y")))
    out = kept(pairs.join(x, ["kind", "sb"]).join(y, ["kind", "sa"]).filter(_CLOSE).select("a", "b"))
    forget(meet, pairs, sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its connected component for each node with a link but the least ones themselves."""
    edges, state = edges.select("a", "b").distinct(), None
    while True:
        before, edges = edges, kept(edges)
        if hasattr(before, "_siftline_path"):
            forget(before)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now
        # larger neighbours of each node move to its least neighbour, then it and its smaller ones do
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        small = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        edges = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()


def judged(chunks: DataFrame) -> DataFrame:
    """(codebase_id, file_path, reason, cluster) of every code file; reason is null for hand-written ones."""
    files = kept(sketches(chunks))
    found = links(_nodes(files), sets_of(chunks, files))
    roots = kept(components(found))
    forget(found)
    rooted = lambda rows, which, home, s: rows.withColumn("node", F.xxhash64(F.lit(which), home, s)).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    here, nowhere = F.col("codebase_id"), F.lit("")

    spread = rooted(files.filter(f"n_tokens >= {LEAST}").select("plain", "codebase_id").distinct(), "w", nowhere, "plain")
    wide = spread.groupBy("root").agg(F.count_distinct("codebase_id").alias("_n")).filter(f"_n >= {REPOSITORIES}")
    vendored = spread.join(wide, "root", "left_semi").select("plain").distinct().withColumn("_vendored", F.lit(True))

    # members of families and of data clusters are counted as different texts, of which one node may hold many
    own = rooted(files.filter(f"n_tokens >= {LEAST} and n_masks > 0").select("codebase_id", "masked", "digest").distinct(), "m", here, "masked")
    large = own.groupBy("root").agg(F.count_distinct("digest").alias("_n")).filter(f"_n >= {FAMILY}")
    families = own.join(large, "root", "left_semi").select("codebase_id", "masked").distinct().withColumn("_family", F.lit(True))

    held = rooted(files.filter("literal and n_masks > 0").select("masked", "digest").distinct(), "ml", nowhere, "masked")
    many = held.groupBy("root").agg(F.count_distinct("digest").alias("_n")).filter(f"_n >= {FAMILY}")
    data = held.join(many, "root", "left_semi").select("masked").distinct().withColumn("_data", F.lit(True))

    out = files.select("codebase_id", "file_path", "n_tokens", "plain", "masked", "reason", "literal", "telling")
    out = out.join(vendored, "plain", "left").join(families, ["codebase_id", "masked"], "left").join(data, "masked", "left")
    # a few tokens are alike by chance: short files of a family must also repeat within themselves
    cluster = F.when(F.col("_vendored") & (F.col("n_tokens") >= LEAST), "vendored cluster").when(F.col("_family") & F.col("telling"), "generated family").when(F.col("_data") & F.col("literal"), "data")
    return out.select("codebase_id", "file_path", F.coalesce("reason", cluster).alias("reason"), cluster.alias("cluster"))


def found(chunks: DataFrame) -> DataFrame:
    return judged(chunks).filter("reason is not null").select("codebase_id", "file_path").distinct()
