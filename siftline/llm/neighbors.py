"""The most similar vectors of every vector: an inverted file with product-quantised residuals.

Rows with the same direction are one class, so copies cost nothing and stay exact.  For each vector
length, cells, the lists within each cell and residual codebooks are fitted on samples of bounded size a list;
every class is indexed.  Lists keep their size as the data grows (up to ``LISTS`` of them), so the work of a query that asks a
fixed number of lists does too.  In its lists, tables of products between the query and the codebooks give
approximate cosines (asymmetric distances); with the known coding error of each member they bound the true cosine, and
all members that can be among the k best are scored exactly.  Lists are packed into blocks of at most about ``BLOCK`` classes; a
list larger than that is spread over several blocks, and queries go to all of them; a block asked by
more than ``ASKS`` classes is repeated for slices of them.  So no task grows with the data and
nothing is left out.

Defined results: null, empty, all-zero and non-finite vectors, and null ids, have no neighbours and
are none; vectors of different lengths are never compared; equal cosines go to the smaller id;
repeated rows are rows of their own; an empty table gives an empty table; extra columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.session import kept

SAMPLE, LIST_ROWS, LISTS, PER_LIST, PART, PROBES, BLOCK, ASKS, PARTS, CODES = 20_000, 128, 65_536, 32, 8_192, 8, 4_000, 60_000, 8, 256
SHARE = 0.06  # of the lists, where neighbours of any cosine are wanted
SAME_DIGITS = 6  # directions equal to so many digits are one class


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8, spherical: bool = False) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)



class Model:
    """What is fitted for one vector length: centroids, codebooks of the residuals, and the blocks of each list."""

    def __init__(self, sample: np.ndarray, cells: np.ndarray, centroids: np.ndarray, cell_of: np.ndarray, seed: int = 11):
        """``cell_of`` has the first-level cell of each centroid."""
        dim = sample.shape[1]
        order = np.lexsort((np.arange(len(centroids)), np.argsort(np.argsort(cells @ _axis(cells)))[cell_of]))
        self.centroids = centroids[order]  # lists of a cell, and near cells, side by side
        self.parts = PARTS if dim % PARTS == 0 else 1
        residual = sample - self.centroids[_nearest(sample, self.centroids)]
        step, rng = dim // self.parts, np.random.default_rng(seed)
        self.codebooks = [_kmeans(residual[:, i * step : (i + 1) * step], min(CODES, len(sample)), rng, 5) for i in range(self.parts)]
        self.blocks: list[list[int]] = []
        self.slices: dict[int, int] = {}

    def pack(self, sizes: np.ndarray, asked: np.ndarray, first: int) -> int:
        """Blocks for lists of these sizes, numbered from ``first``: near lists share one, large ones have several."""
        self.blocks = []
        block, held = first, 0
        for n in map(int, sizes):
            if n > BLOCK:
                if held:
                    block, held = block + 1, 0
                k = -(-n // BLOCK)
                self.blocks.append(list(range(block, block + k)))
                block += k
                continue
            if held + n > BLOCK:
                block, held = block + 1, 0
            self.blocks.append([block])
            held += n
        asks: dict[int, int] = {}
        for c, blocks in enumerate(self.blocks):
            for x in blocks:
                asks[x] = asks.get(x, 0) + int(asked[c])
        self.slices = {x: -(-n // ASKS) for x, n in asks.items() if n > ASKS}
        return block + 1

    def probes(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each vector, and the lists it asks as a query."""
        s = x @ self.centroids.T
        p = min(probes, s.shape[1])
        return s.argmax(axis=1), np.argpartition(-s, p - 1, axis=1)[:, :p]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r, step = x - self.centroids[lists], x.shape[1] // self.parts
        return np.stack([_nearest(r[:, i * step : (i + 1) * step], b) for i, b in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.codebooks)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, part and code: the product of the query's part with the code's."""
        step = q.shape[1] // self.parts
        return np.stack([q[:, i * step : (i + 1) * step] @ b.T for i, b in enumerate(self.codebooks)], axis=1)


def _axis(c: np.ndarray) -> np.ndarray:
    """The direction in which the centroids differ most, to put near lists side by side."""
    if len(c) < 2:
        return np.ones(c.shape[1], np.float32)
    _, _, v = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)
    return v[0]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def directions(chunks: DataFrame) -> DataFrame:
    """(id, key, dim, vec): the usable vectors at unit length; equal directions have equal keys."""

    def run(batches):
        for b in batches:
            ids, keys, dims, vecs = [], [], [], []
            column = b.column(1)
            lengths = np.array([-1 if v is None else v for v in pc.list_value_length(column).to_pylist()])
            for dim in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == dim)
                flat = column.take(pa.array(at)).flatten()
                x = np.array(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
                norm = np.linalg.norm(x, axis=1)
                ok = np.isfinite(norm) & (norm > 0)
                at, u = at[ok], (x[ok] / norm[ok, None])
                ids += [b.column(0)[int(i)].as_py() for i in at]
                keys += [xxhash.xxh128_digest(v.tobytes()) for v in np.round(u, SAME_DIGITS) + 0.0]
                dims += [int(dim)] * len(at)
                vecs += [w.tobytes() for w in u.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["id", "key", "dim", "vec"])

    rows = chunks.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).filter("id is not null and embedding is not null")
    return rows.mapInArrow(run, "id long, key binary, dim int, vec binary")


def classes(rows: DataFrame, least_kept: int) -> DataFrame:
    """(key, dim, vec, ids): one row a direction with its smallest ids."""
    # in hashed slices first, so that a class of any size is never one list
    sliced = rows.select("id", "key", F.pmod(F.xxhash64("id"), F.lit(64)).alias("slice"))
    top = sliced.withColumn("r", F.row_number().over(Window.partitionBy("key", "slice").orderBy("id"))).filter(F.col("r") <= least_kept)
    ids = top.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("id")), 1, least_kept).alias("ids"))
    own = rows.groupBy("key").agg(F.min(F.struct("id", "dim", "vec")).alias("m"))
    return own.join(ids, "key").select("key", F.col("m.dim").alias("dim"), F.col("m.vec").alias("vec"), "ids")


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict[int, Model]:
    """A model for each vector length: one list to ``LIST_ROWS`` rows, at most ``LISTS``.

    Cells and codebooks are fitted here on at most ``sample`` vectors of a length; the lists of each cell by
    the tasks, on ``PER_LIST`` sampled vectors a list, in parts of at most about ``PART`` vectors.
    """
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    few = lambda want: F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) < F.create_map(*(F.lit(x) for d, n in counts.items() for x in (d, int((1 << 30) * min(1.0, want(n) / n)))))[F.col("dim")]
    taken: dict[int, dict[bytes, np.ndarray]] = {d: {} for d in counts}
    for r in rows.filter(few(lambda n: 0.95 * sample)).select("dim", "key", "vec").collect():  # about ``sample`` a length
        if len(taken[r.dim]) < sample:
            taken[r.dim][bytes(r.key)] = np.frombuffer(r.vec, np.float32)
    samples = {d: np.stack(list(v.values())) for d, v in taken.items() if v}
    for r in rows.filter(~F.col("dim").isin(list(samples))).select("dim", "vec").limit(sample).collect() if len(samples) < len(counts) else ():  # lengths with hardly any row
        samples[r.dim] = np.vstack([samples.get(r.dim, np.zeros((0, r.dim), np.float32)), np.frombuffer(r.vec, np.float32)])
    lists = {d: max(1, min(LISTS, counts[d] // LIST_ROWS)) for d in samples}
    cells = {d: _kmeans(x, min(len(x), max(1, round(math.sqrt(lists[d])))), np.random.default_rng(11), spherical=True) for d, x in samples.items()}
    sent = rows.sparkSession.sparkContext.broadcast(cells)  # at most 256 a length

    def place(batches):
        for b in batches:
            dims = np.array(b.column(0).to_pylist())
            cell = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cell[at] = (_matrix(b.column(1).take(pa.array(at)), d) @ sent.value[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), b.column(1)], names=["dim", "cell", "vec"])

    placed = rows.filter(F.col("dim").isin(list(samples))).filter(few(lambda n: PER_LIST * max(1, min(LISTS, n // LIST_ROWS)))).groupBy("key").agg(F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"))
    placed = placed.select("dim", "vec").mapInArrow(place, "dim int, cell int, vec binary")
    share = F.ceil(F.count("*") / PART).alias("parts")
    parts = placed.groupBy("dim", "cell").agg(share)
    split = placed.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.expr("pmod(xxhash64(vec), parts)").cast("int"))  # at most 256 rows a length

    def refine(table: pa.Table) -> pa.Table:
        d, c = table.column("dim")[0].as_py(), table.column("cell")[0].as_py()
        x = _matrix(table.column("vec").combine_chunks(), d)
        k = min(len(x), max(1, round(len(x) / PER_LIST)))
        found = _kmeans(x[np.argsort([xxhash.xxh64_intdigest(v.tobytes()) for v in x])], k, np.random.default_rng(c), spherical=True)
        return pa.table({"dim": pa.array([d] * k, pa.int32()), "cell": pa.array([c] * k, pa.int32()), "vec": pa.array([v.tobytes() for v in found], pa.binary())})

    leaves: dict[int, list] = {d: [] for d in samples}
    for r in split.groupBy("dim", "cell", "part").applyInArrow(refine, "dim int, cell int, vec binary").collect():  # at most about LISTS a length
        leaves[r.dim].append((r.cell, r.vec))
    models = {}
    for d, x in samples.items():
        held = sorted(leaves[d]) or [(c, v.tobytes()) for c, v in enumerate(cells[d])]
        models[d] = Model(x, cells[d], np.stack([np.frombuffer(v, np.float32) for _, v in held]), np.array([c for c, _ in held]))
    return models


def search(chunks: DataFrame, k: int = 5, queries: str = "true", least: float = -1.0, probes: int = PROBES, share: float = 0.0) -> DataFrame:
    """(id, rank, neighbour, cosine): the k most similar other rows of each row for which ``queries`` (over id) holds.

    A query asks ``probes`` lists, or ``share`` of all lists if that is more.  Neighbours below the cosine ``least``
    are left out.  Within the lists asked nothing is lost: every member is scored exactly whose approximate
    cosine and coding error leave it a chance to be among the k best.
    """
    spark = chunks.sparkSession
    rows = kept(directions(chunks))
    models = fit(rows)
    sent = spark.sparkContext.broadcast(models)  # at most about LISTS centroids and 256 codes a length

    def assign(batches):
        for b in batches:
            dims, asks = np.array(b.column(1).to_pylist()), np.array(b.column(3).to_pylist())
            own_list, lists, codes = np.zeros(len(dims), np.int32), [None] * len(dims), [b""] * len(dims)
            for dim in np.unique(dims):
                m, at = sent.value[dim], np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 1024):
                    i = at[lo : lo + 1024]
                    q = _matrix(b.column(2).take(pa.array(i)), dim)
                    own, near = m.probes(q, max(probes, math.ceil(share * len(m.centroids))))
                    own_list[i] = own
                    for j, code, c, n in zip(i, m.encode(q, own), own, near, strict=True):
                        codes[j] = code.tobytes()
                        if asks[j]:
                            lists[j] = n if c in n else [*n, c]
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(own_list), pa.array(lists, kinds), pa.array(codes, pa.binary())], names=["key", "dim", "vec", "ids", "list", "asks", "code"])

    asked = rows.filter(queries).select("key").distinct().withColumn("asks", F.lit(True))
    marked = classes(rows, k + 1).join(asked, "key", "left").select("key", "dim", "vec", F.coalesce("asks", F.lit(False)).alias("asks"), "ids")
    cls = kept(marked.mapInArrow(assign, "key binary, dim int, vec binary, ids array<long>, list int, asks array<int>, code binary"))

    held = {(r.dim, r.list): r.n for r in cls.groupBy("dim", "list").agg(F.count("*").alias("n")).collect()}  # one row a list
    wanted = {(r.dim, r.list): r.n for r in cls.select("dim", F.explode("asks").alias("list")).groupBy("dim", "list").agg(F.count("*").alias("n")).collect()}
    first = 0
    for dim, m in models.items():
        n, a = (np.array([x.get((dim, c), 0) for c in range(len(m.centroids))]) for x in (held, wanted))
        first = m.pack(n, a, first)
    packed = spark.sparkContext.broadcast(models)

    def spread(batches):
        """A row for each block that a class lies in or asks: its list there (or -1) and the lists it asks there."""
        for b in batches:
            out = [[] for _ in range(9)]
            for key, dim, vec, own, lists, code, low in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                m = packed.value[dim]
                mine = m.blocks[own]
                salt = int.from_bytes(key[:4], "little")
                home = mine[salt % len(mine)]
                there: dict[tuple[int, int], list[int]] = {(home, x): [] for x in range(m.slices.get(home, 1))}
                for c in lists or ():
                    for block in m.blocks[c]:
                        there.setdefault((block, (salt >> 8) % m.slices.get(block, 1)), []).append(c)
                for (block, part), ask in there.items():
                    at_home = block == home
                    for column, v in zip(out, (block, part, key, low, dim, own if at_home else -1, ask, code if at_home else b"", vec), strict=True):
                        column.append(v)
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["block", "slice", "key", "low", "dim", "list", "asks", "code", "vec"])

    def look(table: pa.Table) -> pa.Table:
        """The k best classes for each query of a block, exactly scored; equal cosines by their smallest id."""
        dim = table.column("dim")[0].as_py()
        m = packed.value[dim]
        keys, low = table.column("key").combine_chunks(), table.column("low").to_numpy()
        lists = table.column("list").to_numpy()
        x = _matrix(table.column("vec").combine_chunks(), dim)
        base = np.flatnonzero(lists >= 0)
        codes = np.frombuffer(b"".join(c for c in table.column("code").to_pylist() if c), np.uint8).reshape(len(base), m.parts)
        error = np.linalg.norm(x[base] - m.decode(codes, lists[base]), axis=1) + 1e-6
        asks: dict[int, list[int]] = {}
        for i, cs in enumerate(table.column("asks").to_pylist()):
            for c in cs:
                asks.setdefault(c, []).append(i)
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for c, who in asks.items():
            inside = np.flatnonzero(lists[base] == c)
            if not len(inside):
                continue
            members, member_codes, e = base[inside], codes[inside].astype(np.int64), error[inside]
            for lo in range(0, len(who), max(1, 500_000 // len(members))):
                qi = np.array(who[lo : lo + max(1, 500_000 // len(members))])
                t = m.tables(x[qi])
                approx = np.repeat((x[qi] @ m.centroids[c])[:, None], len(members), axis=1)
                for part in range(m.parts):
                    approx += np.take(t[:, part, :], member_codes[:, part], axis=1)
                approx[qi[:, None] == members[None, :]] = -np.inf
                floor = np.full(len(qi), least)
                if len(members) > k:  # k members are surely this good
                    floor = np.maximum(floor, -np.partition(-(approx - e), k - 1, axis=1)[:, k - 1])
                a, j = np.nonzero(approx + e >= floor[:, None])
                for at in range(0, len(a), 200_000):
                    q, o = qi[a[at : at + 200_000]], members[j[at : at + 200_000]]
                    exact = np.round(np.einsum("nd,nd->n", x[q].astype(np.float64), x[o].astype(np.float64)), 9)
                    ok = (exact >= least) & (q != o)
                    best.append((q[ok], o[ok], exact[ok]))
        q, o, cosine = (np.concatenate(c) for c in zip(*best, strict=True))
        order = np.lexsort((low[o], -cosine, q))
        q, o, cosine = q[order], o[order], cosine[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        q, o, cosine = q[rank < k], o[rank < k], cosine[rank < k]
        return pa.table({"key": keys.take(pa.array(q)), "other": keys.take(pa.array(o)), "low": pa.array(low[o], pa.int64()), "cosine": pa.array(cosine, pa.float64())})

    blocks = cls.select("key", "dim", "vec", "list", "asks", "code", F.col("ids")[0].alias("low")).mapInArrow(spread, "block int, slice int, key binary, low long, dim int, list int, asks array<int>, code binary, vec binary")
    near = kept(blocks.groupBy("block", "slice").applyInArrow(look, "key binary, other binary, low long, cosine double"))

    # classes back to rows: a row's own class comes first (cosine 1), then other classes' smallest ids
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "low"))).filter(F.col("r") <= k)
    others = top.join(cls.select(F.col("key").alias("other"), "ids"), "other").select("key", "cosine", F.explode("ids").alias("neighbour"))
    own = cls.filter(F.size("ids") > 1).join(asked.select("key"), "key", "left_semi").select("key", F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    found = F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour")))
    lists = others.unionByName(own).groupBy("key").agg(found.alias("found"))
    each = rows.filter(queries).join(lists, "key").select("id", F.posexplode(F.slice(F.filter("found", lambda f: f["neighbour"] != F.col("id")), 1, k)).alias("rank", "f"))
    return each.select("id", (F.col("rank") + 1).alias("rank"), F.col("f.neighbour").alias("neighbour"), (-F.col("f.far")).alias("cosine"))


def found(chunks: DataFrame, k: int = 5, least: float = 0.9) -> DataFrame:
    """(chunk_a, chunk_b): pairs with a cosine of at least ``least`` of which one is among the k most similar of the other."""
    near = search(chunks, k, least=least - 1e-6).filter(F.col("cosine") >= least)
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()
