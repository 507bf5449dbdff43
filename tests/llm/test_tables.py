"""Operators over whole tables: brute force, hot groups, and rows with nulls, repeats and clashing columns."""

import random

import numpy as np
import pytest
import xxhash

from siftline.llm import contamination, credentials, documented, generated, invalid, mixture, neighbors, repetition, splitting

CHUNKS = "id long, codebase_id string, file_path string, start_line long, end_line long, content string, language string, hash string, embedding array<float>, modified_at long, key string, leaf string, vec string, reason string"


def chunk(i, cb, path, content, at=1, start=1, embedding=None):
    return (i, cb, path, start, None, content, None, None, embedding, at, "k", "l", "v", "r")


@pytest.fixture(scope="module")
def dirty(spark):
    """Nulls in any column, repeats, old versions, empty texts."""
    rows = [
        chunk(1, "c", "a.py", 'PASSWORD = "clQ9!MGqgca*UD"\n'), chunk(2, "c", "a.py", 'PASSWORD = "clQ9!MGqgca*UD"\n'), chunk(3, "c", "a.py", 'OLD_SECRET = "stale7949#x"\nx = (\n', at=0),
        chunk(4, None, "n.py", "x = (\n", at=None), chunk(5, "c", None, 'API_KEY = "dense2996#"'), chunk(6, "c", "e.py", None), chunk(7, "c", "e.go", ""), chunk(None, None, None, None, None, None),
        chunk(9, "c", "d.py", 'def f():\n    """Reads each record out of the store."""\n', at=None),
    ]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CHUNKS)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_dirty_rows(dirty, empty):
    assert rows_of(credentials.found(dirty)) == {("c", "a.py", 1), ("c", None, 1)}
    assert credentials.redact(dirty).filter("content like '%clQ9%'").count() == 0 and credentials.redact(dirty).columns == dirty.columns
    assert rows_of(invalid.found(dirty)) == {(None, "n.py"), ("c", "e.go")}
    assert {tuple(r)[:4] for r in invalid.rates(dirty).collect()} == {("c", "python", 3, 0), ("c", "go", 1, 1), (None, "python", 1, 1)}
    assert rows_of(documented.found(dirty)) == {("c", "d.py", 1)}
    assert generated.found(dirty).count() == 0
    for f in (credentials.found, invalid.found, documented.found, generated.found, neighbors.found):
        assert f(empty).count() == 0
    assert neighbors.found(dirty).count() == 0


def test_redaction_goes_over_the_edges_of_chunks(spark):
    body = ["".join(random.Random(i).choices("abcdefghijkABCDEFGHIJK0123456789+/", k=64)) for i in range(20)]
    lines = ["a = 1"] * 10 + ["-----BEGIN RSA PRIVATE KEY-----", *body, "-----END RSA PRIVATE KEY-----"] + ["rest = 2"] * 5
    lines += ["const apiKey =", '  "q7Rk2xVb9L" +', *[f'  "Zt{i}mWq81Lk" +' for i in range(6)], '  "end5Xq";', "done = 3"]
    cut = lambda size, step: [(i + 1, "\n".join(lines[i : i + size])) for i in range(0, len(lines), step)]
    rows = [chunk(100 * at + i, "c", "k.js", text, at=at, start=s) for at, parts in ((2, cut(20, 15)), (1, cut(16, 16))) for i, (s, text) in enumerate(parts)]
    rows += [chunk(900, "c", "k.js", 'let apiKey = "vQ8#other2Lm"', at=2, start=3)]  # contradicts the others
    before = {r[0]: r[5] for r in rows}
    after = {r.id: r.content for r in credentials.redact(spark.createDataFrame(rows, CHUNKS)).collect()}
    secrets = [*body, "q7Rk2xVb9L", *[f"Zt{i}mWq81Lk" for i in range(6)], "end5Xq", "vQ8#other2Lm"]
    assert after.keys() == before.keys() and not any(s in text for text in after.values() for s in secrets)
    for i, text in after.items():
        assert len(text) == len(before[i]) and all(a == b or not any(x in a for x in ("done", "rest", "a = 1", "BEGIN", "END")) for a, b in zip(before[i].split("\n"), text.split("\n"), strict=True))
    open_end = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(body) + "\nx = 1\n"
    assert credentials.mask(open_end, "k.pem").endswith("\nx = 1\n") and not any(b in credentials.mask(open_end, "k.pem") for b in body)


def test_generated_clusters(spark):
    def hand(k):
        rng = random.Random(k)
        forms = ["x{0} = g{0}(y{1}, {1})", "if not a{0}: b{1}()", "for c{0} in d{1}: e{0}.append(c{0})", "assert v{0} >= {1}, 'm{0}'", "u{0}[{1}] = [q{0} for q{0} in r{1} if q{0}]", "s{0} += {1}", "t{0}.run(w{1}, z=x{0})"]
        return f"import a{k}\n" + "\n".join(rng.choice(forms).format(rng.randint(0, 99), k * 100 + i) for i in range(25))

    rows = [chunk(i, f"c{i}", f"p{i}/lib.py", hand(0) + ("\n# patched\n" if i == 2 else "")) for i in range(3)]  # a library in three
    rows += [chunk(10 + i, f"c{i}", f"q{i}/own.py", hand(1)) for i in range(2)]  # a copy in two
    rows += [chunk(20, "c9", "v.py", hand(0) + "\n\n# patched  \nadded = 1")]  # altered copy
    rows += [chunk(30, "c1", "README.md", "# Code generated by x. DO NOT EDIT."), chunk(31, "c1", "gen/x.py", "a = 1")]
    rows *= 2  # every row twice
    table = spark.createDataFrame(rows, CHUNKS)
    assert {r.file_path for r in generated.found(table).collect()} == {"p0/lib.py", "p1/lib.py", "p2/lib.py", "v.py", "gen/x.py"}


def links_of(spark, sets, buckets):
    sign = lambda s: generated.nibbles(generated.minhash(np.array([xxhash.xxh64_intdigest(str(x)) for x in s], np.uint64)))
    nodes = [(n, "w", "w", "", n, [buckets[n]], sign(s), len(s)) for n, s in sets.items()]
    table = spark.createDataFrame(nodes, "node long, kind string, which string, home string, set long, bands array<long>, sign array<long>, n int")
    items = spark.createDataFrame([("w", n, list(s)) for n, s in sets.items()], "kind string, set long, items array<long>")
    return rows_of(generated.links(table, lambda needed: items.join(needed, ["kind", "set"], "left_semi")))


def test_generated_clusters_are_components(spark):
    """A chain of three codebases whose ends are not alike, in every order of its digests; a hot bucket led by a stranger."""
    tokens = generated.tables()[False]
    for k in range(3):
        words = [f"n{k}_{i}" for i in range(150)]
        texts = [" ".join([f"h{k}_{i}" for i in range(12 * j)] + words[12 * j :]) for j in range(3)]
        sets = [set(generated.shingles(tokens.hash[generated.counted(t, tokens)[1]], generated.PLAIN).tolist()) for t in texts]
        share = lambda a, b: len(a & b) / len(a | b)
        assert share(sets[0], sets[1]) >= 0.8 and share(sets[1], sets[2]) >= 0.8 and share(sets[0], sets[2]) < 0.8
        rows = [chunk(j, f"c{j}", f"{j}.js", t) for j, t in enumerate(texts)]
        assert generated.found(spark.createDataFrame(rows, CHUNKS)).count() == 3, k
    sets = {0: [0], 1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5], 3: [1, 2, 3, 4], 4: [9], 5: [9]}
    assert links_of(spark, sets, {n: 7 for n in sets}) == {(1, 2), (1, 3), (2, 3), (4, 5)}
    assert rows_of(generated.components(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5), (5, 9), (7, 9), (7, 8)], "a long, b long"))) == {(2, 1), (3, 1), (5, 4), (7, 4), (8, 4), (9, 4)}


def test_generated_family_need_not_repeat(spark):
    """Three files of one repository, alike when masked, none repeating within itself; alike short ones are no evidence."""
    rng = random.Random(3)
    shape = [rng.choice(["{}(", "){}", "[{}]", "+{}", "-{}", "={}", "*{}", "if {}", "return {}", "for {}", "not {}", "{};", "<{}", ">{}", "&{}", "|{}"]) for _ in range(90)]
    text = lambda k, n: " ".join(s.format(f"n{k}_{i}") for i, s in enumerate(shape[:n]))
    assert generated.describe(text(0, 90), "a.js", generated.tables())["repeats"] < 0.2
    rows = [chunk(k, "c", f"{k}.js", text(k, 90)) for k in range(3)] + [chunk(10 + k, "d", f"s{k}.js", text(10 + k, 25)) for k in range(3)]
    rows += [chunk(20 + k, f"e{k}", f"t{k}.js", text(20 + k, 90)) for k in range(3)]  # one in each of three
    assert {r.file_path for r in generated.found(spark.createDataFrame(rows, CHUNKS)).collect()} == {"0.js", "1.js", "2.js"}


def test_literal_clusters_are_data(spark):
    blob = lambda k: f'BLOB{k} = "' + "".join(random.Random(k).choices("abcdef0123456789", k=3000)) + '"\n'
    rows = [chunk(k, f"c{k}", f"{k}.py", blob(k)) for k in range(3)] + [chunk(10 + k, "d", f"s{k}.py", f'NAME{k} = "short{k}"\n') for k in range(3)]
    assert {tuple(r)[1:] for r in generated.judged(spark.createDataFrame(rows, CHUNKS)).collect() if r.reason} == {(f"{k}.py", "data", "data") for k in range(3)}


def test_generated_verification_is_exact(spark):
    """0.9 of the whole sets are shared, but less than 0.8 of the 256 least hashes; and the other way round."""
    sets = {1: range(1000), 2: range(100, 1000), 3: range(5000, 6000), 4: [*range(5000, 5600), *range(7000, 7400)]}
    assert links_of(spark, sets, {n: n // 3 for n in sets}) == {(1, 2)}


def test_signatures_lose_no_close_pair():
    """Of pairs of sets with a similarity of 0.8, all agree in enough values of their signatures."""
    for seed in range(300):
        items = np.random.default_rng(seed).integers(0, 2**63, 450).astype(np.uint64)
        a, b = generated.minhash(np.sort(items[:405])), generated.minhash(np.sort(items[45:]))
        assert (a == b).sum() >= generated.AGREE
        differ = sum(bin((x ^ y) & (15 << 4 * j)).count("1") > 0 for x, y in zip(generated.nibbles(a), generated.nibbles(b), strict=True) for j in range(16))
        assert differ <= (a != b).sum()


def brute_neighbours(vectors, k, least):
    out = set()
    ids = sorted(vectors)
    unit = {i: np.array(vectors[i], float) / np.linalg.norm(vectors[i]) for i in ids}
    for a in ids:
        near = sorted(((-round(float(unit[a] @ unit[b]), 6), b) for b in ids if b != a and len(vectors[b]) == len(vectors[a])))[:k]
        out |= {(min(a, b), max(a, b)) for s, b in near if -s >= least}
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 40)  # several blocks and slices on a small table
    monkeypatch.setattr(neighbors, "ASKS", 100)
    rng = np.random.default_rng(5)
    vectors = {}
    for g in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            vectors[len(vectors)] = [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.05]
    hot = [float(np.float32(x)) for x in rng.normal(size=16)]
    for _ in range(len(vectors) // 2):  # a third of all rows are copies
        vectors[len(vectors)] = hot
    for _ in range(10):
        vectors[len(vectors)] = [float(np.float32(x)) for x in rng.normal(size=5)]
    rows = [chunk(i, "c", "a", None, embedding=v) for i, v in vectors.items()]
    rows += [chunk(9001, "c", "a", None, embedding=[0.0] * 16), chunk(9002, "c", "a", None, embedding=[]), chunk(9003, "c", "a", None, embedding=[float("nan")] * 16), chunk(None, "c", "a", None, embedding=hot)]
    table = spark.createDataFrame(rows, CHUNKS)
    assert rows_of(neighbors.found(table)) == brute_neighbours(vectors, 5, 0.9)
    some = neighbors.search(table, 3, "id % 20 = 0").collect()
    assert {r.id for r in some} <= {i for i in vectors if i % 20 == 0} and max(r.rank for r in some) == 3


ITEMS = "item_id long, benchmark string, split string, text string"
DOCS = "doc_id long, text string, source string, gram string, n long"


def test_contamination(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    items = [(i, "b", "test", " ".join(rng.choices(words, k=40))) for i in range(8)] + [(90, "b", "dev", None), (91, "b", "dev", "too short"), (92, None, None, "")]
    docs = []
    for k in range(60):
        ws = rng.choices(words, k=rng.randint(0, 80))
        if k % 3 == 0:
            t = items[k % 8][3].split()
            a = rng.randint(0, 20)
            cut = t[a : a + rng.randint(12, 20)]
            if k % 2:
                cut = [x.upper() + "," for x in cut]
            ws[5:5] = cut
        docs.append((k, " ".join(ws), None, "g", 1))
    docs += [(100, None, None, None, None), (101, "", None, None, None), (0, docs[0][1], None, None, None)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    grams = lambda t: {tuple(t[j : j + 15]) for j in range(len(t) - 14)}
    parse = contamination.words
    want = {(k, j) for k, t, *_ in docs if t for j, _, _, u in items if u and grams(parse(t)) & grams(parse(u))}
    assert rows_of(contamination.found(d, i)) == want and len(want) > 5
    assert contamination.found(d.limit(0), i).count() == 0 and contamination.found(d, i.limit(0)).count() == 0


def test_edited_copies_leak(spark):
    """Every tenth word changed, in documents long and short, beside exact copies of other parts of the same items."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [(i, "b", "test", " ".join(word() for _ in range(60))) for i in range(20)]
    docs, planted = [], set()
    for k in range(200):
        i = k % 20
        t = items[i][3].split()
        if k % 4 == 3:
            t = t[:20]
        else:
            planted.add((k, i))
            for at in range(rng.randint(0, 9), 60, 10):
                if k % 4 == 2 and at > 9:
                    t[at - 1 : at] = [word(), word()]  # one word becomes two
                else:
                    t[at] = word()
        docs.append((k, " ".join([*(word() for _ in range(rng.randint(0, 400))), *t, *(word() for _ in range(rng.randint(0, 400)))]), None, "g", 1))
    docs += [(1000 + k, " ".join(word() for _ in range(100)), None, "g", 1) for k in range(300)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    leaked = contamination.leaks(d, i).collect()
    edited = {(r.doc_id, r.item_id) for r in leaked if not r.copied}
    assert len(planted - {(r.doc_id, r.item_id) for r in leaked}) <= 0.02 * len(planted) and edited <= planted and len(edited) > 100
    for r in leaked[:20]:  # the same scores as over the whole document
        a, b = docs[r.doc_id][1].split(), items[r.item_id][3].split()
        known = {w: n for n, w in enumerate(set(b))}
        (run,), (score,) = contamination.align([np.array([known.get(w, -1) for w in a])], [np.array([known[w] for w in b])])
        assert (run, score) == (r.longest_run, r.score)


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixture, "PER_BUCKET", 7)
    rows = [(k, "word " * 10, " Big " if k % 2 else "BIG", None, None) for k in range(90)] + [(200 + k, "word " * 10, "small", None, None) for k in range(5)]
    rows += [(300, "word", None, None, None), (301, "word", "  ", None, None), (302, None, "small", None, None), (303, "word " * 50, "unlisted", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats long")
    sizes = mixture.tokens(docs)
    plan = {r.listed: r for r in mixture.plan(sizes, weights).collect()}
    assert plan["small"].short and plan["absent"].short and not plan["big"].short
    assert rows_of(mixture.found(docs, weights)) == {("small",), ("absent",)}
    drawn = mixture.drawn(sizes, weights).collect()
    copies = {}
    for r in drawn:
        copies.setdefault(r.source, []).append(r.copies)
    assert set(copies) == {"big", "small"} and len(copies["small"]) == 6 and set(copies["small"]) == {3}
    assert abs(sum(copies["big"]) - 90 * plan["big"].expected) < 1 and max(copies["big"]) <= 1
    assert {r.doc_id: r.copies for r in drawn} == {r.doc_id: r.copies for r in mixture.drawn(sizes, weights).collect()}
    shares = {r.source: r for r in mixture.shares(sizes, weights).collect()}
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1) and shares["absent"].actual_share == 0
    assert mixture.drawn(mixture.tokens(docs.limit(0)), weights).count() == 0


def test_documents_and_items_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h " * 9, None, None, None), (1, "a b c d e f g h " * 9, None, None, None), (2, None, None, None, None), (3, "", None, None, None), (None, "x", None, None, None)], DOCS)
    assert rows_of(repetition.found(docs)) == {(1,)} and repetition.measure(docs).count() == 5
    items = spark.createDataFrame(
        [("x", "c", "a.md", "markdown", 5, 6, "line one\n" * 200, "SMALL", 1), ("x", "c", "a.md", "markdown", 5, 6, "line one\n" * 200, "SMALL", 1), ("y", None, None, None, None, None, "é" * 2000, None, 1), ("z", None, None, None, None, None, None, "12", 1), ("q", None, "a", None, 1, 1, "abc", "auto", 1)],
        "chunk_id string, codebase_id string, file_path string, language string, start_line long, end_line long, content string, token_budget string, piece_no int",
    )
    assert rows_of(splitting.found(items)) == {("x",), ("y",)}
    cut = splitting.pieces(items).filter("chunk_id = 'x'").dropDuplicates(["piece_no"]).orderBy("piece_no").collect()
    assert cut[0].start_line == 5 and all(len(r.content.encode()) <= 1024 and r.end_line - r.start_line == r.content.count("\n") for r in cut)
    assert all(a.end_line >= b.start_line - 1 for a, b in zip(cut, cut[1:], strict=False)) and cut[-1].end_line == 5 + 200
    assert splitting.found(items.limit(0)).count() == 0 and repetition.found(docs.limit(0)).count() == 0
