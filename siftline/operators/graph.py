"""A graph of what code defines and imports: nodes, edges, dependents, traversal, predicted changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import vectors as V
from siftline.functions.text import lines_of, sha16, stable_score
from siftline.session import cut, spread

# Node type, language and the expression that finds the name in a trimmed line.
PATTERNS = [
    ("Function", "rust", r"^(?:pub(?:\([^)]*\))? )?(?:const |async |unsafe )*fn (\w+)"), ("Struct", "rust", r"^(?:pub(?:\([^)]*\))? )?struct (\w+)"),
    ("Trait", "rust", r"^(?:pub(?:\([^)]*\))? )?trait (\w+)"), ("Impl", "rust", r"^impl(?:<[^>]*>)? (?:[\w:<>, ]+ for )?(\w+)"), ("Import", "rust", r"^(?:pub )?use ([\w:]+)"),
    ("Function", "javascript", r"^(?:export )?(?:default )?(?:async )?function\*? (\w+)"), ("Class", "javascript", r"^(?:export )?(?:default )?class (\w+)"), ("Import", "javascript", r"""^import .*from ['"]([^'"]+)['"]"""),
    ("Function", "typescript", r"^(?:export )?(?:default )?(?:async )?function\*? (\w+)"), ("Class", "typescript", r"^(?:export )?(?:default )?(?:abstract )?class (\w+)"), ("Import", "typescript", r"""^import .*from ['"]([^'"]+)['"]"""),
    ("Interface", "typescript", r"^(?:export )?interface (\w+)"),
    ("Function", "python", r"^(?:async )?def (\w+)"), ("Class", "python", r"^class (\w+)"), ("Import", "python", r"^(?:import|from) ([\w.]+)"),
    ("Function", "go", r"^func (?:\([^)]*\) ?)?(\w+)"), ("Struct", "go", r"^type (\w+) struct"), ("Interface", "go", r"^type (\w+) interface"),
    ("Function", "java", r"^(?:public|private|protected) (?:static |final |abstract )*[\w<>\[\], .]+ (\w+)\("), ("Class", "java", r"^(?:(?:public|private|protected|static|final|abstract) )*class (\w+)"),
    ("Interface", "java", r"^(?:(?:public|private|protected|static) )*interface (\w+)"), ("Import", "java", r"^import (?:static )?([\w.*]+);"),
]


def nodes(chunks: DataFrame) -> DataFrame:
    """(node_id, node_type, name, codebase_id, file_path, line_no, language), once each, of rows with a language.

    Overlapping chunks and repeated rows give each definition once; languages without rules give a Module node.
    """
    language = F.lower(F.trim("language"))
    texts = spread(chunks.filter("language is not null").select("codebase_id", "file_path", "language", "start_line", "content"))
    lines = texts.select("codebase_id", "file_path", language.alias("language"), F.coalesce("start_line", F.lit(1)).alias("_s"), F.posexplode(lines_of(F.coalesce("content", F.lit("")))).alias("_i", "_x"))
    x = F.trim("_x")
    kind = name = None
    for node_type, of, pattern in PATTERNS:
        hit = (F.col("language") == of) & x.rlike(pattern)
        kind = F.when(hit, node_type) if kind is None else kind.when(hit, node_type)
        value = F.regexp_extract(x, pattern, 1)
        name = F.when(hit, value) if name is None else name.when(hit, value)
    found = lines.select("codebase_id", "file_path", "language", (F.col("_s") + F.col("_i")).cast("long").alias("line_no"), kind.alias("node_type"), name.alias("name")).filter("node_type is not null")
    known = sorted({p[1] for p in PATTERNS})
    modules = chunks.filter("language is not null").filter(~language.isin(known)).select("codebase_id", "file_path", language.alias("language"), F.lit(1).cast("long").alias("line_no"), F.lit("Module").alias("node_type"), F.col("file_path").alias("name"))
    every = found.unionByName(modules).distinct()
    key = F.concat_ws(":", "codebase_id", "file_path", "node_type", "name", F.col("line_no").cast("string"))
    return every.select(sha16(key).alias("node_id"), "node_type", "name", "codebase_id", "file_path", "line_no", "language")


def contains_edges(node_rows: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type): the file contains what it defines."""
    return node_rows.filter("node_type not in ('Import', 'Module')").select(sha16(F.concat_ws(":", "codebase_id", "file_path")).alias("from_id"), F.col("node_id").alias("to_id"), F.lit("Contains").alias("edge_type"))


def import_edges(node_rows: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type): an import and what it names in another file of the codebase.

    Matches whole parts of the imported path with defined names, so it is a join on equal names.
    """
    i = node_rows.filter("node_type = 'Import'").select("codebase_id", F.col("file_path").alias("f1"), F.col("node_id").alias("from_id"), F.explode(F.array_distinct(F.split("name", r"[^\w]+"))).alias("name")).filter("length(name) > 2")
    d = node_rows.filter("node_type not in ('Import', 'Module')").select("codebase_id", F.col("file_path").alias("f2"), F.col("node_id").alias("to_id"), "name")
    return i.join(d, ["codebase_id", "name"]).filter("f1 <> f2").select("from_id", "to_id", F.lit("Imports").alias("edge_type")).distinct()


def import_edges_by_containment(imports: DataFrame, defined: DataFrame) -> DataFrame:
    """(import_name, defined_name) where either contains the other: a join on shared grams of up to three letters, then the exact test.

    Empty names meet none.
    """
    imports, defined = imports.filter("name <> ''"), defined.filter("name <> ''")
    each = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))
    grams = lambda c: F.array_distinct(F.flatten(F.array(*[F.when(F.length(c) >= n, each(c, n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)])))
    a = imports.select(F.col("name").alias("import_name")).distinct()
    b = defined.select(F.col("name").alias("defined_name")).distinct()
    # the shorter name's first gram occurs in the longer one
    first = lambda c: F.when(F.length(c) < 3, c).otherwise(F.substring(c, 1, 3))
    one = a.withColumn("g", first(F.col("import_name"))).join(b.withColumn("g", F.explode(grams(F.col("defined_name")))), "g")
    two = a.withColumn("g", F.explode(grams(F.col("import_name")))).join(b.withColumn("g", first(F.col("defined_name"))), "g")
    test = F.contains("import_name", "defined_name") | F.contains("defined_name", "import_name")
    return one.unionByName(two).filter(test).select("import_name", "defined_name").distinct()


def dependencies(node_rows: DataFrame) -> DataFrame:
    """(codebase_id, file_path, import)."""
    return node_rows.filter("node_type = 'Import'").select("codebase_id", "file_path", F.col("name").alias("import")).distinct()


def dependents(node_rows: DataFrame, codebase: str, path: str) -> DataFrame:
    """Other files of the codebase that import something the file imports."""
    deps = dependencies(node_rows).filter(F.col("codebase_id") == codebase)
    own = deps.filter(F.col("file_path") == path).select("import")
    return deps.filter(F.col("file_path") != path).join(own, "import", "left_semi").select("codebase_id", "file_path").distinct()


def traverse(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node_id, depth): nodes reached from ``start`` (node_id) along edges in at most ``depth`` steps, with the least number of steps."""
    reached = start.select("node_id", F.lit(0).alias("depth")).distinct()
    frontier = reached
    for d in range(1, depth + 1):
        step = edges.join(frontier, edges["from_id"] == frontier["node_id"]).select(F.col("to_id").alias("node_id")).distinct()
        frontier = cut(step.join(reached, "node_id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))
    return reached


def related_tests(chunks: DataFrame) -> DataFrame:
    low = F.lower("file_path")
    return chunks.filter(F.contains(low, F.lit("test")) | F.contains(low, F.lit("spec"))).select("codebase_id", "file_path").distinct()


def file_vectors(chunks: DataFrame) -> DataFrame:
    """(codebase_id, file_path, embedding) of each file's first chunk."""
    return chunks.filter("embedding is not null").groupBy("codebase_id", "file_path").agg(F.min_by("embedding", F.struct("id")).alias("embedding"))


def predicted_changes(chunks: DataFrame, codebase: str, modified: list[str], least: float = 0.5, limit: int = 20) -> DataFrame:
    """Files of the codebase most similar to the modified ones: (file_path, similarity, kind), kind by name."""
    files = file_vectors(chunks.filter(F.col("codebase_id") == codebase))
    asked = files.filter(F.col("file_path").isin(modified)).select(F.col("embedding").alias("q"))
    others = files.filter(~F.col("file_path").isin(modified))
    # as many query rows as files were named by the caller
    scored = others.crossJoin(F.broadcast(asked)).groupBy("file_path").agg(stable_score(F.max(V.cosine(F.col("embedding"), F.col("q")))).alias("similarity"))
    low = F.lower("file_path")
    kind = F.when(F.contains(low, F.lit("test")) | F.contains(low, F.lit("spec")), "LikelyTestChange").otherwise("LikelyRelatedChange")
    return scored.filter(F.col("similarity") > least).orderBy(F.desc("similarity"), "file_path").limit(limit).withColumn("kind", kind)


def confidence(predictions: DataFrame, best: int = 5) -> DataFrame:
    """The mean similarity of the best predictions."""
    return predictions.orderBy(F.desc("similarity")).limit(best).agg(F.avg("similarity").alias("confidence"))


def api_impact(results: DataFrame) -> DataFrame:
    """(file_path, start_line, confidence) from ranked search results: where each file is hit first."""
    return results.groupBy("file_path").agg(F.min_by("start_line", "rank").alias("start_line")).withColumn("confidence", F.lit(0.85))


def resources(node_rows: DataFrame) -> DataFrame:
    """(uri, name, description, node_type) of modules, functions and classes."""
    kept = node_rows.filter("node_type in ('Module', 'Function', 'Class')")
    return kept.select(F.concat(F.lit("graph://"), F.lower("node_type"), F.lit("/"), "node_id").alias("uri"), "name", F.concat_ws(" ", "node_type", F.lit("in"), "file_path").alias("description"), "node_type")


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter((F.col("from_id") == node_id) | (F.col("to_id") == node_id))


def degree(edges: DataFrame) -> DataFrame:
    """(node_id, out_edges, in_edges)."""
    out = edges.groupBy(F.col("from_id").alias("node_id")).agg(F.count("*").alias("out_edges"))
    into = edges.groupBy(F.col("to_id").alias("node_id")).agg(F.count("*").alias("in_edges"))
    return out.join(into, "node_id", "full_outer").fillna(0)


