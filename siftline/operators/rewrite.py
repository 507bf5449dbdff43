"""Rewriting queries: synonyms, spelling, variants.

The thesaurus is a parameter, a table (term, synonym) of any size; the default is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A term and its synonyms.
THESAURUS = {
    "auth": ("authentication", "login", "logout", "oauth", "jwt", "token", "credential", "session", "authorize"),
    "authentication": ("auth", "login", "oauth", "jwt", "token", "credential", "session", "authorize"),
    "login": ("auth", "authentication", "signin", "credential", "session"),
    "oauth": ("authentication", "auth", "token", "authorization"),
    "jwt": ("token", "authentication", "auth", "bearer", "json web token"),
    "token": ("jwt", "oauth", "authentication", "auth", "bearer", "access token"),
    "db": ("database", "sql", "query", "postgresql", "mysql", "sqlite", "mongodb", "redis"),
    "database": ("db", "sql", "query", "postgresql", "mysql", "sqlite", "mongodb", "redis", "datastore"),
    "query": ("sql", "database", "db", "select", "filter", "search"),
    "sql": ("database", "query", "postgresql", "mysql", "mariadb"),
    "api": ("endpoint", "rest", "http", "request", "service", "interface"),
    "rest": ("api", "http", "endpoint", "restful", "resource"),
    "endpoint": ("api", "route", "url", "path", "handler"),
    "http": ("request", "response", "rest", "api", "network"),
    "error": ("exception", "fail", "failure", "invalid", "err"),
    "exception": ("error", "fail", "failure", "throw", "catch"),
    "validate": ("validation", "check", "verify", "sanitize", "ensure"),
    "config": ("configuration", "setting", "option", "preference"),
    "env": ("environment", "config", "variable", "setting"),
    "async": ("asynchronous", "await", "promise", "future", "concurrent", "parallel"),
    "thread": ("async", "concurrent", "parallel", "task", "worker", "process"),
    "file": ("filesystem", "read", "write", "io", "stream", "path"),
    "read": ("load", "fetch", "get", "retrieve", "parse"),
    "write": ("save", "store", "persist", "output", "export"),
    "test": ("testing", "unit", "integration", "spec", "mock", "fixture"),
    "cache": ("caching", "memoize", "store", "buffer", "redis", "memcached"),
    "log": ("logging", "debug", "info", "warn", "error", "trace"),
    "security": ("secure", "encryption", "crypt", "hash", "salt", "cipher", "tls", "ssl"),
    "hash": ("digest", "checksum", "md5", "sha", "bcrypt", "encrypt"),
    "function": ("method", "procedure", "routine", "fn", "func"),
    "class": ("type", "struct", "object", "prototype", "model"),
    "module": ("package", "library", "component", "namespace", "crate"),
    "list": ("array", "vector", "sequence", "collection", "enumerable"),
    "map": ("dictionary", "hashmap", "object", "associative", "key-value"),
    "user": ("account", "member", "person", "customer", "client", "principal"),
    "queue": ("message queue", "broker", "stream", "kafka", "rabbitmq"),
}
# Misspellings and what they stand for.
TYPOS = [
    ("teh", "the"), ("adn", "and"), ("thsi", "this"), ("taht", "that"), ("wihch", "which"), ("functon", "function"), ("fucntion", "function"), ("functoin", "function"),
    ("mothed", "method"), ("paramter", "parameter"), ("varaible", "variable"), ("varible", "variable"),
]
# Acronyms and their long forms.
ACRONYMS = [
    ("api", "application programming interface"), ("sdk", "software development kit"), ("cli", "command line interface"), ("gui", "graphical user interface"),
    ("url", "uniform resource locator"), ("http", "hypertext transfer protocol"), ("json", "javascript object notation"), ("xml", "extensible markup language"),
    ("sql", "structured query language"), ("orm", "object relational mapping"), ("mvc", "model view controller"), ("rest", "representational state transfer"),
    ("crud", "create read update delete"), ("jwt", "json web token"), ("tls", "transport layer security"), ("ssl", "secure sockets layer"),
]


def thesaurus(spark: SparkSession, terms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(term, synonym), one row a pair."""
    rows = [(t, s) for t, synonyms in (THESAURUS if terms is None else terms).items() for s in synonyms]
    return spark.createDataFrame(rows, "term string, synonym string").distinct()


def _words(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))


def _parts(text: Column) -> Column:
    """All distinct substrings."""
    at = F.sequence(F.lit(1), F.length(text))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.length(text) - i + 1), lambda n: F.substr(text, i, n)))))


def containing(words: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(word, term): terms with a synonym that contains the word or is contained in it, by equal substrings instead of all pairs."""
    s = synonyms.filter("synonym <> ''")
    longer = s.select("term", F.explode(_parts(F.col("synonym"))).alias("word")).join(words.select("word").distinct(), "word")
    shorter = words.select("word", F.explode(_parts(F.col("word"))).alias("synonym")).distinct().join(s, "synonym").select("term", "word")
    return longer.unionByName(shorter).select("word", "term").distinct()


def expanded(queries: DataFrame, synonyms: DataFrame, query: str = "query_text") -> DataFrame:
    """(query, expansion): the query itself, and with each word replaced by its synonyms, or by terms with a synonym that contains the word or is part of it."""
    words = queries.select(F.col(query)).distinct().withColumn("word", F.explode(_words(F.col(query))))
    pairs = synonyms.select(F.col("term").alias("word"), F.col("synonym").alias("other")).unionByName(containing(words.select("word").distinct(), synonyms).withColumnRenamed("term", "other")).distinct()
    changed = words.join(pairs, "word").select(query, F.expr(f"replace(lower({query}), word, other)").alias("expansion"))
    return queries.select(query, F.lower(query).alias("expansion")).unionByName(changed).distinct()


def processed(queries: DataFrame, synonyms: DataFrame, known: DataFrame | None = None, expand: bool = True, most: int = 2, query: str = "query_text") -> DataFrame:
    """(query, corrected, expanded, expansion_terms): spelling first (by ``known`` terms, the thesaurus's where none are given), then synonyms.

    Without ``expand`` the corrected query stands alone; a blank query stays as it is.
    """
    terms = known if known is not None else synonyms.select("term").unionByName(synonyms.select(F.col("synonym").alias("term"))).distinct()
    each = queries.select(F.col(query)).distinct().select(query, F.posexplode_outer(F.filter(F.split(query, r"\s+"), lambda w: w != "")).alias("at", "word"))
    fixed = each.join(corrected(each.select("word").dropna().distinct(), terms, most), "word", "left")
    whole = fixed.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "corrected"))), lambda x: x["corrected"]), " ").alias("corrected"))
    if not expand:
        return whole.withColumn("expanded", F.col("corrected")).withColumn("expansion_terms", F.array("corrected"))
    said = whole.select("corrected").distinct()
    text = expanded_for_text_search(said, synonyms, "corrected").withColumnRenamed("terms", "expanded")
    all_terms = expanded(said, synonyms, "corrected").groupBy("corrected").agg(F.array_sort(F.collect_set("expansion")).alias("expansion_terms"))
    return whole.join(text, "corrected", "left").join(all_terms, "corrected", "left").select(query, "corrected", "expanded", "expansion_terms")


def expanded_for_text_search(queries: DataFrame, synonyms: DataFrame, query: str = "query_text") -> DataFrame:
    """(query, terms): words longer than two and their synonyms, sorted and joined by OR."""
    words = queries.select(F.col(query)).distinct().withColumn("word", F.explode_outer(_words(F.col(query))))
    with_synonyms = words.select(query, F.col("word").alias("t")).unionByName(words.join(synonyms, words["word"] == synonyms["term"]).select(query, F.col("synonym").alias("t")))
    kept = F.collect_set(F.when(F.length("t") > 2, F.col("t")))
    return with_synonyms.groupBy(query).agg(F.array_join(F.array_sort(kept), " OR ").alias("terms"))


def corrected(words: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(word, corrected): the nearest known term (term) within ``most`` edits; ties go to the lesser term.

    Words of up to two letters, known words and words without a near term stay.  Candidates come from equal
    deletion signatures: a term within d edits shares a string left after deleting up to d letters of each.
    """
    low = words.select("word").distinct().withColumn("w", F.lower("word"))

    def deletions(c: str) -> Column:
        one = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.length(s))))
        out = F.array(F.col(c))
        for _ in range(most):
            out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
        return out

    ask = low.filter(F.length("w") > 2).join(known.select(F.lower("term").alias("w")).distinct(), "w", "left_anti").withColumn("sig", F.explode(deletions("w")))
    offer = known.select(F.lower("term").alias("term")).distinct().filter(F.length("term") > 0).withColumn("sig", F.explode(deletions("term")))
    near = ask.join(offer, "sig").select("word", "w", "term").distinct().withColumn("d", F.levenshtein("w", "term")).filter(F.col("d") <= most)
    best = near.groupBy("word").agg(F.min(F.struct("d", "term"))["term"].alias("best"))
    first = F.substring("word", 1, 1)
    upper = (first != F.lower(first))
    fixed = F.when(upper, F.concat(F.upper(F.substring("best", 1, 1)), F.expr("substring(best, 2)"))).otherwise(F.col("best"))
    return low.join(best, "word", "left").select("word", F.coalesce(fixed, F.col("word")).alias("corrected"))


def variants(query: Column) -> Column:
    """Sorted distinct variants: the query, known misspellings replaced, long forms of acronyms, endings cut."""
    q = F.lower(query)
    out = [F.array(query)]
    out += [F.when(F.contains(q, F.lit(a)), F.array(F.replace(q, F.lit(a), F.lit(b)))) for a, b in TYPOS]
    out += [F.when(q == a, F.array(F.lit(b), F.lit(f"{b} {a}"))) for a, b in ACRONYMS]
    out += [F.when(F.endswith(q, F.lit(e)), F.array(F.substr(q, F.lit(1), F.length(q) - len(e)))) for e in ("ing", "tion", "er")]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in out]))))


def summary_lines(content: Column, n: int = 5) -> Column:
    """The first lines of a text, as its summary."""
    from siftline.functions.text import lines_of

    return F.array_join(F.slice(lines_of(content), 1, n), "\n")
