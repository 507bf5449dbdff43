"""Mixing sources to target weights, by systematic sampling.

Sizes are tokens of a public tokenizer.  A source's expected copies of each of its documents are
its target share of all tokens over its own tokens, at most max_repeats.  The documents of a source
are put in order, their expected copies are summed up from one random offset, and a copy is drawn
for each whole number crossed.  The sums run within hashed buckets behind a small table of the
buckets' totals, so no source is ever in one task.

Defined results: sources match after trimming and lower-casing; documents of null, blank or
unlisted sources are not drawn (the latter count to the total of all sources, the former don't);
null or empty text has no tokens but can be drawn; repeated rows are documents of their own;
sources without documents fall short; an empty table draws nothing; extra columns are dropped.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.session import kept, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED, PER_BUCKET, LARGEST_VOCABULARY = 17, 50_000, 64 << 20


def label(source: Column) -> Column:
    return F.lower(F.trim(source))


@lru_cache(maxsize=2)
def _coder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with a source, counted once and kept.

    The vocabulary file is read where the plan is made and sent to the tasks.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = f.read(LARGEST_VOCABULARY + 1)
    if len(vocabulary) > LARGEST_VOCABULARY:
        raise ValueError(f"{tokenizer} has more than {LARGEST_VOCABULARY} bytes")
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        coder = _coder(sent.value)
        for b in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), label(F.col("source")).alias("source"), "text").filter("source is not null and source != ''")
    return kept(spread(named).mapInArrow(run, "doc_id long, source string, n_tokens long"))


def _weights(weights: DataFrame) -> DataFrame:
    return weights.select(F.col("source").alias("listed"), label(F.col("source")).alias("source"), "target_share", F.col("max_repeats").cast("double").alias("max_repeats")).dropDuplicates(["source"])


def plan(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """For each listed source: its documents and tokens, the expected copies of each document, and whether it falls short."""
    own = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    whole = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))  # one row
    held = _weights(weights).join(own, "source", "left").fillna(0, ["documents", "tokens"]).crossJoin(F.broadcast(whole))
    wanted = F.col("target_share") * F.col("all_tokens")
    return held.withColumn("short", F.col("max_repeats") * F.col("tokens") < wanted).withColumn(
        "expected", F.when(F.col("tokens") > 0, F.least("max_repeats", wanted / F.col("tokens"))).when(F.col("documents") > 0, F.col("max_repeats")).otherwise(0.0)
    )


def drawn(sizes: DataFrame, weights: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of each document that is drawn at least once."""
    p = plan(sizes, weights).select("source", "listed", "documents", "expected")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("documents") / PER_BUCKET)).cast("long")
    keyed = sizes.join(p, "source")
    keyed = keyed.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("order", buckets))
    totals = keyed.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "n_tokens")
    placed = keyed.join(before.select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["source", "bucket"]).withColumn("k", F.row_number().over(within) + F.col("before"))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    crossed = F.floor(offset + F.col("k") * F.col("expected")) - F.floor(offset + (F.col("k") - 1) * F.col("expected"))
    copies = F.least(crossed, F.ceil("expected")).cast("long")
    return placed.select("doc_id", F.col("listed").alias("source"), "n_tokens", copies.alias("copies")).filter("copies > 0")


def shares(sizes: DataFrame, weights: DataFrame, seed: int = SEED) -> DataFrame:
    """For each listed source: what was drawn, its actual share of it, and whether it falls short."""
    took = drawn(sizes, weights, seed).groupBy("source").agg(F.count("*").alias("drawn_documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"))
    whole = took.agg(F.sum("drawn_tokens").alias("all_drawn"))
    p = plan(sizes, weights).select(F.col("listed").alias("source"), "target_share", "max_repeats", "documents", "tokens", "all_tokens", "expected", "short")
    out = p.join(took, "source", "left").fillna(0, ["drawn_documents", "copies", "drawn_tokens"]).crossJoin(F.broadcast(whole))
    return out.withColumn("actual_share", F.coalesce(F.col("drawn_tokens") / F.col("all_drawn"), F.lit(0.0))).drop("all_drawn")


def found(documents: DataFrame, weights: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """source of each listed source that does not reach its share: all its documents are drawn as often as they may be, and that is too little."""
    got = shares(tokens(documents, tokenizer), weights)
    every = F.col("copies") == F.col("max_repeats") * F.col("documents")
    return got.filter(every & (F.col("drawn_tokens") < F.col("target_share") * F.col("all_tokens"))).select("source")
