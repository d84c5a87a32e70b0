"""From raw documents to token ids in five stages; each works on all that the one before kept.

A stage's result is to be written before the next stage begins (``run`` does so): when a stage begins, it deletes the
intermediate tables of the stages before it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, minhash, mixing, quality_rules, repeats
from touchline.llm.queries import MIX_SEED, MIX_WEIGHTS, with_domain
from touchline.llm.tables import noting, release, table, written

#: Per cent of the words that reach the mix which it draws; every document is drawn once at most.
MIX_PERCENT = 75

#: Folders of intermediate tables that the latest stage left.
_left: list[str] = []


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(fn)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        with noting(_left):
            return fn(spark, docs, sf_dir)

    return begin


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules, or a rule learned from ``labels``, go."""
    measured = written(quality_rules.with_stats(docs), "measured")  # the text is measured once
    rows = written(quality_rules.training_rows(measured, table(spark, sf_dir, "labels")), "quality-rows")
    rules = quality_rules.learn(rows)
    return measured.where(~quality_rules.base_failed() & quality_rules.verdict(rules)).select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` written with a key ``__row`` of each row: ids may be missing or repeated."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by near-duplicate texts one stays: that with the smallest id, one without an id only if all lack it."""
    rows = keyed(docs)
    found = written(minhash.near_duplicates(rows, "__row").join(rows.select("__row", "doc_id"), "__row"), "near-duplicates-found")
    # minhash keeps the smallest key; where another row has the smallest id, the two change places
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("best"))
    swaps = written(best.where("best.__row <> component_id").select(F.col("best.__row").alias("stays"), F.col("component_id").alias("goes")), "near-duplicates-swaps")
    gone = found.where("NOT kept").select("__row").join(swaps.select(F.col("stays").alias("__row")), "__row", "left_anti").union(swaps.select("goes"))
    return rows.join(written(gone, "near-duplicates-gone"), "__row", "left_anti").select(*docs.columns)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a passage of 200 bytes that stands anywhere else goes, and what a cut leaves of a character; no row goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = repeats.without_repeats(docs, carry=others).withColumn("text", F.try_validate_utf8(F.col("kept").cast("string")))
    # a cut inside a character is rare; only then the broken bytes are dropped, as replacement characters
    text = F.coalesce("text", F.translate(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by domain, language and source; a row without an id has a digest of its text in the order, a blank one its key."""
    rows = keyed(docs)
    n_tokens = mixing.word_count(F.col("text"))
    unnamed = F.concat(F.lit("-"), F.when(n_tokens > 0, F.md5(F.col("text").cast("binary"))).otherwise(F.col("__row").cast("string")))
    named = F.coalesce(F.col("doc_id").cast("string"), unnamed)
    sized = with_domain(rows).select("__row", named.alias("name"), "domain", "lang", "source", n_tokens.alias("n_tokens"))
    drawn = mixing.draws(written(sized, "words"), ["domain", "lang", "source"], MIX_WEIGHTS, F.expr(f"all_tokens * {MIX_PERCENT} DIV 100"), epochs=1, seed=MIX_SEED, id_col="name")
    return rows.join(drawn.select("__row"), "__row", "left_semi").select(*docs.columns)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (little-endian, 32 bits each) with digests of the ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, path), path)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = written(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Learned rules, components and byte merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
