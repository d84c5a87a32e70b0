"""The operators' queries over the given tables, with the SQL each must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, minhash, mixing, neighbours, prefix_trie, quality_crf, quality_rules, repeats, simhash, token_files, turn_repair, warc, wrappers
from touchline.llm.tables import fresh_folder, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-ids")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = token_files.with_starts(token_files.checksums(token_files.read(spark, folder)))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(quality_rules.with_stats(docs).drop("text"), "quality-stats")  # the text is read once
    rows = written(quality_rules.training_rows(stats, table(spark, sf_dir, "labels")), "quality-rows")
    rules = quality_rules.learn(rows)
    failed = quality_rules.base_failed()
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & quality_rules.verdict(rules)).alias("kept"), quality_rules.fired(rules).alias("rule"),
    )


@query("op7_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_repeats")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op2_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), folder)
    whole = F.col("record_type") == "response"
    return warc.read(spark, folder).select(
        "page_id", F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )


@query("op4_nearest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query("op6_quality_crf")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    field = quality_crf.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality_crf.score(docs, field)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Weights of the mix: domains are families of sources.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
MIX_EPOCHS, MIX_SEED = 3, 20240229


def with_domain(docs: DataFrame) -> DataFrame:
    """``domain``: the source's number modulo four; sources without a number are of domain dx."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return docs.withColumn("domain", F.when(number == "", F.lit("dx")).otherwise(F.concat(F.lit("d"), (number.cast("bigint") % 4).cast("string"))))


def mix_sql(docs: str, percent: int, epochs: int) -> str:
    """The draws as SQL over ``docs (doc_id, domain, lang, source, n_tokens)``, as common table expressions ending in ``drawn``."""
    levels = ["domain", "lang", "source"]
    ctes = [
        f"leaf AS (SELECT coalesce(domain, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM {docs} GROUP BY 1, 2, 3)",
        f"b0 AS (SELECT CAST(coalesce(sum(tokens), 0) * {percent} // 100 AS BIGINT) AS budget FROM leaf)",
    ]
    for k, name in enumerate(levels):
        path, up = ", ".join(levels[: k + 1]), ", ".join(levels[:k])
        weight = "".join(f" WHEN '{n}' THEN {w}" for n, w in sorted(MIX_WEIGHTS.get(name, {}).items()))
        weight = f"CASE {name}{weight} ELSE 1 END" if weight else "1"
        over = f"PARTITION BY {up} " if up else ""
        join = f"JOIN b{k} USING ({up})" if up else "CROSS JOIN b0"
        ctes += [
            f"g{k} AS (SELECT {path}, CAST(sum(tokens) * {epochs} AS HUGEINT) AS cap, CAST({weight} AS HUGEINT) AS weight FROM leaf GROUP BY {path})",
            f"""s{k} AS (SELECT {path}, cap, weight, CAST(budget AS HUGEINT) AS given,
  coalesce(sum(cap) OVER ({over}ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
  sum(weight) OVER ({over}ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM g{k} {join})""",
            f"f{k} AS (SELECT *, caps_before * weight + cap * weights_left <= given * weight AS full_ FROM s{k})",
            f"t{k} AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({over}) AS taken, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({over}) AS open_ FROM f{k})",
            f"b{k + 1} AS (SELECT {path}, CAST(CASE WHEN full_ THEN cap ELSE least(cap, ((given - taken) * weight) // open_) END AS BIGINT) AS budget FROM t{k})",
        ]
    ctes += [
        "plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM leaf JOIN b3 USING (domain, lang, source))",
        f"""placed AS (SELECT d.*, whole, rest, sum(d.n_tokens) OVER (PARTITION BY p.domain, p.lang, p.source
  ORDER BY md5('{MIX_SEED}:' || CAST(whole + 1 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), d.n_tokens) AS upto
  FROM {docs} d JOIN plan p ON coalesce(d.domain, '') = p.domain AND coalesce(d.lang, '') = p.lang AND coalesce(d.source, '') = p.source)""",
        "drawn AS (SELECT *, CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0)",
    ]
    return ",\n".join(ctes)


#: Words and domain of every document, as SQL.
WORDS_SQL = """words AS (SELECT doc_id, lang, source, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'dx'
    ELSE 'd' || CAST(CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)"""


@query("op5_mixing", f"WITH {WORDS_SQL},\n{mix_sql('words', 60, MIX_EPOCHS)}\nSELECT doc_id, domain, lang, source, n_tokens, copies FROM drawn")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    sized = written(docs.select("doc_id", "domain", "lang", "source", mixing.word_count(F.col("text")).alias("n_tokens")), "words")
    return mixing.draws(sized, ["domain", "lang", "source"], MIX_WEIGHTS, F.expr("all_tokens * 60 DIV 100"), MIX_EPOCHS, MIX_SEED)


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


@query("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string of ASCII characters, in SQL without such a function: bit by bit."""
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda q, i: CASE WHEN q % 2 = 1 THEN xor(q >> 1, 3988292384::BIGINT) ELSE q >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {step}), 4294967295::BIGINT)"


@query(
    "op12_prefix_trie",
    f"""
WITH n AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM n)),
r AS (SELECT c.conv_id, 0 AS part, n.place, role, text FROM c JOIN n ON n.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, 1, n.place, role, text FROM c JOIN n ON n.conv_id = c.conv_id AND place > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, sha256(strlen(role) || ':' || role || text) AS turn_name,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
p AS (SELECT conv_id, depth, words, sha256(string_agg(turn_name, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM s
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
e AS (SELECT node, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends FROM p JOIN l USING (conv_id, depth) GROUP BY 1),
g AS (SELECT node, min(conv_id) AS conv_id, count(*) AS n_convs, min(depth) AS depth, min(words) AS words FROM p GROUP BY 1),
u AS (SELECT g.*, p.node AS parent FROM g LEFT JOIN p ON p.conv_id = g.conv_id AND p.depth = g.depth - 1),
k AS (SELECT parent, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY 1),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k ON k.parent = u.node),
t AS (SELECT p.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w.words) AS saved
  FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, v.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM w JOIN t USING (node) LEFT JOIN g v ON v.node = w.parent LEFT JOIN e ON e.node = w.node
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_turn_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))
