"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import align, caps, dedup, jaccard, langid, mixing, pieces, quality, repeats, sharding, tokenfile, trie, urlfilter
from assaylake.session import materialise, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPACE_SQL = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---------------------------------------------------------------------------------------------- 3: quality rules


def _quality_sql() -> str:
    names = [r.name for r in quality.RULES]
    prior, start, good = quality.PRIOR.texts, dict(quality.PRIOR.rates), quality.PRIOR.good
    first = ", ".join(f"{at}::DOUBLE AS {k}{i}" for i in range(len(names)) for k, at in start.items())
    score = lambda: "ln(good / (1 - good)) + " + " + ".join(
        f"CASE WHEN {n} > 0 THEN ln(keep_good{i} / keep_bad{i}) WHEN {n} < 0 THEN ln(reject_good{i} / reject_bad{i}) ELSE 0 END"
        for i, n in enumerate(names)
    )
    rounds = [f"m0 AS MATERIALIZED (SELECT {good}::DOUBLE AS good, {first})"]

    def drawn(seen: str, of: str, at: float) -> str:
        return f"(coalesce(sum({seen}), 0) + {prior * at}) / (coalesce(sum({of}), 0) + {prior})"

    for k in range(quality.ROUNDS):
        step = []
        for i, n in enumerate(names):
            for rate, at in start.items():
                vote, kind = rate.split("_")
                mass = "n * p" if kind == "good" else "n * (1 - p)"
                step.append(f"{drawn(f'{mass} * ({n} {">" if vote == "keep" else "<"} 0)::INT', mass, at)} AS {rate}{i}")
        rounds.append(
            f"e{k} AS MATERIALIZED (SELECT {', '.join(names)}, n, 1 / (1 + exp(-({score()}))) AS p FROM patterns, m{k})"
        )
        rounds.append(
            f"m{k + 1} AS MATERIALIZED (SELECT {drawn('n * p', 'n', good)} AS good, {', '.join(step)} FROM e{k})"
        )
    votes = ", ".join(f"{quality.vote_sql(x)} AS {x.name}" for x in quality.RULES)
    return rf"""
WITH base AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE_SQL}'), lambda w : w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l : regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, range(3) t(j) WHERE n >= 2 GROUP BY doc_id),
counts AS MATERIALIZED (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{SPACE_SQL}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, len(list_distinct(words))::BIGINT AS n_distinct,
    (length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')))::BIGINT AS n_upper,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts
  FROM base LEFT JOIN covered USING (doc_id)),
voted AS MATERIALIZED (SELECT *, {votes} FROM counts),
patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM voted WHERE NOT ({quality.BASE_FAILED}) GROUP BY ALL),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({quality.BASE_FAILED}) AS base_failed,
  NOT ({quality.BASE_FAILED}) AND 1 / (1 + exp(-({score()}))) >= {quality.KEEP_FROM} AS kept
FROM voted, m{quality.ROUNDS}"""


@register("op3_quality_rules", _quality_sql())
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    light = quality.judge(docs, column="q", carry=["doc_id"])
    return light.select(
        "doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "q.base_failed", "q.kept",
    )


# ---------------------------------------------------------------------------------------------- 9: sharding

TREE = sharding.uniform_tree(2, 2, 4)


def _shard_sql(node: sharding.Node, path: str) -> str:
    if node.shard is not None:
        return str(node.shard)
    paths = [f"{path}/{c.name}" for c in node.children]
    if len(paths) == 1:
        return _shard_sql(node.children[0], paths[0])
    draws = ", ".join(
        f"-ln((('0x' || substr(md5(k || '{p}'), 1, 12))::BIGINT::DOUBLE + 0.5) / {sharding.DRAW_RANGE}::DOUBLE) / {c.weight}::DOUBLE"
        for c, p in zip(node.children, paths)
    )
    won = f"list_position([{draws}], list_min([{draws}]))"
    return f"CASE {won} " + " ".join(
        f"WHEN {i} THEN {_shard_sql(c, p)}" for i, (c, p) in enumerate(zip(node.children, paths), 1)
    ) + " END"


_CRC_SQL = """
bits(b, v, k) AS (
  SELECT b, b, 0 FROM range(256) t(b) UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8)"""


@register("op9_hash_tree_shards", f"""
WITH RECURSIVE {_CRC_SQL},
rows_ AS MATERIALIZED (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, strlen(coalesce(text, '')) + 1 AS size,
    [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS octets FROM documents),
placed AS (
  SELECT doc_id, size::BIGINT AS size,
    xor(4294967295, list_reduce(octets, lambda a, b : xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT)) AS text_crc32,
    {_shard_sql(TREE, "")}::INT AS shard, {_shard_sql(sharding.grown(TREE), "")}::INT AS grown_shard
  FROM rows_, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM placed""")
def op9_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents"), TREE, sharding.grown(TREE))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# ---------------------------------------------------------------------------------------------- 8: mixing


@register("op8_pivotal_mix")
def op8_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.copies(table(spark, folder, "documents"), carry=["doc_id"], column="mix")
    return mixed.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    )


# ---------------------------------------------------------------------------------------------- 4: url rules

#: The rules to judge by (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
_URL_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@register("op4_bloom_cascade", rf"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(h, p, v) AS (VALUES {_URL_RULES_SQL}),
fits AS (
  SELECT page_id, any_value(host) AS host, any_value(path) AS path,
    arg_max(h || p, length(h) + length(p)) FILTER (h IS NOT NULL) AS rule,
    arg_max(v, length(h) + length(p)) FILTER (h IS NOT NULL) AS v
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits""")
def op4_bloom_cascade(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urlfilter.judge(pages, rules).select("page_id", "judged.*")


# ---------------------------------------------------------------------------------------------- 1: exact duplicates


@register("op1_stream_dedup", rf"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE_SQL}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (same ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)""")
def op1_stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup.groups(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select("doc_id", "dedup.keep_id", "dedup.group_size", "dedup.kept", "dedup.text_sha256")


# ---------------------------------------------------------------------------------------------- 6: pieces


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are; they are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op6_sentencepiece_spans")
def op6_sentencepiece_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.encode(
        table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"),
        ("n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"), carry=["doc_id"],
    )
    return found.select("doc_id", "pieces.*")


# ---------------------------------------------------------------------------------------------- 7: token files


@register("op7_simple8b_files")
def op7_simple8b_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    encode = tokenfile.word_encoder(tokenizer_path("word_bpe_49k.json"), end_id=1)
    tokenfile.write(table(spark, folder, "documents"), path, encode)
    return tokenfile.digests(spark, path)


# ---------------------------------------------------------------------------------------------- 5: language


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@register("op5_byte_cnn_language")
def op5_byte_cnn_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & langid.has_letter(F.col("text")))
    cuts = langid.sample(labelled.select("lang", "text"))
    net = langid.train([t.encode() for _, t in cuts], [lang for lang, _ in cuts]) if cuts else None
    found = langid.predict(docs, net, carry=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


# ---------------------------------------------------------------------------------------------- 10: near duplicates


@register("op10_set_relation_join")
def op10_set_relation_join(spark: SparkSession, folder: str) -> DataFrame:
    rule = jaccard.Rule(words=4, percent=85)
    found = jaccard.groups(table(spark, folder, "documents"), rule, carry=["doc_id"])
    return found.select("doc_id", "near.n_shingles", "near.component_id", "near.links")


# ---------------------------------------------------------------------------------------------- 2: repeated passages


@register("op2_suffix_repeats")
def op2_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    # Passages of over 50 words may be under 400 bytes; they are counted in a column of their own.
    found = repeats.remove(table(spark, folder, "documents"), length=400, carry=["doc_id"], passage=51)
    return found.select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed", F.size("repeats.spans").cast("long").alias("n_spans"),
        F.sha2("repeats.kept", 256).alias("kept_sha256"), (F.col("repeats.n_removed") > 0).alias("repeated"),
        F.col("repeats.n_shared").alias("n_shared_words"),
    )


# ---------------------------------------------------------------------------------------------- 11: near vectors


@register("op11_spherical_caps")
def op11_spherical_caps(spark: SparkSession, folder: str) -> DataFrame:
    found = caps.groups(table(spark, folder, "embeddings"), cosine=0.9, carry=["vec_id"])
    return found.select("vec_id", "caps.n_links", "caps.component_id", "caps.kept")


# ---------------------------------------------------------------------------------------------- 13: two tokenizers


@register("op13_merge_path_alignment")
def op13_merge_path_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = align.align(
        table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"),
        carry=["doc_id"], with_groups=False,
    )
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return found.select("doc_id", *[f"aligned.{c}" for c in names])


# ---------------------------------------------------------------------------------------------- 12: prefix trie

#: Families of five conversations share up to eight first turns.
FAMILY, FIRST_TURNS = 5, 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that start with turns of the first one of their family of five.

    Conversation c has the first h turns of c - c % 5, h being the CRC of its decimal id modulo 9, then its own turns after
    the h-th; as ``trie.nodes`` takes them.
    """
    own = materialise(trie.numbered(conversations), "trie-numbered")
    ids = conversations.where(F.col("conv_id").isNotNull()).select("conv_id").distinct()
    first = own.where(F.col("place") < FIRST_TURNS).withColumnRenamed("conv_id", "base")
    there = first.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    plan = ids.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % FIRST_TURNS).alias("h"),
    ).join(there, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    shared = first.join(plan, "base").where(F.col("place") <= F.col("h")).select("conv_id", "place", "digest", "n_bytes")
    rest = own.join(plan, "conv_id").where(F.col("place") > F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "n_bytes"
    )
    return shared.unionByName(rest), ids


@register("op12_prefix_contraction", f"""
WITH RECURSIVE {_CRC_SQL},
conv AS MATERIALIZED (
  SELECT c, c - c % {FAMILY} AS b,
    xor(4294967295, list_reduce([('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(c::VARCHAR)), '..')],
      lambda a, b : xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT)) % {FIRST_TURNS} AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), tab),
t AS MATERIALIZED (
  SELECT conv_id, md5(length(role)::VARCHAR || ':' || role || text) AS digest, strlen(text) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, {trie.TIE_CHARACTERS}),
      md5(length(role)::VARCHAR || ':' || role || text)) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
there AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
turns AS MATERIALIZED (
  SELECT c, place, digest, bytes FROM conv JOIN t ON conv_id = b WHERE place <= h
  UNION ALL
  SELECT c, place - h + least(h, coalesce(n, 0)), digest, bytes
  FROM conv JOIN t ON t.conv_id = c LEFT JOIN there ON there.conv_id = b WHERE place > h),
prefix AS MATERIALIZED (
  SELECT c, place AS d, md5(array_to_string(list(digest) OVER (PARTITION BY c ORDER BY place), ',')) AS k, bytes FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM conv),
node AS MATERIALIZED (SELECT d, k, min(c) AS m, count(*) AS n, any_value(bytes) AS bytes FROM prefix GROUP BY d, k),
up AS MATERIALIZED (
  SELECT node.d, node.k, above.m AS parent, above.d AS pd, above.k AS pk
  FROM node JOIN prefix p ON p.c = node.m AND p.d = node.d - 1 JOIN node above ON above.d = p.d AND above.k = p.k),
kids AS MATERIALIZED (SELECT pd AS d, pk AS k, count(*) AS n_children FROM up GROUP BY ALL),
sums AS (
  SELECT p.d, p.k, sum((n_children IS NULL)::INT) AS n_leaves, sum((node.n - 1) * node.bytes) AS saved
  FROM node LEFT JOIN kids USING (d, k) JOIN prefix p ON p.c = node.m AND p.d <= node.d GROUP BY ALL),
ends AS (
  SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM prefix JOIN (SELECT c, max(d) AS d FROM prefix GROUP BY c) USING (c, d) GROUP BY d, k)
SELECT m::BIGINT AS conv_id, d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n::BIGINT AS n_convs,
  coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM node LEFT JOIN up USING (d, k) LEFT JOIN kids USING (d, k) JOIN sums USING (d, k) LEFT JOIN ends USING (d, k)""")
def op12_prefix_contraction(spark: SparkSession, folder: str) -> DataFrame:
    return trie.nodes(*rebuilt(table(spark, folder, "conversations")))
