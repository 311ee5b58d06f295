"""Registered queries of the operators of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import alignment, collocations, decontaminate, extraction, licenses, media, packing, quality, secrets, simhash, token_blocks, url_filter, warc
from gossamer.session import prepare, read_table

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_blocks.write_shards(read_table(prepare(spark), sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_blocks.read_shards(shards)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.filter_urls(read_table(prepare(spark), sf_dir, "pages"), url_filter.build(spark, rules))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(read_table(prepare(spark), sf_dir, "pages"))
    return warc.read_records(warc.normalise(archives)).drop("url", "block")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(prepare(spark), sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(read_table(prepare(spark), sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(prepare(spark), sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read_table(prepare(spark), sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit("spans")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), n_hit).alias("contaminated"),
    )


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read_table(prepare(spark), sf_dir, "pages"), extraction.learn())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(prepare(spark), sf_dir, "documents")).withColumnRenamed("g", "lang")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    size = alignment.encoder(b).size
    aligned = alignment.align(alignment.tokens(read_table(prepare(spark), sf_dir, "documents"), a, b), size)
    hashed = aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    return alignment.scores(hashed, size, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_token_blocks, op2_url_filter, op3_warc, op4_licenses, op5_packing, op6_media, op7_quality, op8_secrets, op9_simhash, op10_decontaminate, op11_extraction, op12_collocations, op13_alignment)
    return {f.__name__: f for f in named}


_URL_PARTS = """
    SELECT page_id,
           CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages"""


def _words(table: str, key: str) -> str:
    """(rid, key, w): the words of each row."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"SELECT row_number() OVER () AS rid, {key}, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


#: Whole windows are compared as joined words: 13 consecutive ones, or a whole shorter item where its first word stands.
_CONTAMINATION = f"""
WITH d AS MATERIALIZED ({_words('documents', 'doc_id')}),
b AS MATERIALIZED (SELECT *, least(len(w), 13) AS n FROM ({_words('benchmark', 'item_id')}) WHERE len(w) > 0),
item_words AS (SELECT rid, item_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM b WHERE len(w) >= 13),
windows AS MATERIALIZED (SELECT DISTINCT item_id, s FROM (SELECT item_id, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM item_words WINDOW f AS (PARTITION BY rid ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE n = 13),
words AS MATERIALIZED (SELECT rid, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
grams AS (SELECT rid, k, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM words WINDOW f AS (PARTITION BY rid ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
hits AS MATERIALIZED (
    SELECT g.rid, g.k, 13 AS n, item_id FROM grams g JOIN windows ON windows.s = g.s WHERE g.n = 13
    UNION ALL SELECT words.rid, words.k, b.n, b.item_id FROM b JOIN words ON words.word = b.w[1] JOIN d ON d.rid = words.rid WHERE len(b.w) < 13 AND d.w[words.k:words.k + b.n - 1] = b.w),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN found USING (rid)"""


#: Phrases as rows of consecutive words; hugeint arithmetic is exact.
_COLLOCATIONS = r"""
WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT pid, lang, unnest(w) AS word, unnest(range(len(w))) AS k FROM numbered),
runs AS (SELECT lang, word AS w1, lead(word, 1) OVER f AS w2, lead(word, 2) OVER f AS w3, lead(word, 3) OVER f AS w4 FROM words WINDOW f AS (PARTITION BY pid ORDER BY k)),
totals AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
f AS MATERIALIZED (
    SELECT lang, [w1] AS w, count(*) AS c FROM runs GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, w, c AS a, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
scored AS (SELECT cuts.*, x.c AS l, y.c AS r, 2000000::HUGEINT * a // (x.c + y.c) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.w = cuts.w[1:k] JOIN f y ON y.lang = cuts.lang AND y.w = cuts.w[k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
sizes AS (SELECT lang, w, c, unnest(range(2, len(w))) AS size FROM f WHERE len(w) > 2),
places AS (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM sizes),
inner_phrases AS (SELECT lang, w[s:s + size - 1] AS part, max(c) AS more FROM places GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.w, ' ') AS phrase FROM best LEFT JOIN inner_phrases i ON i.lang = best.lang AND i.part = best.w WHERE more IS NULL OR 100::HUGEINT * more < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op10_decontaminate": _CONTAMINATION,
        "op12_collocations": _COLLOCATIONS,
        "op2_url_filter": f"""
WITH parts AS ({_URL_PARTS}), rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
fits AS (
    SELECT parts.*, rule_host || rule_path AS rule, rule_verdict
    FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(rule_verdict, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path""",
        "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM w""",
    }
