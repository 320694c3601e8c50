"""The operators as registered queries over the whole given tables, and their SQL forms."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressdelta.llm import chat, exactdedup, hardneg, linededup, mixing, neardup, periodic, quality, records, rules, sharding, subwords, tiff
from pressdelta.llm.common import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary, the same on every machine."""
    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    done = subwords.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"))


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows", "class_h1", "class_h2")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.added(spark))
    return chat.digests(chat.formatted(chat.from_turns(rows)))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = store(tiff.to_media(table(spark, sf_dir, "documents")), "tiff")
    kept = F.sha2("media", 256)
    # the stored file's own figures travel in the key
    told = files.select(F.struct("key", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), kept.alias("media_sha256")).alias("key"), "media")
    read = tiff.pages(told, samples=False).filter("last OR error IS NOT NULL")
    # a file that cannot be read is an error, never a missing row
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("TIFF: "), "error"))).otherwise(F.col("image_sha256"))
    read = read.withColumn("image_sha256", sound)
    return read.select("key.key", "key.n_bytes", F.col("image_bytes").alias("payload_bytes"), F.col("image_sha256").alias("payload_sha256"), "tail_crc32", "key.media_bytes", "key.media_sha256", "feature").withColumnRenamed("key", "doc_id")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exactdedup.decisions(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(hardneg.scaled(table(spark, sf_dir, "embeddings").withColumn("label", moved)), F.col("id") % 100 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic.summary(periodic.with_runs(docs, carry=["doc_id"]))


QUERIES = {f.__name__: f for f in (op1_quality, op2_mixing, op3_line_dedup, op4_subwords, op5_sharding, op6_near_dups, op7_chat, op8_records, op9_tiff, op10_rules, op11_exact_dedup, op12_hard_negatives, op13_periodic_runs)}

ORACLE = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS r, sum(source_size) OVER () AS total FROM s),
c AS (SELECT *, total - 3 * coalesce(sum(source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM o),
l AS (SELECT CAST(rest AS DOUBLE) / open_w AS level FROM c WHERE w * (CAST(rest AS DOUBLE) / open_w) <= 3 * source_size ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, least(w * level, 3.0 * source_size)::DOUBLE AS target FROM s, l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS flow, sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (CASE WHEN 2 * before + size < 2 * flow THEN 1 ELSE 0 END + CASE WHEN 2 * (source_size + before) + size < 2 * flow THEN 1 ELSE 0 END
       + CASE WHEN 2 * (2 * source_size + before) + size < 2 * flow THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p""",
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))) AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.*, o.owner IS NULL OR o.owner = l.doc_id AS stays FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op7_chat": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
           SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + length(regexp_replace(concat(role, text), '[^\\<]', '', 'g')) + length(regexp_replace(role, '[^>]', '', 'g')) + 15)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id""",
    "op10_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             length(regexp_replace(text, '[^A-Za-z\x{C0}-\x{24F}]', '', 'g')) AS letters FROM t),
g AS (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
x AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM m, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
b AS (SELECT w.doc_id, text, letters, len(ls) AS n_lines, len(ws)::BIGINT AS n_words, length(list_aggregate(list_concat(ws, ['']), 'string_agg', ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(x.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN x ON w.doc_id = x.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
            OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > letters OR 5 * length(regexp_replace(text, '[^!?]', '', 'g')) > n_words OR 2 * letters < length(text)) AS kept FROM f""",
    "op11_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS k, row_number() OVER () AS r FROM documents),
w AS (SELECT *, first_value(r) OVER p AS best, first_value(doc_id) OVER p AS keep_id, count(*) OVER (PARTITION BY k) AS n FROM d WINDOW p AS (PARTITION BY k ORDER BY chars DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, n::BIGINT AS group_size, r = best AS kept, k AS text_sha256 FROM w""",
    "op12_hard_negatives": r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_periodic_runs": r"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) AS h FROM documents),
g AS (SELECT *, len(ws) AS n, coalesce(h % 10 = 0, false) AND len(ws) > 0 AS hit, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
t AS (SELECT doc_id, i, CASE WHEN hit AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM e GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, s, l, min(q) AS q FROM s GROUP BY doc_id, s, l),
b AS (SELECT doc_id, count(*)::BIGINT AS n_runs, arg_min([s, l, q], [-l, s, q]) AS best, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS runs FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
c AS (SELECT t.doc_id, string_agg(w, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period, (1000 * best[2] // best[3])::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN c ON d.doc_id = c.doc_id""",
}
