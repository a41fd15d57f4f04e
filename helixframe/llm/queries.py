"""The registered queries opN_<name> and pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import ann, chat, language, lmscore, merkle, mixing, neardup, packing, quantiles, substring, tokencount, topk, urls
from helixframe.session import Scratch, table


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=20)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def op2_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels grow with the documents, so they are never broadcast; documents without an id are spread by their text
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("salt")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", salt)
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id", F.lit(0).cast("long").alias("salt"), F.lit(True).alias("good")).distinct()
    return lmscore.score(docs.join(good.hint("merge"), ["doc_id", "salt"], "left"), F.col("good"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no calls, and all its turns run forward: odd conversations stand for such as are listed newest first
    calls, results = chat.turns_as_calls(table(spark, sf_dir, "conversations"), F.col("conv_id") % 2 == 1)
    return chat.link(calls, results, chat.REPLY)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.by_radius(table(spark, sf_dir, "documents"), radius=3, size=3)
    return found.select("doc_id", neardup.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", language.held_out(docs).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, cycle=(1, 2, 3), epochs=3, keep=["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
        F.col("__position").alias("position"),
    ).orderBy("position", "doc_id")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, F.translate("text", upper, upper.lower()))
    found = merkle.proofs(table(spark, sf_dir, "documents"), tampered)
    folded = merkle.fold(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    proof = F.sha2(merkle.proof_text(F.col("path")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 512)
    return counted.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_tokens").alias("n_tokens"), F.col("__over_limit").alias("over_limit"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, grp, batch, x of the clicks' values and of the prices of sold items."""
    clicks = table(spark, sf_dir, "clicks").groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("r"))
    value = clicks.select(F.lit("value").alias("stream"), F.col("r.client_id").cast("string").alias("grp"), F.col("click_id").alias("id"), F.col("r.value").alias("money"))
    items = table(spark, sf_dir, "items").select("item_id", "brand", "price").hint("merge")  # items grow with the input
    lines = table(spark, sf_dir, "sale_lines").select("item_id", "vendor_id").filter("item_id is not null")
    price = lines.join(items, "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), F.col("vendor_id").alias("id"), F.col("price").alias("money"))
    rows = value.unionByName(price).select("stream", "grp", quantiles.in_batch(F.col("id")).alias("batch"), quantiles.money_units(F.col("money")).alias("units"))
    return rows.filter("grp is not null and units is not null").select("stream", "grp", "batch", (F.col("units") + 1000 * F.col("batch")).alias("x"))


def op13_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by = Scratch(spark).save(streams(spark, sf_dir), "streams"), ["stream", "grp"]
    found = quantiles.judged(rows, quantiles.sketches(rows, by, "batch", "x"), by, "batch", "x", range(4), parts=4, least=20)
    return found.withColumn("rank_error", quantiles.rank_error()).withColumn("within", 1000 * F.col("rank_error") <= 20 * F.col("n"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf_dir)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP3 = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM conversations),
calls AS (SELECT DISTINCT conv_id, conv_id || ':' || turn AS call_id, turn, text, CASE WHEN conv_id % 2 = 1 THEN conv_id || ':' || (turn + 2) WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS parent_id FROM c WHERE role = 'user'),
results AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn AS result_turn, text AS content FROM c WHERE role = 'assistant'),
o AS (SELECT *, CASE WHEN text IS NULL THEN json_object('turn', turn) ELSE json_object('text', text, 'turn', turn) END AS arguments FROM calls),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY CAST(arguments AS VARCHAR)) AS nth FROM o),
f AS (SELECT * FROM n WHERE nth = 1),
u AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM f WHERE conv_id % 2 = 1),
d AS (SELECT conv_id, call_id, (max(turn) OVER (PARTITION BY conv_id, turn % 2, run) - turn) // 2 AS depth FROM u),
e AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS most FROM d),
l AS (SELECT r.conv_id, r.call_id, f.turn, r.result_turn, f.text, f.arguments, r.content, f.parent_id, CASE WHEN f.conv_id IS NULL THEN 'orphan' ELSE 'linked' END AS status FROM results r LEFT JOIN f ON f.conv_id = r.conv_id AND f.call_id = r.call_id
  UNION ALL SELECT conv_id, call_id, turn, NULL, text, arguments, NULL, parent_id, CASE WHEN nth > 1 AND conv_id IS NOT NULL AND call_id IS NOT NULL THEN 'repeated' ELSE 'pending' END FROM n
  WHERE nth > 1 OR conv_id IS NULL OR call_id IS NULL OR NOT EXISTS (SELECT 1 FROM results r WHERE r.conv_id = n.conv_id AND r.call_id = n.call_id)),
v AS (SELECT *, CASE WHEN status = 'orphan' THEN NULL WHEN text IS NULL THEN ['text: missing'] ELSE []::VARCHAR[] END AS errors FROM l)
SELECT v.conv_id, v.call_id, turn, result_turn, status, CASE WHEN most > 0 AND status <> 'orphan' THEN depth END AS depth, len(errors) = 0 AS valid, errors,
       CAST(json_object('arguments', arguments, 'call_id', v.call_id, 'content', content, 'conv_id', v.conv_id, 'name', CASE WHEN status <> 'orphan' THEN 'reply' END,
         'parent_id', parent_id, 'status', status, 'turn', turn, 'valid', len(errors) = 0) AS VARCHAR) AS record
FROM v LEFT JOIN e ON e.conv_id = v.conv_id AND e.call_id = v.call_id
"""

OP7 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS s, words FROM w WHERE len(words) >= 20),
g AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) AS h FROM i),
m AS (SELECT doc_id, s, (doc_id, s) > min((doc_id, s)) OVER (PARTITION BY h) AS late FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM m WHERE late),
k AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, n: NOT list_contains(gone, n)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'z') AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix ' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS k FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, row_number() OVER (ORDER BY src) AS n, CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
f AS (SELECT *, (SELECT sum(source_size) FROM w) - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight FROM w),
o AS (SELECT *, 3 * source_size * rest_weight >= rest * weight AS is_open FROM f),
b AS (SELECT rest, rest_weight FROM o WHERE is_open ORDER BY source_size / weight, src LIMIT 1),
t AS (SELECT o.src, o.source_size, o.n, CASE WHEN bool_or(is_open) OVER (ORDER BY o.source_size / weight, src ROWS UNBOUNDED PRECEDING)
             THEN CAST(weight * b.rest AS DOUBLE) / CAST(b.rest_weight AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM o, b),
p AS (SELECT d.*, t.source_size, t.target, [0.5, -0.5, 0.0][CAST((n - 1) % 3 + 1 AS INT)]::DOUBLE AS a,
             coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.src = t.src),
e AS (SELECT *, (2 * start + size <= 2 * target)::INT + (2 * (source_size + start) + size <= 2 * target)::INT + (2 * (2 * source_size + start) + size <= 2 * target)::INT AS copies,
             CAST(start AS DOUBLE) / target AS u FROM p)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies > 0 AND target > 0 THEN CASE WHEN a = 0 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END END AS position
FROM e
"""

OP11 = r"""
WITH RECURSIVE bits AS (SELECT n AS i, CAST(n AS UBIGINT) AS v, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT *, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
        lambda s, b: xor(list_extract(t, CAST(xor(s, b) & 255 AS BIGINT) + 1), s // 256))) % 5 = 0 AS hit FROM documents, crc),
l AS (SELECT doc_id, coalesce('1' || source, '0') AS src, hit, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low FROM d),
h AS (SELECT doc_id, src, sha256(head || body) AS leaf, sha256(head || CASE WHEN hit THEN low ELSE body END) AS own FROM l),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS idx, count(*) OVER (PARTITION BY src) AS n FROM h),
nodes AS (SELECT src, 0 AS lvl, idx, n, leaf AS d FROM p
  UNION ALL SELECT src, lvl + 1, idx // 16, max((n + 15) // 16), sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY src, lvl, idx // 16),
subs AS (SELECT src, d, CAST(row_number() OVER (ORDER BY src) - 1 AS BIGINT) AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, idx, n, d FROM subs UNION ALL SELECT lvl + 1, idx // 16, max((n + 15) // 16), sha256(string_agg(d, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 16),
kids AS (SELECT src, lvl, idx // 16 AS parent, list(d ORDER BY idx) AS c FROM nodes WHERE n > 1 GROUP BY ALL),
topkids AS (SELECT lvl, idx // 16 AS parent, list(d ORDER BY idx) AS c FROM tops WHERE n > 1 GROUP BY ALL),
up AS (SELECT doc_id, src, leaf, 0 AS lvl, idx, n, own AS f, '' AS proof FROM p
  UNION ALL SELECT doc_id, up.src, leaf, up.lvl + 1, idx // 16, (n + 15) // 16, sha256(array_to_string(c[:idx % 16], '') || f || array_to_string(c[idx % 16 + 2:], '')), proof || array_to_string(c[:idx % 16], '') || array_to_string(c[idx % 16 + 2:], '')
    FROM up JOIN kids k ON k.src = up.src AND k.lvl = up.lvl AND k.parent = idx // 16 WHERE n > 1),
past AS (SELECT doc_id, leaf, s.d AS subroot, 0 AS lvl, s.idx, s.n, f, proof FROM up JOIN subs s ON s.src = up.src WHERE up.n = 1
  UNION ALL SELECT doc_id, leaf, subroot, past.lvl + 1, idx // 16, (n + 15) // 16, sha256(array_to_string(c[:idx % 16], '') || f || array_to_string(c[idx % 16 + 2:], '')), proof || array_to_string(c[:idx % 16], '') || array_to_string(c[idx % 16 + 2:], '')
    FROM past JOIN topkids k ON k.lvl = past.lvl AND k.parent = idx // 16 WHERE n > 1)
SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.d AS verified FROM past, (SELECT d FROM tops WHERE n = 1) t WHERE n = 1
"""

OP10 = r"""
WITH s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM s),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
             regexp_matches(host || path, '(^|\.)(spam-farm|cheap-pills|free-casino)\.|/(wp-login|wp-admin)([./]|$)|/(cart|checkout)/') AS hit FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN hit THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": op1_substring,
        "op2_lmscore": op2_lmscore,
        "op3_chat": op3_chat,
        "op4_packing": op4_packing,
        "op5_neardup": op5_neardup,
        "op6_language": op6_language,
        "op7_topk": op7_topk,
        "op8_ann": op8_ann,
        "op9_mixing": op9_mixing,
        "op10_urls": op10_urls,
        "op11_merkle": op11_merkle,
        "op12_tokencount": op12_tokencount,
        "op13_quantiles": op13_quantiles,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring": OP1, "op3_chat": OP3, "op7_topk": OP7, "op9_mixing": OP9, "op10_urls": OP10, "op11_merkle": OP11}
