"""One query for each operator of this package, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.llm import ann, chat, exact_dedup, fill_middle, filter_audit, html_text, mixing, packing, pii, simhash, toxicity, warc
from meshtide.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash.components(table(spark, sf_dir, "documents"))
    return c.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_binary_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = packing.binary_packs(table(spark, sf_dir, "documents"))

    def crcs(batches):
        for b in batches:
            sums = [pa.array([zlib.crc32(x.as_py()) for x in b.column(k)], pa.int64()) for k in (0, 3)]
            yield pa.RecordBatch.from_arrays([b.column(4), b.column(5), b.column(1), b.column(2), *sums], ["doc_ids", "starts", "n_tokens", "cu_seqlens", "ids_crc32", "positions_crc32"])

    return packs.mapInArrow(crcs, "doc_ids array<long>, starts array<long>, n_tokens long, cu_seqlens array<int>, ids_crc32 long, positions_crc32 long")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrated(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.equal_groups(table(spark, sf_dir, "documents")).drop("rid").withColumnRenamed("id", "doc_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.histogram_packs(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat.read_back(chat.formatted(turns.unionByName(planted)))
    hashed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        hashed(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), hashed(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda c: ~toxicity.held_out(c))
    s = toxicity.scored(docs, model)
    return s.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fill_middle.transformed(table(spark, sf_dir, "documents"))
    hashed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    back = hashed(fill_middle.restored(F.col("form"), F.col("output")))
    return t.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), back.alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_archives(table(spark, sf_dir, "pages"))
    r = warc.read_records(folder, index)
    return r.select(F.expr("try_cast(page AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "intact")


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_binary_packs, op3_mixing, op4_pii, op5_ann, op6_exact_dedup, op7_html_text, op8_packing, op9_chat, op10_toxicity,
    op11_fill_middle, op12_filter_audit, op13_warc)}

_OP6 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

_OP9 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
             regexp_replace(text, '([\[<]/?)(#*(?:SYS\]|INST\]|TURN\]|s>))', '\1#\2', 'g') AS body FROM t),
q AS (SELECT *, (before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS ok,
             length(body) + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10
                            ELSE 17 + length(base64(role::BLOB)) END AS chars FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, bool_and(ok) AS valid
FROM q GROUP BY conv_id
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS hs FROM d),
f AS (SELECT *, len(units) AS n,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 50 THEN 'plain'
                  WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             least(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS x, greatest(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS y FROM u),
c AS (SELECT *, array_to_string(units[1:x], '') AS p, array_to_string(units[x + 1:y], '') AS m, array_to_string(units[y + 1:], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

_OP12 = r"""
WITH RECURSIVE o(filter_order) AS (
  SELECT '' UNION ALL SELECT o.filter_order || f.f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f(f) WHERE length(o.filter_order) < 5 AND NOT contains(o.filter_order, f.f)),
w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(words) < 50) AS fa, (100 * len(list_distinct(words)) < 65 * len(words)) AS fb,
             (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t)) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
             coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS fe, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
k AS (SELECT part, (CASE WHEN fa THEN 'A' ELSE '' END || CASE WHEN fb THEN 'B' ELSE '' END || CASE WHEN fc THEN 'C' ELSE '' END || CASE WHEN fd THEN 'D' ELSE '' END || CASE WHEN fe THEN 'E' ELSE '' END) AS fails,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
s AS (SELECT k.part, o.filter_order, i.step::INT AS step, substr(o.filter_order, i.step, 1) AS f, k.fails, k.n, k.good, k.toxic,
             contains(k.fails, substr(o.filter_order, i.step, 1)) AS now, k.fails <> '' AND regexp_matches(k.fails, '[' || substr(o.filter_order, 1, i.step - 1) || '!]') AS earlier
      FROM k, o, range(1, 6) i(step) WHERE length(o.filter_order) = 5),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT earlier AND NOT now THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN now AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN now AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN now AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN now AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM s GROUP BY ALL)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM g
"""

_OP13 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS best FROM p),
d AS (SELECT *, [strpos('0123456789abcdef', substr(h, k + 1, 1)) - 1 FOR k IN range(40)] AS x FROM q)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (((x[5 * i // 4 + 1] * 16 + x[5 * i // 4 + 2]) >> (3 - 5 * i % 4)::INT) & 31))::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to, true AS intact
FROM d
"""

ORACLE_SQL = {"op6_exact_dedup": _OP6, "op9_chat": _OP9, "op11_fill_middle": _OP11, "op12_filter_audit": _OP12, "op13_warc": _OP13}
