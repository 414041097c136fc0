"""Named queries of the operators, over whole tables, and SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.ball_codes import compress_vectors
from sondage.llm.conversations import damage, repair_digests
from sondage.llm.decontaminate import find_occurrences, hit_words, is_contaminated
from sondage.llm.common import stage
from sondage.llm.exact import exact_groups
from sondage.llm.language_model import fit_and_score
from sondage.llm.line_dedup import remove_repeated_lines
from sondage.llm.near_join import near_groups
from sondage.llm.packing import pack_documents
from sondage.llm.pii import find_personal_data, listed
from sondage.llm.sharding import shard_by_size
from sondage.llm.substring_dedup import repeated_spans
from sondage.llm.toxicity import fit_toxicity, score_toxicity, training_ids
from sondage.llm.warc import read_records, write_archives

Query = Callable[[SparkSession, str], DataFrame]

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    scored = fit_and_score(docs, F.coalesce(fold != 2, F.lit(True)), fold == 3)
    return scored.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, training_ids(table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    records = read_records(write_archives(pages))
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast(kind).alias("refers_to"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = hit_words()
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return cut.select("row.doc_id", "n_lines", "removed", "text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_size(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, entries = compress_vectors(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    coded = stage(coded, "codes")
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    # labels may be few and very common: sums are combined before the shuffle and come back in copies, one for each salt
    salts = 16
    sums = coded.groupBy("row.label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = coded.select("row.*", "codes", "error").withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(salts)).cast("int"))
    joined = rows.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")) & (rows["salt"] == sums["salt"]))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damage(table(spark, sf_dir, "conversations")), present="present")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("row.doc_id", *[count(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_warc": op6_warc,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_personal_data": op13_personal_data,
}

def _codebook_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Plain rounds over all entries, one after the other."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, part, m.d AS d, m.entry AS entry FROM (SELECT r, part, min({{'d': d, 'entry': entry}}) AS m FROM (
  SELECT r, part, entry, sum((v.x - e.x) * (v.x - e.x)) AS d FROM v JOIN e{k} e USING (part, pos) GROUP BY r, part, entry) GROUP BY r, part))""")
        if k < rounds:
            steps.append(f"""e{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, x)::BIGINT AS x FROM e{k} LEFT JOIN (
  SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{k} USING (r, part) GROUP BY part, entry, pos) USING (part, entry, pos))""")
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x)::BIGINT) AS x
           FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
v AS MATERIALIZED (SELECT r, (i - 1) // (len(x) // {parts}) AS part, (i - 1) % (len(x) // {parts}) AS pos, x[i] AS x FROM (SELECT r, x, unnest(range(1, len(x) + 1)) AS i FROM k)),
e0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x FROM v WHERE r <= {entries}), {", ".join(steps)},
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r) JOIN k USING (r), s
"""


CRC_TABLE = """rounds AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rounds WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM rounds WHERE k = 8)"""


def _repair_sql() -> str:
    """One turn after the other: for each state the least (cost, letters) with the text they leave."""
    never = "{'c': 1000000000, 'a': '', 'x': ''}"
    least = lambda *options: f"list_min([{', '.join(options)}])"
    edit = lambda s, cost, letter, line="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'x': {s}.x || {line}}}"
    add = lambda s, role: edit(s, 3, "I", f"chr(10) || '{role}:'")
    added = lambda source: f"""(SELECT * EXCLUDE (s0, s1, s2, s3, t2), s0 AS t0, s1 AS t1, t2, {least('s3', add('t2', 'assistant'))} AS t3 FROM (
      SELECT *, {least('s2', add('s0', 'user'), add('s1', 'user'), add('s3', 'user'))} AS t2 FROM {source}))"""
    more = "CASE WHEN row.fault = 't' THEN 3 ELSE 0 END"
    keep = lambda s, initial: f"CASE WHEN row.fault IN ('', 't') AND row.role[1] = '{initial}' THEN {edit(s, more, 'K', 'chr(10) || row.role || chr(58) || row.text')} ELSE {never} END"
    name = lambda s, role: f"CASE WHEN row.fault IN ('', 't') THEN {edit(s, f'3 + {more}', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || row.text')} ELSE {never} END"
    drop = lambda s: edit(s, 4, "D")
    return f"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
kinds AS (SELECT * EXCLUDE (h, t), xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(h) // 2), lambda p: ('0x' || h[2 * p + 1 : 2 * p + 2])::BIGINT)),
            lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS k FROM keyed, t),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE k <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM placed),
faults AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
           lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM marked),
whole AS (SELECT row_number() OVER () AS g, o.conv_id, coalesce(list({{'role': role, 'text': text, 'fault': fault}} ORDER BY i) FILTER (i IS NOT NULL), []) AS rows,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY o.conv_id),
dp AS (SELECT g, 0::BIGINT AS i, {{'c': 0, 'a': '', 'x': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM whole
  UNION ALL SELECT g, i + 1, {drop('t0')}, {least(drop('t1'), keep('t0', 's'))},
    {least(drop('t2'), keep('tx', 'u'), name('tx', 'user'))}, {least(drop('t3'), keep('t2', 'a'), name('t2', 'assistant'))} FROM (
    SELECT *, {least('t0', 't1', 't3')} AS tx FROM {added('(SELECT dp.*, rows[i + 1] AS row FROM dp JOIN whole USING (g) WHERE i < len(rows))')})),
done AS (SELECT g, {least('t0', 't3')} AS b FROM {added('(SELECT dp.* FROM dp JOIN whole USING (g) WHERE i = len(rows))')})
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(substr(b.x, 2)) AS repaired_sha256 FROM done JOIN whole USING (g)
"""


CHECKS: dict[str, str] = {
    "op5_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, {AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
g AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM g LEFT JOIN n USING (doc_id)
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS winner, ('0x' || sha1(body)[1:10])::UBIGINT AS a,
             ('0x' || sha1(body)[11:20])::UBIGINT AS b, ('0x' || sha1(body)[21:30])::UBIGINT AS c, ('0x' || sha1(body)[31:40])::UBIGINT AS e FROM p)
SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(flatten(list_transform([a, b, c, e],
         lambda v: list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda k: (v >> k) & 31))),
         lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(x + 1 AS BIGINT)]), '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to FROM d
""",
    "op7_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
""",
    "op8_decontamination": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, list_slice(w, i, i + least(13, len(w)) - 1) AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
place AS (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS win
          FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hit AS (SELECT p.doc_id, p.i, p.size, win.item_id FROM place p JOIN win ON p.size = win.size AND p.win = win.win),
n AS (SELECT doc_id, count(DISTINCT hit_at) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS hit_at FROM hit) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN who USING (doc_id)
""",
    "op11_vector_codes": _codebook_sql(),
    "op12_conversation_repair": _repair_sql(),
    "op10_sharding": """
WITH RECURSIVE rounds AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rounds WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM rounds WHERE k = 8),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(range(size - 16), lambda p: ('0x' || h[2 * p + 1 : 2 * p + 2])::BIGINT)),
          lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
p AS (SELECT *, sum(size) OVER o - size AS before, row_number() OVER o - 1 AS place, sum(size) OVER () AS total FROM crc
      WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST((before * 40) // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot,
       NULL::INTEGER AS grown_shard FROM s
""",
}
