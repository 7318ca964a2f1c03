"""The registered queries of this subpackage and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import (decontaminate, html_wrappers, langid, licences, linededup, merkle,
                           neighbours, packing, periodic, simhash, tokenstore, toxicity, warc)
from radiolake.llm.common import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_collision_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_licence_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select(
        F.col("id").alias("doc_id"), "n_paragraphs",
        F.size("licences").cast("long").alias("n_named"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))),
                     ",").alias("families"))


def _sql_words(table: str, key: str) -> str:
    return f"""
  SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"""


OP3_SQL = f"""
WITH d AS ({_sql_words('documents', 'doc_id')}),
b AS (SELECT *, least(10, len(w)) AS n FROM ({_sql_words('benchmark', 'item_id')}) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - n + 2)) AS r(i)),
runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, item_id, i, n FROM runs JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(k) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.spans_of(table(spark, sf_dir, "documents"),
                                  table(spark, sf_dir, "benchmark"), window=10)
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        (decontaminate.n_hit() > 0).alias("contaminated"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = langid.train(docs.where(langid.learning_rows()))
    found = langid.predict(docs, trees)
    return found.select(F.col("id").alias("doc_id"), (crc_mod("id", 4) == 2).alias("held_out"),
                        "lang_pred", "score", "bits_per_byte")


@query("op5_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_text(table(spark, sf_dir, "pages")).withColumnRenamed(
        "id", "page_id")


# base32 by hand: the 160 bits of the digest in groups of five
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
bits AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, list_reduce(list_transform(
    range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010',
      '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', sha1(html)[i])]), lambda a, x: a || x) AS b FROM p),
coded AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT
      + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT]), '') AS payload_digest FROM bits),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM kept"""


@query("op6_warc_revisits", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_token_store")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(table(spark, sf_dir, "documents"),
                                 tokenizer_file("word_bpe_49k.json"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (crc_mod("id", 5) == 0).alias("held_out"),
                        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("passages").alias("n_passages"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"),
                                    tokenizer_file("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


@query("op10_simhash_components")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, unnest(range(1, len(lines) + 1)) AS r(i)),
often AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, i, line, last IS NOT NULL AND last <> doc_id AS gone FROM l LEFT JOIN often USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op11_line_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped",
                       F.sha2("text", 256).alias("kept_sha256"))


# crc32 of an id as text, bit by bit
_SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    range(1, length(doc_id::VARCHAR) + 1), lambda i: list_concat([ord((doc_id::VARCHAR)[i])::BIGINT],
      [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(
        f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {_sql_leaf('text')} AS leaf,
    CASE WHEN {_SQL_CRC} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS changed
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS idx,
  count(*) OVER (PARTITION BY g) AS n FROM d),
lv AS (SELECT g, 0 AS lvl, idx, leaf AS h, n FROM numbered
  UNION ALL SELECT g, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM lv WHERE n > 1 GROUP BY g, lvl, idx // 3),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1),
top AS (SELECT 0 AS lvl, idx, subroot AS h, n FROM sub
  UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY lvl, idx // 3),
steps AS (SELECT g, lvl, idx // 3 AS p, list(h ORDER BY idx) AS hs FROM lv WHERE n > 1 GROUP BY ALL),
tops AS (SELECT lvl, idx // 3 AS p, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY ALL),
up AS (SELECT doc_id, g, 0 AS lvl, idx, changed AS cur, '' AS sibs FROM numbered
  UNION ALL SELECT doc_id, up.g, up.lvl + 1, idx // 3,
    sha256(array_to_string(hs[1:idx % 3], '') || cur || array_to_string(hs[idx % 3 + 2:], '')),
    sibs || array_to_string(hs[1:idx % 3], '') || array_to_string(hs[idx % 3 + 2:], '')
  FROM up JOIN steps ON up.g = steps.g AND up.lvl = steps.lvl AND p = idx // 3),
groups AS (SELECT doc_id, g, arg_max(cur, lvl) AS cur, arg_max(sibs, lvl) AS sibs FROM up GROUP BY doc_id, g),
higher AS (SELECT doc_id, 0 AS lvl, idx, cur, sibs FROM groups JOIN sub USING (g)
  UNION ALL SELECT doc_id, higher.lvl + 1, idx // 3,
    sha256(array_to_string(hs[1:idx % 3], '') || cur || array_to_string(hs[idx % 3 + 2:], '')),
    sibs || array_to_string(hs[1:idx % 3], '') || array_to_string(hs[idx % 3 + 2:], '')
  FROM higher JOIN tops ON higher.lvl = tops.lvl AND p = idx // 3),
folded AS (SELECT doc_id, arg_max(cur, lvl) AS folded_root, sha256(arg_max(sibs, lvl)) AS proof_sha256 FROM higher GROUP BY doc_id)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, proof_sha256, folded_root,
  folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM d JOIN sub USING (g) JOIN folded USING (doc_id)"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle.manifest(table(spark, sf_dir, "documents"),
                            ["doc_id", "source", "lang", "n_chars", "text"],
                            instead={"text": tampered.otherwise(F.col("text"))})
    return found.withColumnRenamed("id", "doc_id")


# equal words q apart make islands; of the periods of one stretch the smallest counts
OP13_SQL = f"""
WITH t AS (SELECT doc_id, {_SQL_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT *, len(w) AS n, h // 10 AS g FROM t),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM s),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) AS w FROM p),
words AS (SELECT doc_id, n, i, w[i + 1] AS x FROM d, unnest(range(0, n)) AS r(i)),
pairs AS (SELECT b.doc_id, b.i, c.i - b.i AS q FROM words b JOIN words c ON b.doc_id = c.doc_id AND b.x = c.x AND c.i > b.i
  WHERE (c.i - b.i) * 4 <= b.n),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, start, length, min(q) AS q FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
lists AS (SELECT doc_id, count(*) AS n_runs, list(struct_pack(start := start, length := length, q := q) ORDER BY length DESC, start, q)[1] AS best,
  string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + q, start + length)) AS r(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length,
  best.q::BIGINT AS period, (1000 * best.length // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM documents_ids LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""".replace(
    "documents_ids", "(SELECT doc_id FROM documents)")


def with_periods(docs: DataFrame) -> DataFrame:
    """Texts whose id's crc32 ends in 0 go on from one of their words with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a),
                                    F.slice(tail, F.lit(1), n - a)), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), changed)
                       .otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    period = -F.col("best.period")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"))
