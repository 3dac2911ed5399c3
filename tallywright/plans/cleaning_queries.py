"""Queries for integrity checks and word repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.text import norm_title, slugify
from tallywright.operators import cleaning, lyrics
from tallywright.plans.registry import load, query

_UNIQUE = """SELECT p_partkey, p_name, p_type, CASE WHEN count(*) OVER (PARTITION BY lower(p_name)) = 1 THEN p_name
  WHEN count(*) OVER (PARTITION BY lower(p_name), p_type) = 1 THEN p_name || ' (' || p_type || ')'
  ELSE p_name || ' (p. ' || p_partkey || ')' END AS unique_name,
  count(*) OVER (PARTITION BY lower(p_name)) > 1 AS renamed FROM part"""


@query("assign_unique_names", _UNIQUE)
def assign_unique_names(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return cleaning.assign_unique_names(part, "p_name", "p_type", "p_partkey")


@query(
    "assert_unique",
    f"""SELECT key, n, first_record, last_record FROM (SELECT lower(p_name || p_size) AS key, count(*) AS n, min(p_partkey) AS first_record,
    max(p_partkey) AS last_record FROM part GROUP BY 1) WHERE n > 1""",
)
def assert_unique(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    return cleaning.repeated_keys(part, norm_title(F.concat("p_name", F.col("p_size").cast("string"))), "p_partkey")


@query(
    "repeated_records",
    """SELECT p_partkey, key, n FROM (SELECT p_partkey, lower(p_name || p_size) AS key, count(*) OVER (PARTITION BY lower(p_name || p_size)) AS n
    FROM part) WHERE n > 1""",
)
def repeated_records(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    return cleaning.repeated_records(part, norm_title(F.concat("p_name", F.col("p_size").cast("string"))), "p_partkey")


_SHEET = """(SELECT l_orderkey * 10 + l_linenumber AS row_no, CASE WHEN l_partkey % 50 = 0 THEN ' ' WHEN l_partkey % 50 = 1 THEN 'x' || l_orderkey
  ELSE CAST(l_orderkey * 3 + l_linenumber % 2 AS VARCHAR) END AS id,
  CASE WHEN l_suppkey % 10 = 0 THEN '-' WHEN l_suppkey % 10 = 1 THEN 'iv' ELSE CAST(l_suppkey AS VARCHAR) END AS page,
  CAST(1 + l_linenumber % 3 AS VARCHAR) AS sheets FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2))"""


def sheet(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")
    )
    p, s = F.col("l_partkey") % 50, F.col("l_suppkey") % 10
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"),
        F.when(p == 0, F.lit(" "))
        .when(p == 1, F.concat(F.lit("x"), F.col("l_orderkey")))
        .otherwise((F.col("l_orderkey") * 3 + F.col("l_linenumber") % 2).cast("string"))
        .alias("id"),
        F.when(s == 0, F.lit("-")).when(s == 1, F.lit("iv")).otherwise(F.col("l_suppkey").cast("string")).alias("page"),
        (1 + F.col("l_linenumber") % 3).cast("string").alias("sheets"),
    )


@query(
    "validate_ids",
    f"""WITH s AS (SELECT row_no, trim(id) AS id, page, sheets, min(row_no) OVER (PARTITION BY trim(id)) AS first_row FROM {_SHEET}),
    m AS (SELECT CAST(o_orderkey * 3 AS VARCHAR) AS id FROM orders)
    SELECT * FROM (SELECT row_no AS "row", id, CASE WHEN id = '' THEN 'blank id' WHEN row_no <> first_row THEN 'id repeated'
      WHEN id NOT IN (SELECT id FROM m) THEN 'id not in master' WHEN page IN ('', '-') THEN 'page missing'
      WHEN NOT regexp_matches(page, '^[0-9]+$') THEN 'page not a number' WHEN sheets NOT IN ('1', '2') THEN 'sheet count not 1 or 2' END AS reason FROM s)
    WHERE reason IS NOT NULL
    UNION ALL SELECT NULL, id, 'master never named' FROM m WHERE id NOT IN (SELECT id FROM s)""",
)
def validate_ids(spark: SparkSession, sf: str) -> DataFrame:
    master = load(spark, sf, "orders").select((F.col("o_orderkey") * 3).cast("string").alias("id"))
    return cleaning.validate_ids(sheet(spark, sf), master)


_INTERVALS = """(SELECT user_id, event_id, event_id AS first, event_id + CAST(floor(value) AS BIGINT) % 90 AS last,
   1 + event_id % 2 AS n_sheets, 1 + event_id % 3 AS n_scans FROM events)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(
        "user_id",
        "event_id",
        F.col("event_id").alias("first"),
        (F.col("event_id") + F.floor("value") % 90).alias("last"),
        (1 + F.col("event_id") % 2).alias("n_sheets"),
        (1 + F.col("event_id") % 3).alias("n_scans"),
    )


@query(
    "check_order_overlap_gap",
    f"""WITH x AS (SELECT *, lag(last) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM {_INTERVALS})
    SELECT user_id, event_id, 'problem' AS level, 'overlap' AS finding, first AS "from", p AS "to" FROM x WHERE first <= p
    UNION ALL SELECT user_id, event_id, 'note', 'gap', p + 1, first - 1 FROM x WHERE first - p - 1 > 0
    UNION ALL SELECT user_id, event_id, 'problem', 'scan count', n_sheets, n_scans FROM x WHERE n_sheets <> n_scans""",
)
def check_order_overlap_gap(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.check_order_overlap_gap(intervals(spark, sf), ["user_id"], "event_id")


@query(
    "check_order_whole_table",
    f"""WITH x AS (SELECT *, lag(last) OVER (ORDER BY event_id) AS p FROM {_INTERVALS})
    SELECT event_id, 'problem' AS level, 'overlap' AS finding, first AS "from", p AS "to" FROM x WHERE first <= p
    UNION ALL SELECT event_id, 'note', 'gap', p + 1, first - 1 FROM x WHERE first - p - 1 > 0
    UNION ALL SELECT event_id, 'problem', 'scan count', n_sheets, n_scans FROM x WHERE n_sheets <> n_scans""",
)
def check_order_whole_table(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.check_order_overlap_gap(intervals(spark, sf), [], "event_id")


@query(
    "compare_by_position",
    """WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS position, p_name AS t, p_size AS pg FROM part),
    b AS (SELECT row_number() OVER (ORDER BY p_partkey) AS position, CASE WHEN p_size % 9 = 0 THEN p_name || '!' WHEN p_size % 9 = 1 THEN p_name || 'x' ELSE upper(p_name) END AS t,
      p_size + CASE WHEN p_partkey % 20 = 0 THEN 1 ELSE 0 END AS pg FROM part)
    SELECT position, 'page differs' AS finding FROM a JOIN b USING (position) WHERE a.pg <> b.pg
    UNION ALL SELECT position, 'title differs' FROM a JOIN b USING (position) WHERE regexp_replace(lower(a.t), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(b.t), '[^a-z0-9]', '', 'g')""",
)
def compare_by_position(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    printed = part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_size").alias("page"))
    k = F.col("p_size") % 9
    records = part.select(
        (F.col("p_partkey") + 7).alias("rec"),
        F.when(k == 0, F.concat("p_name", F.lit("!"))).when(k == 1, F.concat("p_name", F.lit("x"))).otherwise(F.upper("p_name")).alias("title"),
        (F.col("p_size") + F.when(F.col("p_partkey") % 20 == 0, 1).otherwise(0)).alias("page"),
    )
    return cleaning.compare_by_position(printed, records, "p_partkey", "rec")


@query(
    "compare_existing_values",
    """SELECT o_orderkey, old, new FROM (SELECT o_orderkey, trim(CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN o_orderpriority ELSE '3-OLD' END) AS old,
    trim(o_orderpriority) AS new FROM orders) WHERE old NOT IN ('', '-') AND old <> new""",
)
def compare_existing_values(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    old = orders.select(
        "o_orderkey",
        F.when(k == 0, F.lit(" -")).when(k == 1, F.lit("")).when(k == 2, F.col("o_orderpriority")).otherwise(F.lit("3-OLD")).alias("v"),
    )
    return cleaning.compare_existing_values(old, orders.select("o_orderkey", F.col("o_orderpriority").alias("v")), "o_orderkey", "v")


def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    name = F.concat(
        F.lpad(F.col("l_orderkey").cast("string"), 6, "0"), F.lit("_s"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"), F.lit(".png")
    )
    odd = F.when(F.col("l_suppkey") % 40 == 0, F.concat(F.lit("loose "), F.col("l_partkey"))).otherwise(name)
    return li.select(odd.alias("file")).distinct()


_FILES = """(SELECT DISTINCT CASE WHEN l_suppkey % 40 = 0 THEN 'loose ' || l_partkey
  ELSE lpad(CAST(l_orderkey AS VARCHAR), 6, '0') || '_s' || l_linenumber || '-' || l_partkey || '.png' END AS file FROM lineitem)"""


@query(
    "number_files",
    rf"""SELECT id, file, row_number() OVER (PARTITION BY id ORDER BY file) AS position FROM
    (SELECT CAST(regexp_extract(file, '^(\d+)_', 1) AS BIGINT) AS id, file FROM {_FILES} WHERE regexp_matches(file, '^\d+_'))""",
)
def number_files(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.number_files(scan_files(spark, sf))


def recorded_lists(numbered: DataFrame) -> DataFrame:
    """What a master table records: some lists short, some reordered, some with a lost file."""
    k, pos = F.col("id") % 5, F.col("position")
    total = numbered.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    at = (
        F.when(k == 2, pos - 1)
        .when((k == 3) & (F.col("n") > 1) & (pos <= 2), 3 - pos)
        .otherwise(pos)
    )
    own = F.struct(F.col("file").alias("file"), at.alias("recorded_at"), F.lit(False).alias("spaced"))
    lost = F.struct(
        F.lit("gone.png").alias("file"), (F.col("n") + 1).alias("recorded_at"), F.lit(False).alias("spaced")
    )
    rows = F.when((k == 1) & (pos == 1), F.array(own, lost)).when(F.col("recorded_at0") > 0, F.array(own))
    return (
        numbered.join(total, "id")
        .where("id % 5 <> 4")
        .withColumn("recorded_at0", at)
        .select("id", F.explode(rows).alias("r"))
        .select("id", "r.*")
    )


def recorded_cells(numbered: DataFrame) -> DataFrame:
    """(id, cell): the recorded names as comma-joined cells, some with a blank behind the comma."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("recorded_at", "file"))), lambda x: x["file"])
    cells = recorded_lists(numbered).groupBy("id").agg(ordered.alias("files"))
    return cells.select("id", F.when(F.col("id") % 5 == 3, F.array_join("files", ", ")).otherwise(F.array_join("files", ",")).alias("cell"))


@query(
    "compare_file_lists",
    rf"""SELECT id, CASE id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'broken' WHEN 2 THEN 'added'
      ELSE CASE WHEN n > 1 THEN 'tidied' ELSE 'ok' END END AS status,
    CAST(CASE WHEN id % 5 = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_missing, CAST(CASE WHEN id % 5 = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_added
    FROM (SELECT CAST(regexp_extract(file, '^(\d+)_', 1) AS BIGINT) AS id, count(*) AS n FROM {_FILES} WHERE regexp_matches(file, '^\d+_') GROUP BY 1)
    WHERE id % 5 <> 4 AND NOT (id % 5 = 2 AND n = 1)""",
)
def compare_file_lists(spark: SparkSession, sf: str) -> DataFrame:
    numbered = cleaning.number_files(scan_files(spark, sf))
    return cleaning.compare_file_lists(numbered, cleaning.recorded_files(recorded_cells(numbered)))


@query(
    "orphans_both_ways",
    """SELECT 'file without record' AS kind, 'c' || c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'record without file', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) OR o_custkey % 100 = 0""",
)
def orphans_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    files = load(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("file"))
    name = F.concat(F.lit("c"), F.col("o_custkey"))
    records = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 100 == 0, F.lit(None)).otherwise(F.concat(name, F.lit(", none"))).alias("cell")
    )
    seen = load(spark, sf, "orders").select(F.lit(-1).cast("bigint").alias("id"), name.alias("cell"))
    out = cleaning.orphans_both_ways(records.unionByName(seen), files)
    return out.where("value <> '-1'")


@query(
    "rename_collisions",
    r"""WITH p AS (SELECT s, regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM
      (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '-' || (c_custkey % 700) ELSE lower(c_mktsegment) || '_' || (c_custkey % 700) END AS s FROM customer)),
    m AS (SELECT t, count(*) AS n FROM p WHERE s <> t GROUP BY t)
    SELECT t AS target, n AS n_sources, t IN (SELECT t FROM p WHERE s = t) AS taken FROM m WHERE n > 1 OR t IN (SELECT t FROM p WHERE s = t)""",
)
def rename_collisions(spark: SparkSession, sf: str) -> DataFrame:
    tail = (F.col("c_custkey") % 700).cast("string")
    source = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit("-"), tail)).otherwise(
        F.concat(F.lower("c_mktsegment"), F.lit("_"), tail)
    )
    names = load(spark, sf, "customer").select(source.alias("file"))
    return cleaning.rename_collisions(names, "file", slugify(F.col("file")))


_GLUE = "replace(text, '. ', '')"
_WORDS = rf"""(SELECT doc_id, w FROM (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array({_GLUE}, '\s+')), '[^\p{{L}}\p{{N}}_''-]', '', 'g') AS w FROM documents) WHERE w <> '')"""
_DICT = f"(SELECT lower(w) AS word, count(*) AS n FROM {_WORDS} WHERE NOT regexp_matches(w, '[a-z][A-Z]') GROUP BY 1)"


def glued_docs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("")).alias("text"))


@query("corpus_dictionary", f"SELECT word, n FROM {_DICT}")
def corpus_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return lyrics.corpus_dictionary(glued_docs(spark, sf), "doc_id", "text")


@query(
    "flag_glued_words",
    f"""SELECT doc_id, w AS token, regexp_extract(w, '^(.*?[a-z])[A-Z]', 1) AS head, regexp_extract(w, '^.*?[a-z]([A-Z].*)$', 1) AS tail
    FROM {_WORDS} WHERE regexp_matches(w, '[a-z][A-Z]')""",
)
def flag_glued_words(spark: SparkSession, sf: str) -> DataFrame:
    return lyrics.flag_glued_words(glued_docs(spark, sf), "doc_id", "text")


@query(
    "classify_glued_words",
    f"""WITH d AS {_DICT} SELECT w AS token, CASE WHEN lower(regexp_extract(regexp_extract(w, '^.*?[a-z]([A-Z].*)$', 1), '^([A-Z][a-z]*)', 1)) IN ('mu', 'nya', 'ku') THEN 'keep'
      WHEN lower(w) IN (SELECT word FROM d) THEN 'lower' ELSE 'ask' END AS action, count(*) AS n, count(DISTINCT doc_id) AS n_records
    FROM {_WORDS} WHERE regexp_matches(w, '[a-z][A-Z]') GROUP BY w""",
)
def classify_glued_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = glued_docs(spark, sf)
    return lyrics.classify_glued_words(
        lyrics.flag_glued_words(docs, "doc_id", "text"), lyrics.corpus_dictionary(docs, "doc_id", "text"), "doc_id"
    )


@query(
    "sync_status",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'empty' WHEN quality + toxic = 0 THEN 'verified' ELSE 'raw' END AS status
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY status""",
)
def sync_status(spark: SparkSession, sf: str) -> DataFrame:
    findings = load(spark, sf, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("n_findings"))
    synced = cleaning.sync_status(load(spark, sf, "documents").select("doc_id"), findings, "doc_id")
    return synced.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
