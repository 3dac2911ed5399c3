"""Queries for readers, writers and table upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import provenance
from tallywright.plans.registry import load, query
from tallywright.session import scratch_path
from tallywright.sources import external, records, staging


@query(
    "scan_records_csv",
    """SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(*) FILTER (source = '') AS BIGINT) AS blank,
    min(md5(text)) AS first_digest, max(md5(text)) AS last_digest
    FROM (SELECT lang, text, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS source FROM documents) GROUP BY lang""",
)
def scan_records_csv(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select(
        "doc_id", "text", "lang", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("source")).alias("source")
    )
    path = scratch_path(spark, "records-csv")
    records.save_records_csv(docs, path)
    back = records.scan_records_csv(spark, path, docs.columns)
    return back.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("source") == "").alias("blank"),
        F.min(F.md5("text")).alias("first_digest"),
        F.max(F.md5("text")).alias("last_digest"),
    )


@query("scan_jsonl_items", "SELECT item_id, md5(text) AS digest, 'v1' AS version FROM benchmark")
def scan_jsonl_items(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "items-jsonl")
    items = load(spark, sf, "benchmark")
    records.save_items_jsonl(items, {"canary": "c-1", "version": "v1"}, path)
    both = [f"{path}/items", f"{path}/header"]
    rows = records.scan_jsonl_items(spark, both, "item_id bigint, text string", "text")
    header = records.scan_jsonl_header(spark, both, "canary string, version string", "text")
    return rows.select("item_id", F.md5("text").alias("digest"), header.agg(F.max("version")).scalar().alias("version"))


@query("scan_file_per_record", "SELECT doc_id AS id, lang || ' + ' || source AS name, md5(text) AS digest FROM documents")
def scan_file_per_record(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a file of its own, written, read back, and refused if an id had two files."""
    path = scratch_path(spark, "file-per-record")
    docs = load(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit(" + "), "source").alias("name"), "text")
    records.save_file_per_record(docs, "doc_id", "name", "text", path)
    files = records.one_file_per_id(records.scan_file_per_record(spark, path))
    return files.select("id", "name", F.md5("text").alias("digest"))


def rebuilt_documents(docs: DataFrame) -> DataFrame:
    """A second build: some rows gone, some new, some texts other, some rows twice."""
    kept = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    fresh = docs.where("doc_id % 7 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    return kept.unionByName(fresh).unionByName(kept.where("doc_id % 13 = 0"))


_CHANGED = """WITH o AS (SELECT doc_id, lang, text FROM documents), k AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM o WHERE doc_id % 11 <> 0),
n AS (SELECT * FROM k UNION ALL SELECT -1 - doc_id, lang, text FROM o WHERE doc_id % 7 = 0 UNION ALL SELECT * FROM k WHERE doc_id % 13 = 0)"""


@query(
    "staged_write_preview",
    _CHANGED
    + """, a AS (SELECT doc_id, count(*) AS c, min(text) AS t FROM o GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS c, min(text) AS t FROM n GROUP BY doc_id)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
    coalesce(a.c, 0) AS old_rows, coalesce(b.c, 0) AS new_rows FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.c <> b.c OR a.t <> b.t""",
)
def staged_write_preview(spark: SparkSession, sf: str) -> DataFrame:
    """What a second build of the documents would change in the published one."""
    root = scratch_path(spark, "published-documents")
    docs = load(spark, sf, "documents").select("doc_id", "lang", "text")
    staging.publish(docs, root, ["doc_id"])
    return staging.preview(rebuilt_documents(docs), root, ["doc_id"])


@query("published_version", _CHANGED + " SELECT lang, count(*) AS n, min(md5(text)) AS lo, max(md5(text)) AS hi, CAST(2 AS BIGINT) AS number FROM n GROUP BY lang")
def published_version(spark: SparkSession, sf: str) -> DataFrame:
    """The second build, published over the first and read by its marker."""
    root = scratch_path(spark, "published-documents")
    docs = load(spark, sf, "documents").select("doc_id", "lang", "text")
    first = staging.publish(docs, root, ["doc_id"])
    number = staging.publish(rebuilt_documents(docs), root, ["doc_id"], base=first, least_kept=0.5)
    back = staging.read_current(spark, root)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5("text")).alias("lo"), F.max(F.md5("text")).alias("hi")).withColumn("number", F.lit(number).cast("bigint"))


@query(
    "scan_run_manifests",
    """SELECT 'user-' || user_id || '-' || (event_id // 500) AS run_id, count(*) AS total_steps, round(sum(value), 4) AS total_s,
    CAST(count(*) FILTER (event_type IN ('view', 'click')) AS BIGINT) AS n_train, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS n_eval
    FROM events WHERE user_id % 4 <> 0 GROUP BY user_id, event_id // 500""",
)
def scan_run_manifests(spark: SparkSession, sf: str) -> DataFrame:
    manifests = event_manifests(spark, sf)
    path = scratch_path(spark, "manifests")
    manifests.write.json(path)
    back = records.scan_run_manifests(spark, path)
    return back.select(
        "run_id",
        "total_steps",
        F.round("total_s", 4).alias("total_s"),
        F.size("loss_history").cast("bigint").alias("n_train"),
        F.size("eval_loss_history").cast("bigint").alias("n_eval"),
    )


def event_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest per user and block of 500 events, so its history is bounded.

    Views and clicks stand for training steps, errors for evaluations.
    """
    e = load(spark, sf, "events")
    train = F.when(F.col("event_type").isin("view", "click"), F.struct(F.col("event_id").alias("step"), F.col("value").alias("loss")))
    held = F.when(
        F.col("event_type") == "error",
        F.struct(F.col("event_id").alias("step"), (F.col("event_id") % 9).alias("epoch"), F.col("value").alias("eval_loss")),
    )
    block = F.floor(F.col("event_id") / 500)
    return e.groupBy("user_id", block.alias("block")).agg(
        F.concat(F.lit("user-"), F.col("user_id"), F.lit("-"), F.col("block")).alias("run_id"),
        F.when(F.col("user_id") % 4 == 0, F.lit("smoke")).otherwise(F.lit("final")).alias("tag"),
        F.count(F.lit(1)).alias("total_steps"),
        F.sum("value").alias("total_s"),
        F.collect_list(train).alias("loss_history"),
        F.collect_list(held).alias("eval_loss_history"),
    ).drop("user_id", "block")


@query(
    "explode_run_history",
    """SELECT 'user-' || user_id || '-' || (event_id // 500) AS run_id, CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS kind, event_id AS step, value AS loss
    FROM events WHERE user_id % 4 <> 0 AND event_type IN ('view', 'click', 'error')""",
)
def explode_run_history(spark: SparkSession, sf: str) -> DataFrame:
    return records.explode_run_history(event_manifests(spark, sf).where("tag <> 'smoke'"))


@query(
    "load_exam_rows",
    """SELECT id, options, reason FROM (SELECT p_partkey AS id,
      CASE WHEN p_partkey % 10 = 0 THEN '1' ELSE '0' END AS few, CASE WHEN p_size % 4 = 0 THEN 'E' ELSE 'B' END AS key,
      CASE WHEN p_size % 3 = 0 THEN 'A=A. ' || p_name || ';B=' || p_brand || chr(10) || 'or so;C=' || p_size
           ELSE 'A=' || p_name || ';B=' || p_brand || chr(10) || 'or so;C=' || p_size END AS options,
      CASE WHEN p_partkey % 10 = 0 THEN 'few-shot example' WHEN p_size % 4 = 0 THEN 'key not in options'
           WHEN p_type IN ('PROMO') THEN 'unknown subject' ELSE '' END AS reason FROM part)""",
)
def load_exam_rows(spark: SparkSession, sf: str) -> DataFrame:
    done = external.classify_exam_rows(exam_rows(spark, sf), exam_groups(spark, sf))
    letters = F.transform(F.sort_array(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return done.select("id", F.array_join(letters, ";").alias("options"), "reason")


def exam_rows(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    first = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("A. "), F.col("p_name"))).otherwise(F.col("p_name"))
    return part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 10 == 0, F.lit("1")).otherwise(F.lit("0")).alias("is_for_fewshot"),
        F.concat(
            F.lit("A. "), first, F.lit("\nB. "), F.col("p_brand"), F.lit("\nor so\nC."), F.col("p_size"), F.lit("\nD. \n")
        ).alias("blob"),
        F.when(F.col("p_size") % 4 == 0, F.lit("E")).otherwise(F.lit("B")).alias("key"),
        F.concat(F.col("p_type"), F.lit(" ")).alias("subject"),
        F.lit("VIII ").alias("level"),
        F.concat(F.lit("Which part is "), F.col("p_name"), F.lit("? ")).alias("question"),
    )


def exam_groups(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    return part.where("p_type <> 'PROMO'").select(
        F.col("p_type").alias("subject"), F.lower("p_type").alias("subject_group")
    ).distinct()


@query(
    "exam_drop_reasons",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'few-shot example'
      WHEN p_size % 4 = 0 THEN 'key not in options' WHEN p_type IN ('PROMO') THEN 'unknown subject' ELSE '' END AS reason FROM part)
    WHERE reason <> '' GROUP BY reason""",
)
def exam_drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return external.drop_reasons(external.classify_exam_rows(exam_rows(spark, sf), exam_groups(spark, sf)))


@query(
    "load_literal_rows",
    """SELECT p_partkey AS id, 'A=' || p_name || ';B=it''s ' || p_brand || ';C=a "' || p_size || '"' AS options,
    CASE WHEN p_size % 2 = 0 THEN 'province' ELSE 'general' END AS level,
    CASE WHEN p_size % 5 = 0 THEN 'key not in options' ELSE '' END AS reason FROM part""",
)
def load_literal_rows(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    rows = part.select(
        F.col("p_partkey").alias("id"),
        F.concat(
            F.lit("['A. "), F.col("p_name"), F.lit("', \"B. it's "), F.col("p_brand"), F.lit("\", 'C. a \""),
            F.col("p_size"), F.lit("\"', 'no letter']"),
        ).alias("options_text"),
        F.when(F.col("p_size") % 5 == 0, F.lit("D")).otherwise(F.lit("C")).alias("key"),
        F.col("p_type").alias("topic"),
        F.when(F.col("p_size") % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("is_specific"),
        F.col("p_brand").alias("province"),
        F.col("p_name").alias("context"),
    )
    done = external.classify_literal_rows(rows)
    letters = F.transform(F.sort_array(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return done.select("id", F.array_join(letters, ";").alias("options"), "level", "reason")


@query(
    "ingest_new_only",
    """SELECT doc_id, source FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)""",
)
def ingest_new_only(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "source", "text")
    return provenance.ingest_new_only(docs, docs.where("doc_id % 3 = 0"), "text").select("doc_id", "source")


@query(
    "write_items_jsonl",
    """SELECT 'c-1' AS canary, '1.5' AS version, '20260901' AS seed, 'benchmark' AS source, count(*) AS n_items,
    min(md5(text)) AS lo, max(md5(text)) AS hi FROM benchmark""",
)
def write_items_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Items and their header, written and read back."""
    path = scratch_path(spark, "items-out")
    records.save_items_jsonl(
        load(spark, sf, "benchmark"), {"canary": "c-1", "version": "1.5", "seed": "20260901", "source": "benchmark"}, path
    )
    both = [f"{path}/items", f"{path}/header"]
    header = records.scan_jsonl_header(spark, both, "canary string, version string, seed string, source string", "text")
    rows = records.scan_jsonl_items(spark, both, "item_id bigint, text string", "text")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.md5("text")).alias("lo"), F.max(F.md5("text")).alias("hi"))
    return header.drop("file").select(
        "*", stats.select("n").scalar().alias("n_items"), stats.select("lo").scalar().alias("lo"), stats.select("hi").scalar().alias("hi")
    )


# columns of each table as both engines spell them alike: amounts in hundredths, times in seconds, vectors in millionths
_PRINTS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "100 c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "100 s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "100 p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "100 o_totalprice", "time o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "100 l_quantity", "100 l_extendedprice", "100 l_discount", "100 l_tax",
        "l_returnflag", "l_linestatus", "time l_shipdate",
    ],
    "events": ["event_id", "time ts", "user_id", "event_type", "10000 value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "vector embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _spelled(column: str) -> tuple[str, str, str]:
    """Name, Spark SQL and DuckDB SQL of a column's text."""
    how, _, name = column.rpartition(" ")
    if how == "time":
        return name, f"CAST(unix_seconds(CAST({name} AS TIMESTAMP)) AS STRING)", f"CAST(CAST(floor(epoch({name})) AS BIGINT) AS VARCHAR)"
    if how == "vector":
        return (
            name, f"array_join(transform({name}, x -> CAST(CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS STRING)), ',')",
            f"array_to_string([CAST(CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR) FOR x IN {name}], ',')",
        )
    if how:
        return name, f"CAST(CAST(floor({name} * {how} + 0.5) AS BIGINT) AS STRING)", f"CAST(CAST(floor({name} * {how} + 0.5) AS BIGINT) AS VARCHAR)"
    return name, f"CAST({name} AS STRING)", f"CAST({name} AS VARCHAR)"


def _fp(table: str, cols: list[str]) -> str:
    texts = [_spelled(c)[2] for c in cols]
    parts = ", ".join(f"coalesce('v' || length({t}) || ':' || {t}, 'n')" for t in texts)
    sums = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)) AS BIGINT) AS sum_digest_{k}" for k in range(1, 5))
    return f"""SELECT '{table}' AS label, count(*) AS n_rows, bit_xor(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS xor_digest, {sums}
    FROM (SELECT sha256(concat_ws('|', {parts})) AS h FROM {table})"""


@query("dataset_fingerprint", " UNION ALL ".join(_fp(t, c) for t, c in _PRINTS.items()))
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    frames = []
    for table, cols in _PRINTS.items():
        spelled = [_spelled(c) for c in cols]
        texts = load(spark, sf, table).selectExpr(*[f"{expr} AS {name}" for name, expr, _ in spelled])
        frames.append(provenance.dataset_fingerprint(texts, [name for name, _, _ in spelled], table))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(
    "upsert_latest",
    """SELECT source, count(*) AS n, 'new' AS version FROM documents WHERE doc_id % 2 = 0 GROUP BY source
    UNION ALL SELECT source, count(*), 'old' FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0) GROUP BY source""",
)
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    old = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit("old"))
    new = docs.where("doc_id % 2 = 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit("new"))
    return provenance.upsert_latest(old, new, ["source"])


@query(
    "require_same_build",
    """SELECT conv_id, turn, CASE WHEN sha = '' THEN 'refused: no hash' WHEN sha = cur THEN 'ok' ELSE 'refused: other build' END AS mc_status,
    CASE WHEN sha = '' THEN 'allowed: no hash' WHEN sha = cur THEN 'ok' ELSE 'refused: other build' END AS free_status
    FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN md5('set-' || (conv_id % 3)) ELSE md5('old') END AS sha,
      md5('set-' || (conv_id % 3)) AS cur FROM conversations)""",
)
def require_same_build(spark: SparkSession, sf: str) -> DataFrame:
    conv = load(spark, sf, "conversations")
    name = F.concat(F.lit("set-"), F.col("conv_id") % 3)
    k = F.col("turn") % 3
    headers = conv.select(
        "conv_id",
        "turn",
        name.alias("question_file"),
        F.when(k == 0, F.lit("")).when(k == 1, F.md5(name)).otherwise(F.md5(F.lit("old"))).alias("sha"),
    )
    manifest = conv.select(name.alias("question_file"), F.md5(name).alias("sha")).distinct()
    strict = provenance.build_status(headers, manifest, True).select("conv_id", "turn", F.col("status").alias("mc_status"))
    loose = provenance.build_status(headers, manifest, False).select("conv_id", "turn", F.col("status").alias("free_status"))
    return strict.join(loose, ["conv_id", "turn"])


@query(
    "merge_keep_extra_columns",
    """SELECT p_partkey, upper(p_name) AS p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS p_brand,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS p_type FROM part""",
)
def merge_keep_extra_columns(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    new = part.select("p_partkey", F.upper("p_name").alias("p_name"))
    old = part.where("p_partkey % 3 <> 0").select("p_partkey", "p_name", "p_brand", "p_type")
    return provenance.merge_keep_extra_columns(new, old, "p_partkey")


_FILL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN ' - ' ELSE o_orderstatus END AS st,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS pr,
  CASE WHEN o_orderkey % 7 = 0 THEN '—' ELSE 'F' END AS s_st, o_orderpriority AS s_pr FROM orders)"""


@query(
    "fill_if_blank",
    f"""SELECT st, pr, count(*) AS n FROM (SELECT CASE WHEN trim(st) = '-' AND s_st <> '—' THEN s_st ELSE st END AS st,
      CASE WHEN pr = '' THEN s_pr ELSE pr END AS pr FROM {_FILL}) GROUP BY ALL""",
)
def fill_if_blank(spark: SparkSession, sf: str) -> DataFrame:
    filled, _ = _filled(spark, sf)
    return filled.groupBy("st", "pr").agg(F.count(F.lit(1)).alias("n"))


def _filled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = load(spark, sf, "orders")
    key = F.col("o_orderkey")
    table = orders.select(
        "o_orderkey",
        F.when(key % 4 == 0, F.lit(" - ")).otherwise(F.col("o_orderstatus")).alias("st"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("pr"),
    )
    source = orders.select(
        "o_orderkey", F.when(key % 7 == 0, F.lit("—")).otherwise(F.lit("F")).alias("st"), F.col("o_orderpriority").alias("pr")
    )
    return provenance.fill_if_blank(table, source, "o_orderkey", ["st", "pr"])


@query(
    "fill_if_blank_report",
    f"""SELECT 'st' AS "column", CAST(count(*) FILTER (trim(st) = '-' AND s_st <> '—') AS BIGINT) AS filled,
      CAST(count(*) FILTER (s_st = '—') AS BIGINT) AS source_blank,
      CAST(count(*) FILTER (s_st <> '—' AND trim(st) <> '-' AND st <> s_st) AS BIGINT) AS kept_different FROM {_FILL}
    UNION ALL SELECT 'pr', CAST(count(*) FILTER (pr = '') AS BIGINT), 0, 0 FROM {_FILL}""",
)
def fill_if_blank_report(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf)[1]


@query(
    "restore_prior_version",
    _fp("customer", _PRINTS["customer"]),
)
def restore_prior_version(spark: SparkSession, sf: str) -> DataFrame:
    spelled = [_spelled(c) for c in _PRINTS["customer"]]
    rows = load(spark, sf, "customer").selectExpr(*[f"{expr} AS {name}" for name, expr, _ in spelled])
    current = rows.withColumn("printed", F.col("c_mktsegment")).withColumn("c_mktsegment", F.lower("c_mktsegment"))
    restored = provenance.restore_prior_version(current, "c_mktsegment", "printed")
    return provenance.dataset_fingerprint(restored, [name for name, _, _ in spelled], "customer")
