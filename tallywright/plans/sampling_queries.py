"""Queries for splits, samples and item clean-up, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.text import lines_of
from tallywright.operators import sampling
from tallywright.plans.registry import load, query
from tallywright.plans.sqlkit import lines, md5


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source")
    quality = load(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    return docs.join(quality, "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, lang, source, CAST(quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def split_sql(seed: int) -> str:
    return f"""SELECT doc_id, lang, source, quality, CASE WHEN row_number() OVER (PARTITION BY lang, quality ORDER BY {md5(seed, 'doc_id')}, doc_id)
      <= round_even(count(*) OVER (PARTITION BY lang, quality) * 70 / 107, 0) THEN 'train' ELSE 'test' END AS side FROM {_LABELLED}"""


def split(spark: SparkSession, sf: str, seed: int = 20260901) -> DataFrame:
    return sampling.stratified_split(labelled(spark, sf), ["lang", "quality"], ["doc_id"], 70, 107, seed)


@query("stratified_split", f"SELECT doc_id, lang, quality, side FROM ({split_sql(20260901)})")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return split(spark, sf).select("doc_id", "lang", "quality", "side")


@query(
    "split_report",
    f"""SELECT lang, quality, count(*) AS n, CAST(count(*) FILTER (side = 'train') AS BIGINT) AS n_train,
    CAST(count(*) FILTER (side = 'test') AS BIGINT) AS n_test, round(count(*) FILTER (side = 'train') / count(*), 6) AS train_share
    FROM ({split_sql(20260901)}) GROUP BY GROUPING SETS ((lang, quality), ())""",
)
def split_report(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_report(split(spark, sf), ["lang", "quality"])


@query(
    "frozen_split_guard",
    f"""SELECT a.doc_id, a.side AS old_side, b.side AS new_side FROM ({split_sql(20260901)}) a JOIN ({split_sql(7)}) b
    ON a.doc_id = b.doc_id WHERE a.side <> b.side""",
)
def frozen_split_guard(spark: SparkSession, sf: str) -> DataFrame:
    same = sampling.frozen_split_guard(split(spark, sf), split(spark, sf), "doc_id")
    return sampling.split_differences(same, split(spark, sf, 7), "doc_id")


_LR = """WITH c AS (SELECT {keys}, count(*) AS supply FROM {table} GROUP BY {keys}),
  t AS (SELECT *, {n} * supply // (SELECT sum(supply) FROM c) AS fl, {n} * supply % (SELECT sum(supply) FROM c) AS rem FROM c),
  s AS (SELECT {keys}, supply, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, {keys}) <= {n} - (SELECT sum(fl) FROM t) THEN 1 ELSE 0 END AS seats FROM t)"""


@query(
    "largest_remainder_allocation",
    _LR.format(keys="l_returnflag, l_linestatus, l_linenumber", table="lineitem", n=1001)
    + " SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber, supply, CAST(seats AS BIGINT) AS seats FROM s",
)
def largest_remainder_allocation(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    return sampling.largest_remainder(li, ["l_returnflag", "l_linestatus", "l_linenumber"], 1001)


@query(
    "largest_remainder_sample",
    _LR.format(keys="lang, source", table="documents", n=101)
    + f""" SELECT doc_id, lang, source FROM (SELECT doc_id, d.lang, d.source, seats,
      row_number() OVER (PARTITION BY d.lang, d.source ORDER BY {md5(3, 'doc_id')}, doc_id) AS rn FROM documents d JOIN s USING (lang, source)) WHERE rn <= seats""",
)
def largest_remainder_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source")
    return sampling.largest_remainder_sample(docs, ["lang", "source"], ["doc_id"], 101, 3)


@query(
    "equal_quota_sample",
    f"""SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {md5(5, 'event_id')}, event_id) AS rn
    FROM events) WHERE rn <= 50""",
)
def equal_quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select("event_id", "event_type")
    return sampling.equal_quota_sample(ev, "event_type", ["event_id"], 50, 5)


_WF = """WITH RECURSIVE c AS (SELECT {cat} AS category, count(*) AS supply, row_number() OVER (ORDER BY count(*), {cat}) AS i,
    count(*) OVER () AS m FROM {table} GROUP BY {cat}),
  w AS (SELECT category, supply, i, m, least(supply, {n} // m) AS seats, {n} - least(supply, {n} // m) AS rest FROM c WHERE i = 1
    UNION ALL SELECT c.category, c.supply, c.i, c.m, least(c.supply, w.rest // (c.m - c.i + 1)), w.rest - least(c.supply, w.rest // (c.m - c.i + 1))
    FROM w JOIN c ON c.i = w.i + 1)"""
_PAIR = "(SELECT *, lang || '-' || (doc_id % 13 * doc_id % 7) AS mix FROM documents)"


@query(
    "waterfill_allocation",
    _WF.format(cat="mix", table=_PAIR, n=421) + " SELECT category AS mix, supply, CAST(seats AS BIGINT) AS seats FROM w",
)
def waterfill_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.waterfill(mixed(spark, sf), "mix", 421)


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    mix = F.concat("lang", F.lit("-"), F.col("doc_id") % 13 * F.col("doc_id") % 7)
    return load(spark, sf, "documents").select("doc_id", mix.alias("mix"))


@query(
    "waterfill_sample",
    _WF.format(cat="mix", table=_PAIR, n=421)
    + f""" SELECT doc_id, mix FROM (SELECT doc_id, mix, seats, row_number() OVER (PARTITION BY mix ORDER BY {md5(11, 'doc_id')}, doc_id) AS rn
      FROM {_PAIR} JOIN w ON w.category = mix) WHERE rn <= seats""",
)
def waterfill_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.waterfill_sample(mixed(spark, sf), "mix", ["doc_id"], 421, 11)


@query(
    "carve_validation",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {md5(13, 'doc_id')}, doc_id) <= greatest(1, count(*) OVER () * 5 // 100)
    THEN 'validation' ELSE 'train' END AS part FROM documents""",
)
def carve_validation(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.carve_validation(load(spark, sf, "documents").select("doc_id"), ["doc_id"], 13)


@query(
    "held_out_subset_check",
    f"""WITH s AS (SELECT d.doc_id, side, 'Which is ' || text || '?' AS q, 'What is ' || text || '?' AS q2 FROM ({split_sql(20260901)}) x JOIN documents d ON d.doc_id = x.doc_id)
    SELECT CAST(0 AS BIGINT) AS outside, CAST(count(*) FILTER (side = 'train') AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS shared_questions,
    count(*) FILTER (side = 'train') > 0 AS ok FROM s""",
)
def held_out_subset_check(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    full = docs.select("doc_id", F.concat(F.lit("Which is "), "t", F.lit("?")).alias("question"))
    held = (
        split(spark, sf).where("side = 'test'").select("doc_id").join(docs, "doc_id")
        .select("doc_id", F.concat(F.lit("What is "), "t", F.lit("?")).alias("question"))
    )
    return sampling.held_out_subset_check(full, held, "doc_id", "question")


# next-line items over whole documents

NEXT_SQL = f"""SELECT doc_id, i AS pos, ls[i] AS question, ls[i + 1] AS answer, lang FROM (
  SELECT doc_id, lang, ls, unnest(range(1, len(ls))) AS i FROM (SELECT doc_id, lang, {lines('text')} AS ls FROM documents))"""


def next_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line i asks for line i + 1, from the array of one document: no shuffle."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", lines_of(F.col("text")).alias("ls"))
    pairs = F.transform(
        F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))),
        lambda nxt, i: F.struct((i + 1).cast("bigint").alias("pos"), F.get("ls", i).alias("question"), nxt.alias("answer")),
    )
    return docs.select("doc_id", "lang", F.explode(pairs).alias("x")).select(
        "doc_id", "x.*", "lang"
    )


@query("dedupe_items", f"SELECT doc_id, pos, md5(question) AS question, md5(answer) AS answer FROM ({NEXT_SQL}) QUALIFY row_number() OVER (PARTITION BY question, answer ORDER BY doc_id, pos) = 1")
def dedupe_items(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.dedupe_items(next_lines(spark, sf), ["doc_id", "pos"]).select(
        "doc_id", "pos", F.md5("question").alias("question"), F.md5("answer").alias("answer")
    )


@query(
    "drop_clashing",
    f"""WITH x AS ({NEXT_SQL}) SELECT doc_id, pos FROM x WHERE question NOT IN
    (SELECT question FROM x GROUP BY question HAVING count(DISTINCT answer) > 1)""",
)
def drop_clashing(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.drop_clashing(next_lines(spark, sf)).select("doc_id", "pos")


@query(
    "clashing_questions",
    f"SELECT md5(question) AS question, count(*) AS n_items FROM ({NEXT_SQL}) x GROUP BY x.question HAVING count(DISTINCT answer) > 1",
)
def clashing_questions(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.clashing_questions(next_lines(spark, sf)).select(F.md5("question").alias("question"), "n_items")


_SIDES = f"""WITH x AS (SELECT n.*, side FROM ({NEXT_SQL}) n JOIN ({split_sql(20260901)}) s ON s.doc_id = n.doc_id),
  tr AS (SELECT doc_id AS record, question, md5(question || answer) AS unit FROM x WHERE side = 'train'),
  te AS (SELECT doc_id AS record, question, md5(question || answer) AS unit FROM x WHERE side = 'test')"""


@query(
    "side_leak_gates",
    _SIDES
    + """, g AS (SELECT 'records on both sides' AS gate, (SELECT count(*) FROM (SELECT DISTINCT record FROM tr) JOIN (SELECT DISTINCT record FROM te) USING (record)) AS value
    UNION ALL SELECT 'reserved content in training', (SELECT count(*) FROM (SELECT DISTINCT unit FROM tr) JOIN (SELECT DISTINCT unit FROM te) USING (unit))
    UNION ALL SELECT 'same question on both sides', (SELECT count(*) FROM te WHERE question IN (SELECT question FROM tr)))
    SELECT gate, value, value = 0 AS passed FROM g""",
)
def side_leak_gates(spark: SparkSession, sf: str) -> DataFrame:
    items = next_lines(spark, sf).join(split(spark, sf).select("doc_id", "side"), "doc_id").select(
        F.col("doc_id").alias("record"), "question", F.md5(F.concat("question", "answer")).alias("unit"), "side"
    )
    train, test = items.where("side = 'train'"), items.where("side = 'test'")
    return sampling.side_leak_gates(train, test, test.select("unit"), items, "split")


_ALL = f"""WITH x AS (SELECT doc_id, pos, question, md5(question || answer) AS unit FROM ({NEXT_SQL})),
  tr AS (SELECT doc_id AS record, question, unit FROM x WHERE pos % 2 = 0), te AS (SELECT doc_id AS record, question, unit FROM x WHERE pos % 2 = 1)"""


@query(
    "side_leak_gates_all",
    _ALL
    + """, g AS (SELECT 'records without a training item' AS gate, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT record FROM tr)) AS value
    UNION ALL SELECT 'reserved content in training', (SELECT count(*) FROM (SELECT DISTINCT unit FROM tr) JOIN (SELECT DISTINCT unit FROM te) USING (unit))
    UNION ALL SELECT 'same question on both sides', (SELECT count(*) FROM te WHERE question IN (SELECT question FROM tr)))
    SELECT gate, value, value = 0 AS passed FROM g""",
)
def side_leak_gates_all(spark: SparkSession, sf: str) -> DataFrame:
    """The regime in which every record is on both sides and only its content is kept apart."""
    items = next_lines(spark, sf).select(F.col("doc_id").alias("record"), "pos", "question", F.md5(F.concat("question", "answer")).alias("unit"))
    train, test = items.where("pos % 2 = 0"), items.where("pos % 2 = 1")
    records = load(spark, sf, "documents").select(F.col("doc_id").alias("record"))
    return sampling.side_leak_gates(train, test, test.select("unit"), records, "all")


@query(
    "checked_sides",
    _SIDES
    + """, kept AS (SELECT * FROM tr WHERE unit NOT IN (SELECT unit FROM te) AND question NOT IN (SELECT question FROM te))
    SELECT 'train' AS side, record, count(*) AS n FROM kept GROUP BY record UNION ALL SELECT 'test', record, count(*) FROM te GROUP BY record""",
)
def checked_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Items per record of two sides that have passed the leak gates and the gate of the wordings."""
    from tallywright.operators import gates
    from tallywright.plans.item_queries import TEMPLATES, TEST_TEMPLATES

    items = next_lines(spark, sf).join(split(spark, sf).select("doc_id", "side"), "doc_id").select(
        F.col("doc_id").alias("record"), F.md5("question").alias("question"), F.md5(F.concat("question", "answer")).alias("unit"), "side"
    )
    test = items.where("side = 'test'")
    train = items.where("side = 'train'").join(test.select("unit").distinct(), "unit", "left_anti").join(test.select("question").distinct(), "question", "left_anti")
    wordings = [(k, side, i == 0, w) for side, table in (("train", TEMPLATES), ("test", TEST_TEMPLATES)) for k, ws in table.items() for i, w in enumerate(ws)]
    templates = spark.createDataFrame(wordings, "category string, side string, is_base boolean, wording string")
    sides = gates.checked_sides(train, test, test.select("unit"), items, "split", templates)
    counts = [side.groupBy("record").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "record", "n") for name, side in zip(("train", "test"), sides, strict=True)]
    return counts[0].unionByName(counts[1])


@query(
    "mixture_summary",
    """SELECT mix, n, round(n / sum(n) OVER (), 6) AS share, n <= 20 OR n / sum(n) OVER () >= 0.03 AS ok FROM
    (SELECT lang || '-' || (doc_id % 13 * doc_id % 7) AS mix, count(*) AS n FROM documents GROUP BY 1)""",
)
def mixture_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.mixture_summary(mixed(spark, sf), "mix", 0.03)


@query(
    "flagship",
    f"""WITH x AS ({NEXT_SQL}), ok AS (SELECT * FROM x WHERE question NOT IN (SELECT question FROM x GROUP BY question HAVING count(DISTINCT answer) > 1))
    SELECT s.lang, side, count(*) AS n_items, count(DISTINCT ok.doc_id) AS n_records FROM ok JOIN ({split_sql(20260901)}) s ON s.doc_id = ok.doc_id
    GROUP BY GROUPING SETS ((s.lang, side), ())""",
)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Next-line items, clashes dropped, on a stratified split, counted per side and language."""
    items = sampling.drop_clashing(next_lines(spark, sf)).select("doc_id")
    per_doc = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    joined = split(spark, sf).select("doc_id", "lang", "side").join(per_doc, "doc_id")
    return joined.groupingSets([["lang", "side"], []], "lang", "side").agg(
        F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_records")
    )
