"""Queries for excerpts and free-form question generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.text import STOPWORDS, lines_of
from tallywright.operators import excerpts, generation, sampling
from tallywright.operators.ranking import deal, join_null_safe
from tallywright.plans.registry import load, query
from tallywright.plans.sqlkit import gives_away, lines, md5, number, words
from tallywright.session import materialise

SIZES = [2, 4, 8]


def records(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """Documents as records: lines are bars, the title is the last line's first word. only: doc_id, a few of them.

    Records are dealt by id before they are cut: what is cut from them is many times their size and never moves.
    """
    read = load(spark, sf, "documents").select("doc_id", "text", "lang")
    if only is not None:
        read = join_null_safe(read, F.broadcast(only), ["doc_id"], "left_semi")
    docs = deal(read, "doc_id").select("doc_id", "text", "lang", lines_of(F.col("text")).alias("ls"))
    title = F.coalesce(F.regexp_extract(F.get("ls", F.size("ls") - 1), r"^(\S+)", 1), F.lit(""))
    return docs.withColumn("title", title).withColumn("name", F.concat("title", F.lit(" "), "doc_id"))


REC = f"""rec AS MATERIALIZED (SELECT doc_id, text, lang, ls, coalesce(regexp_extract(ls[len(ls)], '^(\\S+)', 1), '') AS title,
  coalesce(regexp_extract(ls[len(ls)], '^(\\S+)', 1), '') || ' ' || doc_id AS name FROM (SELECT doc_id, text, lang, {lines('text')} AS ls FROM documents))"""
SLIDE = """sl AS (SELECT doc_id, title, name, n, s, array_to_string(ls[s + 1 : s + n], ' | ') AS excerpt FROM (
  SELECT doc_id, title, name, ls, n, unnest(range(0, len(ls) - n + 1)) AS s FROM rec, (VALUES (2), (4), (8)) z(n) WHERE len(ls) >= n))"""
OWN = "own AS (SELECT excerpt, count(DISTINCT title) AS n_owners FROM sl GROUP BY excerpt)"


@query("sliding_excerpts", f"WITH {REC}, {SLIDE} SELECT doc_id, CAST(n AS BIGINT) AS n, count(*) AS n_windows, max(md5(excerpt)) AS top_digest, CAST(sum(length(excerpt)) AS BIGINT) AS chars FROM sl GROUP BY doc_id, n")
def sliding_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    cut = excerpts.sliding_excerpts(records(spark, sf).select("doc_id", "ls"), "ls", SIZES)
    return cut.groupBy("doc_id", F.col("n").cast("bigint").alias("n")).agg(
        F.count(F.lit(1)).alias("n_windows"), F.max(F.md5("excerpt")).alias("top_digest"), F.sum(F.length("excerpt")).alias("chars")
    )


@query(
    "tiling_excerpts",
    f"""WITH {REC} SELECT doc_id, CAST(n AS BIGINT) AS n, s + 1 AS first_bar, s + n AS last_bar, md5(array_to_string(ls[s + 1 : s + n], ' | ')) AS digest FROM (
    SELECT doc_id, ls, n, unnest(range(0, len(ls) - n + 1, n)) AS s FROM rec, (VALUES (2), (4), (8)) z(n) WHERE len(ls) >= n)""",
)
def tiling_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    cut = excerpts.tiling_excerpts(records(spark, sf).select("doc_id", "ls"), "ls", SIZES)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return cut.select("doc_id", big("n"), big("first_bar"), big("last_bar"), F.md5("excerpt").alias("digest"))


@query(
    "excerpt_owners",
    f"WITH {REC}, {SLIDE}, {OWN} SELECT n_owners, count(*) AS n_excerpts, min(md5(excerpt)) AS lo, max(md5(excerpt)) AS hi FROM own GROUP BY n_owners",
)
def excerpt_owners(spark: SparkSession, sf: str) -> DataFrame:
    cut = excerpts.sliding_excerpts(records(spark, sf).select("title", "ls"), "ls", SIZES)
    own = excerpts.excerpt_owners(cut, "title").withColumn("hex", F.lower(F.hex("gram")))
    return own.groupBy("n_owners").agg(F.count(F.lit(1)).alias("n_excerpts"), F.min("hex").alias("lo"), F.max("hex").alias("hi"))


@query(
    "word_gram_owners",
    """WITH g AS (SELECT doc_id, array_to_string(ws[s : s + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS s FROM (
      SELECT doc_id, [w for w in regexp_split_to_array(lower(text), '\\s+') if w <> ''] AS ws FROM documents) WHERE len(ws) >= 8))
    SELECT n_owners, count(*) AS n_grams FROM (SELECT gram, count(DISTINCT doc_id) AS n_owners FROM g GROUP BY gram) GROUP BY n_owners""",
)
def word_gram_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Eight-word grams over whole texts and how many documents hold each."""
    docs = deal(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("ws"))
    grams = excerpts.sliding_excerpts(docs, "ws", [8])
    return excerpts.excerpt_owners(grams, "doc_id").groupBy("n_owners").agg(F.count(F.lit(1)).alias("n_grams"))


@query(
    "drop_ambiguous",
    f"""WITH {REC}, {SLIDE}, {OWN} SELECT doc_id, CAST(n AS BIGINT) AS n, s AS start, category FROM (SELECT sl.*, CASE WHEN (doc_id + s) % 3 = 0 THEN 'other' ELSE 'excerpt_to_title' END AS category, n_owners
    FROM sl JOIN own USING (excerpt)) WHERE category = 'other' OR n_owners = 1""",
)
def drop_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    cut = excerpts.sliding_excerpts(records(spark, sf).select("doc_id", "title", "ls"), "ls", SIZES)
    shared = excerpts.shared_excerpts(cut, "title")
    items = cut.withColumn("category", F.when((F.col("doc_id") + F.col("start")) % 3 == 0, F.lit("other")).otherwise(F.lit("excerpt_to_title")))
    kept = excerpts.drop_ambiguous(items, shared, F.col("excerpt"), F.col("category") == "excerpt_to_title")
    return kept.select("doc_id", F.col("n").cast("bigint").alias("n"), F.col("start").cast("bigint").alias("start"), "category")


_NOTES = f"""nt AS (SELECT doc_id, title, name, n, s, excerpt, [w for w in regexp_split_to_array(excerpt, '\\s+') if w NOT IN ('', '|')] AS ws FROM sl)"""
_INFO = "len(ws) >= 4 AND len(list_distinct([length(w) for w in ws])) >= 3"


@query(
    "informative_excerpt",
    f"WITH {REC}, {SLIDE}, {_NOTES} SELECT doc_id, CAST(n AS BIGINT) AS n, count(*) AS n_windows, CAST(count(*) FILTER ({_INFO}) AS BIGINT) AS n_informative FROM nt GROUP BY doc_id, n",
)
def informative_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    cut = excerpts.sliding_excerpts(records(spark, sf).select("doc_id", "ls"), "ls", SIZES)
    noted = cut.select("doc_id", "n", excerpts.word_notes(F.col("excerpt")).alias("notes"))
    return noted.groupBy("doc_id", F.col("n").cast("bigint").alias("n")).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(excerpts.informative_excerpt(F.col("notes"))).alias("n_informative")
    )


_TOP = "list_max([lpad(CAST(length(w) AS VARCHAR), 6, '0') || w for w in ws])"


@query(
    "highest_in_excerpt",
    f"""WITH {REC}, {SLIDE}, {_NOTES} SELECT doc_id, CAST(n AS BIGINT) AS n, s AS start, substr({_TOP}, 7) AS highest,
    CAST(len(list_distinct(ws)) - 1 AS BIGINT) AS n_others FROM nt WHERE len(ws) > 0""",
)
def highest_in_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    cut = excerpts.sliding_excerpts(records(spark, sf).select("doc_id", "ls"), "ls", SIZES)
    noted = cut.withColumn("notes", excerpts.word_notes(F.col("excerpt"))).where(F.size("notes") > 0)
    return noted.select(
        "doc_id", F.col("n").cast("bigint").alias("n"), F.col("start").cast("bigint").alias("start"),
        excerpts.highest_in_excerpt(F.col("notes")).alias("highest"),
        F.size(excerpts.other_tokens(F.col("notes"))).cast("bigint").alias("n_others"),
    )


# free-form families

TEMPLATES = {
    "maker": ["Who makes {name}?", "Name the maker of {name}.", "{name} is made by whom?"],
    "kind": ["Of what kind is {name}?", "State the kind of {name}."],
    "size": ["What size is {name}?", "Give the size of {name}.", "How large is {name}?"],
    "verify": ["Is it true that {name} {phrase} {value}?", "Judge this: {name} {phrase} {value}.", "{name} {phrase} {value}, true or false?"],
    "excerpt_to_title": ["Which record holds this passage?\n{excerpt}"],
    "line_to_title": ["Which record holds this line?\n{line}"],
    "next_line": ["Continue {name} after this line.\n{line}"],
    "cloze": ["Fill the gap in this line of {name}.\n{line}"],
    "title_to_text": ["Write out {name}.", "What does {name} say?"],
    "title_to_line": ["Write line {n} of {name}."],
    "title_to_bars": ["Write bars {a} to {b} of {name}."],
    "highest_note": ["Which is the longest word here?\n{excerpt}"],
    "count_bars": ["How many bars are here?\n{excerpt}"],
}
# the test side asks in other words
TEST_TEMPLATES = {
    "maker": ["By whom was {name} made?"],
    "kind": ["Which kind does {name} belong to?"],
    "size": ["{name} comes in which size?"],
    "verify": ["Is this statement right: {name} {phrase} {value}?"],
    "excerpt_to_title": ["Tell the record from this passage.\n{excerpt}"],
    "line_to_title": ["Tell the record that has this line.\n{line}"],
    "next_line": ["Which line follows in {name}?\n{line}"],
    "cloze": ["Which word is missing from this line of {name}?\n{line}"],
    "title_to_text": ["How does {name} read?"],
    "title_to_line": ["Line {n} of {name} reads how?"],
    "title_to_bars": ["How do bars {a} to {b} of {name} go?"],
    "highest_note": ["Point out the longest word.\n{excerpt}"],
    "count_bars": ["Count the bars.\n{excerpt}"],
}

FACTS = [
    generation.Fact("maker", "maker", "The sheet names no maker of {name}."),
    generation.Fact("kind", "p_type"),
    generation.Fact("size", "p_size", answer="size {value}", printed_if="p_partkey % 3 <> 0"),
]


def parts(spark: SparkSession, sf: str) -> DataFrame:
    maker = F.when(F.col("p_size") % 10 == 0, F.lit("-")).otherwise(F.col("p_brand"))
    return load(spark, sf, "part").select(
        "p_partkey", "p_type", "p_size", maker.alias("maker"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name")
    )


PARTS = """pt AS (SELECT p_partkey, p_type, p_size, CASE WHEN p_size % 10 = 0 THEN '-' ELSE p_brand END AS maker, p_name || ' ' || p_partkey AS name FROM part)"""


def _fact_sql(templates: dict, side: str) -> str:
    out = []
    for w in generation.wordings(templates, "maker", side):
        out.append(
            f"SELECT p_partkey AS record, CASE WHEN maker = '-' THEN 'maker_abstain' ELSE 'maker' END AS category, replace('{w}', '{{name}}', name) AS question, "
            "CASE WHEN maker = '-' THEN 'The sheet names no maker of ' || name || '.' ELSE maker END AS answer FROM pt"
        )
    for w in generation.wordings(templates, "kind", side):
        out.append(f"SELECT p_partkey, 'kind', replace('{w}', '{{name}}', name), p_type FROM pt")
    for w in generation.wordings(templates, "size", side):
        out.append(f"SELECT p_partkey, 'size', replace('{w}', '{{name}}', name), 'size ' || p_size FROM pt WHERE p_partkey % 3 <> 0")
    return " UNION ALL ".join(out)


@query("fact_items", f"WITH {PARTS} {_fact_sql(TEST_TEMPLATES, 'test')}")
def fact_items(spark: SparkSession, sf: str) -> DataFrame:
    return generation.fact_items(parts(spark, sf), "p_partkey", "name", FACTS, TEST_TEMPLATES, "test").select(
        "record", "category", "question", "answer"
    )


@query("paraphrase_expand", f"WITH {PARTS} {_fact_sql(TEMPLATES, 'train')}")
def paraphrase_expand(spark: SparkSession, sf: str) -> DataFrame:
    return generation.fact_items(parts(spark, sf), "p_partkey", "name", FACTS, TEMPLATES, "train").select(
        "record", "category", "question", "answer"
    )


def pick_sql(items: str, domain: str, k: int, seed: str, at_most: bool = False, tag: str = "") -> str:
    """CTEs: items(key, value), domain(value) -> picked(key, j, other)."""
    n = f"least(m - 1, {k})" if at_most else str(k)
    repeats = " OR ".join([f"({n} > {j} AND s0 * {j} % (m - 1) = 0)" for j in range(1, k)]) or "false"
    return f"""dom{tag} AS (SELECT value, row_number() OVER (ORDER BY {md5(seed, 'value')}, value) AS pos, count(*) OVER () AS m FROM (SELECT DISTINCT value FROM {domain})),
ask{tag} AS (SELECT i.key, i.value, pos AS own, m, {number(seed + '-start', 'key')} % (m - 1) AS h, 1 + {number(seed + '-stride', 'key')} % greatest(m - 2, 1) AS s0
  FROM {items} i JOIN dom{tag} d ON d.value = i.value WHERE m - 1 >= {1 if at_most else k}),
picked{tag} AS (SELECT key, j, d.value AS other FROM (SELECT key, j, (own + (h + j * CASE WHEN {repeats} THEN 1 ELSE s0 END) % (m - 1)) % m + 1 AS pos
  FROM ask{tag}, (SELECT unnest(range({k})) AS j) WHERE j < {n}) a JOIN dom{tag} d ON d.pos = a.pos)"""


def _verify_sql(side: str, templates: dict) -> str:
    ws = generation.wordings(templates, "verify", side)
    k = 4 if side == "train" else 1
    out, ctes = [], []
    for cat, col, phrase in (("maker", "maker", "is made by"), ("kind", "p_type", "is of kind")):
        src = f"(SELECT p_partkey AS key, name, trim({col}) AS value FROM pt WHERE trim({col}) NOT IN ('', '-', '–', '—'))"
        ctes.append(pick_sql(src, src, k, f"v1-{cat}", True, f"_{cat}"))
        say = lambda w, v, p=phrase: f"replace(replace(replace({w}, '{{name}}', name), '{{phrase}}', '{p}'), '{{value}}', {v})"
        for w in ws:
            q = w.replace("'", "''")
            out.append(f"SELECT key AS record, 'verify_{cat}' AS category, {say(chr(39) + q + chr(39), 'value')} AS question, 'True. ' || name || ' {phrase} ' || value || '.' AS answer FROM {src}")
        arr = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"
        out.append(
            f"SELECT p.key, 'verify_{cat}', {say(f'{arr}[1 + j % {len(ws)}]', 'other')}, 'False. ' || name || ' {phrase} ' || value || ', not ' || other || '.' FROM picked_{cat} p JOIN {src} s ON s.key = p.key"
        )
    return f"WITH {PARTS}, {', '.join(ctes)} " + " UNION ALL ".join(out)


VERIFY = [("maker", "maker", "is made by"), ("kind", "p_type", "is of kind")]


@query("verify_items_train", _verify_sql("train", TEMPLATES))
def verify_items_train(spark: SparkSession, sf: str) -> DataFrame:
    return generation.verify_items(parts(spark, sf), "p_partkey", "name", VERIFY, TEMPLATES["verify"], "train", "v1").select(
        "record", "category", "question", "answer"
    )


@query("verify_items_test", _verify_sql("test", TEST_TEMPLATES))
def verify_items_test(spark: SparkSession, sf: str) -> DataFrame:
    return generation.verify_items(parts(spark, sf), "p_partkey", "name", VERIFY, TEST_TEMPLATES["verify"], "test", "v1").select(
        "record", "category", "question", "answer"
    )


_DIG = "record, category, md5(question) AS question, md5(answer) AS answer, md5(unit) AS unit"


def digests(df: DataFrame) -> DataFrame:
    return df.select("record", "category", *[F.md5(c).alias(c) for c in ("question", "answer", "unit")])


def _q(templates: dict, cat: str, i: int = 0, **parts: str) -> str:
    out = "'" + templates[cat][i].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, col in parts.items():
        out = f"replace({out}, '{{{name}}}', {col})"
    return out


def family_sql(t: dict, side: str, seed: str) -> dict[str, str]:
    """One SELECT per family: record, category, question, answer, unit."""
    cut = f"(SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY {md5(seed, 'doc_id', 'n', 's')}, s) AS rk FROM nt)"
    ln = "(SELECT doc_id, title, name, i - 1 AS i, ls[i] AS line, ls[i + 1] AS nxt FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM rec))"
    bare = r"lower(regexp_replace(w, '[^\p{L}\p{N}_''-]', '', 'g'))"
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    wd = f"""(SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY {md5(seed, 'doc_id', 'i', 'j')}, j) AS rk FROM (
      SELECT doc_id, name, i, ws, j, ws[j + 1] AS w FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS j FROM (SELECT *, {words('line')} AS ws FROM {ln}) WHERE len(ws) >= 4))
      WHERE length({bare}) > 2 AND {bare} NOT IN ({stop}) AND len([x for x in ws if x = w]) = 1)"""
    cnt = f"""(SELECT doc_id, n, array_to_string(ls[st + 1 : st + n], ' | ') AS excerpt FROM (SELECT *, {number(seed + '-at', 'doc_id', 'n')} % (len(ls) - n + 1) AS st,
      row_number() OVER (PARTITION BY doc_id ORDER BY {md5(seed + '-length', 'doc_id', 'n')}, n) AS rk FROM rec, (SELECT unnest(range(3, 13)) AS n) WHERE len(ls) >= n))"""
    texts = " UNION ALL ".join(
        f"SELECT doc_id AS record, 'title_to_text' AS category, {_q(t, 'title_to_text', i, name='name')} AS question, trim(text) AS answer, CAST(NULL AS VARCHAR) AS unit FROM rec WHERE len(ls) > 0"
        for i in range(len(generation.wordings(t, "title_to_text", side)))
    )
    return {
        "excerpt_to_title": f"SELECT doc_id AS record, 'excerpt_to_title' AS category, {_q(t, 'excerpt_to_title', excerpt='excerpt')} AS question, title AS answer, 'excerpt|' || excerpt AS unit FROM {cut} WHERE {_INFO}",
        "line_to_title": f"SELECT doc_id AS record, 'line_to_title' AS category, {_q(t, 'line_to_title', line='line')} AS question, title AS answer, 'line|' || doc_id || '|' || i AS unit FROM {ln} WHERE NOT {gives_away('title', 'line')}",
        "next_line": f"SELECT doc_id AS record, 'next_line' AS category, {_q(t, 'next_line', name='name', line='line')} AS question, nxt AS answer, 'pair|' || doc_id || '|' || i AS unit FROM {ln} WHERE nxt IS NOT NULL",
        "cloze": f"""SELECT doc_id AS record, 'cloze' AS category, {_q(t, 'cloze', name='name', line="array_to_string(list_transform(ws, lambda x, p: CASE WHEN p = j + 1 THEN '____' ELSE x END), ' ')")} AS question, w AS answer, 'cloze|' || doc_id || '|' || i || '|' || j AS unit FROM {wd} WHERE rk <= 3""",
        "recall": f"""{texts} UNION ALL SELECT doc_id, 'title_to_line', {_q(t, 'title_to_line', name='name', n='CAST(i + 1 AS VARCHAR)')}, line, 'line|' || doc_id || '|' || i FROM {ln}
          UNION ALL SELECT doc_id, 'title_to_bars', {_q(t, 'title_to_bars', name='name', a='CAST(s + 1 AS VARCHAR)', b='CAST(s + n AS VARCHAR)')}, array_to_string(ls[s + 1 : s + n], ' | '), 'bars|' || doc_id || '|' || s || '|' || n
          FROM (SELECT doc_id, name, ls, n, unnest(range(0, len(ls) - n + 1, n)) AS s FROM rec, (VALUES (2), (4), (8)) z(n) WHERE len(ls) >= n)""",
        "reasoning": f"""SELECT doc_id AS record, 'highest_note' AS category, {_q(t, 'highest_note', excerpt='excerpt')} AS question, substr({_TOP}, 7) AS answer, 'excerpt|' || excerpt AS unit FROM {cut} WHERE len(ws) > 0
          UNION ALL SELECT doc_id, 'count_bars', {_q(t, 'count_bars', excerpt='excerpt')}, CAST(n AS VARCHAR), 'excerpt|' || excerpt FROM {cnt}""",
    }


def families(recs: DataFrame, t: dict, side: str, seed: str, limit: int | None = None) -> dict[str, DataFrame]:
    notes = excerpts.word_notes
    return {
        "excerpt_to_title": generation.excerpt_to_title_items(recs, "doc_id", "title", "ls", t["excerpt_to_title"][0], limit, seed, notes),
        "line_to_title": generation.line_to_title_items(recs, "doc_id", "title", "ls", t["line_to_title"][0], limit),
        "next_line": generation.next_line_items(recs, "doc_id", "name", "ls", t["next_line"][0], limit),
        "cloze": generation.cloze_items(recs, "doc_id", "name", "ls", t["cloze"][0], limit, seed),
        "recall": generation.recall_items(recs, "doc_id", "name", "ls", "text", "ls", t, side, limit),
        "reasoning": generation.reasoning_items(recs, "doc_id", "ls", t, limit, seed, notes),
    }


_BASE = f"WITH {REC}, {SLIDE}, {_NOTES}"
_TRAIN_SQL = family_sql(TEMPLATES, "train", "g1")


def _register(name: str) -> None:
    @query(f"{name}_items", f"{_BASE} SELECT {_DIG} FROM ({_TRAIN_SQL[name]})")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return digests(families(records(spark, sf), TEMPLATES, "train", "g1")[name])


for _name in _TRAIN_SQL:
    _register(_name)


def side_of(recs: DataFrame, side: str, reserved: DataFrame | None = None) -> DataFrame:
    t, seed = (TEMPLATES, "g1") if side == "train" else (TEST_TEMPLATES, "g2")
    return generation.assemble_side(list(families(recs, t, side, seed).values()), reserved)


def side_items(spark: SparkSession, sf: str, side: str, reserved: DataFrame | None = None) -> DataFrame:
    return side_of(records(spark, sf), side, reserved)


def _side_sql(side: str) -> str:
    t, seed = (TEMPLATES, "g1") if side == "train" else (TEST_TEMPLATES, "g2")
    union = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in family_sql(t, side, seed).values())
    return f"""(SELECT *, CASE WHEN category IN ('highest_note', 'count_bars') THEN 'reasoning' ELSE 'recall' END AS level FROM ({union})
      WHERE trim(answer) <> '' AND (category IN ('highest_note', 'count_bars', 'title_to_bars', 'kind') OR NOT {gives_away('answer', 'question')}))"""


def test_side(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty items of every category from the test side.

    All items are compared as digests; only the records of those that are drawn are spelled out again.
    """
    drawn = materialise(sampling.drawn_keys(side_items(spark, sf, "test"), "record", "category", 50, "pick"), "drawn")
    few = drawn.select(F.col("record").alias("doc_id")).distinct()
    spelled = side_of(records(spark, sf, few), "test").withColumn("pair", sampling.pair_key(F.col("question"), F.col("answer")))
    asked = join_null_safe(spelled, F.broadcast(drawn), ["pair", "record", "category"], "left_semi").drop("pair")
    items = sampling.first_of_group(asked, ["question", "answer"], ["record", "category", "unit"])
    return sampling.equal_quota_sample(items, "category", ["record", "question", "answer"], 50, "pick")


_TEST_SQL = f"""test0 AS (SELECT * FROM {_side_sql('test')} QUALIFY row_number() OVER (PARTITION BY question, answer ORDER BY record, category, unit) = 1),
test AS (SELECT * FROM test0 QUALIFY row_number() OVER (PARTITION BY category ORDER BY {md5('pick', 'record', 'question', 'answer')}, record, question, answer) <= 50)"""


@query("test_side", f"{_BASE}, {_TEST_SQL} SELECT record, category, level, md5(question) AS question, md5(answer) AS answer FROM test")
def test_side_query(spark: SparkSession, sf: str) -> DataFrame:
    return test_side(spark, sf).select("record", "category", "level", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query(
    "assemble_side",
    f"""{_BASE}, {_TEST_SQL} SELECT category, level, count(*) AS n, count(DISTINCT record) AS n_records, min(md5(question || answer)) AS lo, max(md5(question || answer)) AS hi
    FROM {_side_sql('train')} WHERE unit IS NULL OR unit NOT IN (SELECT unit FROM test WHERE unit IS NOT NULL) GROUP BY category, level""",
)
def assemble_side(spark: SparkSession, sf: str) -> DataFrame:
    # at most fifty units a category, against whole items that would be shuffled to meet them
    reserved = materialise(generation.content_units(test_side(spark, sf)), "reserved")
    train = side_items(spark, sf, "train", F.broadcast(reserved))
    both = F.md5(F.concat("question", "answer"))
    return train.groupBy("category", "level").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("record").alias("n_records"), F.min(both).alias("lo"), F.max(both).alias("hi")
    )


@query("content_units", f"{_BASE}, {_TEST_SQL} SELECT DISTINCT md5(unit) AS unit FROM test WHERE unit IS NOT NULL")
def content_units(spark: SparkSession, sf: str) -> DataFrame:
    return generation.content_units(test_side(spark, sf)).select(F.md5("unit").alias("unit"))
