"""Queries for multiple-choice construction and the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.labels import render_chat
from tallywright.operators import audit, choice_items, choices, excerpts, generation, sampling
from tallywright.plans.item_queries import (
    _INFO,
    _NOTES,
    OWN,
    PARTS,
    REC,
    SLIDE,
    TEST_TEMPLATES,
    _TOP,
    parts,
    records,
)
from tallywright.operators.ranking import deal
from tallywright.plans.registry import load, query
from tallywright.plans.sampling_queries import split, split_sql
from tallywright.plans.sqlkit import gives_away, md5, number, words
from tallywright.session import materialise

OUTSIDE = ["77", "88", "99"]


def mc_facts(spark: SparkSession, sf: str) -> DataFrame:
    """(record, category, question, answer, hardness) of the printed facts; parts are dealt before they are cut."""
    p = deal(parts(spark, sf), "p_partkey")
    fact = lambda cat, value, q, hard: F.when(
        F.trim(value) != "-",
        F.struct(
            F.lit(cat).alias("category"), F.concat(F.lit(q), "name", F.lit("?")).alias("question"),
            F.trim(value).alias("answer"), F.lit(hard).alias("hardness"),
        ),
    )
    rows = F.array(
        fact("maker", F.col("maker"), "Who makes ", ""),
        fact("kind", F.col("p_type"), "Of what kind is ", ""),
        fact("size", F.col("p_size").cast("string"), "What size is ", "outside values"),
    )
    return p.select(F.col("p_partkey").alias("record"), F.explode(rows).alias("x")).where("x is not null").select("record", "x.*")


def mc_raw(spark: SparkSession, sf: str) -> DataFrame:
    facts = mc_facts(spark, sf)
    extra = spark.createDataFrame([("size", v) for v in OUTSIDE], "category string, answer string")
    return choice_items.fact_mc(facts, facts.select("category", "answer").unionByName(extra), "mc1")


def mc_items(spark: SparkSession, sf: str) -> DataFrame:
    """Placed items, written once to the shared folder: most queries read them several times."""
    return materialise(choice_items.place_options(mc_raw(spark, sf), "place"), "choice-items")


def stride_sql(m: str, k: int, seed: str, *key: str) -> str:
    """(h + j * stride) % m for j; m and the key are column expressions."""
    s0 = f"(1 + {number(seed + '-stride', *key)} % greatest({m} - 1, 1))"
    repeats = " OR ".join(f"{s0} * {j} % ({m}) = 0" for j in range(1, k))
    return f"(({number(seed + '-start', *key)} % ({m}) + j * CASE WHEN {repeats} THEN 1 ELSE {s0} END) % ({m}))"


MC_SQL = f"""{PARTS}, facts AS (SELECT p_partkey AS record, 'maker' AS category, 'Who makes ' || name || '?' AS question, maker AS answer, '' AS hardness FROM pt WHERE maker <> '-'
  UNION ALL SELECT p_partkey, 'kind', 'Of what kind is ' || name || '?', p_type, '' FROM pt
  UNION ALL SELECT p_partkey, 'size', 'What size is ' || name || '?', CAST(p_size AS VARCHAR), 'outside values' FROM pt),
dom AS MATERIALIZED (SELECT category, answer, row_number() OVER (PARTITION BY category ORDER BY {md5('mc1', 'answer')}, answer) AS pos, count(*) OVER (PARTITION BY category) AS m
  FROM (SELECT category, answer FROM facts UNION SELECT 'size', unnest({OUTSIDE}))),
oth AS MATERIALIZED (SELECT record, a.category, j, d.answer AS other FROM (SELECT f.record, f.category, j, (pos + {stride_sql('m - 1', 4, 'mc1', 'f.record', 'f.category')}) % m + 1 AS want
  FROM facts f JOIN dom USING (category, answer), (SELECT unnest(range(4)) AS j) WHERE m - 1 >= 4) a JOIN dom d ON d.category = a.category AND d.pos = a.want),
opt AS MATERIALIZED (SELECT f.record || '-' || f.category AS uid, f.record, f.category, question, answer, hardness, text,
  substr('ABCDE', CAST(row_number() OVER (PARTITION BY f.record, f.category ORDER BY {md5('place', "f.record || '-' || f.category", 'text')}, text) AS INT), 1) AS letter
  FROM facts f JOIN (SELECT record, category, other AS text FROM oth UNION ALL SELECT record, category, answer FROM facts) o ON o.record = f.record AND o.category = f.category),
mc AS MATERIALIZED (SELECT uid, record, category, question, answer, hardness, letter AS key FROM opt WHERE text = answer)"""


@query(
    "value_distractors",
    f"WITH {MC_SQL} SELECT record, category, string_agg(other, '|' ORDER BY j) AS others FROM oth GROUP BY record, category",
)
def value_distractors(spark: SparkSession, sf: str) -> DataFrame:
    return mc_raw(spark, sf).select("record", "category", F.array_join("others", "|").alias("others"))


@query("place_options", f"WITH {MC_SQL} SELECT opt.uid, opt.category, key, letter, text FROM opt JOIN mc USING (uid)")
def place_options(spark: SparkSession, sf: str) -> DataFrame:
    return choice_items.option_rows(mc_items(spark, sf))


TIERS = [("type+brand+size", ["p_type", "p_brand", "p_size"]), ("type+brand", ["p_type", "p_brand"]), ("type", ["p_type"]), ("any", [])]


def titled_parts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(
        "p_partkey", "p_type", "p_brand", "p_size", F.concat("p_name", F.lit(" "), "p_partkey").alias("name")
    )


def _tier_sql(cte: str, key: str, tiers: list[tuple[str, list[str]]], seed: str) -> str:
    cols = []
    for i, (_, c) in enumerate(tiers):
        part = f"PARTITION BY {', '.join(c)} " if c else ""
        cols.append(f"row_number() OVER ({part}ORDER BY {md5(seed, key)}, {key}) AS p{i}, count(*) OVER ({part}) AS m{i}")
    idx = " UNION ALL ".join(
        f"SELECT {i} AS tier, concat_ws('|', {', '.join(['0'] + [f'CAST({x} AS VARCHAR)' for x in c])}) AS grp, p{i} AS pos, name FROM rk" for i, (_, c) in enumerate(tiers)
    )
    case = lambda f: "CASE " + " ".join(f"WHEN m{i} - 1 >= 4 THEN {f(i, c)}" for i, (_, c) in enumerate(tiers)) + " END"
    grp = case(lambda i, c: f"concat_ws('|', {', '.join(['0'] + [f'CAST({x} AS VARCHAR)' for x in c])})")
    return f"""rk AS (SELECT *, {', '.join(cols)} FROM {cte}), idx AS ({idx}),
ch AS (SELECT {key} AS k, {case(lambda i, c: str(i))} AS tier, {case(lambda i, c: f'p{i}')} AS own, {case(lambda i, c: f'm{i}')} AS m, {grp} AS grp, {case(lambda i, c: repr(tiers[i][0]))} AS level FROM rk),
td AS (SELECT k, level, string_agg(name, '|' ORDER BY j) AS others FROM (SELECT k, level, tier, grp, j, (own + {stride_sql('m - 1', 4, seed, 'k')}) % m + 1 AS pos FROM ch, (SELECT unnest(range(4)) AS j) WHERE tier IS NOT NULL) a
  JOIN idx USING (tier, grp, pos) GROUP BY k, level)"""


@query(
    "tiered_title_distractors",
    f"WITH src AS (SELECT p_partkey, p_type, p_brand, p_size, p_name || ' ' || p_partkey AS name FROM part), {_tier_sql('src', 'p_partkey', TIERS, 't1')} SELECT k AS p_partkey, level, others FROM td",
)
def tiered_title_distractors(spark: SparkSession, sf: str) -> DataFrame:
    d = choices.tiered_distractors(titled_parts(spark, sf), "p_partkey", "name", TIERS, 4, "t1")
    return d.select("p_partkey", "level", F.array_join("others", "|").alias("others"))


@query(
    "reversed_mc",
    f"""WITH src AS (SELECT p_partkey, p_type, p_brand, p_name || ' ' || p_partkey AS name FROM part),
    bl AS (SELECT p_type, p_brand, count(*) AS c, sum(count(*)) OVER (PARTITION BY p_type) AS m, coalesce(sum(count(*)) OVER (PARTITION BY p_type ORDER BY md5(p_brand), p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
      FROM src GROUP BY p_type, p_brand),
    ix AS (SELECT s.*, c, m, o, o + row_number() OVER (PARTITION BY s.p_type, s.p_brand ORDER BY {md5('r1', 'p_partkey')}, p_partkey) - 1 AS pos FROM src s JOIN bl USING (p_type, p_brand)),
    ak AS (SELECT p_partkey, p_type, j, CAST((o + c + {stride_sql('m - c', 4, 'r1', 'p_partkey')}) % m AS BIGINT) AS pos FROM ix, (SELECT unnest(range(4)) AS j) WHERE m - c >= 4)
    SELECT a.p_partkey || '-maker_to_name' AS uid, any_value('Which of these is made by ' || s.p_brand || '?') AS question, any_value(s.name) AS answer, string_agg(i.name, '|' ORDER BY j) AS others
    FROM ak a JOIN ix i ON i.p_type = a.p_type AND i.pos = a.pos JOIN src s ON s.p_partkey = a.p_partkey GROUP BY a.p_partkey""",
)
def reversed_mc(spark: SparkSession, sf: str) -> DataFrame:
    raw = choice_items.reversed_mc(
        titled_parts(spark, sf), "p_partkey", "p_type", "p_brand", "name", "maker_to_name", "Which of these is made by {value}?", "r1"
    )
    return raw.select("uid", "question", "answer", F.array_join("others", "|").alias("others"))


DOC_TIERS = [("language+length", ["lang", "n_lines"]), ("language", ["lang"]), ("any", [])]


def doc_records(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).withColumn("n_lines", F.size("ls"))


_DOC_TIER = _tier_sql("(SELECT doc_id, name, lang, len(ls) AS n_lines FROM rec)", "doc_id", DOC_TIERS, "d1")


def doc_distractors(spark: SparkSession, sf: str) -> DataFrame:
    recs = doc_records(spark, sf).select("doc_id", "name", "lang", "n_lines")
    return choices.tiered_distractors(recs, "doc_id", "name", DOC_TIERS, 4, "d1")


def raw_view(df: DataFrame) -> DataFrame:
    # four options in a seeded order; sorted here so that equal sets compare equal
    return df.select(
        "uid", "category", F.md5("question").alias("question"), F.md5("answer").alias("answer"),
        F.md5(F.array_join(F.sort_array("others"), "|")).alias("others"), "hardness",
    )


_SORTED = "md5(array_to_string(list_sort(string_split(others, '|')), '|'))"


def _lit(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_PICK = f"pk AS (SELECT * FROM nt WHERE {_INFO} QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY {md5('x1', 'doc_id', 'n', 's')}, s) <= 3)"
_HI = f"""hi AS (SELECT *, list_distinct([w for w in ws if w <> hiw]) AS rest FROM (SELECT *, substr({_TOP}, 7) AS hiw FROM pk))"""


def _four(seed: str, *key: str) -> str:
    inner = ", ".join(key)
    return f"md5(array_to_string(list_sort([substr(z, 33) for z in list_sort([md5(concat_ws('|', '{seed}', {inner}, o)) || o for o in rest])][1:4]), '|'))"


@query(
    "excerpt_mc",
    f"""WITH {REC}, {SLIDE}, {OWN}, {_NOTES}, {_PICK}, {_DOC_TIER}, {_HI}
    SELECT doc_id || '-excerpt-' || n || '-' || s AS uid, 'excerpt_to_title' AS category, md5(replace({_lit(TEST_TEMPLATES['excerpt_to_title'][0])}, '{{excerpt}}', excerpt)) AS question,
      md5(name) AS answer, md5(array_to_string(list_sort(string_split(others, '|')), '|')) AS others, level AS hardness
    FROM pk JOIN own USING (excerpt) JOIN td ON k = doc_id WHERE n_owners = 1
    UNION ALL SELECT doc_id || '-highest-' || n || '-' || s, 'highest_note', md5(replace({_lit(TEST_TEMPLATES['highest_note'][0])}, '{{excerpt}}', excerpt)), md5(hiw),
      {_four('x1', 'doc_id', 'n', 's')}, 'same excerpt' FROM hi WHERE len(rest) >= 4""",
)
def excerpt_mc(spark: SparkSession, sf: str) -> DataFrame:
    recs = doc_records(spark, sf)
    shared = excerpts.shared_excerpts(excerpts.sliding_excerpts(recs.select("title", "ls"), "ls"), "title")
    raw = choice_items.excerpt_mc(
        recs, "doc_id", "name", "ls", doc_distractors(spark, sf), shared,
        (TEST_TEMPLATES["excerpt_to_title"][0], TEST_TEMPLATES["highest_note"][0]), 3, "x1", excerpts.word_notes,
    )
    return raw_view(raw)


_CNT = f"""cnt AS (SELECT doc_id, n, array_to_string(ls[st + 1 : st + n], ' | ') AS excerpt, [CAST(n + d AS VARCHAR) for d in [-2, -1, 1, 2, 3] if n + d BETWEEN 3 AND 12] AS rest
  FROM (SELECT *, {number('n1-at', 'doc_id', 'n')} % (len(ls) - n + 1) AS st, row_number() OVER (PARTITION BY doc_id ORDER BY {md5('n1-length', 'doc_id', 'n')}, n) AS rk
  FROM rec, (SELECT unnest(range(3, 13)) AS n) WHERE len(ls) >= n) WHERE rk <= 3)"""


@query(
    "count_mc",
    f"""WITH {REC}, {_CNT} SELECT doc_id || '-count-' || n AS uid, 'count_bars' AS category, md5(replace({_lit(TEST_TEMPLATES['count_bars'][0])}, '{{excerpt}}', excerpt)) AS question,
    md5(CAST(n AS VARCHAR)) AS answer, {_four('n1', 'doc_id', 'n')} AS others, 'near the answer' AS hardness FROM cnt WHERE len(rest) >= 4""",
)
def count_mc(spark: SparkSession, sf: str) -> DataFrame:
    return raw_view(choice_items.count_mc(records(spark, sf), "doc_id", "ls", TEST_TEMPLATES["count_bars"][0], 3, "n1"))


_FIRST = "(SELECT doc_id, title, name, ls, i - 1 AS i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM rec))"


@query(
    "line_mc",
    f"""WITH {REC}, {_DOC_TIER} SELECT doc_id || '-line-' || i AS uid, 'line_to_title' AS category, md5(replace({_lit(TEST_TEMPLATES['line_to_title'][0])}, '{{line}}', line)) AS question,
    md5(name) AS answer, {_SORTED} AS others, level AS hardness FROM {_FIRST} f JOIN td ON k = doc_id WHERE len({words('line')}) >= 4 AND NOT {gives_away('name', 'line')}""",
)
def line_mc(spark: SparkSession, sf: str) -> DataFrame:
    return raw_view(
        choice_items.line_mc(records(spark, sf), "doc_id", "name", "ls", doc_distractors(spark, sf), TEST_TEMPLATES["line_to_title"][0])
    )


@query(
    "cloze_mc",
    f"""WITH {REC}, w AS (SELECT doc_id, name, ls, i, {words('line')} AS ws FROM {_FIRST}),
    sp AS (SELECT *, ws[j + 1] AS a FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS j FROM w WHERE len(ws) >= 5) WHERE length(ws[j + 1]) > 2
      QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY {md5('c1', 'doc_id', 'i', 'j')}) = 1),
    rs AS (SELECT *, list_distinct([x for x in flatten([{words('l')} for l in ls]) if length(x) > 2 AND lower(x) <> lower(a)]) AS rest FROM sp)
    SELECT doc_id || '-cloze-' || i AS uid, 'cloze' AS category, md5(replace(replace({_lit(TEST_TEMPLATES['cloze'][0])}, '{{name}}', name), '{{line}}', array_to_string(list_transform(ws, lambda x, p: CASE WHEN p = j + 1 THEN '____' ELSE x END), ' '))) AS question,
      md5(a) AS answer, {_four('c1', 'doc_id', 'i')} AS others, 'same record' AS hardness FROM rs WHERE len(rest) >= 4""",
)
def cloze_mc(spark: SparkSession, sf: str) -> DataFrame:
    return raw_view(choice_items.cloze_mc(records(spark, sf), "doc_id", "name", "ls", TEST_TEMPLATES["cloze"][0], None, "c1"))


_TWICE = f"""SELECT uid || CASE x WHEN 0 THEN '' ELSE '-again' END AS uid, category, question, x FROM mc, (VALUES (0), (1)) v(x) WHERE x = 0 OR record % 3 = 0"""


@query(
    "dedupe_choice_items",
    f"""WITH {MC_SQL}, tw AS ({_TWICE}) SELECT md5(question) AS question, min(tw.uid) AS uid, category FROM tw JOIN (
      SELECT uid, string_agg(text, '|' ORDER BY text) AS texts FROM opt GROUP BY uid) o ON o.uid = replace(tw.uid, '-again', '') GROUP BY tw.question, texts, category""",
)
def dedupe_choice_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every third record's items come twice, the second time with their options in another order."""
    items = mc_items(spark, sf)
    turned = F.map_from_arrays(F.map_keys("options"), F.reverse(F.map_values("options")))
    again = items.where("record % 3 = 0").withColumn("uid", F.concat("uid", F.lit("-again"))).withColumn("options", turned)
    kept = sampling.dedupe_choice_items(items.unionByName(again), ["uid"])
    return kept.select(F.md5("question").alias("question"), "uid", "category")


TARGET = 5700
BAL_SQL = f"""{MC_SQL}, cc AS (SELECT category, count(*) AS n FROM mc GROUP BY category),
r1 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {md5('b1', 'uid')}, uid) <= (SELECT {TARGET} // count(*) FROM cc) AS ins FROM mc),
r2 AS (SELECT *, row_number() OVER (PARTITION BY ins ORDER BY {md5('b1-rest', 'uid')}, uid) AS rest FROM r1),
r3 AS (SELECT * FROM r2 WHERE ins OR rest <= {TARGET} - (SELECT count(*) FROM r1 WHERE ins)),
bal AS (SELECT *, row_number() OVER (ORDER BY {md5('b1-order', 'uid')}, uid) AS place FROM r3)"""


def balanced(spark: SparkSession, sf: str) -> DataFrame:
    return choice_items.balance_to_target(sampling.dedupe_choice_items(mc_items(spark, sf), ["uid"]), TARGET, "b1")


@query("balance_to_target", f"WITH {BAL_SQL} SELECT uid, category, key, 'mc-' || lpad(CAST(place AS VARCHAR), greatest(4, length(CAST(place AS VARCHAR)))::INTEGER, '0') AS item_id FROM bal")
def balance_to_target(spark: SparkSession, sf: str) -> DataFrame:
    return balanced(spark, sf).select("uid", "category", "key", "item_id")


@query(
    "mc_self_audit",
    f"""WITH {BAL_SQL}, t AS (SELECT b.*, length(answer) > (SELECT max(length(text)) FROM opt o WHERE o.uid = b.uid AND o.letter <> b.key) AS longest FROM bal b), n AS (SELECT count(*) AS n FROM t)
    SELECT 'key letter' AS "check", category, key AS label, count(*) AS n, CAST(NULL AS DOUBLE) AS share, false AS failed FROM t GROUP BY category, key
    UNION ALL SELECT 'key letter', NULL, key, count(*), round(count(*) / (SELECT n FROM n), 6), count(*) / (SELECT n FROM n) > 0.25 FROM t GROUP BY key
    UNION ALL SELECT 'longest answer', category, 'longest', CAST(count(*) FILTER (longest) AS BIGINT), round(count(*) FILTER (longest) / count(*), 6), count(*) FILTER (longest) / count(*) > 0.35 FROM t GROUP BY category
    UNION ALL SELECT 'longest answer', NULL, 'longest', CAST(count(*) FILTER (longest) AS BIGINT), round(count(*) FILTER (longest) / count(*), 6), count(*) FILTER (longest) / count(*) > 0.30 FROM t
    UNION ALL SELECT 'twin options', NULL, 'twin', 0, 0.0, false
    UNION ALL SELECT 'hardness', NULL, hardness, count(*), round(count(*) / (SELECT n FROM n), 6), false FROM t WHERE hardness <> '' GROUP BY hardness
    UNION ALL SELECT 'key source', NULL, 'printed', count(*), round(count(*) / (SELECT n FROM n), 6), false FROM t""",
)
def mc_self_audit(spark: SparkSession, sf: str) -> DataFrame:
    return choice_items.mc_self_audit(balanced(spark, sf))


# audit: the same items with planted faults

AUD_SQL = f"""{MC_SQL}, ao AS (SELECT uid, record, category, letter, CASE WHEN fault = 0 AND letter = 'C' THEN ' ' WHEN fault = 1 AND letter = 'D' THEN (SELECT text FROM opt x WHERE x.uid = y.uid AND x.letter = 'A')
    WHEN fault = 4 AND letter = 'B' THEN (SELECT text || ' x' FROM opt x WHERE x.uid = y.uid AND x.letter = 'A') ELSE text END AS text
  FROM (SELECT *, record % 40 AS fault FROM opt) y WHERE NOT (fault = 2 AND letter = 'E')),
ai AS (SELECT uid, record, category, CASE WHEN record % 40 = 5 THEN question || chr(10) || chr(10) || 'See ' || answer || ' here' ELSE question END AS question,
  CASE WHEN record % 40 = 3 THEN 'F' WHEN record % 40 BETWEEN 10 AND 16 THEN 'A' ELSE key END AS key FROM mc),
aa AS (SELECT ai.*, coalesce(trim(text), '') AS answer FROM ai LEFT JOIN ao ON ao.uid = ai.uid AND ao.letter = ai.key)"""


def audited(spark: SparkSession, sf: str) -> DataFrame:
    items = mc_items(spark, sf)
    o, fault = F.col("options"), F.col("record") % 40

    def change(k, v):
        return (
            F.when((fault == 0) & (k == "C"), F.lit(" "))
            .when((fault == 1) & (k == "D"), o["A"])
            .when((fault == 4) & (k == "B"), F.concat(o["A"], F.lit(" x")))
            .otherwise(v)
        )

    changed = F.map_filter(F.transform_values(o, change), lambda k, v: ~((fault == 2) & (k == "E")))
    shown = F.when(fault == 5, F.concat("question", F.lit("\n\nSee "), F.element_at(o, F.col("key")), F.lit(" here"))).otherwise(F.col("question"))
    key = F.when(fault == 3, F.lit("F")).when(fault.between(10, 16), F.lit("A")).otherwise(F.col("key"))
    return items.select("uid", "record", "category", shown.alias("question"), changed.alias("options"), key.alias("key"))


@query("exact_option_count", f"WITH {AUD_SQL} SELECT uid, count(*) AS n_options FROM ao GROUP BY uid HAVING count(*) <> 5")
def exact_option_count(spark: SparkSession, sf: str) -> DataFrame:
    return audit.exact_option_count(audited(spark, sf))


@query("empty_option", f"WITH {AUD_SQL} SELECT uid, letter FROM ao WHERE trim(text) = ''")
def empty_option(spark: SparkSession, sf: str) -> DataFrame:
    return audit.empty_option(audited(spark, sf))


@query("key_in_options", f"WITH {AUD_SQL} SELECT uid, key FROM ai WHERE NOT EXISTS (SELECT 1 FROM ao WHERE ao.uid = ai.uid AND ao.letter = ai.key)")
def key_in_options(spark: SparkSession, sf: str) -> DataFrame:
    return audit.key_in_options(audited(spark, sf))


@query("identical_options", f"WITH {AUD_SQL} SELECT uid, category FROM ao GROUP BY uid, category HAVING count(DISTINCT trim(text)) < count(*)")
def identical_options(spark: SparkSession, sf: str) -> DataFrame:
    return audit.identical_options(audited(spark, sf))


@query(
    "alias_options",
    f"""WITH {AUD_SQL}, al AS (SELECT DISTINCT p_brand AS text, 'b' || (CAST(substr(p_brand, 7) AS INT) % 20) AS entity FROM part)
    SELECT uid, category FROM ao LEFT JOIN al ON al.text = trim(ao.text) GROUP BY uid, category HAVING count(DISTINCT coalesce('e' || entity, 't' || trim(ao.text))) < count(*)""",
)
def alias_options(spark: SparkSession, sf: str) -> DataFrame:
    aliases = load(spark, sf, "part").select(
        F.col("p_brand").alias("text"), F.concat(F.lit("b"), F.expr("substring(p_brand, 7)").cast("int") % 20).alias("entity")
    ).distinct()
    return audit.alias_options(audited(spark, sf), aliases)


@query(
    "nested_options",
    f"""WITH {AUD_SQL} SELECT DISTINCT a.uid, a.category FROM ao a JOIN ao b ON a.uid = b.uid WHERE trim(a.text) <> '' AND trim(b.text) <> '' AND trim(a.text) <> trim(b.text) AND contains(lower(trim(b.text)), lower(trim(a.text)))""",
)
def nested_options(spark: SparkSession, sf: str) -> DataFrame:
    return audit.nested_options(audited(spark, sf))


_LOOSE = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query(
    "key_in_quote",
    f"""WITH {AUD_SQL} SELECT uid, category, CASE WHEN category = 'kind' THEN 'REVIEW' ELSE 'FAIL' END AS level FROM (SELECT *, CASE WHEN instr(question, chr(10) || chr(10)) > 0 THEN substr(question, instr(question, chr(10) || chr(10)) + 2) ELSE question END AS q FROM aa)
    WHERE length(answer) > 3 AND {_LOOSE.format('answer')} <> '' AND contains({_LOOSE.format('q')}, {_LOOSE.format('answer')})""",
)
def key_in_quote(spark: SparkSession, sf: str) -> DataFrame:
    return audit.key_in_quote(audited(spark, sf), harmless=("kind",))


@query(
    "shape_cue",
    f"""WITH {MC_SQL}, x AS (SELECT uid, arg_min(letter, length(text) * 100 + ascii(letter)) AS s, arg_max(letter, length(text) * 100 + ascii(letter)) AS l, any_value(answer) AS answer,
      sum(CASE WHEN text <> answer AND regexp_matches(trim(text), '^\\p{{Lu}}') THEN 1 ELSE 0 END) AS ou, sum(CASE WHEN text <> answer THEN 1 ELSE 0 END) AS o FROM opt GROUP BY uid),
    st AS (SELECT avg(CASE WHEN s = key THEN 1 ELSE 0 END) AS sh, avg(CASE WHEN l = key THEN 1 ELSE 0 END) AS lo, abs(avg(CASE WHEN regexp_matches(trim(x.answer), '^\\p{{Lu}}') THEN 1 ELSE 0 END) - sum(ou) / sum(o)) AS gap FROM x JOIN mc USING (uid))
    SELECT 'shortest option' AS cue, round(sh, 6) AS share, CASE WHEN greatest(sh, lo) > 0.25 THEN 'FAIL' ELSE 'ok' END AS level FROM st
    UNION ALL SELECT 'longest option', round(lo, 6), CASE WHEN greatest(sh, lo) > 0.25 THEN 'FAIL' ELSE 'ok' END FROM st
    UNION ALL SELECT 'capital gap', round(gap, 6), CASE WHEN gap > 0.10 THEN 'FAIL' ELSE 'ok' END FROM st""",
)
def shape_cue(spark: SparkSession, sf: str) -> DataFrame:
    return audit.shape_cue(mc_items(spark, sf))


@query(
    "letter_spread",
    f"""WITH {AUD_SQL}, c AS (SELECT key AS letter, count(*) AS n FROM ai GROUP BY key) SELECT letter, n, round(n / (SELECT sum(n) FROM c), 6) AS share,
    CASE WHEN abs(n / (SELECT sum(n) FROM c) - 1.0 / (SELECT count(*) FROM c)) > 0.05 THEN 'REVIEW' ELSE 'ok' END AS level FROM c""",
)
def letter_spread(spark: SparkSession, sf: str) -> DataFrame:
    return audit.letter_spread(audited(spark, sf))


@query(
    "narrow_answer_space",
    f"""WITH {AUD_SQL}, c AS (SELECT category || (record % 2) AS category, CASE WHEN category = 'kind' AND record % 2 = 1 AND record % 11 <> 0 THEN 'ECONOMY' WHEN category = 'size' AND record % 2 = 0 THEN CAST(record % 3 AS VARCHAR) ELSE answer END AS answer FROM aa WHERE key <> 'F'),
    d AS (SELECT category, answer, count(*) AS n FROM c GROUP BY ALL) SELECT category, count(*) AS n_answers, CAST(sum(n) AS BIGINT) AS n_items, round(max(n) / sum(n), 6) AS top_share FROM d GROUP BY category HAVING count(*) <= 3 OR max(n) / sum(n) > 0.75""",
)
def narrow_answer_space(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.col("record") % 2
    items = audited(spark, sf).where("key <> 'F'")
    answer = (
        F.when((F.col("category") == "kind") & (odd == 1) & (F.col("record") % 11 != 0), F.lit("ECONOMY"))
        .when((F.col("category") == "size") & (odd == 0), (F.col("record") % 3).cast("string"))
        .otherwise(F.coalesce(F.try_element_at("options", F.col("key")), F.lit("")))
    )
    swapped = items.select(
        "uid", F.concat("category", odd).alias("category"), F.lit("A").alias("key"), F.create_map(F.lit("A"), answer).alias("options")
    )
    return audit.narrow_answer_space(swapped)


@query(
    "repeated_question",
    f"SELECT md5({_LOOSE.format('text')}) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def repeated_question(spark: SparkSession, sf: str) -> DataFrame:
    return audit.repeated_question(load(spark, sf, "documents"), "text")


@query(
    "inferred_source_used",
    f"WITH {AUD_SQL} SELECT uid, record FROM ai LEFT JOIN labels l ON l.doc_id = record WHERE category = 'size' AND (quality IS NULL OR quality <> 1)",
)
def inferred_source_used(spark: SparkSession, sf: str) -> DataFrame:
    sources = load(spark, sf, "labels").select(
        F.col("doc_id").alias("record"), F.when(F.col("quality") == 1, F.lit("printed")).otherwise(F.lit("inferred")).alias("source")
    )
    return audit.inferred_source_used(audited(spark, sf), sources, "size")


@query(
    "ambiguous_title_option",
    f"WITH {AUD_SQL} SELECT DISTINCT uid, category FROM ao WHERE trim(text) IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_partkey) > 1)",
)
def ambiguous_title_option(spark: SparkSession, sf: str) -> DataFrame:
    titles = load(spark, sf, "part").select(F.col("p_partkey").alias("record"), F.col("p_brand").alias("title"))
    return audit.ambiguous_title_option(audited(spark, sf), titles)


@query(
    "key_matches_master",
    f"""WITH {AUD_SQL} SELECT uid, answer, CASE category WHEN 'maker' THEN maker WHEN 'kind' THEN p_type ELSE CAST(p_size AS VARCHAR) END AS value FROM aa JOIN pt ON p_partkey = record
    WHERE {_LOOSE.format('answer')} <> {_LOOSE.format("CASE category WHEN 'maker' THEN maker WHEN 'kind' THEN p_type ELSE CAST(p_size AS VARCHAR) END")}""",
)
def key_matches_master(spark: SparkSession, sf: str) -> DataFrame:
    master = mc_facts(spark, sf).select("record", "category", F.col("answer").alias("value"))
    return audit.key_matches_master(audited(spark, sf), master)


@query(
    "split_leak",
    f"""SELECT source FROM ({split_sql(20260901)}) WHERE side = 'train' INTERSECT SELECT source FROM ({split_sql(20260901)}) WHERE side = 'test'""",
)
def split_leak(spark: SparkSession, sf: str) -> DataFrame:
    s = split(spark, sf)
    return audit.split_leak(s.where("side = 'train'"), s.where("side = 'test'"), "source")


@query(
    "audit_summary",
    f"""WITH {AUD_SQL}, v AS (SELECT 'exact_option_count' AS "check", 'FAIL' AS l, (SELECT count(*) FROM (SELECT uid FROM ao GROUP BY uid HAVING count(*) <> 5)) AS n
      UNION ALL SELECT 'empty_option', 'FAIL', (SELECT count(*) FROM ao WHERE trim(text) = '')
      UNION ALL SELECT 'key_in_options', 'FAIL', (SELECT count(*) FROM ai WHERE NOT EXISTS (SELECT 1 FROM ao WHERE ao.uid = ai.uid AND ao.letter = ai.key))
      UNION ALL SELECT 'identical_options', 'FAIL', (SELECT count(*) FROM (SELECT uid FROM ao GROUP BY uid HAVING count(DISTINCT trim(text)) < count(*)))
      UNION ALL SELECT 'repeated_question', 'REVIEW', (SELECT count(*) FROM (SELECT question FROM ai GROUP BY question HAVING count(*) > 1)))
    SELECT "check", n, CASE WHEN n > 0 THEN l ELSE 'ok' END AS level FROM v""",
)
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    items = audited(spark, sf)
    return audit.audit_summary(
        {
            "exact_option_count": ("FAIL", audit.exact_option_count(items)),
            "empty_option": ("FAIL", audit.empty_option(items)),
            "key_in_options": ("FAIL", audit.key_in_options(items)),
            "identical_options": ("FAIL", audit.identical_options(items)),
            "repeated_question": ("REVIEW", audit.repeated_question(items)),
        }
    )


CANARY = "canary 8a1f"


@query("canary_scan", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, text || CASE WHEN doc_id % 97 = 0 THEN ' {CANARY}' ELSE '' END AS t FROM documents) WHERE contains(t, '{CANARY}')")
def canary_scan(spark: SparkSession, sf: str) -> DataFrame:
    planted = F.concat("text", F.when(F.col("doc_id") % 97 == 0, F.lit(f" {CANARY}")).otherwise(F.lit("")))
    docs = load(spark, sf, "documents").select("doc_id", "lang", planted.alias("t"))
    return audit.canary_scan(docs, "t", CANARY).select("doc_id", "lang")


def _grams(table: str, key: str) -> str:
    return f"""(SELECT DISTINCT {key}, array_to_string(ws[s : s + 7], ' ') AS gram FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 6)) AS s FROM (SELECT {key}, {words('lower(text)')} AS ws FROM {table}) WHERE len(ws) >= 8))"""


def worded(spark: SparkSession, sf: str, table: str, key: str) -> DataFrame:
    return deal(load(spark, sf, table).select(key, "text"), key).select(key, F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("ws"))


@query(
    "contaminated_documents",
    f"SELECT doc_id, count(*) AS n_shared FROM {_grams('documents', 'doc_id')} WHERE gram IN (SELECT gram FROM {_grams('benchmark', 'item_id')}) GROUP BY doc_id",
)
def contaminated_documents(spark: SparkSession, sf: str) -> DataFrame:
    return audit.contaminated_documents(
        worded(spark, sf, "documents", "doc_id"), "doc_id", worded(spark, sf, "benchmark", "item_id"), "item_id", "ws", 8
    )


@query(
    "contaminated_items",
    f"""WITH d AS (SELECT DISTINCT gram FROM {_grams('documents', 'doc_id')}) SELECT item_id, count(*) AS n_grams, CAST(count(*) FILTER (d.gram IS NOT NULL) AS BIGINT) AS n_found
    FROM {_grams('benchmark', 'item_id')} b LEFT JOIN d ON d.gram = b.gram GROUP BY item_id""",
)
def contaminated_items(spark: SparkSession, sf: str) -> DataFrame:
    return audit.contaminated_items(
        worded(spark, sf, "documents", "doc_id"), "doc_id", worded(spark, sf, "benchmark", "item_id"), "item_id", "ws", 8
    )


@query("prompt_builder_parity", f"WITH {MC_SQL} SELECT uid, 'neutral' AS condition FROM mc WHERE record % 50 = 7")
def prompt_builder_parity(spark: SparkSession, sf: str) -> DataFrame:
    """The chat renderer against options joined as rows; one condition is off for some records."""
    items = mc_items(spark, sf)
    conditions = F.explode(F.array(F.lit("own"), F.lit("neutral"))).alias("condition")
    chat = render_chat(F.col("question"), F.col("options"), F.col("condition"), "Answer with one letter.")
    a = items.select("*", conditions).select("uid", "condition", F.get(chat, F.lit(1))["content"].alias("prompt"))
    lines = choice_items.option_rows(items).groupBy("uid").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("letter", F.lit(". "), "text"))), "\n").alias("lettered")
    )
    off = F.when((F.col("record") % 50 == 7) & (F.col("condition") == "neutral"), F.lit("Reply with one letter.")).otherwise(
        F.lit("Answer with one letter.")
    )
    b = items.join(lines, "uid").select("*", conditions).select(
        "uid", "condition", F.concat_ws("\n\n", "question", "lettered", off).alias("prompt")
    )
    return audit.prompt_builder_parity(a, b, ["uid", "condition"], "prompt")


def template_table(spark: SparkSession, sf: str) -> DataFrame:
    """Wordings per maker name: base, paraphrases and the test wording."""
    p = load(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("category"), "p_name", "p_type")
    row = lambda side, base, w: F.struct(F.lit(side).alias("side"), F.lit(base).alias("is_base"), w.alias("wording"))
    rows = F.array(
        row("train", False, F.concat(F.lit("Name "), "p_name")),
        row("test", True, F.concat(F.lit("Name "), F.col("p_type"), F.lit(" "), F.col("p_partkey") % 9)),
        row("train", True, F.concat(F.lit("Name "), F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.lit("it")))),
        row("test", True, F.when(F.col("p_partkey") % 400 == 0, F.concat(F.lit("Name "), "p_name")).otherwise(F.lit("Tell"))),
    )
    return p.select("category", F.explode(rows).alias("r")).select("category", "r.*")


@query(
    "template_lint",
    """WITH t AS (SELECT p_brand AS category, 'train' AS side, false AS is_base, 'Name ' || p_name AS wording FROM part
      UNION ALL SELECT p_brand, 'test', true, 'Name ' || p_type || ' ' || (p_partkey % 9) FROM part
      UNION ALL SELECT p_brand, 'train', true, 'Name ' || CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE 'it' END FROM part
      UNION ALL SELECT p_brand, 'test', true, CASE WHEN p_partkey % 400 = 0 THEN 'Name ' || p_name ELSE 'Tell' END FROM part)
    SELECT DISTINCT 'train wording on the test side' AS rule, category, wording FROM t WHERE side = 'train' AND wording IN (SELECT wording FROM t WHERE side = 'test')
    UNION ALL SELECT 'wording repeated', category, wording FROM t WHERE side = 'train' AND NOT is_base GROUP BY category, wording HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'paraphrase equals base', category, wording FROM t WHERE side = 'train' AND NOT is_base AND (category, wording) IN (SELECT (category, wording) FROM t WHERE side = 'train' AND is_base)""",
)
def template_lint(spark: SparkSession, sf: str) -> DataFrame:
    return generation.template_lint(template_table(spark, sf))
