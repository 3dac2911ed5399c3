"""Queries for scoring predictions and for negative controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import reply
from tallywright.functions.hashing import seeded_number
from tallywright.functions.text import lines_of, norm_answer, once, words_of
from tallywright.operators import choice_items, gates, provenance, scoring
from tallywright.plans.base import PRED_SQL, QA_SQL, predictions, qa_items
from tallywright.plans.choice_queries import MC_SQL, mc_items
from tallywright.plans.registry import load, query
from tallywright.plans.sqlkit import edges, lines, md5, norm, number, words
from tallywright.session import materialise


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rivals = scoring.rival_sets(qa_items(spark, sf))
    return scoring.score(predictions(spark, sf), ["run", "item_id"], rivals)


_WW = r"CASE WHEN contains({h}, {n}) THEN regexp_matches({h}, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape({n}) || '([^\p{{L}}\p{{N}}_]|$)') ELSE false END"
_NO = " OR ".join(f"contains(lower(said), '{x}')" for x in reply.REFUSAL)
SCORED = rf"""items AS ({QA_SQL}), pred AS ({PRED_SQL}),
riv AS (SELECT DISTINCT category, {norm('answer')} AS rival FROM items WHERE NOT ends_with(category, '_abstain') UNION SELECT 'maker_abstain', {norm('answer')} FROM items WHERE category = 'maker'),
rd AS (SELECT *, {norm('said')} AS p, {norm('answer')} AS g, regexp_extract_all(replace(said, ',', ''), '-?\d+') AS ns FROM (
  SELECT *, CASE WHEN contains(lower(o), '<think>') THEN '' ELSE {edges('o')} END AS said FROM (SELECT *, regexp_replace(reply, '(?is)<think>.*?</think>', ' ', 'g') AS o FROM pred))),
hit AS (SELECT DISTINCT run, item_id FROM rd JOIN riv USING (category) WHERE category <> 'hitung_bar' AND rival <> '' AND
  CASE WHEN category = 'maker_abstain' THEN length(rival) > 3 AND {_WW.format(h='p', n='rival')} ELSE NOT contains(g, rival) AND {_WW.format(h='p', n='rival')} END),
scored AS (SELECT rd.run, rd.item_id, rec_id, category, question, answer, reply, CASE WHEN p = g THEN 1 ELSE 0 END AS strict,
  CASE WHEN CASE WHEN category = 'maker_abstain' THEN ({_NO}) AND hit.run IS NULL WHEN category = 'hitung_bar' THEN coalesce(answer = ns[1] OR answer = ns[len(ns)], false)
    ELSE {_WW.format(h='p', n='g')} AND hit.run IS NULL END THEN 1 ELSE 0 END AS lenient FROM rd LEFT JOIN hit ON hit.run = rd.run AND hit.item_id = rd.item_id)"""


@query("score_by_category", f"WITH {SCORED} SELECT run, item_id, category, CAST(strict AS BIGINT) AS strict, CAST(lenient AS BIGINT) AS lenient FROM scored")
def score_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("run", "item_id", "category", "strict", "lenient")


@query(
    "write_audit_table",
    f"WITH {SCORED} SELECT run, item_id, category, md5(question) AS question, md5(answer) AS answer, md5(reply) AS reply, CAST(strict AS BIGINT) AS strict, CAST(lenient AS BIGINT) AS lenient FROM scored",
)
def write_audit_table(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows written as quoted CSV and read back as records."""
    from tallywright.session import scratch_path
    from tallywright.sources import records

    rows = scored(spark, sf).select("run", "item_id", "category", "question", "answer", "reply", "strict", "lenient")
    path = scratch_path(spark, "audit-csv")
    records.save_records_csv(rows, path)
    back = records.scan_records_csv(spark, path, rows.columns)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return back.select(
        "run", big("item_id"), "category", F.md5("question").alias("question"), F.md5("answer").alias("answer"),
        F.md5("reply").alias("reply"), big("strict"), big("lenient"),
    )


@query(
    "contains_key_no_rival",
    f"WITH {SCORED} SELECT run, item_id, lenient = 1 AS hit FROM scored WHERE category IN ('maker', 'kind')",
)
def contains_key_no_rival(spark: SparkSession, sf: str) -> DataFrame:
    preds = predictions(spark, sf).where("category in ('maker', 'kind')")
    said = preds.withColumn("said", once(reply.strip_reasoning(F.col("reply"))))
    texts = F.struct(norm_answer(F.col("said")).alias("p"), norm_answer(F.col("answer")).alias("g"))
    # read by the search for rivals and by the join with what it finds
    norm_cols = materialise(said.select("run", "item_id", "category", once(texts).alias("t")).select("run", "item_id", "category", "t.*"), "read-replies")
    hits = scoring.rival_hits(norm_cols, ["run", "item_id"], scoring.rival_sets(qa_items(spark, sf)))
    joined = norm_cols.join(hits, ["run", "item_id"], "left").fillna(False, ["names_rival"])
    return joined.select("run", "item_id", (reply.contains_key(F.col("p"), F.col("g")) & ~F.col("names_rival")).alias("hit"))


@query("rival_sets", f"WITH {SCORED} SELECT category, rival FROM riv")
def rival_sets(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.rival_sets(qa_items(spark, sf))


# every rule of the scorer that has its own reading of a reply, over cases spelled from documents

_CASE_SQL = f"""cs AS (SELECT doc_id, n, line, substr('CDEFGAB', 1 + n % 7, 1) AS x, substr('CDEFGAB', CAST(1 + (n + doc_id) % 7 AS INTEGER), 1) AS y, CAST(n % 8 AS VARCHAR) AS a, CAST((n + 1) % 8 AS VARCHAR) AS b
  FROM (SELECT doc_id, CAST(len({words('text')}) AS INTEGER) AS n, coalesce(({lines('text')})[1], '') AS line FROM documents)),
ca AS (SELECT doc_id, 'verifikasi_isi' AS category, ['Itu benar.', 'Tidak benar sama sekali', 'Menurut saya salah', 'Kurang tepat', 'Entahlah', '<think>salah</think> Benar'][1 + doc_id % 6] AS reply,
    ['Benar, memang begitu.', 'Salah.'][1 + n % 2] AS answer FROM cs
  UNION ALL SELECT doc_id, 'nada_dasar', ['Nada dasarnya ' || x, x || ' mayor', 'kunci ' || y, x, 'do ' || x || ' atau do ' || y, 'tidak tahu'][1 + doc_id % 6], 'do = ' || x FROM cs
  UNION ALL SELECT doc_id, 'nada_tertinggi', ['Nada ' || a || chr(39), a || ',', '#' || a || chr(39), 'tidak ada', a || chr(39) || ' itu'][1 + doc_id % 5], a || chr(39) || ' ' || b FROM cs
  UNION ALL SELECT doc_id, 'judul_ke_baris', ['>> ' || line || ' <<', array_to_string(({words('line')})[1 : (len({words('line')}) + 1) // 2], ' '), line || ' dan lagi sesuatu yang lain sama sekali', ''][1 + doc_id % 4], line FROM cs
  UNION ALL SELECT doc_id, 'hitung_bar', ['Ada ' || n || ' bar', '1, 2, ' || n, n || ' dari 9', 'tidak tahu'][1 + doc_id % 4], CAST(n AS VARCHAR) FROM cs),
cr AS MATERIALIZED (SELECT *, {norm('said')} AS p, {norm('answer')} AS g FROM (SELECT *, {edges("regexp_replace(reply, '(?is)<think>.*?</think>', ' ', 'g')")} AS said FROM ca)),
tk AS (SELECT doc_id, t, sum(sp) AS np, sum(sg) AS ng FROM (SELECT doc_id, unnest(string_split(p, ' ')) AS t, 1 AS sp, 0 AS sg FROM cr WHERE category = 'judul_ke_baris'
  UNION ALL SELECT doc_id, unnest(string_split(g, ' ')), 0, 1 FROM cr WHERE category = 'judul_ke_baris') WHERE t <> '' GROUP BY doc_id, t),
f1 AS (SELECT doc_id, 'judul_ke_baris' AS category, sum(least(np, ng)) AS c, sum(np) AS np, sum(ng) AS ng FROM tk GROUP BY doc_id)"""
_VERDICT = r"'(?:(tidak|bukan|kurang|belum)\s+)?(benar|tepat|salah|keliru)'"
_JUDGED = f"CASE WHEN regexp_extract({{0}}, {_VERDICT}, 2) = '' THEN NULL ELSE (regexp_extract({{0}}, {_VERDICT}, 2) IN ('benar', 'tepat')) <> (regexp_extract({{0}}, {_VERDICT}, 1) <> '') END"
_KEY_BEFORE = r"(?:do|nada dasar(?:nya)?|bernada dasar|kunci|key)\s+([a-g])([^a-z]|$)"
_KEYED = rf"""list_sort(list_distinct(list_concat(regexp_extract_all({{0}}, '{_KEY_BEFORE}', 1),
  regexp_extract_all(regexp_replace({{0}}, '{_KEY_BEFORE}', '1\2', 'g'), '(?:^|[^a-z])([a-g])\s+(?:mayor|major|minor|mol)(?:[^a-z]|$)', 1))))"""
_NAMED = f"CASE WHEN len({_KEYED}) = 0 AND regexp_matches({{0}}, '^[a-g]$') THEN [{{0}}] ELSE {_KEYED} END"
_TONE = r"regexp_extract({0}, '[#b]*[0-7]['',]*_*\.?|-|\|')"


@query(
    "rule_cases",
    rf"""WITH {_CASE_SQL} SELECT cr.doc_id, cr.category, CAST(CASE WHEN p = g THEN 1 ELSE 0 END AS BIGINT) AS strict, CAST(CASE WHEN coalesce(CASE cr.category
      WHEN 'verifikasi_isi' THEN {_JUDGED.format('p')} = {_JUDGED.format('g')}
      WHEN 'nada_dasar' THEN len({_NAMED.format('g')}) > 0 AND {_NAMED.format('p')} = {_NAMED.format('g')}
      WHEN 'nada_tertinggi' THEN {_TONE.format('said')} <> '' AND {_TONE.format('said')} = {_TONE.format('answer')}
      WHEN 'hitung_bar' THEN answer = regexp_extract(replace(said, ',', ''), '-?\d+') OR answer = regexp_extract(replace(said, ',', ''), '(-?\d+)[^0-9]*$', 1)
      ELSE CASE WHEN f1.doc_id IS NULL THEN true WHEN np = 0 OR ng = 0 THEN false ELSE 2.0 * c / (np + ng) >= 0.8 END END, false) THEN 1 ELSE 0 END AS BIGINT) AS lenient
    FROM cr LEFT JOIN f1 ON f1.doc_id = cr.doc_id AND f1.category = cr.category""",
)
def rule_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of every document for the rules verdict, keys, first note, number and overlap."""
    cases = rule_replies(spark, sf)
    rules = {k: v for k, v in scoring.RULES.items() if v != "sequence"}
    rivals = spark.createDataFrame([], "category string, rival string")  # none of these rules looks at rivals
    return scoring.score(cases, ["doc_id", "category"], rivals, rules).select("doc_id", "category", "strict", "lenient")


def rule_replies(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, category, reply, answer)."""
    spelled = load(spark, sf, "documents").select("doc_id", F.size(words_of(F.col("text"))).alias("n"), F.coalesce(F.get(lines_of(F.col("text")), F.lit(0)), F.lit("")).alias("line"))
    n, d, line = F.col("n"), F.col("doc_id"), F.col("line")
    letter = lambda k: F.substr(F.lit("CDEFGAB"), (1 + k % 7).cast("int"), F.lit(1))
    x, y = letter(n), letter(n + d)
    a, b = (n % 8).cast("string"), ((n + 1) % 8).cast("string")
    ws = words_of(line)

    def case(category: str, replies: list, answers: list) -> Column:
        texts = [F.array(*[F.lit(t) if isinstance(t, str) else t for t in ts]) for ts in (replies, answers)]
        said, key = (F.element_at(t, (1 + i % m).cast("int")) for t, i, m in zip(texts, (d, n), (len(replies), len(answers)), strict=True))
        return F.struct(F.lit(category).alias("category"), said.alias("reply"), key.alias("answer"))

    told = F.array(
        case("verifikasi_isi", ["Itu benar.", "Tidak benar sama sekali", "Menurut saya salah", "Kurang tepat", "Entahlah", "<think>salah</think> Benar"], ["Benar, memang begitu.", "Salah."]),
        case("nada_dasar", [F.concat(F.lit("Nada dasarnya "), x), F.concat(x, F.lit(" mayor")), F.concat(F.lit("kunci "), y), x, F.concat(F.lit("do "), x, F.lit(" atau do "), y), "tidak tahu"], [F.concat(F.lit("do = "), x)]),
        case("nada_tertinggi", [F.concat(F.lit("Nada "), a, F.lit("'")), F.concat(a, F.lit(",")), F.concat(F.lit("#"), a, F.lit("'")), "tidak ada", F.concat(a, F.lit("' itu"))], [F.concat(a, F.lit("' "), b)]),
        case("judul_ke_baris", [F.concat(F.lit(">> "), line, F.lit(" <<")), F.array_join(F.slice(ws, F.lit(1), F.floor((F.size(ws) + 1) / 2).cast("int")), " "), F.concat(line, F.lit(" dan lagi sesuatu yang lain sama sekali")), ""], [line]),
        case("hitung_bar", [F.concat(F.lit("Ada "), n, F.lit(" bar")), F.concat(F.lit("1, 2, "), n), F.concat(n, F.lit(" dari 9")), "tidak tahu"], [n.cast("string")]),
    )
    return spelled.select("doc_id", F.explode(told).alias("c")).select("doc_id", "c.*")


TALLY = f"""{SCORED}, tally AS (SELECT run, category, count(*) AS n, CAST(sum(strict) AS BIGINT) AS strict, CAST(sum(lenient) AS BIGINT) AS lenient FROM scored GROUP BY GROUPING SETS ((run, category), (run)))"""


def tallies(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.tally(scored(spark, sf))


@query("tally", f"WITH {TALLY} SELECT * FROM tally")
def tally(spark: SparkSession, sf: str) -> DataFrame:
    return tallies(spark, sf)


@query(
    "per_record_accuracy",
    f"WITH {SCORED} SELECT run, rec_id, CAST(sum(lenient) AS BIGINT) AS hits, count(*) AS n, round(avg(lenient), 6) AS share FROM scored GROUP BY run, rec_id",
)
def per_record_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.per_record_accuracy(scored(spark, sf), "run", "rec_id")


@query(
    "error_summary",
    f"""WITH {SCORED}, w AS (SELECT run, category, trim(reply) AS r FROM scored WHERE lenient = 0),
    c AS (SELECT run, category, r AS text, count(*) AS k FROM w GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY run, category ORDER BY k DESC, text) AS rn FROM c),
    m AS (SELECT run, category, count(*) AS misses, count(DISTINCT r) AS n_distinct FROM w GROUP BY run, category)
    SELECT m.run, row_number() OVER (PARTITION BY m.run ORDER BY misses DESC, m.category) AS place, m.category, misses, n_distinct, text AS commonest, k AS times
    FROM m JOIN b ON b.run = m.run AND b.category = m.category AND rn = 1""",
)
def error_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.error_summary(scored(spark, sf), "run")


# slots: several questions of one record and category, matched by position

# order of turns over all conversations: a turn is below half of this
SPAN = 1 << 32
_SLOT_KEYS = "(SELECT conv_id % 40 AS rec, role AS category, conv_id * 4294967296 + turn AS ord, md5(text) AS gold FROM conversations)"
_SLOT_PRED = "(SELECT conv_id % 40 AS rec, role AS category, conv_id * 4294967296 + turn * 2 + x AS ord, md5(text || x) AS said FROM conversations, (VALUES (0), (1)) v(x) WHERE x = 0 OR conv_id % 2 = 0)"


def slot_keys(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select(
        (F.col("conv_id") % 40).alias("rec"), F.col("role").alias("category"),
        (F.col("conv_id") * SPAN + F.col("turn")).alias("ord"), F.md5("text").alias("gold"),
    )


def slot_preds(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").withColumn("x", F.explode(F.array(F.lit(0), F.lit(1)))).where("x = 0 or conv_id % 2 = 0")
    return c.select(
        (F.col("conv_id") % 40).alias("rec"), F.col("role").alias("category"),
        (F.col("conv_id") * SPAN + F.col("turn") * 2 + F.col("x")).alias("ord"), F.md5(F.concat("text", "x")).alias("said"),
    )


@query(
    "match_by_position",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY rec, category ORDER BY ord) AS i, count(*) OVER (PARTITION BY rec, category) AS m FROM {_SLOT_KEYS}),
    p AS (SELECT *, row_number() OVER (PARTITION BY rec, category ORDER BY ord) AS i FROM {_SLOT_PRED})
    SELECT p.rec, p.category, p.ord, said, gold FROM p JOIN k ON k.rec = p.rec AND k.category = p.category AND k.i = least(p.i, k.m)""",
)
def match_by_position(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.match_by_position(slot_preds(spark, sf), slot_keys(spark, sf), ["rec", "category"], "ord")


@query(
    "order_alarm",
    """SELECT CAST(count(*) FILTER (a.s <> b.s) AS BIGINT) AS n_moved, CAST(0 AS BIGINT) AS n_uneven, count(*) FILTER (a.s <> b.s) > 0 AS alarm FROM
    (SELECT o_orderpriority AS s, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) a JOIN (SELECT o_orderpriority AS s, row_number() OVER (ORDER BY o_orderkey % 50 * 1000000 + o_orderkey) AS i FROM orders) b USING (i)""",
)
def order_alarm(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    keys = o.select("o_orderpriority", F.col("o_orderkey").alias("ord"))
    preds = o.select("o_orderpriority", (F.col("o_orderkey") % 50 * 1000000 + F.col("o_orderkey")).alias("ord"))
    return scoring.order_alarm(preds, keys, ["o_orderpriority"], "ord")


@query(
    "unmatched_gate",
    """SELECT CAST(count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)) AS BIGINT) AS n_unmatched, count(*) AS n_predictions,
    round(count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)) / count(*), 6) AS share, true AS refuse FROM orders""",
)
def unmatched_gate(spark: SparkSession, sf: str) -> DataFrame:
    keys = load(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("slot"))
    return scoring.unmatched_gate(load(spark, sf, "orders").select(F.col("o_custkey").alias("slot")), keys, ["slot"])


# choice replies

MC_RUNS = {"base": 2, "s1": 5, "s2": 6}


def choice_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(run, uid, reply): letters, labelled letters, option texts and hedges."""
    items = mc_items(spark, sf)
    table = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(k).alias("skill")) for r, k in MC_RUNS.items()])
    rows = items.select("uid", "key", "options", F.explode(table).alias("r")).select("uid", "key", "options", "r.*")
    luck = seeded_number("mluck", F.col("run"), F.col("uid")) % 10
    other = F.substr(F.lit("ABCDE"), (1 + seeded_number("mother", F.col("run"), F.col("uid")) % 5).cast("int"), F.lit(1))
    form = seeded_number("mform", F.col("run"), F.col("uid")) % 7
    pick = rows.withColumn("pick", F.when(luck < F.col("skill"), F.col("key")).otherwise(other))
    p = F.col("pick")
    said = (
        F.when(form == 0, p)
        .when(form == 1, F.concat(F.lit("**("), p, F.lit(")** indeed")))
        .when(form == 2, F.concat(F.lit("jawabannya adalah "), p, F.lit(", surely")))
        .when(form == 3, F.concat(F.lit("it is "), F.element_at("options", p)))
        .when(form == 4, F.concat(F.lit("I pick "), p, F.lit(" here")))
        .when(form == 5, F.concat(F.lit("<think>A or B</think>"), p, F.lit(". yes")))
        .otherwise(F.concat(p, F.lit(" or "), other))
    )
    return pick.select("run", "uid", said.alias("reply"))


_MC_RUNS = ", ".join(f"('{r}', {k})" for r, k in MC_RUNS.items())
MCS = rf"""{MC_SQL}, mp0 AS MATERIALIZED (SELECT uid, record, category, key, run, form, oth, CASE WHEN luck < skill THEN key ELSE oth END AS pick FROM (
  SELECT *, {number('mluck', 'run', 'uid')} % 10 AS luck, substr('ABCDE', CAST(1 + {number('mother', 'run', 'uid')} % 5 AS INT), 1) AS oth, {number('mform', 'run', 'uid')} % 7 AS form FROM mc, (VALUES {_MC_RUNS}) r(run, skill))),
mp AS MATERIALIZED (SELECT m.*, CASE form WHEN 0 THEN pick WHEN 1 THEN '**(' || pick || ')** indeed' WHEN 2 THEN 'jawabannya adalah ' || pick || ', surely' WHEN 3 THEN 'it is ' || o.text
   WHEN 4 THEN 'I pick ' || pick || ' here' WHEN 5 THEN '<think>A or B</think>' || pick || '. yes' ELSE pick || ' or ' || oth END AS reply FROM mp0 m JOIN opt o ON o.uid = m.uid AND o.letter = m.pick),
mt AS MATERIALIZED (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(reply, '(?is)<think>.*?</think>', ' ', 'g')), '[*_`#]+', '', 'g'), '\s+', ' ', 'g')) AS t FROM mp),
tx AS (SELECT run, mt.uid, length(trim(text)) AS n, letter, row_number() OVER (PARTITION BY run, mt.uid ORDER BY length(trim(text)) DESC, letter DESC) AS rn,
   lead(length(trim(text))) OVER (PARTITION BY run, mt.uid ORDER BY length(trim(text)) DESC, letter DESC) AS nx FROM mt JOIN opt ON opt.uid = mt.uid WHERE contains(lower(t), lower(trim(text)))),
mr AS (SELECT mt.*, regexp_extract(t, '^\(?([A-E])\)?\s*(?:[.):\-]|$)', 1) AS a, upper(regexp_extract(t, '(?i)(?:jawaban(?:nya)?|pilihan(?:nya)?|answer)\s*(?:adalah|ialah|:|=)?\s*\(?([A-E])\)?(?:[^A-Za-z]|$)', 1)) AS b,
   CASE WHEN nx IS NULL OR n > nx THEN letter END AS c, list_distinct(regexp_extract_all(regexp_replace(t, '([^A-Za-z])', '\1\1', 'g'), '(?:^|[^A-Za-z])([A-E])(?:[^A-Za-z]|$)', 1)) AS d
   FROM mt LEFT JOIN tx ON tx.run = mt.run AND tx.uid = mt.uid AND rn = 1),
ms AS MATERIALIZED (SELECT run, uid, record, category, key, choice, CASE WHEN choice = key THEN 1 ELSE 0 END AS correct, CASE WHEN choice <> '' THEN 1 ELSE 0 END AS readable FROM (
  SELECT *, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c IS NOT NULL THEN c WHEN len(d) = 1 THEN d[1] ELSE '' END AS choice FROM mr))"""


def scored_choices(spark: SparkSession, sf: str) -> DataFrame:
    items = mc_items(spark, sf).select("uid", "record", "category", "key", "options")
    return scoring.score_choices(choice_predictions(spark, sf), items, "uid")


@query("chosen_letter", f"WITH {MCS} SELECT run, uid, choice FROM ms")
def chosen_letter(spark: SparkSession, sf: str) -> DataFrame:
    return scored_choices(spark, sf).select("run", "uid", "choice")


@query("match_by_id", f"WITH {MCS} SELECT run, uid, category, CAST(correct AS BIGINT) AS correct, CAST(readable AS BIGINT) AS readable FROM ms")
def match_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return scored_choices(spark, sf).select("run", "uid", "category", "correct", "readable")


@query(
    "completeness_gate",
    f"WITH {MCS} SELECT run, count(*) AS n_matched, (SELECT count(*) FROM mc) AS n_items, count(*) = (SELECT count(*) FROM mc) AS complete FROM ms WHERE run <> 's1' OR record % 100 <> 0 GROUP BY run",
)
def completeness_gate(spark: SparkSession, sf: str) -> DataFrame:
    preds = choice_predictions(spark, sf).where("run <> 's1' or cast(split(uid, '-')[0] as bigint) % 100 <> 0")
    return scoring.completeness_gate(preds, mc_items(spark, sf), "run", "uid")


@query("gated_choices", f"WITH {MCS} SELECT run, category, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct FROM ms GROUP BY run, category")
def gated_choices(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of runs that answer every item of the current build; anything else ends the job."""
    items = mc_items(spark, sf).select("uid", "record", "category", "key", "options")
    preds = choice_predictions(spark, sf)
    build = provenance.dataset_fingerprint(items.select("uid", "key"), ["uid", "key"], "mc").select(F.col("label").alias("question_file"), F.hex("xor_digest").alias("sha"))
    headers = preds.select(F.col("run").alias("file"), F.lit("mc").alias("question_file")).distinct().join(build, "question_file")
    return gates.scored_choices(preds, items, headers, build, "uid").groupBy("run", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct"))


@query(
    "gated_matches",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY rec, category ORDER BY ord) AS i, count(*) OVER (PARTITION BY rec, category) AS m FROM {_SLOT_KEYS}),
    p AS (SELECT *, row_number() OVER (PARTITION BY rec, category ORDER BY ord) AS i FROM {_SLOT_PRED})
    SELECT p.rec, p.category, count(*) AS n, count(DISTINCT gold) AS n_keys FROM p JOIN k ON k.rec = p.rec AND k.category = p.category AND k.i = least(p.i, k.m) GROUP BY ALL""",
)
def gated_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions matched by position, if each of them has a key."""
    preds, keys = slot_preds(spark, sf), slot_keys(spark, sf)
    matched = gates.passed(scoring.match_by_position(preds, keys, ["rec", "category"], "ord"), gates.matched_gate(preds, keys, ["rec", "category"]))
    return matched.groupBy("rec", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gold").alias("n_keys"))


@query(
    "mc_report",
    f"""WITH {MCS}, l AS (SELECT run, choice, count(*) AS c, row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, choice) AS rn, sum(count(*)) OVER (PARTITION BY run) AS a FROM ms WHERE readable = 1 GROUP BY run, choice)
    SELECT m.run, category, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(readable), 6) AS readable, CAST(NULL AS VARCHAR) AS modal_letter, CAST(NULL AS DOUBLE) AS modal_share, CAST(NULL AS BOOLEAN) AS warn_unreadable, CAST(NULL AS BOOLEAN) AS warn_one_letter FROM ms m GROUP BY m.run, category
    UNION ALL SELECT m.run, NULL, count(*), round(avg(correct), 6), round(avg(readable), 6), any_value(l.choice), any_value(round(l.c / l.a, 6)), avg(readable) < 0.9, any_value(l.c / l.a > 0.5) FROM ms m JOIN l ON l.run = m.run AND rn = 1 GROUP BY m.run""",
)
def mc_report(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.mc_report(scored_choices(spark, sf))


# log-probabilities from all embedding components, dealt to the five options in turn

_LP = "(SELECT vec_id, substr('ABCDE', CAST(1 + (i - 1) % 5 AS INT), 1) AS letter, CAST(embedding[i] AS DOUBLE) AS lp FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def logprobs(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "lp"))
    return e.select(
        "vec_id", F.substr(F.lit("ABCDE"), (1 + F.col("i") % 5).cast("int"), F.lit(1)).alias("letter"), F.col("lp").cast("double").alias("logprob")
    )


@query(
    "option_likelihood_choice",
    f"""WITH m AS (SELECT vec_id, letter, avg(lp) AS s FROM {_LP} WHERE NOT (vec_id % 20 = 0 AND letter = 'D') GROUP BY vec_id, letter),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, letter) AS rn, count(*) OVER (PARTITION BY vec_id) = 5 AS valid FROM m)
    SELECT vec_id, CASE WHEN valid THEN letter END AS choice, CASE WHEN valid THEN round(s, 6) END AS score, valid FROM b WHERE rn = 1""",
)
def option_likelihood_choice(spark: SparkSession, sf: str) -> DataFrame:
    toks = logprobs(spark, sf)
    items = toks.select("vec_id", "letter").distinct()
    out = scoring.option_likelihood_choice(toks.where("not (vec_id % 20 = 0 and letter = 'D')"), items, "vec_id")
    return out.withColumn("score", F.round("score", 6))


@query(
    "letter_likelihood_choice",
    f"SELECT vec_id, letter AS choice FROM (SELECT vec_id, letter, row_number() OVER (PARTITION BY vec_id ORDER BY max(lp) DESC, letter) AS rn FROM {_LP} GROUP BY vec_id, letter) WHERE rn = 1",
)
def letter_likelihood_choice(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.letter_likelihood_choice(logprobs(spark, sf), "vec_id")


@query(
    "truncation_rate",
    f"""SELECT role, CAST(CASE role WHEN 'assistant' THEN 60 ELSE 30 END AS BIGINT) AS budget, count(*) AS n, round(avg(CASE WHEN k >= CASE role WHEN 'assistant' THEN 60 ELSE 30 END THEN 1 ELSE 0 END), 6) AS share,
    avg(CASE WHEN k >= CASE role WHEN 'assistant' THEN 60 ELSE 30 END THEN 1 ELSE 0 END) > 0.1 AS warn FROM (SELECT role, len({words('text')}) AS k FROM conversations) GROUP BY role""",
)
def truncation_rate(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    replies = c.select("role", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("k"))
    budgets = c.where("role = 'assistant'").select("role", F.lit(60).alias("budget")).distinct()
    return scoring.truncation_rate(replies, "role", "k", 30, budgets)


# controls

_PRIO = "(SELECT o_orderkey, o_orderstatus AS category, o_orderpriority AS answer FROM orders)"


def priorities(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("answer"))


@query(
    "control_constant",
    f"""WITH c AS (SELECT category, answer, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, answer) AS rn FROM {_PRIO} GROUP BY category, answer)
    SELECT p.category, c.answer AS reply, count(*) AS n, CAST(count(*) FILTER (p.answer = c.answer) AS BIGINT) AS hits FROM {_PRIO} p JOIN c ON c.category = p.category AND rn = 1 GROUP BY ALL""",
)
def control_constant(spark: SparkSession, sf: str) -> DataFrame:
    done = scoring.control_constant(priorities(spark, sf), "category", "answer")
    return done.groupBy("category", "reply").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") == F.col("reply")).alias("hits"))


@query(
    "control_random",
    f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {md5('cr', 'o_orderkey')}, o_orderkey) AS pos, count(*) OVER (PARTITION BY category) AS m FROM {_PRIO})
    SELECT a.o_orderkey, a.category, a.answer, b.answer AS reply FROM x a JOIN x b ON b.category = a.category AND b.pos = 1 + {number('cr-draw', 'a.o_orderkey')} % a.m""",
)
def control_random(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.control_random(priorities(spark, sf), "o_orderkey", "category", "answer", "cr")


@query(
    "control_empty",
    f"SELECT category, count(*) AS n, CAST(0 AS BIGINT) AS strict, CAST(0 AS BIGINT) AS lenient FROM ({QA_SQL}) GROUP BY category",
)
def control_empty(spark: SparkSession, sf: str) -> DataFrame:
    """The empty control through the scorer: anything above zero is a fault of the scorer."""
    items = qa_items(spark, sf)
    done = scoring.score(scoring.control_empty(items), ["item_id"], scoring.rival_sets(items))
    return done.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("strict").alias("strict"), F.sum("lenient").alias("lenient"))


@query(
    "control_prior",
    f"""WITH {MC_SQL}, cnt AS (SELECT 'maker' AS category, maker AS text, count(*) AS n FROM pt WHERE maker <> '-' GROUP BY maker UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM pt GROUP BY p_size)
    SELECT uid, letter AS choice FROM (SELECT o.uid, o.letter, row_number() OVER (PARTITION BY o.uid ORDER BY CASE WHEN o.category = 'kind' THEN {number('cp', 'o.uid', 'o.letter')} ELSE coalesce(n, 0) END DESC, o.letter) AS rn
      FROM opt o LEFT JOIN cnt ON cnt.category = o.category AND cnt.text = o.text) WHERE rn = 1""",
)
def control_prior(spark: SparkSession, sf: str) -> DataFrame:
    from tallywright.plans.choice_queries import mc_facts

    counts = mc_facts(spark, sf).where("category <> 'kind'").groupBy("category", F.col("answer").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.control_prior(choice_items.option_rows(mc_items(spark, sf)), counts, "uid", "cp")


@query(
    "answer_share",
    f"SELECT category, answer, n, round(n / m, 6) AS share FROM (SELECT category, answer, count(*) AS n, sum(count(*)) OVER (PARTITION BY category) AS m, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, answer) AS rn FROM {_PRIO} GROUP BY category, answer) WHERE rn = 1",
)
def answer_share(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.most_common(priorities(spark, sf), ["category"], "answer")
