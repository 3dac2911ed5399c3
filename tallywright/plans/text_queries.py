"""Queries for the text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import contract, labels, reply, text
from tallywright.functions.hashing import seeded_number
from tallywright.operators.pairs import token_f1_pairs
from tallywright.plans.base import PRED_SQL, predictions
from tallywright.plans.registry import load, query
from tallywright.plans.sqlkit import edges, flat, gives_away, lines, norm, number, squeeze, whole_word, words


@query(
    "norm_answer",
    f"SELECT doc_id, md5({norm('text')}) AS digest, CAST(length({norm('text')}) AS BIGINT) AS n FROM documents",
)
def norm_answer(spark: SparkSession, sf: str) -> DataFrame:
    n = text.norm_answer(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("bigint").alias("n"))


@query(
    "norm_titles",
    rf"""SELECT p_partkey, {squeeze('lower(p_name)')} AS title,
    trim(regexp_replace(lower(p_name || '!! ' || p_brand), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS loose,
    regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]', '', 'g') AS alnum FROM part""",
)
def norm_titles(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return load(spark, sf, "part").select(
        "p_partkey",
        text.norm_title(c("p_name")).alias("title"),
        text.norm_loose(F.concat(c("p_name"), F.lit("!! "), c("p_brand"))).alias("loose"),
        text.norm_alnum(F.concat(c("p_name"), F.lit("-"), c("p_brand"))).alias("alnum"),
    )


_slug = lambda x: rf"regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    "slugify",
    f"""SELECT doc_id, line, {_slug("l")} AS slug, {_slug("l")} || '.abc' AS file FROM (SELECT doc_id, i - 1 AS line, ls[i] AS l FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {lines('text')} AS ls FROM documents)))""",
)
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", F.posexplode(text.lines_of(F.col("text"))).alias("line", "l"))
    return rows.select(
        "doc_id",
        F.col("line").cast("bigint").alias("line"),
        text.slugify(F.col("l")).alias("slug"),
        text.slugify(F.concat("l", F.lit(".ABC")), keep_extension=True).alias("file"),
    )


@query(
    "is_missing",
    """SELECT lang, CAST(count(*) FILTER (trim(v) IN ('', '-', '–', '—')) AS BIGINT) AS wide,
    CAST(count(*) FILTER (trim(v) IN ('', '-')) AS BIGINT) AS header,
    CAST(count(*) FILTER (trim(v) NOT IN ('', '-', '–', '—')) AS BIGINT) AS present
    FROM (SELECT lang, coalesce(CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' - ' WHEN 2 THEN '—'
      WHEN 3 THEN '–' WHEN 4 THEN NULL ELSE text END, '') AS v FROM documents) GROUP BY lang""",
)
def is_missing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 6
    v = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, F.lit(" - "))
        .when(k == 2, F.lit("—"))
        .when(k == 3, F.lit("–"))
        .when(k == 4, F.lit(None).cast("string"))
        .otherwise(F.col("text"))
    )
    return (
        load(spark, sf, "documents")
        .select("lang", v.alias("v"))
        .groupBy("lang")
        .agg(
            F.count_if(text.is_missing(F.col("v"))).alias("wide"),
            F.count_if(text.is_missing(F.col("v"), text.HEADER_MISSING)).alias("header"),
            F.count_if(text.blank_to_empty(F.col("v")) != "").alias("present"),
        )
    )


@query(
    "contains_whole_word",
    f"""WITH n AS MATERIALIZED (SELECT doc_id, {norm('text')} AS n FROM documents), w AS (SELECT doc_id - 1 AS doc_id, trim(substr(n, 1, 3)) AS needle FROM n)
    SELECT doc_id, needle, {whole_word('n', 'needle')} AS hit FROM n JOIN w USING (doc_id) WHERE needle <> ''""",
)
def contains_whole_word(spark: SparkSession, sf: str) -> DataFrame:
    """Each document is asked for the first letters of the next one."""
    norms = load(spark, sf, "documents").select("doc_id", text.norm_answer(F.col("text")).alias("n"))
    needles = norms.select((F.col("doc_id") - 1).alias("doc_id"), F.trim(F.substring("n", 1, 3)).alias("needle")).where("needle <> ''")
    return norms.join(needles, "doc_id").select("doc_id", "needle", text.contains_whole_word(F.col("n"), F.col("needle")).alias("hit"))


@query(
    "gives_away",
    f"""SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len([l for l in ls if {gives_away('title', 'l')}]) AS BIGINT) AS n_given FROM (
    SELECT doc_id, ls, coalesce(regexp_extract(ls[len(ls)], '^(\\S+)', 1), '') AS title
    FROM (SELECT doc_id, {lines('text')} AS ls FROM documents))""",
)
def gives_away(spark: SparkSession, sf: str) -> DataFrame:
    base = load(spark, sf, "documents").select("doc_id", text.lines_of(F.col("text")).alias("ls"))
    titled = base.withColumn(
        "title", F.coalesce(F.regexp_extract(F.get("ls", F.size("ls") - 1), r"^(\S+)", 1), F.lit(""))
    )
    hit = F.filter("ls", lambda line: text.gives_away(F.col("title"), line))
    return titled.select(
        "doc_id", F.size("ls").cast("bigint").alias("n_lines"), F.size(hit).cast("bigint").alias("n_given")
    )


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_bare = r"lower(regexp_replace(w, '[^\p{L}\p{N}_''-]', '', 'g'))"


@query(
    "is_content_word",
    f"""SELECT lang, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(k) AS BIGINT) AS n_content FROM (
    SELECT lang, len(ws) AS n, len([w for w in ws if length({_bare}) > 2 AND {_bare} NOT IN ({_STOP})]) AS k
    FROM (SELECT lang, {words('text')} AS ws FROM documents)) GROUP BY lang""",
)
def is_content_word(spark: SparkSession, sf: str) -> DataFrame:
    return (
        load(spark, sf, "documents")
        .select("lang", text.words_of(F.col("text")).alias("ws"))
        .select(
            "lang",
            F.size("ws").alias("n"),
            F.size(F.filter("ws", lambda w: text.is_content_word(w))).alias("k"),
        )
        .groupBy("lang")
        .agg(F.sum("n").alias("n_words"), F.sum("k").alias("n_content"))
    )


_THINK_SQL = """SELECT conv_id, turn, CASE conv_id % 4
    WHEN 0 THEN '<think>' || text || '</think> ' || role
    WHEN 1 THEN 'so <THINK>' || text
    WHEN 2 THEN text
    ELSE '<Think>' || role || '</think>' || text || '<think> again ' || turn || '</THINK>' END AS r FROM conversations"""


@query(
    "strip_reasoning",
    rf"""SELECT conv_id, turn, md5(CASE WHEN contains(lower(o), '<think>') THEN '' ELSE {edges('o')} END) AS answer,
    md5(CASE WHEN len(bs) > 0 THEN array_to_string(bs, chr(10) || '---' || chr(10))
        ELSE {edges("regexp_extract(r, '(?is)<think>(.*)$', 1)")} END) AS reasoning
    FROM (SELECT conv_id, turn, r, regexp_replace(r, '(?is)<think>(.*?)</think>', ' ', 'g') AS o,
          [{edges('b')} for b in regexp_extract_all(r, '(?is)<think>(.*?)</think>', 1)] AS bs FROM ({_THINK_SQL}))""",
)
def strip_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id") % 4
    r = (
        F.when(k == 0, F.concat(F.lit("<think>"), F.col("text"), F.lit("</think> "), F.col("role")))
        .when(k == 1, F.concat(F.lit("so <THINK>"), F.col("text")))
        .when(k == 2, F.col("text"))
        .otherwise(
            F.concat(
                F.lit("<Think>"), F.col("role"), F.lit("</think>"), F.col("text"), F.lit("<think> again "),
                F.col("turn"), F.lit("</THINK>"),
            )
        )
    )
    return (
        load(spark, sf, "conversations")
        .withColumn("r", r)
        .select(
            "conv_id",
            "turn",
            F.md5(reply.strip_reasoning(F.col("r"))).alias("answer"),
            F.md5(reply.reasoning_of(F.col("r"))).alias("reasoning"),
        )
    )


_VERDICTS = ["Benar.", "tidak benar", "Itu salah", "bukan salah, tetapi lain", "kurang tepat", "keliru!", "BENAR sekali", ""]


@query(
    "verdict",
    rf"""SELECT conv_id, turn, CASE WHEN w = '' THEN NULL WHEN (w IN ('benar', 'tepat')) <> (n <> '') THEN 'benar'
    ELSE 'salah' END AS verdict FROM (
    SELECT conv_id, turn, regexp_extract(t, '(?:(tidak|bukan|kurang|belum)\s+)?(benar|tepat|salah|keliru)', 2) AS w,
      regexp_extract(t, '(?:(tidak|bukan|kurang|belum)\s+)?(benar|tepat|salah|keliru)', 1) AS n
    FROM (SELECT conv_id, turn, {norm("text || ' ' || [" + ", ".join(f"'{v}'" for v in _VERDICTS)
        + f"][CAST(1 + {number('verdict', 'conv_id', 'turn')} % 8 AS INT)]")} AS t FROM conversations))""",
)
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.element_at(
        F.array(*[F.lit(v) for v in _VERDICTS]),
        (1 + seeded_number("verdict", F.col("conv_id"), F.col("turn")) % 8).cast("int"),
    )
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", reply.verdict(F.concat(F.col("text"), F.lit(" "), pick)).alias("verdict")
    )


@query(
    "number_matches",
    r"""SELECT doc_id, first_n, last_n, doc_id % 3 = 0 AND false OR (coalesce(g = first_n OR g = last_n, false)) AS hit
    FROM (SELECT doc_id, ns[1] AS first_n, ns[len(ns)] AS last_n, CAST(doc_id AS VARCHAR) AS g FROM (
      SELECT doc_id, regexp_extract_all(replace(text || CASE WHEN doc_id % 3 = 0 THEN ' 1,0' ELSE ' ' || doc_id || ' bars' END, ',', ''), '-?\d+') AS ns
      FROM documents))""",
)
def number_matches(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(
        F.col("text"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(" 1,0")).otherwise(F.concat(F.lit(" "), F.col("doc_id"), F.lit(" bars"))),
    )
    ns = reply.numbers(said)
    return load(spark, sf, "documents").select(
        "doc_id",
        F.get(ns, F.lit(0)).alias("first_n"),
        F.get(ns, F.size(ns) - 1).alias("last_n"),
        reply.number_matches(said, F.col("doc_id").cast("string")).alias("hit"),
    )


@query(
    "named_keys",
    r"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(
      regexp_extract_all(t, '(?:do|nada dasar(?:nya)?|bernada dasar|kunci|key)\s+([a-g])(?:[^a-z]|$)', 1),
      regexp_extract_all(t, '(?:^|[^a-z])([a-g])\s+(?:mayor|major|minor|mol)(?:[^a-z]|$)', 1)))), ',') AS keys
    FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'do ' || a || ' ' || p_name
      WHEN 1 THEN a || ' mayor atau ' || b || ' mayor' WHEN 2 THEN 'nada dasarnya ' || a
      WHEN 3 THEN 'kunci ' || a || ' do ' || b || ' ' ELSE p_name END AS t
      FROM (SELECT p_partkey, p_name, substr('abcdefg', CAST(1 + p_partkey % 7 AS INT), 1) AS a,
            substr('abcdefg', CAST(1 + p_size % 7 AS INT), 1) AS b FROM part))""",
)
def named_keys(spark: SparkSession, sf: str) -> DataFrame:
    a = F.substr(F.lit("ABCDEFG"), (1 + F.col("p_partkey") % 7).cast("int"), F.lit(1))
    b = F.substr(F.lit("ABCDEFG"), (1 + F.col("p_size") % 7).cast("int"), F.lit(1))
    k = F.col("p_partkey") % 5
    said = (
        F.when(k == 0, F.concat(F.lit("Do = "), a, F.lit(" "), F.col("p_name")))
        .when(k == 1, F.concat(a, F.lit(" Mayor atau "), b, F.lit("-Mayor")))
        .when(k == 2, F.concat(F.lit("nada dasarnya "), a))
        .when(k == 3, F.concat(F.lit("kunci "), a, F.lit("; do="), b, F.lit("!")))
        .otherwise(F.col("p_name"))
    )
    return load(spark, sf, "part").select("p_partkey", F.array_join(reply.named_keys(said), ",").alias("keys"))


_MELODY_TEXT = "text || ' #' || (1 + doc_id % 7) || ''', 5,_. | - 3__'"


@query(
    "melody_tokens",
    f"""SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, md5(array_to_string(ts, ' ')) AS digest FROM (
    SELECT doc_id, regexp_extract_all({_MELODY_TEXT}, '[#b]*[0-7]['',]*_*\\.?|-|\\|') AS ts FROM documents)""",
)
def melody_tokens(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.col("text"), F.lit(" #"), 1 + F.col("doc_id") % 7, F.lit("', 5,_. | - 3__"))
    ts = reply.melody_tokens(said)
    return load(spark, sf, "documents").select(
        "doc_id", F.size(ts).cast("bigint").alias("n"), F.md5(F.array_join(ts, " ")).alias("digest")
    )


_TOK = "string_split({0}, ' ')"


@query(
    "token_f1",
    f"""WITH pairs AS (SELECT a.doc_id, {norm('a.text')} AS p, {norm('b.text')} AS g
      FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    pt AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(string_split(p, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY ALL),
    gt AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(string_split(g, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY ALL),
    c AS (SELECT doc_id, sum(least(pt.n, gt.n)) AS c FROM pt JOIN gt USING (doc_id, t) GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN np + ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0
      ELSE CAST(2 * coalesce(c, 0) AS DOUBLE) / (np + ng) END, 6) AS f1
    FROM (SELECT doc_id, len([t for t in string_split(p, ' ') if t <> '']) AS np,
          len([t for t in string_split(g, ' ') if t <> '']) AS ng FROM pairs) LEFT JOIN c USING (doc_id)""",
)
def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("gold"))
    pairs = docs.withColumnRenamed("text", "pred").join(after, "doc_id")
    return token_f1_pairs(pairs, "doc_id", "pred", "gold").select("doc_id", F.round("f1", 6).alias("f1"))


_PHR = " OR ".join(f"contains(lower(r), '{p}')" for p in reply.REFUSAL)


@query(
    "refusal_without_name",
    f"""SELECT run, item_id, ({_PHR}) AND NOT regexp_matches({norm('r')}, '(^|[^\\p{{L}}\\p{{N}}_])(brand|economy|promo)([^\\p{{L}}\\p{{N}}_]|$)') AS declined
    FROM (SELECT run, item_id, reply AS r FROM ({PRED_SQL}) WHERE starts_with(category, 'maker'))""",
)
def refusal_without_name(spark: SparkSession, sf: str) -> DataFrame:
    rivals = F.array(*[F.lit(x) for x in ("brand", "economy", "promo", "abc")])
    return (
        predictions(spark, sf)
        .where(F.startswith("category", F.lit("maker")))
        .select("run", "item_id", reply.is_refusal_without_name(F.col("reply"), rivals).alias("declined"))
    )


@query(
    "header_field",
    r"""SELECT page_id, trim(regexp_extract(t, '(?m)^title:(.*)$', 1)) AS title, trim(regexp_extract(t, '(?m)^lang:(.*)$', 1)) AS lang,
    trim(regexp_extract(t, '(?m)^%[\t\n\f\r ]*source[ \t]+(.*)$', 1)) AS source FROM (
    SELECT page_id, 'lang: ' || regexp_extract(html, 'lang="([a-z]*)"', 1) || chr(10) || 'title:' ||
      regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || '% source ' || url AS t FROM pages)""",
)
def header_field(spark: SparkSession, sf: str) -> DataFrame:
    record = F.concat(
        F.lit("lang: "), F.regexp_extract("html", 'lang="([a-z]*)"', 1),
        F.lit("\ntitle:"), F.regexp_extract("html", "<title>([^<]*)</title>", 1),
        F.lit("\n% source "), F.col("url"),
    )
    return (
        load(spark, sf, "pages")
        .withColumn("t", record)
        .select(
            "page_id",
            text.header_field(F.col("t"), "title").alias("title"),
            text.header_field(F.col("t"), "lang").alias("lang"),
            text.directive(F.col("t"), "source").alias("source"),
        )
    )


@query(
    "canonical_key_letter",
    r"""SELECT p_partkey, CASE WHEN h <> '' THEN h ELSE p END AS letter,
    CASE WHEN h = '' AND p = '' THEN 'no key' WHEN h <> '' AND p <> '' AND h <> p THEN 'sources disagree' ELSE '' END AS note
    FROM (SELECT p_partkey, upper(regexp_extract(trim(p_name), '^([A-Ga-g])', 1)) AS h,
      CASE WHEN p_size % 3 = 0 THEN '' ELSE substr('ABCDEFG', CAST(1 + p_size % 7 AS INT), 1) END AS p FROM part)""",
)
def canonical_key_letter(spark: SparkSession, sf: str) -> DataFrame:
    printed = F.when(F.col("p_size") % 3 == 0, F.lit("-")).otherwise(
        F.concat(F.lit("Do = "), F.substr(F.lit("ABCDEFG"), (1 + F.col("p_size") % 7).cast("int"), F.lit(1)))
    )
    letter, note = text.canonical_key_letter(F.col("p_name"), printed)
    return load(spark, sf, "part").select("p_partkey", letter.alias("letter"), note.alias("note"))


@query(
    "split_quoted_tempo",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' (1/4=' || p_size || ')'
    WHEN p_partkey % 3 = 1 THEN p_name ELSE '"' || p_name || '"' END AS tempo FROM part""",
)
def split_quoted_tempo(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit(' "'), F.col("p_name"), F.lit('" 1/4='), F.col("p_size")))
        .when(k == 1, F.concat(F.lit("  "), F.col("p_name")))
        .otherwise(F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
    )
    return load(spark, sf, "part").select("p_partkey", text.split_quoted_tempo(raw).alias("tempo"))


@query(
    "unfence",
    f"""SELECT conv_id, turn, md5({edges('x')}) AS body FROM (SELECT conv_id, turn, CASE conv_id % 3
      WHEN 0 THEN role || ' %abc ' || turn
      WHEN 1 THEN text ELSE '%abc ' || text END AS x FROM conversations)""",
)
def unfence(spark: SparkSession, sf: str) -> DataFrame:
    fence = F.lit("```")
    k = F.col("conv_id") % 3
    marked = F.concat(
        F.lit("see\n```txt\n"), F.col("text"), F.lit("\n```\nand\n```\n"), F.col("role"), F.lit(" %abc "),
        F.col("turn"), F.lit("\n"), fence,
    )
    longest = F.concat(F.lit("```\na\n```\n```text\n"), F.col("text"), F.lit("\n"), fence)
    said = F.when(k == 0, marked).when(k == 1, longest).otherwise(F.concat(F.lit("%abc "), F.col("text")))
    body = F.regexp_replace(text.unfence(said, "%abc"), r"^\s+|\s+$", "")
    return load(spark, sf, "conversations").select("conv_id", "turn", F.md5(body).alias("body"))


_RULES_SQL = """[r for r in [
    CASE WHEN NOT starts_with(html, '<!DOCTYPE html>') THEN 'no doctype' END,
    CASE WHEN NOT contains(html, '<title>') THEN 'no title' END,
    CASE WHEN NOT regexp_matches(html, '<html[^>]*lang="') THEN 'no language' END,
    CASE WHEN NOT contains(html, '<h1>') THEN 'no heading' END,
    CASE WHEN contains(html, '<nav>') THEN 'has navigation' END,
    CASE WHEN NOT (len(string_split(html, '<p>')) - 1 >= 4) THEN 'fewer than four paragraphs' END] if r IS NOT NULL]"""


@query("contract_check", f"SELECT page_id, unnest({_RULES_SQL}) AS violation FROM pages")
def contract_check(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    rules = [
        ("no doctype", F.startswith(h, F.lit("<!DOCTYPE html>"))),
        ("no title", F.contains(h, F.lit("<title>"))),
        ("no language", h.rlike('<html[^>]*lang="')),
        ("no heading", F.contains(h, F.lit("<h1>"))),
        ("has navigation", ~F.contains(h, F.lit("<nav>"))),
        ("fewer than four paragraphs", F.regexp_count(h, F.lit("<p>")) >= 4),
    ]
    return load(spark, sf, "pages").select("page_id", F.explode(labels.contract_check(rules)).alias("violation"))


HOUSE = contract.Contract(directives=("page-key",), fields=("X", "T", "C", "Q", "M", "L", "K"), forbidden=("build-id", "build-file"), excuse="% chords only")


def delivered(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, file): notation files with faults of every kind; the bars are the words of a document's first line."""
    first = F.coalesce(F.get(text.lines_of(F.col("text")), F.lit(0)), F.lit(""))
    docs = load(spark, sf, "documents").select("doc_id", "lang", F.array_join(text.words_of(first), " | ").alias("bars"))
    d = F.col("doc_id")
    title, composer = F.concat(F.lit("T:"), "lang", F.lit("\n")), F.when(d % 4 == 0, F.lit("C:\n")).otherwise(F.lit("C:anon\n"))
    file = F.concat(
        F.when(d % 6 == 0, F.lit("%abc-2.0\n")).otherwise(F.lit("%abc-2.1\n")),
        F.when(d % 5 != 0, F.lit("% page-key do = C\n")).when(d % 10 == 0, F.lit("%% page-key G\n")).otherwise(F.lit("")),
        F.when(d % 17 == 0, F.lit("%%build-id 7\n")).otherwise(F.lit("")),
        F.lit("X:1\n"),
        F.when(d % 7 == 0, F.concat(composer, title)).otherwise(F.concat(title, composer)),
        F.when(d % 3 == 0, F.lit("")).otherwise(F.lit("Q:1/4=90\n")),
        F.lit("M:4/4\n"),
        F.when(d % 9 == 0, F.lit("L:1/16\n")).otherwise(F.lit("L: 1/8 \n")),
        F.lit("K:C\n| "), "bars",
        F.when(d % 8 == 0, F.lit("\n% chords only")).otherwise(F.lit("")),
        F.lit("\nw: a | b | c | d | e | f | g | h | i\n"),
    )
    return docs.select("doc_id", file.alias("file"))


@query(
    "contract_rules",
    f"""WITH f AS (SELECT doc_id AS d, 1 + length(b) - length(replace(b, '|', '')) AS bars FROM (SELECT doc_id, coalesce(array_to_string({words('coalesce(l[1], chr(32))')}, ' | '), '') AS b FROM (SELECT doc_id, {lines('text')} AS l FROM documents)))
    SELECT d AS doc_id, unnest([r for r in [
      CASE WHEN d % 6 = 0 THEN 'first line is not the version mark' END, CASE WHEN d % 10 = 5 THEN 'no directive page-key' END,
      CASE WHEN d % 4 = 0 THEN 'field C is empty' END, CASE WHEN d % 3 = 0 THEN 'no field Q' END, CASE WHEN d % 7 = 0 THEN 'fields out of order' END,
      CASE WHEN d % 9 = 0 THEN 'field L is not 1/8' END, CASE WHEN d % 17 = 0 THEN 'holds a directive that only the build may write' END,
      CASE WHEN bars < 8 AND d % 8 <> 0 THEN 'fewer than 8 bar lines' END] if r IS NOT NULL]) AS violation FROM f""",
)
def contract_rules(spark: SparkSession, sf: str) -> DataFrame:
    return delivered(spark, sf).select("doc_id", F.explode(contract.violations(F.col("file"), HOUSE)).alias("violation"))


_HOST = "regexp_extract(url, 'https?://([a-z0-9.]*)', 1)"


@query(
    "parse_run_label",
    f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'prior' WHEN 1 THEN {_HOST} WHEN 2 THEN {_HOST} || ' [r8-x]'
      WHEN 3 THEN {_HOST} ELSE {_HOST} || '-odd' END AS model,
    CASE page_id % 5 WHEN 0 THEN 'control' WHEN 1 THEN 'base' ELSE 'trained' END AS kind,
    CASE page_id % 5 WHEN 2 THEN page_id WHEN 3 THEN 3 END AS seed,
    CASE page_id % 5 WHEN 0 THEN 'mc' WHEN 4 THEN '' ELSE 'full' END AS regime,
    CASE page_id % 5 WHEN 1 THEN 'peluang-opsi' WHEN 2 THEN 'peluang' ELSE '' END AS method FROM pages""",
)
def parse_run_label(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "https?://([a-z0-9.]*)", 1)
    k = F.col("page_id") % 5
    name = (
        F.when(k == 0, F.lit("kontrol-prior--mc.jsonl"))
        .when(k == 1, F.concat(host, F.lit("-base-peluang-opsi--full.jsonl")))
        .when(k == 2, F.concat(host, F.lit("-full-s"), F.col("page_id"), F.lit("-r8-x-peluang--full.jsonl")))
        .when(k == 3, F.concat(host, F.lit("-split70-s3--full.jsonl")))
        .otherwise(F.concat(host, F.lit("-odd.jsonl")))
    )
    return load(spark, sf, "pages").select("page_id", labels.parse_run_label(name).alias("l")).select("page_id", "l.*")


@query(
    "parse_external_label",
    f"SELECT page_id, {_HOST} AS model, CASE WHEN page_id % 4 IN (1, 3) THEN 'neutral' ELSE 'own' END AS prompt FROM pages",
)
def parse_external_label(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "https?://([a-z0-9.]*)", 1)
    k = F.col("page_id") % 4
    name = (
        F.when(k == 0, F.concat(host, F.lit("--exam.jsonl")))
        .when(k == 1, F.concat(host, F.lit("-netral--exam.jsonl")))
        .when(k == 2, F.concat(F.lit("arm-"), host, F.lit("-peluang-opsi--exam.jsonl")))
        .otherwise(F.concat(host, F.lit("-peluang-netral--exam.jsonl")))
    )
    return load(spark, sf, "pages").select("page_id", labels.parse_external_label(name, "exam", ["arm-"]).alias("l")).select("page_id", "l.*")


@query(
    "canonicalise_values",
    """WITH m AS (SELECT n_name AS printed, CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE 'NATION_' || (n_nationkey % 5) END AS canonical
      FROM nation WHERE n_nationkey % 2 = 0),
    f AS (SELECT n_name, coalesce(canonical, n_name) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN m ON printed = n_name)
    SELECT c AS nation, count(*) AS suppliers, count(DISTINCT n_name) AS spellings,
      (SELECT count(DISTINCT n_name) FROM f) AS distinct_before, (SELECT count(DISTINCT c) FROM f) AS distinct_after
    FROM f GROUP BY c""",
)
def canonicalise_values(spark: SparkSession, sf: str) -> DataFrame:
    nation = load(spark, sf, "nation")
    table = nation.where("n_nationkey % 2 = 0").select(
        F.col("n_name").alias("printed"),
        F.when(F.col("n_nationkey") % 7 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("NATION_"), F.col("n_nationkey") % 5))
        .alias("canonical"),
    )
    named = load(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    done = labels.canonicalise_values(named, "n_name", table)
    counts = done.agg(
        F.countDistinct("n_name_printed").alias("b"), F.countDistinct("n_name").alias("a")
    )
    return done.groupBy(F.col("n_name").alias("nation")).agg(
        F.count(F.lit(1)).alias("suppliers"), F.countDistinct("n_name_printed").alias("spellings")
    ).select(
        "*",
        counts.select("b").scalar().alias("distinct_before"),
        counts.select("a").scalar().alias("distinct_after"),
    )


@query(
    "conditional_class",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN contains(o_orderpriority, 'NOT') THEN 'unspecified' ELSE 'open' END AS class,
    count(*) AS n FROM orders GROUP BY 1""",
)
def conditional_class(spark: SparkSession, sf: str) -> DataFrame:
    c = (
        F.when(F.col("o_orderstatus") == "F", F.lit("closed"))
        .when(F.contains("o_orderpriority", F.lit("NOT")), F.lit("unspecified"))
        .otherwise(F.lit("open"))
    )
    return load(spark, sf, "orders").groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "render_chat",
    """SELECT item_id, condition, role, md5(content) AS content FROM (
    SELECT item_id, s.condition, 'system' AS role, s.system AS content FROM benchmark, (VALUES ('own', 'You know the book.'), ('neutral', 'You answer questions.')) s(condition, system)
    UNION ALL SELECT item_id, s.condition, 'user', text || chr(10) || chr(10) || 'A. not ' || text || chr(10) || 'B. ' || item_id || chr(10) || 'C. none'
      || chr(10) || chr(10) || 'Answer with one letter.'
    FROM benchmark, (VALUES ('own', 1), ('neutral', 2)) s(condition, n))""",
)
def render_chat(spark: SparkSession, sf: str) -> DataFrame:
    conditions = F.array(
        F.struct(F.lit("own").alias("condition"), F.lit("You know the book.").alias("system")),
        F.struct(F.lit("neutral").alias("condition"), F.lit("You answer questions.").alias("system")),
    )
    options = F.create_map(
        F.lit("C"), F.lit("none"), F.lit("A"), F.concat(F.lit("not "), "text"), F.lit("B"), F.col("item_id").cast("string")
    )
    return (
        load(spark, sf, "benchmark")
        .withColumn("s", F.explode(conditions))
        .select(
            "item_id",
            "s.condition",
            F.explode(labels.render_chat(F.col("text"), options, F.col("s.system"), "Answer with one letter.")).alias("m"),
        )
        .select("item_id", "condition", "m.role", F.md5("m.content").alias("content"))
    )


@query(
    "split_prompt_completion",
    """SELECT doc_id, CAST(2 AS BIGINT) AS n_prompt, 'assistant' AS last_role, md5(text) AS last_text, md5('s|' || lang) AS prompt FROM documents""",
)
def split_prompt_completion(spark: SparkSession, sf: str) -> DataFrame:
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(turn("system", F.lit("s")), turn("user", F.col("lang")), turn("assistant", F.col("text")))
    rows = load(spark, sf, "documents").select("doc_id", messages.alias("m"))
    prompt, completion = labels.split_prompt_completion(F.col("m"))
    return rows.select(
        "doc_id",
        F.size(prompt).cast("bigint").alias("n_prompt"),
        F.get(completion, F.lit(0))["role"].alias("last_role"),
        F.md5(F.get(completion, F.lit(0))["content"]).alias("last_text"),
        F.md5(F.array_join(F.transform(prompt, lambda x: x["content"]), "|")).alias("prompt"),
    )


@query(
    "split_turns",
    """SELECT conv_id, turn, role, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'completion' ELSE 'prompt' END AS part
    FROM conversations""",
)
def split_turns(spark: SparkSession, sf: str) -> DataFrame:
    return labels.split_turns(load(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query(
    "quoted_part",
    """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'no blank ' || lang END) AS quoted FROM documents""",
)
def quoted_part(spark: SparkSession, sf: str) -> DataFrame:
    q = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Which one?\n\n"), F.col("text"))).otherwise(
        F.concat(F.lit("no blank "), F.col("lang"))
    )
    return load(spark, sf, "documents").select("doc_id", F.md5(text.quoted_part(q)).alias("quoted"))


@query(
    "display_name",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' (' || p_type || ')' END AS name FROM part",
)
def display_name(spark: SparkSession, sf: str) -> DataFrame:
    unique = F.when(F.col("p_partkey") % 2 == 0, F.lit("  ")).otherwise(
        F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")"))
    )
    return load(spark, sf, "part").select("p_partkey", text.display_name(unique, F.col("p_name")).alias("name"))
