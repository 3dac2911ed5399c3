"""Queries for notation and lyrics, on tunes that Spark spells from documents.

Every document becomes one tune: its words give the notes of a line and the
lyric under it. The SQL twin spells the same text and reads it on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.text import let, lines_of, words_of
from tallywright.operators import lyrics, tunes
from tallywright.operators.ranking import deal
from tallywright.plans.registry import load, query
from tallywright.plans.sqlkit import lines, words

METERS = ["4/4", "3/4", "C", "6/8", "2+3/8", "none"]
KEYS = ["C", "G", "Dm", "Bb", "F#", "Am", "Eb mix", "none"]


def _note(w: Column, j: Column) -> Column:
    n = F.length(w)
    letter = F.substr(F.lit("CDEFGAB"), 1 + n % 7, F.lit(1))
    high = n > 8
    acc = F.when(F.contains(w, F.lit(",")), F.lit("^")).when(F.contains(w, F.lit(".")), F.lit("=")).when(
        F.contains(w, F.lit("?")), F.lit("__")
    ).otherwise(F.lit(""))
    octave = F.when(high & F.endswith(w, F.lit("e")), F.lit("'")).when(~high & F.endswith(w, F.lit("n")), F.lit(",")).otherwise(F.lit(""))
    dur = F.element_at(F.array(*[F.lit(x) for x in ("2", "/2", "3/2", "", "/")]), (1 + n % 5).cast("int"))
    body = F.when(n == 2, F.lit("z")).otherwise(F.concat(acc, F.when(high, F.lower(letter)).otherwise(letter), octave))
    bar = F.when(j % 8 == 7, F.lit(" ||")).when(j % 4 == 3, F.lit(" |")).otherwise(F.lit(""))
    return F.concat(F.when(j % 12 == 4, F.lit("(3")).otherwise(F.lit("")), body, dur, bar)


def _music(ws: Column, i: Column) -> Column:
    lead = F.concat(
        F.when(i % 3 == 1, F.lit("[M:3/4] ")).otherwise(F.lit("")),
        F.when(i % 7 == 3, F.lit("[L:1/16] ")).when(i % 7 == 4, F.lit("[L:1/8] ")).otherwise(F.lit("")),
        F.when(i % 5 == 2, F.lit("[K:G] ")).otherwise(F.lit("")),
    )
    tail = F.when(i % 4 == 3, F.lit(" :|")).when(i % 9 == 8, F.lit(' "Am" (')).otherwise(F.lit(""))
    return F.concat(lead, F.array_join(F.transform(ws, _note), " "), tail)


def _lyric(ws: Column, i: Column) -> Column:
    def syllables(w: Column, j: Column) -> Column:
        n = F.length(w)
        sung = (
            F.when(n == 2, F.lit("*"))
            .when(n >= 6, F.concat(F.substring(w, 1, 3), F.lit("- "), F.substr(w, F.lit(4))))
            .otherwise(w)
        )
        return F.concat(sung, F.when(j % 4 == 3, F.lit(" |")).otherwise(F.lit("")))

    return F.concat(
        F.lit("w: "), F.array_join(F.transform(ws, syllables), " "), F.when(i % 4 == 1, F.lit("-")).otherwise(F.lit(""))
    )


def spelled_tunes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, tune): one expression per document, dealt by document before it is worked out."""
    docs = deal(load(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").select("doc_id", "lang", lines_of(F.col("text")).alias("ls"))
    body = F.array_join(
        F.transform(
            "ls",
            lambda x, i: let(
                words_of(x),
                lambda ws: F.concat(
                    _music(ws, i),
                    F.lit("\n"),
                    _lyric(ws, i),
                    F.when(i % 2 == 0, F.concat(F.lit("\n"), _lyric(F.reverse(ws), i))).otherwise(F.lit("")),
                ),
            ),
        ),
        "\n",
    )
    d = F.col("doc_id")
    meter = F.element_at(F.array(*[F.lit(m) for m in METERS]), (1 + d % len(METERS)).cast("int"))
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (1 + d % len(KEYS)).cast("int"))
    head = F.concat(
        F.when(d % 13 == 0, F.lit("")).otherwise(F.lit("%abc-2.1\n")),
        F.lit("X:1\nT:"), d,
        F.when(d % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("\nM:"), meter)),
        F.lit("\nL:1/8\nK:"), key, F.lit("\n"),
    )
    return docs.select("doc_id", "lang", F.concat(head, body, F.lit("\nW: "), F.coalesce(F.get("ls", F.lit(0)), F.lit("-"))).alias("tune"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SQL_NOTE = """(CASE WHEN (j - 1) % 12 = 4 THEN '(3' ELSE '' END
  || CASE WHEN length(w) = 2 THEN 'z' ELSE
      (CASE WHEN contains(w, ',') THEN '^' WHEN contains(w, '.') THEN '=' WHEN contains(w, '?') THEN '__' ELSE '' END)
      || (CASE WHEN length(w) > 8 THEN lower(substr('CDEFGAB', 1 + length(w) % 7, 1)) ELSE substr('CDEFGAB', 1 + length(w) % 7, 1) END)
      || (CASE WHEN length(w) > 8 AND ends_with(w, 'e') THEN '''' WHEN length(w) <= 8 AND ends_with(w, 'n') THEN ',' ELSE '' END) END
  || ['2', '/2', '3/2', '', '/'][1 + length(w) % 5]
  || CASE WHEN (j - 1) % 8 = 7 THEN ' ||' WHEN (j - 1) % 4 = 3 THEN ' |' ELSE '' END)"""
_SQL_SYL = """(CASE WHEN length(w) = 2 THEN '*' WHEN length(w) >= 6 THEN substr(w, 1, 3) || '- ' || substr(w, 4) ELSE w END
  || CASE WHEN (j - 1) % 4 = 3 THEN ' |' ELSE '' END)"""


def _sql_lyric(ws: str) -> str:
    return f"'w: ' || coalesce(array_to_string(list_transform({ws}, lambda w, j: {_SQL_SYL}), ' '), '') || CASE WHEN i % 4 = 1 THEN '-' ELSE '' END"


TUNES_SQL = f"""SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE '%abc-2.1' || chr(10) END || 'X:1' || chr(10) || 'T:' || d.doc_id
  || CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE chr(10) || 'M:' || {_sql_list(METERS)}[1 + d.doc_id % {len(METERS)}] END
  || chr(10) || 'L:1/8' || chr(10) || 'K:' || {_sql_list(KEYS)}[1 + d.doc_id % {len(KEYS)}] || chr(10) || coalesce(b.body, '')
  || chr(10) || 'W: ' || coalesce(({lines('d.text')})[1], '-') AS tune
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(
    CASE WHEN i % 3 = 1 THEN '[M:3/4] ' ELSE '' END || CASE WHEN i % 7 = 3 THEN '[L:1/16] ' WHEN i % 7 = 4 THEN '[L:1/8] ' ELSE '' END
    || CASE WHEN i % 5 = 2 THEN '[K:G] ' ELSE '' END || coalesce(array_to_string(list_transform(ws, lambda w, j: {_SQL_NOTE}), ' '), '')
    || CASE WHEN i % 4 = 3 THEN ' :|' WHEN i % 9 = 8 THEN ' "Am" (' ELSE '' END
    || chr(10) || {_sql_lyric('ws')} || CASE WHEN i % 2 = 0 THEN chr(10) || {_sql_lyric('list_reverse(ws)')} ELSE '' END, chr(10) ORDER BY i) AS body
  FROM (SELECT doc_id, p - 1 AS i, {words('ls[p]')} AS ws FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, {lines('text')} AS ls FROM documents)))
  GROUP BY doc_id) b ON b.doc_id = d.doc_id"""

# the oracle's own reading of a tune: body lines, tokens, running state
_BODY_SQL = rf"""tunes AS MATERIALIZED ({TUNES_SQL}),
cut AS MATERIALIZED (SELECT doc_id, lang, tune, string_split(tune, chr(10)) AS ls, list_position([starts_with(x, 'K:') for x in string_split(tune, chr(10))], true) AS k_at FROM tunes),
all_lines AS MATERIALIZED (SELECT doc_id, lang, tune, unnest(range(1, len(ls) + 1)) AS line, trim(unnest(ls)) AS body, k_at FROM cut),
heads AS (SELECT doc_id, any_value(lang) AS lang, any_value(tune) AS tune, any_value(k_at) AS k_at,
  coalesce(max(CASE WHEN line < k_at AND starts_with(body, 'M:') THEN substr(body, 3) END), '') AS meter,
  coalesce(max(CASE WHEN line = k_at THEN substr(body, 3) END), '') AS key_text FROM all_lines GROUP BY doc_id),
body AS (SELECT l.doc_id, line, body, key_text,
  CASE WHEN meter IN ('C', 'none', '') THEN 1 WHEN meter = '4/4' THEN 4 WHEN meter = '3/4' THEN 3 WHEN meter = '6/8' THEN 6 ELSE 5 END AS hq_n,
  CASE WHEN meter IN ('C', 'none', '') THEN 1 WHEN meter IN ('4/4', '3/4') THEN 4 ELSE 8 END AS hq_d,
  CASE WHEN starts_with(body, 'w:') THEN 'lyric' WHEN starts_with(body, 'W:') THEN 'field' ELSE 'music' END AS kind
  FROM all_lines l JOIN heads USING (doc_id) WHERE line > l.k_at AND body <> '' AND NOT starts_with(body, '%')),
toks AS (SELECT doc_id, line, key_text, hq_n, hq_d, pos, ts[pos] AS tok FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS pos FROM (
  SELECT doc_id, line, key_text, hq_n, hq_d, regexp_extract_all(regexp_replace(body, '"[^"]*"', '', 'g'),
   '\[[A-Z]:[^\]]*\]|:\||\|\||\||\(\d+|(?:\^|__|=)?[A-Ga-gz][,'']*(?:\d+/\d+|/\d+|/|\d+)?|\S') AS ts FROM body WHERE kind = 'music'))),
typed AS (SELECT *, CASE WHEN starts_with(tok, '[') THEN 'inline' WHEN contains(tok, '|') THEN 'bar' WHEN regexp_matches(tok, '^\(\d') THEN 'tuplet'
  WHEN starts_with(tok, 'z') THEN 'rest' WHEN regexp_matches(tok, '[A-Ga-g]') THEN 'note' ELSE 'other' END AS kind FROM toks),
state AS (SELECT *, count(*) FILTER (kind = 'bar') OVER (PARTITION BY doc_id ORDER BY line, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg,
  last_value(CASE WHEN tok = '[M:3/4]' THEN 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line, pos) AS m34,
  last_value(CASE WHEN tok = '[L:1/16]' THEN 16 WHEN tok = '[L:1/8]' THEN 8 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line, pos) AS u,
  max(CASE WHEN tok = '[K:G]' THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS kg FROM typed),
nth AS (SELECT *, count(*) FILTER (kind IN ('note', 'rest')) OVER (PARTITION BY doc_id, seg ORDER BY line, pos) AS n,
  bool_or(kind NOT IN ('bar', 'inline')) OVER (PARTITION BY doc_id, seg) AS filled FROM state),
parts AS (SELECT *, n - max(CASE WHEN kind = 'tuplet' THEN n END) OVER (PARTITION BY doc_id, seg ORDER BY line, pos) AS since,
  regexp_extract(tok, '^(\^|__|=)', 1) AS acc, regexp_extract(tok, '([A-Ga-gz])', 1) AS letter,
  regexp_extract(tok, '[A-Ga-gz][,'']*(.*)$', 1) AS dur FROM nth),
ev AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY seg) AS bar,
  CASE dur WHEN '2' THEN 2 WHEN '3/2' THEN 3 ELSE 1 END AS ln, CASE dur WHEN '/2' THEN 2 WHEN '3/2' THEN 2 WHEN '/' THEN 2 ELSE 1 END AS ld,
  CASE WHEN since BETWEEN 1 AND 3 THEN 3 ELSE 1 END AS tp, CASE WHEN since BETWEEN 1 AND 3 THEN 2 ELSE 1 END AS tq,
  CASE WHEN m34 = 1 THEN 3 ELSE hq_n END AS q_n, CASE WHEN m34 = 1 THEN 4 ELSE hq_d END AS q_d, coalesce(u, 8) AS ud,
  CASE WHEN kg IS NOT NULL THEN 'G' ELSE key_text END AS key_now,
  length(tok) - length(replace(tok, '''', '')) - (length(tok) - length(replace(tok, ',', ''))) AS oct FROM parts WHERE filled)"""


def stored_tunes(spark: SparkSession, sf: str) -> DataFrame:
    """The spelled tunes, dealt by tune: texts are shuffled once and the tokens cut from them stay where they are. No
    operator works the spelling out again, which lies behind the shuffle."""
    return deal(spelled_tunes(spark, sf), "doc_id")


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    return tunes.tune_headers(stored_tunes(spark, sf), "doc_id", "tune")


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tunes.tune_tokens(_headers(spark, sf), "doc_id")


@query("tune_text", f"SELECT doc_id, md5(tune) AS digest, CAST(length(tune) AS BIGINT) AS n FROM ({TUNES_SQL})")
def tune_text(spark: SparkSession, sf: str) -> DataFrame:
    return spelled_tunes(spark, sf).select("doc_id", F.md5("tune").alias("digest"), F.length("tune").cast("bigint").alias("n"))


@query(
    "tune_events",
    f"""WITH {_BODY_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) AS seq FROM ev WHERE kind IN ('note', 'rest'))
    SELECT doc_id, bar, count(*) AS n, CAST(count(*) FILTER (kind = 'rest') AS BIGINT) AS rests, CAST(sum(seq) AS BIGINT) AS seqs, max(line) AS line,
    CAST(sum(ln * 10 + ld) AS BIGINT) AS lengths, CAST(sum(tp * 10 + tq) AS BIGINT) AS tuplets, CAST(sum(q_n * 10 + q_d) AS BIGINT) AS meters, CAST(sum(ud) AS BIGINT) AS units,
    CAST(sum(oct) AS BIGINT) AS octaves, string_agg(acc || letter, ' ' ORDER BY seq) AS letters, max(key_now) AS key_now FROM e GROUP BY doc_id, bar""",
)
def tune_events(spark: SparkSession, sf: str) -> DataFrame:
    e = tunes.tune_events(_tokens(spark, sf), "doc_id")
    ordered = F.sort_array(F.collect_list(F.struct("seq", F.concat("acc", "letter").alias("t"))))
    return e.groupBy("doc_id", "bar").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("kind") == "rest").alias("rests"),
        F.sum("seq").alias("seqs"),
        F.max("line").alias("line"),
        F.sum(F.col("len_num") * 10 + F.col("len_den")).alias("lengths"),
        F.sum(F.col("tuplet_p") * 10 + F.col("tuplet_q")).alias("tuplets"),
        F.sum(F.col("meter_num") * 10 + F.col("meter_den")).alias("meters"),
        F.sum("unit_den").alias("units"),
        F.sum("octave").alias("octaves"),
        F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("letters"),
        F.max("key_now").alias("key_now"),
    )


_BARS_SQL = """bars AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) AS bar, line,
  CAST(t // gcd(t, 96 * ud) AS BIGINT) AS total_num, CAST(96 * ud // gcd(t, 96 * ud) AS BIGINT) AS total_den, CAST(q_n AS BIGINT) AS quota_num, CAST(q_d AS BIGINT) AS quota_den,
  t * q_d = q_n * 96 * ud AS ok FROM (
  SELECT doc_id, seg, min(CASE WHEN kind NOT IN ('bar', 'inline') THEN line END) AS line, CAST(sum(CASE WHEN kind IN ('note', 'rest') THEN ln * 96 // ld * tq // tp ELSE 0 END) AS BIGINT) AS t,
  arg_max(q_n, line * 1000000 + pos) AS q_n, arg_max(q_d, line * 1000000 + pos) AS q_d, arg_max(ud, line * 1000000 + pos) AS ud FROM ev GROUP BY doc_id, seg))"""


@query("bar_totals", f"WITH {_BODY_SQL}, {_BARS_SQL} SELECT * FROM bars")
def bar_totals(spark: SparkSession, sf: str) -> DataFrame:
    return tunes.bar_totals(_tokens(spark, sf), "doc_id")


@query(
    "bar_violations",
    f"WITH {_BODY_SQL}, {_BARS_SQL} SELECT b.* FROM (SELECT *, max(bar) OVER (PARTITION BY doc_id) AS m FROM bars) b WHERE m > 2 AND bar > 1 AND bar < m AND NOT ok".replace(
        "SELECT b.* FROM", "SELECT b.* EXCLUDE (m) FROM"
    ),
)
def bar_violations(spark: SparkSession, sf: str) -> DataFrame:
    return tunes.bar_violations(tunes.bar_totals(_tokens(spark, sf), "doc_id"), "doc_id")


@query(
    "pickup_check",
    f"""WITH {_BODY_SQL}, {_BARS_SQL}, m AS (SELECT doc_id, max(bar) AS n_bars FROM bars GROUP BY doc_id)
    SELECT m.doc_id, n_bars, (a.total_num * b.total_den + b.total_num * a.total_den) * a.quota_den = a.quota_num * a.total_den * b.total_den AS complementary
    FROM m JOIN bars a ON a.doc_id = m.doc_id AND a.bar = 1 JOIN bars b ON b.doc_id = m.doc_id AND b.bar = n_bars WHERE NOT a.ok OR NOT b.ok""",
)
def pickup_check(spark: SparkSession, sf: str) -> DataFrame:
    return tunes.pickup_check(tunes.bar_totals(_tokens(spark, sf), "doc_id"), "doc_id")


@query(
    "order_bar_totals",
    """SELECT bar_key, n, total, total <> 180 AS off FROM (SELECT l_orderkey AS bar_key, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total,
    row_number() OVER (ORDER BY l_orderkey) AS rn, count(*) OVER () AS m FROM lineitem GROUP BY l_orderkey) WHERE rn > 1 AND rn < m""",
)
def order_bar_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The same shape on orders: totals against a quota, both ends exempt."""
    li = load(spark, sf, "lineitem")
    totals = li.groupBy(F.col("l_orderkey").alias("bar_key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("total")
    )
    ends = li.agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))
    inner = (F.col("bar_key") != ends.select("lo").scalar()) & (F.col("bar_key") != ends.select("hi").scalar())
    return totals.where(inner).withColumn("off", F.col("total") != 180)


_ALIGN_SQL = rf"""counts AS (SELECT doc_id, line, count(*) FILTER (kind = 'note') AS notes, count(*) FILTER (kind IN ('note', 'rest')) AS events FROM typed GROUP BY doc_id, line),
lyr AS (SELECT b.doc_id, b.line, b.kind, list_sum([length(x) - length(replace(x, '_', '')) + CASE WHEN regexp_replace(x, '^_+|_+$', '', 'g') = '*'
   OR regexp_matches(regexp_replace(x, '^_+|_+$', '', 'g'), '[\p{{L}}\p{{N}}_]') THEN 1 ELSE 0 END
   for x in regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(substr(b.body, 3), '%.*$', ''), '\|\]|\[\||\|?\[[12]', ' ', 'g'), '[|\[\]]', ' ', 'g'), '[\s-]+') if x <> '']) AS tokens,
   c.notes AS n0, c.events AS e0 FROM body b LEFT JOIN counts c ON c.doc_id = b.doc_id AND c.line = b.line WHERE b.kind <> 'field'),
al AS (SELECT doc_id, line, kind, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, coalesce(last_value(n0 IGNORE NULLS) OVER w, 0) AS notes, coalesce(last_value(e0 IGNORE NULLS) OVER w, 0) AS events
  FROM lyr WINDOW w AS (PARTITION BY doc_id ORDER BY line))""".replace("{{", "{").replace("}}", "}")


@query(
    "lyric_alignment",
    f"WITH {_BODY_SQL}, {_ALIGN_SQL} SELECT doc_id, line, tokens, notes, events, tokens IN (notes, events) AS ok, tokens = events AND tokens <> notes AS events_only FROM al WHERE kind = 'lyric'",
)
def lyric_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return tunes.lyric_alignment(_headers(spark, sf), "doc_id")


_SYNTAX_SQL = r"""syn AS (SELECT doc_id, unnest([r for r in [CASE WHEN meter = '' THEN 'no M header' END,
  CASE WHEN NOT starts_with(tune, '%abc') THEN 'first line is not the version mark' END,
  CASE WHEN regexp_matches(tune, '\+[a-z]+\+') THEN 'old decoration' END, CASE WHEN regexp_matches(tune, '(?m)^A:') THEN 'old area field' END,
  CASE WHEN regexp_matches(tune, '(?m)^Q:\s*\d+\s*$') THEN 'tempo without unit' END, CASE WHEN regexp_matches(tune, '\+[A-G][#b]?\+') THEN 'old chord' END,
  CASE WHEN (length(b) - length(replace(b, '"', ''))) % 2 = 1 THEN 'unpaired quote' END,
  CASE WHEN (length(b) - length(replace(b, '(', ''))) - len(regexp_extract_all(b, '\(\d')) <> length(b) - length(replace(b, ')', '')) THEN 'unbalanced slur' END] if r IS NOT NULL]) AS rule
  FROM heads JOIN (SELECT doc_id, string_agg(regexp_replace(body, '%.*$', ''), chr(10) ORDER BY line) AS b FROM all_lines WHERE NOT regexp_matches(body, '^[wW]:') GROUP BY doc_id) USING (doc_id))"""


@query("syntax_rules", f"WITH {_BODY_SQL}, {_SYNTAX_SQL} SELECT doc_id, rule FROM syn")
def syntax_rules(spark: SparkSession, sf: str) -> DataFrame:
    return tunes.syntax_rules(_headers(spark, sf), "doc_id")


_SHARPS = "CASE {k} WHEN 'C' THEN 0 WHEN 'G' THEN 1 WHEN 'Dm' THEN -1 WHEN 'Bb' THEN -2 WHEN 'F#' THEN 6 WHEN 'Am' THEN 0 WHEN 'Eb mix' THEN -4 ELSE 0 END"
_STEP = "CASE upper({l}) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END"


def _sig(k: str, letter: str) -> str:
    n = _SHARPS.format(k=k)
    return f"""CASE WHEN ({n}) > 0 AND instr('FCGDAEB', upper({letter})) <= ({n}) THEN 1 WHEN ({n}) < 0 AND instr('BEADGCF', upper({letter})) <= -({n}) THEN -1 ELSE 0 END"""


_ACC = "CASE acc WHEN '^' THEN 1 WHEN '=' THEN 0 WHEN '__' THEN -2 END"
_PITCH_SQL = f"""e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) AS seq FROM ev WHERE kind IN ('note', 'rest')),
pitch AS (SELECT doc_id, seq, CAST((CASE WHEN letter = lower(letter) THEN 6 ELSE 5 END + oct) * 12 + {_STEP.format(l='letter')}
  + coalesce(last_value({_ACC} IGNORE NULLS) OVER (PARTITION BY doc_id, seg, upper(letter) ORDER BY seq), {_sig('key_now', 'letter')}) AS BIGINT) AS pitch, key_text FROM e WHERE kind = 'note')"""


@query("pitch_events", f"WITH {_BODY_SQL}, {_PITCH_SQL} SELECT doc_id, seq, pitch FROM pitch")
def pitch_events(spark: SparkSession, sf: str) -> DataFrame:
    return tunes.pitch_events(tunes.tune_events(_tokens(spark, sf), "doc_id"), "doc_id")


_TONIC = "CASE key_text WHEN 'C' THEN 0 WHEN 'G' THEN 7 WHEN 'Dm' THEN 2 WHEN 'Bb' THEN 10 WHEN 'F#' THEN 6 WHEN 'Am' THEN 9 WHEN 'Eb mix' THEN 3 END"


@query(
    "pitch_profile",
    f"""WITH {_BODY_SQL}, {_PITCH_SQL}, lp AS (SELECT *, abs(pitch - lag(pitch) OVER (PARTITION BY doc_id ORDER BY seq)) AS leap, {_TONIC} AS tonic FROM pitch),
    s AS (SELECT doc_id, count(*) AS n, min(pitch) AS lo, max(pitch) AS hi, max(pitch) - min(pitch) AS ambitus, list_sort(list(pitch))[1 + count(*) // 2] AS median, coalesce(max(leap), 0) AS max_leap,
      CAST(count(*) FILTER (leap > 12) AS BIGINT) AS big_leaps, count(*) FILTER ((pitch - tonic + 120) % 12 NOT IN (0, 2, 4, 5, 7, 9, 11)) AS off, arg_max(pitch, seq) AS lastp, any_value(tonic) AS tonic FROM lp GROUP BY doc_id)
    SELECT doc_id, n, lo, hi, ambitus, median, max_leap, big_leaps, CASE WHEN tonic IS NOT NULL THEN round(off / n, 6) END AS off_ratio,
      CASE WHEN tonic IS NOT NULL THEN CAST(lastp % 12 AS BIGINT) END AS final_class, coalesce((lastp - tonic + 120) % 12 = 9, false) AS relative_minor,
      CAST((CASE WHEN ambitus > 17 THEN 1 ELSE 0 END) + (CASE WHEN median > 74 OR median < 55 THEN 1 ELSE 0 END) + (CASE WHEN big_leaps > 0 THEN 1 ELSE 0 END)
       + (CASE WHEN tonic IS NOT NULL AND off / n > 0.15 THEN 1 ELSE 0 END) + (CASE WHEN tonic IS NOT NULL AND (lastp - tonic + 120) % 12 NOT IN (0, 2, 4, 7, 9) THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM s""",
)
def pitch_profile(spark: SparkSession, sf: str) -> DataFrame:
    headers = _headers(spark, sf)
    pitches = tunes.pitch_events(tunes.tune_events(tunes.tune_tokens(headers, "doc_id"), "doc_id"), "doc_id")
    return tunes.pitch_profile(pitches, headers, "doc_id")


# rendering: header key and unit (1/8, so beats = length / 2), state per line
_LETTER = "CASE upper({l}) WHEN 'C' THEN 0 WHEN 'D' THEN 1 WHEN 'E' THEN 2 WHEN 'F' THEN 3 WHEN 'G' THEN 4 WHEN 'A' THEN 5 ELSE 6 END"
_RENDER_SQL = f"""rt AS (SELECT *, CASE WHEN kind IN ('note', 'rest') THEN 1 ELSE 0 END AS ev FROM parts0 WHERE key_text <> 'none' AND kind <> 'inline' AND kind <> 'other'),
rn AS (SELECT *, sum(ev) OVER (PARTITION BY doc_id, line ORDER BY pos) - max(CASE WHEN kind = 'tuplet' THEN nn END) OVER (PARTITION BY doc_id, line ORDER BY pos) AS since_l FROM
  (SELECT *, sum(ev) OVER (PARTITION BY doc_id, line ORDER BY pos) AS nn FROM rt)),
rp AS (SELECT *, (CASE WHEN letter = lower(letter) THEN 6 ELSE 5 END + oct) * 12 + {_STEP.format(l='letter')} + coalesce({_ACC}, {_sig('key_text', 'letter')}) - 60 - ({_TONIC}) AS delta,
  ({_LETTER.format(l='letter')} - {_LETTER.format(l='key_text[1]')} + 7) % 7 AS step FROM rn),
ra AS (SELECT *, (delta + 120) % 12 - [0, 2, 4, 5, 7, 9, 11][step + 1] AS alter0, (delta + 120) // 12 - 10 AS oct0 FROM rp),
rb AS (SELECT *, alter0 - 12 * (CASE WHEN alter0 > 6 THEN 1 WHEN alter0 < -6 THEN -1 ELSE 0 END) AS alt, oct0 + (CASE WHEN alter0 > 6 THEN 1 WHEN alter0 < -6 THEN -1 ELSE 0 END) AS oc FROM ra),
rendered AS (SELECT doc_id, line, string_agg(
  CASE WHEN kind = 'tuplet' THEN tok WHEN kind = 'bar' THEN replace(tok, ':', '')
  ELSE (CASE WHEN kind = 'rest' THEN '0' ELSE (CASE WHEN alt > 0 THEN repeat('#', CAST(alt AS INT)) ELSE repeat('b', CAST(-alt AS INT)) END) || (step + 1) || (CASE WHEN oc > 0 THEN repeat('''', CAST(oc AS INT)) ELSE repeat(',', CAST(-oc AS INT)) END) END)
    || CASE dur WHEN '2' THEN '' WHEN '' THEN '_' WHEN '3/2' THEN '_.' ELSE '__' END || CASE WHEN since_l = 3 THEN ')' ELSE '' END END, ' ' ORDER BY pos) AS rendered FROM rb GROUP BY doc_id, line)"""
_PARTS0 = r"""parts0 AS (SELECT *, regexp_extract(tok, '^(\^|__|=)', 1) AS acc, regexp_extract(tok, '([A-Ga-gz])', 1) AS letter, regexp_extract(tok, '[A-Ga-gz][,'']*(.*)$', 1) AS dur,
  length(tok) - length(replace(tok, '''', '')) - (length(tok) - length(replace(tok, ',', ''))) AS oct FROM typed)"""


@query("render_degrees", f"WITH {_BODY_SQL}, {_PARTS0}, {_RENDER_SQL} SELECT doc_id, line, md5(rendered) AS digest, CAST(length(rendered) AS BIGINT) AS n FROM rendered")
def render_degrees(spark: SparkSession, sf: str) -> DataFrame:
    r = tunes.render_degrees(_headers(spark, sf), "doc_id")
    return r.select("doc_id", "line", F.md5("rendered").alias("digest"), F.length("rendered").cast("bigint").alias("n"))


_TUNE_BARS_SQL = r"""tb AS (SELECT doc_id, [x for x in [regexp_replace(b, '^[ \]]+|[ \]]+$', '', 'g') for b in regexp_split_to_array(string_agg(rendered, ' ' ORDER BY line), '\|+:?|:\|')] if trim(x) <> ''] AS bars FROM rendered GROUP BY doc_id)"""


@query(
    "bars_of_tune",
    f"WITH {_BODY_SQL}, {_PARTS0}, {_RENDER_SQL}, {_TUNE_BARS_SQL} SELECT doc_id, CAST(len(bars) AS BIGINT) AS n_bars, md5(array_to_string(bars, ';')) AS digest FROM tb",
)
def bars_of_tune(spark: SparkSession, sf: str) -> DataFrame:
    b = tunes.bars_of_tune(tunes.render_degrees(_headers(spark, sf), "doc_id"), "doc_id")
    return b.select("doc_id", F.size("bars").cast("bigint").alias("n_bars"), F.md5(F.array_join("bars", ";")).alias("digest"))


@query(
    "read_back_pitches",
    f"""WITH {_BODY_SQL}, {_PARTS0}, {_RENDER_SQL}, x AS (SELECT doc_id, line, unnest([t for t in string_split(rendered, ' ') if regexp_matches(t, '^[#b]*[1-7]')]) AS t FROM rendered),
    y AS (SELECT doc_id, line, regexp_extract(t, '^([#b]*[1-7]['',]*)', 1) AS tok FROM x)
    SELECT doc_id, line, count(*) AS n, CAST(sum(v) AS BIGINT) AS pitches, max(v) AS top FROM (SELECT *, CAST([0, 2, 4, 5, 7, 9, 11][CAST(regexp_extract(tok, '([1-7])', 1) AS INT)]
      + length(tok) - length(replace(tok, '#', '')) - (length(tok) - length(replace(tok, 'b', ''))) + 12 * (length(tok) - length(replace(tok, '''', '')) - (length(tok) - length(replace(tok, ',', '')))) AS BIGINT) AS v FROM y) GROUP BY doc_id, line""",
)
def read_back_pitches(spark: SparkSession, sf: str) -> DataFrame:
    r = tunes.render_degrees(_headers(spark, sf), "doc_id")
    p = r.select("doc_id", "line", tunes.read_back_pitches(F.col("rendered")).alias("p")).where(F.size("p") > 0)
    values = F.transform("p", lambda x: x["pitch"])
    return p.select(
        "doc_id", "line", F.size("p").cast("bigint").alias("n"),
        F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("pitches"), F.array_max(values).alias("top"),
    )


@query(
    "corpus_quality_rollup",
    f"""WITH {_BODY_SQL}, {_BARS_SQL}, {_ALIGN_SQL}, {_SYNTAX_SQL},
    nb AS (SELECT doc_id, count(*) AS bars, count(*) FILTER (m > 2 AND bar > 1 AND bar < m AND NOT ok) AS bad FROM (SELECT *, max(bar) OVER (PARTITION BY doc_id) AS m FROM bars) GROUP BY doc_id),
    ly AS (SELECT doc_id, count(*) AS n, count(*) FILTER (tokens NOT IN (notes, events)) AS bad, count(*) FILTER (tokens = events AND tokens <> notes) AS eo FROM al WHERE kind = 'lyric' GROUP BY doc_id),
    sy AS (SELECT doc_id, count(*) AS n FROM syn GROUP BY doc_id),
    per AS (SELECT h.lang, coalesce(nb.bars, 0) AS bars, coalesce(nb.bad, 0) AS bad, coalesce(ly.n, 0) AS ln, coalesce(ly.bad, 0) AS lb, coalesce(eo, 0) AS eo, coalesce(sy.n, 0) AS sn
      FROM heads h LEFT JOIN nb USING (doc_id) LEFT JOIN ly USING (doc_id) LEFT JOIN sy USING (doc_id))
    SELECT lang, count(*) AS tunes, CAST(count(*) FILTER (bad + lb + sn = 0) AS BIGINT) AS clean, CAST(sum(bars) AS BIGINT) AS bars, CAST(sum(bars - bad) AS BIGINT) AS bars_passing, CAST(sum(ln) AS BIGINT) AS lyric_lines,
     CAST(sum(ln - lb) AS BIGINT) AS lyric_aligned, CAST(sum(eo) AS BIGINT) AS events_only, CAST(sum(sn) AS BIGINT) AS syntax, CAST(sum(bad + lb + sn) AS BIGINT) AS findings FROM per GROUP BY ROLLUP (lang)""",
)
def corpus_quality_rollup(spark: SparkSession, sf: str) -> DataFrame:
    spelled = stored_tunes(spark, sf)
    h = tunes.tune_headers(spelled, "doc_id", "tune")
    return tunes.corpus_quality_rollup(
        spelled.select("doc_id", "lang"),
        tunes.bar_totals(tunes.tune_tokens(h, "doc_id"), "doc_id"),
        tunes.lyric_alignment(h, "doc_id"),
        tunes.syntax_rules(h, "doc_id"),
        "doc_id",
        "lang",
    )


# lyrics

_W_SQL = r"""wl AS (SELECT doc_id, line, body, row_number() OVER (PARTITION BY doc_id, grp ORDER BY line) AS verse, grp FROM (
  SELECT doc_id, line, body, starts_with(body, 'w:') AS is_w, count(*) FILTER (NOT starts_with(body, 'w:') AND NOT regexp_matches(body, '^[A-Za-z]:')) OVER (PARTITION BY doc_id ORDER BY line) AS grp
  FROM all_lines WHERE body <> '' AND NOT starts_with(body, '%')) WHERE is_w)"""


@query(
    "repair_from_evidence",
    rf"""WITH {_BODY_SQL}, {_W_SQL}, tk AS (SELECT doc_id, verse, line, pos - 1 AS position, ts[pos] AS token FROM (SELECT *, unnest(range(2, len(ts) + 1)) AS pos FROM (SELECT *, regexp_split_to_array(body, '\s+') AS ts FROM wl))),
    s AS (SELECT *, lag(token) OVER (PARTITION BY doc_id, verse ORDER BY line, position) AS prev FROM tk WHERE regexp_matches(token, '\p{{L}}'))
    SELECT doc_id, line, position, token, lower(substr(token, 1, 1)) || substr(token, 2) AS repaired FROM s
    WHERE ends_with(prev, '-') AND regexp_matches(token, '^\p{{Lu}}') AND len([f for f in ['the', 'eaudie', 'und', 'ise', 'ones'] if starts_with(f, lower(regexp_replace(regexp_replace(token, '-+$', ''), '[,.!?]+$', '')))]) > 0""",
)
def repair_from_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return lyrics.repair_from_evidence(stored_tunes(spark, sf), "doc_id", "tune", ["The", "Eaudie", "Und", "Ise", "Ones"])


@query(
    "self_contradiction_join",
    rf"""WITH {_BODY_SQL}, sy AS (SELECT doc_id, line, pos - 1 AS pos, ts[pos] AS token FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS pos FROM (
      SELECT doc_id, line, [t for t in regexp_split_to_array(substr(body, 3), '[\s|]+') if t <> ''] AS ts FROM all_lines WHERE starts_with(body, 'w:')))),
    pr AS MATERIALIZED (SELECT *, lead(token) OVER (PARTITION BY doc_id, line ORDER BY pos) AS nxt FROM sy),
    wit AS MATERIALIZED (SELECT DISTINCT doc_id, lower(regexp_replace(token, '-$', '')) AS a, lower(regexp_replace(nxt, '-+$', '')) AS b FROM pr WHERE ends_with(token, '-') AND nxt IS NOT NULL
      AND regexp_replace(token, '-$', '') NOT IN ('', '_', '*', '|', '-') AND regexp_replace(nxt, '-+$', '') NOT IN ('', '_', '*', '|', '-'))
    SELECT pr.doc_id, line, pos, token, nxt AS next, token || '- ' || nxt AS joined FROM pr JOIN wit ON wit.doc_id = pr.doc_id AND a = lower(token) AND b = lower(regexp_replace(nxt, '-+$', ''))
    WHERE NOT ends_with(token, '-') AND NOT contains(token, '\-') AND token NOT IN ('_', '*', '|', '-') AND regexp_replace(nxt, '-+$', '') NOT IN ('_', '*', '|', '-') AND NOT regexp_matches(nxt, '^\p{{Lu}}')""",
)
def self_contradiction_join(spark: SparkSession, sf: str) -> DataFrame:
    return lyrics.self_contradiction_join(stored_tunes(spark, sf), "doc_id", "tune")


@query(
    "assemble_verses",
    rf"""WITH {_BODY_SQL}, {_W_SQL}, dp AS (SELECT doc_id, max(verse) AS depth FROM wl GROUP BY doc_id),
    sp AS (SELECT doc_id, grp, body, unnest(CASE WHEN size = 1 THEN range(1, depth + 1) ELSE [verse] END) AS verse FROM (SELECT *, max(verse) OVER (PARTITION BY doc_id, grp) AS size FROM wl) JOIN dp USING (doc_id)),
    rw AS (SELECT doc_id, grp, verse, pos, replace(ts[pos], '|', '') AS raw FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS pos FROM (SELECT *, regexp_split_to_array(substr(body, 3), '\s+') AS ts FROM sp))),
    t0 AS (SELECT *, ends_with(replace(raw, '\-', chr(1)), '-') AS cont, replace(replace(replace(raw, '\-', chr(1)), '~', ' '), '-', '') AS tok FROM rw WHERE raw <> '' AND NOT regexp_matches(raw, '^[_*]+$')),
    tk AS (SELECT * REPLACE (cont OR coalesce(lead(tok = '' AND cont) OVER (PARTITION BY doc_id, verse ORDER BY grp, pos), false) AS cont) FROM t0),
    st AS (SELECT *, sum(CASE WHEN pc THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, verse ORDER BY grp, pos) AS word FROM (SELECT *, coalesce(lag(cont) OVER (PARTITION BY doc_id, verse ORDER BY grp, pos), false) AS pc FROM tk)),
    wd AS (SELECT doc_id, verse, word, replace(string_agg(tok, '' ORDER BY grp, pos), chr(1), '-') AS body, arg_max(grp * 2 + CASE WHEN cont THEN 1 ELSE 0 END, grp * 100000 + pos) AS place FROM st GROUP BY doc_id, verse, word),
    ln AS (SELECT doc_id, verse, place, string_agg(body, ' ' ORDER BY word) AS body FROM wd WHERE body <> '' GROUP BY doc_id, verse, place),
    pz AS (SELECT l.doc_id, line, trim(substr(body, 3)) AS body FROM all_lines l WHERE starts_with(body, 'W:') AND trim(substr(body, 3)) NOT IN ('', '-'))
    SELECT doc_id, verse, row_number() OVER (PARTITION BY doc_id, verse ORDER BY place) AS line, md5(body) AS digest FROM ln
    UNION ALL SELECT pz.doc_id, coalesce(depth, 0) + row_number() OVER (PARTITION BY pz.doc_id ORDER BY line), 1, md5(body) FROM pz LEFT JOIN dp USING (doc_id)""",
)
def assemble_verses(spark: SparkSession, sf: str) -> DataFrame:
    v = lyrics.assemble_verses(stored_tunes(spark, sf), "doc_id", "tune")
    return v.select("doc_id", "verse", "line", F.md5("body").alias("digest"))
