"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line (lower case, one space for white space, 0 for digits) that stands in at least `least` different texts of a host
and in `share` of the host's documents, or in `many` of them on however large a host, is taken for furniture. Its words
don't count; a document that keeps less than `remain` of its words is depleted and rejected, as is one that fails the base
rules. Copies are one text here, so a document isn't depleted by its own copies; documents are told apart by key and text. Lines travel as 64-bit hashes; for judge(), texts don't travel at
all. clean() returns the texts without these lines, from the same removals that judge() counts.

Null and empty texts have no words and fail the base rules. A null host is a host of its own. Rows with a null or
repeated key have results of their own. An empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.session import materialise

WHITE = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words_of(text: Column) -> Column:
    body = trimmed(text)
    return F.when(F.length(body) > 0, F.split(body, WHITE + "+")).otherwise(F.array().cast("array<string>"))


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.length(trimmed(line)) > 0)


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(trimmed(line), WHITE + "+", " ")), "[0-9]", "0")


def base_features(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """id, host, body (hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(text, F.lit("")).alias("text")
    )
    cut = rows.select("id", "host", F.xxhash64("text").alias("body"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), words_of(F.col("text")).alias("words"), worded_lines(F.col("text")).alias("lines"))
    counted = cut.select(
        "id", "host", "body", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    span = F.size("hashes") - (WINDOW - 1)
    tuples = F.arrays_zip(*[F.slice("hashes", k + 1, span).alias(f"w{k}") for k in range(WINDOW)])
    windows = F.when(span > 1, F.transform(tuples, lambda t: F.xxhash64(t)))
    held = counted.withColumn("windows", windows).drop("hashes")
    # only texts with an equal pair of windows go on; equal windows are neighbours once sorted
    ranked = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
    )
    placed = held.withColumn("ranked", ranked).drop("windows")
    twice = F.transform(
        "ranked",
        lambda r, k: F.when((r["w"] == F.get(F.col("ranked"), k - 1)["w"]) | (r["w"] == F.get(F.col("ranked"), k + 1)["w"]), r["i"]),
    )
    starts = placed.withColumn("starts", F.sort_array(F.filter(twice, lambda i: i.isNotNull()))).drop("ranked")
    fresh = F.transform("starts", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), k + 1) - i, F.lit(WINDOW))))
    repeat = F.coalesce(F.aggregate(fresh, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return starts.withColumn("n_repeat_words", repeat).drop("starts")


def frequent_lines(lines: DataFrame, hosts: DataFrame, least: int, share: float, many: int) -> DataFrame:
    """host, line: lines above the limits. hosts: host and number of documents."""
    per_text = lines.select("host", "line", "body", "id").distinct().groupBy("host", "line", "body").agg(F.count("*").alias("n"))
    spread = per_text.groupBy("host", "line").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_docs")).where(F.col("n_texts") >= least)
    often = (F.col("n_docs") >= share * F.col("host_docs")) | (F.col("n_docs") >= many)
    return spread.join(hosts, "host").where(often).select("host", "line")


def own_rows(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(text, F.lit("")).alias("text"))


def removals(docs: DataFrame, key: str, text: str, host: str, least: int, share: float, many: int) -> DataFrame:
    """gid, ghost, gbody (hash of the text), removed_words and places of the frequent lines among the lines with words, of the texts that have any."""
    cut = own_rows(docs, key, text, host).select("id", "host", F.xxhash64("text").alias("body"), F.posexplode(worded_lines(F.col("text"))).alias("pos", "raw"))
    lines = materialise(
        cut.select("id", "host", "body", "pos", F.xxhash64(normal_line(F.col("raw"))).alias("line"), F.size(words_of(F.col("raw"))).alias("n")), "lines"
    )
    hosts = lines.select("host", "body", "id").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    often = materialise(frequent_lines(lines, hosts, least, share, many), "often")
    # rows that are equal in key and text share one entry here, and repeated lines of a text count each time
    gone = lines.join(often, ["host", "line"]).select("id", "host", "body", "pos", "n").distinct()
    gone = gone.groupBy("id", "host", "body").agg(F.sum("n").alias("removed_words"), F.collect_list("pos").alias("places"))
    return materialise(gone.select(F.col("id").alias("gid"), F.col("host").alias("ghost"), F.col("body").alias("gbody"), "removed_words", "places"), "gone")


def same_text() -> Column:
    return F.col("id").eqNullSafe(F.col("gid")) & (F.col("host") == F.col("ghost")) & (F.col("body") == F.col("gbody"))


def without_lines(rows: DataFrame) -> DataFrame:
    """rows with the text without those of its lines with words that stand at `places`, the others in order."""
    split = rows.withColumn("parts", F.split("text", "\n"))
    worded = F.filter(F.transform("parts", lambda line, i: F.when(F.length(trimmed(line)) > 0, i)), lambda i: i.isNotNull())
    held = split.withColumn("worded", worded)
    out = held.withColumn("out", F.transform("places", lambda p: F.get(F.col("worded"), p)))
    left = out.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("out")))
    return left.withColumn("text", F.array_join(F.transform("left", lambda i: F.get(F.col("parts"), i)), "\n"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least: int = 20, share: float = 0.02, many: int = 500) -> DataFrame:
    """key and the text without its frequent lines; one row per row of docs, null texts stay null."""
    gone = removals(docs, key, text, host, least, share, many)
    none = docs.where(F.col(text).isNull()).select(F.col(key).alias("id"), F.lit(None).cast("string").alias("text"))
    some = own_rows(docs.where(F.col(text).isNotNull()), key, text, host).withColumn("body", F.xxhash64("text"))
    # texts with nothing to remove keep their bytes
    made = without_lines(some.join(gone, same_text(), "left").withColumn("whole", F.when(F.col("places").isNull(), F.col("text"))))
    out = made.select("id", F.coalesce("whole", "text").alias("text")).unionByName(none)
    return out.select(F.col("id").alias(key), F.col("text").alias(text))


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least: int = 20, share: float = 0.02, remain: float = 0.2, many: int = 500
) -> DataFrame:
    """key, the five base numbers, base_failed, removed_words and kept; one row per row of docs."""
    lost = removals(docs, key, text, host, least, share, many).drop("places")
    base = base_features(docs, key, text, host)
    out = base.join(lost, same_text(), "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < remain * F.col("n_words")
    return out.select(
        F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words"
    )


def oracle(least: int = 20, share: str = "0.02", remain: str = "0.2", many: int = 500) -> str:
    """DuckDB SQL for judge() over documents, with lines and windows as text."""
    white = r"[\x20\x09-\x0D]"
    trim = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, [x FOR x IN regexp_split_to_array(text, '{white}+') IF x <> ''] AS words,
        [x FOR x IN string_split(text, chr(10)) IF {trim.format("x")} <> ''] AS lines FROM d),
grams AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) > 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
split AS (SELECT doc_id, host, text, unnest(lines) AS raw FROM w),
norm AS (SELECT doc_id, host, text, regexp_replace(lower(regexp_replace({trim.format("raw")}, '{white}+', ' ', 'g')), '[0-9]', '0', 'g') AS line,
        len([x FOR x IN regexp_split_to_array(raw, '{white}+') IF x <> '']) AS n FROM split),
hosts AS (SELECT host, count(DISTINCT (doc_id, text)) AS host_docs FROM norm GROUP BY host),
often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS c, count(DISTINCT (doc_id, text)) AS n FROM norm GROUP BY host, line) JOIN hosts USING (host)
        WHERE c >= {least} AND (n >= {share} * host_docs OR n >= {many})),
gone AS (SELECT doc_id, sum(n) AS n FROM norm JOIN often USING (host, line) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
      FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - removed_words < {remain} * n_words) AS kept, removed_words FROM b"""
