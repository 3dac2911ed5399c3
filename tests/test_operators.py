"""Distributed ranks, samples and choices against their plain definitions."""

import hashlib
import random
import sys
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.functions.hashing import seeded_key
from tallywright.functions.reply import token_f1_arrays
from tallywright.functions.text import contains_whole_word, fold_accents, norm_answer
from tallywright.operators import audit, choice_items, choices, generation, ranking, sampling, scoring


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, one NULL group, ids with gaps."""
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("g"), F.col("id") % 5)
    )
    return spark.range(3000).select((F.col("id") * F.col("id") % 100003).alias("k"), g.alias("g")).dropDuplicates(["k"])


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_seeded_rank_equals_window(skewed):
    plain = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(seeded_key(5, F.col("k")), "k")))
    ranked = ranking.seeded_rank(skewed.repartition(7), ["g"], ["k"], 5, total="n", digits=2)
    as_key = lambda d: sorted((r.k, r.rn) for r in d.select("k", "rn").collect())
    assert as_key(ranked) == as_key(plain)
    sizes = Counter(r.g for r in skewed.collect())
    assert all(sizes[r.g] == r.n for r in ranked.collect())


def test_ordered_rank_and_previous_row_equal_windows(skewed):
    w = Window.partitionBy("g").orderBy("k")
    plain = skewed.withColumn("rn", F.row_number().over(w)).withColumn("prev_k", F.lag("k").over(w))
    key = lambda d, c: {(r.k, r[c]) for r in d.select("k", c).collect()}
    assert key(ranking.ordered_rank(skewed, ["g"], "k", buckets=13), "rn") == key(plain, "rn")
    assert key(ranking.previous_row(skewed, ["g"], "k", ["k"], buckets=64), "prev_k") == key(plain, "prev_k")


@pytest.mark.parametrize("supply,target", [([900, 60, 5], 300), ([900, 60, 5], 2000), ([7, 7, 7, 7], 30), ([1, 2, 3, 50], 20), ([10, 10, 11], 29), ([5], 3)])
def test_waterfill(spark, supply, target):
    data = [(f"c{i}", j) for i, n in enumerate(supply) for j in range(n)]
    got = {r.c: r.seats for r in sampling.waterfill(spark.createDataFrame(data, "c string, k int"), "c", target).collect()}
    left, want = target, {}
    order = sorted((n, f"c{i}") for i, n in enumerate(supply))
    for i, (n, c) in enumerate(order):
        want[c] = min(n, left // (len(order) - i))
        left -= want[c]
    assert got == want
    if supply == [900, 60, 5]:
        assert sum(got.values()) == min(target, 965)


def test_largest_remainder_total(skewed):
    seats = sampling.largest_remainder(skewed, ["g"], 101).collect()
    assert sum(r.seats for r in seats) == 101
    n = sum(r.supply for r in seats)
    assert all(abs(r.seats - 101 * r.supply / n) < 1 for r in seats)
    everyone = sampling.largest_remainder_sample(skewed, ["g"], ["k"], 10**6, 1)
    assert everyone.count() == n


def test_split_ignores_partitioning(skewed):
    a = sampling.stratified_split(skewed, ["g"], ["k"], 70, 107, 3)
    b = sampling.stratified_split(skewed.repartition(11), ["g"], ["k"], 70, 107, 3)
    assert {(r.k, r.side) for r in a.collect()} == {(r.k, r.side) for r in b.collect()}
    for r in sampling.split_report(a, ["g"]).where("n_train + n_test = n").collect():
        if r.g is not None:
            assert r.n_train == round(r.n * 70 / 107)


def test_frozen_split_refuses_another(skewed):
    a = sampling.stratified_split(skewed, ["g"], ["k"], 70, 107, 3)
    b = sampling.stratified_split(skewed, ["g"], ["k"], 70, 107, 4)
    assert sampling.frozen_split_guard(a, a, "k").count() == a.count()
    with pytest.raises(Exception, match="frozen split"):
        sampling.frozen_split_guard(a, b, "k").collect()


def test_first_of_group_and_clashes(spark):
    df = spark.createDataFrame([(1, "q", "a"), (2, "q", "a"), (3, "q", "b"), (4, "r", "c")], "i int, question string, answer string")
    assert rows(sampling.dedupe_items(df, ["i"]), "i") == [(1,), (3,), (4,)]
    assert rows(sampling.drop_clashing(df), "i") == [(4,)]


@pytest.mark.parametrize("k", [1, 3, 4])
def test_other_values(spark, k):
    items = spark.range(400).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 6)).alias("v"))
    got = choices.pick_other_values(items, ["id"], [], "v", items, k, "s").collect()
    assert len(got) == 400
    for r in got:
        assert len(set(r.others)) == k and r.v not in r.others
    thin = choices.pick_other_values(items, ["id"], [], "v", items, 9, "s")
    assert thin.count() == 0
    some = choices.pick_other_values(items, ["id"], [], "v", items, 9, "s", at_most=True).collect()
    assert all(len(set(r.others)) == len(r.others) == 4 for r in some)


def test_rivals_never_share_the_value(spark):
    recs = spark.range(300).select(
        F.col("id"), (F.col("id") % 2).cast("string").alias("t"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("v"), F.concat(F.lit("n"), "id").alias("name"),
    )
    facts = {f"n{r.id}": (r.t, r.v) for r in recs.collect()}
    got = choices.pick_rivals_without_value(recs, "id", "t", "v", "name", 4, "s").collect()
    assert len(got) == 300
    for r in got:
        assert len(set(r.others)) == 4
        assert all(facts[o][0] == r.t and facts[o][1] != r.v for o in r.others)


def test_tiers_take_the_tightest_that_fits(spark):
    recs = spark.range(200).select(F.col("id"), (F.col("id") % 20).alias("a"), F.when(F.col("id") < 6, 0).otherwise(F.col("id")).alias("b"), F.concat(F.lit("n"), "id").alias("name"))
    tiers = [("ab", ["a", "b"]), ("a", ["a"]), ("any", [])]
    got = choices.tiered_distractors(recs, "id", "name", tiers, 4, "s").collect()
    facts = {f"n{r.id}": r for r in recs.collect()}
    assert len(got) == 200 and {r.level for r in got} == {"a"}
    for r in got:
        assert f"n{r.id}" not in r.others and len(set(r.others)) == 4
        assert all(facts[o].a == facts[f"n{r.id}"].a for o in r.others)
    loose = choices.tiered_distractors(recs, "id", "name", tiers, 12, "s").collect()
    assert {r.level for r in loose} == {"any"}


def test_order_alarm(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "ord int, s string")
    make = lambda s: spark.createDataFrame(list(enumerate(s)), "ord int, s string")
    alarm = lambda s: scoring.order_alarm(make(s), keys, ["s"], "ord").first().alarm
    assert alarm("aabc") is False
    assert alarm("abac") is True
    assert alarm("aab") is False


def test_position_matching_clamps(spark):
    keys = spark.createDataFrame([(1, "a", "k1"), (5, "a", "k2"), (2, "b", "k3")], "ord int, s string, gold string")
    preds = spark.createDataFrame([(1, "a", "p1"), (2, "a", "p2"), (3, "a", "p3"), (4, "b", "p4"), (9, "c", "p5")], "ord int, s string, said string")
    got = rows(scoring.match_by_position(preds, keys, ["s"], "ord"), "said", "gold")
    assert got == [("p1", "k1"), ("p2", "k2"), ("p3", "k2"), ("p4", "k3")]


def test_contamination_never_pairs(spark):
    docs = spark.createDataFrame([(1, list("abcdefgh")), (2, list("xyzabcde")), (3, list("qqqq"))], "d int, ws array<string>")
    items = spark.createDataFrame([(7, list("abcde")), (8, list("zzzzz"))], "i int, ws array<string>")
    assert rows(audit.contaminated_documents(docs, "d", items, "i", "ws", 4), "d", "n_shared") == [(1, 2), (2, 2)]
    assert rows(audit.contaminated_items(docs, "d", items, "i", "ws", 4), "i", "n_grams", "n_found") == [(7, 2, 2), (8, 1, 0)]


def test_folding(spark):
    text = "Élan ﬁn naïve Ω ½ ＡＢ é don't well-known a/b #c!"
    r = spark.createDataFrame([(text,)], "t string").select(fold_accents(F.col("t")).alias("f"), norm_answer(F.col("t")).alias("n")).first()
    assert r.f == "Elan fin naive Ω 1⁄2 AB e don't well-known a/b #c!"
    assert r.n == "elan fin naive ω 1 2 ab e don t well known a/b #c"


def test_blank_facts_become_refusals(spark):
    recs = spark.createDataFrame([(1, "X", "Ann", "C"), (2, "Y", " – ", "")], "id int, name string, composer string, tempo string")
    facts = [generation.Fact("composer", "composer", "No composer is given for {name}."), generation.Fact("tempo", "tempo")]
    t = {"composer": ["Who wrote {name}?", "Name who wrote {name}."], "tempo": ["How fast is {name}?"]}
    got = rows(generation.fact_items(recs, "id", "name", facts, t, "train"), "record", "category", "question", "answer")
    assert got == [
        (1, "composer", "Name who wrote X.", "Ann"), (1, "composer", "Who wrote X?", "Ann"), (1, "tempo", "How fast is X?", "C"),
        (2, "composer_abstain", "Name who wrote Y.", "No composer is given for Y."), (2, "composer_abstain", "Who wrote Y?", "No composer is given for Y."),
    ]


def test_reserved_content_is_kept_out(spark):
    item = lambda i, q, a, u: (i, "next_line", q, a, "printed", u)
    fam = spark.createDataFrame(
        [item(1, "q1", "a1", "u1"), item(2, "q2", "a2", None), item(3, "the word here", "word", "u3"), item(4, "q4", " ", "u4"), item(5, "q5", "a5", "u5")],
        "record int, category string, question string, answer string, key_source string, unit string",
    )
    reserved = spark.createDataFrame([("u1",)], "unit string")
    assert rows(generation.assemble_side([fam], reserved), "record") == [(2,), (5,)]


def test_strides_never_repeat(spark):
    ms = spark.range(600).select(F.col("id"), (4 + F.col("id") % 12).alias("m"))
    got = choices.with_offsets(ms, "s", ["id"], F.col("m"), 4).groupBy("id", "m").agg(F.collect_set("o").alias("o")).collect()
    assert len(got) == 600
    assert all(len(r.o) == 4 and 0 <= min(r.o) and max(r.o) < r.m for r in got)


def test_folding_of_every_character(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    texts = ["".join(map(chr, points[i : i + 2000])) for i in range(0, len(points), 2000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fold_accents(F.col("t")).alias("f")).collect()
    for r in got:
        want = "".join(c for c in unicodedata.normalize("NFKD", texts[r.i]) if not unicodedata.combining(c))
        assert r.f == want, hex(ord(texts[r.i][0]))


def test_folding_beyond_the_basic_plane(spark):
    r = spark.createDataFrame([("𝐀 한글 값 𝒞 😀 ｶﾞ",)], "t string").select(fold_accents(F.col("t")).alias("f")).first()
    assert r.f == "".join(c for c in unicodedata.normalize("NFKD", "𝐀 한글 값 𝒞 😀 ｶﾞ") if not unicodedata.combining(c)) and r.f.startswith("A ")


def test_range_buckets_are_even(spark):
    """One outlier, a long common prefix and a hot value change nothing."""
    n = 40_000
    shapes = {
        "outlier": F.when(F.col("id") == 7, F.lit(1 << 60)).otherwise(F.col("id") * 3),
        "prefix": F.concat(F.lit("the same first words of all: "), F.format_string("%012d", F.col("id") * F.col("id"))),
        "hot": F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")),
    }
    df = spark.range(n).select("id", *[c.alias(name) for name, c in shapes.items()])
    for name in shapes:
        placed = ranking.range_bucket(df, [name, "id"], buckets=1024, out="b").cache()
        sizes = placed.groupBy("b").count().agg(F.max("count")).first()[0]
        assert sizes < n / 50, (name, sizes)
        window = Window.orderBy(name, "id")
        assert placed.withColumn("before", F.lag("b").over(window)).where("b < before").count() == 0
    assert ranking.range_bucket(df.where("id < 0"), ["id"]).count() == 0
    texts = df.select(F.col("prefix").alias("k")).limit(3000)
    assert ranking.ordered_rank(texts, [], "k", buckets=64).withColumn("w", F.row_number().over(Window.orderBy("k"))).where("rn <> w").count() == 0


def test_carving_by_selection(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100003).alias("k"))
    rank = F.row_number().over(Window.orderBy(seeded_key(13, F.col("k")), "k"))
    for percent in (0, 5, 100):
        got = sampling.carve_validation(df, ["k"], 13, percent)
        held = max(1, 5000 * percent // 100)
        assert got.withColumn("rn", rank).where((F.col("part") == "validation") != (F.col("rn") <= held)).count() == 0
        assert sampling.carve_validation(df, ["k"], 13, percent, digits=1).exceptAll(got).count() == 0
    assert rows(sampling.carve_validation(df.limit(1), ["k"], 13), "part") == [("validation",)]
    assert sampling.carve_validation(df.where("k < 0"), ["k"], 13).count() == 0


def test_whole_words_without_patterns(spark):
    cases = [
        ("a c# b", "c#", True), ("xc#", "c#", False), ("a #c", "#c", True), ("a#c", "#c", False), ("one/two", "two", True), ("onetwo", "two", False),
        ("two", "two", True), ("a.b", "a.b", True), ("a.bc", "a.b", False), ("(x)", "(x)", True), ("a \\Eb c", "\\Eb", True), ("ab", "", False), ("", "", True), ("naïve x", "na", False),
    ]
    df = spark.createDataFrame(cases, "hay string, needle string, want boolean")
    got = df.where(contains_whole_word(F.col("hay"), F.col("needle")) != F.col("want")).collect()
    assert got == []


def test_token_overlap(spark):
    rng = random.Random(3)
    data = [([rng.choice("abcdef") for _ in range(rng.randrange(30))], [rng.choice("abcxyz") for _ in range(rng.randrange(30))]) for _ in range(200)] + [(["a"] * 5000, ["a"] * 4000)]
    got = spark.createDataFrame(data, "p array<string>, g array<string>").select("p", "g", token_f1_arrays(F.col("p"), F.col("g")).alias("f")).collect()
    for r in got:
        common = sum((Counter(r.p) & Counter(r.g)).values())
        want = float(len(r.p) == len(r.g)) if not r.p or not r.g else 2 * common / (len(r.p) + len(r.g))
        assert r.f == pytest.approx(want)


def test_distractors_that_read_alike(spark):
    names = ["Song One", "song  one!", "SONG ONE", "Two", "Three", "Four", "Five"]
    recs = spark.createDataFrame([(i, n, "g") for i, n in enumerate(names)], "id int, name string, g string")
    got = choices.tiered_distractors(recs, "id", "name", [("group", ["g"]), ("any", [])], 4, "s").collect()
    assert len(got) == 7
    for r in got:
        like = ["".join(c for c in n.lower() if c.isalpha()) for n in r.others]
        assert len(set(like)) == 4 and "".join(c for c in names[r.id].lower() if c.isalpha()) not in like


def test_what_is_exploded_from_a_file_is_not_broadcast(spark):
    """Spark takes these rows for as large as the range they come from, which is below any threshold."""
    rows = spark.range(40).select(F.col("id").alias("record"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("category"))
    facts = rows.withColumn("answer", F.concat("category", (F.col("record") % 9).cast("string")))
    picked = choices.pick_other_values(facts, ["record", "category"], ["category"], "answer", facts, 4, "s")
    joins = [x for x in picked._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    # bucket totals may be: a row per bucket and category
    assert not [x for x in joins if "record#" in x.split("Inner")[0] or "answer#" in x.split("Inner")[0]]
    assert picked.count() == 80


def test_replies_are_not_broadcast_and_read_once(spark):
    preds = spark.range(40).select(
        F.col("id").alias("k"), F.lit("c").alias("category"), F.concat(F.lit("say X"), F.col("id") % 3, F.lit(" now")).alias("p"), F.lit("x0").alias("g")
    ).withColumn("p", F.lower("p"))
    rivals = spark.range(3).select(F.lit("c").alias("category"), F.concat(F.lit("x"), F.col("id")).alias("rival"))
    hits = scoring.rival_hits(preds, ["k"], rivals)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin [category" in x and "BuildLeft" in x]
    # the reply is spelled in one place, not again in the filter on its n-grams
    assert max(x.count("lower(concat(say X") for x in plan.splitlines()) <= 2
    assert {r.k: r.names_rival for r in hits.collect()} == {k: k % 3 != 0 for k in range(40)}


def test_a_cloze_draws_from_the_whole_record(spark):
    words = [f"word{i:03}" for i in range(200)]
    lines = [" ".join(words[i : i + 5]) for i in range(0, 200, 5)]
    df = spark.createDataFrame([(1, "One", lines)], "id int, name string, ls array<string>")
    got = choice_items.cloze_mc(df, "id", "name", "ls", "{name}: {line}", None, "c").collect()
    assert len(got) == len(lines)
    digest = lambda r, w: hashlib.md5(f"c|1|{r.uid.split('-')[-1]}|{w}".encode()).hexdigest()
    for r in got:
        assert r.others == sorted((w for w in words if w != r.answer), key=lambda w: digest(r, w))[:4]


def test_placed_items_are_written_once(spark, tmp_path):
    """Queries that read choice items several times find a table, not the ranks and lookups behind them."""
    from tallywright.plans.choice_queries import mc_items

    rows = [(i, f"part {i}", f"KIND {i % 7}", f"Brand#{i % 9}", 1 + i % 12) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    items = mc_items(spark, str(tmp_path))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Window", "Aggregate", "Join"))
    assert items.where("not exists(map_values(options), v -> v = element_at(options, key))").count() == 0 and items.count() > 80


def test_drawn_keys_name_the_rows_of_the_draw(spark):
    cols = ["record", "category", "question", "answer", "unit"]
    data = [(r, "ab"[r % 2], f"q{r % 7}", f"a{r % 3}", f"u{r}") for r in range(60)] + [(3, "b", "q3", "a0", "t"), (None, "a", None, "x", "n"), (61, "a", None, "y", "n")]
    items = spark.createDataFrame(data, "record long, category string, question string, answer string, unit string").repartition(3)
    whole = sampling.equal_quota_sample(
        sampling.first_of_group(items, ["question", "answer"], ["record", "category", "unit"]), "category", ["record", "question", "answer"], 4, "s"
    )
    drawn = sampling.drawn_keys(items, "record", "category", 4, "s")
    assert drawn.columns == ["pair", "record", "category"]  # no text
    keyed = whole.withColumn("pair", sampling.pair_key(F.col("question"), F.col("answer"))).select("pair", "record", "category")
    got, want = ({(bytes(r.pair), r.record, r.category) for r in d.collect()} for d in (drawn, keyed))
    assert got == want and len(got) == 8
    assert whole.columns == cols


def test_drawn_keys_where_most_rows_come_second(spark):
    # the first rows of category b by digest are copies whose first stands in category a
    rows = [(0, "a", f"q{k}", "x", "u") for k in range(40)] + [(r, "b", f"q{r % 40}", "x", "u") for r in range(1, 400)] + [(500 + r, "b", f"p{r}", "x", "u") for r in range(3)]
    items = spark.createDataFrame(rows, "record long, category string, question string, answer string, unit string").repartition(3)
    got = {(r.record, r.category) for r in sampling.drawn_keys(items, "record", "category", 2, "s").collect()}
    whole = sampling.equal_quota_sample(
        sampling.first_of_group(items, ["question", "answer"], ["record", "category", "unit"]), "category", ["record", "question", "answer"], 2, "s"
    )
    assert got == {(r.record, r.category) for r in whole.collect()} and len({r for r in got if r[1] == "b"}) == 2


def test_the_draw_shuffles_no_text(spark, capsys):
    items = spark.createDataFrame([(1, "a", "q", "x", "u")], "record long, category string, question string, answer string, unit string")
    sampling.drawn_keys(items, "record", "category", 2, "s").explain("formatted")
    assert "question" not in capsys.readouterr().out
