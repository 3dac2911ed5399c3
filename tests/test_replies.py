"""Golden replies: what a scorer must read out of free text."""

import difflib

import pytest
from pyspark.sql import functions as F

from tallywright.functions import reply
from tallywright.operators import pairs, scoring

# category, gold, reply, expected, why
FREE_FORM = [
    ("pencipta", "Ismail Marzuki", "Ismail Marzuki", True, "bare"),
    ("pencipta", "Ismail Marzuki", "Lagu itu ciptaan ISMAIL MARZUKI.", True, "wrapped"),
    ("pencipta", "Ismail Marzuki", "Ismail Marzuki atau L. Manik", False, "a rival is named as well"),
    ("pencipta", "Ismail Marzuki", "L. Manik", False, "rival alone"),
    ("pencipta", "Ismail Marzuki", "<think>L. Manik? no</think> Ismail Marzuki", True, "rival only in the reasoning"),
    ("pencipta", "Ismail Marzuki", "<think>Ismail Marzuki", False, "the block never closes"),
    ("judul", "Desaku Yang Kucinta", "Desaku Yang Kucinta", True, "a shorter rival is part of the key"),
    ("judul", "Desaku", "Desaku Yang Kucinta", False, "a longer rival is named"),
    ("judul", "Bhinneka Tunggal Ika", "Judulnya Bhineka Tunggal Ika", True, "second spelling"),
    ("judul", "Bhinneka Tunggal Ika", "Bhinneka Tunggal", False, "cut short"),
    ("nada_dasar", "Do = C", "C Mayor", True, "another way to write a key"),
    ("nada_dasar", "Do = C", "Nada dasarnya C.", True, "named by its label"),
    ("nada_dasar", "Do = C", "c", True, "bare letter"),
    ("nada_dasar", "Do = C", "C Mayor atau G Mayor", False, "two keys"),
    ("nada_dasar", "Do = C", "Do = D", False, "wrong key"),
    ("hitung_bar", "4", "Ada 4 bar", True, "first number"),
    ("hitung_bar", "4", "bar 1, bar 2, jadi 4", True, "last number"),
    ("hitung_bar", "4", "1, 4, 9", False, "neither first nor last"),
    ("hitung_bar", "1200", "1,200 bar", True, "thousands mark"),
    ("hitung_bar", "4", "tidak tahu", False, "no number"),
    ("verifikasi_asal", "Benar. Lagu X dari Y.", "Benar", True, "agrees"),
    ("verifikasi_asal", "Salah. Bukan Y.", "Itu tidak benar", True, "negated agreement"),
    ("verifikasi_asal", "Benar. Lagu X dari Y.", "Kurang tepat", False, "negated"),
    ("verifikasi_asal", "Benar. Lagu X dari Y.", "Mungkin", False, "no verdict"),
    ("pencipta_abstain", "Buku tidak mencantumkan.", "Maaf, saya tidak tahu", True, "plain refusal"),
    ("pencipta_abstain", "Buku tidak mencantumkan.", "Tidak diketahui, mungkin Ismail Marzuki", False, "refuses, then names"),
    ("pencipta_abstain", "Buku tidak mencantumkan.", "Ismail Marzuki", False, "invents"),
    ("judul_ke_baris", "satu dua tiga empat lima", "satu dua tiga empat lima", True, "same line"),
    ("judul_ke_baris", "satu dua tiga empat lima", "satu dua tiga empat", True, "one word short"),
    ("judul_ke_baris", "satu dua tiga empat lima", "satu dua", False, "too little"),
    ("nada_tertinggi", "5'", "5'", True, "same note"),
    ("nada_tertinggi", "5'", "5", False, "an octave off"),
    ("judul_ke_notasi", "1 2 3 4 | 5 5 5 -", "1 2 3 4 | 5 5 5 -", True, "same melody"),
    ("judul_ke_notasi", "1 2 3 4 | 5 5 5 -", "1 2 3 4 | 5 5 6 -", True, "one note off"),
    ("judul_ke_notasi", "1 2 3 4 | 5 5 5 -", "7 7 7", False, "another melody"),
]


def test_free_form_verdicts(spark):
    rivals = [
        ("pencipta", "ismail marzuki"), ("pencipta", "l manik"), ("pencipta_abstain", "ismail marzuki"),
        ("judul", "desaku"), ("judul", "desaku yang kucinta"), ("judul", "bhinneka tunggal ika"),
    ]
    table = spark.createDataFrame(rivals, "category string, rival string")
    rows = [(i, c, g, p) for i, (c, g, p, _, _) in enumerate(FREE_FORM)]
    preds = spark.createDataFrame(rows, "uid int, category string, answer string, reply string")
    got = {r.uid: r.lenient for r in scoring.score(preds, ["uid"], table).collect()}
    wrong = [(FREE_FORM[i], got[i]) for i in range(len(FREE_FORM)) if bool(got[i]) != FREE_FORM[i][3]]
    assert not wrong


def test_rival_marks_and_symbols(spark):
    """Rivals with / # , inside, and one without any word character."""
    rivals = spark.createDataFrame([("m", "4/4"), ("m", "3/4"), ("m", "c#"), ("m", "#")], "category string, rival string")
    rows = [(0, "m", "3/4", "4/4"), (1, "m", "13/4", "4/4"), (2, "m", "x,4/4", "2/4"), (3, "m", "c#m", "2/4"), (4, "m", "a # b", "2/4")]
    preds = spark.createDataFrame(rows, "uid int, category string, p string, g string")
    got = {r.uid: r.names_rival for r in scoring.rival_hits(preds, ["uid"], rivals).collect()}
    assert [got.get(i, False) for i in range(5)] == [True, False, True, False, True]


OPT = {"A": "Do = C", "B": "Do = D", "C": "Do = E", "D": "Do = F", "E": "Do = G"}
NEST = {"A": "5", "B": "5'", "C": "3", "D": "2", "E": "riang"}
LETTERS = [
    ("B", OPT, "B"), ("B.", OPT, "B"), ("(B)", OPT, "B"), ("B)", OPT, "B"), ("**B**", OPT, "B"), ("`B`", OPT, "B"),
    ("B. Do = D", OPT, "B"), ("Jawabannya adalah C.", OPT, "C"), ("jawaban: d", OPT, "D"), ("Pilihan E", OPT, "E"),
    ("The answer is (A)", OPT, "A"), ("Do = C", OPT, "A"), ("menurut saya do = g", OPT, "E"), ("saya pilih D saja", OPT, "D"),
    ("A atau B", OPT, ""), ("", OPT, ""), ("tidak tahu", OPT, ""), ("<think>A? B?</think>C", OPT, "C"), ("<think>A", OPT, ""),
    ("nadanya 5'", NEST, "B"), ("nadanya 5", NEST, "A"), ("2 dan 3", NEST, ""), ("tempo riang", NEST, "E"), ("Banyak", OPT, ""),
]


def test_letters(spark):
    rows = [(i, r, o) for i, (r, o, _) in enumerate(LETTERS)]
    df = spark.createDataFrame(rows, "uid int, reply string, options map<string,string>")
    got = {r.uid: r.c for r in df.select("uid", reply.chosen_letter(F.col("reply"), F.col("options")).alias("c")).collect()}
    assert [(LETTERS[i], got[i]) for i in got if got[i] != LETTERS[i][2]] == []


def test_sequence_ratio_is_the_published_measure(spark):
    rows = [("a b c d", "a b x d"), ("", ""), ("q", ""), ("1 2 3 | 4", "1 2 | 4 5 6"), ("x " * 300, "x " * 150 + "y " * 150)]
    df = spark.createDataFrame([(a.split(), b.split()) for a, b in rows], "a array<string>, b array<string>")
    got = [r.r for r in df.select(pairs.sequence_ratio_column(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [pytest.approx(difflib.SequenceMatcher(None, a.split(), b.split()).ratio()) for a, b in rows]


def test_titles_with_other_digits_differ(spark):
    df = spark.createDataFrame([("Tanah Airku 1", "Tanah Airku 2"), ("bhineka tunggal ika", "Bhinneka Tunggal Ika")], "a string, b string")
    one, two = (r.s for r in df.select(pairs.title_similarity(F.col("a"), F.col("b")).alias("s")).collect())
    assert one == 0.0 and 0.95 < two < 1.0


def test_short_and_long_overlap_agree(spark):
    rows = [(0, "a b b c", "b b d"), (1, "", ""), (2, "a", ""), (3, "x y", "y x"), (4, "Ünï cödé", "uni code")]
    df = spark.createDataFrame(rows, "k int, p string, g string")
    short = {r.k: r.f for r in df.select("k", reply.token_f1(F.col("p"), F.col("g")).alias("f")).collect()}
    long = {r.k: r.f1 for r in pairs.token_f1_pairs(df, "k", "p", "g").collect()}
    assert short == pytest.approx(long)
    assert short == pytest.approx({0: 4 / 7, 1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0})


def test_a_score_reads_its_replies_once(spark):
    """Behind a score stand written replies and rivals: no branch strips and normalises the replies again."""
    rows = [(1, "maker", "<think>B</think> Ann", "Ann"), (2, "maker", "Ann or Bob", "Bob"), (3, "judul_ke_notasi", "1 2 3", "1 2 3"), (4, None, "x", "x")]
    preds = spark.createDataFrame(rows, "id long, category string, reply string, answer string")
    done = scoring.score(preds, ["id"], scoring.rival_sets(preds))
    assert "<think>" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["lenient"] for r in done.collect()} == {1: 1, 2: 0, 3: 1, 4: 1}
