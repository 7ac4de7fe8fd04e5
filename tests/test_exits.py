import pytest
from pyspark.sql import functions as F

from musterline.functions.text import words
from musterline.operators import answers as an
from musterline.operators import leavers as lv
from musterline.operators import sentiment as st
from musterline.plans import exits

IDS = ("2015-01-01", "1980-01-01", "F", "Analyst", "2024-01-01", "2024-02-01", "Resignation", "Pay")
SCHEMA = ", ".join(f"{n.upper()} string" for n in lv.IDENTIFIERS) + (
    ", QUESTION_DESC string, CHOICE_OR_COMMENTS string, place int"
)


def answers(spark, rows):
    """Rows of (who, question, answer); `who` goes into the letter date."""
    data = [
        (*IDS[:4], who, *IDS[5:], question, answer, place)
        for place, (who, question, answer) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def pivot(spark, rows):
    table = lv.pivot_answers(answers(spark, rows).repartition(3), "place")
    return {r.resignationletterdate: r.asDict() for r in table.collect()}, table.columns


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="resignationreason"):
        lv.check_answers(answers(spark, [("a", "Q", "x")]).drop("RESIGNATIONREASON"))


def test_first_non_null_answer_wins(spark):
    rows, _ = pivot(spark, [("a", "Why", None), ("a", "Why", "pay"), ("a", "Why", "move")])
    assert rows["a"]["why"] == "pay"


def test_nulls_drop_leavers_and_questions(spark):
    rows, columns = pivot(
        spark, [("a", "Why", "x"), ("a", None, "y"), ("b", "Why", None), (None, "Why", "z"), ("a", "How", None)]
    )
    assert set(rows) == {"a"} and "how" not in columns


def test_equal_identifiers_merge(spark):
    rows, _ = pivot(spark, [("a", "Why", "one"), ("a", "How", "two")])
    assert len(rows) == 1 and rows["a"]["how"] == "two"


def test_question_names_and_clashes(spark):
    rows, columns = pivot(
        spark, [("a", "A b", "1"), ("a", "a_b", "2"), ("a", "What's up, doc?", "3"), ("a", "Gender", "4")]
    )
    assert columns[8:] == ["a_b", "gender_2", "whats_up_doc", "a_b_2"]
    assert rows["a"]["a_b"] == "1" and rows["a"]["a_b_2"] == "2" and rows["a"]["gender"] == "F"


def test_feedback_joins_every_text_column(spark):
    table = lv.pivot_answers(answers(spark, [("a", "Q1", "x"), ("a", "Q3", "z"), ("b", "Q2", "y")]), "place")
    texts = {r.resignationletterdate: r.full_feedback for r in lv.add_feedback(table).collect()}
    assert texts["a"] == "2015-01-01 1980-01-01 F Analyst a 2024-02-01 Resignation Pay x  z"
    dated = table.withColumn("dob", F.col("dob").cast("date"))
    assert "1980" not in lv.add_feedback(dated).first().full_feedback


def test_comments_and_proof(spark):
    table = lv.pivot_answers(
        answers(spark, [("a", "What now", "go"), ("a", "Comments", "x"), ("a", "Addtional", " "), ("b", "Scale", "5")]),
        "place",
    )
    assert [(r.resignationletterdate, r.all_comments) for r in lv.verbatim_comments(table).collect()] == [("a", "go")]
    proof = lv.proof_view(table.withColumn("sentiment", F.lit("Neutral")))
    assert proof.columns == [
        "designation", "resignationreason", "sentiment", "addtional", "comments", "what_now"
    ]


def test_tokens(spark):
    text = "Don't the TEAM'S Café_1 was çok-GÜZEL, ok 12345 company!"
    frame = spark.createDataFrame([(text,), (None,)], "full_feedback string")
    assert frame.select(words("full_feedback")).first()[0][:2] == ["don", "t"]
    found = [r.tokens for r in st.add_tokens(frame).collect()]
    assert found == [["café_1", "çok", "güzel", "12345"], []]


def test_lemmas_keep_order_and_unknown_tokens(spark):
    docs = spark.createDataFrame(
        [(1, ["managers", "left", "managers", "salary"]), (2, [])], "k int, tokens array<string>"
    )
    lemmas = spark.createDataFrame([("managers", "manager")], "token string, lemma string")
    found = {r.k: r.tokens for r in st.lemmatise(docs, "k", lemmas).collect()}
    assert found == {1: ["manager", "left", "manager", "salary"], 2: []}


def test_sentiment_thresholds(spark):
    docs = spark.createDataFrame(
        [(1, "good good"), (2, "bad"), (3, "meh"), (4, "  "), (5, None), (6, "good bad"), (7, "GOOD tiny")],
        "k int, full_feedback string",
    )
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0), ("tiny", -1.9)], "token string, valence double")
    rows = {r.k: r for r in st.add_sentiment(docs, "k", lexicon).collect()}
    assert [rows[k].sentiment for k in range(1, 8)] == [
        "Positive", "Negative", "Neutral", "Neutral", "Neutral", "Neutral", "Neutral",
    ]
    assert rows[1].compound == pytest.approx(4 / (16 + 15) ** 0.5)


def test_designation_share(spark):
    frame = spark.createDataFrame([("A",), ("B",), ("A",), ("A",)], "designation string")
    assert [tuple(r) for r in lv.designation_share(frame).collect()] == [("A", 3, 75.0), ("B", 1, 25.0)]


VOCABULARY = {
    "pay": "salary bonus money raise",
    "boss": "manager lead supervisor attitude",
    "road": "commute travel distance traffic",
    "home": "family child parent home",
}


def survey(spark):
    rows = []
    for number in range(24):
        topic = list(VOCABULARY)[number % 4]
        mood = "happy" if number < 12 else "angry"
        rows.append((f"L{number}", "What made you go", f"{VOCABULARY[topic]} {VOCABULARY[topic]} {mood}"))
    rows.append(("L99", "What made you go", "plain words"))
    lexicon = spark.createDataFrame([("happy", 3.0), ("angry", -3.0)], "token string, valence double")
    return answers(spark, rows), lexicon


def test_themes_end_to_end(spark):
    found = exits.analyse_exits(*survey(spark), order="place")
    themes = found.themes.collect()
    assert sorted((t.corpus, t.topic) for t in themes) == [(c, i) for c in ("concern", "praise") for i in range(4)]
    assert all(len(t.keywords) == 5 and not any(" " in w for w in t.keywords) for t in themes)
    leavers = {r.resignationletterdate: r for r in found.leavers.collect()}
    assert len(leavers) == 25
    assert leavers["L99"].assigned_themes == [] and leavers["L99"].sentiment == "Neutral"
    for name, row in leavers.items():
        kind = {"Positive": "Praise", "Negative": "Concern", "Neutral": "-"}[row.sentiment]
        assert all(theme.startswith(kind) for theme in row.assigned_themes)
        assert name == "L99" or row.assigned_themes
    # Leavers who say the same share their themes.
    assert leavers["L0"].assigned_themes == leavers["L4"].assigned_themes == leavers["L8"].assigned_themes
    assert "full_feedback" not in found.leavers.columns and "tokens" not in found.leavers.columns
    picked = leavers["L0"].assigned_themes[0]
    assert lv.leavers_with_theme(found.leavers, picked).count() >= 3


def test_user_theme_names(spark):
    names = spark.createDataFrame([("praise", 0, "Fair pay")], "corpus string, topic int, name string")
    found = exits.analyse_exits(*survey(spark), order="place", theme_names=names)
    table = found.themes.collect()
    assert {t.theme_name for t in table if (t.corpus, t.topic) == ("praise", 0)} == {"Fair pay"}
    assert all(": " in t.theme_name for t in table if t.corpus == "concern")


def test_too_few_documents_give_no_themes(spark):
    rows, lexicon = survey(spark)
    few = exits.analyse_exits(rows.where("RESIGNATIONLETTERDATE IN ('L0', 'L1', 'L99')"), lexicon, "place")
    assert few.themes.count() == 0
    assert [r.assigned_themes for r in few.leavers.collect()] == [[], [], []]
    one_side = exits.analyse_exits(rows.where("place < 12"), lexicon, "place")
    assert {t.corpus for t in one_side.themes.collect()} == {"praise"}


def test_two_topics_of_one_name_stay_apart(spark):
    names = spark.createDataFrame(
        [("praise", t, "Same") for t in range(4)], "corpus string, topic int, name string"
    )
    found = exits.analyse_exits(*survey(spark), order="place", theme_names=names)
    members = lv.theme_members(found.leavers).where("corpus = 'praise'").collect()
    by_topic = {t: found.of_theme("praise", t).count() for t in range(4)}
    assert sum(by_topic.values()) == len(members) > 0
    assert by_topic == {t: sum(m.topic == t for m in members) for t in range(4)}
    shares = lv.theme_designations(found.leavers).where("corpus = 'praise'").collect()
    for topic in {s.topic for s in shares}:
        assert sum(s.share_pct for s in shares if s.topic == topic) == pytest.approx(100)


def test_answers_as_a_map_say_what_the_columns_say(spark):
    from musterline.operators import answers as an

    rows = [("a", "What now", "go"), ("a", "Comments", "x"), ("a", "Addtional", " "), ("b", "Scale", "5"), ("a", "Q3", "z"),
            ("b", "What now", "stay on"), ("b", "comments!", "ok then"), ("c", "Scale", None), ("a", "What now", "later"), ("d", "Only", "")]
    source = answers(spark, rows).repartition(3)
    gathered, wide = an.gather_answers(source, "place"), lv.pivot_answers(source, "place")
    key = lambda f, c: {r.resignationletterdate: r[c] for r in f.collect()}
    assert key(an.add_feedback(gathered, an.questions(source)), "full_feedback") == key(lv.add_feedback(wide), "full_feedback")
    assert key(an.verbatim_comments(gathered), "all_comments") == key(lv.verbatim_comments(wide), "all_comments")
    mood = F.lit("Neutral")
    long = an.proof(gathered.withColumn("sentiment", mood), "resignationletterdate").collect()
    assert sorted((r.resignationletterdate, r.question, r.answer) for r in long) == [
        ("a", "addtional", " "), ("a", "comments", "x"), ("a", "what_now", "go"), ("b", "comments", "ok then"), ("b", "what_now", "stay on"),
    ]


def test_wide_output_of_the_plan(spark):
    rows, lexicon = survey(spark)
    found = exits.analyse_exits(rows, lexicon, order="place")
    table = found.wide(lv.questions_of(rows))
    assert "what_made_you_go" in table.columns and "answers" not in table.columns
    assert {r.what_made_you_go for r in table.where("resignationletterdate = 'L99'").collect()} == {"plain words"}


def test_feedback_places_only_the_answers_given(spark):
    """The text of all questions, for any gaps, without looking every question up."""
    asked = [f"q{i:02d}" for i in range(12)]
    said = [{}, {"q00": "a", "q11": "b"}, {"q05": None, "q06": "c d"}, {q: q for q in asked}, {"q03": "", "zz": "x"}]
    rows = [(*[None if n == "gender" else f"{n}{k}" for n in lv.IDENTIFIERS], s) for k, s in enumerate(said)]
    schema = ", ".join(f"{n} string" for n in lv.IDENTIFIERS) + ", answers map<string,string>"
    gathered, questions = spark.createDataFrame(rows, schema), F.array(*[F.lit(q) for q in asked])
    text = lambda known, s: " ".join([*known, *[s.get(q) or "" for q in asked]])
    found = an.add_feedback(gathered, questions)
    assert [r.full_feedback for r in found.collect()] == [text([x or "" for x in r[:-1]], r[-1]) for r in rows]
    numbered = gathered.withColumns({n: F.lit(1) for n in lv.IDENTIFIERS})
    assert [r.full_feedback for r in an.add_feedback(numbered, questions).collect()] == [text([], s) for s in said]
    none = an.add_feedback(numbered, F.array().cast("array<string>"))
    assert {r.full_feedback for r in none.collect()} == {""}
    assert "array_position" in found._jdf.queryExecution().analyzed().toString()


def test_words_meet_the_lexicon_with_a_number_for_the_leaver(spark, monkeypatch):
    class Reached(Exception):
        pass

    def add_sentiment(docs, key, lexicon):
        raise Reached(dict(docs.dtypes)[key], sorted(r[key] for r in docs.select(key).collect()))

    monkeypatch.setattr(st, "add_sentiment", add_sentiment)
    lexicon = spark.createDataFrame([("pay", 1.0)], "token string, valence double")
    with pytest.raises(Reached) as reached:
        exits.analyse_exits(answers(spark, [("a", "Why", "pay"), ("a", "How", "x"), ("b", "Why", "pay")]), lexicon, "place")
    kind, numbers = reached.value.args
    assert kind == "bigint" and len(numbers) == len(set(numbers)) == 2
