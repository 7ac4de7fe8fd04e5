"""Values on an edge: text rounding, written dates, views over several units, double entries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from musterline.functions.columns import fixed
from musterline.operators import cleaning, topics
from musterline.operators import sentiment as st
from musterline.plans.attendance import analyse_days


@pytest.mark.parametrize("places", [0, 1, 2])
def test_text_is_rounded_on_the_exact_value(spark, places):
    rng = random.Random(places)
    values = [223 / 20000 * 100, 0.0, 0.125, 0.375, 2.5, 3.5, 1.005, 2.675, 0.05, 0.25, 0.35]
    values += [99.995, 100.0, 1e15 - 0.5, 0.004999999, 5e-324, -1.005, -3.25]
    values += [rng.randrange(10**6) / 1000 for _ in range(300)]
    values += [a / b * 100 for a, b in [(rng.randrange(1, 500), rng.randrange(1, 500)) for _ in range(300)]]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed("v", places))
    for value, text in frame.collect():
        assert text == f"{value:.{places}f}", value


def test_text_of_nothing_is_null(spark):
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(fixed("v", 2)).first()[0] is None


@pytest.mark.parametrize(
    "text",
    [
        "2026-01-20T00:00:00", "20-01-2026", "20 January 2026", "Jan 20, 2026", "January 20, 2026",
        "20.01.2026", "01-20-2026", "20/1/2026", "2026-01-20 08:30", "20-January-2026",
    ],
)
def test_dates_as_people_write_them(spark, text):
    frame = spark.createDataFrame([(text,)], "relieving_date string")
    assert cleaning.parse_relieving_date(frame).first()[0] == dt.date(2026, 1, 20)


def test_the_month_comes_first_where_both_readings_fit(spark):
    frame = spark.createDataFrame([("03-04-2026",), ("03.04.2026",)], "relieving_date string")
    found = {r[0] for r in cleaning.parse_relieving_date(frame).collect()}
    assert found == {dt.date(2026, 3, 4)}


def test_a_view_holds_all_days_of_its_employees(days_of):
    frames = analyse_days(
        days_of(
            [
                ("E1", "2024-01-01", "P", {"unit": "U1"}),
                ("E1", "2024-01-02", "P", {"unit": "U2"}),
                ("E2", "2024-01-01", "P", {"unit": "U2"}),
            ]
        )
    )
    days = frames.view(units=["U1"]).daily.select("employee_id", "date").collect()
    assert sorted((r[0], r[1].day) for r in days) == [("E1", 1), ("E1", 2)]


def test_double_entries_count_once(spark):
    docs = spark.createDataFrame([(1, "good", ["b", "good"])], "k int, full_feedback string, tokens array<string>")
    lexicon = spark.createDataFrame([("good", 1.0), ("good", 1.0), ("good", 3.0)], "token string, valence double")
    assert st.add_sentiment(docs, "k", lexicon).first().compound == pytest.approx(1 / 4)
    lemmas = spark.createDataFrame([("good", "well"), ("good", "fine")], "token string, lemma string")
    assert st.lemmatise(docs, "k", lemmas).first().tokens == ["b", "fine"]


def test_masses_equal_but_for_their_last_digits_rank_by_term(spark):
    terms = spark.createDataFrame([("c", "b", 0.3), ("c", "a", 0.1 + 0.2)], "corpus string, term string, topic_0 double")
    for frame in (terms, terms.withColumn("topic_0", F.when(F.col("term") == "b", 0.1 + 0.2).otherwise(0.3))):
        assert topics.topic_keywords(frame, topics=1).first().keywords == ["a", "b"]
