"""The conditional random field against enumeration, and language identification by accuracy."""

from itertools import product

import numpy as np
import pytest

from musterline.llm import language_crf as crf, language_id
from musterline.llm.queries import op11_language_id

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the cat and the dog with their houses were thinking of nothing this morning while walking".split()
GERMAN = "der hund und die katze haben nicht gedacht dass schöne straßen wichtig gewesen sein könnten".split()


def enumerated(emissions, transitions, start):
    """Probabilities of the labels of each word by adding up all paths."""
    steps, kinds = emissions.shape
    out = np.zeros((steps, kinds))
    for path in product(range(kinds), repeat=steps):
        weight = np.exp(start[path[0]] + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        weight *= np.prod([emissions[t, k] for t, k in enumerate(path)])
        for t, k in enumerate(path):
            out[t, k] += weight
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("lane, lanes", [(128, 2048), (3, 2), (2, 3), (1, 1)])
def test_forward_backward_equals_enumeration(monkeypatch, lane, lanes):
    monkeypatch.setattr(crf, "LANE", lane)
    monkeypatch.setattr(crf, "LANES", lanes)
    rng = np.random.default_rng(1)
    table = rng.random((9, 3)).astype(np.float32) + 0.01
    transitions, start = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    texts = [rng.integers(0, 9, n) for n in (1, 7, 0, 3, 8, 2, 6)]
    words = np.concatenate(texts)
    got = np.zeros((len(words), 3))
    cut = crf.Lanes(np.array([len(t) for t in texts]))
    for _, place, here in crf.posteriors(cut, words, table, transitions, start):
        got[place] = here
    at = 0
    for text in texts:
        if len(text):
            wanted = enumerated(table[text].astype(float), transitions, start)
            assert np.allclose(got[at : at + len(text)], wanted, atol=1e-6)
        at += len(text)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    scores, labels = rng.normal(0, 1, (4, 2, 3)), rng.integers(0, 3, (4, 2))
    transitions, start = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    value, *gradients = crf.log_likelihood(scores, labels, transitions, start)
    for parameter, gradient in zip((scores, transitions, start), gradients):
        for place in np.ndindex(parameter.shape):
            parameter[place] += 1e-5
            more = crf.log_likelihood(scores, labels, transitions, start)[0]
            parameter[place] -= 1e-5
            assert abs((more - value) / 1e-5 - gradient[place]) < 1e-3


def two_languages():
    rng = np.random.default_rng(4)
    runs = []
    for number in range(200):
        words = (ENGLISH, GERMAN)[number % 4 // 2]
        runs.append(([words[i] for i in rng.integers(0, len(words), 30)], number % 4 // 2))
    return crf.train(runs, ["xx", "yy"], epochs=4)


def test_spans_of_code_switched_text():
    field = two_languages()
    text = " ".join(ENGLISH) + ". 1234 -- " + " ".join(GERMAN) + " ²² " + " ".join(ENGLISH)
    (spans,) = crf.Labeller(field).spans([text])
    assert [s[2] for s in spans] == ["xx", "yy", "xx"]
    assert text[spans[1][0] : spans[1][1]] == " ".join(GERMAN)
    assert text[spans[0][0] : spans[0][1]] == " ".join(ENGLISH)
    # Transitions were learnt: staying is likelier than changing.
    assert field.transitions[0, 0] > field.transitions[0, 1] and field.transitions[1, 1] > field.transitions[1, 0]
    shares = crf.Labeller(field).shares([text, None, "", "12 ²", " ".join(GERMAN), "ENGLISH"])
    assert 0.5 < shares[0, 0] < 0.8 and shares[4, 1] > 0.95
    assert (shares[1:4] == 0).all() and abs(shares[5].sum() - 1) < 1e-6


def test_very_long_text_and_forgotten_words_change_nothing(monkeypatch):
    field = two_languages()
    text = " ".join(GERMAN * 20_000)
    shares = crf.Labeller(field).shares([text, "hund", text[:5000]])
    monkeypatch.setattr(crf, "LONG_TEXT", 100)
    monkeypatch.setattr(crf, "GROUP_WORDS", 10)
    monkeypatch.setattr(crf, "CACHE_WORDS", 2)
    again = crf.Labeller(field).shares([text, "hund", text[:5000]])
    assert np.allclose(shares, again, atol=1e-6) and shares[0, 1] > 0.99


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    found = op11_language_id(spark, SMALL).where("held_out").join(docs, "doc_id").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in found)
    assert len(found) > 200 and right / len(found) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_defined_cases(spark, tmp_path, odd_rows):
    rows = [(n, " ".join(ENGLISH), "xx", "s", 1) for n in range(60)]
    rows += [(100 + n, " ".join(GERMAN), "yy", "s", 1) for n in range(60)]
    rows += [(None, " ".join(ENGLISH), "zz", "s", 1), (300, " ".join(GERMAN), None, None, None)]
    rows += [(1000 + (i or 0), text, None, "s", 1) for i, text in odd_rows] + [(400, "12 .. ²", "xx", "s", 1)] * 2
    frame = spark.createDataFrame(
        [(*r, 0.5, "x", "w") for r in rows], SCHEMA + ", score double, lang_pred string, `a.b` string"
    )
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    out = op11_language_id(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == len(rows)
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"], r["held_out"]))
    assert all(got[n][0][0] == "xx" for n in range(60)) and got[300][0][0] == "yy"
    assert got[None][0][0] == "xx" and got[None][0][2] is False
    assert [g[:2] for g in got[400]] == [("und", 0.0)] * 2
    for number, text in odd_rows:
        letters = any(map(str.isalpha, text or ""))
        assert all((g[0] == "und") != letters for g in got[1000 + (number or 0)] if number)
    # A language without labels at all: nothing is learnt.
    none = frame.withColumn("lang", frame["source"].substr(9, 1)).where("lang IS NULL")
    assert language_id.fit(none) is None
    assert {r["found"]["lang_pred"] for r in none.select(language_id.predicted(none, None).alias("found")).collect()} <= {"und"}


def test_spans_column(spark):
    field = two_languages()
    docs = spark.createDataFrame([(1, " ".join(ENGLISH)), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", language_id.spans(docs, field).alias("s")).collect()}
    assert [s["lang"] for s in got[1]] == ["xx"] and got[2] == []
