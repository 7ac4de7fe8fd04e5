"""Exit queries: pivot, feedback, tokens, sentiment, TF-IDF, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from musterline.catalog import sql
from musterline.catalog.registry import query
from musterline.functions import special
from musterline.functions import text as tx
from musterline.operators import answers as an
from musterline.operators import leavers as lv
from musterline.operators import sentiment as st
from musterline.operators import terms as tm
from musterline.operators import topics as tp
from musterline.plans import exits
from musterline.session import durable, shared_folder
from musterline.sources import derived, read_answers

ANSWER_CTES = f"{sql.ANSWERS},\n{sql.FIRST_ANSWERS}"
NAME = "lower(regexp_replace(replace(question_desc, ' ', '_'), '[^0-9a-zA-Z_]', '', 'g'))"
# Feedback: identifiers, then an answer or nothing for every question, in question order.
FEEDBACK = f"""{ANSWER_CTES},
questions AS (SELECT DISTINCT question_desc FROM first_answers),
who AS (SELECT DISTINCT {sql.IDENTIFIERS} FROM first_answers),
filled AS (
  SELECT w.*, q.question_desc, coalesce(f.answer, '') AS answer
  FROM who w, questions q LEFT JOIN first_answers f
    ON f.resignationletterdate = w.resignationletterdate AND f.question_desc = q.question_desc),
joined AS (
  SELECT {sql.IDENTIFIERS}, string_agg(answer, ' ' ORDER BY question_desc) AS said
  FROM filled GROUP BY {sql.IDENTIFIERS}),
feedback AS (
  SELECT *, concat_ws(' ', {sql.IDENTIFIERS}) || ' ' || said AS full_feedback FROM joined)"""
# The words left out of topics, stated for the SQL on their own.
STOPS = """
  'a', 'about', 'above', 'after', 'again', 'against', 'all', 'am', 'an', 'and', 'any', 'are',
  'as', 'at', 'be', 'because', 'been', 'before', 'being', 'below', 'between', 'both', 'but',
  'by', 'can', 'cannot', 'could', 'did', 'do', 'does', 'doing', 'don', 'down', 'during',
  'each', 'few', 'for', 'from', 'further', 'had', 'has', 'have', 'having', 'he', 'her',
  'here', 'hers', 'herself', 'him', 'himself', 'his', 'how', 'i', 'if', 'in', 'into', 'is',
  'it', 'its', 'itself', 'let', 'me', 'more', 'most', 'my', 'myself', 'no', 'nor', 'not',
  'of', 'off', 'on', 'once', 'only', 'or', 'other', 'ought', 'our', 'ours', 'ourselves',
  'out', 'over', 'own', 'same', 'shan', 'she', 'should', 'so', 'some', 'such', 'than',
  'that', 'the', 'their', 'theirs', 'them', 'themselves', 'then', 'there', 'these', 'they',
  'this', 'those', 'through', 'to', 'too', 'under', 'until', 'up', 'very', 'was', 'we',
  'were', 'what', 'when', 'where', 'which', 'while', 'who', 'whom', 'why', 'with', 'won',
  'would', 'you', 'your', 'yours', 'yourself', 'yourselves', 'na', 'yes', 'good', 'fair',
  'excellent', 'agree', 'better', 'best', 'company', 'organization', 'work', 'working',
  'employee', 'partner', 'team', 'sometimes', 'nothing', 'issue', 'backed', 'left', 'join',
  'fill'"""


def words_sql(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def content_sql(text: str) -> str:
    return f"list_filter({words_sql(text)}, lambda x: length(x) > 2 AND x NOT IN ({STOPS}))"


def wide(spark, sf_dir) -> DataFrame:
    return lv.pivot_answers(derived.exit_answers(spark, sf_dir))


def spoken(spark, sf_dir) -> DataFrame:
    answers = derived.exit_answers(spark, sf_dir)
    return an.add_feedback(an.gather_answers(answers), an.questions(answers))


@query(
    "read_answers_order",
    "SELECT conv_id, min_by(role, turn) AS role, count(*) AS answers FROM conversations GROUP BY conv_id",
)
def read_answers_order(spark, sf_dir):
    """First answer of every conversation by its place in the file, which is sorted by turn."""
    rows = read_answers(spark, f"{sf_dir.rstrip('/')}/conversations.parquet", "parquet")
    return rows.groupBy("conv_id").agg(
        F.min_by("role", "row_order").alias("role"), F.count(F.lit(1)).alias("answers")
    )


@query(
    "exit_wide",
    f"WITH {ANSWER_CTES} SELECT {sql.IDENTIFIERS}, {NAME} AS question, answer FROM first_answers",
)
def exit_wide(spark, sf_dir):
    """The wide table, its answers opened into rows: which questions there are depends
    on the data."""
    table = wide(spark, sf_dir)
    asked = [name for name in table.columns if name not in lv.IDENTIFIERS]
    return table.unpivot(list(lv.IDENTIFIERS), asked, "question", "answer").where(
        F.col("answer").isNotNull()
    )


@query(
    "exit_wide_from_csv",
    f"WITH {ANSWER_CTES} SELECT {sql.IDENTIFIERS}, {NAME} AS question, answer FROM first_answers",
)
def exit_wide_from_csv(spark, sf_dir):
    """The same from CSV files whose comments hold line breaks."""
    folder = shared_folder(spark, "answers")
    answers = derived.exit_answers(spark, sf_dir)
    answers.write.option("header", True).option("escape", '"').csv(folder)
    table = lv.pivot_answers(read_answers(spark, folder))
    asked = [name for name in table.columns if name not in lv.IDENTIFIERS]
    return table.unpivot(list(lv.IDENTIFIERS), asked, "question", "answer").where(
        F.col("answer").isNotNull()
    )


@query(
    "question_names",
    f"WITH {ANSWER_CTES} SELECT DISTINCT question_desc AS question, {NAME} AS name FROM first_answers",
)
def question_names(spark, sf_dir):
    usable = lv.usable_answers(derived.exit_answers(spark, sf_dir))
    return usable.select(
        F.col(lv.QUESTION).alias("question"),
        lv.question_column(F.col(lv.QUESTION)).alias("name"),
    ).distinct()


@query(
    "feedback_text",
    f"WITH {FEEDBACK} SELECT resignationletterdate, full_feedback FROM feedback",
)
def feedback_text(spark, sf_dir):
    return spoken(spark, sf_dir).select("resignationletterdate", "full_feedback")


@query(
    "clean_tokens",
    f"SELECT doc_id, array_to_string({content_sql('text')}, ' ') AS cleaned"
    " FROM documents",
)
def clean_tokens(spark, sf_dir):
    docs = st.add_tokens(derived.feedback_texts(spark, sf_dir), "text")
    return docs.select("doc_id", st.cleaned_text().alias("cleaned"))


@query(
    "lemma_tokens",
    f"""SELECT doc_id, array_to_string(list_transform({content_sql('text')},
          lambda x: CASE WHEN suffix(x, 's') THEN left(x, length(x) - 1) ELSE x END), ' ') AS cleaned
        FROM documents""",
)
def lemma_tokens(spark, sf_dir):
    docs = durable(st.add_tokens(derived.feedback_texts(spark, sf_dir), "text").drop("text"))
    lemmas = derived.token_lemmas(docs.select(F.explode("tokens").alias("token")))
    return st.lemmatise(docs, "doc_id", lemmas).select(
        "doc_id", st.cleaned_text().alias("cleaned")
    )


BY_LENGTH = "length(x) % 5 - 2"
BY_LETTERS = "(unicode(x) + unicode(right(x, 1)) + length(x)) % 7 - 3"


def _sentiment_sql(key: str, rows: str, valence: str) -> str:
    """`rows` has `key` and `text`; `valence` is an expression of the token x."""
    return f"""valences AS (
  SELECT {key}, coalesce(list_sum(list_transform({words_sql('text')},
      lambda x: CASE WHEN length(x) >= 3 THEN {valence} ELSE 0 END)), 0)::DOUBLE AS s
  FROM {rows}),
scored AS (SELECT {key}, s / sqrt(s * s + 15) AS compound FROM valences),
labelled AS (
  SELECT {key}, round(compound, 9) AS compound, CASE WHEN compound >= 0.05 THEN 'Positive'
    WHEN compound <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM scored)"""


DOCUMENTS_SENTIMENT = (
    "english AS (SELECT doc_id, text FROM documents),\n"
    + _sentiment_sql("doc_id", "english", BY_LENGTH)
)
LEAVERS_SENTIMENT = (
    f"{FEEDBACK},\ntexts AS (SELECT resignationletterdate, full_feedback AS text FROM feedback),\n"
    + _sentiment_sql("resignationletterdate", "texts", BY_LETTERS)
)


@query("sentiment", f"WITH {DOCUMENTS_SENTIMENT} SELECT * FROM labelled")
def sentiment(spark, sf_dir):
    docs = derived.feedback_texts(spark, sf_dir)
    lexicon = derived.token_lexicon(docs.select(F.explode(tx.words("text")).alias("token")))
    return st.add_sentiment(docs, "doc_id", lexicon, "text").select(
        "doc_id", F.round("compound", 9).alias("compound"), "sentiment"
    )


def leavers(spark, sf_dir) -> DataFrame:
    """Leavers with key, feedback, tokens and sentiment."""
    return exits.scored_leavers(derived.exit_answers(spark, sf_dir), lexicon(spark, sf_dir))


def lexicon(spark, sf_dir) -> DataFrame:
    return derived.token_lexicon(
        spoken(spark, sf_dir).select(F.explode(tx.words("full_feedback")).alias("token")), derived.BY_LETTERS
    )


@query("leaver_sentiment", f"WITH {LEAVERS_SENTIMENT} SELECT * FROM labelled")
def leaver_sentiment(spark, sf_dir):
    return leavers(spark, sf_dir).select(
        "resignationletterdate", F.round("compound", 9).alias("compound"), "sentiment"
    )


@query(
    "sentiment_corpora",
    f"""WITH {LEAVERS_SENTIMENT}
    SELECT CASE sentiment WHEN 'Positive' THEN 'praise' ELSE 'concern' END AS corpus,
      resignationletterdate, array_to_string({content_sql('text')}, ' ') AS cleaned
    FROM labelled JOIN texts USING (resignationletterdate) WHERE sentiment <> 'Neutral'""",
)
def sentiment_corpora(spark, sf_dir):
    docs = exits.corpora_of(leavers(spark, sf_dir), "resignationletterdate")
    return docs.select("corpus", "resignationletterdate", st.cleaned_text().alias("cleaned"))


TERMS = f"""tokens AS (
  SELECT doc_id, list_filter({content_sql('text')},
    lambda x: length(x) > 1 AND x NOT IN ({STOPS})) AS t
  FROM documents),
grams AS (
  SELECT doc_id, unnest(t) AS term FROM tokens
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
  FROM tokens WHERE len(t) > 1),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
size AS (SELECT count(*) AS n FROM tokens),
kept AS (
  SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
  FROM counts, size GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= any_value(n) * 0.9::DOUBLE),
raw AS (SELECT doc_id, term, tf, df, tf * idf AS raw FROM counts JOIN kept USING (term)),
norms AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY doc_id)"""


def document_tfidf(spark, sf_dir) -> DataFrame:
    docs = st.add_tokens(derived.feedback_texts(spark, sf_dir), "text").withColumn(
        "corpus", F.lit("all")
    )
    return tm.tfidf(docs, "doc_id", ("all",))


@query(
    "term_counts",
    f"WITH {TERMS} SELECT doc_id, term, tf FROM counts",
)
def term_counts(spark, sf_dir):
    docs = st.add_tokens(derived.feedback_texts(spark, sf_dir), "text")
    counts = tm.term_counts(docs.withColumn("corpus", F.lit("all")), "doc_id")
    return counts.select("doc_id", "term", "tf")


@query(
    "tfidf",
    f"WITH {TERMS} SELECT doc_id, term, tf, df, round(raw / norm, 9) AS weight"
    " FROM raw JOIN norms USING (doc_id)",
)
def tfidf(spark, sf_dir):
    return document_tfidf(spark, sf_dir).select(
        "doc_id", "term", "tf", "df", F.round("weight", 9).alias("weight")
    )


# --- themes ---


def _psi(x: str) -> str:
    """The digamma function of an SQL expression, term by term as in `functions.special`."""
    far = f"({x} + {special.SHIFT})"
    series = "0.0::DOUBLE"
    for _, coefficient in reversed(special.SERIES):
        series = f"((1.0::DOUBLE / ({far} * {far})) * ({coefficient!r}::DOUBLE + {series}))"
    near = " + ".join(f"1.0::DOUBLE / ({x} + {step})" for step in range(special.SHIFT))
    return f"(ln({far}) - 0.5::DOUBLE / {far} - {series} - ({near}))"


def _start_sql(topic: int) -> str:
    def uniform(salt: int) -> str:
        digest = f"md5(concat_ws('/', corpus, term, '{topic}', '{tp.SEED}', '{salt}'))"
        return f"(('0x' || substr({digest}, 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE"

    normal = f"sqrt(ln({uniform(1)}) * -2.0) * cos({uniform(2)} * (2 * pi()))"
    ninth = 1.0 / (9.0 * tp.START_SHAPE)
    return f"pow({normal} * {ninth**0.5!r}::DOUBLE + {1.0 - ninth!r}::DOUBLE, 3.0)"


def _mixture_sql() -> str:
    """Gamma of a document from the lists c, b0 .. b3 of its terms.

    Up to `MIXTURE_STEPS` steps; the fifth place of the state says that it has settled.
    """
    n = tp.TOPICS
    theta = f"list_transform(g[1:{n}], lambda x: exp({_psi('x')} - {_psi(f'list_sum(g[1:{n}])')}))"
    norm = " + ".join(f"th[{i + 1}] * b{i}[i]" for i in range(n))
    shares = f"list_transform(range(1, len(c) + 1), lambda i: c[i] / ({norm} + {tp.TINY!r}::DOUBLE))"
    fresh = ", ".join(f"{1 / n}::DOUBLE + th[{i + 1}] * list_dot_product(sh, b{i})" for i in range(n))
    moved = " + ".join(f"abs(f[{i + 1}] - g[{i + 1}])" for i in range(n))
    settled = f"CASE WHEN ({moved}) / {n} < {tp.MIXTURE_TOLERANCE!r}::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE"
    state = ", ".join(f"f[{i + 1}]" for i in range(n))
    step = (
        f"list_transform([{theta}], lambda th: list_transform([{shares}], lambda sh:"
        f" list_transform([[{fresh}]], lambda f: [{state}, {settled}])[1])[1])[1]"
    )
    ones = ", ".join(["1.0"] * n)
    steps = f"list_transform(range({tp.MIXTURE_STEPS}), lambda z: []::DOUBLE[])"
    return (
        f"list_reduce(list_concat([[{ones}, 0.0]::DOUBLE[]], {steps}),"
        f" lambda g, z: CASE WHEN g[{n + 1}] = 1.0 THEN g ELSE {step} END)[1:{n}]"
    )


def _model_sql(passes: int) -> str:
    """The passes one after another: factors f, documents d with their gamma, terms l."""
    topics = range(tp.TOPICS)
    steps = []
    for number in range(passes + 1):
        factors = ", ".join(f"exp({_psi(f't{i}')} - {_psi(f's{i}')}) AS b{i}" for i in topics)
        sums = ", ".join(f"sum(t{i}) AS s{i}" for i in topics)
        lists = ", ".join(f"list(b{i} ORDER BY term) AS b{i}" for i in topics)
        steps.append(f"""f{number} AS MATERIALIZED (
  SELECT corpus, term, {factors}
  FROM l{number} JOIN (SELECT corpus, {sums} FROM l{number} GROUP BY corpus) USING (corpus)),
d{number} AS MATERIALIZED (
  SELECT *, {_mixture_sql()} AS g FROM (
    SELECT corpus, k, list(term ORDER BY term) AS term, list(c ORDER BY term) AS c, {lists}
    FROM w JOIN f{number} USING (corpus, term) GROUP BY corpus, k))""")
        if number == passes:
            break
        theta = ", ".join(f"exp({_psi(f'g[{i + 1}]')} - {_psi('list_sum(g)')}) AS th{i}" for i in topics)
        opened = ", ".join(f"unnest(b{i}) AS b{i}" for i in topics)
        norm = " + ".join(f"th{i} * b{i}" for i in topics) + f" + {tp.TINY!r}::DOUBLE"
        given = ", ".join(
            f"sum(c * (th{i} * b{i}) / ({norm})) + {1 / tp.TOPICS}::DOUBLE AS t{i}" for i in topics
        )
        steps.append(f"""l{number + 1} AS MATERIALIZED (
  SELECT corpus, term, {given}
  FROM (SELECT corpus, unnest(term) AS term, unnest(c) AS c, {opened}, {", ".join(f"th{i}" for i in topics)}
        FROM (SELECT *, {theta} FROM d{number})) GROUP BY corpus, term)""")
    return ",\n".join(steps)


_STARTS = ", ".join(f"{_start_sql(i)} AS t{i}" for i in range(tp.TOPICS))
MODEL = f"""{LEAVERS_SENTIMENT},
tokens AS (
  SELECT CASE sentiment WHEN 'Positive' THEN 'praise' ELSE 'concern' END AS corpus,
    resignationletterdate AS k, list_filter({content_sql('text')},
      lambda x: length(x) > 1 AND x NOT IN ({STOPS})) AS t
  FROM labelled JOIN texts USING (resignationletterdate) WHERE sentiment <> 'Neutral'),
grams AS (
  SELECT corpus, k, unnest(t) AS term FROM tokens
  UNION ALL
  SELECT corpus, k, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
  FROM tokens WHERE len(t) > 1),
counts AS MATERIALIZED (SELECT corpus, k, term, count(*) AS tf FROM grams GROUP BY ALL),
size AS (SELECT corpus, count(*) AS n FROM tokens GROUP BY corpus),
kept AS (
  SELECT corpus, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
  FROM counts JOIN size USING (corpus) GROUP BY corpus, term
  HAVING count(*) >= 2 AND count(*) <= any_value(n) * 0.9::DOUBLE),
enough AS (
  SELECT corpus FROM size JOIN (SELECT corpus, count(*) AS terms FROM kept GROUP BY corpus) USING (corpus)
  WHERE n >= {tp.TOPICS} AND terms >= {tp.TOPICS}),
raw AS (SELECT corpus, k, term, tf * idf AS raw FROM counts JOIN kept USING (corpus, term)
        WHERE corpus IN (SELECT corpus FROM enough)),
w AS MATERIALIZED (
  SELECT corpus, k, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY corpus, k)) AS c FROM raw),
l0 AS MATERIALIZED (SELECT corpus, term, {_STARTS} FROM (SELECT DISTINCT corpus, term FROM w)),
{_model_sql(tp.PASSES)},
long AS (
  SELECT corpus, term, unnest(range({tp.TOPICS})) AS topic,
    unnest([{", ".join(f"t{i}" for i in range(tp.TOPICS))}]) AS mass FROM l{tp.PASSES}),
placed AS (
  SELECT *, row_number() OVER (
    PARTITION BY corpus, topic ORDER BY round(mass, {tp.RANKED_PLACES}) DESC, term) AS rank
  FROM long),
keywords AS (
  SELECT corpus, topic, array_agg(replace(term, ' ', '_') ORDER BY rank) AS keywords
  FROM placed WHERE rank <= {tp.KEYWORDS} GROUP BY corpus, topic),
named AS (
  SELECT corpus, topic, kind AS theme_type,
    kind || ': ' || array_to_string(keywords[:3], ' / ') AS theme_name, keywords
  FROM (SELECT *, CASE corpus WHEN 'praise' THEN 'Praise / Satisfaction'
    ELSE 'Concern / Attrition Driver' END AS kind FROM keywords)),
shares AS (
  SELECT t.corpus, t.k,
    coalesce(list_transform(g, lambda x: x / list_sum(g)), [{", ".join([str(1 / tp.TOPICS)] * tp.TOPICS)}]) AS mixture
  FROM tokens t LEFT JOIN d{tp.PASSES} d ON d.corpus = t.corpus AND d.k = t.k
  WHERE t.corpus IN (SELECT corpus FROM enough)),
members AS (
  SELECT k AS resignationletterdate, corpus, topic, theme_name AS theme
  FROM shares JOIN named USING (corpus) WHERE mixture[topic + 1] > {tp.ASSIGN_ABOVE}::DOUBLE),
leavers AS (SELECT feedback.*, sentiment FROM feedback JOIN labelled USING (resignationletterdate))"""


def insights(spark, sf_dir) -> exits.ExitInsights:
    return exits.analyse_exits(derived.exit_answers(spark, sf_dir), lexicon(spark, sf_dir))


@query("theme_keywords", f"WITH {MODEL} SELECT corpus, topic::INT AS topic, unnest(keywords) AS keyword FROM named")
def theme_keywords(spark, sf_dir):
    return insights(spark, sf_dir).themes.select("corpus", "topic", F.explode("keywords").alias("keyword"))


@query(
    "theme_table",
    f"WITH {MODEL} SELECT corpus, theme_type, theme_name, array_to_string(keywords, ', ') AS keywords FROM named",
)
def theme_table(spark, sf_dir):
    themes = insights(spark, sf_dir).themes
    return themes.select(
        "corpus", "theme_type", "theme_name", F.array_join("keywords", ", ").alias("keywords")
    )


@query(
    "leaver_themes",
    f"""WITH {MODEL}
    SELECT {sql.IDENTIFIERS}, sentiment, coalesce(themes, '') AS themes
    FROM leavers LEFT JOIN (
      SELECT resignationletterdate, string_agg(theme, ' | ' ORDER BY topic) AS themes
      FROM members GROUP BY resignationletterdate) USING (resignationletterdate)""",
)
def leaver_themes(spark, sf_dir):
    tagged = insights(spark, sf_dir).leavers
    return tagged.select(
        *lv.IDENTIFIERS, "sentiment", F.array_join("assigned_themes", " | ").alias("themes")
    )


@query(
    "theme_members",
    f"WITH {MODEL} SELECT corpus, topic::INT AS topic, theme, {sql.IDENTIFIERS}, sentiment"
    " FROM leavers JOIN members USING (resignationletterdate)",
)
def theme_members(spark, sf_dir):
    """Leavers of every theme, of praise and of concern."""
    members = lv.theme_members(insights(spark, sf_dir).leavers)
    return members.select("corpus", "topic", "theme", *lv.IDENTIFIERS, "sentiment")


@query(
    "theme_designations",
    f"""WITH {MODEL}
    SELECT corpus, topic::INT AS topic, theme, designation, count(*) AS leavers,
      round(count(*) / sum(count(*)) OVER (PARTITION BY corpus, topic) * 100, 9) AS share_pct
    FROM leavers JOIN members USING (resignationletterdate) GROUP BY corpus, topic, theme, designation""",
)
def theme_designations(spark, sf_dir):
    """Designations within every theme."""
    shares = lv.theme_designations(insights(spark, sf_dir).leavers)
    return shares.withColumn("share_pct", F.round("share_pct", 9))


COMMENTS = f"""comments AS (
  SELECT resignationletterdate, string_agg(answer, '. ' ORDER BY question_desc) AS all_comments
  FROM first_answers WHERE trim(answer) <> '' AND length(answer) > 1
    AND regexp_matches({NAME}, 'what|suggestion|comment|addtional')
  GROUP BY resignationletterdate)"""


@query(
    "chosen_theme_comments",
    f"""WITH {MODEL}, {COMMENTS}
    SELECT resignationletterdate, designation, theme, all_comments
    FROM leavers JOIN members USING (resignationletterdate) JOIN comments USING (resignationletterdate)
    WHERE corpus = 'praise' AND topic = 0""",
)
def chosen_theme_comments(spark, sf_dir):
    """What the leavers of one theme wrote."""
    chosen = insights(spark, sf_dir).of_theme(exits.PRAISE, 0)
    named = chosen.withColumn("theme", F.filter("assigned", lambda a: a["topic"] == 0)[0]["theme"])
    return an.verbatim_comments(named).select(
        "resignationletterdate", "designation", "theme", "all_comments"
    )


@query(
    "chosen_theme_designations",
    f"""WITH {MODEL},
    own AS (SELECT DISTINCT resignationletterdate FROM members
      WHERE theme = (SELECT theme_name FROM named WHERE corpus = 'concern' AND topic = 1))
    SELECT designation, count(*) AS leavers,
      round(count(*) / (SELECT count(*) FROM own) * 100, 9) AS share_pct
    FROM leavers JOIN own USING (resignationletterdate) GROUP BY designation""",
)
def chosen_theme_designations(spark, sf_dir):
    """Designations of the leavers that have a theme of the chosen name."""
    found = insights(spark, sf_dir)
    name = (
        found.themes.where((F.col("corpus") == exits.CONCERN) & (F.col("topic") == 1))
        .select("theme_name")
        .scalar()
    )
    shares = lv.designation_share(lv.leavers_with_theme(found.leavers, name))
    return shares.withColumn("share_pct", F.round("share_pct", 9))


@query(
    "designation_share",
    f"""WITH {LEAVERS_SENTIMENT},
    members AS (SELECT designation FROM feedback JOIN labelled USING (resignationletterdate)
      WHERE sentiment = 'Positive')
    SELECT designation, count(*) AS leavers,
      count(*) / (SELECT count(*) FROM members) * 100 AS share_pct FROM members GROUP BY designation""",
)
def designation_share(spark, sf_dir):
    return lv.designation_share(st.praise(leavers(spark, sf_dir)))


@query(
    "verbatim_comments",
    f"""WITH {ANSWER_CTES}
    SELECT resignationletterdate, string_agg(answer, '. ' ORDER BY question_desc) AS all_comments
    FROM first_answers WHERE trim(answer) <> '' AND length(answer) > 1
      AND regexp_matches({NAME}, 'what|suggestion|comment|addtional')
    GROUP BY resignationletterdate""",
)
def verbatim_comments(spark, sf_dir):
    gathered = an.gather_answers(derived.exit_answers(spark, sf_dir))
    return an.verbatim_comments(gathered).select("resignationletterdate", "all_comments")


@query(
    "proof_view",
    f"""WITH {LEAVERS_SENTIMENT}
    SELECT f.resignationletterdate, f.designation, f.resignationreason, sentiment,
      {NAME} AS question, answer
    FROM feedback f JOIN labelled USING (resignationletterdate)
      JOIN first_answers a USING (resignationletterdate)
    WHERE regexp_matches({NAME}, 'what|suggestion|comment|addtional')""",
)
def proof_view(spark, sf_dir):
    """The proof table with its leaver, a row per comment."""
    return an.proof(leavers(spark, sf_dir), "resignationletterdate")


# --- theme operators on a given term-topic table and given mixtures ---

# Masses and shares from the rows themselves, so that both engines form the same ones.
MASS = "((tf * (topic + 2) + df * 7 + length(term) * (topic + 1)) % 97)"
GIVEN_TERMS = f"""{TERMS},
totals AS (
  SELECT CASE WHEN length(term) % 2 = 0 THEN 'praise' ELSE 'concern' END AS corpus, term,
    sum(tf)::BIGINT AS tf, count(*) AS df
  FROM counts GROUP BY term),
long AS (
  SELECT corpus, topic, term, {MASS} AS mass FROM totals, range(4) t(topic)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY corpus, topic ORDER BY mass DESC, term) AS rank
  FROM long),
keywords AS (
  SELECT corpus, topic, array_agg(replace(term, ' ', '_') ORDER BY rank) AS keywords
  FROM placed WHERE rank <= 5 GROUP BY corpus, topic),
named AS (
  SELECT corpus, topic, kind AS theme_type,
    kind || ': ' || array_to_string(keywords[:3], ' / ') AS theme_name, keywords
  FROM (SELECT *, CASE corpus WHEN 'praise' THEN 'Praise / Satisfaction'
    ELSE 'Concern / Attrition Driver' END AS kind FROM keywords))"""


def given_themes(spark, sf_dir) -> DataFrame:
    """Themes of the term-topic table of `GIVEN_TERMS`."""
    docs = st.add_tokens(derived.feedback_texts(spark, sf_dir), "text")
    counts = tm.term_counts(docs.withColumn("corpus", F.lit("all")), "doc_id")
    corpus = F.when(F.length("term") % 2 == 0, exits.PRAISE).otherwise(exits.CONCERN)
    totals = (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
        .withColumn("corpus", corpus)
    )
    masses = {
        f"topic_{topic}": F.expr(MASS.replace("topic", str(topic))).cast("double")
        for topic in range(4)
    }
    return exits.name_themes(tp.topic_keywords(totals.withColumns(masses)))


@query(
    "given_theme_keywords",
    f"WITH {GIVEN_TERMS} SELECT corpus, topic::INT AS topic, theme_type, theme_name,"
    " array_to_string(keywords, ', ') AS keywords FROM named",
)
def given_theme_keywords(spark, sf_dir):
    """Keywords and names of themes from a given term-topic table."""
    return given_themes(spark, sf_dir).withColumn("keywords", F.array_join("keywords", ", "))


GIVEN_MEMBERS = f"""WITH {GIVEN_TERMS},
given AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'praise' ELSE 'concern' END AS corpus,
    CASE WHEN doc_id % 5 = 0 THEN [0.25, 0.25, 0.25, 0.25]
      ELSE list_transform(range(4), lambda t: ((doc_id * (t + 3)) % 11) / 22) END AS mixture
  FROM documents),
members AS (
  SELECT doc_id, lang, source, corpus, topic, theme_name AS theme
  FROM given JOIN named USING (corpus) JOIN documents USING (doc_id)
  WHERE mixture[topic + 1] > 0.2)"""


def given_leavers(spark, sf_dir) -> DataFrame:
    """Documents as leavers, with themes assigned from given mixtures.

    Documents with an id divisible by 5 have no mixture: every topic is as likely.
    """
    documents = derived.table(spark, sf_dir, "documents").withColumn(
        lv.LEAVER_KEY, F.col("doc_id")
    )
    corpus = F.when(F.col("doc_id") % 3 == 0, exits.PRAISE).otherwise(exits.CONCERN)
    docs = documents.withColumn("corpus", corpus)
    shares = F.array(*[(F.col("doc_id") * (topic + 3)) % 11 / 22 for topic in range(4)])
    mixtures = docs.where(F.col("doc_id") % 5 != 0).select(
        "corpus", lv.LEAVER_KEY, shares.alias("mixture")
    )
    assigned = exits.assign_themes(docs, mixtures, given_themes(spark, sf_dir))
    return documents.join(assigned, lv.LEAVER_KEY, "left")


@query("given_theme_members", f"{GIVEN_MEMBERS} SELECT doc_id, corpus, topic::INT AS topic, theme FROM members")
def given_theme_members(spark, sf_dir):
    members = lv.theme_members(given_leavers(spark, sf_dir))
    return members.select("doc_id", "corpus", "topic", "theme")


@query(
    "given_theme_designations",
    f"""{GIVEN_MEMBERS}
    SELECT corpus, topic::INT AS topic, theme, source AS designation, count(*) AS leavers,
      round(count(*) / sum(count(*)) OVER (PARTITION BY corpus, topic) * 100, 9) AS share_pct
    FROM members GROUP BY corpus, topic, theme, source""",
)
def given_theme_designations(spark, sf_dir):
    tagged = given_leavers(spark, sf_dir).withColumnRenamed("source", "designation")
    return lv.theme_designations(tagged).withColumn("share_pct", F.round("share_pct", 9))
