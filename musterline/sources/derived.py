"""Attendance- and exit-shaped frames derived from the general test tables.

Sets of codes trip every special case of the cleaning and scoring rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Status codes that the derived rows are drawn from.
CODES = (
    "W*", "H*", "AR", "P", "W", "H", "CL", "EL", "PL", "BL",
    "SL", "ELec", "RH", "CO", "A", "LWP", "ABSENT", "ML", "PRL",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(divisor: int, *codes: str) -> str:
    """Position in CODES of the code at `event_id % divisor`; the last code for the rest."""
    whens = " ".join(
        f"WHEN {place} THEN {CODES.index(code)}" for place, code in enumerate(codes[:-1])
    )
    return f"CASE event_id % {divisor} {whens} ELSE {CODES.index(codes[-1])} END"


EVENT_CODE = f"""CASE event_type
    WHEN 'click' THEN {_pick(7, "W*", "H*", "AR", "P")}
    WHEN 'view' THEN {_pick(5, "W", "H", "P")}
    WHEN 'purchase' THEN {_pick(6, "CL", "EL", "PL", "ML", "PRL", "BL")}
    WHEN 'signup' THEN {_pick(4, "SL", "ELec", "RH", "CO")}
    ELSE {_pick(5, "A", "LWP", "ABSENT")} END"""


def _code_text(position: str) -> Column:
    listed = ", ".join(f"'{code}'" for code in CODES)
    return F.expr(f"element_at(array({listed}), {position} + 1)")


USER_COLUMNS = (
    "concat('E', lpad(CAST(user_id AS STRING), 5, '0')) AS employee_id",
    "concat('Emp ', CAST(user_id AS STRING)) AS employee_name",
    "CASE WHEN user_id % 17 = 0 THEN 'N/A' ELSE concat('MGR_', CAST(user_id % 12 AS STRING)) END"
    " AS reporting_manager",
    "concat('OU_', CAST(user_id % 3 AS STRING)) AS ou_name",
    "concat('FL_', CAST(user_id % 5 AS STRING)) AS functional_lead",
)
RELIEVING_DATE = "CASE WHEN user_id % 20 = 0 THEN DATE '2024-01-20' END AS relieving_date"


def _user_columns(*more: str) -> list[Column]:
    return [F.expr(text) for text in (*USER_COLUMNS, *more)]


def _day_code() -> Column:
    """First code of the day, with the last one as second half for every third user."""
    first, last = _code_text("first_code"), _code_text("last_code")
    return F.when(
        (F.col("user_id") % 3 == 0) & (F.col("first_code") != F.col("last_code")),
        F.concat_ws("/", first, last),
    ).otherwise(first)


def _user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last code per user and day, as positions: numbers merge in place."""
    return (
        table(spark, sf_dir, "events")
        .select(
            "user_id",
            F.col("ts").cast("date").alias("date"),
            "event_id",
            F.expr(EVENT_CODE).alias("code"),
        )
        .groupBy("user_id", "date")
        .agg(
            F.min_by("code", "event_id").alias("first_code"),
            F.max_by("code", "event_id").alias("last_code"),
        )
    )


def attendance_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long attendance of one month: a row per user and day of `events`."""
    return _user_days(spark, sf_dir).select(
        *_user_columns(RELIEVING_DATE), "date", _day_code().alias("raw_code")
    )


def attendance_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month as a wide grid with headers written the way people write them."""
    long = attendance_month(spark, sf_dir).withColumn(
        "header", F.date_format("date", "d-MMM-yy")
    )
    headers = [
        row["header"]
        for row in long.select("header", "date").distinct().orderBy("date").collect()
    ]
    wide = (
        long.groupBy(
            F.col("employee_id").alias(" Employee  ID "),
            F.col("employee_name").alias("Employee_Name"),
            F.col("reporting_manager").alias("REPORTING MANAGER"),
            F.col("ou_name").alias("OU Name"),
            F.col("functional_lead").alias("Functional Lead"),
            F.col("relieving_date").alias("Relieving_Date"),
        )
        .pivot("header", headers)
        .agg(F.first("raw_code"))
    )
    return wide


def attendance_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid with two rows per user, from even and odd events, numbered in `row_order`."""
    halves = (
        table(spark, sf_dir, "events")
        .select(
            "user_id",
            F.col("ts").cast("date").alias("date"),
            "event_id",
            (F.col("event_id") % 2).alias("half"),
            F.expr(EVENT_CODE).alias("code"),
        )
        .groupBy("user_id", "half", "date")
        .agg(F.min_by("code", "event_id").alias("first_code"))
        .withColumn("header", F.date_format("date", "d-MMM-yy"))
    )
    headers = [
        row["header"]
        for row in halves.select("header", "date").distinct().orderBy("date").collect()
    ]
    return (
        halves.select(
            "user_id",
            *_user_columns(),
            F.when(F.col("half") == 1, F.lit("20-Jan-2024")).alias("relieving_date"),
            "half",
            "header",
            _code_text("first_code").alias("raw_code"),
        )
        .groupBy(
            "employee_id",
            "employee_name",
            "reporting_manager",
            "ou_name",
            "functional_lead",
            "relieving_date",
            (F.col("user_id") * 2 + F.col("half")).alias("row_order"),
        )
        .pivot("header", headers)
        .agg(F.first("raw_code"))
    )


def attendance_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long attendance over many months, from orders and their customers."""
    priority, number = F.col("o_orderpriority"), F.col("o_orderkey")
    code = (
        F.when(priority == "1-URGENT", F.lit("ABSENT"))
        .when(priority == "2-HIGH", F.lit("CL"))
        .when(priority == "3-MEDIUM", F.lit("P/SL"))
        .when(priority == "4-NOT SPECIFIED", F.lit("P"))
        .otherwise(F.when(number % 6 == 0, F.lit("LWP")).otherwise(F.lit("P")))
    )
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("employee_id"),
            F.col("c_name").alias("employee_name"),
            F.col("c_mktsegment").alias("ou_name"),
            F.col("r_name").alias("functional_lead"),
            F.col("n_name").alias("reporting_manager"),
            F.lit(None).cast("date").alias("relieving_date"),
            F.col("o_orderdate").cast("date").alias("date"),
            code.alias("raw_code"),
        )
    )


def exit_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long exit answers from conversations, some identifiers shared or missing."""
    conv, turn = F.col("conv_id"), F.col("turn")
    k = F.when(conv % 50 == 49, conv - 1).otherwise(conv)

    def padded(number: Column, width: int) -> Column:
        return F.lpad(number.cast("string"), width, "0")

    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("2015-"), padded(k % 12 + 1, 2), F.lit("-01")).alias("DATEOFJOINING"),
        F.concat(F.lit("1980-01-"), padded(k % 28 + 1, 2)).alias("DOB"),
        F.when(k % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("GENDER"),
        F.element_at(
            F.array(*[F.lit(d) for d in ("Analyst", "Engineer", "Lead", "Manager")]),
            (k % 4 + 1).cast("int"),
        ).alias("DESIGNATION"),
        F.concat(F.lit("R"), padded(k, 8)).alias("RESIGNATIONLETTERDATE"),
        F.concat(F.lit("2024-"), padded(k % 12 + 1, 2), F.lit("-28")).alias(
            "ACTUALRELIEVINGDATE"
        ),
        F.when(k % 37 != 5, F.lit("Resignation")).alias("SEPARATIONTYPE"),
        F.element_at(
            F.array(*[F.lit(r) for r in ("Pay", "Growth", "Move")]), (k % 3 + 1).cast("int")
        ).alias("RESIGNATIONREASON"),
        F.concat(
            F.lit("What did the "), "role", F.lit(" say ("), turn.cast("string"), F.lit(")?")
        ).alias("QUESTION_DESC"),
        F.when((conv + turn) % 9 != 0, F.col("text")).alias("CHOICE_OR_COMMENTS"),
        (conv * 1000 + turn).alias("row_order"),
    )


def feedback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# Valences for invented texts, which no real lexicon matches. The second
# one leaves about as many texts positive as negative.
BY_LENGTH = "length(token) % 5 - 2"
BY_LETTERS = "(ascii(token) + ascii(right(token, 1)) + length(token)) % 7 - 3"


def token_lexicon(tokens: DataFrame, valence: str = BY_LENGTH) -> DataFrame:
    """A lexicon of every `token` of three letters or more."""
    return (
        tokens.where(F.length("token") >= 3)
        .select("token")
        .distinct()
        .withColumn("valence", F.expr(f"CAST({valence} AS DOUBLE)"))
    )


def token_lemmas(tokens: DataFrame) -> DataFrame:
    """A lemma table for invented texts: tokens ending in `s` lose it."""
    return (
        tokens.where(F.col("token").endswith("s"))
        .select("token")
        .distinct()
        .withColumn("lemma", F.expr("left(token, length(token) - 1)"))
    )
