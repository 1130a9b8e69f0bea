"""What a service around the analysis answers, as rows: a greeting, key checks, the options of a caller; and errors that are logged before they are raised."""

from __future__ import annotations

import functools
import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Names and codes of the languages (fixed values).
LANGUAGES = {"ENGLISH": "en", "FRENCH": "fr", "GERMAN": "de", "SPANISH": "es"}
GREETING = "Welcome to the text analytics service"


def greeting(spark: SparkSession) -> DataFrame:
    """One row: answer."""
    return spark.range(1).select(F.lit(GREETING).alias("answer"))


def validated(requests: DataFrame, api_keys: DataFrame) -> DataFrame:
    """All requests with valid (their key is known) and answer, a line of HTML. A null key is unknown; a key that is listed twice counts once."""
    known = api_keys.select("api_key").distinct().withColumn("_known", F.lit(True))
    valid = F.coalesce("_known", F.lit(False))
    answer = F.when(valid, "<h1>Valid API Key</h1>").otherwise("<h1>Invalid API Key</h1>")
    return requests.join(known, "api_key", "left").withColumn("valid", valid).withColumn("answer", answer).drop("_known")


def languages() -> Column:
    """The languages by name, as a map."""
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])


def initial(callers: DataFrame) -> DataFrame:
    """api_key and options, a JSON object of the languages and the caller's key."""
    return callers.select("api_key", F.to_json(F.struct(languages().alias("Language"), F.col("api_key").cast("string").alias("KEY"))).alias("options"))


def logged(function):
    """The function; what it raises is logged with its traceback and raised again."""

    @functools.wraps(function)
    def call(*args, **kwargs):
        try:
            return function(*args, **kwargs)
        except Exception:
            logging.getLogger("prosa").exception("%s failed", function.__qualname__)
            raise

    return call
