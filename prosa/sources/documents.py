"""Sources and sinks: documents from any Spark reader, results as JSON, Parquet or HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, path: str, kind: str = "parquet", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and text from Parquet, ORC, JSON lines, CSV with a header, or text files (each a document, its id a hash of its path)."""
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))
    options = {"header": True, "multiLine": True, "escape": '"'} if kind == "csv" else {}
    found = spark.read.format(kind).options(**options).load(path)
    return found.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def of_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Documents of an in-memory request, numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def valid_requests(requests: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Requests whose key is known."""
    return requests.join(api_keys.select(F.col("api_key")), "api_key", "left_semi")


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(column))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


#: Draws each list of the payload as a table.
DRAWING = (
    "var place = document.getElementById('dashboard');"
    "Object.keys(dashboard).forEach(function (name) {"
    "var rows = [].concat(dashboard[name]), table = document.createElement('table');"
    "table.createCaption().textContent = name;"
    "rows.forEach(function (row) { var line = table.insertRow(); Object.values(Object(row) === row ? row : [row]).forEach(function (x) { line.insertCell().textContent = x; }); });"
    "place.appendChild(table); });"
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_json() wrote."""
    return spark.read.schema(schema).json(path)


def dashboard_html(payload: DataFrame, styled: bool = True) -> DataFrame:
    """A page that lists its payload, one row per payload: the columns as JSON data, where no text can end the script, and a few lines that draw them."""
    head = '<link rel="stylesheet" type="text/css" href="dashboard.css">' if styled else ""
    return payload.select(F.concat(F.lit(f'{head}<div id="dashboard"></div><script>var dashboard = '), F.replace(F.to_json(F.struct("*")), F.lit("</"), F.lit("<\\/")), F.lit(f";{DRAWING}</script>")).alias("html"))
