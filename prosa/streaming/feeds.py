"""The same functions on streams: sentiment by window with a watermark, progress as keyed state, and whole analyses of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prosa.functions import text as T, words as W
from prosa.operators import sentiment
from prosa.plans import analysis, service
from prosa.sources.documents import valid_requests


def windowed_valence(stream: DataFrame, time: str = "ts", text: str = "text", late: str = "10 minutes", size: str = "5 minutes", lexicon: dict[str, float] | None = None) -> DataFrame:
    """start, n_words and mean valence of the lexicon words of each window. Stateless up to the aggregation; late rows go with the watermark."""
    known = F.broadcast(sentiment.lexicon_table(stream.sparkSession, lexicon or W.LEXICON).withColumnRenamed("base", "valence"))
    found = stream.withWatermark(time, late).select(time, F.explode(F.transform(T.words(text), F.lower)).alias("term")).join(known, "term")
    return found.groupBy(F.window(time, size)).agg(F.count("*").alias("n_words"), F.avg("valence").alias("valence")).select(F.col("window.start").alias("start"), "n_words", "valence")


def progress_state(stream: DataFrame, key: str, time: str, percentage: str, late: str = "10 minutes") -> DataFrame:
    """The last percentage of each key, kept as streaming state (update mode)."""
    return stream.withWatermark(time, late).groupBy(key).agg(F.max_by(percentage, time).alias("percentage"))


def answered(requests: DataFrame, api_keys: DataFrame, out: str, checkpoint: str, options: analysis.AnalysisOptions = analysis.AnalysisOptions(), **trigger):
    """Starts the stream that analyses requests (api_key, doc_id, text) with a known key, and returns its query.

    A micro-batch's reports are JSON under `out`/batch=N; one that is run again after a failure replaces its own folder, so each request is
    answered once. A request's doc_id is its own within the batch. trigger: as in writeStream.trigger().
    """

    @service.logged
    def answer(batch: DataFrame, number: int) -> None:
        own = valid_requests(batch, api_keys).select("doc_id", "text").persist()  # the parts of a report read it several times
        try:
            analysis.report(own, options).write.mode("overwrite").json(f"{out}/batch={number}")
        finally:
            own.unpersist()

    writer = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
