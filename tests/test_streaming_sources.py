import datetime
import json

import pytest
from pyspark.sql import functions as F

from prosa.functions import show
from prosa.operators import legacy, normalize, topics
from prosa.plans import service
from prosa.sources import documents
from prosa.streaming import feeds


def test_windowed_valence_and_progress(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    rows = [(at(0), "u", "a good day", 10.0), (at(1), "u", "a bad day", 20.0), (at(7), "v", "good", 30.0)]
    spark.createDataFrame(rows, "ts timestamp, key string, text string, pct double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, key string, text string, pct double").parquet(str(tmp_path / "in"))
    for frame, mode, name in ((feeds.windowed_valence(stream), "complete", "valence"), (feeds.progress_state(stream, "key", "ts", "pct"), "update", "progress")):
        query = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(r.n_words for r in spark.table("valence").collect()) == [1, 2]
    assert {r.key: r.percentage for r in spark.table("progress").collect()} == {"u": 20.0, "v": 30.0}


def test_sources_and_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'a "quoted", text'), (2, "b")], "doc_id long, text string")
    for kind in ("parquet", "json", "orc", "csv"):
        writer = frame.write.option("header", True).option("escape", '"')
        writer.format(kind).save(str(tmp_path / kind))
        assert sorted(map(tuple, documents.documents(spark, str(tmp_path / kind), kind).collect())) == [(1, 'a "quoted", text'), (2, "b")]
    (tmp_path / "x.txt").write_text("whole\ntext")
    assert documents.documents(spark, str(tmp_path / "x.txt"), "text").first().text == "whole\ntext"
    documents.write_json(frame, str(tmp_path / "out"))
    assert documents.as_json(frame).where(F.col("json").contains('"doc_id":2')).count() == 1
    assert "dashboard" in documents.dashboard_html(frame).first().html
    keys = spark.createDataFrame([("k",)], "api_key string")
    asked = spark.createDataFrame([("k", 1), ("x", 2)], "api_key string, n int")
    assert documents.valid_requests(asked, keys).count() == 1
    assert documents.of_texts(spark, ["a", "b"]).count() == 2


def test_answers_to_callers(spark):
    keys = spark.createDataFrame([("k",), ("k",), (None,)], "api_key string")
    asked = spark.createDataFrame([("k", 1), ("x", 2), (None, 3), ("k", 4)], "api_key string, n int")
    got = {r.n: (r.valid, "Invalid" in r.answer) for r in service.validated(asked, keys).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, True), 4: (True, False)}
    assert service.validated(asked.limit(0), keys).count() == 0 and not service.validated(asked, keys.limit(0)).where("valid").count()
    told = json.loads(service.initial(keys.limit(1)).first().options)
    assert told == {"Language": service.LANGUAGES, "KEY": "k"} and service.greeting(spark).first().answer == service.GREETING


def test_errors_are_logged_and_raised(caplog):
    @service.logged
    def divide(x):
        """Says why."""
        return 1 / x

    assert divide(2) == 0.5 and divide.__doc__ == "Says why."
    with pytest.raises(ZeroDivisionError):
        divide(0)
    assert "divide failed" in caplog.text and "ZeroDivisionError" in caplog.text


def test_a_stream_of_requests_is_answered_once(spark, tmp_path):
    schema = "api_key string, doc_id long, text string"
    keys = spark.createDataFrame([("k",)], "api_key string")
    text = "The people are very happy about great music. A terrible storm destroyed large buildings yesterday."
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def ask(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = feeds.answered(spark.readStream.schema(schema).parquet(source), keys, out, checkpoint, availableNow=True)
        query.awaitTermination()

    ask([("k", 1, text), ("x", 2, text), (None, 3, text)])
    ask([("k", 4, None), ("k", 5, text)])
    got = {r.doc_id: r for r in spark.read.json(out).collect()}
    assert sorted(got) == [1, 4, 5] and got[1].summary == got[5].summary and got[1].batch != got[5].batch
    assert not list((tmp_path / "out").glob("batch=2"))


def test_texts_for_people(spark):
    rows = [(1, "Seven quick foxes jumped gladly. No. Brown dogs slept under trees."), (2, None), (3, "")]
    got = {r.doc_id: r.shown for r in normalize.shown(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = {r.sent_id: ", ".join(r.tokens) for r in normalize.content_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == f"Normalized Sentences\n\t[{own[0]}]\n\t[{own[2]}]\nTokens\n\t[{own[0]}, {own[2]}]"
    assert got[2] == got[3] == "Normalized Sentences\nTokens\n\t[]"
    told = show.settings_text(topics.TopicOptions(topics=3)).split("\n")
    assert told[0].startswith("Numbers: topics = 3") and told[1:] == ["On:", "Off:", "Others:"]
    told = show.settings_text(legacy.LegacyOptions(keep_case=True))
    assert "keep_case" in told.split("\n")[1] and "keep_stopwords" in told.split("\n")[2]
