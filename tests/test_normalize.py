import pytest
from pyspark.sql import functions as F

from prosa.functions import text as T
from prosa.operators import language, legacy, normalize, progress
from prosa.plans import analysis


def one(spark, column, *values):
    kind = "array<string>" if isinstance(values[0], list) else "string"
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column).collect()]


def test_sentences_and_batches(spark):
    docs = spark.createDataFrame([(1, "One.  Two!\nThree? four"), (2, " ".join(f"S{i}." for i in range(401))), (3, ""), (4, None)], "doc_id long, text string")
    assert [r.raw for r in normalize.sentences(docs).where("doc_id = 1").collect()] == ["One.", "Two!", "Three?", "four"]
    sizes = [(r.doc_id, r.n_sentences) for r in normalize.batches(docs).orderBy("doc_id", "part_id").collect()]
    assert sizes == [(1, 4), (2, 200), (2, 200), (2, 1)]


def test_small_functions(spark):
    assert one(spark, T.squeeze_once("x"), "coooool", "letter", "abc") == ["cooool", "leter", "abc"]
    assert one(spark, T.emphasis("x", 4), "SUCKS????", "re-unites.", "ok!!") == ["SUCKS????", "re-unites", "ok"]
    assert one(spark, T.expand_contractions("x"), "I can't've gone, isn't it? Gonna") == ["I cannot have gone, is not it? going to"]
    assert one(spark, T.is_upper("x"), "AB", "Ab", "12") == [True, False, False]
    assert one(spark, normalize.lemma("x"), "cities", "dogs", "pass", "walked", "Walking") == ["city", "dog", "pass", "walk", "walk"]
    assert one(spark, normalize.unescape_html("x"), "a &lt;b&gt; &amp;amp; &#65;&eacute;", None) == ["a <b> &amp; Aé", None]
    assert one(spark, normalize.corrected("x", ["cool"]), "cooool", "zzz") == ["cool", "zzz"]


def test_filter_chain(spark):
    kept = lambda *words: [w for w, k in zip(words, one(spark, normalize.passes("x"), *words)) if k]
    assert kept("movie", "it's", "x", "seven", "a1", "the", "http://a", "Great") == ["movie", "Great"]


def test_legacy_golden(spark):
    text = "I hope this group of film-makers!!!! never re-unites. ever again. IT SUCKS???? >:("
    options = legacy.LegacyOptions(keep_case=True, keep_stopwords=True).with_emphasis(4)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    more = spark.createDataFrame([(1, "Here you go! :)")], "doc_id long, text string")
    got = [r.tokens for r in legacy.append(docs, more, options).orderBy("sent_id").collect()]
    assert got == [["hope", "this", "group", "of", "film-makers!!!!"], ["never", "re-unites"], ["ever", "again"], ["IT", "SUCKS????"], [">:("], ["Here", "you", "go"], [":)"]]


def test_legacy_classes_and_spelling(spark):
    docs = spark.createDataFrame([(1, "The dogs quickly walked coool home.")], "doc_id long, text string")
    tokens = lambda o: legacy.normalized(docs, o).first().tokens
    assert tokens(legacy.LegacyOptions().with_pos_filter(True)) == ["dog", "quickly", "walk", "coool", "home"]
    assert tokens(legacy.LegacyOptions(correct_spelling=True, vocabulary=("cool", "home", "dogs")))[3:] == ["cool", "home"]


def test_legacy_couplings():
    options = legacy.LegacyOptions()
    assert options.with_contractions(False).keep_stopwords
    assert options.with_pos_filter(True).keep_special
    assert not options.with_pos_filter(True).with_emphasis(2).pos_filter


def test_suggestions_meet_every_pair_within_two_edits(spark):
    known, asked = ["kitten", "sitting", "mitten", "a", "ab"], ["kiten", "sittin", "b", "xyzxyz", "abc"]
    make = lambda words: spark.createDataFrame([(w,) for w in words], "term string")
    got = {r.term: (r.suggestion, r.edits) for r in normalize.suggestions(make(asked), make(known)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {a: min((distance(a, k), k) for k in known) for a in asked}
    assert got == {a: (k, d) for a, (d, k) in want.items() if d <= 2}


def test_query_filter(spark):
    docs = spark.createDataFrame([(1, "good film plot here. nothing else matters much. ")], "doc_id long, text string")
    got = normalize.query_filter(docs, ["good", "film"], 0.5).collect()
    assert [r.sent_id for r in got] == [0] and got[0].cosine == pytest.approx(2 / (4**0.5 * 2**0.5) if len(got[0].tokens) == 4 else 2 / (3**0.5 * 2**0.5), abs=1e-6)


def test_language(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "der Hund und die Katze"), (3, "xyz"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.detected for r in language.detect(docs).collect()} == {1: "en", 2: "de", 3: None, 4: None}
    translated = language.translate_if(docs, "de", lambda x: language.translate_words(x, {"hund": "dog", "und": "and"}), 0.5).where("doc_id = 2").first()
    assert translated.translated == "der dog and die Katze"


def test_char_batches(spark):
    text = " ".join(["word"] * 10)
    got = [r.text for r in language.char_batches(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), 14).collect()]
    assert got == [" word word word"] * 3 + [" word"]


def test_progress(spark):
    got = [r.percentage for r in progress.schedule(spark, 3).orderBy("step").collect()]
    assert got[:5] == [10.0, 15.0, 30.0, 37.5, 45.0] and got[-1] == 100.0 and len(got) == 16
    state = spark.createDataFrame([("a", "x", 40.0)], "ip string, at string, percentage double")
    asked = spark.createDataFrame([("a",), ("b",)], "ip string")
    assert {tuple(r) for r in progress.read(state, asked, "ip").collect()} == {("a", 40.0), ("b", 0.0)}
    assert progress.reset(state, asked, "ip").first().percentage == 0.0


def test_report(spark):
    docs = spark.createDataFrame([(1, "The good film was a great joy today. A bad plot hurts every film today. Another good plot."), (2, "Hi."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in analysis.report(docs, analysis.AnalysisOptions(summary_length=1)).collect()}
    assert set(got) == {1, 2, 3} and got[1].label and got[1].summary and got[3].compound is None
    assert analysis.run_metrics(docs).first().documents == 3


def test_corrections_need_no_bound(spark):
    df = spark.createDataFrame([("goooooooooooood",), ("xxyyzz",), ("Good",), ("",), (None,)], "w string")
    assert [r[0] for r in df.select(normalize.corrected("w", ["good"])).collect()] == ["good", "xxyyzz", "good", "", None]


def test_settings_of_the_normaliser(spark):
    docs = spark.createDataFrame([(1, "The Dogs quickly watched 3 beautifull gardens, wow!")], "doc_id long, text string")
    tokens = lambda **o: normalize.normalized(docs, normalize.NormalizeOptions(**o), ("beautiful",)).first().tokens
    assert tokens() == ["dog", "quickly", "watch", "beautiful", "garden", "wow"]
    assert tokens(keep_case=True)[0] == "Dog" and "," in tokens(special_char=True) and tokens(keep_stopwords=True)[0] == "the"
    assert tokens(spell_threshold=20)[3] == "beautifull"
