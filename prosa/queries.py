"""Every operator as a named query over whole tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from prosa.functions import text as T, words as W
from prosa.operators import language, legacy, normalize, progress, ranking, sentiment, similarity, topics
from prosa.plans import analysis, legacy_summary as legacy_summary_plan, service
from prosa.sources.documents import as_json, table, valid_requests as requests_with_key

#: Texts that exercise the rules; the driver's documents hold none of their words. Ids are negative.
RULE_TEXTS = (
    "the movie good", "is not good", "is really good", "is very good", "was really so good", "never so good", "good but bad", "movie GOOD movie", "the movie good!!!", "the movie bad!!!!!!!!!??", "three neutral words!!!",
    "the least good", "at least good", "it is kind of good", "this is a yeah right", "He was never this bad. But is it GREAT?? I really LOVE it!", "nothing here is wrong", "We can't say it isn't amazing. They're gonna win, aren't they?",
)
LEGACY_TEXTS = ("We hope this group of film-makers!!!! never re-unites. ever again. IT SUCKS???? >:( Here you go! :)", "#!% ok... (fine) so-so?! [x]")
QUERY = ("idiot", "worthless", "hand", "ha", "die")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def ruled(spark: SparkSession, folder: str) -> DataFrame:
    """The documents and the rule texts."""
    own = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(RULE_TEXTS)], "doc_id long, text string")
    return docs(spark, folder).unionByName(own)


def words_of(spark, folder):
    return sentiment.sentence_words(ruled(spark, folder))


def sentence_split(spark, folder):
    return normalize.sentences(docs(spark, folder))


def sentence_count(spark, folder):
    return docs(spark, folder).select("doc_id", F.size(T.sentences("text")).cast("long").alias("n_sentences"))


def partition_batches(spark, folder):
    return normalize.batches(docs(spark, folder)).select("doc_id", "part_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.md5("text").alias("digest"))


def token_explode(spark, folder):
    return normalize.tokens(docs(spark, folder))


def token_filter_chain(spark, folder):
    return normalize.raw_tokens(ruled(spark, folder)).where(normalize.passes("token"))


def token_annotations(spark, folder):
    flags = ("is_upper", "is_title", "is_stop", "like_number")
    return normalize.annotated(ruled(spark, folder)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("lemma").alias("n_lemmas"), *(F.sum(F.col(f).cast("long")).alias(f) for f in flags))


def min_length_filter(spark, folder):
    return normalize.tokens(docs(spark, folder)).where(F.length("token") >= 3).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def special_char_filter(spark, folder):
    return normalize.raw_tokens(docs(spark, folder)).where(~F.col("token").rlike(T.PUNCTUATION_OR_DIGIT)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def stopword_anti(spark, folder):
    known = spark.createDataFrame([(x,) for own in W.STOPWORDS.values() for x in own], "low string").distinct()
    kept = normalize.tokens(docs(spark, folder)).withColumn("low", F.lower("token")).join(F.broadcast(known), "low", "left_anti")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def vocab_semi(spark, folder):
    all_docs = docs(spark, folder)
    kept = normalize.tokens(all_docs).withColumn("term", F.lower("token")).join(normalize.vocabulary(all_docs, 20), "term", "left_semi")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def min_tokens_sentences(spark, folder):
    return normalize.content_sentences(docs(spark, folder)).select("doc_id", "sent_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def case_flags(spark, folder):
    count = lambda c: F.sum(c.cast("long"))
    return normalize.tokens(ruled(spark, folder)).groupBy("doc_id").agg(count(T.is_upper("token")).alias("upper"), count(F.lower("token") == F.col("token")).alias("lower"), F.count("*").alias("n_tokens"))


def case_handling(spark, folder):
    base = normalize.tokens(ruled(spark, folder)).withColumn("base", normalize.lemma("token"))
    return base.groupBy(normalize.word_class("token").alias("class")).agg(F.count("*").alias("n_tokens"), F.countDistinct(normalize.cased("token", "base")).alias("n_forms"))


def repeat_squeeze(spark, folder):
    return normalize.tokens(docs(spark, folder)).select(F.lower("token").alias("term")).distinct().select("term", T.squeeze_once("term").alias("squeezed")).where("term <> squeezed")


def levenshtein_suggest(spark, folder):
    known = normalize.vocabulary(docs(spark, folder), 50)
    asked = normalize.vocabulary(table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), 1)
    return normalize.suggestions(asked.join(known, "term", "left_anti"), known)


def html_unescape_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(normalize.unescape_html("html")).alias("digest"))


def html_strip_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(T.collapse(T.strip_tags("html"))).alias("digest"))


def contraction_expand(spark, folder):
    return ruled(spark, folder).select("doc_id", F.md5(T.expand_contractions("text")).alias("digest"))


def legacy_docs(spark, folder):
    own = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(LEGACY_TEXTS)], "doc_id long, text string")
    return docs(spark, folder).unionByName(own)


def punct_emphasis(spark, folder):
    tokens = normalize.raw_tokens(legacy_docs(spark, folder)).where(F.col("token").rlike("[?!]$"))
    return tokens.select("doc_id", "sent_id", "pos", "token", T.emphasis("token", 4).alias("shaped"))


def legacy_special_tokens(spark, folder):
    return normalize.raw_tokens(legacy_docs(spark, folder)).where(T.special_only("token")).select("doc_id", "sent_id", "pos", "token")


def legacy_normalize(spark, folder):
    options = legacy.LegacyOptions(keep_case=True, keep_stopwords=True).with_emphasis(4)
    return legacy.normalized(legacy_docs(spark, folder), options).select("doc_id", "sent_id", F.array_join("tokens", " ").alias("tokens"))


def append_union(spark, folder):
    first = docs(spark, folder)
    second = first.select("doc_id", F.lit("Here you go! :) More follows.").alias("text"))
    options = legacy.LegacyOptions(keep_special=True, keep_stopwords=True)
    return legacy.append(first, second, options).groupBy("doc_id").agg(F.max("sent_id").cast("long").alias("last_id"), F.count("*").alias("n_sentences"), F.max_by("raw", "sent_id").alias("last"))


def lexicon_join(spark, folder):
    """Flagship: valence words by document through a broadcast join."""
    known = F.broadcast(sentiment.lexicon_table(spark, W.LEXICON))
    found = normalize.tokens(ruled(spark, folder)).join(known, F.lower("token") == F.col("term"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.round(F.sum("base"), 4).alias("valence"), F.round(F.avg("base"), 6).alias("mean_valence"))


def sentence_valence(spark, folder):
    own = sentiment.sentence_valences(words_of(spark, folder))
    return own.select("doc_id", "sent_id", F.round(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x["v"]), 6).alias("valence")).where("valence <> 0")


def word_valence(spark, folder):
    return sentiment.valences(words_of(spark, folder)).select("doc_id", "sent_id", "pos", F.lower("word").alias("term"), F.round("valence", 6).alias("valence"))


def cap_differential(spark, folder):
    return words_of(spark, folder).where("caps").select("doc_id", "sent_id")


def booster_lookback(spark, folder):
    found = sentiment.hits(words_of(spark, folder), W.LEXICON)
    pulled = sum(F.coalesce(sentiment.booster(F.col(f"b{k}")), F.lit(0.0)) for k in (1, 2, 3))
    return found.select("doc_id", "sent_id", "pos", F.round(pulled, 6).alias("boost")).where("boost <> 0")


def negation_lookback(spark, folder):
    found = sentiment.hits(words_of(spark, folder), W.LEXICON)
    n = sum(sentiment.negated(F.col(f"b{k}")).cast("long") for k in (1, 2, 3))
    return found.select("doc_id", "sent_id", "pos", n.alias("n_negations")).where("n_negations > 0")


def idiom_match(spark, folder):
    pair = normalize.tokens(ruled(spark, folder)).withColumn("following", F.lead("token").over(Window.partitionBy("doc_id", "sent_id").orderBy("pos")))
    return pair.where(F.concat_ws(" ", "token", "following").isin(list(W.IDIOMS))).select("doc_id", "sent_id", "pos", F.concat_ws(" ", "token", "following").alias("idiom"))


def but_rule(spark, folder):
    return words_of(spark, folder).select("doc_id", "sent_id", sentiment.but_position("words").cast("long").alias("at")).where("at is not null")


def punct_amplifier(spark, folder):
    return words_of(spark, folder).select("doc_id", "sent_id", F.round(T.punctuation_emphasis("raw"), 6).alias("amp")).where("amp > 0")


def sentence_polarity(spark, folder):
    return sentiment.polarity(words_of(spark, folder))


def document_sentiment(spark, folder):
    return sentiment.document_sentiment(words_of(spark, folder))


def sentiment_labels(spark, folder):
    named = sentiment.polarity(words_of(spark, folder)).select(sentiment.label("compound").alias("label"))
    return named.groupBy("label").agg(F.count("*").alias("n_sentences"))


def descriptors(spark, folder):
    """All descriptors of every sentence, the neutral ones too; sentences without a valence are no exception."""
    own = sentiment.descriptors(words_of(spark, folder))
    return own.select("doc_id", "sent_id", *(F.array_join(side, "|").alias(side) for side in ("pos", "neg", "neu")), F.size("neu").cast("long").alias("n_neu"))


def conversation_sentiment(spark, folder):
    turns = table(spark, folder, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text", "conv_id", "role")
    scored = sentiment.document_sentiment(sentiment.sentence_words(turns.select("doc_id", "text")))
    return turns.join(scored, "doc_id").groupBy("conv_id", "role").agg(F.count("*").alias("n_turns"), T.rounded(T.mean_of_digits("compound", 6), 4).alias("compound"))


def content(spark, folder):
    return normalize.content_sentences(docs(spark, folder))


def weights(spark, folder):
    return similarity.document_weights(docs(spark, folder))


def term_frequency(spark, folder):
    return similarity.term_frequency(content(spark, folder))


def collection_idf(spark, folder):
    return weights(spark, folder).select("doc_id", "term", F.round("collection_idf", 6).alias("idf")).distinct()


def classic_idf(spark, folder):
    return weights(spark, folder).select("doc_id", "term", F.round("classic_idf", 6).alias("idf")).distinct()


def tfidf_weights(spark, folder):
    return weights(spark, folder).select("doc_id", "sent_id", "term", F.round(F.col("tf") * F.col("collection_idf"), 6).alias("weight"))


def sentence_norms(spark, folder):
    w = F.col("tf") * F.col("collection_idf")
    return weights(spark, folder).groupBy("doc_id", "sent_id").agg(F.round(F.sqrt(F.sum(w * w)), 6).alias("norm"))


def cosine_pairs(spark, folder):
    return similarity.pairs(weights(spark, folder)).select("doc_id", "i", "j", F.round("sim", 6).alias("sim"))


def cosine_threshold_edges(spark, folder):
    return similarity.edges(similarity.pairs(weights(spark, folder)))


def legacy_cosine_2dp(spark, folder):
    found = similarity.pairs(weights(spark, folder), "classic_idf")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.round(F.sum("sim"), 4).alias("total"), F.sum((F.round("sim", 2) > 0.1).cast("long")).alias("n_above"))


def adjacency(spark, folder):
    own = weights(spark, folder)
    return similarity.adjacency(own, similarity.pairs(own))


def row_stochastic(spark, folder):
    return similarity.row_stochastic(adjacency(spark, folder)).select("doc_id", "i", "j", F.round("p", 6).alias("p"))


def degree_centrality(spark, folder):
    return similarity.degrees(adjacency(spark, folder))


def ranked(spark, folder, mode):
    """Scores rounded to 6 digits."""
    own = similarity.together(content(spark, folder))
    idf = "classic_idf" if mode.startswith("legacy") else "collection_idf"
    return ranking.rank(own, similarity.pairs(weights(spark, folder), idf), mode).withColumn("score", F.round("score", 6))


def lexrank_scores(spark, folder):
    return ranked(spark, folder, "lexrank")


def legacy_lexrank(spark, folder):
    return ranked(spark, folder, "legacy_lexrank")


def divrank_scores(spark, folder):
    return ranked(spark, folder, "divrank")


def legacy_divrank(spark, folder):
    return ranked(spark, folder, "legacy_divrank")


def grasshopper_scores(spark, folder):
    return ranked(spark, folder, "grasshopper")


def legacy_grasshopper(spark, folder):
    return ranked(spark, folder, "legacy_grasshopper")


def lexrank_summary(spark, folder):
    return analysis.summaries(docs(spark, folder))


def by_degree(spark, folder):
    found = similarity.degrees(adjacency(spark, folder))
    return content(spark, folder).select("doc_id", "sent_id").join(found, ["doc_id", "sent_id"], "left").select("doc_id", "sent_id", F.coalesce("degree", F.lit(0)).cast("double").alias("score"))


def topk_summary(spark, folder):
    own = content(spark, folder).select("doc_id", "sent_id", "raw")
    return ranking.top_k(own, by_degree(spark, folder), 3).select("doc_id", F.md5("summary").alias("digest"))


def topk_summary_reversed(spark, folder):
    own = content(spark, folder).select("doc_id", "sent_id", "raw")
    return ranking.top_k(own, by_degree(spark, folder), 3, descending=True).select("doc_id", F.md5("summary").alias("digest"))


def legacy_summary(spark, folder):
    return legacy_summary_plan.summaries(docs(spark, folder), legacy_summary_plan.LegacySummaryOptions("lexrank", "mmr", QUERY, 3))


def to_query(spark, folder):
    """The share of a sentence's distinct content words that are in the query."""
    share = F.size(F.array_intersect("tokens", F.array(*map(F.lit, QUERY)))) / F.size(F.array_distinct("tokens"))
    return content(spark, folder).select("doc_id", "sent_id", share.alias("sim_q"))


def mmr_rerank(spark, folder):
    found = ranking.mmr(by_degree(spark, folder), similarity.pairs(weights(spark, folder)), to_query(spark, folder))
    return found.select("doc_id", "sent_id", F.round("mmr", 5).alias("mmr"))


def query_similarity_filter(spark, folder):
    return normalize.query_filter(docs(spark, folder), list(QUERY), 0.1).select("doc_id", "sent_id", F.round("cosine", 5).alias("cosine"))


def embedding_query_topk(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    asked = vectors.where("vec_id = 0").limit(1).select(F.col("e").alias("q"))  # one vector
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.join(F.broadcast(asked)).select("vec_id", F.round(F.try_divide(dot("e", "q"), F.sqrt(dot("e", "e")) * F.sqrt(dot("q", "q"))), 5).alias("cosine"))
    return scored.orderBy(F.desc("cosine"), "vec_id").limit(20)


def bigram_scores(spark, folder):
    return topics.phrase_scores(content(spark, folder)).select("a", "b", "n_ab", F.round("score", 5).alias("score"))


def phrase_merge(spark, folder):
    own = content(spark, folder)
    return topics.merged(own, topics.phrase_scores(own))


def bow_counts(spark, folder):
    return topics.bag_of_words(phrase_merge(spark, folder))


def fitted(spark, folder):
    return topics.fit_phrases(content(spark, folder))


def lda_topics(spark, folder):
    return topics.topic_shares(spark, fitted(spark, folder))


def topic_terms(spark, folder):
    return topics.topic_terms(spark, fitted(spark, folder))


def topic_relevance(spark, folder):
    return topics.relevance(spark, fitted(spark, folder))


def topic_token_table(spark, folder):
    return topics.token_table(spark, fitted(spark, folder))


def topic_distance(spark, folder):
    return topics.topic_map(spark, fitted(spark, folder))


def topic_dashboard(spark, folder):
    return analysis.dashboard(docs(spark, folder))


def language_vote(spark, folder):
    return language.detect(docs(spark, folder)).select("doc_id", "detected", F.round("confidence", 4).alias("confidence"))


def language_accuracy(spark, folder):
    known = language.detect(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return known.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.col("detected") == F.col("lang"), F.lit(False)).cast("long")).alias("n_right"))


def language_filter(spark, folder):
    return language.is_language(docs(spark, folder), "en", 0.9).select("doc_id")


def conditional_translation(spark, folder):
    words = {"und": "and", "der": "the", "die": "the", "das": "the", "nicht": "not", "ist": "is"}
    found = language.translate_if(docs(spark, folder), "de", lambda x: language.translate_words(x, words), 0.9)
    return found.where("translated is not null").select("doc_id", F.md5("translated").alias("digest"))


def char_batches(spark, folder):
    return language.char_batches(docs(spark, folder)).select("doc_id", "batch", F.length("text").alias("n_chars"))


def progress_latest(spark, folder):
    return progress.latest(table(spark, folder, "events"), "user_id", "ts", "value", "event_id").select("user_id", "at", F.round("percentage", 6).alias("percentage"))


def progress_reset(spark, folder):
    events = table(spark, folder, "events")
    state = progress.latest(events, "user_id", "ts", "value", "event_id")
    return progress.reset(state, events.where("event_type = 'error'").select("user_id"), "user_id").select("user_id", "at", F.round("percentage", 6).alias("percentage"))


def progress_read(spark, folder):
    """The percentage of every customer as a caller."""
    state = progress.latest(table(spark, folder, "events"), "user_id", "ts", "value", "event_id")
    callers = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    return progress.read(state, callers, "user_id").select("user_id", F.round("percentage", 6).alias("percentage"))


def valid_requests(spark, folder):
    """Requests (events) whose key belongs to a customer in credit."""
    requests = table(spark, folder, "events").select("event_id", F.col("user_id").alias("api_key"))
    keys = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("api_key"))
    return requests_with_key(requests, keys).select("event_id", "api_key")


def bigram_term_frequency(spark, folder):
    return similarity.term_frequency(content(spark, folder), 2).groupBy("term").agg(F.sum("tf").alias("n")).where("n > 1")


def legacy_normalize_defaults(spark, folder):
    return legacy.normalized(legacy_docs(spark, folder)).select("doc_id", "sent_id", F.array_join("tokens", " ").alias("tokens"))


def normalize_chain(spark, folder):
    return normalize.normalized(ruled(spark, folder)).select("doc_id", "sent_id", F.array_join("tokens", " ").alias("tokens"))


def pooled_translation(spark, folder):
    words = {"und": "and", "der": "the", "die": "the", "das": "the", "nicht": "not", "ist": "is"}

    def translate(texts: list[str]) -> list[str]:
        return [" ".join(words.get(w.lower(), w) for w in text.split(" ")) for text in texts]

    batches = language.char_batches(docs(spark, folder))
    return language.translate_batches(batches, translate).select("doc_id", "batch", F.md5("text").alias("digest"))


def progress_schedule(spark, folder):
    return progress.schedule(spark, 7)


def analysis_report(spark, folder):
    return analysis.report(docs(spark, folder))


def analysis_json(spark, folder):
    return as_json(analysis.report(docs(spark, folder)))


def run_metrics(spark, folder):
    return analysis.run_metrics(docs(spark, folder))


def language_options(spark, folder):
    """The constant that the service publishes: names and codes of the languages."""
    return spark.range(1).select(F.explode(service.languages()).alias("name", "code"))


def service_greeting(spark, folder):
    return service.greeting(spark)


def init_options(spark, folder):
    """What every customer as a caller is told at first."""
    return service.initial(table(spark, folder, "customer").select(F.col("c_custkey").alias("api_key")))


def validate_answers(spark, folder):
    """Every request (event) with the answer on its key, known if its customer is in credit."""
    requests = table(spark, folder, "events").select("event_id", F.col("user_id").alias("api_key"))
    keys = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("api_key"))
    return service.validated(requests, keys).select("event_id", "valid", "answer")


def shown_documents(spark, folder):
    return normalize.shown(docs(spark, folder)).select("doc_id", F.md5("shown").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, sentence_count, partition_batches, token_explode, token_annotations, token_filter_chain, min_length_filter, special_char_filter, stopword_anti, vocab_semi, min_tokens_sentences, case_flags, case_handling, repeat_squeeze,
        levenshtein_suggest, html_unescape_pages, html_strip_pages, contraction_expand, punct_emphasis, legacy_special_tokens, legacy_normalize, append_union, lexicon_join, sentence_valence, word_valence, cap_differential,
        booster_lookback, negation_lookback, idiom_match, but_rule, punct_amplifier, sentence_polarity, document_sentiment, sentiment_labels, descriptors, conversation_sentiment, term_frequency, collection_idf, classic_idf,
        tfidf_weights, sentence_norms, cosine_pairs, cosine_threshold_edges, legacy_cosine_2dp, row_stochastic, degree_centrality, lexrank_scores, lexrank_summary, topk_summary, topk_summary_reversed, legacy_lexrank, legacy_summary,
        divrank_scores, legacy_divrank, grasshopper_scores, legacy_grasshopper, mmr_rerank, query_similarity_filter, embedding_query_topk, bigram_scores, phrase_merge, bow_counts, lda_topics, topic_terms, topic_relevance,
        topic_token_table, topic_distance, topic_dashboard, language_vote, language_accuracy, language_filter, conditional_translation, char_batches, progress_latest, progress_reset, progress_schedule, analysis_report,
        analysis_json, run_metrics, language_options, progress_read, valid_requests, bigram_term_frequency, legacy_normalize_defaults, normalize_chain, pooled_translation,
        service_greeting, init_options, validate_answers, shown_documents,
    )
}
