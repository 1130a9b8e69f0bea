"""Sentences, tokens and their filters: everything is a narrow transformation up to explode, so no step shuffles."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from prosa.functions import text as T, words as W
from prosa.functions.show import sentences_text


@dataclass(frozen=True)
class NormalizeOptions:
    min_length: int = 2
    min_tokens: int = 2
    stopwords: tuple[str, ...] = tuple(W.STOPWORDS["en"])
    keep_stopwords: bool = False
    keep_case: bool = False
    special_char: bool = False
    spell_threshold: int = 4

    def classes(self) -> tuple[str, ...]:
        """Word classes that pass: more with special characters and with stop words."""
        return W.BASE_CLASSES + (W.OTHER_CLASSES if self.special_char else ()) + (tuple(dict.fromkeys(W.OPEN_CLASSES + W.CLOSED_CLASSES)) if self.keep_stopwords else ())


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id and raw; a null text has no sentences."""
    return docs.select("doc_id", F.posexplode(T.sentences("text")).alias("sent_id", "raw"))


def batches(docs: DataFrame, size: int = 200) -> DataFrame:
    """doc_id, part_id, n_sentences and text: the sentences of a document in batches. Each batch is a slice of the document's own array, so nothing is shuffled."""
    whole = docs.select("doc_id", T.sentences("text").alias("all")).where(F.size("all") > 0)
    cut = whole.select("doc_id", "all", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / size).cast("int"))).alias("part_id"))
    own = F.slice("all", F.col("part_id") * size + 1, F.lit(size))
    return cut.select("doc_id", "part_id", F.size(own).alias("n_sentences"), F.array_join(own, " ").alias("text"))


@F.pandas_udf(StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    """Character references decoded once, by the full HTML 5 table; Spark has no function for it."""
    import html

    return texts.map(html.unescape, na_action="ignore")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id, pos and token."""
    return sentences(docs).select("doc_id", "sent_id", F.posexplode(T.words("raw")).alias("pos", "token"))


def raw_tokens(docs: DataFrame) -> DataFrame:
    """Like tokens(), cut at white space only."""
    return sentences(docs).select("doc_id", "sent_id", F.posexplode(F.split("raw", " ")).alias("pos", "token"))


def annotated(docs: DataFrame) -> DataFrame:
    """tokens() with the properties that filters read: lower, lemma, class, and flags for case, stop words and numbers."""
    flags = {"is_upper": T.is_upper("token"), "is_title": T.is_title("token"), "is_stop": F.lower("token").isin(W.STOPWORDS["en"]), "like_number": F.lower("token").isin(W.NUMBER_WORDS)}
    return tokens(docs).select("*", F.lower("token").alias("lower"), lemma("token").alias("lemma"), word_class("token").alias("class"), *(c.alias(name) for name, c in flags.items()))


def passes(token: Column | str, options: NormalizeOptions = NormalizeOptions()) -> Column:
    """The filter chain: punctuation or digits, length, number words, addresses, stop words."""
    token = T.col(token)
    kept = ~token.rlike(T.PUNCTUATION_OR_DIGIT) & (F.length(token) >= options.min_length) & ~F.lower(token).isin(W.NUMBER_WORDS) & ~token.rlike(T.URL_OR_EMAIL)
    return kept if options.keep_stopwords else kept & ~F.lower(token).isin(list(options.stopwords))


def word_class(token: Column | str) -> Column:
    """An approximate class from word lists and suffixes."""
    low = F.lower(T.col(token))
    return (
        F.when(T.col(token).rlike(f"^{T.PUNCTUATION}+$"), "PUNCT").when(low.isin(W.NUMBER_WORDS) | low.rlike(r"^\d"), "NUM").when(low.isin(W.STOPWORDS["en"]), "DET").when(low.rlike("ly$"), "ADV")
        .when(low.rlike("(ous|ful|ive|able|ible|al|ic|less|ish)$"), "ADJ").when(low.rlike("(ing|ed|ize|ise|ify)$"), "VERB").when(T.is_title(token), "PROPN").otherwise("NOUN")
    )


def lemma(token: Column | str) -> Column:
    """Plural and verb endings removed by rule; pass a table of lemmas for more."""
    low = F.lower(T.col(token))
    return (
        F.when(low.rlike("[^aeiou]ies$"), F.regexp_replace(low, "ies$", "y")).when(low.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(low, "es$", "")).when(low.rlike("[^s]s$") & (F.length(low) > 3), F.regexp_replace(low, "s$", ""))
        .when(low.rlike("[aeiou].*ing$") & (F.length(low) > 5), F.regexp_replace(low, "ing$", "")).when(low.rlike("[aeiou].*ed$") & (F.length(low) > 4), F.regexp_replace(low, "ed$", "")).otherwise(low)
    )


def cased(token: Column | str, base: Column | str) -> Column:
    """base in the case of token: upper, title or as it is."""
    return F.when(T.is_upper(token), F.upper(T.col(base))).when(T.is_title(token), F.initcap(T.col(base))).otherwise(T.col(base))


def normalized(docs: DataFrame, options: NormalizeOptions = NormalizeOptions(), vocabulary: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, sent_id and tokens by all settings: filters, word classes, lemmas, spelling (words longer than spell_threshold, where a vocabulary is given) and case. Sentences with `min_tokens` tokens or fewer go."""
    cut = F.regexp_extract_all("raw", F.lit(rf"{T.WORD}|[^\p{{L}}\s]+" if options.special_char else T.WORD), 0)
    special = lambda t: T.special_only(t) & F.lit(options.special_char)
    kept = F.filter(cut, lambda t: (special(t) | passes(t, options)) & word_class(t).isin(list(options.classes())))

    def shaped(t: Column) -> Column:
        base = lemma(t)
        if vocabulary:
            base = F.when(F.length(base) > options.spell_threshold, corrected(base, list(vocabulary))).otherwise(base)
        return F.when(special(t), t).otherwise(cased(t, base) if options.keep_case else base)

    return sentences(docs).select("doc_id", "sent_id", F.transform(kept, shaped).alias("tokens")).where(F.size("tokens") > options.min_tokens)


def content_array(sentence: Column | str, options: NormalizeOptions = NormalizeOptions()) -> Column:
    """The content words of a sentence in lower case, as an array."""
    keep = [x for words in W.STOPWORDS.values() for x in words]
    return F.filter(F.transform(T.words(sentence), F.lower), lambda x: (F.length(x) >= options.min_length) & ~x.isin(keep))


def content_sentences(docs: DataFrame, options: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """doc_id, sent_id, raw and tokens of the sentences with more than `min_tokens` content words; no shuffle."""
    return sentences(docs).withColumn("tokens", content_array("raw", options)).where(F.size("tokens") > options.min_tokens)


def shown(docs: DataFrame, options: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """doc_id and shown: the content sentences and their tokens as text for people, from the document's own array. A null text has no sentences."""
    all_tokens = F.transform(F.coalesce(T.sentences("text"), F.array().cast("array<string>")), lambda x: content_array(x, options))
    return docs.select("doc_id", sentences_text(F.filter(all_tokens, lambda x: F.size(x) > options.min_tokens)).alias("shown"))


def vocabulary(docs: DataFrame, least_documents: int) -> DataFrame:
    """Terms (lower case) found in at least so many documents, with that number."""
    per_doc = docs.select("doc_id", F.explode(F.array_distinct(F.transform(T.words("text"), F.lower))).alias("term"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_documents)


def deletions(word: Column | str) -> Column:
    """The word without none, one or two of its characters: two words within two edits share one of these."""
    word = T.col(word)
    at = lambda x: F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
    without = lambda x: F.transform(at(x), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    once = without(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, without))))


def suggestions(terms: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """term and suggestion: the nearest known word within two edits, ties by the word. Meets on shared deletions, never on all pairs."""
    a = terms.select("term").distinct().select("term", F.explode(deletions("term")).alias("key"))
    b = known.select(F.col("term").alias("word")).distinct().select("word", F.explode(deletions("word")).alias("key"))
    met = a.join(b, "key").select("term", "word").distinct().withColumn("edits", F.levenshtein("term", "word"))
    return met.where(F.col("edits") <= most).groupBy("term").agg(F.min(F.struct("edits", "word")).alias("best")).select("term", F.col("best.word").alias("suggestion"), F.col("best.edits").alias("edits"))


def corrected(token: Column | str, known: list[str]) -> Column:
    """Doubled letters squeezed, the last pair first, until the word is in a plan-time vocabulary; unchanged if it never is. Each round takes a letter, so a word needs fewer rounds than it has letters."""
    word = F.lower(T.col(token))
    rounds = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    out = F.aggregate(rounds, word, lambda now, _: F.when(now.isin(known), now).otherwise(T.squeeze_once(now)))
    return F.when(out.isin(known), out).otherwise(word)


def query_filter(docs: DataFrame, query: list[str], threshold: float) -> DataFrame:
    """Content sentences whose bag of words has a cosine of at least `threshold` with the query's, with that cosine."""
    wanted = sorted(set(query))
    counted = content_sentences(docs)
    uses = lambda word: F.size(F.filter("tokens", lambda x: x == word))
    dot = sum(uses(w) * query.count(w) for w in wanted) if wanted else F.lit(0)
    # squares of counts over the sorted tokens: the n-th use of a word adds 2n - 1
    counted_to = lambda a, x: F.when(x == a["last"], a["n"] + 2.0).otherwise(F.lit(1.0))
    step = lambda a, x: F.struct(x.alias("last"), counted_to(a, x).alias("n"), (a["sum"] + counted_to(a, x)).alias("sum"))
    norm = F.aggregate(F.array_sort("tokens"), F.struct(F.lit("").alias("last"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum")), step, lambda a: F.sqrt(a["sum"]))
    own = sum(query.count(w) ** 2 for w in wanted) ** 0.5
    cosine = F.round(F.try_divide(dot, norm * own), 6) if wanted else F.lit(0.0)
    return counted.withColumn("cosine", cosine).where(F.col("cosine") >= threshold)
