"""The earlier normaliser: fluent settings with their couplings, and a token chain that keeps emphasis and special characters."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from prosa.functions import text as T, words as W
from prosa.operators import normalize


@dataclass(frozen=True)
class LegacyOptions:
    min_length: int = 2
    keep_case: bool = False
    keep_stopwords: bool = False
    keep_contractions: bool = True
    keep_special: bool = False
    emphasis_level: int | None = None
    emphasis_marks: str = "?!"
    pos_filter: bool = False
    keep_wordform: bool = False
    correct_spelling: bool = False
    vocabulary: tuple[str, ...] = ()

    def with_contractions(self, keep: bool) -> LegacyOptions:
        """Expanding contractions requires that stop words are kept."""
        return replace(self, keep_contractions=keep, keep_stopwords=self.keep_stopwords or not keep)

    def with_pos_filter(self, on: bool) -> LegacyOptions:
        """The filter needs special characters and leaves the emphasis as it is."""
        return replace(self, pos_filter=on, keep_special=self.keep_special or on)

    def with_emphasis(self, level: int | None) -> LegacyOptions:
        """Emphasis turns the filter off and keeps special characters."""
        return replace(self, emphasis_level=level, pos_filter=self.pos_filter and level is None, keep_special=self.keep_special or level is not None)


def token_array(raw, options: LegacyOptions):
    """The normalised tokens of a sentence; an empty array stays."""
    text = T.col(raw) if options.keep_contractions else T.expand_contractions(raw)
    spaced = options.keep_special or options.emphasis_level is not None
    cut = F.split(text, r"\s+") if spaced else F.regexp_extract_all(text, F.lit(rf"{T.WORD}|[^\p{{L}}\s]+"), 0)
    special = lambda t: T.special_only(t)
    kept = F.filter(cut, lambda t: (special(t) & F.lit(options.keep_special) & (t != "")) | (~special(t) & (F.length(t) >= options.min_length)))

    def shaped(t):
        word = T.left_clean(t)
        word = T.emphasis(word, options.emphasis_level, options.emphasis_marks) if options.emphasis_level is not None else F.regexp_extract(word, r"^(.*[\p{L}\p{N}_])", 1)
        return F.when(special(t), t).otherwise(word if options.keep_case else F.lower(word))

    out = F.filter(F.transform(kept, shaped), lambda t: t != "")
    if options.pos_filter:
        out = F.filter(out, lambda t: special(t) | normalize.word_class(t).isin("ADJ", "ADV", "NOUN", "VERB"))
        if not options.keep_wordform:
            out = F.transform(out, lambda t: F.when(special(t), t).otherwise(normalize.cased(t, normalize.lemma(t))))
    if options.correct_spelling:
        out = F.transform(out, lambda t: normalize.corrected(t, list(options.vocabulary)))
    return out if options.keep_stopwords else F.filter(out, lambda t: ~t.isin(W.STOPWORDS["en"] + ["n't", "'s", "'d", "'t", "'ve", "'ll"]))


def normalized(docs: DataFrame, options: LegacyOptions = LegacyOptions()) -> DataFrame:
    """doc_id, sent_id, raw and tokens; sentences without tokens stay."""
    cut = docs.select("doc_id", F.posexplode(T.sentences("text")).alias("sent_id", "raw"))
    return cut.withColumn("tokens", token_array("raw", options))


def append(first: DataFrame, second: DataFrame, options: LegacyOptions = LegacyOptions()) -> DataFrame:
    """The sentences of the second documents after those of the first ones with the same doc_id, renumbered."""
    count = F.size(T.sentences(F.coalesce("text", F.lit(""))))
    offsets = first.groupBy("doc_id").agg(F.max(count).alias("offset"))
    later = normalized(second, options).join(offsets, "doc_id", "left").withColumn("sent_id", F.col("sent_id") + F.coalesce("offset", F.lit(0))).drop("offset")
    return normalized(first, options).unionByName(later)
