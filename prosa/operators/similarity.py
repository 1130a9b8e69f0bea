"""Term weights and sentence similarity within documents.

All of it needs the rows of one document together, so documents are dealt out once, by doc_id, and every later
aggregation and window (whose keys begin with doc_id) runs on that partitioning. Sentence pairs come from the terms that
both hold: each term's list of sentences is unfolded against itself, so pairs without a common term never exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prosa.operators.normalize import content_sentences


def together(sents: DataFrame) -> DataFrame:
    """All sentences of a document in one partition. A document is the unit of ranking, so this group is bounded by its length."""
    return sents.repartition("doc_id")


def n_grams(tokens: Column | str, n: int) -> Column:
    """An array of n successive tokens each, joined by spaces; empty for shorter sentences."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    if n == 1:
        return tokens
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: i + (n - 1) <= F.size(tokens))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def term_frequency(sents: DataFrame, n: int = 1) -> DataFrame:
    """doc_id, sent_id, term and tf of n-grams. sents: doc_id, sent_id, tokens."""
    return sents.select("doc_id", "sent_id", F.explode(n_grams("tokens", n)).alias("term")).groupBy("doc_id", "sent_id", "term").agg(F.count("*").alias("tf"))


def with_weights(tf: DataFrame, sents_per_doc: Column | None = None) -> DataFrame:
    """tf with n (sentences of the document), total (count of the term in it), df, and both inverse frequencies."""
    by_term = Window.partitionBy("doc_id", "term")
    n = F.size(F.collect_set("sent_id").over(Window.partitionBy("doc_id"))) if sents_per_doc is None else sents_per_doc
    counted = tf.withColumn("n", n).withColumn("total", F.sum("tf").over(by_term)).withColumn("df", F.count("*").over(by_term))
    return counted.withColumn("collection_idf", F.log("n") / F.col("total")).withColumn("classic_idf", F.log(F.col("n") / F.col("df")))


def document_weights(docs: DataFrame) -> DataFrame:
    """The weighted terms of all content sentences; n is counted before sentences are unfolded."""
    sents = together(content_sentences(docs).select("doc_id", "sent_id", "tokens"))
    counted = sents.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    tf = counted.select("doc_id", "sent_id", "n", F.explode("tokens").alias("term")).groupBy("doc_id", "sent_id", "n", "term").agg(F.count("*").alias("tf"))
    return with_weights(tf.select("doc_id", "sent_id", "term", "tf", "n"), F.col("n"))


def pairs(weights: DataFrame, idf: str = "collection_idf") -> DataFrame:
    """doc_id, i, j (i < j) and sim: cosine of the weighted sentences that share a term; pairs with a zero norm have none."""
    weighted = weights.withColumn("w", F.col("tf") * F.col(idf))
    normed = weighted.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "sent_id")))).where("norm > 0")
    lists = normed.groupBy("doc_id", "term").agg(F.collect_list(F.struct("sent_id", (F.col("w") / F.col("norm")).alias("u"))).alias("own")).where(F.size("own") > 1)
    left = lists.select("doc_id", "own", F.explode("own").alias("a"))
    both = left.select("doc_id", F.col("a.sent_id").alias("i"), F.col("a.u").alias("u"), F.explode(F.filter("own", lambda x: x["sent_id"] > F.col("a.sent_id"))).alias("b"))
    return both.groupBy("doc_id", "i", F.col("b.sent_id").alias("j")).agg(F.sum(F.col("u") * F.col("b.u")).alias("sim"))


def edges(sims: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Pairs above the threshold; equal to it to nine digits is not above, whatever the order of the sums. NaN counts as larger than any number in Spark and is left out by hand."""
    return sims.where(~F.isnan("sim") & (F.round("sim", 9) > threshold)).select("doc_id", "i", "j")


def adjacency(weights: DataFrame, sims: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Both directions of each edge and each sentence's own one: doc_id, i, j. Sentences of zero norm have no own edge."""
    found = edges(sims, threshold)
    own = weights.where("collection_idf > 0").select("doc_id", F.col("sent_id").alias("i")).distinct().withColumn("j", F.col("i"))
    return found.unionByName(found.select("doc_id", F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(own)


def row_stochastic(adjacent: DataFrame) -> DataFrame:
    """doc_id, i, j and p: rows of the adjacency that sum to 1."""
    return adjacent.withColumn("p", F.lit(1.0) / F.count("*").over(Window.partitionBy("doc_id", "i")))


def degrees(adjacent: DataFrame) -> DataFrame:
    return adjacent.groupBy("doc_id", F.col("i").alias("sent_id")).agg(F.count("*").alias("degree"))
