"""Katz back-off language model: Good-Turing discounted n-gram counts, exactly normalised back-off weights.

Texts are cut once into blocks of a few million tokens: distinct words (64-bit hashes), the tokens as numbers of these and the documents' lengths.
For each order, a block sends each of its distinct n-grams once, with its count in training texts, to a bucket by hash (packed, a row for
each block and bucket). A bucket adds them up, stores its part of the n-gram table, and answers each block in the order it was asked, so that
answers carry no keys. One of the blocks that asked is told to represent an n-gram: it adds discounted counts and lower-order
probabilities to its context's sums, which are added up the same way; from these follows the weight

    alpha(h) = (1 - sum of discounted P(w|h) over seen w) / (1 - sum of P(w|shorter h) over seen w)

so that the probabilities of each context sum to 1. Each token is then scored recursively: a seen n-gram by its discounted share, an unseen one by the
weight of its context times the score one order below, an unknown word by the mass that discounting frees among single words. Buckets are
balanced by hash; no frequent word, context or text meets in one task, and the driver sees only the counts of counts.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case and one end per text. Where a context has no discounted count, one count is reserved
for what it hasn't seen. Where counts of counts give no valid Good-Turing discounts (small corpora), counts up to 5 lose 0.5.

N-grams are known by hashes of 64 bits that nothing verifies: of n distinct ones about n^2 / 2^65 pairs share a hash (0.03 at 10^9) and are
counted as one.

Defined cases: a null text is empty and has the end alone; a text of any length is scored whole and never cut, so a block is as large as its longest
text; counts have no ties to break; repeated rows are counted and scored as often as they occur; a null doc_id has the fold of an
empty text; an empty table gives an empty result; without training texts every token is unknown with probability 1; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prosa.llm.common import free_shuffles, stage

BLOCKS = "block long, docs array<long>, lengths binary, training binary, words binary, tokens binary"
ANSWERS = "kind string, block long, bucket int, a binary, b binary"
END, BEGIN = b"\n", b" "


@dataclass(frozen=True)
class KatzOptions:
    order: int = 2
    discounted: int = 5
    folds: int = 7
    held_out: int = 2
    block_tokens: int = 4_000_000
    bucket_tokens: int = 3_000_000


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, the lowest of all numbers first: planes of small numbers are zeros, which every codec shortens."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpacked(data: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the steps between them."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def fold(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def blocks_of(docs: DataFrame, options: KatzOptions) -> DataFrame:
    def cut(batches):
        ids: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        number: dict[bytes, int] = {END: 0}
        held = 0

        def flush():
            nonlocal ids, lengths, parts, number, held
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            training = np.array([fold(i, options.folds) != options.held_out for i in ids], np.uint8)
            row = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([packed(x)], pa.binary()) for x in (np.array(lengths, np.int32), training, hashes, np.concatenate(parts)))]
            ids, lengths, parts, number, held = [], [], [], {END: 0}, 0
            return pa.RecordBatch.from_arrays(row, names=["docs", "lengths", "training", "words", "tokens"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").lower().split()
                for w in set(words):
                    if w not in number:
                        number[w] = len(number)
                ids.append(doc_id)
                lengths.append(len(words) + 1)
                parts.append(np.fromiter(map(number.__getitem__, [*words, END]), np.int32, len(words) + 1))
                held += len(words) + 1
                if held >= options.block_tokens:
                    yield flush()
        if ids:
            yield flush()

    cut_docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, BLOCKS.removeprefix("block long, "))
    return stage(cut_docs.withColumn("block", F.monotonically_increasing_id()).select("block", "docs", "lengths", "training", "words", "tokens"), "lm-blocks")


def numbered(context: np.ndarray, tokens: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of context and token: a place of each distinct pair, and each place's pair number. Temporaries are dropped as early as they can."""
    pairs = context.astype(np.int64)
    pairs *= words
    pairs += tokens
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    new = np.empty(len(pairs), bool)
    new[:1] = True
    np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
    del pairs
    gram = np.empty(len(order), np.int32)
    gram[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], gram


class Grams:
    """The n-grams of one block at each order: for each token the number of its n-gram and of its context, and their keys."""

    def __init__(self, row: dict, order: int):
        self.words, self.tokens = unpacked(row["words"], np.uint64), unpacked(row["tokens"], np.int32)
        self.lengths = unpacked(row["lengths"], np.int32)
        self.training = np.repeat(np.frombuffer(row["training"], np.uint8), self.lengths).astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        begin = np.uint64(xxhash.xxh64_intdigest(BEGIN))
        #: By order: number of each token's n-gram; keys of the n-grams; a token that ends each; number of each token's context, 0 at the begin of a text; keys of contexts.
        self.gram, self.keys, self.example = [None, self.tokens], [None, self.words], [None, None]
        self.context, self.context_keys = [None, None], [None, None]
        for m in range(2, order + 1):
            context = np.empty_like(self.tokens)
            context[1:] = self.gram[m - 1][:-1] + 1
            context[self.starts] = 0
            context_keys = np.concatenate([np.array([begin + np.uint64(m)], np.uint64), self.keys[m - 1]])
            example, gram = numbered(context, self.tokens, len(self.words))
            self.context.append(context)
            self.context_keys.append(context_keys)
            self.gram.append(gram)
            self.example.append(example)
            self.keys.append(mixed(context_keys[context[example]], self.words[self.tokens[example]]))

    def trained(self, m: int) -> np.ndarray:
        """Counts in training texts of the n-grams of order m."""
        return np.bincount(self.gram[m][self.training], minlength=len(self.keys[m])).astype(np.uint32)


def rows_by_bucket(block: int, kind: str, keys: np.ndarray, buckets: int, *values: np.ndarray):
    """Packed keys and values, ascending by key: a tuple for each bucket."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], [v[order] for v in values]
    ends = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    return [(kind, block, k, packed_keys(keys[a:b]), *(packed(v[a:b]) for v in values)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]


def ask_counts(blocks: DataFrame, m: int, buckets: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, m)
                for r in rows_by_bucket(row["block"], str(m), grams.keys[m], buckets, grams.trained(m)):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) if i < 2 else pa.array([x], pa.int32()) if i == 2 else pa.array([x], pa.binary()) for i, x in enumerate(r)], names=["kind", "block", "bucket", "keys", "counts"])

    return blocks.select("block", "lengths", "training", "words", "tokens").mapInArrow(ask, "kind string, block long, bucket int, keys binary, counts binary")


def answer_counts(asked: DataFrame, m: int, discounted: int) -> DataFrame:
    """Answers: kind count<m> with total counts and bits that make a block the representative; kind table<m> the n-grams seen; kind stat<m> counts of counts."""

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [unpacked_keys(r["keys"]) for r in rows]
        every, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]), minlength=len(every)).astype(np.uint64)
        represents = np.zeros(len(inverse), bool)
        represents[first] = True
        out, at = [], 0
        for r, k in zip(rows, keys):
            own = slice(at, at + len(k))
            out.append((f"count{m}", r["block"], r["bucket"], packed(totals[inverse[own]].astype(np.uint32)), np.packbits(represents[own]).tobytes()))
            at += len(k)
        seen = totals > 0
        counts = np.bincount(totals[totals <= discounted + 1].astype(np.int64), minlength=discounted + 2)
        bucket = rows[0]["bucket"]
        out.append((f"table{m}", -1, bucket, packed_keys(every[seen]), packed(totals[seen].astype(np.uint32))))
        out.append((f"stat{m}", -1, bucket, np.array([*counts[1:], seen.sum(), totals.sum()], np.int64).tobytes(), b""))
        return answer_table(out)

    return asked.groupBy("bucket").applyInArrow(answer, ANSWERS)


def answer_table(rows: list[tuple]) -> pa.Table:
    types = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "block", "bucket", "a", "b"), zip(*rows), types)})


def discounts(counts: np.ndarray, most: int) -> np.ndarray:
    """Good-Turing factors for counts 0 to most (that of 0 unused); counts: how many n-grams occur 1, 2, ... most + 1 times."""
    n = np.concatenate([[0.0], counts.astype(float)])
    for k in range(most, 1, -1):
        if n[1 : k + 2].all():
            r = np.arange(1, k + 1)
            tail = (k + 1) * n[k + 1] / n[1]
            d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if tail < 1 else np.zeros(k)
            if (d > 0).all() and (d < 1).all():
                return np.concatenate([[1.0], d, np.ones(most - k)])
    r = np.arange(1, most + 1)
    return np.concatenate([[1.0], (r - 0.5) / r])


@dataclass(frozen=True)
class Level:
    """What the driver knows of an order: discount factors, how many n-grams there are, how many tokens."""

    factors: np.ndarray
    types: int
    tokens: int
    freed: float

    @property
    def denominator(self) -> float:
        return self.tokens + (0.0 if self.freed > 1e-9 else 1.0)

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * self.factors[np.where(counts < len(self.factors), counts, 0).astype(np.int64)]


def level_of(answers: DataFrame, m: int, options: KatzOptions) -> Level:
    rows = answers.where(F.col("kind") == f"stat{m}").select("a").collect()  # options.discounted + 3 numbers per bucket
    total = sum((np.frombuffer(r[0], np.int64) for r in rows), np.zeros(options.discounted + 3, np.int64))
    factors = discounts(total[: options.discounted + 1], options.discounted)
    r = np.arange(1, options.discounted + 1)
    return Level(factors, int(total[-2]), int(total[-1]), float(((1 - factors[1:]) * r * total[: options.discounted]).sum()))


class Scorer:
    """Probabilities of a block's tokens, order by order, from the answers it got."""

    def __init__(self, row: dict, answers: list[dict], levels: list, order: int):
        self.grams = Grams(row, order)
        self.levels, self.answers = levels, {}
        for r in sorted(answers, key=lambda r: (r["kind"], r["bucket"])):
            self.answers.setdefault(r["kind"], []).append(r)

    def unsorted(self, kind: str, keys: np.ndarray, column: str, dtype) -> np.ndarray:
        out = np.empty(len(keys), dtype)
        out[np.argsort(keys, kind="stable")] = np.concatenate([unpacked(r[column], dtype) for r in self.answers[kind]])
        return out

    def counts(self, m: int) -> np.ndarray:
        return self.unsorted(f"count{m}", self.grams.keys[m], "a", np.uint32).astype(np.int64)

    def represents(self, m: int) -> np.ndarray:
        bits = [np.unpackbits(np.frombuffer(r["b"], np.uint8))[: len(r["a"]) // 4] for r in self.answers[f"count{m}"]]
        out = np.empty(len(self.grams.keys[m]), bool)
        out[np.argsort(self.grams.keys[m], kind="stable")] = np.concatenate(bits)
        return out

    def contexts(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Denominator (0: never seen) and back-off weight of each context number."""
        used = np.unique(self.grams.context[m])
        denominator, weight = np.zeros(len(self.grams.context_keys[m])), np.ones(len(self.grams.context_keys[m]))
        keys = self.grams.context_keys[m][used]
        denominator[used] = self.unsorted(f"alpha{m}", keys, "a", np.float64)
        weight[used] = self.unsorted(f"alpha{m}", keys, "b", np.float64)
        return denominator, weight

    def probability(self, m: int) -> np.ndarray:
        """P(token | its context of order m) of each token."""
        level, gram, counts = self.levels[m], self.grams.gram[m], self.counts(m)
        if m == 1:
            unknown = (level.freed or 1.0) / level.denominator if level.tokens else 1.0
            return np.where(counts > 0, level.discounted(counts) / max(level.denominator, 1.0), unknown)[gram]
        lower = self.probability(m - 1)
        denominator, weight = self.contexts(m)
        context = self.grams.context[m]
        seen = counts[gram] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            own = level.discounted(counts)[gram] / denominator[context]
        return np.where(seen, own, weight[context] * lower)

    def sums(self, m: int) -> tuple[np.ndarray, ...]:
        """Keys of this block's contexts, and over the seen n-grams that it represents: counts, discounted counts, probabilities one order below."""
        counts, example, context = self.counts(m), self.grams.example[m], self.grams.context[m]
        own = self.represents(m) & (counts > 0)
        lower = self.probability(m - 1)[example]
        used, at = np.unique(context, return_inverse=True)
        at = at[example]
        add = lambda x: np.bincount(at[own], weights=x[own], minlength=len(used))
        return self.grams.context_keys[m][used], add(counts), add(self.levels[m].discounted(counts)), add(lower)


def cogrouped(blocks: DataFrame, answers: list[DataFrame], function, schema: str) -> DataFrame:
    """function(block's row, its answers) for each block."""
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    mine = every.where("block >= 0")
    return blocks.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(lambda left, right: function(left.to_pylist()[0], right.to_pylist()), schema)


def ask_sums(blocks: DataFrame, answers: list[DataFrame], levels: list, m: int, buckets: int) -> DataFrame:
    def ask(row, own):
        keys, counts, discounted, lower = Scorer(row, own, levels, m).sums(m)
        rows = rows_by_bucket(row["block"], str(m), keys, buckets, counts.astype(np.uint32), discounted, lower)
        types = (pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "block", "bucket", "keys", "counts", "discounted", "lower"), zip(*rows), types)})

    return cogrouped(blocks.drop("docs"), answers, ask, "kind string, block long, bucket int, keys binary, counts binary, discounted binary, lower binary")


def answer_sums(asked: DataFrame, m: int) -> DataFrame:
    """Answers: kind alpha<m> with denominators and weights; kind backoff<m> the same with keys, for the stored table."""

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [unpacked_keys(r["keys"]) for r in rows]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        added = lambda c, dtype: np.bincount(inverse, weights=np.concatenate([unpacked(r[c], dtype) for r in rows]), minlength=len(every))
        counts, discounted, lower = added("counts", np.uint32), added("discounted", np.float64), added("lower", np.float64)
        denominator = np.where(counts - discounted > 1e-9 * counts, counts, np.where(counts > 0, counts + 1.0, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(counts > 0, (denominator - discounted) / denominator / np.maximum(1.0 - lower, 1e-12), 1.0)
        out, at = [], 0
        for r, k in zip(rows, keys):
            own = inverse[at : at + len(k)]
            out.append((f"alpha{m}", r["block"], r["bucket"], packed(denominator[own]), packed(weight[own])))
            at += len(k)
        seen = counts > 0
        out.append((f"backoff{m}", -1, rows[0]["bucket"], packed_keys(every[seen]), packed(np.concatenate([denominator[seen], weight[seen]]))))
        return answer_table(out)

    return asked.groupBy("bucket").applyInArrow(answer, ANSWERS)


@dataclass
class KatzModel:
    """Staged tables, partitioned by kind (n-grams, back-off weights, answers), and what the driver knows of each order."""

    blocks: DataFrame
    tables: list
    levels: list


def fit(docs: DataFrame, options: KatzOptions = KatzOptions()) -> KatzModel:
    """Counts and weights from the training texts among docs; all of docs can be scored with the result."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, options)
    tokens = blocks.agg(F.sum(F.octet_length("tokens")) / 4).first()[0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens // options.bucket_tokens))
    tables, levels = [], [None]
    for m in range(1, options.order + 1):
        tables.append(stage(answer_counts(ask_counts(blocks, m, buckets), m, options.discounted), f"lm-counts{m}", "kind"))
        levels.append(level_of(tables[-1], m, options))
        free_shuffles(spark)
        if m > 1:
            tables.append(stage(answer_sums(ask_sums(blocks, tables, levels, m, buckets), m), f"lm-backoff{m}", "kind"))
            free_shuffles(spark)
    return KatzModel(blocks, tables, levels)


def score(model: KatzModel, options: KatzOptions = KatzOptions()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    levels, types = model.levels, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def read(row, own):
        scorer = Scorer(row, own, levels, options.order)
        grams, total = scorer.grams, levels[1].tokens
        counts = scorer.counts(1)[grams.tokens]
        base = np.log10((counts + 1.0) / (total + levels[1].types + 1.0))
        own_score = np.log10(scorer.probability(options.order))
        by_doc = lambda x: np.add.reduceat(x, grams.starts)
        held_out = np.frombuffer(row["training"], np.uint8) == 0
        columns = (row["docs"], held_out, grams.lengths, by_doc((counts > 0).astype(np.int64)), np.full(len(held_out), total), by_doc(base), by_doc(own_score))
        return pa.table({n: pa.array(c if n == "doc_id" else np.asarray(c), t) for n, c, t in zip(names, columns, types)})

    return cogrouped(model.blocks, model.tables, read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, options: KatzOptions = KatzOptions()) -> DataFrame:
    return score(fit(docs, options), options)
