"""Best-fit packing by large-item matching.

Texts are tokenised in one pass into pieces of at most `capacity` tokens (the remainder comes first). The plan needs nothing but
how many pieces have each length: at most `capacity` numbers, however many documents there are. On these it is exact:
pieces above a third of the capacity fill a bin at most in twos, and are matched greedily, the longest one with the longest
partner that fits; shorter ones follow by length, each into the smallest gap that takes it; new bins are opened last. Bins
with the same content are one group with a multiplicity, so the plan has a few thousand entries. Every piece then gets its
rank among those of its length (counts by length and hash bucket, a running sum, a row number within the bucket), and
the plan maps (length, rank) to (sequence, offset). No length, however frequent, meets in one task.

Defined cases: a null text counts as empty and is the single id 0; a text of any length is tokenised whole; repeated rows are packed as often
as they occur; pieces of equal length are ties, any of them may take any of their places; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from prosa.llm.common import stage, worker_cache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackingOptions:
    tokenizer: str
    capacity: int = 2048
    end_id: int = 0
    cached_words: int = 800_000


def public_vocabulary(name: str) -> str:
    """The path of a vocabulary file that is installed beside the tokenizer libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    cache = worker_cache("tokenizers")
    if path not in cache:
        cache[path] = Tokenizer.from_file(path)
    return cache[path]


#: Kinds of characters: unsure, letter, digit, mark, apostrophe, space, other white space, end of a text.
UNSURE, LETTER, DIGIT, MARK, APOSTROPHE, SPACE, WHITE, END = range(8)
#: A longer chunk is not kept, a longer text is encoded in stretches.
LONGEST_CHUNK, LONGEST_TEXT = 64, 4_000_000


def kinds_of_characters() -> np.ndarray:
    """The kind of each of the first 65,536 code points; unsure where versions of Unicode may differ."""

    def kind(x: str) -> int:
        now, then = unicodedata.category(x), unicodedata.ucd_3_2_0.category(x)
        return next((k for k, names in ((LETTER, "L"), (DIGIT, "N"), (MARK, "PS")) if now[0] in names and then[0] in names), UNSURE)

    out = np.fromiter(map(kind, map(chr, range(1 << 16))), np.uint8, 1 << 16)
    out[[ord(x) for x in "' \t\n\r"]] = [APOSTROPHE, SPACE, WHITE, WHITE, WHITE]
    return out


def _table(size: int, of: Callable[..., bool]) -> np.ndarray:
    return np.array([of(*divmod(x, 8)) for x in range(size)])


_SURE = frozenset((LETTER, DIGIT, MARK, APOSTROPHE))
_IS_SURE, _IS_WHITE = np.isin(np.arange(8), list(_SURE)), np.isin(np.arange(8), [SPACE, WHITE])
_RUN = {LETTER: 0, DIGIT: 1, MARK: 2, APOSTROPHE: 2}
#: Kinds (8 * left + right) between which a piece always ends: runs of letters, digits or marks, before white space, after white space that is no space.
#: A letter after an apostrophe may belong to it ('s).
_BETWEEN = _table(64, lambda a, b: END in (a, b) or a in _SURE and b in (SPACE, WHITE) or a == WHITE and b in _SURE or {a, b} <= _SURE and _RUN[a] != _RUN[b] and (a, b) != (APOSTROPHE, LETTER))


#: One run of Latin letters of one or two bytes, maybe after a space: a single piece of the pattern.
_WORD = re.compile(rb" ?[A-Za-z]*(?:(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])[A-Za-z]*)*")


def byte_letters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary; here a line's end is a space and a vertical tab a line's end."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u2")
    out[plain] = plain
    others = [x for x in range(256) if x not in set(plain)]
    out[others] = 256 + np.arange(len(others))
    out[0x0B], out[0x0A] = out[0x0A], 0x20
    return out


def chunks_of(texts: list[str], kinds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts, each followed by a NUL, cut wherever the byte-level pattern begins a new piece for certain, and the places of those NULs among the chunks."""
    joined = "\0".join([*texts, ""])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = kinds[np.minimum(np.frombuffer(joined.encode("utf-32-le"), "<u4"), len(kinds) - 1)]
    kind[ends] = END
    cut = np.ones(len(kind), bool)
    cut[1:] = _BETWEEN[kind[:-1] * 8 + kind[1:]]
    cut[:-1] |= _IS_WHITE[kind[:-1]] & _IS_SURE[kind[1:]]  # the last of some white space stands alone or begins a word
    packed, begin = joined.encode(), np.flatnonzero(cut)
    if len(packed) > len(joined):
        places = np.flatnonzero(np.frombuffer(packed, np.uint8) & 0xC0 != 0x80)
        offsets = np.append(places[begin], len(packed))
    else:
        offsets = np.append(begin, len(packed))
    found = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
    return found.dictionary_encode(), np.searchsorted(begin, ends)


def stretches(text: str) -> list[str]:
    """A long text cut before spaces between letters, every million characters or later."""
    out, at = [], 0
    while found := re.compile("(?<=[A-Za-z])(?= [A-Za-z])").search(text, at + 1_000_000):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def encode_texts(texts: list[str], path: str, cached_words: int) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, the same as of the tokenizer over the whole text.

    Texts are cut where the byte-level pattern begins a new piece whatever stands around, so that chunks can be encoded apart, and each
    distinct chunk once. Texts that hold a token which the tokenizer takes out beforehand are encoded whole.
    """
    tokenizer, cache, known = tokenizer_of(path), worker_cache(f"chunks {path}"), worker_cache(f"known {path}")
    if not texts:
        return []
    if not known:
        from tokenizers import Tokenizer, pre_tokenizers

        known["kinds"] = kinds_of_characters()
        known["begins"] = np.array([(tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(tokenizer.get_vocab_size())])  # which ids begin with a space
        known["words"], known["letters"] = Tokenizer(tokenizer.model), byte_letters()  # the same model; words come with their bytes' letters and need no pattern
        known["words"].pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        known["line"], known["apart"] = tokenizer.token_to_id("\u010a"), [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    if any(len(x) > LONGEST_TEXT for x in texts):
        whole = any(x in text for x in known["apart"] for text in texts)
        parts = [[x] if whole or len(x) <= LONGEST_TEXT else stretches(x) for x in texts]
        if any(len(x) > 1 for x in parts):
            return [b"".join(y for part in x for y in encode_texts([part], path, cached_words)) for x in parts]

    def ids_of(chunks: list[str]) -> list[bytes]:  # "fast": without the characters' places, which nobody asks for
        return [np.array(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def ids_of_words(chunks: list[bytes], spaced: bool) -> list[bytes]:
        """The ids of words that are a single piece each: told apart in the ids of all by the space that they begin with, or by a line's end between them."""
        if not chunks:
            return []
        letters = known["letters"][np.frombuffer((b"\n" if spaced else b"\n\x0b\n").join(chunks), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(known["words"].encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
        begins = np.flatnonzero(known["begins"][ids]) if spaced else np.append(0, np.flatnonzero(ids == known["line"]) + 1)
        if len(begins) != len(chunks):
            return ids_of([x.decode() for x in chunks])
        packed, begins = ids.tobytes(), 4 * begins
        return list(map(packed.__getitem__, map(slice, begins.tolist(), [*(begins[1:] - (0 if spaced else 4)).tolist(), len(packed)])))

    if len(cache) > cached_words:
        cache.clear()
    chunks, ends = chunks_of(texts, known["kinds"])
    words = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
    packed = list(map(cache.get, words))
    new = [i for i, x in enumerate(packed) if x is None]
    word = [words[i] for i in new]
    kind = [(1 if x[0] == 32 else 2) if len(x) > 1 and _WORD.fullmatch(x) else 0 for x in word]
    for k, encode in enumerate((lambda x: ids_of([y.decode() for y in x]), lambda x: ids_of_words(x, True), lambda x: ids_of_words(x, False))):
        own = [j for j, x in enumerate(kind) if x == k]
        for j, ids in zip(own, encode([word[j] for j in own])):
            packed[new[j]] = ids
            if len(word[j]) <= LONGEST_CHUNK:
                cache[word[j]] = ids

    lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    ids, begin = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(lengths) - lengths
    at = chunks.indices.to_numpy()
    sizes = lengths[at]
    sizes[ends] = 0
    after = np.cumsum(sizes)
    ids = ids[np.repeat(begin[at] - (after - sizes), sizes) + np.arange(after[-1])].tobytes()
    bounds = (4 * after[ends]).tolist()
    out = [ids[a:b] for a, b in zip([0, *bounds], bounds)]
    for token in known["apart"]:
        for i in [i for i, text in enumerate(texts) if token in text]:
            out[i] = ids_of([texts[i]])[0]
    return out


def groups(texts: list[str]):
    """(first, end) of stretches of texts that are encoded together: up to 2,048 texts, or 1,000,000 characters and one text more."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= 1_000_000 or i + 1 - first == 2048:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def tokenise(docs: DataFrame, options: PackingOptions) -> DataFrame:
    """A row for each piece of each document: PIECES. start: the document's ids before the piece."""

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for at, to in groups(texts):
                rows = []
                for doc, packed in zip(ids[at:to], encode_texts(texts[at:to], options.tokenizer, options.cached_words)):
                    view = memoryview(packed + options.end_id.to_bytes(4, "little"))
                    n = len(view) // 4
                    start, length = 0, n % options.capacity or options.capacity
                    for piece in range(-(-n // options.capacity)):
                        rows.append((doc, piece, start, length, zlib.crc32(view[4 * start : 4 * (start + length)])))
                        start, length = start + length, options.capacity
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, PIECES)


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, (first rank, end rank, sequence of the first, offset): ranks of a stretch go to successive sequences."""
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(left, 0)
    out: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in left}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    order: list[int] = []  # gaps in use, ascending
    opened = 0

    def put(length: int, base: int, bins: int, offset: int) -> None:
        out[length].append((taken[length], taken[length] + bins, base, offset))
        taken[length] += bins
        left[length] -= bins

    def keep(gap: int, base: int, bins: int) -> None:
        if bins and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((base, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect_left(large, capacity - length + 1) - 1
            while at >= 0 and left[large[at]] < 1 + (large[at] == length):
                at -= 1
            partner = large[at] if at >= 0 else 0
            bins = left[length] if not partner else left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, opened, bins, 0)
            if partner:
                put(partner, opened, bins, length)
            keep(capacity - length - partner, opened, bins)
            opened += bins

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                base, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, base, bins = capacity, opened, -(-left[length] // (capacity // length))
                opened += bins
            each = gap // length
            full = min(bins, left[length] // each)
            rest = min(each, left[length] - full * each) if full < bins else 0
            for k in range(each if full else 0):
                put(length, base, full, capacity - gap + k * length)
            for k in range(rest):
                put(length, base + full, 1, capacity - gap + k * length)
            keep(gap - each * length, base, full)
            keep(gap - rest * length, base + full, 1 if rest else 0)
            keep(gap, base + full + (1 if rest else 0), bins - full - (1 if rest else 0))
    return out


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """pieces with `rank`: a number from 0 among the pieces of the same length. salt: deals out rows that are equal in all else."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "salt"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32", "salt")) - 1
    return dealt.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")


def pack(docs: DataFrame, options: PackingOptions, pieces_of: Callable[[DataFrame, PackingOptions], DataFrame] = tokenise) -> DataFrame:
    """PIECES with sequence_id and offset, a row per piece."""
    pieces = stage(pieces_of(docs, options).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    packed = plan(counts, options.capacity)
    begins = {n: np.array([s[0] for s in stretches]) for n, stretches in packed.items()}
    places = {n: np.array([(s[2] - s[0], s[3]) for s in stretches]) for n, stretches in packed.items()}

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                found = places[n][np.searchsorted(begins[n], ranks[own], side="right") - 1]
                sequence[own], offset[own] = ranks[own] + found[:, 0], found[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, 64 + sum(counts.values()) // 50_000).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
