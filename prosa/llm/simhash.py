"""SimHash near-duplicates: meet-in-the-middle ball hashing, then connected components.

A fingerprint has 64 bits; two texts link when theirs differ in at most 3. Half of that radius is no whole number: balls of
radius 2 on one side and 1 on the other would be 2081 + 65 variants of each fingerprint. So the 64 bits are cut into three
blocks of 21, 21 and 22, and each block is left out in turn. If two fingerprints differ in 3 bits or fewer, some block holds one
of these bits (or none is needed), and what remains differs in 2 at most: both sides emit all variants of the remaining 42 or 43 bits within half that
radius, 1, and meet. That is 131 variants of each distinct fingerprint, shuffled on the variant. Colliding fingerprints are
verified on all 64 bits.

Within a variant's group no pairs are enumerated. Members with the same left-out block differ in 2 bits at most and
are chained; chains whose blocks differ in one bit are joined (each block looks up its 21 or 22 neighbours); members that are
the unchanged variant itself are compared to each other up to 3 bits. Every link is found by one of these under one of the three blocks.

A task keeps a forest of what it has linked, of at most MOST_LINKED fingerprints at a time, and sends a link per fingerprint, not per
meeting. Components come from alternating large-star and small-star steps, each staged, on distinct fingerprints with a link only. In a step,
fingerprints with over a thousandth of all links (fewer than a thousand, whatever the input) get their least neighbour by broadcast, so that no
hub's links meet in one task; the others by a join.

Defined cases: null and wordless texts have fingerprint 0 and link to each other; a text of any length is read whole, its shingles in blocks of
numbers; repeated rows each get a row; ties (a bit set in exactly half of the hashes) leave the bit 0; a null doc_id takes part but never names a
component unless nothing else does (then component_id is null); an empty table gives an empty result; other columns are ignored by
`near_duplicates` and kept by `keep_one`. Rows that share a doc_id but not the text are documents of their own in `keep_one`.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prosa.llm.common import drop, free_shuffles, stage

SEED = 42
#: First bit and size of the three blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))
RADIUS = 3
#: Fingerprints in a task's forest; a full one is sent on and begun anew.
MOST_LINKED = 400_000
#: A hub has over 1 in so many links.
HUB_SHARE = 1000


def fingerprint(text: bytes) -> int:
    """Unsigned SimHash of the 3-word shingles of a text, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    n = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    count = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        count += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long); hashed: and text_hash, Spark's xxhash64 of the text."""

    def scan(batches):
        for batch in batches:
            found = np.array([fingerprint(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    text = F.col("text").cast("string")
    more = [F.xxhash64(text).alias("text_hash")] if hashed else []
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), *more).mapInArrow(scan, "doc_id long, fp long" + ", text_hash long" * hashed)


def variants(fp):
    """A column with all variants: the number of the left-out block in the top bits, then the remaining bits with one or none changed."""
    low = F.lit((1 << 21) - 1)
    left = [F.shiftrightunsigned(fp, 21), fp.bitwiseAND(low).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 42), 21)), fp.bitwiseAND(F.lit((1 << 42) - 1))]

    def ball(rest, bits: int):
        changed = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: rest.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        return F.concat(F.array(rest), changed)

    return F.concat(*(ball(rest.bitwiseOR(F.lit(j << 60)), 64 - size) for j, (rest, (_, size)) in enumerate(zip(left, BLOCKS))))


def rest_of(fps: np.ndarray, j: int) -> np.ndarray:
    """What remains of fingerprints (uint64) without block j."""
    at, size = BLOCKS[j]
    low = fps & np.uint64((1 << at) - 1)
    return low | (fps >> np.uint64(at + size) << np.uint64(at) if at + size < 64 else np.uint64(0))


def links_of_group(key: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is within the radius among distinct fingerprints that share a variant: fewer than 25 for each."""
    j = key >> 60
    at, size = BLOCKS[j]
    block = ((fps >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64)
    first: dict[int, int] = {}
    out = []
    for f, m in zip(fps.tolist(), block.tolist()):
        if m in first:
            out.append((first[m], f))
        else:
            first[m] = f
    if len(first) > 1:
        for m, f in first.items():
            for b in range(size):
                other = m ^ (1 << b)
                if other > m and other in first:
                    out.append((f, first[other]))
        self_at = np.flatnonzero(rest_of(fps, j) == np.uint64(key & ((1 << 60) - 1)))
        if len(self_at) > 1:
            out += near_blocks(block[self_at], fps[self_at], size)
    return out


def near_blocks(block: np.ndarray, fps: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Links between fingerprints that differ within one block only, by up to the radius."""
    out = []
    if len(block) <= 1500:
        label = np.arange(len(block))  # links within what is connected already are left out
        for i in range(1, len(block)):
            near = np.flatnonzero(np.bitwise_count(block[:i] ^ block[i]) <= RADIUS)
            for other in dict.fromkeys(label[near].tolist()):
                out.append((int(fps[i]), int(fps[near[label[near] == other][0]])))
                label[label == other] = i
        return out
    place = dict(zip(block.tolist(), fps.tolist()))
    flips = [sum(1 << b for b in c) for n in range(1, RADIUS + 1) for c in combinations(range(size), n)]
    for m, f in place.items():
        out += [(f, place[m ^ x]) for x in flips if m ^ x > m and m ^ x in place]
    return out


def links(distinct: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect all fingerprints within the radius. distinct: fp."""
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * 131 // 4_000_000)
    sent = distinct.select(F.explode(variants(F.col("fp"))).alias("variant"), "fp").repartition(parts, "variant").sortWithinPartitions("variant")

    def meet(batches):
        kept_v, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        forest: dict[int, int] = {}
        for batch in batches:
            v = np.concatenate([kept_v, batch.column(0).to_numpy()])
            f = np.concatenate([kept_f, batch.column(1).to_numpy().view(np.uint64)])
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
            end = starts[-1] if len(starts) else 0  # the last group may go on in the next batch
            kept_v, kept_f = v[end:], f[end:]
            unite(forest, links_of_groups(v[:end], f[:end], starts[:-1]))
            if len(forest) > MOST_LINKED:
                yield stars_of(forest)
                forest.clear()
        unite(forest, links_of_groups(kept_v, kept_f, np.zeros(min(1, len(kept_v)), np.int64)))
        yield stars_of(forest)

    def join(batches):
        forest: dict[int, int] = {}
        for batch in batches:
            unite(forest, zip(*(batch.column(i).to_numpy().view(np.uint64).tolist() for i in range(2))))
            if len(forest) > MOST_LINKED:
                yield stars_of(forest)
                forest.clear()
        yield stars_of(forest)

    # tasks know a fingerprint under different roots: where its links meet, the roots are linked once and the fingerprint keeps one link
    return sent.mapInArrow(meet, "a long, b long").repartition(parts, "b").mapInArrow(join, "a long, b long")


def stars_of(forest: dict[int, int]) -> pa.RecordBatch:
    """A link from each member to the root of its component."""
    ends = np.array([(root_of(forest, x), x) for x in forest], np.uint64).reshape(-1, 2)
    ends = ends[ends[:, 0] != ends[:, 1]].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])


def links_of_groups(v: np.ndarray, f: np.ndarray, starts: np.ndarray):
    """Links of all groups of equal variants. A pair that is alone in its groups is told in one of them."""
    sizes = np.diff(np.append(starts, len(v)))
    twos = starts[sizes == 2]
    a, b = f[twos], f[twos + 1]
    near = np.bitwise_count(a ^ b) <= RADIUS
    a, b, at = a[near], b[near], v[twos][near]
    own = at == meeting(a, b)
    yield from zip(a[own].tolist(), b[own].tolist())
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        yield from links_of_group(int(v[s]), np.unique(f[s : s + n]))


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One variant that both fingerprints of each pair have and under which links_of_group connects them."""
    out = np.full(len(a), -1, np.int64)
    least = np.minimum(a, b)
    bits = np.bitwise_count(a ^ b)
    for j, (at, size) in enumerate(BLOCKS):
        differ = rest_of(a ^ b, j)
        outside = np.bitwise_count(differ)
        inside = bits - outside
        fits = (out < 0) & ((inside <= 1) & (outside <= 2) | (inside == RADIUS))
        rest = rest_of(least, j) ^ np.where(outside == 2, differ & (~differ + np.uint64(1)), np.uint64(0))
        out = np.where(fits, rest.view(np.int64) | (j << 60), out)
    return out


def root_of(forest: dict[int, int], x: int) -> int:
    """The smallest member known of the component of x."""
    root = x
    while forest[root] != root:
        root = forest[root]
    while forest[x] != root:
        forest[x], x = root, forest[x]
    return root


def unite(forest: dict[int, int], pairs) -> None:
    for a, b in pairs:
        x, y = root_of(forest, a) if a in forest else forest.setdefault(a, a), root_of(forest, b) if b in forest else forest.setdefault(b, b)
        if x != y:
            forest[max(x, y)] = min(x, y)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node with a link. Alternating large-star and small-star steps."""

    old: list[DataFrame] = []

    def to_min(pairs: DataFrame) -> DataFrame:
        """u, v and m: the least of u and its neighbours."""
        least = stage(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least-neighbours")
        old.append(least)
        total = least.agg(F.sum("n")).first()[0] or 0
        hubs = least.where(F.col("n") * HUB_SHARE > total).select("u", "m")  # fewer than HUB_SHARE rows: their links would outnumber all
        rest = least.where(F.col("n") * HUB_SHARE <= total).select("u", "m")
        marked = pairs.join(F.broadcast(hubs), "u", "left")
        return marked.where("m is not null").unionByName(marked.where("m is null").drop("m").join(rest, "u"))

    def measure(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    both_ways = lambda df: df.union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
    every = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    # a node whose only link leads to a smaller one follows it: it needs no part in the steps
    leaves = stage(both_ways(every).groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1 and v < u").select("u", "v"), "leaves")
    now = stage(every.join(leaves.select("u"), "u", "left_anti"), "links")
    state = measure(now)
    while state[0]:
        large = to_min(both_ways(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = to_min(large)
        old.append(now)
        now = stage(small.select(F.col("u"), F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        while old:
            drop(old.pop())
        before, state = state, measure(now)
        if before == state:
            break
    inner = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    outer = leaves.join(inner, leaves.v == inner.node, "left").select(F.col("u").alias("node"), F.coalesce("root", "v").alias("root"))
    return inner.unionByName(outer)


def roots_of(distinct: DataFrame, rows: int) -> DataFrame:
    """node and root of every fingerprint with a link, roots included. distinct: fp."""
    stars = stage(components(links(distinct, rows)), "stars")
    free_shuffles(distinct.sparkSession)
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable), a row per document."""
    marked = stage(fingerprints(docs), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct-fingerprints")
    linked = distinct.join(roots_of(distinct.select("fp"), distinct.count()), F.col("fp") == F.col("node")).select("fp", "root", "doc")
    least = linked.groupBy("root").agg(F.min("doc").alias("least"))
    named = stage(linked.select("fp", "root").join(least, "root").select(F.col("fp").alias("own"), "least"), "named-components")
    known = distinct.join(named, F.col("fp") == F.col("own"), "left").select(F.col("fp").alias("own"), F.coalesce("least", "doc").alias("component_id"))
    return marked.join(known, F.col("fp") == F.col("own")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns.

    Of a group stays the row with the least doc_id (null ones last), of several texts with that id the one with the least hash;
    of repeated rows with one id and text, one. Only ids and hashes are shuffled beside the kept texts.
    """
    marked = stage(fingerprints(docs, hashed=True), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("first")), "distinct-fingerprints")
    roots = roots_of(distinct.select("fp"), distinct.count())
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    own = {c.lower() for c in docs.columns}
    id_name, hash_name = (next(x for x in (f"{base}{'_' * n}" for n in range(len(own) + 1)) if x not in own) for base in ("kept_id", "kept_hash"))
    kept = stage(grouped.select(F.col("first.doc_id").alias(id_name), F.col("first.text_hash").alias(hash_name)), "kept-documents")
    free_shuffles(docs.sparkSession)
    repeats = marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash"))
    repeats = stage(repeats, "repeated-documents")
    again = F.col(id_name).eqNullSafe(F.col("again_id")) & (F.col(hash_name) == F.col("again_hash"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_name)) & (F.xxhash64(docs["text"].cast("string")) == F.col(hash_name))
    once = docs.join(kept.join(repeats, again, "left_anti"), same, "left_semi")
    more = docs.join(kept.join(repeats, again, "left_semi"), same).dropDuplicates([id_name, hash_name])
    return once.unionByName(more.drop(id_name, hash_name))
