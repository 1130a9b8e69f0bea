"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model's protobuf is parsed here, field by field: pieces, scores and types, the kind of model, the normaliser and byte fallback. From
these the backend is rebuilt: the precompiled character map and white-space rules as normaliser, the space marker, and the scores as a
unigram model or, where the file holds a BPE model (as the one installed here does), as merges ordered by score; byte fallback spells what
has no piece.

No piece of such a model holds the marker after another character, which is checked when the model is read; a text's words can thus be encoded
apart. Each task encodes each distinct word once: new words, joined to texts of CHUNK words, go to the backend in multithreaded batches, and so
they go to the sentencepiece library. The ids that are returned are always the backend's; parity is reported for each text as the number
of its words that the library encodes otherwise, whatever a worker has met before. Other texts (runs of spaces, character maps) are
encoded whole, in batches as well.

Defined cases: a null or empty text has no ids; a text of any length is encoded whole, word by word, its ids as one row; repeated rows each get a
row; an empty table gives an empty result; other columns are ignored. There are no ties: merges of equal score are ordered by their pieces' ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prosa.llm.common import worker_cache

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: Words in a text of a batch.
CHUNK = 128


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown_id: int = 0
    character_map: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True


def fields(data: bytes):
    """(number, value) of each field of a protobuf message; length-delimited and fixed ones as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> PieceModel:
    model = PieceModel()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback, model.unknown_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
        elif number == 3:
            spec = dict(fields(value))
            model.character_map, model.dummy_prefix, model.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return model


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    out = []
    for piece, i in ids.items():
        halves = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        out += [(-model.pieces[i][1], ids[a], ids[b], a, b) for a, b in halves]
    return [(a, b) for *_, a, b in sorted(out)]


def backend(model: PieceModel):
    """The rebuilt tokenizer."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = model.pieces[model.unknown_id][0]
    if model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown_id, byte_fallback=model.byte_fallback))
    elif model.kind == BPE:
        tokenizer = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"models of kind {model.kind} are not supported")
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if separable(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]*"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    if own := [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]:
        tokenizer.add_tokens(own)
    return tokenizer


def separable(model: PieceModel) -> bool:
    """No piece holds the marker after another character: words can be encoded apart."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


class Codec:
    """Encodes texts with the backend, compared to the sentencepiece library, and decodes ids."""

    def __init__(self, path: str, cached_words: int, threads: int):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))  # the backend reads it with its first batch
        self.model = read_model(path)
        self.backend, self.peer = backend(self.model), sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads, self.cached_words, self.cache = threads, cached_words, {}
        self.apart = separable(self.model) and self.model.dummy_prefix and not self.model.squeeze and not self.model.character_map and not any(k == USER_DEFINED for *_, k in self.model.pieces)
        self.begins = np.array([p.startswith(MARK) for p, *_ in self.model.pieces])
        self.spelt = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.unlike: set[str] = set()  # cached words that the library encodes otherwise

    def batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The backend's ids of each text, by a multithreaded batch, and whether the library's are the same."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if self.threads > 1 else "false"  # other operators of this worker may have set it
        own = [np.array(x.ids, "<u4") for x in self.backend.encode_batch(texts, add_special_tokens=False)]
        peer = self.peer.encode(texts, num_threads=self.threads)
        return own, [np.array_equal(a, np.array(b, "<u4")) for a, b in zip(own, peer)]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of words, each with a space before it, into the cache."""
        chunks = [words[at : at + CHUNK] for at in range(0, len(words), CHUNK)]
        alone: list[str] = []
        for chunk, ids, same in zip(chunks, *self.batch([" ".join(c) for c in chunks])):
            starts = np.flatnonzero(self.begins[ids])
            if same and len(starts) == len(chunk):
                packed, ends = ids.tobytes(), np.append(starts, len(ids)) * 4
                self.cache.update((w, packed[a:b]) for w, a, b in zip(chunk, ends[:-1].tolist(), ends[1:].tolist()))
            else:
                alone += chunk
        for word, ids, same in zip(alone, *self.batch(alone)):
            self.cache[word] = ids.tobytes()
            if not same:
                self.unlike.add(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The backend's ids as little-endian unsigned 32-bit numbers."""
        return [ids for ids, _ in self.checked(texts)]

    def checked(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """encode() of each text, and how many of its words (1 for a text that is encoded whole) the library encodes otherwise."""
        cut = [t.split(" ") if t else [] for t in texts] if self.apart else [None] * len(texts)
        if len(self.cache) > self.cached_words:
            self.cache.clear()
            self.unlike.clear()
        wanted: set[str] = set()
        for parts in cut:
            wanted.update(parts or ())
        self.learn([w for w in wanted if w and MARK not in w and w not in self.cache])
        out: list = []
        whole: list[int] = []
        for k, parts in enumerate(cut):
            try:
                if parts is None:
                    raise KeyError
                out.append((b"".join(map(self.cache.__getitem__, parts)), sum(map(self.unlike.__contains__, parts)) if self.unlike else 0))
            except KeyError:  # spaces beside spaces, or a model whose words can't be encoded apart
                whole.append(k)
                out.append(None)
        for k, ids, same in zip(whole, *self.batch([texts[k] for k in whole])):
            out[k] = (ids.tobytes(), int(not same))
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.spelt.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def codec_of(path: str, cached_words: int = 400_000, threads: int | None = None) -> Codec:
    """A worker's codec. threads: two at least, by default as many as a task has cores."""
    from pyspark import TaskContext

    cache, task = worker_cache("codecs"), TaskContext.get()
    threads = threads or max(2, task.cpus() if task else 2)
    if (path, threads) not in cache:
        cache[path, threads] = Codec(path, cached_words, threads)
    return cache[path, threads]


def encode(docs: DataFrame, model: str, threads: int | None = None) -> DataFrame:
    """doc_id and ids (array of int), a row per document."""

    def scan(batches):
        codec = codec_of(model, threads=threads)
        for batch in batches:
            ids = codec.encode([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of doc_id and ids; null ids count as none."""

    def scan(batches):
        codec = codec_of(model)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(scan, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, threads: int | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_unlike (the text's words that the sentencepiece library encodes otherwise) and round_trip (the ids decode to the text)."""

    def scan(batches):
        codec = codec_of(model, threads=threads)
        for batch in batches:
            doc_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(doc_ids), 512):
                texts = [x or "" for x in all_texts[at : at + 512]]
                found = codec.checked(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[at : at + 512], pa.int64()), pa.array([len(x) // 4 for x, _ in found], pa.int64()), pa.array([zlib.crc32(x) for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array([codec.decode(x) == t for (x, _), t in zip(found, texts)])],
                    names=["doc_id", "n_ids", "ids_crc32", "n_unlike", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n_ids long, ids_crc32 long, n_unlike long, round_trip boolean")
