"""Token-id output: Elias-Fano document boundaries over one concatenated id array per shard.

A shard is a self-describing byte string (format LTOK, version 1), stored as a row of a Parquet table in the
shared folder, so Spark's commit protocol covers lost executors:

    header   16 little-endian 8-byte integers, see ``HEADER``
    parts    boundary low bits, boundary high bits, boundary samples, document-id low bits, high bits,
             samples, token ids (2 bytes each where the vocabulary allows, else 4)

Edge cases: null or empty text is a document holding only the end id; a null doc_id sorts first and comes back
as null; repeated doc_ids are kept, ordered by text; one document of any length stays in one shard; an empty
table gives no shards. Only (doc_id, text) are read, so further columns cannot clash.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.llm.memory import released, remember
from lattice.storage import bound_batches, stored

MAGIC = int.from_bytes(b"LTOK0001", "little")
HEADER = ("magic", "n_docs", "n_null", "n_tokens", "id_width", "first_id", "b_low", "b_lows", "b_highs", "b_samples", "i_low", "i_lows", "i_highs", "i_samples", "seq", "reserved")
SAMPLE = 64
SHARD_TOKENS = 4_000_000
CACHE_UNITS, REST_UNITS, CALL_PIECES = 500_000, 250_000, 256
#: Bytes of text cut at once, for each unit that a worker may remember.
SLICE_BYTES = 16
OWNER = "tokens"
TAIL = "!#$%&()*+,-./:;<=>?@[]^_{|}~\""
SHARDS = "range_no int, seq int, n_docs long, n_tokens long, payload binary"


class EliasFano:
    """A non-decreasing sequence of n integers in about 2 + log2(max / n) bits each.

    The low bits are packed; the high bits are a unary bitmap. Every 64th set bit's place is sampled,
    so ``select(i)`` scans a bounded stretch of the bitmap instead of a 64-bit table.
    """

    def __init__(self, n: int, low_bits: int, lows: bytes, highs: bytes, samples: bytes):
        self.n, self.low_bits, self.lows, self.highs, self.samples = n, low_bits, lows, highs, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = b""
        if low and n:
            bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
            lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bitmap = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bitmap[places] = 1
        return cls(n, low, lows, np.packbits(bitmap, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        chunk = int.from_bytes(self.lows[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return chunk >> (first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i without decoding the others."""
        place = int.from_bytes(self.samples[4 * (i // SAMPLE) : 4 * (i // SAMPLE) + 4], "little")
        left, byte = i % SAMPLE, place // 8
        word = self.highs[byte] >> (place % 8) << (place % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.highs[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little")[: self.n * self.low_bits]
            weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
            out |= bits.reshape(self.n, self.low_bits).astype(np.uint64) @ weights
        return out.astype(np.int64)


def pack_shard(doc_ids: list, ends: np.ndarray, ids: bytes | bytearray, id_width: int, seq: int) -> bytes:
    """Bytes of a shard; doc_ids ascending, nulls first; ends are cumulative token counts."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    bounds, names = EliasFano.build(ends), EliasFano.build((known - first).astype(np.uint64))
    head = (MAGIC, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]), id_width, first, bounds.low_bits, len(bounds.lows), len(bounds.highs), len(bounds.samples), names.low_bits, len(names.lows), len(names.highs), len(names.samples), seq, 0)
    return b"".join((np.array(head, "<i8").tobytes(), bounds.lows, bounds.highs, bounds.samples, names.lows, names.highs, names.samples, ids))


class Shard:
    """Random access to a packed shard."""

    def __init__(self, payload: bytes):
        head = dict(zip(HEADER, np.frombuffer(payload, "<i8", len(HEADER)).tolist(), strict=True))
        if head["magic"] != MAGIC:
            raise ValueError("not a token shard")
        at = 8 * len(HEADER)
        parts = []
        for name in ("b_lows", "b_highs", "b_samples", "i_lows", "i_highs", "i_samples"):
            parts.append(payload[at : at + head[name]])
            at += head[name]
        self.n_docs, self.n_null, self.first_id = head["n_docs"], head["n_null"], head["first_id"]
        self.bounds = EliasFano(self.n_docs, head["b_low"], *parts[:3])
        self.names = EliasFano(self.n_docs - self.n_null, head["i_low"], *parts[3:])
        self.ids = np.frombuffer(payload, "<u2" if head["id_width"] == 2 else "<u4", head["n_tokens"], at)

    def doc_ids(self) -> list:
        return [None] * self.n_null + (self.names.all() + self.first_id).tolist()

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]


class _Encoder:
    """Encodes texts with the tokenizers library; pieces are encoded once and remembered.

    A byte-level BPE never joins a non-space to the white space after it, nor a letter or digit to the punctuation after it.
    So a text cut before each single space or newline between two other characters, and before the
    punctuation that ends such a piece, encodes piece by piece. Other texts, and those that hold an added token such as
    an end-of-text mark, which the library gives its own id, are encoded as they are.

    Arrow cuts a batch and finds its different units, so Python sees each unit once a batch. A unit is what follows a space;
    what follows a newline keeps it, and a newline set before each text, whose id is taken off again, makes its start one of
    these.
    """

    cached: dict[tuple, _Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.uint16 if self.width == 2 else np.uint32
        vocabulary = self.tok.get_vocab()
        self.by_piece = "Ġ" in vocabulary and "Ċ" in vocabulary and self.tok.normalizer is None
        #: Added tokens are found in a text before it is cut into pieces, so texts that hold one go to the library whole.
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.newline = np.array([vocabulary.get("Ċ", 0)], self.kind).tobytes()
        self.lengths = np.zeros(size, np.int64)
        for word, i in vocabulary.items():
            self.lengths[i] = len(word)
        #: Ids by unit, empty where a unit cannot be encoded by itself: those that came in several batches, and the others.
        self.kept: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}  # punctuation after a letter or digit

    @classmethod
    def of(cls, path: str) -> _Encoder:
        if path not in cls.cached:
            cls.cached[path] = cls(path)
        return cls.cached[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    @staticmethod
    def _splits(core: str) -> bool:
        """Whether the punctuation after it can be cut off: it ends in a Latin letter or an ASCII digit."""
        last = core[-1:]
        return last < "\u0250" and (last.isalpha() or (last.isascii() and last.isalnum()))

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self._whole(tail)
        return self.tails[tail]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each led by its own space or newline and free of both inside."""
        out: list[bytes] = []
        for k in range(0, len(pieces), CALL_PIECES):
            part = pieces[k : k + CALL_PIECES]
            text = "".join(part)
            raw = np.frombuffer(text.encode(), np.uint8)
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(self.lengths[ids])
            goal = np.append(np.flatnonzero((raw == 32) | (raw == 10))[1:], len(raw))
            cuts = np.searchsorted(ends, goal)
            if len(ids) and len(goal) == len(part) and ends[-1] == goal[-1] and (ends[cuts] == goal).all():
                whole, stops = ids.astype(self.kind).tobytes(), ((cuts + 1) * self.width).tolist()
                out += map(whole.__getitem__, map(slice, [0, *stops], stops))
            else:
                out += map(self._whole, part)
        return out

    def _found(self, units: list[str]) -> list[bytes]:
        """Ids of a batch's units, each of them once; empty for those that begin or end in white space beside a leading newline."""
        kept, young = self.kept, self.young
        found = list(map(kept.get, units))
        fresh: list[int] = []
        pairs: list[tuple[int, str, str]] = []
        for i, ids in enumerate(found):
            if ids is not None:
                continue
            u = units[i]
            ids = young.pop(u, None)
            if ids is not None:
                found[i] = kept[u] = ids
                continue
            if u.isalpha():
                fresh.append(i)
                continue
            x = u[1:] if u[:1] == "\n" else u
            if not x or x[0].isspace() or x[-1].isspace():
                found[i] = young[u] = b""
                continue
            core = u.rstrip(TAIL)
            if len(core) == len(u) or not self._splits(core):
                fresh.append(i)
            else:
                pairs.append((i, core, u[len(core) :]))
        learned = [units[i] for i in fresh]
        for i, u, ids in zip(fresh, learned, self._encode_units(learned), strict=True):
            found[i] = young[u] = ids
        cores = list(dict.fromkeys(c for _, c, _ in pairs if c not in kept and c not in young))
        young.update(zip(cores, self._encode_units(cores), strict=True))
        for i, core, tail in pairs:
            ids = kept[core] if core in kept else young[core]
            found[i] = young[units[i]] = ids and ids + self._tail(tail)
        return found

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of units; empty if a leading newline has no id of its own."""
        pieces = [u if u[0] == "\n" else " " + u for u in units]
        return [b"" if p[0] == "\n" and not ids.startswith(self.newline) else ids for p, ids in zip(pieces, self._encode_pieces(pieces), strict=True)]

    def forget(self, most: int, keep: int) -> None:
        """Where more than ``most`` units came again, the ``keep`` that did so first stay, frequent ones; of the others the latest."""
        if len(self.kept) > most:
            self.kept = dict(islice(self.kept.items(), keep))
        if len(self.young) > most:
            self.young = dict(islice(self.young.items(), len(self.young) - keep, None))

    def batch(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.large_string()))

    def encode(self, texts: pa.Array, most: int = CACHE_UNITS) -> list[bytes]:
        """Ids of each text, little-endian; null counts as empty. ``most``: units of either kind that are remembered."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return []
        if not self.by_piece:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        self.forget(most, most // 2)
        gc.disable()  # only strings and bytes are made, in no cycles, and the tables of pieces are long to walk
        try:
            return self._by_piece(texts)
        finally:
            gc.enable()

    def _by_piece(self, texts: pa.Array) -> list[bytes]:
        first, glue = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        cut = pc.split_pattern(pc.binary_join_element_wise(first, pc.replace_substring(texts, "\n", " \n"), glue), " ")
        firsts = cut.offsets.to_numpy()[:-1]
        units = cut.flatten().dictionary_encode()
        del cut  # a copy of the texts, and larger than they are with its offsets
        found = self._found(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        placed = units.indices.to_numpy()
        ends = np.cumsum(np.add.reduceat(sizes[placed], firsts, dtype=np.int64))  # a text has one unit at least
        whole = np.logical_or.reduceat((sizes == 0)[placed], firsts)
        payload = memoryview(pa.array(found, pa.large_binary()).take(units.indices).buffers()[2] or b"")
        for mark in self.added:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        return [self._whole(texts[i].as_py()) if w else bytes(payload[a + self.width : b]) for i, (w, a, b) in enumerate(zip(whole.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True))]


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of (doc_id, text) in slices of at most ``most`` bytes of text, or one longer text: cutting takes several times that."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False))
    first, before = 0, 0
    while first < len(ends):
        stop = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, stop - first)
        first, before = stop, int(ends[stop - 1])


def _shards(path: str, end_id: int, shard_tokens: int, known_units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(path)
        remember(OWNER, _Encoder.cached.clear)
        end = np.array([end_id], encoder.kind).tobytes()
        schema = pa.schema([("range_no", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
        place, seq, names, sizes, ids, held = TaskContext.get().partitionId(), 0, [], [], bytearray(), 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum(np.array(sizes, np.int64))
            payload = pack_shard(names, ends, ids, encoder.width, seq)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([place], [seq], [len(names)], [int(ends[-1])], [payload]), schema, strict=True)], schema=schema)

        for batch in batches:
            for part in _slices(batch, SLICE_BYTES * known_units):
                for d, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1), known_units), strict=True):
                    names.append(d)
                    ids += raw
                    ids += end
                    sizes.append(len(raw) // encoder.width + 1)
                    held += sizes[-1]
                    if held >= shard_tokens:
                        yield flush()
                        seq, names, sizes, ids, held = seq + 1, [], [], bytearray(), 0
        if names:
            yield flush()
        encoder.forget(known_units // 2, known_units // 2)  # the worker may wait long for its next task

    return released(run, OWNER)


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, known_units: int = CACHE_UNITS) -> DataFrame:
    """Encode (doc_id, text) into shards in ascending doc_id order; returns the stored shard table.

    ``known_units`` bounds what a worker remembers and cuts at once: fewer take less memory and more time, the shards are the same.
    """
    bound_batches(spark)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(spark, ranged.mapInArrow(_shards(tokenizer_path, end_id, shard_tokens, known_units), SHARDS), "token_shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("range_no", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32")
    for batch in batches:
        for place, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            shard = Shard(payload)
            ends = shard.bounds.all()
            starts = np.r_[0, ends[:-1]]
            crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = shard.n_docs
            yield pa.RecordBatch.from_arrays([pa.array([place] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.doc_ids(), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=list(names))


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the stored bytes: doc_id, start, n_tokens, ids_crc32.

    Only shard sizes (a row per shard) are ordered globally; the ids stay where they are read.
    """
    ahead = Window.orderBy("range_no", "seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("range_no", "seq", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("before"))
    rows = shards.select("range_no", "seq", "payload").mapInArrow(released(_read, OWNER), "range_no int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(sizes, ["range_no", "seq"]).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
