"""Benchmark decontamination by template canonicalisation.

Each token becomes a template token: numbers, units after a number, and names (capitalised words inside a sentence, but not
words all in capitals) are replaced by typed placeholders, other words by themselves, lower-cased and without edge punctuation. Windows of
``width`` template tokens are hashed and hash-joined to the benchmark's windows; a bounded bitmap of the benchmark's hashes
spares the join the windows that cannot match. A window with fewer than ``min_literals`` literals is hashed by its exact
values. An item's window matches whatever precedes it in a document: its first word may be literal, name or unit there,
and must then be the same word. Matches on one alignment of a document with an item count together, and
only if the slots agree: each value of the item stands for one value of the document and the reverse.
An alignment with ``min_windows`` windows (or all of the item's, if fewer), counting all of them or only those with
enough literals, is a leak: exact, or re-parameterised.

Edge cases: null or empty texts match nothing; items of fewer than ``min_literals`` words match nothing, items with fewer
literals than that only by their exact values; items shorter than a window are matched whole; repeated items and documents are
reported under their ids, once each, and rows that share an id (or have none) are matched row by row; null ids are reported as
null; an empty benchmark or table gives none; other columns are not read. ``decontaminate`` decides by row: a leaking text goes
whatever its id, even without one, and a clean text stays though its id leaks elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.columns import spare
from lattice.llm.memory import released, remember
from lattice.storage import bound_batches, stored

WIDTH, MIN_WINDOWS, MIN_LITERALS = 8, 6, 4
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
OWNER = "decontam"
UNITS = frozenset(b"% percent km m cm mm kg g mg lb lbs oz l ml s ms sec seconds second min minutes minute h hours hour days day weeks week months month years year miles mile feet foot ft inch inches meters metres meter metre kilometers kilometres kilograms grams liters litres dollars dollar euros euro usd eur cents pounds pound degrees c f k hz khz mhz ghz kb mb gb tb w kw mw v a".split())
_NUMBER = re.compile(rb"[$\xc2\xa3\xe2\x82\xac#]*[+-]?\d[\d,.:/]*(?:st|nd|rd|th|%|[a-z]{1,3})?$", re.I)
_EDGE = b"\"'()[]{}<>.,;:!?*&$%#|~`_-"
LITERAL, NUMBER, UNIT, NAME = range(4)
_SLOT = np.array([0x9AE16A3B2F90404F + i * 0x632BE59BD9B4E019 for i in range(4)], dtype=object)
_SLOT = np.array([int(x) & (2**64 - 1) for x in _SLOT], np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """word -> its value's 60-bit hash and, in the low bits: capitalised, ends a sentence, kind (number, unit word)."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_EDGE)
        low = bare.lower()
        kind = NUMBER if _NUMBER.match(bare) else UNIT if low in UNITS or word == b"%" else LITERAL
        letters = bare.decode("utf-8", "replace")
        title = letters[:1].isupper() and (len(letters) == 1 or not letters[1:].isupper())
        ends = word.rstrip(b"\"')]*&$%#!")[-1:] in (b".", b"?", b":") or word[-1:] in (b"!", b"?", b".")
        out = (xxhash.xxh3_64_intdigest(low) >> 4 << 4) | kind << 2 | ends << 1 | title
        if len(self) > 150_000:
            self.clear()
        self[word] = out
        return out


_words = _Words()


def template(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, slot kinds (0: a literal) and value hashes of the whole text's tokens."""
    words = (text or b"").split()
    packed = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    kind = (packed >> np.uint64(2) & np.uint64(3)).astype(np.int64)
    before = np.r_[LITERAL, kind[:-1]]
    ended = np.r_[True, (packed[:-1] >> np.uint64(1) & np.uint64(1)).astype(bool)]
    kind[(kind == UNIT) & (before != NUMBER)] = LITERAL
    kind[(kind == LITERAL) & (packed & np.uint64(1)).astype(bool) & ~ended] = NAME
    value = packed >> np.uint64(4)
    return np.where(kind == LITERAL, value, _SLOT[kind]), kind, value


def windows(tokens: np.ndarray, kind: np.ndarray, value: np.ndarray, width: int, min_literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows, in order, and whether each is a template: those with fewer literals are hashed by their exact values."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    plain = np.cumsum(np.r_[0, kind == LITERAL])
    rich = plain[width:] - plain[:n] >= min_literals
    h, poor = np.full(n, width, np.uint64), np.flatnonzero(~rich)
    for i in range(width):
        h = (h ^ tokens[i : i + n]) * _MUL
        h ^= h >> np.uint64(31)
    if len(poor):
        exact = np.where(kind == LITERAL, value, value ^ _SLOT[kind])
        x = np.full(len(poor), width + 256, np.uint64)
        for i in range(width):
            x = (x ^ exact[poor + i]) * _MUL
            x ^= x >> np.uint64(31)
        h[poor] = x
    return h, rich


def _item_windows(tokens: np.ndarray, kind: np.ndarray, value: np.ndarray, unit: np.ndarray, width: int, min_literals: int) -> Iterator[tuple]:
    """(place, hash, slot kinds, slot values, whether in the item's own form, whether the first slot must keep its value).

    What a window's first word is depends on the word before it, which in a document may be any: a heading, a line
    break, another sentence. So each window also occurs with its first word as literal, name and (unit words) unit.
    """
    for p in range(len(tokens) - width + 1):
        k, v, t = kind[p : p + width].copy(), value[p : p + width], tokens[p : p + width].copy()
        own = k[0]
        others = [] if own == NUMBER else [x for x in (LITERAL, UNIT, NAME) if x != own and (x != UNIT or unit[p])]
        for first in [own, *others]:
            k[0], t[0] = first, v[0] if first == LITERAL else _SLOT[first]
            h, _ = windows(t, k, v, width, min_literals)
            at = np.flatnonzero(k)
            yield p, int(h.view(np.int64)[0]), k[at].tolist(), v[at].view(np.int64).tolist(), first == own, int(first != own and first != LITERAL)


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(name: str) -> pa.Schema:
    more = [("level", pa.int32()), ("fixed", pa.int32()), ("needed", pa.int32()), ("needed_all", pa.int32())] if name == "item_id" else []
    more = more or [("row", pa.int64())]
    return pa.schema([(name, pa.int64()), ("place", pa.int32()), ("hash", pa.int64()), ("kinds", pa.list_(pa.int8())), (f"{name}_slots", pa.list_(pa.int64())), ("width", pa.int32()), *more])


def _cut_items(min_windows: int, min_literals: int):
    schema = _schema("item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember(OWNER, _words.clear)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, out = batch.slice(k, 256), []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    tokens, kind, value = template(text)
                    if len(tokens) < min_literals:
                        continue
                    width = min(WIDTH, len(tokens))
                    _, rich = windows(tokens, kind, value, width, min_literals)
                    needed = min(min_windows, np.count_nonzero(rich)), min(min_windows, len(rich))
                    unit = np.array([_words[w] >> 2 & 3 == UNIT for w in text.split()])
                    for p, x, kinds, slots, own, fixed in _item_windows(tokens, kind, value, unit, width, min_literals):
                        out.append((i, p, x, kinds, slots, width, (0 if own else 1) if rich[p] else 2, fixed, *needed))
                yield _rows(out, schema)

    return released(run, OWNER)


def _cut(widths: list[int], bitmap, min_literals: int):
    schema = _schema("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember(OWNER, _words.clear)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, out = batch.slice(k, 256), []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    tokens, kind, value = template(text)
                    row = xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)
                    for width in widths:
                        h, _ = windows(tokens, kind, value, width, min_literals)
                        spot = (h & np.uint64(8 * len(bitmap.value) - 1)).astype(np.int64)
                        at = np.flatnonzero(bitmap.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
                        for p, x in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True):
                            slots = np.flatnonzero(kind[p : p + width])
                            out.append((i, p, x, kind[p + slots].tolist(), value[p + slots].view(np.int64).tolist(), width, row))
                yield _rows(out, schema)

    return released(run, OWNER)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_windows: int = MIN_WINDOWS, min_literals: int = MIN_LITERALS) -> DataFrame:
    """doc_id, item_id, n_windows, n_slots, exact: the items that each document repeats, at their best alignment."""
    bound_batches(spark)
    ddl = "{0} long, place int, hash long, kinds array<byte>, {0}_slots array<long>, width int"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = stored(spark, items.mapInArrow(_cut_items(min_windows, min_literals), ddl.format("item_id") + ", level int, fixed int, needed int, needed_all int"), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most WIDTH of them
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (16 * items.count()).bit_length()))
    spots = items.select((F.col("hash").bitwiseAND(bits - 1) + 1).alias("b"))
    maps = spots.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for k, m in maps.collect():  # bounded by MAX_BITS
        bitmap[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_cut(widths or [WIDTH], shared, min_literals), ddl.format("doc_id") + ", row long")
    items = items.select("item_id", F.col("place").alias("item_place"), "hash", "width", "item_id_slots", "level", "fixed", "needed", "needed_all")
    both = found.join(items, ["hash", "width"]).where((F.col("fixed") == 0) | (F.get("item_id_slots", F.lit(0)) == F.get("doc_id_slots", F.lit(0))))
    pairs = F.transform(F.arrays_zip("kinds", "item_id_slots", "doc_id_slots"), lambda z: F.struct(z.kinds.alias("k"), z.item_id_slots.alias("i"), z.doc_id_slots.alias("d")))
    pairs = F.slice(pairs, F.col("fixed") + 1, F.size("kinds"))  # a fixed first slot is settled
    # level 0: templates as the item has them, 1: with another first word, 2: exact values. More windows may hold slots that
    # disagree, so each level stands alone.
    upto = lambda level, c: F.when(F.col("level") <= level, c)
    sums = [(F.count_distinct(upto(v, F.col("item_place"))).alias(f"n{v}"), F.array_distinct(F.flatten(F.collect_set(upto(v, pairs)))).alias(f"s{v}")) for v in range(3)]
    aligned = both.groupBy("doc_id", "row", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.min("needed").alias("m0"), F.min("needed_all").alias("m2"), *(c for two in sums for c in two))
    tried = F.array(*(F.struct(F.col(f"n{v}").alias("n_windows"), F.col(f"s{v}").alias("slots"), F.col("m2" if v == 2 else "m0").alias("needed")) for v in range(3)))
    aligned = aligned.select("doc_id", "item_id", F.inline(tried))
    n_of = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(*(s[n] for n in names)))))
    agrees = (n_of("k", "i") == F.size("slots")) & (n_of("k", "d") == F.size("slots"))
    leaks = aligned.where((F.col("needed") > 0) & (F.col("n_windows") >= F.col("needed")) & agrees)
    exact = F.forall("slots", lambda s: s.i == s.d)
    best = F.max(F.struct("n_windows", exact.alias("exact"), F.size("slots").cast("long").alias("n_slots")))
    leaks = leaks.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return leaks.select("doc_id", "item_id", "b.n_windows", "b.n_slots", "b.exact")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that leak no benchmark item, with their own columns; decided by the text of each row."""
    (name,) = spare(docs.columns, "leak")
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text")
    leaks = find_leaks(spark, texts, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    leaks = stored(spark, leaks, "leaks")
    return docs.join(leaks, F.xxhash64(F.col("text").cast("string")) == F.col(name), "left_anti").select(*docs.columns)
