import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattice.llm import tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def plain(texts):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(0, 10**6), max_size=300))
def test_elias_fano_round_trip(values):
    v = np.cumsum(values)
    ef = tokens.EliasFano.build(v)
    assert ef.all().tolist() == v.tolist()
    assert [ef.select(i) for i in range(len(v))] == v.tolist()


def test_elias_fano_is_small():
    v = np.arange(0, 10_000 * 700, 700)
    ef = tokens.EliasFano.build(v)
    assert len(ef.lows) + len(ef.highs) + len(ef.samples) < 10_000 * 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab1.,' \n\t é漢<|>$", "end", "<|endoftext|>", " <|endoftext|>", "<|endoftext|"]), max_size=40).map("".join), max_size=6))
def test_units_encode_like_whole_texts(texts):
    got = tokens._Encoder.of(PATH).batch(texts)
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == plain(texts)


def test_added_tokens_take_their_own_id():
    got = [np.frombuffer(g, np.uint16).tolist() for g in tokens._Encoder.of(PATH).batch(["a <|endoftext|>b", "<|endoftext|>"])]
    mark = Tokenizer.from_file(PATH).token_to_id("<|endoftext|>")
    assert got == plain(["a <|endoftext|>b", "<|endoftext|>"]) and got[1] == [mark] and mark in got[0]


def test_shard_access():
    ids = np.array([5, 6, 0, 0, 7, 0], np.uint16)
    shard = tokens.Shard(tokens.pack_shard([None, 3, 9], np.array([3, 4, 6]), ids.tobytes(), 2, 0))
    assert shard.doc_ids() == [None, 3, 9]
    assert [shard.tokens(i).tolist() for i in range(3)] == [[5, 6, 0], [0], [7, 0]]
    with pytest.raises(ValueError):
        tokens.Shard(b"\0" * 200)


def test_files_round_trip(spark):
    rows = [(9, "Hello world, hello  world"), (2, None), (5, ""), (7, "x " * 5000), (7, "a"), (None, "no id"), (1, "<|endoftext|> is text")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, seq string, n_tokens int").repartition(3)
    out = tokens.read_shards(tokens.write_shards(spark, df, PATH, shard_tokens=1000)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for (d, _), ids in zip(order, plain([t or "" for _, t in order]), strict=True):
        ids = [*ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_shards(tokens.write_shards(spark, df, PATH)).count() == 0


def counted(monkeypatch):
    """A new encoder, and the pieces it gives to the library."""
    encoder, asked = tokens._Encoder(PATH), []
    encode = encoder._encode_pieces
    monkeypatch.setattr(encoder, "_encode_pieces", lambda pieces: asked.extend(pieces) or encode(pieces))
    return encoder, asked


def test_units_that_come_again_stay_known_between_tasks(monkeypatch):
    encoder, asked = counted(monkeypatch)
    encoder.batch(["x " + " ".join(f"junk{i}" for i in range(tokens.REST_UNITS))])
    texts = ["x zwiebelkuchen, straßenbahnen.\nZwiebelkuchen"]
    encoder.batch(texts)
    encoder.batch(texts)
    encoder.forget(tokens.REST_UNITS, tokens.REST_UNITS)
    asked.clear()
    got = encoder.batch(texts)
    assert asked == []
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == plain(texts)


def test_a_text_start_and_a_line_start_are_one_unit(monkeypatch):
    encoder, asked = counted(monkeypatch)
    calls, whole = [], encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda text: calls.append(text) or whole(text))
    texts = ["Ostern kommt", "es ist so\nOstern kommt", "'s ist so", "so\n's", "\n", "", " so", "so\n\nso", "so \nso", "so\t\nso"]
    got = encoder.batch(texts)
    assert asked.count("\nOstern") == 1 and not {"Ostern kommt", "Ostern"} & set(calls)
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == plain(texts)


def test_another_operator_drops_the_known_units():
    from lattice.llm.memory import released, remember

    remember(tokens.OWNER, tokens._Encoder.cached.clear)
    encoder = tokens._Encoder.of(PATH)
    assert list(released(iter, tokens.OWNER)([])) == [] and tokens._Encoder.of(PATH) is encoder
    assert list(released(iter)([])) == [] and not tokens._Encoder.cached


def test_another_operator_drops_known_words_and_shapes():
    from lattice.llm import decontam, quality
    from lattice.llm.memory import released

    batch = pa.RecordBatch.from_pydict({"id": [1], "text": ["Seven of 12 boats sank near the old harbour wall today."], "y": [1]})
    assert list(decontam._cut_items(6, 4)([batch])) and decontam._words
    assert list(released(quality._train_bags, quality.OWNER)([batch])) and quality._shapes and not decontam._words
    assert list(released(iter)([])) == [] and not quality._shapes


def test_a_worker_cuts_and_remembers_no_more_than_it_may(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(tokens, "TaskContext", Task)
    encoder, cut = tokens._Encoder.of(PATH), []
    encoder.kept.clear()
    encoder.young.clear()
    encode = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda texts, *most: cut.append(texts) or encode(texts, *most))
    texts = [" ".join(f"unit{(k * 37 + i) % 4000}" for i in range(k % 90)) for k in range(400)] + ["long " * 5000, None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    whole = [b.to_pydict() for b in tokens._shards(PATH, 0, 20_000, tokens.CACHE_UNITS)([batch])]
    assert len(cut) == 1 and len(encoder.kept) + len(encoder.young) > 1000
    cut.clear()
    few = [b.to_pydict() for b in tokens._shards(PATH, 0, 20_000, 500)([batch])]
    assert few == whole and sum(b["n_docs"][0] for b in few) == len(texts)
    assert len(encoder.kept) <= 250 and len(encoder.young) <= 250
    assert len(cut) > 10 and all(len(c) == 1 or sum(len(t or "") for t in c.to_pylist()) <= 500 * tokens.SLICE_BYTES for c in cut)
