from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webcatalog.llm import packing, token_records
from webcatalog.llm.encode import encoder
from webcatalog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


PLAIN = Tokenizer.from_file(PATH)


def ids_of(text, end):
    ids = PLAIN.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_cached_encoding_equals_the_library():
    encode, plain = encoder(PATH), PLAIN
    parts = [*"ab .\n\t'sé1!, 　", "<|endoftext|>", " \n", "\n ", " '", "'s ", "über", "Wort,", "漢字", "x."]
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want, repr(text)


def test_op3_round_trip(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op3_token_records"](spark, FOLDER).collect()}
    start = 0
    for doc_id in sorted(texts):
        want = ids_of(texts[doc_id], 0)
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (start, len(want) // 4, zlib.crc32(want))
        start += len(want) // 4
    assert len(rows) == len(texts)


def test_records_frames_and_edges(spark, tmp_path):
    payload = b"abc"
    framed = token_records.frame(payload)
    assert bytes(token_records.unframe(framed, 0)) == payload
    for at in range(len(framed)):
        with pytest.raises(ValueError):
            token_records.unframe(framed[:at] + bytes([framed[at] ^ 1]) + framed[at + 1 :], 0)
    with pytest.raises(ValueError):
        token_records.unframe(framed[:-1], 0)
    rows = [(2, "b", 1), (2, "b", 1), (None, None, 2), (1, "", 3), (3, "w " * 9000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    token_records.write_records(docs, f"file://{tmp_path}/a", PATH)
    got = token_records.read_records(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3]
    assert [bytes(r.ids) for r in got] == [ids_of(t, 0) for t in (None, "", "b", "b", "w " * 9000)]
    mixed = token_records.read_records(spark, f"file://{tmp_path}/a", seed=1)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, got))
    token_records.write_records(docs.limit(0), f"file://{tmp_path}/b", PATH)
    assert token_records.read_records(spark, f"file://{tmp_path}/b").count() == 0


def checked(rows, texts, end=1, capacity=2048):
    """Asserts that the pieces hold each document once; the padding and all tokens."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        want, at = ids_of(text, end), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want) // 4
            assert r.ids_crc32 == zlib.crc32(want[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(want)
    padding = 0
    for window in sequences.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(r.length for r in rows)


def test_op6_packs_everything_once(spark, texts):
    padding, total = checked(QUERIES["op6_packing"](spark, FOLDER).collect(), texts)
    assert padding < 0.01 * total


def test_packing_edges(spark):
    texts = {1: "a", 2: None, 3: "", None: "c d", 5: "word " * 7000}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, offset int").repartition(3)
    rows = packing.pack(docs, PATH).collect()
    checked(rows, texts)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = packing.pack(docs.where("doc_id = 1").union(docs.where("doc_id = 1")), PATH).collect()
    assert [r.length for r in twice] == [2, 2]


def test_packer_keeps_its_bounds():
    rng = random.Random(2)
    packer = packing.Packer(capacity=64, places=4, slack=3)
    total = 0
    for k in range(2000):
        n = rng.choice([1, 5, 30, 63, 64, 65, 200])
        total += n
        packer.add(packing.Piece(k, 0, bytes(4 * n), n))
        assert len(packer.windows) == len(packer.free) <= 4
    rest = packer.finish()
    sizes = [sum(map(len, w)) for w in packer.emitted]
    assert min(sizes) >= 61 and max(sizes) == 64 and sum(sizes) + sum(map(len, rest)) == total
    assert sorted(sum(map(len, w)) for w in packing.powers(rest)) == [1 << b for b in range(7) if sum(map(len, rest)) >> b & 1]
