import zlib

import numpy as np
import pytest

from logsieve.llm import packing
from logsieve.llm.queries import END_ID, VOCABULARY_SIZE, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
@pytest.mark.parametrize("block", [1, 5, 8, 64])
def test_round_trip_of_bits(bits, block):
    rng = np.random.default_rng(bits)
    documents = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 1, 7, 100)]
    file = packing.Packed(packing.to_bytes([4, 5, 6, 7], documents, bits, block))
    flat = np.concatenate(documents)
    assert (file.ids(0, len(flat)) == flat).all() and list(file.doc_ids) == [4, 5, 6, 7]
    for a, b in [(0, 0), (3, 4), (5, 50), (99, 108)]:
        assert (file.ids(a, b) == flat[a:b]).all()


def test_bits_for():
    assert [packing.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def expected(rows):
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary_path())
    ids = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4")) for d, t in rows]
    return {d: (len(i), zlib.crc32(i.tobytes())) for d, i in ids}


TEXTS = [
    (3, "The  QUICK brown fox's 123 don't"), (1, "a\x01b \x01 \x1c x\x85y <|endoftext|> é é ́x İ ΑΣ"), (2, None), (9, ""), (4, "same"), (5, "same İ Å <|ENDOFTEXT|> UPPER"), (6, "İ Å Ḱ UPPER'S"), (-7, "x" * 5000),
]


def test_whole_texts_in_id_order(documents):
    rows = [(d, t, None, None) for d, t in TEXTS]
    found = packing.round_trip(documents(rows), vocabulary_path(), VOCABULARY_SIZE, END_ID, block=16, ids_per_file=20, shards=3).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in found} == expected(TEXTS)
    start = 0
    for r in sorted(found, key=lambda r: r.doc_id):
        assert r.start == start
        start += r.n_tokens


def test_odd_rows(documents):
    found = packing.round_trip(documents(), vocabulary_path(), VOCABULARY_SIZE, END_ID).collect()
    assert len(found) == 10 and sorted(r.start for r in found if r.doc_id is None)[0] == 0
    assert len({r.start for r in found}) == 10
    assert packing.round_trip(documents([]), vocabulary_path(), VOCABULARY_SIZE, END_ID).collect() == []


def test_cache_limit_changes_nothing():
    texts = [t or "" for _, t in TEXTS] + ["other words here"]
    load = packing.from_file(vocabulary_path())
    small, large = packing.WordEncoder(load, 2, 1), packing.WordEncoder(load)
    for text in texts * 2:
        assert small.encode(text).tolist() == large.encode(text).tolist()


def test_words_before_stops_are_those_of_the_whole_path():
    """Words of ASCII letters go to the merges as they are, others as byte letters; stops after either are a piece."""
    encoder = packing.WordEncoder(packing.from_file(vocabulary_path()))
    for word in ["Plain", "plain.", "WORDS..,", "straße.", "éa,", "x2.", "don't.", "東京.", "...", "a.b,", "\u0660.", "_.", "ſo."]:
        assert encoder.encode(word).tolist() == encoder._whole(word)
    assert b"plain" in encoder._pieces
