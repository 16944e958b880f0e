import zlib

import numpy as np
import pytest

from wakeline.llm import packing
from wakeline.llm.byte_tokens import ByteEncoder
from wakeline.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(rows, texts, tokenizer, window=packing.WINDOW):
    """Every document is cut without gap or overlap, every sequence is gapless, full or of a power of two, and ids are right."""
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for _, t in texts]
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    expected = {}
    for (doc_id, _), x in zip(texts, ids):
        expected.setdefault(doc_id, []).append(x)
    assert set(pieces) == set(expected)
    for doc_id, own in expected.items():
        if len(own) == 1:
            x, at = own[0], 0
            for p in sorted(pieces[doc_id], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(x)
                part = np.array(x[at : at + p["length"]], "<u4").tobytes()
                assert np.frombuffer(bytes(p["ids"]), f"<u{p['width']}").astype("<u4").tobytes() == part and zlib.crc32(part) == p["ids_crc32"]
                at += p["length"]
            assert at == len(x)
        else:
            assert sum(p["length"] for p in pieces[doc_id]) == sum(map(len, own))
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = []
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == window or n & (n - 1) == 0 and n < window for n in sizes)
    assert sum(n < window for n in sizes) <= window.bit_length()
    return sizes


def test_whole_table(documents, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    check(packing.packed(documents).collect(), texts, tokenizer)


def test_odd_rows(make, odd_rows, tokenizer):
    check(packing.packed(make(odd_rows, clashing=True)).collect(), [r[:2] for r in odd_rows], tokenizer)


def test_empty_table(make):
    assert packing.packed(make([])).count() == 0
    assert packing.sequences(packing.packed(make([]))).count() == 0


def test_one_hot_length(make, tokenizer):
    texts = [(i, "the same words again and again") for i in range(3000)]
    sizes = check(packing.packed(make(texts), window=64).collect(), texts, tokenizer, 64)
    assert sum(sizes) == 3000 * (len(tokenizer.encode(texts[0][1], add_special_tokens=False).ids) + 1)


def test_sequences_hold_their_pieces(documents):
    placed = packing.packed(documents).cache()
    whole = packing.sequences(placed).collect()
    pieces = {(r["sequence_id"], r["offset"]): r for r in placed.collect()}
    assert len(whole) == len({k[0] for k in pieces}) and sum(len(r["pieces"]) for r in whole) == len(pieces)
    for r in whole:
        assert len(r["ids"]) == r["length"] * r["width"]
        for p in r["pieces"]:
            own = pieces[r["sequence_id"], p["offset"]]
            assert bytes(r["ids"])[p["offset"] * r["width"] :][: len(own["ids"])] == bytes(own["ids"])


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_every_rest_once(seed):
    rng = np.random.default_rng(seed)
    window = 64
    h = rng.integers(0, 40, window) * (rng.random(window) < (1.0, 0.1, 0.03, 1.0)[seed])
    h[0] = 0
    if seed == 3:
        h[39] = 5000
    cover, line = {}, []
    for kind, lo, hi, start, length, at, stride in packing.plan(h, window):
        for j in range(hi - lo):
            cover.setdefault((kind, lo + j), []).append((start, length))
            line.append((at + j * stride, length))
    assert len(cover) == h.sum()
    for (kind, rank), parts in cover.items():
        assert 0 <= rank < h[kind] and sum(p[1] for p in parts) == kind
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    at = 0
    for begin, length in sorted(line):
        assert begin == at
        at += length
    assert at == (h * np.arange(window)).sum()


def test_a_plan_does_not_grow_with_the_table():
    rng = np.random.default_rng(2)
    h = rng.integers(1, 50, packing.WINDOW)
    h[0] = 0
    small, large = (packing.plan(h * k) for k in (1, 10**6))
    assert len(large) < 4 * len(small) < 200_000


def test_least_squares_explains_what_can_be_filled():
    window = 32
    combos = packing.combinations(window)
    assert len({tuple(c) for c in combos.tolist()}) == len(combos) and (combos.sum(1) == window).all()
    rng = np.random.default_rng(0)
    goal = np.zeros(window)
    for c in rng.choice(len(combos), 12, replace=False):
        np.add.at(goal, combos[c], rng.integers(100, 900))
    goal[0] = 0
    found, x = packing.least_squares(combos, goal)
    made = np.zeros(window)
    np.add.at(made, found.ravel(), np.repeat(x, 3))
    made[0] = 0
    assert (x > 0).all() and np.abs(made - goal).sum() < 0.02 * goal.sum()


def test_pieces_are_encoded_as_whole_texts(tokenizer):
    import pyarrow as pa

    texts = ["a  b\n\nc", " lead", "<|endoftext|> x<|endoftext|>y", "it's don't", "é İ Σ", "", "\t\r\n", "12 345", "a \n b", "a\nb ", "x  ", "\n", "  ",
             "a\x1c b\x1fc", "日本 語　テ", "a b c d", "'s 't x's 'll"]
    ids, counts = ByteEncoder(tokenizer_path("byte_bpe_50k.json")).encode(pa.array(["pad it", *texts, None, "end"]).slice(1, len(texts) + 1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [*(tokenizer.encode(t, add_special_tokens=False).ids for t in texts), []]


def test_every_text_of_the_table_is_encoded_whole(documents, tokenizer):
    import pyarrow as pa

    texts = [r["text"] or "" for r in documents.select("text").collect()]
    ids, counts = ByteEncoder(tokenizer_path("byte_bpe_50k.json")).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_another_kind_of_tokenizer_gets_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = ["Some words  and\nlines", "more"]
    ids, counts = ByteEncoder(path).encode(pa.array(texts))
    plain = Tokenizer.from_file(path)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
