import hashlib

import numpy as np
import pytest

from wakeline.llm import syncmers as sy


def brute(text, k=sy.K, s=sy.S):
    """Positions of closed syncmers by comparing every inner substring's hash."""
    def value(x):
        h = 0
        for i, c in enumerate(x):
            h = (h + int(sy.mix(np.array([ord(c)], np.uint64))[0]) * pow(int(sy.BASE), i, 1 << 64)) % (1 << 64)
        return int(sy.mix(np.array([h], np.uint64))[0])

    out = []
    for i in range(len(text) - k + 1):
        inner = [value(text[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_closed_syncmers_by_definition():
    text = "The anchors of a text depend on nothing but the characters inside of them, éè\U0001f600 wherever they are. " * 2
    assert sy.anchors(text)[1].tolist() == brute(text)


def test_anchors_are_free_of_context():
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh "), 400))
    a, b = "".join(rng.choice(list("xyz "), 90)) + shared, shared + "tail" * 20
    inside = {int(h) for h in sy.anchors(shared)[0]}
    assert inside <= {int(h) for h in sy.anchors(a)[0]} and inside <= {int(h) for h in sy.anchors(b)[0]}
    assert sy.shift(sy.anchors(a), sy.anchors(b)) == -90
    gaps = np.diff(sy.anchors(shared)[1])
    assert gaps.max() <= sy.K - sy.S + 1


@pytest.mark.parametrize("text", ["", "x", "a" * 31, "a" * 32, "abcdefghij" * 4, "\U0001f600" * 50])
def test_short_texts(text):
    hashes, at = sy.anchors(text)
    assert len(hashes) == len(at) and bool(len(hashes)) == bool(text)
    assert sy.likeness(hashes, hashes) == 1.0


def expected(rows):
    known = sorted(((d, t or "") for d, t, *_ in rows if d is not None), key=lambda r: r)
    pairs = [(d, t, known[(i + 1) % len(known)][1]) for i, (d, t) in enumerate(known)] + [(None, t or "", t or "") for d, t, *_ in rows if d is None]
    out = []
    for d, t, n in pairs:
        e = sy.edited(t, n)
        x, y, z = (sy.anchors(v)[0] for v in (t, e, n))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), sy.fingerprint(x), sy.fingerprint(y), sy.likeness(x, y), sy.likeness(x, z)))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in sy.fingerprints(docs).collect()), key=str)


def test_next_document_across_ranges(documents):
    assert got(documents.repartition(5)) == expected([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows(make, odd_rows):
    assert got(make(odd_rows, clashing=True)) == expected(odd_rows)


@pytest.mark.parametrize("rows", [[], [(4, "one text alone, which is its own next one")], [(None, "no id")]])
def test_small_tables(make, rows):
    assert got(make(rows)) == expected(rows) if rows else sy.fingerprints(make(rows)).count() == 0
