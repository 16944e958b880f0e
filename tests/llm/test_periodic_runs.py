import hashlib
import random
import zlib

import pytest

from wakeline.llm import periodic_runs as pr
from wakeline.llm.registered import QUERIES


def brute(words, least=24, times=3):
    """All runs, by trying every period and extending every agreement."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        k = 0
        while k < n - q:
            e = k
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e - k + q >= max(least, times * q):
                found.setdefault((k, e - k + q), q)  # the smallest period comes first
            k = max(e, k + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def looped(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = looped(doc_id, text)
    runs = brute(words)
    most = (None,) * 4
    if runs:
        s, length, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        most = (s, length, q, 1000 * length // q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *most, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def asked(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](docs.sparkSession, str(tmp_path)).select(*COLUMNS).collect()
    return sorted(map(tuple, got), key=repr)


def test_whole_table(documents, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect() if len(r["text"]) < 20_000]
    short = documents.where("length(text) < 20000")
    got = asked(short, tmp_path)
    assert got == sorted((expected(*r) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 5


def test_odd_rows(make, odd_rows, tmp_path):
    rows = [r if not r[1] or len(r[1]) < 10_000 else (r[0], r[1][:9000]) for r in odd_rows]
    # Ids whose words are looped, with white space that only some languages know.
    for i in range(100, 200):
        rows.append((i, f"a b\t c\r\n d{i}\x0b e \x0c f\u00a0g h\u2003i \x1c j " * 9))
    assert asked(make(rows, clashing=True), tmp_path) == sorted((expected(*r[:2]) for r in rows), key=repr)


def test_very_long_texts(make):
    texts = [(1, "word " * 300_000), (2, " ".join(f"w{i % 50_000}" for i in range(200_000))), (3, " ".join(f"u{i} same line again and again of nine words" for i in range(20_000)))]
    got = {r["doc_id"]: r for r in pr.periodic_runs(make(texts)).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 300_000, 1)] and got[1]["collapsed"] == "word"
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 200_000, 50_000)] and got[2]["n_words"] == 200_000
    assert got[3]["runs"] == [] and got[3]["collapsed"] == texts[2][1]


def test_empty_table(make, tmp_path):
    assert pr.periodic_runs(make([])).count() == 0
    assert asked(make([]), tmp_path) == []


def _text(rng):
    words = [str(rng.randint(0, rng.choice([1, 2, 3, 30]))) for _ in range(rng.randint(0, 90))]
    for _ in range(rng.randint(0, 3)):
        if words:
            s, p = rng.randrange(len(words)), rng.randint(1, 9)
            words[s:s] = words[s : s + p] * rng.randint(1, 6)
    return words


@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 2), (6, 3), (12, 4), (3, 3)])
def test_every_run_and_no_other(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(30):
        texts = [_text(rng) for _ in range(20)]
        got = pr.runs_of([" ".join(w).encode() for w in texts], least, times)
        assert [got.get(i, []) for i in range(20)] == [brute(w, least, times) for w in texts]


def test_suffix_array_and_common_prefixes():
    import numpy as np

    rng = random.Random(4)
    texts = [w for w in (_text(rng) for _ in range(8)) if w]
    codes, counts = pr.word_codes([" ".join(w).encode() for w in texts])
    doc = np.repeat(np.arange(len(texts)), counts)
    order, common = pr.suffixes(codes, doc, np.cumsum(counts)[doc])
    ends = np.cumsum(counts)
    tails = [(d, codes[i : ends[d]].tolist()) for i, d in enumerate(doc.tolist())]
    assert order.tolist() == sorted(range(len(codes)), key=tails.__getitem__)
    for k in range(1, len(order)):
        (d, a), (e, b) = tails[order[k - 1]], tails[order[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == (same if d == e else 0)
