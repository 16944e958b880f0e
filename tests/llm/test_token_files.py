import zlib

import numpy as np
import pyarrow as pa
import pytest

from wakeline.llm import token_files as tf
from wakeline.llm.files import new_folder
from wakeline.llm.tokens import WordEncoder, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def brute(rows, tokenizer):
    """(doc_id, start, n_tokens, crc) in ascending doc_id order, null last, ties by text."""
    out, start = [], 0
    for doc_id, text in sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, tf.END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(docs):
    return sorted(map(tuple, tf.token_files(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_round_trip(documents, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert read(documents) == brute(rows, tokenizer)


def test_odd_rows(make, odd_rows, tokenizer):
    assert read(make(odd_rows, clashing=True)) == brute([r[:2] for r in odd_rows], tokenizer)


def test_empty_table(make):
    assert tf.token_files(make([])).count() == 0


def test_one_document_at_random(spark, make, tokenizer):
    docs = make([(i * 10, f"text number {i} " * (i % 5)) for i in range(40)])
    folder = new_folder(spark, "tokens")
    part = tf.write_token_files(docs, folder).orderBy("part").first()
    file = tf.TokenFile(folder, part["part"])
    for i in range(part["n_docs"]):
        key = file.keys(i, i + 1)[0]
        assert file.document(i).tolist() == [*tokenizer.encode(f"text number {key // 10} " * (key // 10 % 5), add_special_tokens=False).ids, tf.END_ID]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [0, 2**40], sorted(np.random.default_rng(3).integers(0, 10**7, 3000).tolist())])
def test_elias_fano(values):
    code = tf.EliasFano.from_bytes(tf.EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert [code[i] for i in range(len(values))] == values
    for a, b in ((0, len(values)), (len(values) // 3, len(values) // 2), (len(values), len(values))):
        assert code.values(a, b).tolist() == values[a:b]


def test_elias_fano_space():
    values = np.sort(np.random.default_rng(1).integers(0, 600 * 10**5, 10**5))
    assert 8 * len(tf.EliasFano.of(values).to_bytes()) < 12.5 * 10**5  # against 64 bits each


def test_words_are_encoded_as_whole_texts(tokenizer):
    texts = ["a  b\n\nc", " lead", "<|endoftext|> x<|startoftext|>y", "it's don't you", "é İ Σ", "", "\t\r\n", "12 345"]
    ids, counts = WordEncoder(tokenizer_path()).encode(pa.array([*texts, None]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [*(tokenizer.encode(t, add_special_tokens=False).ids for t in texts), []]
