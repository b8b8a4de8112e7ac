import os
import random

import numpy as np
import pytest

from tamizal.llm import bpe as B

PATH = f"{B.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="vocabularies aren't here")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def mine(texts):
    ids, counts = B.encoder(PATH).encode(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_like_the_library(library):
    random.seed(2)
    parts = ["'", "'s", "re", "ll", " ", "  ", "\n", "a", "Ñ", "1", "-", "\0", "\t", "日本", "😀", "²", "\xa0", "́", "palabra"]
    texts = ["", None, "x" * 5000 + " " * 400, "aaaa " * 50, "<|endoftext|>", "'", " 's\n's", *("".join(random.choices(parts, k=random.randint(1, 20))) for _ in range(3000))]
    assert mine(texts) == [library(t) for t in texts]


def test_long_words(library):
    """Unbroken runs: letters of 180, base64, DNA, digits, one letter, and a word of a million bytes."""
    random.seed(6)
    draw = lambda letters, k: "".join(random.choices(letters, k=k))
    lower, base64 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"
    texts = [" ".join(draw(lower, 180) for _ in range(500)), draw(base64, 1_000_000), draw("ACGT", 20_000), draw("01", 20_000), draw("0123456789", 5_000), "x" * 100_001, "-" * 3001 + "=" * 2000, "ab" * 9999, "日本語" * 3000]
    assert mine(texts) == [library(t) for t in texts]


def test_unsound_bounds_change_nothing(library):
    e = B.Encoder(open(PATH, "rb").read())
    e.query = B.FIXPOINT.replace(" AS safe", " AND false AS safe")
    text = "La inscripción de 1234567 postulantes aaaaaaa xyxyxyx ACGTTGCA"
    assert e.encode([text])[0].tolist() == library(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 3)
    texts = ["uno dos tres cuatro", "cinco seis siete", "uno dos"]
    assert [mine([t])[0] for t in texts] == [library(t) for t in texts]


def test_encode_corpus(spark, library):
    rows = [(1, "Hola, ¿qué tal?"), (1, "Hola, ¿qué tal?"), (2, ""), (3, None), (None, "fin")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS k", "0 AS ids")
    got = sorted(((r["doc_id"], r["ids"]) for r in B.encode_corpus(df).collect()), key=repr)
    assert got == sorted(((k, library(t)) for k, t in rows), key=repr)
    sizes = sorted(((r["doc_id"], r["tokens"]) for r in B.count_tokens(df).collect()), key=repr)
    assert sizes == sorted(((k, len(library(t))) for k, t in rows), key=repr)
    assert B.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
