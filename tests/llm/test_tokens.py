"""Encoding, token files and token counts against the tokenizers library and plain dynamic programming."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from odd_rows import documents, none, odd
from tokenizers import Tokenizer

from gridweave.llm import bpe, tokencount, tokenfile

LETTERS = [*"abcXYZ 's't 're  \n\n\t\r\x1c\x85.,!?123²¼ªºµéÉñßİKſΣσς中文字かな한국ا١😀́̈  ᠎", "<|endoftext|>", "<|startoftext|>",
           "'ll", " 's", "\r\n", "  ", "don't"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    own, library = bpe.encoder(bpe.tokenizer_text(path)), Tokenizer.from_file(path)
    assert own.kind in ("bytes", "words")
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, repr(text)
        if own.kind == "bytes":
            assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_forced_boundaries_stand_in_no_token():
    own = bpe.encoder(bpe.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json")))
    assert (~own.inner).any()
    assert not own.inner[ord("e"), ord(" ")] and own.inner[ord("t"), ord("h")]


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_LIMIT", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.Encoder(bpe.tokenizer_text(path)), Tokenizer.from_file(path)
    text = "many different words, more than a table of three holds; twice: many different words"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = odd(spark)
    got = bpe.decode_documents(bpe.encode_documents(docs, path), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), bytes(r.ids), r.text) for r in bpe.round_trip_documents(docs, path).collect()) == sorted(
        (str(r.doc_id), bytes(r.ids), r.text) for r in got)
    assert bpe.encode_documents(none(spark), path).collect() == []


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("width", [2, 3, 4])
def test_planes_round_trip(bits, width):
    rnd = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rnd.integers(0, 1 << (8 * width), n).astype(np.uint32)
        planes = tokenfile.to_planes(ids, width, bits)
        assert len(planes) == (8 * width if bits else width)
        assert (tokenfile.from_planes(planes, n, width, bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_file_gives_back_every_document(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 1 << 16)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = odd(spark)
    tokenfile.write_token_file(docs, str(tmp_path / "file"), path, end_id=2, bits=bits)
    got = sorted(tokenfile.read_token_file(spark, str(tmp_path / "file")).collect(), key=lambda r: r.start)
    # ascending ids, NULL first, without gaps
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0))
    start = 0
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    for r in got:
        assert r.start == start
        start += len(r.ids) // 4
    chunks = tokenfile.read_chunks(spark, str(tmp_path / "file"))
    assert chunks.where("n_ids > 65536").isEmpty() and chunks.where("n_ids = 65536").count() >= 1


def test_token_file_of_an_empty_table_and_a_hot_id(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenfile.write_token_file(none(spark), str(tmp_path / "none"), path, end_id=2)
    assert tokenfile.read_token_file(spark, str(tmp_path / "none")).collect() == []
    docs = documents(spark, [f"text {i}" for i in range(300)], [7 if i % 3 else i for i in range(300)])
    tokenfile.write_token_file(docs, str(tmp_path / "hot"), path, end_id=2)
    got = sorted(tokenfile.read_token_file(spark, str(tmp_path / "hot")).collect(), key=lambda r: r.start)
    assert len(got) == 300 and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert tokenfile.read_chunks(spark, str(tmp_path / "hot")).select("shard").distinct().count() > 8


def test_token_counts_equal_plain_dynamic_programming(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        scores, byte_score = tokencount.piece_scores(f.read())

    def best(word):
        found = [(0.0, 0)] + [None] * len(word)
        for j in range(1, len(word) + 1):
            options = [(found[i][0] + scores[word[i:j]], found[i][1] + 1) for i in range(max(0, j - 20), j) if word[i:j] in scores]
            if word[j - 1] not in scores:
                n = len(word[j - 1].encode())
                options.append((found[j - 1][0] + n * byte_score, found[j - 1][1] + n))
            top = max(o[0] for o in options)
            found[j] = (top, min(o[1] for o in options if o[0] == top))
        return found[-1]

    docs = odd(spark)
    got = {(str(r.doc_id), r.n_pre_tokens, r.n_tokens) for r in tokencount.count_tokens(docs, path).collect()}
    known = {}
    want = set()
    for r in docs.collect():
        words = (r.text or "").split()
        for w in words:
            known.setdefault(w, best(tokencount.MARK + w)[1])
        want.add((str(r.doc_id), len(words), sum(known[w] for w in words)))
    assert got == want
    assert tokencount.count_tokens(none(spark), path).collect() == []


def test_a_small_trie_gives_the_same_counts(monkeypatch):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        made = tokencount.piece_scores(f.read())
    words = [f"{a}{b}ing" for a in ("walk", "talk", "interest", "zzqx") for b in ("", "er", "st")]
    large = tokencount.Counter(*made)
    want = [large[w] for w in words]
    monkeypatch.setattr(tokencount, "MOST_NODES", 10)
    monkeypatch.setattr(tokencount, "MOST_WORDS", 2)
    small = tokencount.Counter(*made)
    assert [small[w] for w in words] == want
