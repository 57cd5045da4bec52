"""Encoding and decoding against the library of the tokenizer file."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import awkward, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from haloflux.llm import lexicon, queries

SF_DIR = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder(tmp_path_factory):
    words = ["the", " the", " quick", " quickly", "quick", " été", "123", " 12", "\n", " ", "'s", " '", "ab", "abc", "b", "bc"]
    path = tmp_path_factory.mktemp("lexicon") / "some.bin"
    path.write_bytes(lexicon.compiled(lexicon.Vocabulary(PATH), [w.encode() for w in words]))
    return lexicon.Codec(PATH, str(path))


def same(coder, library, texts):
    ids, before = coder.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        got = ids[before[k] : before[k + 1]].tolist()
        assert got == want, t
        assert coder.decode(got) == library.decode(want, skip_special_tokens=False)


TRICKY = [None, "", " ", "  ", "a  b", "it's we're I'll he'd 'tis ''s 's's 'S", "x'", "'", "'l", "don't\n\n 've  'm", "<|endoftext|>", " <|endoftext|> a<|endoftext|>", "<|endo", "ftext|>", "\t a\r\n  b 　c  d\u0085e᠎f", "١٢٣ ½² x²", "é ‍👩‍👩‍👧 \U00020000퟿﻿", "\x00\x1c\x1d a", "'re've", "'ſ"]


def test_tricky_texts(coder, library):
    same(coder, library, TRICKY)
    same(coder, library, TRICKY[::-1])
    same(coder, library, [])


def test_random_texts(coder, library):
    pick = random.Random(5)
    pool = [" ", " ", "  ", "\n", "\t", "a", "the", "'", "'s", "'re", "ll", "S", "1", "23", "!", "<|endoftext|>", "é", "漢", " ", " ", "²", "\U0001f600", "_", "ſ"]
    for _ in range(30):
        same(coder, library, ["".join(pick.choices(pool, k=pick.randrange(40))) for _ in range(100)])
    for _ in range(20):
        same(coder, library, ["".join(chr(c) for _ in range(pick.randrange(30)) if not 0xD800 <= (c := pick.randrange(0x32000)) < 0xE000) for _ in range(100)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_texts(coder, library, texts):
    same(coder, library, texts)


def test_long_words_and_texts(coder, library):
    same(coder, library, ["x" * 200_000, prose(3, 200_000), "ab" * 50_000 + " " * 50_000, "é" * 30_000])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 5 for x in b)), max_size=40))
def test_the_automaton_is_minimal_and_numbers_words_in_order(words):
    words = sorted(set(words))
    automaton = lexicon.Automaton.compiled(words)
    probes = words + [w + b"\x01" for w in words] + [w[:-1] for w in words] + [b"\x04\x04\x04\x04\x04\x04\x04"]
    data = np.frombuffer(b"".join(probes), np.uint8)
    ends = np.cumsum([len(p) for p in probes])
    got = automaton.walk(data, ends - [len(p) for p in probes], ends).tolist()
    assert got == [words.index(p) if p in words else -1 for p in probes]
    # states of the least automaton: distinct sets of continuations
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)} or {b""}
    assert len(automaton.base) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_documents(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op13_bpe(spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows_with_and_without_a_lexicon(spark, library):
    rows = [(k, t) for k, (_, t, *_) in enumerate(awkward())] + [(100 + k, t) for k, t in enumerate(TRICKY)] + [(7, "again"), (7, "again")]
    docs = frame(spark, rows)
    for most in (lexicon.WORDS, 0):
        name = lexicon.build(docs, PATH, most=most)
        got = lexicon.encoded(docs, PATH, name)
        back = lexicon.decoded(got, PATH)
        want = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
        assert sorted((r.doc_id, r.ids) for r in got.collect()) == want
        assert sorted(back.collect()) == sorted((i, library.decode(ids, skip_special_tokens=False)) for i, ids in want)
    empty = frame(spark, [])
    assert lexicon.encoded(empty, PATH, lexicon.build(empty, PATH)).count() == 0


def test_frequent_words_are_those_counted_over_all_rows(spark):
    docs = frame(spark, [(k, "one two two" + " three" * (k % 3)) for k in range(30)])
    assert b" two" in lexicon.frequent_words(docs, most=1) and b" three" in lexicon.frequent_words(docs)


def test_other_kinds_of_files_are_refused(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]")).save(str(tmp_path / "words.json"))
    with pytest.raises(ValueError, match="byte-level"):
        lexicon.Vocabulary(str(tmp_path / "words.json"))
