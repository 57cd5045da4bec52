import zlib

import numpy as np
import pytest
from brute import awkward, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from haloflux.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_pieces_restore_the_ids_of_every_document(spark, tokenizer):
    rows = [(i, t) for i, (_, t, *_) in enumerate(awkward())] + [(100 + k, prose(k, 30 + 61 * k)) for k in range(40)]
    rows += [(200, " leading"), (201, "trailing "), (202, "a  b \n c d"), (203, "it's  we're 12 34,56 <|endoftext|>"), (205, "<|endoftext|>"), (206, "a <|endoftext|><|endoftext|> b <|endo"), (204, "a  b 　 c")]
    got = packing.packed(frame(spark, rows), queries.tokenizer_path(), keep_ids=True).collect()
    own = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
        own.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(own[i], key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == ids and all(p.doc_tokens == len(ids) for p in pieces)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = total = 0
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
        total += end
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding < 0.05 * total


def test_repeated_rows_and_no_rows(spark):
    rows = [(7, prose(1, 2000))] * 3 + [(None, "no id")] * 2
    got = packing.packed(frame(spark, rows), queries.tokenizer_path()).collect()
    assert sum(r.doc_id is None for r in got) == 2 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.packed(frame(spark, []), queries.tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_equals_a_search_over_all_windows(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            room = min(fits)[0]
            k = next(k for k, r in enumerate(rooms) if r == room)
        else:
            rooms.append(64)
            k = len(rooms) - 1
        want.append(64 - rooms[k])
        rooms[k] -= n
    windows, offsets = packing.best_fit_decreasing(lengths, 64)
    assert sorted(offsets) == sorted(want) and len(set(windows)) == len(rooms)


def test_other_vocabularies_use_their_own_library(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"[UNK]": 0, "one": 1, "two": 2}, unk_token="[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    plain.save(str(tmp_path / "words.json"))
    row = packing.document_pieces(frame(spark, [(1, "one two three")]), str(tmp_path / "words.json"), keep_ids=True).first()
    assert row.ids == [1, 2, 0, 0]
