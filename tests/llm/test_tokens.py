import zlib

import numpy as np
import pytest
from helpers import AWKWARD, corpus, table
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavane.llm import tokenfile
from stratavane.llm.common import fresh_path
from stratavane.llm.tokens import PieceEncoder, encoder, vocabulary


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x1f\x85\xa0 '.,aAbzZ09éñß̈\x01<|>endoftxʼ漢"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_encode_as_whole_texts(name, text):
    enc = encoder(vocabulary(name))
    assert enc.encode(text) == np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_the_library_reads_them(name):
    from tokenizers import Tokenizer

    fresh, enc = Tokenizer.from_file(vocabulary(name)), encoder(vocabulary(name))
    for text in ("end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>\n<|endoftext|><|endoftext|> ", "<|ENDOFTEXT|> <|endof text|> plain"):
        assert enc.encode(text) == np.array(fresh.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_full_cache_changes_nothing():
    enc = PieceEncoder(vocabulary("byte_bpe_50k.json"), most=2)
    for text in ("some words here", "and other words there"):
        assert enc.encode(text) == np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def want(rows, row_order):
    enc, at, out = encoder(vocabulary("word_bpe_49k.json")), 0, []
    for i, t, *_ in row_order(rows):
        ids = [*enc.tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


@pytest.mark.parametrize("block_bytes", [3000, tokenfile.BLOCK_BYTES])
def test_round_trip(spark, block_bytes):
    rows = corpus(6, 40) + AWKWARD
    got = tokenfile.round_trip(table(spark, rows).repartition(3), block_bytes=block_bytes, row_tokens=64)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want(rows, in_order)


def test_empty_table(spark):
    assert tokenfile.round_trip(table(spark, [])).collect() == []


def test_rows_and_masks_are_views(spark):
    rows = corpus(7, 30)
    folder = fresh_path(spark, "files")
    blocks = tokenfile.write(table(spark, rows), "word_bpe_49k.json", folder, row_tokens=128)
    file = tokenfile.TokenFile(folder, blocks[0][0])
    total = sum(n for _, n in blocks)
    ids, valid = [], 0
    for i in range(len(file)):
        row, mask = file.row(i)
        assert len(row) == 128 and row.base is not None
        valid += mask.true_count
        ids.append(row)
    assert valid == total and len(file) == -(-total // 128)
    assert np.array_equal(np.concatenate(ids)[:total], np.concatenate(list(file.tokens(0, total))))
