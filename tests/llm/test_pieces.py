"""Operator 13 against the library, on texts of all kinds and on odd rows."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SOME = ["a", "b", " ", "  ", "\n", "▁", "th", "e", "in", "é", "\x00", "😀", "ü", "한", "1", "22", ".", "..", "e.g.", "=", "==", "   ", "\t"]


def _ids(texts: list[str]) -> list[list[int]]:
    return [np.frombuffer(x, "<u4").tolist() for x in sentence_pieces.Encoder(PATH, 1 << 20).of(texts)]


def _same(texts: list[str]) -> None:
    want = LIBRARY.encode(texts, add_bos=True, add_eos=True)
    assert _ids(texts) == want
    joined = sentence_pieces.pieces(PATH).joined
    assert [joined(ids).decode() for ids in want] == [LIBRARY.decode(ids) for ids in want]


def test_ids_equal_the_library():
    rng = random.Random(13)
    for n in (3, 20, 200):
        _same(["".join(rng.choices(SOME, k=rng.randint(0, n))) for _ in range(1000)])
    tokens = [t for t in sentence_pieces.pieces(PATH).ids]
    _same(["".join(rng.choices(tokens, k=rng.randint(1, 12))) for _ in range(4000)])


def test_runs_of_spaces_and_of_marks():
    _same([" " * k + x + " " * j for k in range(40) for j in range(0, 40, 5) for x in ("", "a", "ab", "é", "=")])
    _same([c * k for c in ("=", ".", "-", "0", "ab", "é") for k in range(120)])
    _same(["x" * 50_000, " " * 50_000, "ab12-" * 20_000])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    _same([text])


def test_any_ids_are_decoded():
    rng = random.Random(2)
    some = [0, 1, 2, *range(3, 259), 259, 260, 300, 28705]
    joined = sentence_pieces.pieces(PATH).joined
    for _ in range(5000):
        ids = rng.choices(some, k=rng.randint(0, 8))
        assert joined(ids).decode() == LIBRARY.decode(ids)


def test_the_last_token_of_each_prefix_is_that_of_its_encoding():
    pieces = sentence_pieces.pieces(PATH)
    word = "▁internationalisations"
    for end in range(1, len(word) + 1):
        ids = pieces.word(word[:end])
        fitting = [k for t, k in pieces.ids.items() if word[:end].endswith(t) and (len(t) == end or pieces.compatible(pieces.word(word[: end - len(t)])[-1], k))]
        assert fitting == ids[-1:]


def test_models_of_another_kind_are_refused(tmp_path):
    with pytest.raises((ValueError, OSError, RuntimeError)):
        sentence_pieces.Pieces(str(tmp_path / "none.model"))


def test_on_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (None, "no id", "x"), (4, "same", "x"), (4, "same", "x"), (5, "word " * 40_000 + "x" * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sentence_pieces.decode(sentence_pieces.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in got) == sorted((d or 0, LIBRARY.encode(t or "", add_bos=True, add_eos=True), t or "") for d, t, _ in rows)
    assert sentence_pieces.digest(sentence_pieces.decode(sentence_pieces.encode(df.limit(0), PATH), PATH)).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert sentence_pieces.decode(none, PATH).first().text == ""
