"""What Python workers hold at once does not grow with batches, and results do not depend on how they are cut."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from photonlake.llm import bpe, bytescan, language, pieces, shingles

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def column():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijé ") for _ in range(rng.randint(3, 12))) for _ in range(4000)]
    return pa.array([" ".join(rng.choice(words) for _ in range(300)) for _ in range(1000)])


def test_classes_of_characters_take_few_objects():
    pieces._classes()
    assert peak_mb(pieces._classes.__wrapped__) < 40
    regex = pytest.importorskip("regex")
    for kind, pattern in ((pieces.LETTER, r"\p{L}"), (pieces.NUMBER, r"\p{N}"), (pieces.WHITE, r"\p{White_Space}")):
        for point in (*range(0x3000), 0xD7FF, 0xE000, 0x1D4B3, 0x10FFFF):
            assert (pieces._classes()[point] == kind) == bool(regex.fullmatch(pattern, chr(point)))


def test_ids_of_a_round_do_not_hold_its_matrix():
    own = bpe.encoder(RANKS)
    rows = [None] * 64
    own._merge_rows([b"xq%06dzkwv" % i for i in range(64)], 12, list(range(64)), rows)
    assert all(x.base is None for x in rows)


def test_long_pieces_fill_bounded_matrices():
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefghij") for _ in range(400)).encode() for _ in range(4000)]
    assert peak_mb(lambda: bpe.encoder(RANKS).encode_pieces(made)) < 60


def test_scans_hold_a_short_slice(column):
    model = language.TextModel(["a", "b"], np.random.default_rng(1).integers(0, 99, (2, 1 << 16)).astype(float))
    assert column.nbytes > bytescan.SLICE_BYTES // 2
    assert peak_mb(lambda: model.evidence(column)) < 24
    assert peak_mb(lambda: list(shingles.sets_of(column))) < 32
    whole = model.evidence(column)
    assert all((model.evidence(column.slice(i, 1)) == whole[i]).all() for i in range(0, 1000, 97))


def test_encoded_rows_leave_by_slices(spark):
    text = "one two three " * 20_000
    rows = [(k, text if k % 2 else None, f"s{k}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1)
    got = {r.doc_id: r for r in bpe.encode_decode(docs, RANKS).collect()}
    assert len(got) == 12 and all(got[k].source == s and bytes(got[k].decoded).decode() == (t or "") for k, t, s in rows)
    assert {r.doc_id: r.ids for r in bpe.encode(docs, RANKS).collect()} == {k: r.ids for k, r in got.items()}
    assert bpe.decode(bpe.encode(docs, RANKS), RANKS).filter("decoded = cast(coalesce(text, '') as binary)").count() == 12
