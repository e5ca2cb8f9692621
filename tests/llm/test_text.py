"""Splitting, hashing, BPE and rANS against the public libraries and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from photonlake.llm import bpe, bytescan, rans, shingles
from photonlake.llm.language import page_rows

PARTS = ["a", "b", "Z", "é", "ß", "中", "ू", "𝒳", "🙂", "1", "²", "Ⅷ", "'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", " ", " ", "　", "-", "_", "\x1c", "\x85", "don't", "I'LL", " 's", "''s", "'sx", "<|endoftext|>", "​", "\r\n"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    return [*made, "", None, " ", "\n\n", "a" * 3000, "-" * 1500 + "ab" * 400, "日本語" * 300]


def test_bpe_equals_tiktoken(texts):
    own, back = bpe.encoder(RANKS), bpe.decoder(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text, ids in zip(texts, own.cache.ids(pa.array(texts)), strict=True):
        assert ids.tolist() == known.encode_ordinary(text or "")
        assert back.decode(ids) == (text or "").encode()


def test_long_pieces_merge_alike():
    own = bpe.encoder(RANKS)
    piece = b"abcab" * 60
    rows = [None]
    own._merge_rows([piece], 512, [0], rows)
    assert rows[0].tolist() == own._merge_long(piece)


@pytest.mark.parametrize("special", [True, False])
def test_library_tokenizer_equals_library(texts, special):
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    if not special:
        known.encode_special_tokens = True
    for text, ids in zip(texts, rans.library_tokenizer(path, special)()(pa.array(texts)), strict=True):
        assert ids.tolist() == known.encode(text or "", add_special_tokens=False).ids
    if special:
        assert next(iter(rans.library_tokenizer(path)()(pa.array(["hello <|endoftext|> x"])))).tolist() == [31373, 220, 50256, 2124]


def test_pieces_with_one_polynomial_hash_stay_apart():
    a = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    b = a.translate({97: 98, 98: 97})
    raw = [np.frombuffer(x.encode(), np.uint8) for x in (a, b)]
    assert len({int(bytescan.span_hash(bytescan.prefix_hash(x), np.array([0]), np.array([1024]))[0]) for x in raw}) == 1
    own = bpe.encoder(RANKS)
    assert [bpe.decoder(RANKS).decode(ids).decode() for ids in own.cache.ids(pa.array([a, b, b, a]))] == [a, b, b, a]
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library = rans.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))()
    assert [x.tolist() for x in library(pa.array([a, b]))] == [known.encode(x).ids for x in (a, b)]
    sets = [s.tolist() for s in shingles.sets_of(pa.array([f"p q r s {a}", f"p q r s {b}"]))]
    assert sets[0] != sets[1]


def test_pieces_that_share_a_hash_stay_apart(texts, monkeypatch):
    """With a hash of three bits nearly all short pieces clash."""
    from photonlake.llm.pieces import PieceIds

    words = PieceIds._words
    monkeypatch.setattr(PieceIds, "_words", staticmethod(lambda *of: (*words(*of)[:2], words(*of)[2] & np.uint64(7) | np.uint64(1))))
    own = bpe.encoder(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    clashing = PieceIds(own.encode_pieces)
    for text, ids in zip(texts, clashing.ids(pa.array(texts)), strict=True):
        assert ids.tolist() == known.encode_ordinary(text or "")


def test_small_cache_forgets(texts):
    own = bpe.encoder(RANKS)
    from photonlake.llm.pieces import PieceIds

    want = [x.tolist() for x in own.cache.ids(pa.array(texts[:200]))]
    for small in (PieceIds(own.encode_pieces, most=40), PieceIds(own.encode_pieces, most_bytes=2000)):
        assert [x.tolist() for x in small.ids(pa.array(texts[:200]))] == want
        assert [x.tolist() for t in texts[:200] for x in small.ids(pa.array([t], pa.string()))] == want
        assert small.held < 400


def test_texts_longer_than_a_slice():
    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 400_000))
    assert len(text) > bytescan.SLICE_BYTES
    own = bpe.encoder(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = list(own.cache.ids(pa.array(["a b", text, None])))
    assert ids[1].tolist() == known.encode_ordinary(text) and bpe.decoder(RANKS).decode(ids[1]).decode() == text
    assert [len(x) for x in ids] == [2, len(ids[1]), 0]
    words = text.split(" ")
    assert len(list(shingles.sets_of(pa.array(["a b", text])))[1]) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def coded(ids, table):
    return rans.encode_block(ids, table) | {"n_tokens": len(ids), "part": 0, "block": 0, "table_crc32": table.crc32, "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000, 300_000])
def test_blocks_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 50_000).astype(np.uint32)
    table = rans.Table.scaled(np.bincount(ids, minlength=50_257))
    assert int(table.frequency.sum()) == 1 << rans.SCALE
    block = coded(ids, table)
    assert (rans.decode_block(block, table, table.slots()) == ids).all()
    last = len(block["at"]) - 1
    stretch = rans.decode_stretch(block, last, table, table.slots())
    assert (stretch == ids[-len(stretch) :]).all()


def test_many_rare_ids_fit_the_table():
    counts = np.ones(50_257, np.int64)
    counts[7] = 10**12
    table = rans.Table.scaled(counts)
    assert int(table.frequency.sum()) == 1 << rans.SCALE and table.frequency.min() == 1


def test_damage_is_found():
    ids = np.arange(1000, dtype=np.uint32) % 50
    table = rans.Table.scaled(np.bincount(ids, minlength=60))
    block = coded(ids, table)
    block["words"] = block["words"][:-1] + bytes([block["words"][-1] ^ 1])
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(block, table, table.slots())


def test_words_and_shingles_equal_plain_python(texts):
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, got in zip(texts, shingles.sets_of(pa.array(texts)), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        want = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
        assert len(got) == len(want)


def test_slices_cover_long_and_sliced_columns():
    column = pa.array(["abc", None, "", "x" * 100, "de"]).slice(1)
    rows = [(data.tobytes(), offsets.tolist()) for _, _, data, offsets in bytescan.slices(column, 10)]
    assert b"".join(d for d, _ in rows) == b"x" * 100 + b"de"


def test_pages_that_stay_open_take_linear_time(spark):
    """Five megabytes of angle brackets, of open comments, scripts and html tags."""
    import time

    parts = {0: "<", 1: "<!--", 2: "<script", 3: "<html lang", 4: "&a", 5: "-->", 6: "</style>"}
    pages = spark.createDataFrame([(k,) for k in parts], "page_id bigint")
    html = F.create_map(*[F.lit(x) for k, v in parts.items() for x in (k, v)])[F.col("page_id")]
    pages = pages.withColumn("html", F.repeat(html, F.floor(5_000_000 / F.length(html)).cast("int"))).withColumn("url", F.lit("http://a.b.de/"))
    began = time.time()
    assert page_rows(pages).agg(F.sum(F.length("text"))).first()[0] > 0
    assert time.time() - began < 60


def test_comments_scripts_and_styles_go(spark):
    html = 'a<!-- x <!-- y --> b <script src="1">if (a < b) "<p>"</SCRIPT>c<STYLE>p {}</style>d --> e<b class="x">f</b> &amp; <!-- open g <html lang=de>'
    rows = spark.createDataFrame([(1, None, html), (2, "x", None), (3, "", "")], "page_id bigint, url string, html string")
    got = {r.id: r for r in page_rows(rows).collect()}
    assert got[1].text.split() == "a b c d --> e f <!-- open g".split() and got[1].declared == "de"
    assert got[2].text == "" and got[2].declared is None and got[3].host is None
