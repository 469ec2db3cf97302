"""Packing and BPE against the tokenizers library and plain recomputation."""

import hashlib
import random
import zlib
from array import array

import pytest

P = pytest.importorskip("public_tokenizers")

from staffwise.llm import chunk_bpe as C  # noqa: E402
from staffwise.llm import packing as K  # noqa: E402
from staffwise.llm.tokens import Encoder  # noqa: E402

PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, key string, ids string, length string, _row string"
RNG = random.Random(4)
LONG = " ".join(RNG.choice(["Wörter", "and", "<|endoftext|>", "it's", "12,345", "!?!?", "don't…\n", "plain",
                            f"w{RNG.randint(0, 9)}"]) for _ in range(9000)) + "x" * 9000
TEXTS = [None, "", " ", "\n\n", "a", "A a\tB c", "the cat's pajamas, they'RE ok", "İstanbul ΟΔΟΣ Σ",
         "été café ́x", "<|startoftext|>hi<|endoftext|>  yo", "<|STARTOFTEXT|> Hi",
         "ab" * 4000, LONG, LONG, "prefix words " + LONG[100:], "\x1c\x1d a\x85b   c"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", "i", "l", "r") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids, lambda i: t.decode(i, skip_special_tokens=False)


def test_encoder_equals_library(lib):
    enc = Encoder(open(PATH, encoding="utf-8").read())
    assert enc.by_piece
    for t in TEXTS:
        assert array("I", enc.ids(t or "")).tolist() == lib[0](t)


def test_cuts_follow_content():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijkl mnopé\n") for _ in range(30000))
    assert "".join(C.chunks(text)) == text
    a, b = set(C.chunks(text)), set(C.chunks("moved by a few words " + text))
    assert len(a & b) > 0.9 * len(a) > 10


def test_repair_at_any_cut(lib):
    enc = Encoder(open(PATH, encoding="utf-8").read())
    text = "They're here <|endoftext|> naïve 12 34, it's\nfine!! end"
    for i in range(1, len(text), 2):
        for j in range(i + 1, len(text), 3):
            got = C.join_chunks(enc, [text[:i], text[i:j], text[j:]], {})
            assert array("I", got).tolist() == lib[0](text), (i, j)


def test_bpe_documents(spark, lib):
    rows = C.encode_documents(frame(spark, TEXTS), PATH).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = lib[0](TEXTS[r.doc_id])
        assert array("I", r.ids).tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == lib[1](ids)
    assert max(r.n_reused for r in rows) > 20
    assert C.encode_documents(frame(spark, TEXTS).filter("doc_id < 0"), PATH).count() == 0


def test_bpe_query_on_sample_tables(spark, lib):
    from staffwise.llm.queries import op10_bpe
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib[0](texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib[1](ids).encode()).hexdigest()


def check_packing(rows, texts, lib, capacity):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts.items():
        ids = [*lib[0](text), 1]
        mine = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert len(mine) == max(1, -(-len(ids) // capacity))
        for r in mine:
            part = array("I", ids[r.start:r.start + r.length]).tobytes()
            assert r.start == r.piece * capacity and r.ids_crc32 == zlib.crc32(part) & 0xFFFFFFFF
        assert sum(r.length for r in mine) == len(ids)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, lib):
    texts = dict(enumerate(TEXTS))
    rows = K.pack_documents(frame(spark, TEXTS), PATH, 128).collect()
    check_packing(rows, texts, lib, 128)
    assert K.pack_documents(frame(spark, TEXTS).filter("doc_id < 0"), PATH).count() == 0


def test_packing_query_wastes_little(spark, lib):
    from staffwise.llm.queries import op7_best_fit_packing
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_best_fit_packing(spark, sf).collect()
    n = check_packing(rows, texts, lib, 4096)
    assert n <= 1.03 * sum(r.length for r in rows) / 4096 + 1


def test_repeated_rows_and_many_groups(spark):
    pieces = spark.range(5000).selectExpr("0L as doc_id", "0 as piece", "1 + id % 37 as length")
    rows = K.pack(pieces, 40, group_pieces=500).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 5000 and len({b >> 32 for b in bins}) == 10
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 40


def test_sum_of_squares_against_definition():
    import numpy as np
    rng = np.random.default_rng(3)
    lengths, cap = rng.integers(1, 13, 200), 12
    bins, offsets = K.sum_of_squares(lengths, cap)
    fill = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        def total(levels):
            count = {}
            for v in levels.values():
                if v < cap:
                    count[v] = count.get(v, 0) + 1
            return sum(c * c for c in count.values())
        tries = [total({**fill, k: v + s}) for k, v in fill.items() if v + s <= cap]
        best = min([*tries, total({**fill, len(fill): s})])
        assert fill.get(b, 0) == o
        fill[b] = o + s
        assert total(fill) == best
