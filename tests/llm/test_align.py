"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from staffwise.llm import align as A
from staffwise.llm.queries import tokenizer_path

A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, row string, `key` string, pairs string, n_a string, id string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_PATH)


def plain(libraries, text):
    """[(id, start, end)] of both sides, by the whole text; empty where bytes differ."""
    a, b = libraries
    letters = A.byte_alphabet()
    if not text:
        return [], []
    sides = [[(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
             [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
              for i in b.encode(text)]]
    if any(b"".join(t for _, t in s) != (" " + text).encode() for s in sides):
        return [], []
    out = []
    for s in sides:
        at, tokens = 0, []
        for i, t in s:
            tokens.append((i, at, at + len(t)))
            at += len(t)
        out.append(tokens)
    return out


def plain_rows(libraries, texts):
    docs, counts = [], Counter()
    for t in texts:
        a, b = plain(libraries, t)
        ends = {e: i for i, _, e in a}
        links = [(ends[e], i) for i, _, e in b if e in ends]
        counts.update(links)
        cut = sorted(set(ends) & {e for _, _, e in b})
        groups = [",".join(str(i) for i, _, e in a if lo < e <= hi) + "|" + ",".join(str(i) for i, _, e in b if lo < e <= hi)
                  for lo, hi in zip([0, *cut], cut)]
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [(n_a, n_b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), sha)
            for n_a, n_b, g, x, sha in docs]


def texts():
    rnd = random.Random(3)
    words = ["the", "naïve", "straße", "日本語", "x1", "<|endoftext|>", "</s>", "<0x41>", "don't", "é", "🙂👍🏽", " ",
             "a\tb", "\x1c", "\x85", "…", "''", "0123", "Wort.", "​", "ﬁ", "\r\n", "\x00z", "▂"]
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "  a  b   c ", "\t\tx", "▁a b", "a ▁", "<unk> <s> b",
           "'s 't", " ́x", "a   b", "the the the", "the the the", "A" * 3000]
    for _ in range(120):
        out.append("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\n", "", " \n "])
                           for _ in range(rnd.randrange(1, 40))))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("size, memo", [(A.SLICE, A.MEMO_PIECES), (7, 5)])
def test_summary_against_whole_texts(spark, libraries, monkeypatch, size, memo):
    """With slices of a few characters and a store of a few words too."""
    monkeypatch.setattr(A, "SLICE", size)
    monkeypatch.setattr(A, "MEMO_PIECES", memo)
    t = texts()
    pair = A.Pair(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    got = [d[1:6] for d in A._documents(pair, enumerate(t))]
    assert got == [(x[0], x[1], x[2], x[3], x[6]) for x in plain_rows(libraries, t)]


def test_summary(spark, libraries):
    t = texts()
    rows = [(None if i % 17 == 5 else i // 2, x, *"abcdef") for i, x in enumerate(t)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = A.summary(docs, A_PATH, B_PATH)
    assert [n for n, k in got.dtypes if k == "bigint"] == ["doc_id", *COLUMNS[:-1]]
    found = sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in got.collect())
    assert found == sorted((str(r[0]), *x) for r, x in zip(rows, plain_rows(libraries, t)))
    assert A.summary(docs.filter("doc_id < 0"), A_PATH, B_PATH).collect() == []


def test_overlaps(spark, libraries):
    t = texts()
    docs = spark.createDataFrame([(i, x, *"abcdef") for i, x in enumerate(t)], SCHEMA)
    got = {tuple(r) for r in A.overlaps(docs, A_PATH, B_PATH).collect()}
    expected = set()
    for d, x in enumerate(t):
        a, b = plain(libraries, x)
        expected |= {(d, i, j, p[0], q[0], p[2] == q[2]) for i, p in enumerate(a) for j, q in enumerate(b)
                     if max(p[1], q[1]) < min(p[2], q[2])}
    assert got == expected


def test_supplied_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = docs.orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in A.summary(docs, A_PATH, B_PATH).collect()}
    assert got == dict(zip([r["doc_id"] for r in t], plain_rows(libraries, [r["text"] for r in t])))


def test_very_long_text(spark):
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("lorem ipsum 12 "), 200_000).alias("text"))
    r = A.summary(long, A_PATH, B_PATH).first()
    short = A.summary(long.select("doc_id", F.repeat(F.lit("lorem ipsum 12 "), 1000).alias("text")), A_PATH, B_PATH).first()
    # the text's last space alone is tokens of its own
    assert (r["n_a"] - 1) == 200 * (short["n_a"] - 1) and (r["n_b"] - 1) == 200 * (short["n_b"] - 1)
