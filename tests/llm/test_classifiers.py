"""Toxicity and language identification: held-out accuracy, folds, edge cases."""

import zlib

import pytest

from staffwise.llm import langid as G
from staffwise.llm import toxicity as T

EXTRA = "score string, label string, toxic string, _h string, predicted string"
LONG = "quiet words about nothing in particular " * 30000


def fold(doc, n):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % n


def documents(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", "l", "t", "h", "p") for d, t, lang in rows],
                                 "doc_id long, text string, lang string, " + EXTRA)


EDGES = [(1, None, None), (2, "", "en"), (3, " ", "en"), (4, LONG, "en"), (5, "12 34 !?", "de"),
         (6, "tie", "en"), (6, "tie", "de"), (6, "tie", "de"), (None, "text without id", None), (8, "é", "fr")]


def test_toxicity_on_held_out_labels(spark):
    from staffwise.llm.queries import op3_toxicity
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op3_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    toxic = [r.predicted for r in held if labels[r.doc_id] == 1]
    clean = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_edges(spark):
    docs = documents(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    got = T.classify(docs, none).collect()
    assert len(got) == len(EDGES) and all(r.score == 0.0 for r in got)
    rows = EDGES + [(100 + i, f"{'vile slur' if i % 2 else 'kind note'} number {i} " * 20, "en") for i in range(150)]
    labels = spark.createDataFrame([(100 + i, i % 2, "x") for i in range(150)] + [(1, None, "x"), (101, 1, "y")],
                                   "doc_id long, toxic int, text string")
    got = T.classify(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score
    assert all(by[100 + i].predicted == i % 2 for i in range(150))
    one = T.classify(documents(spark, rows), labels.filter("toxic = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert T.classify(docs.filter("doc_id < 0"), labels).count() == 0
    kept = T.without_toxic(documents(spark, rows), labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 75


def test_rare_toxic_wording_is_kept():
    # 20 of 1000 toxic texts (2%) hold nothing but a wording of their own, a stem of four characters
    toxic = [f"common slur w{i}" for i in range(980)] + [f"text boco{chr(97 + i)}x w{i}" for i in range(20)]
    ordinary = [f"text common w{i}" for i in range(1000)]
    got = T.fragments(toxic, ordinary)
    assert b" slur " in got and got.count(b" boco") == 20
    many = [f" unit{i:04d} ".encode() for i in range(400)]  # more than 1536 bytes
    assert all(x in T.completed(b"", many) for x in many)


def test_windows_cover_whole_texts():
    for n in (0, 1, 39, 40, 41, 63, 64, 65, 1000):
        data = bytes(i % 251 for i in range(n))
        w = T.windows(data)
        assert w[0] == data[:T.WINDOW] and (not n or w[-1].endswith(data[-1:]))
        assert set(range(n)) == {i * T.STEP + j for i, x in enumerate(w) for j in range(len(x))}
        blocks, at = [], 0
        while part := T.windows(data, at, 7):
            blocks += part
            at += 7
        assert blocks == w


def test_language_on_held_out_documents(spark):
    from staffwise.llm.queries import op5_language_id
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_language_id(spark, sf).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_copies_do_not_thin_a_language_sample(spark):
    from staffwise.llm.common import labelled_sample
    rows = [("fr", "copie")] * 20_000 + [("fr", f"texte {i}") for i in range(300)] + [("en", f"text {i}") for i in range(300)]
    got = labelled_sample(spark.createDataFrame(rows, "lang string, text string"), "lang", 200, 1000)
    assert [sum(k == x for k, _ in got) for x in ("en", "fr")] == [200, 200]
    assert len(set(got)) == 400


def test_language_edges(spark):
    got = G.identify(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 3, 5} <= und and all(r.score == 0 for r in got if r.doc_id in (1, 2, 3, 5))
    nothing = G.identify(documents(spark, [(d, t, None) for d, t, _ in EDGES])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert G.identify(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 40])
def test_counts_do_not_depend_on_blocks(monkeypatch, n):
    text = "Abcé defG hij"[:n] * (1 if n < 14 else 9)
    whole = G.counts(text)
    monkeypatch.setattr(G, "BLOCK", 4)
    assert (G.counts(text) == whole).all()
    assert whole.sum() == sum(max(0, len(text) - k) for k in range(3))


def test_far_texts_are_rejected():
    model = G.fit([(k, t) for k, t in [("aa", "lorem ipsum dolor sit amet " * 9)] * 6
                   + [("bb", "quick brown foxes jump over lazy dogs " * 9)] * 6])
    assert G.predict(model, "lorem ipsum dolor")[0] == "aa"
    assert G.predict(model, "щука плавает")[2] and not G.predict(model, "lorem ipsum dolor sit amet " * 3)[2]
