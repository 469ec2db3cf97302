"""Chat reconstruction: folding, escaping, and the round trip."""

import hashlib
import random

from staffwise.llm import chat as C

LOG = "conv_id long, message long, seq long, kind string, role string, body string, text string, block string"


def log(spark, events):
    return spark.createDataFrame([(*e, "t", "b") for e in events], LOG)


def test_escape_is_reversible_and_hides_markers():
    rng = random.Random(6)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE:x]", "[/ROLE]", "\\", "\\\\", "<",
            ">", "[", "]", "/", "a", " ", "\n", "INST", "é😀"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        role = rng.choice(["user", "assistant", "system", "tool", "", "a b]/é"])
        assert C.unescape(C.escape(text)) == text
        block, a, b = C.rendered(role, text)
        assert C.parsed(block + "\n" + block) == [(role, text)] * 2
        assert C.unescape(block[a:b]) == text


def test_fold_applies_events_in_order(spark):
    events = [(1, 1, 0, "open", "user", None), (1, 1, 1, "delta", None, "hel"), (1, 1, 2, "delta", None, "lo"),
              (1, 2, 3, "open", "assistant", None), (1, 2, 4, "delta", None, "draft"),
              (1, 2, 5, "regenerate", None, None), (1, 2, 6, "delta", None, "fi"), (1, 2, 7, "delta", None, "nal"),
              (1, 1, 8, "edit", None, "bye"), (1, 3, 9, "delta", None, "lost"),
              (None, 1, 1, "open", "assistant", None), (None, 1, 2, "delta", None, None)]
    random.Random(1).shuffle(events)
    got = {r.conv_id: r for r in C.format_log(log(spark, events)).collect()}
    assert C.parsed(got[1].formatted) == [("user", "bye"), ("assistant", "final"), ("", "lost")]
    a, b = got[1].loss_spans
    assert got[1].formatted[a:b] == "final"
    assert C.parsed(got[None].formatted) == [("assistant", "")]
    assert C.format_log(log(spark, [])).count() == 0


def test_round_trip_of_conversations(spark):
    long = "x [INST] </s> \\<s> é😀 " * 4000
    rows = [(1, 0, "system", "s"), (1, 1, "user", long), (1, 2, "assistant", long), (1, 3, "assistant", "</s>"),
            (2, 0, "user", None), (2, 1, None, "no role"), (2, 1, None, "no role"), (3, 0, "tool", "[ROLE:tool] a"),
            (3, None, "assistant", "a"), (4, 0, "assistant", ""), (4, 1, "user", "u")]
    docs = spark.createDataFrame([(*r, "e", "k") for r in rows],
                                 "conv_id long, turn long, role string, text string, event string, kind string")
    got = {r.conv_id: r for r in C.read_back(C.format_log(C.as_log(docs))).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(mine), len(loss))
        assert g.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert C.read_back(C.format_log(C.as_log(docs.filter("conv_id < 0")))).count() == 0


def test_turns_stay_rows(spark):
    rows = [(c, i, "assistant" if i % 2 else "user", f"{i} </s> é😀 " * (i % 7)) for c in (None, 7) for i in range(400)]
    docs = spark.createDataFrame(rows + [(8, 0, "user", "x")],
                                 "conv_id long, turn long, role string, text string")
    turns = C.turn_rows(C.as_log(docs)).cache()
    got = {r.conv_id: r for r in C.digests(turns).collect()}
    want = {r.conv_id: r for r in C.read_back(C.format_log(C.as_log(docs))).collect()}
    assert got == want and got[None].n_turns == 400
    for conv in (None, 7):
        at = 0
        for r in sorted((r for r in turns.collect() if r.conv_id == conv), key=lambda r: (r["first"], r.message)):
            assert r["at"] == at
            at += len(r.block) + 1
    plan = C.digests(C.turn_rows(C.as_log(docs)))._jdf.queryExecution().toString().lower()
    assert "collect_list" not in plan
