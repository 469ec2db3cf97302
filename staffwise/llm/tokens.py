"""Token ids as the ``tokenizers`` library gives them, with reuse of pieces."""

from __future__ import annotations

import json
from array import array

import numpy as np

# pieces whose ids one Python worker keeps at most; past it the store is emptied
MEMO_PIECES = 1_000_000
STOPS = frozenset(",.;:!?")


def hard_whitespace(spec: dict) -> bool:
    """True if no token of this tokenizer can reach over a space or line feed,
    so that the ids of a text are those of its space-separated pieces in turn.

    Holds when texts are cut into words by a pattern that keeps only runs
    without white space, normalisation acts within words, nothing is added
    around a text, and added tokens neither hold nor swallow white space.
    """
    def kinds(part):
        if not part:
            return []
        return [x for k in ("normalizers", "pretokenizers") for x in part.get(k, [])] or [part]

    normal = all(n["type"] in ("NFC", "Lowercase")
                 or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"}
                     and n["content"] == " ") for n in kinds(spec.get("normalizer")))
    cuts = [p for p in kinds(spec.get("pre_tokenizer")) if p["type"] == "Split"]
    level = [p for p in kinds(spec.get("pre_tokenizer")) if p["type"] == "ByteLevel"]
    words = any(p["behavior"] == "Removed" and p["invert"]
                and p["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
                for p in cuts)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
                and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return (normal and words and added and spec.get("post_processor") is None
            and all(not p["add_prefix_space"] for p in level))


class Encoder:
    """``ids(text)``: the library's ids (add_special_tokens=False, truncation
    and padding off) as packed little-endian unsigned 32-bit integers.

    Where white space is a hard boundary, each distinct piece between spaces
    and line feeds is encoded once per worker and its ids are reused (the
    store holds at most MEMO_PIECES pieces); otherwise whole texts are encoded.
    """

    def __init__(self, spec_json: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_str(spec_json)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.loads(spec_json)
        self.by_piece = hard_whitespace(spec)
        # lower-casing A-Z beforehand merges pieces; only where the tokenizer
        # lower-cases itself and no added token's text can be involved
        parts = spec.get("normalizer") or {}
        self.lowers = any(n.get("type") == "Lowercase" for n in [parts, *parts.get("normalizers", [])])
        self.openers = {t["content"][:2] for t in spec.get("added_tokens", [])}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocab = self.lib.get_vocab(with_added_tokens=False)
        size = 1 + max(self.lib.get_vocab(with_added_tokens=True).values(), default=0)
        self.ends = np.zeros(size, bool)  # tokens that end a word
        self.ends[[i for w, i in vocab.items() if suffix and w.endswith(suffix)]] = True
        # without a decoder the library joins the tokens with spaces
        self.words = None if spec.get("decoder") else \
            [self.lib.id_to_token(i) or "" for i in range(size)]
        self.memo: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_piece:
            return self.whole(text)
        if self.lowers and not any(o in text for o in self.openers):
            text = text.encode("utf-8").lower().decode("utf-8")
        pieces = text.replace("\n", " ").split(" ")
        got = list(map(self.memo.get, pieces))
        if None in got:
            missing = [i for i, ids in enumerate(got) if ids is None]
            new = self._new({pieces[i] for i in missing})
            for i in missing:
                got[i] = new[pieces[i]]
        return b"".join(got)

    def _new(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not stored yet; a word with a stop behind it
        is two tokenizer words, and its ids those of each."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
            self.memo[""] = b""
        memo = self.memo
        stopped = [p for p in pieces if len(p) > 1 and p[-1] in STOPS and p[:-1].isalpha()]
        self._learn({p[:-1] for p in stopped} | {p[-1] for p in stopped} | pieces.difference(stopped))
        for p in stopped:
            memo[p] = memo[p[:-1]] + memo[p[-1]]
        return memo

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pieces, plain words in one call: the ids of each end with
        its only word-ending token."""
        memo = self.memo
        new = [p for p in pieces if p not in memo]
        plain = [p for p in new if p.isascii() and p.isalpha()]
        ids = np.array(self.lib.encode(" ".join(plain), add_special_tokens=False).ids, np.uint32)
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) == len(plain):
            raw = ids.tobytes()
            memo.update(zip(plain, (raw[a:b] for a, b in zip([0, *ends], ends))))
            new = [p for p in new if p not in memo]
        for p, e in zip(new, self.lib.encode_batch_fast(new, add_special_tokens=False)):
            memo[p] = array("I", e.ids).tobytes()

    def text_of(self, ids: bytes) -> str:
        numbers = memoryview(ids).cast("I").tolist()
        if self.words:
            return " ".join(map(self.words.__getitem__, numbers))
        return self.lib.decode(numbers, skip_special_tokens=False)


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec_json: str) -> Encoder:
    """This worker's encoder of a tokenizer (kept between tasks)."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(spec_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec_json)
    return _ENCODERS[key]


def broadcast_tokenizer(spark, path: str):
    """The tokenizer's JSON text (a few MB, bounded by its vocabulary, not by
    the data), read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
