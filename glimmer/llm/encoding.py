"""Texts to token ids with a public tokenizer file of the ``tokenizers`` library.

Where a tokenizer drops white space before it splits (checked in its file), a text's ids are the ids of its
white-space separated words one after another. Distinct words are then encoded once a worker and looked up after;
other tokenizers encode whole texts.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: Words, and pieces of words, that a worker remembers; more are encoded again.
MEMORY = 200_000
PIECE_MEMORY = 400_000
#: Texts whose words are looked up together: their table stays small enough for the processor's cache.
TOGETHER = 64
#: Fixed value: the split pattern, in the tokenizer's file, that never joins letters with anything else.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of visible ASCII and Latin-1 letters, which no normal form changes, and SPLIT for them in lower case.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: What every special token's string holds; words with it go through the whole tokenizer.
MARK = "<|"


class Encoder:
    """``ordinary``: the strings of special tokens in a text are ordinary text, so no text yields a special id."""

    def __init__(self, path: str, ordinary: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._separable(spec)
        self.model, self._as_bytes = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._known: dict[bytes, bytes] = {}  # ids as little-endian u32, a third of a tuple's size
        self._pieces: dict[str, bytes] = {}

    @staticmethod
    def _separable(spec: dict) -> bool:
        """Do white-space separated words encode on their own? True for normalisers that look at one character or its
        combining marks, a splitter whose pieces hold no white space and which drops the rest, and a model that sees
        one piece at a time."""
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        parts = [(x["type"], (x.get("pattern") or {}).get("Regex"), x.get("content")) for x in norm.get("normalizers", [])]
        first, *rest = pre.get("pretokenizers", [{}])
        return (
            parts == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
            and first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
            and [(x["type"], x["use_regex"], x["add_prefix_space"]) for x in rest] == [("ByteLevel", False, False)]
            and spec["model"]["type"] == "BPE"
            and not any(x["lstrip"] or x["rstrip"] or x["normalized"] or MARK not in x["content"] for x in spec["added_tokens"])
        )

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(piece if piece.isascii() else self._as_bytes(piece)[0][0])]).tobytes()
            if len(self._pieces) < PIECE_MEMORY:
                self._pieces[piece] = ids
        return ids

    def _words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Plain words are put together from their pieces' ids, which far fewer distinct ones share; all else goes
        through the whole tokenizer."""
        out, rest, piece = {}, [], self._piece
        for w in new:
            t = w.decode("utf-8", "replace")
            if PLAIN.fullmatch(t) and MARK not in t:
                low = t.lower()
                out[w] = piece(low) if w.isalpha() else b"".join(map(piece, PIECES.findall(low)))
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)):
            out[w] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text as uint32."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        known, out = self._known, []
        for a in range(0, len(texts), TOGETHER):
            split = [t.split() for t in texts[a : a + TOGETHER]]
            distinct = set(itertools.chain.from_iterable(split))
            table = dict(zip(distinct, map(known.get, distinct)))
            new = self._words([w for w, ids in table.items() if ids is None])
            table.update(new)
            known.update(itertools.islice(new.items(), max(0, MEMORY - len(known))))
            out += [np.frombuffer(b"".join(map(table.__getitem__, ws)), np.uint32) for ws in split]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, ordinary: bool = False) -> Encoder:
    return Encoder(path, ordinary)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
