"""Texts to token ids, with the ids of pieces kept in the worker.

A tokenizer splits a text before it applies its merges, so pieces between safe cuts can
be encoded alone and the ids put one after the other. Which cuts are safe follows from
the tokenizer's own settings:

``spaced``   byte-level BPE: before a single blank between two other characters, around a
             single line feed between two other characters
``dropped``  white space takes part in no token: at every blank, line feed and tab

Any other tokenizer, a text with a special token's string, and in ``spaced`` a text with
other runs of white space are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
from tokenizers import Tokenizer

from wherewords.llm.tables import WordBatch, mix, word_hashes

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def cut_rule(settings: dict) -> str | None:
    splitter, normalizer = settings.get("pre_tokenizer") or {}, settings.get("normalizer")
    if splitter.get("type") == "ByteLevel" and normalizer is None:
        return "spaced" if splitter.get("use_regex") and not splitter.get("add_prefix_space") else None
    parts = splitter.get("pretokenizers") or [{}]
    first = parts[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    steps = [n.get("type") for n in (normalizer or {}).get("normalizers", [])]
    removes = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    if removes and " " not in pattern and pattern.endswith(r"[^\s\p{L}\p{N}]+") and steps == ["NFC", "Replace", "Lowercase"]:
        return "dropped"
    return None


CUT = "\0"
#: Pieces that the library encodes in a call.
PIECES_AT_ONCE = 2000


def singly_spaced(text: str) -> bool:
    """Whether each run of white space is one blank or line feed between other characters."""
    bare = text.replace("\n", " ")
    # Printable: no other white space.
    return bare.isprintable() and "  " not in bare and bare == bare.strip(" ")


class PieceEncoder:
    """Ids of a batch of texts as one array.

    A text is cut at its white space, and before a comma or full stop after an ASCII letter
    or digit at a word's end. Pieces are told apart by 64-bit hashes, and the ids of those
    seen before are copied out of one array; new ones go to the library in one call per
    batch. At most ``most_pieces`` are remembered.
    """

    def __init__(self, tokenizer_json: str, most_pieces: int = 1_500_000):
        # The library's own threads would compete with Spark's tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        settings = json.loads(tokenizer_json)
        self.rule = cut_rule(settings)
        self.special = [t["content"] for t in settings.get("added_tokens", [])]
        self.most = most_pieces
        alone = [self._library([mark])[0] for mark in ("\n", ",", ".")]
        if any(len(ids) != 1 for ids in alone[self.rule == "dropped" :]):
            self.rule = None
        self.line, self.comma, self.stop = (int(ids[0]) if ids else 0 for ids in alone)
        self._forget()

    def _forget(self) -> None:
        # Sorted hashes with the slot of each; where a slot's ids begin and end.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [one.ids for one in found]

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, each with the end id, and how many each has."""
        quick = [
            i for i, text in enumerate(texts)
            if self.rule and not any(mark in text for mark in self.special)
            and (self.rule == "dropped" or singly_spaced(text))
        ]
        flat, counts = self._quick([texts[i] for i in quick])
        if len(quick) < len(texts):
            rest = sorted(set(range(len(texts))) - set(quick))
            parts = dict(zip(quick, np.split(flat, np.cumsum(counts)[:-1]), strict=False))
            parts.update(zip(rest, (np.array(ids, np.uint32) for ids in self._library([texts[i] for i in rest])), strict=True))
            counts = np.array([len(parts[i]) for i in range(len(texts))], np.int64)
            flat = np.concatenate([parts[i] for i in range(len(texts))])
        lengths = counts + 1
        out = np.full(int(lengths.sum()), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = flat
        return out, lengths

    def _quick(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        batch = WordBatch(texts, hashed=False)
        raw, starts, ends = batch.raw, batch.starts, batch.ends
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        last, before = raw[ends - 1], raw[np.maximum(ends - 2, 0)]
        marked = ((last == ord(",")) | (last == ord("."))) & (ends - starts > 1) & _ALNUM[before]
        core_ends = ends - marked
        keys = word_hashes(raw, starts, core_ends, lower=self.rule == "dropped")
        blank = np.zeros(len(starts), bool)
        line = np.zeros(len(starts), np.int64)
        if self.rule == "spaced":
            opens = np.zeros(len(starts) + 1, bool)
            opens[batch.first[:-1]] = True
            follows = raw[np.maximum(starts - 1, 0)]
            blank = (follows == ord(" ")) & ~opens[:-1]
            line = ((follows == ord("\n")) & ~opens[:-1]).astype(np.int64)
            keys = np.where(blank, mix(keys ^ np.uint64(0x9E3779B97F4A7C15)), keys)
        slots = self._slots(keys, lambda k: " " * bool(blank[k]) + bytes(raw[starts[k] : core_ends[k]]).decode("utf-8", "surrogatepass"))
        own = self.bounds[slots + 1] - self.bounds[slots]
        sizes = line + own + marked
        begins = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        flat[begins[line > 0]] = self.line
        flat[(begins + sizes - 1)[marked]] = np.where(last[marked] == ord(","), self.comma, self.stop)
        inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        flat[inside + np.repeat(begins + line, own)] = self.ids[inside + np.repeat(self.bounds[slots], own)]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return flat, np.diff(sums[batch.first])

    def _slots(self, keys: np.ndarray, piece) -> np.ndarray:
        """The slot of each key; ``piece(k)`` is the text of the k-th."""
        if len(self.keys) > self.most:
            self._forget()
        unique, first, where = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != unique[inside]
        if new.any():
            fresh = first[new]
            parts, counts = [self.ids], np.empty(len(fresh), np.int64)
            # The library's results hold far more than ids, so few are asked for at once.
            for begin in range(0, len(fresh), PIECES_AT_ONCE):
                found = self._library([piece(k) for k in fresh[begin : begin + PIECES_AT_ONCE]])
                counts[begin : begin + len(found)] = list(map(len, found))
                parts.append(np.fromiter((i for ids in found for i in ids), np.uint32))
            slots = len(self.bounds) - 1 + np.arange(len(fresh))
            self.ids = np.concatenate(parts)
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.slots = np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.keys, unique)
        return self.slots[at][where]


_encoders: dict[int, PieceEncoder] = {}


def worker_encoder(tokenizer_json: str) -> PieceEncoder:
    """The worker's encoder, kept between tasks."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(tokenizer_json)
    return _encoders[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()
