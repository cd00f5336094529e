"""What a worker holds at once while it hashes and encodes texts, and that results do not depend on it."""

import numpy as np
import public_tokenizers

from wherewords.llm import encode, tables
from wherewords.llm.encode import PieceEncoder, read_tokenizer

TEXTS = [" ".join(f"w{i}x{j}, y{j}." for j in range(500)) for i in range(12)] + ["", "one", "A" * 300_000 + " b"]


def test_few_pieces_go_to_the_library_at_once(monkeypatch):
    settings = read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    encoder, calls = PieceEncoder(settings), []
    library = encoder._library
    encoder._library = lambda texts: calls.append(len(texts)) or library(texts)
    ids, lengths = encoder.encode(TEXTS, 2)
    assert sum(calls) > 6000 and max(calls) <= 2000
    whole = [encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2] for text in TEXTS]
    assert ids.tolist() == [i for one in whole for i in one] and lengths.tolist() == [len(one) for one in whole]
    monkeypatch.setattr(encode, "PIECES_AT_ONCE", 7)
    again = PieceEncoder(settings).encode(TEXTS, 2)
    assert np.array_equal(ids, again[0]) and np.array_equal(lengths, again[1])


def test_hashes_in_small_chunks(monkeypatch):
    monkeypatch.setattr(tables, "_powers", {})
    hashes = tables.WordBatch(TEXTS[:12]).hashes
    assert sum(powers.nbytes for powers in tables._powers.values()) <= 4 << 20
    whole = tables.WordBatch(TEXTS).hashes
    assert np.array_equal(hashes, whole[: len(hashes)])
    for chunk in (64, 1 << 20):
        monkeypatch.setattr(tables, "_CHUNK", chunk)
        monkeypatch.setattr(tables, "_powers", {})
        assert np.array_equal(whole, tables.WordBatch(TEXTS).hashes)
