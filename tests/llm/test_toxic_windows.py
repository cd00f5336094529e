"""Windows of many texts in one call of the compressor."""

import numpy as np

from wherewords.llm import toxicity

TOXIC = [f"you awful filthy liar number {i}" for i in range(60)]
CLEAN = [f"the harbour opens at noon on day {i}" for i in range(60)]
TEXTS = ["", "a", "é" * 3, "x" * 16, "y" * 17, "z" * 5000, *TOXIC, "", *CLEAN]


def model():
    return toxicity.Model(*toxicity.train_dictionaries(TOXIC, CLEAN), [0.3] * toxicity.FIGURES, -1.0)


def test_together_as_alone(monkeypatch):
    one = model()
    together = one.score(TEXTS)
    assert np.array_equal(together, [one.score([text])[0] for text in TEXTS])
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    assert np.array_equal(together, one.score(TEXTS))


def test_windows_cover_the_text():
    for text in TEXTS:
        windows, counts = toxicity.scored_windows([text])
        parts = windows.view(np.uint8).reshape(-1, toxicity.SCORED_BYTES)
        raw = b"".join(bytes(p[: toxicity.STRIDE]) for p in parts[:-1]) + (bytes(parts[-1]) if len(parts) else b"")
        assert raw.rstrip(b" ") == text.lower().encode() and list(counts) == [len(parts)]


def test_few_calls_for_many_short_texts():
    one, calls = model(), []

    class Counting:
        def __init__(self, compressor):
            self.compressor = compressor

        def multi_compress_to_buffer(self, windows):
            calls.append(len(windows))
            return self.compressor.multi_compress_to_buffer(windows)

    one._pair = [Counting(c) for c in one._compressors()]
    one.score(TOXIC + CLEAN)
    assert len(calls) == 2
