import numpy as np

from quillspark.llm import language_crf


def grams_of(w):
    """The features of a word, told by the words that have them and nothing else."""
    m = b"^" + w + b"$"
    return sum(max(0, len(m) - k + 1) for k in range(1, 5)) + 1 + 6


def test_long_words_are_seen_whole(monkeypatch):
    for n in (1, 3, 29, 30, 31, 32, 59, 60, 88, 500):
        w = (b"abcdefghijklmnopqrstuvwxyz0123456789" * 20)[:n]
        who, what = language_crf.features([b"x", w, b"y"])
        assert (who == 1).sum() == grams_of(w)
    head = b"a" * 100
    one, other = (set(language_crf.features([head + tail])[1].tolist()) for tail in (b"tion", b"heit"))
    assert len(one ^ other) > 10
    # The n-grams of the middle and those of both ends are those of short words.
    _, long = language_crf.features([b"q" * 40 + b"zebra" + b"q" * 40])
    assert len(set(language_crf.features([b"zebra"])[1].tolist()) & set(long.tolist())) >= 5 + 4 + 3 + 2 - 5
    _, tail = language_crf.features([b"q" * 90 + b"heit"])
    assert len(set(language_crf.features([b"heit"])[1].tolist()) & set(tail.tolist())) >= 4 + 3 + 2 + 1
    words = [b"w%d" % k for k in range(50)] + [b"long" * k for k in range(1, 60)]
    model = language_crf.Model(["a", "b"])
    model.weights[:] = np.random.default_rng(1).normal(size=model.weights.shape)
    whole = model.scores(words)
    monkeypatch.setattr(language_crf, "PIECES", 3)
    assert np.allclose(model.scores(words), whole, atol=1e-5)
