"""Style features of a text, in no particular language. They read the whole text."""

from __future__ import annotations

import zlib
from collections import Counter
from math import log1p

import numpy as np

_MARKS = b"*#&%$|<>{}[]=_~^\\/@"
_UPPER, _LOWER, _DIGITS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:"
NAMES = (
    "chars", "words", "word_length", "long_words", "short_words", "marks", "pipes", "bangs", "upper", "digits", "stops", "beyond_ascii", "lines",
    "line_repeats", "short_lines", "distinct", "same_as_last", "top_word", "same_pairs", "compressed", "per_sentence", "capitals", "marked_ends", "bigram_repeats",
)


def style(text: bytes) -> list[float]:
    n = len(text)
    words = text.split()
    w = len(words)
    if not w:
        return [0.0] * len(NAMES)
    drop = lambda chars: (n - len(text.translate(None, chars))) / n
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = [len(x) for x in words]
    pairs = Counter(zip(words, words[1:], strict=False))
    upper, lower = drop(_UPPER), drop(_LOWER)
    stops = drop(_STOPS)
    inner = n - (w - 1)
    ascii_part = len(text.translate(None, bytes(range(128, 256))))
    return [
        log1p(n), log1p(w), inner / w, sum(x > 12 for x in lengths) / w, sum(x < 3 for x in lengths) / w, drop(_MARKS), drop(b"|"), drop(b"!"), upper, drop(_DIGITS), stops,
        (n - ascii_part) / n, len(lines) / w, 1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 20 for x in lines) / max(1, len(lines)), len(counts) / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, counts.most_common(1)[0][1] / w, 1 - len(pairs) / max(1, w - 1), len(zlib.compress(text, 1)) / n,
        log1p(w / (1 + text.count(b". ") + text.count(b".\n"))), upper / max(1e-9, upper + lower), sum(x[-1] in _MARKS for x in words) / w, pairs.most_common(1)[0][1] / w if pairs else 0.0,
    ]


def styles(texts: list[bytes]) -> np.ndarray:
    return np.array([style(t) for t in texts], float).reshape(len(texts), len(NAMES))


class Steps:
    """Turns each feature into its standard score and indicators of the fitting rows' quantiles."""

    CUTS = (0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98)

    def __init__(self, x: np.ndarray):
        self.mean, self.sd = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.cuts = np.quantile(x, self.CUTS, axis=0) if len(x) else np.zeros((len(self.CUTS), x.shape[1]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.sd, -5, 5), *(np.asarray(x > c, float) for c in self.cuts)])
