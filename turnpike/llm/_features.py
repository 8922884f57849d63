"""Counts and ratios of one text that the quality operators share. Whole texts, one pass each."""

from __future__ import annotations

import numpy as np

from turnpike.llm._text import WordHashes, rolling_hash

#: Counts, as they are reported.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures for rules and models; all are 0 for a text without words.
MEASURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "exclaims", "pipes", "stops", "commas",
    "top_word", "distinct", "twins", "lines", "longest_word", "non_ascii", "repeat_wide", "alnum",
)
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER, _DIGIT = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_UPPER[65:91] = 1
#: Letters and digits: 0-9, A-Z, a-z, and every byte of a character beyond ASCII.
_ALNUM = np.zeros(256, np.uint8)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = 1
_DIGIT[48:58] = 1


def _covered(hashes: np.ndarray, k: int) -> int:
    """Words inside windows of ``k`` words that occur twice or more."""
    grams = rolling_hash(hashes, k, 4)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    repeated = np.zeros(len(grams), dtype=bool)
    repeated[order[1:][equal]] = True
    repeated[order[:-1][equal]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int32)
    at = np.nonzero(repeated)[0]
    edge[: len(grams)] += repeated
    edge[at + k] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


#: Words of the windows in which distinct words are counted; the share among all words would fall with length alone.
SPAN = 200


def _distinct(hashes: np.ndarray) -> float:
    """Share of distinct words, on average over whole windows of ``SPAN`` words; of all words where there are fewer."""
    n = len(hashes)
    parts = hashes[: n // SPAN * SPAN].reshape(-1, SPAN) if n >= SPAN else hashes.reshape(1, -1)
    ranked = np.sort(parts, axis=1)
    return 1.0 - float((ranked[:, 1:] == ranked[:, :-1]).mean()) * (parts.shape[1] - 1) / parts.shape[1] if parts.shape[1] > 1 else 1.0


def measure(data: bytes, memory: WordHashes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """``COUNTS`` and ``MEASURES`` of a text in UTF-8."""
    words = data.split()
    n = len(words)
    bytes_ = np.frombuffer(data, np.uint8)
    points = len(data) - int(((bytes_ & 0xC0) == 0x80).sum())
    word_chars = points - sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    pipes = data.count(b"|")
    symbols = pipes + sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">"))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    dup_lines = len(lines) - len(set(lines))
    if not n:
        return (0, word_chars, symbols, dup_lines, 0), (0.0,) * len(MEASURES)
    hashes = memory.of(words)
    repeat = _covered(hashes, 3)
    ranked = np.sort(hashes)
    runs = np.diff(np.nonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))[0])
    measures = (
        float(np.log1p(n)), word_chars / n, symbols / n, dup_lines / len(lines), repeat / n, float(_UPPER[bytes_].sum()) / word_chars,
        float(_DIGIT[bytes_].sum()) / word_chars, data.count(b"!") / n, pipes / n, data.count(b".") / n, data.count(b",") / n,
        float(runs.max()) / n, _distinct(hashes), float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0, len(lines) / n,
        float(max(map(len, words))), (len(data) - points) / word_chars, _covered(hashes, 8) / n,
        float(_ALNUM[bytes_].sum()) / (word_chars + len(data) - points),
    )
    return (n, word_chars, symbols, dup_lines, repeat), measures
