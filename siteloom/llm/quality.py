"""Text statistics of a page's main part, and what an outlier's contributions say about it.

The squared Mahalanobis distance of a page from the prose of its language is split among the
statistics. A page beyond the threshold is named by the statistics that put it there: rows of
cells and digits make a table, short lines without a sentence's end a list, symbols, odd word
lengths and missing common words junk. Nothing else decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from operator import mul

from siteloom.llm.blocks import _BULLET, _COUNT, _WORD, ALL_STOP, CLOSERS, ENDINGS, GOOD, STOP_WORDS, is_row
from siteloom.llm.residue import outside

#: The statistics of the distance, in the order of its vectors.
STATS = ("log_words", "word_length", "symbol_share", "punct_share", "common_share", "line_words", "cell_share", "digit_share")
#: Which statistics speak for a kind, and on which side of the mean (0: either).
KINDS = {
    "list": (("line_words", -1), ("punct_share", -1)),
    "table": (("cell_share", 1), ("digit_share", 1)),
    "junk": (("common_share", -1), ("symbol_share", 1), ("word_length", 0)),
}
#: Steps of the histogram from which medians are read; each statistic has about a thousand.
STEPS = (0.02, 0.04, 0.001, 0.001, 0.001, 0.02, 0.001, 0.001)
#: Least spread of each statistic, for trimming and, squared, as ridge of the covariance.
LEAST_SPREAD = (0.1, 0.1, 0.004, 0.05, 0.02, 0.1, 0.02, 0.01)
#: Variance of a page's statistic about the page's own mean: a constant, per word, and per line. A short page's
#: deviations are scaled down by it. Length itself may differ by a factor of two.
NOISE = ((1, 0, 0), (0, 6, 0), (0, 0.02, 0), (0, 0, 0.2), (0, 0.23, 0), (0, 0, 1), (0, 0, 0), (0, 0.02, 0))
LONGEST_WORD = 40.0

#: Symbols, without the marks that part cells; cells are a statistic of their own.
_SYMBOL = re.compile(r"[^\w\s|;,]")
_RUN, _DIGIT = re.compile(r"\w+"), re.compile(r"\d")


#: Counts of a token, packed into one integer of fields of so many bits, so that a page's counts are added up in one pass.
FIELD_BITS = 48
_FIELD = (1 << FIELD_BITS) - 1


@lru_cache(maxsize=200_000)
def _token(token: str) -> int:
    """Of a token in lower case, packed: words, runs of letters and digits, their characters, symbols, digits, characters that no message has
    (``residue.outside``), common words, and common words of each language."""
    b, size = FIELD_BITS, len(token)
    if token.isdecimal():
        return 1 << b | size << 2 * b | size << 4 * b
    if token.isalpha():
        words, packed = [token], 1 | 1 << b | size << 2 * b | outside(token) << 5 * b
    else:
        words, runs = _WORD.findall(token), _RUN.findall(token)
        packed = len(words) | len(runs) << b | len("".join(runs)) << 2 * b | len(_SYMBOL.findall(token)) << 3 * b | len(_DIGIT.findall(token)) << 4 * b | outside(token) << 5 * b
    for word in words:
        if word in ALL_STOP:
            packed += 1 << 6 * b
            for i, stop in enumerate(STOP_WORDS.values(), 7):
                packed += (word in stop) << i * b
    return packed


def is_sentence(line: str) -> bool:
    """Whether a line ends as sentences do."""
    return line.rstrip(CLOSERS).endswith(ENDINGS[:-1])


def page_stats(lines: list[str], labels: list[int]) -> tuple[str, list[float], int, int, int]:
    """Language, statistics in the order of ``STATS``, the numbers of words and lines they rest on (1 at least), and the characters
    that no filler, message or notice has.

    An own headline and one leading sentence are set aside; bullets and counts at a line's end aren't read as
    symbols. The language is the one whose common words are most frequent, '' if they are rare. A page
    without main part has zeros.
    """
    main = [line for line, label in zip(lines, labels) if label == GOOD]
    if len(main) > 1 and len(main[0]) <= 140 and not is_sentence(main[0]) and not is_row(main[0]):
        main = main[1:]
    if len(main) > 2 and is_sentence(main[0]) and len(main[0]) <= 400:
        main = main[1:]
    text = "\n".join([_COUNT.sub("", _BULLET.sub("", x)) if not x[0].isalpha() or x[-1] == ")" else x for x in main])
    tokens = Counter(text.lower().split())
    packed = sum(map(mul, map(_token, tokens), tokens.values()))
    words, runs, run_chars, symbols, digits, foreign, common, *by_lang = [packed >> FIELD_BITS * i & _FIELD for i in range(7 + len(STOP_WORDS))]
    size, n, m = max(1, len(text)), max(1, runs), max(1, len(main))
    stats = [
        math.log2(1 + words),
        min(LONGEST_WORD, run_chars / n),
        symbols / size,
        sum(map(is_sentence, main)) / m,
        common / n,
        math.log2(1 + runs / m),
        sum([len(x) for x in main if is_row(x)]) / max(1, sum(map(len, main))),
        digits / size,
    ]
    most = max(by_lang)
    lang = list(STOP_WORDS)[by_lang.index(most)] if most and most >= max(2, 0.08 * words) else ""
    return lang, stats, n, m, foreign
