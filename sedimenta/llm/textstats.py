"""Counts over whole texts that the quality operators share (runs in Python workers)."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Character classes, by the first byte of a character in UTF-8.
CLASSES = ["lower", "upper", "digit", "space", "symbol", "punctuation", "other"]
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

#: Common words of each language, fixed values.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on are this from at or an not have which he you but all were they".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son aux cette".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
N_COMMON = max(map(len, COMMON.values()))
_PLACE = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON.items()}
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _table() -> np.ndarray:
    out = np.full(256, 7, dtype=np.uint8)  # 7: inside a character
    for b in range(128):
        c = chr(b)
        if c in SPACE:
            out[b] = 3
        elif c in SYMBOLS:
            out[b] = 4
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        else:
            out[b] = 5
    out[0xC0:] = 6
    return out


TABLE = _table()


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in three-word windows found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    n, reach = 0, 0  # words before ``reach`` are counted
    for i, w in enumerate(windows):
        if count[w] > 1:
            n += i + 3 - max(i, reach)
            reach = i + 3
    return n


def counts(text: str, lang: str | None) -> dict:
    """Base counts of a text, its character classes and the common words of its language."""
    data = text.encode()
    words = data.split()
    classes = np.bincount(TABLE[np.frombuffer(data, dtype=np.uint8)], minlength=8)[:7]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    common = np.zeros(N_COMMON + 1, dtype=np.int64)
    place = _PLACE.get(lang or "")
    distinct = Counter(words)
    if place:
        for w, n in distinct.items():
            if len(w) < 16:
                i = place.get(w.strip(_STRIP).lower())
                if i is not None:
                    common[i] += n
        common[-1] = len(words) - common.sum()
    return {
        "n_words": len(words),
        "word_chars": len(text) - int(classes[3]),
        "n_symbols": int(classes[4]),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "classes": classes,
        "common": common if place else None,
        "n_distinct": len(distinct),
        "n_lines": len(lines),
    }
