"""Word coding: texts to number arrays through a table of the words that matter."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np

#: ASCII that is no letter or digit parts words; so does this punctuation beyond ASCII.
_PARTS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
_OTHER = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u206f\u3000-\u303f\ufeff]+")


def words(text: str | None) -> list[bytes]:
    """Lower-case words in UTF-8."""
    t = (text or "").lower()
    if not t.isascii() and _OTHER.search(t):
        t = _OTHER.sub(" ", t)
    return t.encode("utf-8", "replace").translate(_PARTS).split()


class Coder:
    """Numbers for words; 0 for a word that is not in ids."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids

    def codes(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.ids.get, w, repeat(0)), np.int64, len(w))
