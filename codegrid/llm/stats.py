"""Document statistics that quality and toxicity models share: one row of numbers per text, from whole texts."""

from __future__ import annotations

import re

import numpy as np

#: names of the statistics, in order. Shares are under the arcsine root transformation, sizes under log(1 + x).
NAMES = ["log_bytes", "log_words", "word_length", "upper", "digits", "stops", "commas", "bangs", "pipes", "symbols",
         "odd_ends", "lines", "distinct", "repeated_lines"]
_SYMBOLS = np.array([ord(c) for c in "#$%&*+<=>@\\^_`{}~"])
_ODD_END = re.compile(rb"[#$%&*|!@^~]+(?=\s|$)")
_LETTERS = np.r_[65:91, 97:123, 128:256]


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(NAMES))
    if not raw.strip():
        out[0] = np.log1p(len(raw))
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = set(words)
    n, letters = len(words), max(1, hist[_LETTERS].sum())
    share = [hist[65:91].sum() / letters, hist[48:58].sum() / len(raw), hist[46] / n, hist[44] / n, hist[33] / n, hist[124] / n,
             hist[_SYMBOLS].sum() / n, len(_ODD_END.findall(raw)) / n, len(lines) / n]
    out[:3] = np.log1p(len(raw)), np.log1p(n), np.log1p(len(raw) / n)
    out[3:12] = np.arcsin(np.sqrt(np.minimum(share, 1.0)))
    # the share of distinct words falls with the length whatever the text: Herdan's index takes that out
    out[12] = np.log1p(len(seen)) / np.log1p(n)
    out[13] = np.arcsin(np.sqrt(1 - len(set(lines)) / max(1, len(lines))))
    return out
