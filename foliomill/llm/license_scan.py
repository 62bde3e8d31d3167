"""Licence notices in texts, by Dice coefficient over word bigrams with licence templates.

Texts are normalised to words: lower case, without punctuation, copyright lines left out of the
templates. A window of a text can only reach the coefficient if its length is near the template's:
with d = THRESHOLD its bigrams number between d / (2 - d) and (2 - d) / d of the template's, and at
least d / (2 - d) of the template's number are the template's own. Starts without so many in reach
are dropped; from each other start all windows within the bounds are compared, whatever lies between
their words. A start behind another of the template's bigrams is looked at only where that one cannot be
the better start: where it is taken, or repeats one that the window has already as often as the template.
Work is per row and linear in the text; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.llm import license_texts

THRESHOLD = 0.8
HITS_A_STEP = 16_384  # bigrams whose templates are counted at a time

# Notices of public licences, by SPDX name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
}
# Headers of files, which refer to a text; all other templates but notices are whole texts.
HEADERS = {"Apache-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later",
           "MPL-2.0-header"}
TEMPLATES |= license_texts.HEADERS | license_texts.whole_texts()
for _name, _text in license_texts.notices():
    TEMPLATES.setdefault(_name, _text)
WORD = re.compile(r"\w+")
Found = tuple[str, int, int, float]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(one: Counter, two: Counter) -> float:
    """Twice the common bigrams over all bigrams, repeats counted."""
    return 2 * (one & two).total() / max(1, one.total() + two.total())


_BIGRAMS = {name: bigrams(WORD.findall(text.lower())) for name, text in TEMPLATES.items()}
# All wordings, each once: of a name, the template and others.
_WORDINGS = list({(name, tuple(WORD.findall(text.lower()))): (name, bigrams(WORD.findall(text.lower()))) for name, text in (
    *TEMPLATES.items(), *license_texts.OTHERS, *license_texts.notices())}.values())
_NAMES = [name for name, _ in _WORDINGS]
_PLACES: dict[str, int] = {}
for _, _counts in _WORDINGS:
    for _pair in _counts:
        for _word in _pair:
            _PLACES.setdefault(_word, len(_PLACES) + 1)
# (bigram, wording, repeats) by bigram, and where each bigram's begin.
_HELD = np.array(sorted(
    (_PLACES[a] << 16 | _PLACES[b], at, n) for at, (_, counts) in enumerate(_WORDINGS) for (a, b), n in counts.items()))
_ALL_CODES, _BEGINS, _LISTED = np.unique(_HELD[:, 0], return_index=True, return_counts=True)
_OF = _HELD[:, 1].astype(np.int32)
# Bigrams of each wording, as places among all, and their repeats.
_OWN = [(np.searchsorted(_ALL_CODES, mine[:, 0]).astype(np.int32), mine[:, 2].astype(np.int16))
        for mine in np.split(_HELD[np.argsort(_OF, kind="stable")], np.cumsum(np.bincount(_OF))[:-1])]
_SIZES = np.array([counts.total() for _, counts in _WORDINGS])


def bounds(size: int, threshold: float) -> tuple[float, float]:
    """Numbers of bigrams that can reach the coefficient with a template of ``size`` bigrams."""
    share = threshold / (2 - threshold)
    return share * size - 1e-9, size / share + 1e-9


class _Windows:
    """The windows of a text that reach the coefficient with one wording, by their start.

    They start and end on the wording's bigrams: without others at its ends a window is better.
    """

    def __init__(self, at: int, hits: np.ndarray, which: np.ndarray, repeats: np.ndarray, threshold: float):
        self.hits, self.size, self.threshold = hits, int(_SIZES[at]), threshold
        low, high = bounds(self.size, threshold)
        self.shortest, self.longest = int(np.ceil(low)), int(high)
        # Common bigrams are at most the hits, and a window of the least length needs ``low`` of them.
        near = hits[self.shortest - 1:] - hits[:len(hits) - self.shortest + 1] < self.longest
        self.starts = np.flatnonzero(near)
        if not len(self.starts):
            return
        # A bigram that the wording has n times counts unless the n-th one before it is in the window too.
        order = np.argsort(which, kind="stable")
        places = np.arange(len(hits))
        new = np.append(True, which[order][1:] != which[order][:-1])
        first = np.maximum.accumulate(np.where(new, places, 0))
        earlier = places - repeats[order]
        self.before = np.empty(len(hits), np.int64)
        self.before[order] = np.where(earlier >= first, order[np.maximum(earlier, 0)], -1)

        # The n-th one behind it: from there on, a window that begins with it does not count it.
        behind = np.append(places, len(hits))[np.minimum(places + repeats[order], len(hits))]
        last = np.append(new[1:], True)
        ends = np.minimum.accumulate(np.where(last, places, len(hits))[::-1])[::-1]
        after = np.full(len(hits), -1)
        inside = behind <= ends
        after[order[inside]] = order[behind[inside]]
        # What a start can reach at most: all windows but those that are better from the bigram before it.
        self.reach = np.ones(len(hits))
        follows = np.append(False, hits[1:] == hits[:-1] + 1)
        counted = np.append(-1, after[:-1])
        length = np.where(counted >= 0, hits[np.maximum(counted, 0)] - hits + 1, np.iinfo(np.int64).max // 4)
        bound = np.where(length <= self.longest, 2.0 * self.size / (length + self.size), 0.0)
        self.reach[follows] = bound[follows]
        self.is_start = near
        self.starts = self.starts[self.reach[self.starts] >= threshold]

    def next_start(self, place: int) -> int | None:
        """The first start at a place or behind it, if it is the first of the wording's bigrams there."""
        at = int(np.searchsorted(self.hits, place))
        return at if at < len(self.is_start) and self.is_start[at] else None

    def best(self, start: int, limit: int) -> tuple[float, int] | None:
        """Coefficient and last bigram of the best window from a start, of equal ones the longest;
        none of its bigrams is at ``limit`` or behind it."""
        at = self.hits[start]
        end = int(self.hits.searchsorted(min(at + self.longest, limit)))
        if end - start < self.shortest:
            return None
        common = (self.before[start:end] < start).cumsum()
        # Fewer in common than the least that reaches the coefficient: the windows before that end are too short.
        if common[-1] < self.shortest:
            return None
        skipped = int(common.searchsorted(self.shortest))
        ends = self.hits[start + skipped:end]
        values = 2 * common[skipped:] / (ends - (at - 1 - self.size))
        last = len(values) - 1 - int(values[::-1].argmax())
        return (float(values[last]), int(ends[last])) if values[last] >= self.threshold else None


def _candidates(codes: np.ndarray, threshold: float) -> list[tuple[str, _Windows]]:
    """Wordings of which a text has enough bigrams close together."""
    places = np.minimum(np.searchsorted(_ALL_CODES, codes), len(_ALL_CODES) - 1)
    hits = np.flatnonzero(_ALL_CODES[places] == codes)
    if not len(hits):
        return []
    which = places[hits]
    held = np.zeros(len(_SIZES), np.int64)
    for at in range(0, len(which), HITS_A_STEP):
        some = which[at:at + HITS_A_STEP]
        lengths = _LISTED[some]
        ends = np.cumsum(lengths)
        held += np.bincount(
            _OF[np.arange(ends[-1]) + np.repeat(_BEGINS[some] - ends + lengths, lengths)], minlength=len(_SIZES))
    found = []
    for at in np.flatnonzero(held >= bounds(_SIZES, threshold)[0]).tolist():
        codes_of, repeats = _OWN[at]
        own = np.minimum(np.searchsorted(codes_of, which), len(codes_of) - 1)
        is_own = codes_of[own] == which
        windows = _Windows(at, hits[is_own], which[is_own], repeats[own[is_own]], threshold)
        if len(windows.starts):
            found.append((_NAMES[at], windows))
    return found


def rank(name: str) -> int:
    """Whole texts before headers before one-line notices: a window inside one of a lower rank is part of it."""
    return 2 if name.endswith("-notice") else 1 if name in HEADERS else 0


def spdx(name: str) -> tuple[str, str]:
    """(SPDX name, kind) of a wording's name; families without a version go by their own name."""
    kind = ("text", "header", "notice")[rank(name)]
    return name.removesuffix("-notice").removesuffix("-text").removesuffix("-header"), kind


def licenses_of(text: str | None, threshold: float = THRESHOLD) -> list[Found]:
    """(licence, start, end, coefficient) of a text, in code points, by start.

    Of windows that overlap, whole texts count before headers and these before one-line notices; then the
    better one counts, and of equal ones the longer one.
    """
    if not text:
        return []
    lower = text.lower()
    words = WORD.findall(lower) if len(lower) == len(text) else [word.lower() for word in WORD.findall(text)]
    places = np.fromiter(map(_PLACES.get, words, itertools.repeat(0)), np.int64, len(words))
    codes = places[:-1] << 16 | places[1:] if len(words) > 1 else np.zeros(0, np.int64)
    candidates = _candidates(codes, threshold)
    if not candidates:
        return []
    # Bigrams that share a word with a kept window are taken; the best window of a start is looked
    # for again if a better one has taken its end.
    taken = np.zeros(len(codes) + 1, bool)
    heap, kept, asked = [], [], set()

    def ask(at: int, start: int) -> None:
        """A start by the best value that it can have; its windows are compared when its turn comes."""
        if (at, start) not in asked:
            asked.add((at, start))
            name, windows = candidates[at]
            heapq.heappush(heap, (rank(name), -float(windows.reach[start]), -len(codes), 0, "", -1, at, start))

    def push(at: int, start: int, limit: int) -> None:
        name, windows = candidates[at]
        best = windows.best(start, limit)
        if best:
            first = int(windows.hits[start])
            heapq.heappush(heap, (rank(name), -best[0], first - best[1], first, name, best[1], at, start))

    for at, (_, windows) in enumerate(candidates):
        for start in windows.starts.tolist():
            ask(at, start)
    while heap:
        _, value, _, first, name, last, at, start = heapq.heappop(heap)
        if last < 0:
            if not taken[candidates[at][1].hits[start]]:
                push(at, start, len(codes))
            continue
        if taken[first]:
            continue
        inside = taken[first:last + 1]
        if inside.any():
            push(at, start, first + int(np.argmax(inside)))
            continue
        taken[max(0, first - 1):last + 2] = True
        kept.append((name, first, last, -value))
        # Starts behind the window had a better one before them, which is taken now.
        for other, (_, windows) in enumerate(candidates):
            start = windows.next_start(last + 2)
            if start is not None:
                windows.reach[start] = 1.0
                ask(other, start)
    spans = [(m.start(), m.end()) for m in WORD.finditer(text if len(lower) != len(text) else lower)]
    return sorted(((name, spans[first][0], spans[last + 1][1], round(value, 6)) for name, first, last, value in kept),
                  key=lambda f: f[1])


def licenses(text: Column) -> Column:
    """Array of (license, kind, start, end, dice): the SPDX name and whether a whole text, a header or a
    one-line notice was found. Null, empty and unlicensed texts have none; whole texts of any length are read,
    and repeated rows each on their own."""
    def scanned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [
            dict(zip(("license", "kind"), spdx(n)), start=s, end=e, dice=d) for n, s, e, d in licenses_of(text)])

    return F.pandas_udf(scanned, "array<struct<license string, kind string, start int, end int, dice double>>")(text)
