"""License scans by patience alignment.

A place of a template of n words is sought from every word of a text that is one of the
template's first words, those of which one must be aligned first if enough are aligned: the 2n
words from there are aligned with the template.  In such a window the words that occur once in
it and once in the template are anchors; the longest increasing subsequence of the anchors'
places is kept, and the gaps between kept anchors are aligned in the same way.  A gap without
anchors is aligned from its ends, word by word.  Coverage is the share of the template's words
that are aligned.  Of overlapping places of a template the one of the best coverage stays, then
the shortest, then the first.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEMPLATES
from .rows import pick

COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def tokens(text: str | None) -> list[str]:
    """Words in lower case, without the punctuation around them."""
    return _WORD.findall(text.lower()) if text else []


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (ascending in the first) that ascends in the second."""
    tops, piles, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of aligned equal words, ascending in both."""
    found, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        for (i, j), (i1, j1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            stack.append((i + 1, i1, j + 1, j1))
    return sorted(found)


def needed(n: int, coverage: float) -> int:
    """Words of a template of ``n`` that must be aligned."""
    return max(1, math.ceil(coverage * n - 1e-9))


def apart(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of places (aligned words, first, last) those that stay, in the order of the text."""
    out = []
    for place in sorted(set(places), key=lambda p: (-p[0], p[2] - p[1], p[1])):
        at = bisect_left(out, place[1], key=lambda p: p[1])
        if (at == 0 or out[at - 1][2] < place[1]) and (at == len(out) or out[at][1] > place[2]):
            out.insert(at, place)
    return out


@dataclass
class Scanner:
    templates: dict[str, str]
    coverage: float = COVERAGE
    parts: list = field(default_factory=list)

    def __post_init__(self):
        for name, text in sorted(self.templates.items()):
            if words := tokens(text):
                least = needed(len(words), self.coverage)
                self.parts.append((name, words, Counter(words), least, set(words[: len(words) - least + 1])))

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, str]]:
        """(license, coverage, first word, words, span) of each template's places."""
        if not text:
            return []
        lowered = text.lower()
        spans = [m.span() for m in _WORD.finditer(lowered)]
        words = [lowered[a:b] for a, b in spans]
        have, out = set(words), []
        source = text if len(lowered) == len(text) else lowered
        for name, template, counts, least, first in self.parts:
            if sum(c for w, c in counts.items() if w in have) < least:
                continue  # no place can be covered enough
            n = len(template)
            inside, common, end, begun, places = Counter(), 0, 0, 0, []
            for at in (i for i, w in enumerate(words) if w in first):
                # the words of the template among those of the window, kept up from window to window
                while end < min(len(words), at + 2 * n):
                    if (w := words[end]) in counts:
                        inside[w] += 1
                        common += inside[w] <= counts[w]
                    end += 1
                while begun < at:
                    if (w := words[begun]) in counts:
                        common -= inside[w] <= counts[w]
                        inside[w] -= 1
                    begun += 1
                if common >= least and len(matched := align(words[at : at + 2 * n], template)) >= least:
                    places.append((len(matched), at + matched[0][0], at + matched[-1][0]))
            out += [(name, k / n, a, b - a + 1, source[spans[a][0] : spans[b][1]]) for k, a, b in apart(places)]
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, n_words, span): a row for each row of ``docs``
    and each place of a template that it covers by ``coverage`` or more; places of one template
    don't overlap and span at most twice its words.

    A null or empty text has no license.  Repeated rows get rows each; a null doc_id stays null.
    Templates without words match nothing.  An empty table gives an empty table.  Other columns
    are not read.  The templates are a parameter of bounded size and are sent with the tasks.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in scanner.scan(t.as_py())]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()), strict=True)],
                names=["doc_id", "license", "coverage", "first_word", "n_words", "span"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, license string, coverage double, first_word int, n_words int, span string")
