"""Many phrases with wildcards in one pass over a text.

`*` stands for any characters of a line, `?` for one of them, and a phrase with " and " needs each of its parts, anywhere. Case doesn't
matter. Each part is cut at its stars into segments; of each segment the longest piece without `?` goes into one
automaton, and what stands around a hit of that piece is compared on the spot. So the time for a text doesn't grow with
the number of phrases, only with their hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import ahocorasick


def parts_of(phrase: str) -> list[str]:
    parts = re.split(r"\s+and\s+", phrase) if " and " in phrase.lower() else [phrase]
    return [p.strip() for p in parts]


def pattern(part: str) -> str:
    """The part as a regular expression, which is what it means."""
    return re.escape(part).replace(r"\*", ".*").replace(r"\?", ".")


class PhraseMatcher:
    """Which of ``phrases`` a text contains: found(text) gives their numbers, in order."""

    def __init__(self, phrases: tuple[str, ...]):
        self.parts: dict[str, int] = {}
        self.needs = [[self.parts.setdefault(p.lower(), len(self.parts)) for p in parts_of(phrase)] for phrase in phrases]
        self.segments: dict[str, int] = {}
        self.of_part: list[list[int] | re.Pattern] = []
        anchors = defaultdict(list)
        for part in self.parts:
            segments = [s for s in part.split("*") if s]
            if any(not s.strip("?") for s in segments):  # nothing to look for
                self.of_part.append(re.compile(pattern(part), re.IGNORECASE))
                continue
            numbers = []
            for s in segments:
                if s not in self.segments:
                    self.segments[s] = len(self.segments)
                    anchor = max(s.split("?"), key=len)
                    anchors[anchor].append((self.segments[s], s, s.index(anchor)))
                numbers.append(self.segments[s])
            self.of_part.append(numbers)
        self.automaton = ahocorasick.Automaton()
        for anchor, uses in anchors.items():
            self.automaton.add_word(anchor, (len(anchor), uses))
        self.automaton.make_automaton()
        #: Segments whose places are needed: those of parts with several.
        self.placed = {n for numbers in self.of_part if isinstance(numbers, list) and len(numbers) > 1 for n in numbers}
        self.lengths = {n: len(s) for s, n in self.segments.items()}
        #: Parts by their first segment and phrases by their first part, so that only those are looked at that have it.
        self.begun, self.asked, self.always = defaultdict(list), defaultdict(list), []
        for part, numbers in enumerate(self.of_part):
            (self.begun[numbers[0]] if isinstance(numbers, list) and numbers else self.always).append(part)
        for i, needed in enumerate(self.needs):
            self.asked[needed[0]].append((i, needed[1:]))

    def found(self, text: str | None) -> list[int]:
        low = (text or "").lower()
        places: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(low) if len(self.automaton) else ():
            for number, segment, offset in uses:
                if number in places and number not in self.placed:
                    continue
                start = end + 1 - size - offset
                if start >= 0 and (size == len(segment) or _fits(low, start, segment)):
                    places.setdefault(number, []).append(start)
        parts = {part for number in places for part in self.begun.get(number, ()) if self._holds(part, low, places)}
        parts.update(part for part in self.always if self._holds(part, low, places))
        return sorted(i for part in parts for i, others in self.asked.get(part, ()) if parts.issuperset(others))

    def _holds(self, part: int, low: str, places: dict[int, list[int]]) -> bool:
        numbers = self.of_part[part]
        if isinstance(numbers, re.Pattern):
            return numbers.search(low) is not None
        if any(n not in places for n in numbers):
            return False
        if len(numbers) < 2:
            return True
        line_end = -1
        for start in sorted(places[numbers[0]]):
            if start <= line_end:  # an earlier start in this line has failed already
                continue
            at, line_end = start + self.lengths[numbers[0]], low.find("\n", start)
            line_end = len(low) if line_end < 0 else line_end
            for n in numbers[1:]:
                after = sorted(places[n])
                i = bisect_left(after, at)
                at = after[i] + self.lengths[n] if i < len(after) else len(low) + 1
                if at > line_end:
                    break
            else:
                return True
        return False


def _fits(text: str, start: int, segment: str) -> bool:
    there = text[start : start + len(segment)]
    return len(there) == len(segment) and all(c == d or (c == "?" and d != "\n") for c, d in zip(segment, there))


@lru_cache(maxsize=4)
def matcher(phrases: tuple[str, ...]) -> PhraseMatcher:
    """Built once in each Python worker."""
    return PhraseMatcher(phrases)
