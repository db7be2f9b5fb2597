"""Replacing many values in one text, one after the other, in near-linear time.

Doing it value by value costs the text's length each time. Here the text is cut into pieces,
an index tells in which pieces each value starts, and a replacement touches a few pieces
only. What a mask spells anew, with what stands next to it, is looked up around the mask.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence

try:
    import ahocorasick
except ImportError:  # the slow way below needs no index
    ahocorasick = None

#: Characters of a piece.
PIECE = 512


class _Pieces:
    """A text in pieces, and for each value the pieces in which it may start."""

    def __init__(self, text: str, values: set[str]):
        self.parts = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        self.index = ahocorasick.Automaton()
        for value in values:
            self.index.add_word(value, value)
        self.index.make_automaton()
        self.longest = max(map(len, values))
        self.starts: dict[str, list[int]] = {}
        for end, value in self.index.iter(text):
            self._note(value, (end + 1 - len(value)) // PIECE)

    def _note(self, value: str, number: int) -> None:
        heap = self.starts.setdefault(value, [])
        if not heap or heap[-1] != number:
            heapq.heappush(heap, number)

    def _after(self, number: int, size: int) -> str:
        """The first ``size`` characters behind a piece."""
        out = ""
        while size > len(out) and number + 1 < len(self.parts):
            number += 1
            out += self.parts[number][: size - len(out)]
        return out

    def find(self, value: str, number: int, start: int = 0) -> int:
        """Where the value next starts inside the piece, or -1; it may end in a later one."""
        part = self.parts[number]
        at = part.find(value, start)
        if at < 0:
            low = max(start, len(part) - len(value) + 1)
            at = (part[low:] + self._after(number, len(value) - 1)).find(value)
            at = low + at if 0 <= at < len(part) - low else -1
        return at

    def put(self, number: int, at: int, value: str, mask: str) -> None:
        """Put the mask in place of the value and note what values that spells."""
        part = self.parts[number]
        over = at + len(value) - len(part)
        self.parts[number] = part[:at] + mask + part[at + len(value) :]
        later = number
        while over > 0:
            later += 1
            cut = min(over, len(self.parts[later]))
            self.parts[later] = self.parts[later][cut:]
            over -= cut
        # What stands before the mask, with the piece that each part of it lies in.
        reach = self.longest - 1
        before = [(number, part[:at][-reach:] if reach else "")]
        size, earlier = len(before[0][1]), number
        while size < reach and earlier:
            earlier -= 1
            before.append((earlier, self.parts[earlier][-(reach - size) :]))
            size += len(before[-1][1])
        rest = self.parts[number][at + len(mask) :][:reach]
        behind = rest + self._after(number, reach - len(rest))
        near = "".join(x for _, x in reversed(before)) + mask + behind
        for end, made in self.index.iter(near):
            start = end + 1 - len(made)
            if start >= size + len(mask):
                continue  # it stood there before
            offset = size
            for piece, x in before:
                offset -= len(x)
                if start >= offset:
                    self._note(made, number if start >= size else piece)
                    break


def _pairs(values: Sequence[str], masks: Sequence[str]) -> list[tuple[str, str]]:
    return [(v, m) for v, m in zip(values, masks) if v and v != m]


def replace_in_order(text: str, values: Sequence[str], masks: Sequence[str]) -> str:
    """For each pair in turn, replace the first occurrence of the value in the text so far."""
    pairs = _pairs(values, masks)
    if len(pairs) < 2 or ahocorasick is None:
        for value, mask in pairs:
            text = text.replace(value, mask, 1)
        return text
    pieces = _Pieces(text, {v for v, _ in pairs})
    for value, mask in pairs:
        heap = pieces.starts.get(value, [])
        while heap:
            at = pieces.find(value, heap[0])
            if at >= 0:
                pieces.put(heap[0], at, value, mask)
                break
            heapq.heappop(heap)
    return "".join(pieces.parts)


def replace_every(text: str, values: Sequence[str], masks: Sequence[str]) -> str:
    """For each pair in turn, replace all occurrences of the value in the text so far."""
    pairs = _pairs(values, masks)
    if len(pairs) < 2 or ahocorasick is None:
        for value, mask in pairs:
            text = text.replace(value, mask)
        return text
    pieces = _Pieces(text, {v for v, _ in pairs})
    for value, mask in pairs:
        for number in sorted(set(pieces.starts.pop(value, []))):
            at = pieces.find(value, number)
            while at >= 0:
                pieces.put(number, at, value, mask)
                at = pieces.find(value, number, at + len(mask))
    return "".join(pieces.parts)


def replace_by_last(text: str, values: Sequence[str], masks: Sequence[str]) -> str:
    """``replace_every`` of the distinct values as they first appear, each by its last mask."""
    last = dict(zip(values, masks))
    return replace_every(text, list(last), list(last.values()))


# --- masking by place --------------------------------------------------------------------------


def settled(spans: Sequence[tuple]) -> list[tuple]:
    """Of the spans (start, end, number, ...) those that stay, by place.

    The longest first, then the lowest number, then the first; whatever overlaps one goes.
    """
    starts: list[int] = []
    kept: list[tuple] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], s[2], s[0])):
        i = bisect_left(starts, span[1])
        if i == 0 or kept[i - 1][1] <= span[0]:
            starts.insert(i, span[0])
            kept.insert(i, span)
    return kept


def _beyond(spans: Sequence[tuple], kept: Sequence[tuple]) -> Iterator[tuple[int, int]]:
    """What the spans hold outside the kept ones."""
    end, k = 0, 0
    for start, stop, *_ in sorted(spans):
        at = max(start, end)
        while at < stop:
            while k < len(kept) and kept[k][1] <= at:
                k += 1
            if k < len(kept) and kept[k][0] <= at:
                at = kept[k][1]
                continue
            cut = min(stop, kept[k][0]) if k < len(kept) else stop
            yield at, cut
            at = cut
        end = max(end, stop)


def mask_spans(text: str | None, matches: Sequence[dict] | None, about: Sequence[tuple]) -> dict | None:
    """The text with the settled detections masked where they stand, and these detections.

    ``matches`` are those of each detector in turn, with the characters since the one before;
    ``about`` has type, method and confidence of each detector.
    """
    if text is None:
        return None
    spans, at, last = [], 0, None
    for m in matches:
        if m["number"] != last:
            at, last = 0, m["number"]
        at += m["gap"]
        if m["value"] is not None:
            spans.append((at, at + len(m["value"]), m["number"], m["value"], m["mask"]))
        at += m["size"]
    kept = settled(spans)
    changes = [(a, b, mask) for a, b, _, _, mask in kept]
    changes += [(a, b, "X" * (b - a)) for a, b in _beyond(spans, kept)]
    out, at = [], 0
    for start, end, mask in sorted(changes):
        out += (text[at:start], mask)
        at = end
    out.append(text[at:])
    found = []
    for start, end, number, value, mask in kept:
        kind, method, confidence = about[number]
        found.append(
            {
                "pii_type": kind, "original_value": value, "masked_value": mask,
                "detection_method": method, "confidence": confidence, "start": start, "end": end,
            }
        )
    return {"masked_text": "".join(out), "detections": found}
