"""Slow and plain versions of the operators, to test against."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def substring_dedup(docs: list[tuple[int | None, str | None]], depth: int = 50) -> list[tuple]:
    least: dict[tuple, int] = {}
    for doc, text in docs:
        w = words(text)
        if doc is not None:
            for i in range(len(w) - depth + 1):
                key = tuple(w[i : i + depth])
                least[key] = min(doc, least.get(key, doc))
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        if doc is not None:
            for i in range(len(w) - depth + 1):
                if least[tuple(w[i : i + depth])] < doc:
                    gone.update(range(i, i + depth))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingles(text: str | None, k: int = 5) -> set[tuple]:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_groups(docs: list[tuple[int, str | None]], similarity: float = 0.8) -> dict[int, int]:
    """id -> smallest id of its group, over all pairs that share a shingle; an id stands for all its texts."""
    docs = list(docs)
    of = [d for d, _ in docs]
    sets = [shingles(t) for _, t in docs]
    by: dict[tuple, list[int]] = {}
    for d, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(d)
    parent = {d: d for d in of}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    done = set()
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    n = len(sets[a] & sets[b])
                    if n / (len(sets[a]) + len(sets[b]) - n) >= similarity:
                        x, y = sorted((root(of[a]), root(of[b])))
                        parent[y] = x
    return {d: root(d) for d in of}


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    from collections import Counter

    text = text or ""
    w = words(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    cov: set[int] = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cov |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cov)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts of lengths (index + 1), as (configuration, times).

    Sequences with the same content are one class; placing all pieces of a
    length splits at most one class for each remaining space, so the work
    depends on the number of lengths and not of pieces.
    """
    room: dict[int, list[tuple[dict[int, int], int]]] = {}
    spaces = np.zeros(capacity + 1, bool)
    for length in range(len(counts), 0, -1):
        left = int(counts[length - 1])
        while left:
            fit = np.flatnonzero(spaces[length:])
            if len(fit):
                r = length + int(fit[0])
                content, times = room[r].pop()
                if not room[r]:
                    spaces[r] = False
            else:
                # new sequences take as many of this length as fit
                r, content, times = capacity, {}, -(-left // (capacity // length))
            each = min(r // length, max(1, left // times))
            used = min(times, left // each)
            if used < times:
                if content:
                    room.setdefault(r, []).append((content, times - used))
                    spaces[r] = True
            now = content | {length: content.get(length, 0) + each}
            room.setdefault(r - each * length, []).append((now, used))
            spaces[r - each * length] = r - each * length > 0
            left -= used * each
    return [c for held in room.values() for c in held]


def page_text(page: str) -> str:
    """The visible text of a page by the standard library's parser."""
    from html.parser import HTMLParser

    blocks = "br div p".split()

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "svg"):
                self.hidden += 1
                self.out.append(" ")
            elif tag in blocks and not self.hidden:
                self.out.append("\x00")

        def handle_endtag(self, tag):
            if tag in ("script", "svg"):
                self.hidden -= 1
            elif tag in blocks and not self.hidden:
                self.out.append("\x00")

        def handle_startendtag(self, tag, attrs):
            if tag in blocks and not self.hidden:
                self.out.append("\x00")

        def handle_comment(self, data):
            self.out.append(" ")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    r = Reader()
    r.feed(page)
    r.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(r.out).split("\x00")) if x)
