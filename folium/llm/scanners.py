"""Scanners for paired marks, each linear in the text whatever it holds.

They find what a lazy regular expression would find from left to right, but look
for the closing mark by position instead of trying every opening mark to the end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

LINE_END = re.compile(r"[\r\n]")
_RUNS = {c: re.compile(re.escape(c) + "+") for c in "*_~'"}


class Finder:
    """Where a fixed text stands next; what isn't found once is not sought again."""

    def __init__(self, text: str, what: str):
        self.text, self.what, self.none = text, what, False

    def __call__(self, at: int) -> int:
        if self.none:
            return -1
        found = self.text.find(self.what, at)
        self.none = found < 0
        return found


def runs(text: str, char: str) -> list[tuple[int, int, int]]:
    """All runs of a character: start, end and the number of its line."""
    ends = [m.start() for m in LINE_END.finditer(text)]
    return [(m.start(), m.end(), bisect_right(ends, m.start())) for m in _RUNS[char].finditer(text)]


def _space(text: str, at: int) -> bool:
    """Whether a blank stands there, or nothing at all."""
    return at < 0 or at >= len(text) or text[at].isspace()


def emphasis(text: str, char: str, most: int = 3, blocks: bool = True) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of runs of the same length up to ``most`` in one line: opened before, closed after something that is no blank.

    blocks: whether a longer run between them keeps a pair apart. Yields start of
    the opening, its end, start and end of the closing run.
    """
    found = runs(text, char)
    n = len(found)
    closing: list[dict[int, int]] = [{} for _ in range(n)]
    near: dict[int, int] = {}  # length -> the next run that closes
    line = -1
    for i in range(n - 1, -1, -1):
        a, b, own = found[i]
        if own != line:
            near, line = {}, own
        closing[i] = near
        size = b - a
        if blocks or size <= most and not _space(text, a - 1):
            near = dict(near) if near else {}
        if blocks:
            for k in [k for k in near if k < size]:
                del near[k]
        if size <= most and not _space(text, a - 1):
            near[size] = i
    i = 0
    while i < n:
        a, b, _ = found[i]
        j = closing[i].get(b - a) if b - a <= most and not _space(text, b) and text[a - 1 : a] != "\\" else None
        if j is None:
            i += 1
        else:
            yield a, b, found[j][0], found[j][1]
            i = j + 1


def struck(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Texts between two pairs of tildes in one line, without blanks beside them."""
    found = runs(text, "~")
    n = len(found)
    closing = [-1] * n
    for i in range(n - 2, -1, -1):
        a, b, line = found[i + 1]
        if line == found[i][2]:
            closing[i] = i + 1 if b - a >= 2 and not _space(text, a - 1) else closing[i + 1]
    i, at = 0, 0
    while i < n:
        b, j = found[i][1], closing[i]
        if b - max(found[i][0], at) >= 2 and not _space(text, b) and j >= 0:
            at = found[j][0] + 2
            yield b - 2, b, at - 2, at
            i = j
        else:
            i += 1


def quoted(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of runs of two to five apostrophes of the same length in one line, with single ones at most between them."""
    found = [r for r in runs(text, "'") if r[1] - r[0] > 1]
    i = 0
    while i + 1 < len(found):
        (a, b, line), (c, d, other) = found[i], found[i + 1]
        if b - a <= 5 and b - a == d - c and line == other:
            yield a, b, c, d
            i += 2
        else:
            i += 1


_COMMENT = re.compile(r"<!--|<!\[CDATA\[|<!DOCTYPE|<\?xml", re.I)


def comments(text: str) -> Iterator[tuple[int, int]]:
    """Comments, CDATA sections, document types and XML declarations."""
    end = {x: Finder(text, x) for x in ("-->", "]]>", ">")}
    at = 0
    while m := _COMMENT.search(text, at):
        kind = m[0][:3]
        close = "-->" if kind == "<!-" else "]]>" if kind == "<![" else ">"
        e = end[close](m.end())
        if e < 0 or kind == "<?x" and (e == m.end() or text[e - 1] != "?"):
            at = m.end()
        else:
            at = e + len(close)
            yield m.start(), at


def wiki_tables(text: str) -> Iterator[tuple[int, int]]:
    """From {| to a line that begins with |}."""
    begin, end, at = Finder(text, "{|"), Finder(text, "\n|}"), 0
    while (a := begin(at)) >= 0 and (e := end(a + 2)) >= 0:
        at = e + 3
        yield a, at


_BEGIN = re.compile(r"\\begin\{([A-Za-z]+\*?)\}")
_END = re.compile(r"\\end\{([A-Za-z]+\*?)\}")
_GAP = re.compile(r"[ \t]*\r?\n?")


def environments(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """LaTeX environments: name, start, start of the body, its end, end."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _END.finditer(text):
        ends.setdefault(m[1], []).append(m.span())
    close = {"[": Finder(text, "]"), "{": Finder(text, "}")}
    at = 0
    while m := _BEGIN.search(text, at):
        at = m.end()
        own = ends.get(m[1])
        if not own or own[-1][0] < at:
            continue
        p = at
        while (f := close.get(text[p : p + 1])) and (e := f(p + 1)) >= 0 and e + 1 <= own[-1][0]:
            p = e + 1
        p = _GAP.match(text, p).end()
        a, b = own[bisect_left(own, (p, 0))]
        s = a - 1 if a > p and text[a - 1] == "\n" else a
        s = s - 1 if s > p and text[s - 1] == "\r" else s
        yield m[1], m.start(), p, s, b
        at = b


_NAME = re.compile(r"\\([A-Za-z]+)\*?")
_BRACED = re.compile(r"\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}")


def commands(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """LaTeX commands with one argument, braces nested once at most: name, start, start and end of the argument, end."""
    close, line_end = Finder(text, "]"), {c: Finder(text, c) for c in "\r\n"}
    at = 0
    while m := _NAME.search(text, at):
        at = p = m.end()
        if text[p : p + 1] == "[" and (e := close(p)) >= 0 and text[e + 1 : e + 2] == "{" and not any(0 <= f(p) < e for f in line_end.values()):
            p = e + 1
        if b := _BRACED.match(text, p) if text[p : p + 1] == "{" else None:
            yield m[1], m.start(), b.start(1), b.end(1), b.end()
            at = b.end()


_MATH = re.compile(r"\$|\\[\[(]")
_INLINE = re.compile(r"\$(?=[^\s$])([^$\r\n]+)\$(?![\d$])")


def formulas(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """Formulas between $$, $, \\[ \\] and \\( \\): mark, start, start and end of the inner part, end."""
    close = {"$$": Finder(text, "$$"), "\\[": Finder(text, "\\]"), "\\(": Finder(text, "\\)")}
    at = 0
    while m := _MATH.search(text, at):
        a = m.start()
        mark = m[0] if m[0] != "$" else text[a : a + 2]
        at = a + 1
        if mark in close and (e := close[mark](a + 3)) >= 0:
            at = e + 2
            yield mark, a, a + 2, e, at
        elif m[0] == "$" and not (a and (text[a - 1] in "\\$_" or text[a - 1].isalnum())):
            if (b := _INLINE.match(text, a)) and not (text[b.end(1) - 1].isspace() or text[b.end(1) - 1] == "\\"):
                at = b.end()
                yield "$", a, b.start(1), b.end(1), at
