"""Problem 2: markup residue in text.

A permissive reader turns each text into a tree of everything that could be HTML,
Markdown, wiki or LaTeX. Gradient-boosted trees judge each node by features of
the node and its place in the tree; a hierarchical decoding over the whole tree
then picks the likeliest choice in which no node contradicts its ancestors. What
was judged to be markup is turned into plain structure, the rest stays as it is.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm import scanners
from folium.llm.boosting import Boosted

# Names that the languages define.
BLOCK = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("a abbr acronym b bdo big br cite code del dfn em font i img input ins kbd label mark nobr q ref s samp small span strike strong sub sup tt u var wbr".split())
VOID = frozenset("br hr img input wbr meta link col".split())
COMMANDS = frozenset("section subsection subsubsection paragraph chapter emph textbf textit texttt textsc underline item begin end ref label cite caption footnote frac sqrt sum int prod alpha beta gamma delta Delta lambda mu pi rho sigma le ge leq geq ne times cdot pm approx infty left right text mathrm mathbf hline centering includegraphics title author date maketitle noindent newline par quad hspace vspace url href".split())
OPAQUE = frozenset("comment fence code math env_math template".split())
STRUCTURAL = {"list": {"item"}, "quote": {"quote_line"}, "env": {"item"}}
KINDS = ("html", "html_open", "html_close", "comment", "entity", "heading", "setext", "list", "item", "quote", "quote_line", "table", "rule", "fence", "code", "strong", "under", "strike", "link", "wiki_heading", "wiki_link", "template", "wiki_table", "wiki_quote", "env", "env_math", "command", "bare", "math", "break", "escape")
KIND_NO = {k: i for i, k in enumerate(KINDS)}

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s[^<>]*)?)(/?)>")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
HEADING = re.compile(r"[ ]{0,3}(#{1,6})[ \t]+(?=\S)")
WIKI_HEADING = re.compile(r"(={2,6})[ \t]*(?=[^=\s])")
SETEXT = re.compile(r"[ ]{0,3}(=+|-+)[ \t]*$")
BULLET = re.compile(r"([ \t]*[-*+][ \t]+(?:\[[ xX]\][ \t]+)?)(\S.*)$")
NUMBERED = re.compile(r"([ \t]*\d{1,3}[.)][ \t]+)(\S.*)$")
QUOTE = re.compile(r"([ ]{0,3}>[ \t]?)(.*)$")
TABLE_RULE = re.compile(r"[ \t]*+\|?+[ \t]*+:?+-++:?+[ \t]*+(?:\|[ \t]*+:?+-++:?+[ \t]*+)*+\|?+[ \t]*+$")
RULE = re.compile(r"[ ]{0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
FENCE = re.compile(r"(^|\n)([ ]{0,3}(`{3,}+|~{3,}+)[^\r\n`]*+\r?\n)(.*?)(\r?\n[ ]{0,3}\3[ \t]*(?=\r|\n|$)|$)", re.S)
CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\r\n]+?)(?<!`)\1(?!`)")
LINK = re.compile(r"(!?\[)([^\[\]\r\n]*)(\]\([^()\s]+(?:[ \t]+[\"'][^\"'\r\n]*[\"'])?\)|\]\[[^\[\]\r\n]*\])")
WIKI_LINK = re.compile(r"(\[\[(?:[^\[\]|\r\n]*\|)*)([^\[\]|\r\n]+)(\]\])")
OUTER_LINK = re.compile(r"(\[(?=[^\[\]\r\n]*+\])(?:https?|ftp|mailto|doc)://?[^\s\[\]]+[ \t]+)([^\[\]\r\n]+)(\])")
TEMPLATE = re.compile(r"\{\{[^{}\r\n]+\}\}")
MATH_ENVS = frozenset("equation equation* align align* displaymath math gather gather* eqnarray multline verbatim lstlisting".split())
ITEM = re.compile(r"\\item(?:\[[^\]]*\])?[ \t]*")
BARE = re.compile(r"\\([A-Za-z]+)\*?")
BREAK = re.compile(r"\\\\(?=[ \t\r\n]|$)")
ESCAPE = re.compile(r"\\[%&$#_{}*\[\]`]")
#: Whatever has none of these has no candidate.
TRIGGER = re.compile(r"[<&*_`~\\$'{}]|\]\(|\[\[|\]\[|(?:^|[\r\n])[ \t]*(?:[-+>|=#*:]|\d{1,3}[.)][ \t])|\[(?:https?|ftp|mailto|doc):")


class Node:
    __slots__ = ("kind", "a", "b", "ia", "ib", "cuts", "name", "attrs", "parent", "children", "depth", "no")

    def __init__(self, kind: str, a: int, b: int, ia: int, ib: int, cuts: list[tuple[int, int, str]], name: str = "", attrs: str = ""):
        self.kind, self.a, self.b, self.ia, self.ib, self.cuts, self.name, self.attrs = kind, a, b, ia, ib, cuts, name, attrs
        self.parent, self.children, self.depth, self.no = None, [], 0, 0


def _tag_text(name: str, closing: bool) -> str:
    if name in ("td", "th"):
        return "\t" if closing else ""
    if name == "li":
        return "" if closing else "\n• "
    return "\n" if name in BLOCK or name == "br" else ""


def _html(text: str, out: list[Node]) -> None:
    for span in scanners.comments(text) if "<" in text else ():
        out.append(Node("comment", *span, *span, [(*span, "")]))
    open_tags: dict[str, list[tuple[int, re.Match]]] = {}
    tags = list(TAG.finditer(text)) if "<" in text else []
    for m in tags:
        closing, name, attrs, own = m[1] == "/", m[2].lower(), m[3], m[4] == "/" or m[3].rstrip().endswith("/")
        cut = (*m.span(), _tag_text(name, closing))
        if closing:
            stack = open_tags.get(name)
            if stack:
                o = stack.pop()[1]
                out.append(Node("html", o.start(), m.end(), o.end(), m.start(), [(*o.span(), _tag_text(name, False)), cut], name, o[3]))
            else:
                out.append(Node("html_close", *m.span(), *m.span(), [cut], name, attrs))
        elif own or name in VOID:
            out.append(Node("html_open", *m.span(), *m.span(), [cut], name, attrs))
        else:
            open_tags.setdefault(name, []).append((len(out), m))
    for stack in open_tags.values():
        for _, m in stack:
            out.append(Node("html_open", *m.span(), *m.span(), [(*m.span(), _tag_text(m[2].lower(), False))], m[2].lower(), m[3]))
    for m in ENTITY.finditer(text) if "&" in text else ():
        out.append(Node("entity", *m.span(), *m.span(), [(*m.span(), html.unescape(m[0]))], m[0][1:]))


def _wiki_end(line: str) -> int:
    """Where the text of a wiki heading ends: before two to six closing signs; 0 if there are none."""
    whole = line.rstrip(" \t")
    closing = min(6, len(whole) - len(whole.rstrip("=")))
    return len(whole[: len(whole) - closing].rstrip(" \t")) if closing > 1 else 0


def _lines(text: str, out: list[Node]) -> None:
    rows = []
    for m in LINE.finditer(text):
        if m.start() == m.end():
            break
        rows.append((m.start(), m.start() + len(m[0].rstrip("\r\n")), m.end()))
    k = 0
    while k < len(rows):
        a, b, end = rows[k]
        line = text[a:b]
        nxt = text[rows[k + 1][0] : rows[k + 1][1]] if k + 1 < len(rows) else ""
        if m := HEADING.match(line):
            stop = max(m.end() + 1, len(line.rstrip(" \t").rstrip("#").rstrip(" \t")))
            out.append(Node("heading", a, b, a + m.end(), a + stop, [(a, a + m.end(), ""), (a + stop, b, "")], m[1]))
        elif (m := WIKI_HEADING.match(line)) and (stop := _wiki_end(line)) > m.end():
            out.append(Node("wiki_heading", a, b, a + m.end(), a + stop, [(a, a + m.end(), ""), (a + stop, b, "")], m[1]))
        elif "|" in line and "|" in nxt and TABLE_RULE.match(nxt):
            last = k + 2
            while last < len(rows) and "|" in text[rows[last][0] : rows[last][1]]:
                last += 1
            cuts = [(rows[k + 1][0], rows[k + 1][2], "")]
            for r in [k, *range(k + 2, last)]:
                ra, rb = rows[r][:2]
                row = text[ra:rb]
                begin, end = ra + len(row) - len(row.lstrip()), ra + len(row.rstrip())
                done = ra
                for i in range(ra, rb):
                    if text[i] != "|" or text[i - 1 : i] == "\\":
                        continue
                    lo, hi = i, i + 1
                    while lo > ra and text[lo - 1] in " \t":
                        lo -= 1
                    while hi < rb and text[hi] in " \t":
                        hi += 1
                    if lo >= done:
                        cuts.append((lo, hi, "" if lo <= begin or hi >= end else "\t"))
                        done = hi
            out.append(Node("table", a, rows[last - 1][1], a, rows[last - 1][1], sorted(cuts)))
            k = last
            continue
        elif nxt and line.strip() and SETEXT.match(nxt) and len(nxt.strip()) >= 3 and not BULLET.match(line):
            na, nb = rows[k + 1][:2]
            out.append(Node("setext", a, nb, a, b, [(b, nb, "")], nxt.strip()[0]))
            k += 2
            continue
        elif RULE.match(line):
            out.append(Node("rule", a, b, a, b, [(a, b, "")], line.strip()[0]))
        else:
            for kind, row_kind, pattern in (("list", "item", BULLET), ("list", "item", NUMBERED), ("quote", "quote_line", QUOTE)):
                if m := pattern.match(line):
                    last, items = k, []
                    while last < len(rows) and (m := pattern.match(text[rows[last][0] : rows[last][1]])):
                        ra, rb = rows[last][:2]
                        mark = m[1].strip()
                        plain = "" if kind == "quote" else "☒ " if mark[-2:-1] in ("x", "X") else "☐ " if mark.endswith("]") else "• " if pattern is BULLET else m[1].lstrip()
                        items.append(Node(row_kind, ra, rb, ra + m.end(1), rb, [(ra, ra + m.end(1), plain)], mark[:1] if not mark[:1].isdigit() else "1", mark[1:].strip() if mark.endswith("]") else ""))
                        last += 1
                    out.append(Node(kind, a, rows[last - 1][1], a, rows[last - 1][1], [], items[0].name))
                    out += items
                    k = last - 1
                    break
        k += 1


def _inline(text: str, out: list[Node]) -> None:
    def pair(kind: str, m: re.Match, left: tuple[int, int], inner: tuple[int, int], right: tuple[int, int], name: str = "", new: tuple[str, str] = ("", "")) -> None:
        out.append(Node(kind, m.start() if kind != "fence" else left[0], m.end(), *inner, [(*left, new[0]), (*right, new[1])], name))

    if "`" in text or "~" in text:
        for m in FENCE.finditer(text):
            pair("fence", m, m.span(2), m.span(4), m.span(5))
        for m in CODE.finditer(text):
            pair("code", m, (m.start(), m.start(2)), m.span(2), (m.end(2), m.end()))
        for a, ia, ib, b in scanners.struck(text):
            out.append(Node("strike", a, b, ia, ib, [(a, ia, ""), (ib, b, "")]))
    if "*" in text:
        for a, ia, ib, b in scanners.emphasis(text, "*"):
            out.append(Node("strong", a, b, ia, ib, [(a, ia, ""), (ib, b, "")], str(ia - a)))
    if "_" in text:
        for a, ia, ib, b in scanners.emphasis(text, "_", blocks=False):
            out.append(Node("under", a, b, ia, ib, [(a, ia, ""), (ib, b, "")], str(ia - a)))
    if "[" in text:
        for m in LINK.finditer(text):
            pair("link", m, m.span(1), m.span(2), m.span(3), "!" if m[1][0] == "!" else "ref" if m[3].startswith("][") else "url")
        for m in WIKI_LINK.finditer(text):
            pair("wiki_link", m, m.span(1), m.span(2), m.span(3))
        for m in OUTER_LINK.finditer(text):
            pair("link", m, m.span(1), m.span(2), m.span(3), "outer")
    if "{" in text:
        for m in TEMPLATE.finditer(text):
            out.append(Node("template", *m.span(), *m.span(), [(*m.span(), ", ".join(p.strip() for p in m[0][2:-2].split("|")))]))
        for a, b in scanners.wiki_tables(text):
            whole = text[a:b]
            cuts = [(a + c.start(), a + c.end(), new) for pattern, new in ((r"^\{\|[^\r\n]*\r?\n", ""), (r"\r?\n\|\}$", "")) for c in re.finditer(pattern, whole)]
            cuts += [(a + c.start(), a + c.end(), "" if c[0].strip() in ("|-",) else "\t" if c[0].strip() in ("!!", "||") else "\n") for c in re.finditer(r"\r?\n\|-[^\r\n]*|(?<![ \t])[ \t]*(?:!!|\|\|)[ \t]*|(?<=\n)[!|](?![-}|!])[ \t]*", whole)]
            out.append(Node("wiki_table", a, b, a, b, cuts))
    if "''" in text:
        for a, ia, ib, b in scanners.quoted(text):
            out.append(Node("wiki_quote", a, b, ia, ib, [(a, ia, ""), (ib, b, "")]))
    if "\\" in text:
        for name, a, ia, ib, b in scanners.environments(text):
            kind = "env_math" if name in MATH_ENVS else "env"
            out.append(Node(kind, a, b, ia, ib, [(a, ia, ""), (ib, b, "")], name))
            if kind == "env":
                marks = list(ITEM.finditer(text, ia, ib))
                for i, c in enumerate(marks):
                    stop = marks[i + 1].start() if i + 1 < len(marks) else ib
                    out.append(Node("item", c.start(), stop, c.end(), stop, [(*c.span(), "• ")], "\\"))
        for name, a, ia, ib, b in scanners.commands(text):
            new = "\n" if name in ("section", "subsection", "subsubsection", "paragraph", "chapter", "title") else ""
            if name not in ("begin", "end"):
                out.append(Node("command", a, b, ia, ib, [(a, ia, new), (ib, b, new)], name))
        for m in BARE.finditer(text):
            if m[1] not in ("begin", "end", "item"):
                out.append(Node("bare", *m.span(), *m.span(), [(*m.span(), "")], m[1]))
        for m in BREAK.finditer(text):
            out.append(Node("break", *m.span(), *m.span(), [(*m.span(), "\n")]))
        for m in ESCAPE.finditer(text):
            out.append(Node("escape", *m.span(), *m.span(), [(*m.span(), m[0][1:])]))
    if "$" in text or "\\" in text:
        for mark, a, ia, ib, b in scanners.formulas(text):
            out.append(Node("math", a, b, ia, ib, [(a, ia, ""), (ib, b, "")], mark))


def tree(text: str) -> list[Node]:
    """Candidates in document order, each inside the inner part of its parent; of crossing ones the longer stays."""
    found: list[Node] = []
    if not TRIGGER.search(text):
        return found
    _html(text, found)
    _lines(text, found)
    _inline(text, found)
    rank = lambda n: (n.a, -n.b, n.kind not in OPAQUE, KIND_NO[n.kind])
    found.sort(key=rank)
    kept: list[Node] = []
    stack: list[Node] = []
    sorted_cuts: dict[int, tuple[list[int], list[int]]] = {}  # starts of a node's cuts, and the furthest end up to each

    def touched(n: Node, top: Node) -> bool:
        if len(top.cuts) < 4:
            return any(c[0] < n.b and n.a < c[1] for c in top.cuts)
        if top.no not in sorted_cuts:
            own = sorted((c[0], c[1]) for c in top.cuts)
            sorted_cuts[top.no] = [c[0] for c in own], list(accumulate((c[1] for c in own), max))
        starts, ends = sorted_cuts[top.no]
        k = bisect_left(starts, n.b)
        return k > 0 and n.a < ends[k - 1]

    for n in found:
        while stack and stack[-1].b <= n.a:
            stack.pop()
        top = stack[-1] if stack else None
        if top is not None and (n.b > top.b or touched(n, top) and not (top.kind == "item" and n.kind == "list")):
            continue  # crosses its parent or touches what the parent cuts away
        n.parent, n.depth = top, len(stack)
        if top is not None:
            top.children.append(n)
        n.no = len(kept)
        kept.append(n)
        stack.append(n)
    return kept


ATTRIBUTES = ("href", "src", "style", "class", "color", "size", "width", "align", "name", "id")
NUMBERS = 34 + len(ATTRIBUTES)
SIGNS = frozenset("\\^_{}=")
LEVELS = frozenset(("heading", "wiki_heading", "setext"))  # their name is the mark, for the level


def features(text: str, nodes: list[Node]) -> np.ndarray:
    """One row of numbers for each node: what it is, its content and attributes, its surroundings, its subtree, depth and siblings."""
    x = np.zeros((len(nodes), NUMBERS), np.float32)
    sizes = [1] * len(nodes)
    cut = [sum(c[1] - c[0] for c in n.cuts) for n in nodes]
    for n in reversed(nodes):
        if n.parent is not None:
            sizes[n.parent.no] += sizes[n.no]
            cut[n.parent.no] += cut[n.no]
    kinds = [0] * len(KINDS)
    for n in nodes:
        kinds[KIND_NO[n.kind]] += 1
    roots = sum(n.parent is None for n in nodes)
    # how many signs of each sort stand before each place
    letters, digits, blanks, ends, signs = (list(accumulate(map(test, text), initial=0)) for test in (str.isalpha, str.isdigit, " ".__eq__, "\n".__eq__, SIGNS.__contains__))
    alike: dict[int, Counter] = {}
    for i, n in enumerate(nodes):
        inner, whole = n.ib - n.ia, n.b - n.a
        before, after = text[n.a - 1 : n.a], text[n.b : n.b + 1]
        siblings = n.parent.children if n.parent else None
        if siblings and n.parent.no not in alike:
            alike[n.parent.no] = Counter(s.kind for s in siblings)
        known = n.name in BLOCK or n.name in INLINE if n.kind in ("html", "html_open", "html_close") else n.name in COMMANDS if n.kind in ("command", "bare") else n.name in html5 or n.name + ";" in html5 or n.name[:1] == "#" if n.kind == "entity" else False
        name = "" if n.kind in LEVELS else n.name
        attrs = n.attrs.lower()
        x[i, :34] = (
            KIND_NO[n.kind], known, whole, inner, (letters[n.ib] - letters[n.ia]) / (inner or 1), (digits[n.ib] - digits[n.ia]) / (inner or 1), blanks[n.ib] - blanks[n.ia], ends[n.b] - ends[n.a],
            before == "" or before in "\r\n", before.isalnum(), before.isspace(), before in ":\\/", before.isdigit(), after == "" or after in "\r\n", after.isalnum(), after.isspace(), after in "\\/.:",
            n.depth, len(siblings) if siblings else roots, alike[n.parent.no][n.kind] if siblings else kinds[KIND_NO[n.kind]], sizes[i], cut[i] / (whole or 1), len(n.children),
            KIND_NO[n.parent.kind] if n.parent else -1, sum(a in attrs for a in ATTRIBUTES), attrs.count("="), len(n.cuts[0][2]) if n.cuts else 0, whole / (len(text) or 1),
            kinds[KIND_NO[n.kind]], len(nodes), ord(name[0]) if name else 0, len(name), signs[n.ib] > signs[n.ia], text[n.a : n.a + 2] == "  ",
        )
        if attrs:
            x[i, 34:] = [a in attrs for a in ATTRIBUTES]
    return x


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest choice for each node that agrees with its ancestors' choices.

    Nothing inside code, formulas, comments and templates is markup; the rows of a
    list, a quotation or an environment are markup exactly if it is.
    """
    n = len(nodes)
    no, yes = np.zeros(n), np.array(odds, float)
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        for child in node.children:
            c = child.no
            tied = child.kind in STRUCTURAL.get(node.kind, ())
            best = max(no[c], yes[c])
            no[k] += no[c] if tied else best
            yes[k] += no[c] if node.kind in OPAQUE else yes[c] if tied else best
    chosen = np.zeros(n, bool)
    shut = np.zeros(n, bool)  # inside something opaque
    for k, node in enumerate(nodes):
        p = node.parent
        if p is not None and (shut[p.no] or chosen[p.no] and p.kind in OPAQUE):
            shut[k] = True
        elif p is not None and node.kind in STRUCTURAL.get(p.kind, ()):
            chosen[k] = chosen[p.no]
        else:
            chosen[k] = yes[k] > no[k]
    return chosen


#: What a chosen node stands for in the report of structure.
ROLE = {"heading": "heading", "setext": "heading", "wiki_heading": "heading", "item": "list item", "table": "table", "wiki_table": "table", "fence": "code", "code": "code", "math": "formula", "env_math": "formula", "quote": "quotation", "link": "link", "wiki_link": "link"}
TAG_ROLE = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "list item", "table": "table", "pre": "code", "code": "code", "a": "link", "blockquote": "quotation"}


SECTIONS = ("chapter", "section", "subsection", "subsubsection")
HREF = re.compile(r"\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def detail(text: str, n: Node, role: str) -> str | None:
    """What the markup said beside the text: the level of a heading, the target of a link, the language of code."""
    if role == "heading":
        if n.kind == "html":
            return n.name[1:]
        if n.kind == "setext":
            return "1" if n.name == "=" else "2"
        return str(SECTIONS.index(n.name) if n.name in SECTIONS else len(n.name)) if n.kind in ("command", *LEVELS) else None
    if role == "link":
        if n.kind == "html":
            m = HREF.search(n.attrs)
            return next((g for g in m.groups() if g is not None), None) if m else None
        left, right = text[n.a : n.ia], text[n.ib : n.b]
        if n.kind == "wiki_link":
            return left.strip("[|").split("|")[0].strip() or text[n.ia : n.ib]
        return left[1:].strip() if n.name == "outer" else right[2:-1].split(" ")[0].strip() or None
    if role == "code" and n.kind == "fence":
        return text[n.a : n.ia].strip(" `~\r\n\t") or None
    return None


def cleaned(text: str, nodes: list[Node], chosen: np.ndarray) -> tuple[str, list[tuple[str, int, int, str | None]]]:
    """The text without the chosen markup, and its structure: (role, start, end, detail), places in the clean text."""
    cuts = sorted(c for n in nodes if chosen[n.no] for c in n.cuts if c[0] < c[1] or c[2])
    out, at, size, marks = [], 0, 0, [(0, 0)]
    for a, b, new in cuts:
        if a < at:
            continue
        out += [text[at:a], new]
        size += a - at + len(new)
        at = b
        marks.append((b, size))
    out.append(text[at:])
    places = [m[0] for m in marks]

    def moved(p: int) -> int:
        k = bisect_right(places, p) - 1
        return min(marks[k][1] + p - marks[k][0], marks[k + 1][1] if k + 1 < len(marks) else size + len(text) - at)

    roles = []
    for n in nodes:
        if chosen[n.no]:
            role = TAG_ROLE.get(n.name) if n.kind == "html" else "heading" if n.kind == "command" and n.name.endswith("section") else ROLE.get(n.kind)
            if role:
                roles.append((role, moved(n.ia), moved(n.ib), detail(text, n, role)))
    return "".join(out), roles


# --- the labelled sample -------------------------------------------------------------------------------------------


def sample(rows: int, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """Labelled texts made from a rule: markup of all four languages and signs in their ordinary sense, among invented words.

    Yields the text and the spans of its parts with whether they are markup.
    """
    rng = np.random.default_rng(seed)
    vowels, consonants = ("aeiou", "bcdfgklmnprstvz"), ("аеиоуыя", "бвгдзклмнпрстчш")

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def number(top: int = 900) -> str:
        return str(int(rng.integers(1, top)))

    def word() -> str:
        v, c = vowels if rng.random() < 0.5 else consonants
        w = "".join(pick(*c) + pick(*v) for _ in range(int(rng.integers(1, 5))))
        return w.upper() if rng.random() < 0.1 else w.title() if rng.random() < 0.3 else w

    def words(low: int = 1, high: int = 8) -> str:
        return " ".join(word() for _ in range(int(rng.integers(low, high))))

    def field() -> str:
        return f"[{pick('data', 'form', 'user', 'page')}.{word().title()}]"

    def content() -> str:
        return pick(words(1, 3), words(1, 6), f"{words(1, 3)} {field()}", words(1, 3) + " " + number())

    nl = lambda: pick("\n", "\r\n")

    def formula() -> str:
        return pick(f"\\frac{{{number()}}}{{{number()}}}", f"x_{{{number(9)}}}^2 + y^{{{number(9)}}}", f"\\sqrt{{{number()} a}}", f"m = \\rho V / {number()}", f"\\sum_{{i=1}}^{{{number()}}} q_i", f"\\Delta t \\le {number()}", f"a_{number(9)} = b^2", f"E = mc^{number(9)}", "\\alpha + \\beta")

    def markup() -> str:
        t, n = pick("b", "i", "u", "em", "strong", "s", "sub", "sup", "span", "code", "small", "del", "B", "I", "EM"), nl()
        k = int(rng.integers(34))
        if k == 0:
            return f"<{t}>{content()}</{t}>"
        if k == 1:
            return pick(f"<{t}>{content()}", f"{content()}</{t}>", f"<span class={word()}>{content()}", f"<{t}>{words(8, 20)}</{t}>")
        if k == 2:
            return f'<font {pick("color", "size", "face")}="{pick("Maroon", "#A03010", "0, 96, 64", number())}" size={number(30)}>{content()}</font>'
        if k == 3:
            return content() + pick("<br>", "<br/>", "<BR />", "<hr>", "<br />") + content()
        if k == 4:
            return pick(f"<div>{words(3, 12)}<a href=\"{word()}://{word()}/{number()}\">{content()}</a></div>", f"<p style='margin:0'>{words(3, 12)}</p>", f"<h{number(6)}>{content()}</h{number(6)}>", f"<h3>{content()}</h3><p style='margin:0'>{words(3, 12)}</p>", f"<p class=\"{word()}\">{words(2, 9)}</p>")
        if k == 5:
            return f"<table><tr><th>{content()}</th><th>{content()}</th></tr><tr><td>{field()}</td><td>{number()}</td></tr></table>"
        if k == 6:
            return pick(f"<ul>{n}<li>{content()}</li>{n}<li>{content()}</li>{n}</ul>", f"<ol><li>{content()}</li><li>{content()}</li></ol>")
        if k == 7:
            return pick(f"<!-- {words(1, 4)} {number()} -->", f"<pre><code>{word()} {field()}{n}if n &lt; {number()}</code></pre>", f"<!-- {words(1, 3)} -->{words(3, 9)}<pre>{content()}</pre>")
        if k in (8, 9):
            return pick(f"&laquo;{content()}&raquo;", f"{word()}&nbsp;{word()}", f"&#8470;&#160;{number()}", f"&lt;b&gt;{field()}&lt;/b&gt;", f"{word()} &amp; {word()}", f"&quot;{word()}&quot;", f"{number()}&#x20AC;", f"{word()}&mdash;{word()}")
        if k == 10:
            return "\n" + "#" * int(rng.integers(1, 7)) + f" {content()}{n}"
        if k == 11:
            return f"\n{content()}{n}{pick('=', '-') * int(rng.integers(3, 14))}{n}"
        if k in (12, 13):
            mark = pick("-", "*", "+", "- [ ]", "- [x]")
            return "\n" + "".join(f"{mark} {content()}{n}" for _ in range(int(rng.integers(2, 5))))
        if k == 14:
            return "\n" + "".join(f"{j}. {content()}{n}" for j in range(1, int(rng.integers(3, 6))))
        if k == 15:
            return "\n" + "".join(f"> {words(3, 10)}{n}" for _ in range(int(rng.integers(1, 4))))
        if k == 16:
            return f"\n| {content()} | {content()} |{n}|---|:--:|{n}| {field()} | {number()} |{n}"
        if k == 17:
            return f"\n```{pick('', 'sql', 'text')}{n}{word()} = {field()} * {number()}{n}```{n}"
        if k == 18:
            return f"`{pick(word(), words(1, 3), field(), number())}`"
        if k in (19, 20):
            d = pick("*", "**", "***", "_", "__", "___", "~~")
            return f"{d}{pick(word(), words(2, 4), content(), number(), f'{number()} {number()},{number(99)}')}{d}"
        if k == 21:
            return pick(f"[{content()}]({word()}://{word()}/{number()})", f"![{content()}]({word()}/{number()}.png)", f"[{words(1, 3)}](https://{word()}.net)").replace("[[", "[")
        if k == 22:
            return f"\n== {words(1, 4)} =={n}"
        if k == 23:
            return pick(f"[[{words(1, 3)}|{words(1, 3)}]]", f"[[{words(1, 3)}]]", f"<ref>{content()}</ref>\n* [[{words(1, 3)}]]")
        if k == 24:
            return pick(f"{{{{{word()}|{word()}={number()}|{word()}={word()}}}}}", f"{{{{{word()}}}}}")
        if k == 25:
            return f'\n{{| class="{word()}"{n}! {words(1, 3)} !! {words(1, 3)}{n}|-{n}| {number()} || {number()}{n}|}}{n}'
        if k == 26:
            return pick(f"''{words(1, 4)}''", f"'''{words(1, 4)}'''")
        if k == 27:
            return f"\\{pick('section', 'subsection', 'emph', 'textbf', 'textit', 'underline', 'texttt', 'footnote')}{{{content()}}}"
        if k == 28:
            return f"\\begin{{itemize}}{n}" + "".join(f"\\item {content()}{n}" for _ in range(int(rng.integers(1, 4)))) + "\\end{itemize}"
        if k == 29:
            return f"\\begin{{equation}}{n}{formula()}{n}\\end{{equation}}"
        if k in (30, 31):
            return pick(f"${formula()}$", f"\\[ {formula()} \\]", f"$${formula()}$$", f"\\( {formula()} \\)")
        if k == 32:
            return f"{words(1, 3)} \\\\ {words(1, 3)}~\\ref{{{word()}:{number()}}}"
        return pick(f"{number()} m<sup>2</sup>", f"CO<sub>2</sub>", f"<u>{word()}</u>", f"<i>{words(2, 5)}</i>")

    def ordinary() -> str:
        k = int(rng.integers(25))
        if k == 0:
            return f"[IIf({field()} < {number()}, \"{word()}\", \"{word()}\")]"
        if k == 1:
            return f"<{number()}> {number()}"
        if k == 2:
            return pick(f"{number()} < x, y > {number()}", f"a < {word()} and {word()} > b", f"x<{number()} y>{number()}")
        if k in (3, 4):
            return pick("C", "D", "Z") + ":" + "".join("\\" + pick(word().lower(), "blank", "item", "text", "date", "title", "section", word().lower() + "_" + number()) for _ in range(int(rng.integers(1, 5)))) + pick("", "\\sheet_a.frx", ".txt", "\\")
        if k == 5:
            return pick("____________ / ____________ /", "______________", "«___» __________ 20__", "____ x ____", "_____ / _____", "_" * int(rng.integers(3, 30)))
        if k == 6:
            return pick(f"{words(1, 3)} | {number()}", f"| {words(1, 2)} | {words(1, 2)} |")
        if k == 7:
            return pick(f"{words(1, 3)} -> {words(1, 3)}", f"=> {words(1, 3)}", "<- " + word())
        if k == 8:
            return pick(f"{words(1, 2)}* ({number()})", f"* {words(2, 6)}", f"{word()}** {word()}", f"*) {words(2, 5)}", f"{words(1, 3)}*, {words(1, 3)}*", f"{word()}* {word()} {word()}*")
        if k == 9:
            return pick(f"{number()} * {number()} * {number()}", f"{word()} = {number()} * {number()} * {number()}", f"{number()}*{number()}*{number()}", f"{number()} x {number()}")
        if k == 10:
            return pick(f"{word()}_{number()}_{word()}", f"{word()},_{number()}_{word()}", f"{word()}_{word()}_{word()}_{number()}", f"_{number()}")
        if k == 11:
            return pick(f"${number()} – ${number()}", f"${number()}, {word()} ${number()}", f"{number()}$ {word()} {number()}$", f"US${number()} / US${number()}", f"${number()}.{number()}")
        if k == 12:
            return pick(f"{words(1, 3)} & {words(1, 3)}", f"{word()} & Co; {word()}", "R&D; " + word())
        if k == 13:
            return pick(f"{{{number()}}} {word()}", f"{{{word()}}}", f"{{{number()}; {number()}}}")
        if k == 14:
            return pick(f"#{number()}", f"# {number()}", f"{word()} #{number()}", f"#{number()} {word()}")
        if k == 15:
            return pick(f"~{number()} %", f"~ {number()}", f"{number()}~{number()}", f"~{number()} {word()} ~{number()}")
        if k in (16, 17):
            return pick(f"{number(9)}.{number(9)}. {words(3, 12)}", f"\n{number(9)}.{number(9)}. {words(3, 9)}", f"{number(30)}. {words(3, 9)}", f"{number(9)}) {words(2, 6)}", f"§ {number()}")
        if k == 18:
            return pick(f"- {words(2, 5)}", f"– {words(2, 5)}", f"{word()} - {word()} - {word()}", f"-{number()}", f"+{number()} {number()}", f"+ {number()}", f"- {number()}", f"= {number()}")
        if k == 19:
            return pick(f"[{number()}] {word()}", f"[{word()}] ({word()})", f"[{number()}][{number()}]", f"{field()} ({word()})", f"{field()}, {field()}", f"{field()}{field()}")
        if k == 20:
            return pick(f"“{word()}” ‘{word()}’", f"''{number()}", f"{number()}' {number()}''", f"{number()}''", f"{word()}'s {word()}s'")
        if k == 21:
            return pick(f"> {number()}", f">= {number()}", f"{word()} > {word()}", f"> {number()} mm")
        if k == 22:
            return pick("==", f"{word()} == {word()}", f"{word()} = {word()}", "----", "-----------", "===", "***", "* * *")
        if k == 23:
            return pick(f"<{word().lower()}@{word().lower()}.net>", f"<{words(2, 4)}>", f"<{word()}>", f"\\\\{word().lower()}\\{word().lower()}", f"{word()}\\{word()}")
        return content()

    for _ in range(rows):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            kind = rng.random()
            part = markup() if kind < 0.45 else ordinary() if kind < 0.85 else words(2, 12)
            glue = pick(" ", " ", " ", pick("\n", "\r\n", ", ", ". ")) if text else ""
            if part.startswith("\n"):
                glue, part = "\n" if text else "", part[1:]
            text += glue
            spans.append((len(text), len(text) + len(part), kind < 0.45))
            text += part
            if part.endswith("\n"):
                text += "" if rng.random() < 0.5 else words(2, 8)
        yield text, spans


_MODEL: dict[tuple, Boosted] = {}


def model(rows: int = 6000, seed: int = 7, trees: int = 60, depth: int = 5) -> Boosted:
    """The classifier of nodes, fitted on a sample of ``rows`` labelled texts (the bound of the sample)."""
    key = (rows, seed, trees, depth)
    if key not in _MODEL:
        xs, ys = [], []
        for text, spans in sample(rows, seed):
            nodes = tree(text)
            if nodes:
                xs.append(features(text, nodes))
                for n in nodes:
                    inside = n.parent is not None and (n.parent.kind in OPAQUE and ys[n.parent.no - n.no] or shut[n.parent.no]) if n.no else False
                    shut = [*shut, inside] if n.no else [False]
                    ys.append(not inside and any(a <= (n.ia if n.kind in ("list", "quote") else n.a) < b and yes for a, b, yes in spans))
        _MODEL[key] = Boosted.fit(np.concatenate(xs), np.array(ys, float), trees, depth)
    return _MODEL[key]


OUT = "doc_id string, node_id int, clean string, structure array<struct<role: string, start: int, end: int, detail: string>>, n_markup int, text string"
ROLES = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detail", pa.string())]))


def judge(texts: list[str], boosted: Boosted) -> Iterator[tuple[list[Node], np.ndarray] | None]:
    """Tree and choices of each text, None where there are no candidates; all nodes are scored at once."""
    trees = [tree(t) if t else [] for t in texts]
    rows = [features(t, n) for t, n in zip(texts, trees) if n]
    odds = boosted.odds(np.concatenate(rows)) if rows else np.empty(0)
    at = 0
    for nodes in trees:
        if nodes:
            yield nodes, decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
        else:
            yield None


def strip_markup(df: DataFrame, boosted: Boosted | None = None) -> DataFrame:
    """The rows of df that hold markup, as clean text with their structure.

    df: doc_id, node_id, text. Output: doc_id, node_id, clean (headings and cells on
    their own, list items after a bullet, code and formulas as written), structure
    (role, start and end in clean, detail: level of a heading, target of a link,
    language of code), n_markup (constructs), text. Null and empty texts
    and texts without markup give no rows; repeated rows count once.
    """
    shared = df.sparkSession.sparkContext.broadcast(boosted or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = batch.column(2).to_pylist()
                keep, clean, roles, count = [], [], [], []
                for k, (text, found) in enumerate(zip(texts, judge(texts, shared.value))):
                    if found is not None and found[1].any():
                        plain, structure = cleaned(text, *found)
                        keep.append(k)
                        clean.append(plain)
                        roles.append([{"role": r, "start": a, "end": b, "detail": d} for r, a, b, d in structure])
                        count.append(int(found[1].sum()))
                if keep:
                    kept = batch.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(clean, pa.string()), pa.array(roles, ROLES), pa.array(count, pa.int32()), kept.column(2)], names=["doc_id", "node_id", "clean", "structure", "n_markup", "text"])

    rows = df.select("doc_id", F.col("node_id").cast("int").alias("node_id"), "text").where("text <> ''")
    return rows.mapInArrow(run, OUT).dropDuplicates(["doc_id", "node_id"])
