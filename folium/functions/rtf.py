"""Rich text: from RTF to lines of styled runs and plain text, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Destinations without text of their own.
HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object header headerl headerr headerf footer footerl footerr footerf footnote themedata datastore generator listtable listoverridetable rsidtbl xmlnstbl latentstyles fldinst".split())
# Control words that stand for text.
SIGNS = {"par": "\n", "line": "\n", "sect": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": "\u2003", "enspace": "\u2002"}
SPOKEN = HIDDEN | SIGNS.keys() | {"u", "uc"}  # control words that text depends on
ALIGN = {"ql": "Left", "qr": "Right", "qc": "Center", "qj": "Justify"}
TOKEN = re.compile(r"(?P<uni>(?:\\u-?\d+ ?(?:\\'[0-9a-fA-F]{2}|[^\\{}\r\n]))+)|(?P<hex>(?:\\'[0-9a-fA-F]{2})+)|\\(?P<word>[a-zA-Z]+)(?P<num>-?\d+)? ?|\\(?P<sign>[^a-zA-Z])|(?P<brace>[{}])|(?P<raw>[^\\{}]+)", re.S)
ONE_UNI = re.compile(r"\\u(-?\d+) ?(?:\\'[0-9a-fA-F]{2}|[^\\{}\r\n])", re.S)
LONE_UNI = re.compile(r"\\u(-?\d+) ?")
FACE = re.compile(r"\{\\f(\d+)((?:\\[a-z]+-?\d* ?|\\\*)*)([^;{}\\]*);?")
COLOR = re.compile(r"(?:\\red(\d+))?\s*(?:\\green(\d+))?\s*(?:\\blue(\d+))?\s*;")


def is_rtf(text: str | None) -> bool:
    return bool(text) and text.lstrip().startswith("{\\rtf")


def codec_of(rtf: str) -> str:
    """The codec the header names, windows-1252 where it names none that is known."""
    m = re.search(r"\\ansicpg(\d+)", rtf)
    name = f"cp{m[1]}" if m else "cp1252"
    try:
        "".encode("utf-8" if name == "cp65001" else name)
    except LookupError:
        return "cp1252"
    return "utf-8" if name == "cp65001" else name


def fonts_of(rtf: str) -> dict[int, str]:
    at = rtf.find("{\\fonttbl")
    if at < 0:
        return {}
    depth, end = 0, at
    while end < len(rtf):
        depth += (rtf[end] == "{") - (rtf[end] == "}")
        end += 1
        if not depth:
            break
    return {int(n): face.strip() for n, _, face in FACE.findall(rtf[at:end])}


def colors_of(rtf: str) -> list[str | None]:
    m = re.search(r"\{\\colortbl([^}]*)\}", rtf)
    return [None if r == g == b == "" else "%02X%02X%02X" % (int(r or 0), int(g or 0), int(b or 0)) for r, g, b in COLOR.findall(m[1])] if m else []


def _bytes_text(raw: bytes, codec: str) -> str:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in raw) if codec != "utf-8" else raw.decode(codec, "replace")


def _chars(numbers: Iterator[int]) -> str:
    return "".join(chr(n & 0xFFFF) for n in numbers).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


BLANK = {"bold": False, "italic": False, "underline": False, "strike": False, "size": None, "face": None, "color": None}


def pieces(rtf: str, styled: bool = True) -> Iterator[tuple[str, dict, str | None]]:
    """(text, style, alignment) in order; the alignment is the last one set so far. Not styled: the style is always blank, which is faster."""
    codec, fonts, colors = codec_of(rtf), fonts_of(rtf) if styled else {}, colors_of(rtf) if styled else []
    style, hidden, skip, align = dict(BLANK), False, 1, None
    stack: list[tuple] = []
    drop = 0  # characters of a fallback still to be left out
    at, opened, end = 0, False, len(rtf)
    while at < end:
        m = TOKEN.match(rtf, at)
        if m is None:
            at += 1
            continue
        kind, at = m.lastgroup, m.end()
        if kind == "num":
            kind = "word"
        text = ""
        if kind == "brace":
            if m["brace"] == "{":
                stack.append((dict(style) if styled else style, hidden, skip))
                opened = True
                continue
            if stack:
                style, hidden, skip = stack.pop()
        elif kind == "uni":
            if skip == 1:
                text = _chars(int(n) for n in ONE_UNI.findall(m[0]))
            else:  # other fallbacks: one sign at a time
                one = LONE_UNI.match(m[0])
                text, drop, at = _chars(iter([int(one[1])])), skip, m.start() + one.end()
                if not hidden:
                    yield text, dict(style) if styled else style, align
                opened = False
                continue
        elif kind == "hex":
            raw = bytes.fromhex(m["hex"].replace("\\'", ""))
            cut, drop = min(drop, len(raw)), max(0, drop - len(raw))
            text = _bytes_text(raw[cut:], codec)
        elif kind == "raw":
            text = m["raw"].replace("\r", "").replace("\n", "")
            cut, drop = min(drop, len(text)), max(0, drop - len(text))
            text = text[cut:]
        elif kind == "sign":
            if m["sign"] == "*" and opened:
                hidden = True
            text = {"~": "\xa0", "_": "\u2011", "-": "\xad", "\n": "\n", "\r": "\n"}.get(m["sign"], m["sign"] if m["sign"] in "\\{}" else "")
        else:
            word, num = m["word"], m["num"]
            on = num != "0"
            if not styled and word not in SPOKEN:
                pass
            elif word in HIDDEN and opened:
                hidden = True
            elif word in SIGNS:
                text = SIGNS[word]
            elif word == "u" and num:
                text = _chars(iter([int(num)]))
            elif word == "uc":
                skip = int(num or 1)
            elif word == "b":
                style["bold"] = on
            elif word == "i":
                style["italic"] = on
            elif word in ("ul", "ulw", "uld", "uldb"):
                style["underline"] = on
            elif word == "ulnone":
                style["underline"] = False
            elif word == "strike":
                style["strike"] = on
            elif word == "fs" and num:
                style["size"] = int(num) / 2
            elif word == "f" and num:
                style["face"] = fonts.get(int(num))
            elif word == "cf" and num:
                style["color"] = colors[int(num)] if 0 <= int(num) < len(colors) else None
            elif word == "plain":
                style.update(bold=False, italic=False, underline=False, strike=False)
            elif word in ALIGN:
                align = ALIGN[word]
        opened = False
        if text and not hidden:
            yield text, dict(style) if styled else style, align


def rtf_text(rtf: str) -> str:
    """The plain text with line feeds."""
    return "".join([t for t, _, _ in pieces(rtf, False)]).strip()


def rtf_lines(rtf: str, base_size: float = 9.0) -> tuple[list[list[dict]], str | None]:
    """Lines of styled runs without blank lines at the edges, and the first alignment set."""
    lines: list[list[dict]] = [[]]
    first = None
    for text, style, align in pieces(rtf):
        first = first or align
        for k, part in enumerate(text.split("\n")):
            if k:
                lines.append([])
            if part:
                run = style | {"text": part, "size": style["size"] or base_size}
                if lines[-1] and all(lines[-1][-1][x] == run[x] for x in BLANK):
                    lines[-1][-1]["text"] += part
                else:
                    lines[-1].append(run)
    blank = [not "".join(r["text"] for r in line).strip() for line in lines]
    while lines and blank[-1]:
        lines.pop(), blank.pop()
    while lines and blank[0]:
        lines.pop(0), blank.pop(0)
    return lines, first


def rtf_escape(text: str) -> str:
    return "".join("\\" + c if c in "\\{}" else c if c.isascii() else "".join(f"\\u{int.from_bytes(c.encode('utf-16-be')[k : k + 2], 'big', signed=True)}?" for k in range(0, len(c.encode("utf-16-be")), 2)) for c in text)


def lines_rtf(lines: list[list[dict]], align: str | None = None, face: str = "Arial", size: float = 9.0) -> str:
    """RTF of lines of styled runs."""
    faces, colors = [face], []
    for run in (r for line in lines for r in line):
        if run.get("face") and run["face"] not in faces:
            faces.append(run["face"])
        if run.get("color") and run["color"] not in colors:
            colors.append(run["color"])
    head = "{\\rtf1\\ansi\\ansicpg1252\\deff0{\\fonttbl" + "".join(f"{{\\f{k}\\fnil {rtf_escape(f)};}}" for k, f in enumerate(faces)) + "}"
    if colors:
        head += "{\\colortbl;" + "".join(f"\\red{int(c[:2], 16)}\\green{int(c[2:4], 16)}\\blue{int(c[4:], 16)};" for c in colors) + "}"
    code = {v: k for k, v in ALIGN.items()}.get(align or "")
    out = []
    for line in lines:
        body = ""
        for run in line:
            marks = "".join(f"\\{w}" for w, key in (("b", "bold"), ("i", "italic"), ("ul", "underline"), ("strike", "strike")) if run.get(key))
            color = f"\\cf{colors.index(run['color']) + 1}" if run.get("color") else ""
            body += f"{{\\f{faces.index(run.get('face') or face)}\\fs{round((run.get('size') or size) * 2)}{color}{marks} {rtf_escape(run.get('text') or '')}}}"
        out.append("\\pard" + (f"\\{code}" if code else "") + body + "\\par\n")
    return head + "".join(out) + "}"
