"""Texts that a PDF's content streams show, with the codes of each font read through its map to Unicode.

Objects stand in the file or in compressed object streams. A page names its fonts in its resources or a parent's; a font's
map gives ranges of codes, kept as intervals by code length and looked up by bisection.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"/([^\s/<>\[\]()]+)|\(((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*)\)|<([0-9A-Fa-f\s]*)>|([\[\]])|([A-Za-z'\"*]+)|[-+.\d]+|<<|>>", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_CONTROL = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _inflated(body: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(body)
    except zlib.error:
        return body


def _unescaped(raw: bytes) -> bytes:
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else _CONTROL.get(m[1], m[1]), raw)


class CodeMap:
    """Codes of a font and the text that each stands for; a code of no interval shows nothing."""

    def __init__(self, source: bytes):
        self.lengths: set[int] = set()
        found: dict[int, list[tuple[int, int, list[str] | str]]] = {}
        for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", source, re.S):
            self.lengths |= {len(re.sub(rb"\s", b"", h)) // 2 for h in re.findall(rb"<([0-9A-Fa-f\s]+)>", block)}
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", source, re.S):
            for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]*)>", block):
                found.setdefault(len(code) // 2, []).append((int(code, 16), int(code, 16), self._text(text)))
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", source, re.S):
            for low, high, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f\s]*)>|\[(.*?)\])", block, re.S):
                to = [self._text(t) for t in re.findall(rb"<([0-9A-Fa-f\s]*)>", many)] if many else self._text(one)
                found.setdefault(len(low) // 2, []).append((int(low, 16), int(high, 16), to))
        self.lengths |= set(found)
        self.tables = {n: sorted(rows, key=lambda r: r[0]) for n, rows in found.items()}
        self.lows = {n: [r[0] for r in rows] for n, rows in self.tables.items()}

    @staticmethod
    def _text(digits: bytes) -> str:
        return bytes.fromhex(digits.decode()).decode("utf-16-be", "replace")

    def _one(self, length: int, code: int) -> str | None:
        at = bisect_right(self.lows.get(length, []), code) - 1
        if at < 0 or code > self.tables[length][at][1]:
            return None
        low, _, to = self.tables[length][at]
        if isinstance(to, list):
            return to[code - low] if code - low < len(to) else None
        return to[:-1] + chr(ord(to[-1]) + code - low) if to else ""

    def decode(self, raw: bytes) -> str:
        out, at = [], 0
        lengths = sorted(self.lengths) or [1]
        while at < len(raw):
            for n in lengths:
                text = self._one(n, int.from_bytes(raw[at : at + n])) if at + n <= len(raw) else None
                if text is not None:
                    out.append(text)
                    at += n
                    break
            else:
                at += lengths[-1]
        return "".join(out)


class _File:
    def __init__(self, raw: bytes):
        self.objects: dict[int, bytes] = {}
        for m in _OBJECT.finditer(raw):
            self.objects[int(m[1])] = m[2]
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400] and (s := _STREAM.search(body)):
                data, first = _inflated(s[1]), int((re.search(rb"/First\s+(\d+)", body) or [0, b"0"])[1])
                head = [int(x) for x in data[:first].split()]
                ends = [*head[3::2], len(data) - first]
                for number, start, end in zip(head[::2], head[1::2], ends, strict=False):
                    self.objects.setdefault(number, data[first + start : first + end])
        self.maps: dict[int, CodeMap | None] = {}

    def refs(self, body: bytes, name: bytes) -> list[int]:
        m = re.search(rb"/" + name + rb"\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
        return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1] or m[2] or b"")] if m else []

    def _dictionary(self, body: bytes, name: bytes) -> bytes:
        """What stands between << and >> behind a name, or in the object that it refers to."""
        m = re.search(rb"/" + name + rb"\s*(<<|(\d+)\s+\d+\s+R)", body)
        if not m:
            return b""
        if m[2]:
            return self.objects.get(int(m[2]), b"")
        depth = 0
        for t in re.finditer(rb"<<|>>", body[m.start(1) :]):
            depth += 1 if t[0] == b"<<" else -1
            if not depth:
                return body[m.start(1) : m.start(1) + t.end()]
        return body[m.start(1) :]

    def fonts(self, page: bytes) -> dict[bytes, CodeMap | None]:
        for _ in range(50):  # a page's parents; a file may be broken into a ring
            if resources := self._dictionary(page, b"Resources"):
                named = re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self._dictionary(resources, b"Font"))
                return {name: self._map(int(number)) for name, number in named}
            parent = self.refs(page, b"Parent")
            if not parent or parent[0] not in self.objects:
                break
            page = self.objects[parent[0]]
        return {}

    def _map(self, font: int) -> CodeMap | None:
        if font not in self.maps:
            to = self.refs(self.objects.get(font, b""), b"ToUnicode")
            s = _STREAM.search(self.objects.get(to[0], b"")) if to else None
            self.maps[font] = CodeMap(_inflated(s[1])) if s else None
        return self.maps[font]


def _shown(body: bytes, fonts: dict[bytes, CodeMap | None]) -> str:
    """Strings in the order in which they are shown, a blank between operators; the parts of one array belong together."""
    out: list[str] = []
    font, name, held, inside = None, b"", [], False
    for m in _TOKEN.finditer(body):
        if m[1] is not None:
            name = m[1]
        elif m[2] is not None or m[3] is not None:
            raw = _unescaped(m[2]) if m[2] is not None else bytes.fromhex((d := re.sub(rb"\s", b"", m[3]).decode()) + "0" * (len(d) % 2))
            held.append(font.decode(raw) if font else raw.decode("latin-1"))
        elif m[4]:
            inside = m[4] == b"["
        elif m[5] and not inside:
            if m[5] == b"Tf":
                font = fonts.get(name)
            elif m[5] in (b"Tj", b"TJ", b"'", b'"') and held:
                out.append("".join(held))
            held = []
    return " ".join(out)


def streams(raw: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of each content stream, in the order of the file. Strings of fonts without a map are read as Latin-1."""
    file = _File(raw)
    pages = [b for b in file.objects.values() if re.search(rb"/Type\s*/Page\b", b)]
    fonts = {n: file.fonts(p) for p in pages for n in file.refs(p, b"Contents")}
    whole = {k: v for f in fonts.values() for k, v in f.items()}
    at = [(m.start(2), m.end(2), int(m[1])) for m in _OBJECT.finditer(raw)]
    starts = [a for a, _, _ in at]
    for n, m in enumerate(_STREAM.finditer(raw)):
        body = _inflated(m[1])
        i = bisect_right(starts, m.start()) - 1
        number = at[i][2] if i >= 0 and m.start() < at[i][1] else -1
        kind = raw[at[i][0] : m.start()] if number >= 0 else b""
        if re.search(rb"\bBT\b", body) and not re.search(rb"/ObjStm|/Image|/FontFile|begincmap", kind + body[:2000]):
            yield f"stream{n}", _shown(body, fonts.get(number, whole))
