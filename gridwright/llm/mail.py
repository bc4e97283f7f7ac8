"""Raw mails: their parts, transfer encodings and markup, and the lines that are own prose."""

from __future__ import annotations

import binascii
import html
import quopri
import re
from collections.abc import Iterator
from dataclasses import dataclass

_BLANK = re.compile(r"\r?\n[ \t]*\r?\n")
_FIELD = re.compile(r"^(content-type|content-transfer-encoding)[ \t]*:[ \t]*(.*(?:\r?\n[ \t].*)*)", re.I | re.M)
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"\n]*)\"|([^\s;\"]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([^\s;\"]+)", re.I)


@dataclass(frozen=True)
class Part:
    """A leaf of a mail: its body is text[start:end]."""

    kind: str
    encoding: str
    charset: str
    start: int
    end: int


def _head(text: str, start: int, end: int) -> tuple[dict[str, str], int]:
    """Header fields of interest and where the body begins."""
    if text.startswith("\n", start):
        return {}, start + 1
    m = _BLANK.search(text, start, end)
    stop, body = (m.start() + 1, m.end()) if m else (end, end)
    return {f[1].lower(): f[2] for f in _FIELD.finditer(text, start, stop)}, body


def parts(text: str, start: int = 0, end: int | None = None) -> list[Part]:
    """The leaves in order, however deep. A missing end boundary ends a part with its mail; text outside the parts belongs to none."""
    out: list[Part] = []
    todo = [(start, len(text) if end is None else end)]
    while todo:
        start, end = todo.pop()
        head, body = _head(text, start, end)
        kind = head.get("content-type", "text/plain")
        name = kind.split(";")[0].strip().lower() or "text/plain"
        if name.startswith("multipart/") and (m := _BOUNDARY.search(kind)):
            mark = "--" + (m[1] if m[1] is not None else m[2])
            cuts, at = [], body
            while (at := text.find(mark, at, end)) >= 0:
                line_end = text.find("\n", at, end)
                line_end = end if line_end < 0 else line_end
                rest = text[at + len(mark) : line_end].strip()
                if (at == body or text[at - 1] == "\n") and rest in ("", "--"):
                    cuts.append((at, min(line_end + 1, end), rest))
                    if rest == "--":
                        break
                at = line_end
            stops = [c[0] for c in cuts[1:]] + [end]
            todo += reversed([(begin, stop) for (_, begin, rest), stop in zip(cuts, stops, strict=False) if rest != "--"])
            continue
        charset = m[1].lower() if (m := _CHARSET.search(kind)) else "utf-8"
        out.append(Part(name, head.get("content-transfer-encoding", "").strip().lower(), charset, body, end))
    return out


def decoded(text: str, part: Part) -> str:
    """A part's body with its transfer encoding undone; '' for bytes that are no text.

    Bytes of parts that don't call themselves text are text if they decode without error and hold no NUL.
    """
    body = text[part.start : part.end]
    if part.encoding == "quoted-printable":
        raw = quopri.decodestring(body.encode("utf-8", "surrogatepass"))
    elif part.encoding == "base64":
        clean = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            raw = binascii.a2b_base64(clean[: len(clean) - (len(clean) % 4 == 1)] + "=" * (-len(clean) % 4))
        except binascii.Error:
            return ""
    else:
        return body
    called = part.kind.startswith("text/") or part.kind in ("application/json", "application/xml")
    try:
        out = raw.decode(part.charset, "replace" if called else "strict")
    except LookupError:
        out = raw.decode("utf-8", "replace")
    except UnicodeDecodeError:
        return ""
    return out if called or "\0" not in out else ""


_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")


def plain(markup: str) -> str:
    """HTML without markup: inline tags vanish, all others part words; entities are undone."""
    return html.unescape(_TAG.sub(" ", _INLINE.sub("", _HIDDEN.sub(" ", markup))))


def texts(text: str) -> Iterator[str]:
    """What a reader of the mail can see, part by part: every text part, decoded and without markup, and text outside the parts."""
    seen = []
    for p in parts(text):
        seen.append((p.start, p.end))
        body = decoded(text, p)
        if body:
            yield plain(body) if p.kind == "text/html" else body
    if len(seen) > 1 or (seen and seen[0][1] < len(text)):
        _, at = _head(text, 0, len(text))
        outside = []
        for start, end in seen:
            outside.append(text[at : max(at, start)])
            at = end
        outside.append(text[at:])
        yield "\n\n".join(outside)


_QUOTED = re.compile(r"[ \t]*>")
_ORIGINAL = re.compile(r"[ \t]*-{2,}[ \t]*Original Message[ \t]*-{2,}[ \t]*$", re.I)
_ANNOUNCES = re.compile(r".*[:：][ \t]*$")
_WHEN = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{1,2}:\d{2}")


def prose(text: str) -> list[list[tuple[int, int]]]:
    """Paragraphs of own prose: lists of line spans (without line ends) in text.

    Only single-part bodies and text/plain parts without quoted-printable or base64 encoding hold any. Left out
    are quoted lines, the line announcing a quotation, all below an original-message line, and signatures (from '-- ' to the next blank line).
    """
    out: list[list[tuple[int, int]]] = []
    for part in parts(text):
        if part.kind != "text/plain" or part.encoding in ("quoted-printable", "base64"):
            continue
        lines, at = [], part.start
        while at < part.end:
            stop = text.find("\n", at, part.end)
            stop = part.end if stop < 0 else stop
            lines.append((at, stop - (stop > at and text[stop - 1] == "\r")))
            at = stop + 1
        here: list[tuple[int, int]] = []
        signature = False
        for k, (a, b) in enumerate(lines):
            line = text[a:b]
            if not line.strip():
                signature = False
                if here:
                    out.append(here)
                here = []
                continue
            if signature:
                continue
            if _ORIGINAL.match(line):
                break
            if line == "-- ":
                signature = True
            elif not _QUOTED.match(line) and not (_ANNOUNCES.match(line) and _announces(text, lines, k)):
                here.append((a, b))
                continue
            if here:
                out.append(here)
            here = []
        if here:
            out.append(here)
    return out


def _announces(text: str, lines: list[tuple[int, int]], k: int) -> bool:
    """Whether the next line, or after blank lines the next with a date in this one, is quoted."""
    for j in range(k + 1, len(lines)):
        nxt = text[lines[j][0] : lines[j][1]]
        if nxt.strip():
            return bool(_QUOTED.match(nxt)) and (j == k + 1 or bool(_WHEN.search(text[lines[k][0] : lines[k][1]])))
    return False
