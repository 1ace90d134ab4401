"""What the sender of an email wrote: the body without headers, quotes, signature, disclaimer, attachments and second copies."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]*[ \t]*:")
_TYPE = re.compile(r"^\s*([\w.+-]+/[\w.+-]+)")
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]+)"|([^\s;]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([\w.:-]+)', re.I)


def split_headers(text: str) -> tuple[dict[str, str], str]:
    """Header fields (lower-case names, unfolded, the first of each name) and the rest. Text that opens with no header has none."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("From ") and "\n" in text:
        text = text[text.index("\n") + 1 :]
    elif text.startswith(">From ") and "\n" in text:
        text = text[text.index("\n") + 1 :]
    text = text.lstrip("\n") if _HEADER.match(text.lstrip("\n")) else text
    if not _HEADER.match(text):
        gap = text.startswith("\n")
        return {}, text[1:] if gap else text
    head, _, body = text.partition("\n\n")  # a line of white space continues a header
    fields: dict[str, str] = {}
    name = ""
    for line in head.split("\n"):
        if line[:1] in " \t":
            if name:
                fields[name] += " " + line.strip()
        elif ":" in line:
            key, value = line.split(":", 1)
            key = key.strip().lower()
            name = "" if key in fields else key
            if name:
                fields[name] = value.strip()
        else:
            name = ""
    return fields, body


def _part_headers(part: str) -> tuple[dict[str, str], str]:
    part = part.lstrip(" \t")
    if part.startswith("\n"):
        part = part[1:]
    if part.startswith("\n") or not _HEADER.match(part):
        return {}, part
    return split_headers(part)


def _decoded(fields: dict[str, str], body: str) -> str:
    coding = fields.get("content-transfer-encoding", "").strip().lower()
    if coding not in ("base64", "quoted-printable"):
        return body
    charset = _CHARSET.search(fields.get("content-type", ""))
    try:
        if coding == "base64":
            raw = base64.b64decode(re.sub(r"[^A-Za-z0-9+/]", "", body) + "==", validate=False)
        else:
            raw = quopri.decodestring(body.encode("utf-8", "surrogateescape"))
    except (binascii.Error, ValueError):
        return body
    for name in (charset.group(1) if charset else "utf-8", "utf-8", "latin-1"):
        try:
            return raw.decode(name).replace("\r\n", "\n")
        except (LookupError, UnicodeDecodeError):
            continue
    return body


def text_part(fields: dict[str, str], body: str, depth: int = 0) -> tuple[str, bool] | None:
    """(text, is HTML) of the first readable part that is no attachment; plain text wins over HTML."""
    kind = fields.get("content-type", "")
    name = _TYPE.match(kind)
    kind_name = name.group(1).lower() if name else "text/plain"
    if "attachment" in fields.get("content-disposition", "").lower():
        return None
    if kind_name.startswith("multipart/") and depth < 8:
        mark = _BOUNDARY.search(kind)
        found = None
        if mark:
            line = "--" + (mark.group(1) or mark.group(2))
            pieces = re.split(r"(?:^|\n)" + re.escape(line) + r"(?:--)?[ \t]*(?=\n|$)", body)
            for piece in pieces[1:]:
                one = text_part(*_part_headers(piece), depth + 1)
                if one is None or not one[0].strip():
                    continue
                if not one[1]:
                    return one
                found = found or one
            if found or len(pieces) > 1:
                return found
        return body, False
    if kind_name == "text/html":
        return _decoded(fields, body), True
    if kind_name == "text/plain" or not name or (kind_name.startswith("text/") and "name=" not in kind.lower()):
        return _decoded(fields, body), False
    return None


_DROP = re.compile(r"<(script|style|head|title)\b.*?</\1\s*>", re.I | re.S)
_QUOTE = re.compile(r"<blockquote\b.*?</blockquote\s*>", re.I | re.S)
_CELL = re.compile(r"</t[dh]\s*>\s*(?=<t[dh])", re.I)
_ITEM = re.compile(r"<li\b[^>]*>", re.I)
_BREAK = re.compile(r"<br\s*/?>\n?|</(?:p|div|tr|li|h\d|pre|table|ul|ol)\s*>\n?", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")


def html_text(source: str) -> str:
    text = _QUOTE.sub("\n", _DROP.sub("", source))
    text = _BREAK.sub("\n", _ITEM.sub("- ", _CELL.sub("\t", text)))
    return html.unescape(_TAG.sub("", text)).replace("\xa0", " ")


# fixed values: how mail programs of the archive's languages introduce a quotation
_WROTE = re.compile(
    r"\b(?:wrote|writes|schrieb|schreibt|a écrit|a Ã©crit|escribió|escribiÃ³|написал\(?а?\)?|пишет)\b[^\n]{0,90}[:：]$"
    r"|^\* .{1,80}\[.{0,60}\]:$"
    r"|^(?:\w{3},? )?.{0,40}\d\d?:\d\d.{0,60}:$"
    r"|さんは書きました[:：]$",
    re.I,
)
_QUOTED = re.compile(r"^\s*(?:[A-Z]{0,3}>|\|(?!.*\|)(?: |$))")
_FORWARD = re.compile(r"^\s*(?:-{2,}|_{5,}).{0,4}(?:original message|ursprüngliche nachricht|message d'origine|message original|mensaje original|forwarded message|weitergeleitete nachricht|исходное сообщение|пересылаемое сообщение)", re.I)
_OUTLOOK = re.compile(r"^\s*(?:From|Von|De|От)\s*:\s+\S")
_OUTLOOK_NEXT = re.compile(r"^\s*(?:Sent|Gesendet|Envoyé|Enviado(?: el)?|Отправлено|Date|Datum|Fecha|Дата)\s*:", re.I)
_RULE = re.compile(r"^\s*([-_=*~#])(?:\s*\1){9,}\s*$")
_DISCLAIMER = re.compile(
    r"confidential|intended (?:only )?(?:for|recipient)|registered office|not checked outside|vertraulich|bestimmt für|irrtümlich|réservé à son destinataire|reçu par erreur|confidencial|destinatario|por error|"
    r"конфиденциальн|предназначено|privileged|virus|please delete|bitte löschen|merci de le détruire|entry no\.|e-mail and any attachments|this (?:message|e-?mail)|diese (?:nachricht|e-?mail)|ce message|este (?:mensaje|correo)|это (?:сообщение|письмо)|"
    r"unsubscribe|mailing list|秘密|宛先",
    re.I,
)


def own_text(text: str | None) -> str:
    """The sender's own lines of a raw message."""
    if not text:
        return ""
    fields, body = split_headers(text)
    part = text_part(fields, body)
    if part is None:
        return ""
    plain = reread(html_text(part[0]) if part[1] else part[0])
    kept: list[str] = []
    every, in_bars = plain.split("\n"), False
    for k, line in enumerate(every):
        line = line.rstrip()
        if _OUTLOOK.match(line) and k + 1 < len(every) and _OUTLOOK_NEXT.match(every[k + 1]):
            break
        if line in ("--", "—") or _FORWARD.match(line):
            break
        before = next((x for x in reversed(kept[-3:]) if x), "")
        barred = line.lstrip().startswith("|") and (in_bars or before is not _CUT and _attribution(before))  # a quoted table or rule
        in_bars = barred or (line.lstrip().startswith("|") and bool(_QUOTED.match(line)))
        if not barred and not _QUOTED.match(line):
            kept.append(line)
        elif kept and kept[-1] is not _CUT:
            while kept and not kept[-1]:
                kept.pop()
            if kept and _attribution(kept[-1]):
                kept.pop()
            elif len(kept) > 1 and kept[-2] is not _CUT and _attribution(kept[-2] + " " + kept[-1]) and len(kept[-1]) < 60:
                del kept[-2:]
            kept.append(_CUT)
    lines = [line for line in kept if line is not _CUT and not _attribution(line)]
    return "\n".join(_without_disclaimer(lines)).strip("\n")


_CUT = "\0quotation"


_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]")


def reread(text: str) -> str:
    """UTF-8 that was read as a one-byte code, put right; text that was not stays as it is."""
    if not _MISREAD.search(text):
        return text
    for name in ("latin-1", "cp1252", "iso-8859-15"):
        try:
            return text.encode(name).decode("utf-8")
        except UnicodeError:
            continue
    return text


def _attribution(line: str) -> bool:
    return line[-1:] in (":", "：") and len(line) < 200 and bool(_WROTE.search(line.strip()))


def _without_disclaimer(lines: list[str]) -> list[str]:
    while lines and not lines[-1].strip():
        lines.pop()
    for _ in range(3):  # a disclaimer is a closing paragraph, often under a rule
        start = len(lines)
        while start and lines[start - 1].strip() and not _RULE.match(lines[start - 1]):
            start -= 1
        last = " ".join(lines[start:])
        if start == len(lines) and start and _RULE.match(lines[-1]):
            lines = lines[:-1]
        elif last and _DISCLAIMER.search(last) and len(lines) - start <= 12:
            lines = lines[:start]
        else:
            break
        while lines and not lines[-1].strip():
            lines.pop()
    return lines
