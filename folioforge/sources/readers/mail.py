"""Messages and mailboxes."""

from __future__ import annotations

import re
from email import message_from_bytes, policy
from email.headerregistry import HeaderRegistry
from email.message import EmailMessage
from functools import lru_cache

from .markup import visible_text

_SHOWN = "From To Cc Date Subject".split()
#: Printable ASCII, in which nothing is encoded: as a subject it stands for itself.
_PLAIN = re.compile(r"(?!.*=\?)[ -~]+")
#: Headers that are kept as parsed, and the longest of them.
_KEPT, _KEPT_LENGTH = 2048, 500
_parse = HeaderRegistry()
_parsed = lru_cache(_KEPT)(_parse)


def _header(name: str, value: str):
    """A header as parsed: the parser takes most of the time of a message, and is asked for the same header several times."""
    if len(value) > _KEPT_LENGTH:
        return _parse(name, value)
    return value if name.lower() == "subject" and _PLAIN.fullmatch(value) else _parsed(name, value)


_POLICY = policy.default.clone(header_factory=_header)


def _content(part: EmailMessage) -> str:
    try:
        return part.get_content()
    except (LookupError, UnicodeDecodeError):
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def _show(message: EmailMessage) -> str:
    """Headers, the plain text (or else the HTML's), and the names of attachments."""
    bodies: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    attached = []
    for part in message.walk():
        if name := part.get_filename():
            attached.append(name)
        elif part.get_content_maintype() != "multipart" and part.get_content_type() in bodies:
            bodies[part.get_content_type()].append(_content(part))
    plain, rich = bodies.values()
    body = "\n".join(plain).strip() if any(map(str.strip, plain)) else visible_text("\n".join(rich)) if rich else ""
    pieces = ["\n".join(f"{h}: {message[h]}" for h in _SHOWN if message[h])]
    if body:
        pieces.append(body)
    if attached:
        pieces.append("Attachments: " + ", ".join(attached))
    return "\n\n".join(pieces)


def read_message(data: bytes) -> str:
    return _show(message_from_bytes(data, policy=_POLICY))


def read_mailbox(data: bytes) -> str:
    """Each message under a line with its number; a line that starts ``From `` begins one."""
    text = data.decode("utf-8", "replace")
    starts = [m.start() for m in re.finditer(r"(?:\A|(?<=[\n\r]))From ", text) if m.start()]
    cuts = [0, *starts, len(text)]
    messages = [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    out = []
    for k, m in enumerate(messages, 1):
        if m.startswith("From "):
            m = m.partition("\n")[2]
        out.append(f"--- message {k} ---\n{read_message(m.encode('utf-8', 'replace'))}")
    return "\n".join(out)
