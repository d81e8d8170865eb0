"""Shared parts of the corpus operators: the tokenizer on executors, and an author's own text."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import SparkSession

#: Where the public tokenizer files lie; a parameter of every operator that needs one.
TOKENIZERS = os.environ.get("SEQLOOM_TOKENIZERS", "/opt/tokenizers")
#: A vocabulary file is read once on the driver and sent along; it may have at most so many bytes.
MOST_FILE_BYTES = 64 << 20


def tokenizer_json(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    file = Path(folder, f"{name}.json")
    if file.stat().st_size > MOST_FILE_BYTES:
        raise ValueError(f"{file} is larger than {MOST_FILE_BYTES} bytes")
    return file.read_text(encoding="utf-8")


def sent_along(spark: SparkSession, name: str, folder: str):
    return spark.sparkContext.broadcast(tokenizer_json(name, folder))


_LOADED: dict[int, object] = {}


def loaded(text: str):
    """The tokenizer of a vocabulary text, made once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(text)
    if key not in _LOADED:
        made = Tokenizer.from_str(text)
        made.encode_special_tokens = True  # text that looks like a special token is ordinary text
        _LOADED[key] = made
    return _LOADED[key]


def batches(texts: list[str], most_letters: int = 2_000_000):
    """Slices of texts of bounded total length, so that long texts don't meet in one call."""
    start = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= most_letters:
            yield texts[start : k + 1]
            start, total = k + 1, 0
    if start < len(texts):
        yield texts[start:]


_BLOCKS = regex.compile(r"\[quote\b[^\]]*\]|\[/quote\]|<blockquote\b[^>]*>|</blockquote>", regex.I)
_WROTE = regex.compile(r"^\s*\S.{0,80}\b(?:wrote|writes|said|schrieb|a écrit|escribió|написал(?:а)?)\s*:\s*$", regex.I)
_QUOTED = regex.compile(r"^\s*(?:>|&gt;|\||»)")
_SIGNATURE = regex.compile(r"^(?:--\s*|_{4,}\s*|-{4,}\s*|~{3,}\s*)$")
_CLOSING = regex.compile(r"^\s*(?:regards|best regards|kind regards|cheers|best|thanks|greetings|sincerely|yours|br|gru(?:ß|ss)|mfg|cordialement|saludos|с уважением)\s*[,.!]?\s*$", regex.I)
_SENT = regex.compile(r"^\s*(?:sent from my|gesendet von|envoyé de mon|enviado desde)\b.{0,60}$", regex.I)
_CODE = regex.compile(r"\[(?:img|code|url=[^\]]*)\][^\[]*\[/(?:img|code|url)\]|<(?:pre|code|script|style)\b[^>]*>.*?</(?:pre|code|script|style)>", regex.I | regex.S)
_TAGS = regex.compile(r"\[/?[a-z*]+(?:=[^\]]*)?\]|</?[a-zA-Z!][^<>]{0,300}>", regex.I)
_ENTITIES = regex.compile(r"&(?:#\d+|#x[0-9a-f]+|[a-z]+);?", regex.I)
_LINKS = regex.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+")
#: Stands for a letter that isn't the author's own.
_GONE = "\0"
#: Whether a code point is space or stands for such a letter; none above the last is.
_UNSEEN = np.array([chr(k) == _GONE or chr(k).isspace() for k in range(0x3002)])
_VISIBLE = regex.compile(r"\S")
_BLOB = regex.compile(r"[A-Za-z0-9+/=_-]{45,}")


def without_quotes(text: str) -> str:
    """The text without quoted lines, the line that names whom they quote, and quoted blocks, nested ones included."""
    lines = text.split("\n")
    own = []
    for k, line in enumerate(lines):
        if _QUOTED.match(line):
            continue
        if _WROTE.match(line) and any(_QUOTED.match(x) for x in lines[k + 1 : k + 2]):
            continue
        own.append(line)
    text = "\n".join(own)
    kept, depth, at, opened_at = [], 0, 0, 0
    for m in _BLOCKS.finditer(text):
        closing = m.group().startswith(("[/", "</"))
        if depth == 0:
            kept.append(text[at : m.start()])
            opened_at, at = m.start(), m.end()
        depth = max(0, depth + (-1 if closing else 1))
        if depth == 0:
            kept.append("\n")
            at = m.end()
    rest = text[at:] if depth == 0 else text[opened_at:].partition("\n\n")[2]  # a block that is never closed ends with its paragraph
    return "".join(kept) + rest


def without_signature(text: str) -> str:
    """The text up to a signature line, or up to a closing formula with at most three short lines after it."""
    lines = [x for x in text.split("\n") if not _SENT.match(x)]
    for k, line in enumerate(lines):
        if _SIGNATURE.match(line) and any(x.strip() for x in lines[:k]) and len([x for x in lines[k:] if x.strip()]) <= 8:
            lines = lines[:k]
            break
    for k in range(len(lines) - 1, -1, -1):
        if _CLOSING.match(lines[k]):
            after = [x for x in lines[k + 1 :] if x.strip()]
            if len(after) <= 3 and all(len(x) <= 60 for x in after):
                lines = lines[:k]
            break
    return "\n".join(lines)


def own_text(text: str | None) -> str:
    """What the author wrote: without quoted passages, signature, markup, entities, links and blobs. Null gives ''."""
    if not text:
        return ""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace("\x85", "\n")
    text = without_signature(without_quotes(text))
    text = _CODE.sub(" ", text)
    text = _TAGS.sub(" ", text)
    text = _ENTITIES.sub(" ", text)
    text = _LINKS.sub(" ", text)
    return _BLOB.sub(" ", text).strip()


def own_letters(text: str) -> np.ndarray:
    """Whether each character of a text is a visible one of its author's own words, by the rules of own_text()."""
    lines = text.replace("\r\n", " \n").replace("\r", "\n").replace("\u2028", "\n").replace("\x85", "\n").split("\n")
    own = list(lines)
    for k, line in enumerate(lines):
        if _QUOTED.match(line) or (_WROTE.match(line) and k + 1 < len(lines) and _QUOTED.match(lines[k + 1])):
            own[k] = _GONE * len(line)
    text = "\n".join(own)
    depth, opened_at, spans = 0, 0, []
    for m in _BLOCKS.finditer(text):
        if depth == 0:
            opened_at = m.start()
        depth = max(0, depth + (-1 if m.group().startswith(("[/", "</")) else 1))
        if depth == 0:
            spans.append((opened_at, m.end()))
    if depth:
        end = text.find("\n\n", opened_at)
        spans.append((opened_at, len(text) if end < 0 else end))
    for a, b in spans:
        text = text[:a] + _VISIBLE.sub(_GONE, text[a:b]) + text[b:]
    kept = len(without_signature(text.replace(_GONE, " ")).split("\n")) if text else 0
    lines = text.split("\n")
    dropped = [bool(_SENT.match(x)) for x in lines]
    left = 0
    for k, gone in enumerate(dropped):
        left += not gone
        if gone or left > kept:
            lines[k] = _GONE * len(lines[k])
    text = "\n".join(lines)
    for pattern, marks in ((_CODE, "[<"), (_TAGS, "[<"), (_ENTITIES, "&"), (_LINKS, ("://", "www.", "@")), (_BLOB, ("",))):
        if any(x in text for x in marks):  # without one of them there is no match
            text = pattern.sub(lambda m: _GONE * len(m.group()), text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ~_UNSEEN[np.minimum(points, len(_UNSEEN) - 1)]
