"""Prose of a text: its sentences without code, identifiers, paths and marks; comments in code count."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

#: Letters of scripts written without spaces between words.
UNSPACED = r"぀-ヿ㐀-䶿一-鿿豈-﫿가-힯฀-๿"
#: A sentence has at least so many words, or so many unspaced letters.
MIN_WORDS, MIN_UNSPACED = 4, 6

_LINE_END = re.compile(r"\r\n|[\r\n  \x85]")
_FENCE = re.compile(r"^\s*(```|~~~)")
_COMMENT = re.compile(r"^\s*(?://+[/!]?|/\*+!?|\*+(?=\s|$)|#+!?(?=\s|$)|--(?=\s)|;;+|<!--|\"\"\"|''')\s*(.*?)\s*(?:\*+/|-->|\"\"\"|''')?\s*$")
_QUOTE = re.compile(r"^\s*(?:[-*+]\s+)?(?:>\s?)+|^\s*[-*+]\s+(?=//|#|\*)")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)]|---+|===+)(?:\s|$)")
_PLAIN = re.compile(r"[^{}();=<>\[\]]*$")
_TRAILING = re.compile(r"\s(?://+|/\*+|#|--)\s+(.*?)\s*(?:\*/)?\s*$")
_CODE = re.compile(r"[{};(\[=]\s*$|=>|===?|!==?|:=|&&|\|\||\(\)|->|</|/>|^\s*[}\])@]|^\s*(?:import|export|from|package|const|let|var|def|class|func|function|type|interface|struct|return|if|elif|else|for|while|try|except|raise|throw|public|private|static|async|await|with|yield|use|fn|pub|impl|enum|#include)\b[^.!?]*[(){}\[\]=:;\"'<>]|^\s*(?:import|from|package|return|use|export)\s+\S+(?:\s+(?:import|as|from)\s+\S+)*\s*$")
_SPAN = re.compile(r"`[^`]*`|\b\w+://\S+|\S*[\w.@-]/[\w.@-]\S*|<[^<> ]+>")
_SENTENCE = re.compile(r"(?<=[.!?…])[\s ]+|(?<=[。！？])|\s[/|·]\s|[\t•]|^\s*(?:[-*+]|\d+[.)])\s+")
_TOKEN = re.compile(r"\w+(?:[-'’.]\w+)*")
_NAME = re.compile(r"[a-zß-öø-ÿ0-9][A-Z]|[._]|\d")
_UNSPACED = re.compile(f"[{UNSPACED}]")
_RUN = re.compile(f"[{UNSPACED}]+|[^{UNSPACED}]+")
_ODD = re.compile(r"[{}()\[\]=<>;$#@\\|^~*_&%+]")


def lines_of(text: str) -> Iterator[tuple[str, bool]]:
    """Candidate lines and whether they stand in a comment; code gives its trailing comment only.

    Wrapped lines are joined: a line goes on the one before if both stand in a comment or
    neither does, unless it begins a list item or a blank line, code or a heading lies between.
    """
    fenced, held, kind = False, "", False
    for line in _LINE_END.split(text):
        line = _QUOTE.sub("", line)
        new: tuple[str, bool] | None = None
        opens = False
        if _FENCE.match(line):
            fenced = not fenced
        elif m := _COMMENT.match(line):
            new, opens = (m[1], True), not m[1]
        elif fenced and not _PLAIN.match(line) or _CODE.search(line):
            if t := _TRAILING.search(line):
                new, opens = (t[1], True), True
        elif line.strip():
            new, opens = (line, False), bool(_ITEM.match(line))
        if new is None or opens or new[1] != kind:
            if held:
                yield held, kind
            held = ""
        if new is not None:
            held, kind = f"{held} {new[0]}" if held else new[0], new[1]
    if held:
        yield held, kind


def without_spans(sentence: str) -> str:
    """The sentence without code spans, addresses, paths and tags."""
    return _SPAN.sub(" ", sentence) if "/" in sentence or "`" in sentence or "<" in sentence else sentence


def _plain_word(token: str) -> bool:
    """A word that is no identifier; only unusual tokens need the pattern."""
    if token.isalpha() and (token[1:].islower() or token.isupper() or len(token) == 1):
        return True
    return token[0].isalpha() and not _NAME.search(token)


def cleaned(sentence: str) -> tuple[str, int, int]:
    """Words of the main script of a sentence without spans, joined by blanks, their number, number of unspaced letters."""
    tokens = _TOKEN.findall(sentence)
    if sentence.isascii():
        words = [t for t in tokens if _plain_word(t)]
        return " ".join(words).lower(), len(words), 0
    unspaced: list[str] = []
    others: dict[bool, list[str]] = {False: [], True: []}
    any_unspaced = _UNSPACED.search(sentence) is not None
    for token in tokens:
        if any_unspaced and _UNSPACED.search(token):
            unspaced.extend(r for r in _RUN.findall(token) if _UNSPACED.match(r))
        elif _plain_word(token):
            others["\u0370" <= token[0] <= "\u1fff"].append(token)
    spaced = max(others.values(), key=lambda w: sum(map(len, w)))
    n = sum(map(len, unspaced))
    if 2 * n >= sum(map(len, spaced)) and n:
        return " ".join(unspaced), 0, n
    return " ".join(spaced).lower(), len(spaced), 0


def sentences(text: str | None) -> list[str]:
    """Cleaned prose sentences in order; nothing for a null, empty or prose-free text."""
    out: list[str] = []
    text = text or ""
    for line, _ in lines_of(text if text.isascii() else unicodedata.normalize("NFKC", text)):
        for part in _SENTENCE.split(line):
            if not part or part.isspace():
                continue
            bare = without_spans(part)
            words, spaced, unspaced = cleaned(bare)
            if (spaced >= MIN_WORDS or unspaced >= MIN_UNSPACED) and len(_ODD.findall(bare)) * 12 <= len(part):
                out.append(words)
    return out
