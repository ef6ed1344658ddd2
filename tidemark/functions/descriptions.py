"""One-line descriptions of projects from their readmes and manifests, in Arrow batches."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as xml

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest description.
LONGEST = 200

_CODE = re.compile(r"^(```|~~~).*?^\1[^\n]*$", re.MULTILINE | re.DOTALL)
_IMAGE = re.compile(r"!\[[^\]\n]{0,300}\](?:\([^()\n]{0,2000}\)|\[[^\]\n]{0,300}\])")
_LINK = re.compile(r"\[([^\[\]\n]{0,500})\](?:\([^()\n]{0,2000}\)|\[[^\]\n]{0,300}\])")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,2000}>", re.DOTALL)
_SKIPPED = re.compile(r"\s*(?:#|>|\||[-*+]\s|\d+[.)]\s|={3,}|-{3,}|\[[^\]]+\]:|$)")
_END = re.compile(r"(?<=[.!?])\s")


def tidy(text: str) -> str | None:
    """White space joined, marks of emphasis dropped, cut at a word; None for nothing."""
    text = re.sub(r"\s+", " ", re.sub(r"[*_`]+(?=\S)|(?<=\S)[*_`]+", "", text)).strip()
    if len(text) > LONGEST:
        text = text[: LONGEST - 1].rsplit(" ", 1)[0].rstrip(" ,;:") + "…"
    return text or None


def readme_sentence(text: str | None) -> str | None:
    """First sentence of the first paragraph that is no heading, list, quote, table, image or code."""
    if not text:
        return None
    text = _TAG.sub(" ", _CODE.sub("", text.replace("\r\n", "\n")))
    text = _LINK.sub(r"\1", _IMAGE.sub("", text))
    for paragraph in re.split(r"\n[ \t]*\n", text):
        lines = [line for line in paragraph.split("\n") if not _SKIPPED.match(line)]
        words = " ".join(lines).strip()
        if len(re.findall(r"\w{2,}", words)) >= 3:
            return tidy(_END.split(words, maxsplit=1)[0])
    return None


def json_description(text: str | None) -> str | None:
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    found = value.get("description") if isinstance(value, dict) else None
    return tidy(found) if isinstance(found, str) else None


def toml_description(text: str | None) -> str | None:
    """Of a project, package, workspace package or poetry table."""
    try:
        value = tomllib.loads(text or "")
    except (tomllib.TOMLDecodeError, RecursionError):
        return None
    tables = [value.get("project"), value.get("package"), (value.get("tool") or {}).get("poetry") if isinstance(value.get("tool"), dict) else None]
    for table in tables:
        if isinstance(table, dict) and isinstance(table.get("description"), str):
            return tidy(table["description"])
    return None


def pom_description(text: str | None) -> str | None:
    """The project's own ``<description>``; documents with entity declarations are not read."""
    if not text or "<!ENTITY" in text or "<!DOCTYPE" in text:
        return None
    try:
        root = xml.fromstring(text)
    except xml.ParseError:
        return None
    for child in root:
        if child.tag.rsplit("}", 1)[-1] == "description":
            return tidy(child.text or "")
    return None


def _column(function, column: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function(t if isinstance(t, str) else None))

    return run(column)


def description(path: Column, text: Column) -> Column:
    """By the file's name: readme, package.json, *.toml or pom.xml; null for others."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return (
        F.when(name.rlike(r"^readme(\.(md|markdown|txt|rst))?$"), _column(readme_sentence, text))
        .when(name == "package.json", _column(json_description, text))
        .when(name.endswith(".toml"), _column(toml_description, text))
        .when(name == "pom.xml", _column(pom_description, text))
    )
