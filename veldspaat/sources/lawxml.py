"""Articles out of landed XML of laws.

Inference would read article numbers as times and lose the order of mixed content, so each file is parsed on its own,
in the task that read it. One row in, its articles out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, artikel string, titel string, tekst string, leden array<string>, structuur array<string>, place int, error string"
#: Elements that aren't part of the wording, and those above an article that make its path. Fixed values.
LEFT_OUT = {"meta-data", "kop", "noot", "redactie", "lidnr", "li.nr"}
ABOVE = {"boek", "deel", "titeldeel", "hoofdstuk", "afdeling", "paragraaf"}


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _flat(node: ET.Element) -> str:
    """Running text of a node without the parts left out."""
    parts = [node.text or ""]
    for child in node:
        if child.tag not in LEFT_OUT:
            parts.append(_flat(child))
        parts.append(child.tail or "")
    return _squeezed(" ".join(parts))


def _blocks(node: ET.Element, depth: int = 0) -> list[str]:
    """Lines of a node: paragraphs, list items indented by depth with their numbers, table rows with all cells."""
    lines: list[str] = []
    for child in node:
        if child.tag in LEFT_OUT:
            continue
        if child.tag == "li":
            number = _squeezed(child.findtext("li.nr") or "")
            inner = _blocks(child, depth + 1)
            head = inner.pop(0).strip() if inner else _flat(child)
            lines += [f"{'  ' * depth}{number} {head}".rstrip(), *inner]
        elif child.tag == "row":
            lines.append(" | ".join(_flat(cell) for cell in child.iter("entry")))
        elif child.tag == "al" or not len(child):
            lines.append("  " * depth + _flat(child))
        else:
            lines += _blocks(child, depth)
    return [line for line in lines if line.strip()]


def _heading(node: ET.Element) -> str | None:
    kop = node.find("kop")
    if kop is None:
        return None
    label = _squeezed(f"{kop.findtext('label') or ''} {kop.findtext('nr') or ''}")
    title = _squeezed(kop.findtext("titel") or "")
    return " - ".join(x for x in (label, title) if x) or None


def articles(xml: str) -> Iterator[dict]:
    """The articles of a law in order, with the headings above each from the root down."""

    def walk(node: ET.Element, path: list[str]) -> Iterator[dict]:
        for child in node:
            if child.tag == "artikel":
                members = [f"{_squeezed(m.findtext('lidnr') or '')} {chr(10).join(_blocks(m))}".strip() for m in child.findall("lid")]
                text = "\n".join(members or _blocks(child))
                yield {"artikel": _squeezed(child.findtext("kop/nr") or ""), "titel": _squeezed(child.findtext("kop/titel") or "") or None, "tekst": text, "leden": members or None, "structuur": path or None}
            else:
                above = _heading(child) if child.tag in ABOVE else None
                yield from walk(child, [*path, above] if above else path)

    yield from walk(ET.fromstring(xml), [])


def read_articles(files: DataFrame, *, path: str = "path", xml: str = "xml") -> DataFrame:
    """A row per article of every (path, xml); a file that can't be parsed gives one row with its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for where, text in zip(batch[path], batch[xml], strict=True):
                try:
                    rows += [{"path": where, **a, "place": i, "error": None} for i, a in enumerate(articles(text or ""))]
                except ET.ParseError as error:
                    rows.append({"path": where, "artikel": None, "titel": None, "tekst": None, "leden": None, "structuur": None, "place": 0, "error": str(error)})
            yield pd.DataFrame(rows, columns=["path", "artikel", "titel", "tekst", "leden", "structuur", "place", "error"])

    return files.select(path, xml).mapInPandas(parse, SCHEMA)
