"""Slide decks in the Office Open XML format, read with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cueloom.errors import DeckParseError, InvalidInput

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PLACEHOLDER = "click to add title"


def _links(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, name = posixpath.split(part)
    try:
        root = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    return {r.get("Id"): (r.get("Type").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:]) for r in root}


def _paragraphs(shape) -> list[str]:
    return ["".join(t.text or "" for t in p.iter(f"{A}t")) for p in shape.iter(f"{A}p")]


def slide_title(root) -> str | None:
    """The first text of a shape that is neither blank nor the layout's prompt."""
    for shape in root.iter(f"{P}sp"):
        text = "\n".join(_paragraphs(shape)).strip()
        if text and text.lower() != PLACEHOLDER:
            return text
    return None


def slide_notes(root) -> str | None:
    """Paragraphs of the notes' body, each stripped; blank ones inside stay."""
    for shape in root.iter(f"{P}sp"):
        kind = shape.find(f".//{P}nvPr/{P}ph")
        if kind is not None and kind.get("type") == "body":
            return "\n".join(p.strip() for p in _paragraphs(shape)).strip() or None
    return None


def parse(content: bytes) -> list[tuple[int, str | None, str | None]]:
    """slide_num, title and notes of each slide in the deck's order."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        order = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        links, out = _links(z, "ppt/presentation.xml"), []
        for n, ref in enumerate(order.iter(f"{P}sldId"), 1):
            part = links[ref.get(f"{R}id")][1]
            notes = next((t for kind, t in _links(z, part).values() if kind == "notesSlide"), None)
            try:
                text = slide_notes(ElementTree.fromstring(z.read(notes))) if notes else None
            except (KeyError, ElementTree.ParseError):
                text = None
            out.append((n, slide_title(ElementTree.fromstring(z.read(part))), text))
        return out
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise DeckParseError(f"not a slide deck: {e}") from e


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, slide_num, title and notes of each slide of the decks at path (files end in .pptx)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if not files.where("lower(path) not like '%.pptx'").isEmpty():
        raise InvalidInput("decks are files that end in .pptx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *s) for p, c in zip(batch["path"], batch["content"], strict=True) for s in parse(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "slide_num", "title", "notes"])

    return files.mapInPandas(run, "path string, slide_num int, title string, notes string")


def is_deck(name: str) -> bool:
    return re.search(r"\.pptx$", name, re.I) is not None
