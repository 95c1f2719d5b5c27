"""Sections of XML documents. The parser never resolves a document type or an external entity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Containers whose number and header lead to their sections.
LEVELS = ("division", "subdivision", "title", "subtitle", "part", "subpart", "chapter", "subchapter")
SCHEMA = "section_index int, section_identifier string, heading string, kind string, content string, parents array<string>, error string"
_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>", re.S)


def _text(node: ElementTree.Element | None) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _load(content: str) -> ElementTree.Element:
    return ElementTree.fromstring(_DOCTYPE.sub("", content, count=1).strip())


def plain_text(content: str) -> str:
    """The whole document's text, white space collapsed."""
    return _text(_load(content))


def sections(content: str) -> list[tuple]:
    """(identifier, heading, kind, content, parents) in document order: the form first, then each section whole.

    A section inside another, as in a quotation, stays part of it. No section is an error.
    """
    root = _load(content)
    out: list[tuple] = []
    todo: list[tuple[ElementTree.Element, tuple[str, ...]]] = [(body, ()) for body in [*root.findall("legis-body"), *root.findall("resolution-body")]][::-1]
    while todo:
        node, path = todo.pop()
        tag = node.tag if isinstance(node.tag, str) else ""
        if tag == "section":
            number = _text(node.find("enum")).removesuffix(".").strip()
            out.append((number or None, _text(node.find("header")) or None, "Section", _text(node), list(path)))
            continue
        if tag in LEVELS:
            path = (*path, " ".join(f"{tag.upper()} {_text(node.find('enum'))} {_text(node.find('header'))}".split()))
        todo += [(child, path) for child in reversed(node)]
    if not out:
        raise ValueError("XML: no section elements")
    form = _text(root.find("form"))
    return ([(None, None, "Fallback", form, [])] if form else []) + out


def parse_xml(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_index, ..., error): each document's sections, or one row that says why there are none."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "section_index", "section_identifier", "heading", "kind", "content", "parents", "error"]
        for batch in batches:
            out = []
            for k, content in zip(batch["key"], batch["text"]):
                try:
                    out += [(k, i, *s, None) for i, s in enumerate(sections(content or ""))]
                except (ElementTree.ParseError, ValueError) as e:
                    out.append((k, None, None, None, None, None, None, str(e) if isinstance(e, ValueError) else "XML: malformed XML"))
            frame = pd.DataFrame(out, columns=names)
            frame["section_index"] = frame["section_index"].astype("Int32")
            yield frame

    return rows.mapInPandas(run, f"key {rows.dtypes[0][1]}, {SCHEMA}").withColumnRenamed("key", key)


def walked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, state, plain, sections): ``sections`` of a document that has some, else its ``plain`` text, or the ``broken`` content as it is."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, content in zip(batch["key"], batch["text"]):
                try:
                    found = [{"section_index": i, "section_identifier": n, "kind": kind, "content": body, "parent": path[-1] if path else ""} for i, (n, _, kind, body, path) in enumerate(sections(content))]
                    out.append((k, "sections", None, found))
                except ElementTree.ParseError:
                    out.append((k, "broken", content, None))
                except ValueError:
                    out.append((k, "plain", plain_text(content), None))
            yield pd.DataFrame(out, columns=["key", "state", "plain", "sections"])

    section = "array<struct<section_index int, section_identifier string, kind string, content string, parent string>>"
    return rows.mapInPandas(run, f"key {rows.dtypes[0][1]}, state string, plain string, sections {section}").withColumnRenamed("key", key)
