"""Markup residue: which kinds of markup a text holds, and the text without them.

A text is a flat list of blocks (its lines). A block's features are its word count and link density,
those of its two neighbours, what its neighbours show (an open code fence before it, an underline below
it), and how many signs of each family it shows itself; a decision tree for each kind
(html, markdown, wiki, latex), trained on the labelled table in ``markup_labels``, says whether the
block holds that kind. Neighbours decide what a block alone can't tell: a row of ``=`` is an underline
below a short line and a printed rule elsewhere; a line is code between two fences. The trees are small
and travel with the tasks; the labelled table is their only training data. Rows without any candidate
sign never leave the JVM.

Conversion keeps structure: headings with their level in ``#``, list items as ``- `` or with their number,
table cells parted by `` | ``, code fences and formulas as they are; comments, attributes, categories and
templates go, however deep they are nested.

Defined results: null texts hold nothing and stay null; a text without markup is returned unchanged;
repeated rows give theirs each; an empty table gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import blocks
from .markup_labels import DOCUMENTS

KINDS = ("html", "markdown", "wiki", "latex")

_ATTRIBUTE = r"""(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))?)*"""
_TAG = re.compile(rf"</?(?!all>)[A-Za-z][\w:-]*{_ATTRIBUTE}\s*/?>|<!--|-->|<!DOCTYPE\b|<\?xml\b")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}\d{0,2}|#\d{2,6}|#[xX][0-9a-fA-F]{2,5});")
_SIGNS: dict[str, re.Pattern[str]] = {
    "tag": _TAG,
    "entity": _ENTITY,
    "md_heading": re.compile(r"^\s{0,3}#{1,6}\s+\S"),
    "md_underline": re.compile(r"^={4,}\s*$"),
    "md_strong": re.compile(r"(?<![*\w])\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*(?!\*)|(?<![_\w])__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?![_\w])"),
    "md_strike": re.compile(r"~~(?=[^\s~])[^~\n]+?(?<=[^\s~])~~"),
    "md_code": re.compile(r"```|`[^`\n]+`"),
    "md_link": re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]+\)"),
    "md_quote": re.compile(r"^>\s+\S"),
    "md_row": re.compile(r"^\s*\|?\s*:?-{3,}:?\s*\|(?:\s*:?-{3,}:?\s*\|?)*\s*$"),
    "pipe": re.compile(r"^\s*\|[^|\n-][^|\n]*\|"),
    "wiki_link": re.compile(r"\[\[(?!Page [A-Z]?\d+\]\])[^\[\]\n]*[\w”.,;)—]+\]\]"),
    "wiki_address": re.compile(r"\[https?://[^\s\[\]]+ [^\[\]\n]+\]"),
    "wiki_signature": re.compile(r"(?<!~)~{3,5}(?!~)"),
    "wiki_template": re.compile(r"\{\{[^{}\n]+\}\}"),
    "wiki_quote": re.compile(r"(?<!')'{2,5}(?=[^\s'])[^'\n]+?(?<=[^\s'])'{2,5}(?!')"),
    "wiki_heading": re.compile(r"^\s*(={2,6})\s*[^=\s][^=\n]*\1\s*$"),
    "wiki_table": re.compile(r"^\s*(?:\{\||\|\}|\|-|!.*!!|\|.*\|\|)"),
    "tex_command": re.compile(r"\\[A-Za-z]+\*?\s*[{\[]"),
    "tex_symbol": re.compile(r"\\(?:item\b|S(?![A-Za-z])|[,;:!\[\]()](?!\w)|,\\S)"),
    "tex_math": re.compile(r"\$[^$\n]*\\[A-Za-z]+[^$\n]*\$"),
}
#: A string without which a sign can't occur in a block.
_NEEDS = {
    "tag": "<", "entity": "&", "md_heading": "#", "md_underline": "==", "md_strike": "~~", "md_code": "`", "md_link": "](", "md_quote": ">", "md_row": "--", "pipe": "|",
    "wiki_link": "[[", "wiki_address": "[http", "wiki_signature": "~~~", "wiki_template": "{{", "wiki_quote": "''", "wiki_heading": "==", "tex_command": "\\", "tex_symbol": "\\", "tex_math": "\\",
}
_LINK = re.compile(r"<a\b[^<>]*>([^<>]*)</a>|\[([^\[\]\n]*)\]\([^()\s]+\)|\[\[([^\[\]\n]*)\]\]|https?://\S+")
FEATURES = (*_SIGNS, "words", "link_density", "words_before", "links_before", "words_after", "links_after", "fenced", "underlined")

_UNDERLINE = list(_SIGNS).index("md_underline")

#: White space of Python's patterns but the line feed, for the JVM.
_BLANK = r"[\t\x0B\f\r\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Some character without which no sign can occur.
_CANDIDATE = rf"[<&\\`|~]|\*\*|__|\[\[|\]\(|\{{\{{|''|!!|\[https?://|(?m)^{_BLANK}*(?:#|==)|(?m)^>{_BLANK}"


def candidate(text: Column) -> Column:
    """Rows in which some sign may occur."""
    return F.coalesce(text.rlike(_CANDIDATE), F.lit(False))


def features(lines: list[str]) -> np.ndarray:
    """One row of FEATURES for each block."""
    out = np.zeros((len(lines), len(FEATURES)))
    for i, line in enumerate(lines):
        for j, (name, pattern) in enumerate(_SIGNS.items()):
            if _NEEDS.get(name, "") in line:
                out[i, j] = sum(1 for _ in pattern.finditer(line))
        n = len(line.split())
        linked = sum(len((m[1] or m[2] or m[3] or "x").split()) for m in _LINK.finditer(line)) if "[" in line or "<a" in line or "http" in line else 0
        out[i, len(_SIGNS)] = n
        out[i, len(_SIGNS) + 1] = min(1.0, linked / max(1, n))
    base = len(_SIGNS)
    out[1:, base + 2: base + 4] = out[:-1, base: base + 2]
    out[:-1, base + 4: base + 6] = out[1:, base: base + 2]
    fences = np.array([line.lstrip().startswith("```") for line in lines], bool)
    out[:, base + 6] = (np.cumsum(fences) - fences) % 2 * ~fences
    out[:-1, base + 7] = out[1:, _UNDERLINE]
    return out


class Tree:
    """A binary decision tree by Gini impurity; ties go to the feature that is listed first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 20, least: int = 1) -> None:
        self.nodes: list[tuple[int, float, int, int, bool]] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, bool(y.mean() > 0.5)))
        if depth and 0 < y.sum() < len(y):
            best = self._split(x, y, least)
            if best:
                _, f, cut = best
                low = x[:, f] <= cut
                left = self._grow(x[low], y[low], depth - 1, least)
                right = self._grow(x[~low], y[~low], depth - 1, least)
                self.nodes[at] = (f, cut, left, right, self.nodes[at][4])
        return at

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, int, float] | None:
        best, gini = None, lambda p: 2 * p * (1 - p)
        whole = len(y) * gini(y.mean())
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                n = int(low.sum())
                if least <= n <= len(y) - least:
                    gain = whole - n * gini(y[low].mean()) - (len(y) - n) * gini(y[~low].mean())
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, float(cut))
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, cut, left, right, label = self.nodes[at]
            if f < 0 or not len(rows):
                out[rows] = label
                continue
            low = x[rows, f] <= cut
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


@lru_cache(maxsize=1)
def trees() -> dict[str, Tree]:
    """A tree for each kind, trained on the labelled table."""
    x = np.concatenate([features([b for _, b in doc]) for doc in DOCUMENTS])
    labels = [set(k.split()) for doc in DOCUMENTS for k, _ in doc]
    return {kind: Tree(x, np.array([kind in k for k in labels], float)) for kind in KINDS}


def kinds_of(texts: list[str | None]) -> np.ndarray:
    """One row of booleans for each text, in the order of KINDS."""
    lines = [(t or "").split("\n") for t in texts]
    out = np.zeros((len(texts), len(KINDS)), bool)
    if not texts:
        return out
    x = np.concatenate([features(b) for b in lines])
    owner = np.repeat(np.arange(len(texts)), [len(b) for b in lines])
    for j, tree in enumerate(trees().values()):
        np.logical_or.at(out[:, j], owner, tree.predict(x))
    return out


def markup_kinds(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, markup): one row for each row and kind of markup it holds; repeated rows give theirs each."""
    rows = df.where(candidate(F.col(text_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text", 1024):
                row, kind = np.nonzero(kinds_of(batch["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(row)), pa.array([KINDS[k] for k in kind.tolist()], pa.string())], ["id", "markup"])

    return rows.mapInArrow(classify, f"id {rows.dtypes[0][1]}, markup string")


_HEADING = re.compile(r"(?is)<(h[1-6]|header)\b[^<>]*>(.*?)</\1>")
_LIST = re.compile(r"(?i)<(/?)(ol|ul)\b[^<>]*>|\s*<li\b[^<>]*>\s*")
_LEVELS = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
#: A formula, an escaped brace, a command whose text stays, or a brace.
_BRACES = re.compile(r"(\$\$.*?\$\$|\$[^$\n]*\\[^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\))|\\[{}]|(\\(?:emph|text[a-z]+|underline|mbox)\s*\{)|[{}]", re.S)
_TEMPLATE = re.compile(r"\{\{|\}\}")


def _listed(text: str) -> str:
    """List items on lines of their own, those of numbered lists with their number."""
    open_lists: list[int] = []

    def item(m: re.Match[str]) -> str:
        if m[2]:
            if not m[1]:
                open_lists.append(0 if m[2].lower() == "ol" else -1)
            elif open_lists:
                open_lists.pop()
            return "\n"
        if open_lists and open_lists[-1] >= 0:
            open_lists[-1] += 1
            return f"\n{open_lists[-1]}. "
        return "\n- "

    return _LIST.sub(item, text)


def _unwrapped(text: str) -> str:
    """The text without the commands that only dress their text, however they are nested; formulas stay."""
    out: list[str] = []
    dressed: list[bool] = []
    at = 0
    for m in _BRACES.finditer(text):
        out.append(text[at: m.start()])
        at = m.end()
        if m[2]:
            dressed.append(True)
            continue
        if m[0] == "{":
            dressed.append(False)
        elif m[0] == "}" and dressed and dressed.pop():
            continue
        out.append(m[0])
    return "".join([*out, text[at:]])


def _untemplated(text: str) -> str:
    """The text without templates, however they are nested; a brace pair that nothing closes stays."""
    opened: list[tuple[int, int]] = []
    parts: list[str] = []
    at = 0
    for m in _TEMPLATE.finditer(text):
        parts.append(text[at: m.start()])
        at = m.end()
        if m[0] == "{{":
            opened.append((len(parts), m.start()))
            parts.append(m[0])
        elif opened:
            del parts[opened.pop()[0]:]
        else:
            parts.append(m[0])
    return "".join([*parts, text[at:]])


def clean(text: str, kinds: set[str]) -> str:
    """The text without the given kinds of markup, its structure kept."""
    if "latex" in kinds:
        text = re.sub(r"\\((?:sub)*section|paragraph|chapter)\*?\{([^{}]*)\}", lambda m: f"\n{'#' * _LEVELS.get(m[1], 3)} {m[2]}\n", text)
        text = re.sub(r"\\(?:begin|end)\{[^{}]*\}", "", text)
        text = re.sub(r"\\item\s*", "- ", text)
        text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
        text = re.sub(r"~?\\(?:ref|label|cite)\{[^{}]*\}", "", text)
        text = _unwrapped(text)
        text = re.sub(r"\\,", " ", text)
        text = re.sub(r"\\S(?![A-Za-z])~?\s*", "§ ", text)
    if "html" in kinds:
        text = re.sub(r"(?s)<!--.*?-->", "", text)
        text = re.sub(r"&lt;(/?[A-Za-z][\w:-]*)&gt;", r"<\1>", text)
        text = _HEADING.sub(lambda m: f"\n{'#' * (int(m[1][1]) if m[1][1].isdigit() else 1)} {m[2]}\n", text)
        text = re.sub(r"(?i)<pre\b[^<>]*>", "\n```\n", text)
        text = re.sub(r"(?i)</pre>", "\n```\n", text)
        text = re.sub(r"(?i)</?code\b[^<>]*>", "`", text)
        text = _listed(text)
        text = re.sub(r"(?i)</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", text)
        text = re.sub(r"(?i)<br\s*/?>|<p(?:\s[^<>]*)?>|</(?:p|div|tr|table|section|text|quoted-block)>", "\n", text)
        text = _TAG.sub("", text)
        text = html.unescape(text)
    if "wiki" in kinds:
        text = _untemplated(text)
        text = re.sub(r"\[\[(?:Category|File|Image):[^\[\]]*\]\]", "", text)
        text = re.sub(r"\[\[(?!Page [A-Z]?\d+\]\])(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", text)
        text = re.sub(r"\[https?://[^\s\[\]]+ ([^\[\]\n]+)\]", r"\1", text)
        text = re.sub(r"(?<!~)~{3,5}(?!~)", "", text)
        text = re.sub(r"(?<!')'{2,5}(?=[^\s'])([^'\n]+?)'{2,5}(?!')", r"\1", text)
        text = re.sub(r"(?m)^\s*(={2,6})\s*([^=\n]+?)\s*\1\s*$", lambda m: f"{'#' * len(m[1])} {m[2]}", text)
        text = re.sub(r"(?m)^\s*(?:\{\|.*|\|\}|\|-.*)\n?", "", text)
        text = re.sub(r"(?m)^\s*[!|]\s*(.*(?:!!|\|\|).*)$", lambda m: re.sub(r"\s*(?:!!|\|\|)\s*", " | ", m[1]), text)
    if "markdown" in kinds:
        parts = re.split(r"(```.*?(?:```|$))", text, flags=re.S)
        for i in range(0, len(parts), 2):
            part = parts[i]
            part = re.sub(r"(?m)^(\S.*)\n=+[ \t]*$", r"# \1", part)
            part = re.sub(r"(?m)^\s{0,3}(#{1,6})\s+", r"\1 ", part)
            part = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+\)", r"\1", part)
            part = re.sub(r"(\*\*|__|~~)(?=[^\s*_~])([^\n]+?)\1", r"\2", part)
            part = re.sub(r"(?m)^>\s+", "", part)
            part = re.sub(r"(?m)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-*:?\s*\n?", "", part)
            part = re.sub(r"(?m)^\s*\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", part)
            parts[i] = part
        text = "".join(parts)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip("\n")


def clean_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): each row's text without markup residue."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text", 1024):
                texts = batch["text"].to_pylist()
                found = kinds_of(texts)
                texts = [clean(t, {KINDS[k] for k in np.flatnonzero(f)}) if t and f.any() else t for t, f in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], ["id", "text"])

    dirty = rows.where(candidate(F.col("text"))).mapInArrow(convert, rows.schema)
    return dirty.unionByName(rows.where(~candidate(F.col("text"))))
