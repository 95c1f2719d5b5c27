"""Texts cut off by field limits or broken transfers.

Hidden limits. A field that holds at most L units leaves a pile of texts of exactly that length, in
the unit the field counts. Each text's length is recomputed as code points, UTF-8 bytes, UTF-16 units,
with entities escaped, as a JSON string and with line ends converted; per source and measure, a length
that holds far more texts than its neighbours exposes a limit. Groups are (source, measure, length),
counted with partial sums, so a hot source is no hot task; texts are never shuffled.

Endings. Whole closing blocks are taken off a text's end line by line, and what is left must close its
last sentence. Three results: ``closed``, ``open`` (inside a word, number, sign or sentence), or
``unsure`` - an end that looks closed but may be the middle of something: an amount or an abbreviation
before the last point, or a last list item, name or label that shows no end. Limits decide those:
an unsure text is cut if, and only if, its length is one of its source's limits.

One pass over the texts gives lengths and endings; that small table is written once, and the rest is
relational work on it.

Defined results: null and blank texts are no cases and count in no share; repeated rows count each;
a null source is a source of its own; columns other than the three named are ignored; an empty table
gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..workspace import written
from .arrow import blocks
from .wordhash import buffers

MEASURES = ("chars", "utf8", "utf16", "entities", "json", "crlf", "lf")
CLOSED, UNSURE, OPEN = 0, 1, 2

#: White space and signs of no width; a text of nothing else is blank.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"

_W = r"[\p{L}\p{M}'’-]+"
_CAP = r"\p{Lu}[\p{L}\p{M}'’-]*"
_LOW = r"[\p{Ll}\p{M}'’-]+"
# Last lines that are whole in themselves: a sign or word of end, tags, an address, a counted page, a date line,
# an attestation, a row with its amount, a bracketed note with a number, a numbered reference.
_WHOLE = (
    r"[^\p{L}\p{N}.?!。！？…]{1,80}",
    r"(?:THE )?END(?: OF [A-Z ]+)?|(?i:fin|the end)",
    r"(?:#[\p{L}\p{N}_]+\s*)+",
    r"(?:https?://|www\.)\S+\.\S+/\S*",
    rf"(?:{_W} ){{0,2}}{_CAP} \d+ \p{{Ll}}{{1,3}} \d+",
    rf"(?:{_CAP} ?){{1,3}}, {_CAP} \d{{1,2}}, \d{{4}}",
    rf"{_CAP}: {_CAP} {_CAP}, {_CAP}",
    rf"{_CAP}(?: {_W})*\s{{2,}}[$€£]?[\d,.]*\d",
    r"\((?=[^()]*\d)[^()]*(?:\([^()]*\)[^()]*)*\)",
    r"(?:Ref|Reference|No|File|Docket|Case)\.? [\dA-Z]+(?:[-/][\dA-Z]+)*",
)
# Last lines that may go on: a list item, a labelled list of words, a label with a number, and the second line of a name and its office.
_ITEM = rf"[-*•] {_W}(?: {_W}){{0,3}}"
_GOES_ON = (_ITEM, rf"{_CAP}(?: {_LOW}){{0,3}}: {_LOW}(?:, {_LOW})*", rf"(?:{_W} ){{0,2}}{_CAP} \d+")
_NAME, _OFFICE = rf"{_CAP} {_CAP}", rf"{_CAP}(?: {_W}){{1,3}}"
_CLOSING = r"[.?!。！？]['\"”’»)\]]*$"
# A point after one of these closes nothing; neither does an ellipsis, a bracketed mark or a bare section number.
_NO_CLOSE = r"(?:(?:^|[\s(“\"])(?:U\.S\.(?:C\.)?|[A-Z]\.|No\.|Sec\.|§|Pub\.|L\.|Mr\.|Mrs\.|Dr\.|v\.|art\.|Art\.|núm\.|p\.|pp\.)|\.\.\.|…|\[[^\]]*\]|\[?\(?(?:more|truncated|continued)\)?\]?\.*|(?:^|\n)\s*(?:Sec|SEC|Section|Art)\.? \d+\.)$"
# A point after one of these may close a sentence or not: an amount, a common abbreviation.
_MAYBE = r"(?:[$€£]\s?\d[\d,]*|(?:^|[\s(])(?:Inc|Co|Corp|Ltd|St|Mt|Jr|Sr|Rep|Sen|Gov|Gen|Hon|Ave|Fig|Vol|approx|est|dept|vs|cf|etc|ch|para|i\.e|e\.g))\.$"


class _Rules:
    """The compiled patterns, once in each worker."""

    made: _Rules | None = None

    def __init__(self) -> None:
        import regex

        line = lambda *p: regex.compile("|".join(f"(?:{x})" for x in p))
        self.whole, self.goes_on, self.item = line(*_WHOLE), line(*_GOES_ON), line(_ITEM)
        self.name, self.office = line(_NAME), line(_OFFICE)
        self.closing, self.no_close, self.maybe = regex.compile(_CLOSING), regex.compile(_NO_CLOSE), regex.compile(_MAYBE)

    @classmethod
    def get(cls) -> _Rules:
        if cls.made is None:
            cls.made = cls()
        return cls.made

    def stripped(self, body: str) -> tuple[str, bool]:
        """(text without up to three closing blocks at its end, whether the last line is one that may go on)."""
        unsure = False
        for k in range(3):
            head, feed, line = body.rpartition("\n")
            line = line.strip(SPACE)
            if not feed:
                break
            head = head.rstrip(SPACE)
            if self.whole.fullmatch(line):
                body = head
                continue
            name_head, feed, name = head.rpartition("\n")
            if feed and self.name.fullmatch(name.strip(SPACE)) and self.office.fullmatch(line):
                body, unsure = name_head.rstrip(SPACE), unsure or k == 0
                continue
            if not self.goes_on.fullmatch(line):
                break
            while self.item.fullmatch(line):  # a list of any length is one block
                rest, feed, above = head.rpartition("\n")
                if not feed or not self.item.fullmatch(above.strip(SPACE)):
                    break
                head = rest.rstrip(SPACE)
            body, unsure = head, unsure or k == 0
        return body, unsure

    def ending(self, text: str) -> int | None:
        """CLOSED, UNSURE or OPEN; None for a blank text."""
        body = text.rstrip(SPACE)
        if not body:
            return None
        body, unsure = self.stripped(body)
        line = body[body.rfind("\n") + 1:]
        # the sentence's last signs stand within its last line and the line feed before it
        end = body[max(0, len(body) - len(line) - 1):]
        if not self.closing.search(end[-64:]) or self.no_close.search(end):
            return OPEN
        if line.count("“") > line.count("”") and text.count("“") > text.count("”"):
            return OPEN
        return UNSURE if unsure or self.maybe.search(end[-64:]) else CLOSED


def _table(weights: dict[str, int], base: int = 0) -> np.ndarray:
    out = np.full(256, base, np.int8)
    for signs, n in weights.items():
        for sign in signs:
            out[ord(sign)] += n
    return out


_CHARS = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int8)
_WIDE = np.array([b >= 0xF0 for b in range(256)], np.int8)
_ENTITY = _table({"&": 4, "<>": 3, '"': 5})
_JSON = _table({'"\\\n\r\t\b\f': 1})
_FEED = _table({"\n": 1})


def measured_lengths(column: pa.Array) -> dict[str, np.ndarray]:
    """Each text's length by each measure; one pass over the bytes for each kind of sign."""
    raw, offsets = buffers(column)

    def count(marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = count(_CHARS[raw])
    pair = np.zeros(len(raw), np.int8)
    if len(raw) > 1:
        pair[1:] = (raw[1:] == 10) & (raw[:-1] == 13)
        starts = offsets[:-1]
        pair[starts[starts < len(raw)]] = 0  # no pair spans two texts
    pairs = count(pair)
    return {
        "chars": chars, "utf8": np.diff(offsets), "utf16": chars + count(_WIDE[raw]), "entities": chars + count(_ENTITY[raw]),
        "json": chars + count(_JSON[raw]) + 2, "crlf": chars + count(_FEED[raw]) - pairs, "lf": chars - pairs,
    }


def measured(df: DataFrame, id_col: str | None, source: str, text: str) -> DataFrame:
    """([doc_id,] source, the lengths, ending) of each text that is not blank, as a table in the shared folder."""
    own = [F.col(id_col).alias("doc_id")] if id_col else []
    rows = df.where(F.col(text).isNotNull()).select(*own, F.col(source).alias("source"), F.col(text).alias("text"))
    names = [n for n, _ in rows.dtypes[:-1]]
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes[:-1]), *(f"{m} int" for m in MEASURES), "ending int"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _Rules.get()
        for whole in batches:
            for batch in blocks(whole, "text"):
                ends = pa.array([rules.ending(t) for t in batch["text"].to_pylist()], pa.int32())
                lengths = measured_lengths(batch["text"])
                out = pa.RecordBatch.from_arrays([*(batch[n] for n in names), *(pa.array(lengths[m].astype(np.int32)) for m in MEASURES), ends], [*names, *MEASURES, "ending"])
                yield out.filter(pc.is_valid(ends))

    return written(rows.mapInArrow(measure, schema), "truncation-measured")[0]


def _limits(rows: DataFrame, least: int, ratio: float) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES])).alias("m")
    counts = rows.select("source", each).groupBy("source", "m.measure", "m.length").agg(F.count("*").alias("texts"))
    # each length adds its count to the 20 around it: bounded work for each row, no window over a source
    near = counts.select("source", "measure", F.explode(F.array(*[F.col("length") + d for d in range(-10, 11) if d])).alias("length"), "texts").groupBy("source", "measure", "length").agg((F.sum("texts") / 20).alias("expected"))
    near = near.select(F.col("source").alias("s"), F.col("measure").alias("m"), F.col("length").alias("l"), "expected")
    piles = counts.where(F.col("texts") >= least)
    piles = piles.join(near, piles["source"].eqNullSafe(near["s"]) & (piles["measure"] == near["m"]) & (piles["length"] == near["l"]), "left")
    piles = piles.select("source", "measure", "length", "texts", F.coalesce("expected", F.lit(0.0)).alias("expected"))
    piles = piles.where(F.col("texts") >= ratio * F.greatest("expected", F.lit(0.5)))
    # a field's limit shows in related measures too: the one that explains most texts names the field's unit
    beside = Window.partitionBy("source").orderBy("length").rangeBetween(-2, 2)
    return piles.withColumn("_most", F.max("texts").over(beside)).where("texts = _most").drop("_most")


def limits(df: DataFrame, source: str, text: str, least: int = 20, ratio: float = 8.0) -> DataFrame:
    """(source, measure, length, texts, expected): lengths at which texts of a source pile up.

    A pile has at least ``least`` texts and ``ratio`` times the mean of the 20 lengths around it; of
    piles within two units of each other the highest counts, in each measure that has it.
    """
    return _limits(measured(df, None, source, text), least, ratio)


def _decided(rows: DataFrame, least: int, ratio: float) -> DataFrame:
    """``rows`` with ``at_limit`` and ``cut``."""
    found = _limits(rows, least, ratio)
    # at most 21 / ratio piles share a stretch of lengths, so limits are few for each source and measure
    hit = found.groupBy(F.col("source").alias("_source")).agg(F.collect_set(F.struct("measure", "length")).alias("_limits"))
    own = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES])
    out = rows.join(hit, rows["source"].eqNullSafe(hit["_source"]), "left").withColumn("at_limit", F.coalesce(F.arrays_overlap(own, F.col("_limits")), F.lit(False)))
    return out.withColumn("cut", (F.col("ending") == OPEN) | ((F.col("ending") == UNSURE) & F.col("at_limit")))


def truncated(df: DataFrame, id_col: str, source: str, text: str, least: int = 20, ratio: float = 8.0) -> DataFrame:
    """(doc_id, source, at_limit): the cut texts, and whether their length is one of their source's limits."""
    return _decided(measured(df, id_col, source, text), least, ratio).where("cut").select("doc_id", "source", "at_limit")


def truncation_share(df: DataFrame, source: str, text: str, least: int = 20, ratio: float = 8.0) -> DataFrame:
    """(source, texts, cut, share): of each source's texts that are not blank."""
    rows = _decided(measured(df, None, source, text), least, ratio)
    return rows.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
