"""Encoding of a whole corpus with a public byte-level BPE vocabulary, through a transducer lexicon.

1. One pass counts the pre-tokenizer's words over all texts (summed in each task, then by word).
2. The most frequent ``lexicon`` words are merged once and compiled into a minimal acyclic automaton:
   shared suffixes are one state, and the number of words that sort before a path is the index of its
   ids. The file goes to the shared folder and is memory-mapped by the workers of a node.
3. One pass encodes: the words of a block are looked up in the automaton all at once, byte by byte;
   a word that isn't there is merged exactly by the vocabulary's ranks.

Defined results: null and empty texts have no ids (an empty list); strings of special tokens are
ordinary text; every input row gives one row, repeated rows too; other columns are ignored.
"""

from __future__ import annotations

import base64
import io
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ..workspace import shared_dir
from .arrow import blocks

#: Fixed: the pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: a token's bytes in base64 and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by exact merging: the adjacent pair of least rank first, the leftmost of equals."""
    parts = [word[i: i + 1] for i in range(len(word))]
    if len(parts) > 256:
        return _merged_long(word, ranks)
    while len(parts) > 1:
        least, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (least is None or r < least):
                least, at = r, i
        if least is None:
            break
        parts[at: at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs, for words where scanning each time would be quadratic."""
    import heapq

    n = len(word)
    text: list[bytes | None] = [word[i: i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, word[i: i + 2]) for i in range(n - 1) if (r := ranks.get(word[i: i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if text[i] is not None else n
        if j >= n or text[i] + text[j] != pair:
            continue
        text[i], text[j] = pair, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            new = pair + text[after[i]]
            if (r := ranks.get(new)) is not None:
                heapq.heappush(heap, (r, i, new))
        if before[i] >= 0:
            new = text[before[i]] + pair
            if (r := ranks.get(new)) is not None:
                heapq.heappush(heap, (r, before[i], new))
    return [ranks[x] for x in text if x is not None]


class Lexicon:
    """A minimal acyclic automaton over bytes whose words are numbered in sorted order, with their ids."""

    NAMES = ("keys", "target", "skip", "final", "offsets", "ids")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def compiled(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Add the words in sorted order; a state that no later word can change is replaced by its equal."""
        ordered = sorted(entries)
        states: list[list] = [[False, {}]]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []
        last = b""

        def freeze(down: int) -> None:
            while len(path) > down:
                parent, byte, child = path.pop()
                form = (states[child][0], tuple(states[child][1].items()))
                states[parent][1][byte] = register.setdefault(form, child)

        for word in ordered:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            freeze(same)
            at = path[-1][2] if path else 0
            for byte in word[same:]:
                states.append([False, {}])
                states[at][1][byte] = len(states) - 1
                path.append((at, byte, len(states) - 1))
                at = len(states) - 1
            states[at][0] = True
            last = word
        freeze(0)
        number, todo = {0: 0}, [0]
        for s in todo:
            for child in states[s][1].values():
                if child not in number:
                    number[child] = len(number)
                    todo.append(child)
        below: dict[int, int] = {}
        stack = [(0, False)]
        while stack:
            s, ready = stack.pop()
            if ready:
                below[s] = int(states[s][0]) + sum(below[c] for c in states[s][1].values())
            elif s not in below:
                stack.append((s, True))
                stack += [(c, False) for c in states[s][1].values()]
        keys, target, skip = [], [], []
        for s in todo:
            before = int(states[s][0])
            for byte, child in sorted(states[s][1].items()):
                keys.append(number[s] << 8 | byte)
                target.append(number[child])
                skip.append(before)
                before += below[child]
        counts = [len(entries[w]) for w in ordered]
        return cls(
            keys=np.array(keys, np.int64), target=np.array(target, np.int32), skip=np.array(skip, np.int32), final=np.array([states[s][0] for s in todo], bool),
            offsets=np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), ids=np.fromiter(chain.from_iterable(entries[w] for w in ordered), np.int32, sum(counts)),
        )

    def dumped(self) -> bytes:
        """All arrays one after another, each a ``.npy`` image that starts at a multiple of 64."""
        out = io.BytesIO()
        for name in self.NAMES:
            np.lib.format.write_array(out, np.ascontiguousarray(getattr(self, name)))
            out.write(b"\0" * (-out.tell() % 64))
        return out.getvalue()

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The arrays of a dump as views of the mapped file."""
        whole = np.memmap(path, np.uint8, "r")
        arrays, at = {}, 0
        with open(path, "rb") as f:
            for name in cls.NAMES:
                f.seek(at)
                np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f)
                start, size = f.tell(), int(np.prod(shape)) * dtype.itemsize
                arrays[name] = whole[start: start + size].view(dtype)
                at = start + size + (-(start + size) % 64)
        return cls(**arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, or -1; all words take their next byte at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(lengths) - lengths
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        row, state, index, depth = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        while len(row):
            ended = lengths[row] == depth
            done = row[ended]
            good = self.final[state[ended]]
            out[done[good]] = index[ended][good]
            row, state, index = row[~ended], state[~ended], index[~ended]
            if not len(row):
                break
            key = state << 8 | raw[start[row] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            row, index, state = row[ok], index[ok] + self.skip[at[ok]], self.target[at[ok]].astype(np.int64)
            depth += 1
        return out

    def ids_of(self, index: int) -> list[int]:
        return self.ids[self.offsets[index]: self.offsets[index + 1]].tolist()


def _pattern():  # noqa: ANN202
    import regex

    return regex.compile(PATTERN)


def frequent_words(df: DataFrame, text_col: str, most: int) -> list[str]:
    """The ``most`` words of all texts that occur most often, ties in byte order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = _pattern().findall, Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(find(text))
            if len(seen) > 500_000:  # what a task holds stays bounded; the sums are the same
                yield _counted(seen)
                seen = Counter()
        if seen:
            yield _counted(seen)

    words = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in top.collect()]


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str, lexicon: int = 32_768) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each text by the vocabulary at ``ranks_path``.

    ``lexicon`` bounds the words that are compiled, and so what the driver holds.
    """
    spark = df.sparkSession
    ranks = read_ranks(ranks_path)
    entries = {(w := word.encode()): merged(w, ranks) for word in frequent_words(df, text_col, lexicon)}
    name = f"lexicon-{uuid.uuid4().hex}"
    target = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(Lexicon.compiled(entries).dumped()))
    out.close()
    spark.sparkContext.addFile(target)
    table = spark.sparkContext.broadcast(ranks)  # a vocabulary, its size is fixed

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _pattern().findall
        words = Lexicon.mapped(SparkFiles.get(name))
        known: dict[str, list[int]] = {}
        for whole in batches:
            for batch in blocks(whole, "text", 2048):
                found = [find(t) if t else [] for t in batch["text"].to_pylist()]
                new = list(set(chain.from_iterable(found)) - known.keys())
                raw = [w.encode() for w in new]
                for word, b, index in zip(new, raw, words.find(raw).tolist()):
                    known[word] = words.ids_of(index) if index >= 0 else merged(b, table.value)
                ids = [list(chain.from_iterable(map(known.__getitem__, x))) for x in found]
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])
                if len(known) > 300_000:
                    known.clear()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, f"doc_id {df.select(id_col).dtypes[0][1]}, ids array<int>")
