"""First-fit decreasing packing with a tournament tree of bin capacities.

Documents become ids, are cut at the sequence length, and are dealt into
randomised groups by a seeded hash of their id; each group packs by itself:
pieces by falling length (ties by document and start), each into the first bin
that still has room. The tree holds the largest free capacity below each node,
so a piece finds its bin in log2(bins) steps. Only lengths and checksums leave
the tokenizing task; ids and texts are never shuffled.

The number of groups follows the number of documents (GROUP_DOCS each), so a
group's memory is bounded at every input size. Only a group's last bins are
left part empty, and small pieces fill the gaps of large ones.

Null texts count as empty and give the end id alone. Repeated rows are separate
documents: `row` in the output numbers the rows of one id and content. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import CUT, MARKS, edges_of, in_parts, process_cache, small_batches, words_of

GROUP_DOCS = 16_384
MAX_WORDS = 900_000
PART_BYTES = 4 << 20
#: How a byte-level vocabulary writes the space and the line feed.
STARTS = ("\u0120", "\u010a")


class Encoder(dict):
    """Ids of a byte-level BPE tokenizer, a word at a time; as a dict, the words known so far.

    A space between two characters that are not white space always starts a new
    match of the tokenizer's pattern, so the ids of a text are those of its
    words, each but the first with its space. Nor do letters and a mark after them
    share a match, or a line feed and the letters beside it. A text's unknown words
    go to the tokenizer in one call, and its ids are cut where a token starts with
    the space or the line feed. Texts that hold an added token go to the tokenizer
    whole. At most MAX_WORDS words are kept.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda x: []
        self.single = edges_of(lambda x: [b - a for _, (a, b) in split(x)]) and not any(" " in x or "\n" in x for x in self.added)
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith(STARTS)]] = True
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(("\0" + x, self.whole(x)) for x in MARKS)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[str]) -> None:
        """The ids of unknown words without white space inside, by one call."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join([w if w[0] == "\n" else " " + w for w in words])], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.starts[ids]) * 4
        if len(cuts) == len(words) and not cuts[0]:  # else they are met one by one
            raw, cuts = ids.tobytes(), cuts.tolist()
            self.update(zip(words, map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)])), strict=True))

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.whole(word if word[0] == "\n" else " " + word)
        return ids

    def text(self, text: str) -> bytes:
        if not text or any(x in text for x in self.added):
            return self.whole(text)
        if len(self) > MAX_WORDS:
            self.reset()
        words = words_of(text) if self.single else None
        if words is None:
            first, *rest = CUT.split(text)
            return self.whole(first) + b"".join([self.whole(" " + w) if w.isspace() or w[0] in "\0\n" else self[w] for w in rest])
        first, *rest = words
        found = list(map(self.get, rest))
        if None in found:
            self.learn(list({w for w, ids in zip(rest, found, strict=True) if ids is None}))
            found = [self[w] if ids is None else ids for w, ids in zip(rest, found, strict=True)]
        return self.whole(first) + b"".join(found)


def encoder(path: str) -> Encoder:
    """The worker's encoder: the words learnt in one task serve the next."""
    cache = process_cache("packing")
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def _pieces(path: str, length: int, end: int, id_column: str, text_column: str):
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).text
        for batch in batches:
            for part in in_parts(batch, [text_column], 256, PART_BYTES):
                out: list[tuple] = []
                for key, text in zip(part.column(id_column).to_pylist(), part.column(text_column).to_pylist(), strict=True):
                    ids = ids_of(text or "") + last
                    n, mark = len(ids) // 4, zlib.crc32(ids)
                    out += [(key, mark, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
                columns = zip(*out, strict=True)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "mark", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths must fall. The tree's leaves are the bins' free capacities."""
    n = len(lengths)
    size = 1
    while size < max(1, n):
        size *= 2
    tree = [capacity] * (2 * size)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, need in enumerate(lengths.tolist()):
        at = 1
        while at < size:
            at *= 2
            if tree[at] < need:
                at += 1
        free = tree[at]
        bins[k], offsets[k] = at - size, capacity - free
        tree[at] = free - need
        at //= 2
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            most = left if left > right else right
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
    return bins, offsets


def _pack_group(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        key, none = group.column("doc_id").fill_null(0).to_numpy(), group.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        mark, start, length = (group.column(n).to_numpy() for n in ("mark", "start", "length"))
        # rows that repeat an id and a content, numbered
        order = np.lexsort((start, mark, key, none))
        same = np.concatenate([[False], *[np.all([np.diff(x[order]) == 0 for x in (start, mark, key, none.astype(np.int8))], axis=0)]]) if len(order) else np.empty(0, bool)
        at = np.arange(len(order))
        row = np.empty(len(order), np.int64)
        row[order] = at - np.maximum.accumulate(np.where(same, 0, at)) + 1
        order = np.lexsort((start, row, mark, key, none, -length))
        bins, offsets = first_fit_decreasing(length[order], capacity)
        out = group.take(pa.array(order))
        sequence = (out.column("group").to_numpy() << 32) + bins
        columns = [out.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        return pa.table([*columns, pa.array(sequence), pa.array(offsets), pa.array(row[order])], names=[x.split()[0] for x in PACKED.split(", ")])

    return run


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"


def pack(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, end: int = 1, seed: int = 7, group_docs: int = GROUP_DOCS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each piece: where it starts in its document and where it lies in which sequence."""
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    pieces = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        _pieces(tokenizer_path, length, end, "doc_id", "text"), "doc_id long, mark long, start long, length long, ids_crc32 long, doc_tokens long"
    )
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.lit(groups)))
    return pieces.groupBy("group").applyInArrow(_pack_group(length), PACKED)
