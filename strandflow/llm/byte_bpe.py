"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Each task cuts its documents into the pattern's matches and hands Spark one row
per block of documents (BLOCK_BYTES of text): the words that are new to the task
and, per document, the indices of its words. Spark folds the ranked merges over each word's
byte array (as the bytes' ids) beside what neighbours make, of which a merge
changes two. The ranks are literal arrays, since a map literal would be
searched from end to end: a left id's displacement and a right id lead to one
entry, which holds the left id again and the id that the two make. A last step
puts the ids of a document's words in order and decodes them: the concatenated
binary pieces of the ids. There is no shuffle: distinct words over the table would
have to go to their blocks and back, which writes more than the table's size. A
task holds TASK_BYTES of text, so that it meets few words that others fold too, and
at most MAX_WORDS distinct words; beyond that it starts anew.

The fold's work grows with the square of a word's length, so words of over LONGEST
bytes are merged by a heap over a linked list in the block's task instead, by the
same ranks and with the same result.

Null texts count as empty; an empty text has no ids. Repeated rows are each
encoded. An empty table gives an empty result. Other columns of the input are
ignored, whatever their names. A text may exceed a block; it is never cut.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import CUT, edges_of, small_batches, trim, words_of

BLOCK_BYTES = 128 << 10
#: Text of a task: a large task meets fewer new words than its parts would.
TASK_BYTES = 48 << 20
MAX_WORDS = 500_000
#: Bytes of a word that the fold merges; longer ones go to the heap.
LONGEST = 64
#: Ids take 16 bits; a look-up that finds no merge leaves more.
IDS = 1 << 16
#: An entry that differs from every left id above its lowest 16 bits, and the last element's upper bits.
EMPTY = 1 << 33
LAST = 1 << 60

#: Letters below are letters in every version of Unicode.
OLD_LETTERS = "\u0530"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def word_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with \s read as Unicode's White_Space, as the tokenizer's library reads it."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def last_merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes piece.

    Merges inside a token's bytes go in the same order wherever it stands, so no
    other two neighbours ever meet that would make the same token.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        pairs = [(ranks.get(a + b, EMPTY), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def rank_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Displacements of left ids, and entries left << 16 | made: that of two neighbours is at displacement + right.

    Rows (the right ids of one left id) are laid over each other, the widest
    first, each at the first displacement where it meets no other.
    """
    if max(ranks.values()) >= IDS:
        raise ValueError("ids over 16 bits")
    rows: dict[int, list[tuple[int, int]]] = {}
    for piece, made in ranks.items():
        if len(piece) > 1:
            left, right = last_merge(piece, ranks)
            rows.setdefault(ranks[left], []).append((ranks[right], made))
    used = np.zeros(4 * IDS, bool)
    entries = np.full(4 * IDS, EMPTY, np.int64)
    moved = [0] * (max(ranks.values()) + 1)
    last, start, wide = 0, 0, 1 << 30
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        right, made = (np.array(x) for x in zip(*row, strict=True))
        if len(right) < wide:  # what has no room for its first id stays so for rows as wide
            start, wide = 0, len(right)
        at = start
        while True:
            free = np.flatnonzero(~used[(at + np.arange(4096))[:, None] + right[None, :]].any(1)) if len(right) > 1 else np.flatnonzero(~used[at + right[0] : at + right[0] + 4096])
            if len(free):
                break
            at += 4096
        at += int(free[0])
        start = at if len(right) > 4 else max(0, at - IDS // 2)
        used[at + right] = True
        entries[at + right] = left << 16 | made
        moved[left], last = at, max(last, at)
    return moved, entries[: last + IDS].tolist()


def rank_literals(ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """rank_table() as arrays that Spark folds into literals."""
    moved, entries = rank_table(ranks)
    return F.from_json(F.lit(json.dumps(moved)), "array<bigint>"), F.from_json(F.lit(json.dumps(entries)), "array<bigint>")


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by a heap of neighbours over a linked list, for words of any length."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = [(ranks[x], i) for i in range(len(parts) - 1) if (x := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j == len(parts) or ranks.get(parts[i] + parts[j]) != rank:
            continue  # one of the two is merged already
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = k = after[j]
        if k < len(parts):
            before[k] = i
            if (r := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i))
        if (k := before[i]) >= 0 and (r := ranks.get(parts[k] + parts[i])) is not None:
            heapq.heappush(heap, (r, k))
    return [ranks[x] for x in parts if x is not None]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas are interpreted, so a repeated expression is repeated work."""
    return F.element_at(F.transform(F.array(value), body), 1)


def encode_word(word: Column, moved: Column, entries: Column) -> Column:
    """Fold the ranked merges over one word, an array of its bytes' ids, to the array of its ids.

    An element holds an id in its lowest 16 bits, where it starts in the next 8,
    and above them what it makes with the next one (IDS or more: nothing). A step
    takes the least element, which is the first of the lowest rank, drops the next
    and looks up the new id's two neighbours. (No array_position: it leaves its
    loop by an exception.) A negative word (ids as -1 - id) is merged already.
    """

    def made(left: Column, right: Column) -> Column:
        found = F.get(entries, (F.get(moved, left.cast("int")) + right).cast("int")).bitwiseXOR(F.shiftleft(left, 16))
        return F.shiftleft(found, 24)

    def id_of(x: Column) -> Column:
        return x.bitwiseAND(IDS - 1)

    def merge(q: Column, low: Column) -> Column:
        new = F.shiftright(low, 24)
        place = low.bitwiseAND(255 << 16).bitwiseOR(new)

        def moved_on(kept: Column) -> Column:
            def changed(x: Column, i: Column) -> Column:
                after = F.get(kept, i + 1)
                joined = F.when(after.isNull(), place.bitwiseOR(LAST)).otherwise(place.bitwiseOR(made(new, id_of(after))))
                return F.when(x == low, joined).when(after.eqNullSafe(low), x.bitwiseAND((1 << 24) - 1).bitwiseOR(made(id_of(x), new))).otherwise(x)

            return F.transform(kept, changed)

        return _let(F.filter(q, lambda x, i: ~F.get(q, i - 1).eqNullSafe(low)), moved_on)

    def step(q: Column, _: Column) -> Column:
        return _let(F.array_min(q), lambda low: F.when(low >= IDS << 24, q).otherwise(merge(q, low)))

    def begin(x: Column, i: Column) -> Column:
        pair = F.when(i == F.size(word) - 1, F.lit(LAST)).otherwise(made(x, F.get(word, i + 1)))
        return pair.bitwiseOR(F.shiftleft(i.cast("long"), 16)).bitwiseOR(x)

    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(word), F.lit(2))), F.transform(word, begin), step, lambda q: F.transform(q, id_of))
    return F.when(F.get(word, F.lit(0)) < 0, F.transform(word, lambda x: -1 - x)).otherwise(folded)


def _taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of values, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Decoder:
    """Ids to bytes: their binary pieces, concatenated."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.sizes = np.array([len(x) for x in pieces])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.frombuffer(b"".join(pieces), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and how many each id gave."""
        sizes = self.sizes[ids]
        return _taken(self.values, self.starts[ids], sizes), sizes


def _blocks(pattern: str, ranks: dict[bytes, int], id_column: str, text_column: str):
    """Documents to blocks: new distinct words, and per document the words' indices in the task's list."""
    byte_ranks = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = word_pattern(pattern).findall
        fresh, ids, rows, held, start, count = [], [], [], 0, 0, 0
        plain = match(" aB\u00e9\u0436") == [" aB\u00e9\u0436"]  # the pattern takes a space and letters whole
        single = edges_of(lambda x: map(len, match(x)))

        class Chunks(dict):
            """The number of a chunk's word, for chunks of one; those of a text's words_of, and other words after a \\0."""

            def letters(self, chunk: str) -> bool:
                return plain and chunk.isalpha() and (chunk.isascii() or max(chunk) < OLD_LETTERS)

            def number(self, word: str) -> bytes:
                return self[word[1:] if word[0] == " " and self.letters(word[1:]) else "\0" + word]

            def __missing__(self, chunk: str) -> bytes:
                nonlocal count
                if chunk[0] == "\0":
                    word = chunk[1:]
                elif self.letters(chunk):
                    word = " " + chunk
                else:
                    found = match(chunk if chunk[0] == "\n" else " " + chunk)
                    numbers = b"".join(map(self.number, found))
                    if len(found) == 1:
                        self[chunk] = numbers
                    return numbers
                fresh.append(word)
                self[chunk] = at = count.to_bytes(4, "little")
                count += 1
                return at

        chunks = Chunks()

        def row(text: str) -> bytes:
            pieces = words_of(text) if single else None
            if pieces is None:
                first, *rest = CUT.split(text)
                last = b"".join([b"".join(map(chunks.number, match(" " + x))) if x[0] in "\0\n" else chunks[x] for x in rest])
            else:
                first, *rest = pieces
                last = b"".join(map(chunks.__getitem__, rest))
            return b"".join(map(chunks.number, match(first))) + last

        def block() -> pa.RecordBatch:
            spelled = [w.encode() for w in fresh]
            if max(map(len, spelled), default=0) > LONGEST:
                parts = [byte_ranks[np.frombuffer(w, np.uint8)] if len(w) <= LONGEST else -1 - np.array(merge_long(w, ranks)) for w in spelled]
                ends, values = np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
            else:
                ends, values = np.cumsum([0, *map(len, spelled)]), byte_ranks[np.frombuffer(b"".join(spelled), np.uint8)]
            listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
            docs = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["id", "words"])
            return pa.record_batch(
                [pa.array([start], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(spelled)], pa.int32()), listed), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), docs)],
                names=["start", "words", "docs"],
            )

        for batch in batches:
            for key, text in zip(batch.column(id_column), batch.column(text_column), strict=True):
                ids.append(key.as_py())
                text = text.as_py()
                rows.append(row(text) if text else b"")
                held += len(text or "") + 64
                if held >= BLOCK_BYTES:
                    yield block()
                    fresh, ids, rows, held, start = [], [], [], 0, count
                    if count >= MAX_WORDS:
                        chunks.clear()
                        start = count = 0
        if ids:
            yield block()
        trim()

    return run


def _assemble(ranks: dict[bytes, int]):
    """Words' ids, put in each document's order, and their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(ranks)
        # of the task's words: ids one after another, and where each starts
        known, starts, used, held = np.empty(1 << 16, np.uint16), np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                start, words, docs = batch.column("start")[k].as_py(), batch.column("ids")[k].values, batch.column("docs")[k].values
                if start == 0:
                    used = held = 0
                if len(words):
                    ends, new = held + np.cumsum(np.diff(words.offsets.to_numpy()), dtype=np.int64), words.flatten().to_numpy(zero_copy_only=False).astype(np.uint16)
                    known, starts = _room(known, held + len(new)), _room(starts, used + len(ends) + 1)
                    known[held : held + len(new)], starts[used + 1 : used + len(ends) + 1] = new, ends
                    held, used = held + len(new), used + len(ends)
                keys, rows = docs.field("id"), docs.field("words")
                at = np.frombuffer(rows.buffers()[2], np.uint32) if rows.buffers()[2] else np.empty(0, np.uint32)
                edges = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64) // 4
                most = 1 << 18  # words at once; a longer document goes alone
                first = 0
                while first < len(rows):
                    last = max(first + 1, int(np.searchsorted(edges, edges[first] + most, side="right")) - 1)
                    w = at[edges[first] : edges[last]]
                    sizes = starts[w + 1] - starts[w]
                    ids = _taken(known, starts[w], sizes)
                    text, each = decode(ids)
                    tokens = np.concatenate([[0], np.cumsum(sizes)])[edges[first : last + 1] - edges[first]]
                    bytes_to = np.concatenate([[0], np.cumsum(each)])[tokens]
                    yield pa.record_batch(
                        [keys[first:last], pa.array(np.diff(tokens), pa.int64()), _binary(tokens * 4, ids.astype("<u4")), _binary(bytes_to, text)],
                        names=["doc_id", "n_tokens", "ids", "decoded"],
                    )
                    first = last
        trim()

    return run


def _room(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.empty(max(len(x) // 2, size - len(x)), x.dtype)])


def _binary(edges: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded bytes of each document."""
    small_batches(docs.sparkSession)
    ranks = read_ranks(rank_path)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(-(-size // TASK_BYTES), docs.sparkSession.sparkContext.defaultParallelism))
    blocks = rows.mapInArrow(_blocks(pattern, ranks, "doc_id", "text"), "start long, words array<array<bigint>>, docs array<struct<id:long,words:binary>>")
    moved, entries = rank_literals(ranks)
    coded = blocks.select("start", F.transform("words", lambda w: encode_word(w, moved, entries)).alias("ids"), "docs")
    return coded.mapInArrow(_assemble(ranks), "doc_id long, n_tokens long, ids binary, decoded binary")
