"""Language identification by a linear-chain conditional random field over words.

Each word's features (whole word if in the lexicon, prefixes and suffixes,
character n-grams) give a score for each language; learned transitions join
neighbouring words, and forward-backward gives each word's distribution in
code-switched text. A document's language is the one with the largest share of
its words, its score that share. A run of more than LONGEST letters (text
without spaces) is read as several words.

The model is fitted on the driver on a bounded sample of labelled rows
(SAMPLE_DOCS for each language, fewer if there are more than 64, by a hash of
the id; every label is learned), from which code-switched sequences are drawn so that transitions are learned.
Prediction reads whole texts: long texts are cut in chunks whose transfer
matrices carry the exact messages from chunk to chunk.

Null texts and texts without a letter give `und` with score 0. Without labelled
rows every document is `und`. An empty table gives an empty result. Repeated rows
are each predicted. The columns to keep are untouched; the two new ones may be
named otherwise where they would clash, and clashing names raise an error.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import in_parts, process_cache, small_batches, trim

SAMPLE_DOCS = 400
SAMPLE_ROWS, LEAST_DOCS = 64 * SAMPLE_DOCS, 8
DIMENSIONS = 1 << 17
CHUNK = 128
LONGEST = 40
MAX_WORDS = 400_000
PART_ROWS, PART_BYTES = 1000, 4 << 20
UNKNOWN = "und"



def _numbers() -> str:
    """A character class of what \\w takes besides letters, decimal digits and _ (number letters, fractions, powers)."""
    found = [k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k)) in ("Nl", "No")]
    ranges, last = [], None
    for k in found:
        if last is not None and k == last + 1:
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
        last = k
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_WORD = re.compile(f"[^\\W\\d_{_numbers()}]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; longer ones as pieces of LONGEST letters that share two, so that no n-gram is missed."""
    words = _WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[k : k + LONGEST] for w in words for k in range(0, max(1, len(w) - 2), LONGEST - 2)]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # DIMENSIONS x labels
    transitions: np.ndarray  # labels x labels, from row to column
    lexicon: frozenset[str]


def features_of(word: str, lexicon: frozenset[str]) -> list[int]:
    """Indices of a word's features; long words give more n-grams, so scores are averaged by the caller's weights."""
    n = len(word)
    framed = f"^{word}$"
    names = [f"p{word[:k]}" for k in range(1, min(4, n) + 1)] + [f"s{word[-k:]}" for k in range(1, min(4, n) + 1)]
    names += {framed[k : k + 2] for k in range(len(framed) - 1)}
    names += {framed[k : k + 3] for k in range(len(framed) - 2)}
    if word in lexicon:
        names += [f"w{word}"]
    return [zlib.crc32(x.encode()) % DIMENSIONS for x in names]


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Scores of distinct words for each language."""
    lists = [features_of(w, model.lexicon) for w in words]
    flat = np.array([i for x in lists for i in x], np.int64)
    starts = np.cumsum([0, *[len(x) for x in lists[:-1]]])
    return np.add.reduceat(model.weights[flat], starts, axis=0) if words else np.zeros((0, len(model.labels)))


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, chunk: int = CHUNK, messages: bool = False):
    """Each word's distribution; scores holds the sequences one after another, each of at least one word.

    With messages also the forward messages (a word's own score in them) and the
    backward ones (the words after it), each up to a factor.

    Chunks are sorted by length, so step t touches the first chunks only. The
    state before a sequence is uniform.
    """
    k = scores.shape[1]
    e = np.exp(scores - scores.max(1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    counts = -(-lengths // chunk)
    sequence = np.repeat(np.arange(len(lengths)), counts)
    first_chunk = np.concatenate([[0], np.cumsum(counts)[:-1]])
    number = np.arange(len(sequence)) - first_chunk[sequence]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[sequence] + number * chunk
    sizes = np.minimum(chunk, lengths[sequence] - number * chunk)
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    steps = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]  # chunks longer than t
    several = counts.max(initial=0) > 1
    into = np.full((len(order), k), 1.0 / k)
    out = np.ones((len(order), k))
    if several:
        m = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
        for t in range(steps):
            n = active[t]
            x = (m[:n] @ a) * e[begin[:n] + t][:, None, :]
            m[:n] = x / x.sum((1, 2), keepdims=True)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))  # of each chunk in the sorted order
        for j in range(1, int(counts.max())):
            some = first_chunk[counts > j] + j
            x = np.einsum("nk,nkl->nl", into[place[some - 1]], m[place[some - 1]])
            into[place[some]] = x / x.sum(1, keepdims=True)
        for j in range(int(counts.max()) - 2, -1, -1):
            some = first_chunk[counts > j + 1] + j
            x = np.einsum("nkl,nl->nk", m[place[some + 1]], out[place[some + 1]])
            out[place[some]] = x / x.sum(1, keepdims=True)
    alphas = np.empty_like(e)
    state = into
    for t in range(steps):
        n = active[t]
        x = (state[:n] @ a) * e[begin[:n] + t]
        x /= x.sum(1, keepdims=True)
        alphas[begin[:n] + t] = x
        state[:n] = x
    state = out
    forward = alphas.copy() if messages else None
    betas = np.empty_like(e) if messages else None
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        if messages:
            betas[at] = state[:n]
        x = alphas[at] * state[:n]
        alphas[at] = x / x.sum(1, keepdims=True)
        x = (e[at] * state[:n]) @ a.T
        state[:n] = x / x.sum(1, keepdims=True)
    return (alphas, forward, betas) if messages else alphas


def pair_marginals(scores: np.ndarray, forward: np.ndarray, betas: np.ndarray, transitions: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The joint distribution of the words at and at + 1: forward message, transition, score, backward message."""
    e = np.exp(scores[at + 1] - scores[at + 1].max(1, keepdims=True))
    pair = forward[at][:, :, None] * np.exp(transitions - transitions.max()) * (e * betas[at + 1])[:, None, :]
    return pair / pair.sum((1, 2), keepdims=True)


def fit(samples: list[tuple[str, str]], sequences: int = 2400, epochs: int = 2, seed: int = 3) -> Model | None:
    """A model from (text, language) pairs: gradient ascent on the likelihood of sequences drawn from one to three texts."""
    by: dict[str, list[list[str]]] = {}
    for text, label in samples:
        if words := words_of(text):
            by.setdefault(label, []).append(words)
    labels = sorted(by)
    if not labels:
        return None
    counts = Counter(w for docs in by.values() for words in docs for w in set(words))
    lexicon = frozenset(w for w, n in counts.items() if n >= 3)
    rng = np.random.default_rng(seed)
    k = len(labels)
    sequences = max(sequences, 40 * k)
    model = Model(labels, np.zeros((DIMENSIONS, k)), np.zeros((k, k)), lexicon)
    drawn = []
    for _ in range(sequences):
        words, marks = [], []
        for _ in range(int(rng.integers(1, 4))):
            label = int(rng.integers(k))
            docs = by[labels[label]]
            doc = docs[int(rng.integers(len(docs)))]
            at, n = int(rng.integers(len(doc))), int(rng.integers(4, 24))
            piece = doc[at : at + n]
            words += piece
            marks += [label] * len(piece)
        drawn.append((words, marks))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in drawn for w in words))}
    lists = [features_of(w, lexicon) for w in vocabulary]
    flat = np.array([i for x in lists for i in x], np.int64)
    widths = np.array([len(x) for x in lists])
    heads = np.concatenate([[0], np.cumsum(widths)[:-1]])
    word_grad = np.full((DIMENSIONS, k), 1e-8)
    pair_grad = np.full((k, k), 1e-8)
    for _ in range(epochs):
        for b in range(0, sequences, 120):
            part = drawn[b : b + 120]
            ids = np.array([vocabulary[w] for words, _ in part for w in words])
            marks = np.array([m for _, ms in part for m in ms])
            lengths = np.array([len(words) for words, _ in part])
            used, where = np.unique(ids, return_inverse=True)
            index = np.concatenate([flat[heads[u] : heads[u] + widths[u]] for u in used])
            scores = np.add.reduceat(model.weights[index], np.concatenate([[0], np.cumsum(widths[used])[:-1]]), axis=0)[where]
            after, forward, betas = forward_backward(scores, lengths, model.transitions, messages=True)
            gap = np.eye(k)[marks] - after
            per_word = np.stack([np.bincount(where, gap[:, c], len(used)) for c in range(k)], 1)
            spread = np.repeat(per_word, widths[used], axis=0)
            grad = np.stack([np.bincount(index, spread[:, c], DIMENSIONS) for c in range(k)], 1)
            word_grad += grad**2
            model.weights += 0.3 * grad / np.sqrt(word_grad)
            # transitions: observed less expected pairs within sequences
            ends = np.cumsum(lengths) - 1
            inner = np.ones(len(ids), bool)
            inner[ends] = False
            at = np.flatnonzero(inner)
            pair = pair_marginals(scores, forward, betas, model.transitions, at)
            seen = np.zeros((k, k))
            np.add.at(seen, (marks[at], marks[at + 1]), 1)
            step = seen - pair.sum(0)
            pair_grad += step**2
            model.transitions += 0.3 * step / np.sqrt(pair_grad)
    model.weights = model.weights.astype(np.float32)
    return model


def sample_labelled(docs: DataFrame, eligible, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", per_label: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """About per_label rows of each label (or its part of SAMPLE_ROWS, LEAST_DOCS at least), at most twice as many, chosen by a hash of the id; never none."""
    share = F.pmod(F.xxhash64(F.lit(11), F.col(id_column)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = docs.where(eligible & F.col(label_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(text_column).alias("text"), F.col(label_column).alias("label"), share.alias("share"))
    counts = rows.groupBy("label").agg(F.count("*"), F.min("share")).collect()
    if not counts:
        return []
    per_label = min(per_label, max(LEAST_DOCS, SAMPLE_ROWS // len(counts)))
    bounds = docs.sparkSession.createDataFrame([(label, max(least, per_label / n)) for label, n, least in counts], "label string, bound double")
    found = rows.join(F.broadcast(bounds), "label").where("share <= bound").select("text", "label").limit(2 * per_label * len(counts)).collect()
    return sorted((r[0], r[1]) for r in found)


def _predict(model: Model | None, text_column: str, names: list[str], new: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("language")
        if cache.get("crf_of") != token:
            cache.update(crf_of=token, crf_words={}, crf_scores=[])
        index: dict[str, int] = cache["crf_words"]
        table = cache["crf_scores"]

        def part_of(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [words_of(x) for x in part.column(text_column).to_pylist()]
            labels, shares = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, x in enumerate(texts) if x and model]
            if rows:
                if len(index) > MAX_WORDS:
                    index.clear()
                    table.clear()
                unseen = list(set().union(*[texts[i] for i in rows]) - index.keys())
                if unseen:
                    index.update(zip(unseen, range(len(index), len(index) + len(unseen)), strict=True))
                    table.extend(emissions(unseen[k : k + 20_000], model) for k in range(0, len(unseen), 20_000))
                if len(table) > 1:
                    table[:] = [np.concatenate(table)]
                lengths = np.array([len(texts[i]) for i in rows])
                ids = np.fromiter((i for r in rows for i in map(index.__getitem__, texts[r])), np.int64, int(lengths.sum()))
                after = forward_backward(table[0][ids], lengths, model.transitions)
                share = np.add.reduceat(after, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / lengths[:, None]
                best = share.argmax(1)
                for r, b, s in zip(rows, best.tolist(), share.max(1).tolist(), strict=True):
                    labels[r], shares[r] = model.labels[b], min(1.0, s)
            return pa.record_batch([*[part.column(n) for n in names], pa.array(labels, pa.string()), pa.array(shares, pa.float64())], names=[*names, *new])

        for batch in batches:
            for part in in_parts(batch, [text_column], rows_at_once, PART_BYTES):
                yield part_of(part)
        trim()

    rows_at_once = max(1, min(PART_ROWS, PART_ROWS * 64**2 // len(model.labels) ** 2)) if model else PART_ROWS  # chunks hold labels x labels numbers
    token = zlib.crc32(model.weights.tobytes()) if model else 0
    return run


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_column: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns to keep and two new ones: language and score. The model is read by each task; its size is DIMENSIONS for each label."""
    if len({x.lower() for x in [*keep, *names]}) < len(keep) + 2:
        raise ValueError(f"column names clash: {[*keep, *names]}")
    small_batches(docs.sparkSession)
    sent = text_column  # once, even if it is kept
    rows = docs.select(*keep)
    if text_column not in keep:
        while sent.lower() in {x.lower() for x in keep}:
            sent += "_"
        rows = docs.select(*keep, F.col(text_column).alias(sent))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInArrow(_predict(model, sent, keep, names), f"{fields}, `{names[0]}` string, `{names[1]}` double".lstrip(", "))
