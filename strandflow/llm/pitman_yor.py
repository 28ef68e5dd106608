"""A hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

The restaurant of a token is the word before it, whatever the vocabulary's size;
all of them share the root (the empty context) as their parent, whose base is
uniform over the known words and one unknown. A dish of a restaurant with c
customers at t tables sends t customers to the root.

A sweep draws the tables of each dish anew, with all its customers taken out and
seated given everyone else: the probability of t tables is S_d(c, t) (generalised
Stirling numbers) times that of t new tables in the restaurant and of t customers
more in the parent. Dishes of up to EXACT customers are drawn from this law itself,
larger ones from the normal law with its saddle point's mean and variance. Within a
sweep, all dishes see the restaurants' totals of the sweep before. Each draw's
random number is a hash of the context, the word and the sweep, so that neither
the order nor the layout of rows changes a score. Discounts come from the numbers
of dishes with one and two customers. After BURN_IN sweeps, the predictive
probabilities of SAMPLES sweeps are averaged; a text's score is the sum of their
logarithms.

Work is dealt out by word: a shard holds all customers of its words on both
levels, so the seating of a word needs nothing of other shards but the totals of
the restaurants, which are summed over the shards between sweeps in a table dealt
out by restaurant, from which each shard gets back its own; the root's totals are
seven numbers, on the driver. A sweep's seating is written, so none is run twice.

Tasks index blocks of documents and send each shard its tokens as compressed
arrays, once. Words that hold over 1 / HOT of a block's tokens are counted in the
block and scored there with probabilities that the shard returns, so a word with
a third of all tokens costs one number for each word before it in a block. Shards
return sums for each document, not tokens.

Null texts count as empty: the end alone. Rows with a null id are training rows.
Repeated rows are scored (and counted) each. Without training rows every word is
unknown and scores log10 of 1. An empty table gives an empty result. A text of any
length is scored whole; one that exceeds a block is a block. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import materialize, release, small_batches, trim

THETA = 1.0
BURN_IN, SAMPLES = 2, 3
EXACT = 128
#: Logarithms are summed in these parts of one: sums of whole numbers don't depend on their order, and are sent in few bytes.
SCALE = {"score": 1 << 24, "base": 1 << 30}
HOT = 512
BLOCK_BYTES = 12 << 20
SHARD_BYTES = 8 << 20
END = b"\n"  # no word: words have no white space

INDEX = (
    "shard int, block long, words binary, doc binary, word binary, contexts binary, context binary, hot_words binary, hot_word binary, hot_context binary, hot_count binary, "
    "ids array<long>, held binary, tokens binary, seen_doc binary, seen_word binary, seen_context binary, seen_count binary"
)
_ARRAYS = "words doc word contexts context hot_words hot_word hot_context hot_count".split()
_SEEN = "held tokens seen_doc seen_word seen_context seen_count".split()


def _pack(x: np.ndarray) -> bytes:
    """An array's bytes by their place in its numbers (the high ones compress), compressed."""
    import zstandard

    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return x.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard

    dtype = np.dtype(raw[:3].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[3:]), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def _differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype("<u8")


def _summed(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x.astype(np.int64))


def _record(names: list[str], rows: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "block": pa.int64(), "ids": pa.list_(pa.int64())}
    return pa.record_batch([pa.array([r.get(n) for r in rows], kinds.get(n, pa.binary())) for n in names], names=names)


def _index(shards: int, held_modulus: int, held_remainder: int):
    """Documents to one row for each shard of a block, and one (shard = shards + block's number, for itself) with its documents."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    class Words(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self)
            return n

    def block_rows(number: int, ids: list, texts: list[bytes]) -> list[dict]:
        import xxhash

        local = Words()
        end = local[END]
        streams, lengths = [], []
        for data in texts:
            parts = data.lower().split()
            streams.append(np.fromiter(map(local.__getitem__, parts), np.uint32, len(parts)))
            streams.append(np.array([end], np.uint32))
            lengths.append(len(parts) + 1)
        token = np.concatenate(streams)
        streams.clear()
        spelled = list(local)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, spelled), np.uint64, len(spelled))
        restaurants = (hashes >> np.uint64(1)).astype(np.int64)
        local.clear()
        spelled_count = len(spelled)
        spelled.clear()
        before = np.empty(len(token), np.uint32)
        before[0] = end
        before[1:] = token[:-1]  # the end of a document is what the next one starts after
        size = np.array(lengths)
        doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)
        counts = np.bincount(token, minlength=spelled_count)
        hot = counts * HOT > len(token)
        held = np.array([0 if i is None else zlib.crc32(str(i).encode()) % held_modulus == held_remainder for i in ids], np.uint8)
        of = (hashes % np.uint64(shards)).astype(np.int64)
        # words numbered by shard
        order = np.argsort(of, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = np.searchsorted(of[order], np.arange(shards + 1))
        cold = ~hot[token]
        ct, cd, cc = token[cold], doc[cold], before[cold]
        by = np.argsort(of[ct].astype(np.uint16 if shards < 1 << 16 else np.uint32), kind="stable")
        ct, cd, cc = ct[by], cd[by], cc[by]
        cuts = np.searchsorted(of[ct], np.arange(shards + 1))
        # hot words: (word, context) pairs of the block with their training counts, and the documents' counts of them
        ht, hd, hc = token[~cold].astype(np.int64), doc[~cold], before[~cold].astype(np.int64)
        pair, where = np.unique(ht * spelled_count + hc, return_inverse=True)
        train = np.bincount(where, held[hd] == 0, len(pair)).astype(np.uint32) if len(pair) else np.empty(0, np.uint32)
        pair_word, pair_context = pair // spelled_count, pair % spelled_count
        hot_order = np.argsort(of[pair_word], kind="stable")
        hot_first = np.searchsorted(of[pair_word][hot_order], np.arange(shards + 1))
        seen, seen_count = np.unique(hd.astype(np.int64) << np.int64(32) | where, return_counts=True)
        rows = []
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            mine = hot_order[hot_first[s] : hot_first[s + 1]]
            if a == b and not len(mine):
                continue
            here, at = np.unique(restaurants[np.concatenate([cc[a:b], pair_context[mine]])], return_inverse=True)
            d = 2 * cd[a:b].astype(np.int64) + held[cd[a:b]]  # the held flag goes in the lowest bit
            rows.append(
                {"shard": s, "block": number}
                | dict(
                    zip(
                        _ARRAYS,
                        map(
                            _pack,
                            (
                                hashes[order[first[s] : first[s + 1]]],
                                _narrow(np.diff(d, prepend=0)),
                                _narrow(rank[ct[a:b]] - first[s]),
                                _differences(here),
                                _narrow(at[: b - a]),
                                hashes[pair_word[mine]],
                                mine.astype("<u4"),
                                _narrow(at[b - a :]),
                                train[mine],
                            ),
                        ),
                        strict=True,
                    )
                )
            )
        own = {"held": held, "tokens": size.astype("<u4"), "seen_doc": (seen >> np.int64(32)).astype("<u4"), "seen_word": (seen & np.int64(0xFFFFFFFF)).astype("<u4")}
        own |= {"seen_count": seen_count.astype("<u4"), "seen_context": np.array([len(pair)], "<u4")}
        rows.append({"shard": shards + number % (1 << 30), "block": number, "ids": ids} | {k: _pack(v) for k, v in own.items()})
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 16
        ids, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                ids.append(key)
                texts.append(data)
                held += len(data) + 64
                if held >= BLOCK_BYTES:
                    yield _record(names, block_rows(number, ids, texts))
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield _record(names, block_rows(number, ids, texts))
        trim()

    return run


STATE = (
    "shard int, blocks array<long>, words binary, contexts binary, types_word binary, types_context binary, types_count binary, cuts binary, doc binary, type binary, hot_cuts binary, hot_type binary, hot_pair binary, "
    "block long, ids array<long>, held binary, tokens binary, seen_doc binary, seen_word binary, seen_context binary, seen_count binary"
)


def _build():
    """A shard's blocks to its types (word, word before) with training counts, and each token's type."""
    names = [x.split()[0] for x in STATE.split(", ")]

    def record(row: dict) -> pa.Table:
        kinds = {"shard": pa.int32(), "block": pa.int64(), "ids": pa.list_(pa.int64()), "blocks": pa.list_(pa.int64())}
        return pa.table([pa.array([row.get(n)], kinds.get(n, pa.binary())) for n in names], names=names)

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        if rows[0]["words"] is None:
            return pa.concat_tables([record({k: r[k] for k in ("shard", "block", "ids", *_SEEN)}) for r in rows])
        parts = [{k: _unpack(r[k]) for k in _ARRAYS} for r in rows]
        for p in parts:
            p["contexts"] = _summed(p["contexts"])
        words = np.unique(np.concatenate([np.concatenate([p["words"], p["hot_words"]]) for p in parts]))
        contexts = np.unique(np.concatenate([p["contexts"] for p in parts]))
        width = len(contexts)
        keys, docs, cuts, hot_keys, hot_pairs, hot_cuts, hot_counts = [], [], [0], [], [], [0], []
        for p in parts:
            at = np.searchsorted(words, p["words"])
            before = np.searchsorted(contexts, p["contexts"])
            keys.append(at[p["word"]] * width + before[p["context"]])
            docs.append(np.cumsum(p["doc"].astype(np.int64)))
            cuts.append(cuts[-1] + len(p["word"]))
            hot_keys.append(np.searchsorted(words, p["hot_words"]) * width + before[p["hot_context"]])
            hot_pairs.append(p["hot_word"])
            hot_counts.append(p["hot_count"])
            hot_cuts.append(hot_cuts[-1] + len(p["hot_word"]))
        sizes = [len(k) for k in keys]
        types, at = np.unique(np.concatenate([*keys, *hot_keys]), return_inverse=True)
        n = sum(sizes)
        doc = np.concatenate(docs)
        train = (doc & 1) == 0
        count = np.bincount(at[:n], train, len(types)) + np.bincount(at[n:], np.concatenate(hot_counts), len(types))
        row = {
            "shard": rows[0]["shard"],
            "blocks": [r["block"] for r in rows],
            "words": _pack(words),
            "contexts": _pack(_differences(contexts)),
            "types_word": _pack((types // width).astype("<u4")),
            "types_context": _pack((types % width).astype("<u4")),
            "types_count": _pack(count.astype("<u4")),
            "cuts": _pack(np.array(cuts, "<i8")),
            "doc": _pack(_narrow(doc >> 1)),
            "type": _pack(at[:n].astype("<u4")),
            "hot_cuts": _pack(np.array(hot_cuts, "<i8")),
            "hot_type": _pack(at[n:].astype("<u4")),
            "hot_pair": _pack(np.concatenate(hot_pairs)),
        }
        del parts, keys, docs, types, at, doc
        trim()
        return record(row)

    return run


def stirling(most: int, discount: float) -> np.ndarray:
    """log S_d(c, t) for c and t up to most; -inf beyond c."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = out[c] + np.log(np.maximum(c - t * discount, 0.0))
            out[c + 1] = np.logaddexp(np.concatenate([[-np.inf], out[c][:-1]]), stay)
    return out


def hashed(x: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers of (0, 1) from 64-bit hashes."""
    x = x + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) * 2.0**-52 + 2.0**-53


class Odds:
    """Odds of a dish's table j + 1: (theta + d (T + j)) of a new table in a restaurant with T others, times the parent's probability of the dish after j customers more."""

    def __init__(self, discount: float, tables: np.ndarray, parent) -> None:
        self.discount, self.tables, self.parent = discount, tables, parent

    def at(self, rows, j):
        return (THETA + self.discount * (self.tables[rows] + j)) * self.parent(rows, j)

    def logs(self, rows: np.ndarray, most: int) -> np.ndarray:
        return np.log(self.at(rows[:, None], np.arange(most)[None, :]))


def sample_tables(customers: np.ndarray, odds: Odds, discount: float, random: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Tables of dishes with so many customers each, drawn given everyone else; one uniform number for each dish."""
    tables = (customers > 0).astype(np.float64)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    log_s = stirling(EXACT, discount)
    low = 1
    while low < EXACT:
        high = min(EXACT, 2 * low if low > 4 else low + 1)
        band = few[(customers[few] > low) & (customers[few] <= high)]
        width = max(1, (1 << 18) // high)
        for k in range(0, len(band), width):
            rows = band[k : k + width]
            c = customers[rows].astype(np.int64)
            law = np.cumsum(odds.logs(rows, high), axis=1) + log_s[c, 1 : high + 1]
            law = np.cumsum(np.exp(law - law.max(1, keepdims=True)), axis=1)
            tables[rows] = 1 + (law < (random[rows] * law[:, -1])[:, None]).sum(1)
        low = high
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        tables[many] = _many_tables(customers[many], odds, many, discount, random[many], now[many])
    return tables


def _many_tables(c: np.ndarray, odds: Odds, rows: np.ndarray, d: float, random: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Normal draws for dishes of many customers.

    Tables of n customers come as a Poisson process of rate w d (1 - d) ... (n - 1 - d) z^n / n!, conditioned on c customers at all: with
    f = 1 - (1 - z)^d and z (1 - z)^(d - 1) = c / w, their number has mean w f / d and variance mean r, r = 1 - m1^2 / m2 of the moments of a table's size; r more for the one table that a heavy tail makes sure of.
    """
    from statistics import NormalDist

    t = np.clip(now, 1, c)
    for _ in range(12):
        w = odds.at(rows, t - 1)
        low, high = np.full(len(c), -80.0), np.zeros(len(c))
        for _ in range(50):  # of log (1 - z)
            y = (low + high) / 2
            above = np.log(c / w) < np.log(-np.expm1(y)) + (d - 1) * y
            low, high = np.where(above, y, low), np.where(above, high, y)
        y = (low + high) / 2
        f = -np.expm1(d * y)
        t = np.clip((t + w * f / d) / 2, 1, c)
    z, rest = -np.expm1(y), np.exp(y)
    m1 = z * d * rest ** (d - 1) / f
    m2 = m1 + z * z * d * (1 - d) * rest ** (d - 2) / f
    share = np.clip(1 - m1 * m1 / m2, 0, 1)
    normal = np.array([NormalDist().inv_cdf(x) for x in random.tolist()])
    return np.clip(np.rint(t + share + np.sqrt(t * share) * normal), 1, c)


class Shard:
    """A shard's customers and tables on both levels, by the restaurants' ids.

    Totals are (customers, tables) of the shard's own restaurants over all shards, and a vector of the root.
    """

    def __init__(self, number: int, words: np.ndarray, word: np.ndarray, contexts: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        self.number, self.hashes, self.contexts, self.at = number, words.astype(np.uint64), contexts.astype(np.int64), at.astype(np.int64)
        self.word, self.count = word.astype(np.int64), count.astype(np.float64)
        self.fine = (self.count > 0).astype(np.float64)
        self.words = len(words)
        self.customers = np.bincount(self.word, self.fine, self.words)
        self.root = (self.customers > 0).astype(np.float64)

    def seat(self, fine: np.ndarray, root: np.ndarray) -> None:
        self.fine, self.root = fine.astype(np.float64), root.astype(np.float64)
        self.customers = np.bincount(self.word, self.fine, self.words)

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        once = [x for c in (self.count, self.customers) for x in ((c == 1).sum(), (c == 2).sum())]
        words = np.bincount(self.word, self.count, self.words)
        customers, tables = (np.bincount(self.at, x, len(self.contexts)) for x in (self.count, self.fine))
        return customers, tables, np.array([self.root.sum(), self.customers.sum(), (words > 0).sum(), words.sum(), *once], np.float64)

    def predictive(self, customers: np.ndarray, tables: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each word at the root, and of each type at its restaurant."""
        x = Totals(shared)
        p0 = (self.customers - x.d[1] * self.root + x.base) / (THETA + x.customers)
        p1 = (self.count - x.d[0] * self.fine + (THETA + x.d[0] * tables[self.at]) * p0[self.word]) / (THETA + customers[self.at])
        return p0, p1

    def sweep(self, customers: np.ndarray, tables: np.ndarray, shared: np.ndarray, step: int) -> None:
        x = Totals(shared)
        some = np.flatnonzero(self.count > 0)
        fine, w = self.fine[some], self.word[some]
        others = self.customers[w] - fine
        above = others - x.d[1] * np.minimum(self.root[w], others) + x.base
        odds = Odds(x.d[0], tables[self.at[some]] - fine, lambda rows, j: (above[rows] + j) / (THETA + x.customers - fine[rows] + j))
        names = self.hashes[w] ^ (self.contexts[self.at[some]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.fine[some] = sample_tables(self.count[some], odds, x.d[0], hashed(names, step), fine)
        self.customers = np.bincount(self.word, self.fine, self.words)
        odds = Odds(x.d[1], x.tables - self.root, lambda rows, j: 1 / (x.known + 1))
        self.root = sample_tables(self.customers, odds, x.d[1], hashed(self.hashes, step), self.root)


class Totals:
    def __init__(self, shared: np.ndarray) -> None:
        self.tables, self.customers, self.known, self.tokens, *once = shared.tolist()
        self.d = [min(0.95, max(0.05, one / max(1.0, one + 2 * two))) for one, two in zip(once[::2], once[1::2], strict=True)]
        self.base = (THETA + self.d[1] * self.tables) / (self.known + 1)


def _dealt(contexts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a shard's restaurants by bucket, and where each bucket starts."""
    order = np.argsort(contexts % buckets, kind="stable")
    return order, np.searchsorted(contexts[order] % buckets, np.arange(buckets + 1))


#: A shard's rows: its types (step null), its seating after a step, and from each bucket the totals of its restaurants after a step.
ROWS = "shard int, step int, bucket int, words binary, contexts binary, types_word binary, types_context binary, types_count binary, fine binary, root binary, customers binary, tables binary"
TYPES = "words contexts types_word types_context types_count".split()
SENT = "bucket int, shard int, step int, ids binary, customers binary, tables binary, shared binary, fine binary, root binary"
RETURNED = "shard int, step int, bucket int, customers binary, tables binary"


def _meet(rows: list[dict], buckets: int) -> tuple[dict, Shard, dict]:
    """A shard's row of types, the shard, and for each step that has come the (customers, tables) of its restaurants and its seating."""
    own = next(r for r in rows if r["words"] is not None)
    words, contexts, word, at, count = (_unpack(own[n]) for n in TYPES)
    contexts = _summed(contexts)
    shard = Shard(own["shard"], words, word, contexts, at, count)
    order, _ = _dealt(shard.contexts, buckets)

    def joined(step: int, name: str) -> np.ndarray:
        out = np.empty(len(contexts))
        parts = sorted((r for r in rows if r["step"] == step and r[name] is not None), key=lambda r: r["bucket"])
        out[order] = np.concatenate([_unpack(r[name]) for r in parts])
        return out

    steps = sorted({r["step"] for r in rows if r["tables"] is not None})
    customers = joined(0, "customers") if steps else None
    seats = {r["step"]: (_unpack(r["fine"]), _unpack(r["root"])) for r in rows if r["fine"] is not None}
    return own, shard, {s: (customers, joined(s, "tables"), seats.get(s)) for s in steps}


def _sweep(shared: np.ndarray | None, step: int, buckets: int):
    """A shard's seating after one more sweep and its sums: a row for each bucket of its restaurants, one (bucket -1) for the rest. Step 0 has one table for each dish."""

    def run(group: pa.Table) -> pa.Table:
        _, shard, history = _meet(group.to_pylist(), buckets)
        if step:
            customers, tables, seats = history[step - 1]
            if seats:
                shard.seat(*seats)
            shard.sweep(customers, tables, shared, step)
        customers, tables, v = shard.totals()
        order, first = _dealt(shard.contexts, buckets)
        rows = [{"bucket": -1, "shard": shard.number, "step": step, "shared": _pack(v)} | ({"fine": _pack(_narrow(shard.fine)), "root": _pack(_narrow(shard.root))} if step else {})]
        for b in range(buckets):
            at = order[first[b] : first[b + 1]]
            if len(at):
                row = {"bucket": b, "shard": shard.number, "step": step, "ids": _pack(np.diff(shard.contexts[at], prepend=0)), "tables": _pack(_narrow(tables[at]))}
                rows.append(row if step else row | {"customers": _pack(_narrow(customers[at]))})
        del shard, customers, tables, order
        trim()
        return pa.Table.from_pylist(rows, _arrow(SENT))

    return run


def _arrow(fields: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in fields.split(", "))])


def _merge(step: int):
    """A bucket's rows of all shards to the sums over them, for each shard in the order it sent."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        ids = [np.cumsum(_unpack(r["ids"])) for r in rows]
        at = np.unique(np.concatenate(ids), return_inverse=True)[1]
        cuts = np.cumsum([0, *map(len, ids)])
        out = [{"shard": r["shard"], "step": step, "bucket": r["bucket"]} for r in rows]
        for name in ("tables",) if step else ("tables", "customers"):
            sums = np.bincount(at, np.concatenate([_unpack(r[name]) for r in rows]))
            for r, a, b in zip(out, cuts, cuts[1:], strict=False):
                r[name] = _pack(_narrow(sums[at[a:b]]))
        return pa.Table.from_pylist(out, _arrow(RETURNED))

    return run


PARTS = "block long, doc binary, score binary, base binary, known binary, pair binary, pair_score binary, pair_base binary, pair_known binary, ids array<long>, held binary, tokens binary, seen_doc binary, seen_word binary, seen_count binary, seen_context binary"


def _score(shared: list[np.ndarray], buckets: int):
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            _, shard, history = _meet([row | dict.fromkeys(("step", "tables", "fine", "customers")), *right.to_pylist()], buckets)
            final = Totals(shared[-1])
            mean = np.zeros(len(shard.count))
            for step in range(BURN_IN + 1, BURN_IN + SAMPLES + 1):
                customers, tables, seats = history[step]
                shard.seat(*seats)
                mean += shard.predictive(customers, tables, shared[step])[1] / SAMPLES
            score = np.rint(-np.log10(mean) * SCALE["score"])
            counts = np.bincount(shard.word, shard.count, shard.words)
            base = np.rint(-np.log10((counts + 1) / (final.tokens + final.known + 1)) * SCALE["base"])[shard.word]
            known = (counts > 0)[shard.word]
            doc, kind, cuts = (_unpack(row[n]) for n in ("doc", "type", "cuts"))
            hot_type, hot_pair, hot_cuts = (_unpack(row[n]) for n in ("hot_type", "hot_pair", "hot_cuts"))
            for block, a, b, c, d in zip(row["blocks"], cuts, cuts[1:], hot_cuts, hot_cuts[1:], strict=False):
                n = int(doc[a:b].max(initial=0)) + 1
                docs = np.flatnonzero(np.bincount(doc[a:b], minlength=n))
                part = {"doc": _narrow(docs)}
                for name, value in (("score", score), ("base", base), ("known", known)):
                    part[name] = _narrow(np.bincount(doc[a:b], value[kind[a:b]], n)[docs])
                    part["pair_" + name] = _narrow(value[hot_type[c:d]])
                part["pair"] = hot_pair[c:d]
                out.append({"block": block} | {k: _pack(v) for k, v in part.items()})
            del shard, history, mean, score, base, known, doc, kind
            trim()
        return pa.Table.from_batches([_record(names, out)])

    return run


def _sum(train_tokens: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["held"] is not None)
        held, tokens, seen_doc, seen_word, seen_count, pairs = (_unpack(own[k]) for k in ("held", "tokens", "seen_doc", "seen_word", "seen_count", "seen_context"))
        n = len(held)
        sums = {k: np.zeros(n) for k in ("score", "base", "known")}
        hot = {k: np.zeros(int(pairs[0])) for k in sums}
        for r in sorted((r for r in rows if r["held"] is None), key=lambda r: (len(r["doc"]), r["doc"], r["score"], r["pair"])):
            doc, pair = _unpack(r["doc"]), _unpack(r["pair"])
            for k in sums:
                sums[k][doc] += _unpack(r[k])
                hot[k][pair] = _unpack(r["pair_" + k])
        for k in sums:
            sums[k] += np.bincount(seen_doc, hot[k][seen_word] * seen_count, n)
        return pa.table(
            [
                pa.array(own["ids"], pa.int64()),
                pa.array(held.astype(bool), pa.bool_()),
                pa.array(tokens.astype(np.int64), pa.int64()),
                pa.array(np.rint(sums["known"]).astype(np.int64), pa.int64()),
                pa.array([train_tokens] * n, pa.int64()),
                pa.array(-sums["base"] / SCALE["base"], pa.float64()),
                pa.array(-sums["score"] / SCALE["score"], pa.float64()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def _clean(docs: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose tables are written; the first round frees what still refers to them."""
    import gc
    import time

    gc.collect()
    for _ in range(2):
        docs.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def score_documents(docs: DataFrame, held_modulus: int = 7, held_remainder: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id isn't the held remainder."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // SHARD_BYTES))
    state = materialize(source.mapInArrow(_index(shards, held_modulus, held_remainder), INDEX).groupBy("shard").applyInArrow(_build(), STATE), "seating")
    _clean(docs)
    words = state.where("types_word is not null")
    buckets = max(4, shards // 2)

    def rows_of(df: DataFrame) -> DataFrame:
        return df.select([F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in ROWS.split(", "))])

    types = rows_of(words.select("shard", *TYPES))
    totals, seats = {}, {}  # of each step; the steps before the samples' are dropped once used
    shared: list[np.ndarray] = []
    for step in range(1 + BURN_IN + SAMPLES):
        rows = types
        for before in {0, step - 1} & totals.keys():
            rows = rows.unionByName(rows_of(totals[before]))
        if step - 1 in seats:
            rows = rows.unionByName(rows_of(seats[step - 1]))
        sent = materialize(rows.groupBy("shard").applyInArrow(_sweep(shared[-1] if shared else None, step, buckets), SENT), "seats")
        # eight numbers of each shard
        shared.append(sum((_unpack(r[0]) for r in sent.where("bucket < 0").select("shared").collect()), np.zeros(8)))
        back = materialize(sent.where("bucket >= 0").select("bucket", "shard", "ids", "customers", "tables").groupBy("bucket").applyInArrow(_merge(step), RETURNED), "totals")
        if 1 < step <= BURN_IN + 1:
            release(totals.pop(step - 1), seats.pop(step - 1))
        totals[step] = back
        if step:
            seats[step] = materialize(sent.where("bucket < 0").select("shard", "step", "fine", "root"), "seats")
        release(sent)
        _clean(docs)
    tokens = words.select("shard", *TYPES, "blocks", "doc", "type", "cuts", "hot_type", "hot_pair", "hot_cuts")
    history = rows_of(totals[0])
    for step in range(BURN_IN + 1, BURN_IN + SAMPLES + 1):
        history = history.unionByName(rows_of(totals[step])).unionByName(rows_of(seats[step]))
    sums = tokens.groupBy("shard").cogroup(history.groupBy("shard")).applyInArrow(_score(shared, buckets), PARTS)
    own = state.where("held is not null").select([F.col(n) if n in ("block", "ids", *_SEEN) else F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in PARTS.split(", "))])
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sums.unionByName(own).groupBy("block").applyInArrow(_sum(int(shared[0][3])), result)
