"""Alignment of profiles and of sequences, vectorised along anti-diagonals. No Spark here.

A profile is a (columns x letters + 2) array of letter frequencies, with the
ambiguous class and the gap last. A path has 0 for a match, 1 for a gap in the
reference and 2 for a gap in the query.
"""

from __future__ import annotations

import numpy as np

from strandflow.functions.alphabet import Scoring, index_array, letters_of

GAPPY = 0.95
FAR = -1e30


def profile_of(rows: list[str], weights: list[float] | None, kind: str = "n") -> np.ndarray:
    """Weighted letter counts of each column, scaled to the number of rows."""
    size = len(letters_of(kind)) + 2
    width = len(rows[0]) if rows else 0
    out = np.zeros((width, size))
    w = np.ones(len(rows)) if weights is None else np.asarray(weights, float)
    total = w.sum()
    if total <= 0:
        w, total = np.ones(len(rows)), float(len(rows))
    at = np.arange(width)
    for row, x in zip(rows, w, strict=True):
        np.add.at(out, (at, index_array(row, kind)), x / total * len(rows))
    return out


def similarity(ref: np.ndarray, qry: np.ndarray, scoring: Scoring, gap_letter: float) -> np.ndarray:
    """Score of each query column (row) against each reference column, per pair of rows."""
    k = scoring.matrix.shape[0]
    rows_r, rows_q = max(1e-9, ref.sum(1).max(initial=0)), max(1e-9, qry.sum(1).max(initial=0))
    letters = qry[:, :k] @ scoring.matrix.T @ ref[:, :k].T
    gaps = gap_letter * (np.outer(qry[:, k], ref[:, :k].sum(1)) + np.outer(qry[:, :k].sum(1), ref[:, k]))
    return (letters + gaps) / (rows_r * rows_q)


def gap_penalties(profile: np.ndarray, scoring: Scoring) -> tuple[np.ndarray, np.ndarray]:
    """Opening and extension at each column: weaker where rows have gaps already."""
    rows = max(1e-9, profile.sum(1).max(initial=0))
    g = profile[:, -1]
    scale = 0.5 if scoring.kind == "n" else 1.0
    share = (rows - g) / rows
    op = np.where(g > 0, np.minimum(0.1 * scoring.gap_open, scoring.gap_open * scale * share), scoring.gap_open)
    ex = np.where(g > 0, np.minimum(0.2 * scoring.gap_extend, scoring.gap_extend * share), scoring.gap_extend)
    return op, ex


class Similarity:
    """similarity() a cell at a time, so that no matrix of it is held."""

    def __init__(self, ref: np.ndarray, qry: np.ndarray, scoring: Scoring, gap_letter: float) -> None:
        k = scoring.matrix.shape[0]
        rows_r, rows_q = max(1e-9, ref.sum(1).max(initial=0)), max(1e-9, qry.sum(1).max(initial=0))
        self.shape = len(qry), len(ref)
        self.query = np.hstack([qry[:, :k] @ scoring.matrix.T, gap_letter * qry[:, k : k + 1], gap_letter * qry[:, :k].sum(1, keepdims=True)]) / rows_q
        self.ref = np.hstack([ref[:, :k], ref[:, :k].sum(1, keepdims=True), ref[:, k : k + 1]]) / rows_r

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("ab,ab->a", self.query[i], self.ref[j])


class BandDied(ValueError):
    """No cell of a diagonal is within xdrop of the best score so far, or the last cell is outside the band."""


#: Bytes of pointers that are held at once; larger problems keep each BLOCK-th diagonal and compute pointers anew, block by block.
POINTERS = 64 << 20


def align_columns(sim, op_r: np.ndarray, ex_r: np.ndarray, op_q: np.ndarray, ex_q: np.ndarray, scoring: Scoring, pointers: int = POINTERS, xdrop: float | None = None) -> tuple[np.ndarray, float]:
    """Path and score of the best global alignment; sim is a query x reference matrix, or a Similarity.

    A match wins ties, then a gap in the query over one in the reference; an
    extension wins over an opening. Cells whose score is more than xdrop below the
    best so far end the band of the diagonals that follow; a band that dies is
    tried again at twice the drop. Memory: the pointers of one block of diagonals
    and the scores of each block's first.
    """
    n, m = sim.shape
    if not n or not m:
        return np.array([2] * m + [1] * n, np.int8), 0.0
    drop = xdrop if xdrop is not None else scoring.xdrop * max(1.0, abs(scoring.gap_extend))
    most = (n + m) * (18.0 + abs(scoring.gap_open) + float(np.abs(scoring.matrix).max()))
    while True:
        try:
            return _aligned(sim, op_r, ex_r, op_q, ex_q, scoring, pointers, drop)
        except BandDied:
            if drop > most:
                raise
            drop *= 2


def _aligned(sim, op_r, ex_r, op_q, ex_q, scoring: Scoring, pointers: int, drop: float) -> tuple[np.ndarray, float]:
    n, m = sim.shape  # query, reference
    cells = sim.at if isinstance(sim, Similarity) else lambda i, j: sim[i, j]
    lead = scoring.gap_open + scoring.gap_extend * np.maximum(0, np.arange(max(n, m) + 1) - 1)
    last = n + m - 1
    block = min(last, max(1, pointers // n))

    def diagonal(k: int, state: tuple) -> tuple[tuple, int, np.ndarray]:
        """State after diagonal k (scores of the two last diagonals, of insertions and deletions, best score, band), where its band starts, its pointers."""
        s1, s2, ins, dele, top, first, end = state
        low, high = max(0, k - m + 1, first), min(n, k + 1, end)
        if low >= high:
            raise BandDied
        i = np.arange(low, high)
        j = k - i
        inner = (i > 0) & (j > 0)
        edge = np.where((i == 0) & (j == 0), 0.0, lead[np.maximum(i, j)])
        match = np.where(inner, s2[i - 1], edge) + cells(i, j)
        up_open = np.where(i > 0, s1[i - 1] + op_q[i], FAR)
        up_ext = np.where(i > 0, ins[i - 1] + ex_q[i], FAR)
        left_open = np.where(j > 0, s1[i] + op_r[j], FAR)
        left_ext = np.where(j > 0, dele[i] + ex_r[j], FAR)
        up, left = np.maximum(up_open, up_ext), np.maximum(left_open, left_ext)
        state_ = np.where((match >= up) & (match >= left), 0, np.where(up > left, 1, 2))
        best = np.where(state_ == 0, match, np.where(state_ == 1, up, left))
        new_ins, new_del, new_s = np.full(n, FAR), np.full(n, FAR), np.full(n, FAR)
        new_ins[low:high], new_del[low:high], new_s[low:high] = up, left, best
        top = max(top, float(best.max()))
        alive = np.flatnonzero(best >= top - drop)
        if not len(alive):
            raise BandDied
        return (new_s, s1, new_ins, new_del, top, low + int(alive[0]), low + int(alive[-1]) + 2), low, (state_ | (4 * (up_ext >= up_open)) | (8 * (left_ext >= left_open))).astype(np.uint8)

    far = np.full(n, FAR)
    state = (far, far, far, far, FAR, 0, n)
    starts, held = [], []
    for k in range(last):
        if k % block == 0:
            starts.append(state)
            held = []
        state, low, codes = diagonal(k, state)
        held.append((low, codes))
    score = float(state[0][n - 1])
    if score <= FAR / 2:
        raise BandDied
    path: list[int] = []
    i, j, now = n - 1, m - 1, 0
    for number in range(len(starts) - 1, -1, -1):
        if number < len(starts) - 1:
            state, held = starts[number], []
            for k in range(number * block, (number + 1) * block):
                state, low, codes = diagonal(k, state)
                held.append((low, codes))
        while i >= 0 and j >= 0 and i + j >= number * block:
            low, codes = held[i + j - number * block]
            p = int(codes[i - low])
            if now == 0:
                now = p & 3
                if now == 0:
                    path.append(0)
                    i, j = i - 1, j - 1
                    continue
            if now == 1:
                path.append(1)
                now = 1 if p & 4 else 0
                i -= 1
            else:
                path.append(2)
                now = 2 if p & 8 else 0
                j -= 1
    path += [2] * (j + 1) + [1] * (i + 1)
    return np.array(path[::-1], np.int8), score


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of each maximal run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def consensus_of(profile: np.ndarray, kind: str = "n") -> str:
    """The most frequent letter of each column, the first of equals; N or X without letters."""
    letters = letters_of(kind)
    real = profile[:, : len(letters)]
    best = real.argmax(1)
    none = "N" if kind == "n" else "X"
    return "".join(none if not real[k, b] > 0 else letters[b] for k, b in enumerate(best.tolist()))


def pairwise(a: str, b: str, scoring: Scoring) -> tuple[np.ndarray, float]:
    """Global alignment of two sequences with free leading gaps: path (0 match, 1 gap in a, 2 gap in b) and score.

    Of equal scores the match is taken first, then the gap in a.
    """
    m, n = len(a), len(b)
    s = scoring.matrix[np.minimum(index_array(a, scoring.kind), scoring.matrix.shape[0] - 1)][:, np.minimum(index_array(b, scoring.kind), scoring.matrix.shape[0] - 1)]
    M, X, Y = np.zeros((m + 1, n + 1)), np.full((m + 1, n + 1), FAR), np.full((m + 1, n + 1), FAR)
    X[1:, 0] = 0
    Y[0, 1:] = 0
    for k in range(2, m + n + 1):
        i = np.arange(max(1, k - n), min(m, k - 1) + 1)
        j = k - i
        if not len(i):
            continue
        M[i, j] = s[i - 1, j - 1] + np.maximum(np.maximum(M[i - 1, j - 1], X[i - 1, j - 1]), Y[i - 1, j - 1])
        X[i, j] = np.maximum(M[i - 1, j] + scoring.gap_open, X[i - 1, j] + scoring.gap_extend)
        Y[i, j] = np.maximum(M[i, j - 1] + scoring.gap_open, Y[i, j - 1] + scoring.gap_extend)
    path, i, j = [], m, n
    while i or j:
        if i and j:
            best = max(M[i, j], X[i, j], Y[i, j])
            step = 0 if best == M[i, j] else 1 if best == Y[i, j] else 2
        else:
            step = 2 if i else 1
        path.append(step)
        i, j = i - (step != 1), j - (step != 2)
    return np.array(path[::-1], np.int8), float(max(M[m, n], X[m, n], Y[m, n]))


def restore_gappy(path: np.ndarray, runs: tuple[list, list], consensus: tuple[str, str], scoring: Scoring) -> np.ndarray:
    """Put removed column runs back: facing runs are aligned by their consensus, lone ones are gaps in the other side."""
    out: list[int] = []
    r = q = 0  # places in the full profiles
    ref_runs, qry_runs = dict(runs[0]), dict(runs[1])

    def fill() -> None:
        nonlocal r, q
        a, b = ref_runs.pop(r, 0), qry_runs.pop(q, 0)
        if a and b:
            out.extend(pairwise(consensus[0][r : r + a], consensus[1][q : q + b], scoring)[0].tolist())
        else:
            out.extend([2] * a + [1] * b)
        r, q = r + a, q + b

    for step in path.tolist():
        fill()
        out.append(step)
        r, q = r + (step != 1), q + (step != 2)
    fill()
    return np.array(out, np.int8)


def align_profiles(ref: np.ndarray, qry: np.ndarray, scoring: Scoring, gappy: float = GAPPY, merging: bool = False) -> np.ndarray:
    """Path that aligns two profiles; columns with a larger share of gaps than `gappy` stand aside meanwhile."""
    flags = [p[:, -1] / np.maximum(1e-9, p.sum(1)) > gappy if gappy < 1 else np.zeros(len(p), bool) for p in (ref, qry)]
    kept = [p[~f] for p, f in zip((ref, qry), flags, strict=True)]
    large = max(ref.sum(1).max(initial=0), qry.sum(1).max(initial=0)) > 10_000
    sim = Similarity(*kept, scoring, 0.0 if merging or large else scoring.gap_extend)
    (op_r, ex_r), (op_q, ex_q) = (gap_penalties(p, scoring) for p in kept)
    path, _ = align_columns(sim, op_r, ex_r, op_q, ex_q, scoring)
    if flags[0].any() or flags[1].any():
        path = restore_gappy(path, (runs_of(flags[0]), runs_of(flags[1])), (consensus_of(ref, scoring.kind), consensus_of(qry, scoring.kind)), scoring)
    return path


def merge_profiles(ref: np.ndarray, qry: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Sum along the path; a side without a column there adds its rows to the gap."""
    out = np.zeros((len(path), ref.shape[1]))
    out[path != 1] += ref
    out[path != 2] += qry
    out[path == 1, -1] += ref.sum(1).max(initial=0)
    out[path == 2, -1] += qry.sum(1).max(initial=0)
    return out


def replay(row: str, path: np.ndarray, side: int, gap: str = "-") -> str:
    """A row of the reference (side 1) or the query (side 2) along the path."""
    letters = np.full(len(path), ord(gap), np.uint32)
    letters[path != side] = np.frombuffer(row.encode("utf-32-le"), np.uint32)
    return letters.tobytes().decode("utf-32-le")
