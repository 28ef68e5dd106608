"""Whole alignments: build from sequences, merge alignments, place sequences on a backbone.

A part of the guide tree (at most `most` leaves) is aligned within one task, and
all parts at once. Their profiles are joined level by level along the tree of
parts, the pairs of a level at once, each in its own task; rows are rewritten once,
along their part's path. Deferred sequences come last, one after another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.functions.alphabet import Scoring
from strandflow.functions.storage import kept
from strandflow.operators import kernel, rewrite
from strandflow.sources import newick


@dataclass(frozen=True)
class Options:
    scoring: Scoring = field(default_factory=Scoring)
    gappy: float = kernel.GAPPY
    most: int = 500
    rooted: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.gappy <= 1:
            raise ValueError("gappy must be over 0 and at most 1")
        if self.most < 2:
            raise ValueError("a part needs room for two leaves")


@dataclass
class Block:
    """Rows aligned with each other, by name, with their weights and their profile."""

    names: list[str]
    rows: list[str]
    weights: list[float]
    profile: np.ndarray

    def join(self, other: Block, options: Options, merging: bool = False) -> Block:
        path = kernel.align_profiles(self.profile, other.profile, options.scoring, options.gappy, merging)
        rows = [kernel.replay(r, path, 1) for r in self.rows] + [kernel.replay(r, path, 2) for r in other.rows]
        return Block(self.names + other.names, rows, self.weights + other.weights, kernel.merge_profiles(self.profile, other.profile, path))


def block_of(names: list[str], rows: list[str], weights: list[float], kind: str) -> Block:
    return Block(names, rows, weights, kernel.profile_of(rows, weights, kind))


def align_tree(tree: newick.Node, blocks: dict[str, Block], options: Options) -> Block | None:
    """Blocks of leaves (and of inner nodes that carry rows already) joined up the tree, pairs first."""
    done: dict[int, Block] = {}
    for node in tree.walk():
        line = [done.pop(id(c)) for c in node.children if id(c) in done]
        while len(line) > 1:
            line = [line[k].join(line[k + 1], options) if k + 1 < len(line) else line[k] for k in range(0, len(line), 2)]
        if node.name in blocks:
            line = [blocks[node.name].join(line[0], options, merging=True)] if line else [blocks[node.name]]
        if line:
            done[id(node)] = line[0]
    return done.get(id(tree))


def _text(tree: newick.Node) -> list[tuple]:
    return [(r[0], r[1], r[2], r[3], r[8]) for r in newick.to_rows(tree)]


def _tree(rows: list[tuple]) -> newick.Node:
    nodes = {name: newick.Node(name, length, is_leaf=leaf) for name, _, _, length, leaf in rows}
    root = None
    for name, parent, _, _, _ in rows:
        if parent is None:
            root = nodes[name]
        else:
            nodes[parent].add(nodes[name])
    return root


ROWS = "group_id int, name string, weight double, aligned string"


def build(spark: SparkSession, sequences: DataFrame, tree: newick.Node, options: Options | None = None) -> DataFrame:
    """(group_id, name, weight, aligned) of sequences(name, seq) whose names are leaves of the tree; the first of repeated names counts.

    With a column status, excluded sequences are left out and deferred ones set
    aside: the others are aligned along the tree without them, then each takes its
    place in turn, the longest first.
    """
    options = options or Options()
    later = None
    if "status" in sequences.columns:
        later = sequences.where("status = 'deferred'")
        sequences = sequences.where("status = 'ok'")
        # names of the guide tree, which the driver holds anyway
        now = {r.name for r in sequences.select("name").distinct().collect()}
        names = {n.name for n in tree.walk() if n.is_leaf}
        later = later.join(spark.createDataFrame([(n,) for n in sorted(names - now)], "name string"), "name", "left_semi") if names - now else later.limit(0)
        if not names & now:  # none is left to start with
            later, sequences = None, later.select(*sequences.columns)
            now = names
        tree = newick.prune(tree, now)
    tree = newick.binarize(tree) if options.rooted else newick.reroot(tree)
    roots = newick.partition(tree, options.most)
    weights = {r[0]: r[7] for r in newick.to_rows(tree) if r[8]}
    # each part's tree goes to its own task
    parts = spark.createDataFrame([(g, json.dumps(_text(newick.copy(n, lambda x, g=g: x.group == g)))) for g, n in roots.items()], "group_id int, tree string")
    leaves = spark.createDataFrame([(n.name, n.group, float(weights[n.name])) for n in tree.walk() if n.is_leaf], "name string, group_id int, weight double")
    rows = sequences.groupBy("name").agg(F.min_by("seq", "seq_id").alias("seq")).join(leaves, "name")

    def run(key: tuple, group: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame({"group_id": [], "name": [], "weight": [], "aligned": []}).astype({"group_id": "int32"})
        group = group.sort_values("name")
        blocks = {n: block_of([n], [s or ""], [w], options.scoring.kind) for n, s, w in zip(group["name"], group["seq"], group["weight"], strict=True)}
        made = align_tree(_tree([tuple(r) for r in json.loads(part["tree"].iloc[0])]), blocks, options)
        return pd.DataFrame({"group_id": int(key[0]), "name": made.names, "weight": made.weights, "aligned": made.rows}).astype({"group_id": "int32"})

    made = rows.groupBy("group_id").cogroup(parts.groupBy("group_id")).applyInPandas(run, ROWS)
    if len(roots) > 1:
        made = merge_parts(spark, kept(made), newick.part_schedule(newick.contract(tree, roots)), options)
    return made if later is None else add_deferred(kept(made), later, options)


def add_deferred(rows: DataFrame, sequences: DataFrame, options: Options | None = None) -> DataFrame:
    """An alignment with sequences(name, seq) taken in one after another, the longest first (then by name); they are few beside the rows."""
    rank = Window.orderBy(F.length("seq").desc(), "name")  # low-quality sequences only
    one = sequences.groupBy("name").agg(F.min_by(F.coalesce("seq", F.lit("")), "seq_id").alias("seq"))
    own = one.select(F.row_number().over(rank).alias("group_id"), "name", F.lit(1.0).alias("weight"), F.col("seq").alias("aligned"))
    return merge(rows.withColumn("group_id", F.lit(0)).unionByName(own), options, first=0)


BLOCKS = "block int, profile binary, members array<struct<group_id:int,path:binary>>"


def merge_parts(spark: SparkSession, rows: DataFrame, levels: list[list[tuple[int, int]]], options: Options) -> DataFrame:
    """Parts joined level by level: (block, block it takes in) of a level are pairs of their own, each aligned in its own task.

    Only profiles and the parts' paths move between levels; rows are rewritten once.
    """
    size = len(kernel.letters_of(options.scoring.kind)) + 2

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            members = [[{"group_id": int(g), "path": bytes(int(c))}] for g, c in zip(batch["group_id"], batch["columns"], strict=True)]
            yield pd.DataFrame({"block": batch["group_id"], "profile": batch["profile"], "members": members})

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("side")
        if len(pair) == 1:  # the other one has no rows
            return pd.DataFrame({"block": pair["key"], "profile": pair["profile"], "members": pair["members"]}).astype({"block": "int32"})
        left, right = (np.frombuffer(x).reshape(-1, size) for x in pair["profile"])
        path = kernel.align_profiles(left, right, options.scoring, options.gappy, merging=True)
        members = []
        for own, side in zip(pair["members"], (1, 2), strict=True):
            for member in own:  # columns that the side lacks are gaps in all its members
                new = np.ones(len(path), np.int8)
                new[path != side] = np.frombuffer(member["path"], np.int8)
                members.append({"group_id": int(member["group_id"]), "path": new.tobytes()})
        return pd.DataFrame({"block": [int(pair["key"].iloc[0])], "profile": [kernel.merge_profiles(left, right, path).tobytes()], "members": [members]}).astype({"block": "int32"})

    blocks = kept(profiles(rows, options.scoring.kind).mapInPandas(start, BLOCKS))
    for pairs in levels:
        sides = [(a, a, 0) for a, _ in pairs] + [(b, a, 1) for a, b in pairs]
        named = blocks.join(F.broadcast(spark.createDataFrame(sides, "block int, key int, side int")), "block", "left")  # two numbers for each part
        joined = named.where("key is not null").groupBy("key").applyInPandas(run, BLOCKS)
        blocks = kept(named.where("key is null").select("block", "profile", "members").unionByName(joined))
    found = blocks.select(F.explode("members").alias("x")).select("x.group_id", "x.path")
    return replayed(rows, found)


def profiles(rows: DataFrame, kind: str = "n") -> DataFrame:
    """(group_id, n, profile as float64 bytes) of each alignment, from partial sums of its tasks' rows."""
    size = len(kernel.letters_of(kind)) + 2

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, part in batch.groupby("group_id"):
                raw = kernel.profile_of(part["aligned"].tolist(), part["weight"].tolist(), kind) * (part["weight"].sum() / len(part))
                out.append((int(g), len(part), float(part["weight"].sum()), raw.tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["group_id", "n", "w", "raw"]).astype({"group_id": "int32"})

    def total(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, w = int(part["n"].sum()), float(part["w"].sum())
        summed = np.sum([np.frombuffer(x) for x in part["raw"]], axis=0)
        return pd.DataFrame({"group_id": [int(key[0])], "n": [n], "columns": [len(summed) // size], "profile": [(summed / w * n).tobytes()]}).astype({"group_id": "int32"})

    raw = rows.select("group_id", "weight", "aligned").mapInPandas(partial, "group_id int, n long, w double, raw binary")
    return raw.groupBy("group_id").applyInPandas(total, "group_id int, n long, columns long, profile binary")


def merge(rows: DataFrame, options: Options | None = None, first: int | None = None) -> DataFrame:
    """Alignments (group_id, name, weight, aligned) joined into one: the first, else the one with the most rows, takes the others in turn."""
    options = options or Options()
    size = len(kernel.letters_of(options.scoring.kind)) + 2

    def paths(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.assign(starts=parts["group_id"] == first).sort_values(["starts", "n", "group_id"], ascending=[False, False, True])
        whole, held = None, {}
        for g, raw in zip(parts["group_id"], parts["profile"], strict=True):
            profile = np.frombuffer(raw).reshape(-1, size)
            if whole is None:
                whole, held[int(g)] = profile, np.zeros(len(profile), np.int8)
                continue
            path = kernel.align_profiles(whole, profile, options.scoring, options.gappy, merging=True)
            for k, old in held.items():  # a column that the whole lacks is a gap in all so far
                new = np.ones(len(path), np.int8)
                new[path != 1] = old
                held[k] = new
            held[int(g)] = (path == 2).astype(np.int8)
            whole = kernel.merge_profiles(whole, profile, path)
        return pd.DataFrame({"group_id": list(held), "path": [x.tobytes() for x in held.values()]}).astype({"group_id": "int32"})

    # one profile for each alignment: all of them are needed in turn
    found = profiles(rows, options.scoring.kind).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda p: paths(p.drop(columns="all")), "group_id int, path binary")
    return replayed(rows, found)


def replayed(rows: DataFrame, paths: DataFrame, gap: str = "-") -> DataFrame:
    """Rows along their group's path: 0 takes the next letter, 1 is a gap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["aligned"] = [kernel.replay(r, np.frombuffer(p, np.int8), 1, gap) for r, p in zip(batch["aligned"], batch["path"], strict=True)]
            yield batch[["group_id", "name", "weight", "aligned"]]

    return rows.join(paths, "group_id").select("group_id", "name", "weight", "aligned", "path").mapInPandas(run, ROWS)


def place(spark: SparkSession, sequences: DataFrame, backbone: DataFrame, options: Options | None = None) -> DataFrame:
    """(name, aligned, placed): each sequence aligned with the backbone's profile alone, insertions sharing columns.

    The backbone profile (one row for each column) is the only thing that all
    tasks read; of the insertions only the longest at each column counts.
    """
    options = options or Options()
    backbone = kept(backbone)
    back = backbone.select(F.lit(0).alias("group_id"), "name", F.lit(1.0).alias("weight"), "aligned")
    first = profiles(back, options.scoring.kind).first()
    size = len(kernel.letters_of(options.scoring.kind)) + 2
    profile = np.frombuffer(first.profile).reshape(-1, size) if first else np.zeros((0, size))
    columns = len(profile)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, seq in zip(batch["name"], batch["seq"], strict=True):
                query = kernel.profile_of([seq or ""], None, options.scoring.kind)
                path = kernel.align_profiles(profile, query, options.scoring, options.gappy, merging=True)
                out.append((name, seq or "", path.tobytes()))
            yield pd.DataFrame(out, columns=["name", "seq", "path"])

    placed = kept(sequences.select("name", "seq").mapInPandas(align, "name string, seq string, path binary"))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            longest = np.zeros(columns + 1, np.int64)
            for raw in batch["path"]:
                np.maximum(longest, insertions(np.frombuffer(raw, np.int8), columns), out=longest)
            yield pd.DataFrame({"place": np.flatnonzero(longest), "n": longest[longest > 0]})

    found = placed.select("path").mapInPandas(runs, "place long, n long").groupBy("place").agg(F.max("n").alias("n")).collect()
    slots = np.zeros(columns + 1, np.int64)
    for place_, n in found:
        slots[place_] = n

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [slotted(s, np.frombuffer(p, np.int8), slots) for s, p in zip(batch["seq"], batch["path"], strict=True)]
            yield pd.DataFrame({"name": batch["name"], "aligned": rows, "placed": True})

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ["".join("." * slots[k] + c for k, c in enumerate(r)) + "." * slots[columns] for r in batch["aligned"]]
            yield pd.DataFrame({"name": batch["name"], "aligned": rows, "placed": False})

    schema = "name string, aligned string, placed boolean"
    return backbone.select("name", "aligned").mapInPandas(widen, schema).unionByName(placed.mapInPandas(write, schema))


def insertions(path: np.ndarray, columns: int) -> np.ndarray:
    """Letters that the path inserts before each reference column, and after the last."""
    before = np.cumsum(path != 1)[path == 1]
    return np.bincount(before, minlength=columns + 1)


def slotted(seq: str, path: np.ndarray, slots: np.ndarray) -> str:
    """A placed row: - where it lacks a column, insertions at the left of their slots, . in slots that it leaves."""
    out, at, column, used = [], 0, 0, 0
    for step in path.tolist():
        if step == 1:
            out.append(seq[at])
            at, used = at + 1, used + 1
        else:
            out.append("." * (int(slots[column]) - used))
            out.append("-" if step == 2 else seq[at])
            at += step == 0
            column, used = column + 1, 0
    out.append("." * (int(slots[column]) - used))
    return "".join(out)


def place_on_tree(spark: SparkSession, sequences: DataFrame, backbone: DataFrame, tree: newick.Node, options: Options | None = None) -> DataFrame:
    """(group_id, name, weight, aligned) of backbone and new rows: backbone rows hang on the nearest node above a new leaf.

    Each part of the tree is one task, as in build(); its backbone rows stay
    aligned, without the columns that only they fill with gaps.
    """
    options = options or Options()
    new = {r.name for r in sequences.select("name").distinct().collect()}
    tree = newick.reroot(tree) if not options.rooted else newick.binarize(tree)
    roots = newick.partition(tree, options.most)
    rows = newick.to_rows(tree)
    weights = {r[0]: r[7] for r in rows if r[8]}
    above: set[int] = set()
    for n in tree.walk():
        if (n.is_leaf and n.name in new) or any(id(c) in above for c in n.children):
            above.add(id(n))
    hangs = {}
    for n in tree.walk():
        if n.is_leaf and n.name not in new:
            at = n.parent or n
            while id(at) not in above and at.parent is not None and at.parent.group == n.group:
                at = at.parent
            hangs[n.name] = at.name
    parts = {g: _text(newick.copy(n, lambda x, g=g: x.group == g)) for g, n in roots.items()}
    leaves = spark.createDataFrame([(n.name, n.group, float(weights[n.name])) for n in tree.walk() if n.is_leaf], "name string, group_id int, weight double")
    both = sequences.select("name", F.col("seq").alias("text"), F.lit(True).alias("new")).unionByName(backbone.select("name", F.col("aligned").alias("text"), F.lit(False).alias("new")))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["new", "name"])
        blocks: dict[str, Block] = {}
        carried: dict[str, list[tuple]] = {}
        for name, text, weight, fresh in zip(group["name"], group["text"], group["weight"], group["new"], strict=True):
            if fresh:
                blocks[name] = block_of([name], [text], [weight], options.scoring.kind)
            else:
                carried.setdefault(hangs[name], []).append((name, text, weight))
        for node, members in carried.items():
            names, texts, ws = (list(x) for x in zip(*members, strict=True))
            filled = [k for k in range(len(texts[0])) if any(t[k] != "-" for t in texts)]
            blocks[node] = block_of(names, ["".join(t[k] for k in filled) for t in texts], ws, options.scoring.kind)
        made = align_tree(_tree(parts[int(key[0])]), blocks, options)
        return pd.DataFrame({"group_id": int(key[0]), "name": made.names, "weight": made.weights, "aligned": made.rows}).astype({"group_id": "int32"})

    inner = both.join(leaves, "name").groupBy("group_id").applyInPandas(run, ROWS)
    return inner if len(roots) == 1 else merge_parts(spark, kept(inner), newick.part_schedule(newick.contract(tree, roots)), options)


#: Leaves of a guide tree that the driver can join by average linkage.
GUIDE_MOST = 4000


def guide_tree(sequences: DataFrame, k: int = 6) -> newick.Node:
    """Average linkage of the k-mer distances of sequences(seq_id, name, seq), on the driver, for at most GUIDE_MOST of them."""
    names = [(r.seq_id, r.name) for r in sequences.groupBy("name").agg(F.min("seq_id").alias("seq_id")).orderBy("name").limit(GUIDE_MOST + 1).collect()]
    if len(names) > GUIDE_MOST:
        raise ValueError(f"over {GUIDE_MOST} sequences: give a tree")
    place = {key: i for i, (key, _) in enumerate(names)}
    distance = np.ones((len(names), len(names)))
    for a, b, d in rewrite.kmer_distance(sequences, k).collect():
        if a in place and b in place:
            distance[place[a], place[b]] = distance[place[b], place[a]] = d
    return newick.upgma([n for _, n in names], distance)


def alignment_tree(rows: DataFrame) -> newick.Node:
    """Average linkage of the share of differing letters in the columns where both rows have one, for at most GUIDE_MOST rows."""
    found = rows.select("name", "aligned").orderBy("name").limit(GUIDE_MOST + 1).collect()
    if len(found) > GUIDE_MOST:
        raise ValueError(f"over {GUIDE_MOST} rows: give a tree")
    letters = np.array([np.frombuffer(r.aligned.encode("latin-1", "replace").upper(), np.uint8) for r in found])
    real = ~np.isin(letters, [ord("-"), ord(".")])
    distance = np.ones((len(found), len(found)))
    for i in range(len(found)):
        both = real & real[i]
        n = both.sum(1)
        distance[i] = np.where(n > 0, ((letters != letters[i]) & both).sum(1) / np.maximum(n, 1), 1.0)
    return newick.upgma([r.name for r in found], distance)


def iterate(spark: SparkSession, sequences: DataFrame, rounds: int = 3, options: Options | None = None, tree: newick.Node | None = None) -> DataFrame:
    """Alignments along a tree and trees from alignments in turn; the alignment after so many rounds."""
    if not 1 <= rounds <= 5:
        raise ValueError("rounds must be 1 to 5")
    tree = tree or guide_tree(sequences)
    rows = kept(build(spark, sequences, tree, options))
    for _ in range(rounds - 1):
        rows = kept(build(spark, sequences, alignment_tree(rows), options))
    return rows
