"""The kernel against brute force, trees, files and whole alignments."""

import gzip
import itertools

import numpy as np
import pytest

from strandflow.functions.alphabet import Scoring, nucleotide_matrix, read_matrix
from strandflow.operators import kernel
from strandflow.plans import modes
from strandflow.sources import fasta, newick


def every_path(n, m):
    """All paths of m reference and n query columns."""
    if not n or not m:
        yield [2] * m + [1] * n
        return
    for rest, step in ((every_path(n - 1, m - 1), 0), (every_path(n - 1, m), 1), (every_path(n, m - 1), 2)):
        for p in rest:
            yield [*p, step]


def score_of(path, sim, scoring):
    """Affine score; a leading gap costs its opening and extensions, and the first match none."""
    i = j = 0
    total, before = 0.0, 0
    for k, step in enumerate(path):
        if step == 0:
            total += sim[i, j]
            i, j = i + 1, j + 1
        else:
            total += scoring.gap_extend if before == step and k else scoring.gap_open
            i, j = i + (step == 1), j + (step == 2)
        before = step
    return total


@pytest.mark.parametrize("a, b", [("ACGT", "AGT"), ("AAAA", "AA"), ("ACG", "ACG"), ("GATT", "CATG"), ("A", "ACGTA")])
def test_inner_alignments_are_optimal(a, b):
    scoring = Scoring(gap_open=-10, gap_extend=-2)
    ref, qry = kernel.profile_of([a], None), kernel.profile_of([b], None)
    sim = kernel.similarity(ref, qry, scoring, scoring.gap_extend)
    path, _ = kernel.align_columns(sim, *kernel.gap_penalties(ref, scoring), *kernel.gap_penalties(qry, scoring), scoring)
    assert (path != 1).sum() == len(a) and (path != 2).sum() == len(b)
    # the last columns always face each other, as in the recurrence
    best = max(score_of(p, sim, scoring) for p in every_path(len(b), len(a)) if p[-1] == 0)
    assert score_of(path.tolist(), sim, scoring) == pytest.approx(best)


def starts_once(path):
    """Only one side has gaps before the first match, as in the recurrence."""
    before = path[: path.index(0)] if 0 in path else [1, 2]
    return len(set(before)) < 2


def random_problem(rng, most):
    scoring = Scoring(gap_open=-float(rng.integers(5, 30)), gap_extend=-float(rng.integers(1, 5)))
    a, b = ("".join(rng.choice(list("ACGT"), int(rng.integers(1, most)))) for _ in range(2))
    ref, qry = kernel.profile_of([a], None), kernel.profile_of([b], None)
    return (kernel.similarity(ref, qry, scoring, scoring.gap_extend), *kernel.gap_penalties(ref, scoring), *kernel.gap_penalties(qry, scoring), scoring), (ref, qry)


def test_random_alignments_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        problem, _ = random_problem(rng, 6)
        path, score = kernel.align_columns(*problem)
        best = max(score_of(p, problem[0], problem[-1]) for p in every_path(*problem[0].shape) if starts_once(p))
        assert score_of(path.tolist(), problem[0], problem[-1]) == pytest.approx(best)


def test_blocks_of_diagonals_and_cells_give_the_whole_matrix():
    """The same path with a few pointers at a time, with similarities by the cell, and with a drop that is doubled until the band lives."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        problem, (ref, qry) = random_problem(rng, 60)
        path, score = kernel.align_columns(*problem)
        for pointers in (1, 200, 1000):
            again, same = kernel.align_columns(*problem, pointers=pointers)
            assert again.tolist() == path.tolist() and same == score
        cells = kernel.Similarity(ref, qry, problem[-1], problem[-1].gap_extend)
        assert kernel.align_columns(cells, *problem[1:])[1] == pytest.approx(score)
        assert kernel.align_columns(*problem, xdrop=1e9)[1] == score
        near, at_most = kernel.align_columns(*problem, xdrop=1.0)
        assert at_most <= score + 1e-9 and (near != 1).sum() == len(ref) and (near != 2).sum() == len(qry)


def test_protein():
    letters = "ACDEFGHIKLMNPQRSTVWY"
    matrix = read_matrix(" ".join(letters) + "\n" + "\n".join(" ".join("25" if i == j else "-5" for j in range(20)) for i in range(20)), "p")
    scoring = Scoring(kind="p", matrix=matrix)
    whole, part = (kernel.profile_of([x], None, "p") for x in ("MKTAYIAKQRX", "MKTAYAKQRX"))
    assert kernel.align_profiles(whole, part, scoring).tolist() in ([0] * 5 + [2] + [0] * 5, [0] * 4 + [2] + [0] * 6)
    assert kernel.consensus_of(kernel.profile_of(["MK-", "MKX"], None, "p"), "p") == "MKX"
    with pytest.raises(ValueError):
        Scoring(kind="p")


def test_closure_of_a_long_chain(spark):
    """Deeper than Spark's recursion limit, and over a million rows."""
    from strandflow.operators import tree

    n = 1500
    nodes = spark.range(n).selectExpr("cast(id as string) as node_id", "case when id > 0 then cast(id - 1 as string) end as parent_id")
    up = tree.closure(spark, nodes)
    assert up.count() == n * (n + 1) // 2
    assert up.where("cast(node_id as int) - cast(anc_id as int) <> dist").isEmpty()


def test_average_linkage():
    rng = np.random.default_rng(4)
    d = rng.random((7, 7))
    d = (d + d.T) / 2
    made = newick.upgma([f"s{k}" for k in range(7)], d)
    groups = [frozenset([k]) for k in range(7)]
    found = {frozenset(int(x.name[1:]) for x in n.leaves()) for n in made.walk() if n.children}
    expected = set()
    while len(groups) > 1:  # by the mean over all pairs, from the definition
        a, b = min(itertools.combinations(groups, 2), key=lambda p: np.mean([d[i, j] for i in p[0] for j in p[1]]))
        groups = [g for g in groups if g not in (a, b)] + [a | b]
        expected.add(a | b)
    assert found == expected


def test_part_schedule():
    tree = newick.binarize(newick.star([f"s{k:02d}" for k in range(40)]))
    roots = newick.partition(tree, 6)
    levels = newick.part_schedule(newick.contract(tree, roots))
    gone = set()
    for pairs in levels:
        named = [g for p in pairs for g in p]
        assert len(named) == len(set(named)) and not gone & set(named)
        gone |= {b for _, b in pairs}
    assert gone == set(roots) - {tree.group} and len(levels) < len(roots) - 1


def test_deferred_sequences_come_last(spark):
    good = "ACGTTGCAACGGTATCGATTACAGGC"
    rows = [(k, f"s{k}", good[: 26 - k % 3], "ok") for k in range(6)] + [(6, "s6", "TTTT", "deferred"), (7, "s7", "ACGTTGCNNNNNNNNNNNNNNCAGGC", "deferred"), (8, "s8", good, "excluded")]
    frame = spark.createDataFrame(rows, "seq_id long, name string, seq string, status string")
    tree = newick.star([f"s{k}" for k in range(9)])
    found = {r.name: r.aligned for r in modes.build(spark, frame, tree, modes.Options(most=3)).collect()}
    assert set(found) == {f"s{k}" for k in range(8)} and len({len(x) for x in found.values()}) == 1
    assert all(found[n].replace("-", "") == s for _, n, s, status in rows if status != "excluded")
    alone = {r.name: r.aligned for r in modes.build(spark, frame.where("status = 'ok'"), newick.prune(tree, {f"s{k}" for k in range(6)}), modes.Options(most=3)).collect()}
    wide = ["".join(c) for c in zip(*[found[n] for n in sorted(alone)], strict=True)]
    kept = [c for c in wide if set(c) != {"-"}]
    assert ["".join(c) for c in zip(*[alone[n] for n in sorted(alone)], strict=True)] == kept  # the others are aligned as if there were none


def test_files_of_a_run(spark, tmp_path):
    """Tree and sequences from files, an alignment and its parts, filtered rows and trees to files."""
    names = [f"s{k}" for k in range(8)]
    (tmp_path / "in.fa").write_text("".join(f">{n} text\nACGTTG\nCA{'ACGT'[k % 4]}C\n" for k, n in enumerate([*names, "other"])))
    tree = newick.prune(newick.parse("(" + ",".join([*names, "gone"]) + ");"), set(names))
    tree = newick.reroot(tree)
    roots = newick.partition(tree, 3)
    leaves = spark.createDataFrame([(n.name, n.group, 1.0) for n in tree.walk() if n.is_leaf], "name string, group_id int, weight double")
    rows = fasta.read_sequences(spark, str(tmp_path / "in.fa"), leaves)
    assert {r.name for r in rows.collect()} == set(names)
    made = modes.build(spark, rows.select("seq_id", "name", "seq"), tree, modes.Options(most=3))
    fasta.write_parts(made, str(tmp_path / "parts"))
    assert sum(fasta.read_fasta(spark, str(p)).count() for p in (tmp_path / "parts").iterdir() if p.is_dir()) == 8
    fasta.write_tree(spark, tree, str(tmp_path / "tree"))
    text = spark.read.text(str(tmp_path / "tree")).first()[0]
    assert sorted(n.name for n in newick.parse(text).leaves()) == names
    fasta.write_subtrees(spark, roots, str(tmp_path / "subtrees"))
    assert spark.read.text(str(tmp_path / "subtrees")).count() == len(roots)
    status = rows.select("name", "seq").selectExpr("name", "seq", "case when name = 's1' then 'excluded' else 'ok' end as status")
    fasta.write_filtered(status, str(tmp_path / "filtered"))
    assert [r.name for r in fasta.read_fasta(spark, str(tmp_path / "filtered")).collect()] == ["s1"]


def test_iterations(spark):
    rows = [(k, f"s{k}", "ACGTTGCAACGGTATCGA"[k % 3 : 18 - k % 2]) for k in range(6)]
    frame = spark.createDataFrame(rows, "seq_id long, name string, seq string")
    found = modes.iterate(spark, frame, rounds=2).collect()
    assert {(r.name, r.aligned.replace("-", "")) for r in found} == {(n, s) for _, n, s in rows}
    with pytest.raises(ValueError):
        modes.iterate(spark, frame, rounds=6)


def test_equal_sequences_have_no_gaps():
    p = kernel.profile_of(["ACGTTGCAAC"], None)
    assert kernel.align_profiles(p, p, Scoring()).tolist() == [0] * 10
    assert kernel.pairwise("ACGGT", "ACGGT", Scoring())[0].tolist() == [0] * 5


def test_empty_and_ambiguous():
    empty, some = kernel.profile_of([""], None), kernel.profile_of(["ACG"], None)
    assert kernel.align_profiles(empty, some, Scoring()).tolist() == [1, 1, 1]
    assert kernel.align_profiles(some, empty, Scoring()).tolist() == [2, 2, 2]
    assert kernel.consensus_of(kernel.profile_of(["N-x"], None)) == "NNN"
    assert kernel.consensus_of(kernel.profile_of(["au", "AT"], None)) == "AT"


def test_gappy_columns_come_back():
    ref = kernel.profile_of(["AC" + "-" * 3 + "GT"] * 30 + ["ACTTTGT"], None)
    qry = kernel.profile_of(["ACGT"], None)
    path = kernel.align_profiles(ref, qry, Scoring(), 0.9)
    assert path.tolist() == [0, 0, 2, 2, 2, 0, 0]
    assert kernel.runs_of(np.array([1, 1, 0, 1], bool)) == [(0, 2), (3, 1)]


def test_matrices():
    m = nucleotide_matrix()
    assert (m[0, 0], m[0, 2], m[0, 1], m[4, 0]) == (18, -4, -8, 0)
    assert np.array_equal(read_matrix("A C G T\n" + "\n".join(" ".join("4" if i == j else "-1" for j in range(4)) for i in range(4)), wildcard=True)[4], [4] * 5)
    with pytest.raises(ValueError):
        read_matrix("A C G J2\n1 1 1 1")
    with pytest.raises(ValueError):
        Scoring(gap_open=1)


NEWICK = [
    ("(A:1,B:2);", ["A", "B"]),
    ("((A,B),(C,D)x:2)r;", ["A", "B", "C", "D"]),
    ("('a b':1,(C:0.5,'d''e':0):1,F:3);", ["a b", "C", "d'e", "F"]),
    ("((((A:1):2)):1,B:1);", ["A", "B"]),
    ("(A,A,B);", ["A", "A_dup_1", "B"]),
]


@pytest.mark.parametrize("text, names", NEWICK)
def test_newick(text, names):
    tree = newick.parse(text)
    assert [n.name for n in tree.leaves()] == names
    again = newick.parse(newick.write(tree))
    assert [r[3] for r in newick.to_rows(again)] == [r[3] for r in newick.to_rows(tree)]
    for made in (newick.binarize(tree), newick.reroot(tree)):
        assert sorted(n.name for n in made.leaves()) == sorted(names)
        assert all(len(n.children) in (0, 2) for n in made.walk() if n.parent is not None)


@pytest.mark.parametrize("text", ["((A,B);", "(A,B));", ""])
def test_broken_newick(text):
    with pytest.raises(ValueError):
        newick.parse(text)


def test_tree_algebra():
    tree = newick.parse("((A:1,B:2):1,(C:1,(D:2,E:3):1):2);")
    kept = newick.prune(tree, {"A", "D"})
    assert sorted((n.name, n.length) for n in kept.leaves()) == [("A", 2.0), ("D", 5.0)]
    parts = newick.partition(newick.binarize(newick.star("abcdefgh")), 3)
    assert len(parts) >= 3 and all(sum(x.is_leaf and x.group == g for x in n.walk()) <= 3 for g, n in parts.items())
    pairs = newick.schedule(newick.star("abcde"))
    assert pairs == [(0, 0, "a", "b"), (0, 1, "c", "d"), (1, 0, "a", "c"), (2, 0, "a", "e")]


ROWS = [("a", "ACGTACGTAC"), ("b", "ACGTCGTAC"), ("c", "ACGTACGGTAC"), ("d", "TTACGTACGTAC"), ("e", "ACGTAC"), ("f", "acguacguac"), ("g", "NNNN")]


def check(rows, expected):
    assert len({len(r.aligned) for r in rows}) == 1
    assert {r.name: r.aligned.replace("-", "").replace(".", "") for r in rows} == dict(expected)


@pytest.mark.parametrize("most", [500, 2])
def test_build(spark, most):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)] + [(99, "a", "TTTT"), (100, "other", "A")], "seq_id long, name string, seq string")
    check(modes.build(spark, frame, newick.star([n for n, _ in ROWS]), modes.Options(most=most)).collect(), ROWS)


def test_place(spark):
    back = spark.createDataFrame([("x", "AC-GT"), ("y", "ACCGT")], "name string, aligned string")
    fresh = spark.createDataFrame([("p", "ACCGT"), ("q", "ATTTCCGTA"), ("r", "")], "name string, seq string")
    expected = [("x", "ACGT"), ("y", "ACCGT"), ("p", "ACCGT"), ("q", "ATTTCCGTA"), ("r", "")]
    check(modes.place(spark, fresh, back).collect(), expected)
    tree = newick.parse("((x:1,p:1):1,(y:1,(q:1,r:1):1):1);")
    check(modes.place_on_tree(spark, fresh, back, tree).collect(), expected)
    check(modes.place_on_tree(spark, fresh, back, tree, modes.Options(most=2)).collect(), expected)


def test_worked_insertions():
    """Two rows with paths 0 1 0 0 and 0 1 1 0 2 on three columns: the longest insertion has two slots."""
    a, b = (np.array(x, np.int8) for x in ([0, 1, 0, 0], [0, 1, 1, 0, 2]))
    slots = np.maximum(modes.insertions(a, 3), modes.insertions(b, 3))
    assert slots.tolist() == [0, 2, 0, 0]
    assert modes.slotted("xyxx", a, slots) == "xy.xx" and modes.slotted("xyyx", b, slots) == "xyyx-"


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG-T\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">three\nTT\n")
    rows = fasta.read_fasta(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.seq) for r in rows) == [("one", "ACGTAC"), ("three", "TT"), ("two", "GG-T")]
    out = spark.createDataFrame([("n", "AC-G")], "name string, aligned string")
    fasta.write_fasta(out, str(tmp_path / "out"), compress=True)
    assert [(r.name, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()] == [("n", "AC-G")]
    (tmp_path / "q.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    assert [(r.name, r.seq) for r in fasta.read_fastq(spark, str(tmp_path / "q.fq")).orderBy("name").collect()] == [("r1", "ACGT"), ("r2", "GG")]


def test_all_pairs_of_short_strings_keep_their_letters():
    for a, b in itertools.product(["", "A", "AC", "GTT"], repeat=2):
        path, _ = kernel.pairwise(a, b, Scoring())
        assert kernel.replay(a, path, 1).replace("-", "") == a and kernel.replay(b, path, 2).replace("-", "") == b


def test_stream(spark, tmp_path):
    from strandflow.streaming.placement import place_stream

    back = spark.createDataFrame([("x", "AC-GT"), ("y", "ACCGT")], "name string, aligned string")
    spark.createDataFrame([("p", "ACGT"), ("q", "ACCCGT")], "name string, seq string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, seq string").json(str(tmp_path / "in"))
    running = place_stream(stream, back, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    check([r for r in rows], [("x", "ACGT"), ("y", "ACCGT"), ("p", "ACGT"), ("q", "ACCCGT")])
