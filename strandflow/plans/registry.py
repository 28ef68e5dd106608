"""Every query of the engine over the driver's whole tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.alphabet import GAP_EXTEND, Scoring, letter_index, nucleotide_matrix
from strandflow.functions.storage import kept
from strandflow.operators import kernel, profile, qc, rewrite, tree
from strandflow.plans import modes
from strandflow.plans import projections as P
from strandflow.sources import fasta, newick

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_LETTER = "CASE WHEN ch IN ('-', '.') THEN 5 WHEN upper(ch) = 'A' THEN 0 WHEN upper(ch) = 'C' THEN 1 WHEN upper(ch) = 'G' THEN 2 WHEN upper(ch) IN ('T', 'U') THEN 3 ELSE 4 END"


def _cells(source: str = "msa", name: str = "cells") -> str:
    return f"{name} AS (SELECT node, row_id, weight, unnest(range(length(aligned))) AS pos, unnest(string_split(aligned, '')) AS ch FROM {source})"


_PROFILE = f"""{P.msa_sql()}, {_cells()},
raw AS (SELECT node, pos, {_LETTER} AS letter, sum(weight) AS freq, count(*) AS n FROM cells GROUP BY ALL),
sizes AS (SELECT node, count(*) AS n, sum(weight) AS w FROM msa GROUP BY node),
prof AS (SELECT node, pos, letter, freq / w * sizes.n AS freq FROM raw JOIN sizes USING (node))"""


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns}).withColumn("pos", F.col("pos").cast("long"))


# profiles


@query(f"WITH {_PROFILE} SELECT node, pos, letter::INTEGER AS letter, n::BIGINT AS n FROM raw")
def column_profile(spark, sf_dir):
    cells = qc.cells(P.msa(spark, sf_dir))
    return cells.groupBy("node", F.col("pos").cast("long").alias("pos"), letter_index(F.col("ch")).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PROFILE} SELECT node, pos, letter::INTEGER AS letter, round(freq, 6) AS freq FROM prof")
def weighted_profile(spark, sf_dir):
    return _rounded(profile.profile(P.msa(spark, sf_dir)), "freq")


@query(f"WITH {P.msa_sql(node='p_type')}, {_cells()} SELECT node, pos, {_LETTER}::INTEGER AS letter, sum(weight) AS freq FROM cells GROUP BY ALL")
def subtree_profile(spark, sf_dir):
    return profile.raw_profile(P.msa(spark, sf_dir, node="p_type")).withColumn("pos", F.col("pos").cast("long"))


_CONSENSUS = f"""WITH {_PROFILE},
best AS (SELECT node, pos, letter, row_number() OVER (PARTITION BY node, pos ORDER BY CASE WHEN letter < 4 THEN freq ELSE -1 END DESC, letter) AS r FROM prof),
picked AS (SELECT node, pos, CASE WHEN letter < 4 THEN substr('ACGT', letter::INTEGER + 1, 1) ELSE 'N' END AS letter FROM best WHERE r = 1)"""


@query(
    f"""{_CONSENSUS} SELECT node, pos, letter, round(gaps / n, 6) AS gap_share FROM picked JOIN
(SELECT node, pos, count(*) AS n, count(*) FILTER (WHERE ch IN ('-', '.')) AS gaps FROM cells GROUP BY ALL) USING (node, pos)"""
)
def consensus(spark, sf_dir):
    rows = P.msa(spark, sf_dir)
    gaps = qc.gap_counts(rows).select("node", "pos", F.round(F.col("gaps") / F.col("n"), 6).alias("gap_share"))
    return profile.consensus(profile.profile(rows)).join(gaps, ["node", "pos"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"{_CONSENSUS} SELECT node, string_agg(letter, '' ORDER BY pos) AS consensus FROM picked GROUP BY node")
def consensus_string(spark, sf_dir):
    return profile.consensus_strings(profile.consensus(profile.profile(P.msa(spark, sf_dir))))


_GAPPY = f"""WITH {P.msa_sql()}, {_cells()},
gappy AS (SELECT node, pos FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE ch IN ('-', '.')) / count(*) > 0.2)"""


@query(f"""{_GAPPY} SELECT node, min(pos) AS start, count(*) AS len FROM (SELECT node, pos, pos - row_number() OVER (PARTITION BY node ORDER BY pos) AS island FROM gappy) GROUP BY node, island""")
def gappy_runs(spark, sf_dir):
    return qc.runs(qc.gappy_columns(P.msa(spark, sf_dir), 0.2))


@query(
    f"""{_GAPPY}, kept AS (SELECT c.* FROM cells c ANTI JOIN gappy g ON c.node = g.node AND c.pos = g.pos)
SELECT m.node, m.row_id, coalesce(string_agg(k.ch, '' ORDER BY k.pos), '') AS aligned FROM msa m LEFT JOIN kept k ON k.node = m.node AND k.row_id = m.row_id GROUP BY ALL"""
)
def gappy_compact(spark, sf_dir):
    rows = P.msa(spark, sf_dir)
    keep = qc.gap_counts(rows).where(F.col("gaps") / F.col("n") <= 0.2).groupBy("node").agg(F.sort_array(F.collect_list("pos")).alias("keep"))
    return qc.masked(rows, keep)


@query(
    f"""WITH {_PROFILE}, sums AS (SELECT node, pos, sum(freq) AS n, sum(CASE WHEN letter = 5 THEN freq ELSE 0.0 END) AS g FROM prof GROUP BY ALL)
SELECT node, pos, round(CASE WHEN g > 0 THEN least(-5.0, -50.0 * 0.5 * (n - g) / n) ELSE -50.0 END, 4) AS op, round(CASE WHEN g > 0 THEN least(-1.0, -5.0 * (n - g) / n) ELSE -5.0 END, 4) AS ex FROM sums"""
)
def gap_penalties(spark, sf_dir):
    out = profile.gap_penalties(profile.profile(P.msa(spark, sf_dir)))
    return out.select("node", F.col("pos").cast("long").alias("pos"), F.round("op", 4).alias("op"), F.round("ex", 4).alias("ex"))


_PATHS = "paths AS (SELECT node AS pair_id, k, ((length(node) + k) % 3)::INTEGER AS step FROM (SELECT DISTINCT node FROM msa), (SELECT unnest(range((SELECT max(length(p_name)) FROM part))) AS k))"


@query(
    f"""WITH {_PROFILE}, {_PATHS},
walked AS (SELECT *, sum((step <> 1)::INTEGER) OVER w - 1 AS ref, sum((step <> 2)::INTEGER) OVER w - 1 AS qry FROM paths WINDOW w AS (PARTITION BY pair_id ORDER BY k)),
added AS (
  SELECT pair_id, k, letter, n::DOUBLE AS freq FROM walked JOIN raw ON node = pair_id AND pos = ref WHERE step <> 1
  UNION ALL SELECT pair_id, k, letter, raw.freq FROM walked JOIN raw ON node = pair_id AND pos = qry WHERE step <> 2
  UNION ALL SELECT pair_id, k, 5, CASE WHEN step = 1 THEN 3.0 ELSE 2.0 END FROM walked WHERE step <> 0)
SELECT pair_id, k AS pos, letter::INTEGER AS letter, sum(freq) AS freq FROM added GROUP BY ALL"""
)
def profile_merge(spark, sf_dir):
    rows = P.msa(spark, sf_dir)
    qry = profile.raw_profile(rows).withColumnRenamed("node", "pair_id")
    ref = profile.raw_profile(rows.withColumn("weight", F.lit(1.0))).withColumnRenamed("node", "pair_id")
    steps = rows.groupBy(F.col("node").alias("pair_id")).agg(F.max(F.length("aligned")).alias("w")).select("pair_id", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("k"))
    paths = steps.select("pair_id", "k", ((F.length("pair_id") + F.col("k")) % 3).alias("step"))
    return profile.merge_along(ref, qry, paths, 5, 3.0, 2.0).withColumn("pos", F.col("pos").cast("long"))


_MATRIX = ", ".join(f"({a}, {b}, {s})" for a, b, s in profile.matrix_rows(nucleotide_matrix(), GAP_EXTEND))


@query(
    f"""WITH {P.msa_sql('left_msa', 'p_name', "'names'")}, {P.msa_sql('right_msa', 'p_type', "'types'")}, {_cells('left_msa', 'left_cells')}, {_cells('right_msa', 'right_cells')},
a AS (SELECT pos, {_LETTER} AS letter, sum(weight) AS freq FROM left_cells GROUP BY ALL), b AS (SELECT pos, {_LETTER} AS letter, sum(weight) AS freq FROM right_cells GROUP BY ALL),
m(letter_a, letter_b, score) AS (VALUES {_MATRIX})
SELECT a.pos AS ref_pos, b.pos AS qry_pos, round(sum(a.freq * b.freq * score) / ((SELECT sum(weight) FROM left_msa) * (SELECT sum(weight) FROM right_msa)), 4) AS score
FROM a JOIN m ON a.letter = letter_a JOIN b ON b.letter = letter_b GROUP BY ALL"""
)
def profile_similarity(spark, sf_dir):
    ref = profile.raw_profile(P.msa(spark, sf_dir, "p_name", "names")).drop("node")
    qry = profile.raw_profile(P.msa(spark, sf_dir, "p_type", "types")).drop("node")
    matrix = spark.createDataFrame(profile.matrix_rows(nucleotide_matrix(), GAP_EXTEND), "letter_a int, letter_b int, score double")
    out = profile.similarity(ref, qry, matrix, 5, GAP_EXTEND)
    return out.select(F.col("ref_pos").cast("long").alias("ref_pos"), F.col("qry_pos").cast("long").alias("qry_pos"), F.round("score", 4).alias("score"))


# quality control

_STATS = f"""WITH {P.SEQS}, ranked AS (SELECT length(seq) AS len, row_number() OVER (ORDER BY length(seq)) AS r, count(*) OVER () AS n FROM seqs),
stats AS (SELECT max(n) AS n_seqs, min(len) AS min_len, max(len) AS max_len, sum(len)::BIGINT // count(*) AS avg_len, max(len) FILTER (WHERE r = n // 2 + 1) AS median_len FROM ranked)"""


@query(f"{_STATS} SELECT n_seqs::BIGINT AS n_seqs, min_len, max_len, avg_len::BIGINT AS avg_len, median_len FROM stats")
def length_stats(spark, sf_dir):
    return qc.length_stats(P.sequences(spark, sf_dir))


@query(f"{_STATS} SELECT seq_id, name, length(seq) AS len FROM seqs, stats WHERE length(seq) BETWEEN floor(median_len * 0.5) AND floor(median_len * 1.5)")
def length_filter(spark, sf_dir):
    seqs = P.sequences(spark, sf_dir)
    return qc.with_status(seqs, qc.length_bounds(seqs, 0.5), 1.0).where("status = 'ok'").select("seq_id", "name", "len")


_AMBIGUOUS = "length(regexp_replace(seq, '[ACGTUacgtu.-]', '', 'g'))"


@query(f"WITH {P.SEQS} SELECT seq_id, length(seq) AS len, {_AMBIGUOUS} AS n_ambiguous, {_AMBIGUOUS} > length(seq) * 0.1 AS low_quality FROM seqs")
def ambiguity_filter(spark, sf_dir):
    seqs = P.sequences(spark, sf_dir)
    wide = spark.range(1).select(F.lit(0).cast("long").alias("low"), F.lit(2**62).alias("high"))
    return qc.with_status(seqs, wide).select("seq_id", "len", "n_ambiguous", (F.col("status") != "ok").alias("low_quality"))


@query(
    f"""{_STATS} SELECT seq_id, name, length(seq) AS len, {_AMBIGUOUS} AS n_ambiguous,
CASE WHEN length(seq) > floor(median_len * 1.5) OR length(seq) < floor(median_len * 0.5) OR {_AMBIGUOUS} > length(seq) * 0.3 THEN 'excluded' ELSE 'ok' END AS status FROM seqs, stats"""
)
def qc_status(spark, sf_dir):
    seqs = P.sequences(spark, sf_dir)
    return qc.with_status(seqs, qc.length_bounds(seqs, 0.5), 0.3, drop=True)


@query(
    f"""WITH {P.SEQS}, firsts AS (SELECT * FROM seqs ORDER BY seq_id LIMIT 100),
found AS (SELECT seq_id, unnest(range(length(seq))) AS k, unnest(string_split(seq, '')) AS c FROM firsts)
SELECT coalesce((SELECT CASE WHEN upper(c) = 'U' THEN 'n' ELSE 'p' END FROM found WHERE upper(c) IN ('E','F','I','J','L','P','Q','Z','U') ORDER BY seq_id, k LIMIT 1), 'n') AS kind"""
)
def type_inference(spark, sf_dir):
    """The feature itself looks at the first 100 sequences."""
    return fasta.infer_kind(P.sequences(spark, sf_dir).withColumnRenamed("seq_id", "file_ord"))


_NAMES = "named AS (SELECT seq_id, substr(md5(seq), 1, 2) AS name, seq FROM seqs)"


def _named(spark, sf_dir):
    return P.sequences(spark, sf_dir).withColumn("name", F.substring(F.md5(F.col("seq").cast("binary")), 1, 2))


@query(f"WITH {P.SEQS}, {_NAMES} SELECT name, min(seq_id) AS seq_id, arg_min(seq, seq_id) AS seq FROM named GROUP BY name")
def dedup_first(spark, sf_dir):
    return qc.first_of_names(_named(spark, sf_dir))


@query(f"WITH {P.SEQS} SELECT seq_id, name, length(seq) AS len FROM seqs SEMI JOIN (SELECT 'S' || s_suppkey AS name FROM supplier) USING (name)")
def names_in_tree(spark, sf_dir):
    leaves = P.nodes(spark, sf_dir).where("is_leaf").select(F.col("node_id").alias("name"))
    return qc.in_tree(P.sequences(spark, sf_dir), leaves).select("seq_id", "name", F.length("seq").cast("long").alias("len"))


@query(f"WITH RECURSIVE {P.SEQS}, {P.NODES} SELECT node_id AS name FROM nodes WHERE is_leaf AND node_id NOT IN (SELECT name FROM seqs)")
def missing_leaves(spark, sf_dir):
    leaves = P.nodes(spark, sf_dir).where("is_leaf").select(F.col("node_id").alias("name"))
    return qc.missing_leaves(P.sequences(spark, sf_dir), leaves)


@query(f"WITH {P.SEQS} SELECT DISTINCT name FROM seqs")
def sequence_names(spark, sf_dir):
    return P.sequences(spark, sf_dir).select("name").distinct()


@query(
    f"""WITH {P.msa_sql()}, {_cells()}, kept AS (SELECT node, pos FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE ch = '-') <= floor(0.3 * count(*)))
SELECT m.node, m.row_id, coalesce(string_agg(c.ch, '' ORDER BY c.pos), '') AS aligned FROM msa m LEFT JOIN (SELECT * FROM cells SEMI JOIN kept USING (node, pos)) c USING (node, row_id) GROUP BY ALL"""
)
def column_mask(spark, sf_dir):
    rows = P.msa(spark, sf_dir)
    return qc.masked(rows, qc.kept_columns(rows, F.col("gaps") <= F.floor(0.3 * F.col("n"))))


@query(
    f"""WITH {P.msa_sql()}, {_cells()}, kept AS (SELECT node, pos FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE ch <> '-') > 0)
SELECT node, count(*) AS n_columns FROM kept GROUP BY node"""
)
def allgap_columns(spark, sf_dir):
    return qc.kept_columns(P.msa(spark, sf_dir), F.col("gaps") < F.col("n")).select("node", F.size("keep").cast("long").alias("n_columns"))


_INFO = f"WITH {P.msa_sql()}, info AS (SELECT node, count(*) AS n_rows, max(length(aligned)) AS width FROM msa GROUP BY node)"


@query(f"{_INFO} SELECT node, n_rows, width FROM info")
def msa_info(spark, sf_dir):
    return qc.msa_info(P.msa(spark, sf_dir))


@query(f"{_INFO} SELECT node, n_rows, row_number() OVER (ORDER BY n_rows DESC, node) - 1 AS merge_level FROM info")
def merge_order(spark, sf_dir):
    return rewrite.merge_order(qc.msa_info(P.msa(spark, sf_dir)))


@query(
    f"""{_INFO}, ambiguous AS (SELECT node, sum(length(regexp_replace(aligned, '[ACGTUacgtu.-]', '', 'g'))) AS n_ambiguous FROM msa GROUP BY node)
SELECT node, n_rows, width, row_number() OVER (ORDER BY n_rows DESC, width DESC, node) AS turn FROM info JOIN ambiguous USING (node) WHERE n_ambiguous > 0.1 * n_rows * width"""
)
def deferred_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = P.msa(spark, sf_dir)
    bad = rows.groupBy("node").agg(F.sum(F.length(F.regexp_replace("aligned", "[ACGTUacgtu.-]", ""))).alias("n_ambiguous"))
    late = qc.msa_info(rows).join(bad, "node").where(F.col("n_ambiguous") > 0.1 * F.col("n_rows") * F.col("width"))
    turn = F.row_number().over(Window.orderBy(F.col("n_rows").desc(), F.col("width").desc(), "node"))  # one row for each alignment
    return late.select("node", "n_rows", "width", turn.cast("long").alias("turn"))


# trees

_TREE = f"WITH RECURSIVE {P.NODES}"


def _tree(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir)
    return nodes, tree.closure(spark, nodes)


@query(f"{_TREE} SELECT node_id, coalesce(num_leaves, 0) AS num_leaves FROM nodes LEFT JOIN leafs USING (node_id)")
def tree_leaf_counts(spark, sf_dir):
    return tree.leaf_counts(*_tree(spark, sf_dir))


@query(f"{_TREE} SELECT node_id, count(*) AS level FROM up GROUP BY node_id")
def tree_levels(spark, sf_dir):
    return tree.levels(_tree(spark, sf_dir)[1])


@query(f"{_TREE} SELECT node_id, parent_id, branch_length FROM fixed")
def branch_repair(spark, sf_dir):
    return tree.repaired(P.nodes(spark, sf_dir)).select("node_id", "parent_id", "branch_length")


@query(
    f"""{_TREE}, w AS (SELECT u.node_id, sum(f.branch_length / l.num_leaves) AS w FROM up u JOIN nodes n ON n.node_id = u.node_id AND n.is_leaf JOIN fixed f ON f.node_id = u.anc_id JOIN leafs l ON l.node_id = u.anc_id GROUP BY u.node_id)
SELECT node_id, round(w / (SELECT max(w) FROM w), 6) AS weight FROM w"""
)
def tree_weights(spark, sf_dir):
    nodes, up = _tree(spark, sf_dir)
    return tree.weights(tree.repaired(nodes), up).withColumn("weight", F.round("weight", 6))


@query(
    f"""{_TREE}, kept AS (SELECT 'C' || o_custkey AS node_id FROM orders GROUP BY 1 HAVING count(*) >= 12),
alive AS (SELECT DISTINCT anc_id AS node_id FROM up SEMI JOIN kept USING (node_id)),
stays AS (SELECT n.node_id FROM nodes n JOIN alive USING (node_id) WHERE n.parent_id IS NULL OR n.is_leaf OR (SELECT count(*) FROM nodes c JOIN alive a ON a.node_id = c.node_id WHERE c.parent_id = n.node_id) >= 2),
near AS (SELECT u.node_id, arg_min(u.anc_id, u.dist) AS parent_id, min(u.dist) AS upto FROM up u JOIN stays s ON s.node_id = u.anc_id WHERE u.dist > 0 GROUP BY u.node_id)
SELECT s.node_id, r.parent_id, coalesce((SELECT sum(f.branch_length) FROM up u JOIN fixed f ON f.node_id = u.anc_id WHERE u.node_id = s.node_id AND u.dist < r.upto), 0.0) AS branch_length
FROM stays s LEFT JOIN near r ON r.node_id = s.node_id"""
)
def tree_prune(spark, sf_dir):
    nodes, up = _tree(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kept = orders.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("node_id")).count().where("count >= 12").select("node_id")
    return tree.pruned(tree.repaired(nodes), up, kept)


@query(
    f"""{_TREE}, ranked AS (SELECT node_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY child_ord, node_id) - 1 AS k, count(*) OVER (PARTITION BY parent_id) AS n FROM nodes WHERE parent_id IS NOT NULL)
SELECT node_id, parent_id, CASE WHEN NOT (k = n - 1 AND n % 2 = 1) THEN k // 2 END::BIGINT AS pair FROM ranked WHERE n > 2"""
)
def tree_binarize_round(spark, sf_dir):
    return tree.binarize_round(P.nodes(spark, sf_dir))


@query(
    f"""{_TREE} SELECT node_id, num_leaves FROM nodes JOIN leafs USING (node_id) WHERE NOT is_leaf
ORDER BY abs((SELECT num_leaves FROM leafs WHERE node_id = 'node_root') / 2 - num_leaves), node_id LIMIT 1"""
)
def centroid_cut(spark, sf_dir):
    nodes, up = _tree(spark, sf_dir)
    return tree.centroid(nodes, tree.leaf_counts(nodes, up))


@query(f"""{_TREE}, roots AS (SELECT node_id FROM nodes WHERE node_id LIKE 'node\\_r%' ESCAPE '\\')
SELECT r.node_id, (SELECT arg_min(u.anc_id, u.dist) FROM up u JOIN roots x ON x.node_id = u.anc_id WHERE u.node_id = r.node_id AND u.dist > 0) AS parent_id FROM roots r""")
def subtree_root_tree(spark, sf_dir):
    nodes, up = _tree(spark, sf_dir)
    roots = nodes.where("startswith(node_id, 'node_r')").select("node_id")
    return roots.join(tree.nearest_root(up, roots, itself=False), "node_id", "left").select("node_id", F.col("root_id").alias("parent_id"))


@query(
    f"""{_TREE}, marked AS (SELECT DISTINCT u.anc_id AS node_id FROM up u JOIN nodes n ON n.node_id = u.node_id WHERE n.is_leaf AND n.node_id LIKE 'S%')
SELECT u.node_id, arg_min(u.anc_id, u.dist) AS anchor FROM up u JOIN marked m ON m.node_id = u.anc_id JOIN nodes n ON n.node_id = u.node_id WHERE n.is_leaf AND n.node_id LIKE 'C%' GROUP BY u.node_id"""
)
def placement_anchor(spark, sf_dir):
    nodes, up = _tree(spark, sf_dir)
    placed = nodes.where("is_leaf and startswith(node_id, 'S')").select("node_id")
    marked = up.join(placed, "node_id", "left_semi").select(F.col("anc_id").alias("node_id")).distinct()
    waiting = nodes.where("is_leaf and startswith(node_id, 'C')").select("node_id")
    return tree.nearest_root(up.join(waiting, "node_id", "left_semi"), marked).withColumnRenamed("root_id", "anchor")


@query(f"{_TREE}, h AS (SELECT u.anc_id AS node_id, max(dist) AS height FROM up u JOIN nodes n ON n.node_id = u.node_id AND n.is_leaf GROUP BY u.anc_id) SELECT node_id, (height - 1)::BIGINT AS level FROM h WHERE height > 0")
def schedule_binary_levels(spark, sf_dir):
    return tree.heights(*_tree(spark, sf_dir))


@query(f"{_INFO}, ranked AS (SELECT node, row_number() OVER (ORDER BY n_rows DESC, node) - 1 AS r FROM info) SELECT (r - 1)::BIGINT AS level, (SELECT node FROM ranked WHERE r = 0) AS ref_id, node AS qry_id FROM ranked WHERE r > 0")
def schedule_star_merge(spark, sf_dir):
    ranked = rewrite.merge_order(qc.msa_info(P.msa(spark, sf_dir)))
    first = ranked.where("merge_level = 0").select(F.col("node").alias("ref_id"))
    return ranked.where("merge_level > 0").join(F.broadcast(first)).select((F.col("merge_level") - 1).alias("level"), "ref_id", F.col("node").alias("qry_id"))


@query(f"WITH {P.NEW} SELECT 0::BIGINT AS level, 'backbone' AS ref_id, name AS qry_id FROM fresh")
def schedule_placement(spark, sf_dir):
    return P.new_sequences(spark, sf_dir).select(F.lit(0).cast("long").alias("level"), F.lit("backbone").alias("ref_id"), F.col("name").alias("qry_id"))


# rewriting


def _path_rows(spark, sf_dir):
    return P.steps(spark, sf_dir).groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "step"))), lambda x: x["step"]).alias("path"))


_WALKED = f"""WITH {P.STEPS}, walked AS (SELECT *, sum((step <> 1)::INTEGER) OVER w - 1 AS ref, sum((step <> 2)::INTEGER) OVER w - 1 AS qry FROM steps WINDOW w AS (PARTITION BY pair_id ORDER BY k))"""


@query(
    f"""{_WALKED} SELECT pair_id, string_agg(CASE WHEN step = 1 THEN '-' ELSE substr('ACGT', (ref % 4 + 1)::INTEGER, 1) END, '' ORDER BY k) AS ref_row,
string_agg(CASE WHEN step = 2 THEN '-' ELSE substr('TGCA', (qry % 4 + 1)::INTEGER, 1) END, '' ORDER BY k) AS qry_row FROM walked GROUP BY pair_id"""
)
def apply_path(spark, sf_dir):
    rows = _path_rows(spark, sf_dir).withColumn("n", F.size("path"))
    ref, qry = (F.expr(f"repeat('{letters}', n)") for letters in ("ACGT", "TGCA"))
    return rows.select("pair_id", rewrite.replayed(ref, F.col("path"), 1).alias("ref_row"), rewrite.replayed(qry, F.col("path"), 2).alias("qry_row"))


@query(f"WITH {P.STEPS} SELECT pair_id, count(*) FILTER (WHERE step <> 1) AS ref_len, count(*) FILTER (WHERE step <> 2) AS qry_len FROM steps GROUP BY pair_id")
def path_check(spark, sf_dir):
    return rewrite.path_lengths(_path_rows(spark, sf_dir))


@query(
    f"""{_WALKED}, runs AS (SELECT pair_id, ref + 1 AS place, count(*) AS n FROM walked WHERE step = 1 GROUP BY ALL), longest AS (SELECT place, max(n) AS n FROM runs GROUP BY place)
SELECT place::BIGINT AS place, n, coalesce(sum(n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM longest"""
)
def merge_insertions(spark, sf_dir):
    return rewrite.slots(rewrite.insertion_runs(P.steps(spark, sf_dir).withColumnRenamed("pair_id", "row_id")))


@query(
    f"""WITH {P.msa_sql()}, {_cells()}
SELECT node, row_id, string_agg(CASE WHEN pos % 3 = length(node) % 3 THEN '-' || ch ELSE ch END, '' ORDER BY pos) AS aligned FROM cells GROUP BY ALL"""
)
def replay_union(spark, sf_dir):
    rows = P.msa(spark, sf_dir)
    opened = F.transform(F.sequence(F.lit(0), F.length("aligned") - 1), lambda i: F.when(i % 3 == F.length("node") % 3, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0))))
    return rows.select("node", "row_id", rewrite.replayed(F.col("aligned"), F.flatten(opened), 1).alias("aligned"))


@query(f"WITH {P.msa_sql()} SELECT node, row_id, regexp_replace(aligned, '[-.]', '', 'g') AS seq, length(aligned) AS width FROM msa")
def ungap_check(spark, sf_dir):
    return P.msa(spark, sf_dir).select("node", "row_id", qc.ungapped(F.col("aligned")).alias("seq"), F.length("aligned").cast("long").alias("width"))


@query(
    f"""WITH {P.SHORT}, grams AS (SELECT DISTINCT seq_id, substr(seq, i::INTEGER, 6) AS gram FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 4)) AS i FROM short WHERE length(seq) >= 6)),
sizes AS (SELECT seq_id, count(*) AS n FROM grams GROUP BY seq_id)
SELECT a.seq_id AS a, b.seq_id AS b, round(1 - count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS distance
FROM grams a JOIN grams b ON a.gram = b.gram AND a.seq_id < b.seq_id JOIN sizes x ON x.seq_id = a.seq_id JOIN sizes y ON y.seq_id = b.seq_id GROUP BY a.seq_id, b.seq_id"""
)
def kmer_distance(spark, sf_dir):
    return rewrite.kmer_distance(P.short_sequences(spark, sf_dir))


# whole alignments: the rows without their gaps are the input, all rows are as wide and no column is empty


def _names(spark, sf_dir) -> list[str]:
    return sorted(r.name for r in P.short_sequences(spark, sf_dir).select("name").collect())


def _ungapped(rows: DataFrame) -> DataFrame:
    rows = kept(rows)
    widths = rows.agg(F.count_distinct(F.length("aligned")).alias("widths"))
    letters = rows.select(F.posexplode(F.split("aligned", "")).alias("pos", "ch")).where("ch <> ''")
    empty = letters.groupBy("pos").agg(F.max((~F.col("ch").isin("-", ".")).cast("int")).alias("any")).agg(F.count_if(F.col("any") == 0).alias("empty_columns"))
    return rows.select("name", qc.ungapped(F.col("aligned")).alias("seq")).join(F.broadcast(widths)).join(F.broadcast(empty))  # one row each


_WHOLE = "1::BIGINT AS widths, 0::BIGINT AS empty_columns"


def _backbone(spark, sf_dir) -> DataFrame:
    return modes.build(spark, P.short_sequences(spark, sf_dir), newick.star(_names(spark, sf_dir)), modes.Options(rooted=True))


@query(f"WITH {P.SHORT} SELECT name, seq, {_WHOLE} FROM short")
def progressive_msa(spark, sf_dir):
    return _ungapped(_backbone(spark, sf_dir))


@query(f"WITH {P.SHORT} SELECT name, seq, {_WHOLE} FROM short")
def dnc_msa(spark, sf_dir):
    return _ungapped(modes.build(spark, P.short_sequences(spark, sf_dir), newick.star(_names(spark, sf_dir)), modes.Options(most=12)))


@query(f"WITH {P.SHORT} SELECT name, seq, {_WHOLE} FROM short WHERE seq_id % 11 <> 5")
def deferred_msa(spark, sf_dir):
    key = F.col("seq_id")
    rows = P.short_sequences(spark, sf_dir).withColumn("status", F.when(key % 11 == 5, "excluded").when(key % 7 == 0, "deferred").otherwise("ok"))
    return _ungapped(modes.build(spark, rows, newick.star(_names(spark, sf_dir)), modes.Options(most=12)))


@query(f"WITH {P.SHORT} SELECT name, seq, {_WHOLE} FROM short")
def iterative_msa(spark, sf_dir):
    return _ungapped(modes.iterate(spark, P.short_sequences(spark, sf_dir), rounds=2))


@query("SELECT p_partkey::VARCHAR AS name, regexp_replace(translate(p_name, ' eaoiunrtslc', '-ACGTACGTACG'), '[-.]', '', 'g') AS seq, 1::BIGINT AS widths FROM part")
def merge_msas(spark, sf_dir):
    rows = P.msa(spark, sf_dir)
    number = F.substring_index("node", "#", -1).cast("int")
    return _ungapped(modes.merge(rows.select(number.alias("group_id"), F.col("row_id").cast("string").alias("name"), "weight", "aligned"))).drop("empty_columns")


@query(f"WITH {P.SHORT}, {P.NEW} SELECT name, seq, {_WHOLE} FROM (SELECT name, seq FROM short UNION ALL SELECT name, seq FROM fresh)")
def place_seqs(spark, sf_dir):
    return _ungapped(modes.place(spark, P.new_sequences(spark, sf_dir), _backbone(spark, sf_dir)))


@query(f"WITH {P.SHORT}, {P.NEW} SELECT name, seq, {_WHOLE} FROM (SELECT name, seq FROM short UNION ALL SELECT name, seq FROM fresh)")
def place_seqs_tree(spark, sf_dir):
    fresh = P.new_sequences(spark, sf_dir)
    names = _names(spark, sf_dir) + sorted(r.name for r in fresh.select("name").collect())
    return _ungapped(modes.place_on_tree(spark, fresh, _backbone(spark, sf_dir), newick.star(names), modes.Options(most=64)))


# the score of two sequences with free leading gaps, by a fold over rows of cells
@query(
    f"""WITH {P.SHORT}, pairs AS (SELECT seq_id, string_split(translate(upper(substr(seq, 1, 24)), 'U', 'T'), '') AS a, string_split(translate(upper(substr(seq, 25, 24)), 'U', 'T'), '') AS b FROM short WHERE length(seq) >= 48),
scored AS (SELECT seq_id, a, b, list_transform(a, lambda x: list_transform(b, lambda y: CASE WHEN NOT contains('ACGT', x) OR NOT contains('ACGT', y) THEN 0.0::DOUBLE
  WHEN x = y THEN 18.0::DOUBLE WHEN x || y IN ('AG', 'GA', 'CT', 'TC') THEN -4.0::DOUBLE ELSE -8.0::DOUBLE END)) AS s FROM pairs),
folded AS (SELECT seq_id, list_reduce(list_prepend(list_transform(range(25), lambda k: 0.0::DOUBLE), s), lambda prev, row: list_reduce(
  list_prepend([0.0::DOUBLE], list_transform(range(1, 25), lambda j: [j::DOUBLE])),
  lambda acc, e: list_append(acc, greatest(prev[e[1]::INTEGER] + row[e[1]::INTEGER], prev[e[1]::INTEGER + 1] - 10, acc[e[1]::INTEGER] - 10)))) AS last FROM scored)
SELECT seq_id, last[25] AS score FROM folded"""
)
def pairwise_align_score(spark, sf_dir):
    scoring = Scoring(gap_open=-10.0, gap_extend=-10.0)

    def run(batches):
        for batch in batches:
            batch["score"] = [kernel.pairwise(a, b, scoring)[1] for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch[["seq_id", "score"]]

    rows = P.short_sequences(spark, sf_dir).where("length(seq) >= 48")
    return rows.select("seq_id", F.substring("seq", 1, 24).alias("a"), F.substring("seq", 25, 24).alias("b")).mapInPandas(run, "seq_id long, score double")
