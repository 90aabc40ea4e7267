"""Merkle manifest of a table: digests of rows, of each language, and one root; proofs by a recursive query.

H is SHA-256 in lower-case hex; its inputs are concatenated, digests as hex text. A leaf is H of doc_id, source,
lang, n_chars and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. In a language the leaves
stand by doc_id; every two neighbours become their H, level by level, a last one without neighbour becomes its own H, until one
node remains (a lone leaf itself). These subroots, by language with null first, make the root in the same way.

Nodes are stored for every ``STRIDE``-th level, each with the hash, the siblings on the way up to the next stored level
and the key of the node there, so a proof needs few joins, and the stored rows are little more than the
leaves. A block of ``2**STRIDE`` nodes is one group, so no task gathers more, and each level has a ``2**STRIDE``-th of the rows.
A subroot's row is a leaf of the tree of languages.

A recursive query climbs from each leaf: it joins the node that the leaf has reached, appends that node's siblings
and folds them into the digest it carries, up to the root. All leaves pass the few upper nodes, so a node
is stored once for every ``2**STRIDE`` leaves below it, and the leaves are dealt over these copies.

Cases: a null text (or any other null) is ``-`` and so differs from an empty one. Null doc_ids come first in their language;
rows with the same doc_id stand in order of their leaves, and repeated rows are leaves of their own with equal
results up to their place. A null language is a language of its own, other than the empty one. Extra columns are not read. No rows give no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.llm.common import unlimited_recursion
from mailquarry.plans.skew import small
from mailquarry.sinks.facts import staged

STRIDE = 8
BLOCK = 1 << STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of languages; names of languages start with '=' or are NO_LANGUAGE.
TOP, NO_LANGUAGE = "", "-"


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(n_chars: Column | None = None) -> Column:
    """Digest of a row; with another value for n_chars if given."""
    return F.sha2(F.concat(*[_framed(n_chars if n_chars is not None and name == "n_chars" else F.col(name)) for name in FIELDS]), 256)


def leaves(docs: DataFrame, tampered: Column, changed_n_chars: Column) -> DataFrame:
    """(tree, doc_id, hash, start) of every row; ``start`` is the digest after tampering, the leaf itself elsewhere."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(NO_LANGUAGE))
    start = F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(changed_n_chars))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_hash().alias("hash"), start.alias("changed"))
    return rows.withColumn("start", F.coalesce("changed", "hash")).drop("changed")


def positions(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``pos`` and ``n``, trees): the place of each row in its tree, from 0, and the number of rows there.

    The rows are sorted over all trees by ranges, so a large tree is spread over many tasks; a running sum of
    the counts of (tree, task), a row for each, gives the places.
    """
    by = ["tree", *order]
    split = rows.withColumn("again", F.monotonically_increasing_id())  # repeated rows may lie in several ranges
    split = split.repartitionByRange(*by, "again").sortWithinPartitions(*by, "again").drop("again")
    split = staged(split.withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "llm-sorted")
    parts = staged(split.groupBy("tree", "task").agg(F.count("*").alias("n_here"), F.min("at").alias("first_at")), "llm-ranges")
    before = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumns({"before": F.coalesce(F.sum("n_here").over(before), F.lit(0)), "n": F.sum("n_here").over(Window.partitionBy("tree"))})
    placed = split.join(small(offsets), ["tree", "task"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first_at"))
    trees = parts.groupBy("tree").agg(F.sum("n_here").alias("n"))
    return placed.select(*rows.columns, "pos", "n"), trees


def _parents(level: str) -> str:
    return f"transform(sequence(0, (size({level}) - 1) div 2), j -> sha2(concat({level}[2 * j], coalesce(get({level}, 2 * j + 1), '')), 256))"


def _stored_level(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Node rows of one stored level from (tree, n, up_pos, below_up, level, pos, hash, below, carried)."""
    height = F.expr("CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END")
    rows = rows.withColumns({"climb": F.least(F.lit(STRIDE), height - F.col("level")), "block": F.expr(f"pos div {BLOCK}")})
    key = ["tree", "n", "up_pos", "below_up", "level", "climb", "block"]
    blocks = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "below", *carried))).alias("nodes"))
    blocks = blocks.withColumn("levels", F.expr(
        f"aggregate(slice(sequence(1, {STRIDE}), 1, climb), array(nodes.hash), (done, i) -> concat(done, array({_parents('element_at(done, -1)')})))"))
    blocks = blocks.withColumn("below_block", F.expr("aggregate(nodes.below, 0L, (s, x) -> s + x)"))
    last = F.expr("level + climb >= CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END")
    blocks = blocks.withColumns({
        "parent_hash": F.expr("levels[climb][0]"),
        "parent_tree": F.when(~last, F.col("tree")).when(F.col("tree") != TOP, F.lit(TOP)),
        "parent_level": F.when(~last, F.col("level") + F.col("climb")).otherwise(0),
        "parent_pos": F.when(~last, F.col("block")).otherwise(F.col("up_pos")),
        "parent_below": F.when(~last, F.col("below_block")).otherwise(F.col("below_up")),
    })
    nodes = blocks.select("*", F.posexplode("nodes").alias("i", "node"))
    siblings = "transform(slice(sequence(0, {0}), 1, climb), j -> unhex(get(levels[j], shiftright(i, j) ^ 1)))".format(STRIDE - 1)
    return nodes.select(
        "tree", "level", "node.pos", "node.hash", "node.below", *[f"node.{c}" for c in carried], F.expr(siblings).alias("siblings"),
        "parent_tree", "parent_level", "parent_pos", "parent_hash", "parent_below", "n", "up_pos", "below_up")


def _levels_above(first: DataFrame, most: int) -> list[DataFrame]:
    """The stored levels above one, bottom up; ``most`` is the number of leaves of the largest tree."""
    found, level, rows = [], STRIDE, first
    while most > 1 << level:
        ups = rows.where((F.col("parent_tree") == F.col("tree")) & (F.col("pos") % BLOCK == 0))
        ups = ups.select("tree", "n", "up_pos", "below_up", F.col("parent_level").alias("level"), F.col("parent_pos").alias("pos"),
                         F.col("parent_hash").alias("hash"), F.col("parent_below").alias("below"))
        rows = staged(_stored_level(ups, []), "llm-merkle-level")
        found.append(rows)
        level += STRIDE
    return found


def built(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bottom, upper): the leaves' node rows with doc_id and start, and all other stored node rows."""
    placed, trees = positions(found, ["doc_id", "hash"])
    trees = staged(trees, "llm-trees")
    most = trees.agg(F.max("n").alias("n"), F.count("*").alias("trees")).first()
    lang = F.when(F.col("tree") != NO_LANGUAGE, F.substring("tree", 2, 1 << 30))  # null first, then bytewise
    tops, _ = positions(trees.select(F.lit(TOP).alias("tree"), lang.alias("lang"), F.col("tree").alias("name"), F.col("n").alias("below")), ["lang"])
    tops = staged(tops, "llm-tops")
    ups = tops.select(F.col("name").alias("tree"), F.col("pos").alias("up_pos"), F.col("below").alias("below_up"))
    rows = placed.join(small(ups), "tree").withColumns({"level": F.lit(0), "below": F.lit(1).cast("long")})
    bottom = staged(_stored_level(rows, ["doc_id", "start"]), "llm-merkle-leaves")
    upper = _levels_above(bottom, most["n"] or 0)

    ends = [x.where((F.col("pos") % BLOCK == 0) & (F.col("parent_tree") == TOP)).select(F.col("tree").alias("name"), F.col("parent_hash").alias("hash")) for x in [bottom, *upper]]
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionAll(more)
    rows = tops.join(subroots, "name").select("tree", "n", "pos", "hash", "below").withColumns({"up_pos": F.lit(None).cast("long"), "below_up": F.lit(None).cast("long"), "level": F.lit(0)})
    first = staged(_stored_level(rows, []), "llm-merkle-level")
    upper += [first, *_levels_above(first, most["trees"] or 0)]
    keep = ["tree", "level", "pos", "hash", "below", "siblings", "parent_tree", "parent_level", "parent_pos", "parent_hash", "parent_below"]
    every = upper[0].select(keep)
    for more in upper[1:]:
        every = every.unionAll(more.select(keep))
    return bottom, every


def _folded(start: str, row: str) -> str:
    """The digest after the siblings of a node row: a left one before, a right one behind, none alone."""
    sibling, on_left = "coalesce(lower(hex(x)), '')", f"shiftright({row}.pos, s.i) & 1 = 1"
    step = f"named_struct('i', s.i + 1, 'd', sha2(concat(IF({on_left}, {sibling}, ''), s.d, IF({on_left}, '', {sibling})), 256))"
    return f"aggregate({row}.siblings, named_struct('i', 0, 'd', {start}), (s, x) -> {step}, s -> s.d)"


def climbed(bottom: DataFrame, upper: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, by a recursive query over the node rows."""
    spark = bottom.sparkSession
    copies = f"greatest(1L, (below + {BLOCK - 1}) div {BLOCK})"
    nodes = staged(upper.select("*", F.explode(F.expr(f"sequence(0L, {copies} - 1)")).alias("copy")), "llm-merkle-nodes")
    joined = "aggregate({0}.siblings, {1}, (p, x) -> concat(p, coalesce(x, X'')))"
    copy = f"{{0}} % greatest(1L, ({{1}}.parent_below + {BLOCK - 1}) div {BLOCK})"
    sql = f"""
WITH RECURSIVE climb(doc_id, leaf, leaf_pos, folded, proof, subroot, reached, tree, level, pos, copy) AS (
  SELECT doc_id, unhex(b.hash), b.pos, {_folded("b.start", "b")}, {joined.format("b", "X''")}, CAST(NULL AS STRING), b.parent_hash,
    b.parent_tree, b.parent_level, b.parent_pos, {copy.format("b.pos", "b")}
  FROM {{bottom}} AS b
  UNION ALL
  SELECT c.doc_id, c.leaf, c.leaf_pos, {_folded("c.folded", "n")}, {joined.format("n", "c.proof")}, IF(n.tree = '{TOP}' AND n.level = 0, n.hash, c.subroot), n.parent_hash,
    n.parent_tree, n.parent_level, n.parent_pos, {copy.format("c.leaf_pos", "n")}
  FROM climb AS c JOIN {{nodes}} AS n ON n.tree = c.tree AND n.level = c.level AND n.pos = c.pos AND n.copy = c.copy)
SELECT doc_id, lower(hex(leaf)) AS leaf, subroot, reached AS root, sha2(lower(hex(proof)), 256) AS proof_sha256, folded AS folded_root, folded = reached AS verified
FROM climb WHERE tree IS NULL"""
    with unlimited_recursion(spark):
        return staged(spark.sql(sql, bottom=bottom, nodes=nodes), "llm-merkle-proofs")


def manifest(docs: DataFrame, tampered: Column, changed_n_chars: Column) -> DataFrame:
    """Builds the tree of ``docs`` and climbs it from every leaf, after a change of n_chars in the tampered rows."""
    return climbed(*built(leaves(docs, tampered, changed_n_chars)))


def oracle() -> str:
    """DuckDB SQL of the digest over ``documents``, level by level with a recursive query of its own."""
    def framed(value: str) -> str:
        return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"

    def hashed(n_chars: str) -> str:
        return "sha256(" + " || ".join(framed(n_chars if x == "n_chars" else x) for x in FIELDS) + ")"

    return f"""
WITH RECURSIVE steps(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
leaf AS (SELECT doc_id, lang, {hashed("n_chars")} AS h, {hashed("n_chars::HUGEINT + 1")} AS changed,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc),
base AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id FROM leaf),
lv(lang, level, pos, n, h) AS (SELECT lang, 0, pos, n, h FROM base UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY lang, level, pos // 2, n),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tv(level, pos, n, h) AS (SELECT 0, pos, n, h FROM sub UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tv WHERE n > 1 GROUP BY level, pos // 2, n),
up(id, lang, level, pos, n, f, proof) AS (SELECT id, lang, 0, pos, n, CASE WHEN crc % 7 = 0 THEN changed ELSE h END, '' FROM base UNION ALL
  SELECT u.id, u.lang, u.level + 1, u.pos // 2, (u.n + 1) // 2, sha256(CASE WHEN u.pos % 2 = 1 THEN s.h ELSE '' END || u.f || CASE WHEN u.pos % 2 = 0 THEN coalesce(s.h, '') ELSE '' END), u.proof || coalesce(s.h, '')
  FROM up u LEFT JOIN lv s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1),
over_lang AS (SELECT u.id, sub.pos, sub.n, sub.h AS subroot, u.f, u.proof FROM up u JOIN sub ON u.n = 1 AND sub.lang IS NOT DISTINCT FROM u.lang),
top(id, level, pos, n, subroot, f, proof) AS (SELECT id, 0, pos, n, subroot, f, proof FROM over_lang UNION ALL
  SELECT u.id, u.level + 1, u.pos // 2, (u.n + 1) // 2, u.subroot, sha256(CASE WHEN u.pos % 2 = 1 THEN s.h ELSE '' END || u.f || CASE WHEN u.pos % 2 = 0 THEN coalesce(s.h, '') ELSE '' END), u.proof || coalesce(s.h, '')
  FROM top u LEFT JOIN tv s ON s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT doc_id, base.h AS leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM top JOIN base USING (id), (SELECT h FROM tv WHERE tv.n = 1) AS root WHERE top.n = 1"""
