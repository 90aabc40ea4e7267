"""Line dedup with a log-template tree.

A line is cut at white space into tokens; a token with a digit is a variable field. The tree has a
fixed depth: the first level is the token count, the next ``LEADING`` levels are the leading tokens, and the
last level are two tokens in their places. For that, the tokens of a line that other lines of the leaf have in the same place are put
in order of how few do; each two of the ``RAREST`` first are a branch, so a line stands in up to six. The lines of a template meet in
the branch of its two rarest constants, beside few others however large the leaf is.

In a branch, a token is constant if at least ``max(2, CONSTANT_SHARE * lines)`` of the branch's lines have it in that place, else
variable. A template is the constant tokens with ``<*>`` for the others; it counts for a line where at least
``SIMILARITY`` of its tokens are constant. A line takes the one of its templates that has most lines (of equal ones that with
more constants, then by places), so it is in one group. A template recurs if the lines that took it stand in more than one document; exact
repeats of a line always share one. Lines of a recurring template are dropped from all documents but the first one (smallest
doc_id), which keeps them, so that no content is lost. Lines of fewer than ``MIN_TOKENS`` tokens are left alone.

One pass over the texts writes hashes of leaf and line. Grouping them (which reduces before the
shuffle, so a line that a third of all documents share is one row for each task) finds repeats and
the leaves with several lines; only the lines of those leaves are read again, cut into tokens and
counted by (leaf, position, token). Lines with too few shared tokens for any template end there. Hashes of the others' branches are
counted; to a branch with several lines their tokens' hashes follow as arrays, and a task counts whole branches one after the
other. Those of more than ``MOST_CELLS`` tokens are counted by (branch, position, token) over all tasks.

Cases: a null text has no lines and stays null; a text that loses all its lines becomes empty. Rows with
the same doc_id count as one document; so do rows without doc_id that have the same text, and
among several of those the smallest text hash is the first. Extra columns pass through; ``n_lines`` and
``n_dropped`` replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import apart, hash_filter, in_arrow, perhaps_in, same_row
from mailquarry.sinks.facts import staged

LEADING, RAREST = 3, 4
MIN_TOKENS = 5
SIMILARITY = 0.8
CONSTANT_SHARE = 0.1
#: Tokens of all lines of a branch that one task holds at a time.
MOST_CELLS = 2**16
FIELD = "<*>"
SHAPES = "leaf long, key long, shape long, constants long, at1 long, at2 long"
#: White space is collapsed first; then tokens with a digit become fields. The look-behind keeps the
#: search linear.
SPACES, WITH_DIGIT = r"[ \t\r\f\x0B]+", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"
ODD_SPACES, DIGIT = r"  |[\t\r\f\x0B]", "[0-9]"
LAST_ID = 2**63 - 1


def masked_lines(text: Column) -> Column:
    """The lines with single spaces and fields for tokens with a digit.

    Texts without a digit or without unusual white space skip that replacement, which changes nothing there.
    """
    lines = F.split(text, "\n")
    spaced = F.when(text.rlike(ODD_SPACES), F.transform(lines, lambda x: F.regexp_replace(x, SPACES, " "))).otherwise(lines)
    trimmed = F.transform(spaced, F.trim)
    return F.when(text.rlike(DIGIT), F.transform(trimmed, lambda x: F.regexp_replace(x, WITH_DIGIT, FIELD))).otherwise(trimmed)


def token_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def lines_of(docs: DataFrame, leading: int, min_tokens: int) -> DataFrame:
    """(doc_id, hash, at, line, leaf, key) of all lines with enough tokens."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(masked_lines(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("tokens", token_count(F.col("line"))).where(F.col("tokens") >= min_tokens)
    return rows.select("doc_id", "hash", "at", "line", F.xxhash64("tokens", F.substring_index("line", " ", leading)).alias("leaf"), F.xxhash64("line").alias("key"))


def _document() -> tuple[Column, Column]:
    """What tells documents apart: the id, and the text hash of those without one."""
    return F.coalesce("doc_id", F.lit(LAST_ID)), F.when(F.col("doc_id").isNull(), F.col("hash"))


def _span() -> list[Column]:
    """Of a group: its first and last document."""
    return [F.min("owner").alias("owner"), F.min("owner_hash").alias("owner_hash"), F.max("last").alias("last"), F.max("last_hash").alias("last_hash")]


def _several() -> Column:
    """Whether a group has more than one document."""
    return (F.col("owner") != F.col("last")) | F.coalesce(F.col("owner_hash") != F.col("last_hash"), F.lit(False))


def _owner_key(owner: Column, owner_hash: Column) -> Column:
    return F.xxhash64(owner, F.coalesce(owner_hash, F.lit(0).cast("long")))


def _branches(cells: Column) -> Column:
    """Each two of the rarest cells of a line, as one hash."""
    cell = [F.get(cells, F.lit(i)) for i in range(RAREST)]
    pairs = [(a, b) for i, a in enumerate(cell) for b in cell[i + 1:]]
    return F.array_compact(F.array(*[F.when(b.isNotNull(), F.xxhash64(F.least(a, b), F.greatest(a, b))) for a, b in pairs]))


def _small_branches(constant_share: float):
    """Templates of the lines of whole branches, from rows in order of the branch."""
    def shapes(batch):
        import numpy as np
        import pyarrow as pa

        branch = batch.column("branch").to_numpy()
        lists = batch.column("cells").combine_chunks()
        starts = lists.offsets.to_numpy()
        cells = lists.values.to_numpy()[starts[0]:starts[-1]]
        at = batch.column("ats").combine_chunks().flatten().to_numpy().astype(np.int64)
        starts = starts - starts[0]
        row = np.repeat(np.arange(len(branch)), np.diff(starts))
        group = np.cumsum(np.r_[0, branch[1:] != branch[:-1]])[row]
        order = np.lexsort((cells, group))
        change = np.r_[True, (cells[order][1:] != cells[order][:-1]) | (group[order][1:] != group[order][:-1])]
        run = np.cumsum(change) - 1
        support = np.empty(len(cells), dtype=np.int64)
        support[order] = np.bincount(run)[run]
        least = np.maximum(2, np.ceil(batch.column("variants").to_numpy() * constant_share))
        constant = support >= least[row]
        first = starts[:-1]
        constants = np.add.reduceat(constant.astype(np.int64), first)
        found = constants >= batch.column("needed").to_numpy()
        at = np.where(constant, at, 0)
        columns = {"leaf": batch.column("leaf").to_numpy(), "key": batch.column("key").to_numpy(),
                   "shape": np.bitwise_xor.reduceat(np.where(constant, cells, 0), first), "constants": constants,
                   "at1": np.add.reduceat(at, first), "at2": np.add.reduceat(at * at, first)}
        return pa.RecordBatch.from_pydict({k: v[found] for k, v in columns.items()})

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            branch = rows.column("branch").to_numpy()
            # the last branch may go on in the next batch
            whole = int(np.searchsorted(branch, branch[-1]))
            if whole:
                yield shapes(rows.slice(0, whole).combine_chunks())
            rest = rows.slice(whole).combine_chunks()
        if rest is not None:
            yield shapes(rest)

    return run


def _large_branches(placed: DataFrame, constant_share: float) -> DataFrame:
    """The same for branches of any size: counts by (branch, cell), joined back to the lines."""
    counted = placed.select("branch", "variants", F.explode("cells").alias("cell")).groupBy("branch", "cell").agg(
        F.count("*").alias("n"), F.min("variants").alias("variants"))
    constant = counted.where((F.col("n") > 1) & (F.col("n") >= F.ceil(F.col("variants") * constant_share))).select("branch", "cell")
    at = F.col("at").cast("long")
    own = F.arrays_zip(F.col("ats").alias("at"), F.col("cells").alias("cell"))
    return placed.select("leaf", "key", "needed", "branch", F.inline(own).alias("at", "cell")).join(constant, ["branch", "cell"]).groupBy(
        "leaf", "key", "needed", "branch").agg(
        F.count("*").alias("constants"), F.bit_xor("cell").alias("shape"), F.sum(at).alias("at1"), F.sum(at * at).alias("at2")
    ).where(F.col("constants") >= F.col("needed")).select("leaf", "key", "shape", "constants", "at1", "at2")


def recurring(docs: DataFrame, lines: DataFrame, leading: int = LEADING, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY,
              constant_share: float = CONSTANT_SHARE, most_cells: int = MOST_CELLS) -> DataFrame:
    """(leaf, key, owner, owner_hash) of the lines whose template recurs.

    Branches of up to ``most_cells`` tokens in all are whole in a task, larger ones are spread; both give the same.
    """
    owner, owner_hash = _document()
    counts = staged(lines.select("leaf", "key", owner.alias("owner"), owner_hash.alias("owner_hash")).groupBy("leaf", "key").agg(
        F.min("owner").alias("owner"), F.min("owner_hash").alias("owner_hash"), F.max("owner").alias("last"), F.max("owner_hash").alias("last_hash")), "llm-lines")
    leaves = counts.groupBy("leaf").agg(F.count("*").alias("variants")).where("variants > 1")
    mixed = staged(counts.join(leaves, "leaf"), "llm-leaves")
    # their texts are read again from the document that has each line first
    wanted = mixed.select(_owner_key(F.col("owner"), F.col("owner_hash")).alias("k")).unionAll(mixed.select("key"))
    wanted = staged(hash_filter(wanted, F.col("k")), "llm-filter")
    held = docs.withColumn("hash", F.xxhash64("text"))
    held = perhaps_in(held, _owner_key(*_document()), wanted).select("doc_id", "text")
    texts = perhaps_in(lines_of(held, leading, min_tokens).select("leaf", "key", "line"), F.col("key"), wanted).distinct()
    texts = staged(texts.join(mixed.select("leaf", "key"), ["leaf", "key"]).select("leaf", "key", F.split("line", " ").alias("tokens")), "llm-leaf-lines")
    cells = texts.select("leaf", "key", F.size("tokens").alias("tokens"), F.posexplode("tokens").alias("at", "token"))
    cells = cells.select("leaf", "key", "tokens", "at", F.xxhash64("leaf", "at", "token").alias("cell"))
    support = cells.groupBy("cell").agg(F.count("*").alias("support")).where("support > 1")
    needed = F.ceil(F.col("tokens") * similarity).alias("needed")
    line = ["leaf", "key", "needed"]
    shared = cells.select("leaf", "key", needed, "at", "cell").join(support, "cell").groupBy(*line).agg(
        F.array_sort(F.collect_list(F.struct("support", "at", "cell"))).alias("own"))
    shared = staged(shared.where(F.size("own") >= F.col("needed")).select(*line, F.col("own.at").alias("ats"), F.col("own.cell").alias("cells")), "llm-shared")
    # hashes alone find the branches with several lines; the cells of a line follow once to each of these
    branched = shared.select("leaf", "key", F.size("cells").alias("size"), F.explode(_branches(F.col("cells"))).alias("branch"))
    sizes = branched.groupBy("branch").agg(F.count("*").alias("variants"), F.sum("size").alias("in_all")).where("variants > 1")
    members = branched.drop("size").join(sizes, "branch").groupBy("leaf", "key").agg(F.collect_list(F.struct("branch", "variants", "in_all")).alias("branches"))
    placed = staged(shared.join(members, ["leaf", "key"]), "llm-branches").select(*line, "cells", "ats", F.inline("branches"))
    small = placed.where(F.col("in_all") <= most_cells).select("branch", "variants", *line, "cells", "ats")
    small = in_arrow(small.repartition("branch").sortWithinPartitions("branch"), _small_branches(constant_share), SHAPES)
    large = _large_branches(placed.where(F.col("in_all") > most_cells), constant_share)
    # one row for a line and template, found by whatever branch
    shape = ["leaf", "shape", "constants", "at1", "at2"]
    shapes = staged(small.unionByName(large).select(*shape, "key").distinct(), "llm-shapes")
    popular = shapes.groupBy(*shape).agg(F.count("*").alias("n")).where("n > 1")
    best = F.struct((-F.col("n")).alias("n"), (-F.col("constants")).alias("order"), "at1", "at2", "shape", "constants")
    taken = shapes.join(popular, shape).groupBy("leaf", "key").agg(F.min(best).alias("best")).select(
        "leaf", "key", "best.shape", "best.constants", "best.at1", "best.at2")
    templates = staged(taken.join(mixed, ["leaf", "key"]), "llm-templates")
    groups = templates.groupBy(*shape).agg(*_span()).where(_several())
    general = templates.select(*shape, "key").join(groups, shape)
    found = ["leaf", "key", "owner", "owner_hash"]
    both = counts.where(_several()).select(found).unionByName(general.select(found))
    return both.groupBy("leaf", "key").agg(F.min("owner").alias("owner"), F.min("owner_hash").alias("owner_hash"))


def dedup_lines(docs: DataFrame, leading: int = LEADING, min_tokens: int = MIN_TOKENS, **settings) -> DataFrame:
    """Every row of ``docs`` with its text without dropped lines, n_lines and n_dropped (which replace columns of these names)."""
    docs, old = apart(docs, "doc_id", "text", "n_lines", "n_dropped")
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    lines = staged(lines_of(narrow, leading, min_tokens).drop("line"), "llm-line-keys")
    # a written table, so that the join reads both sides straight from a shuffle and can split a hot line
    templates = staged(recurring(narrow, lines, leading, min_tokens, **settings), "llm-recurring")
    first, first_hash = _document()
    first = (first == F.col("owner")) & (F.col("doc_id").isNotNull() | (first_hash == F.col("owner_hash")))
    drops = lines.join(templates, ["leaf", "key"]).where(~F.coalesce(first, F.lit(False))).groupBy("doc_id", "hash").agg(F.collect_set("at").alias("_drops"))
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "_drops")
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    named = [c for c, name in zip(old, docs.columns, strict=True) if name in cols]
    rows = docs.select(*cols, F.xxhash64(F.col("text").cast("string")).alias("_text_hash"))
    rows = rows.join(drops, same_row(F.col("doc_id"), F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    own = F.split("text", "\n")
    kept = F.array_join(F.filter(own, lambda _, at: ~F.array_contains("_drops", at)), "\n")
    text = F.when(F.col("_drops").isNull(), F.col("text")).otherwise(kept)
    return rows.select(
        *[text.alias("text") if name == "text" else c for c, name in zip(named, cols, strict=True)],
        F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long").alias("n_dropped"))


def oracle() -> str:
    """DuckDB SQL of the query over documents."""
    mask = (rf"regexp_replace(trim(regexp_replace(l, '[ \t\r\f\x0B]+', ' ', 'g'), ' '), '[^ 0-9]*[0-9][^ ]*', '{FIELD}', 'g')")
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
masked AS (SELECT doc_id, pos, l, {mask} AS line FROM lines),
long_lines AS (SELECT *, string_split(line, ' ') AS tokens FROM masked WHERE len(string_split(line, ' ')) >= {MIN_TOKENS}),
counts AS (
  SELECT line, any_value(tokens) AS tokens, max(doc_id) AS last, min(doc_id) AS owner,
         concat_ws(' ', len(any_value(tokens)), array_to_string(any_value(tokens)[1:{LEADING}], ' ')) AS leaf
  FROM long_lines GROUP BY line),
leaves AS (SELECT leaf, count(*) AS variants FROM counts GROUP BY leaf HAVING count(*) > 1),
exploded AS (
  SELECT leaf, line, last, owner, variants, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos
  FROM counts JOIN leaves USING (leaf)),
support AS (SELECT leaf, pos, token, count(*) AS support FROM exploded GROUP BY leaf, pos, token HAVING count(*) > 1),
shared AS (
  SELECT * FROM (
    SELECT leaf, line, pos, token, last, owner, support, len(string_split(line, ' ')) AS tokens, count(*) OVER (PARTITION BY leaf, line) AS n,
           row_number() OVER (PARTITION BY leaf, line ORDER BY support, pos) AS rarity
    FROM exploded JOIN support USING (leaf, pos, token)) x
  WHERE n >= ceil(tokens * CAST({SIMILARITY} AS DOUBLE))),
branches AS (
  SELECT leaf, a.line, a.pos AS p1, a.token AS t1, b.pos AS p2, b.token AS t2
  FROM shared a JOIN shared b USING (leaf, line) WHERE a.rarity <= {RAREST} AND b.rarity <= {RAREST} AND a.pos < b.pos),
sizes AS (SELECT leaf, p1, t1, p2, t2, count(*) AS lines FROM branches GROUP BY ALL HAVING count(*) > 1),
placed AS (
  SELECT leaf, line, p1, t1, p2, t2, lines, pos, token, tokens FROM branches JOIN sizes USING (leaf, p1, t1, p2, t2) JOIN shared USING (leaf, line)),
constants AS (
  SELECT leaf, p1, t1, p2, t2, pos, token FROM placed GROUP BY ALL
  HAVING count(*) >= greatest(2, ceil(any_value(lines) * CAST({CONSTANT_SHARE} AS DOUBLE)))),
templates AS (
  SELECT DISTINCT leaf, line, template, constants, at1, at2 FROM (
    SELECT leaf, line, string_agg(pos || ' ' || token, ' ' ORDER BY pos) AS template, count(*) AS constants, sum(pos) AS at1, sum(pos * pos) AS at2, any_value(tokens) AS tokens
    FROM placed JOIN constants USING (leaf, p1, t1, p2, t2, pos, token) GROUP BY leaf, line, p1, t1, p2, t2) y
  WHERE constants >= ceil(tokens * CAST({SIMILARITY} AS DOUBLE))),
popular AS (SELECT leaf, template, count(*) AS n FROM templates GROUP BY leaf, template HAVING count(*) > 1),
taken AS (
  SELECT leaf, line, template, last, owner FROM (
    SELECT *, row_number() OVER (PARTITION BY leaf, line ORDER BY n DESC, constants DESC, at1, at2) AS choice
    FROM templates JOIN popular USING (leaf, template)) z JOIN counts USING (leaf, line) WHERE choice = 1),
groups AS (
  SELECT leaf, template, min(owner) AS owner FROM taken GROUP BY leaf, template HAVING min(owner) <> max(last)),
owners AS (
  SELECT line, min(owner) AS owner FROM (
    SELECT line, owner FROM counts WHERE owner <> last
    UNION ALL SELECT line, groups.owner FROM taken JOIN groups USING (leaf, template)) GROUP BY line),
drops AS (SELECT doc_id, pos FROM long_lines JOIN owners USING (line) WHERE doc_id <> owner),
left_over AS (
  SELECT doc_id, count(*) AS n_lines, count(drops.doc_id) AS n_dropped,
         coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (drops.doc_id IS NULL), '') AS text
  FROM lines LEFT JOIN drops USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE left_over.text END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN left_over USING (doc_id)"""
