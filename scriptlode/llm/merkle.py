"""Merkle manifest of a dataset (operator 11).

Leaves are digests of whole rows. A tree is built for each language, and one over the roots of these. Levels are built from below,
eight nodes to a run, and stored as node rows that name their parent and the digests beside them. A recursive query over the
stored rows then climbs from the leaves to the root, appending the siblings of each level and folding the digests: those of
changed rows from their changed leaf. The eight leaves of a run share everything above their run, so they climb as one row with eight
folded digests. Digests travel as 32 bytes and are hashed as lower-case hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import staged, table

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = "/"  # the tree over the language trees; those are '' (null) and '=' with the language
_ROWS, _LEVELS = "spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"


def fold(digests: Column) -> Column:
    """Digest of digests that follow one another."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of a row whose text is `text`: each field as byte count, ':' and value, '-' for null."""
    def field(value):
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(field((text if f == "text" else F.col(f)).cast("string")) for f in fields)), 256))


def numbered(rows: DataFrame, tree: str, *order: Column) -> DataFrame:
    """Add `pos`, the place of a row in its tree from 0, and `count`, the rows of the tree.

    Rows are dealt in ranges of (tree, order), and only the counts of the ranges meet, so a tree that holds most rows is numbered by many tasks;
    `at` spreads rows that are equal in all else.
    """
    order = [*order, F.col("at")]
    ranged = staged(rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(F.col(tree), *order)
                    .withColumn("dealt", F.spark_partition_id()))
    own = Window.partitionBy(tree)
    starts = (ranged.groupBy(tree, "dealt").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.sum("n").over(own.orderBy("dealt")) - F.col("n"))
              .withColumn("count", F.sum("n").over(own)).drop("n"))
    local = F.row_number().over(Window.partitionBy(tree, "dealt").orderBy(*order)) - 1
    return (ranged.withColumn("local", local).join(starts, [tree, "dealt"])
            .withColumn("pos", F.col("start") + F.col("local")).drop("at", "dealt", "start", "local"))


def _runs(nodes: DataFrame, *carried: str) -> DataFrame:
    """Runs of neighbouring nodes in order: members (with `hash` and what is carried) and all their digests in a row."""
    member = F.struct("pos", "hash", *carried)
    runs = (nodes.groupBy("tree", "count", F.shiftright("pos", 3).alias("run"))
            .agg(F.array_sort(F.collect_list(member)).alias("members")))  # at most FAN members
    return runs.withColumn("all", F.unhex(F.array_join(F.transform("members", lambda m: F.hex(m["hash"])), "")))


def _beside(i: Column) -> tuple[Column, Column]:
    """Digests of a run before and after its member number `i`."""
    return F.substring("all", F.lit(1), 32 * i), F.substring("all", 32 * i + 33, F.lit(32 * FAN))


def _build(nodes: DataFrame, level: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels above `nodes` (tree, count, pos, hash) of `level`, of which a tree has `most` at most.

    Returns the node rows with their parents, and the last node of each tree: tree, level, hash.
    """
    links, tops = [], nodes.filter("count = 1").select("tree", F.lit(level).alias("level"), "hash")
    while most > 1:
        runs = staged(_runs(nodes.filter("count > 1")))
        before, after = _beside(F.col("i"))
        links.append(runs.select("tree", "run", "all", F.posexplode("members").alias("i", "m")).select(
            "tree", F.lit(level).alias("level"), F.col("m.pos").alias("pos"), F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"),
            F.col("run").alias("up_pos"), F.lit(True).alias("folds"), before.alias("before"), after.alias("after")))
        level, most = level + 1, -(-most // FAN)
        nodes = runs.select("tree", F.ceil(F.col("count") / FAN).alias("count"), F.col("run").alias("pos"), fold(F.col("all")).alias("hash"))
        tops = tops.unionByName(nodes.filter("count = 1").select("tree", F.lit(level).alias("level"), "hash"))
    return links, staged(tops)


_CLIMB = """
WITH RECURSIVE climb(run_tree, run, tree, level, pos, folded, proof) AS (
  SELECT tree, run, tree, 1, run, folded, X'' FROM {runs}
  UNION ALL
  SELECT c.run_tree, c.run, n.up_tree, n.up_level, n.up_pos,
         CASE WHEN n.folds THEN transform(c.folded, h -> unhex(sha2(lower(hex(concat(n.before, h, n.after))), 256))) ELSE c.folded END,
         concat(c.proof, n.before, n.after)
  FROM climb c JOIN {nodes} n ON c.pos = n.pos AND c.level = n.level AND c.tree = n.tree
)
SELECT run_tree AS tree, run, folded, proof FROM climb WHERE tree = {top} AND level = {level}
"""


def _climbed(runs: DataFrame, nodes: DataFrame, level: int, levels: int) -> DataFrame:
    """Folded root of every leaf of a run, and the siblings above it."""
    spark = runs.sparkSession
    before = {key: spark.conf.get(key) for key in (_ROWS, _LEVELS)}
    spark.conf.set(_ROWS, "-1")  # every run climbs, however many there are
    spark.conf.set(_LEVELS, str(levels + 3))
    try:
        return staged(spark.sql(_CLIMB, runs=runs, nodes=nodes, top=_TOP, level=level))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def manifest(docs: DataFrame, changed_text: Column, changed: Column) -> DataFrame:
    """Leaf, roots and proof of every row, and the root folded from its leaf with `changed_text` where `changed` holds.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Leaves of a language ascend by doc_id, null first, equal
    ids by digest. Null fields count as '-'; a null language has a tree of its own. Repeated rows are leaves of their own. A
    language of one row has its leaf as root, and a table of one language that language's root; without siblings the proof is the
    digest of nothing. An empty table gives no rows. Texts of any length are hashed in their row. Other columns are ignored.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = staged(docs.select("doc_id", tree.alias("tree"), leaf(F.col("text")).alias("hash"),
                                F.when(changed, leaf(changed_text)).alias("now")))
    placed = numbered(leaves, "tree", F.asc_nulls_first("doc_id"), F.col("hash"))
    runs = _runs(placed, "doc_id", "now")

    def folded(m, i):
        before, after = _beside(i)
        now = F.coalesce(m["now"], m["hash"])
        return F.when(F.col("count") == 1, now).otherwise(fold(F.concat(before, now, after)))

    runs = staged(runs.withColumn("folded", F.transform("members", folded)))
    most = runs.agg(F.max("count")).first()[0]
    if most is None:
        return _result(runs.select("tree", F.col("tree").alias("subroot"), F.lit("").alias("root"), "all", "count", F.lit(None).cast("binary").alias("proof"), "members", "folded"))
    first = runs.select("tree", F.ceil(F.col("count") / FAN).alias("count"), F.col("run").alias("pos"),
                        F.when(F.col("count") == 1, F.col("all")).otherwise(fold(F.col("all"))).alias("hash"))
    links, subroots = _build(first, 1, -(-most // FAN))
    placed = staged(numbered(subroots.withColumnRenamed("tree", "of").withColumn("tree", F.lit(_TOP)), "tree", F.col("of")))
    trees = placed.count()
    over, top = _build(placed.select("tree", "count", "pos", "hash"), 0, trees)
    joined = placed.select(F.col("of").alias("tree"), "level", F.lit(0).cast("long").alias("pos"), F.col("tree").alias("up_tree"), F.lit(0).alias("up_level"),
                           F.col("pos").alias("up_pos"), F.lit(False).alias("folds"), F.lit(b"").alias("before"), F.lit(b"").alias("after"))
    nodes = joined
    for part in [*links, *over]:
        nodes = nodes.unionByName(part)
    root = top.first()
    climbed = _climbed(runs.select("tree", "run", "folded"), staged(nodes), root["level"], len(links) + len(over))
    return _result(climbed.join(runs.drop("folded"), ["tree", "run"]).join(subroots.select("tree", shown(F.col("hash")).alias("subroot")), "tree")
                   .withColumn("root", F.lit(bytes(root["hash"]).hex())))


def _result(rows: DataFrame) -> DataFrame:
    before, after = _beside(F.col("i"))
    beside = F.when(F.col("count") == 1, F.lit(b"")).otherwise(F.concat(before, after))
    return (rows.select("*", F.posexplode("members").alias("i", "m"))
            .select(F.col("m.doc_id").alias("doc_id"), shown(F.col("m.hash")).alias("leaf"), "subroot", "root",
                    F.sha2(shown(F.concat(beside, "proof")), 256).alias("proof_sha256"),
                    shown(F.get("folded", F.col("i"))).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; a third of them are checked with their text in lower case."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), F.translate("text", capitals, capitals.lower()), third)


OP11_SQL = r"""
WITH RECURSIVE
i AS (SELECT *, row_number() OVER () AS r, doc_id::VARCHAR AS k FROM documents),
z AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(k, '')]),
                lambda a, b : list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda s, o : CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)), 4294967295::BIGINT) % 3 = 0 AS hit FROM i),
f AS (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now FROM z),
e AS (SELECT r, doc_id, lang, coalesce(strlen(k) || ':' || k, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head, text, now FROM f),
l AS (SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS bent FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
-- levels of the trees: all nodes of a level together
t AS (SELECT 0 AS level, lang, pos::BIGINT AS pos, n::BIGINT AS n, leaf AS h FROM o
      UNION ALL
      SELECT level + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, lang, pos // 8, n),
s AS (SELECT lang, level AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos::BIGINT AS pos, n::BIGINT AS n, subroot AS h FROM s
      UNION ALL
      SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8, n),
g AS (SELECT level, lang, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY level, lang, pos // 8),
h AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM u WHERE n > 1 GROUP BY level, pos // 8),
c AS (SELECT r, lang, 0 AS level, pos, bent AS fold, '' AS proof FROM o
      UNION ALL
      SELECT r, c.lang, c.level + 1, pos // 8,
             sha256(array_to_string(hs[:pos % 8], '') || fold || array_to_string(hs[pos % 8 + 2:], '')),
             proof || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
      FROM c JOIN g ON g.level = c.level AND g.lang IS NOT DISTINCT FROM c.lang AND g.run = c.pos // 8),
j AS (SELECT c.r, c.fold, c.proof, s.pos, s.subroot FROM c JOIN s ON s.lang IS NOT DISTINCT FROM c.lang AND s.depth = c.level),
d AS (SELECT r, subroot, 0 AS level, pos, fold, proof FROM j
      UNION ALL
      SELECT r, subroot, d.level + 1, pos // 8,
             sha256(array_to_string(hs[:pos % 8], '') || fold || array_to_string(hs[pos % 8 + 2:], '')),
             proof || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
      FROM d JOIN h ON h.level = d.level AND h.run = d.pos // 8)
SELECT o.doc_id, o.leaf, d.subroot, u.h AS root, sha256(d.proof) AS proof_sha256, d.fold AS folded_root, d.fold = u.h AS verified
FROM o JOIN d USING (r) JOIN u ON u.n = 1 AND u.level = d.level
"""
