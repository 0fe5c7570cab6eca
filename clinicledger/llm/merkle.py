"""Operator 13: a Merkle manifest of a dataset, by slot pivots.

Every row is a leaf: the SHA-256 of its fields, each written as its length in
bytes and its value, so that no two rows share an input.  A group's leaves
(ascending by key) form a tree of ``FANOUT`` children a node; the groups' roots
(subroots), ordered by group, form a tree in the same way, whose root signs
all.

A level is one aggregation: conditional aggregates spread each parent's
children into slot columns.  All slots concatenated give the parent's hash;
all but a child's own give its siblings.  Proofs are carried from the root
down, a level's nodes meet their parents once, so a tree of n leaves costs
about 1.5 n rows of joins, however deep it is.

Places in a group come from a range sort: each sorted partition numbers its
own rows, and prefix sums over (partition, group) counts give their bases, so
a group with most of the rows is spread over partitions like any.  Equal rows
are dealt apart by a row number.  Every level is written in the shared folder
before the next; the driver only sees the largest group's size and the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinicledger.llm.common import small, stored

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the strings' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(values: dict[str, Column]) -> Column:
    """A leaf's hash from the columns of ``FIELDS``."""
    return digest(*[field(values[name]) for name in FIELDS])


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf gives with its siblings, level by level."""
    return F.aggregate(siblings, leaf, lambda h, step: F.sha2(F.concat(step.before, h, step.after), 256))


def proof_digest(siblings: Column) -> Column:
    """SHA-256 of all siblings' hashes, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(siblings, lambda step: F.concat(step.before, step.after)), ""), 256)


def _placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` (a written table) with ``pos`` (place in its group by
    ``order``, from 0), ``n`` (the group's size) and ``base`` of its
    partition; written."""
    keys = [group, *order]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys, "__row")
    dealt = dealt.sortWithinPartitions(*keys, "__row").drop("__row")
    ids = F.monotonically_increasing_id()
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("part"), ids.alias("place")), name)
    # at most partitions + groups rows, and partitions rows a group
    counts = dealt.groupBy("part", group).agg(F.min("place").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "part", group, (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n")
    )
    counts = stored(counts, f"{name}-counts")
    placed = dealt.join(small(counts), ["part", group])
    return placed.withColumn("pos", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of the ``nodes`` (``tree``, ``n``, ``pos``, ``node``: a struct
    with ``hash``): ``tree``, ``n`` (of the children), ``parent``, a slot
    column per child and ``hash``."""
    slots = [F.max(F.when(F.col("pos") % fanout == k, F.col("node"))).alias(f"slot{k}") for k in range(fanout)]
    parents = nodes.filter("n > 1").groupBy("tree", "n", F.expr(f"pos div {fanout}").alias("parent")).agg(*slots)
    return parents.withColumn("hash", F.sha2(F.concat_ws("", *[F.col(f"slot{k}.hash") for k in range(fanout)]), 256))


def _levels(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, lowest first, and ``tree``, ``hash`` of each
    tree's root."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    pivots: list[DataFrame] = []
    roots = nodes.filter("n = 1").select("tree", "node.hash")
    while largest > 1:
        pivots.append(stored(_pivot(nodes, fanout), f"{name}-{len(pivots)}"))
        largest = -(-largest // fanout)
        nodes = pivots[-1].select(
            "tree", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.col("parent").alias("pos"), F.struct("hash").alias("node")
        )
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", "node.hash"))
    return pivots, roots


def _proofs(nodes: DataFrame, pivots: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """``tree``, ``node``, ``siblings`` and ``above``'s other columns of every
    lowest node.  ``above``: ``tree``, ``siblings`` (over the tree's root)."""
    carried = [c for c in above.columns if c not in ("tree", "siblings")]
    slots = [F.col(f"slot{k}") for k in range(fanout)]
    joined = lambda part: F.concat_ws("", *[s["hash"] for s in part])
    upper = None
    for pivot in reversed(pivots):
        tops = pivot.filter(F.col("n") <= fanout).join(above, "tree")
        if upper is not None:
            inner = pivot.filter(F.col("n") > fanout).join(upper.withColumnRenamed("pos", "parent").drop("node"), ["tree", "parent"])
            tops = tops.unionByName(inner.select(*tops.columns))
        children = F.explode(F.array(*[
            F.struct(
                (F.col("parent") * fanout + k).alias("pos"), slots[k].alias("node"),
                F.concat(F.array(F.struct(joined(slots[:k]).alias("before"), joined(slots[k + 1:]).alias("after"))), F.col("siblings")).alias("siblings"),
            ) for k in range(fanout)
        ]))
        upper = tops.select("tree", *carried, children.alias("child")).select("tree", *carried, "child.*").filter("node is not null")
    alone = nodes.filter("n = 1").join(above, "tree").select("tree", *carried, "pos", "node", "siblings")
    return alone if upper is None else upper.unionByName(alone)


@dataclass
class Manifest:
    """A written manifest.  ``leaves``: ``tree`` (the group's number in
    ascending order), ``n``, ``pos``, ``node`` (``hash``, ``key``, further
    columns); ``levels``: the pivots, lowest first; ``subroots``: ``tree``,
    ``hash``; ``root``: None for an empty table."""

    leaves: DataFrame
    levels: list[DataFrame]
    group_levels: list[DataFrame]
    subroots: DataFrame
    root: str | None
    fanout: int

    def proofs(self) -> DataFrame:
        """A row per leaf: its ``node``'s columns, ``subroot``, ``root`` and
        ``siblings``, an array from the leaf to the root of the hashes
        ``before`` and ``after`` it in its run."""
        spark = self.leaves.sparkSession
        top = spark.range(1).select(F.col("id").alias("tree"), F.array().cast(_STEP).alias("siblings"))
        groups = _group_nodes(self.subroots)
        above = _proofs(groups, self.group_levels, top, self.fanout)
        above = stored(above.select(F.col("node.tree").alias("tree"), F.col("node.hash").alias("subroot"), "siblings"), "merkle-above")
        found = _proofs(self.leaves, self.levels, above, self.fanout)
        return found.select("node.*", "subroot", F.lit(self.root).cast("string").alias("root"), "siblings")


def _group_nodes(subroots: DataFrame) -> DataFrame:
    """The subroots as nodes of one tree."""
    return subroots.select(F.lit(0).cast("long").alias("tree"), "n", F.col("tree").alias("pos"), F.struct("hash", "tree").alias("node"))


def build(rows: DataFrame, group: Column, key: Column, leaf: Column, fanout: int = FANOUT, **more: Column) -> Manifest:
    """Build and write the manifest of ``rows``: a tree per value of
    ``group`` (null first, then by UTF-8 bytes) over its leaves by ``key``
    (null first, ties by leaf hash), and the tree over the subroots.  ``more``
    columns of a row are kept with its leaf.

    Repeated rows are leaves of their own; an empty table has no root.
    """
    value = group.cast("string")
    named = F.when(value.isNull(), "-").otherwise(F.concat(F.lit("="), value))  # "-" sorts first
    leaves = stored(
        rows.select(named.alias("__group"), key.alias("__key"), leaf.alias("__hash"), F.struct(
            leaf.alias("hash"), key.alias("key"), *[c.alias(name) for name, c in more.items()]
        ).alias("node")), "merkle-leaves",
    )
    placed = stored(_placed(leaves, "__group", ["__key", "__hash"], "merkle-sorted"), "merkle-placed")
    groups = stored(placed.groupBy("__group").agg(F.lit(0).alias("one")), "merkle-groups")
    groups = _placed(groups, "one", ["__group"], "merkle-numbered").select("__group", F.col("pos").alias("tree"), F.col("n").alias("n_trees"))
    groups = stored(groups, "merkle-trees")
    nodes = stored(placed.join(small(groups.select("__group", "tree")), "__group").select("tree", "n", "pos", "node"), "merkle-nodes")
    levels, subroots = _levels(nodes, fanout, "merkle-level")
    subroots = stored(subroots.join(groups.select("tree", F.col("n_trees").alias("n")), "tree"), "merkle-subroots")
    group_levels, root = _levels(_group_nodes(subroots), fanout, "merkle-group-level")
    found = root.first()
    return Manifest(nodes, levels, group_levels, subroots, found["hash"] if found else None, fanout)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` (``doc_id``, ``source``, ``lang``,
    ``n_chars``, ``text``; other columns are ignored), and a check of a copy
    in which documents with an even crc32 of their decimal ``doc_id`` lost
    their newlines: ``doc_id``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root`` (from the copy's leaf and the manifest's
    siblings), ``verified`` (equals the root).

    Nulls in any column are fields of their own (``-``); a document without
    doc_id is copied as it is; null texts stay null.  Repeated rows give
    repeated results.  An empty table gives an empty result.
    """
    types = {"doc_id": "long", "n_chars": "long"}
    rows = docs.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in FIELDS])
    values = {c: F.col(c) for c in FIELDS}
    bent = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    bent = bent & F.coalesce(F.col("text").contains("\n"), F.lit(False))
    other = F.when(bent, leaf_hash({**values, "text": F.translate("text", "\n", "")}))
    found = build(rows, F.col("source"), F.col("doc_id"), leaf_hash(values), copy=other).proofs()
    return found.select(
        F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("siblings")).alias("proof_sha256"),
        fold(F.coalesce("copy", "hash"), F.col("siblings")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: per leaf and level, the hashes around a node; crc32 by its polynomial
AUDIT_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS r FROM documents),
f AS (SELECT doc_id, source, r, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
  (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER + 1, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::BIGINT)) % 2 = 0 AS bent FROM d),
l AS (SELECT doc_id, source, r, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN bent AND text IS NOT NULL THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS other FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree FROM l),
sub AS (SELECT tree, 0 AS lvl, n, pos, leaf AS h FROM p UNION ALL
  SELECT tree, lvl + 1, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM sub WHERE n > 1 GROUP BY tree, lvl, n, pos // 3),
top AS (SELECT 0 AS lvl, (SELECT count(*) FROM sub WHERE n = 1) AS n, tree - 1 AS pos, h FROM sub WHERE n = 1 UNION ALL
  SELECT lvl + 1, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // 3),
a AS (SELECT x.tree, x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS b,
  coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS e
  FROM sub x JOIN sub y ON x.tree = y.tree AND x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY ALL),
t AS (SELECT x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS b,
  coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS e
  FROM top x JOIN top y ON x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY ALL),
steps AS (SELECT p.r, a.lvl, a.b, a.e FROM p JOIN a ON a.tree = p.tree AND a.pos = p.pos // (3 ** a.lvl)::BIGINT UNION ALL
  SELECT p.r, 1000 + t.lvl, t.b, t.e FROM p JOIN t ON t.pos = (p.tree - 1) // (3 ** t.lvl)::BIGINT),
s AS (SELECT r, list(b || '|' || e ORDER BY lvl) AS path, string_agg(b || e, '' ORDER BY lvl) AS proof FROM steps GROUP BY r),
o AS (SELECT p.doc_id, p.leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(s.proof, '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(p.other, p.leaf), coalesce(s.path, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM p JOIN sub ON sub.tree = p.tree AND sub.n = 1 LEFT JOIN s ON s.r = p.r)
SELECT *, folded_root = root AS verified FROM o
"""
