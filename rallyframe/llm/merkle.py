"""Merkle manifest of a dataset: a tree of digests for each group of rows, one root over the groups, and a proof for every row.

Leaves of a group ascend by the order column; every `arity` consecutive nodes (last run: fewer, even one) become the hash of
their hex digests until one node is left, the group's subroot. The subroots, in order of their groups (null first, bytewise), are
the leaves of one more tree, whose last node is the root.

1. Leaves are hashed by Spark expressions, so texts go no further. Rows (order, digest) are range-partitioned by
   (group, order, digest) and written; a copy number splits equal rows, so neither a hot group nor rows that repeat meet
   in one task. What lies before a part's run of a group, and the group's size, are sums over runs (one row for each part and
   group), so every leaf gets its index.
2. Events go up: within a part every child is an event that its parent's partial accumulates under its index; when the
   arity that the tree's size gives that parent is met, the parent is hashed and is an event itself. What stays without a
   parent, some log(n) nodes for each end of a part, is its frontier; the frontiers of `FAN` consecutive parts are
   combined by that key in the next round, and so on until one node is left.
3. Links go back down: each round hands every frontier node below it its proof (siblings level by level, left and right
   ones apart, up to the root), and a part builds its leaves' proofs on those of its own frontier.

A part has about `PART` rows, a combination FAN times some log(n) nodes, whatever the input; rounds grow with the logarithm of the
number of parts. Digests are bytes until the proofs.

Cases: null fields are `-`; a null order comes first; rows of equal group and order ascend by digest, so rows that repeat share
their neighbours' proofs in some order; a group of one row is its own subroot, one group its own root; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.llm import common

NAME = "op11_merkle_manifest"

#: Rows of a part, about.
PART = 1 << 17
#: Parts, or combinations of parts, that the next round combines.
FAN = 256
#: Rows of proofs sent at once.
ROWS = 2048
#: The tree over the groups.
TOP = -1

NODES = "block long, tree long, level int, i long, size long, trees long, digest binary"
LINKS = "block long, tree long, level int, i long, subroot string, root string, left array<string>, right array<string>"


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hex digest of a row's fields: `-` for null, else byte count, colon, value."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


class Forest:
    """The nodes that a part, or a combination of parts, knows. A node is (tree, level, i); `size` has the number of each tree's leaves."""

    def __init__(self, arity: int, trees: int):
        self.arity, self.size, self.widths = arity, {TOP: trees}, {}
        self.digest: dict[tuple, bytes] = {}
        self.partial: dict[tuple, int] = {}
        self.frontier: dict[tuple, None] = {}

    def width(self, tree: int, level: int) -> int:
        """How many nodes the tree has at a level."""
        known = self.widths.get(tree)
        if known is None:
            known = self.widths[tree] = [self.size[tree]]
            while known[-1] > 1:
                known.append(-(-known[-1] // self.arity))
        return known[level]

    def parent(self, node: tuple) -> tuple | None:
        """A subroot is a leaf of the tree over the groups; None for the root."""
        tree, level, i = node
        if self.width(tree, level) > 1:
            return tree, level + 1, i // self.arity
        return None if tree == TOP else (TOP, 0, tree)

    def children(self, node: tuple) -> list[tuple]:
        tree, level, i = node
        first = i * self.arity
        return [(tree, level - 1, k) for k in range(first, min(first + self.arity, self.width(tree, level - 1)))]

    def event(self, node: tuple, digest: bytes) -> None:
        """A child has come: its parents are hashed as far up as their arity is met."""
        while True:
            self.digest[node] = digest
            parent = self.parent(node)
            if parent is None:
                self.frontier[node] = None
                return
            if parent[1] == 0:
                node = parent
                continue
            own = self.children(parent)  # as many as the size gives it
            seen = self.partial.get(parent, 0) + 1
            if seen < len(own):
                self.partial[parent] = seen
                self.frontier[node] = None
                return
            self.partial.pop(parent, None)
            for child in own:
                self.frontier.pop(child, None)
            node, digest = parent, hashlib.sha256("".join(self.digest[c].hex() for c in own).encode()).digest()


def forest_of(batches: Iterator[pa.RecordBatch], arity: int) -> tuple[Forest | None, list[tuple]]:
    """The forest over the nodes of all batches, and these nodes in their order."""
    forest, nodes = None, []
    for batch in batches:
        for tree, level, i, size, trees, digest in zip(*(batch[c].to_pylist() for c in ("tree", "level", "i", "size", "trees", "digest")), strict=True):
            forest = forest or Forest(arity, trees)
            forest.size[tree] = size
            nodes.append((tree, level, i))
            forest.event(nodes[-1], digest)
    return forest, nodes


def combined(nodes: DataFrame, arity: int) -> DataFrame:
    """The frontier of every block."""

    def combine(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _ = forest_of(batches, arity)
        out = [(key[0].as_py(), *n, forest.size[n[0]], forest.size[TOP], forest.digest[n]) for n in forest.frontier]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=[f.split()[0] for f in NODES.split(", ")])

    return nodes.groupBy("block").applyInArrow(combine, NODES)


class Proofs:
    """Subroot, root, left and right siblings of nodes, from those of the forest's frontier."""

    def __init__(self, forest: Forest, links: dict[tuple, tuple]):
        self.forest, self.links, self.known = forest, links, dict(links)

    def forget(self) -> None:
        """Lets go of what can be had from the links again."""
        self.known = dict(self.links)

    def of(self, node: tuple) -> tuple:
        path = []
        while node not in self.known:
            parent = self.forest.parent(node)
            if parent is None:
                self.known[node] = (None, self.forest.digest[node].hex(), (), ())
            else:
                path.append(node)
                node = parent
        for child in reversed(path):
            subroot, root, left, right = self.known[node]
            if child[0] != node[0]:  # a subroot is the same digest as a leaf of the tree over the groups
                subroot = self.forest.digest[child].hex()
            else:
                own = self.forest.children(node)
                hexes = [self.forest.digest[c].hex() for c in own]
                at = own.index(child)
                left, right = ("".join(hexes[:at]), *left), ("".join(hexes[at + 1 :]), *right)
            self.known[child] = (subroot, root, left, right)
            node = child
        return self.known[node]


def linked(nodes: DataFrame, links: DataFrame | None, arity: int, keep: str, kept: list[str]) -> DataFrame:
    """The proofs of all nodes of every block, given those of its frontier; the last round's are its own."""
    kinds = {f.split(" ")[0]: f.split(" ")[1] for f in keep.split(", ")}
    schema = f"{keep}, subroot string, root string, left array<string>, right array<string>"

    def sent(rows: dict[str, pa.Array], proofs: list[tuple]) -> pa.RecordBatch:
        def lists(k: int) -> pa.Array:
            ends = [0]
            for p in proofs:
                ends.append(ends[-1] + len(p[k]))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for p in proofs for x in p[k]], pa.string()))

        own = [rows[c] for c in kinds]
        return pa.RecordBatch.from_arrays([*own, pa.array([p[0] for p in proofs], pa.string()), pa.array([p[1] for p in proofs], pa.string()), lists(2), lists(3)], [*kinds, "subroot", "root", "left", "right"])

    def link(tables: Iterator[pa.RecordBatch], above: dict[tuple, tuple]) -> Iterator[pa.RecordBatch]:
        held = list(tables)
        forest, _ = forest_of(iter(held), arity)
        proofs = Proofs(forest, above) if forest else None
        for batch in held:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                found = [proofs.of(n) for n in zip(*(part[c].to_pylist() for c in ("tree", "level", "i")), strict=True)]
                proofs.forget()
                yield sent({c: part[kept[j]] for j, c in enumerate(kinds)}, found)

    if links is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from link(batches, {})

        return nodes.groupBy("block").applyInArrow(alone, schema)

    # the proofs of a block's frontier come as rows before its nodes
    names = nodes.columns
    both = nodes.withColumn("above", F.lit(None).cast("struct<subroot string, root string, left array<string>, right array<string>>")).unionByName(
        links.select("block", "tree", "level", "i", F.struct("subroot", "root", "left", "right").alias("above")), allowMissingColumns=True
    )

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, own = {}, []
        for batch in batches:
            is_link = batch["above"].is_valid()
            mine = batch.filter(is_link)
            for tree, level, i, a in zip(*(mine[c].to_pylist() for c in ("tree", "level", "i", "above")), strict=True):
                above[tree, level, i] = (a["subroot"], a["root"], tuple(a["left"]), tuple(a["right"]))
            own.append(batch.filter(pc.invert(is_link)).select(names))
        yield from link(iter(own), above)

    return both.groupBy("block").applyInArrow(below, schema)


def indexed(rows: DataFrame, key: str, by: list[str], part: int = PART) -> tuple[DataFrame, int]:
    """The rows and block (consecutive rows in the order of key, by), tree (rank of the key, null first), i (place within the key), size (rows
    of the key), trees (number of keys); and the number of blocks."""
    spark = rows.sparkSession
    unsorted = common.written(rows)
    rows = unsorted.withColumns({"grp": F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), "copy": F.monotonically_increasing_id()})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part))
    rows = rows.repartitionByRange(parts, "grp", *by, "copy").sortWithinPartitions("grp", *by, "copy").drop("copy")
    place = F.monotonically_increasing_id()
    table = common.written(rows.withColumn("place", place).withColumns({"block": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)}))
    common.dropped(spark, unsorted)
    runs = table.groupBy("block", "grp").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("grp").orderBy("block")
    runs = runs.withColumns({"before": F.sum("n").over(own) - F.col("n"), "size": F.sum("n").over(Window.partitionBy("grp"))})
    runs = runs.withColumn("begun", F.when(F.col("before") == 0, F.row_number().over(Window.partitionBy("block", F.col("before") == 0).orderBy("grp"))))
    # one row a part: where its first key stands among all keys
    counts = runs.groupBy("block").agg(F.count("begun").alias("keys"))
    counts = counts.select("block", (F.sum("keys").over(Window.orderBy("block")) - F.col("keys")).alias("keys_before"), F.sum("keys").over(Window.partitionBy()).alias("trees"))
    ranked = runs.join(counts, "block").withColumn("tree", F.max(F.when(F.col("before") == 0, F.col("keys_before") + F.col("begun") - 1)).over(Window.partitionBy("grp")))
    ranked = ranked.select("block", "grp", "first", "before", "size", "trees", "tree")
    return table.join(ranked, ["block", "grp"]).withColumn("i", F.col("place") - F.col("first") + F.col("before")).drop("grp", "first", "before"), parts


def manifest(rows: DataFrame, key: str, order: str, digest: str, arity: int = 2, part: int = PART, fan: int = FAN) -> DataFrame:
    """All columns of rows, and subroot, root, left, right: hex digests, and the siblings' digests of each level, those to the left and to
    the right of the path concatenated (empty where there are none). digest: a column of hex digests."""
    kept = [f"_{k}" for k in range(len(rows.columns))]
    schema = rows.schema
    plain = rows.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(rows.columns, kept)))
    plain = plain.withColumns({"grp_key": F.col(kept[rows.columns.index(key)]), "ord": F.col(kept[rows.columns.index(order)]), "digest": F.unhex(F.col(kept[rows.columns.index(digest)]))})
    leaves, parts = indexed(plain, "grp_key", ["ord", "digest"], part)
    leaves = leaves.select(*kept, "block", "tree", F.lit(0).alias("level"), "i", "size", "trees", "digest")
    rounds = [leaves]
    while True:  # as many rounds as it takes to come from all parts to one
        low = combined(rounds[-1], arity)
        rounds.append(common.written(low.withColumn("child", F.col("block")).withColumn("block", F.floor(F.col("block") / fan).cast("long"))))
        if parts <= 1:
            break
        parts = -(-parts // fan)
    links = None
    for nodes in reversed(rounds[1:]):
        links = common.written(linked(nodes, links, arity, "block long, tree long, level int, i long", ["child", "tree", "level", "i"]))
    keep = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(kept, schema))
    out = linked(leaves, links, arity, keep, kept)
    return out.select(*(F.col(k).alias(f.name) for k, f in zip(kept, schema)), "subroot", "root", "left", "right")


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]).cast("binary"), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    values = {c: F.col(c) for c in FIELDS}
    one_more = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(*one_more.values()))
    done = manifest(docs.select("doc_id", "lang", leaf(*values.values()).alias("leaf"), tampered.alias("tampered")), "lang", "doc_id", "leaf")
    siblings = F.array_join(F.zip_with("left", "right", lambda l, r: F.concat(l, r)), "")
    done = done.withColumns({"proof_sha256": F.sha2(siblings.cast("binary"), 256), "folded_root": folded(F.coalesce("tampered", "leaf"), F.col("left"), F.col("right"))})
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda n: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n, 'text')))})"
    step = "{0}.rid, {0}.lang, {0}.lvl + 1 AS lvl, {0}.i // 2 AS i, ({0}.n + 1) // 2 AS n, {0}.said || coalesce(s.d, '') AS said, sha256(CASE WHEN {0}.i % 2 = 0 THEN {0}.acc || coalesce(s.d, '') ELSE s.d || {0}.acc END) AS acc"
    return f"""
WITH RECURSIVE {common.CRC_TABLE_SQL}, l AS (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
    CASE WHEN {common.crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN {leaf("(n_chars::HUGEINT + 1)")} ELSE {leaf("n_chars")} END AS shown
  FROM documents, crc
), ix AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l
), up AS (
  SELECT lang, 0 AS lvl, i, n, leaf AS d FROM ix
  UNION ALL
  SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, lvl, i // 2, (n + 1) // 2
), g AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lvl, i, n, subroot AS d FROM g
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 2, (n + 1) // 2
), p AS (
  SELECT rid, lang, 0 AS lvl, i, n, '' AS said, coalesce(shown, leaf) AS acc FROM ix
  UNION ALL
  SELECT {step.format("p")} FROM p LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = p.lvl AND s.i = xor(p.i, 1) WHERE p.n > 1
), q AS (
  SELECT p.rid, p.lang, 0 AS lvl, g.i, g.n, p.said, p.acc FROM p JOIN g ON g.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT {step.format("q")} FROM q LEFT JOIN top s ON s.lvl = q.lvl AND s.i = xor(q.i, 1) WHERE q.n > 1
)
SELECT ix.doc_id, ix.leaf, g.subroot, t.d AS root, sha256(q.said) AS proof_sha256, q.acc AS folded_root, q.acc = t.d AS verified
FROM ix JOIN g ON g.lang IS NOT DISTINCT FROM ix.lang JOIN q ON q.rid = ix.rid AND q.n = 1 JOIN top t ON t.n = 1
"""


SQL = _sql()
