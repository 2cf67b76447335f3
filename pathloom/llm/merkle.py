"""Merkle manifest of a data set: checkpointed levels, and proofs whose inner nodes are computed again.

Each row is a leaf, the digest of its fields. The leaves of a source, in the order of their ids,
form a tree in which every RUN consecutive nodes become their digest; the sources' roots form one
more tree of the same kind, whose root stands for the whole data set.

1. Leaves take their places by ranges (`ranks.numbered`), so that a source with a third of all rows
   is spread over a third of the partitions.
2. A tree is stored only every STEP levels, as blocks: a row holds one aligned subtree's RUN ** STEP
   nodes of a stored level, and nothing of the levels between. A block is all that a task needs to
   make its node of the next stored level.
3. A proof is read off from the top down. Each block makes its inner levels anew, emits for each
   of its nodes the siblings met on the way up, ahead of those its own top has already got, and
   lets the inner levels go. Text is read once and never moved: what moves is a digest or two a row.

Stored levels are settled, so a lost executor costs a stage and not the tree.

Defined results: a null field is `-`, so it differs from an empty one; a null source comes first and
is a source of its own; leaves ascend by id, null first, then by digest; repeated rows are leaves of
their own, each with its place's proof; texts are digested whole (2 GB at most, as any value); an
empty table has no root and gives no rows. Other columns count for nothing, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked, settled
from .ranks import numbered

RUN, STEP = 3, 4
BLOCK = RUN**STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """The digest of fields, each `-` or its length in bytes, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, changed: the last is the leaf that a row with text `changed` would have, null if that is null."""
    d = picked(docs, *FIELDS)
    *others, text = [F.col(f) for f in FIELDS]
    if changed is None:
        return d.select("doc_id", "source", leaf_of(*others, text).alias("leaf"), F.lit(None).cast("string").alias("changed"))
    d = d.withColumn("_changed", changed)
    return d.select("doc_id", "source", leaf_of(*others, text).alias("leaf"), F.when(F.col("_changed").isNotNull(), leaf_of(*others, F.col("_changed"))).alias("changed"))


def height(width: Column) -> Column:
    """Levels from a block's nodes to its top: until one node remains, or STEP where the tree goes on."""
    levels = F.lit(STEP)
    for h in range(STEP - 1, -1, -1):
        levels = F.when(width <= RUN**h, h).otherwise(levels)
    return levels


def up(nodes: Column) -> Column:
    """The next level: every RUN nodes, the last run fewer, as their digest."""
    each = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda i: digest(F.array_join(F.slice(a, i * RUN + 1, F.lit(RUN)), "")))
    return F.transform(F.array(nodes), each)[0]


def regenerated(blocks: DataFrame) -> DataFrame:
    """blocks with the levels above their nodes as l0 ... and their top node; only within a row."""
    b = blocks.withColumns({"height": height(F.col("width")), "l0": F.transform("nodes", lambda n: n["node"])})
    for h in range(STEP):
        b = b.withColumn(f"l{h + 1}", F.when(F.col("height") > h, up(F.col(f"l{h}"))).otherwise(F.col(f"l{h}")))
    return b.withColumn("top", F.col(f"l{STEP}")[0])


def in_blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """tree, block, width, nodes of rows (tree, pos, width, node and more): the stored form, settled."""
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    return settled(nodes.groupBy("tree", block).agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("pos", "node", *more))).alias("nodes")))


def stored_levels(first: DataFrame) -> list[DataFrame]:
    """first and the stored levels over it, up to the one where every tree is a single block."""
    levels = [first]
    while (levels[-1].agg(F.max("width")).first()[0] or 0) > BLOCK:
        above = regenerated(levels[-1]).select("tree", F.col("block").alias("pos"), F.ceil(F.col("width") / BLOCK).alias("width"), F.col("top").alias("node"))
        levels.append(in_blocks(above))
    return levels


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the sources' trees, and of the tree over their roots."""

    sources: list[DataFrame]
    whole: list[DataFrame]


def built(docs: DataFrame, changed: Column | None = None) -> Manifest:
    placed = numbered(settled(leaves(docs, changed)), "source", "doc_id", "leaf")
    first = in_blocks(placed.select(F.col("group_no").alias("tree"), "pos", "width", F.col("leaf").alias("node"), "doc_id", "source", "changed"), "doc_id", "source", "changed")
    sources = stored_levels(first)
    subroots = settled(regenerated(sources[-1]).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("top").alias("node")))
    n = subroots.agg(F.count("*").alias("width"))  # one row: no keys
    return Manifest(sources, stored_levels(in_blocks(subroots.join(F.broadcast(n)))))


def _siblings(i: Column, level: Column, h: int) -> Column:
    """What stands left and right of a node's ancestor on a level, within its run."""
    at = F.floor(i / RUN**h).cast("int")
    begin = F.floor(at / RUN).cast("int") * RUN
    return F.struct(F.array_join(F.slice(level, begin + 1, at - begin), "").alias("left"), F.array_join(F.slice(level, at + 2, begin + RUN - at - 1), "").alias("right"))


def _emitted(blocks: DataFrame, *carried: str) -> DataFrame:
    """A row a node: tree, pos, node (a struct of what is stored), proof, carried. blocks are regenerated and have the proof of their top as `above`."""
    def own(i: Column) -> Column:
        return F.slice(F.array(*[_siblings(i, F.col(f"l{h}"), h) for h in range(STEP)]), F.lit(1), F.col("height"))

    nodes = F.transform("nodes", lambda n, i: F.struct(n.alias("node"), F.concat(own(i), F.col("above")).alias("proof")))
    e = blocks.select("tree", *carried, F.explode(nodes).alias("_e"))
    return e.select("tree", F.col("_e.node.pos").alias("pos"), F.col("_e.node").alias("node"), F.col("_e.proof").alias("proof"), *carried)


def _downward(levels: list[DataFrame], top: DataFrame, *carried: str) -> DataFrame:
    """Emitted leaves; top is the highest stored level, regenerated, with `above` and carried."""
    found = _emitted(top, *carried)
    for blocks in reversed(levels[:-1]):
        above = found.select(F.col("tree").alias("_t"), F.col("pos").alias("_b"), F.col("proof").alias("above"), *carried)
        found = _emitted(regenerated(blocks).join(above, (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_b"))), *carried)
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, source, leaf, changed, subroot, root, and proof: siblings (left, right) level by level from leaf to root."""
    whole = regenerated(manifest.whole[-1]).withColumns({"above": F.array().cast(PROOF), "root": F.col("top")})
    roots = _downward(manifest.whole, whole, "root").select(F.col("pos").alias("_t"), F.col("proof").alias("above"), "root")
    top = regenerated(manifest.sources[-1]).withColumn("subroot", F.col("top")).join(roots, F.col("tree") == F.col("_t"))
    found = _downward(manifest.sources, top, "subroot", "root")
    return found.select("node.doc_id", "node.source", F.col("node.node").alias("leaf"), "node.changed", "subroot", "root", "proof")


def folded_up(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, p: digest(F.concat(p["left"], node, p["right"])))


def checked(docs: DataFrame) -> DataFrame:
    """Every document's leaf, roots and proof, and whether it still proves right once half of the texts lose their newlines."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    p = proofs(built(docs, tampered))
    joined = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    p = p.select("doc_id", "leaf", "subroot", "root", digest(joined).alias("proof_sha256"), folded_up(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a decimal number's digits, for SQL that has none: eight steps a byte.
CRC32 = """(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT))"""


def _field(c: str) -> str:
    return f"COALESCE(concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR), '-')"


ORACLE = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
h AS (SELECT doc_id, source, sha256(concat({", ".join(_field(c) for c in FIELDS)})) AS leaf, sha256(concat({", ".join(_field(c) for c in (*FIELDS[:-1], "changed"))})) AS changed FROM d),
placed AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, COUNT(*) OVER (PARTITION BY source) AS n FROM h),
t AS (SELECT tree, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, pos // 3, n),
subroots AS (SELECT tree, node AS subroot FROM t WHERE n = 1),
u AS (SELECT 0 AS level, tree AS pos, (SELECT COUNT(*) FROM subroots) AS n, subroot AS node FROM subroots
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
tops AS (SELECT tree, MAX(level) AS top FROM t GROUP BY tree),
steps AS (SELECT p.doc_id, p.tree, p.pos, p.leaf, s.level, COALESCE(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < me.pos), '') AS l, COALESCE(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > me.pos), '') AS r
  FROM placed p JOIN t me ON me.tree = p.tree AND me.pos = p.pos // CAST(pow(3, me.level) AS BIGINT) AND me.n > 1 JOIN t s ON s.tree = me.tree AND s.level = me.level AND s.pos // 3 = me.pos // 3
  GROUP BY p.doc_id, p.tree, p.pos, p.leaf, s.level, me.pos
  UNION ALL SELECT p.doc_id, p.tree, p.pos, p.leaf, q.top + s.level, COALESCE(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < me.pos), ''), COALESCE(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > me.pos), '')
  FROM placed p JOIN tops q ON q.tree = p.tree JOIN u me ON me.pos = p.tree // CAST(pow(3, me.level) AS BIGINT) AND me.n > 1 JOIN u s ON s.level = me.level AND s.pos // 3 = me.pos // 3
  GROUP BY p.doc_id, p.tree, p.pos, p.leaf, q.top, s.level, me.pos),
f AS (SELECT tree, pos, 0 AS level, changed AS node FROM placed
  UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(concat(s.l, f.node, s.r)) FROM f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level),
ends AS (SELECT tree, pos, arg_max(node, level) AS folded_root FROM f GROUP BY tree, pos),
proof AS (SELECT tree, pos, sha256(string_agg(concat(l, r), '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, b.subroot, w.node AS root, COALESCE(f.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = w.node AS verified
FROM placed p JOIN u w ON w.n = 1 JOIN subroots b USING (tree) JOIN ends e ON e.tree = p.tree AND e.pos = p.pos LEFT JOIN proof f ON f.tree = p.tree AND f.pos = p.pos
"""
