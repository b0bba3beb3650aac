"""Merkle dataset manifest: one hash tree per language, one over the languages, and every row's proof by pointer jumping.

A node holds the siblings on its way to an ancestor and a pointer to that ancestor. Joining the pointers with the nodes they point to appends the ancestor's siblings
and doubles the distance, so paths of d levels take log2(d) self-joins. Round k needs only the nodes of levels that 2^k divides, so the nodes' side shrinks
with the square of the round before; leaves move four times at most, whatever the depth, because from level 16 on the nodes' side is one row for 65,536 leaves and is sent to them.

Positions come from a range partitioning and prefix counts, never from one sorted task; trees grow eight levels a job, in blocks of 256 neighbours.

Results by case: a null value is ``-`` in a leaf; null ids come first, a null language is a tree of its own, the first; rows that share an id are ordered by leaf
and each is a leaf; a language of one row has that leaf as subroot, a table of one language that subroot as root; a proof without siblings is the hash of
nothing; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.llm.registry import Tables, query
from feedops.session import pinned

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "top"
# Levels that one job adds: blocks of 2^8 neighbours.
BLOCK_LEVELS = 8
# One entry of a path: which side the sibling is on (0 none, 1 left, 2 right), then its 32 bytes.
ENTRY = 33
# Nodes near the root are sent to every task up to this number (30 MB), and salted beyond it.
BROADCAST_NODES, SALTS = 50_000, 64


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """sha256 of strings in a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*[field(columns[name]) for name in FIELDS])


def parent(first: Column, second: Column) -> Column:
    """The node above one or two neighbours."""
    return digest(hexed(first), F.coalesce(hexed(second), F.lit("")))


def _bits(n: Column) -> Column:
    """Levels above ``n`` leaves: ceil(log2(n))."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at`` (0, 1, ... within its tree) and ``n`` (rows of its tree), by range partitions and prefix counts.

    Ranges are cut on the whole order and a draw, so neither one tree nor rows that all look alike fill one task.
    """
    keys = [tree, *order]
    ranged = rows.withColumn("draw", F.rand(17)).repartitionByRange(*keys, "draw").sortWithinPartitions(*keys).drop("draw")
    ranged = pinned(ranged.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).alias("part")
    counts = ranged.groupBy(tree, part).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    # One row per tree and range; a tree's rows here are bounded by the number of ranges.
    runs = counts.groupBy(tree).agg(F.array_sort(F.collect_list(F.struct("part", "first", "rows"))).alias("runs"), F.sum("rows").alias("n"))
    before = F.transform("runs", lambda x, i: F.struct(x["part"].alias("part"), (x["first"] - F.aggregate(F.slice("runs", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["rows"])).alias("shift")))
    shifts = runs.select(tree, "n", F.explode(before).alias("x")).select(tree, "n", "x.part", "x.shift")
    found = ranged.withColumn("part", part).join(shifts, [tree, "part"])
    return found.withColumn("at", F.col("place") - F.col("shift")).drop("place", "part", "shift")


def _levels(base: int) -> Column:
    """From ``digests`` of one block: the arrays of its levels base, base + 1, ..., as far as the tree is deep."""

    def above(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: parent(F.get(level, 2 * i), F.get(level, 2 * i + 1)))

    steps = F.sequence(F.lit(1), F.least(F.lit(BLOCK_LEVELS), F.col("depth") - base))
    return F.aggregate(steps, F.array("digests"), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def _entry(level: Column, i: Column) -> Column:
    """The path entry of the i-th node of a level: its sibling, if there is one."""
    right = F.get(level, i + 1)
    return F.when(i % 2 == 1, F.concat(F.lit(b"\x01"), F.get(level, i - 1))).when(right.isNotNull(), F.concat(F.lit(b"\x02"), right)).otherwise(F.lit(bytes(ENTRY)))


def build(leaves: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves with ``entry``, inner nodes below the roots, roots) of the trees of ``leaves``: (tree, at, depth, digest, load).

    Nodes are (tree, level, at, depth, entry); a leaf that is a root has no entry. ``load`` is whatever belongs to a leaf.
    """
    single = leaves.where("depth = 0")
    bottom = single.select("tree", "at", "depth", "digest", "load", F.lit(None).cast("binary").alias("entry"))
    nodes, roots = [], [single.select("tree", "digest")]
    rows = leaves.where("depth > 0")
    for base in range(0, deepest, BLOCK_LEVELS):
        item = F.struct("at", "digest", "load") if base == 0 else F.struct("at", "digest")
        blocks = rows.groupBy("tree", "depth", F.shiftright("at", BLOCK_LEVELS).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        blocks = pinned(blocks.withColumn("digests", F.transform("items", lambda x: x["digest"])).withColumn("levels", _levels(base)).drop("digests"))
        if base == 0:
            found = blocks.select("tree", "depth", "levels", F.posexplode("items").alias("i", "x"))
            bottom = bottom.unionByName(found.select("tree", "x.at", "depth", "x.digest", "x.load", _entry(F.col("levels")[0], F.col("i")).alias("entry")))
        inner = blocks.select("tree", "depth", "block", F.posexplode("levels").alias("j", "level")).select("tree", "depth", "block", "j", "level", F.posexplode("level").alias("i", "digest"))
        place = F.expr(f"shiftleft(block, {BLOCK_LEVELS} - j)") + F.col("i")
        inner = inner.select("tree", "depth", (F.col("j") + base).alias("level"), place.alias("at"), "digest", _entry(F.col("level"), F.col("i")).alias("entry"), "j")
        # The last level of a block has its siblings in other blocks: it is the first level of the next job.
        nodes.append(inner.where(f"level > 0 and level < depth and j < {BLOCK_LEVELS}").drop("j", "digest"))
        roots.append(inner.where("level = depth").select("tree", "digest"))
        rows = inner.where(f"j = {BLOCK_LEVELS} and level < depth").select("tree", "depth", "at", "digest")
    empty = bottom.limit(0).select("tree", "depth", F.lit(0).alias("level"), "at", "entry")
    return bottom, reduce(DataFrame.unionByName, nodes, empty), reduce(DataFrame.unionByName, roots)


def _key(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}tree").alias("tree"), F.col(f"{prefix}level").cast("int").alias("level"), F.col(f"{prefix}at").cast("long").alias("at"))


def _above(top_depth: int) -> Column:
    """The pointer of a node (tree, level, at, depth, rank) to the node above it; null where that is the root."""
    in_tree = F.struct("tree", (F.col("level") + 1).cast("int").alias("level"), F.shiftright("at", 1).alias("at"))
    to_top = F.when(F.lit(top_depth > 0), F.struct(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("rank").alias("at")))
    last = F.when(F.col("tree") == TOP, F.lit(None)).otherwise(to_top)
    return F.when(F.col("level") + 1 < F.col("depth"), in_tree).otherwise(last)


def jump(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every row's path and pointer with those of the node it points to appended; rows that have reached the root stay as they are.

    A pointer below level 16 is shared by at most 256 rows. Nodes further up are few but popular: they are repeated once a salt, or all nodes go to every
    task behind a count. The salt is drawn from the row's path, so a repeated task draws the same.
    """
    target = nodes.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("path").alias("more"))
    if nodes.count() <= BROADCAST_NODES:
        found = rows.join(F.broadcast(target), "up", "left")
    else:
        popular = (F.col("up.tree") == TOP) | (F.col("up.level") >= 16)
        target = target.withColumn("salt", F.explode(F.when(popular, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        draw = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
        found = rows.withColumn("salt", F.when(F.col("up").isNull() | popular, draw).otherwise(0)).join(target, ["up", "salt"], "left").drop("salt")
    return found.withColumn("path", F.concat("path", F.coalesce("more", F.lit(b"")))).withColumn("up", F.col("next")).drop("next", "more")


def proofs(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """(tree, digest, load, depth, path) of every leaf, and the root in hexadecimal (null without rows).

    ``leaves``: (tree, order, digest, load); a tree's leaves are ordered by ``order``, then by digest, trees by name. ``path`` holds ``ENTRY`` bytes a level.
    """
    placed = positions(leaves, "tree", ["order", "digest"]).withColumn("depth", _bits(F.col("n"))).drop("order", "n")
    trees = positions(placed.groupBy(F.col("tree").alias("name")).agg(F.max("depth").alias("depth")).withColumn("tree", F.lit(TOP)), "tree", ["name"])
    trees = pinned(trees.select(F.col("name").alias("tree"), "depth", F.col("at").alias("rank"), F.col("n")))
    shape = trees.agg(F.max("depth"), F.max("n")).first()
    if shape[0] is None:
        return placed.select("tree", "digest", "load", "depth", F.lit(b"").alias("path")), None
    deepest, top_depth = shape[0], (shape[1] - 1).bit_length()
    bottom, inner, roots = build(placed.select("tree", "at", "depth", "digest", "load"), deepest)
    subroots = roots.join(trees, "tree").select(F.lit(TOP).alias("tree"), F.col("rank").alias("at"), F.lit(top_depth).alias("depth"), "digest", F.lit(None).cast("string").alias("load"))
    top_bottom, top_inner, top_roots = build(pinned(subroots), top_depth)
    root = top_roots.first()["digest"]

    ranks = trees.select("tree", "rank")
    empty = F.lit(b"")
    # A leaf that is a root itself already stands on the top tree's first level.
    start = bottom.join(ranks, "tree").withColumn("level", F.when(F.col("depth") == 0, F.lit(-1)).otherwise(0))
    rows = start.select("tree", "digest", "load", "depth", F.coalesce("entry", empty).alias("path"), _above(top_depth).alias("up"))
    top_nodes = top_bottom.where("depth > 0").select("tree", "depth", F.lit(0).alias("level"), "at", "entry").unionByName(top_inner)
    nodes = inner.join(ranks, "tree").unionByName(top_nodes.withColumn("rank", F.lit(None).cast("long")))
    nodes = pinned(nodes.select(_key().alias("key"), F.col("entry").alias("path"), _above(top_depth).alias("up")))
    for k in range((deepest + top_depth).bit_length()):
        rows = jump(rows, nodes)
        kept = nodes.where((F.col("key.tree") == TOP) | (F.col("key.level") % (2 << k) == 0))
        nodes = pinned(jump(kept, nodes))
    return rows.drop("up"), bytes(root).hex()


def entries(path: Column) -> Column:
    n = (F.length(path) / ENTRY).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(path, i * ENTRY + 1, ENTRY))).otherwise(F.array().cast("array<binary>"))


def _side(entry: Column) -> Column:
    return F.hex(F.substring(entry, 1, 1))


def fold(start: Column, path: Column) -> Column:
    """The ancestor that a digest and the siblings of its path lead to."""

    def step(value: Column, entry: Column) -> Column:
        sibling = F.substring(entry, 2, ENTRY - 1)
        return F.when(_side(entry) == "01", parent(sibling, value)).when(_side(entry) == "02", parent(value, sibling)).otherwise(parent(value, F.lit(None).cast("binary")))

    return F.aggregate(path, start, step)


def siblings_digest(path: Column) -> Column:
    """sha256 of the path's siblings, in hexadecimal."""
    present = F.filter(path, lambda e: _side(e) != "00")
    return F.sha2(F.array_join(F.transform(present, lambda e: hexed(F.substring(e, 2, ENTRY - 1))), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified) for every row of ``docs``, digests in hexadecimal.

    ``tampered`` says in which rows ``n_chars`` is raised by one before the proof is checked: those do not verify.
    """
    columns = {name: F.col(name) for name in FIELDS}
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string") if tampered is not None else None
    seen = leaf(columns) if more is None else leaf(columns | {"n_chars": F.when(F.coalesce(tampered, F.lit(False)), more).otherwise(F.col("n_chars").cast("string"))})
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows, root = proofs(docs.select(tree.alias("tree"), F.col("doc_id").alias("order"), leaf(columns).alias("digest"), F.struct("doc_id", seen.alias("seen")).alias("load")))
    rows = rows.select("digest", "depth", "load.doc_id", "load.seen", entries(F.col("path")).alias("path"))
    rows = rows.select("*", fold(F.col("digest"), F.slice("path", 1, F.col("depth"))).alias("subroot"), fold(F.col("seen"), F.col("path")).alias("folded"))
    return rows.select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), "path",
                       hexed(F.col("folded")).alias("folded_root"), F.coalesce(hexed(F.col("folded")) == F.lit(root), F.lit(False)).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_BAD_LEAF = "sha256(" + " || ".join(_FIELD.format("(n_chars + tampered)" if c == "n_chars" else c) for c in FIELDS) + ")"
_ABOVE = "list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
_STEP = "CASE e[1] WHEN 'L' THEN sha256(e[2:] || h) WHEN 'R' THEN sha256(h || e[2:]) ELSE sha256(h) END"
_ENTRY = "CASE WHEN ({i} >> level) % 2 = 1 THEN 'L' || nodes[{i} >> level] WHEN len(nodes) >= ({i} >> level) + 2 THEN 'R' || nodes[({i} >> level) + 2] ELSE 'N' END"
_ORACLE = f"""
WITH RECURSIVE checked AS (
  SELECT *, CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, b: xor(crc >> 8, list_reduce([xor(crc, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))), 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS tampered
  FROM documents),
leaves AS (SELECT doc_id, lang, {_LEAF} AS leaf, {_BAD_LEAF} AS seen FROM checked),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
levels(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_ABOVE} FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM levels WHERE len(nodes) = 1),
tops(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY rank) FROM subroots
  UNION ALL SELECT level + 1, {_ABOVE} FROM tops WHERE len(nodes) > 1),
below AS (SELECT p.lang, p.pos, list({_ENTRY.format(i='p.pos')} ORDER BY level) AS path FROM placed p JOIN levels l ON l.lang IS NOT DISTINCT FROM p.lang WHERE len(nodes) > 1 GROUP BY p.lang, p.pos),
above AS (SELECT lang, list({_ENTRY.format(i='rank')} ORDER BY level) AS path FROM subroots JOIN tops ON len(nodes) > 1 GROUP BY lang),
paths AS (SELECT p.*, s.subroot, coalesce(b.path, []) || coalesce(a.path, []) AS path FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN below b ON b.lang IS NOT DISTINCT FROM p.lang AND b.pos = p.pos LEFT JOIN above a ON a.lang IS NOT DISTINCT FROM p.lang),
folded AS (SELECT *, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, list_reduce([seen] || path, lambda h, e: {_STEP}) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda e: e <> 'N'), lambda e: e[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM folded
"""


@query("op12_merkle", sql=_ORACLE)
def _query(t: Tables) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = manifest(t.documents.select(*FIELDS), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
