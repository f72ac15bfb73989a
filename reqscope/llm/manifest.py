"""Merkle manifest of a table: leaf hashes, proofs and verification by butterfly exchange.

H is the lowercase hex sha256 of its inputs, concatenated; digests enter as hex
text. A row's leaf is H of its fields, each ``-`` if null, else the UTF-8 byte
count, ``:`` and the value. The rows of a group, in order, are the leaves of a
binary tree (a last node without partner is hashed alone while others remain);
the groups' subroots, in order of the group, are the leaves of one more tree.

1. The scan hashes each row to 32 bytes; texts go no further. Rows are range
   partitioned by group and order, and numbered by their place in the partition
   plus the counts of the partitions before: no task holds a group.
2. Aligned runs of ``2^block_bits`` leaves are blocks, hashed in tasks of one
   block each. A block is the partition of the exchange.
3. Butterfly rounds. Before a round every block knows the root of its subtree of
   ``fanout^r`` aligned blocks. Blocks with the same number inside ``fanout``
   neighbouring subtrees form a cell, swap these roots and hash their common
   ancestors, each for itself, keeping the siblings they pass. All blocks of a
   subtree do so redundantly, so at the end each block holds its whole upper
   proof and nothing is passed down. A subtree of fewer blocks than its
   neighbours (the tail, or a small group) sends its root as often as the
   neighbours need. The rounds go on across the groups to the root in the same
   way. A cell has at most ``fanout`` blocks however large the tree is.
4. Each block folds every leaf with its siblings to a root and compares.

Nothing is collected but the number of rounds, nothing broadcast by request.

Defined results: rows without group come first, as a group of their own; rows
without order value come first in their group; ties in the order go by leaf
hash; repeated rows are leaves each; fields that the table does not have count
as null. Altered rows are those with ``altered`` columns that differ: they are
checked with the altered leaf against the untampered siblings. An empty table
gives no rows. Columns of other names play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class ManifestParams:
    block_bits: int = 10  #: leaves of a block, as a power of two
    fanout_bits: int = 4  #: subtrees that meet in a round, as a power of two


def field_text(value: Column) -> Column:
    """``-`` for a null, else byte count, colon, value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def placed(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Number the rows of each group in order: ``(rows, pieces)``, both with ``part``.

    ``rows`` is written in range order with ``at``, the place in its part. A piece
    is the run of a group in one part: ``first`` (smallest ``at``), ``before`` (rows of
    the group in earlier parts) and ``n`` (rows of the group). The windows run
    over pieces, of which a group has at most one per part.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    mid = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", mid)
    rows = materialize(rows.select("*", F.shiftright("mid", 33).alias("part"), F.col("mid").bitwiseAND((1 << 33) - 1).alias("at")).drop("mid"), name)
    pieces = rows.groupBy("part", *group).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    own = Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy(F.lit(0))
    before = F.sum("c").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    return rows, pieces.select("part", *group, "first", before.alias("before"), F.sum("c").over(own).alias("n"))


def _subtrees(count: Column, level: int) -> Column:
    """Nodes ``level`` levels above ``count`` nodes."""
    return F.shiftright(count + F.lit((1 << level) - 1), level)


def group_rounds(sizes: DataFrame, rounds: int, p: ManifestParams) -> DataFrame:
    """Where each group stands in the rounds across groups: ``(tree, plan)`` from ``(tree, blocks)``.

    ``plan[q]`` holds the blocks in earlier subtrees of the cell (``before``), in the own subtree (``own``), in the widest subtree (``widest``) and in all
    subtrees of the cell (``together``). Each round groups at most ``fanout`` rows.
    """
    level, steps = sizes.select("tree", F.col("tree").alias("s"), F.col("blocks").alias("own")), []
    plan = sizes.select("tree")
    for q in range(rounds):
        cell = Window.partitionBy(F.shiftright("s", p.fanout_bits))
        level = level.select(
            "s", "own", F.max("own").over(cell).alias("widest"), F.sum("own").over(cell).alias("together"),
            (F.sum("own").over(cell.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("before"))
        plan = plan.withColumn("s", F.shiftright("tree", p.fanout_bits * q)).join(
            level.select("s", F.struct("before", "own", "widest", "together").alias(f"q{q}")), "s").drop("s")
        level = level.groupBy(F.shiftright("s", p.fanout_bits).alias("s")).agg(F.max("together").alias("own"))
        steps.append(f"q{q}")
    kind = "array<struct<before:bigint,own:bigint,widest:bigint,together:bigint>>"
    return plan.select("tree", (F.array(*steps) if steps else F.array()).cast(kind).alias("plan"))


def exchange(state: DataFrame, p: ManifestParams) -> DataFrame:
    """One round: blocks of a cell swap subtree roots and climb ``fanout_bits`` levels.

    ``state`` has ``scope`` (the tree climbed), ``s`` (subtree), ``o`` (number in the subtree), ``m`` (blocks of the subtree), ``widest``
    (blocks of the cell's widest subtree), ``total`` (subtrees in the tree), ``node`` (the subtree's root), ``path``
    (siblings so far) and more columns that are kept.
    """
    rest = [c for c in state.columns if c not in ("scope", "s", "o", "m", "widest", "total", "node")]
    digit = F.col("s").bitwiseAND((1 << p.fanout_bits) - 1)
    sent = state.withColumn("cell", F.explode(F.sequence("o", F.col("widest") - 1, "m")))
    sent = sent.withColumns({"digit": digit.cast("int"), "g": F.shiftright("s", p.fanout_bits)})
    member = F.struct("digit", "s", "o", "m", "widest", *rest)
    cells = sent.groupBy("scope", "g", "cell", "total").agg(
        F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("swapped"),
        F.collect_list(F.when(F.col("cell") == F.col("o"), member)).alias("members"))  # copies sent elsewhere are no members there
    rows = cells.select("scope", "total", F.col("swapped.node").alias("nodes"), F.inline("members"))
    for j in range(p.fanout_bits):
        climbing = _subtrees(F.col("total"), j) > 1
        sibling = F.get("nodes", F.shiftright("digit", j).bitwiseXOR(F.lit(1)))
        up = F.transform(F.sequence(F.lit(0), F.floor((F.size("nodes") - 1) / 2).cast("int")),
                         lambda i: F.sha2(F.concat(F.get("nodes", 2 * i), F.coalesce(F.get("nodes", 2 * i + 1), F.lit(""))), 256))
        rows = rows.withColumns({
            "path": F.when(climbing & sibling.isNotNull(), F.concat("path", F.array(sibling))).otherwise(F.col("path")),
            "nodes": F.when(climbing, up).otherwise(F.col("nodes"))})
    return rows.select("scope", "s", "o", "m", "widest", "total", F.col("nodes")[0].alias("node"), *rest)


def climb(blocks: DataFrame, lang_rounds: int, top_rounds: int, p: ManifestParams) -> DataFrame:
    """``(tree, block, trees, path, subroot, root)`` from ``(tree, block, leaves, trees, plan, node)``: all rounds, first inside the trees, then across them."""
    total = _subtrees(F.col("leaves"), p.block_bits)
    state = blocks.select("tree", "block", "trees", "plan", "leaves", F.array().cast("array<string>").alias("path"), "node")
    for r in range(lang_rounds):
        span = 1 << (p.fanout_bits * r)
        s = F.shiftright("block", p.fanout_bits * r)
        first = F.shiftleft(F.shiftright("block", p.fanout_bits * (r + 1)), p.fanout_bits * (r + 1))
        state = exchange(state.withColumns({
            "scope": F.col("tree"), "s": s, "o": F.col("block") % span,
            "m": F.least(F.lit(span), total - s * span), "widest": F.least(F.lit(span), total - first),
            "total": _subtrees(total, p.fanout_bits * r)}), p)
        state = state.drop("scope", "s", "o", "m", "widest", "total")
    state = state.withColumns({"subroot": F.col("node"), "o": F.col("block"), "s": F.col("tree")})
    for q in range(top_rounds):
        now = F.col("plan")[q]
        state = exchange(state.withColumns({
            "scope": F.lit(-1).cast("long"), "m": now["own"], "widest": now["widest"],
            "total": _subtrees(F.col("trees"), p.fanout_bits * q)}), p)
        state = state.withColumns({"o": F.col("o") + now["before"], "s": F.shiftright("s", p.fanout_bits)}).drop("scope", "m", "widest", "total")
    return state.select("tree", "block", "trees", "path", "subroot", F.col("node").alias("root"))


def _hex(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves: list[str], height: int, count: int) -> list[list[str]]:
    """Nodes of a block from its leaves up to its root, level by level, in a tree of ``count`` leaves."""
    out = [leaves]
    for level in range(height):
        if count <= 1 << level:  # the whole tree has one node already
            break
        below = out[-1]
        out.append([_hex(*below[i: i + 2]) for i in range(0, len(below), 2)])
    return out


def fold(node: str, place: int, count: int, siblings: Iterator[str]) -> str:
    """Climb from the ``place``-th of ``count`` nodes to the root, taking a sibling wherever the node has one."""
    while count > 1:
        if place % 2:
            node = _hex(next(siblings), node)
        elif place + 1 < count:
            node = _hex(node, next(siblings))
        else:
            node = _hex(node)
        place, count = place >> 1, (count + 1) >> 1
    return node


def _block_roots(p: ManifestParams):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        one = pdf.iloc[0]
        top = levels([bytes(x).hex() for x in pdf["leaf"]], p.block_bits, int(one["leaves"]))[-1]
        return pd.DataFrame({"tree": [one["tree"]], "block": [one["block"]], "leaves": [one["leaves"]], "node": [top[0]],
                             "ids": [pdf["id"].tolist()], "hashes": [b"".join(bytes(x) for x in pdf["leaf"])], "altered": [pdf["altered"].tolist()]})

    return run


PROOF_TYPES = {"id": pa.string(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(),
               "verified": pa.bool_(), "n_siblings": pa.int32(), "place": pa.int64(), "leaves": pa.int64()}
PROOF_SCHEMA = ("id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
                "n_siblings int, place long, leaves long")


def check_block(b: dict, p: ManifestParams, with_proof: bool) -> list[tuple]:
    """A row per leaf of a block: its siblings up to the root, and the root that its (altered) leaf folds to with them."""
    start, count = b["block"] << p.block_bits, b["leaves"]
    leaves = [b["hashes"][i: i + 32].hex() for i in range(0, len(b["hashes"]), 32)]
    nodes, above, known, rows = levels(leaves, p.block_bits, count), b["path"], {}, []
    height = len(nodes) - 1
    for i, leaf in enumerate(leaves):
        inside, node = [], leaf if b["altered"][i] is None else b["altered"][i].hex()
        for level, at in zip(nodes[:-1], (i >> n for n in range(height))):
            if at % 2:
                inside.append(level[at - 1])
                node = _hex(inside[-1], node)
            elif at + 1 < len(level):
                inside.append(level[at + 1])
                node = _hex(node, inside[-1])
            else:
                node = _hex(node)
        if node not in known:  # leaves that reach the same block root share the way from there
            up = iter(above)
            known[node] = fold(fold(node, start >> height, -(-count >> height), up), b["tree"], b["trees"], up)
        proof = inside + above
        rows.append((b["ids"][i], leaf, b["subroot"], b["root"], _hex(*proof), known[node], known[node] == b["root"], len(proof), start + i, count,
                     *([proof] if with_proof else [])))
    return rows


def _proofs(p: ManifestParams, with_proof: bool):
    types = PROOF_TYPES | ({"proof": pa.list_(pa.string())} if with_proof else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = check_block(batch.slice(k, 1).to_pylist()[0], p, with_proof)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))

    return run


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, altered: dict[str, Column] | None = None, altered_where: Column | None = None,
             p: ManifestParams = ManifestParams(), with_proof: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings, place (in its group), leaves (of its group),
    and the siblings themselves with ``with_proof``.

    ``altered`` gives values that replace fields, in rows with ``altered_where``, before the leaf is checked.
    """
    have = {c.lower() for c in docs.columns}

    def field(name: str) -> Column:
        return F.col(name) if name.lower() in have else F.lit(None).cast("string")

    swapped = altered or {}
    leaf = leaf_hash([field(f) for f in fields])
    changed = F.when(F.coalesce(altered_where, F.lit(False)), leaf_hash([swapped.get(f, field(f)) for f in fields])) if altered_where is not None else F.lit(None)
    rows = docs.select(field(group).cast("string").alias("grp"), field(order).alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(changed.cast("string")).alias("altered"))
    # equal rows differ by a number of their own, so that range partitioning can part them
    leaves = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    spark, kind = docs.sparkSession, dict(leaves.dtypes)["id"]
    rows, pieces = placed(leaves, ["grp"], ["id", "leaf", "tie"], "ordered")
    pieces = materialize(pieces, "pieces")
    groups = pieces.groupBy("grp").agg(F.max("n").alias("n"))
    ranked, runs = placed(groups, [], ["grp"], "groups")
    trees = ranked.join(runs.withColumnRenamed("n", "trees"), "part").select(
        "grp", "n", "trees", (F.col("before") + F.col("at") - F.col("first")).alias("tree"), _subtrees(F.col("n"), p.block_bits).alias("blocks"))
    trees = materialize(trees, "trees")
    most = trees.agg(F.max("blocks").alias("blocks"), F.max("trees").alias("trees")).first()
    rounds = [0 if not n else -(-(int(n) - 1).bit_length() // p.fanout_bits) for n in (most["blocks"], most["trees"])]
    trees = trees.join(group_rounds(trees.select("tree", "blocks"), rounds[1], p), "tree")
    # the pieces are few (parts plus groups), so rows meet their numbers by part and group
    numbers = pieces.withColumnRenamed("grp", "g").join(trees.select(F.col("grp").alias("g2"), "tree"), F.col("g").eqNullSafe(F.col("g2"))).drop("g2")
    numbers = numbers.withColumnRenamed("part", "piece_part")
    on = (F.col("part") == F.col("piece_part")) & F.col("grp").eqNullSafe(F.col("g"))
    position = F.col("before") + F.col("at") - F.col("first")
    numbered = rows.join(numbers, on).select(
        "tree", position.alias("position"), F.shiftright(position, p.block_bits).alias("block"), F.col("n").alias("leaves"),
        F.col("id").cast("string").alias("id"), "leaf", "altered")
    blocks = materialize(numbered.groupBy("tree", "block").applyInPandas(
        _block_roots(p), "tree long, block long, leaves long, node string, ids array<string>, hashes binary, altered array<binary>"), "blocks")
    start = blocks.select("tree", "block", "leaves", "node").join(trees.select("tree", "trees", "plan"), "tree")
    upper = climb(start, rounds[0], rounds[1], p)
    joined = blocks.select("tree", "block", "leaves", "ids", "hashes", "altered").join(upper, ["tree", "block"])
    out = joined.mapInArrow(_proofs(p, with_proof), PROOF_SCHEMA + (", proof array<string>" if with_proof else ""))
    return out.select(F.col("id").cast(kind).alias(order), *out.columns[1:])


DOCUMENT_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(docs: DataFrame, p: ManifestParams = ManifestParams(), with_proof: bool = False) -> DataFrame:
    """The manifest of ``documents`` by language; one more character is claimed where 7 divides the crc32 of the number in decimal."""
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = (F.col("n_chars").cast("decimal(38,0)") + F.lit(1)).cast("decimal(38,0)")
    altered = {"n_chars": claimed} if "n_chars" in (c.lower() for c in docs.columns) else {}
    return manifest(docs, DOCUMENT_FIELDS, "lang", "doc_id", altered, where, p, with_proof)


def oracle_sql() -> str:
    """The registered query as DuckDB SQL: trees level by level, then one walk up per row."""
    text = lambda e: f"coalesce(concat(strlen(CAST({e} AS VARCHAR)), ':', CAST({e} AS VARCHAR)), '-')"
    one = lambda e: f"CASE WHEN {e} IS NULL THEN '-' ELSE {text(e)} END"
    leaf = lambda n: "sha256(concat(" + ", ".join(one(n if f == "n_chars" else f) for f in DOCUMENT_FIELDS) + "))"
    # crc32 of a string, bit by bit: a byte enters, then eight shifts (-1)
    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1),
  lambda k: [CAST(ord(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
    walk = lambda name, start, tree, match: f"""{name} AS ({start}
  UNION ALL SELECT w.id, w.t, w.l + 1, w.i // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.i % 2 = 1 THEN concat(s.h, w.h) ELSE concat(w.h, coalesce(s.h, '')) END), concat(w.sib, coalesce(s.h, ''))
  FROM {name} w LEFT JOIN {tree} s ON {match} AND s.l = w.l AND s.i = xor(w.i, 1) WHERE w.n > 1)"""  # noqa: E731
    return f"""WITH RECURSIVE hashed AS (SELECT row_number() OVER () AS id, doc_id, lang, {leaf('n_chars')} AS leaf,
  CASE WHEN {crc} % 7 = 0 THEN {leaf('(CAST(n_chars AS HUGEINT) + 1)')} ELSE {leaf('n_chars')} END AS now FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
groups AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM d)),
leaves AS (SELECT d.*, g.t, g.trees FROM d JOIN groups g ON d.lang IS NOT DISTINCT FROM g.lang),
nodes AS (SELECT t, 0 AS l, i, n, leaf AS h FROM leaves
  UNION ALL SELECT t, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY t, l + 1, i // 2, (n + 1) // 2),
subroots AS (SELECT nodes.t, h, trees FROM nodes JOIN groups USING (t) WHERE n = 1),
upper_nodes AS (SELECT 0 AS l, t AS i, trees AS n, h FROM subroots
  UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY l + 1, i // 2, (n + 1) // 2),
{walk('inner_walk', "SELECT id, t, 0 AS l, i, n, now AS h, '' AS sib FROM leaves", 'nodes', 's.t = w.t')},
{walk('outer_walk', "SELECT w.id, w.t, 0 AS l, w.t AS i, g.trees AS n, w.h, w.sib FROM inner_walk w JOIN groups g USING (t) WHERE w.n = 1", 'upper_nodes', 'true')}
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(w.sib) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM leaves d JOIN subroots s USING (t) JOIN outer_walk w ON w.id = d.id AND w.n = 1 CROSS JOIN (SELECT h FROM upper_nodes WHERE n = 1) r"""
