"""Merkle manifest against a direct build of the trees and against its SQL form."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from reqscope.llm import manifest, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels from leaves to root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i: i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, place):
    """(side, digest or None) at each level under the root."""
    out = []
    for level in levels[:-1]:
        k = place ^ 1
        out.append(("left" if place % 2 else "right", level[k] if k < len(level) else None))
        place >>= 1
    return out


def direct(rows):
    """Expected rows for ``(doc_id, source, lang, n_chars, text)``."""
    out, langs = [], sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    levels = {g: tree([leaf(r) for r in own]) for g, own in trees.items()}
    top = tree([levels[g][-1][0] for g in langs])
    for t, g in enumerate(langs):
        for i, r in enumerate(trees[g]):
            way = siblings(levels[g], i) + siblings(top, t)
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            for side, s in way:
                node = h(node) if s is None else h(s, node) if side == "left" else h(node, s)
            out.append((r[0], leaf(r), levels[g][-1][0], top[-1][0], h(*[s for _, s in way if s]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_op11_equals_sql_and_direct_build(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.QUERIES["op11_merkle_manifest"](spark, SF)
    rel = con.execute(queries.ORACLE["op11_merkle_manifest"])
    assert [d[0] for d in rel.description] == df.columns
    have = got(df)
    assert have == sorted(rel.fetchall(), key=repr)
    assert have == direct([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()])


@pytest.mark.parametrize("sizes,bits", [([1], (1, 1)), ([37, 1, 5, 2, 9], (1, 2)), ([37, 1, 5, 2, 9], (0, 1)), ([70, 33, 1] + [k % 4 + 1 for k in range(20)], (2, 1))])
def test_op11_many_blocks_and_rounds(spark, sizes, bits):
    """Blocks of two leaves and cells of two or four blocks: many rounds, tails of every length, many groups."""
    rows = [(100 * g + i, f"s{i % 3}", f"l{g:02}", i, "x" * (i % 5)) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(manifest.document_manifest(df, manifest.ManifestParams(*bits))) == direct(rows)


def test_op11_odd_rows(spark):
    long = "langer täxt 🙂 " * 40_000
    rows = [(1, "a", None, None, None), (None, None, None, None, None), (2, "", "", 0, ""), (2, "", "", 0, ""), (None, "s", "de", 5, "ü"), (-3, "s", "de", 5, long),
            (7, "s", "de", 2**63 - 1, "t"), (7, "s", "de", 3, "t"), (7, "s", "de", 3, "t"), (8, "1:", "é", -1, "2:ab"), (9, None, "zz", 1, "a")]
    rows += [(k, "hot", "en", 1, "same") for k in range(60)] + [(500, "hot", "en", 1, "same")] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "id", "leaf", "part", "at", "tree", "block", "node", "path", "cell", "altered", "mid", "tie", "s", "o"):
        df = df.withColumn(name, F.lit(f"clash {name}"))
    p = manifest.ManifestParams(2, 1)
    assert got(manifest.document_manifest(df, p)) == direct(rows)
    out = manifest.document_manifest(df, p, with_proof=True).collect()
    assert all(h(*r["proof"]) == r["proof_sha256"] and len(r["proof"]) == r["n_siblings"] for r in out)
    assert manifest.document_manifest(df.limit(0), p).count() == 0
    fewer = manifest.document_manifest(df.drop("n_chars", "source", "tie"), p)
    assert got(fewer) == direct([(r[0], None, r[2], None, r[4]) for r in rows])
