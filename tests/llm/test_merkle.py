"""The Merkle manifest, against a plain tree in memory."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from thermoband.llm import catalogue, merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_proofs(leaves, fanout=8):
    """The root of a list of leaves, and for each of them its (left, right) steps."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i in range(len(leaves)):
            first = at[i] // fanout * fanout
            run = nodes[first : first + fanout]
            steps[i].append(("".join(run[: at[i] - first]), "".join(run[at[i] - first + 1 :])))
            at[i] //= fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], steps


def fold(node, steps):
    for left, right in steps:
        node = h(left, node, right)
    return node


def plain_manifest(rows, fanout=8):
    """(order, leaf) -> (subroot, root, steps) of rows (group, order, leaf)."""
    groups = {}
    for g, o, x in rows:
        groups.setdefault(g, []).append((o is not None, o, x))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    lists = {g: [x for _, _, x in sorted(groups[g], key=lambda t: (t[0], t[1] or 0, t[2]))] for g in names}
    below = {g: tree_proofs(lists[g], fanout) for g in names}
    root, above = tree_proofs([below[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, above, strict=True):
        for x, steps in zip(lists[g], below[g][1], strict=True):
            out.append((g, x, below[g][0], root, tuple(steps + up)))
    return out


def found(frame):
    return sorted((r.g, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.steps)) for r in frame.collect())


def check(spark, rows, fanout, levels):
    df = spark.createDataFrame(rows, "g string, o bigint, leaf string")
    got = merkle.manifest(df.withColumn("same", F.coalesce("g", F.lit("none"))), "g", "o", "leaf", "same", fanout=fanout, levels=levels)
    got = got.withColumn("g", F.col("same"))
    want = sorted(("none" if g is None else g, *rest) for g, *rest in plain_manifest(rows, fanout))
    assert found(got) == want


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 9, 27), (28, 1, 10), (81, 82, 5, 1, 1, 1, 1)])
def test_trees_of_all_shapes(spark, sizes):
    """Full and short last partitions and blocks, lone leaves, several rounds in both trees."""
    rows = [(f"g{k}" if k else None, i, h(str(k), str(i))) for k, n in enumerate(sizes) for i in range(n)]
    check(spark, rows, 3, 1)


def test_ragged_blocks(spark):
    """Sizes around powers of the fanout, whose last block serves many places."""
    rows = [(f"{n:03}", i, h(str(n), str(i))) for n in (8, 9, 10, 16, 17, 18, 19, 33) for i in range(n)]
    check(spark, rows, 2, 1)


def test_nulls_ties_and_repeats(spark):
    rows = [("b", None, h("x")), ("b", 1, h("y")), ("b", 1, h("z")), ("b", 1, h("y")), (None, None, h("q")), ("é", 5, h("e")), ("z", 5, h("f")), ("", 7, h("g"))]
    check(spark, rows * 4, 2, 2)


def test_empty(spark, no_docs):
    assert merkle.manifest(no_docs.withColumn("leaf", merkle.document_leaf()), "lang", "doc_id", "leaf").count() == 0


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_query(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r, text: h(*map(part, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    rows = {leaf(r, r.text): r for r in docs}
    out = []
    for _, x, subroot, root, steps in plain_manifest([(r.lang, r.doc_id, leaf(r, r.text)) for r in docs]):
        r = rows[x]
        changed = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        end = fold(leaf(r, r.text.translate(lower)) if changed else x, steps)
        out.append((r.doc_id, x, subroot, root, h("".join(a + b for a, b in steps)), end, end == root))
    return out


def as_rows(frame):
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return sorted((tuple(r[c] for c in names) for r in frame.collect()), key=str)


def test_query_against_plain(spark, sf_dir, documents):
    got = as_rows(catalogue.op12_merkle_manifest(spark, sf_dir))
    assert got == sorted(plain_query(documents.collect()), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_query_on_odd_documents(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert as_rows(catalogue.op12_merkle_manifest(spark, str(tmp_path))) == sorted(plain_query(odd_docs.collect()), key=str)
