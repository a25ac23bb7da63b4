"""Merkle trees and their paths, and fill-in-middle, against plain Python."""

import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stacklore.llm import fill_in_middle as M
from stacklore.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        run = i // 8 * 8
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        i //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 513, 600, 4096])
def test_traversal_gives_all_paths(n):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    got = list(merkle.traverse(leaves, merkle.height(n)))
    assert got == [path(tree, i) for i in range(n)]
    assert merkle.block_root(leaves, merkle.height(n)) == tree[-1][0]


def test_short_block_of_a_higher_tree():
    leaves = [h(str(i)) for i in range(3)]
    assert list(merkle.traverse(leaves, 3))[1] == [(leaves[0], leaves[2]), ("", ""), ("", "")]
    assert merkle.block_root(leaves, 3) == h(h(h(*leaves)))


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def manifest(rows, wrong):
    """doc_id -> what is expected; rows are tuples of doc_id, text, lang, source, n_chars."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    digest = lambda r, text: leaf(r[0], r[3], r[2], r[4], text)
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1])))
        trees.append(levels([digest(r, r[1]) for r in groups[g]]))
    top, out = levels([t[-1][0] for t in trees]), []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = path(trees[k], i) + path(top, k)
            node = digest(r, wrong(r[0], r[1]))
            for a, b in steps:
                node = h(a, node, b)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def wrong(doc_id, text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text) if text is not None else None
    return lowered if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else text


def columns(docs):
    c = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars")]
    return merkle.digest_of(*c, F.col("text"))


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_blocks_of_any_size_give_the_same(spark, documents, block):
    docs = documents.withColumn("lang", F.when(F.col("doc_id") % 50 > 0, F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(F.col("lang"))))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    got = merkle.merkle_manifest(docs, "lang", "doc_id", columns(docs), block=block)
    got = got.withColumn("node", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("proof", F.sha2(merkle.siblings(F.col("path")), 256))
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["node"], True) for r in got.collect()) == sorted(manifest(rows, lambda _, t: t))


def test_manifest_query(spark, smallest, documents):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in documents.collect()]
    got = sorted(tuple(r) for r in merkle.op11_merkle_manifest(spark, smallest).collect())
    assert got == sorted(manifest(rows, wrong)) and {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark, awkward, empty):
    got = merkle.merkle_manifest(awkward, "lang", "doc_id", columns(awkward))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in awkward.collect()]
    key = lambda r: tuple(map(str, r))
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), merkle.folded(F.col("leaf"), F.col("path")), F.lit(True))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(manifest(rows, lambda _, t: t), key=key)
    assert merkle.merkle_manifest(empty, "lang", "doc_id", columns(empty)).count() == 0
    one = merkle.merkle_manifest(awkward.limit(1), "lang", "doc_id", columns(awkward)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


def fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest, n = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    a, b, c, d = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    p, m = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:p], units[p:m], units[m:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, documents, awkward, empty):
    odd = ["<P> a mark", "a\nb\r\n\x00c", "😀😀 x😀", "<", "<P", "S>", "é" * 40, "a" * 500, "1" * 33, "ab " * 8, "ab " * 16]
    for docs in (documents, awkward, spark.createDataFrame([(i + 17 * k, t) for i, t in enumerate(odd) for k in range(12)], "doc_id long, text string")):
        rows = docs.select("doc_id", "text").collect()
        got = M.fill_in_middle(docs)
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        back = got.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r) for r in back), key=key) == sorted(((d, *fim(d, t), t or "") for d, t in rows), key=key)
    assert M.fill_in_middle(empty).count() == 0


def test_fill_in_middle_query(spark, smallest, documents):
    got = {r["doc_id"]: r for r in M.op12_fill_in_middle(spark, smallest).collect()}
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
    for r in documents.collect():
        n, form, p, m, output = fim(r["doc_id"], r["text"])
        assert tuple(got[r["doc_id"]])[1:] == (n, form, p, m, h(output), h(r["text"] or ""))
