"""Repeated byte strings against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest

from stacklore.llm import suffix_dedup as S

KIND = "doc_id long, text string"


def expected(texts, length=200):
    seen: dict[bytes, int] = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((len(b), [(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def check(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), KIND).repartition(5)
    got = {r["doc_id"]: r for r in S.suffix_dedup(docs, **options).collect()}
    assert len(got) == len(texts)
    for i, (n, spans, kept) in enumerate(expected(texts, options.get("length", 200))):
        r = got[i]
        assert (r["n_bytes"], [(x["start"], x["stop"]) for x in r["spans"]]) == (n, spans), i
        assert (bytes(r["kept"]) if r["kept"] is not None else (texts[i] or "").encode()) == kept


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgé", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(13)
    passages = [words(rng, 60) for _ in range(4)]
    texts = []
    for i in range(120):
        t = words(rng, rng.randint(0, 200))
        if i % 3 == 0:
            t += rng.choice(passages) + words(rng, 30)
        if i % 4 == 0 and texts:
            old = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                old[rng.randrange(len(old))] = "edit"
            t = " ".join(old)
        texts.append(t)
    again = words(rng, 50)
    return [*texts, again + "x" + again, "x" * 3000, "ab" * 900, "x" * 150, "", None, "", texts[5], texts[5], "é" * 199, "é" * 100]


def test_equals_all_windows(spark, mixed):
    check(spark, mixed)


@pytest.mark.parametrize("most", [8, 40])
def test_large_groups_are_compared_across_parts(spark, mixed, most):
    rng = random.Random(5)
    hot = words(rng, 70)
    check(spark, [*mixed[:40], *(words(rng, 20) + hot + words(rng, 20) for _ in range(60))], most=most)


def test_other_lengths_and_long_texts(spark, monkeypatch):
    rng = random.Random(2)
    parts = [words(rng, 100) for _ in range(30)]
    check(spark, ["".join(rng.choices(parts, k=6)) for _ in range(12)], length=120)
    monkeypatch.setattr(S, "STRETCH", 1000)
    assert [n for n, _ in S.stretches(b"a" * 2199)] == [0, 1000] and sum(len(d) - 199 for _, d in S.stretches(b"a" * 2199)) == 2000


def test_sort_finds_equal_suffixes():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 400, dtype=np.uint8)
    starts = np.arange(400 - 20)
    rows, part = S.multikey_sort(S._words(data), starts, starts % 3, 20)
    keys = [(int(s) % 3, data[s : s + 20].tobytes()) for s in starts]
    assert sorted(rows.tolist()) == [i for i, k in enumerate(keys) if keys.count(k) > 1]
    assert all((keys[a] == keys[b]) == (p == q) for a, b, p, q in zip(rows, rows[1:], part, part[1:], strict=False))
    sorted_keys = [keys[i] for i in rows]
    assert sorted_keys == sorted(sorted_keys)


def test_odd_rows(spark, awkward, empty):
    got = S.suffix_dedup(awkward)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept", "sha256"] and got.count() == awkward.count()
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[7]["spans"][0]["stop"] == 50_000 and by_id[1]["n_bytes"] == 0 and not by_id[5]["spans"]
    assert S.suffix_dedup(empty).count() == 0


def test_query(spark, smallest, documents):
    rows = {r["doc_id"]: r for r in S.op13_suffix_dedup(spark, smallest).collect()}
    docs = documents.collect()
    assert len(rows) == len(docs)
    for d, (n, spans, kept) in zip(docs, expected([d["text"] for d in docs]), strict=True):
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
