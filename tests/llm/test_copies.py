"""Near duplicates and benchmark copies against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from stacklore.llm import decontamination
from stacklore.llm import jaccard_join as J
from stacklore.llm import shingles as S
from stacklore.llm.components import components
from stacklore.llm.common import Scratch
from stacklore.llm.decontamination import Items, contaminated, smith_waterman


def grams(text: str) -> set:
    w = text.replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(rng: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def family():
    rng = random.Random(9)
    rows, n = [], 0
    for size, edits in ((300, 3), (2, 2), (3, 1), (40, 5)):
        base = [f"b{rng.randrange(10**6)}" for _ in range(160)]
        for _ in range(size):
            rows.append((n, " ".join(near(rng, base, rng.randint(0, edits)))))
            n += 1
    rows += [(n + i, " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randint(1, 80)))) for i in range(150)]
    rows += [(n + 200 + i, "the same copy of one text " * 3) for i in range(30)] + [(n + 300, "one two"), (n + 301, "one two"), (n + 302, "one  two")]
    return rows


def brute(rows):
    first, sets = {}, {}
    for i, t in rows:
        first.setdefault(t, i)
    sets = {i: grams(t) for t, i in first.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = dict.fromkeys(sets, 0)
    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 10 * len(x & y) >= 8 * len(x | y):
            n[a] += 1
            n[b] += 1
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (find(first[t]), n[first[t]]) for i, t in rows}


def test_join_equals_brute_force(spark, family):
    docs = spark.createDataFrame(family, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(docs).collect()}
    assert got == brute(family)


def test_join_on_odd_rows(spark, awkward, empty):
    rows = J.jaccard_join(awkward).collect()
    assert len(rows) == 11
    same = [r for r in rows if r["n_copies"] == 4]
    assert len(same) == 4 and {r["class_id"] for r in same} == {5}
    assert [r["class_id"] for r in rows if r["doc_id"] == 1] == [1]
    assert J.jaccard_join(empty).count() == 0


def test_depth_reaches_the_recall():
    r = J.least_depth(0.8, 16, 0.999)
    assert 1 - (1 - 0.8**r) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (r + 1)) ** 16


def test_shingles_and_signatures():
    rng = random.Random(3)
    texts = ["", "a", "a b\tc d", "ü ß a b c d e f", " ".join(str(rng.randrange(30)) for _ in range(20_000))] + [" ".join(str(rng.randrange(6)) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    sets = S.shingles(texts)
    assert [len(x) for x in sets] == [len(grams(t.replace("\t", " "))) for t in texts]
    for a, b in combinations(range(0, len(texts), 9), 2):
        assert len(np.intersect1d(sets[a], sets[b])) == len(grams(texts[a].replace("\t", " ")) & grams(texts[b].replace("\t", " ")))
    together, apart = S.signatures(sets, 96), np.concatenate([S.signatures([x], 96) for x in sets])
    assert (together == apart).all()


def test_signatures_estimate_similarity():
    one = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 3000).astype(np.uint64))
    other = np.unique(np.concatenate((one[600:], np.random.default_rng(2).integers(0, 1 << 62, 600).astype(np.uint64))))
    x, y = S.signatures([one, other], 2000)
    true = len(np.intersect1d(one, other)) / len(np.union1d(one, other))
    assert abs((x == y).mean() - true) < 0.05


@pytest.mark.parametrize("n", [3, 40])
def test_similar_pairs(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 40, 50).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(50) < 0.1, rng.integers(0, 1 << 40, 50).astype(np.uint64), base)) for _ in range(n)]
    found = S.similar_pairs(sets, 0.8)
    for a, b in combinations(range(n), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        assert found[a, b] == (10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common))


@pytest.mark.parametrize("n", [5, 30])
def test_sets_apart_from_a_base_give_the_same_pairs(n):
    rng = np.random.default_rng(n)
    base = np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 40, rng.integers(0, 6)).astype(np.uint64)))) for _ in range(n)] + [base, base[:3]]
    cut = [S.apart(x, base) for x in sets]
    got = S.similar_pairs([x for x, _ in cut], 0.8, np.array([len(x) for x in sets]), np.array([k for _, k in cut]), len(base))
    assert (got == S.similar_pairs(sets, 0.8)).all() and got.any()


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    for a in nodes:
        for b in nodes:
            assert (got[a] == got[b]) == (find(a) == find(b))


def plain_alignment(item, passage):
    best, h = 0, np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_equals_the_plain_matrix():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 15))
        assert smith_waterman(a, b)[0] == plain_alignment(a, b)
    score, first, last = smith_waterman(np.array([1, 2, 3, 4]), np.array([9, 9, 1, 2, 8, 3, 4, 9]))
    assert (score, first, last) == (7, 2, 7)


def test_copies_are_found_and_clean_rows_left(spark, awkward, empty):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(40))) for i in range(20)] + [(90, "too short"), (91, None)]
    rows = []
    for i in range(20):
        words = items[i][1].split()
        edited = [w if k % 7 else "changed" for k, w in enumerate(words)]
        rows += [(i, f"{word()} {items[i][1].upper()}! {word()}"), (100 + i, " ".join([word() for _ in range(60)] + edited + [word() for _ in range(60)])), (200 + i, " ".join(word() for _ in range(150)))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert got == {(i, i) for i in range(20)} | {(100 + i, i) for i in range(20)}
    assert contaminated(awkward, bench).count() == 0 and contaminated(empty, bench).count() == 0
    assert contaminated(docs, bench.where("false")).count() == 0


def test_common_passages_keep_seeds():
    items = Items([(1, "a b c d e f g h i j k l m n o p"), (2, "q r s t u v w x y z")])
    items.choose({i: 10**6 * (1 + i % 3) for i in range(100)}, 10)
    assert items.rare.all()
    items.choose({i: 10**3 if i < 8 else 10**6 for i in range(100)}, 10)
    assert 8 <= items.rare.sum() < len(items.rare)


def test_an_edited_copy_in_a_third_of_the_rows_is_found(spark):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(28)]
    version = [*item[:9], "x", *item[10:20], "y", *item[21:]]  # eight of 25 seeds are gone
    plain = lambda: [f"p{rng.randrange(10**6)}" for _ in range(20)]
    rows = [(i, " ".join([*plain(), *(version if i % 3 == 0 else item[:4] if i % 3 == 1 else []), *plain()])) for i in range(1200)]
    docs = spark.createDataFrame([(-1, " ".join(item)), *rows], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r["doc_id"] for r in contaminated(docs, bench).collect()) == [-1, *range(0, 1200, 3)]


def best_shares(item: list[str], docs: list[list[str]]) -> list[float]:
    """Best local alignment of an item with each document, as a share of the item's own score: plain recurrence over all
    documents side by side, apart by more unknown words than an alignment could cross."""
    apart = [None] * (2 * len(item) + 2)
    flat, begins = [], []
    for d in docs:
        begins.append(len(flat))
        flat += [*d, *apart]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for w in flat if w))}
    place = np.array([number.get(w, -1) for w in flat])
    top, row = np.zeros(len(flat) + 1, int), np.zeros(len(flat) + 1, int)
    for w in item:
        now = np.zeros(len(flat) + 1, int)
        now[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(place == number.get(w, -2), 2, -1), row[1:] - 1))
        slope = np.arange(len(now))  # gaps along the row
        row = now = np.maximum.accumulate(now + slope) - slope
        top = np.maximum(top, now)
    return [int(top[a + 1 : a + 1 + len(d)].max(initial=0)) / (2 * len(item)) for a, d in zip(begins, docs, strict=True)]


def test_recall_against_alignment_of_all_pairs(spark, smallest, documents):
    bench = spark.read.parquet(f"{smallest}/benchmark.parquet")
    words = lambda x: decontamination.WORD.findall((x or "").lower())
    rng, items = random.Random(21), bench.collect()
    edited = []
    for k, item in enumerate(items):
        own = (item["text"] or "").split()
        for n, share in enumerate((0.1, 0.2, 0.3, 0.4)):  # of the words replaced, dropped or doubled
            change = lambda w: rng.choice(([f"e{rng.randrange(10**6)}"], [], [w, w]))
            body = [x for w in own for x in (change(w) if rng.random() < share else [w])]
            around = rng.choice(items)["text"].split()[:6]
            edited.append((1_000_000 + 10 * k + n, " ".join([*around, *body, *around])))
    more = documents.select("doc_id", "text").unionByName(spark.createDataFrame(edited, "doc_id long, text string"))
    rows = [(r["doc_id"], words(r["text"])) for r in more.collect()]
    expected = set()
    for item in items:
        own = words(item["text"])
        if own:
            need = decontamination.SHARE if len(own) >= decontamination.MIN_WORDS else 1.0
            expected |= {(rows[i][0], item["item_id"]) for i, share in enumerate(best_shares(own, [w for _, w in rows])) if share >= need}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(more, bench).collect()}
    assert got <= expected and len(expected) > 2 * len(items) and len(got) >= 0.9 * len(expected)
    print("recall", len(got) / len(expected), "of", len(expected))


def test_items_that_share_a_phrase_are_proposed_by_their_rarest_words(monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    phrase = "which of the following is"
    items = Items([(i, " ".join([phrase, *(word() for _ in range(rng.choice((1, 4, 12, 30))))])) for i in range(3000)])
    own = [x for x, _ in zip(items.words, range(40), strict=False)]
    plain = " ".join([*(word() for _ in range(150)), phrase, *(word() for _ in range(150))])
    names = {int(n): w for w, n in zip(["which", "of", "the", "following", "is"], items.numbers(decontamination.hashed([phrase])[0]), strict=True)}
    names |= {int(n): f"w{i}" for i, n in enumerate(items.numbers(decontamination.hashed([" ".join(f"w{i}" for i in range(3000))])[0]))}
    copies = [" ".join([plain, *(names[int(x)] for k, x in enumerate(w) if k % 6 != 5), plain]) for w in own]
    texts = decontamination.hashed([plain, *copies, phrase, ""])
    results, looked = [], []
    enough = Items.enough
    monkeypatch.setattr(Items, "enough", lambda self, owners, present: looked.append(len(owners)) or enough(self, owners, present))
    for most in (32, 0, 10**9):  # the last lists every item of every seed
        monkeypatch.setattr(decontamination, "SEED_ITEMS", most)
        looked.clear()
        items.align(texts[0])
        results.append(([items.align(x) for x in texts], max(looked)))
    assert results[0][0] == results[1][0] == results[2][0] and sum(map(len, results[0][0])) >= 20
    assert max(results[0][1], results[1][1]) < 1500 and results[2][1] == 3000


def test_short_items_are_met_whole(spark):
    bench = spark.createDataFrame([(1, "Qua dri"), (2, "lonely"), (3, "a b c"), (4, "a b c d e"), (5, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x qua, dri y"), (2, "qua z dri"), (3, "so lonely!"), (4, "a b x c"), (5, "z a b c d e"), (6, "a b c x"), (7, "lonely lonely"), (7, "lonely lonely"), (None, "Qua dri")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in contaminated(docs, bench).collect())
    assert got == [("1", 1), ("3", 2), ("5", 3), ("5", 4), ("6", 3), ("7", 2), ("7", 2), ("None", 1)]


def test_blocks_and_passes_give_the_same(spark, monkeypatch):
    rng = random.Random(15)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice((2, 8, 20, 40))))) for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(30)) + " " + items[i % 30][1] + f" w{i}") for i in range(90)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, contaminated(docs, bench).collect()))
    for seeds in (100, 10):
        monkeypatch.setattr(decontamination, "BLOCK_SEEDS", 60)
        monkeypatch.setattr(decontamination, "PASS_SEEDS", seeds)
        assert sorted(map(tuple, contaminated(docs, bench).collect())) == whole
