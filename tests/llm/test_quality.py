"""Quality rules and the line classifier."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from stacklore.llm import line_crf, quality_rules
from stacklore.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text: str) -> tuple:
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered, seen, again = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_base_statistics(spark, documents, awkward, empty):
    for docs in (documents, awkward):
        rows = quality_rules.quality_rules(docs).collect()
        expected = sorted((str(r["doc_id"]), *statistics(r["text"] or "")) for r in docs.collect())
        assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == expected
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(empty).count() == 0


def test_outliers_go_and_do_not_pull_the_estimate(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(150, 400))), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(f"#$%{x}|||" for x in rng.integers(0, 10**6, 200)), "en", "a") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.quality_rules(docs)
    assert got.where("doc_id < 1000 and not kept").count() == 0
    assert got.where("doc_id >= 1000 and kept").count() == 0


def log_det(x: np.ndarray) -> float:
    return np.linalg.slogdet(np.cov(x.T, bias=True) + np.diag(np.square(quality_rules.FLOORS)))[1]


def test_least_determinants_equal_all_subsets(spark):
    """Groups of 9 to 15 rows, some of them far off, against every subset of h rows."""
    rng, rows, expected = np.random.default_rng(3), [], {}
    for k, n in enumerate((9, 11, 13, 15)):
        x = np.round(rng.normal(0, 0.4, (n, 5)) * 1024)
        x[: k % 4] += 3000
        h = (n + 6) // 2
        best = min((log_det(x[list(c)] / 1024), c) for c in combinations(range(n), h))
        expected[f"g{k}"] = (best[0], x[list(best[1])].mean(0) / 1024)
        rows += [(f"g{k}", *map(int, r)) for r in x]
    points = spark.createDataFrame(rows, "g string, x0 long, x1 long, x2 long, x3 long, x4 long")
    got = {r["g"]: r for r in quality_rules.least_determinants(points, Scratch(spark), 40, 4, 3).collect()}
    for g, (det, mean) in expected.items():
        assert abs(got[g]["det"] - det) < 1e-6 and np.allclose([got[g][f"m{i}"] for i in range(5)], mean)


def test_steps_take_exactly_h_rows_and_never_raise_the_determinant(spark):
    rng = np.random.default_rng(4)
    rows = [("a", *map(int, r)) for r in rng.normal(0, 500, (4001, 5))] + [("b", 1, 2, 3, 4, 5)] * 50 + [("b", *map(int, r)) for r in rng.normal(0, 900, (30, 5))] + [("c", 1, 1, 1, 1, 1)]
    points, scratch = spark.createDataFrame(rows, "g string, x0 long, x1 long, x2 long, x3 long, x4 long"), Scratch(spark)
    old = quality_rules.concentrated(points, quality_rules._by_medians(points), 3, scratch, "a0")
    for k in range(3):
        new = quality_rules.concentrated(points, old, 3, scratch, f"a{k + 1}")
        a, b = ({r["g"]: r for r in x.collect()} for x in (old, new))
        assert [round(b[g]["n"], 6) for g in "abc"] == [2003, 43, 1]
        assert all(b[g]["det"] <= a[g]["det"] + 1e-9 for g in "abc")
        old = new


def test_small_groups_are_judged(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
    rows = [(i, text(), "en", f"s{i % 40}") for i in range(120)] + [(500, " ".join("#$%|||&<>" for _ in range(60)) + " " + text(), "en", "s1"), (501, text(), "de", "alone"), (502, text(), None, None)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[500]["kept"] and got[501]["kept"] and got[502]["kept"] and all(got[i]["kept"] for i in range(120))


def test_cutoff_is_a_chi_square_quantile():
    assert abs(quality_rules.chi_quantile(0.025) - 12.833) < 1e-3 and abs(quality_rules.chi_quantile(0.5) - 4.351) < 1e-3 and abs(quality_rules.chi_tail(50.69) - 1e-9) < 1e-11


def test_estimates_do_not_depend_on_partitions(spark, documents):
    one = quality_rules.quality_rules(documents.repartition(1)).select("doc_id", "distance").collect()
    many = quality_rules.quality_rules(documents.repartition(7, "text")).select("doc_id", "distance").collect()
    assert sorted(one, key=str) == sorted(many, key=str)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    emission, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected, z = line_crf.marginals(emission, moves, sizes)
    at, total_moves = 0, np.zeros((2, 2))
    for k, n in enumerate(sizes):
        weights, marginal, trans = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in np.ndindex(*[2] * n):
            w = np.exp(sum(emission[at + i] * y for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            weights += w
            marginal += w * np.array(path)
            for a, b in zip(path, path[1:], strict=False):
                trans[a, b] += w
        assert np.allclose(good[at : at + n], marginal / weights) and np.isclose(z[k], np.log(weights))
        total_moves += trans / weights
        at += n
    assert np.allclose(expected, total_moves)


def test_fit_is_the_peak_of_the_likelihood():
    """The weighted log-likelihood, by summing over all label paths, falls off in every direction from the fit."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["word", "other", "more"], 6)) + "." for _ in range(30)]
    docs = [("\n".join(rng.choice(texts, 3)), 1) for _ in range(25)] + [("\n".join("#$% 12 ||" if rng.random() < 0.8 else rng.choice(texts) for _ in range(3)), 0) for _ in range(25)]
    made = [line_crf.line_features(t) for t, _ in docs]
    y = np.array([q for _, q in docs])
    model = line_crf.fit([f for f, _ in made], [n for _, n in made], y)
    each = np.where(y == 1, 0.5 / (3 * 25), 0.5 / (3 * 25))

    def likelihood(theta: np.ndarray) -> float:
        weights, moves = theta[: line_crf.WIDTH], theta[line_crf.WIDTH :].reshape(2, 2)
        total = -line_crf.RIDGE / 2 * theta @ theta
        for (f, _), q, w in zip(made, y, each, strict=True):
            e = f @ weights
            path = lambda labels, e=e: sum(e[i] for i, v in enumerate(labels) if v) + sum(moves[a, b] for a, b in zip(labels, labels[1:], strict=False))
            total += w * (path([q] * len(f)) - np.log(sum(np.exp(path(p)) for p in np.ndindex(*[2] * len(f)))))
        return total

    best = np.concatenate((model.weights, model.moves.ravel()))
    top = likelihood(best)
    assert top > likelihood(np.zeros_like(best)) + 0.1
    for _ in range(25):
        step = rng.normal(size=len(best))
        assert likelihood(best + 0.3 * step / np.linalg.norm(step)) < top + 1e-4


def test_bounds_and_blank_texts(spark):
    docs = spark.createDataFrame([(i, "plain words of a text.\nand more of it.") for i in range(40)] + [(i, "## ||| $$$\n%% 77 &&") for i in range(40, 80)] + [(81, "a\n" * 300_000)] + [(7, "## again ||")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(82)], "doc_id long, quality int")
    model = line_crf.fit_quality(docs, labels)
    good, bad, empty, white = model.qualities(["plain words of a text.\nand more of it.", "## ||| $$$\n%% 77 &&", "", " \n "])
    assert good > 0.5 > bad and empty == white < 0.5
    blank = spark.createDataFrame([(i, " ") for i in range(100, 160)], "doc_id long, text string")
    seen = line_crf.fit_quality(docs.unionByName(blank), labels.unionByName(spark.createDataFrame([(i, 1) for i in range(100, 160)], "doc_id long, quality int")))
    assert seen.qualities([""])[0] > 0.8


def test_held_out_accuracy(spark, documents, smallest, awkward, empty):
    labels = spark.read.parquet(f"{smallest}/labels.parquet")
    model = line_crf.fit_quality(documents, labels)
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    rows = line_crf.with_quality(documents, model).join(labels, "doc_id").where(held).select("score", "quality").collect()
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in rows]) >= 0.95
    odd = line_crf.with_quality(awkward, model, "mine").collect()
    assert len(odd) == 11 and all(0 <= r["mine"] <= 1 for r in odd) and odd[0]["score"] == 1.5
    assert line_crf.with_quality(empty, model).count() == 0
    blank = line_crf.fit_quality(documents, labels.where("false"))
    assert blank.qualities(["anything", ""]).tolist() == [0.5, 0.5] or blank.qualities([""]).tolist() == [0.5]
