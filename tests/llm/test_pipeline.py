"""The pipeline stage by stage against its operators, and whole."""

import math
import re
import struct
import zlib

import corpus_pipeline as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stacklore.llm import jaccard_join, line_crf, secrets
from stacklore.llm.decontamination import MIN_WORDS, SHARE, WORD, contaminated

from .test_copies import best_shares, brute
from .test_spans import TIK, base_secrets, plain_stretches
from .test_tokens import simple_best_fit


def test_stages(spark, documents, smallest, tmp_path):
    docs, kept = documents, {}
    for name, f in P.STAGES:
        out = f(spark, docs, smallest)
        out.write.parquet(str(tmp_path / name))
        kept[name] = docs = spark.read.parquet(str(tmp_path / name))
        if name != P.STAGES[-1][0]:
            assert docs.columns == documents.columns
    labels = spark.read.parquet(f"{smallest}/labels.parquet")
    good = kept["quality_classifier"].join(labels, "doc_id")
    assert good.where("quality = 0").count() <= 0.05 * labels.where("quality = 0").count()
    assert good.where("quality = 1").count() >= 0.97 * labels.where("quality = 1").count()
    classes = jaccard_join.jaccard_join(kept["quality_classifier"])
    assert {r[0] for r in kept["ngram_jaccard_join"].select("doc_id").collect()} == {r[0] for r in classes.select("class_id").distinct().collect()}
    bench = spark.read.parquet(f"{smallest}/benchmark.parquet")
    assert contaminated(kept["benchmark_decontamination"], bench).count() == 0
    gone = kept["ngram_jaccard_join"].join(kept["benchmark_decontamination"], "doc_id", "left_anti").select("doc_id")
    assert {r[0] for r in gone.collect()} == {r[0] for r in contaminated(kept["ngram_jaccard_join"], bench).select("doc_id").collect()}
    assert kept["secret_scan"].count() == kept["benchmark_decontamination"].count()
    assert {r[0] for r in kept["best_fit_packing"].select("doc_id").collect()} == {r[0] for r in kept["secret_scan"].select("doc_id").collect()}


def test_odd_rows(spark, awkward, empty, smallest):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", F.col("spans"), "score", "length")
    for _, f in P.STAGES[1:-1]:
        docs = f(spark, docs, smallest)
        assert docs.columns == awkward.columns
    assert [r["doc_id"] for r in docs.where("text like 'same%'").collect()] == [5]
    assert P.STAGES[-1][1](spark, docs, smallest).count() > 0
    for _, f in P.STAGES[1:]:
        assert f(spark, empty, smallest).count() == 0
    assert P.STAGES[0][1](spark, empty, smallest).count() == 0


WORDS = " ".join(f"word{i}" for i in range(120))


def test_one_id_with_two_texts_and_rows_without_ids(spark, smallest):
    near = WORDS.replace("word60", "other")
    rows = [
        (1, "A"), (2, "A"), (2, "B unique"), (3, "C"), (1, "A"), (None, "C"), (None, "D alone"), (None, "D alone"), (None, None), (4, None), (4, None),
        (7, WORDS), (7, near), (None, near + " end"), (5, ""), (6, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in P.distinct_documents(spark, docs, smallest).collect()]
    plain = [(r[0], r[1]) for r in kept if r[1] is None or len(r[1]) < 20]
    assert sorted(map(str, plain)) == sorted(map(str, [(1, "A"), (2, "B unique"), (3, "C"), (None, "D alone"), (None, None), (4, None), (4, None), (5, "")]))
    long = [r for r in kept if r[1] and len(r[1]) > 20]
    assert len(long) == 1 and long[0][0] == 7
    item = spark.read.parquet(f"{smallest}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(1, item), (1, "clean words of the same id"), (None, "before " + item), (None, "clean"), (None, None)], "doc_id long, text string")
    left = [tuple(r) for r in P.clean_documents(spark, docs, smallest).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(1, "clean words of the same id"), (None, "clean"), (None, None)]))


def plain_quality(model, text: str) -> float:
    """Line by line, all label paths summed by their recurrences in plain Python."""
    x, n = line_crf.line_features(text)
    if not len(x):
        s = 1 / (1 + math.exp(model.scale * model.shift))
        return (s + model.blank[1]) / (1 + model.blank[0])
    e = [(0.0, float(v)) for v in x @ model.weights]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, behind = [e[0]], [(0.0, 0.0)]
    for i in range(1, len(e)):
        ahead.append(tuple(e[i][y] + add(*(ahead[-1][z] + model.moves[z][y] for z in (0, 1))) for y in (0, 1)))
    for i in range(len(e) - 2, -1, -1):
        behind.insert(0, tuple(add(*(model.moves[z][y] + e[i + 1][y] + behind[0][y] for y in (0, 1))) for z in (0, 1)))
    total = add(*ahead[-1])
    good = [math.exp(a[1] + b[1] - total) for a, b in zip(ahead, behind, strict=True)]
    raw = sum(g * k for g, k in zip(good, n, strict=True)) / sum(n)
    return 1 / (1 + math.exp(-max(-30, min(30, model.scale * (raw - model.shift)))))


def plain_redaction(text: str) -> str:
    """Base shapes by the plain expressions, and random stretches by their definition."""
    found = []
    for span in base_secrets(text).split(","):
        if span:
            found.append(tuple(map(int, span.split(":")[1:])))
    for run in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if secrets.KNOWN.fullmatch(run[0]):
            continue
        if secrets.random_like(run[0], TIK):
            found.append(run.span())
            continue
        count = lambda x: len(secrets._encoding(TIK).encode_ordinary(x))
        scored = [(-float(len(run[0])) if secrets.KNOWN.fullmatch(m[0]) and not m[0].isdigit() else secrets.MAX_CHARS_PER_TOKEN * count(m[0]) - len(m[0]), m.start(), m.end()) for m in secrets.PART.finditer(run[0])]
        found += [(run.start() + a, run.start() + b) for a, b in plain_stretches(scored) if b - a >= 20 and secrets.random_like(run[0][a:b], TIK)]
    hidden = [False] * len(text)
    for a, b in found:
        hidden[a:b] = [True] * (b - a)
    starts = {a for a, _ in found}
    out = []
    for i, c in enumerate(text):
        if not hidden[i]:
            out.append(c)
        elif i == 0 or not hidden[i - 1] or i in starts and not any(a < i < b for a, b in found):
            out.append("[secret]")
    return "".join(out)


def test_run_equals_the_stages_in_plain_python(spark, documents, smallest, vocabulary):
    """The whole pipeline, each stage by other means on what the one before it left."""
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    model = line_crf.fit_quality(documents, spark.read.parquet(f"{smallest}/labels.parquet"))
    docs = [(i, t) for i, t in docs if plain_quality(model, t or "") >= 0.5]
    classes = brute([(i, t) for i, t in docs if t is not None])
    docs = [(i, t) for i, t in docs if t is None or classes[i][0] == i]
    words = [WORD.findall((t or "").lower()) for _, t in docs]
    bad = set()
    for item in spark.read.parquet(f"{smallest}/benchmark.parquet").collect():
        own = WORD.findall((item["text"] or "").lower())
        need = SHARE if len(own) >= MIN_WORDS else 1.0
        bad |= {docs[k][0] for k, share in enumerate(best_shares(own, words)) if own and share >= need}
    docs = [(i, plain_redaction(t or "")) for i, t in docs if i not in bad]
    library, expected, lengths = Tokenizer.from_file(vocabulary), [], []
    for i, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
            lengths.append(b - a)
    got = P.run(spark, smallest).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    assert len({r["sequence_id"] for r in got}) == simple_best_fit(lengths, 1024)
