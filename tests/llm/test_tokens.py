"""Compiled tokenizer, token counts and packing against the library."""

import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stacklore.llm import bpe, packing
from stacklore.llm.packing import best_fit_packing, plan
from stacklore.llm.token_counts import token_counts

PARTS = [" ", "\n", "\t", "'", "s", "t", "r", "e", "v", "l", "d", "m", "a", "B", "1", "!", "é", "中", " ", "\u0085", "😀", "'re", "'ll", "<|endoftext|>", "½", "\x1c", "٣"]


def ids(found: bytes) -> list[int]:
    return np.frombuffer(found, "<u4").tolist()


def test_encoding_equals_the_library(vocabulary):
    rng, library = random.Random(3), Tokenizer.from_file(vocabulary)
    texts = ["".join(rng.choices(PARTS, k=rng.choice([0, 1, 2, 5, 40, 900]))) for _ in range(1500)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids(x) for x in bpe.encode(texts, vocabulary)] == expected
    assert bpe.count_tokens(texts, vocabulary).tolist() == [len(x) for x in expected]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(vocabulary, texts):
    library = Tokenizer.from_file(vocabulary)
    assert [ids(x) for x in bpe.encode(texts, vocabulary)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_scan_composes_maps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, bpe.STATES, (37, bpe.STATES)).astype(np.uint8)
    state, out = np.arange(bpe.STATES), []
    for m in maps:
        state = m[state]
        out.append(state)
    assert (bpe.compose(maps) == np.array(out)).all()


def test_equal_first_hash_does_not_merge():
    points = np.array([*map(ord, "abab")], np.uint32)
    first, at = bpe.Pretokens._grouped(points, np.array([0, 2]), np.array([2, 4]))
    assert len(first) == 1 and at.tolist() == [0, 0]


def test_counts_on_tables(vocabulary, documents, awkward, empty):
    library = Tokenizer.from_file(vocabulary)
    rows = [*documents.collect(), *awkward.collect()]
    expected = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows)
    got = [*token_counts(documents, vocabulary).collect(), *token_counts(awkward, vocabulary).collect()]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts(empty, vocabulary).count() == 0


def simple_best_fit(lengths: list[int], size: int) -> int:
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(size - n)
    return len(free)


def test_plan_is_best_fit():
    rng = random.Random(2)
    for size, n in ((10, 40), (64, 300), (1024, 500), (7, 1), (16, 200)):
        lengths = [rng.randint(1, size) for _ in range(n)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        rows = plan(counts, size)
        used, ranks = {}, {}
        for length, a, b, first, per, offset in rows:
            for r in range(a, b):
                ranks.setdefault(length, []).append(r)
                used.setdefault(first + (r - a) // per, []).append((offset + (r - a) % per * length, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: [*range(v)] for k, v in counts.items()}
        assert len(used) == simple_best_fit(lengths, size)
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size


def test_packing_round_trip(vocabulary, documents, awkward, empty):
    library = Tokenizer.from_file(vocabulary)
    for docs in (documents, awkward):
        rows = best_fit_packing(docs, vocabulary, ids=True).collect()
        assert all(len(r["ids"]) == r["length"] <= 1024 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
        expected = sorted([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect() if r["doc_id"] not in (None, 5))
        by_doc = {}
        for r in sorted((r for r in rows if r["doc_id"] not in (None, 5)), key=lambda r: (r["doc_id"], r["piece"])):
            assert r["start"] == len(by_doc.setdefault(r["doc_id"], [])) and (r["piece"] == 0 or r["length"] == 1024)
            by_doc[r["doc_id"]] += r["ids"]
        assert sorted(by_doc.values()) == expected
        places = {}
        for r in rows:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(places) == simple_best_fit([r["length"] for r in rows], 1024)
        for p in places.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:], strict=False)) and min(p)[0] == 0
    assert best_fit_packing(empty, vocabulary).count() == 0


def test_transitions_sum_to_the_count_whatever_is_kept(vocabulary):
    rng, library = random.Random(8), Tokenizer.from_file(vocabulary)
    words = [" " * rng.randint(0, 1) + "".join(rng.choices("abcdehinorstuABé中-", k=rng.randint(1, 14))) for _ in range(800)] + ["x" * 3000, "ab" * 900, "-" * 700]
    expected = [len(library.encode(w, add_special_tokens=False).ids) for w in words if len(bpe.Pretokens([w], {}).words) == 1]
    words = [w for w in words if len(bpe.Pretokens([w], {}).words) == 1]
    for most in (1, 50, 300_000):
        machine = bpe.Counter(vocabulary, most)
        for _ in range(2):
            assert [machine.count(w) for w in words] == expected
        assert len(machine.last) <= most


def test_seams_equal_the_library(vocabulary):
    """Two letters-only tokens can stand side by side if the library leaves them so."""
    rng, library, rules = random.Random(9), Tokenizer.from_file(vocabulary), bpe.Vocabulary(vocabulary)
    tokens = [x for x in rules.rank if x.isalpha() and x.isascii()]
    for a, b in ((rng.choice(tokens), rng.choice(tokens)) for _ in range(4000)):
        if rules.whole(rules.rank[a]) and rules.whole(rules.rank[b]):
            ids = library.encode((a + b).decode(), add_special_tokens=False).ids
            assert rules.seam(rules.rank[a], rules.rank[b], float("inf")) == (ids == [rules.ids[a], rules.ids[b]])


def test_a_third_without_ids_is_spread_over_blocks(spark, vocabulary, monkeypatch):
    docs = spark.createDataFrame([(None if i % 3 == 0 else i % 4, "same text") for i in range(900)], "doc_id long, text string").repartition(6)
    blocks = []
    plain = packing.Scratch.save
    monkeypatch.setattr(packing.Scratch, "save", lambda self, df, name, *f: (blocks.append(df.count()) if name == "ranks" else None) or plain(self, df, name, *f))
    rows = packing.best_fit_packing(docs, vocabulary).collect()
    assert len(rows) == 900 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 900
    assert blocks[0] > 15  # of about thirty


def test_long_pretokens_by_chunks(vocabulary):
    """Pretokens of many chunks, also such as never meet the state of the chunk before, against the library."""
    library, rng = Tokenizer.from_file(vocabulary), random.Random(11)
    words = [x for x in library.get_vocab() if x.isalpha() and x.isascii()]
    texts = ["a" * n for n in (255, 256, 257, 511, 512, 513, 20_000)] + ["ab" * 3_000, "abc" * 2_000, "=" * 5_001, "z" * 300 + "a" * 9_000 + "b" * 300]
    texts += ["".join(rng.choices(letters, k=rng.randrange(2_000, 9_000))) for letters in ("ab", "aeinrst", "0123456789", "=-_", "ёжзик", "漢字仮名交") for _ in range(4)]
    texts += ["".join(rng.choices(words, k=2_000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(9_000))]
    texts += [x + " " + y for x, y in zip(texts, reversed(texts), strict=True)]
    again, machine = [], bpe.counter(vocabulary)
    plain = bpe.Lanes._again
    bpe.Lanes._again = lambda self, chunk: again.append(chunk) or plain(self, chunk)
    try:
        assert bpe.count_tokens(texts, vocabulary).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    finally:
        bpe.Lanes._again = plain
    assert again and max(map(len, texts)) > 20 * machine.chunk


def test_counting_without_spaces_is_fast(vocabulary):
    rng = random.Random(5)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(100_000))
    bpe.count_tokens(["warm"], vocabulary)
    begin = time.perf_counter()
    bpe.count_tokens([text, "。".join(text[i : i + 30] for i in range(0, len(text), 30)), "a" * 100_000], vocabulary)
    assert time.perf_counter() - begin < 5
