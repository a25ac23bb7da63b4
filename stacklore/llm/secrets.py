"""Secret scans: known shapes, and strings which a tokenizer can only spell in short pieces."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, slices, text_or_empty, texts_of

# The shapes of the base spans.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 6, 20

#: A candidate of the token-efficiency test is an unbroken run of this many characters from this alphabet.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Left alone: whole digests of known lengths as they are mostly written, universally unique ids, dates and numbers.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+)"
)
#: Bytes of a digest by its name; other names may have any of them.
DIGESTS = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}
#: A digest named as such, also in upper case or base64: the name, marks, the value.
NAMED = re.compile(
    r"""(?<![A-Za-z])(?:(?i:(md5|sha-?(?:1|224|256|384|512))(?:sum)?|digest|checksum|fingerprint|etag|integrity|hash))"""
    r"""["')]{0,2}\x20?[-:=(\x20]{1,2}["'(]?((?!(?i:md5|sha-?[1-5]))[A-Za-z0-9+/_-]{20,128}+={0,2}+)(?![A-Za-z0-9+/_=-])"""
)
#: Characters before a candidate in which the name of a digest begins.
BEFORE = 24
#: Digests of the empty text are known by heart.
EMPTY = frozenset(
    x
    for name in DIGESTS
    for raw in [hashlib.new(name, b"", usedforsecurity=False)]
    for x in (raw.hexdigest().upper(), base64.b64encode(raw.digest()).decode())
)
#: A run with fewer different characters than this is a pattern or a sequence over a few symbols, such as one of bases.
FEW = 7
ALPHABET, KEYS = "0123456789abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm"
NEXT = frozenset(x for row in (ALPHABET, ALPHABET[::-1], KEYS, KEYS[::-1]) for x in zip(row, row[1:], strict=False))
#: Speakable words, of any language in these letters: each in one case after its first letter, no long run of
#: consonants or vowels, and vowels for a third of all letters or more.
CASED, CLUSTER = re.compile(r"[A-Za-z][a-z]+(?:[A-Z][a-z]+)*"), re.compile(r"[bcdfghj-np-tvwxz]{4,}|[aeiouy]{4,}", re.I)
VOWEL, VOWELS = re.compile("[aeiouy]", re.I), 0.35
#: A run of words joined by MARKS: short ones say nothing, so those of LONG_WORD characters have to reach the length of a
#: candidate. Each part is judged by itself, so that the work is linear in the run.
MARKS, WORD = re.compile(r"[+/_=-]+"), re.compile(r"[A-Za-z]*[0-9]{0,4}")
LENGTH, LONG_WORD = 20, 8
#: What a run is joined of: identifiers, names or secrets, and the marks between them.
PART = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![A-Za-z0-9])|[A-Za-z0-9]+")
MAX_CHARS_PER_TOKEN = 2.0


@lru_cache(2)
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def of_words(value: str) -> bool:
    """Whether a run is words, with at most a short number each, joined by marks."""
    parts = [x for x in MARKS.split(value) if x]
    return bool(parts) and parts[0][0].isalpha() and all(map(WORD.fullmatch, parts))


def named_digest(text: str, begin: int, end: int) -> int:
    """Where in a candidate that ends in a value which is called a digest, and has the size of one in hexadecimal or
    base64, that value begins; ``end`` if there is none."""
    for m in NAMED.finditer(text, max(begin - BEFORE, 0), end):
        name, value = (m[1] or "").lower().replace("-", ""), m[2]
        plain = value.rstrip("=")
        sizes = [DIGESTS[name]] if name else DIGESTS.values()
        if m.end() == end and any(len(value) == 2 * n and re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) or len(plain) == -(-8 * n // 6) for n in sizes):
            return m.start(2)
    return end


def ordered(value: str) -> bool:
    """Whether most characters repeat the one before or follow it in the alphabet or on the keyboard."""
    lower = value.lower()
    return 2 * sum(x == y or (x, y) in NEXT for x, y in zip(lower, lower[1:], strict=False)) > len(lower)


def speakable(value: str) -> bool:
    return bool(CASED.fullmatch(value)) and not CLUSTER.search(value) and len(VOWEL.findall(value)) >= VOWELS * len(value)


def random_like(value: str, vocabulary: str, most: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Whether the vocabulary needs a token for every ``most`` characters or fewer. Digests, identifiers, strings
    without letters, sequences over few symbols, alphabets and speakable words are no secrets; of words joined by marks
    the long ones decide."""
    if KNOWN.fullmatch(value) or value in EMPTY or not re.search("[A-Za-z]", value) or len(set(value)) < FEW or ordered(value):
        return False
    parts = [x for x in PART.findall(value) if len(x) >= LONG_WORD] if of_words(value) else [value]
    n = sum(map(len, parts))
    return n >= LENGTH and not all(map(speakable, parts)) and n <= most * sum(len(_encoding(vocabulary).encode_ordinary(x)) for x in parts)


def stretches(scored: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """All maximal scoring stretches of (score, begin, end), in order, each as its begin and end. Linear: a held stretch
    remembers the nearest one before it that starts lower, and what lies between can't be its partner."""
    held: list[tuple[float, float, int, int, int]] = []  # total before, total after, begin, end, nearest lower one
    total = 0.0
    for score, begin, end in scored:
        before, total = total, total + score
        if score <= 0:
            continue
        left = before
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= total:
                held.append((left, total, begin, end, j))
                break
            left, begin = held[j][0], held[j][2]
            del held[j:]
    return [(a, b) for _, _, a, b, _ in held]


def random_parts(run: str, vocabulary: str, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """The run if it is random, else its random stretches of parts: all maximal stretches by tokens over what the ratio
    asks for, so that a name or path joined to a secret doesn't hide it."""
    if KNOWN.fullmatch(run) or run in EMPTY:
        return []
    if random_like(run, vocabulary, most):
        return [(0, len(run))]

    def score(part: str) -> float:
        if KNOWN.fullmatch(part) and not part.isdigit():
            return -float(len(run))
        return most * len(_encoding(vocabulary).encode_ordinary(part)) - len(part)

    found = stretches([(score(m[0]), m.start(), m.end()) for m in PART.finditer(run)])
    return [(a, b) for a, b in found if b - a >= LENGTH and random_like(run[a:b], vocabulary, most)]


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """Start and string of each candidate, without a digest that is called one."""
    for m in CANDIDATE.finditer(text):
        end = named_digest(text, *m.span())
        if end - m.start() >= LENGTH:
            yield m.start(), text[m.start() : end]


def find_secrets(text: str, vocabulary: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) in code points, in order. Matches of one kind don't overlap; kinds may."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(at + a, 3, at + b) for at, run in candidates(text) for a, b in random_parts(run, vocabulary)]
    return sorted(spans)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each union of overlapping spans replaced by one mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row. Null text counts as empty;
    repeated rows, and null and tied ids, stay; an empty table gives no rows; other columns are not read. One narrow map: no keys, so nothing can be skewed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for text in texts_of(batch.column(1)):
                spans = find_secrets(text, vocabulary)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*n, hashlib.sha256(shown([x for x in spans if x[1] < 3]).encode()).hexdigest(), shown(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, vocabulary: str, mark: str = "[secret]") -> DataFrame:
    """The rows with all spans of ``secret_scan`` in ``text`` replaced. Null texts stay null, all columns stay, and
    n_chars follows the new text where the table has it."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = [x and redacted(x, find_secrets(x, vocabulary), mark) for x in batch.column(at).to_pylist()]
            columns = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
            if "n_chars" in batch.schema.names:
                i = batch.schema.names.index("n_chars")
                columns[i] = pa.array([n if x is None else len(x) for x, n in zip(texts, batch.column(i).to_pylist(), strict=True)], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
