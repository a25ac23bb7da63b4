"""Byte-pair tokenizer compiled to finite-state form.

Two deterministic machines count tokens in place of the library:

* the *splitter* reads code point classes and marks where a pretoken begins. It has 13 states, so the effect of a
  chunk of text is a map of 13 states to 13 states; chunks are run for all entry states at once and their maps are
  composed with a parallel prefix scan, after which the entry state of each chunk is known;
* the *counter* is a transducer over the bytes of a pretoken, compiled once from the merge rules. It follows the longest
  end of the input that begins a token, and the last token of each prefix from which a token can still begin. A
  transition gives the new last token: the longest at the end that can stand beside the last token of what is before
  it. Two tokens can stand side by side unless undoing their merges at the seam, the latest first, meets a merge across
  the seam that would have come first. Transitions carry how many tokens a prefix has. Long pretokens are cut into
  chunks that are run in step; a chunk's map, from where a token ends to where tokens begin before it with their
  number, composes with its neighbours'.

A special string (``added_tokens`` of the file) inside a text is one token, as by the library's default.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache
from struct import pack

import numpy as np
import regex
import tiktoken

#: Code point classes.
END, SPACE, WHITE, LETTER, NUMBER, OTHER, APOSTROPHE, STMD, R, V, L, E = range(12)
#: States of the splitter.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CLOSED = range(13)
STATES, CLASSES, CHUNK = 13, 12, 256
LETTERS = (LETTER, STMD, R, V, L, E)


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables [state, class] of the next state and of the marks: bit 0, a pretoken begins here; bit 1, one began at
    the code point before. They implement contractions, letter, number and other runs with one leading space, and
    white space runs that leave their last code point to what follows."""
    step, mark = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)

    def begin(c: int) -> int:
        kinds = {END: START, SPACE: ONE_SPACE, WHITE: ONE_WHITE, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, APOSTROPHE: AT_QUOTE}
        return kinds.get(c, IN_LETTERS)

    def joined(c: int) -> int:
        return IN_LETTERS if c in LETTERS else IN_NUMBERS if c == NUMBER else IN_OTHER

    for c in range(CLASSES):
        white = c in (SPACE, WHITE)
        for s in range(STATES):
            step[s, c], mark[s, c] = begin(c), 1
        if c in LETTERS:
            step[IN_LETTERS, c], mark[IN_LETTERS, c] = IN_LETTERS, 0
        if c == NUMBER:
            step[IN_NUMBERS, c], mark[IN_NUMBERS, c] = IN_NUMBERS, 0
        if c in (OTHER, APOSTROPHE):
            for s in (IN_OTHER, AT_QUOTE):
                step[s, c], mark[s, c] = IN_OTHER, 0
        if white:
            for s in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
                step[s, c], mark[s, c] = (RUN_SPACE if c == SPACE else RUN_WHITE), 0
        elif c != END:
            step[ONE_SPACE, c], mark[ONE_SPACE, c] = joined(c), 0
            step[RUN_SPACE, c], mark[RUN_SPACE, c] = joined(c), 2
            mark[RUN_WHITE, c] = 3
        follow = {STMD: CLOSED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}
        if c in follow:
            step[AT_QUOTE, c], mark[AT_QUOTE, c] = follow[c], 0
        for s, closing in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
            if c == closing:
                step[s, c], mark[s, c] = CLOSED, 0
            else:
                step[s, c], mark[s, c] = step[IN_LETTERS, c], mark[IN_LETTERS, c] | 2
    return step, mark


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            classes[a : b + 1] = kind
    classes[0xD800:0xE000] = OTHER
    classes[ord(" ")], classes[ord("'")] = SPACE, APOSTROPHE
    for characters, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for x in characters:
            classes[ord(x)] = kind
    return classes


def little(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps [chunk, state]: row n becomes map n after ... after map 0."""
    maps, d = maps.copy(), 1
    while d < len(maps):
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)
        d *= 2
    return maps


def begins(classes: np.ndarray) -> np.ndarray:
    """Whether a pretoken (or an END position) begins at each place of one array of classes."""
    step, mark = (x.reshape(-1) for x in splitter())
    n = -(-len(classes) // CHUNK)
    padded = np.zeros(n * CHUNK, np.uint8)
    padded[: len(classes)] = classes
    columns = np.ascontiguousarray(padded.reshape(n, CHUNK).T)
    lanes = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (n, STATES)).copy()
    live = np.arange(n)  # chunks whose entry states haven't met yet
    one = np.zeros(n, np.uint8)
    for k in range(CHUNK):
        if len(live) < n:
            one = step[one.astype(np.intp) * CLASSES + columns[k]]
        if len(live):
            lanes[live] = step[lanes[live].astype(np.intp) * CLASSES + columns[k][live, None]]
            if k % 8 == 7:
                met = (lanes[live] == lanes[live][:, :1]).all(1)
                one[live[met]] = lanes[live[met], 0]
                live = live[~met]
    settled = np.ones(n, bool)
    settled[live] = False
    lanes[settled] = one[settled, None]
    entry = np.zeros(n, np.uint8)
    entry[1:] = compose(lanes)[:-1, START]
    marks = np.zeros((CHUNK, n), np.uint8)
    for k in range(CHUNK):
        at = entry.astype(np.intp) * CLASSES + columns[k]
        marks[k] = mark[at]
        entry = step[at]
    marks = marks.T.reshape(-1)
    found = (marks & 1).astype(bool)
    found[:-1] |= (marks[1:] & 2).astype(bool)
    return found[: len(classes)]


class Vocabulary:
    """The rules of a byte-level vocabulary file. A token is called by its rank: bytes first, then merges in order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        if model["pre_tokenizer"].get("type") != "ByteLevel" or model.get("normalizer"):
            raise ValueError("only byte-level vocabularies without a normalizer can be compiled")
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        byte = {c: b for b, c in shown.items()}
        unshown = lambda word: bytes(byte[c] for c in word)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        self.rank = {bytes([b]): b for b in range(256)}
        self.left, self.right = [*range(256)], [*range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(pairs):
            a, b = unshown(a), unshown(b)
            self.left.append(self.rank[a])
            self.right.append(self.rank[b])
            self.merged[self.left[-1], self.right[-1]] = 256 + i
            if self.rank.setdefault(a + b, 256 + i) != 256 + i:
                raise ValueError("two merges make the same token")
        self.ids = {unshown(word): i for word, i in model["model"]["vocab"].items() if all(c in byte for c in word)}

    def seam(self, a: int, b: int, limit: float) -> bool:
        """Whether tokens a and b stay apart under all merges before ``limit``. Of equal merges the left one is first."""
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes come out as this one token."""
        return token < 256 or self.whole(self.left[token]) and self.whole(self.right[token]) and self.seam(self.left[token], self.right[token], token)


class Counter:
    """The transducer, compiled once from the rules and run on many chunks of bytes in step.

    goto: [node, byte] the next node of the automaton that follows the longest end of the input which begins a token;
    longest: the longest token at the end of a node; shorter: the next shorter token at the end of a token."""

    #: Bytes of a chunk, and bytes before it that are read to meet the state of the chunk before.
    CHUNK, WARM = 256, 64

    def __init__(self, path: str, most: int = 1 << 20) -> None:
        """Of verdicts on pairs the last one of each of ``most`` slots is kept; others are worked out again, with equal
        results."""
        self.rules = rules = Vocabulary(path)
        edges: dict[int, int] = {}
        depth, ends = [0], [-1]
        for word, token in rules.rank.items():
            if not rules.whole(token):
                continue
            node = 0
            for byte in word:
                child = edges.setdefault(node << 8 | byte, len(depth))
                if child == len(depth):
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                node = child
            ends[node] = token
        self.depth, ends = np.array(depth, np.int32), np.array(ends, np.int32)
        self.reach = int(self.depth.max())
        self.chunk = max(self.CHUNK, 2 * self.reach)
        self._follow(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)), ends)
        self.size = np.zeros(len(rules.left), np.int32)
        self.size[ends[ends >= 0]] = self.depth[ends >= 0]
        self.left, self.right = np.array(rules.left, np.int64), np.array(rules.right, np.int64)
        pairs = sorted((a * len(rules.left) + b, rank) for (a, b), rank in rules.merged.items())
        self.pairs, self.ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.last = np.full(most, -2, np.int64)

    def _follow(self, edges: np.ndarray, children: np.ndarray, ends: np.ndarray) -> None:
        """Completes the trie of tokens to an automaton, level by level."""
        self.goto = np.zeros((len(ends), 256), np.int32)
        fail, self.longest, self.shorter = np.zeros(len(ends), np.int64), ends.copy(), np.full(len(self.rules.left), -1, np.int32)
        parents, bytes_ = edges >> 8, edges & 255
        self.goto[0, bytes_[parents == 0]] = children[parents == 0]
        by_level = np.argsort(self.depth[children], kind="stable")
        bounds = np.searchsorted(self.depth[children][by_level], np.arange(1, self.reach + 2))
        for level in range(self.reach):
            at = by_level[bounds[level] : bounds[level + 1]]
            nodes = children[at]
            if level:
                fail[nodes] = self.goto[fail[parents[at]], bytes_[at]]
            self.goto[nodes] = self.goto[fail[nodes]]
            below = by_level[bounds[level + 1] : bounds[level + 2]] if level + 1 < self.reach else by_level[:0]
            self.goto[parents[below], bytes_[below]] = children[below]
            own = self.longest[fail[nodes]]
            token = ends[nodes]
            self.shorter[token[token >= 0]] = own[token >= 0]
            self.longest[nodes] = np.where(token >= 0, token, own)

    def _seams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Vocabulary.seam`` of many pairs, without a limit."""
        apart, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 60)
        while len(live):
            key = a * len(self.left) + b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            merges = (self.pairs[at] == key) & (self.ranks[at] < limit)
            apart[live[merges]] = False
            on = ~merges & ((a >= 256) | (b >= 256))
            a, b, live = a[on], b[on], live[on]
            undo = a > b
            limit = np.where(undo, a, b + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return apart

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b can stand side by side; both verdict and pair are in one number of a slot."""
        key = a.astype(np.int64) * len(self.left) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(len(self.last))).astype(np.int64)
        kept = self.last[slot]
        out = (kept & 1).astype(bool)
        if len(unseen := np.flatnonzero(kept >> 1 != key)):
            pairs, first, at = np.unique(key[unseen], return_index=True, return_inverse=True)
            apart = self._seams(pairs // len(self.left), pairs % len(self.left))
            self.last[slot[unseen[first]]] = pairs << 1 | apart
            out[unseen] = apart[at]
        return out

    def count(self, pretoken: str) -> int:
        return int(self.counts([pretoken])[0])

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pretoken."""
        words = [x.encode("utf-8", "replace") for x in pretokens]
        if not words:
            return np.zeros(0, np.int64)
        sizes = np.array(list(map(len, words)), np.int64)
        chunks = np.maximum(-(-sizes // self.chunk), 1)
        first = np.cumsum(chunks) - chunks
        run = Lanes(self, np.frombuffer(b"".join(words), np.uint8), sizes, chunks, first)
        counts = run.counts_at_end()[run.lane[first]]
        for i in np.flatnonzero(chunks > 1).tolist():
            run.mend(first[i] + 1, first[i] + chunks[i])
            counts[i] = run.folded(first[i], first[i] + chunks[i])
        return counts


class Lanes:
    """Chunks of pretokens in step. Of each prefix of a chunk it holds the last token, how many tokens begin in the
    chunk, and how far before the chunk the first one that reaches into it begins. A chunk that isn't the first of its
    pretoken starts ``WARM`` bytes early in the first state; ``mend`` holds what it met against the chunk before it."""

    def __init__(self, machine: Counter, data: np.ndarray, sizes: np.ndarray, chunks: np.ndarray, first: np.ndarray) -> None:
        self.machine, self.data = machine, data
        word = np.repeat(np.arange(len(sizes)), chunks)
        number = np.arange(len(word)) - first[word]
        begin = np.maximum(number * machine.chunk - machine.WARM, 0)
        length = np.minimum(sizes[word], (number + 1) * machine.chunk) - begin
        order = np.argsort(-length, kind="stable")
        self.lane = np.empty(len(order), np.int64)  # of each chunk its place among the longest first
        self.lane[order] = np.arange(len(order))
        self.length, self.base = length[order], (np.cumsum(sizes)[word] - sizes[word] + begin)[order]
        self.core = (number * machine.chunk - begin)[order]
        active = np.searchsorted(-self.length, -np.arange(max(int(self.length[0]), 1)), "left")
        self.off = np.cumsum(active) - active
        total = int(active.sum())
        self.last, self.count, self.origin = (np.zeros(total, np.int32) for _ in range(3))
        self.node, self.at_core = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        for k, n in enumerate(active.tolist()):
            self._step(k, n)

    def _step(self, k: int, n: int) -> None:
        """All chunks longer than k read one byte."""
        m, every, at = self.machine, np.arange(n), self.off[k]
        node = m.goto[self.node[:n], self.data[self.base[:n] + k]]
        token = m.longest[node]
        start = k + 1 - m.size[token]
        open_ = np.flatnonzero(start > 0)
        while len(open_):
            before = self.last[self.off[start[open_] - 1] + open_]
            open_ = open_[~m._apart(before, token[open_])]
            token[open_] = m.shorter[token[open_]]
            if (token[open_] < 0).any():
                raise AssertionError("every byte is a token")
            start[open_] = k + 1 - m.size[token[open_]]
        inside = start > self.core[:n]
        place = self.off[np.maximum(start - 1, 0)] + every
        self.last[at : at + n] = token
        self.origin[at : at + n] = np.where(inside, self.origin[place], self.core[:n] - start)
        self.count[at : at + n] = np.where(inside, self.count[place] + 1, 1)
        self.node[:n] = node
        if k + 1 == m.WARM:
            self.at_core[:n] = node

    def counts_at_end(self) -> np.ndarray:
        filled = self.length > 0
        at = self.off[np.maximum(self.length - 1, 0)] + np.arange(len(self.length))
        return np.where(filled, self.count[np.where(filled, at, 0)], 0).astype(np.int64) if len(self.count) else np.zeros(len(self.length), np.int64)

    def _met(self, chunks: np.ndarray) -> np.ndarray:
        """Whether each of these chunks was, where it begins, in the state in which the chunk before it ended: the same
        node, and the same last tokens of all prefixes from which a token can still begin."""
        m, here, before = self.machine, self.lane[chunks], self.lane[chunks - 1]
        depth = m.depth[self.node[before]]
        met = (self.node[before] == self.at_core[here]) & (depth < m.WARM)
        for j in range(int(depth[met].max(initial=-1)) + 1):
            mine, its = self.last[self.off[m.WARM - j - 1] + here], self.last[self.off[self.length[before] - j - 1] + before]
            met &= (j > depth) | (mine == its)
        return met

    def mend(self, a: int, b: int) -> None:
        """Runs those chunks of a to b again, one after the other, that didn't meet the state of the one before."""
        chunks = np.arange(a, b)
        settled = a
        for i in chunks[~self._met(chunks)].tolist():
            while settled <= i < b:
                self._again(i)
                i += 1
                settled = i
                if i < b and self._met(np.array([i]))[0]:
                    settled = i + 1

    def _again(self, chunk: int) -> None:
        """One chunk, from the state in which the one before ended."""
        m, here, before = self.machine, self.lane[chunk], self.lane[chunk - 1]
        goto, size, longest, shorter = (memoryview(x.reshape(-1)) for x in (m.goto, m.size, m.longest, m.shorter))
        core, length, back = int(self.core[here]), int(self.length[here]), m.reach
        lasts = self.last[self.off[self.length[before] - back + np.arange(-1, back)] + before].tolist()
        node, apart, counts, origins = int(self.node[before]), {}, [], []
        for end, byte in enumerate(self.data[self.base[here] + core : self.base[here] + length].tolist(), 1):
            node = goto[node << 8 | byte]
            token = longest[node]
            while True:
                pair = lasts[back + end - size[token]], token
                ok = apart.get(pair)
                if ok is None:
                    ok = apart[pair] = m.rules.seam(*pair, math.inf)
                if ok:
                    break
                token = shorter[token]
            lasts.append(token)
            start = end - size[token]
            counts.append(counts[start - 1] + 1 if start > 0 else 1)
            origins.append(origins[start - 1] if start > 0 else -start)
        at = self.off[core:length] + here
        self.last[at], self.count[at], self.origin[at], self.node[here] = lasts[back + 1 :], counts, origins, node

    def folded(self, a: int, b: int) -> int:
        """The tokens of a pretoken of chunks a to b. The map of a chunk gives, for each place at its end where a token may
        end, where before the chunk the tokens up to there begin, and their number. Neighbouring maps are composed, in
        parallel, until one is left."""
        lanes, offsets = self.lane[np.arange(a, b)], np.arange(self.machine.reach)
        place = self.length[lanes, None] - offsets
        inside = place > self.core[lanes, None]
        at = self.off[np.maximum(place, 1) - 1] + lanes[:, None]
        to = np.where(inside, self.origin[at], self.core[lanes, None] - place)
        counts = np.where(inside, self.count[at], 0)
        while len(to) > 1:
            even = len(to) // 2 * 2
            early, late = to[0:even:2], to[1:even:2]
            more = counts[1:even:2] + np.take_along_axis(counts[0:even:2], late, 1)
            to, counts = np.concatenate((np.take_along_axis(early, late, 1), to[even:])), np.concatenate((more, counts[even:]))
        return int(counts[0, 0])


class Emitter:
    """Ids of pretokens by the library's rules. Those of at most ``paths`` pretokens are kept."""

    def __init__(self, vocabulary: str, paths: int = 100_000) -> None:
        rules = Vocabulary(vocabulary)
        self.special, self.paths, self.most = rules.special, {}, paths
        self.library = tiktoken.Encoding("rules", pat_str=r"[\s\S]+", mergeable_ranks=rules.rank, special_tokens={})
        self.ids_of = None if all(rules.ids[x] == t for x, t in rules.rank.items()) else {t: rules.ids[x] for x, t in rules.rank.items()}

    def ids(self, pretoken: str) -> list[int]:
        found = self.library.encode_ordinary(pretoken)
        return found if self.ids_of is None else [self.ids_of[t] for t in found]

    def emitted(self, pretokens: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each of these distinct pretokens."""
        out = list(map(self.paths.get, pretokens))
        if None in out:
            unseen = [i for i, x in enumerate(out) if x is None]
            for i in unseen:
                out[i] = little(self.ids(pretokens[i]))
            if (room := self.most - len(self.paths)) > 0:
                self.paths.update((pretokens[i], out[i]) for i in unseen[:room] if len(pretokens[i]) <= 64)
        return out


@lru_cache(2)
def emitter(vocabulary: str) -> Emitter:
    return Emitter(vocabulary)


@lru_cache(2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (base, pow(base, -1, 1 << 64)))


class Pretokens:
    """The distinct pretokens of some texts, and which of them stands at each place.

    words: distinct pretokens; at: for each place in order the index of its word; bounds: the first place of each text
    and one more at the end; special: for each place a special id or -1."""

    def __init__(self, texts: list[str], special: dict[str, int]) -> None:
        if not texts:
            self.words, self.at, self.bounds, self.special = [], np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
            return
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = code_point_classes()[points]
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        classes[ends] = END
        chosen = []
        if any(x in joined for x in special):
            pattern = "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))
            chosen = [(m.start(), m.end(), special[m[0]]) for m in regex.finditer(pattern, joined)]
        for a, b, _ in chosen:
            classes[a:b] = END
        flags = begins(classes)
        flags[ends] = False
        for a, b, _ in chosen:
            flags[a], flags[a + 1 : b] = True, False
        starts = np.flatnonzero(flags)
        stops = np.append(starts[1:], len(joined))[: len(starts)]
        self.bounds = np.searchsorted(starts, np.append(0, ends + 1))
        filled = np.diff(self.bounds) > 0
        stops[self.bounds[1:][filled] - 1] = ends[filled]
        self.special = np.full(len(starts), -1, np.int64)
        for a, _, i in chosen:
            self.special[np.searchsorted(starts, a)] = i
        first, self.at = self._grouped(points, starts, stops)
        self.words = [joined[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]

    @staticmethod
    def _grouped(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups equal pretokens by two independent 64-bit hashes and the length. Members that agree with their group
        in the first hash alone get a group each."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        forward, back = _powers(1 << max(16, int(len(points)).bit_length()))
        keys = []
        with np.errstate(over="ignore"):
            lengths = (stops - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            mixed = points.astype(np.uint64)
            for odd in (0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB):
                mixed += np.uint64(0x632BE59BD9B4E019)
                mixed *= np.uint64(odd)
                mixed ^= mixed >> np.uint64(32)
                terms = mixed * forward[: len(points)]
                total = np.zeros(len(points) + 1, np.uint64)
                np.cumsum(terms, out=total[1:])
                keys.append((total[stops] - total[starts]) * back[starts] ^ lengths)
        _, first, at = np.unique(keys[0], return_index=True, return_inverse=True)
        if len(odd := np.flatnonzero(keys[1] != keys[1][first[at]])):
            at[odd], first = np.arange(len(first), len(first) + len(odd)), np.append(first, odd)
        return first, at


def count_tokens(texts: list[str], vocabulary: str) -> np.ndarray:
    """Tokens of each text: running sums over all pretokens, taken apart where texts end."""
    machine = counter(vocabulary)
    found = Pretokens(texts, machine.rules.special)
    counts = machine.counts(found.words)[found.at]
    counts[found.special >= 0] = 1
    total = np.append(0, np.cumsum(counts))
    return total[found.bounds[1:]] - total[found.bounds[:-1]]


def encode(texts: list[str], vocabulary: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text."""
    machine = emitter(vocabulary)
    found = Pretokens(texts, machine.special)
    out = np.array([*machine.emitted(found.words), b""], object)[found.at]
    for i in np.flatnonzero(found.special >= 0):
        out[i] = little([int(found.special[i])])
    return [b"".join(out[a:b]) for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)]
