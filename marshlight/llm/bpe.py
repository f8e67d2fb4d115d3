"""Byte-level BPE over whole Arrow batches: pre-tokens, merges and lexicon lookups as array work inside Spark tasks.

The pieces: ``pre_tokens`` cuts texts as the GPT-2 pattern does, ``Vocabulary.merge`` applies the merge table exactly to
many pre-tokens at once, ``Lexicon`` is a minimal acyclic transducer of frequent pre-tokens with id outputs, and
``Encoder`` puts them together. The tokenizer file is a parameter and is never copied.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from marshlight.llm.common import padded, same_spans, span_hashes

#: Words over so many bytes are merged anew each time.
KEPT_BYTES = 64
_NONE = np.int64(1 << 40)
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: The code points with Unicode's White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions of the pattern, by their length after the apostrophe.
_CONTRACTIONS = {1: ["s", "t", "m", "d"], 2: ["re", "ve", "ll"]}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.full(0x110000, _OTHER, np.uint8)
    out[:0x40000] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x40000)), np.uint8, 0x40000)  # the planes with letters
    out[_WHITE] = _SPACE
    return out


def valid_utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts with U+FFFD in place of what isn't UTF-8; the same arrays where all is."""
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    return data, offsets


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the pattern's pre-tokens in valid UTF-8; texts never share one."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80) if len(points) < len(data) else np.arange(len(data))
    n = len(points)
    kind = _classes()[points]
    cuts = np.searchsorted(at, offsets[:-1])
    cuts = cuts[cuts < n]
    first = np.zeros(n + 1, bool)
    first[cuts] = True
    first[n] = True
    space = kind == _SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 32
    after_blank &= ~first[:-1]
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    changed |= first[:-1]
    begins = np.where(space, changed, changed & ~after_blank)
    # the last white space before a word stands alone or opens the word
    last = space.copy()
    last[:-1] &= ~space[1:]
    last[-1] = False
    last &= ~first[1:]
    begins |= last
    for p in np.flatnonzero((points == 39) & begins):
        for size, endings in _CONTRACTIONS.items():
            stop = p + 1 + size
            if stop <= n and not first[p + 1 : stop].any() and "".join(map(chr, points[p + 1 : stop])) in endings:
                begins[p + 1 : stop] = False
                if stop < n and kind[stop] == _LETTER:
                    begins[stop] = True
                break
    starts = at[np.flatnonzero(begins)]
    return starts, np.append(starts[1:], len(data))


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of all spans, one after the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]


class Vocabulary:
    """Token bytes and the merge table of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ids = model["vocab"]
        self.tokens: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens") or []}
        self.tokens |= {i: t for t, i in self.special.items()}
        size = max(self.tokens) + 1
        lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self._token_start = np.cumsum(lengths) - lengths
        self._token_length = lengths
        self._token_bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self._byte_id = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self._byte_id[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self._rank_of = {(int(k) >> 20, int(k) & 0xFFFFF): (r, int(m)) for r, (k, m) in enumerate(zip(key, made, strict=True))}
        # open addressing: a slot holds the pair, its rank and the token that it makes
        self._bits = 18
        slots = 1 << self._bits
        self._keys, self._ranks, self._made = np.full(slots, -1, np.int64), np.full(slots, _NONE, np.int64), np.zeros(slots, np.int64)
        left, place = np.arange(len(key)), self._slot(key)
        self.probes = 0
        while len(left):
            free = self._keys[place] == -1
            _, pick = np.unique(np.where(free, place, -1 - np.arange(len(place))), return_index=True)
            pick = pick[free[pick]]
            self._keys[place[pick]], self._ranks[place[pick]], self._made[place[pick]] = key[left[pick]], left[pick], made[left[pick]]
            rest = np.ones(len(left), bool)
            rest[pick] = False
            left, place = left[rest], (place[rest] + 1) & (slots - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 if it isn't in the table."""
        place = self._slot(key)
        found = self._keys[place]
        out = np.where(found == key, place, -1)
        todo = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            place[todo] = (place[todo] + 1) & (len(self._keys) - 1)
            found = self._keys[place[todo]]
            out[todo[found == key[todo]]] = place[todo[found == key[todo]]]
            todo = todo[(found != key[todo]) & (found != -1)]
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """Exact merges of one long piece with a heap of (rank, place)."""
        symbol = [int(self._byte_id[b]) for b in piece]
        n = len(symbol)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r[0], i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := self._rank_of.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], alive[j] = self._rank_of[a, b][1], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self._rank_of.get((symbol[k], symbol[after[k]]))):
                    heapq.heappush(heap, (r[0], k, symbol[k], symbol[after[k]]))
        return [s for s, live in zip(symbol, alive, strict=True) if live]

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long_piece: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of many pieces: (number of ids of each, all ids in a row).

        Every round applies to each piece its own lowest-ranked pair, leftmost occurrences first, as the merge order
        asks; finished pieces leave the arrays.
        """
        lengths = ends - starts
        outs: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of the pieces' ids, and the ids
        owner = np.arange(len(starts))
        for k in np.flatnonzero(lengths > long_piece):
            ids = self.merge_one(data[starts[k] : ends[k]].tobytes())
            outs.append((np.full(len(ids), k), np.array(ids, np.int64)))
        owner = owner[lengths <= long_piece]
        symbol = self._byte_id[_gather(data, starts[owner], lengths[owner])]
        word = np.repeat(owner, lengths[owner])
        while len(symbol):
            rank, made = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)
            if len(symbol) > 1:
                same = np.flatnonzero(word[1:] == word[:-1])
                slot = self._find(symbol[same] << 20 | symbol[same + 1])
                hit = slot >= 0
                rank[same[hit]], made[same[hit]] = self._ranks[slot[hit]], self._made[slot[hit]]
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(word)))
            least = np.repeat(least, sizes)
            over = least == _NONE
            if over.any():
                outs.append((word[over], symbol[over]))
            do = (rank == least) & ~over
            hits = np.flatnonzero(do)
            if len(hits) > 1:  # in a run of overlapping pairs (a a a) every second one merges
                run = np.cumsum(np.append(True, np.diff(hits) > 1))
                nth = np.arange(len(hits)) - np.searchsorted(run, run)
                hits = hits[nth % 2 == 0]
            symbol[hits] = made[hits]
            keep = ~over
            keep[hits + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not outs:
            return np.zeros(len(starts), np.int64), np.zeros(0, np.int64)
        word = np.concatenate([w for w, _ in outs])
        ids = np.concatenate([s for _, s in outs])[np.argsort(word, kind="stable")]
        return np.bincount(word, minlength=len(starts)), ids

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, given how many of the ids are its; like the library, what isn't UTF-8 becomes U+FFFD."""
        ids = ids.astype(np.int64)
        lengths = self._token_length[ids]
        raw = _gather(self._token_bytes, self._token_start[ids], lengths).tobytes()
        edge = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        return [raw[a:b].decode("utf-8", "replace").encode("utf-8") for a, b in zip(edge[:-1], edge[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lexicon:
    """Minimal acyclic transducer: pre-token bytes to ids, equal suffixes shared, outputs as additive ranks on the arcs.

    Arrays: ``arc_key`` (state * 256 + byte, ascending), ``arc_next``, ``arc_rank`` (words that end before this arc's),
    ``final`` by state, and the id lists by rank in ``id_start`` and ``ids``.
    """

    PARTS = ("arc_key", "arc_next", "arc_rank", "final", "id_start", "ids")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @staticmethod
    def build(entries: Iterable[tuple[bytes, list[int]]]) -> Lexicon:
        """From (word, ids) with distinct words that aren't empty; incremental minimisation over the sorted words."""
        entries = sorted((w, i) for w, i in entries if w)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []  # of a registered state: final, its arcs (byte, state)
        path: list[list] = [[False, []]]  # open states of the current word: final, arcs; each last arc leads to the next
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1][-1] = (path[-1][1][-1][0], register[key])

        for word, _ in entries:
            same = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            close(same)
            for b in word[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        count: list[int] = []  # words from a state on; children are registered before their parents
        for final, arcs in states:
            count.append(final + sum(count[t] for _, t in arcs))
        order = len(states) - 1  # numbers are turned round: the root becomes 0
        keys, nexts, ranks = [], [], []
        for s in range(order, -1, -1):
            final, arcs = states[s]
            seen = int(final)
            for b, t in arcs:
                keys.append((order - s) << 8 | b)
                nexts.append(order - t)
                ranks.append(seen)
                seen += count[t]
        sizes = np.array([len(i) for _, i in entries], np.int64)
        return Lexicon(
            {
                "arc_key": np.array(keys, np.int64), "arc_next": np.array(nexts, np.int32), "arc_rank": np.array(ranks, np.int32),
                "final": np.array([f for f, _ in reversed(states)], bool), "id_start": np.append(0, np.cumsum(sizes)),
                "ids": np.array([x for _, i in entries for x in i], np.int32),
            }
        )

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.writelines(self.blocks())

    def blocks(self) -> Iterator[bytes]:
        """The content of the file: a line of JSON with the parts' types, sizes and places, then the arrays."""
        parts = {k: np.ascontiguousarray(getattr(self, k)) for k in self.PARTS}
        at, head = 0, {}
        for k, v in parts.items():
            head[k] = [v.dtype.str, len(v), at]
            at += -(-v.nbytes // 8) * 8
        line = json.dumps(head).encode()
        line += b" " * (-(len(line) + 1) % 8) + b"\n"
        yield line
        for v in parts.values():
            yield v.tobytes() + b"\0" * (-v.nbytes % 8)

    @staticmethod
    def load(path: str) -> Lexicon:
        """The arrays of a saved lexicon, memory-mapped: workers of one machine share the pages."""
        with open(path, "rb") as f:
            line = f.readline()
        return Lexicon({k: np.memmap(path, np.dtype(t), "r", len(line) + at, (n,)) if n else np.zeros(0, np.dtype(t)) for k, (t, n, at) in json.loads(line).items()})

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each byte span, -1 for words that aren't in the lexicon; all spans step together, a byte a round."""
        state, rank = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        out = np.full(len(starts), -1, np.int64)
        live, depth, lengths = np.arange(len(starts)), 0, ends - starts
        while len(live):
            done = lengths[live] == depth
            stop = live[done]
            out[stop] = np.where(self.final[state[stop]], rank[stop], -1)
            live = live[~done]
            if not len(live) or not len(self.arc_key):
                break
            key = state[live] << 8 | data[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == key
            live, arc = live[hit], arc[hit]
            state[live] = self.arc_next[arc]
            rank[live] += self.arc_rank[arc]
            depth += 1
        return out


def distinct_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of words that stand for all, which of them each word is): hashes find them and the bytes decide."""
    _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    first = where[back]
    same = lengths == lengths[first]
    at = np.flatnonzero(same)
    same[at] = same_spans(data, starts[at], data, starts[first[at]], lengths[at])
    other = np.flatnonzero(~same)
    back[other] = len(where) + np.arange(len(other))
    return np.append(where, other), back


class Encoder:
    """Encodes chunks of texts; words that the lexicon lacks are merged exactly and kept, a bounded number of them."""

    def __init__(self, tokenizer: str, lexicon: Lexicon | None = None, kept_bits: int = 19):
        self.vocabulary, self.lexicon = vocabulary(tokenizer), lexicon
        self._mask = (1 << kept_bits) - 1
        self._clear()

    def _clear(self) -> None:
        slots = self._mask + 1
        self._hash = np.zeros(slots, np.uint64)
        self._length, self._at, self._start, self._size = (np.zeros(slots, np.int32) for _ in range(4))
        self._ids, self._used = np.zeros(1 << 16, np.int32), 0
        self._text, self._filled = np.zeros(1 << 16, np.uint8), 0

    def _keep(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Put words, with their bytes, into the table of kept words; of two with one slot one stays, the other is merged again."""
        first = np.cumsum(sizes) - sizes
        slot = (hashes & np.uint64(self._mask)).astype(np.int64)
        slot, pick = np.unique(slot, return_index=True)
        fits = lengths[pick] <= KEPT_BYTES
        slot, pick = slot[fits], pick[fits]
        text, more = _gather(data, starts[pick], lengths[pick]), _gather(ids, first[pick], sizes[pick])
        if self._used + len(more) > 8 * (self._mask + 1) or self._filled + len(text) > 16 * (self._mask + 1):
            self._clear()
        while self._used + len(more) > len(self._ids):
            self._ids = np.append(self._ids, np.zeros_like(self._ids))
        while self._filled + len(text) + 8 > len(self._text):
            self._text = np.append(self._text, np.zeros_like(self._text))
        self._ids[self._used : self._used + len(more)] = more
        self._text[self._filled : self._filled + len(text)] = text
        self._hash[slot], self._length[slot], self._size[slot] = hashes[pick], lengths[pick], sizes[pick]
        self._at[slot] = np.cumsum(lengths[pick]) - lengths[pick] + self._filled
        self._start[slot] = np.cumsum(sizes[pick]) - sizes[pick] + self._used
        self._used, self._filled = self._used + len(more), self._filled + len(text)

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        hashes = span_hashes(data, starts, ends)
        if self.lexicon is None:
            begin, size, pool = self._merged(padded(data), starts, ends - starts, hashes)
            return size, _gather(pool, begin, size)
        data = padded(data)
        where, back = distinct_words(data, starts, ends - starts, hashes)
        rank = self.lexicon.lookup(data, starts[where], ends[where])
        known, other = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        at, lexicon_ids = np.asarray(self.lexicon.id_start), np.asarray(self.lexicon.ids)
        begin, size = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        begin[known], size[known] = at[rank[known]], at[rank[known] + 1] - at[rank[known]]
        unseen = where[other]
        begin[other], size[other], pool = self._merged(data, starts[unseen], ends[unseen] - starts[unseen], hashes[unseen])
        begin[other] += len(lexicon_ids)
        return size[back], _gather(np.concatenate([lexicon_ids, pool]), begin[back], size[back])

    def _merged(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and numbers of each word's ids, and the array that they lie in; words not kept yet are merged. A word is known by its bytes."""
        slot = (hashes & np.uint64(self._mask)).astype(np.int64)
        begin, size = self._start[slot].astype(np.int64), self._size[slot].astype(np.int64)
        known = (self._hash[slot] == hashes) & (self._length[slot] == lengths)
        at = np.flatnonzero(known)
        known[at] = same_spans(data, starts[at], self._text, self._at[slot[at]], lengths[at])
        new = np.flatnonzero(~known)
        pool, shift = self._ids[: self._used], self._used
        if len(new):
            where, back = distinct_words(data, starts[new], lengths[new], hashes[new])
            where = new[where]
            sizes, ids = self.vocabulary.merge(data, starts[where], starts[where] + lengths[where])
            begin[new], size[new] = (np.cumsum(sizes) - sizes + shift)[back], sizes[back]
            pool = np.concatenate([pool, ids.astype(np.int32)])
            self._keep(data, starts[where], lengths[where], hashes[where], sizes, ids)
        return begin, size, pool

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts given as UTF-8 and row offsets: (number of ids of each text, all ids). Special tokens' strings in a text become their ids."""
        data, offsets = valid_utf8(data, offsets)
        raw = data.tobytes()
        specials = []  # (start, end, id) of special tokens' strings inside one text
        for string, number in self.vocabulary.special.items():
            at = raw.find(string)
            while at >= 0:
                if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + len(string) - 1, side="right"):
                    specials.append((at, at + len(string), number))
                    at = raw.find(string, at + len(string))
                else:
                    at = raw.find(string, at + 1)
        cuts = np.unique(np.concatenate([offsets, *[[a, b] for a, b, _ in sorted(specials)]])) if specials else offsets
        cuts = np.append(cuts, len(data)) if len(cuts) < 2 else cuts
        starts, ends = pre_tokens(data, np.unique(cuts))
        if specials:
            begin = np.array([a for a, _, _ in sorted(specials)])
            stop = np.array([b for _, b, _ in sorted(specials)])
            number = np.array([i for _, _, i in sorted(specials)], np.int32)
            k = np.searchsorted(begin, starts, side="right") - 1
            within = (k >= 0) & (starts < stop[np.maximum(k, 0)])
            lead = within & (starts == begin[np.maximum(k, 0)])
            plain = ~within
            sizes, ids = self._words(data, starts[plain], ends[plain])
            size = np.zeros(len(starts), np.int64)
            size[plain], size[lead] = sizes, 1
            out = np.zeros(int(size.sum()), np.int32)
            is_special = np.repeat(lead, size)
            out[is_special], out[~is_special] = number[k[lead]], ids
            sizes, ids = size, out
        else:
            sizes, ids = self._words(data, starts, ends)
        total = np.append(0, np.cumsum(sizes))
        edge = total[np.searchsorted(starts, offsets)]
        return np.diff(edge), ids


_encoders: dict[tuple, Encoder] = {}


def encoder(tokenizer: str, lexicon_path: str | None = None) -> Encoder:
    """This worker's encoder for a tokenizer file and, if given, a saved lexicon; a worker keeps the last one."""
    key = (tokenizer, lexicon_path)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer, Lexicon.load(lexicon_path) if lexicon_path else None)
    return _encoders[key]

