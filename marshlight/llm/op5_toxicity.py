"""Operator 5: toxicity by a subsequence string-kernel SVM with Nystroem landmarks."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.llm.bpe import _LETTER, _NUMBER, _SPACE, _classes
from marshlight.llm.common import map_arrow, mix64, table, text_chunks
from marshlight.llm.learning import append_score, calibrate, fold, sigmoid, training_sample

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Subsequences of 3, 4 and 5 symbols whose span is at most 5, 6 and 6: so many inserted symbols are forgiven.
ORDERS = {3: 5, 4: 6, 5: 6}
DECAY = 0.5
LANDMARKS, HARD_NEGATIVES, ROUNDS = 160, 12_000, 2
#: Lengths of the runs of symbols whose odds begin the training; those of one length may go on from word to word.
RUNS, PHRASE_RUN = (4, 6, 8, 12), 12
#: Units that landmarks are chosen from, and units that one step of the arithmetic holds: fixed, so memory is bounded.
POOL, BLOCK = 400, 16_384
#: Bytes of text that are cut into units at once, and symbols that one step of the scoring holds.
CHUNK, STEP = 1 << 19, 1 << 14
#: A unit is a word, or up to so many neighbouring words of so many symbols together.
PHRASE_WORDS, PHRASE_SYMBOLS = 3, 26
#: Longer words are searched in pieces of so many letters, every so many letters, for parts of these sizes that count as if
#: they stood alone. From 5, as no subsequence then holds both marks; 16 letters in a row are always in one piece.
WHOLE, PIECE, STRIDE, PARTS = 16, 30, 15, range(5, 17)
#: So many neighbouring words are also read without the blanks if none has more letters. (With one blank subsequences still
#: show a word; with two they don't.)
JOINED_WORDS, SHORT = (3, 4), 3
#: Units of a clean text that each round of the training looks at: the worst ones and some chosen by a hash.
WORST, OTHERS = 3, 2
#: Log odds of being in toxic texts that make further words of a toxic text witnesses.
STRONG, SMOOTH = 4.0, 3
#: Most runs whose odds are known, and the odds of any other.
KNOWN_RUNS, UNKNOWN = 200_000, -5.0
#: The symbol between words and at both ends of a text.
MARK = 2
_PATTERNS = [(0, *rest) for n, span in ORDERS.items() for rest in itertools.combinations(range(1, span), n - 1)]
_SPANS = sorted({p[-1] for p in _PATTERNS})
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, size=5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: All beginnings of patterns, shorter ones first.
_PREFIXES = sorted({p[:k] for p in _PATTERNS for k in range(2, len(p) + 1)}, key=lambda p: (len(p), p))
_COMPLETE = set(_PATTERNS)
#: Units of more symbols aren't trained on, so that the kernel's matrices stay small; they are scored as all others are.
LONGEST = 64
_TABLE_BITS = 17
_SHIFTS = (64 - _TABLE_BITS, 64 - 2 * _TABLE_BITS)
_lower: list[np.ndarray] = []


def _lowered() -> np.ndarray:
    if not _lower:
        out = np.arange(0x110000, dtype=np.uint32)
        out[:0x20000] = np.fromiter((ord(s) if len(s := chr(c).lower()) == 1 else c for c in range(0x20000)), np.uint32, 0x20000)  # the planes with cases
        _lower.append(out)
    return _lower[0]


@dataclass
class Units:
    """Texts as one row of symbols and the units in it: symbols [begin, end) of a text; words come first. ``pieces`` are those of long words, without marks."""

    symbols: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    is_word: np.ndarray
    pieces: tuple[np.ndarray, np.ndarray, np.ndarray]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, first letter of each word, letter after its last, text of each word): letters and digits, lower-cased, of the runs
    without white space. Other characters are left out, and runs of one letter that follow each other are one word."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != int(((data & 0xC0) != 0x80).sum()):  # not UTF-8: text by text
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        edge = np.append(0, np.cumsum([len(t) for t in texts]))
    else:
        edge = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    kind = _classes()[points]
    fresh = np.zeros(len(points) + 1, bool)
    fresh[1:] = kind == _SPACE
    fresh[edge] = True
    run = np.cumsum(fresh[:-1])
    keep = np.flatnonzero((kind == _LETTER) | (kind == _NUMBER))
    letters, run = _lowered()[points[keep]], run[keep]
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(run)))
    text = np.searchsorted(edge, keep[head], side="right") - 1
    follows = np.zeros(len(head), bool)
    follows[1:] = (size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1])
    head, text = head[~follows], text[~follows]
    return letters, head, np.append(head[1:], len(run))[: len(head)], text


def units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """All units of some texts: words, phrases of neighbouring words, and short neighbours read as one word. Between the words
    of a unit, before it and behind it stands the mark."""
    letters, head, tail, text = _words(data, offsets)
    size = tail - head
    ends = np.append(text[1:] != text[:-1], True)[: len(head)]  # the last word of its text
    begin = head + np.arange(len(head)) + np.cumsum(ends) - ends  # a mark before each word and one behind each text
    end = begin + size + 2
    short = np.append(0, np.cumsum(size <= SHORT))
    first, last = [], []
    for n in JOINED_WORDS:
        m = max(len(head) - n + 1, 0)
        some = np.flatnonzero((short[n:] - short[:-n] == n)[:m] & (text[:m] == text[len(text) - m :]))
        first.append(some)
        last.append(some + n - 1)
    first, last = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, last))
    total = len(letters) + len(head) + int(ends.sum())
    wide = tail[last] - head[first] + 2
    joined = total + np.cumsum(wide) - wide
    symbols = np.full(total + int(wide.sum()), MARK, np.uint32)
    symbols[np.arange(len(letters)) + np.repeat(begin + 1 - head, size)] = letters
    inner = np.arange(int((wide - 2).sum())) - np.repeat(np.cumsum(wide - 2) - (wide - 2), wide - 2)
    symbols[inner + np.repeat(joined + 1, wide - 2)] = letters[inner + np.repeat(head[first], wide - 2)]
    begins, stops, texts = [begin, joined], [end, joined + wide], [text, text[first]]
    for n in range(2, PHRASE_WORDS + 1):
        a, b = begin[: max(len(begin) - n + 1, 0)], end[n - 1 :]
        some = np.flatnonzero((b - a <= PHRASE_SYMBOLS) & (text[: len(a)] == text[len(text) - len(a) :]))
        begins.append(a[some])
        stops.append(b[some])
        texts.append(text[some])
    long = np.flatnonzero(size > WHOLE)
    count = 1 + np.maximum(-(-(size[long] - PIECE) // STRIDE), 0)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    left, stop = np.repeat(begin[long] + 1, count), np.repeat(end[long] - 1, count)
    left = np.maximum(np.minimum(left + nth * STRIDE, stop - PIECE), left)
    pieces = (left, np.minimum(left + PIECE, stop), np.repeat(text[long], count))
    return Units(symbols, np.concatenate(begins), np.concatenate(stops), np.concatenate(texts), np.arange(sum(map(len, texts))) < len(head), pieces)


def unit_matrix(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(units as rows of symbols, 0 behind; their lengths); with ``marks`` one more at both ends."""
    size = end - begin
    lengths = size + 2 * marks
    out = np.zeros((len(begin), int(lengths.max(initial=0))), np.uint64)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.arange(len(begin)), size)
    out[row, place + marks] = symbols[np.repeat(begin, size) + place]
    if marks:
        out[:, 0] = MARK
        out[np.arange(len(begin)), lengths - 1] = MARK
    return out, lengths


def subsequences(matrix: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(rows, features, weight) of all subsequences within the spans: the kernel's explicit feature map."""
    order = np.argsort(-lengths, kind="stable")
    matrix, lengths = matrix[order], lengths[order]
    terms = [np.ascontiguousarray((mix64(matrix + np.uint64(1)) * m).T) for m in _MULTIPLIERS]
    for begin in range(matrix.shape[1] - 2):
        for pattern in _PATTERNS:
            rows = int(np.searchsorted(-lengths, -(begin + pattern[-1]), side="left"))
            if rows:
                key = terms[0][begin, :rows].copy()
                for k, offset in enumerate(pattern[1:], 1):
                    key += terms[k][begin + offset, :rows]
                yield order[:rows], key, DECAY ** (pattern[-1] + 1)


def _blocks(n: int) -> Iterator[slice]:
    return (slice(k, k + BLOCK) for k in range(0, n, BLOCK))


def norms(lengths: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of a unit's subsequences: the kernel is divided by both units' norms."""
    most = int(lengths.max(initial=0)) if len(lengths) else 0
    total = np.zeros(most + 1)
    for pattern in _PATTERNS:
        total += np.maximum(np.arange(most + 1) - pattern[-1], 0) * DECAY ** (2 * (pattern[-1] + 1))
    return np.sqrt(np.maximum(total, 1e-12))[lengths]


class Weights:
    """A table of features and their weights: a feature has a slot by its top bits, or else one by its next bits, or is in a list."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        slots = 1 << _TABLE_BITS
        self.seen = np.zeros(slots, bool)
        self.tables = [(np.zeros(slots, np.uint64), np.zeros(slots, np.float64)) for _ in range(2)]
        self.seen[self._slot(features, _SHIFTS[0])] = True
        for (keys, values), shift in zip(self.tables, _SHIFTS, strict=True):
            slot, pick = np.unique(self._slot(features, shift), return_index=True)
            keys[slot], values[slot] = features[pick], weights[pick]
            features, weights = np.delete(features, pick), np.delete(weights, pick)
        order = np.argsort(features)
        self.rest = features[order], weights[order]

    @staticmethod
    def _slot(key: np.ndarray, shift: int) -> np.ndarray:
        return ((key >> np.uint64(shift)) & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of features that have a weight, weights)."""
        slot = (key >> np.uint64(_SHIFTS[0])).view(np.int64)
        at = np.flatnonzero(self.seen.take(slot))
        own, slot, (keys, values) = key.take(at), slot.take(at), self.tables[0]
        hit, value = keys.take(slot) == own, values.take(slot)
        miss = np.flatnonzero(~hit)
        if len(miss):
            keys, values = self.tables[1]
            slot = self._slot(own[miss], _SHIFTS[1])
            hit[miss], value[miss] = keys[slot] == own[miss], values[slot]
            if len(self.rest[0]):
                miss = np.flatnonzero(~hit)
                place = np.minimum(np.searchsorted(self.rest[0], own[miss]), len(self.rest[0]) - 1)
                hit[miss], value[miss] = self.rest[0][place] == own[miss], self.rest[1][place]
        return at[hit], value[hit]


class Guess:
    """What is known before the first model: the log odds of some runs of symbols of being in toxic texts."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        self.keys, self.odds, self.table = keys, odds, Weights(keys, odds)

    def __reduce__(self) -> tuple:
        return Guess, (self.keys, self.odds)

    def values(self, u: Units) -> np.ndarray:
        """Of each unit the largest odds of its runs."""
        out = np.full(len(u.begin), UNKNOWN)
        for length in RUNS if len(out) else ():
            key = run_keys(u.symbols, length)
            x = np.full(len(u.symbols) + 1, UNKNOWN)
            at, value = self.table.find(key)
            x[at] = value
            bounds = np.stack([u.begin, np.maximum(u.end - length + 1, u.begin + 1)], 1).reshape(-1)
            out = np.maximum(out, np.where(u.end - u.begin >= length, np.maximum.reduceat(x, bounds)[::2], UNKNOWN))
        return out


def run_keys(symbols: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key of the run of so many symbols from each place on."""
    base = mix64(symbols.astype(np.uint64) + np.uint64(1))
    n = max(len(base) - length + 1, 0)
    key = np.full(n, length, np.uint64)
    for k in range(length):
        key = key * _MULTIPLIERS[0] + base[k : k + n]
    return mix64(key)


class Model:
    """The SVM's decision function. Nystroem features of a unit are linear in its kernel values with the landmarks, and
    those are linear in its subsequences, so the trained weights fold into one number a subsequence: the decision is
    exact and needs no landmark at scoring time. Each subsequence of a text is looked up once, and the units that
    share it are differences of running sums."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.features, self.weights, self.offset, self.slope, self.shift = features, weights, offset, slope, shift
        self.table = Weights(features, weights)

    def __reduce__(self) -> tuple:
        return Model, (self.features, self.weights, self.offset, self.slope, self.shift)

    def sums(self, symbols: np.ndarray) -> dict[int, np.ndarray]:
        """By span: running sums over the symbols of the weights of the subsequences that begin there."""
        n, reach = len(symbols), _SPANS[-1]
        out = {s: np.zeros(n + 1) for s in _SPANS}
        base = mix64(symbols.astype(np.uint64) + np.uint64(1))
        for start in range(0, n if len(self.features) else 0, STEP):
            part = base[start : start + STEP + reach]
            terms, size = [part * m for m in _MULTIPLIERS], min(STEP, n - start)
            keys = {(0,): terms[0]}
            for pattern in _PREFIXES:
                k, o = len(pattern) - 1, pattern[-1]
                keys[pattern] = keys[pattern[:-1]][: max(len(part) - o, 0)] + terms[k][o:]
                if pattern in _COMPLETE:
                    at, value = self.table.find(keys[pattern][:size])
                    out[o][start + 1 + at] += value * DECAY ** (o + 1)
        for x in out.values():
            np.cumsum(x, out=x)
        return out

    def values(self, u: Units) -> np.ndarray:
        """The decision of each unit."""
        total = np.zeros(len(u.begin))
        for span, x in self.sums(u.symbols).items():
            total += x[np.maximum(u.end - span, u.begin)] - x[u.begin]
        return total / norms(u.end - u.begin) + self.offset

    def parts(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The highest decision of the letters [a, b) of each piece between marks of their own, for all places and sizes in
        ``PARTS``: sums of the subsequences inside, by their first letter and span, and of those with either mark."""
        best = np.full(len(begin), -np.inf)
        for block in _blocks(len(begin) if len(self.features) else 0):
            matrix, lengths = unit_matrix(symbols, begin[block], end[block], marks=True)
            best[block] = self._parts(matrix, lengths)
        return best + self.offset

    def _parts(self, matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rows, width = matrix.shape
        terms = [mix64(matrix + np.uint64(1)) * m for m in _MULTIPLIERS]
        mark = mix64(np.array([MARK + 1], np.uint64))
        inside = {span: np.zeros((rows, width)) for span in _SPANS}
        begins, ends = np.zeros((rows, width)), np.zeros((rows, width))  # with the mark before a, with the mark at b
        for pattern in _PATTERNS:
            span, n = pattern[-1], width - pattern[-1]
            first, last = terms[0][:, :n], terms[len(pattern) - 1][:, span:]
            middle = np.zeros((rows, n), np.uint64)
            for k, offset in enumerate(pattern[1:-1], 1):
                middle += terms[k][:, offset : offset + n]
            start, end = mark * _MULTIPLIERS[0], mark * _MULTIPLIERS[len(pattern) - 1]
            for key, into in ((first + middle + last, inside[span][:, :n]), (middle + last + start, begins[:, 1 : n + 1]), (middle + first + end, ends[:, span:])):
                at, value = self.table.find(np.ascontiguousarray(key).reshape(-1))
                into[at // n, at % n] += DECAY ** (span + 1) * value
        sums = {span: np.hstack([np.zeros((rows, 1)), np.cumsum(x, axis=1)]) for span, x in inside.items()}
        best = np.full(rows, -np.inf)
        for size in PARTS:
            a = np.arange(1, width - size)
            total = begins[:, a] + ends[:, a + size]
            for span, x in sums.items():
                total += x[:, a + max(size - span, 0)] - x[:, a]
            total[a[None, :] + size > lengths[:, None] - 1] = -np.inf
            best = np.maximum(best, total.max(axis=1, initial=-np.inf) / norms(np.array([size + 2]))[0])
        return best

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The decision of each text: of its worst unit, or of a long word's worst part."""
        u = units(data, offsets)
        best = np.full(len(offsets) - 1, self.offset)
        highest = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(highest, u.text, self.values(u))
        begin, end, text = u.pieces
        np.maximum.at(highest, text, self.parts(u.symbols, begin, end))
        return np.where(np.isfinite(highest), highest, best)

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * decision + self.shift)


def _runs(of: int, known: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(run, n): in how many texts with the label ``of`` a run of symbols is, summed by chunk; only the runs ``known`` (ascending) if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(batch.column("y").to_numpy() == of))
            for _, _, data, offsets in text_chunks(own.column("text"), CHUNK):
                u, found = units(data, offsets), []
                if not u.is_word.any():
                    continue
                heads = np.flatnonzero(np.append(True, u.text[u.is_word][1:] != u.text[u.is_word][:-1]))  # the first words of texts
                begin, text = u.begin[heads], u.text[heads].astype(np.uint64)
                end, marks = u.end[np.append(heads[1:], u.is_word.sum()) - 1], np.append(0, np.cumsum(u.symbols == MARK))
                for length in RUNS:
                    many = np.maximum(end - begin - length + 1, 0)
                    place, owner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many), np.repeat(text, many)
                    if length < PHRASE_RUN:
                        within = marks[place + length - 1] == marks[place + 1]
                        place, owner = place[within], owner[within]
                    key = run_keys(u.symbols, length)[place]
                    if known is not None:
                        held = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                        key, owner = key[held], owner[held]
                    _, once = np.unique(mix64(key + owner * np.uint64(0x9E3779B97F4A7C15)), return_index=True)  # once a text
                    found.append(key[once])
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["run", "n"])

    return run


def _odds(run: Callable, texts: int, ratio: float) -> Guess:
    """Odds of the runs that are in two toxic texts at least, the most frequent ``KNOWN_RUNS`` of them. Fewer show nothing."""
    if not texts:
        return Guess(np.zeros(0, np.uint64), np.zeros(0))
    toxic = run(_runs(1), "run long, n long", 2)
    keys, n = toxic.column("run").to_numpy().view(np.uint64), toxic.column("n").to_numpy()
    keys, n = (x[np.lexsort((keys, -n))[:KNOWN_RUNS]] for x in (keys, n))
    keys, n = (x[np.argsort(keys)] for x in (keys, n))
    clean = np.zeros(len(keys))
    if len(keys):
        others = run(_runs(0, keys), "run long, n long", 1)
        clean[np.searchsorted(keys, others.column("run").to_numpy().view(np.uint64))] = others.column("n").to_numpy()
    return Guess(keys, np.log((ratio * n + 0.5) / (clean + SMOOTH)))


def _candidates(guess: Guess, model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(kind, unit) from labelled texts. Toxic ones give their worst unit, the witness, and words with strong odds (1); clean ones their worst
    units and a few others (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for first, last, data, offsets in text_chunks(batch.column("text"), CHUNK):
                u, label = units(data, offsets), y[first:last]
                if not len(u.begin):
                    continue
                odds = guess.values(u)
                value = model.values(u) if model else odds
                fits = u.end - u.begin <= LONGEST
                order = np.lexsort((u.begin, u.end - u.begin, -value, u.text))
                order = order[fits[order]]
                if not len(order):
                    continue
                heads = np.flatnonzero(np.append(True, u.text[order][1:] != u.text[order][:-1]))
                nth = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
                toxic = label[u.text[order]] == 1
                kinds = [(1, order[toxic & (nth == 0)]), (0, order[~toxic & (nth < WORST)])]
                chance = mix64(unit_keys(u))
                mixed = order[np.lexsort((chance[order], u.text[order]))]
                heads = np.flatnonzero(np.append(True, u.text[mixed][1:] != u.text[mixed][:-1]))
                nth = np.arange(len(mixed)) - np.repeat(heads, np.diff(np.append(heads, len(mixed))))
                kinds.append((0, mixed[(label[u.text[mixed]] == 0) & (nth < OTHERS)]))
                kinds.append((1, np.flatnonzero((label[u.text] == 1) & (odds >= STRONG) & u.is_word & fits)))
                at = np.concatenate([a for _, a in kinds])
                size = u.end[at] - u.begin[at]
                flat = u.symbols[np.arange(int(size.sum())) + np.repeat(u.begin[at] - (np.cumsum(size) - size), size)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(a), k, np.int32) for k, a in kinds])), lists], names=["kind", "unit"])

    return run


def unit_keys(u: Units) -> np.ndarray:
    """A number for each unit from its first symbols and its length: the same wherever its text lies."""
    base = mix64(u.symbols.astype(np.uint64) + np.uint64(1))
    key = (u.end - u.begin).astype(np.uint64)
    for k in range(5):
        key += base[np.minimum(u.begin + k, u.end - 1)] * _MULTIPLIERS[k]
    return key


def _decisions(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column("text"), CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(first, last - first), pa.array(model.texts(data, offsets))], names=["y", "decision"])

    return run


def _kernel_columns(matrix: np.ndarray, lengths: np.ndarray, features: np.ndarray, table_of: np.ndarray) -> np.ndarray:
    """Kernel values of units (rows) with the landmarks whose subsequence weights are the columns of ``table_of``."""
    out = np.zeros((len(lengths), table_of.shape[1]))
    for block in _blocks(len(lengths)):
        part = out[block]
        for rows, key, weight in subsequences(matrix[block], lengths[block]):
            place = np.minimum(np.searchsorted(features, key), len(features) - 1)
            hit = np.flatnonzero(features[place] == key)
            part[rows[hit]] += weight * table_of[place[hit]]  # a pattern meets a row once
    return out / norms(lengths)[:, None]


def _landmark_table(matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features ascending, features x landmarks weights, divided by the landmarks' norms)."""
    parts = [(rows, key, np.full(len(key), weight)) for rows, key, weight in subsequences(matrix, lengths)]
    if not parts:
        return np.zeros(1, np.uint64), np.zeros((1, len(lengths)))
    rows, keys, weights = (np.concatenate([p[k] for p in parts]) for k in range(3))
    features, back = np.unique(keys, return_inverse=True)
    out = np.zeros((len(features), len(lengths)))
    np.add.at(out, (back, rows), weights)
    return features, out / norms(lengths)


def _svm(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """L2-loss linear SVM (last weight: offset) by Newton steps on the margin violators."""
    x = np.hstack([x, np.ones((len(x), 1))])
    goal, w = 2.0 * y - 1, np.zeros(x.shape[1])
    pull = np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for _ in range(rounds):
        bad = goal * (x @ w) < 1
        c = importance[bad]
        new = np.linalg.solve((x[bad] * c[:, None]).T @ x[bad] + np.diag(pull), (x[bad] * c[:, None]).T @ goal[bad])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _spread(table_of: np.ndarray, most: int) -> np.ndarray:
    """Of units in order of weight, some that are far from each other in the kernel: the first, then always the farthest."""
    own = np.sqrt(np.maximum((table_of**2).sum(axis=0), 1e-12))
    near, chosen = np.full(table_of.shape[1], -1.0), [0]
    while len(chosen) < min(most, table_of.shape[1]):
        last = chosen[-1]
        near = np.maximum(near, (table_of.T @ table_of[:, last]) / (own * own[last]))
        chosen.append(int(near.argmin()))
    return np.array(chosen)


class _Found:
    """The distinct units that came from the texts, and how often each was a witness."""

    def __init__(self) -> None:
        self.votes: dict[bytes, int] = {}
        self.clean: dict[bytes, None] = {}

    def add(self, rows: pa.Table) -> None:
        self.votes = {}
        for kind, unit in zip(rows.column("kind").to_pylist(), rows.column("unit").to_pylist(), strict=True):
            key = np.array(unit, np.uint32).tobytes()
            if kind:
                self.votes[key] = self.votes.get(key, 0) + 1
            else:
                self.clean[key] = None

    @staticmethod
    def matrix(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum([len(k) // 4 for k in keys])
        return unit_matrix(np.frombuffer(b"".join(keys), np.uint32), end - [len(k) // 4 for k in keys], end)


def train(run: Callable[..., pa.Table], landmarks: int = LANDMARKS) -> Model:
    """Fit on labelled texts (text, y), which stay where they are: ``run(step, schema)`` gives the rows of a step over them,
    and ``run(step, schema, least)`` the sums n of each run that are ``least`` or more.

    A label says only that some sentence of the text is toxic: every unit of a clean text is clean, and of a toxic text
    the unit that decides (its witness) is chosen anew in each round, with the words whose odds are strong. What comes
    here is one witness or a few units a text.
    """
    y = run(_labels, "y int").column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0, float(np.log(p / (1 - p))))
    ratio = max(int((y == 0).sum()), 1) / max(int(y.sum()), 1)
    guess, model, found = _odds(run, len(y), ratio), None, _Found()
    for _ in range(ROUNDS):
        found.add(run(_candidates(guess, model), "kind int, unit array<int>"))
        witness = sorted(found.votes, key=lambda k: (-found.votes[k], k))
        others = sorted(k for k in found.clean if k not in found.votes)
        matrix, lengths = _Found.matrix(others) if others else (np.zeros((0, 0), np.uint64), np.zeros(0, np.int64))
        value = _alone(model or guess, others)
        hard = np.argsort(-value, kind="stable")
        pool = witness[landmarks // 3 : POOL]
        spread = [pool[k] for k in _spread(_landmark_table(*_Found.matrix(pool))[1], landmarks // 3)] if pool else []
        chosen = [*witness[: landmarks // 3], *spread]
        chosen += [others[k] for k in hard[: landmarks - len(chosen)]]
        features, table_of = _landmark_table(*_Found.matrix(chosen))
        values, vectors = np.linalg.eigh(_kernel_columns(*_Found.matrix(chosen), features, table_of))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])  # Nystroem: kernel values with the landmarks to features
        some = np.random.default_rng(3).permutation(hard[HARD_NEGATIVES // 2 :])[: HARD_NEGATIVES // 2]
        used = np.append(hard[: HARD_NEGATIVES // 2], some)
        rows = [_kernel_columns(*_Found.matrix(witness), features, table_of), _kernel_columns(matrix[used], lengths[used], features, table_of)]
        votes = np.array([found.votes[k] for k in witness], float)
        w = _svm(np.concatenate(rows) @ root, np.append(np.ones(len(witness)), np.zeros(len(used))), np.append(votes, np.ones(len(used))))
        model = Model(features, table_of @ (root @ w[:-1]), float(w[-1]), 1.0, 0.0)
    last = run(_decisions(model), "y int, decision double")
    slope, shift = calibrate(4 * last.column("decision").to_numpy(), last.column("y").to_numpy())
    return Model(model.features, model.weights, model.offset, 4 * slope, shift)


def _alone(scorer: Model | Guess, keys: list[bytes]) -> np.ndarray:
    """The value of each unit by itself."""
    symbols, end = np.frombuffer(b"".join(keys), np.uint32), np.cumsum([len(k) // 4 for k in keys]).astype(np.int64)
    none = np.zeros(0, np.int64)
    begin = np.append(0, end[:-1])[: len(end)]
    return scorer.values(Units(symbols, begin, end, np.zeros(len(end), np.int64), np.ones(len(end), bool), (none, none, none)))


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.select(["y"]) for b in batches)


def fit(spark: SparkSession, sf_dir: str) -> Model:
    """Train on the bounded labelled sample, which is written once and read by every round's tasks."""
    sample = training_sample(spark, sf_dir, "toxic", FOLDS, HELD_OUT).select("text", "y")

    def run(step: Callable, schema: str, least: int | None = None) -> pa.Table:
        rows = map_arrow(sample, step, schema)
        if least is not None:
            rows = rows.groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            rows = rows.orderBy(F.desc("n"), "run").limit(KNOWN_RUNS)
        return rows.toArrow()

    return train(run)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and, as ``name``, a score: 0 to 1, of the whole text's worst unit.

    Null, empty and blank texts get the score of a text without units. No shuffle; the model is small and goes with
    the tasks. ``name`` must not be in ``keep``.
    """
    return append_score(docs, lambda: lambda data, offsets: model.probability(model.texts(data, offsets)), list(keep), CHUNK, name)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), fit(spark, sf_dir))
    return scored.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
