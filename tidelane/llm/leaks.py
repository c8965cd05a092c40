"""Evaluation passages inside training text, by spaced-seed hashing (problem 7)."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.session import cut_lineage, spread

#: Positions that a seed compares; the one left out may hold any word.
MASKS = ((0, 1, 3), (0, 2, 3))
SPAN = 4
FOUND_SCHEMA = "doc_id bigint, test_id bigint, n_words bigint, n_edits bigint, doc_word bigint, item_word bigint"
SEGMENT_SCHEMA = "doc_id bigint, segment bigint, first bigint, bare binary, left binary, seed array<bigint>"
ITEM_SCHEMA = "test_id bigint, item bigint, bare binary, left binary, seed array<bigint>"
#: Words of a text that are searched as one; longer texts are cut, with what a passage may reach around.
SEGMENT_WORDS = 4096
#: Bits for each seed in the filter, how many are set, and the most bits it has (32 MB): beyond that it lets more through.
FILTER_BITS, PROBES, MOST_BITS = 32, 4, 1 << 28
SALTS = 16
#: Up to so many seeds, and so many bytes of words, the items' side is sent to every executor instead.
FEW_SEEDS, FEW_BYTES = 200_000, 8_000_000

_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>")
_SPACE = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2013\u2014\u2026]")
_WORD = re.compile(r"[^\W_]+", re.ASCII)
_OTHER_WORD = re.compile(r"[^\W_]+")
_INSIDE = re.compile("['`\u2019\u2018]")
_BEYOND = re.compile(r"[^\x00-\x7f]+")


def _plain(text: str) -> str:
    """Without markup, entities and marks inside words, in lower case."""
    return _INSIDE.sub("", _SPACE.sub(" ", _TAG.sub(" ", html.unescape(text)))).lower()


def _words_of(piece: str) -> list[tuple[str, str]]:
    """The words of a piece without blanks, in both forms."""
    if piece.isascii():
        return [(w, w) for w in _WORD.findall(piece)]
    left = _WORD.findall(_BEYOND.sub("", piece))
    plain = unicodedata.normalize("NFKD", piece)
    bare = _WORD.findall(_BEYOND.sub("", plain))
    if left:
        return list(zip(bare, left)) if len(bare) == len(left) else [(w, w) for w in left]
    return [(w, w) for w in _OTHER_WORD.findall("".join(c for c in plain if not unicodedata.combining(c)))]


def words(text: str) -> list[tuple[str, str]]:
    """Each word twice: with its accents taken off, and with every character beyond ASCII left out.

    Wrong decoding turns an accented letter into other characters beyond ASCII, so the second form survives it,
    as the first survives the loss of accents. Words of scripts without ASCII letters keep their letters.
    """
    return [pair for piece in _plain(text).split() for pair in _words_of(piece)]


def _packed(bare: np.ndarray, left: np.ndarray) -> tuple[bytes, bytes]:
    """Both forms' hashes as bytes; none for the second if all are the first's."""
    return bare.tobytes(), b"" if np.array_equal(bare, left) else left.tobytes()


class WordHashes(dict):
    """Pieces without blanks, numbered as they are met, and the hashes of their words in both forms.

    Given up when there are many, so that a worker's memory stays bounded.
    """

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most
        self.bare: list[int] = []
        self.left: list[int] = []
        self.ends: list[int] = []

    def __missing__(self, piece: str) -> int:
        for b, f in _words_of(piece):
            self.bare.append(xxhash.xxh32_intdigest(b))
            self.left.append(xxhash.xxh32_intdigest(f))
        self.ends.append(len(self.bare))
        number = self[piece] = len(self)
        return number

    def forms(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two forms' hashes of all words of all texts, and where each text begins (one more than texts)."""
        if len(self) > self.most:
            self.clear()
            self.bare, self.left, self.ends = [], [], []
        numbers: list[int] = []
        cuts, number = [0], self.__getitem__
        for text in texts:
            numbers += map(number, _plain(text or "").split())
            cuts.append(len(numbers))
        piece, ends = np.array(numbers, np.int64), np.array([0, *self.ends], np.int64)
        count = ends[piece + 1] - ends[piece]
        total = np.r_[0, np.cumsum(count)]
        at = np.repeat(ends[piece] - total[:-1], count) + np.arange(total[-1])
        return np.array(self.bare, np.uint32)[at], np.array(self.left, np.uint32)[at], total[np.array(cuts)]


def _mix(parts: list[np.ndarray], number: int) -> np.ndarray:
    total = np.full(len(parts[0]), number + 1, np.uint64)
    for part in parts:
        total = (total ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def seeds(bare: np.ndarray, left: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every seed within one text, in every choice of its words' forms.

    Two stretches of words that each agree in one form or the other so have a hash in common.
    """
    n = len(bare) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    inside = np.flatnonzero(owner[:n] == owner[SPAN - 1 :])
    two = bare != left
    at, out = [], []
    for number, mask in enumerate(MASKS):
        for choice in itertools.product((0, 1), repeat=len(mask)):
            rows = inside
            for k, c in zip(mask, choice):  # the second form only of words that have two
                rows = rows[two[rows + k]] if c else rows
            if len(rows):
                at.append(rows)
                out.append(_mix([(left if c else bare)[rows + k] for k, c in zip(mask, choice)], number))
    return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def longest_needed(least: int, per_edit: int) -> tuple[int, int]:
    """(item words, edits) within which every passage holds a passage.

    Take a passage without a shorter one inside, of more than `least` words. Its first `least` words (with the edited
    words after them) aren't one, so they have more than their share of edits, and what follows has less than its
    share; being no passage either, that is shorter than `least`. With d = item words - per_edit * edits, d is at most
    least - 1 behind, at least 1 - least before: so the edited words in between are few, too.
    """
    span = 2 * least - 1 + (3 * least - 3) // max(per_edit - 1, 1)
    return span, span // per_edit


def _reach(text: list[int], item: list[int], p: int, i: int, way: int, edits: int) -> list[int]:
    """Item words spanned from (p, i) on, up to the last that agrees, with 0, 1, ... edits; furthest reaching."""
    if way < 0:  # the same, seen backwards
        text, item, p, i = text[p::-1] if p >= 0 else [], item[i::-1] if i >= 0 else [], 0, 0
    n, m, x, y = len(text), len(item), p, i
    while x < n and y < m and text[x] == item[y]:
        x, y = x + 1, y + 1
    best = y - i
    front, spans = {0: best}, [best]  # diagonal: item words passed
    for _ in range(edits):
        ahead: dict[int, int] = {}
        for d, used in front.items():
            if ahead.get(d, -1) <= used:  # altered
                ahead[d] = used + 1
            if ahead.get(d + 1, -1) < used:  # added to the text
                ahead[d + 1] = used
            if ahead.get(d - 1, -1) <= used:  # dropped from it
                ahead[d - 1] = used + 1
        for d, used in ahead.items():
            x, y = p + used + d, i + used
            if 0 <= x < n and y < m and text[x] == item[y]:
                x, y = x + 1, y + 1
                while x < n and y < m and text[x] == item[y]:
                    x, y = x + 1, y + 1
                ahead[d] = y - i
                if y - i > best:
                    best = y - i
        front = ahead
        spans.append(best)
    return spans


def passage(text: list[int], item: list[int], p: int, i: int, least: int, per_edit: int, edits: int) -> tuple[int, int] | None:
    """Length and edits of the passage through (p, i) with the fewest edits that meets the rule, or None."""
    right = _reach(text, item, p, i, 1, edits)
    near = text[max(0, p - 2 * (least + per_edit * edits)) : p], item[max(0, i - 2 * (least + per_edit * edits)) : i]
    left = _reach(*near, len(near[0]) - 1, len(near[1]) - 1, -1, edits)
    for e in range(edits + 1):
        span = max(left[a] + right[e - a] for a in range(e + 1))
        if span >= max(least, per_edit * e):
            return span, e
    return None


def _codes(bare: list[int], left: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """Numbers of an item's words by either form; words that share a form have the same number."""
    by_bare: dict[int, int] = {}
    by_left: dict[int, int] = {}
    for b, f in zip(bare, left):
        a, c = by_bare.get(b), by_left.get(f)
        if a is not None and c is not None and a != c:
            for known in (by_bare, by_left):
                for w, x in known.items():
                    if x == c:
                        known[w] = a
        number = a if a is not None else c if c is not None else len(by_bare) + len(by_left)
        by_bare[b] = by_left[f] = number
    return by_bare, by_left


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """Every distinct item of at least `least` words, with its words' hashes and those of its seeds."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            bare, left, begin = hashes.forms(batch["text"].to_pylist())
            rows = []
            for test_id, item, a, b in zip(batch["test_id"].to_pylist(), batch["item"].to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                if b - a >= least:
                    _, seed = seeds(bare[a:b], left[a:b], np.array([0, b - a]))
                    rows.append((test_id, item, *_packed(bare[a:b], left[a:b]), np.unique(seed.view(np.int64)).tolist()))
            yield _batch(rows, ITEM_SCHEMA)

    known = items.where("test_id IS NOT NULL AND length(text) > 0").select(F.col("test_id").cast("bigint").alias("test_id"), "text").distinct()
    return known.withColumn("item", F.xxhash64("test_id", "text")).mapInArrow(hashed, ITEM_SCHEMA)


_TYPES = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def seed_filter(places: DataFrame, n: int) -> np.ndarray:
    """A few bits for each of the items' n seeds, in a table of bounded size: where one isn't set, it is no seed of theirs.

    Its size follows the number of seeds, up to MOST_BITS; only its words that aren't 0 reach the driver.
    """
    bits = 1 << 16
    while bits < min(FILTER_BITS * n, MOST_BITS):
        bits *= 2
    place = f"((seed & {bits - 1}L) + k * ((shiftrightunsigned(seed, 32) & {bits - 1}L) | 1L)) & {bits - 1}L"
    probes = places.select("seed", F.explode(F.sequence(F.lit(0), F.lit(PROBES - 1)).cast("array<bigint>")).alias("k")).selectExpr(f"{place} AS place")
    rows = probes.selectExpr("place >> 6 AS word", "shiftleft(1L, int(place & 63L)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def may_hold(table: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Whether each seed may be one of those the table was made of."""
    last = np.uint64(64 * len(table) - 1)
    step = ((seed >> np.uint64(32)) & last) | np.uint64(1)
    found = np.ones(len(seed), bool)
    for k in range(PROBES):
        rows = np.flatnonzero(found)
        place = ((seed[rows] & last) + np.uint64(k) * step[rows]) & last
        found[rows] = (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def candidate_segments(documents: DataFrame, table: np.ndarray, halo: int) -> DataFrame:
    """The segments of texts that may share a seed with an item: their words' hashes, with `halo` words around."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            bare, left, begin = hashes.forms(batch["text"].to_pylist())
            at, seed = seeds(bare, left, begin)
            hit = may_hold(table, seed)
            at, seed = at[hit], seed[hit].view(np.int64)
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            text = np.searchsorted(begin, at, "right") - 1
            segment = (at - begin[text]) // SEGMENT_WORDS
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (segment[1:] != segment[:-1])]) if len(at) else at
            ids, rows = batch["doc_id"].to_pylist(), []
            for a, b in zip(new.tolist(), np.r_[new[1:], len(at)].tolist()):
                k, s = int(text[a]), int(segment[a])
                low = max(int(begin[k]), int(begin[k]) + s * SEGMENT_WORDS - halo)
                high = min(int(begin[k + 1]), int(begin[k]) + (s + 1) * SEGMENT_WORDS + halo)
                rows.append((ids[k], s, low - int(begin[k]), *_packed(bare[low:high], left[low:high]), np.unique(seed[a:b]).tolist()))
            yield _batch(rows, SEGMENT_SCHEMA)

    return documents.mapInArrow(search, SEGMENT_SCHEMA)


#: Places of one seed in a text times those in an item from which a pair is looked at by itself.
MANY_PLACES = 10_000
_NO_TEXT, _NO_ITEM = 1 << 40, 1 << 41


class _Laid:
    """Words of many texts on one axis, parted by words that equal none, and the places of their seeds by hash."""

    def __init__(self, words: list[tuple[bytes, bytes]], gap: int, no_word: int):
        bare = [np.frombuffer(b, np.uint32) for b, _ in words]
        left = [np.frombuffer(f, np.uint32) if f else b for b, (_, f) in zip(bare, words)]
        size = np.array([len(b) for b in bare], np.int64)
        self.begin = gap + np.r_[0, np.cumsum(size + gap)]
        self.bare = np.full(int(self.begin[-1]), no_word, np.int64)
        self.left = self.bare.copy()
        at = np.repeat(self.begin[:-1] - np.r_[0, np.cumsum(size)][:-1], size) + np.arange(size.sum())
        flat, flat_left = (np.concatenate(x) if len(x) else np.zeros(0, np.uint32) for x in (bare, left))
        self.bare[at], self.left[at] = flat, flat_left
        place, seed = seeds(flat, flat_left, np.r_[0, np.cumsum(size)])
        owner = np.repeat(np.arange(len(size)), size)[place]
        order = np.lexsort((place, seed, owner))
        self.owner, self.seed, self.place = owner[order], seed[order], at[place[order]]

    def words(self, k: int) -> tuple[list[int], list[int]]:
        part = slice(int(self.begin[k]), int(self.begin[k + 1]) - (int(self.begin[0])))
        return self.bare[part].tolist(), self.left[part].tolist()

    def ranges(self, owner: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of each seed in each owner."""
        known = np.unique(np.concatenate([self.seed, seed]))
        key = self.owner * len(known) + np.searchsorted(known, self.seed)
        asked = owner * len(known) + np.searchsorted(known, seed)
        return np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")


def _promising(texts: _Laid, items: _Laid, text: np.ndarray, item: np.ndarray, shared: list[list[int]], least: int, per_edit: int, edits: int):
    """(pair, place in the text, place in the item) of the stretches of SPAN words in a row from which a passage may be reached.

    A passage has such a stretch, and around its begin, within `least` + `edits` words to either side, at least `least` words
    less their edits that equal words of the item no more than `edits` places from where they would stand without edits.
    """
    pair = np.repeat(np.arange(len(shared)), [len(x) for x in shared])
    seed = np.array([h for x in shared for h in x], np.int64).view(np.uint64)
    low, high = texts.ranges(text[pair], seed)
    item_low, item_high = items.ranges(item[pair], seed)
    times = (high - low) * (item_high - item_low)
    hit = np.repeat(np.arange(len(pair)), np.where(times > MANY_PLACES, 0, times))
    nth = np.arange(len(hit)) - np.repeat(np.cumsum(np.where(times > MANY_PLACES, 0, times)) - np.where(times > MANY_PLACES, 0, times), np.where(times > MANY_PLACES, 0, times))
    width = (item_high - item_low)[hit]
    p, i = texts.place[low[hit] + nth // np.maximum(width, 1)], items.place[item_low[hit] + nth % np.maximum(width, 1)]
    of = pair[hit]

    def same(at: np.ndarray, ati: np.ndarray) -> np.ndarray:
        return (texts.bare[at] == items.bare[ati]) | (texts.left[at] == items.left[ati])

    begins = ~same(p - 1, i - 1)
    for k in range(SPAN):
        begins &= same(p + k, i + k)
    rows = np.flatnonzero(begins)
    found = np.unique(np.stack([of[rows], p[rows], i[rows]]), axis=1)
    of, p, i = found
    around = np.arange(-(least + edits), least + edits + 1)
    count = np.zeros(len(p), np.int64)
    for a in range(0, len(p), 4096):
        b = slice(a, a + 4096)
        near = np.zeros((len(p[b]), len(around)), bool)
        for d in range(-edits, edits + 1):
            near |= same(p[b][:, None] + around, i[b][:, None] + around + d)
        count[b] = near.sum(1)
    keep = count >= least - least // per_edit
    return of[keep], p[keep], i[keep], np.unique(pair[times > MANY_PLACES])


def _first_passage(text: tuple[list[int], list[int]], item: tuple[list[int], list[int]], starts: list[tuple[int, int]] | None, least: int, per_edit: int, edits: int):
    """(words, edits, place in the text, place in the item) of the first passage through one of the places, or None.

    Without places, through any two equal words that begin a stretch of SPAN.
    """
    by_bare, by_left = _codes(*item)
    of_item = [by_bare[b] for b in item[0]]
    codes = [c if (c := by_bare.get(b)) is not None else by_left.get(f, -1) for b, f in zip(*text)]
    if starts is None:
        at: dict[int, list[int]] = {}
        for i, c in enumerate(of_item):
            at.setdefault(c, []).append(i)
        starts = ((p, i) for p, c in enumerate(codes) for i in at.get(c, ()) if not (p and i and codes[p - 1] == of_item[i - 1]) and codes[p : p + SPAN] == of_item[i : i + SPAN])
    for p, i in starts:
        if got := passage(codes, of_item, p, i, least, per_edit, edits):
            return *got, p, i
    return None


def verified(pairs: DataFrame, least: int, per_edit: int, edits: int) -> DataFrame:
    """The pairs of a segment and an item (both with their words, and the seeds they share) that do hold a passage."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = least + 2 * edits + SPAN
        for batch in batches:
            doc_id, segment, first, bare, left, shared, item, test_id, item_bare, item_left = (c.to_pylist() for c in batch.columns)
            texts, items = {}, {}  # (words, their number)
            of_text = np.array([texts.setdefault((d, s, b), (len(texts), (b, f)))[0] for d, s, b, f in zip(doc_id, segment, bare, left)], np.int64)
            of_item = np.array([items.setdefault(k, (len(items), (b, f)))[0] for k, b, f in zip(item, item_bare, item_left)], np.int64)
            laid, laid_items = _Laid([w for _, w in texts.values()], gap, _NO_TEXT), _Laid([w for _, w in items.values()], gap, _NO_ITEM)
            pair, p, i, many = _promising(laid, laid_items, of_text, of_item, shared, least, per_edit, edits)
            starts: dict[int, list[tuple[int, int]] | None] = {}
            for k, x, y in zip(pair.tolist(), (p - laid.begin[of_text[pair]]).tolist(), (i - laid_items.begin[of_item[pair]]).tolist()):
                starts.setdefault(k, []).append((x, y))
            rows = []
            for k, places in (starts | dict.fromkeys(many.tolist())).items():
                if got := _first_passage(laid.words(of_text[k]), laid_items.words(of_item[k]), places, least, per_edit, edits):
                    rows.append((doc_id[k], test_id[k], got[0], got[1], first[k] + got[2], got[3]))
            yield _batch(rows, FOUND_SCHEMA)

    columns = ("doc_id", "segment", "first", "bare", "left", "shared", "item", "test_id", "item_bare", "item_left")
    return pairs.select(*columns).mapInArrow(verify, FOUND_SCHEMA)


def _met(left: DataFrame, right: DataFrame, key: str, few: bool) -> DataFrame:
    """left joined with right: sent to every executor if it is few rows, else with the left's keys spread over SALTS."""
    if few:
        return left.join(F.broadcast(right), key)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "segment"), F.lit(SALTS)).cast("int"))
    return salted.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), [key, "_salt"]).drop("_salt")


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 12, per_edit: int = 6) -> DataFrame:
    """One row for each document (or segment of a very long one) and evaluation item where it holds a passage of the item.

    A passage is at least `least` consecutive words of the item, in order, of which up to one in `per_edit` is
    altered, added or dropped, beginning and ending with words in common. Case, accents, punctuation, spacing,
    markup, invisible characters and wrong decoding don't matter. n_words and n_edits describe the first passage
    found, with the fewest edits; doc_word and item_word are positions (in words) of the seed that led to it.

    documents: doc_id, text. items: test_id, text. Null or empty texts are never cases, nor are items of fewer
    than `least` words, nor rows without doc_id or test_id; repeated documents each count; a repeated test_id counts once, unless its texts differ. Extra
    columns are ignored.

    Every passage has SPAN words in a row unaltered somewhere, if `least` and `per_edit` leave that many (else they
    are refused), so it shares a seed of each mask with its item. The documents are read once; segments with a seed
    that a bit table of the items' seeds lets through are kept in the checkpoint folder. Their seeds are joined with
    the items' on the hash: the items' are sent to every executor if they are counted as few, else the documents' side is spread
    over SALTS keys and the items' repeated for them, as a seed of a copied passage may be in a third of all documents. Pairs
    of segment and item that share a seed of each mask are then verified around the seeds they share.
    """
    if any(-(-(n - n // per_edit) // (n // per_edit + 1)) < SPAN for n in range(least, 4 * least + 4 * per_edit)):
        raise ValueError("a passage needn't hold a seed under this rule")
    span, edits = longest_needed(least, per_edit)
    texts = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND length(text) > 0"), "doc_id")
    known = cut_lineage(item_seeds(items, least))
    places = known.select("item", F.explode("seed").alias("seed"))
    n, size = known.agg(F.coalesce(F.sum(F.size("seed")), F.lit(0)), F.coalesce(F.sum(F.length("bare") + F.length("left")), F.lit(0))).first()
    segments = cut_lineage(candidate_segments(texts, seed_filter(places, n), span + edits + SPAN))
    candidates = segments.select("doc_id", "segment", F.explode("seed").alias("seed"))
    met = _met(candidates, places, "seed", n <= FEW_SEEDS)
    pairs = met.groupBy("doc_id", "segment", "item").agg(F.collect_set("seed").alias("shared")).where(F.size("shared") >= len(MASKS))
    full = known.select("item", "test_id", F.col("bare").alias("item_bare"), F.col("left").alias("item_left"))
    return verified(_met(pairs, full, "item", size <= FEW_BYTES).join(segments.drop("seed").hint("merge"), ["doc_id", "segment"]), least, per_edit, edits)
