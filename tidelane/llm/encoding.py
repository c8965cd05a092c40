"""Text decoded with the wrong character encoding: find it and restore it (problem 8)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.session import spread

REPAIR_SCHEMA = "doc_id bigint, restored_text string, n_runs bigint, n_restored bigint, mappings string, restorable boolean"
REPLACEMENT = "�"

#: Code points share a symbol where single ones say little: so a pair table has at most SYMBOLS^2 cells (18 MB).
SYMBOLS = 1536 + 64 + 544 + 1
EDGE = SYMBOLS - 1


def _symbol_table() -> np.ndarray:
    """Below U+0600 each code point for itself; symbols U+2000-27FF by 32, everything else by 2048."""
    codes = np.arange(0x110000)
    other = np.where((codes >= 0x2000) & (codes < 0x2800), 1536 + ((codes - 0x2000) >> 5), 1600 + (codes >> 11))
    return np.where(codes < 1536, codes, other).astype(np.int32)


_SYMBOL = _symbol_table()


def symbols(codes: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    return _SYMBOL[codes]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_counts(documents: DataFrame) -> DataFrame:
    """How often each symbol is followed by each, over all texts; added up per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            text = "\x00".join(t for t in batch["text"].to_pylist() if t)
            if text:
                s = symbols(_codes(text))
                s[s == 0] = EDGE
                total += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=len(total))
        pairs = np.flatnonzero(total)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], names=["pair", "n"])

    return documents.select("text").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class PairModel:
    """Corpus counts of adjacent symbols, as a dense table of fixed size."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        n = np.zeros(SYMBOLS * SYMBOLS, np.float64)
        n[pairs] = counts
        n = n.reshape(SYMBOLS, SYMBOLS)
        self.total = max(float(n.sum()), 1.0)
        joint = n / self.total
        first, second = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
        self.score = self._scores(joint, first, second).astype(np.float32)
        self.first, self.second = first.reshape(-1) * self.total, second.reshape(-1) * self.total
        self.n = n.reshape(-1)
        self.log = np.log2((self.n + 0.5) / self.total).astype(np.float32)
        #: Pairs met no oftener are rare; where the corpus is small, those met nowhere.
        self.rare = max(self.total * 2.0**-16.5 - 0.5, 0.0)

    @staticmethod
    def _scores(joint: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Bits per million pairs that a pair carries of the corpus' mutual information, as a score.

        Pairs that carry much are usual; a pair that hardly occurs, or only by chance, carries (next to) nothing and
        is improbable.
        """
        with np.errstate(divide="ignore", invalid="ignore"):
            information = np.where(joint > 0, joint * np.log2(joint / (first * second)), 0.0)
        return np.clip(1.0 - np.log10(1.0 + np.maximum(information, 0) * 1e6 / 20.0), -1.0, 1.0)

    def elsewhere(self, text: str, copies: int) -> tuple[dict[int, float], dict[int, float]]:
        """Of each pair of the text, log2 frequency and score in the rest of the corpus: all its copies taken out."""
        s = symbols(_codes(text))
        pairs, own = np.unique(s[:-1] * SYMBOLS + s[1:], return_counts=True)
        n = np.maximum(self.n[pairs] - copies * own, 0)
        total = max(self.total - copies * (len(s) - 1), 1.0)
        first = np.maximum(self.first[pairs // SYMBOLS] - copies * np.bincount(s[:-1], minlength=SYMBOLS)[pairs // SYMBOLS], 0)
        second = np.maximum(self.second[pairs % SYMBOLS] - copies * np.bincount(s[1:], minlength=SYMBOLS)[pairs % SYMBOLS], 0)
        logs, scores = np.log2((n + 0.5) / self.total), self._scores(n / total, first / total, second / total)
        keys = pairs.tolist()
        return dict(zip(keys, logs.tolist())), dict(zip(keys, scores.tolist()))

    def pair_logs(self, text: str, own: dict[int, float]) -> np.ndarray:
        """log2 frequency of each pair of a changed text (own: what this document's pairs have elsewhere)."""
        s = symbols(_codes(text))
        pairs, inverse = np.unique(s[:-1] * SYMBOLS + s[1:], return_inverse=True)
        return np.array([own[p] if p in own else self.log.item(p) for p in pairs.tolist()])[inverse]

    def likelihood(self, text: str, own: dict[int, float]) -> float:
        """Mean log2 frequency of the pairs of a changed text (own: what this document's pairs have elsewhere)."""
        codes = [ord(c) for c in text]
        if len(codes) < 2:
            return -99.0
        s = [c if c < 1536 else 1536 + ((c - 0x2000) >> 5) if 0x2000 <= c < 0x2800 else 1600 + (c >> 11) for c in codes]
        total, log = 0.0, self.log
        for x, y in zip(s, s[1:]):
            pair = x * SYMBOLS + y
            value = own.get(pair)
            total += log.item(pair) if value is None else value
        return total / (len(s) - 1)


def improbable_runs(at: list[int], score: list[float], other: float) -> list[tuple[int, int]]:
    """Maximum-scoring segments [first pair, last pair], left to right.

    score[k] is that of pair number at[k]; each pair not listed scores `other` (below 0).
    """
    out, n, k = [], len(at), 0
    while k < n:
        total = score[k]
        if total <= 0:
            k += 1
            continue
        best, peak, j = total, k, k + 1
        while j < n:
            total += other * (at[j] - at[j - 1] - 1)
            if total <= 0:
                break
            total += score[j]
            if total <= 0:
                break
            if total > best:
                best, peak = total, j
            j += 1
        out.append((at[k], at[peak]))
        k = peak + 1
    return out


def _bytes_as(encoding: str) -> dict[str, int]:
    """Character to byte; bytes that the code page leaves open stand for themselves, as most decoders do."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


#: (seen as, really was): wrong decodings that are undone.
SEEN_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "koi8-r")
SINGLE = (("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "cp1250"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "koi8-r"), ("mac_roman", "cp1252"), ("cp437", "cp1252"))
DOUBLE = (("cp1252", "shift_jis"), ("cp1252", "euc_jp"), ("cp1252", "gb18030"), ("cp1252", "big5"), ("mac_roman", "shift_jis"))
TABLES = {name: _bytes_as(name) for name in {*SEEN_AS, *(a for a, _ in SINGLE + DOUBLE)}}
for _page in ("cp1252", "cp1250", "cp1251", "cp1253"):  # text that passed through two decoders mixes both
    for _b in range(0x80, 0xA0):
        TABLES[_page].setdefault(chr(_b), _b)
BYTES = {name: {ord(c): b for c, b in t.items()} for name, t in TABLES.items()}
LEAD = {name: "".join(c for c, b in t.items() if 0xC2 <= b <= 0xF4) for name, t in TABLES.items()}
FOLLOW = {name: "".join(c for c, b in t.items() if 0x80 <= b <= 0xBF) for name, t in TABLES.items()}


def _sequence(page: str) -> re.Pattern:
    """Characters whose bytes on that page are whole UTF-8 characters beyond ASCII, one after another."""
    lead = {n: re.escape("".join(c for c, b in TABLES[page].items() if low <= b <= high)) for n, low, high in ((1, 0xC2, 0xDF), (2, 0xE0, 0xEF), (3, 0xF0, 0xF4))}
    follow = re.escape(FOLLOW[page])
    return re.compile("(?:" + "|".join(f"[{lead[n]}][{follow}]{{{n}}}" for n in lead) + ")+")


SEQUENCE = {name: _sequence(name) for name in SEEN_AS}
ANY_SEQUENCE = re.compile(f"[{re.escape(''.join(LEAD[n] for n in SEEN_AS))}][{re.escape(''.join(FOLLOW[n] for n in SEEN_AS))}]")


def _decoded(piece: str, page: str) -> str | None:
    """What the bytes of the piece, as that page has them, are in UTF-8; None if they aren't UTF-8."""
    try:
        return piece.translate(BYTES[page]).encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return None


def _structural(text: str) -> list[tuple[int, int, str]]:
    """Where the text is UTF-8, seen as some page, by its structure, and what it then is."""
    if not ANY_SEQUENCE.search(text):
        return []
    chars = set(text)
    pages = [name for name in SEEN_AS if not (chars.isdisjoint(LEAD[name]) or chars.isdisjoint(FOLLOW[name]))]
    return [(*m.span(), new) for name in pages for m in SEQUENCE[name].finditer(text) if (new := _decoded(m.group(), name))]


SENTENCE_END = re.compile(r"[.!?:]\s+|\n+|。")
#: A control character U+0080-9F beside a letter is a byte that no mapping explains.
LOST = re.compile(f"[^{REPLACEMENT}]?{REPLACEMENT}+.?", re.DOTALL)
_C1 = re.compile(r"[\x80-\x84\x86-\x9f]")
CONTROL = re.compile(r"[^\W\d_][\x80-\x84\x86-\x9f]|[\x80-\x84\x86-\x9f][^\W\d_]")


def _same_case(before: str, piece: str, after: str) -> bool:
    """False if lower case letters would stand in a word of capitals."""
    left = re.search(r"[^\W\d_]*$", before).group()
    right = re.match(r"[^\W\d_]*", after).group()
    around = left + right
    return not (len(around) >= 2 and around.isupper() and any(c.islower() for c in piece))


class Repairer:
    """Undoes wrong decodings inside the improbable runs of a text."""

    def __init__(self, model: PairModel):
        self.model = model

    def suspects(self, texts: list[str], copies: list[int]) -> list[int]:
        """The texts that may hold a case, without looking closer: no other one has a run that any mapping fits.

        A mapping needs a sequence of bytes that may be UTF-8, or two pairs beyond ASCII that are rare without the text and
        its copies; what is lost shows by U+FFFD or a control character.
        """
        codes = _codes("\x00".join(texts) + "\x00")
        beyond = codes > 127
        at = np.flatnonzero(beyond[:-1] | beyond[1:])
        s = symbols(codes[np.r_[at, at + 1]]) if len(at) else np.zeros(0, np.int64)
        pair = s[: len(at)] * SYMBOLS + s[len(at) :]
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, "right")
        met, own = np.unique(text.astype(np.int64) * (SYMBOLS * SYMBOLS) + pair, return_counts=True)
        text, n = met // (SYMBOLS * SYMBOLS), self.model.n[met % (SYMBOLS * SYMBOLS)]
        few = n - np.asarray(copies)[text] * own <= self.model.rare
        rare = np.bincount(text, np.where(few, own, 0), minlength=len(texts))
        return [
            k for k, t in enumerate(texts)
            if not t.isascii() and (rare[k] >= 2 or REPLACEMENT in t or _structural(t) or (_C1.search(t) and CONTROL.search(t)))
        ]

    def runs(self, text: str, scores: dict[int, float], whole: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
        """Character ranges of improbable runs, widened to whole stretches beyond ASCII, merged where they touch.

        scores: those of the document's own pairs without its copies. Pairs inside `whole`, what is UTF-8 by its structure,
        and pairs with a lost or control character count as improbable however often they occur: near copies and
        frequent damage make them usual.
        """
        codes = _codes(text)
        if len(codes) < 2:
            return []
        beyond = codes > 127
        near = np.flatnonzero(beyond[:-1] | beyond[1:])
        s = symbols(codes[np.r_[near, near + 1]])
        pairs = (s[: len(near)] * SYMBOLS + s[len(near) :]).tolist()
        score, common = [scores.get(p) for p in pairs], self.model.score.reshape(-1)
        score = np.array([common.item(p) if x is None else x for p, x in zip(pairs, score)])
        spans = [m.span() for m in LOST.finditer(text)] + ([m.span() for m in CONTROL.finditer(text)] if _C1.search(text) else [])
        spans += [(a, b) for a, b, _ in whole]
        for a, b in spans:
            score[np.searchsorted(near, a) : np.searchsorted(near, max(b - 1, a + 1))] = 1.0
        out: list[tuple[int, int]] = []
        spans = []  # a run of a rare script may hold many sentences, of which one is damaged
        for a, b in improbable_runs(near.tolist(), score.tolist(), -0.3):
            b += 2
            while a > 0 and beyond[a - 1]:
                a -= 1
            while b < len(codes) and beyond[b]:
                b += 1
            for m in SENTENCE_END.finditer(text, a, b):
                spans.append((a, m.end()))
                a = m.end()
            spans.append((a, b))
        for a, b in sorted(spans):
            if not beyond[a:b].any():
                continue
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def _better(self, before: str, old: str, new: str, after: str, own: dict[int, float], bonus: float) -> bool:
        if any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") and not 0x80 <= ord(c) < 0xA0 for c in new):
            return False
        if unicodedata.combining(new[0]):
            return False
        if new.isspace() and (not before or before[-1].isspace()):
            return False
        if not _same_case(before, new, after):
            return False
        a, b = before[-1:], after[:1]
        return self.model.likelihood(a + new + b, own) + bonus > self.model.likelihood(a + old + b, own)

    def _fits(self, text: str, a: int, b: int, new: str, own: dict[int, float]) -> bool:
        """Does `new`, decoded from UTF-8, fit better between a and b than what stands there?"""
        common = all(ord(c) < 0x180 or 0x2010 <= ord(c) < 0x20C0 or c == "\u2122" for c in new)
        return self._better(text[max(0, a - 12) : a], text[a:b], new, text[b : b + 12], own, 7.0 if common else 4.0)

    def _utf8(self, text: str, run: str, start: int, own: dict[int, float]) -> tuple[str, str] | None:
        """Byte sequences of UTF-8 inside the run, seen as single-byte characters."""
        best = None
        for name in SEEN_AS:
            changed, out, at = 0, [], 0
            for m in SEQUENCE[name].finditer(run):
                piece, new = m.group(), _decoded(m.group(), name)
                if new is None:
                    continue
                if self._fits(text, start + m.start(), start + m.end(), new, own):
                    out.append(run[at : m.start()] + new)
                    at = m.end()
                    changed += len(piece)
            if changed and (best is None or changed > best[0]):
                best = (changed, "".join(out) + run[at:], name)
        return best and (best[1], f"utf-8 as {best[2]}")

    def _other(self, text: str, a: int, b: int, own: dict[int, float], sums: np.ndarray, rare: np.ndarray) -> tuple[str, str] | None:
        """A stretch that belongs to another code page; the gain is summed, as single letters tell little."""
        lo, hi = max(0, a - 1), min(b, len(text) - 1)
        if rare[hi] - rare[lo] < 2:  # as usual as any text of a rarer language
            return None
        run, before, after = text[a:b], text[lo:a], text[b : b + 1]
        if sum(ord(c) > 127 for c in run) < 2:
            return None
        base = float(sums[hi] - sums[lo]) * (len(run) + 1) / max(hi - lo, 1)
        best = None
        chars = set(map(ord, run))
        for seen, was in SINGLE + DOUBLE:
            if not chars <= BYTES[seen].keys():
                continue
            try:
                new = run.translate(BYTES[seen]).encode("latin-1").decode(was)
            except UnicodeDecodeError:
                continue
            # Two bytes to a character give fewer pairs: the mean is taken over as many as the run had.
            gain = self.model.likelihood(before + new + after, own) * (len(run) + 1) - base
            if new != run and gain > 12.0 and (best is None or gain > best[0]):
                best = (gain, new, f"{was} as {seen}")
        return best and best[1:]

    def _pass(self, text: str, own: dict[int, float], scores: dict[int, float]) -> tuple[str, int, int, set[str], bool]:
        """One round over all runs: (text, runs, runs restored, mappings, does a run hold lost characters)."""
        beyond = _codes(text) > 127
        logs = self.model.pair_logs(text, own)
        few = np.log2((self.model.rare + 0.5) / self.model.total) + 1e-5
        sums, rare = np.r_[0.0, np.cumsum(logs)], np.r_[0, np.cumsum((logs <= few) & (beyond[:-1] | beyond[1:]))]
        whole, lost = _structural(text), REPLACEMENT in text or (_C1.search(text) and CONTROL.search(text))
        if not lost and rare[-1] < 2 and not any(self._fits(text, a, b, new, own) for a, b, new in whole):
            return text, 0, 0, set(), False
        runs = self.runs(text, scores, whole)
        lost = bool(lost) and any(REPLACEMENT in text[a:b] or CONTROL.search(text, max(a - 1, 0), b + 1) for a, b in runs)
        out, at, changed, mappings = [], 0, 0, set()
        k = 0
        while k < len(runs):
            a, b = runs[k]
            j = k  # runs of one sentence are wrongly decoded together
            while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] <= 30 and not SENTENCE_END.search(text, max(a, runs[j][1] - 3), runs[j + 1][0]):
                j += 1
            end = runs[j][1]
            stretch = self._other(text, a, end, own, sums, rare)
            pieces = [(x, y, self._utf8(text, text[x:y], x, own) if any(a < y and x < b for a, b, _ in whole) else None) for x, y in runs[k : j + 1]]
            if stretch and any(p[2] for p in pieces):  # both fit: the likelier one
                utf8, last = [], a
                for x, y, got in pieces:
                    utf8 += [text[last:x], got[0] if got else text[x:y]]
                    last = y
                if self.model.likelihood("".join(utf8), own) >= self.model.likelihood(stretch[0], own):
                    stretch = None
            if stretch:
                out += [text[at:a], stretch[0]]
                at = end
                changed += j - k + 1
                mappings.add(stretch[1])
            else:
                for x, y, got in pieces:
                    if got:
                        out += [text[at:x], got[0]]
                        at = y
                        changed += 1
                        mappings.add(got[1])
            k = j + 1
        return "".join(out) + text[at:], len(runs), changed, mappings, lost

    def repair(self, text: str, copies: int = 1) -> tuple[str, int, int, list[str], bool] | None:
        """(restored text, improbable runs, runs restored, mappings, nothing lost), or None for an unharmed text.

        copies: how many documents of the corpus have exactly this text.
        """
        if text.isascii():
            return None
        own, scores = self.model.elsewhere(text, copies)
        mappings: set[str] = set()
        met, found, restored, lost, changed = {text}, 0, 0, False, 1
        while changed:  # wrongly decoded any number of times
            text, runs, changed, how, lost = self._pass(text, own, scores)
            found = found or runs
            if changed and text in met:  # one mapping takes back another
                lost = True
                break
            met.add(text)
            restored += changed
            mappings |= how
        if not restored and not lost:
            return None
        return text, found, restored, sorted(mappings), not lost and not self._left(text)

    @staticmethod
    def _left(text: str) -> bool:
        """Is there a sequence left that is a letter or sign of Western text in UTF-8, seen as a Western page?"""
        return any((new := _decoded(m.group(), name)) and any(0xC0 <= ord(c) < 0x180 or 0x2010 <= ord(c) < 0x2030 for c in new) for name in ("cp1252", "latin-1") for m in SEQUENCE[name].finditer(text))


_REPAIRERS: dict[str, Repairer] = {}


def _repairer(version: str, pairs: np.ndarray, counts: np.ndarray) -> Repairer:
    """Built once per Python worker, which keeps the last one only."""
    if version not in _REPAIRERS:
        _REPAIRERS.clear()
        _REPAIRERS[version] = Repairer(PairModel(pairs, counts))
    return _REPAIRERS[version]


SALTS = 32


def _with_copies(documents: DataFrame, tasks: int) -> DataFrame:
    """Each document with the number of documents of the same text; those of one text are spread over SALTS keys."""
    keyed = documents.withColumns({"_text": F.xxhash64("text"), "_salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))})
    often = keyed.groupBy("_text").agg(F.count("*").alias("copies")).where("copies > 1")
    often = often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    met = keyed.repartition(tasks, "_text", "_salt").join(often.repartition(tasks, "_text", "_salt"), ["_text", "_salt"], "left")
    return met.select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"))


def repair_documents(documents: DataFrame) -> DataFrame:
    """One row for each document whose text holds characters that came about by wrong decoding.

    Adjacent characters are scored by the mutual information they carry in the whole corpus; pairs inside what is UTF-8 by
    its structure, and pairs with U+FFFD or a control character, score as improbable whatever their number. Maximum-scoring
    segments give the runs in which inverse mappings are tried: UTF-8 seen as a single-byte page, and one page seen as
    another, again and again until none holds. A mapping holds if its result is likelier in the corpus (leaving this document
    and its copies out) and keeps the case of its word. U+FFFD shows a decoding whose bytes are lost: such a text counts,
    restorable is false, and only its other runs are restored. restorable is false, too, where a Western letter is still
    seen as its bytes, or where mappings lead in a circle.

    restored_text holds the text with all accepted mappings undone; mappings names them. Null, empty and pure
    ASCII texts are never cases; repeated rows each count; an empty table gives no rows; extra columns are ignored.

    The corpus is read three times: for pair counts, added up per task, of which at most SYMBOLS^2 reach the driver as
    one table of fixed size; for the hashes of texts that occur more than once; and to repair. Texts are shuffled once
    to meet their number of copies, a hot text by SALTS keys; to count, only where a table has few splits.
    """
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("length(text) > 0")
    counts = pair_counts(spread(documents, "doc_id")).toPandas()
    tasks = max(3 * documents.sparkSession.sparkContext.defaultParallelism, documents.rdd.getNumPartitions())
    pairs, n = counts["pair"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    version = uuid4().hex

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _repairer(version, pairs, n)
        names = [c.split()[0] for c in REPAIR_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            ids, texts, copies = (batch[c].to_pylist() for c in ("doc_id", "text", "copies"))
            out, done = [], {}  # exact copies in a batch are repaired once
            for k in worker.suspects(texts, copies):
                if texts[k] not in done:
                    done[texts[k]] = worker.repair(texts[k], copies[k])
                if got := done[texts[k]]:
                    out.append((ids[k], got[0], got[1], got[2], ", ".join(got[3]), got[4]))
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _with_copies(documents, tasks).mapInArrow(repair, REPAIR_SCHEMA)
