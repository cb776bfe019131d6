"""Evaluation texts that leaked into training text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters, digits and Han characters a shingle has; the share of an item that a passage holds at least; the share of changed characters at most.
SHINGLE, SHARE, CHANGED = 6, 0.5, 0.1
#: Items are taken in blocks of at most this many letters, which bounds what is broadcast.
BLOCK_LETTERS = 2_000_000
#: Texts are put together up to so many characters at a time.
CHUNK_CHARS = 400_000

BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """For every code point what it counts as: its lower-case letter or digit of usual width, or 0 for marks, blanks and the rest."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000 or (cp >= 128 and unicodedata.category(c)[0] not in "LN"):
            continue
        n = unicodedata.normalize("NFKC", c)
        n = (n if len(n) == 1 else c).lower()
        if c.isalnum() and len(n) >= 1 and n[0].isalnum():
            out[cp] = ord(n[0])
    return out


def letters(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts in one array, and where each text begins in it (one more entry than texts)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    mapped = table[points]
    kept = np.concatenate([[0], np.cumsum(mapped > 0)])
    ends = np.cumsum([0] + [len(t) for t in texts])
    return mapped[mapped > 0], kept[ends]


def shingles(flat: np.ndarray, starts: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position in the text) of every shingle that lies within one text."""
    n = len(flat) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * BASE + flat[k : k + n]
    h ^= h >> np.uint64(29)
    at = np.arange(n)
    text = np.searchsorted(starts, at, "right") - 1
    inside = at + q <= starts[text + 1]
    return h[inside], text[inside], (at - starts[text])[inside]


def within(pattern: list[int], text: list[int], k: int) -> bool:
    """Whether some stretch of the text is at most k changes (a character put in, left out or replaced) away from the pattern; bit-parallel."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, score = mask, 0, m
    for c in text:
        e = eq.get(c, 0)
        xv, xh = e | mv, (((e & pv) + pv) ^ pv) | e
        ph, mh = (mv | ~(xh | pv)) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= k:
            return True
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
    return False


class Items:
    """A block of items with their shingles; `narrow` adds which of them are prefix shingles."""

    def __init__(self, ids: list[int], texts: list[str], table: np.ndarray, q: int = SHINGLE, share: float = SHARE, changed: float = CHANGED) -> None:
        self.ids, self.q, self.table = np.array(ids, np.int64), q, table
        self.flat, self.starts = letters(texts, table)
        self.size = np.diff(self.starts)
        # for each number of changes the shortest passage that may have them: one that holds a longer passage's changes lies within that
        self.passages = [self._passages(int(n), share, changed) for n in self.size]
        # a passage of w letters with e changes keeps at least w - q + 1 - q * e of its shingles
        kept = lambda w, e: w - q + 1 - q * e
        self.short = self._short([[p for p in own if kept(*p) < 1] for own in self.passages])
        self.passages = [[(w, e, kept(w, e)) for w, e in own if kept(w, e) >= 1] for own in self.passages]
        self.least = np.array([min((k for _, _, k in own), default=np.iinfo(np.int64).max) for own in self.passages], np.int64)
        h, self.item, self.pos = shingles(self.flat, self.starts, q)
        self.hashes, self.which = np.unique(h, return_inverse=True)
        order = np.argsort(self.which, kind="stable")
        self.posting = order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.which, minlength=len(self.hashes)))])
        self.prefix = np.ones(len(self.hashes), bool)

    @staticmethod
    def _passages(n: int, share: float, changed: float) -> list[tuple[int, int]]:
        """(length, changes) of the shortest passages, from the share of an item of n letters to all of it, for each number of changes."""
        lengths = np.arange(int(np.ceil(n * share)), n + 1) if n else np.zeros(0, np.int64)
        edits, first = np.unique(np.floor(lengths * changed + 1e-9).astype(np.int64), return_index=True)
        return list(zip(lengths[first].tolist(), edits.tolist(), strict=True))

    def _short(self, passages: list[list[tuple[int, int]]]) -> list[tuple]:
        """For passages that need keep none of their shingles, tables of shorter ones: of e + 1 equal pieces of a passage with e changes
        one is whole. A table by length of the pieces: (length, their hashes in order, the item and passage of each)."""
        out: dict[int, list] = {}
        for i, own in enumerate(passages):
            for w, e in own:
                q = w // (e + 1)
                flat = self.flat[self.starts[i] : self.starts[i + 1]]
                out.setdefault(q, []).extend((int(x), i, w, e) for x in np.unique(shingles(flat, np.array([0, len(flat)]), q)[0]))
        tables = []
        for q, rows in sorted(out.items()):
            rows.sort()
            tables.append((q, np.array([r[0] for r in rows], np.uint64), [r[1:] for r in rows]))
        return tables

    def _found_short(self, flat: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(index of the text, index of the item) of the texts that hold a passage which need keep no shingle."""
        out: set[tuple[int, int]] = set()
        for q, hashes, passages in self.short:
            h, text, pos = shingles(flat, starts, q)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                t, at = int(text[k]), int(pos[k])
                own = flat[starts[t] : starts[t + 1]]
                for i, w, e in passages[lo[k] : hi[k]]:
                    if (t, i) not in out:
                        region = own[max(0, at - w - e) : at + q + w + e].tolist()
                        x = self.flat[self.starts[i] : self.starts[i + 1]].tolist()
                        if any(within(x[a : a + w], region, e) for a in range(len(x) - w + 1)):
                            out.add((t, i))
        return out

    def narrow(self, frequency: np.ndarray) -> None:
        """Keeps as prefix shingles those that, of some passage's shingles in order of rarity, come before as many most frequent ones as it keeps at least."""
        prefix = np.zeros(len(self.hashes), bool)
        # shingles come item by item
        edges = np.searchsorted(self.item, np.arange(len(self.ids) + 1))
        for i in range(len(self.ids)):
            codes = self.which[edges[i] : edges[i + 1]]
            if not len(codes):
                continue
            rank = np.empty(len(codes), np.int64)
            rank[np.lexsort((codes, frequency[codes]))] = np.arange(len(codes))
            for w, _, kept in self.passages[i]:
                windows = np.lib.stride_tricks.sliding_window_view(rank, w - self.q + 1)
                need = windows.shape[1] - kept
                # a position is needed if it is among the first of any window that holds it
                bound = np.partition(windows, need, axis=1)[:, need]
                row, col = np.nonzero(windows <= bound[:, None])
                prefix[codes[np.unique(row + col)]] = True
        self.prefix = prefix

    def frequency(self, texts: list[str]) -> np.ndarray:
        """In how many of the texts each shingle occurs."""
        flat, starts = letters(texts, self.table)
        h, text, _ = shingles(flat, starts, self.q)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        pairs = np.unique(text[hit] * np.int64(len(self.hashes)) + at[hit])
        return np.bincount(pairs % len(self.hashes), minlength=len(self.hashes)) if len(pairs) else np.zeros(len(self.hashes), np.int64)

    def found(self, texts: list[str]) -> list[tuple[int, int]]:
        """(index of the text, index of the item) of every text that holds a passage of an item."""
        flat, starts = letters(texts, self.table)
        out = sorted(self._found_short(flat, starts))
        h, text, pos = shingles(flat, starts, self.q)
        if not len(h) or not len(self.hashes):
            return out
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        at, text, pos = at[hit], text[hit], pos[hit]
        width = np.int64(len(self.ids))

        def expand(sel):
            n = self.first[at[sel] + 1] - self.first[at[sel]]
            rows = np.repeat(np.arange(len(sel)), n)
            within_run = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            posting = self.posting[self.first[at[sel]][rows] + within_run]
            return sel[rows], posting

        # texts and items that share a prefix shingle, then all that these pairs share
        rows, posting = expand(np.flatnonzero(self.prefix[at]))
        candidates = np.unique(text[rows] * width + self.item[posting])
        if not len(candidates):
            return out
        rows, posting = expand(np.flatnonzero(np.isin(text, np.unique(candidates // width))))
        key = text[rows] * width + self.item[posting]
        use = np.isin(key, candidates)
        rows, posting, key = rows[use], posting[use], key[use]
        order = np.argsort(key, kind="stable")
        rows, posting, key = rows[order], posting[order], key[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i = int(key[a] % width)
            at_item, at_text, own = self.pos[posting[a:b]], pos[rows[a:b]], flat[starts[key[a] // width] : starts[key[a] // width + 1]]
            if any(b - a >= kept and self._holds(i, w, e, kept, at_item, at_text, own) for w, e, kept in self.passages[i]):
                out.append((int(key[a] // width), i))
        return sorted(set(out))

    def _holds(self, i: int, w: int, e: int, least: int, at: np.ndarray, there: np.ndarray, text: np.ndarray) -> bool:
        """Whether the text holds a passage of w letters of item i with e changes. Shared shingles must lie near one diagonal, at least `least` of them in the passage."""
        q, step = self.q, max(1, e)
        diagonal = there - at
        item = self.flat[self.starts[i] : self.starts[i + 1]]
        n = max(1, w - q + 1)
        tried = set()
        bands = np.unique(np.concatenate([diagonal // step, diagonal // step - 1]))
        for band in bands.tolist():
            lo, hi = band * step, band * step + 2 * step
            own = at[(diagonal >= lo) & (diagonal < hi)]
            if len(own) < least:
                continue
            seen = np.zeros(len(item) - q + 1, np.int64)
            seen[own] = 1
            total = np.concatenate([[0], np.cumsum(seen)])
            count = total[n:] - total[:-n]
            for start in np.argsort(-count, kind="stable").tolist():
                if count[start] < least:
                    break
                if (start, band) in tried:
                    continue
                tried.add((start, band))
                region = text[max(0, start + lo - e) : max(0, start + w + hi + e)]
                if len(region) >= w - e and within(item[start : start + w].tolist(), region.tolist(), e):
                    return True
        return False


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            ids.append(key)
            texts.append(text)
            size += len(text)
        if size >= CHUNK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, changed: float = CHANGED, q: int = SHINGLE, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(doc_id, item_id) of every document that holds one running passage of at least `share` of an item's letters, digits and
    Han characters with at most `changed` of them changed, whatever its case, width, spacing, punctuation and marks.

    Passages of every length from the share on are searched, each with its own number of changes.
    A prefix-filtered set join: the shingles of every such passage are ordered by how many documents hold them, counted over
    all documents; a document is a candidate only if it holds a shingle of a passage's prefix, that is one of those before the
    most frequent ones that a passage with all allowed changes keeps at least. Of a candidate's shared shingles enough must
    lie in one window and near one diagonal (length and position bounds); last, the window is searched in that place of the
    document with the exact number of changes. Passages so short that their changes may leave no shingle whole are met by
    shorter ones, one of which is whole.

    documents (doc_id, text) are read twice and never shuffled, whatever their sources' sizes. items (item_id, text) are a
    stated query set; they are taken in blocks of at most `block_letters` letters, so what is broadcast is bounded, and each
    block meets all documents.

    Edge cases: null and empty texts hold nothing; an item without letters is never found; an item that comes twice counts
    once; a document of any length is searched whole; equal documents are rows of their own; an empty table gives no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null and text is not null and text != ''")
    table = letter_table()
    out = None
    for block in _blocks(items, block_letters):
        base = Items([r[0] for r in block], [r[1] for r in block], table, q, share, changed)
        shipped = spark.sparkContext.broadcast(base)

        def count(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shipped.value.hashes), np.int64)
            for batch in batches:
                for _, texts in _chunks(batch):
                    total += shipped.value.frequency(texts)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["shingle", "n"])

        # one row a shingle of the block, so no more than block_letters rows come to the driver
        frequency = np.zeros(len(base.hashes), np.int64)
        for shingle, n in docs.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n")).toLocalIterator():
            frequency[shingle] = n
        shipped.unpersist()
        base.narrow(frequency)
        narrowed = spark.sparkContext.broadcast(base)

        def search(batches: Iterator[pa.RecordBatch], shipped=narrowed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, texts in _chunks(batch):
                    if pairs := shipped.value.found(texts):
                        yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t, _ in pairs], pa.int64()), pa.array([int(shipped.value.ids[i]) for _, i in pairs], pa.int64())], ["doc_id", "item_id"])

        part = docs.mapInArrow(search, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint")


def _blocks(items: DataFrame, block_letters: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks, one partition at a time."""
    block, size = [], 0
    rows = items.filter("item_id is not null and text is not null and text != ''").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min("text").alias("text"))
    for item_id, text in rows.toLocalIterator():
        if block and size + len(text) > block_letters:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block
