"""Text that was decoded with the wrong character encoding, and the way back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dictionaries are fitted on at most so many documents, chosen by a hash of their keys, on none longer than LONGEST_SAMPLE and on
#: SAMPLE_CHARS characters in all.
SAMPLE_DOCS, LONGEST_SAMPLE, SAMPLE_CHARS = 4_000, 20_000, 8_000_000
#: Bytes of a dictionary, and of each step of a chain of decodings in a description.
DICTIONARY_BYTES, STEP_BYTES = 65_536, 2
#: Below so many bytes zstandard makes one block of a text.
ONE_BLOCK = 100_000
#: Texts are taken together up to about so many characters.
CHARS_AT_ONCE = 100_000
#: Bits of the hashes of four bytes in dictionaries and within a text; bytes that are looked at at once for a bound.
HASH_BITS, FIRST_BITS, BOUND_BYTES = 21, 13, 65_536
_N_LOG_N = np.append(0.0, np.arange(1, ONE_BLOCK + 1) * np.log2(np.arange(1, ONE_BLOCK + 1)))
#: Decodings in a row that are undone at most.
DEPTH = 3
#: Tasks a core among which texts that may be garbled are spread.
WAVES = 4
LOST = "\ufffd"
#: What the UTF-8 bytes of two lost characters look like when they are read as GBK.
LOST_TWICE = "锟斤拷"
LANGUAGES = ("zh", "en", "de", "fr", "ja", "ru", "pt")

#: Single-byte encodings that bytes of other encodings were read with.
SINGLE = ("cp1252", "latin-1", "cp437", "koi8-r", "cp1251", "cp866", "cp850", "mac_roman", "iso8859-15", "iso8859-2", "cp1250")
#: Encodings of the bytes that were read as Western single bytes, beside UTF-8.
EAST = ("gb18030", "big5", "cp932", "euc_jp", "cp949")
CYRILLIC = ("cp1251", "koi8-r", "cp866")
CYRILLIC_PAIRS = tuple((a, b) for a in CYRILLIC for b in CYRILLIC if a != b)
#: Multi-byte encodings that UTF-8 was read with.
MULTI = ("gb18030", "big5", "cp932", "cp949")


def _upper_half(codec: str) -> dict[str, int]:
    """The characters that a single-byte encoding has for the bytes from 0x80; those it leaves open stand for themselves, as many decoders have it."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


HALF = {c: _upper_half(c) for c in SINGLE}


CYRILLIC_TEXT = re.compile("[Ѐ-ӿ─-▟]+")
CYRILLIC_WORD = re.compile("[А-ЯЁ]?[а-яё]*|[А-ЯЁ]+")
NON_ASCII = re.compile("[^\x00-\x7f]{4,}")
NON_ASCII_RUN = re.compile("([^\x00-\x7f]+)")


def _classes() -> tuple[str, str, str, str]:
    """Character classes of UTF-8 read as GBK: (lead byte and continuation, continuation and lead, two continuations, continuation and ASCII)."""
    lead, cont = range(0xE2, 0xF0), range(0x80, 0xC0)
    pairs = ((lead, cont), (cont, lead), (cont, cont), (cont, range(0x40, 0x7F)))
    out = []
    for first, second in pairs:
        chars = []
        for a in first:
            for b in second:
                try:
                    c = bytes([a, b]).decode("gbk")
                except UnicodeDecodeError:
                    continue
                chars.append(re.escape(c))
        out.append("[" + "".join(chars) + "]")
    return tuple(out)


_S1, _S2, _S3, _SA = _classes()
GBK_UTF8 = re.compile(f"(?:{_S1}{_S2}{_S3}|{_S1}{_SA})*{_S1}{_S2}{_S3}(?:{_S1}{_S2}{_S3}|{_S1}{_SA})*")
HAN = re.compile("[㐀-鿿]")
KANA = re.compile("[぀-ヿ]")
CYR = re.compile("[Ѐ-ӿ]")


def _table(half: dict[str, int]) -> np.ndarray:
    """The bytes of a single-byte encoding's characters beyond ASCII, by code point; 0 for all others."""
    out = np.zeros(0x10000, np.uint8)
    for c, b in half.items():
        out[ord(c)] = b
    return out


TABLE = {c: _table(half) for c, half in HALF.items()}
#: For each code point a bit for each of SINGLE: whether its byte begins a longer UTF-8 character, and whether it goes on one.
FIRST_BYTE, NEXT_BYTE = (sum(((t >= a) & (t <= z)).astype(np.uint16) << k for k, t in enumerate(TABLE.values())) for a, z in ((0xC2, 0xF4), (0x80, 0xBF)))
#: Bytes of Western characters, those that cp1252 leaves open included, and of ASCII.
WEST = _table({chr(b): b for b in range(0x100)} | HALF["cp1252"])
WEST_RUN = re.compile(rb"[\x80-\xff]{4,}")
WEST_PAIRS = re.compile(rb"(?:[\x80-\xff][\x80-\xff@-~])+")
#: What the bytes from 0x80 are in the Cyrillic encodings; a byte's own value below.
FROM_BYTE = {c: np.array([ord(bytes([b]).decode(c, "replace")) for b in range(0x100)], np.uint32) for c in CYRILLIC}
#: For each pair of CYRILLIC_PAIRS what a character that was read with the first is in the second, by code point; 0 where there is none.
OTHER_LETTER = {(a, b): np.where((TABLE[a] > 0) & (FROM_BYTE[b][TABLE[a]] != ord(LOST)), FROM_BYTE[b][TABLE[a]], 0).astype(np.uint32) for a, b in CYRILLIC_PAIRS}


def _usual(text: str) -> bool:
    """Whether it may be Chinese: Han characters, and of those most in the basic set, beside ASCII, punctuation and wide forms."""
    basic = 0
    for c in text:
        if not ("一" <= c <= "鿿" or c < "\x80" or " " <= c <= "〿" or "！" <= c <= "￥"):
            return False
        try:
            c.encode("gb2312")
            basic += 1
        except UnicodeEncodeError:
            pass
    return basic * 3 >= len(text) * 2


def _reread(run: str, read_as: str, is_in: str, usual: bool = False) -> str:
    """A run that was read with one encoding and is in another; as it is where that can't be, or isn't usual."""
    try:
        t = run.encode(read_as).decode(is_in)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return run
    return t if not usual or _usual(t) else run


@lru_cache(None)
def _first(codec: str) -> frozenset[str]:
    """Characters whose bytes in an encoding begin as those of a longer UTF-8 character do: with any other a run can't be UTF-8.
    Without a name, those of all MULTI but the first."""
    if not codec:
        return frozenset().union(*map(_first, MULTI[1:]))
    out = set()
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        try:
            b = c.encode(codec)
        except UnicodeEncodeError:
            continue
        if 0xC2 <= b[0] <= 0xF4 and (len(b) == 1 or 0x80 <= b[1] <= 0xBF):
            out.add(c)
    return frozenset(out)


def _decoded(raw: bytes) -> list[tuple[int, str]]:
    """(number in EAST, the text) for each of the Eastern encodings that bytes can be in."""
    out = []
    for j, codec in enumerate(EAST):
        try:
            out.append((j, raw.decode(codec)))
        except UnicodeDecodeError:
            pass
    return out


# of short runs only, which come again and bound the memory
_decoded_short = lru_cache(20_000)(_decoded)


class _Texts:
    """Texts side by side as code points, a line end after each, which no wrong decoding makes or changes."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        joined = "".join(t + "\n" for t in texts)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.minimum(self.points, 0xFFFF).astype(np.intp)
        size = np.array([len(t) for t in texts])
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        self.at = np.append(self.at, np.zeros(3, np.intp))
        self.firsts = np.flatnonzero(FIRST_BYTE[self.at[:-1]] & NEXT_BYTE[self.at[1:]])
        self.codecs = FIRST_BYTE[self.at[self.firsts]] & NEXT_BYTE[self.at[self.firsts + 1]]

    def holding(self, at: np.ndarray) -> list[int]:
        """The texts in which any of the ascending positions is."""
        return np.flatnonzero(np.diff(np.searchsorted(at, np.append(self.start, len(self.points))))).tolist()

    def within(self, first: int, last: int) -> list[int]:
        return self.holding(np.flatnonzero((self.points >= first) & (self.points <= last)))

    def from_single(self, codec: str) -> dict[int, str]:
        """Texts with all UTF-8 sequences undone that were read with a single-byte encoding, by number, of those that have any.

        A first byte and the bytes after it are of different ranges, so sequences never overlap. What has a sequence's form but
        is no character, such as a surrogate, has each of its bytes lost.
        """
        at = self.firsts[self.codecs & (1 << SINGLE.index(codec)) != 0]
        if not len(at):
            return {}
        one, two, three, four = (TABLE[codec][self.at[at + k]].astype(np.uint32) for k in range(4))
        more = [x & 0xC0 == 0x80 for x in (three, four)]
        long, longest = (one >= 0xE0) & (one < 0xF0), one >= 0xF0
        right = (one < 0xE0) | long & more[0] & ((one != 0xE0) | (two >= 0xA0)) | longest & more[0] & more[1] & ((one != 0xF0) | (two >= 0x90))
        at, one, two, three, four, long, longest = (x[right] for x in (at, one, two, three, four, long, longest))
        if not len(at):
            return {}
        two, three, four = two & 0x3F, three & 0x3F, four & 0x3F
        value = np.where(longest, (one & 7) << 18 | two << 12 | three << 6 | four, np.where(long, (one & 15) << 12 | two << 6 | three, (one & 31) << 6 | two))
        none = (value > 0x10FFFF) | long & (value >= 0xD800) & (value <= 0xDFFF)
        points, keep = self.points.copy(), np.ones(len(self.points), bool)
        points[at] = value
        for k, has in ((1, ~none), (2, (long | longest) & ~none), (3, longest & ~none)):
            keep[at[has] + k] = False
        for k, has in ((0, none), (1, none), (2, none), (3, none & longest)):
            points[at[has] + k] = 0xFFFD
        whole = points[keep].tobytes().decode("utf-32-le", "surrogatepass")
        gone = np.flatnonzero(~keep)
        first, last = (x - np.searchsorted(gone, x) for x in (self.start, self.end))
        return {i: whole[first[i] : last[i]] for i in self.holding(at)}

    def from_west(self) -> tuple[dict[int, list[str]], dict[str, dict[int, str]]]:
        """Of texts with four Western characters in a row: undone for each of EAST in the runs of pairs that can be, and for each of
        CYRILLIC in all places, if no character is lost or comes out so."""
        raw = WEST[self.at[:-3]]
        raw_bytes = raw.tobytes()
        some = [i for i, (a, z) in enumerate(zip(self.start.tolist(), self.end.tolist(), strict=True)) if WEST_RUN.search(raw_bytes, a, z)]
        east: dict[int, list[str]] = {}
        for i in some:
            text, a = self.texts[i], int(self.start[i])
            places: list[list[tuple[int, int, str]]] = [[] for _ in EAST]
            for m in WEST_PAIRS.finditer(raw_bytes, a, int(self.end[i])):
                k, n = m.span()
                for j, t in (_decoded_short if n - k <= 64 else _decoded)(m.group()):
                    places[j].append((k - a, n - a, t))
            east[i] = [_replaced(text, p) if p else text for p in places]
        cyrillic: dict[str, dict[int, str]] = {}
        if some:
            high = raw >= 0x80
            for codec in CYRILLIC:
                points = np.where(high, FROM_BYTE[codec][raw], self.points)
                whole = points.tobytes().decode("utf-32-le", "surrogatepass")
                lost = set(self.holding(np.flatnonzero(points == 0xFFFD)))
                cyrillic[codec] = {i: whole[self.start[i] : self.end[i]] for i in some if i not in lost}
        return east, cyrillic

    def other_letters(self) -> list[list[str]]:
        """For each of CYRILLIC_PAIRS all texts with the runs of three or more Cyrillic letters undone that can be."""
        p = self.points
        at = np.flatnonzero((p >= 0x400) & (p <= 0x4FF) | (p >= 0x2500) & (p <= 0x259F))
        if not len(at):
            return [self.texts for _ in CYRILLIC_PAIRS]
        begin = np.flatnonzero(np.append(True, np.diff(at) > 1))
        size = np.diff(np.append(begin, len(at)))
        out = []
        for pair in CYRILLIC_PAIRS:
            value, points = OTHER_LETTER[pair][p[at]], p.copy()
            right = np.repeat((np.minimum.reduceat(value, begin) > 0) & (size >= 3), size)
            points[at[right]] = value[right]
            whole = points.tobytes().decode("utf-32-le", "surrogatepass")
            out.append([whole[a:z] for a, z in zip(self.start.tolist(), self.end.tolist(), strict=True)])
        return out

    def steps(self) -> list[list[tuple[str, str]]]:
        """What steps() has, for each text."""
        single = {codec: self.from_single(codec) for codec in SINGLE}
        east, cyrillic = self.from_west()
        han, kana, cyr = (set(self.within(ord(a), ord(z))) for a, z in ("㐀鿿", "぀ヿ", "Ѐӿ"))
        top = np.maximum.reduceat(self.points, self.start).tolist()
        every, letters = [], None
        for i, text in enumerate(self.texts):
            out = []
            russian = i in cyr and i not in han and fine_cyrillic(text)
            for codec in SINGLE:
                if not (russian and codec in CYRILLIC) and i in single[codec]:
                    out.append((f"utf-8 as {codec}", single[codec][i]))
            if i in east:
                out += [(f"{codec} as cp1252", t) for codec, t in zip(EAST, east[i], strict=True)]
                out += [(f"{codec} as cp1252", cyrillic[codec][i]) for codec in CYRILLIC if i in cyrillic[codec]]
            if i in han and GBK_START.search(text):
                out.append(("utf-8 as gbk", GBK_UTF8.sub(lambda m: _reread(m.group(), "gbk", "utf-8", True), text)))
            if i in han or i in kana or 0xFF71 <= top[i] <= 0xFF9F:
                runs = [m for m in NON_ASCII.finditer(text) if text[m.start()] in _first("")]
                for codec in MULTI[1:] if runs else ():
                    out.append((f"utf-8 as {codec}", _replaced(text, [(*m.span(), _reread(m.group(), codec, "utf-8")) for m in runs if text[m.start()] in _first(codec)])))
            if not russian and i in cyr and i not in han:
                letters = letters or self.other_letters()
                out += [(f"{b} as {a}", t[i]) for (a, b), t in zip(CYRILLIC_PAIRS, letters, strict=True)]
            if i in han:
                out.append(("utf-8 as gb18030", _west_in_gbk(text)))
            every.append([(name, t) for name, t in out if t != text])
        return every


#: Where GBK_UTF8 is anywhere.
GBK_START = re.compile(_S1 + _S2 + _S3)


def _replaced(text: str, places: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for a, z, t in places:
        out += (text[done:a], t)
        done = z
    return "".join(out) + text[done:]


def steps(text: str) -> list[tuple[str, str]]:
    """(name of a wrong decoding, the text with every place undone that this decoding can have made), for all that change anything."""
    return [] if text.isascii() else _Texts([text]).steps()[0]


def all_steps(texts: list[str]) -> Iterator[list[tuple[str, str]]]:
    """What steps() has, for each of many texts."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n > CHARS_AT_ONCE:
            yield from _Texts(some).steps()
            some, n = [], 0
    if some:
        yield from _Texts(some).steps()


def _west_in_gbk(text: str) -> str:
    """UTF-8 of letters of two bytes and of kana that was read as GB 18030: undone only if all of the text's runs beyond ASCII can be."""
    out = []
    for part in NON_ASCII_RUN.split(text):
        if part and not part.isascii():
            if part[0] not in _first("gb18030"):
                return text
            try:
                part = part.encode("gb18030").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return text
        out.append(part)
    return "".join(out)


class Cost:
    """Bytes of a text's description: the smallest of its compressions with each language's dictionary."""

    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        self.raw = {}
        for language, texts in samples.items():
            raw, whole = None, sum(map(len, texts))
            if len(texts) >= 20 and whole > 8_000:
                try:
                    raw = zstandard.train_dictionary(min(DICTIONARY_BYTES, whole // 4), texts).as_bytes()
                except zstandard.ZstdError:
                    raw = None
            if raw is None and whole:
                raw = b"\n".join(texts)[-DICTIONARY_BYTES:]
            if raw:
                self.raw[language] = raw
        self.made = self.held = None

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "made": None, "held": None}

    def __call__(self, text: str) -> int:
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[int]:
        """Of many texts, one dictionary after another, so that its tables stay in the processor's cache."""
        if self.made is None:
            options = zstandard.ZstdCompressionParameters.from_level(3, write_checksum=False, write_content_size=False, write_dict_id=False)
            self.made = {}
            for k, v in self.raw.items():
                ready = zstandard.ZstdCompressionDict(v)
                ready.precompute_compress(compression_params=options)
                self.made[k] = zstandard.ZstdCompressor(dict_data=ready, compression_params=options)
            self.made[""] = zstandard.ZstdCompressor(compression_params=options)
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        plain = self.made[""].compress
        out = [len(plain(raw)) for raw in raws]
        for k in self.raw:
            compress = self.made[k].compress
            for i, raw in enumerate(raws):
                if _may_be(k, texts[i]) and (n := len(compress(raw))) < out[i]:
                    out[i] = n
        return out

    def at_least(self, texts: list[str]) -> list[float]:
        """Bytes that no description of each text goes below, so that one known to be shorter needs no compression of it.

        A copy of zstandard's level 3 is of four bytes or more, from the dictionary or from before in the text. A byte of which
        all four windows of four bytes are in no dictionary and for the first time in the text is therefore a literal, and
        a block has one prefix code, or none, for its literals: no part of them takes less than its entropy. Windows are told apart by a hash, which
        only makes fewer literals. The copies that begin in a dictionary and end in the text have three windows at most.
        """
        if self.held is None:
            self.held = np.zeros(1 << HASH_BITS, bool)
            for raw in self.raw.values():
                self.held[_upper(_windows(raw), HASH_BITS)] = True
        out: list[float] = []
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        a = 0
        while a < len(raws):
            z, whole = a + 1, len(raws[a])
            while z < len(raws) and z - a < 64 and whole + len(raws[z]) < BOUND_BYTES:
                whole += len(raws[z])
                z += 1
            out += self._at_least(raws[a:z]) if max(map(len, raws[a:z])) < ONE_BLOCK else [0.0] * (z - a)
            a = z
        return out

    def _at_least(self, raws: list[bytes]) -> list[float]:
        whole = b"".join(raws) + bytes(4)
        h = _windows(whole)[:-1]
        of = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
        new = ~self.held[_upper(h, HASH_BITS)]
        key, at = _upper(h, FIRST_BITS) + (of << FIRST_BITS), np.arange(len(h), dtype=np.int32)
        first = np.empty(len(raws) << FIRST_BITS, np.int32)
        first[key[::-1]] = at[::-1]
        new &= first[key] == at
        literal = new.copy()
        for k in (1, 2, 3):
            literal[k:] &= new[:-k]
        counts = np.bincount((of[literal] << 8) + np.frombuffer(whole, np.uint8)[:-4][literal], minlength=len(raws) << 8).reshape(len(raws), 256)
        n = counts.sum(1)
        bits = _N_LOG_N[n] - _N_LOG_N[counts].sum(1)
        return np.maximum(0, (bits - 12 * (np.log2(np.maximum(n, 1)) + 1.5)) / 8 - 0.01).tolist()


def _upper(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint32(32 - bits)).astype(np.intp)


def _windows(raw: bytes) -> np.ndarray:
    """A hash of each four bytes in a row."""
    return np.ndarray((max(0, len(raw) - 3),), "<u4", raw, strides=(1,)) * np.uint32(0x9E3779B1)


def _may_be(language: str, text: str) -> bool:
    """Whether a dictionary is worth trying; scripts that only some languages have decide."""
    if language == "ru":
        return bool(CYR.search(text))
    if language == "ja":
        return bool(KANA.search(text))
    if language == "zh":
        return bool(HAN.search(text))
    return True


def restore(text: str, cost) -> tuple[str, list[str]]:
    """(text, chain): the text with the chain of decodings undone that gives the shortest description, the chain's own cost
    included; the text as it is and no chain if none is shorter.

    Every distinct text of every level is a candidate; none is pruned for what it came from, as what lies between a text and
    its restoration may have the longest description of the three. Where `cost` can tell what a description takes at least
    (`at_least`), a text that takes more than the best at least isn't compressed; the result is the same.
    """
    chains, came, levels = {text: []}, {text: text}, [[text]]
    while levels[-1] and len(levels) <= DEPTH:
        following = []
        for t, undone in zip(levels[-1], all_steps(levels[-1]), strict=True):
            for name, u in undone:
                if u not in chains:
                    chains[u], came[u] = chains[t] + [name], t
                    following.append(u)
        levels.append(following)
    if len(chains) == 1:
        return text, []
    all_of, at_least = getattr(cost, "all", lambda texts: [cost(t) for t in texts]), getattr(cost, "at_least", None)

    def least_of(texts: list[str]) -> tuple[int, int, str]:
        return min((n + STEP_BYTES * len(chains[t]), len(chains[t]), t) for n, t in zip(all_of(texts), texts, strict=True))

    best = least_of(levels[0] + levels[1])
    bounds = dict(zip(levels[0] + levels[1], at_least(levels[0] + levels[1]), strict=True)) if at_least and levels[2:] else {}
    for level in levels[2:]:
        # most texts are as what they came from, but for places; if its bound tells nothing, theirs would cost more than they save
        bounded = [t for t in level if bounds.get(came[t], 0) > best[0]]
        plain = [t for t in level if bounds.get(came[t], 0) <= best[0]]
        if plain:
            best = min(best, least_of(plain))
        if bounded:
            bounds |= zip(bounded, at_least(bounded), strict=True)
            bounded.sort(key=lambda t: bounds[t])
            for a in range(0, len(bounded), 16):
                if some := [t for t in bounded[a : a + 16] if bounds[t] + STEP_BYTES * len(chains[t]) <= best[0]]:
                    best = min(best, least_of(some))
    return best[2], chains[best[2]]


def is_lost(text: str) -> bool:
    return LOST in text or LOST_TWICE in text


def fine_cyrillic(text: str) -> bool:
    """Whether all words of Cyrillic letters have capitals as words have them; letters read another way do not."""
    return all(CYRILLIC_WORD.fullmatch(w) for w in CYRILLIC_TEXT.findall(text))


def is_clean(text: str) -> bool:
    """No sign of garbling. Cyrillic letters can always be read another way, so there the words' capitals decide."""
    if is_lost(text):
        return False
    if CYR.search(text) and not HAN.search(text):
        return fine_cyrillic(text)
    return not steps(text)


def _documents(df: DataFrame) -> DataFrame:
    return df.filter("doc_id is not null and text is not null and text != ''")


def fitted(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Cost:
    """Dictionaries by language, from at most `sample_docs` documents of all sources, of which those with a sign of garbling are left out.

    The sample is what a bounded fit may be; the search for garbled text covers all documents.
    """
    docs = _documents(documents)
    chosen = docs.filter(F.length("text") <= LONGEST_SAMPLE).select(F.col("doc_id").alias("chosen"), F.xxhash64("doc_id").alias("h"), F.length("text").alias("n")).orderBy("h", "chosen").limit(sample_docs)
    # the window is over the sample's rows
    chosen = chosen.withColumn("n", F.sum("n").over(Window.orderBy("h", "chosen"))).filter(F.col("n") <= SAMPLE_CHARS)
    rows = docs.join(F.broadcast(chosen.select("chosen")), F.col("doc_id") == F.col("chosen"), "left_semi").select(F.lower(F.substring("lang", 1, 2)).alias("lang"), "text").collect()
    samples: dict[str, list[bytes]] = {}
    for lang, text in sorted(rows, key=lambda r: r[1]):
        if is_clean(text):
            script = "ru" if CYR.search(text) and not HAN.search(text) else "ja" if KANA.search(text) else "zh" if HAN.search(text) else lang if lang in LANGUAGES[1:] else "en"
            samples.setdefault(script, []).append(text.encode("utf-8", "surrogatepass"))
    return Cost(samples)


def garbled(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, restored, chain, lost) of every document with garbled text.

    Each chain of wrong decodings that can have made places of the text is undone and the result compressed with a
    zstandard dictionary per language; the shortest description wins, each step of a chain costing STEP_BYTES, and a text
    that no chain makes shorter is left unchanged. `lost` says that a character is gone for good (U+FFFD stands in the
    text or comes out); `restored` is then the best that can be had.

    Documents are read once for the sample and once for the search. Only texts that some wrong decoding can have made, or in
    which characters are lost, go on, spread over all cores by their text, as one of them costs hundreds of times what a clean
    one does; equal texts are restored once. The dictionaries are bounded.
    Edge cases: null and empty texts are not garbled; texts of any length are taken whole; equal documents are rows of
    their own; an empty table gives no rows; without clean documents plain compression decides.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(fitted(documents.select("doc_id", "text", "lang"), sample_docs))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keep = [i for i, undone in enumerate(all_steps(texts)) if undone or is_lost(texts[i])]
            if keep:
                yield batch.take(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, chain = None, "", []
        for batch in batches:
            ids, texts, chains, lost = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text != last:
                    last, (best, chain) = text, restore(text, shipped.value)
                if chain or is_lost(text):
                    ids.append(key)
                    texts.append(best)
                    chains.append(chain)
                    lost.append(is_lost(best) or is_lost(text))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array(chains, pa.list_(pa.string())), pa.array(lost)], ["doc_id", "restored", "chain", "lost"])

    found = _documents(documents).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(suspect, "doc_id bigint, text string")
    # nearly all of the work is in these few texts, wherever they lie; equal ones come one after another
    spread = found.repartition(WAVES * documents.sparkSession.sparkContext.defaultParallelism, "text").sortWithinPartitions("text")
    return spread.mapInArrow(run, "doc_id bigint, restored string, chain array<string>, lost boolean")
