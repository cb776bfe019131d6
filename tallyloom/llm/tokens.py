"""Encoding of a corpus with a public byte-level BPE, by recursive queries of an embedded database in each partition."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers' files lie.
TOKENIZERS = os.environ.get("TALLYLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pattern that splits text before the merges of a byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are taken together up to so many characters; words known from before are remembered up to MOST_WORDS.
CHUNK_CHARS, MOST_WORDS = 1_000_000, 200_000
#: In words of more bytes a step of the recursion contracts all places of the pair at once, which takes a step a pair instead of a step a place.
LONG_WORD = 400
#: Memory of a task's database, and what each byte of a longer word may add to it.
MEMORY, BYTES_A_BYTE = 250_000_000, 400

#: Token-position rows meet the merge table; of each word the leftmost pair of the lowest rank is contracted. Only a word's last step is kept.
RECURSION = """
with recursive step(w, n, toks) using key (w) as (
  select w, 0, toks from words
  union all
  select w, n + 1, toks[:best.i - 1] || [best.made] || toks[best.i + 2:] from (
    select p.w, any_value(p.n) as n, any_value(p.toks) as toks, min({'rank': m.rank, 'i': p.i, 'made': m.made}) as best
    from (select w, n, toks, unnest(range(1, len(toks))) as i from step) p join merges m on m.l = p.toks[p.i] and m.r = p.toks[p.i + 1]
    group by p.w)
)
select w, toks from step
"""
#: The same for long words: what a merge makes only stands in pairs of a higher rank, so all places of the pair, from the left and
#: without overlap, are contracted in one step.
RECURSION_LONG = """
with recursive step(w, n, toks) using key (w) as (
  select w, 0, toks from words
  union all
  select w, any_value(n) + 1, list(case when taken then made else a end order by i) filter (where not coalesce(before, false)) from (
    select *, lag(taken) over (partition by w order by i) as before from (
      select *, hit and row_number() over (partition by w, hit, island order by i) % 2 = 1 as taken from (
        select *, i - row_number() over (partition by w, hit order by i) as island from (
          select *, coalesce(rank = min(rank) over (partition by w), false) as hit from (
            select p.w, p.n, p.at.i as i, p.at.a as a, m.rank, m.made
            from (select w, n, unnest(list_transform(range(1, len(toks) + 1), lambda i: {'i': i, 'a': toks[i], 'b': toks[i + 1]})) as at from step) p
            left join merges m on m.l = p.at.a and m.r = p.at.b)))))
  group by w having bool_or(hit)
)
select w, toks from step
"""
#: A document's ids: its words' ids in the order of the words.
ASSEMBLY = "select d, flatten(list(toks order by seq)) as ids from (select unnest(d) as d, unnest(seq) as seq, unnest(w) as w from given) join known using (w) group by d"
#: A document's bytes, in hexadecimal: what each id stands for, in the order of the ids.
DECODING = "select d, string_agg(hex, '' order by i) as hex from (select d, unnest(ids) as id, unnest(range(len(ids))) as i from given) join vocab using (id) group by d"


def vocabulary(name: str, folder: str = TOKENIZERS) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """The ids of the 256 bytes and the merges (left id, right id, rank, id made) of a byte-level BPE file; its size is fixed."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    # byte-level vocabularies write printable bytes as themselves and the others, in order, as code points from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    merges = []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((vocab[left], vocab[right], rank, vocab[left + right]))
    return [vocab[signs[b]] for b in range(256)], merges


def database():
    """An embedded database on one thread, with bounded memory and without a folder to spill to."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY // 1_000_000}MB", "temp_directory": ""})


class Encoder:
    """One task's encoder: an embedded database with the merge table and the words known so far."""

    def __init__(self, single: list[int], merges: list[tuple[int, int, int, int]]) -> None:
        self.single, self.merges, self.known = single, merges, {}
        self.split = regex.compile(PATTERN).findall
        self.db = database()
        table = pa.table([pa.array(c, pa.int32()) for c in zip(*merges, strict=True)], ["l", "r", "rank", "made"])
        self.db.register("given", table)
        self.db.execute("create table merges as select * from given")
        self.db.unregister("given")
        self.db.execute("create table known (w int, toks int[])")

    def _learn(self, words: list[str]) -> None:
        """Puts the numbers of words that aren't known yet into `known` and their ids into the table of that name."""
        parts: dict[str, tuple[list, list]] = {RECURSION: ([], []), RECURSION_LONG: ([], [])}
        longest = 0
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            numbers, ids = parts[RECURSION_LONG if len(raw) > LONG_WORD else RECURSION]
            numbers.append(self.known.setdefault(word, len(self.known)))
            ids.append([self.single[b] for b in raw])
            longest = max(longest, len(raw))
        self.db.execute(f"set memory_limit = '{(MEMORY + BYTES_A_BYTE * longest) // 1_000_000}MB'")
        for query, (numbers, ids) in parts.items():
            if numbers:
                self.db.register("words", pa.table({"w": pa.array(numbers, pa.int32()), "toks": pa.array(ids, pa.list_(pa.int32()))}))
                self.db.execute("insert into known " + query)
                self.db.unregister("words")

    def ids_of(self, word: str) -> list[int]:
        return self.db.execute("select toks from known where w = ?", [self.known[word]]).fetchone()[0]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        fresh = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(fresh) > MOST_WORDS:
            self.known.clear()
            self.db.execute("delete from known")
            fresh = {w for words in split for w in words}
        self._learn(sorted(fresh))
        known = self.known
        given = pa.table({"d": pa.array([[i] * len(words) for i, words in enumerate(split)], pa.list_(pa.int32())), "seq": pa.array([range(len(words)) for words in split], pa.list_(pa.int32())), "w": pa.array([[known[w] for w in words] for words in split], pa.list_(pa.int32()))})
        self.db.register("given", given)
        d, ids = self.db.sql(ASSEMBLY).to_arrow_table().columns
        self.db.unregister("given")
        out: list[list[int]] = [[] for _ in texts]
        for i, own in zip(d.to_pylist(), ids.to_pylist(), strict=True):
            out[i] = own
        return out


def encoded(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>): every text as the ids of the named public tokenizer, without special tokens.

    In each partition the texts are split into words by the public pattern, and a recursive query joins each word's
    token-position rows with the merge table and contracts the leftmost pair of the lowest rank, until no pair is left; an
    ordered aggregation puts a document's ids together. Words that were met before in the task are looked up; nothing is
    shuffled and only the vocabulary, whose size is fixed, is sent to the executors.

    Edge cases: null and empty texts give an empty list; texts of any length are encoded whole; special tokens' strings are
    ordinary text; rows with equal texts or keys stay rows of their own; other columns aren't read.
    """
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(*shipped.value)
            texts = batch.column(1).to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= CHUNK_CHARS or i == len(texts) - 1:
                    ids = pa.array(encoder.encode(texts[start : i + 1]), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), ids], [key, "ids"])
                    start, size = i + 1, 0

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the text of every list of ids, by an ordered aggregation over id-position rows joined with the vocabulary.

    Edge cases: a null or empty list is the empty text; an id that the tokenizer doesn't have adds nothing; bytes that are no
    UTF-8 are replaced; rows with equal keys stay rows of their own; other columns aren't read.
    """
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = None
        for batch in batches:
            if db is None:
                single, merges = shipped.value
                raw = {i: bytes([b]) for b, i in enumerate(single)}
                for left, right, _, made in merges:
                    raw[made] = raw[left] + raw[right]
                db = database()
                vocab = pa.table({"id": pa.array(list(raw), pa.int32()), "hex": [b.hex() for b in raw.values()]})
                db.register("given", vocab)
                db.execute("create table vocab as select * from given")
                db.unregister("given")
            db.register("given", pa.table({"d": pa.array(range(batch.num_rows), pa.int32()), "ids": batch.column(1)}))
            d, text = db.sql(DECODING).to_arrow_table().columns
            db.unregister("given")
            out = [""] * batch.num_rows
            for i, own in zip(d.to_pylist(), text.to_pylist(), strict=True):
                out[i] = bytes.fromhex(own).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key), F.col(ids).cast("array<int>")).mapInArrow(run, f"`{key}` {kind}, text string")
