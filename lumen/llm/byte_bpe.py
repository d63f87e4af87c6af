"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one database per Python worker.

Each partition's texts are cut into words by the published split pattern,
vectorised over code points.  The distinct words that the vocabulary does not
hold whole become token-position rows; a recursive query joins adjacent tokens
to the merge table and contracts each word's leftmost pair of minimum rank
until no word changes.  Long words contract by a second recursive query that
takes many pairs a step and restarts from its last state, so that what it keeps
is bounded whatever the word's length.  Decoding takes the ids alone: an ordered
aggregation joins the bytes of every word's ids, and the decoded words in order
are the decoded text.

Scale: nothing is shuffled.  A worker keeps the vocabulary and words of at most
``CACHE`` bytes, and while it works on a partition a database of ``MEMORY`` MB
that does not spill; it cuts its batches to a MB.  Only a
single text or word of many MB takes more, in proportion to its length.  A lost
executor costs its partitions' own work.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import free, prepare, release
from lumen.llm.words import ranges, slices

#: Bytes of words that a worker keeps, and what an entry takes besides its texts.
CACHE, ENTRY = 48 << 20, 180
#: Bytes of a word beyond which it is contracted by CONTRACT_LONG, and rows that a recursive query may keep.
LONG, ROWS = 256, 1_000_000
#: MB that a worker's database may take, and rows of a long word for which it gets one MB more.
MEMORY, ROWS_IN_MB = 160, 2000
#: Bytes of texts handled at once.
PART = 2 << 20

#: Fixed values of the split pattern: the endings that an apostrophe takes with it.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
_worker: dict[str, object] = {}


def _kinds() -> np.ndarray:
    """The class of each code point that the split pattern tells apart."""
    if "kinds" not in _worker:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            out[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
        out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
        _worker["kinds"] = out
    return _worker["kinds"]


def split_words(codes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in code points of texts that begin at borders (sorted; repeats for empty texts)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[codes]
    new_text = np.zeros(n + 1, bool)
    new_text[borders[borders < n]] = True
    new_text[n] = True
    run = np.concatenate([[True], kind[1:] != kind[:-1]]) | new_text[:n]
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], n)
    k = kind[starts]
    begin = run.copy()
    # A blank run before other characters of its text gives its last blank away: alone, or to the word if it is a space.
    follows = (k == BLANK) & ~new_text[ends]
    last = ends[follows] - 1
    begin[last] = True
    spaced = last[codes[last] == 32]
    begin[spaced + 1] = False
    # An apostrophe that begins a match takes a contraction's letters from the next run.
    joined = np.zeros(n + 1, bool)
    joined[spaced + 1] = True
    lone = starts[(k == OTHER) & (ends - starts == 1)]
    lone = lone[(codes[lone] == 39) & ~joined[lone]]
    lone = lone[~new_text[lone + 1]]
    if len(lone):
        after = np.append(codes, [0, 0, 0])
        one, two = after[lone + 1], after[lone + 2]
        second_ok = ~new_text[np.minimum(lone + 2, n)]
        size = np.zeros(len(lone), np.int64)
        for c in CONTRACTIONS:
            hit = (one == ord(c[0])) if len(c) == 1 else (one == ord(c[0])) & (two == ord(c[1])) & second_ok
            size[hit & (size == 0)] = len(c)
        got = size > 0
        at, size = lone[got], size[got]
        begin[at + 1] = False
        rest = at + 1 + size
        rest = rest[(rest < n)]
        begin[rest] = True
    return np.flatnonzero(begin)


CONTRACT = """
with recursive state(step, k, t) as (
  select 0, k, t from first_tokens
  union all
  (with pairs as materialized (
          select step, k, t, case when lead(k) over w >> 24 = k >> 24 then (t << 32) | lead(t) over w end as lr, lag(k) over w as before
          from state window w as (order by k)),
        best as materialized (
          select k >> 24 as word, min(m.ranked | (k & 16777215)) as chosen from pairs join merges m using (lr) group by 1)
   select step + 1, k, case when (k & 16777215) = (chosen & 16777215) then chosen >> 24 else t end
   from pairs join best on word = k >> 24
   where before is distinct from ((word << 24) | (chosen & 16777215)))
)
select s.k, t from (select k >> 24 as word, max(step) as step from state group by 1) l join state s on s.k >> 24 = l.word and s.step = l.step
"""

# Of a long word, a step takes each pair whose rank is the minimum as far as ``reach`` bytes on both sides.  No other merge
# can come between: a token that grows into the pair from beyond would be longer than any that the word holds.  Of equal
# pairs that follow each other every second goes, from the first of their run, if all so far are such minima; a pair that
# is not "calm" (its token has merges of smaller rank) goes only if none equal is within reach before it.
CONTRACT_LONG = """
with recursive state(step, k, t) as (
  select 0, k, t from first_tokens
  union all
  (with pairs as materialized (
          select step, k, t, case when lead(k) over w >> 40 = k >> 40 then (t << 32) | lead(t) over w end as lr, row_number() over w as i
          from state where step < {steps} window w as (order by k)),
        ranked as materialized (select k, i, m.ranked >> 24 as r, m.calm from pairs join merges m using (lr)),
        near as materialized (
          select k, i, r, r = min(r) over (order by k range between {reach} preceding and {reach} following)
            and (calm or coalesce(min(r) over (order by k range between {reach} preceding and 1 preceding) > r, true)) as hit,
            (lag(i) over o is distinct from i - 1 or lag(r) over o is distinct from r)::int as new
          from ranked window o as (order by k)),
        runs as materialized (select k, i, r, hit, sum(new) over (order by k rows unbounded preceding) as run from near),
        taken as materialized (
          select k, i, r from (select k, i, r, bool_and(hit) over u as clear, i - first_value(i) over u as nth from runs window u as (partition by run order by k rows unbounded preceding))
          where clear and nth % 2 = 0)
   select step + 1, p.k, coalesce(a.r, t)
   from pairs p left join taken a on a.i = p.i left join taken b on b.i + 1 = p.i
   where b.i is null and p.k >> 40 in (select k >> 40 from taken))
)
select s.k, t, s.step = {steps} as open from (select k >> 40 as word, max(step) as step from state group by 1) l join state s on s.k >> 40 = l.word and s.step = l.step
"""
# Decoding: each word's ids joined to the vocabulary, and their bytes aggregated in order.
DECODE = """
select k >> 40 as word, string_agg(v.hex, '' order by k) as hex
from final_tokens join vocabulary v on v.id = t group by 1 order by 1
"""


class Codec:
    """The vocabulary of one rank file; while a partition is worked on, its DuckDB tables and the words met so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
        flat = array("q")
        for m, r in self.ranks.items():
            for i in range(1, len(m)):
                if (x := self.ranks.get(m[:i])) is not None and (y := self.ranks.get(m[i:])) is not None:
                    flat.extend((x << 32 | y, r << 24))
        p = np.array(flat, np.int64).reshape(-1, 2)
        self.lengths = sorted({len(m) for m in self.ranks})
        made = p[:, 1] >> 24
        least = np.full(int(made.max(initial=0)) + max(self.ranks.values()) + 1, np.iinfo(np.int64).max)  # of the merges that a token takes part in
        np.minimum.at(least, p[:, 0] >> 32, made)
        np.minimum.at(least, p[:, 0] & 0xFFFFFFFF, made)
        self.merges = pa.table({"lr": p[:, 0], "ranked": p[:, 1], "calm": least[made] > made})
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.con = None
        # Words met of late, and those before them: each word with its ids as text, a tab, and the decoded bytes.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def open(self) -> None:
        """A database in memory that does not spill, as a worker's own disk is no place for data."""
        import duckdb

        if self.con is None:
            self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
            self.con.register("m", self.merges)
            self.con.execute("create table merges as select * from m")
            self.con.register("v", pa.table({"id": list(self.ranks.values()), "hex": [x.hex() for x in self.ranks]}))
            self.con.execute("create table vocabulary as select * from v")
            self.con.unregister("m")
            self.con.unregister("v")

    def close(self) -> None:
        """Let go of the database, so that an idle worker holds the vocabulary and CACHE bytes of words alone."""
        if self.con is not None:
            self.con.close()
        self.con = None
        release()

    def contract(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final tokens of words of at most LONG bytes: keys (word, position) and ids."""
        at = ranges(np.zeros(len(size), np.int64), size)
        key = np.repeat(np.arange(len(size)), size) << 24 | at
        self.con.register("first_tokens", pa.table({"k": key, "t": self.single[np.frombuffer(b"".join(words), np.uint8)]}))
        got = self.con.sql(CONTRACT).to_arrow_table()
        k, t = (got.column(c).to_numpy() for c in ("k", "t"))
        return (k >> 24) << 40 | (k & 0xFFFFFF), t

    def longest(self, word: bytes) -> int:
        """Bytes of the longest token that word may come to hold. A token is made of two that are in it, so none is longer than twice the longest of the shorter ones."""
        out = 1
        for n in self.lengths:
            if n > 2 * out:
                break
            if any(word[i : i + n] in self.ranks for i in range(len(word) - n + 1)):
                out = n
        return out

    def contract_long(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of any length, in as many queries as ROWS asks for."""
        reach = 2 * max(map(self.longest, words))
        k = np.repeat(np.arange(len(size)), size) << 40 | ranges(np.zeros(len(size), np.int64), size)
        t, done = self.single[np.frombuffer(b"".join(words), np.uint8)], []
        self.con.execute(f"set memory_limit = '{MEMORY + len(k) // ROWS_IN_MB}MB'")
        while len(k):
            self.con.register("first_tokens", pa.table({"k": k, "t": t}))
            got = self.con.sql(CONTRACT_LONG.format(steps=max(1, ROWS // len(k)), reach=reach)).to_arrow_table()
            k, t, more = (got.column(c).to_numpy() for c in ("k", "t", "open"))
            done.append((k[~more], t[~more]))
            k, t = k[more], t[more]
        return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])

    def encode(self, words: list[bytes]) -> Iterator[tuple[str, bytes]]:
        """Ids as text, and the bytes that the ids decode to, of words that are all whole tokens, all short, or all long."""
        self.open()
        size = np.array([len(w) for w in words], np.int64)
        if words[0] in self.ranks:
            k, t = np.arange(len(words)) << 40, np.array([self.ranks[w] for w in words], np.int64)
        else:
            k, t = (self.contract_long if size.max() > LONG else self.contract)(words, size)
            order = np.argsort(k)
            k, t = k[order], t[order]
        self.con.register("final_tokens", pa.table({"k": k, "t": t}))
        decoded = self.con.sql(DECODE).to_arrow_table().column("hex").to_pylist()
        ids, first = list(map(str, t.tolist())), np.flatnonzero(np.append(True, k[1:] >> 40 != k[:-1] >> 40)).tolist()
        for a, b, x in zip(first, [*first[1:], len(ids)], decoded):
            yield " ".join(ids[a:b]), bytes.fromhex(x)

    def keep(self, word: bytes, value: bytes) -> None:
        """Keep a word; when half of CACHE is full, what was not met since the last time goes."""
        self.known[word] = value
        self.held += len(value) + len(word) + ENTRY
        if 2 * self.held > CACHE:
            self.known, self.older, self.held = {}, self.known, 0

    def learn(self, words: list[bytes]) -> tuple[list[str], list[bytes]]:
        """Ids as text and decoded bytes of each of these distinct words."""
        out: dict[bytes, bytes] = {}
        rest = []
        for w in words:
            if (x := self.known.get(w)) is None and (x := self.older.get(w)) is not None:
                self.keep(w, x)
            if x is None:
                rest.append((0 if w in self.ranks else 1 if len(w) <= LONG else 1 + self.longest(w), w))
            else:
                out[w] = x
        rest.sort(key=lambda x: x[0])  # long words by their longest token, as that decides how much a step may take
        i = 0
        while i < len(rest):  # bounded rows in one query
            j, total, kept, kind = i, 0, 0, rest[i][0]
            while j < len(rest) and rest[j][0] == kind and (j == i or total + len(rest[j][1]) < 400_000 and kept < ROWS):
                total += len(rest[j][1])
                kept += len(rest[j][1]) ** 2 // 2 if kind == 1 else 1
                j += 1
            group = [w for _, w in rest[i:j]]
            for w, (ids, decoded) in zip(group, self.encode(group), strict=True):
                out[w] = x = ids.encode() + b"\t" + decoded
                if len(w) <= LONG:
                    self.keep(w, x)
            i = j
        split = [out[w].split(b"\t", 1) for w in words]
        return [x[0].decode() for x in split], [x[1] for x in split]


def codec(path: str) -> Codec:
    if path not in _worker:
        _worker[path] = Codec(path)
    return _worker[path]


def encode_texts(c: Codec, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    """Ids as text, token count and decoded bytes of each text."""
    # Code points and where each starts in the bytes.
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    borders = np.searchsorted(lead, offsets)
    start = split_words(codes, borders[:-1])
    word_at = np.append(lead[start], len(data)).astype(np.int64)
    first = np.searchsorted(start, borders)
    if len(start):
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(word_at), pa.py_buffer(data.tobytes())])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy()
        ids, decoded = c.learn(distinct)
        n = np.array([x.count(" ") + 1 for x in ids], np.int64)
        ids, decoded = np.array(ids, object), np.array(decoded, object)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if a == b:
            yield "", 0, b""
        else:
            x = code[a:b]
            yield " ".join(ids[x].tolist()), int(n[x].sum()), b"".join(decoded[x].tolist())


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, full: bool = True) -> DataFrame:
    """The columns ``keep`` of docs with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if full, ``ids`` (decimal, one space between) and ``decoded``.

    Null texts count as empty: no tokens, and the digests of the empty string.
    Columns of docs that have one of these names are replaced.  Rows repeat as
    they do in docs; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    new = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "string"), ("decoded", "string")] * full
    keep = [c for c in (docs.columns if keep is None else keep) if c not in dict(new)]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free("text", docs)))
    names = keep + [c for c, _ in new]

    def f(batches):
        c = codec(path)
        try:
            for batch in batches:
                for part, data, offsets in slices(batch, len(keep), PART):
                    got = list(encode_texts(c, data, offsets))
                    cols = [pa.array([x[1] for x in got], pa.int64()), pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in got]), pa.array([hashlib.sha256(x[2]).hexdigest() for x in got])]
                    if full:
                        cols += [pa.array([x[0] for x in got]), pa.array([x[2].decode("utf-8") for x in got])]
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + cols, names)
        finally:
            c.close()

    schema = src.select(*[f"`{c}`" for c in keep]).schema
    for c, t in new:
        schema = schema.add(c, t)
    return src.mapInArrow(f, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: ids and round trip of every document under byte_bpe_50k.tiktoken."""
    import public_tokenizers

    from lumen.llm.shared import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id"], full=False)
