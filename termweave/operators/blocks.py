"""Releases as blocks of token numbers, in which a round counts phrases by numpy instead of as rows of strings.

A block holds some hundred releases: their distinct words once, and of each release the tokens that phrases are mined from
and those of the index form, as numbers of words. Within a block phrases are told apart by these numbers; across blocks by
two hashes of 64 and 32 bits, the second of which only says which part of the phrases a phrase belongs to.
A phrase is plain if all its words are of ASCII letters and digits: its index form is then the phrase itself. Phrases with
an apostrophe are not plain; ``postings`` gives those as rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.constants import STOP
from termweave.functions import text as T
from termweave.operators.match import COLUMNS

#: A block ends at so many tokens, words or releases, but holds one release at least.
TOKENS, WORDS, RELEASES = 800_000, 60_000, 16_000
#: Tokens of a part, about: what one task sorts at once.
PART_TOKENS = 4_000_000
MOST = 3
NAME = "struct<relid: long, sub: int, at: int, surface: string, kind: string>"
SCHEMA = f"block long, releases int, tokens long, relid binary, words binary, h1 binary, h2 binary, flags binary, mined binary, mined_n binary, index binary, index_n binary, apart boolean, names array<{NAME}>"
_TOKEN = re.compile(T.TOKEN)
_KEYS = ("termweave-words1", "termweave-words2")
#: Flags of a word: may stand in a plain phrase; may begin or end a phrase; has an apostrophe.
PLAIN, EDGE, APART = 1, 2, 4


def _hashes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    values = np.array(words, object) if len(words) else np.zeros(0, object)
    one, two = (pd.util.hash_array(values, hash_key=k, categorize=False) for k in _KEYS)
    return one.astype(np.uint64), two.astype(np.uint64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word, from their hashes."""
    h = (a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)) ^ b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def phrase_hashes(phrases: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of phrases whose words stand one space apart."""
    split = [p.split(" ") for p in phrases]
    words = sorted({w for p in split for w in p})
    number = {w: k for k, w in enumerate(words)}
    out = []
    with np.errstate(over="ignore"):
        for h in _hashes(words):
            made = np.zeros(len(split), np.uint64)
            for k in range(max(map(len, split), default=0)):
                has = np.array([len(p) > k for p in split], bool)
                at = np.array([number[p[k]] for p in split if len(p) > k], np.int64)
                made[has] = _join(made[has], h[at]) if k else h[at]
            out.append(made)
    return out[0], out[1]


def _word_flags(words: Sequence[str]) -> np.ndarray:
    """Words are in lower case."""

    def one(w: str) -> int:
        if w.isascii() and w.isalnum() and len(w) >= 2 and w[0] >= "a":
            return PLAIN | EDGE if len(w) >= 3 and w not in STOP else PLAIN
        return APART | EDGE * (len(w) >= 3 and w not in STOP) if _TOKEN.fullmatch(w) else 0

    return np.fromiter(map(one, words), np.uint8, len(words))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_FOLD = str.maketrans(*T._folding())
_MARKS = re.compile("[\u0300-\u036f]")
_ASCII, _WORD = re.compile("[a-z0-9]+"), re.compile(r"[^\W_]+")
_PRIVATE = "\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd"
_ANY_PRIVATE, _WITH_PRIVATE = re.compile(f"[{_PRIVATE}]"), re.compile(rf"(?:[^\W_]|[{_PRIVATE}])+")


def index_tokens(low: str) -> list[str]:
    """The tokens of the index form of a text in lower case, as ``text.normalised`` makes them, but for the folding of letters, which leaves a token one."""
    if low.isascii():
        return _ASCII.findall(low)
    if _MARKS.search(low):
        low = _MARKS.sub("", low.translate(_FOLD))
    return (_WITH_PRIVATE if _ANY_PRIVATE.search(low) else _WORD).findall(low)


class _Filling:
    """A block in the making."""

    def __init__(self) -> None:
        self.number = _Numbers()
        self.relid: list[int] = []
        self.names: list[dict] = []
        self.mined: list[int] = []
        self.index: list[int] = []
        self.mined_n: list[int] = []
        self.index_n: list[int] = []

    def add(self, relid: int, text: str | None, columns: Sequence[str], names: Sequence[dict] | None) -> None:
        """text: what is mined where that isn't title and body."""
        number = self.number
        low = "\n".join(_TOKEN.findall(f"{columns[0]} \n {columns[-1]}" if text is None else text)).lower()
        mined = [number[w] for w in low.split("\n")] if low else []
        self.mined += mined
        self.mined_n.append(len(mined))
        for c in columns:
            index = [number[w] for w in index_tokens(c.lower())] if c else []
            self.index += index
            self.index_n.append(len(index))
        if names:
            self.names += [{"relid": relid, **n} for n in names]
        self.relid.append(relid)

    def full(self, most: int) -> bool:
        return len(self.mined) + len(self.index) >= TOKENS or len(self.number) >= WORDS or len(self.relid) >= most

    def row(self, block: int) -> list:
        folded = _Numbers()
        to = np.array([folded[w if w.isascii() or "’" in w else w.translate(_FOLD)] for w in self.number], np.int64)
        words = list(folded)
        h1, h2 = _hashes(words)
        flags = _word_flags(words)
        kind = np.uint16 if len(words) <= 65535 else np.uint32
        tokens = lambda numbers: to[np.array(numbers, np.int64)].astype(kind)
        cells = [tokens(self.mined), np.array(self.mined_n, np.int32), tokens(self.index), np.array(self.index_n, np.int32)]
        return [block, len(self.relid), len(self.mined) + len(self.index), np.array(self.relid, np.int64).tobytes(), "\n".join(words).encode(), h1.tobytes(), h2.tobytes(), flags.tobytes(),
                *[c.tobytes() for c in cells], bool((flags & APART).any()), self.names]


def blocks(releases: DataFrame, most: int = RELEASES) -> DataFrame:
    """The blocks, of so many releases at most, of releases (relid, title, heading, body_text) with the names of the five shapes that their texts hold."""
    raw = T.joined("title", "body_text")
    rows = releases.select("relid", raw.alias("raw"), T.has_url(raw).alias("url"), *[F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS])
    rows = rows.select("relid", F.when(F.col("url"), T.without_urls("raw")).alias("text"), "raw", *COLUMNS)
    rows = rows.select("relid", "text", T.shapes(F.coalesce("text", "raw")).alias("names"), *COLUMNS)
    out = pa.schema([("block", pa.int64()), ("releases", pa.int32()), ("tokens", pa.int64()), *[(c, pa.binary()) for c in ("relid", "words", "h1", "h2", "flags", "mined", "mined_n", "index", "index_n")], ("apart", pa.bool_()),
                     ("names", pa.list_(pa.struct([("relid", pa.int64()), ("sub", pa.int32()), ("at", pa.int32()), ("surface", pa.string()), ("kind", pa.string())])))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        filling = _Filling()
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            step = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for lo in range(0, batch.num_rows, step):
                for relid, text, names, *parts in zip(*(c.slice(lo, step).to_pylist() for c in columns), strict=True):
                    filling.add(relid, text, parts, names)
                    if filling.full(most):
                        yield _batch(filling.row(block), out)
                        block += 1
                        filling = _Filling()
        if filling.relid:
            yield _batch(filling.row(block), out)

    return rows.mapInArrow(build, SCHEMA)


def _batch(row: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


@dataclass
class Block:
    """Of a block row as arrays: word hashes and flags, and both streams as word number, release and whether the next one or two tokens are of the same text."""

    row: dict

    def __post_init__(self) -> None:
        r = self.row
        self.h1, self.h2, self.flags = np.frombuffer(r["h1"], np.uint64), np.frombuffer(r["h2"], np.uint64), np.frombuffer(r.get("flags", b""), np.uint8)
        self.kind = np.uint16 if len(self.h1) <= 65535 else np.uint32
        self.relid = np.frombuffer(r["relid"], np.int64)

    def stream(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, release and text of each token."""
        words, n = np.frombuffer(self.row[name], self.kind), np.frombuffer(self.row[f"{name}_n"], np.int32)
        text = np.repeat(np.arange(len(n), dtype=np.int32), n)
        return words, text // (len(n) // max(1, len(self.relid)) or 1), text

    def words(self) -> np.ndarray:
        return np.array(self.row["words"].decode().split("\n"), object)

    def hits(self, table: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """phrase, release: of the table's phrases those that stand in the index form of a release, without repeats."""
        words, doc, text = self.stream("index")
        begins = np.isin(self.h1, table.first)[words]
        at = np.flatnonzero(begins)
        found = []
        for n, (sorted1, sorted2, number) in table.sizes.items():
            here = at[at + n <= len(words)]
            here = here[text[here + n - 1] == text[here]]
            h1, h2 = self.h1[words[here]], self.h2[words[here]]
            with np.errstate(over="ignore"):
                for k in range(1, n):
                    h1, h2 = _join(h1, self.h1[words[here + k]]), _join(h2, self.h2[words[here + k]])
            k = np.minimum(np.searchsorted(sorted1, h1), len(sorted1) - 1)
            hit = (sorted1[k] == h1) & (sorted2[k] == h2)
            found.append(doc[here[hit]].astype(np.int64) * table.count + number[k[hit]])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both % max(1, table.count), both // max(1, table.count)

    def grams(self, name: str, wanted: int = PLAIN, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers, three and from one on, 0 for none, and the release of every run of up to three tokens whose words have the flag and whose first and last are edges."""
        words, doc, text = self.stream(name)
        fine = (self.flags[words] & wanted) > 0
        edge = fine & ((self.flags[words] & EDGE) > 0)
        if keep is not None:
            edge = edge & keep[doc]
        w = words.astype(np.uint64) + np.uint64(1)
        b = np.uint64(self.bits)
        outs, docs = [], []
        for n in range(1, MOST + 1):
            if len(w) < n:
                break
            m = len(w) - n + 1
            ok = edge[:m] & edge[n - 1 :] & (text[:m] == text[n - 1 :])
            if n == 3:
                ok &= fine[1:-1]
            at = np.flatnonzero(ok)
            key = w[at]
            for k in range(1, n):
                key |= w[at + k] << (b * np.uint64(k))
            outs.append(key)
            docs.append(doc[at])
        return (np.concatenate(outs), np.concatenate(docs)) if outs else (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    @property
    def bits(self) -> int:
        bits = max(1, len(self.h1).bit_length())
        if bits * MOST > 64:
            raise ValueError("a release of over two million different words")
        return bits

    def parts(self, key: np.ndarray) -> list[np.ndarray]:
        """The word numbers of runs, -1 for none."""
        b = np.uint64(self.bits)
        mask = np.uint64((1 << self.bits) - 1)
        return [((key >> (b * np.uint64(k))) & mask).astype(np.int64) - 1 for k in range(MOST)]

    def hashed(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, *more = self.parts(key)
        h1, h2 = self.h1[one], self.h2[one]
        with np.errstate(over="ignore"):
            for k in more:
                has = np.flatnonzero(k >= 0)
                h1[has], h2[has] = _join(h1[has], self.h1[k[has]]), _join(h2[has], self.h2[k[has]])
        return h1, h2

    def strings(self, key: np.ndarray) -> np.ndarray:
        words, (one, *more) = self.words(), self.parts(key)
        out = words[one] if len(one) else np.zeros(0, object)
        for k in more:
            has = np.flatnonzero(k >= 0)
            out[has] = out[has] + " " + words[k[has]]
        return out


class Phrases:
    """A table of phrases to look up in blocks, by number."""

    def __init__(self, phrases: Sequence[str]) -> None:
        self.count = len(phrases)
        split = [p.split(" ") for p in phrases]
        self.first = np.unique(_hashes([p[0] for p in split])[0])
        self.sizes = {}
        for n in sorted({len(p) for p in split}):
            number = np.array([k for k, p in enumerate(split) if len(p) == n])
            h1, h2 = phrase_hashes([phrases[k] for k in number])
            order = np.argsort(h1)
            self.sizes[n] = (h1[order], h2[order], number[order])


def _tables(terms: Sequence[str]) -> tuple[Phrases, list[list[int]]]:
    """The distinct phrases of terms, and which terms each stands for; a term without one is never found."""
    found: dict[str, list[int]] = {}
    for k, t in enumerate(terms):
        if q := T.phrase_of(t):
            found.setdefault(q, []).append(k)
    return Phrases(list(found)), list(found.values())


def _expanded(phrase: np.ndarray, doc: np.ndarray, stands: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """term, release from phrase, release."""
    n = np.array([len(x) for x in stands], np.int64)
    flat = np.array([k for x in stands for k in x], np.int64)
    size = n[phrase]
    at = np.repeat(np.cumsum(n)[phrase] - size, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return flat[at], np.repeat(doc, size)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def hits(made: DataFrame, terms: Sequence[str]) -> DataFrame:
    """term, relid of a list of terms, as ``match.phrase_hits`` finds them."""
    table, stands = _tables(terms)
    schema = pa.schema([("term", pa.string()), ("relid", pa.int64())])
    names = np.array(terms, object)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            term, doc = _expanded(*block.hits(table), stands)
            yield pa.RecordBatch.from_arrays([pa.array(names[term], pa.string()), pa.array(block.relid[doc])], schema=schema)

    if not table.count:
        return made.select(F.lit("").alias("term"), F.lit(0).cast("long").alias("relid")).where("false")
    return made.select("relid", "h1", "h2", "index", "index_n").mapInArrow(find, "term string, relid long")


def postings(made: DataFrame, parents: Sequence[str], names: Sequence[str] | None) -> DataFrame:
    """key, relid of the releases with a parent: phrases that aren't plain, and those of ``names`` (None: all)."""
    table, stands = _tables(parents)
    asked = None if names is None else np.unique(phrase_hashes([k for k in names if " ".join(_TOKEN.findall(k)) == k])[0])
    schema = pa.schema([("key", pa.string()), ("relid", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            if not table.count or (asked is not None and not len(asked) and not (block.flags & APART).any()):
                continue
            _, doc = block.hits(table)
            keep = np.zeros(len(block.relid), bool)
            keep[doc] = True
            key, doc = block.grams("mined", PLAIN | APART, keep)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            if asked is not None:
                apart = np.zeros(len(key), bool)
                for k in block.parts(key):
                    apart |= (k >= 0) & ((block.flags[k] & APART) > 0)
                take = apart | np.isin(block.hashed(key)[0], asked)
                key, doc = key[take], doc[take]
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(block.strings(key), pa.string()), pa.array(block.relid[doc])], schema=schema)

    return made.select("relid", "words", "h1", "h2", "flags", "mined", "mined_n", "index", "index_n").mapInArrow(find, "key string, relid long")


PART = "part int, block long, h binary, inside binary, corpus binary, fresh binary, docs binary, parents binary, parents_n binary"
COUNTED = "block long, h long, parent int, in_parent long, corpus long, new long"


def counted(made: DataFrame, parents: Sequence[str], terms: Sequence[str], known: Sequence[str], least: int, pruned: Callable[..., np.ndarray] | None, tokens: int) -> DataFrame:
    """COUNTED: of each plain phrase and parent the releases that hold both, ``least`` at least, and of the phrase all releases and those without any of ``terms``.

    block holds the phrase, h is its hash, parent a number. known: keys that are left out.
    pruned: of parent, in_parent, corpus and new which rows to keep; those with new = 0 go then before anything else.
    """
    table, stands = _tables(parents)
    all_, _ = _tables(terms)
    skip = np.unique(phrase_hashes([k for k in known if " ".join(_TOKEN.findall(k)) == k])[0])
    n_parts, n_parents = max(2 * made.sparkSession.sparkContext.defaultParallelism, -(-tokens // PART_TOKENS)), len(parents)
    kind = np.uint16 if n_parents <= 65535 else np.uint32
    out = pa.schema([("part", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("h", "inside", "corpus", "fresh", "docs", "parents", "parents_n")]])
    rows = pa.schema([("block", pa.int64()), ("h", pa.int64()), ("parent", pa.int32()), ("in_parent", pa.int64()), ("corpus", pa.int64()), ("new", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            n = len(block.relid)
            _, seen = block.hits(all_) if all_.count else (None, np.zeros(0, np.int64))
            matched = np.zeros(n, bool)
            matched[seen] = True
            parent, doc = _expanded(*block.hits(table), stands) if table.count else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            under = np.bincount(doc, minlength=n).astype(np.int32)
            parent = parent[np.argsort(doc, kind="stable")].astype(kind)
            key, doc, held = _sorted(block, under > 0)
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            is_mined, is_index = (held & 1).astype(np.int64), (held >> 1).astype(np.int64)
            inside, corpus, fresh = (np.add.reduceat(x, first) for x in (is_mined, is_index, is_index * ~matched[doc]))
            h1, h2 = block.hashed(key[first])
            part = ((h2 >> np.uint64(32)) % np.uint64(n_parts)).astype(np.uint16 if n_parts <= 65535 else np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(n_parts + 1))
            mined = doc[held & 1 > 0].astype(np.uint16 if n <= 65535 else np.uint32)
            begin = np.cumsum(inside) - inside
            size = inside[order]
            at = np.repeat(begin[order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            docs, ends = mined[at], np.concatenate(([0], np.cumsum(size)))
            h, inside, corpus, fresh = h1[order], inside[order].astype(np.uint16), corpus[order].astype(np.uint16), fresh[order].astype(np.uint16)
            had = [k for k in range(n_parts) if bounds[k] < bounds[k + 1]]
            whose, how_many = parent.tobytes(), under.tobytes()
            cells = [[a[bounds[k] : bounds[k + 1]].tobytes() for k in had] for a in (h, inside, corpus, fresh)] + [[docs[ends[bounds[k]] : ends[bounds[k + 1]]].tobytes() for k in had], [whose] * len(had), [how_many] * len(had)]
            yield pa.RecordBatch.from_arrays([pa.array(had, pa.int32()), pa.array([row["block"]] * len(had), pa.int64()), *[pa.array(c, pa.binary()) for c in cells]], schema=out)

    def count(table_: pa.Table) -> pa.Table:
        found = _counts(table_, kind, n_parents, least, skip, pruned)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, rows, strict=True)], schema=rows)

    needed = ("block", "relid", "h1", "h2", "flags", "mined", "mined_n", "index", "index_n")
    return made.select(*needed).mapInArrow(cut, PART).repartition(n_parts, "part").groupBy("part").applyInArrow(count, COUNTED)


def _sorted(block: Block, under: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain runs in order, each release of each once, and where it stands: 1 for mined in a release under a parent, 2 for the index form."""
    a, da = block.grams("mined", keep=under)
    b, db = block.grams("index")
    key, doc = np.concatenate((a, b)), np.concatenate((da, db)).astype(np.uint64)
    held = np.concatenate((np.full(len(a), 1, np.uint8), np.full(len(b), 2, np.uint8)))
    wide = max(1, len(under)).bit_length()
    if block.bits * MOST + wide + 1 <= 64:
        # all in one number, which sorts several times faster than an order is found
        packed = np.sort((key << np.uint64(wide + 1)) | (doc << np.uint64(1)) | (held >> 1))
        held = np.where(packed & np.uint64(1) > 0, np.uint8(2), np.uint8(1))
        doc, key = ((packed >> np.uint64(1)) & np.uint64((1 << wide) - 1)), packed >> np.uint64(wide + 1)
    else:
        order = np.lexsort((held, doc, key))
        key, doc, held = key[order], doc[order], held[order]
    first = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return key[at], doc[at].astype(np.int64), np.bitwise_or.reduceat(held, at) if len(at) else held


def _counts(t: pa.Table, kind: type, n_parents: int, least: int, skip: np.ndarray, pruned: Callable[..., np.ndarray] | None) -> list[np.ndarray]:
    column = lambda c, d: [np.frombuffer(x.as_py(), d) for x in t.column(c)]
    glue = lambda c, d: np.concatenate(column(c, d))
    h, inside, corpus, fresh = glue("h", np.uint64), glue("inside", np.uint16), glue("corpus", np.uint16), glue("fresh", np.uint16)
    sizes = [len(x) // 8 for x in (v.as_py() for v in t.column("h"))]
    under = column("parents_n", np.int32)
    releases = np.array([len(x) for x in under])
    docs = np.concatenate([np.frombuffer(x.as_py(), np.uint16 if n <= 65535 else np.uint32).astype(np.int64) + base for x, n, base in zip(t.column("docs"), releases, np.cumsum(releases) - releases, strict=True)])
    under, parents = np.concatenate(under).astype(np.int64), glue("parents", kind)
    start = np.cumsum(under) - under
    entry_block = np.repeat(np.array(t.column("block").to_pylist(), np.int64), sizes)
    doc_at = np.cumsum(inside, dtype=np.int64) - inside
    order = np.argsort(h, kind="stable")
    h = h[order]
    empty = [np.zeros(0, np.int64)] * 6
    if not len(h):
        return empty
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    total = lambda x: np.add.reduceat(x[order].astype(np.int64), first)
    in_all, of_all, new_all = total(inside), total(corpus), total(fresh)
    good = (in_all >= least) & ~np.isin(h[first], skip)
    if pruned is not None:
        good &= new_all >= 1
    groups = np.flatnonzero(good)
    ends = np.append(first[1:], len(h))
    outs = [empty]
    lo = 0
    weight = np.cumsum(in_all[groups])
    while lo < len(groups):
        # some phrases at a time, so that neither their releases' parents nor the counts of each with each parent take much
        hi = int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + 500_000, "right"))
        hi = min(max(lo + 1, hi), lo + max(1, 4_000_000 // max(1, n_parents)))
        g = groups[lo:hi]
        n = ends[g] - first[g]
        entry = order[np.repeat(first[g] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        group = np.repeat(np.arange(len(g)), n)
        m = inside[entry].astype(np.int64)
        d = docs[np.repeat(doc_at[entry] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        group_d = np.repeat(group, m)
        p = under[d]
        who = parents[np.repeat(start[d] - (np.cumsum(p) - p), p) + np.arange(int(p.sum()))]
        cells = np.bincount(np.repeat(group_d, p) * n_parents + who, minlength=len(g) * n_parents)
        at = np.flatnonzero(cells >= least)
        k, parent, n_in = at // n_parents, at % n_parents, cells[at]
        # the block of a phrase's first entry under a parent
        has = np.flatnonzero(m > 0)
        home = entry_block[entry[has[np.searchsorted(group[has], k)]]]
        made = [home, h[first[g]].view(np.int64)[k], parent, n_in, of_all[g][k], new_all[g][k]]
        if pruned is not None:
            take = pruned(*made[2:])
            made = [c[take] for c in made]
        outs.append(made)
        lo = hi
    return [np.concatenate(c) for c in zip(*outs, strict=True)]


def spelled(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows (COUNTED) with the phrase itself as key."""
    names = [c.split()[0] for c in COUNTED.split(", ")]
    schema = pa.schema([("key", pa.string()), *[(c, pa.int32() if c == "parent" else pa.int64()) for c in names[1:]]])

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        block = Block(next(_rows(right.to_batches())))
        key = np.unique(block.grams("mined")[0])
        h = block.hashed(key)[0].view(np.int64)
        asked = left.column("h").to_numpy()
        take = np.flatnonzero(np.isin(h, asked))
        take = take[np.argsort(h[take])]
        strings = pa.array(block.strings(key[take]), pa.string())
        return pa.Table.from_arrays([strings.take(pa.array(np.searchsorted(h[take], asked))), *[left.column(c).combine_chunks() for c in names[1:]]], schema=schema)

    words = made.select("block", "relid", "words", "h1", "h2", "flags", "mined", "mined_n")
    return rows.select(*names).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(spell, "key string, " + ", ".join(COUNTED.split(", ")[1:]))


def hashed_keys(keys: DataFrame) -> DataFrame:
    """h: the hashes of a table of keys (key), as in COUNTED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(batch.column(0).to_pylist())[0].view(np.int64))], ["h"])

    return keys.select("key").mapInArrow(run, "h long")


#: Bytes of stored texts of a part, about, where phrases of texts are counted.
PART_BYTES = 4 << 20


def gram_counts(texts: DataFrame) -> DataFrame:
    """gram, df: in how many texts (text) each phrase of up to three tokens stands.

    Counted by numpy in blocks, then by Arrow in parts that a hash deals out: phrases travel as bytes, not as rows, and are compared whole.
    """
    texts = texts.select("text")
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n_parts = max(2 * texts.sparkSession.sparkContext.defaultParallelism, min(-(-size // PART_BYTES), 100_000))
    out = pa.schema([("part", pa.int32()), ("grams", pa.binary()), ("sizes", pa.binary()), ("n", pa.binary())])

    def count(filling: _Filling) -> pa.RecordBatch:
        words = list(filling.number)
        h1, h2 = _hashes(words)
        kind = np.uint16 if len(words) <= 65535 else np.uint32
        block = Block({"relid": np.array(filling.relid, np.int64).tobytes(), "h1": h1.tobytes(), "h2": h2.tobytes(), "flags": _word_flags(words).tobytes(), "mined": np.array(filling.mined, kind).tobytes(), "mined_n": np.array(filling.mined_n, np.int32).tobytes()})
        key, n = np.unique(_distinct(block, *block.grams("mined", PLAIN | APART)), return_counts=True)
        part = (block.hashed(key)[1] >> np.uint64(32)) % np.uint64(n_parts)
        order = np.argsort(part.astype(np.uint16) if n_parts <= 65535 else part, kind="stable")
        key, n, bounds = key[order], n[order].astype(np.int32), np.searchsorted(part[order], np.arange(n_parts + 1, dtype=np.uint64))
        names, (one, two, three) = pa.array(words, pa.large_string()), block.parts(key)
        length = 1 + (two >= 0) + (three >= 0)
        strings, places = [], []
        for k in range(1, MOST + 1):
            at = np.flatnonzero(length == k)
            columns = [names.take(pa.array(c[at])) for c in (one, two, three)[:k]]
            strings.append(pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if k > 1 else columns[0])
            places.append(at)
        back = np.argsort(np.concatenate(places), kind="stable")
        grams = pa.concat_arrays(strings).take(pa.array(back))
        _, ends, data = grams.buffers()
        ends, data = np.frombuffer(ends, np.int64)[: len(grams) + 1], np.frombuffer(data, np.uint8)
        sizes = np.diff(ends).astype(np.int32)
        had = [k for k in range(n_parts) if bounds[k] < bounds[k + 1]]
        cut = [(int(bounds[k]), int(bounds[k + 1])) for k in had]
        cells = [[data[ends[lo] : ends[hi]].tobytes() for lo, hi in cut], [sizes[lo:hi].tobytes() for lo, hi in cut], [n[lo:hi].tobytes() for lo, hi in cut]]
        return pa.RecordBatch.from_arrays([pa.array(had, pa.int32()), *[pa.array(c, pa.binary()) for c in cells]], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling = _Filling()
        for batch in batches:
            for text in batch.column(0):
                filling.add(len(filling.relid), text.as_py() or "", (), None)
                if filling.full(RELEASES):
                    if filling.mined:
                        yield count(filling)
                    filling = _Filling()
        if filling.mined:
            yield count(filling)

    def total(t: pa.Table) -> pa.Table:
        glue = lambda c: b"".join(x.as_py() for x in t.column(c))
        sizes = np.frombuffer(glue("sizes"), np.int32)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        grams = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(glue("grams")))
        n = pa.array(np.frombuffer(glue("n"), np.int32).astype(np.int64))
        sums = pa.table({"gram": grams, "n": n}).group_by("gram").aggregate([("n", "sum")])
        return pa.table({"gram": sums.column("gram").cast(pa.string()), "df": sums.column("n_sum")})

    dealt = texts.mapInArrow(run, "part int, grams binary, sizes binary, n binary").repartition(n_parts, "part")
    return dealt.groupBy("part").applyInArrow(total, "gram string, df long")


def _distinct(block: Block, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each run once for each release that it stands in."""
    wide = max(1, len(block.relid)).bit_length()
    if block.bits * MOST + wide <= 64:
        return np.unique((key << np.uint64(wide)) | doc.astype(np.uint64)) >> np.uint64(wide)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    return key[np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))] if len(key) else key
