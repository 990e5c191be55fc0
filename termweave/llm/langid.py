"""Language identification by segmentation-marginalised unigrams.

For each language every piece of a fixed public vocabulary has a probability. A word's probability in a language is the
sum over all its segmentations into pieces of the product of their probabilities, which a forward algorithm computes; a
text's is the product over its words. Piece probabilities are fitted by expectation maximisation on a bounded sample:
about ``SAMPLE_DOCS`` documents of each language, of longer texts ``SAMPLE_CHARS`` characters. Texts are judged whole.

Defined cases: a null text and one without a letter are ``und`` with score 0; so is every text if nothing was learned.
Ties go to the language that sorts first. Documents with null lang teach nothing. Repeated rows get the same answer.
Other columns stay, but those named lang_pred or score are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.columns import fresh, without
from termweave.llm.wordspans import _BYTES, _STEP, CHUNK, NOT_LETTER, Lookup, chunks, mix, powers, words

SAMPLE_DOCS = 150
SAMPLE_CHARS = 20_000
MAX_PIECE = 10
#: Longer words are scored in parts of so many bytes.
MAX_WORD = 40
#: Words whose scores a worker keeps; a matter of memory, not of results.
KEEP = 500_000
FLOOR = 1e-300


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod ``mod`` is ``rest``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def load_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces that a lower-cased word can hold, after an optional space that marks its start; and all single bytes."""
    with open(path, "rb") as f:
        tokens = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    out = {bytes([b]) for b in range(256)}
    for t in tokens:
        body = t.removeprefix(b" ")
        if body and len(t) <= MAX_PIECE and all(b > 127 or 97 <= b <= 122 for b in body):
            out.add(t)
    return sorted(out)


_INVERSE = np.full(MAX_WORD + 2, np.uint64(pow(int(_STEP), -1, 1 << 64)))
_INVERSE[0] = 1
_INVERSE = np.multiply.accumulate(_INVERSE)
_POWERS = powers(MAX_WORD + 2)


def _prefix(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum(_BYTES[rows] * _POWERS[: rows.shape[1]], axis=1, out=out[:, 1:])
    return out


def _part(prefix: np.ndarray, i: int, j: int) -> np.ndarray:
    """Hash of bytes i to j of each row."""
    return mix((prefix[:, j] - prefix[:, i]) * _INVERSE[i] + np.uint64(j - i))


class Pieces:
    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        keys = np.array([_part(_prefix(np.frombuffer(p, np.uint8)[None]), 0, len(p))[0] for p in pieces], np.uint64)
        self.lookup = Lookup(keys, np.arange(len(pieces), dtype=np.int32))

    def lattice(self, rows: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows that have a piece there, its number) for words of one length."""
        prefix, out = _prefix(rows), []
        for j in range(1, rows.shape[1] + 1):
            for i in range(max(0, j - MAX_PIECE), j):
                found = self.lookup(_part(prefix, i, j))
                have = np.flatnonzero(found >= 0)
                if len(have):
                    out.append((i, j, have, found[have]))
        return out


def forward(lattice: list, n: int, length: int, prob: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: probability of all ways to reach the position."""
    alpha = np.zeros((length + 1, n, prob.shape[1]))
    alpha[0] = 1
    for i, j, have, piece in lattice:
        alpha[j, have] += alpha[i, have] * prob[piece]
    return alpha


def cut(word: bytes) -> list[bytes]:
    """The word after a space, in parts of MAX_WORD bytes."""
    word = b" " + word
    return [word[i : i + MAX_WORD] for i in range(0, len(word), MAX_WORD)]


def by_length(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which parts, their bytes as a matrix) for each length."""
    sizes = np.array([len(p) for p in parts])
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        for lo in range(0, len(which), 1 << 15):
            some = which[lo : lo + (1 << 15)]
            yield some, np.frombuffer(b"".join([parts[k] for k in some]), np.uint8).reshape(len(some), n)


def letters(word: bytes) -> bytes:
    """The word's letters in lower case."""
    text = word.decode("utf-8", "replace")
    return (text if text.isalpha() else "".join(c for c in text if c.isalpha())).lower().encode()


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    prob: np.ndarray


def fit(samples: list[tuple[str, str]], pieces: list[bytes], rounds: int = 5, prior: float = 0.05) -> Model:
    """samples: (language, text). Expectation maximisation from equal probabilities; prior: pseudo-count of each piece."""
    languages = sorted({lang for lang, _ in samples})
    found = Pieces(pieces)
    counts: dict[bytes, np.ndarray] = {}
    for lang, text in samples:
        w = words(pa.array([text]), NOT_LETTER)
        for a, b in zip(w.starts, w.ends):
            for part in cut(letters(w.bytes[a:b].tobytes())):
                counts.setdefault(part, np.zeros(len(languages)))[languages.index(lang)] += 1
    parts = list(counts)
    groups = [(rows.shape, np.array([counts[parts[k]] for k in some]), found.lattice(rows)) for some, rows in by_length(parts)] if parts else []
    prob = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds if languages else 0):
        expected = np.full(prob.shape, prior)
        for (n, length), weight, lattice in groups:
            alpha = forward(lattice, n, length, prob)
            beta = np.zeros_like(alpha)
            beta[length] = weight / np.maximum(alpha[length], FLOOR)
            for i, j, have, piece in reversed(lattice):
                flow = beta[j, have] * prob[piece]
                beta[i, have] += flow
                np.add.at(expected, piece, flow * alpha[i, have])
        prob = expected / expected.sum(0)
    return Model(languages, pieces, prob)


class Scorer:
    """Scores texts by a model; keeps the scores of words seen."""

    def __init__(self, model: Model) -> None:
        self.model, self.found = model, Pieces(model.pieces)
        self.known, self.score = np.zeros(0, np.uint64), np.zeros((0, len(model.languages) + 1))

    def of_words(self, raw: list[bytes]) -> np.ndarray:
        """Log probability of each word by language, and at the end whether it has letters."""
        out = np.zeros((len(raw), len(self.model.languages) + 1))
        parts, owner = [], []
        for k, word in enumerate(raw):
            if body := letters(word):
                out[k, -1] = 1
                for p in cut(body):
                    parts.append(p)
                    owner.append(k)
        owner = np.array(owner, np.int64)
        for some, rows in by_length(parts) if parts else ():
            alpha = forward(self.found.lattice(rows), *rows.shape, self.model.prob)[-1]
            np.add.at(out[:, :-1], owner[some], np.log(np.maximum(alpha, FLOOR)))
        return out

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability under equal priors, for each text."""
        total = np.zeros((len(texts), len(self.model.languages) + 1))
        for lo, hi in chunks(texts, CHUNK):
            w = words(texts.slice(lo, hi - lo), NOT_LETTER)
            h, first, inverse, n = self._distinct(w)
            if len(h):
                total[lo:hi] = np.stack([np.bincount(w.doc, column[inverse], hi - lo) for column in self._scores(w, h, first).T], 1)
        has, log = total[:, -1] > 0, total[:, :-1]
        if not self.model.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = log.argmax(1)
        posterior = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
        return [self.model.languages[b] if ok else "und" for b, ok in zip(best, has)], np.where(has, posterior, 0.0)

    @staticmethod
    def _distinct(w) -> tuple[np.ndarray, ...]:
        return np.unique(w.hashes(), return_index=True, return_inverse=True, return_counts=True)

    def _scores(self, w, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, h)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == h[there]
        if not there.all():
            fresh = np.flatnonzero(~there)
            raw = [w.bytes[a:b].tobytes() for a, b in zip(w.starts[first[fresh]], w.ends[first[fresh]])]
            new = self.of_words(raw)
            if len(self.known) > KEEP:
                self.known, self.score = self.known[:0], self.score[:0]
                return self._scores(w, h, first)
            known = np.concatenate([self.known, h[fresh]])
            order = np.argsort(known)
            self.known, self.score = known[order], np.concatenate([self.score, new])[order]
            at = np.searchsorted(self.known, h)
        return self.score[at]


def sample(docs: DataFrame, learn: Column, per_language: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(lang, text) of about per_language documents of each language, chosen by a hash of the id, up to most_chars of each text; documents of one id count once."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    of = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not of:
        return []
    share = F.create_map(*[F.lit(x) for k, n in of.items() for x in (k, min(1.0, per_language / n))])
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    rows = chosen.groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, most_chars)).alias("text")).orderBy("lang", F.xxhash64("doc_id")).collect()
    return [(r["lang"], r["text"]) for r in rows]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with lang_pred and score; one pass, no shuffle. The model's size is bounded by vocabulary times languages."""
    docs = without(docs, "lang_pred", "score")
    pred = fresh(docs, "_pred")
    found = docs.withColumn(pred, judge(docs.sparkSession, model)("text"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(pred)["lang_pred"].alias("lang_pred"), F.col(pred)["score"].alias("score"))


def judge(spark: SparkSession, model: Model):
    """A function from text to (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            lang, score = scorer(texts)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
