"""URL filter: logistic regression on hashed character n-grams of host and path, below a table of explicit rules.

The model is trained on the driver, once in a session, from a small labelled URL table (``LABEL_LIMIT`` rows at most)
and is a vector of ``DIMS`` weights; judging is one pass over the urls without a shuffle. The default table knows unwanted
hosts by words; a host whose words and their parts it doesn't hold counts as wanted, so a table of one's own is better.

Defined cases: a null url, and one without ``://``, has an empty host and path, fits no rule and is judged by the model
like any other. Of fitting rules of equal length the first by string counts. Very long urls are judged whole. Repeated
rows are judged alike. Other columns of the input stay, but those that
bear the name of a column that ``judge`` adds are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.columns import fresh, without
from termweave.llm.wordspans import mix

DIMS = 1 << 14
LABEL_LIMIT = 100_000

#: The rules (action, host, path) in force.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Words that mark unwanted hosts, and words of ordinary ones, from which the default labelled table is made.
UNWANTED = (
    "adult ads adserver affiliate babes bets betting bingo bonus botnet camgirls casino cheap cialis click clickbait coupon crack cracked dating deals discount drugs escort exploit fakes fetish free gambling girls hack "
    "hentai hotgirls jackpot keygen loans lottery lotto malware miracle naked nude payday pharma phish phishing pills piracy poker popunder porn promo prize ransom replica roulette scam sexy sex slots spam "
    "spyware steroids stolen strip torrent track tracker trojan viagra virus warez webcams weightloss win winner xxx"
).split()
WANTED = (
    "archive library museum school science garden weather history journal council review market kitchen travel music health sports forum report society "
    "academy art books bridge city clinic college culture data energy farm film gallery hospital housing institute law maps nature news office park press radio research river station theatre trade university village water"
).split()
#: Frequent English letter pairs; ordinary but unknown names are made of them.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()


def default_labels() -> list[tuple[str, int]]:
    """(url, 1 for unwanted) from the words above by a rule: each in a few host shapes and paths."""
    rng = np.random.Generator(np.random.PCG64(7))
    ends, fronts = ("com", "net", "org"), ("", "www.", "blog.", "m.")
    tails = ("/", "/en/{}", "/fr/{}.html", "/de/{}?page=2", "/es/{}/", "/en/{}#top")
    bad = [f"{a}-{b}" for a in UNWANTED for b in (*rng.choice(UNWANTED, 5), "x", "online")] + [f"{b}{a}" for a in UNWANTED for b in rng.choice(UNWANTED, 3)]
    good = ["".join(rng.choice(PAIRS, k)) for k in rng.integers(2, 6, len(bad))]
    good[::3] = [f"{a}{b}" for a, b in zip(rng.choice(WANTED, len(good[::3])), rng.choice(["", "-online", "-news", "s", "-x"], len(good[::3])))]
    out = []
    for i, both in enumerate(zip(bad, good)):
        # an unwanted and an ordinary host share all else, so only the name tells them apart
        front, end, tail = fronts[int(rng.integers(4))], ends[int(rng.integers(3))], tails[int(rng.integers(len(tails)))].format(int(rng.integers(1, 1000)))
        out += [(f"https://{front}{name}.{'example.' if i % 2 else ''}{end}{tail}", 1 - k) for k, name in enumerate(both)]
    return out


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of one url, as host_of and path_of have them."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:stop]


_POWER, _SEEDS = np.uint64(0x9E3779B97F4A7C15), {"h": np.uint64(0xA24BAED4963EE407), "p": np.uint64(0xC2B2AE3D27D4EB4F)}


def _grams(kind: str, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct 3- to 5-gram (of bytes, hashed) of the texts, with marks at their ends."""
    data = [f"^{t}$".encode("utf-8", "replace") for t in texts]
    size = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(data)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # bytes from here to the text's end
    found, h = [], np.full(len(flat), _SEEDS[kind])
    for n in range(1, 6):
        at = np.flatnonzero(left >= n)
        h[at] = mix(h[at] * _POWER + flat[at + n - 1])
        if n >= 3:
            found.append(row[at] * DIMS + (h[at] % np.uint64(DIMS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both // DIMS, both % DIMS


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the distinct 3- to 5-grams of each host and path; either part has length 1."""
    out = []
    for kind, texts in (("h", hosts), ("p", paths)):
        row, at = _grams(kind, texts)
        out.append((row, at, np.bincount(row, minlength=len(texts))[row] ** -0.5))
    return tuple(np.concatenate(x) for x in zip(*out))


Model = tuple[np.ndarray, float]


def train(labels: Sequence[tuple[str | None, int]], l2: float = 1e-5, rounds: int = 3000, rate: float = 20.0) -> Model:
    """Weights and bias by full-batch gradient descent on the mean logistic loss."""
    if len(labels) > LABEL_LIMIT:
        raise ValueError(f"{len(labels)} labelled urls; the limit is {LABEL_LIMIT}")
    weights, bias = np.zeros(DIMS), 0.0
    if not labels:
        return weights, bias
    row, at, value = features(*zip(*(parts(u) for u, _ in labels)))
    y = np.array([float(k) for _, k in labels])
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-np.bincount(row, weights[at] * value, len(y)) - bias)) - y
        weights -= rate * (np.bincount(at, off[row] * value, DIMS) / len(y) + l2 * weights)
        bias -= off.mean()
    return weights, bias


@cache
def default_model() -> Model:
    """The model of the default labels, trained once in a session."""
    return train(default_labels())


def probabilities(model: Model, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """That each url is unwanted."""
    if not len(hosts):
        return np.zeros(0)
    row, at, value = features(hosts, paths)
    return 1 / (1 + np.exp(-np.bincount(row, model[0][at] * value, len(hosts)) - model[1]))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's string and action, null without one; equal lengths: the first by string."""
    which, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, action = F.when(fits, F.lit(h + p)).otherwise(which), F.when(fits, F.lit(kind)).otherwise(action)
    return which, action


def judge(pages: DataFrame, labels: Sequence[tuple[str | None, int]] | None = None, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """The rows with host, path, rule, score (the model's probability of unwanted) and verdict (allow or block)."""
    pages = without(pages, *({"host", "path", "rule", "score", "verdict"} - {url}))
    action_ = fresh(pages, "_action")
    model = default_model() if labels is None else train(labels)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            # urls in lots of a bounded number of bytes, so that long ones take no more memory
            lots = np.cumsum([len(h) + len(p) for h, p in zip(hosts, paths)]) // (1 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), len(hosts)]
            yield pd.Series(np.concatenate([probabilities(model, hosts[a:b].tolist(), paths[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]) if len(hosts) else [], dtype="float64")

    rows = pages.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    which, action = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": which, "score": F.pandas_udf(score, "double")("host", "path"), action_: action})
    return rows.withColumn("verdict", F.coalesce(action_, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).drop(action_)
