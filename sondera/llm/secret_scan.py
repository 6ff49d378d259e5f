"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary spells ordinary words in few tokens and random strings in many. A run of key-like characters is
reported as ``random`` if it, or a part of it between separators that is long enough by itself, has few characters per
token. Known digests and identifiers (hexadecimal digests, UUIDs, ULIDs, integrity strings, numbers and dates) are taken
out first, wherever they stand between separators, and so are words and numbers joined by separators. What is tested has
letters of both cases or letters and digits; letters alone must have fewer characters per token still.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import table

#: The base patterns, the least length of what counts, and the group whose length it is.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = ("assign", "access", "hex", "random")
#: ``hex`` as searched: no shorter run can count, and runs are maximal either way.
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Random strings: at least so many characters, and at most so many characters for each token.
LEAST_CHARS, MOST_CHARS_PER_TOKEN = 20, 2.0
#: The same for letters alone, which names in mixed case are, too.
MOST_CHARS_PER_TOKEN_LETTERS = 1.75
#: Longer runs are not remembered, only tested anew: bounds the memory of answers.
REMEMBERED_CHARS = 256
VOCABULARY = "byte_bpe_50k.tiktoken"

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
_KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"  # md5, sha1, sha2
    r"|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"  # UUID
    r"|[0-9_=+/-]+"  # numbers, dates, rules
    r"|sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+=*",  # integrity strings
    re.I,
)
_INSIDE = re.compile(
    r"(?<![0-9a-z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    r"|[0-7][0-9a-hjkmnp-tv-z]{25})(?![0-9a-z])",  # ULID
    re.I,
)
_SEPARATORS = re.compile(r"[/_=-]+")
_WORDS = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*|[0-9]*")
_CLASSES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))


@cache
def encoding(vocabulary: str):
    """The tiktoken encoding of a vocabulary file; loaded once in each worker."""
    import os

    import public_tokenizers
    import tiktoken

    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _random_part(part: str, vocabulary: str) -> bool:
    """The token-efficiency test of one string."""
    digits = bool(_CLASSES[2].search(part))
    if sum(bool(c.search(part)) for c in _CLASSES) < 2:
        return False
    pieces = re.split(r"[+/_=-]+", part)
    if max(map(len, pieces)) < 12 and all(_WORDS.fullmatch(p) for p in pieces):  # words and numbers, joined
        return False
    return len(part) <= (MOST_CHARS_PER_TOKEN if digits else MOST_CHARS_PER_TOKEN_LETTERS) * len(encoding(vocabulary).encode_ordinary(part))


def _tested(run: str, vocabulary: str) -> bool:
    if _KNOWN.fullmatch(run):
        return False
    rest = _INSIDE.sub("/", run)
    whole = [run] if rest == run else []
    return any(_random_part(p, vocabulary) for p in (*whole, *(p for p in _SEPARATORS.split(rest) if len(p) >= LEAST_CHARS)))


_remembered = lru_cache(maxsize=1 << 16)(_tested)


def looks_random(run: str, vocabulary: str = VOCABULARY) -> bool:
    """Whether a run of key-like characters is random by the token-efficiency test, as a whole or in one of its parts."""
    return (_remembered if len(run) <= REMEMBERED_CHARS else _tested)(run, vocabulary)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end) of the base patterns, in code points, in order."""
    found = []
    for place, (kind, pattern, group, least) in enumerate(BASE):
        for m in (_HEX if kind == "hex" else pattern).finditer(text):
            if len(m.group(group)) >= least:
                found.append((m.start(), place, m.end()))
    return sorted(found)


def scan(text: str | None, vocabulary: str = VOCABULARY) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a whole text. A random run inside a base span adds no span of its own."""
    if not text:
        return [], []
    base = base_spans(text)
    more = []
    for m in _RUN.finditer(text):
        if looks_random(m.group(), vocabulary) and not any(s <= m.start() and m.end() <= e for s, _, e in base):
            more.append((m.start(), KINDS.index("random"), m.end()))
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end, code points).

    A null text counts as empty: no spans, and the digest of the empty string. Rows are independent, so ties and
    repeated rows give equal answers, and an empty table an empty one. Texts are read whole, and so are runs of any length.
    The columns added replace those of the same names.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for value in batch:
                base, every = scan(value, vocabulary)
                n = [sum(k == place for _, k, _ in every) for place in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    found = docs.withColumn("_found", of(text))
    names = ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")
    return found.withColumns({n: F.col(f"_found.{n}") for n in names}).drop("_found")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
