"""Checks of model annotations against the texts that they came from."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.functions.text import foreign_script, has_cyrillic, invented_numbers, references


def first_words(text: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), 1, n), " ")


def realigned(inputs: DataFrame, answers: DataFrame, least: int = 3) -> DataFrame:
    """(batch, pos, input_pos): answers (batch, pos, echo) put to the input (batch, pos, text) whose first words they echo.

    If all echoes of a batch match their own input, or each just one input and no input twice, the batch is kept;
    else it is left out.
    """
    i = inputs.select("batch", F.col("pos").alias("input_pos"), first_words(F.col("text")).alias("head"))
    a = answers.select("batch", "pos", first_words(F.col("echo")).alias("said"))
    long_enough = F.size(F.split("said", " ")) >= least
    m = a.join(i, "batch").filter(long_enough & (F.startswith("head", "said") | F.startswith("said", "head")))
    n = answers.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    own = m.filter("pos = input_pos").groupBy("batch").agg(F.count(F.lit(1)).alias("own"))
    single = m.groupBy("batch", "pos").agg(F.count(F.lit(1)).alias("k"), F.min("input_pos").alias("input_pos")).filter("k = 1")
    uniq = single.groupBy("batch").agg(F.countDistinct("input_pos").alias("uniq"))
    all_own = n.join(own, "batch").filter("own = n").select("batch")
    moved = n.join(uniq, "batch").filter("uniq = n").join(all_own, "batch", "left_anti").select("batch")
    straight = a.join(all_own, "batch", "left_semi").select("batch", "pos", F.col("pos").alias("input_pos"))
    return straight.unionByName(single.join(moved, "batch", "left_semi").select("batch", "pos", "input_pos"))


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?…])\s+(?=[\p{Lu}\d\[«\"])", "\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def cited_only(cards: DataFrame) -> DataFrame:
    """``cards`` (id, text, cited array) with clean: sentences with a reference in range, in own script, no number invented."""
    n = F.size("cited")

    def good(s: Column) -> Column:
        r = references(s)
        used = F.transform(F.filter(r, lambda x: (x >= 1) & (x <= n)), lambda x: F.element_at("cited", x))
        return (F.size(r) > 0) & F.forall(r, lambda x: (x >= 1) & (x <= n)) & ~foreign_script(s) & (F.size(invented_numbers(s, used)) == 0)

    return cards.withColumn("clean", F.array_join(F.filter(sentences(F.col("text")), good), " "))


def drop_reason(sentence: Column, cited: Column) -> Column:
    """The first check that a sentence fails, or empty."""
    r, n = references(sentence), F.size(cited)
    return (
        F.when(F.size(r) == 0, "no reference").when(F.exists(r, lambda x: (x < 1) | (x > n)), "dead reference").when(foreign_script(sentence), "foreign script")
        .when(F.size(invented_numbers(sentence, cited)) > 0, "invented number").otherwise("")
    )


#: Signs that a quote may have in another form than its page.
_SIGNS = {"‘": "'", "’": "'", "“": '"', "”": '"', "«": '"', "»": '"', "–": "-", "—": "-", "−": "-", "ё": "е", "Ё": "Е"}
#: What stands for words left out; a quote needs a part of so many characters; a part may differ so much.
_LEFT_OUT, LEAST_PART, LEAST_RATIO = r"\[\.\.\.\]|\(\.\.\.\)|\.\.\.|…", 20, 0.9
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
#: Letters in a row that a part and its place on the page are expected to share.
GRAM = 3


def _one_form(text: str) -> str:
    """Compatibility forms, quotes, dashes, case and white space brought to one form."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(str.maketrans(_SIGNS)).casefold().split())


def one_form(text: Column) -> Column:
    """``text`` with compatibility forms, quotes, dashes, case and white space brought to one form; null stays null."""

    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _one_form(t) for t in batch], dtype="object")

    return of(text)


def _whole_numbers(page: str, begin: int, end: int) -> bool:
    """Whether neither end of a place lies between two digits."""
    return not any(0 < k < len(page) and page[k - 1].isdigit() and page[k].isdigit() for k in (begin, end))


def _grams(text: str) -> np.ndarray:
    """A number for each run of GRAM characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = max(0, len(points) - GRAM + 1)
    out = np.zeros(n, np.int64)
    for k in range(GRAM):
        out = (out << 21) | points[k : k + n]
    return out


def _likely_begins(part: str, page_grams: np.ndarray, begin: int, slack: int) -> list[int]:
    """Where ``part`` may begin on the page: where as many grams fall on near diagonals as its edits must leave."""
    own = _grams(part)
    order = np.argsort(own, kind="stable")
    at = begin + np.flatnonzero(np.isin(page_grams[begin:], own))
    low = np.searchsorted(own[order], page_grams[at], "left")
    n = np.searchsorted(own[order], page_grams[at], "right") - low
    pick = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    diagonal = np.sort(np.repeat(at, n) - order[pick])
    edits = int((1 - LEAST_RATIO) * (2 * len(part) + slack))
    least = max(1, len(own) - GRAM * edits)
    if len(diagonal) < least:
        return []
    found: list[int] = []
    for i in np.flatnonzero(diagonal[least - 1 :] - diagonal[: len(diagonal) - least + 1] <= 2 * slack):
        middle = int(diagonal[i + least // 2])
        if not found or middle - found[-1] > slack:
            found.append(middle)
    return found


def _near_end(part: str, page: str, page_grams: np.ndarray, begin: int) -> int | None:
    """The first end of a place that is like ``part``, or nothing.

    Around each likely begin, windows of nearly the part's length are aligned with it by their longest common
    subsequence, kept in the bits of one number that takes in a character of the page at a time.
    """
    slack = max(1, len(part) // 10)
    where: dict[str, int] = {}
    for k, c in enumerate(part):
        where[c] = where.get(c, 0) | 1 << k
    full, numbers = (1 << len(part)) - 1, _NUMBER.findall(part)
    for middle in _likely_begins(part, page_grams, begin, slack):
        best = None
        for left in range(max(begin, middle - slack), max(begin, middle + slack) + 1):
            rest = full
            for right in range(left + 1, min(len(page), left + len(part) + slack) + 1):
                hit = rest & where.get(page[right - 1], 0)
                rest = ((rest + hit) | (rest - hit)) & full
                size = right - left
                if size < len(part) - slack or (best is not None and right >= best):
                    continue
                like = 2 * (len(part) - rest.bit_count()) >= LEAST_RATIO * (size + len(part))
                if like and _whole_numbers(page, left, right) and _NUMBER.findall(page[left:right]) == numbers:
                    best = right
        if best is not None:
            return best
    return None


def _part_end(part: str, page: str, page_grams: np.ndarray, begin: int) -> int | None:
    """The end of the first place of ``part`` from ``begin`` on: word for word if there is one, else nearly so."""
    at = page.find(part, begin)
    while at >= 0:
        if _whole_numbers(page, at, at + len(part)):
            return at + len(part)
        at = page.find(part, at + 1)
    return _near_end(part, page, page_grams, begin) if len(part) > GRAM else None


def _appears(quote: str | None, page: str | None) -> bool:
    parts = [p for p in (_one_form(x).strip("'\" ") for x in re.split(_LEFT_OUT, quote or "")) if p]
    if max(map(len, parts), default=0) < LEAST_PART:
        return False
    held, at = _one_form(page or ""), 0
    grams = _grams(held)
    for part in parts:
        at = _part_end(part, held, grams, at)
        if at is None:
            return False
    return True


def quote_appears(quote: Column, page: Column) -> Column:
    """Whether a quote is on a page, in time near-linear in the page.

    Its parts between ellipses stand there in order, one of them of 20 characters or more. A part may differ from its
    place a little (a ratio of 0.9), but its numbers are the same, and no place begins or ends inside a number.
    """

    @F.pandas_udf("boolean")
    def of(quotes: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([_appears(q, p) for q, p in zip(quotes, pages)], dtype="bool")

    return of(quote, page)


def named_companies(rows: DataFrame, stop: list[str], most: int = 8) -> DataFrame:
    """(id, company, n) of ``rows`` (id, text, companies): names on word borders with a capital there; first spelling kept."""
    each = rows.select("id", "text", F.posexplode("companies").alias("at", "company")).withColumn("company", F.trim("company"))
    padded = F.concat(F.lit(" "), F.regexp_replace("text", r"[^\p{L}\p{N}&.+-]+", " "), F.lit(" "))
    low, name = F.lower(padded), F.concat(F.lit(" "), F.lower("company"), F.lit(" "))
    spelled = F.substring(padded, F.instr(low, name) + 1, F.length("company"))
    ok = each.filter((F.length("company") > 1) & ~F.lower("company").isin(stop) & F.contains(low, name)).withColumn("seen", spelled).filter(F.col("seen").rlike(r"\p{Lu}"))
    first = ok.withColumn("_n", F.row_number().over(W.partitionBy("id", F.lower("company")).orderBy("at"))).filter("_n = 1")
    return first.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("at"))).filter(F.col("n") <= most).select("id", "company", "n")


def grounded_terms(terms: DataFrame, batches: DataFrame, generic: list[str]) -> DataFrame:
    """Terms (batch, term) of 2 to 40 characters, not generic, that the text of their batch (batch, text) holds."""
    low = F.lower(F.trim("term"))
    t = terms.withColumn("term", low).filter(F.length("term").between(2, 40) & ~F.col("term").isin(generic)).distinct()
    return t.join(batches, "batch").filter(F.contains(F.lower("text"), F.col("term"))).select("batch", "term")


def relevant(rows: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose verdict is not no: what was not judged stays."""
    return rows.join(verdicts.select(*keys, "verdict"), keys, "left").filter(F.coalesce("verdict", F.lit(True))).drop("verdict")


def assessment(answers: DataFrame, kinds: tuple, n_evidence: str = "n_evidence") -> DataFrame:
    """``answers`` (id, body JSON) parsed: kind among ``kinds`` or an error; reason only with a reference in range; players 0 to 20."""
    body = F.from_json("body", "kind string, reason string, players int, grade int")
    out = answers.withColumn("_b", body)
    r = references(F.coalesce(F.col("_b.reason"), F.lit("")))
    cited = F.exists(r, lambda x: (x >= 1) & (x <= F.col(n_evidence)))
    ok = F.coalesce(F.col("_b.kind").isin(*kinds), F.lit(False))
    return out.select(
        "id", ok.alias("valid"), F.when(ok, F.col("_b.kind")).alias("kind"), F.when(cited, F.col("_b.reason")).otherwise("").alias("reason"),
        F.greatest(F.lit(0), F.least(F.lit(20), F.coalesce(F.col("_b.players"), F.lit(0)))).alias("players"), F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(F.col("_b.grade"), F.lit(0)))).alias("grade"),
    )


def event_problems(events: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """``events`` (kind, data JSON) with missing: the fields that their kind needs and that aren't there. No row is dropped."""
    need = F.create_map(*(x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    has = F.coalesce(F.json_object_keys("data"), F.array().cast("array<string>"))
    want = F.coalesce(F.try_element_at(need, F.col("kind")), F.array().cast("array<string>"))
    return events.withColumn("missing", F.array_except(want, has))


def card_audit(cards: DataFrame, *by: str) -> DataFrame:
    """Checks and defects of cards (text, sources, companies): dead references, numbers and companies that no source holds."""
    said = F.lower(F.array_join("sources", " "))
    refs = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), 1), lambda r: r.cast("int"))
    numbers = F.regexp_extract_all(F.regexp_replace("text", r"\[\d+\]", " "), F.lit(r"\d+"), 0)
    own = cards.select(
        *by, F.size(refs).alias("refs"), F.size(F.filter(refs, lambda r: (r < 1) | (r > F.size("sources")))).alias("dead_refs"),
        F.size(numbers).alias("numbers"), F.size(F.filter(numbers, lambda n: ~F.contains(said, n))).alias("absent_numbers"),
        F.size("companies").alias("companies"), F.size(F.filter("companies", lambda c: ~F.contains(said, F.lower(c)))).alias("absent_companies"),
    )
    measures = [c for c in own.columns if c not in by]
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("cards"), *(F.sum(m).alias(m) for m in measures))


def retext(sections: DataFrame) -> DataFrame:
    """Sections (title, why, refs, sources) with needs_title, an empty reason filled and references cut to the sources there are."""
    return sections.withColumns(
        {
            "needs_title": ~has_cyrillic("title"),
            "why": F.coalesce(F.nullif(F.trim("why"), F.lit("")), F.lit("no reason given")),
            "refs": F.filter("refs", lambda r: r.between(1, F.col("sources"))),
        }
    )
