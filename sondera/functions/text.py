"""Column functions on names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that take no part in comparing names.
NAME_STOP = "a an the of for and or in on with via to by from using based as at into over vs versus".split()
#: Words that a phrase neither begins nor ends with.
PHRASE_STOP = (
    "a an the of for and in on with to via from by at as is are be using based towards toward its we our under over into new "
    "learning deep neural network networks model models method methods approach approaches data analysis study more what does "
    "how improving improved efficient novel case framework system systems"
).split()
#: Words of the market, which name no mechanism.
MARKET_WORDS = (
    "enterprise software platform platforms solution solutions service services system systems technology technologies tool tools "
    "protection threat threats intelligence automation orchestration scaling stack suite infrastructure application applications "
    "operations management monitoring advanced autonomous smart modern digital cloud agent agents multi next generation based "
    "driven powered native"
).split()
#: Words around the name of a field, and the fields that are too broad to be a technique.
FILLER = (
    "method methods model models approach approaches technique techniques algorithm algorithms framework frameworks based using "
    "with via for of the a an and application applications tool tools system systems integration use"
).split()
TOO_BROAD = (
    "machine learning", "deep learning", "artificial intelligence", "neural networks", "large language models",
    "natural language processing", "computer vision", "reinforcement learning", "data science", "blockchain",
    "internet of things", "cloud computing", "edge computing", "robotics", "optimization",
)
#: Words that no company is looked up by, and words that company names share.
CATALOGUE_STOP = "a an and for of the to in on with by based using via ai platform platforms system systems technology technologies solution solutions".split()
COMPANY_GENERIC = (
    "ai ml security systems technologies technology labs lab inc ltd llc gmbh corp group platform software solutions data cloud "
    "digital network networks computing the and для robotics research protocol dynamics communications ventures capital"
).split()
SHORT_CORE, LOOSE_WORDS = 6, 4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def without(words: Column, stop: list[str]) -> Column:
    """``words`` that are not in ``stop``; repeats stay."""
    return F.filter(words, lambda w: ~w.isin(list(stop)))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), 0)


def padded(text: Column | str) -> Column:
    """Tokens joined by spaces, with a space at either end: a token begins behind a space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", " ")), F.lit(" "))


def significant(text: Column | str) -> Column:
    """Words of three characters or more, for comparing names."""
    return without(F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9+#-]{3,}"), 0), NAME_STOP)


def loose_words(text: Column | str) -> Column:
    """Distinct words of any length, those of up to three characters first, then the longest; ties keep their order."""
    words = F.array_distinct(without(F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9+#-]+"), 0), NAME_STOP))
    keyed = F.transform(words, lambda w, i: F.struct((F.length(w) > 3).alias("long"), (-F.length(w)).alias("size"), i.alias("at"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda k: k["w"])


def core_matches(tok: Column, core: Column) -> Column:
    """Whether a padded text names a core: its tokens in a row, the last a prefix; a short core whole or with s."""
    want = F.trim(padded(core))
    short = (F.length(F.trim(core)) < SHORT_CORE) & ~want.contains(" ")
    whole = tok.contains(F.concat(F.lit(" "), want, F.lit(" "))) | tok.contains(F.concat(F.lit(" "), want, F.lit("s ")))
    return (want != "") & F.when(short, whole).otherwise(tok.contains(F.concat(F.lit(" "), want)))


def loose_tokens(label: Column) -> Column:
    """The tokens that a label's text must hold: of its first four loose words."""
    return F.flatten(F.transform(F.slice(loose_words(label), 1, LOOSE_WORDS), lambda w: tokens(w)))


def label_matches(tok: Column, label: Column) -> Column:
    """Whether a padded text holds all words of a label, in any order; labels of one word match as a core."""

    def has(t: Column) -> Column:
        whole = tok.contains(F.concat(F.lit(" "), t, F.lit(" "))) | tok.contains(F.concat(F.lit(" "), t, F.lit("s ")))
        return F.when(F.length(t) <= 2, whole).otherwise(tok.contains(F.concat(F.lit(" "), t)))

    return F.when(F.size(loose_words(label)) > 1, F.forall(loose_tokens(label), has)).otherwise(core_matches(tok, label))


def fold_plural(word: Column) -> Column:
    """Plural to singular: ies to y, s dropped but for ss, us and is."""
    plain_s = word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us") & ~word.endswith("is")
    return (
        F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.expr("''"), word.substr(F.lit(1), F.length(word) - 3), F.lit("y")))
        .when((F.length(word) > 3) & plain_s, word.substr(F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def folded(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), 0), fold_plural)


def windows(words: Column, n: int) -> Column:
    """For each word an array of it and the n - 1 after it, nulls past the end.

    The words are shifted as a whole and zipped: slicing at every place would copy the array each time.
    """
    out = F.transform(words, lambda w: F.array(w))
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), lambda run, w: F.array_append(run, w))
    return out


def ngrams(words: Column, n: int) -> Column:
    """Arrays of ``n`` words in a row; none for fewer words."""
    return F.filter(windows(words, n), lambda g: g[n - 1].isNotNull())


def phrases(title: Column | str) -> Column:
    """Distinct phrases of two and three words that no stop word begins or ends."""
    words = F.regexp_extract_all(F.lower(_col(title)), F.lit(r"[a-z][a-z0-9\-]+"), 0)
    both = F.concat(ngrams(words, 2), ngrams(words, 3))
    good = F.filter(both, lambda g: ~F.element_at(g, 1).isin(PHRASE_STOP) & ~F.element_at(g, -1).isin(PHRASE_STOP))
    return F.array_distinct(F.transform(good, lambda g: F.array_join(g, " ")))


def title_of(text: Column | str) -> Column:
    """What stands before the first period with a space behind it."""
    return F.substring_index(_col(text), ". ", 1)


def term_of(title: Column | str, body: Column | str, chars: int = 240) -> Column:
    """Title and the start of the body, with a period between them unless the title ends in a sign."""
    title, start = F.trim(_col(title)), F.trim(F.substring(F.trim(F.coalesce(_col(body), F.lit(""))), 1, chars))
    sign = title.rlike(r"[.!?…]$")
    return F.when(start == "", title).otherwise(F.concat(title, F.when(sign, F.lit(" ")).otherwise(F.lit(". ")), start))


def parts(words: Column) -> Column:
    """Words cut at hyphens and slashes, pieces of three characters or more."""
    return F.filter(F.flatten(F.transform(words, lambda w: F.split(w, "[-/]"))), lambda p: F.length(p) > 2)


def query_words(text: Column | str) -> Column:
    """All words of a query that a label may repeat without saying anything new."""
    low = F.lower(_col(text))
    words = F.array_union(significant(low), F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 2))
    return F.array_union(words, parts(words))


def is_category(label: Column | str, asked: Column) -> Column:
    """Whether a label has no word beyond those ``asked`` and the market's."""
    return F.size(without(F.array_except(parts(significant(label)), asked), MARKET_WORDS)) == 0


def specificity(label: Column | str, asked: Column) -> Column:
    """Words of a label beyond those asked and the market's: 0 to 3."""
    return F.least(F.size(F.array_distinct(without(F.array_except(significant(label), asked), MARKET_WORDS))), F.lit(3))


def too_broad(technique: Column) -> Column:
    words = without(F.filter(F.split(F.lower(technique), r"[\s\-/]+"), lambda w: w != ""), FILLER)
    return F.array_join(words, " ").isin(list(TOO_BROAD))


def clean_technique(raw: Column | str) -> Column:
    """struct(value, reason): the technique as it is kept, or why it is not."""
    value = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.regexp_replace(_col(raw), r"\s+", " ")), '^"+|"+$', "")), r"\s+", " "))
    n = F.size(F.filter(F.split(value, r"\s+"), lambda w: w != ""))
    reason = F.when(value == "", "").when(n < 2, "one word").when(n > 8, "a retelling").when(too_broad(value), "a category").otherwise("")
    return F.struct(F.when((reason == "") & (value != ""), value).otherwise("").alias("value"), reason.alias("reason"))


#: What stands in brackets is no part of a company's name; a word of one begins with a letter.
_IN_BRACKETS, _COMPANY_WORD = r"\([^)]*\)", r"[A-Za-z][A-Za-z0-9&.\-]+"


def names_company(text: Column | str) -> Column:
    """Distinct words that tell company names apart."""
    bare = F.regexp_replace(_col(text), _IN_BRACKETS, " ")
    words = F.transform(F.regexp_extract_all(bare, F.lit(_COMPANY_WORD), 0), lambda w: F.lower(F.btrim(w, F.lit("."))))
    return F.array_distinct(F.filter(without(words, COMPANY_GENERIC), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either)


def references(text: Column | str) -> Column:
    """Numbers in square brackets; a bracket may hold several."""
    groups = F.regexp_extract_all(_col(text), F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1)
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda n: n.cast("int"))


def numbers(text: Column | str) -> Column:
    """Numbers of two digits or more, without their separators."""
    found = F.regexp_extract_all(_col(text), F.lit(r"\d[\d ,.]*\d|\d"), 0)
    return F.filter(F.transform(found, lambda n: F.regexp_replace(n, r"\D", "")), lambda d: F.length(d) >= 2)


def invented_numbers(sentence: Column, cited: Column) -> Column:
    """Numbers of a sentence that its cited texts (array) don't hold."""
    pool = F.regexp_replace(F.array_join(cited, " "), r"\D", "")
    bare = F.regexp_replace(sentence, r"\[\d+(?:\s*,\s*\d+)*\]", " ")
    return F.filter(numbers(bare), lambda n: ~pool.contains(n))


def foreign_script(text: Column | str) -> Column:
    """Whether a letter is neither Latin, Cyrillic nor Greek."""
    return _col(text).rlike(r"[\p{L}&&[^\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]]")


def has_cyrillic(text: Column | str) -> Column:
    return _col(text).rlike(r"\p{IsCyrillic}")
