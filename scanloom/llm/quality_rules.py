"""Quality rules on counts, and on the divergence of a document from language references.

Two histograms of a document are compared with each language's reference by the Jensen-Shannon distance
(base 2, from 0 to 1): classes of characters, and common words against all others.  A document is kept if both
distances to some language add up to LIMIT at most.  Guards: a histogram counts only if it rests on enough characters or
words, else its distance is null and adds nothing.

The references are measured, over all documents of a language that pass the base rules; the words are given.  Counts are
worked out once and written, the references are one row a language, then every document is judged.

Everything is an expression on one row or a sum, compiled by the engine: no Python.  Null texts have no words.  Texts are
whole, however long.  Ties, repeated rows and extra columns make no difference; columns of the new names are replaced.  A
null or unknown language adds to no reference; without any reference the base rules alone decide.  An empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.shared import positional, stored

# Twelve very common words of each language.
WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por"],
}
COMMON = sorted({w for words in WORDS.values() for w in words})
#: Classes of characters other than white space: the last is bytes of UTF-8 beyond one a character.
CLASSES = ["lower", "upper", "digit", "punctuation", "other", "beyond"]
PUNCTUATION = ".,;:!?'\"-()"
SYMBOLS = "#*$%&|<>"
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SPACES = " \t\n\x0b\x0c\r"

#: Of the sum of both distances.
LIMIT = 0.42
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
LEAST_CHARS = 200
LEAST_WORDS = 50

#: By language: shares of the classes, the words, and shares of these and of all other words.
References = dict[str, tuple[list[float], list[str], list[float]]]


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more.

    Where some window's hash comes again, hashes are sorted with their places, and equal neighbours are taken.
    """

    def covered(places: Column) -> Column:
        ends = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.lit(1 << 30)))
        reach = F.zip_with(places, F.slice(ends, 1, F.size(places)), lambda p, q: F.least(F.lit(3), q - p))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def places(sorted_: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(sorted_) - 1)
        same = lambda i, j: F.get(sorted_, i).h.eqNullSafe(F.get(sorted_, j).h)
        twice = F.filter(at, lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(twice, lambda i: F.get(sorted_, i).i))

    def among(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, lambda s: let(places(s), covered)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) >= 3, let(words, lambda w: let(windows(w), among))).otherwise(0).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def js_distance(shares: Column, reference: list[float]) -> Column:
    """Of an array of shares."""

    def term(p: Column, q: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(x / ((p + q) / F.lit(2.0)))).otherwise(F.lit(0.0))
        return part(p) + part(q)

    total = F.aggregate(F.zip_with(shares, F.array(*[F.lit(float(q)) for q in reference]), term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / F.lit(2.0), F.lit(0.0)))


def counted(docs: DataFrame, text: Column, lang: Column, keep: list[str]) -> DataFrame:
    """The columns keep, lang, the counts of the base rules, base_failed, classes and hits (of COMMON), all as numbers of one row."""
    docs = docs.select(*[F.col(c) for c in keep], lang.alias("lang"), F.coalesce(text, F.lit("")).alias("t"))
    docs = docs.withColumn("words", split_words(F.col("t")))
    t, words = F.col("t"), F.col("words")
    some = F.transform(F.filter(words, lambda w: w.isin([x for c in COMMON for x in (c, c.capitalize())])), F.lower)
    docs = docs.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(t, r"[ \t-\r]+", "")).cast("long"),
            "n_dup_lines": repeated_lines(t),
            "n_repeat_words": repeated_words(words),
            "rest": F.regexp_replace(t, r"[a-z \t-\r]+", ""),
            "beyond": (F.octet_length(t) - F.length(t)).cast("long"),
            "hits": let(some, lambda a: F.array(*[F.size(a) - F.size(F.array_remove(a, c)) for c in COMMON])),
        }
    ).drop("words", "t")
    rest, beyond, n = F.col("rest"), F.col("beyond"), F.col("word_chars")
    docs = docs.withColumns({"n_symbols": count_of(rest, SYMBOLS).cast("long"), "some": F.array(n - F.length(rest), *[count_of(rest, x).cast("long") for x in (UPPER, DIGITS, PUNCTUATION)])}).drop("rest")
    lower, upper, digit, punct = (F.get(F.col("some"), F.lit(k)) for k in range(4))
    other = F.greatest(n - lower - upper - digit - punct - beyond, F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.withColumns({"classes": F.array(lower, upper, digit, punct, other, beyond), "base_failed": failed}).drop("some", "beyond")


def measure(counts: DataFrame) -> References:
    """The references, from counted documents: a row for each language that WORDS has comes to the driver."""
    good = counts.filter(F.col("lang").isin(*WORDS) & ~F.col("base_failed"))
    sums = [F.sum(F.get(F.col("classes"), F.lit(k))).alias(f"class{k}") for k in range(len(CLASSES))]
    sums += [F.sum(F.get(F.col("hits"), F.lit(k))).alias(f"hits{k}") for k in range(len(COMMON))]
    out: References = {}
    for r in good.groupBy("lang").agg(F.sum("n_words").alias("n_words"), F.sum("word_chars").alias("word_chars"), *sums).collect():
        hits = [r[f"hits{COMMON.index(w)}"] for w in WORDS[r.lang]]
        out[r.lang] = ([r[f"class{k}"] / r.word_chars for k in range(len(CLASSES))], WORDS[r.lang], [x / r.n_words for x in (*hits, r.n_words - sum(hits))])
    return dict(sorted(out.items()))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """The references that these documents give."""
    own = positional(docs)
    return measure(counted(own, F.col(f"c{docs.columns.index(text)}"), F.col(f"c{docs.columns.index(lang)}"), []))


def judged(counts: DataFrame, references: References) -> DataFrame:
    """Adds class_distance and word_distance, those of the nearest language (the least sum of both), and kept."""
    n, chars = F.col("n_words"), F.col("word_chars")
    distances = []
    for classes, words, shares in references.values():
        own = F.transform(F.array(*[F.lit(COMMON.index(w)) for w in words]), lambda k: F.get(F.col("hits"), k).cast("long"))
        rest = n - F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
        a = F.when(chars >= LEAST_CHARS, js_distance(F.transform("classes", lambda x: x / chars), classes))
        b = F.when(n >= LEAST_WORDS, js_distance(F.transform(F.concat(own, F.array(rest)), lambda x: x / n), shares))
        distances.append(F.struct(a.alias("a"), b.alias("b")))
    with_sum = lambda s: F.struct((F.coalesce(s.a, F.lit(0.0)) + F.coalesce(s.b, F.lit(0.0))).alias("sum"), s.a.alias("a"), s.b.alias("b"))
    none = F.lit(None).cast("struct<sum:double,a:double,b:double>")
    near = counts.withColumn("near", F.array_min(F.transform(F.array(*distances), with_sum)) if distances else none)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("near.sum"), F.lit(0.0)) <= LIMIT)
    return near.withColumns({"class_distance": F.col("near.a"), "word_distance": F.col("near.b"), "kept": kept}).drop("near")


def score(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, references: References | None = None) -> DataFrame:
    """The columns keep (default: all) of all documents, with the columns MADE. Without references they are measured."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in MADE]
    own = [f"c{docs.columns.index(c)}" for c in names]
    at = lambda c: F.col(f"c{docs.columns.index(c)}")
    counts = stored(counted(positional(docs), at(text), at(lang), own), "counts")
    return judged(counts, measure(counts) if references is None else references).select(*own, *MADE).toDF(*names, *MADE)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", references: References | None = None) -> DataFrame:
    """The documents that are kept, with their own columns. Without references they are measured on these documents."""
    own = positional(docs)
    at = lambda c: F.col(f"c{docs.columns.index(c)}")
    counts = stored(counted(own, at(text), at(lang), own.columns), "counts")
    return judged(counts, measure(counts) if references is None else references).filter("kept").select(*own.columns).toDF(*docs.columns)
