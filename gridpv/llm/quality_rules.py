"""Quality rules: distribution divergence from language references, with minimum lengths.

Method: each document's histogram of character classes, and that of its common words, is compared
to the reference of its language by the Jensen-Shannon distance.  References are the median
class shares and mean word shares of all documents of a language with enough words, so they cover the corpus.

Only Spark's own functions are used.  A document is rejected if a base rule fails (fewer than
``MIN_WORDS`` words, or more than half of its words in 3-word windows that come twice or more).  With at
least ``GUARD`` word characters it is also rejected if its class distance is over ``CLASS_FAR``, or over
``CLASS_LIMIT`` while its common-word distance is over ``WORD_LIMIT``: shorter texts are too
noisy to be judged by one histogram, and a listing or a table needs both to be told from prose.  From ``WORD_GUARD``
words on, a common-word distance over ``WORD_FAR`` rejects alone: such a text has next to none of its language's common words.

Languages without a word list use the class reference of all documents and ``CLASS_FAR`` alone.  A null or
empty text has no words and fails the base rule; all counts are 0.  Rows are judged one by one,
so repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.llm.common import WORD, read_table

MIN_WORDS = 50
GUARD = 200
CLASS_FAR = 0.3
CLASS_LIMIT = 0.15
WORD_LIMIT = 0.22
WORD_GUARD = 100
WORD_FAR = 0.3

#: Frequent function words of the languages in the corpus.
COMMON_WORDS = {
    "en": "the of and to in is that for it as with was on are by this be or from at".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur pas au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
ALL = "*"

#: Character classes of the histogram: capitals, other letters, digits, symbols, other, white space.
CLASSES = ("upper", "lower", "digit", "symbol", "other", "space")

_KEEP = {"letter": r"[^\p{L}]+", "upper": r"[^\p{Lu}]+", "digit": r"[^\p{Nd}]+", "symbol": r"[^#*$%&|<>]+"}


def _language(lang_col: str) -> Column:
    known = F.lower(F.trim(F.col(lang_col)))
    return F.when(known.isin(*COMMON_WORDS), known).otherwise(F.lit(ALL))


def histograms(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``docs`` with ``_q_words``, ``_q_text``, ``_q_lang``, class counts ``_q_classes`` and common-word
    counts ``_q_common`` (the listed words, then all others)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumns({"_q_text": text, "_q_lang": _language(lang_col)})
    df = df.withColumns(
        {
            "_q_words": F.regexp_extract_all("_q_text", F.lit(WORD), F.lit(0)),
            "_q_chars": F.length(F.regexp_replace("_q_text", r"[\x20\x09-\x0D]+", "")),
            **{f"_q_{k}": F.length(F.regexp_replace("_q_text", pattern, "")) for k, pattern in _KEEP.items()},
        }
    )
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    lists = F.create_map(*[x for k, words in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, words)))])
    df = df.withColumns(
        {
            "_q_n": F.size("_q_words").cast("long"),
            "_q_hits": F.filter("_q_words", lambda w: w.isin(*every)),
            "_q_list": F.coalesce(lists[F.col("_q_lang")], F.array().cast("array<string>")),
            "_q_classes": F.array(
                F.col("_q_upper"),
                F.col("_q_letter") - F.col("_q_upper"),
                F.col("_q_digit"),
                F.col("_q_symbol"),
                F.col("_q_chars") - F.col("_q_letter") - F.col("_q_digit") - F.col("_q_symbol"),
                F.length("_q_text") - F.col("_q_chars"),
            ).cast("array<double>"),
        }
    )
    df = df.withColumn("_q_listed", F.filter("_q_hits", lambda w: F.array_contains(F.col("_q_list"), w)))
    return df.withColumn(
        "_q_common",
        F.concat(
            F.transform("_q_list", lambda c: F.size(F.filter("_q_listed", lambda w: w == c))),
            F.array(F.size("_q_words") - F.size("_q_listed")),
        ).cast("array<double>"),
    )


def repeated_words(df: DataFrame) -> DataFrame:
    """``df`` with ``_q_repeats``: words in 3-word windows of ``_q_words`` found twice or more.

    Window hashes with their position in the low 28 bits are sorted as numbers; positions whose
    hash has an equal neighbour are compared by their words, so hashes decide nothing.
    """
    words = F.col("_q_words")
    window = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]
    low = F.lit((1 << 28) - 1)
    some = F.size("_q_words") >= 3
    keys = F.transform(
        F.sequence(F.lit(0), F.size("_q_words") - 3),
        lambda i: F.shiftleft(F.xxhash64(*window(i)), 28).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("_q_keys", F.when(some, F.sort_array(keys)).otherwise(F.array().cast("array<long>")))

    def beside(column: str, value):
        """Positions of ``column`` whose value equals that of a neighbour."""
        array = F.col(column)
        return lambda x, i: F.coalesce(value(x) == value(F.get(array, i - 1)), F.lit(False)) | F.coalesce(
            value(x) == value(F.get(array, i + 1)), F.lit(False)
        )

    df = df.withColumn("_q_near", F.filter("_q_keys", beside("_q_keys", lambda x: F.shiftright(x, 28))))
    grams = F.transform(
        "_q_near",
        lambda x: F.struct(
            F.concat_ws(" ", *window(x.bitwiseAND(low).cast("int"))).alias("g"), x.bitwiseAND(low).cast("int").alias("p")
        ),
    )
    df = df.withColumn("_q_grams", F.sort_array(grams))
    df = df.withColumn("_q_same", F.filter("_q_grams", beside("_q_grams", lambda x: x["g"])))
    df = df.withColumn("_q_at", F.sort_array(F.transform("_q_same", lambda x: x["p"])))
    start = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "_q_at",
        start,
        lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("_q_repeats", covered.cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Per language, and for all (``*``), the median share of each class (scaled to add up to 1) and
    the mean share of each common word, over the documents that have enough words.

    At most one row per listed language and one more come to the driver.
    """
    df = histograms(docs, text_col, lang_col).where(F.col("_q_n") >= MIN_WORDS)
    classes = df.select("_q_lang", "_q_classes", "_q_common", F.col("_q_n"))
    classes = classes.select("_q_lang", _share(F.col("_q_classes")).alias("c"), _share(F.col("_q_common")).alias("w"))
    longest = max(map(len, COMMON_WORDS.values())) + 1
    middle = lambda i: F.percentile_approx(F.get("c", F.lit(i)), 0.5, 1000).alias(f"c{i}")
    mean = lambda i: F.avg(F.get("w", F.lit(i))).alias(f"w{i}")
    sums = [F.count("*").alias("n"), *map(middle, range(len(CLASSES))), *map(mean, range(longest))]
    out = {}
    for r in classes.cube("_q_lang").agg(F.grouping("_q_lang").alias("all"), *sums).collect():
        name = ALL if r["all"] or r["_q_lang"] == ALL else r["_q_lang"]
        if name == ALL and not r["all"] or not r["n"]:
            continue
        size = len(COMMON_WORDS.get(name, ())) + 1
        total = sum(r[f"c{i}"] for i in range(len(CLASSES))) or 1.0
        out[name] = {
            "classes": [r[f"c{i}"] / total for i in range(len(CLASSES))],
            "common": [r[f"w{i}"] for i in range(size)] if name != ALL else [1.0],
        }
    return out


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2: 0 to 1) of two histograms; null without a reference."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    parts = F.zip_with(_share(counts), reference, lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, known: dict, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    class_distance, word_distance (double), base_failed and kept (boolean)."""
    df = repeated_words(histograms(docs, text_col, lang_col))
    lines = F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(WORD))
    pick = lambda kind: F.create_map(
        *[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v[kind])))]
    )[F.when(F.col("_q_lang").isin(*known), F.col("_q_lang")).otherwise(ALL)]
    none = F.lit(None).cast("array<double>")
    df = df.withColumns({"_q_lines": lines, "_q_rc": pick("classes") if known else none, "_q_rw": pick("common") if known else none})
    added = {
        "n_words": F.col("_q_n"),
        "word_chars": F.col("_q_chars").cast("long"),
        "n_symbols": F.col("_q_symbol").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": F.col("_q_repeats"),
        "class_distance": _distance(F.col("_q_classes"), F.col("_q_rc")),
        "word_distance": _distance(F.col("_q_common"), F.col("_q_rw")),
    }
    kept = [c for c in docs.columns if c.lower() not in {*added, "base_failed", "kept"}]
    # a generator of one row: filters on its columns stay above it instead of repeating the work below
    signals = F.explode(F.array(F.struct(*[v.alias(k) for k, v in added.items()]))).alias("_q_signals")
    df = df.select(*kept, signals).select(*kept, "_q_signals.*")
    failed = base_failed()
    by_class, by_word = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("class_distance", "word_distance"))
    odd = (F.col("word_chars") >= GUARD) & ((by_class > CLASS_FAR) | (by_class > CLASS_LIMIT) & (by_word > WORD_LIMIT))
    odd = odd | (F.col("n_words") >= WORD_GUARD) & (by_word > WORD_FAR)
    return df.withColumns({"base_failed": failed, "kept": ~failed & ~odd})


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: the base signals, whether they fail, and the verdict."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, references(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
