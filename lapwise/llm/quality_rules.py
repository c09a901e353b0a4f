"""Quality rules: base counts and a distribution-divergence verdict, with DataFrame functions only.

A text's character-class histogram and its histogram of common words are compared with the reference of its language by
the Jensen-Shannon distance (base 2, from 0 to 1). A reference is the mean histogram of all texts of the language that
pass the base rules and are not far from the mean of those, so that junk does not bend it. Texts shorter than the guards
are judged by the base rules alone, since short histograms are noise.

The repeated-window count sorts a text's own window hashes (64-bit XXH64) inside its row, so nothing is shuffled for it
and its cost is n log n in the words of the text.

Defined cases: a null text has no words and is not kept (n_words < 10); a null or unlisted language uses the words of
all languages and its own rows' reference; columns of the input named like an output are replaced; repeated rows are
judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapwise.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: The commonest function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with"],
    "fr": ["de", "la", "le", "les", "des", "et", "en", "un", "une", "du", "que", "dans"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "un"],
}
ANY = ["the", "of", "and", "de", "la", "que", "der", "die", "und", "el", "en", "le"]
SLOTS = "abcdefghijkl"
CHAR_CLASSES = {"lower": r"[^\p{Ll}]+", "upper": r"[^\p{Lu}]+", "digit": r"[^\p{Nd}]+", "stop": r"[^.,;:'\"()\-]+", "mark": r"[^!?#*$%&|<>@_=+/\\~^\[\]{}]+"}
WINDOW = 5


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x)


def repeated_words(words: Column, n: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more; words and n must be plain columns."""
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(found: Column) -> Column:
        return _total(F.transform(found, lambda at, k: F.least(F.coalesce(F.get(found, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")))

    def twice(ranked: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ranked, k)["h"] == x["h"], F.lit(False))
        again = F.filter(ranked, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def count(found: Column) -> Column:
        ranked = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(let(ranked, twice))

    return F.when(n >= WINDOW, let(hashes, count)).otherwise(F.lit(0).cast("long"))


def base_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the words themselves (_words)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumn("_words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0))).withColumn("n_words", F.size("_words"))
    counted = split.withColumns({
        "word_chars": F.length(F.translate(body, WHITE, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words"), F.col("n_words")),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumns({"n_words": F.col("n_words").cast("long"), "base_failed": failed})


def histograms(counted: DataFrame, *, text: str = "text", language: str = "lang") -> DataFrame:
    """counted with char_hist (shares of character classes) and word_hist (shares of the language's common words)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lists = reduce(lambda found, item: found.when(F.col(language) == item[0], F.array(*map(F.lit, item[1]))), COMMON.items(), F.when(F.lit(False), F.array(*map(F.lit, ANY)))).otherwise(F.array(*map(F.lit, ANY)))
    known = sorted({w for words in [*COMMON.values(), ANY] for w in words})
    common = F.filter(F.transform(F.col("_words"), F.lower), lambda w: w.isin(known))
    slots = F.array_join(F.transform(common, lambda w: F.substring(F.lit(" " + SLOTS), F.array_position(F.col("_list"), w).cast("int") + 1, F.lit(1))), "")
    classes = [F.length(F.regexp_replace(body, p, "")) for p in CHAR_CLASSES.values()]
    staged = counted.withColumn("_list", lists).withColumns({"_slots": slots, "_classes": F.array(*[c.cast("double") for c in classes])})
    words = [(F.length("_slots") - F.length(F.replace(F.col("_slots"), F.lit(s), F.lit("")))).cast("double") for s in SLOTS]
    chars = F.col("word_chars").cast("double")
    shares = lambda found, whole: F.transform(F.concat(found, F.array(F.greatest(whole - F.aggregate(found, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))), lambda x: F.coalesce(F.try_divide(x, whole), F.lit(0.0)))
    return staged.withColumns({"char_hist": shares(F.col("_classes"), chars), "word_hist": shares(F.array(*words), F.col("n_words").cast("double"))}).drop("_list", "_slots", "_classes", "_words")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, base 2."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / F.nullif(x + y, F.lit(0.0)))).otherwise(F.lit(0.0)) / 2
    total = F.aggregate(F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def references(measured: DataFrame, *, language: str = "lang") -> DataFrame:
    """Mean histograms of each language over the texts that pass the base rules: one row per language."""
    mean = lambda name, size: F.array(*[F.avg(F.get(F.col(name), F.lit(i))) for i in range(size)]).alias(f"ref_{name}")
    return measured.where(~F.col("base_failed")).groupBy(F.col(language).alias("_language")).agg(mean("char_hist", len(CHAR_CLASSES) + 1), mean("word_hist", len(SLOTS) + 1))


def distances(measured: DataFrame, known: DataFrame, *, language: str = "lang") -> DataFrame:
    """measured with char_distance and word_distance from its language's reference; null where there is none."""
    joined = measured.join(known, F.col(language).eqNullSafe(F.col("_language")), "left")
    found = {"char_distance": js_distance(F.col("char_hist"), F.col("ref_char_hist")), "word_distance": js_distance(F.col("word_hist"), F.col("ref_word_hist"))}
    return joined.withColumns(found).drop("_language", "ref_char_hist", "ref_word_hist")


def judge(docs: DataFrame, *, text: str = "text", language: str = "lang", key: str = "doc_id", rough_distance: float = 0.25, max_char_distance: float = 0.3, max_word_distance: float = 0.45, both: tuple[float, float] = (0.16, 0.23), min_chars: int = 150, min_words: int = 40) -> DataFrame:
    """One row per text: key, the base counts, base_failed, both distances and kept.

    A text is odd if one distance alone is over its maximum, or if it has enough words and is over both bounds of both.

    The counts and histograms are written once to the shared folder, narrow, and read for the references and the verdict.
    The references have a row per language; Spark broadcasts them where their written size is under
    spark.sql.autoBroadcastJoinThreshold.
    """
    measured = histograms(base_counts(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(language).alias("lang")))).drop("text")
    measured = written(measured, "quality-counts")
    rough = distances(measured, written(references(measured), "quality-rough"))
    known = references(rough.where(F.col("char_distance") <= rough_distance))
    joined = distances(measured, written(known, "quality-references"))
    strange = (F.col("word_distance") > max_word_distance) | ((F.col("char_distance") > both[0]) & (F.col("word_distance") > both[1]))
    odd = ((F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance)) | ((F.col("n_words") >= min_words) & strange)
    kept = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))
    return joined.select(F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
