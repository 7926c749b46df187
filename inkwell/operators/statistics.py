"""Per-document statistics: sentence lengths, vocabulary variety, style measurements, readability, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import LANGUAGE_WORDS
from inkwell.operators.tokens import tokens

#: Irregular participles and adverbs that a passive is recognised by.
PARTICIPLES = (
    "known|shown|made|done|seen|given|taken|found|built|held|kept|led|chosen|drawn|written|set|put|run|become|begun|brought|bought|caught|taught|sent|spent|told|understood|lost|won|paid|read|"
    "heard|met|left|grown|thrown|worn|torn|broken|spoken|driven|eaten|fallen|forgotten|hidden|ridden|risen|stolen"
)
ADVERBS = "not|also|often|then|thus|further|subsequently|previously|already|still|always|never|usually|typically|generally|commonly|widely|currently|recently|[A-Za-z0-9_]+ly"
#: Without word-boundary escapes, whose meaning differs between engines; applied to a sentence between two blanks.
PASSIVE = rf"(?i)[^A-Za-z0-9_](?:am|is|are|was|were|be|been|being)\s+(?:(?:{ADVERBS})\s+)?(?:[A-Za-z0-9_]{{3,}}ed|{PARTICIPLES})[^A-Za-z0-9_]"
CONTRACTED = r"'(?:s|t|re|ve|ll|d|m)$"
DENSE = (
    "mean_sentence_len sentence_len_cv type_token_50 comma_rate semicolon_rate colon_rate dash_rate paren_rate question_rate exclaim_rate quote_rate contraction_rate first_person_rate "
    "second_person_rate digit_rate stopword_rate long_word_rate mean_word_len paragraph_count_rate capital_start_rate"
).split()
#: Scripts that tell a language, as code point ranges.
SCRIPTS = (
    ("te", "ఀ-౿"), ("ta", "஀-௿"), ("kn", "ಀ-೿"), ("ml", "ഀ-ൿ"), ("bn", "ঀ-৿"), ("gu", "઀-૿"), ("pa", "਀-੿"), ("hi", "ऀ-ॿ"),
    ("ar", "؀-ۿ"), ("ru", "Ѐ-ӿ"), ("el", "Ͱ-Ͽ"), ("ko", "가-힯"), ("ja", "぀-ヿ"), ("zh", "一-鿿"), ("th", "฀-๿"),
)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)).otherwise(F.lit(0.0))


def deviation(xs: Column, population: bool = False) -> Column:
    """Sample deviation (0 for fewer than two values), or the population's."""
    m = mean(xs)
    n = F.size(xs) if population else F.size(xs) - 1
    return F.when(F.size(xs) > (0 if population else 1), F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.greatest(n, F.lit(1)))).otherwise(F.lit(0.0))


def variation(xs: Column) -> Column:
    return F.when(mean(xs) > 0, deviation(xs) / mean(xs)).otherwise(F.lit(0.0))


def median(xs: Column) -> Column:
    s = F.array_sort(xs)
    at = lambda i: F.try_element_at(s, F.greatest(i, F.lit(1)).cast("int")).cast("double")
    return F.coalesce((at(F.floor((F.size(s) + 1) / 2)) + at(F.floor(F.size(s) / 2) + 1)) / 2, F.lit(0.0))


def sentence_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, mean_words, sd_words, cv_words, median_words, longest."""
    n = F.filter(F.transform(T.simple_sentences(F.coalesce("text", F.lit(""))), T.word_count), lambda x: x > 0)
    d = docs.select("doc_id", n.alias("n"))
    r = lambda c: F.round(c, 6)
    return d.select("doc_id", F.size("n").alias("sentences"), r(mean(F.col("n"))).alias("mean_words"), r(deviation(F.col("n"))).alias("sd_words"), r(variation(F.col("n"))).alias("cv_words"), r(median(F.col("n"))).alias("median_words"), F.coalesce(F.array_max("n"), F.lit(0)).alias("longest"))


def word_entropy(docs: DataFrame) -> DataFrame:
    """doc_id, words, distinct_words, entropy (bits)."""
    c = tokens(docs).groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    g = c.groupBy("doc_id").agg(F.sum("c").alias("words"), F.count("*").alias("distinct_words"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return g.select("doc_id", "words", "distinct_words", F.round(F.log2("words") - F.col("s") / F.col("words"), 6).alias("entropy"))


def moving_type_token_ratio(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, words, mattr: mean share of distinct words over all windows of `size` words (the whole text if shorter).

    A word counts in the windows that begin after its previous occurrence, so a lag gives the sum of all windows' distinct
    counts without building any window."""
    t = tokens(docs).repartition("doc_id")
    before = F.coalesce(F.lag("pos").over(W.partitionBy("doc_id", "word").orderBy("pos")), F.lit(-1))
    t = t.withColumn("q", before).withColumn("n", F.count("*").over(W.partitionBy("doc_id")))
    inside = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n") - size) - F.greatest(F.col("q") + 1, F.col("pos") - (size - 1), F.lit(0)) + 1)
    g = t.groupBy("doc_id").agg(F.max("n").alias("words"), F.sum(inside).alias("s"), F.count_if(F.col("q") < 0).alias("kinds"))
    m = F.when(F.col("words") <= size, F.col("kinds") / F.col("words")).otherwise(F.col("s") / size / (F.col("words") - (size - 1)))
    return g.select("doc_id", "words", F.round(m, 9).alias("mattr"))


def dense_features(docs: DataFrame) -> DataFrame:
    """doc_id and the style measurements named in DENSE."""
    text = F.coalesce("text", F.lit(""))
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+([A-Z\"“(])", "$1\u0001$2"), "\u0001|\n\\s*\n")
    lengths = F.filter(F.transform(cut, lambda s: F.regexp_count(s, F.lit(r"[\p{L}\p{N}]+"))), lambda n: n > 0)
    words = F.filter(T.feature_tokens(text), lambda t: t.rlike(r"[\p{L}\p{N}<]"))
    d = docs.select("doc_id", text.alias("t"), lengths.alias("l"), words.alias("w"))
    d = d.withColumn("n", F.greatest(F.size("w"), F.lit(1)))
    rate = lambda pattern: F.regexp_count("t", F.lit(pattern)) / F.col("n") * 100
    some = lambda test: F.size(F.filter("w", test)) / F.col("n") * 100
    starts = F.when(F.size("w") >= 50, F.sequence(F.lit(0), F.greatest(F.size("w") - 50, F.lit(0)), F.lit(25))).otherwise(F.array().cast("array<int>"))
    ttr = F.when(F.size("w") >= 50, F.aggregate(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice("w", i + 1, 50)))), F.lit(0), lambda s, x: s + x) / 50 / F.size(starts)).otherwise(F.size(F.array_distinct("w")) / F.col("n"))
    mean_len = F.when(F.size("l") > 0, mean(F.col("l"))).otherwise(F.col("n").cast("double"))
    values = [
        F.least(F.lit(80.0), mean_len) / 20, F.least(F.lit(2.0), F.when(F.size("l") > 1, deviation(F.col("l")) / mean_len).otherwise(0.0)), ttr,
        rate(","), rate(";"), rate(":"), rate(r"[—–]|\s-\s"), rate(r"\("), rate(r"\?"), rate("!"), rate('["“”]'),
        some(lambda w: w.rlike(CONTRACTED)), some(lambda w: w.isin("i", "my", "me", "we", "our", "us")), some(lambda w: w.isin("you", "your")), some(lambda w: w == "<num>"),
        some(T.is_stopword) / 10, some(lambda w: F.length(w) >= 9), F.aggregate("w", F.lit(0), lambda s, w: s + F.length(w)) / F.col("n") / 5, rate(r"\n\s*\n"),
        F.when(F.size("l") > 0, F.regexp_count("t", F.lit(r"(?:^|[.!?]\s+)[A-Z]")) / F.size("l")).otherwise(0.0),
    ]
    return d.select("doc_id", *[F.round(v, 9).alias(k) for k, v in zip(DENSE, values, strict=True)])


def is_passive(sentence: Column) -> Column:
    return F.concat(F.lit(" "), sentence, F.lit(" ")).rlike(PASSIVE)


def level(ease: Column) -> Column:
    """Names of reading ease."""
    return F.when(ease >= 90, "Very easy").when(ease >= 80, "Easy").when(ease >= 70, "Fairly easy").when(ease >= 60, "Plain English").when(ease >= 50, "Fairly difficult").when(ease >= 30, "Difficult (typical of academic writing)").otherwise("Very difficult")


def readability(docs: DataFrame) -> DataFrame:
    """doc_id, words, sentences, longest, avg_sentence, ease, grade, passive_share, level; texts without words are left out."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", T.raw_words(text).alias("w"), T.simple_sentences(text).alias("s")).where(F.size("w") > 0)
    syl = F.aggregate(F.transform("w", lambda x: F.greatest(F.lit(1), T.syllables(x))), F.lit(0), lambda s, x: s + x)
    per = F.size("w") / F.greatest(F.size("s"), F.lit(1))
    d = d.withColumn("per", per).withColumn("spw", syl / F.size("w"))
    ease, grade = 206.835 - 1.015 * F.col("per") - 84.6 * F.col("spw"), 0.39 * F.col("per") + 11.8 * F.col("spw") - 15.59
    return d.select("doc_id", F.size("w").alias("words"), F.size("s").alias("sentences"), F.array_max(F.transform("s", T.word_count)).alias("longest"), T.half_up(F.col("per"), 1).alias("avg_sentence"), T.half_up(ease, 1).alias("ease"), T.half_up(grade, 1).alias("grade"), T.half_up(F.size(F.filter("s", is_passive)) / F.greatest(F.size("s"), F.lit(1)), 2).alias("passive_share"), level(ease).alias("level"))


def _among(words: str):
    held = words.split()
    return lambda w: w.isin(*held)


def language(docs: DataFrame) -> DataFrame:
    """doc_id, code, confidence: by script if one has over 30 % of the letters, else by common short words."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("t"), T.matches(F.lower(text), r"\p{L}+").alias("w"), F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1)).alias("letters"))
    share = lambda r: F.regexp_count("t", F.lit(f"[{r}]")) / F.col("letters")
    # the counts of texts in none of these scripts, which are most, stop at one look
    odd = F.col("t").rlike("[" + "".join(r for _, r in SCRIPTS) + "]")
    by_script = F.lit(None).cast("struct<code:string,confidence:double>")
    for code, r in reversed(SCRIPTS):
        by_script = F.when(share(r) > 0.3, F.struct(F.lit(code).alias("code"), F.least(F.lit(1.0), share(r) + 0.2).alias("confidence"))).otherwise(by_script)
    by_script = F.when(odd, by_script)  # around all cases: within them it would be looked at once a script
    listed = " ".join(words for _, _, words in LANGUAGE_WORDS)
    hits = F.array(*[F.struct((F.size(F.filter("known", _among(words))) / F.greatest(F.size("w"), F.lit(1))).alias("score"), F.lit(-k).alias("first"), F.lit(code).alias("code")) for k, (code, _, words) in enumerate(LANGUAGE_WORDS)])
    d = d.withColumn("by_script", by_script).withColumn("known", F.filter("w", _among(listed)))  # one look at each word; the lists share those that are left
    d = d.withColumn("hits", F.sort_array(hits, asc=False))
    best, second = F.col("hits")[0], F.col("hits")[1]["score"]
    words = F.when(best["score"] > 0, F.struct(best["code"].alias("code"), F.least(F.lit(1.0), (best["score"] - second) / best["score"] + 0.3).alias("confidence"))).otherwise(F.struct(F.lit("en").alias("code"), F.lit(0.0).alias("confidence")))
    d = d.select("doc_id", F.coalesce("by_script", words).alias("l"))
    return d.select("doc_id", "l.code", F.round("l.confidence", 6).alias("confidence"))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, words, paragraphs, reading_minutes."""
    text = F.coalesce("text", F.lit(""))
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\s", "") != "")
    n = T.word_count(text)
    return docs.select("doc_id", n.alias("words"), F.size(blocks).alias("paragraphs"), F.greatest(F.lit(1), F.floor(n / 230 + 0.5)).cast("int").alias("reading_minutes"))
