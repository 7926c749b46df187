"""Grammar and style rules. Each gives rows (doc_id, rule, category, severity, start, end, suggestion): code points, ends exclusive.

All rules read a text whose protected stretches are masked (`checked`). Pattern rules cut a text at its matches, so offsets are
running lengths of the pieces; what stands before and after a match is tested on the neighbouring pieces. Lexicon rules are
one equi-join of words with all lists at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import ACRONYMS, CONTRACTIONS, INFORMAL, WEAK, WORDY
from inkwell.functions.spelling import MISSPELLINGS, british_to_american
from inkwell.operators import preparing as P
from inkwell.operators import statistics as S
from inkwell.operators.integrity import phrase_hits, placed
from inkwell.operators.tokens import chosen_spans, paragraphs, with_words
from inkwell.tables import stored

#: Severity and category of each rule.
RULES = {
    "repeated-word": ("grammar", "error"), "double-space": ("punctuation", "info"), "space-before-punctuation": ("punctuation", "warning"), "missing-space-after-punctuation": ("punctuation", "warning"),
    "unbalanced-brackets": ("punctuation", "warning"), "unbalanced-quotes": ("punctuation", "warning"), "sentence-capital": ("grammar", "error"), "a-an": ("grammar", "error"), "confused-words": ("grammar", "error"),
    "likely-confusion": ("grammar", "warning"), "passive-voice": ("style", "info"), "contraction": ("academic", "info"), "wordy-phrase": ("clarity", "info"), "informal-wording": ("academic", "info"), "weak-word": ("style", "info"),
    "long-sentence": ("clarity", "warning"), "repeated-sentence-start": ("style", "info"), "number-at-start": ("academic", "info"), "mixed-spelling-variety": ("consistency", "warning"), "undefined-acronym": ("academic", "info"),
    "acronym-before-definition": ("academic", "info"), "spelling": ("spelling", "error"),
}
#: Pairs that may repeat, words that open sentences.
ALLOWED = ("had had", "that that", "is is", "do do", "bye bye", "so so", "no no", "very very")
STARTERS = tuple(
    "the a an this that these those it we they he she in on at however therefore moreover thus for as if when while although because our their there here such some many most all both each one two three first second finally "
    "further furthermore additionally".split()
)
#: Words mistaken for others, and what is meant ($ groups; a final S- drops the last s).
CONFUSIONS = (
    (r"(should|could|would|must|might) of", "$1 have"),
    (r"alot", "a lot"),
    (r"irregardless", "regardless"),
    (r"(more|less|better|worse|greater|higher|lower|larger|smaller|rather|other|fewer|faster|slower) then", "$1 than"),
    (r"their (is|are|was|were|will|has|have)", "there $1"),
    (r"there (own|data|study|studies|method|methods|approach|findings|analysis)", "their $1"),
    (r"it's own", "its own"),
    (r"based off of", "based on"),
    (r"comprised of", "composed of"),
    (r"infront", "in front"),
    (r"in regards to", "in regard to"),
    (r"could care less", "could not care less"),
    (r"for all intensive purposes", "for all intents and purposes"),
    (r"its (been|a|an|not|clear|possible|likely|unlikely|important|necessary|difficult|evident|known|true|worth)", "it's $1"),
    (r"(an|the|no|any|a|significant|positive|negative|strong|large|small|main|overall|direct|indirect) affect (of|on)", "$1 effect $2"),
    (r"(results|findings|studies|analyses|data sets|datasets|experiments|these results|they|we) (show|suggest|indicate|demonstrate|reveal|confirm)s", "$1 $2"),
    (r"(this|the|our|each|every) (study|result|analysis|model|method|paper|finding|experiment|figure|table) (show|suggest|indicate|demonstrate|reveal|confirm)", "$1 $2 $3s"),
    (r"(results|findings|studies|analyses) was", "$1 were"),
    (r"less (participants|patients|samples|studies|people|subjects|errors|cases|items|observations|students|respondents|individuals|trials|papers)", "fewer $1"),
    (r"(the|a|an|large|small|total|greater|smaller) amount of (participants|patients|samples|studies|people|subjects|errors|cases|items|observations|students|respondents|individuals|trials|papers)", "$1 number of $2"),
    (r"principle (investigator|component|components|author|aim|reason|finding|findings)", "principal $1"),
    (r"complimentary (approach|approaches|method|methods|technique|techniques|data|information|evidence|analysis|analyses|role|roles|perspective|perspectives)", "complementary $1"),
    (r"(this|the|a) phenomena", "$1 phenomenon"),
    (r"(this|the|a) criteria", "$1 criterion"),
    (r"dependant (variable|variables|on)", "dependent $1"),
    (r"statistically significance", "statistical significance"),
    (r"who's (work|study|data|results|findings|research|paper|papers|contribution|contributions)", "whose $1"),
    (r"loose (weight|data|information|accuracy|precision|track)", "lose $1"),
)
#: Comparisons with "then", and an idiom.
LIKELY = (
    (r"(?:more|less|fewer|better|worse|greater|higher|lower|larger|smaller|faster|slower|earlier|later|longer|shorter|stronger|weaker)(?:\s+[a-z]+){1,3}\s+then\s+(?:we|they|expected|anticipated|predicted|planned|intended|required|needed|usual|before|previously|reported|those|that|in|at|the|a|our|their|other|ever)", "than"),
    (r"different than", "different from"),
)
ONE_WORD = r"[A-Za-z0-9_]"
NO_SPACE = r"[^ \t\n\f\r]"
#: Letters of another alphabet's block that are s and k where case is aside, and a letter with them.
FOLDED = "\u017f\u212a"
LETTER, LETTERS = f"[a-z{FOLDED}]", f"[a-z{FOLDED}'-]*"


def checked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", P.masked(F.coalesce("text", F.lit(""))).alias("text"))


def found(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, start, end, hit, before, after of each match; before and after are up to 12 characters around it."""
    pattern = T.re2(pattern)
    d = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.split("text", pattern, -1).alias("gaps"), T.matches(F.col("text"), pattern).alias("hits"))
    before = F.zip_with(F.slice("gaps", 1, F.size("hits")), F.concat(F.array(F.lit("")), F.slice("hits", 1, F.size("hits") - 1)), lambda g, h: F.right(F.concat(h, g), F.lit(12)))
    after = F.zip_with(F.slice("gaps", 2, F.size("hits")), F.concat(F.slice("hits", 2, F.size("hits")), F.array(F.lit(""))), lambda g, h: F.left(F.concat(g, h), F.lit(12)))
    x = F.arrays_zip("hits", F.slice("gaps", 1, F.size("hits")).alias("gap"), before.alias("before"), after.alias("after"))
    d = d.select("doc_id", F.posexplode(x).alias("ix", "x")).select("doc_id", "ix", F.col("x.hits").alias("hit"), F.length("x.gap").alias("g"), F.col("x.before").alias("before"), F.col("x.after").alias("after"))
    end = F.sum(F.col("g") + F.length("hit")).over(W.partitionBy("doc_id").orderBy("ix").rowsBetween(W.unboundedPreceding, W.currentRow))
    return d.withColumn("end", end).select("doc_id", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "before", "after")


def issue(df: DataFrame, rule: str, suggestion: Column | None = None, start: Column | None = None, end: Column | None = None, severity: Column | None = None) -> DataFrame:
    category, usual = RULES[rule]
    return df.select("doc_id", F.lit(rule).alias("rule"), F.lit(category).alias("category"), (F.lit(usual) if severity is None else severity).alias("severity"), (F.col("start") if start is None else start).cast("long").alias("start"), (F.col("end") if end is None else end).cast("long").alias("end"), (F.lit(None).cast("string") if suggestion is None else suggestion).alias("suggestion"))


def repeated_words(text: DataFrame) -> DataFrame:
    def pick(raws: Column) -> Column:
        again = lambda low: F.concat(F.array(F.lit(False)), F.zip_with(F.slice(low, F.lit(2), F.size(low)), F.slice(low, F.lit(1), F.greatest(F.size(low) - 1, F.lit(0))), lambda x, y: x == y))
        return F.slice(T.let(F.transform(raws, F.lower), again), F.lit(1), F.size(raws))

    t = chosen_spans(text, pick)
    t = t.where(F.col("raw").rlike(r"^[\p{L}']{2,}$") & F.col("gap").rlike(r"^[ \t]+\z") & ~F.concat_ws(" ", F.lower("last"), F.lower("raw")).isin(*ALLOWED))
    return issue(t, "repeated-word", F.col("last"), start=F.col("start") - F.length("gap") - F.length("last"))


def spacing(text: DataFrame) -> DataFrame:
    two = found(text, r"[ \t]{2,}").where(F.col("before").rlike(NO_SPACE + r"\z") & F.col("after").rlike("^" + NO_SPACE))
    early = found(text, r" +[,;:!?.]").where(F.col("before").rlike(r"[\p{L}\p{N})\]\x01]\z") & F.col("after").rlike(T.re2(r"^(?:\s|$)")))
    none = found(text, "[,;]").where(F.col("before").rlike(r"\p{L}{2}\z") & F.col("after").rlike(r"^\p{L}"))
    stop = found(text, r"\.").where(F.col("before").rlike(r"[a-z]{2}\z") & F.col("after").rlike("^[A-Z][a-z]") & ~F.lower(F.regexp_extract("before", r"([A-Za-z]+)\z", 1)).isin(*P.ABBREVIATIONS))
    space = "missing-space-after-punctuation"
    return issue(two, "double-space", F.lit(" ")).unionByName(issue(early, "space-before-punctuation", F.trim("hit"))).unionByName(issue(none, space, F.concat("hit", F.lit(" ")))).unionByName(issue(stop, space, F.lit(". ")))


def unbalanced(text: DataFrame) -> DataFrame:
    """Paragraphs whose brackets or quotes don't pair up, by count; order inside a paragraph isn't looked at."""
    p = paragraphs(text).withColumn("text", F.regexp_replace("text", r"(?m)^[ \t]*(?:[0-9]+|[a-zA-Z])\)", ""))
    n = lambda c: F.regexp_count("text", F.lit(c))
    odd = (n(r"\(") != n(r"\)")) | (n(r"\[") != n(r"\]")) | (n(r"\{") != n(r"\}")) | (n("“") != n("”"))
    one = F.lit(1)
    return issue(p.where(odd), "unbalanced-brackets", start=F.col("ix"), end=F.col("ix") + one).unionByName(issue(p.where(n('"') % 2 == 1), "unbalanced-quotes", start=F.col("ix"), end=F.col("ix") + one))


def sentence_capitals(text: DataFrame) -> DataFrame:
    f = found(text, r"[A-Za-z]{3,}[.!?]\s+[a-z][a-z']*").withColumn("word", F.regexp_extract("hit", r"([a-z']+)$", 1))
    f = f.where(F.col("word").isin(*STARTERS) & ~F.lower(F.regexp_extract("hit", r"^([A-Za-z]+)", 1)).isin(*P.ABBREVIATIONS))
    return issue(f, "sentence-capital", F.initcap("word"), start=F.col("end") - F.length("word"))


def vowel_sound(word: Column) -> Column:
    """Whether a word begins with a vowel sound; null if it can't be told."""
    plain = F.translate(word, FOLDED, "sk")
    named = F.substring(word, 1, 1).isin(*"AEFHILMNORSX")
    out = F.when(word.rlike("^[A-Z]{2,}$"), F.when(~word.rlike("[AEIOU]"), named)).when(word.rlike("^[A-Z]$"), named).when(word.rlike("[0-9]"), F.lit(None))
    out = out.when(plain.rlike("(?i)^(?:hour|honest|honor|honour|heir|x-)"), F.lit(True))
    return out.when(plain.rlike("(?i)^(?:one|once|ouija|eu|ewe|uni(?:[^mn]|$)|use|usu|uti|ubiq|ukr|uran|ural|uter|urin|urol|urea)"), F.lit(False)).otherwise(plain.rlike("(?i)^[aeiou]"))


def articles(text: DataFrame) -> DataFrame:
    """A line break is no part of the word before it: an article that opens a line counts."""
    f = found(text, rf"(?i)an?\s+{LETTER}{LETTERS}").where(~F.col("before").rlike(rf"{ONE_WORD}\z"))
    f = f.withColumn("article", F.regexp_extract("hit", r"(?i)^(an?)", 1)).withColumn("word", F.regexp_extract("hit", rf"(?i)({LETTER}{LETTERS})\z", 1))
    f = f.where(~F.col("word").rlike(r"^[a-z]\z")).withColumn("vowel", vowel_sound(F.col("word")))
    f = f.where(F.col("vowel") != (F.lower("article") == "an"))
    return issue(f, "a-an", T.match_case(F.col("article"), F.when(F.col("vowel"), "an").otherwise("a")), end=F.col("start") + F.length("article"))


def confusions(text: DataFrame) -> DataFrame:
    """One pass finds texts with any of the phrases; matches are told apart, and repaired, by which pattern they fit."""
    def by(rules, rule):
        f = found(text, "(?i)(?:" + "|".join(p for p, _ in rules) + ")").where(~F.col("before").rlike(rf"{ONE_WORD}\z") & ~F.col("after").rlike(f"^{ONE_WORD}"))
        fixed = F.lit(None).cast("string")
        for p, by_ in reversed(rules):
            # Java's replacement syntax has the same $ groups
            fixed = F.when(F.col("hit").rlike(f"(?i)^(?:{p})$"), F.regexp_replace("hit", f"(?i)^(?:{p})$", by_)).otherwise(fixed)
        return issue(f, rule, T.match_case(F.col("hit"), fixed))

    return by(CONFUSIONS, "confused-words").unionByName(by(LIKELY, "likely-confusion"))


def lexicon_rows() -> list[tuple[str, str, str]]:
    """(phrase, rule, suggestion) of all lists; words are as tokens are: lower case, ASCII apostrophes."""
    rows = [(p, "wordy-phrase", r) for p, r in WORDY] + [(p, "informal-wording", "|".join(r)) for p, r in INFORMAL] + [(w, "weak-word", None) for w in WEAK]
    rows += [(c, "contraction", long) for c, long in CONTRACTIONS] + [(m, "spelling", w) for m, w in MISSPELLINGS.items()]
    return rows + [(b, "british", a) for b, a in british_to_american().items()] + [(a, "american", b) for b, a in british_to_american().items()]


def lexicon_hits(text: DataFrame) -> DataFrame:
    """doc_id, rule, pos, n, phrase, suggestion (places in words): longest phrase of a list at each place, none inside another."""
    words, spark = with_words(text), text.sparkSession
    hits = None
    rows = lexicon_rows()
    one = [(p, f"{rule}={s or ''}") for p, rule, s in rows if " " not in p]
    many = [(p, f"{rule}={s or ''}") for p, rule, s in rows if " " in p]
    single = F.broadcast(spark.createDataFrame(one, "phrase string, value string"))  # about 1,500 words
    t = words.select("doc_id", F.inline(placed(F.col("words"), {p for p, _ in one}))).withColumnRenamed("w", "phrase").join(single, "phrase").withColumn("n", F.lit(1))
    hits = t.select("doc_id", "pos", "n", "phrase", "value").unionByName(phrase_hits(words, spark.createDataFrame(many, "phrase string, value string")))
    cut = F.split("value", "=", 2)
    return hits.select("doc_id", cut[0].alias("rule"), "pos", "n", "phrase", cut[1].alias("suggestion"))


def spelling_variety(hits: DataFrame) -> DataFrame:
    """The minority's words where a text has British and American forms (British on ties)."""
    both = hits.where(F.col("rule").isin("british", "american"))
    doc = W.partitionBy("doc_id")
    both = both.withColumn("uk", F.count_if(F.col("rule") == "british").over(doc)).withColumn("us", F.count_if(F.col("rule") == "american").over(doc))
    minority = F.when(F.col("uk") <= F.col("us"), "british").otherwise("american")
    return both.where((F.col("uk") > 0) & (F.col("us") > 0) & (F.col("rule") == minority)).select("doc_id", F.lit("mixed-spelling-variety").alias("rule"), "pos", "n", "phrase", "suggestion")


def lexicon_issues(text: DataFrame) -> DataFrame:
    hits = lexicon_hits(text)
    return hits.where(~F.col("rule").isin("british", "american")).unionByName(spelling_variety(hits))


def passives(text: DataFrame, least: int = 5, share: float = 0.4) -> DataFrame:
    """doc_id, ix: passive sentences of texts with `least` sentences of which over `share` are passive."""
    d = text.select("doc_id", T.simple_sentences(F.col("text")).alias("s")).withColumn("p", F.transform("s", S.is_passive))
    n = F.size(F.filter("p", lambda x: x))
    return d.where((F.size("s") >= least) & (n > share * F.size("s"))).select("doc_id", F.posexplode("p").alias("ix", "p")).where("p").select("doc_id", "ix")


def long_sentences(text: DataFrame, limit: int = 40) -> DataFrame:
    """doc_id, ix, words, severity; sentences over several short lines (tables, lists) are left out."""
    s = text.select("doc_id", F.posexplode(T.simple_sentences(F.col("text"))).alias("ix", "s")).withColumn("words", T.word_count(F.col("s"))).where(F.col("words") > limit)
    lines = F.filter(F.split("s", "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: T.word_count(x) <= 12))
    return s.where(~((F.size(lines) >= 3) & (short >= 0.6 * F.size(lines)))).select("doc_id", "ix", "words", F.when(F.col("words") > 1.5 * limit, "error").otherwise("warning").alias("severity"))


def repeated_starts(text: DataFrame) -> DataFrame:
    """doc_id, paragraph, ix, word: the third sentence in a row of one paragraph that begins with one word."""
    p = paragraphs(text).select("doc_id", F.col("ix").alias("paragraph"), F.posexplode(T.simple_sentences(F.col("text"))).alias("ix", "s"))
    p = p.withColumn("word", F.lower(F.regexp_extract("s", r"^([\p{L}']+)", 1)))
    order = W.partitionBy("doc_id", "paragraph").orderBy("ix")
    island = F.col("ix") - F.row_number().over(W.partitionBy("doc_id", "paragraph", "word").orderBy("ix"))
    p = p.withColumn("island", island)
    nth = F.row_number().over(W.partitionBy("doc_id", "paragraph", "word", "island").orderBy("ix"))
    return p.withColumn("nth", nth).where("nth = 3 and word != ''").select("doc_id", "paragraph", "ix", "word")


def number_starts(text: DataFrame) -> DataFrame:
    """doc_id, ix, number: sentences of five words or more that begin with a numeral (not a list mark)."""
    s = text.select("doc_id", F.posexplode(T.simple_sentences(F.col("text"))).alias("ix", "s"))
    s = s.withColumn("number", F.regexp_extract("s", r"^([0-9]+(?:[.,][0-9]+)?)", 1))
    return s.where((F.col("number") != "") & ~F.col("s").rlike(r"^[0-9]+(?:[.,][0-9]+)?[0-9.]*\s*[.)]") & (T.word_count(F.col("s")) >= 5)).select("doc_id", "ix", "number")


def acronyms(text: DataFrame) -> DataFrame:
    """doc_id, rule, acronym, uses: never defined in brackets though used twice, or used before the definition."""
    t = chosen_spans(text, lambda raws: F.transform(raws, lambda w: w.rlike("^[A-Z]{2,6}s?$"))).withColumn("acronym", F.regexp_replace("raw", "s$", ""))
    t = t.where(~F.col("acronym").rlike("^[IVXLCDM]+$") & ~F.col("acronym").isin(*ACRONYMS))
    g = t.groupBy("doc_id", "acronym").agg(F.count("*").alias("uses"), F.min("start").alias("first"))
    d = found(text, r"\(\s*[A-Z]{2,6}s?\s*\)").select("doc_id", F.regexp_replace(F.regexp_extract("hit", "([A-Z]{2,6}s?)", 1), "s$", "").alias("acronym"), "start").groupBy("doc_id", "acronym").agg(F.min("start").alias("defined"))
    j = g.join(d, ["doc_id", "acronym"], "left")
    rule = F.when(F.col("defined").isNull() & (F.col("uses") >= 2), "undefined-acronym").when(F.col("defined") > F.col("first"), "acronym-before-definition")
    return j.withColumn("rule", rule).where("rule is not null").select("doc_id", "rule", "acronym", "uses")


def summary(counts: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, total, errors, warnings, infos, per_1000, score from counts (doc_id, severity, n) and words (doc_id, words)."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0))
    g = counts.groupBy("doc_id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    g = words.join(g, "doc_id", "left").na.fill(0)
    k = F.greatest("words", F.lit(100)) / 1000.0
    total = F.col("errors") + F.col("warnings") + F.col("infos")
    weighted = (F.col("errors") * 5 + F.col("warnings") * 2 + F.col("infos") * 0.4) / k
    score = F.floor(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - weighted * 0.6)), 9) + 0.5)
    return g.select("doc_id", total.alias("total"), "errors", "warnings", "infos", T.half_up(F.round(total / k, 9), 1).alias("per_1000"), score.cast("int").alias("score"))


def severity_of(rule: Column) -> Column:
    out = F.lit("info")
    for name, (_, severity) in RULES.items():
        out = F.when(rule == name, severity).otherwise(out)
    return out


def category_of(rule: Column) -> Column:
    out = F.lit("grammar")
    for name, (category, _) in RULES.items():
        out = F.when(rule == name, category).otherwise(out)
    return out


def all_counts(docs: DataFrame) -> DataFrame:
    """doc_id, rule, severity, n over all rules: a union, then one aggregation. Masked texts are stored: fourteen rules read them."""
    text = stored(checked(docs), "checked")
    parts = [f(text).select("doc_id", "rule", "severity") for f in (repeated_words, spacing, unbalanced, sentence_capitals, articles, confusions)]
    named = lambda df, rule: df.select("doc_id", F.lit(rule).alias("rule"))
    others = [lexicon_issues(text).select("doc_id", "rule"), named(passives(text), "passive-voice"), named(repeated_starts(text), "repeated-sentence-start"), named(number_starts(text), "number-at-start"), acronyms(text).select("doc_id", "rule")]
    parts += [o.withColumn("severity", severity_of(F.col("rule"))) for o in others] + [long_sentences(text).select("doc_id", F.lit("long-sentence").alias("rule"), "severity")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))


def merge_issues(own: DataFrame, others: DataFrame) -> DataFrame:
    """own and others (doc_id, rule, category, start, end): duplicates of a place and rule fall away, and of the others' grammar,
    spelling and punctuation findings those that overlap one of ours."""
    o = others.dropDuplicates(["doc_id", "rule", "start", "end"])
    a, b = o.alias("o"), own.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e")).alias("m")
    near = (F.col("o.doc_id") == F.col("m.doc_id")) & (F.col("o.start") < F.col("m.e")) & (F.col("m.s") < F.col("o.end")) & F.col("o.category").isin("grammar", "spelling", "punctuation")
    return own.dropDuplicates(["doc_id", "rule", "start", "end"]).unionByName(a.join(b, near, "left_anti"))


def apply_fixes(docs: DataFrame, fixes: DataFrame) -> DataFrame:
    """doc_id, text, applied: replacements (doc_id, start, end, suggestion) spliced in by position; of overlapping ones the first stays."""
    f = fixes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "suggestion"))).alias("f"))
    d = docs.join(f, "doc_id", "left").withColumn("f", F.coalesce("f", F.array().cast("array<struct<start:bigint,end:bigint,suggestion:string>>")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"))
    piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    fold = F.aggregate("f", start, lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(F.concat(s["out"], piece(s["at"], x["start"]), x["suggestion"]).alias("out"), x["end"].alias("at"), (s["n"] + 1).alias("n"))))
    d = d.withColumn("s", fold)
    return d.select("doc_id", F.concat("s.out", piece(F.col("s.at"), F.length("text"))).alias("text"), F.col("s.n").alias("applied"))
