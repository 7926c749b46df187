"""Shared parts of the registered queries: the texts they read and SQL pieces for their oracles.

Queries on texts read the whole `documents` table together with a few short texts of our own (negative ids), which hold what
the table has none of: citations, quotations, disguised letters, stock phrases, headings and blank lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import LOOKALIKES, STOPWORDS
from inkwell.tables import table

FIXTURES: tuple[tuple[int, str], ...] = (
    (-1, 'It is important to note that we delve into the data. Moreover, the results plays a crucial role in in this field. However, a apple and an book were utilised.\n\nFurthermore, "a quotation that is long enough to count as one, with 44 letters" (Smith, 2020) stands here. The CNN beats the SVM. The CNN wins. The CNN is quick.'),
    (-2, 'We use a convolutional neural network (CNN) , which doesn\'t need labels;we can\'t say more. Due to the fact that the colour and the color differ, the behaviour is very basically the same. 12 of the samples were found to be lost.\n\nIntroduction\n\nThe first one was taken by us. The second was written by them. The third was shown here. The fourth is known well. The fifth was made there.'),
    (-3, 'Prior work [1, 2] and [4-6] disagrees with Jones and Lee (2019) and with (Garcia et al., 2018; van Dyke, 2017b). See [9] for more, and [3].\n\nReferences\n\n[1] Smith, J. (2020). A study of things. Journal of Things, 12(3), 45-67. https://doi.org/10.1000/xyz123\n[2] Lee, K., & Park, S. (2019). Another study of\nmany things. Science Letters, 4, 1-9. arXiv:1905.01234v2'),
    (-4, 'Thе rеsults wеrе gооd and the pro​cess was hid​den from che​ckers. Profound learning and counterfeit consciousness give irregular timberland scores. A B C D E F G H I done.'),
    (-5, 'Email me at a.b@example.org or see https://example.org/a?b=1. Values rose by 12.5% (p < 0.05) from -3.2e-4 to 7 kg, $x^2 + y$ holds, and “the quoted words here go on for well over forty characters” as said. The the end. I think we shall see; it was done, and done, and done again!  Two blanks here .'),
    (-6, ''),
    (-7, 'The recieved data could of been lost, alot of it (mostly. this shows less participants, and the results shows it; there own study was better then ours, teh end.It was done. You can not get a lot of stuff in order to look into things. Thus we wait. 3 of them were kind of big and we were told. I said "no.'),
    (-8, 'Studies in many countries show that sleep improves memory in adults. It has been widely reported that coffee leads to a higher risk of sleeplessness. We believe that our study of sleep is commonly cited here. Is it widely known that trials suggest otherwise in most of the cases?'),
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: all documents and the fixtures."""
    own = spark.createDataFrame(list(FIXTURES), "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, *columns: str) -> str:
    """A VALUES list that Spark and DuckDB both read."""
    one = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + f") v({', '.join(columns)})"


def given(spark: SparkSession, sf_dir: str, rows, ddl: str, select: str) -> DataFrame:
    """A few rows of our own together with those that `select` derives from given tables.

    select is SQL that Spark and DuckDB both read; {documents} and the like stand for tables, columns go by position."""
    own = spark.createDataFrame(list(rows), ddl)
    made = spark.sql(select, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", select))})
    return own.unionByName(made.toDF(*own.columns).select(*[F.col(f"`{c.name}`").cast(c.dataType) for c in own.schema]))


def given_sql(rows, select: str, *columns: str) -> str:
    """The rows of `given` for DuckDB."""
    return f"(SELECT * FROM {values(rows, *columns)} UNION ALL {re.sub(r'[{}]', '', select)}) v({', '.join(columns)})"


def sql_name(key: str, seed: str) -> str:
    """A made name of a key, in SQL that Spark and DuckDB both read."""
    x = f"translate(md5(CAST({key} AS STRING) || '{seed}'), '0123456789', 'ghijklmnop')"
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2, 6))"


#: The first line of a document as a title.
TITLE = "coalesce(nullif(trim(substr(split_part(text, chr(10), 1), 1, 80)), ''), 'Untitled')"


TEXTS = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {values(FIXTURES, 'doc_id', 'text')})"

_ODD, _PLAIN = "".join(a for a, _ in LOOKALIKES), "".join(b for _, b in LOOKALIKES)


def sql_unconfuse(x: str) -> str:
    only = f"regexp_replace({x}, '[{_ODD}]|[^\\p{{L}}]', '', 'g') = ''"
    return f"CASE WHEN regexp_matches({x}, '[{_ODD}]') AND ({only} OR regexp_matches({x}, '[A-Za-z]')) THEN translate({x}, '{_ODD}', '{_PLAIN}') ELSE {x} END"


def sql_normal(x: str) -> str:
    clean = f"regexp_replace({x}, '[{T.INVISIBLE}]', '', 'g')"
    folded = f"translate({clean}, '{T.WIDE}', '{T.NARROW}')"
    for form, letters in T.LIGATURES:
        folded = f"replace({folded}, '{form}', '{letters}')"
    rare = f"replace(lower(list_transform([{folded}], lambda c: {sql_unconfuse('c')})[1]), '’', '''')"
    return f"CASE WHEN regexp_full_match({x}, '[\\x00-\\x7f]*') THEN lower({x}) ELSE {rare} END"


def sql_raw_words(text: str) -> str:
    return f"regexp_extract_all({text}, {quote(T.WORD)})"


def sql_words(text: str) -> str:
    return f"list_transform({sql_raw_words(text)}, lambda w: {sql_normal('w')})"


def sql_simple_sentences(text: str) -> str:
    cut = f"regexp_split_to_array(regexp_replace({text}, '([.!?]+[\"'')\\]]*)\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s != '')"


WORDS = f"{TEXTS}, ws AS (SELECT doc_id, {sql_words('text')} AS words FROM texts)"
TOKENS = f"{WORDS}, tok AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM ws)"
SENTENCES = f"{TEXTS}, ss AS (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM texts), sen AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS ix FROM ss)"
STOP = "(" + ", ".join(quote(w) for w in STOPWORDS) + ")"
