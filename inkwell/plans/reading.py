"""Queries on sources: pages, marked-up texts, requests, history, searching a local corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.operators import lines as LN
from inkwell.plans.common import given, given_sql, quote, sql_name, sql_words, values
from inkwell.plans.texts_and_statistics import sql_matches
from inkwell.sources import library as L
from inkwell.sources import markup as M
from inkwell.sources import records as RC
from inkwell.tables import shared_dir, table


def io07(spark, sf_dir):
    t = M.html_text(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("md5"))


def sql_entities(x: str) -> str:
    hit = r"&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};"
    code = "CASE WHEN regexp_matches(m, '^&#[xX]') THEN ('0x' || regexp_extract(m, '([0-9a-fA-F]+);$', 1))::INT ELSE regexp_extract(m, '([0-9]+);$', 1)::INT END"
    out = f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '{hit}'), list_transform({sql_matches(x, hit)}, lambda m: CASE WHEN {code} > 0 AND {code} < 1114112 THEN chr({code}) ELSE m END)), lambda p: p[1] || coalesce(p[2], '')), '')"
    for name, c in M.ENTITIES:
        out = f"regexp_replace({out}, '(?i)&{name};', {quote(c)}, 'g')"
    return out


def sql_lines(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t ]+', ' ', 'g'))), lambda l: l != ''), chr(10))"


def _html_sql() -> str:
    t = "regexp_replace(CASE WHEN i != '' THEN i ELSE html END, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in M.DROPPED:
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, '(?i)</?(?:{M.BLOCKS})\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"


IO07 = f"""WITH a AS (SELECT page_id, coalesce(html, '') AS html, regexp_extract(coalesce(html, ''), '(?is)<body\\b[^>]*>(.*)</body>', 1) AS i FROM pages), b AS (SELECT page_id, {_html_sql()} AS x FROM a), c AS (SELECT page_id, {sql_entities('x')} AS x FROM b), d AS (SELECT page_id, {sql_lines('x')} AS t FROM c)
SELECT page_id, length(t) AS chars, md5(t) AS md5 FROM d"""
ENCODED = ((1, "a &lt; b &amp;amp; c"), (2, "&#233;&#xe9;&#X20AC;&#0;&#99999999;"), (3, "&NBSP;x&unknown;&ndash;&hellip;"), (4, "plain"), (5, "&#128512; smile"))
ENCODED_FROM = "SELECT page_id + 100, html FROM {pages}"


def io08(spark, sf_dir):
    return given(spark, sf_dir, ENCODED, "id long, s string", ENCODED_FROM).select("id", M.decode_entities(F.col("s")).alias("text"))


XML = ((1, "<article><title>On things</title><abstract><p>First &amp; last.</p></abstract><sec><p>Body<xref>1</xref> text.</p><fig id='f1'><label>Figure 1</label><caption><p>A <i>fine</i> figure.</p></caption><graphic xlink:href=\"fig1.jpg\"/></fig><fig><label>Bad</label><caption>x</caption><graphic xlink:href=\"../etc\"/></fig></sec><ref-list><ref>Gone</ref></ref-list></article>"), (2, "<p>Only one</p>"))
XML_FROM = """SELECT doc_id + 100, '<article><title>Text ' || CAST(doc_id AS STRING) || ' &amp; more</title><abstract><p>' || replace(replace(coalesce(text, ''), '<', ' '), '&', '&amp;') || '</p></abstract><sec><p>See<xref>' || CAST(doc_id % 9 AS STRING) || '</xref>.</p><fig id="f' || CAST(doc_id AS STRING) || '"><label>Figure <b>' || CAST(doc_id % 7 AS STRING) || '</b></label><caption><p>Of ' || replace(replace(split_part(coalesce(text, ''), chr(10), 1), '<', ' '), '&', '&amp;') || '</p></caption><graphic xlink:href="' || CASE WHEN doc_id % 8 = 0 THEN '../' ELSE '' END || 'fig' || CAST(doc_id AS STRING) || '.png"/></fig></sec><ref-list><ref>Gone</ref></ref-list></article>' FROM {documents}"""


def io09(spark, sf_dir):
    return given(spark, sf_dir, XML, "id long, x string", XML_FROM).select("id", M.jats_text(F.col("x")).alias("text"))


def _jats_sql() -> str:
    t = "x"
    for tag in ("ref-list", "table-wrap", "fig", "disp-formula", "inline-formula"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, '(?i)</(?:p|title|sec|abstract)\\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"


IO09 = f"WITH a AS (SELECT id, {_jats_sql()} AS x FROM {given_sql(XML, XML_FROM, 'id', 'x')}), b AS (SELECT id, {sql_entities('x')} AS x FROM a) SELECT id, {sql_lines('x')} AS text FROM b"


def io42(spark, sf_dir):
    return given(spark, sf_dir, XML, "id long, x string", XML_FROM).select("id", F.posexplode(M.jats_figures(F.col("x"))).alias("ix", "f")).select("id", "ix", "f.*")


IO42 = rf"""WITH a AS (SELECT id, regexp_extract_all(x, '(?is)<fig\b[^>]*>(.*?)</fig>', 1) AS fs FROM {given_sql(XML, XML_FROM, 'id', 'x')}), b AS (SELECT id, list_filter(list_transform(fs, lambda f: {{'label': trim(regexp_replace(regexp_replace(regexp_extract(f, '(?is)<label>(.*?)</label>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')),
 'caption': left(trim(regexp_replace(regexp_replace(regexp_extract(f, '(?is)<caption>(.*?)</caption>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 300), 'file': regexp_extract(f, '<graphic[^>]*href="([A-Za-z0-9_.-]+)"', 1)}}), lambda f: f.file != '') AS fs FROM a),
c AS (SELECT id, unnest(fs) AS f, generate_subscripts(fs, 1) - 1 AS ix FROM b) SELECT id, ix, f.label AS label, f.caption AS caption, f.file AS file FROM c"""
LATEX = ((1, r"\documentclass{article}\begin{document}\title{On \emph{things}} % note" + "\n" + r"\section{Start} We cite \cite{a} and use 50\% of it~here---``quoted''. \begin{figure}\includegraphics{x}\caption{A \textbf{bold} caption}\end{figure} \begin{equation} a = b \end{equation}" + "\n\n" + r"\begin{itemize}\item one\item two\end{itemize} \begin{thebibliography}{9}\bibitem{a} First. \bibitem{b} Second.\end{thebibliography}\end{document} after"),)


LATEX_TEXT = "On things\n\nStart\n\nWe cite \\cite{a} and use 50% of it here—“quoted”.\n\nA bold caption\n\n$$a = b$$\n\none\n\ntwo\n\nReferences\n\n[1] First.\n\n[2] Second."


def io04(spark, sf_dir):
    """Each document as an article whose words with t are emphasised in bold, and a short article of our own, back as text."""
    x = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\\~`", "   "), "([%&$#_{}])", r"\\$1")
    x = F.regexp_replace(x, "(^|[^A-Za-z])(t[a-z]+)", r"$1\\emph{\\textbf{$2}}")
    s = F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n\\section{Document "), F.col("doc_id").cast("string"), F.lit("}\n% a note\n"), x, F.lit("\n\\end{document}\n"))
    own = spark.createDataFrame([(-i, t) for i, t in LATEX], "doc_id long, s string")
    t = table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).unionByName(own).select("doc_id", L.latex_text(F.col("s")).alias("t"))
    return t.select("doc_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("md5"))


IO04 = rf"""WITH a AS (SELECT doc_id, replace(replace(replace(translate(coalesce(text, ''), '\~`', '   '), '''''', '”'), '---', '—'), '--', '–') AS x FROM documents),
p AS (SELECT doc_id, list_prepend('Document ' || doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(x, '\r\n?', chr(10), 'g'), '\n[ \t\n\r\f]*\n'), lambda b: trim(regexp_replace(regexp_replace(b, '[ \t\n\r\f]*\n[ \t\n\r\f]*', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12))), lambda b: b != '')) AS ps FROM a),
t AS (SELECT doc_id, array_to_string(ps, chr(10) || chr(10)) AS t FROM p UNION ALL SELECT * FROM {values([(-1, LATEX_TEXT)], 'doc_id', 't')})
SELECT doc_id, length(t) AS chars, md5(t) AS md5 FROM t"""


def broken(spark, sf_dir):
    """All documents broken into lines of up to 60 characters, with a page number after every line that ends in a full stop."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "(.{1,60})( |$)", "$1\n"), r"\.\n", ".\n12\n")
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))


def io05(spark, sf_dir):
    return broken(spark, sf_dir).select("doc_id", LN.rejoined(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("md5"))


IO05 = rf"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '(.{{1,60}})( |$)', '\1' || chr(10), 'g'), '\.' || chr(10), '.' || chr(10) || '12' || chr(10), 'g') AS text FROM documents),
l0 AS (SELECT doc_id, list_transform(string_split(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(173), ''), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)) AS ls FROM r),
l1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l0), l2 AS (SELECT *, count(*) FILTER (line = '') OVER (PARTITION BY doc_id ORDER BY i) AS block, regexp_matches(line, {quote(LN.PAGE)}) AS page FROM l1),
l3 AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id, block ORDER BY i), '') AS before, avg(CASE WHEN NOT page THEN length(line) END) OVER (PARTITION BY doc_id) AS mean FROM l2 WHERE line != ''),
l4 AS (SELECT *, lag(line) OVER o AS last, lead(line) OVER o AS nxt FROM l3 WHERE NOT page WINDOW o AS (PARTITION BY doc_id, block ORDER BY i)),
l5 AS (SELECT doc_id, block, i, CASE WHEN last IS NULL OR (regexp_matches(last, '[a-z]-$') AND regexp_matches(line, '^[a-z]')) THEN '' WHEN (regexp_matches(before, '[.!?:]["”)]?$') AND length(before) < mean * 0.7::DOUBLE AND regexp_matches(line, '^[A-Z0-9\[“"(]')) OR regexp_matches(line, {quote(LN.HEADING)}) OR regexp_matches(before, {quote(LN.HEADING)}) THEN chr(10) || chr(10) ELSE ' ' END
 || CASE WHEN regexp_matches(line, '[a-z]-$') AND coalesce(regexp_matches(nxt, '^[a-z]'), false) THEN left(line, length(line) - 1) ELSE line END AS part FROM l4),
b AS (SELECT doc_id, block, string_agg(part, '' ORDER BY i) AS t FROM l5 GROUP BY doc_id, block), d AS (SELECT r.doc_id, coalesce(string_agg(b.t, chr(10) || chr(10) ORDER BY block), '') AS t FROM r LEFT JOIN b USING (doc_id) GROUP BY r.doc_id)
SELECT doc_id, length(t) AS chars, md5(t) AS md5 FROM d"""
FILES = ((1, "a.pdf", "25504446"), (2, "b.docx", "504B0304"), (3, "c.TXT", "48656C6C6F"), (4, "d.doc", "D0CF11E0"), (5, "e.pdf", "48656C6C"), (6, "f.xyz", "00"), (7, "g.docx", "25504446"), (8, "h.tex", "5C62"))
FILES_FROM = "SELECT page_id + 100, 'page' || CAST(page_id AS STRING) || CASE page_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.TXT' WHEN 3 THEN '.doc' WHEN 4 THEN '.md' WHEN 5 THEN '' ELSE '.html' END, CASE page_id % 5 WHEN 0 THEN '25504446' WHEN 1 THEN '504B0304' WHEN 2 THEN 'D0CF11E0' ELSE upper(substr(md5(url), 1, 8)) END FROM {pages}"


def io01(spark, sf_dir):
    return given(spark, sf_dir, FILES, "id long, name string, h string", FILES_FROM).select("id", M.file_kind(F.col("name"), F.unhex("h")).alias("kind"))


IO01 = f"""WITH f AS (SELECT id, left(h, 8) AS head, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM {given_sql(FILES, FILES_FROM, 'id', 'name', 'h')})
SELECT id, CASE WHEN head = '25504446' THEN CASE WHEN e = 'docx' THEN 'mismatch' ELSE 'pdf' END WHEN starts_with(head, '504B') THEN CASE WHEN e = 'docx' THEN 'docx' WHEN e = 'pdf' THEN 'mismatch' ELSE 'unknown' END WHEN e IN ('txt', 'md', 'tex') THEN e WHEN e = 'doc' THEN 'old-word' WHEN e IN ('pdf', 'docx') THEN 'mismatch' ELSE 'unknown' END AS kind FROM f"""


def io15(spark, sf_dir):
    """Each source's documents as one request: the first 20, while they hold up to 40,000 characters."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.coalesce("source", F.lit("")).alias("request"), F.col("doc_id").alias("ix"), F.left("text", F.lit(250)).alias("title"), "text")
    return L.uploads(d, 20, 40_000).select("request", "ix", F.length("title").alias("title_chars"), F.length("text").alias("chars"))


IO15 = """WITH d AS (SELECT coalesce(source, '') AS request, doc_id AS ix, text, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS n FROM documents WHERE trim(text) != ''),
u AS (SELECT *, sum(length(text)) OVER (PARTITION BY request ORDER BY ix) AS upto FROM d WHERE n <= 20) SELECT request, ix, least(length(text), 200) AS title_chars, length(text) AS chars FROM u WHERE upto <= 40000"""


def io16(spark, sf_dir):
    """Event properties, parsed and checked."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("with_k"), F.sum("p.k").alias("sum_k"), F.max("p.k").alias("max_k"))


IO16 = "WITH e AS (SELECT event_type, (json_extract(props, '$.k'))::BIGINT AS k FROM events) SELECT event_type, count(*) AS n, count(k) AS with_k, sum(k)::BIGINT AS sum_k, max(k) AS max_k FROM e GROUP BY event_type"


def io21(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(L.history_key(F.lit("overlap"), F.coalesce("text", F.lit(""))).alias("key"), F.col("doc_id").alias("created"), F.col("doc_id").cast("string").alias("result"))
    return L.latest_results(d)


IO21 = r"WITH h AS (SELECT sha256('overlap' || chr(10) || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS key, doc_id AS created, doc_id::VARCHAR AS result FROM documents) SELECT key, max(created) AS created, arg_max(result, created) AS result FROM h GROUP BY key"
INVERTED = ((1, {"the": [0, 3], "cat": [1], "saw": [2], "dog": [4]}), (2, {"alone": [0]}))


def io41(spark, sf_dir):
    index = L.inverted_index(table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), "text"))
    return L.from_inverted_index(spark.createDataFrame(list(INVERTED), "id long, index map<string, array<int>>").unionByName(index))


IO41 = f"SELECT id, string_agg(word, ' ' ORDER BY p) AS text FROM {values([(i, w, p) for i, m in INVERTED for w, ps in m.items() for p in ps], 'id', 'word', 'p')} GROUP BY id UNION ALL SELECT doc_id + 100, coalesce(text, '') FROM documents"
REPLIES = ((1, 'Sure:\n```json\n{"a": 1}\n```'), (2, 'The answer is {"p": 0.5, "r": ["x"]} I think'), (3, "no json"), (4, '{"whole": true}'))
REPLIES_FROM = """SELECT conv_id * 1000 + turn, CASE turn % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || chr(123) || '"turn": ' || CAST(turn AS STRING) || chr(125) || chr(10) || '```' WHEN 1 THEN text || ' ' || chr(123) || '"conv": [' || CAST(conv_id AS STRING) || ']' || chr(125) || ' it is' ELSE text END FROM {conversations} WHERE text IS NOT NULL"""


def io44(spark, sf_dir):
    return given(spark, sf_dir, REPLIES, "id long, s string", REPLIES_FROM).select("id", M.reply_json(F.col("s")).alias("json"))


IO44 = rf"WITH r AS (SELECT id, regexp_extract(s, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```', 1) AS f, regexp_extract(s, '(?s)(\{{.*\}})', 1) AS b FROM {given_sql(REPLIES, REPLIES_FROM, 'id', 's')}) SELECT id, nullif(CASE WHEN f != '' THEN f ELSE b END, '') AS json FROM r"
ERRORS = ((1, "HTTP 429 Too Many"), (2, "TimeoutError: timed out"), (3, "status 503"), (4, "401 unauthorized"), (5, "ECONNRESET"), (6, "code 4290"))
ERRORS_FROM = "SELECT event_id + 100, event_type || ' ' || CAST(400 + event_id * 7 % 110 AS STRING) || CASE event_id % 6 WHEN 0 THEN ' Timed out' WHEN 1 THEN ' rate-limit' ELSE '' END FROM {events}"


def f22(spark, sf_dir):
    return given(spark, sf_dir, ERRORS, "id long, m string", ERRORS_FROM).select("id", M.failure_reason(F.col("m")).alias("reason"))


F22 = rf"""SELECT id, CASE WHEN regexp_matches(m, '(?i)\b429\b|rate.?limit|too many') THEN 'the service was busy and asked us to slow down' WHEN regexp_matches(m, '(?i)timeout|timed out|abort') THEN 'the service did not answer in time' WHEN regexp_matches(m, '\b5[0-9][0-9]\b') THEN 'the service had a server error'
 WHEN regexp_matches(m, '\b40[13]\b') THEN 'the service refused the request; an API key may be needed' ELSE 'the service could not be reached' END AS reason FROM {given_sql(ERRORS, ERRORS_FROM, 'id', 'm')}"""


def f22_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", M.redacted_url(F.col("url")).alias("url"))


def io30(spark, sf_dir):
    """Documents that hold the first eight words of a benchmark item."""
    p = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("phrase"))
    return L.phrase_search(p, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


IO30 = f"""WITH p AS (SELECT item_id AS query, {sql_words("array_to_string(string_split(text, ' ')[1:8], ' ')")} AS p FROM benchmark), w AS (SELECT doc_id AS source_id, {sql_words('text')} AS words FROM documents), t AS (SELECT source_id, words, unnest(range(len(words))) AS i FROM w),
f AS (SELECT source_id, words, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS gram FROM t), h AS (SELECT DISTINCT query, source_id FROM f JOIN p ON len(p) >= 3 AND array_to_string(p[1:3], ' ') = gram AND words[i + 1 : i + len(p)] = p)
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY source_id) <= 3"""


def _keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_join(F.slice(F.split("text", " "), 3, 6), " ").alias("keywords"))


def io31(spark, sf_dir):
    return L.keyword_search(_keywords(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


def io36(spark, sf_dir):
    return L.keyword_search(_keywords(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"), all_words=True)


KEYS = f"""WITH k AS (SELECT DISTINCT query, unnest(ws) AS word FROM (SELECT item_id AS query, {sql_words("array_to_string(string_split(text, ' ')[3:8], ' ')")} AS ws FROM benchmark)), n AS (SELECT query, count(*) AS n FROM k GROUP BY query),
w AS (SELECT DISTINCT source_id, unnest(ws) AS word FROM (SELECT doc_id AS source_id, {sql_words('text')} AS ws FROM documents)), s AS (SELECT query, source_id, count(*) AS shared FROM w JOIN k USING (word) GROUP BY ALL)"""

#: Records of five services, one for each page. Slots between % are SQL; angle quotes stand for braces.
N1, N2, N3 = (sql_name("page_id", k) for k in "xyz")
SHAPES = (
    """⟨"DOI":"10.1000/AB%id%.","title":["On <i>%n1%</i> &amp; %n2%"],"author":[⟨"family":"%n1%","given":"%n2%"⟩,⟨"name":"%n3% Group"⟩,⟨"given":"lost"⟩],"issued":⟨"date-parts":[[%year%,3]]⟩,"container-title":["J. of <b>%n3%</b>"],"volume":"%vol%","page":"%vol%-9","URL":"https://x.example.org/%id%","type":"journal-article","is-referenced-by-count":%vol%,"abstract":"<p>About %n1%.</p>","relation":⟨"%rel%":[]⟩⟩""",
    """⟨"id":"https://o.example.org/W%id%","display_name":" %n1% of %n2% ","authorships":[⟨"author":⟨"display_name":"%n1% %n2%"⟩⟩,⟨"author":⟨"display_name":null⟩⟩],"publication_year":%year%,"primary_location":⟨"source":⟨"display_name":"%n3% Letters"⟩⟩,"biblio":⟨"volume":"%vol%","issue":"2","first_page":"5","last_page":"%vol%"⟩,"doi":"https://doi.org/10.1000/%id%","type":"article","cited_by_count":%vol%,"is_retracted":true,"abstract_inverted_index":⟨"we":[0,2],"saw":[1],"%n1%":[3]⟩⟩""",
    """⟨"data":⟨"attributes":⟨"doi":"10.5281/Z%id%","creators":[⟨"familyName":"%n1%","givenName":"%n2%"⟩,⟨"name":"%n3% Lab"⟩],"titles":[⟨"title":"Data of %n1%"⟩],"publicationYear":%year%,"publisher":⟨"name":"%n3%"⟩,"url":"https://z.example.org/%id%","types":⟨"resourceTypeGeneral":"Dataset"⟩,"descriptions":[⟨"descriptionType":"Other","description":"no"⟩,⟨"descriptionType":"Abstract","description":"Rows of %n2%."⟩]⟩⟩⟩""",
    """⟨"title":"%n2% again","authors":[⟨"name":"%n1% %n3%"⟩,⟨"name":null⟩],"year":%year%,"venue":"%n3% Conf","journal":⟨"volume":"%vol%"⟩,"externalIds":⟨"ArXiv":"1905.%vol%"⟩,"citationCount":%vol%,"publicationTypes":["Conference"],"url":"https://s.example.org/%id%"⟩""",
    """<entry><id>http://arxiv.org/abs/1905.%vol%v2</id><title>A preprint on
   %n1%</title><published>%year%-01-02T00:00:00Z</published><summary>It &lt;says&gt; %n2%.</summary><author><name>%n1% %n2%</name></author><author> <name>%n3%</name></author><arxiv:doi>10.48550/X%id%</arxiv:doi></entry>""",
)
SERVICES = ("crossref", "openalex", "datacite", "semanticscholar", "arxiv")


def _shape(text: str) -> str:
    slots = {"id": "CAST(page_id AS STRING)", "n1": N1, "n2": N2, "n3": N3, "year": "CAST(1950 + page_id % 70 AS STRING)", "vol": "CAST(page_id % 900 + 1000 AS STRING)", "rel": "CASE WHEN page_id % 3 = 0 THEN 'is-retracted-by' ELSE 'has-review' END"}
    parts = [slots[p] if i % 2 else quote(p) for i, p in enumerate(text.split("%"))]
    return f"translate({' || '.join(parts)}, '⟨⟩', chr(123) || chr(125))"


RECORDS_FROM = "SELECT page_id, CASE page_id % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SERVICES)) + " END, CASE page_id % 5 " + " ".join(f"WHEN {i} THEN {_shape(t)}" for i, t in enumerate(SHAPES)) + " END FROM {pages}"
BAD_RECORDS = ((-1, "crossref", "not json"), (-2, "elsewhere", "{}"), (-3, "openalex", "{}"))


def io40(spark, sf_dir):
    w = RC.works(given(spark, sf_dir, BAD_RECORDS, "work_id long, service string, body string", RECORDS_FROM))
    return w.withColumn("authors", F.array_join(F.transform("authors", lambda a: F.concat_ws("|", a["family"], a["given"])), "; "))


def _json(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


_BARE = lambda x: f"nullif(trim(regexp_replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')), '')"
_DOI = lambda x: f"nullif(lower(regexp_replace(regexp_extract({x}, '(10\\.[0-9]{{4,9}}/[^\\s\"<>]+)', 1), '[.,;:)]+$', '')), '')"
_ONE = lambda x: f"split_part({x}, ' ', 2) || '|' || split_part({x}, ' ', 1)"
IO40 = f"""WITH r AS (SELECT * FROM {given_sql(BAD_RECORDS, RECORDS_FROM, 'work_id', 'service', 'body')}), k AS (SELECT *, CASE WHEN service != 'arxiv' THEN try_cast(body AS JSON) END AS j, regexp_replace(body, '\\s+', ' ', 'g') AS x FROM r)
SELECT work_id, {_BARE(_json('title[0]'))} AS title, {_json('author[0].family')} || '|' || {_json('author[0].given')} || '; ' || {_json('author[1].name')} AS authors, {_json('issued.date-parts[0][0]').replace('date-parts', '"date-parts"')}::INT AS year, {_BARE(_json('container-title[0]').replace('container-title', '"container-title"'))} AS container, {_json('volume')} AS volume, NULL AS issue, {_json('page')} AS pages, {_DOI(_json('DOI'))} AS doi, {_json('URL')} AS url, NULL AS publisher,
 {_json('type')} AS type, NULL AS arxiv_id, {_json('is-referenced-by-count').replace('is-', '"is-').replace("count'", "count" + chr(34) + "'")}::INT AS citations, {_BARE(_json('abstract'))} AS abstract, CASE WHEN body LIKE '%is-retracted-by%' THEN 'retracted' END AS retraction, service AS source FROM k WHERE service = 'crossref' AND j IS NOT NULL
UNION ALL SELECT work_id, coalesce(trim({_json('display_name')}), '(untitled)'), coalesce({_ONE(_json('authorships[0].author.display_name'))}, ''), {_json('publication_year')}::INT, {_json('primary_location.source.display_name')}, {_json('biblio.volume')}, {_json('biblio.issue')}, {_json('biblio.first_page')} || '-' || {_json('biblio.last_page')}, {_DOI(_json('doi'))}, {_json('id')}, NULL,
 CASE WHEN {_json('type')} = 'article' THEN 'journal-article' END, NULL, {_json('cited_by_count')}::INT, CASE WHEN {_json('id')} IS NOT NULL THEN 'we saw we ' || list_filter(json_keys(j, '$.abstract_inverted_index'), lambda w: w NOT IN ('we', 'saw'))[1] END, CASE WHEN {_json('is_retracted')} = 'true' THEN 'retracted' END, service FROM k WHERE service = 'openalex'
UNION ALL SELECT work_id, {_json('data.attributes.titles[0].title')}, {_json('data.attributes.creators[0].familyName')} || '|' || {_json('data.attributes.creators[0].givenName')} || '; ' || {_json('data.attributes.creators[1].name')}, {_json('data.attributes.publicationYear')}::INT, NULL, NULL, NULL, NULL, {_DOI(_json('data.attributes.doi'))}, {_json('data.attributes.url')}, {_json('data.attributes.publisher.name')},
 lower({_json('data.attributes.types.resourceTypeGeneral')}), NULL, NULL, {_json('data.attributes.descriptions[1].description')}, NULL, service FROM k WHERE service = 'datacite'
UNION ALL SELECT work_id, {_json('title')}, {_ONE(_json('authors[0].name'))}, {_json('year')}::INT, {_json('venue')}, {_json('journal.volume')}, NULL, NULL, NULL, {_json('url')}, NULL, 'proceedings-article', {_json('externalIds.ArXiv')}, {_json('citationCount')}::INT, NULL, NULL, service FROM k WHERE service = 'semanticscholar'
UNION ALL SELECT work_id, regexp_extract(x, '<title>(.*?)</title>', 1), {_ONE("regexp_extract(x, '<name>(.*?)</name>', 1)")} || '; ' || regexp_extract(x, '</author><author> <name>(.*?)</name>', 1), regexp_extract(x, '<published>([0-9]{{4}})', 1)::INT, NULL, NULL, NULL, NULL, {_DOI("regexp_extract(x, '<arxiv:doi>(.*?)<', 1)")}, 'https://arxiv.org/abs/' || regexp_extract(x, 'abs/(.*?)<', 1), NULL,
 'preprint', regexp_extract(x, 'abs/(.*?)v2<', 1), NULL, replace(replace(regexp_extract(x, '<summary>(.*?)</summary>', 1), '&lt;', '<'), '&gt;', '>'), NULL, service FROM k WHERE service = 'arxiv'"""

def io23(spark, sf_dir):
    """Labelled documents written as JSON lines, with lines that are none or have other labels, and read back."""
    path = f"{shared_dir(spark)}/labelled-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id")
    label = F.when(F.col("doc_id") % 17 == 0, "other").when(F.col("quality") == 1, "human").otherwise("ai")
    line = F.when(F.col("doc_id") % 13 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct("text", label.alias("label"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"))))
    d.select(line.alias("value")).write.text(path)
    rows = L.labelled(spark, path)
    return rows.groupBy("label", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


IO23 = "SELECT CASE WHEN quality = 1 THEN 'human' ELSE 'ai' END AS label, CASE WHEN d.doc_id % 3 > 0 THEN coalesce(source, '') ELSE '' END AS source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND trim(text) != '' AND d.doc_id % 17 != 0 AND d.doc_id % 13 != 0 GROUP BY ALL"

QUERIES = {
    "io23_labelled_lines": io23, "io40_works": io40, "io07_html_text": io07, "io08_entities": io08, "io09_jats_text": io09, "io42_figures": io42, "io04_latex_text": io04, "io05_broken_lines": io05, "io01_file_kinds": io01, "io15_uploads": io15, "io16_json_bodies": io16, "io21_history": io21, "io41_inverted_index": io41, "io44_reply_json": io44, "f22_failure_reasons": f22, "f22_redacted_urls": f22_urls,
    "io30_phrase_search": io30, "io31_keyword_search": io31, "io36_all_words_search": io36,
}
ORACLES = {
    "io23_labelled_lines": IO23, "io40_works": IO40, "io07_html_text": IO07, "io08_entities": f"SELECT id, {sql_entities('s')} AS text FROM {given_sql(ENCODED, ENCODED_FROM, 'id', 's')}", "io09_jats_text": IO09, "io42_figures": IO42, "io04_latex_text": IO04, "io05_broken_lines": IO05, "io01_file_kinds": IO01, "io15_uploads": IO15, "io16_json_bodies": IO16, "io21_history": IO21, "io41_inverted_index": IO41, "io44_reply_json": IO44,
    "f22_failure_reasons": F22, "f22_redacted_urls": "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages", "io30_phrase_search": IO30,
    "io31_keyword_search": f"{KEYS} SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, source_id) <= 10",
    "io36_all_words_search": f"{KEYS} SELECT query, source_id, shared FROM s JOIN n USING (query) WHERE shared = n QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, source_id) <= 10",
}
