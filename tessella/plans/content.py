"""Texts, markup, citations, rules, layout lines and contrast, over documents, pages and derived citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as geo
from tessella.functions import labels as lab
from tessella.functions import text as tx
from tessella.functions.numbers import half_up
from tessella.operators import citations as cit
from tessella.operators import documents as doc
from tessella.plans.registry import js, query
from tessella.sources.tables import table, view

_TOKENS = "list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda t: regexp_replace(t, '[^a-zA-Z0-9_]', '', 'g')), lambda t: t <> '')"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("sf1_tokenise", f"SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS tk FROM documents)")
def _(spark, d):
    t = _docs(spark, d).select("doc_id", tx.tokenise(F.col("text")).alias("tk"))
    return t.select("doc_id", F.size("tk").alias("n_tokens"), F.md5(F.array_join("tk", " ")).alias("digest"))


_PAIRS = "p AS (SELECT a.doc_id, a.text AS x, b.text AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def _pairs(spark, d):
    a, b = _docs(spark, d).select("doc_id", F.col("text").alias("x")), _docs(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("y"))
    return a.join(b, "doc_id")


def _overlap_sql(items: str, whole: str) -> str:
    x, y = items.replace("text", "x"), items.replace("text", "y")
    return f"WITH {_PAIRS}, a AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({x}) AS t FROM p) GROUP BY 1, 2), b AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({y}) AS t FROM p) GROUP BY 1, 2), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.t = b.t), s AS (SELECT doc_id, sum(least(na, nb)) / CAST({whole} AS DOUBLE) AS similarity FROM j GROUP BY 1) SELECT doc_id, {js('coalesce(similarity, 0)', 6)} AS similarity FROM p LEFT JOIN s USING (doc_id)"


@query("sf2_word_similarity", _overlap_sql(_TOKENS, "sum(greatest(na, nb))"))
def _(spark, d):
    return doc.multiset_overlap(_pairs(spark, d), "doc_id", tx.tokenise(F.col("x")), tx.tokenise(F.col("y"))).withColumn("similarity", half_up("similarity", 6))


_BIGRAMS = "list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])"


def _bigrams_sql(side: str) -> str:
    return f"(SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({_BIGRAMS}) AS t FROM (SELECT doc_id, {_TOKENS.replace('text', side)} AS tk FROM p)) GROUP BY 1, 2)"


@query("sf3_bigram_overlap", f"WITH {_PAIRS}, a AS {_bigrams_sql('x')}, b AS {_bigrams_sql('y')}, j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.t = b.t), s AS (SELECT doc_id, sum(least(na, nb)) / CAST(greatest(sum(na), sum(nb)) AS DOUBLE) AS similarity FROM j GROUP BY 1) SELECT doc_id, {js('coalesce(similarity, 0)', 6)} AS similarity FROM p LEFT JOIN s USING (doc_id)")
def _(spark, d):
    p = _pairs(spark, d).select("doc_id", tx.tokenise(F.col("x")).alias("x"), tx.tokenise(F.col("y")).alias("y"))
    return doc.multiset_overlap(p, "doc_id", tx.bigrams(F.col("x")), tx.bigrams(F.col("y")), "max").withColumn("similarity", half_up("similarity", 6))


@query("sf4_sequence_similarity")
def _(spark, d):
    return doc.sequence_similarities(_pairs(spark, d), "doc_id", "x", "y")


@query("sf5_text_chunks")
def _(spark, d):
    return doc.chunks(_docs(spark, d), "doc_id", "text", doc.cut_text, 20_000).select("doc_id", "chunk_index", "start", F.md5("chunk").alias("digest"))


@query("sf6_word_chunks", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 500.0) AS BIGINT))) AS chunk_index FROM w) SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(array_to_string(w[chunk_index * 500 + 1 : chunk_index * 500 + 500], ' ')) AS digest FROM c")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(tx.word_chunks(F.col("text"))).alias("c")).select("doc_id", "c.chunk_index", F.md5("c.chunk_text").alias("digest"))


@query("sf7_sentence_chunks")
def _(spark, d):
    return doc.chunks(_docs(spark, d), "doc_id", "text", doc.pack_sentences, 200).select("doc_id", "chunk_index", "start", F.md5("chunk").alias("digest"))


def _entities_sql(t: str) -> str:
    for k, v in [*((k, v) for k, v in tx.NAMED.items() if k != "amp"), ("amp", "&")]:
        t = f"replace({t}, '&{k};', '{v.replace(chr(39), chr(39) * 2)}')"
    return t


def _html_sql() -> str:
    t = "html"
    for pattern, new in tx.TAG_STEPS:
        t = f"regexp_replace({t}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')" if "\n" not in new else f"regexp_replace({t}, '{pattern}', {' || '.join(['chr(10)'] * len(new))}, 'g')"
    t = _entities_sql(t)
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n\\s+', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("sf8_html_to_text", f"SELECT page_id, md5({_html_sql()}) AS digest, length({_html_sql()}) AS n FROM pages")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("digest"), F.char_length("t").alias("n"))


@query("sf9_entities", f"SELECT page_id, length(html) - length({_entities_sql('html')}) AS shorter FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", (F.char_length("html") - F.char_length(tx.decode_all_entities(F.col("html")))).alias("shorter"))


@query("sf10_superscripts", f"SELECT issue_id, translate('x' || translate(CAST(issue_id AS VARCHAR), '0123456789', '{tx.SUPERSCRIPTS}'), '{tx.SUPERSCRIPTS}', '0123456789') AS plain, true AS has FROM issues", "issues")
def _(spark, d):
    s = F.concat(F.lit("x"), tx.to_superscript(F.col("issue_id")))
    return view(spark, d, "issues").select("issue_id", tx.from_superscript(s).alias("plain"), tx.has_superscript(s).alias("has"))


@query("sf12_strip_control", "SELECT doc_id, md5(nullif(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '')) AS digest FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.strip_control(F.col("text"))).alias("digest"))


#: Citations made of event numbers: "a, b-c".
_CITED = "c AS (SELECT event_id, user_id % 20 AS book, event_id % 9 + 1 AS a, event_id % 23 + 3 AS b, event_id % 23 + 3 + event_id % 4 AS z FROM events)"
_NUMBERS = f"{_CITED}, n AS (SELECT book, event_id, a AS number FROM c UNION SELECT book, event_id, unnest(range(b, z + 1)) FROM c)"


def _citations(spark, d):
    e = F.col("event_id")
    text = F.format_string("[%d, %d-%d]", e % 9 + 1, e % 23 + 3, e % 23 + 3 + e % 4)
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("book"), text.alias("text"))


def _numbers(spark, d):
    return cit.exploded(_citations(spark, d), "book", "text", "event_id")


@query("sf13_citation_numbers", f"WITH {_NUMBERS} SELECT event_id, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers FROM n GROUP BY 1")
def _(spark, d):
    return _citations(spark, d).select("event_id", F.array_join(tx.citation_numbers(F.col("text")).cast("array<string>"), ",").alias("numbers"))


@query("sf15_same_numbers", f"WITH {_NUMBERS}, s AS (SELECT event_id, list(number ORDER BY number) AS l FROM n GROUP BY 1) SELECT x.event_id, x.l = y.l AS same FROM s x JOIN s y ON y.event_id = x.event_id + 1")
def _(spark, d):
    s = _citations(spark, d).select("event_id", tx.citation_numbers(F.col("text")).alias("l"))
    t = s.select((F.col("event_id") - 1).alias("event_id"), F.col("l").alias("m"))
    return s.join(t, "event_id").select("event_id", ((F.col("l") == F.col("m")) & (F.size("l") > 0)).alias("same"))


@query("sf16_orphans", "SELECT event_id, event_id % 3 = 0 AND event_id % 5 = 0 AS orphan FROM events")
def _(spark, d):
    e = F.col("event_id")
    numbers = tx.citation_numbers(F.when(e % 5 == 0, F.lit("[see]")).otherwise(F.lit("[3]")))
    return table(spark, d, "events").select("event_id", cit.orphaned(numbers, F.when(e % 3 == 0, "NUMERIC").otherwise("AUTHOR")).alias("orphan"))


@query("sf19_doi", "SELECT event_id, '10.1234/x' || event_id AS doi FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", tx.doi(F.concat(F.lit("see https://doi.org/10.1234/x"), F.col("event_id").cast("string"), F.lit("."))).alias("doi"))


@query("wn13_sequence_issues", f"WITH {_NUMBERS}, r AS (SELECT book, min(number) AS lo, max(number) AS hi FROM n GROUP BY 1), f AS (SELECT book, number, min((event_id, number)) AS spot FROM n GROUP BY 1, 2), o AS (SELECT book, number, max(number) OVER (PARTITION BY book ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f) SELECT book, 'missing' AS kind, number FROM (SELECT book, unnest(range(lo, hi + 1)) AS number FROM r EXCEPT SELECT book, number FROM n) UNION ALL SELECT book, 'reused', number FROM n GROUP BY book, number HAVING count(*) > 1 UNION ALL SELECT book, 'out-of-order', number FROM o WHERE number < before")
def _(spark, d):
    return cit.sequence_issues(_numbers(spark, d), "book", ["event_id", "place"])


@query("wn13b_gaps", f"WITH {_NUMBERS}, k AS (SELECT DISTINCT book, number FROM n WHERE number % 4 <> 0), g AS (SELECT book, number AS after, lead(number) OVER (PARTITION BY book ORDER BY number) AS before FROM k) SELECT * FROM g WHERE before - after > 1")
def _(spark, d):
    return cit.gaps(_numbers(spark, d).where("number % 4 <> 0"), "book")


@query("wn14_by_appearance", f"WITH {_NUMBERS}, f AS (SELECT book, number, min((event_id, number)) AS spot FROM n GROUP BY 1, 2), l AS (SELECT b AS book, i AS number FROM generate_series(0, 19) x(b), generate_series(1, 40) y(i)) SELECT l.book, l.number, row_number() OVER (PARTITION BY l.book ORDER BY spot IS NULL, spot, l.number) AS new_number FROM l LEFT JOIN f ON f.book = l.book AND f.number = l.number")
def _(spark, d):
    refs = spark.range(20).select(F.col("id").alias("book"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("number"))
    return cit.by_appearance(refs, _numbers(spark, d), "book", ["event_id", "place"])


@query("wn15_number_ranges", f"WITH {_NUMBERS}, k AS (SELECT DISTINCT book, number FROM n WHERE number % 5 <> 0), i AS (SELECT *, number - row_number() OVER (PARTITION BY book ORDER BY number) AS g FROM k), r AS (SELECT book, min(number) AS lo, max(number) AS hi FROM i GROUP BY book, g) SELECT book, string_agg(CASE WHEN lo = hi THEN '' || lo WHEN hi - lo = 1 THEN lo || ',' || hi ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM r GROUP BY 1")
def _(spark, d):
    return _numbers(spark, d).where("number % 5 <> 0").groupBy("book").agg(tx.number_ranges(F.collect_set("number")).alias("ranges"))


@query("jn13_cross_references", f"WITH {_NUMBERS}, k AS (SELECT DISTINCT book, number FROM n), l AS (SELECT b AS book, i AS number FROM generate_series(0, 19) x(b), generate_series(1, 40) y(i) WHERE i % 6 <> 0) SELECT book, 'no-reference' AS kind, number FROM (SELECT * FROM k EXCEPT SELECT * FROM l) UNION ALL SELECT book, 'not-cited', number FROM (SELECT * FROM l EXCEPT SELECT * FROM k) UNION ALL SELECT book, 'matched', number FROM (SELECT * FROM k INTERSECT SELECT * FROM l)")
def _(spark, d):
    refs = spark.range(20).select(F.col("id").alias("book"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("number")).where("number % 6 <> 0")
    return cit.cross_references(_numbers(spark, d), refs, "book")


@query("jn14_links_by_id", "SELECT n_nationkey, count(c_custkey) AS cited FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) > 0")
def _(spark, d):
    links = table(spark, d, "customer").select(F.explode(F.array("c_nationkey")).alias("n_nationkey"), "c_custkey")
    return table(spark, d, "nation").join(links, "n_nationkey").groupBy("n_nationkey").agg(F.count("c_custkey").alias("cited"))


def _references(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("ref_id"), F.col("c_nationkey").cast("long").alias("book"), F.col("c_custkey").alias("number"), F.col("c_mktsegment").alias("author"), (F.col("c_custkey") % 30 + 1990).cast("int").alias("year"), F.col("c_name").alias("title"))


@query("st7_by_author", "SELECT c_custkey AS ref_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_mktsegment), c_custkey) AS new_number FROM customer")
def _(spark, d):
    return cit.by_author(_references(spark, d), "book").select("ref_id", "new_number")


@query("st7b_by_year", "SELECT c_custkey AS ref_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 30 DESC, c_custkey) AS new_number FROM customer")
def _(spark, d):
    return cit.by_year(_references(spark, d), "book", True).select("ref_id", "new_number")


@query("st8_sort_key", "SELECT c_custkey AS ref_id, lower(c_mktsegment || '_' || (c_custkey % 30 + 1990) || '_' || left(c_name, 20)) AS sort_key FROM customer")
def _(spark, d):
    return _references(spark, d).select("ref_id", cit.sort_key(F.col("author"), F.col("year"), F.col("title")).alias("sort_key"))


@query("st9_move", "SELECT c_custkey AS ref_id, CASE WHEN n = 10 THEN 3 WHEN n >= 3 AND n < 10 THEN n + 1 ELSE n END AS new_number FROM (SELECT c_custkey, c_custkey AS n FROM customer)")
def _(spark, d):
    return cit.move(_references(spark, d), "book", 10, 3).select("ref_id", "new_number")


@query("st10_sorted_matches", "SELECT doc_id, strpos(text, 'the') AS spot FROM documents WHERE strpos(text, 'the') > 0 ORDER BY 2, 1")
def _(spark, d):
    at = F.instr("text", "the")
    return _docs(spark, d).where(at > 0).select("doc_id", at.alias("spot")).orderBy("spot", "doc_id")


@query("ag56_reference_groups", "SELECT lower(c_mktsegment || '_' || (c_custkey % 30 + 1990) || '_' || left(c_name, 20)) AS work, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1")
def _(spark, d):
    return cit.grouped(_references(spark, d))


@query("sf18_formatted_references", "SELECT c_custkey AS ref_id, c_mktsegment || ' (' || (c_custkey % 30 + 1990) || '). ' || c_name || '. Press.' AS apa FROM customer")
def _(spark, d):
    return _references(spark, d).select("ref_id", cit.formatted(F.col("author"), F.col("year"), F.col("title"), F.lit("Press")).alias("apa"))


def _signals_sql(signals) -> str:
    def hit(where: str, pattern: str) -> str:
        return f"len(regexp_extract_all(text, '{pattern}')) >= 2" if where == "twice" else f"regexp_matches({'left(text, 3000)' if where == 'early' else 'text'}, '{pattern}')"

    return " + ".join(f"CASE WHEN {hit(w, p)} THEN {n} ELSE 0 END" for _, w, p, n in signals)


@query("sf20_content_type", f"WITH s AS (SELECT doc_id, {_signals_sql(doc.JOURNAL_SIGNALS)} AS journal_score, {_signals_sql(doc.BOOK_SIGNALS)} AS book_score FROM documents) SELECT *, CASE WHEN journal_score > book_score THEN 'JOURNAL' WHEN book_score > journal_score THEN 'BOOK' ELSE 'UNKNOWN' END AS content_type FROM s")
def _(spark, d):
    c = doc.content_type(F.col("text"))
    return _docs(spark, d).select("doc_id", *[v.alias(k) for k, v in c.items()])


@query("sf21_contents_score", "SELECT o1, o2, o3, o4, CASE WHEN zone_type = 'toci' THEN 0.35 ELSE 0 END + CASE WHEN o2 = 1 THEN 0.35 ELSE 0 END + CASE WHEN o3 % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN page_number < 5 THEN 0.1 ELSE 0 END >= 0.55 AS contents FROM zones", "zones")
def _(spark, d):
    s = doc.contents_score(F.col("zone_type") == "toci", F.col("o2") == 1, F.col("o3") % 2 == 0, F.col("page_number") < 5)
    return view(spark, d, "zones").select("o1", "o2", "o3", "o4", (F.floor(s * 100 + 0.5) / 100 >= 0.55).alias("contents"))


@query("sf22_y_of_text", "SELECT issue_id, CAST(page AS DOUBLE) AS y FROM issues", "issues")
def _(spark, d):
    return view(spark, d, "issues").select("issue_id", F.regexp_extract(F.concat(F.lit("at y="), F.coalesce(F.col("page").cast("string"), F.lit(""))), r"y\s*[:=]\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double").alias("y"))


@query("sf23_canonical_labels", "SELECT o1, o2, o3, o4, zone_type AS label FROM zones", "zones")
def _(spark, d):
    return view(spark, d, "zones").select("o1", "o2", "o3", "o4", lab.canonical(F.upper(F.regexp_replace("zone_type", "-", "_"))).alias("label"))


@query("sf24_heading_level", "SELECT o1, o2, o3, o4, CASE WHEN o2 <= 6 THEN o2 END AS level FROM zones", "zones")
def _(spark, d):
    return view(spark, d, "zones").select("o1", "o2", "o3", "o4", lab.heading_level(F.concat(F.lit("H"), F.col("o2").cast("string"))).alias("level"))


@query("sf28_file_names", "SELECT p_partkey, lower(regexp_replace(p_name || ' (1).PDF', '[^a-zA-Z0-9.-]', '_', 'g')) AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.slug(F.concat("p_name", F.lit(" (1).PDF"))).alias("name"))


@query("sf30_alt_text_flags", "SELECT p_partkey, concat_ws(',', CASE WHEN length(p_name) < 9 THEN 'short' END, CASE WHEN regexp_matches(p_name, '(?i)^(image|picture|photo) of') THEN 'prefix' END, CASE WHEN contains(p_name, 'ring') THEN 'generic' END) AS flags FROM part")
def _(spark, d):
    n = F.col("p_name")
    flags = F.array(F.when(F.char_length(n) < 9, "short"), F.when(n.rlike("(?i)^(image|picture|photo) of"), "prefix"), F.when(n.contains("ring"), "generic"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags"))


@query("sf31_language_tags", "SELECT doc_id, regexp_matches(lower(lang), '^[a-z]{2,3}(-[a-z0-9]{2,8})*$') AS ok FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", tx.language_tag_ok(F.col("lang")).alias("ok"))


@query("snk7_csv_guard", "SELECT s_suppkey, CASE WHEN regexp_matches(CAST(s_acctbal AS VARCHAR), '^[=+@-]') THEN '''' || CAST(s_acctbal AS VARCHAR) ELSE CAST(s_acctbal AS VARCHAR) END AS cell FROM supplier WHERE abs(s_acctbal) >= 1")
def _(spark, d):
    return table(spark, d, "supplier").where("abs(s_acctbal) >= 1").select("s_suppkey", tx.csv_safe(F.col("s_acctbal")).alias("cell"))


@query("lx7_scripts", "SELECT doc_id, 'en' AS langs FROM documents WHERE regexp_matches(text, '[a-z]')")
def _(spark, d):
    return _docs(spark, d).where(F.col("text").rlike("[a-z]")).select("doc_id", F.array_join(tx.scripts(F.col("text")), ",").alias("langs"))


@query("lx8_word_counts", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n_chars FROM documents")
def _(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", tx.count_words(t).alias("n_words"), F.char_length(tx.collapse(t)).alias("n_chars"))


@query("lx3_heading_by_size", "SELECT o1, o2, o3, o4, CASE WHEN h / 12 >= 2.0 THEN 1 WHEN h / 12 >= 1.7 THEN 2 WHEN h / 12 >= 1.4 THEN 3 WHEN h / 12 >= 1.2 THEN 4 ELSE 5 END AS level FROM zones", "zones")
def _(spark, d):
    return view(spark, d, "zones").select("o1", "o2", "o3", "o4", doc.heading_level_by_size(F.col("h"), F.lit(12)).alias("level"))


def _lines(spark, d):
    return doc.lines_of_page(view(spark, d, "zones"), ["run_id", "page_number"], ["o1", "o2", "o3", "o4"], 3.0)


# On these pages y is a multiple of ten, so lines under a threshold of 3 are the distinct heights.
@query("lx1_lines", "SELECT run_id, page_number, o1, o2, o3, o4, x, y, w, h, dense_rank() OVER (PARTITION BY run_id, page_number ORDER BY y) AS line FROM zones", "zones")
def _(spark, d):
    return _lines(spark, d)


@query("lx2_line_boxes", "SELECT run_id, page_number, dense_rank() OVER (PARTITION BY run_id, page_number ORDER BY y) AS line, min(x) AS x, y, max(x + w) AS \"right\", max(y + h) AS bottom, floor(avg(h) * 1000000.0 + 0.5) / 1000000.0 AS mean_h, bool_or(h >= 22) AS heading, count(*) AS n FROM zones GROUP BY run_id, page_number, y", "zones")
def _(spark, d):
    return doc.line_boxes(_lines(spark, d), ["run_id", "page_number"]).withColumn("mean_h", half_up("mean_h", 6))


@query("lx4_blocks", "WITH l AS (SELECT run_id, page_number, y, max(y + h) AS bottom, bool_or(h >= 29) AS heading FROM zones WHERE zone_type = 'paragraph' GROUP BY 1, 2, 3), f AS (SELECT *, CASE WHEN lag(bottom) OVER w IS NULL OR y - lag(bottom) OVER w > 2 OR coalesce(lag(heading) OVER w, false) THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY run_id, page_number ORDER BY y)) SELECT run_id, page_number, y, sum(new) OVER (PARTITION BY run_id, page_number ORDER BY y ROWS UNBOUNDED PRECEDING) AS block FROM f", "zones")
def _(spark, d):
    keys = ["run_id", "page_number"]
    z = doc.lines_of_page(view(spark, d, "zones").where("zone_type = 'paragraph'"), keys, ["o1", "o2", "o3", "o4"])
    return doc.blocks(doc.line_boxes(z, keys, 29.0), keys, 2.0).select(*keys, "y", "block")


@query("lx5_block_kinds", "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'heading' WHEN regexp_matches('1. ' || p_name, '^\\s*([•\\-*]|\\d+[.)])\\s') AND p_partkey % 2 = 0 THEN 'list' WHEN p_size < 4 THEN 'header' ELSE 'paragraph' END AS kind FROM part")
def _(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("1. "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", doc.block_kind(text, F.col("p_size") > 45, F.col("p_size"), 50.0).alias("kind"))


@query("lx6_reading_direction", "SELECT run_id, CASE WHEN sum(o2) > 2 * count(*) THEN 'rtl' WHEN count(*) > 2 * sum(o2) THEN 'ltr' ELSE 'mixed' END AS direction FROM zones GROUP BY 1", "zones")
def _(spark, d):
    return doc.reading_direction(view(spark, d, "zones").select("run_id", F.col("o2").alias("rtl_votes"), F.lit(1).alias("ltr_votes")), ["run_id"])


@query("lx9_columns", "WITH n AS (SELECT run_id, page_number, count(DISTINCT y) AS n_lines FROM zones GROUP BY 1, 2), a AS (SELECT run_id, page_number, floor(x / 10 + 0.5) * 10 AS \"column\", count(*) AS n FROM zones GROUP BY 1, 2, 3) SELECT run_id, page_number, \"column\", n, n_lines FROM a JOIN n USING (run_id, page_number) WHERE n >= n_lines * 0.5", "zones")
def _(spark, d):
    return doc.column_positions(_lines(spark, d), ["run_id", "page_number"])


@query("lx20_contexts", "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, last_value(CASE WHEN event_type = 'signup' THEN 'signup' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest_heading FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, d):
    return doc.contexts(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "event_type").select("event_id", "before", "after", "nearest_heading")


@query("mf3_contrast", "WITH c AS (SELECT p_partkey, p_partkey % 256 AS r FROM part), l AS (SELECT p_partkey, CASE WHEN r / 255.0 <= 0.03928 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END * 0.2126 AS lum FROM c) SELECT p_partkey, floor(1.05 / (lum + 0.05) * 1000.0 + 0.5) / 1000.0 AS ratio, 1.05 / (lum + 0.05) >= 4.5 AS passes_aa FROM l")
def _(spark, d):
    fg = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), F.lit("0000"))
    r = geo.contrast_ratio(fg, F.lit("#ffffff"))
    return table(spark, d, "part").select("p_partkey", half_up(r, 3).alias("ratio"), geo.contrast_passes(r, F.lit(False))["passes_aa"].alias("passes_aa"))


@query("re1_style_rules")
def _(spark, d):
    rules = [(r[0], r[3]) for r in doc.STYLE_RULES]
    return doc.apply_rules(_docs(spark, d), "doc_id", "text", rules).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("re2_sentence_start", "SELECT doc_id, len(regexp_extract_all(text, '[.!?] [a-z]')) AS n FROM documents WHERE regexp_matches(text, '[.!?] [a-z]')")
def _(spark, d):
    return doc.apply_rules(_docs(spark, d), "doc_id", "text", [("cap", r"[.!?] [a-z]")]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("re4_house_rules", "SELECT doc_id, len(regexp_extract_all(lower(text), '\\bidiot\\b')) AS n FROM documents WHERE regexp_matches(lower(text), '\\bidiot\\b')")
def _(spark, d):
    return doc.house_rules(_docs(spark, d), "doc_id", "text", [{"id": "t", "kind": "TERMINOLOGY", "avoid": "idiot"}]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("re5_page_audit", "WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages) SELECT page_id, 'EPUB-SEM-001' AS code, 'serious' AS severity, 1 AS n FROM h WHERE NOT regexp_matches(h, '(?i)<html\\b[^>]*\\slang\\s*=') UNION ALL SELECT page_id, 'EPUB-SEM-002', 'moderate', len(regexp_extract_all(h, '(?is)<a\\b[^>]*>\\s*</a>')) FROM h WHERE regexp_matches(h, '(?is)<a\\b[^>]*>\\s*</a>') UNION ALL SELECT page_id, 'EPUB-STRUCT-004', 'minor', 1 FROM h WHERE NOT regexp_matches(h, '(?i)<main\\b')")
def _(spark, d):
    return doc.audit_pages(table(spark, d, "pages"), "page_id", "html").where("code IN ('EPUB-SEM-001', 'EPUB-SEM-002', 'EPUB-STRUCT-004')")


@query("wn10_heading_skips", "SELECT page_id, len(l) AS headings, len(list_filter(range(2, len(l) + 1), lambda i: CAST(l[i] AS INT) - CAST(l[i - 1] AS INT) > 1)) AS skipped FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?i)<h([1-6])\\b', 1) AS l FROM pages)")
def _(spark, d):
    return doc.heading_report(table(spark, d, "pages"), "page_id", "html").select("page_id", "headings", "skipped")


@query("wn11_heading_report", "WITH h AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g') AS h FROM pages), l AS (SELECT page_id, h, regexp_extract_all(h, '(?i)<h([1-6])\\b', 1) AS l FROM h) SELECT page_id, len(l) AS headings, len(list_filter(range(2, len(l) + 1), lambda i: CAST(l[i] AS INT) - CAST(l[i - 1] AS INT) > 1)) AS skipped, len(regexp_extract_all(h, '(?is)<h[1-6]\\b[^>]*>\\s*</h[1-6]>')) AS empty, len(list_filter(l, lambda x: x = '1')) AS first_level, len(list_filter(l, lambda x: x = '1')) = 0 AS missing_first FROM l")
def _(spark, d):
    return doc.heading_report(table(spark, d, "pages"), "page_id", "html")


_CLEAN = "h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages), b AS (SELECT page_id, h, regexp_replace(h, '(?is)<head\\b[^>]*>.*?</head>', '', 'g') AS body FROM h)"


@query("re6_profile_checks", f"WITH {_CLEAN}, c AS (SELECT page_id, 'MARKUP-DEPRECATED-TAG' AS code, len(regexp_extract_all(body, '(?i)<(b|i|big|small|u|strike|s|center|font)[\\s/>]')) AS n FROM b UNION ALL SELECT page_id, 'MARKUP-INLINE-STYLE', len(regexp_extract_all(h, '(?i)\\sstyle\\s*=\\s*[\"''][^\"'']*[\"'']')) FROM b UNION ALL SELECT page_id, 'XHTML-TITLE-EMPTY', CASE WHEN trim(regexp_extract(h, '(?is)<title\\b[^>]*>(.*?)</title>', 1)) = '' THEN 1 ELSE 0 END FROM b) SELECT * FROM c WHERE n > 0")
def _(spark, d):
    from tessella.operators import publication_checks as pub

    found = pub.check_documents(table(spark, d, "pages"), ["page_id"], "html").where("code IN ('MARKUP-DEPRECATED-TAG', 'MARKUP-INLINE-STYLE', 'XHTML-TITLE-EMPTY')")
    return found.select("page_id", "code", "n")


@query("re6b_all_profile_checks")
def _(spark, d):
    from tessella.operators import publication_checks as pub

    return pub.check_documents(table(spark, d, "pages"), ["page_id"], "html").groupBy("code", "severity").agg(F.count("*").alias("pages"), F.sum("n").alias("n"))


@query("re6c_dangling_notes")
def _(spark, d):
    from tessella.operators import publication_checks as pub

    return pub.dangling_notes(table(spark, d, "pages").withColumn("book", (F.col("page_id") % 10).cast("int")), "book", "page_id", "html")


#: Pieces of markup by page number: code that each should give, or none.
_MARKUP = (
    ("", '<div class="sidebar_wrapper"><p>a</p></div> <div class="maincontent_wrapper">m</div>'),
    ("MARKUP-SIDEBAR-MAINCONTENT-MISSING", '<div class="sidebar_wrapper"><p>a</p></div>text<div class="maincontent_wrapper">m</div>'),
    ("MARKUP-TEXTBOX-USES-REAL-HEADER", '<div class="txt_box1"><div><h2>b</h2></div></div>'),
    ("MARKUP-FLOATBOX-USES-REAL-HEADER", '<h1>h</h1><aside class="floatbox_left"><div><h3>b</h3></div></aside>'),
    ("MARKUP-POETRY-WRONG-STRUCTURE", '<div class="poetry_stanza"><div><p>l</p></div></div>'),
    ("MARKUP-SPEECHBUBBLE-WRONG-CLASS", '<figure class="speech-bubble"></figure>'),
    ("MARKUP-METHOD-STEPS-NOT-OL", '<ol><li class="method_steps">s</li></ol><p>1. a</p><p>2. b</p> <p>3. c</p>'),
    ("", '<h1>h</h1><div class="txt_box"><h2>b</h2></div><figure class="speechbubble_r"></figure><p>1. a</p><hr/><p>2. b</p><p>3. c</p>'),
)
_N = len(_MARKUP)


def _publications(spark, d):
    """book, part, n, c: every page, with a piece of markup by its number before its own body; ten pages by turns are a book."""
    pages = table(spark, d, "pages")
    k = F.col("page_id")
    pieces = F.array(*[F.lit(m) for _, m in _MARKUP])
    full = F.concat(F.lit("<html><head><title>t</title></head><body>"), F.get(pieces, (k % _N).cast("int")), F.regexp_extract("html", r"(?s)<body[^>]*>(.*)", 1))
    return pages.select((k % 10).alias("book"), F.format_string("text/%d.xhtml", k).alias("part"), k.alias("n"), full.alias("c"))


def _parsed(files):
    from tessella.operators import element_trees as et

    return et, et.elements(files, ["book", "part"], "c")


@query("re5b_element_places", "WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages) SELECT page_id, len(regexp_extract_all(h, '<p\\b')) AS paragraphs, len(regexp_extract_all(h, '<[a-zA-Z]')) + 2 * len(regexp_extract_all(html, '<script\\b')) + len(regexp_extract_all(html, '<style\\b')) - len(regexp_extract_all(html, '<script\\b')) AS elements, len(regexp_extract_all(regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1), '<a\\b')) AS links_in_nav FROM h JOIN pages USING (page_id)")
def _(spark, d):
    """Elements by page, and links that stand inside the navigation, by containment."""
    from tessella.operators import element_trees as et

    tree = et.elements(table(spark, d, "pages"), ["page_id"], "html")
    links = et.inside(tree, ["page_id"], F.col("tag") == "nav", F.col("tag") == "a").groupBy("page_id").agg(F.countDistinct("node").alias("links"))
    found = tree.groupBy("page_id").agg(F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("tag") != "#text").alias("elements"))
    return found.join(links, "page_id", "left").select("page_id", "paragraphs", "elements", F.coalesce("links", F.lit(0)).alias("links_in_nav"))


@query("re6d_content_markup", "WITH b AS (SELECT page_id % 10 AS book FROM pages WHERE page_id % 8 = 6 GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT page_id % 10 AS book, 'text/' || page_id || '.xhtml' AS part, CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(_MARKUP) if c) + " END AS code FROM pages) SELECT * FROM p WHERE code IS NOT NULL AND (code <> 'MARKUP-METHOD-STEPS-NOT-OL' OR book IN (SELECT book FROM b))")
def _(spark, d):
    et, tree = _parsed(_publications(spark, d))
    return et.content_markup(tree, "book", "part")


_PACKAGE = "c AS (SELECT c_custkey AS book, lower(c_mktsegment) AS logo, c_custkey % 7 AS k FROM customer)"


def _front_pages(spark, d):
    """Books of three parts from customers: a front page whose marks vary with the number, a brand page, a page of channels."""
    # Customers are a small file, read by a task or two, but their pages are much work: so they are dealt before pages are made.
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    k, seg = F.col("c_custkey") % 7, F.col("c_mktsegment")
    title = F.concat(F.when(k == 1, "<h3>").otherwise('<h3 class="booktitle">'), F.lit("T</h3>"), F.when(k == 2, "").otherwise(F.concat(F.lit('<figure class="imprint_logo"><img alt="'), F.when(k == 3, F.lit("x")).otherwise(F.lower(seg)), F.lit('"/></figure>'))))
    front = F.concat(F.lit('<body epub:type="frontmatter"><section epub:type="'), F.when(k == 4, "preface").otherwise("titlepage"), F.lit('">'), title, F.lit("</section></body>"))
    brand = F.concat(F.lit('<body id="'), F.when(k == 5, "b").otherwise("brand_page"), F.lit('"><figure class="wide '), F.when(k == 6, "image_full").otherwise("brand_logo_solo"), F.lit('"><img alt="'), F.when(k == 3, F.lit("y")).otherwise(seg), F.lit('"/></figure></body>'))
    one, two = F.lit('<a href="https://twitter.com/'), F.lit('<a href="https://facebook.com/')
    first = F.concat(one, F.when(k == 2, "others").otherwise("ink"), F.lit('">t</a>'))
    second = F.when(k == 3, "").otherwise(F.concat(two, F.lit('ink">f</a>')))
    social = F.concat(F.when(k == 4, "<body>").otherwise('<body epub:type="backmatter">'), F.when(k == 5, F.concat(second, first)).otherwise(F.concat(first, second)), F.when(k == 6, "").otherwise("<p>Read <b>on</b></p>"), F.lit("</body>"))
    parts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("part"), h.alias("c")) for n, p, h in ((1, "a.xhtml", front), (2, "b.xhtml", brand), (3, "z.xhtml", social))])
    return c.select(F.col("c_custkey").alias("book"), F.explode(parts).alias("x")).select("book", "x.*"), c


@query("re6e_title_pages", f"WITH {_PACKAGE} SELECT book, CASE k WHEN 1 THEN 'TITLE-PAGE-WRONG-STRUCTURE' WHEN 2 THEN 'TITLE-PAGE-MISSING-IMPRINT-LOGO' WHEN 3 THEN 'TITLE-PAGE-WRONG-LOGO-ALT' ELSE 'TITLE-PAGE-MISSING' END AS code FROM c WHERE k IN (1, 2, 3, 4)")
def _(spark, d):
    files, c = _front_pages(spark, d)
    et, tree = _parsed(files)
    rules = c.select(F.col("c_custkey").alias("book"), F.col("c_mktsegment").alias("logo_alt"), F.lit(False).alias("image_only"))
    return et.title_pages(tree, files.select("book", "part", "n"), rules, "book", "part", "n")


@query("re6f_brand_pages", f"WITH {_PACKAGE} SELECT book, CASE k WHEN 3 THEN 'BRAND-PAGE-WRONG-LOGO-ALT' WHEN 5 THEN 'BRAND-PAGE-MISSING' ELSE 'BRAND-PAGE-WRONG-CLASS' END AS code FROM c WHERE k IN (3, 5, 6)")
def _(spark, d):
    files, c = _front_pages(spark, d)
    et, tree = _parsed(files)
    rules = c.select(F.col("c_custkey").alias("book"), F.lit("brand_logo_solo").alias("figure_class"), F.col("c_mktsegment").alias("logo_alt"))
    return et.brand_pages(tree, files.select("book", "part", "n"), rules, "book", "part", "n")


@query("re6g_socials_pages", f"WITH {_PACKAGE} SELECT book, CASE k WHEN 2 THEN 'SOCIALS-HANDLE-WRONG' WHEN 3 THEN 'SOCIALS-PAGE-MISSING' WHEN 4 THEN 'SOCIALS-PAGE-MISSING' WHEN 5 THEN 'SOCIALS-CHANNEL-ORDER-WRONG' ELSE 'SOCIALS-STRAPLINE-MISSING' END AS code, CASE k WHEN 2 THEN 'twitter' END AS channel FROM c WHERE k IN (2, 3, 4, 5, 6)")
def _(spark, d):
    """Every book should name two channels in an order, with a line below; where only one is named nothing tells the page."""
    files, c = _front_pages(spark, d)
    et, tree = _parsed(files)
    wanted = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("channel"), F.lit(h).alias("handle")) for i, (n, h) in enumerate((("twitter", "twitter.com/ink"), ("facebook", "facebook.com/ink")))])
    channels = c.select(F.col("c_custkey").alias("book"), F.explode(wanted).alias("x")).select("book", "x.*")
    lines = c.select(F.col("c_custkey").alias("book"), F.lit("Read on").alias("strapline"))
    return et.socials_pages(tree, files.select("book", "part", "n"), channels, lines, "book", "part", "n", r"follow_ink\.xhtml$")


@query("re7_tagged_files", "WITH p AS (SELECT p_partkey, p_size % 3 <> 0 AS tagged, p_size % 4 <> 0 AS pdfua, p_size AS pages, p_partkey % 5 AS bookmarks FROM part) SELECT p_partkey, 'PDF-UNTAGGED' AS code FROM p WHERE NOT tagged UNION ALL SELECT p_partkey, 'PDFUA-IDENTIFIER-MISSING' FROM p WHERE NOT pdfua UNION ALL SELECT p_partkey, 'BOOKMARK-MISSING' FROM p WHERE pages >= 10 AND bookmarks = 0 UNION ALL SELECT p_partkey, 'BOOKMARK-INSUFFICIENT' FROM p WHERE pages >= 10 AND bookmarks > 0 AND bookmarks < pages / 10.0")
def _(spark, d):
    from tessella.operators import pdf_checks as pdf

    s, k = F.col("p_size"), F.col("p_partkey")
    files = table(spark, d, "part").select("p_partkey", (s % 3 != 0).alias("tagged"), (s % 4 != 0).alias("pdfua"), F.lit("en").alias("language"), F.col("p_name").alias("title"), s.alias("pages"), (k % 5).alias("bookmarks"))
    return pdf.check_files(files, "p_partkey")


@query("re7b_tables", "WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n, bool_or(l_returnflag = 'A') AS header FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, count(DISTINCT n) AS lengths, bool_or(header) AS header FROM c GROUP BY 1) SELECT l_orderkey, '15-003' AS code FROM t WHERE NOT header UNION ALL SELECT l_orderkey, '15-005' FROM t WHERE lengths > 1 UNION ALL SELECT l_orderkey, 'TABLE-MISSING-SUMMARY' FROM t")
def _(spark, d):
    from tessella.operators import pdf_checks as pdf

    cells = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row_no"), (F.col("l_returnflag") == "A").alias("header"), F.lit("").alias("summary"))
    return pdf.check_tables(cells, ["l_orderkey"])


_WORDS = [(w, f"{w} {x}") for w in ("the", "of", "and", "in") for x in ("the", "a", "in")]


@query("re4b_many_phrases", " UNION ALL ".join(f"SELECT doc_id, '{w}/{i}' AS rule, CAST(len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\b{p}\\b')) AS BIGINT) AS n FROM documents WHERE regexp_matches(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\b{p}\\b')" for i, (w, p) in enumerate(_WORDS)))
def _(spark, d):
    """Phrases that share words, all in one automaton."""
    rules = [{"id": f"{w}/{i}", "kind": "TERMINOLOGY", "avoid": p} for i, (w, p) in enumerate(_WORDS)]
    return doc.house_rules(_docs(spark, d), "doc_id", "text", rules).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("re3_phrase_rules", "SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(?:in|the|of) (?:the|a)\\b')) AS n FROM documents WHERE regexp_matches(lower(text), '\\b(?:in|the|of) (?:the|a)\\b')")
def _(spark, d):
    rules = [{"id": "phrase", "kind": "PATTERN", "pattern": r"(?i)\b(?:in|the|of) (?:the|a)\b"}]
    return doc.house_rules(_docs(spark, d), "doc_id", "text", rules).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("sf11_to_superscript", f"SELECT event_id, translate(CAST(event_id AS VARCHAR), '0123456789', '{tx.SUPERSCRIPTS}') AS raised FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", tx.to_superscript(F.col("event_id")).alias("raised"))


@query("sf14_strict_numbers", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN array_to_string(range(event_id % 90 + 1, event_id % 90 + 4), ',') WHEN 1 THEN (event_id % 90) || ',' || (event_id % 7) ELSE '' END AS numbers FROM events")
def _(spark, d):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.format_string("see (%d-%d)", e % 90 + 1, e % 90 + 3)).when(e % 3 == 1, F.format_string("x [%d, %d] y", e % 90, e % 7)).otherwise(F.lit("year 12345 only"))
    return table(spark, d, "events").select("event_id", F.array_join(cit.strict_numbers(text).cast("array<string>"), ",").alias("numbers"))


@query("sf17_reference_entries", "SELECT doc_id, i AS place, i + 1 AS number, 'Entry number ' || (i + 1) || ' of ' || doc_id AS entry FROM documents, (SELECT unnest([0, 1, 2]) AS i)")
def _(spark, d):
    lines = F.concat(*[F.concat(F.lit(f"{i}. Entry number {i} of "), F.col("doc_id").cast("string"), F.lit("\n")) for i in (1, 2, 3)])
    docs = _docs(spark, d).select("doc_id", F.concat("text", F.lit("\nReferences\n"), lines, F.lit("\nAppendix\nmore")).alias("text"))
    return cit.reference_entries(docs, "doc_id", "text")


@query("af1_unnest_records", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def _(spark, d):
    nested = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey")).alias("kids"))
    j = table(spark, d, "customer").join(nested, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("c_custkey", F.explode("kids").alias("k")).select("c_custkey", "k.o_orderkey")


@query("jf4_tolerant_bounds", "SELECT o1, o2, o3, o4, x, w FROM zones", "zones")
def _(spark, d):
    z = view(spark, d, "zones")
    bounds = F.when(F.col("o2") % 2 == 0, F.to_json(F.struct("x", "y", "w", "h"))).otherwise(F.to_json(F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))))
    x, y, w, h = geo.tolerant_box(bounds)
    return z.select("o1", "o2", "o3", "o4", x.alias("x"), w.alias("w"))


_ITEMS = "i AS (SELECT l_orderkey AS block, l_linenumber AS line, l_partkey % 40 AS x, l_suppkey % 3 = 0 AS bold FROM lineitem)"


@query("lx10_table_candidates", f"WITH {_ITEMS}, l AS (SELECT block, count(DISTINCT line) AS rows, min(line) AS top FROM i GROUP BY 1), c AS (SELECT block, count(*) AS columns FROM (SELECT block, floor(x / 10.0 + 0.5) AS a, count(*) AS n FROM i GROUP BY 1, 2) JOIN l USING (block) WHERE n >= rows * 0.5 GROUP BY 1), f AS (SELECT block, line, arg_min(bold, (x, bold)) AS first_bold, bool_or(bold) AS any_bold FROM i GROUP BY 1, 2), h AS (SELECT block, bool_or(line = top AND any_bold) AS header_row FROM f JOIN l USING (block) GROUP BY 1) SELECT block, rows, columns, header_row FROM l JOIN c USING (block) JOIN h USING (block) WHERE rows >= 2 AND columns >= 2")
def _(spark, d):
    from tessella.operators import layout as lay

    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 3 == 0).alias("bold"))
    return lay.table_candidates(items, ["block"]).select("block", "rows", "columns", "header_row")


@query("lx11_column_groups")
def _(spark, d):
    from tessella.operators import layout as lay

    return lay.column_groups(view(spark, d, "zones"), ["run_id", "page_number"], ["y", "o1", "o2", "o3", "o4"], 5.0)


@query("lx12_order_confidence", "WITH p AS (SELECT run_id, page_number, bool_or(run_id % 4 = 0) AS tagged, count(DISTINCT zone_type) > 10 AS many FROM zones GROUP BY 1, 2) SELECT run_id, greatest(0.0, least(1.0, CAST(CASE WHEN bool_or(tagged) THEN 0.9 ELSE 0.5 END AS DOUBLE) - sum(CASE WHEN NOT tagged AND many THEN 1 ELSE 0 END) * 0.2)) >= 0.45 AS sure FROM p GROUP BY 1", "zones")
def _(spark, d):
    from tessella.operators import layout as lay

    p = view(spark, d, "zones").groupBy("run_id", "page_number").agg(F.bool_or(F.col("run_id") % 4 == 0).alias("tagged"), F.when(F.countDistinct("zone_type") > 10, 2).otherwise(1).alias("columns"), F.lit(True).alias("ltr"))
    return lay.reading_order_confidence(p, "run_id").select("run_id", (F.col("confidence") >= 0.45).alias("sure"))


@query("lx13_document_score", "SELECT p_partkey, greatest(0, least(100, 100 - CASE WHEN p_size % 2 = 0 THEN 30 ELSE 0 END - p_size % 3 * 15 - p_size % 5 * 5 - least(p_size % 9, 5) * 2)) AS score FROM part")
def _(spark, d):
    from tessella.operators import layout as lay

    s, none, yes = F.col("p_size"), F.lit(0), F.lit(True)
    parts = {"tagged": s % 2 != 0, "language": yes, "first_heading_missing": F.lit(False), "critical": s % 3, "major": s % 5, "minor": none, "bad_tables": none, "order_issues": none, "logical": yes, "bad_links": s % 9}
    return table(spark, d, "part").select("p_partkey", lay.accessibility_score(parts).alias("score"))


@query("lx16_nearest_heading_level", "WITH s AS (SELECT DISTINCT run_id, h FROM zones WHERE h > 0), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY h DESC) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM s), b AS (SELECT run_id, h AS body FROM r WHERE r = CASE WHEN n > 2 THEN n // 2 + 1 ELSE n END), l AS (SELECT run_id, h AS size, r AS level FROM r JOIN b USING (run_id) WHERE h > body AND r <= 6) SELECT z.run_id, o1, o2, o3, o4, arg_min(level, (abs(size - h), level)) AS level FROM zones z JOIN l USING (run_id) WHERE zone_type = 'section-header' GROUP BY ALL", "zones")
def _(spark, d):
    from tessella.operators import layout as lay

    return lay.nearest_heading_levels(view(spark, d, "zones"), ["run_id"], ["o1", "o2", "o3", "o4"])


@query("lx17_absorbed_captions")
def _(spark, d):
    from tessella.operators import layout as lay

    return lay.absorb_captions(view(spark, d, "zones"), ["run_id", "page_number"], ["o1", "o2", "o3", "o4"])


@query("lx18_structure_tags", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'section-header' WHEN 1 THEN 'table' WHEN 2 THEN 'paragraph' END AS class FROM part")
def _(spark, d):
    from tessella.operators import layout as lay

    s = F.col("p_size") % 4
    tag = F.when(s == 0, "Head").when(s == 1, "Table").when(s == 2, "Odd").otherwise("Sect")
    return table(spark, d, "part").select("p_partkey", lay.tag_class(tag, {"Head": "H2", "Span2": "P", "Box": "Figure"}).alias("class"))


@query("mf12_table_kinds", "WITH r AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS hd FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, count(*) AS rows, max(n) AS cols, sum(hd) AS hd FROM r GROUP BY 1), k AS (SELECT l_orderkey, hd, CASE WHEN rows < 2 OR cols < 2 THEN 'layout' WHEN hd > 0 THEN 'data' ELSE 'unmarked' END AS kind FROM t) SELECT l_orderkey, kind, CASE kind WHEN 'unmarked' THEN 'no-headers' WHEN 'data' THEN 'no-scope,no-caption' ELSE '' END AS issues FROM k")
def _(spark, d):
    from tessella.operators import layout as lay

    cells = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row_no"), (F.col("l_returnflag") == "A").alias("header"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("caption"))
    return lay.table_kinds(cells, ["l_orderkey"])


@query("lx32_fixed_issues", "SELECT issue_id FROM issues WHERE code IN (SELECT 'R' || CAST(n_nationkey AS VARCHAR) FROM nation) OR location IN (SELECT 'loc' || CAST(r_regionkey AS VARCHAR) FROM region)", "issues")
def _(spark, d):
    i = view(spark, d, "issues")
    codes = table(spark, d, "nation").select(F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("code"))
    places = table(spark, d, "region").select(F.concat(F.lit("loc"), F.col("r_regionkey").cast("string")).alias("location"))
    # Two semi-joins on equality instead of one on OR, which would be a nested loop.
    return i.join(codes, "code", "left_semi").select("issue_id").unionByName(i.join(places, "location", "left_semi").select("issue_id")).distinct()


@query("lx38_performance_criteria", "WITH m AS (SELECT unnest(['vision', 'hearing', 'vision']) AS crit, unnest(['view', 'click', 'error']) AS event_type) SELECT crit, count(*) AS n, count(*) FILTER (page IS NOT NULL) AS placed FROM issues JOIN m USING (event_type) GROUP BY 1", "issues")
def _(spark, d):
    m = spark.createDataFrame([("vision", "view"), ("hearing", "click"), ("vision", "error")], "crit string, event_type string")
    return view(spark, d, "issues").join(F.broadcast(m), "event_type").groupBy("crit").agg(F.count("*").alias("n"), F.count("page").alias("placed"))


@query("xs3_log_lines", "SELECT event_id, epoch_us(ts) // 1000000 AS second, event_id % 2 AS state FROM events")
def _(spark, d):
    from tessella.operators.logs import parse_lines

    e = table(spark, d, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z scaler desired="), (F.col("event_id") % 2).cast("string"))
    parsed = parse_lines(e.select("event_id", line.alias("value")), "value", ("event_id",))
    return parsed.select("event_id", F.unix_seconds("ts").alias("second"), F.col("state").cast("long").alias("state"))


@query("xs4_up_intervals", "WITH n AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS start, lead(event_type) OVER w AS nxt, lead(epoch_us(ts) // 1000) OVER w AS fin FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id AS workflow_id, start, fin AS \"end\" FROM n WHERE event_type = 'signup' AND nxt = 'error'")
def _(spark, d):
    from tessella.operators.logs import intervals

    e = view(spark, d, "workflow_events").where("state IN ('signup', 'error')")
    return intervals(e, ["workflow_id"], "ts_ms", "event_id", F.col("state") == "signup", F.col("state") == "error")


@query("xs7_empty_page_summary", "WITH n AS (SELECT run_id, max(page_number) AS last, count(DISTINCT page_number) AS have FROM zones WHERE zone_type = 'figure' AND confidence > 0.5 GROUP BY 1) SELECT run_id, last, last - have AS empty_pages FROM n", "zones")
def _(spark, d):
    z = view(spark, d, "zones").where("zone_type = 'figure' AND confidence > 0.5")
    return z.groupBy("run_id").agg(F.max("page_number").alias("last"), (F.max("page_number") - F.countDistinct("page_number")).alias("empty_pages"))


@query("snk6_csv_lines", "SELECT p_partkey || ',' || p_name || ',' || p_size AS value FROM part")
def _(spark, d):
    from tessella.sinks.files import csv_lines

    return csv_lines(table(spark, d, "part").select("p_partkey", "p_name", "p_size"))


@query("snk12_snapshots", "SELECT r_regionkey, '2024-01-01' AS as_of, '{\"r_name\":\"' || r_name || '\"}' AS snapshot FROM region")
def _(spark, d):
    from tessella.sinks.files import snapshot

    return snapshot(table(spark, d, "region"), "r_regionkey", "2024-01-01")


@query("ud5_chunked_totals", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words FROM documents WHERE regexp_matches(text, '\\S')")
def _(spark, d):
    # Chunk, process, combine: words of 500-word chunks, summed.
    c = _docs(spark, d).select("doc_id", F.explode(tx.word_chunks(F.col("text"))).alias("c"))
    return c.groupBy("doc_id").agg(F.sum(tx.count_words(F.col("c.chunk_text"))).alias("n_words"))
