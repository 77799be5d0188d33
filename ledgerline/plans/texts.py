"""Queries over text: pages of documents, statements printed as text, and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline import functions as L
from ledgerline.functions import text as X
from ledgerline.operators import documents as O
from ledgerline.operators import graph as G
from ledgerline.operators import relational as J
from ledgerline.operators import search as S
from ledgerline.plans import Register, Tables

query = Register()
c = F.col
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TOK = "list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains([" + _STOP + "], t))"


def named_rows(t: Tables) -> DataFrame:
    return t.customer.select(c("c_custkey").alias("matched"), X.name_tokens(F.concat(F.lit("NAME"), c("c_custkey"), F.lit(" OF "), "c_mktsegment", F.lit(" K"), c("c_custkey"))).alias("t"))


def written_names(t: Tables) -> DataFrame:
    """Names as an officer would write them, with titles: those of the query set, every hundredth customer."""
    k = c("c_custkey")
    return t.customer.where(k % 100 == 0).select(k.alias("asked"), X.name_tokens(F.concat(F.lit("Dr. Name"), k, F.lit(" of "), "c_mktsegment", F.lit(" K"), k, F.lit(", S.E., M.M."))).alias("t"))


def pages(t: Tables) -> DataFrame:
    """Turns of conversations as the pages of a document."""
    return t.conversations.select(c("conv_id").alias("doc"), c("turn").alias("page"), "text")


def printed(t: Tables) -> DataFrame:
    """A statement of each order, printed: a page of labelled lines, values in thousands, one loss in parentheses."""
    rows = t.orders
    money = lambda x: F.format_string("%,.2f", x)
    v = c("o_totalprice")
    whole = F.floor("o_totalprice").cast("double")
    text = F.concat(F.lit("CONSOLIDATED BALANCE SHEET\nIn thousands\nCurrent assets total   "), money(v), F.lit("\nLong term liabilities  "), money(whole * 2), F.lit("\nCurrent liabilities\n"), money(whole * 3), F.lit("\nNet income ("), money(whole), F.lit(")\nTax rate 22%\nPage note\n"))
    return rows.select(c("o_orderkey").alias("doc"), F.lit(1).alias("page"), text.alias("text"), v.alias("v"))


def lines(df: DataFrame) -> DataFrame:
    joined = X.join_label_value(F.split("text", "\n"))
    return df.select("doc", "page", F.posexplode(joined).alias("line", "content"))


#: item, label, priority, kind
RULES = (("current_assets", r"current\s+assets", 180, "money"), ("long_term_liabilities", r"long\s+term\s+liabilities", 180, "money"), ("current_liabilities", r"current\s+liabilities", 170, "money"), ("net_income", r"net\s+income", 175, "money"), ("assets", "assets", 100, "money"), ("tax_rate", r"tax\s+rate", 90, "percent"))


def facts(t: Tables) -> DataFrame:
    """(doc, item, value, priority, page, line): every rule on every line, money scaled by the page's unit."""
    unit = printed(t).select("doc", "page", F.when(F.lower("text").contains("in thousands"), 1000.0).when(F.lower("text").contains("in millions"), 1e6).otherwise(1.0).alias("unit"))
    found = F.array(*[F.struct(F.lit(n).alias("item"), X.value_after("content", label).alias("value"), F.lit(p).alias("priority"), F.lit(kind).alias("kind")) for n, label, p, kind in RULES])
    rows = lines(printed(t)).select("doc", "page", "line", "content", F.inline(F.filter(found, lambda x: x["value"].isNotNull())))
    return rows.join(unit, ["doc", "page"]).withColumn("value", F.when(c("kind") == "money", c("value") * c("unit")).otherwise(c("value")))


_V = "pr AS (SELECT o_orderkey AS doc, o_totalprice AS v FROM orders)"
_FACTS = f"{_V}, fa AS (SELECT doc, 'current_assets' AS item, round(v * 1000, 2) AS value FROM pr UNION ALL SELECT doc, 'assets', round(v * 1000, 2) FROM pr UNION ALL SELECT doc, 'long_term_liabilities', floor(v) * 2000 FROM pr UNION ALL SELECT doc, 'current_liabilities', floor(v) * 3000 FROM pr UNION ALL SELECT doc, 'net_income', -floor(v) * 1000 FROM pr UNION ALL SELECT doc, 'tax_rate', 0.22 FROM pr)"


def best(t: Tables) -> DataFrame:
    return J.keep_first(facts(t), ["doc", "item"], [c("priority").desc(), c("page"), c("line")])


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS tidy FROM pages")
def D01_tidy_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.tidy("html").alias("tidy"))


MARKERS = {"page": [("<html", 3), ("<nav", 2), ("<footer", 2)], "listing": [("<ul", 3), ("<li", 3)], "article": [("<p>", 3), ("<article", 3)]}


@query("WITH s AS (SELECT page_id, lower(html) AS h FROM pages), m AS (SELECT page_id, [(CASE WHEN contains(h, '<html') THEN 3 ELSE 0 END + CASE WHEN contains(h, '<nav') THEN 2 ELSE 0 END + CASE WHEN contains(h, '<footer') THEN 2 ELSE 0 END), (CASE WHEN contains(h, '<ul') THEN 3 ELSE 0 END + CASE WHEN contains(h, '<li') THEN 3 ELSE 0 END), (CASE WHEN contains(h, '<p>') THEN 3 ELSE 0 END + CASE WHEN contains(h, '<article') THEN 3 ELSE 0 END)] AS v FROM s) SELECT page_id, CASE WHEN list_max(v) < 5 THEN 'unknown' ELSE ['page', 'listing', 'article'][list_position(v, list_max(v))] END AS kind FROM m")
def D02_classify_document(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.classify("html", MARKERS).alias("kind"))


@query("""WITH RECURSIVE p AS (SELECT conv_id AS doc, turn AS page, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS r FROM conversations),
g AS (SELECT doc, page, r, n AS used, 0 AS grp FROM p WHERE r = 1 UNION ALL SELECT p.doc, p.page, p.r, CASE WHEN g.used > 0 AND g.used + p.n > 3000 THEN p.n ELSE g.used + p.n END, CASE WHEN g.used > 0 AND g.used + p.n > 3000 THEN grp + 1 ELSE grp END FROM g JOIN p ON p.doc = g.doc AND p.r = g.r + 1)
SELECT doc, page, grp::INTEGER AS "group" FROM g""")
def D03_group_pages(t: Tables) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(c("page").alias("page"), F.length("text").cast("long").alias("length"))))
    return pages(t).groupBy("doc").agg(listed.alias("p")).select("doc", F.inline(X.page_groups("p", 3000)))


@query("""WITH s AS (SELECT conv_id AS doc, turn, text, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations),
w AS (SELECT doc, section, string_agg(text, chr(10) ORDER BY turn, text) AS text, min(turn) AS first_page, max(turn) AS last_page FROM s GROUP BY 1, 2),
x AS (SELECT *, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, length(text), 1050) END) AS k FROM w), y AS (SELECT doc, section::BIGINT AS section, k::INTEGER AS "at", first_page, last_page, trim(substr(text, k + 1, 1200), ' ') AS chunk FROM x)
SELECT *, 'doc ' || doc || ' section ' || section || ' p. ' || first_page AS label FROM y WHERE length(chunk) >= 40""")
def D04_chunk_by_section(t: Tables) -> DataFrame:
    """Sections of a conversation (a user's turn opens one) in windows of 1200 characters that overlap by 150."""
    run = W.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumn("section", F.sum((c("role") == "user").cast("int")).over(run))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    whole = rows.groupBy(c("conv_id").alias("doc"), "section").agg(text.alias("text"), F.min("turn").alias("first_page"), F.max("turn").alias("last_page"))
    cut = whole.select("*", F.explode(X.window_starts(F.length("text"), 1200, 150)).alias("at")).withColumn("chunk", F.trim(F.substring(c("text"), c("at") + 1, F.lit(1200))))
    label = F.concat(F.lit("doc "), c("doc"), F.lit(" section "), c("section"), F.lit(" p. "), c("first_page"))
    return cut.where(F.length("chunk") >= 40).select("doc", "section", "at", "first_page", "last_page", "chunk", label.alias("label"))


@query(f"SELECT doc_id, array_to_string({_TOK.format(x='text')}, ' ') AS tokens FROM documents")
def D05_tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.tokens("text"), " ").alias("tokens"))


_IDF = f"tk AS (SELECT item_id, {_TOK.format(x='text')} AS t FROM benchmark), df AS (SELECT term, count(*) AS df FROM (SELECT item_id, unnest(list_distinct(t)) AS term FROM tk) GROUP BY 1), idf AS (SELECT term, ln(1 + (SELECT count(*) FROM tk) / (1.0 + df)) AS idf FROM df)"


def items(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.tokens("text").alias("t"), "text")


@query(f"WITH {_IDF} SELECT term, round(idf, 8) AS idf FROM idf")
def D06_idf(t: Tables) -> DataFrame:
    return S.idf(items(t), "item_id", "t").withColumn("idf", F.round("idf", 8))


_LEX = f"""{_IDF}, qs AS (SELECT doc_id, unnest(list_distinct({_TOK.format(x='text')})) AS term FROM documents WHERE doc_id % 100 = 0), qw AS (SELECT doc_id, term, idf FROM qs JOIN idf USING (term)), tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(t) AS term FROM tk) GROUP BY 1, 2),
lex AS (SELECT doc_id, item_id, least(1, sum(idf * tf * 2.2 / (tf + 1.2)) / any_value(w)) AS s FROM qw JOIN tf USING (term) JOIN (SELECT doc_id, sum(idf) AS w FROM qw GROUP BY 1) USING (doc_id) GROUP BY 1, 2)"""


def lexical(t: Tables) -> DataFrame:
    """Every hundredth document asks, as the query set, all benchmark items."""
    return S.lexical(t.documents.where("doc_id % 100 = 0").select("doc_id", X.tokens("text").alias("t")), items(t), "doc_id", "item_id", "t")


@query(f"WITH {_LEX} SELECT doc_id, item_id, round(s, 8) AS lexical FROM lex")
def D07_lexical_score(t: Tables) -> DataFrame:
    return lexical(t).withColumn("lexical", F.round("lexical", 8))


_COS = "nv AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), co AS (SELECT a.vec_id AS asked, b.vec_id, list_cosine_similarity(b.v, a.v) AS s FROM nv a, nv b WHERE a.vec_id % 100 = 0)"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(c("vec_id").alias("id"), S.normalised("embedding").alias("v"))


@query(f"WITH {_COS} SELECT asked, vec_id, round(s, 6) AS cosine FROM co")
def D08_cosine_score(t: Tables) -> DataFrame:
    """Every hundredth vector asks, as the query set, all vectors."""
    rows = vectors(t).withColumns({"terms": F.array().cast("array<string>"), "w": F.array().cast("array<double>")})
    return S.likeness(rows, rows.where("id % 100 = 0"), "asked", "vec_id").select("asked", "vec_id", F.round("cosine", 6).alias("cosine"))


_OWN = f"""tk AS (SELECT doc_id AS item_id, {_TOK.format(x='text')} AS t FROM documents JOIN embeddings ON vec_id = doc_id), df AS (SELECT term, count(*) AS df FROM (SELECT item_id, unnest(list_distinct(t)) AS term FROM tk) GROUP BY 1), idf AS (SELECT term, ln(1 + (SELECT count(*) FROM tk) / (1.0 + df)) AS idf FROM df),
qs AS (SELECT item_id AS asked, unnest(list_distinct(t)) AS term FROM tk WHERE item_id % 100 = 0), qw AS (SELECT asked, term, idf FROM qs JOIN idf USING (term)), tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(t) AS term FROM tk) GROUP BY 1, 2),
lex AS (SELECT asked, item_id AS vec_id, least(1, sum(idf * tf * 2.2 / (tf + 1.2)) / any_value(w)) AS l FROM qw JOIN tf USING (term) JOIN (SELECT asked, sum(idf) AS w FROM qw GROUP BY 1) USING (asked) GROUP BY 1, 2)"""


@query(f"WITH {_COS}, {_OWN}, x AS (SELECT asked, vec_id, 0.65 * s + 0.35 * coalesce(l, 0) AS s, (vec_id + asked) % 97 = 5 AS cited FROM co LEFT JOIN lex USING (asked, vec_id)), r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY cited DESC, CASE WHEN cited THEN vec_id END, round(s, 9) DESC, vec_id) AS place, count(CASE WHEN cited THEN 1 END) OVER (PARTITION BY asked) AS n FROM x) SELECT asked, vec_id, place, round(s, 6) AS score, cited FROM r WHERE place <= 8 OR place <= n")
def D09_hybrid_search(t: Tables) -> DataFrame:
    """Documents with a vector, asked by every hundredth of them: likeness of vectors and of words together."""
    own = t.documents.join(t.embeddings.select(c("vec_id").alias("doc_id")), "doc_id", "left_semi").select(c("doc_id").alias("id"), X.tokens("text").alias("t"))
    rows = G.cut(vectors(t).join(S.weighted_terms(own, "id", "t"), "id", "left"))
    asked = rows.where("id % 100 = 0").select("id", "v", "terms", c("q_w").alias("w"))
    pairs = S.likeness(rows, asked, "asked", "vec_id", (8, 0.35, lambda row, q: (row + q) % 97 == 5))
    rows = pairs.withColumn("is_cited", (c("vec_id") + c("asked")) % 97 == 5)
    return S.hybrid(rows, "asked", "vec_id", 8, 0.35, "vec_id", "is_cited").select("asked", "vec_id", "place", F.round("score", 6).alias("score"), "cited")


_ADDRESS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ADDRESS_WORDS.items()) + "}"


@query(f"SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(upper('Jalan ' || p_name || ', Nomor ' || p_size || ' (Lt. 2), Kec. ' || p_type || ' bldg ' || p_brand), '[^0-9A-Z]+', ' ', 'g')), ' '), lambda w: coalesce({_ADDRESS}[w], w)), ' ') AS key FROM part")
def D10_canonical_address(t: Tables) -> DataFrame:
    written = F.concat(F.lit("Jalan "), "p_name", F.lit(", Nomor "), c("p_size"), F.lit(" (Lt. 2), Kec. "), "p_type", F.lit(" bldg "), "p_brand")
    return t.part.select("p_partkey", X.canonical_address(written).alias("key"))


_NAMES = "list_distinct(list_filter(string_split(regexp_replace(replace(upper({x}), '.', ''), '[^0-9A-Z]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.NAME_STOPWORDS) + "], w)))"


@query("SELECT c_custkey, array_to_string(list_sort(" + _NAMES.format(x="'PT. ' || c_name || ' ' || c_mktsegment || ' A, S.E., M.B.A.'") + "), ' ') AS t FROM customer")
def D11_name_tokens(t: Tables) -> DataFrame:
    written = F.concat(F.lit("PT. "), "c_name", F.lit(" "), "c_mktsegment", F.lit(" A, S.E., M.B.A."))
    return t.customer.select("c_custkey", F.array_join(F.array_sort(X.name_tokens(written)), " ").alias("t"))


@query("SELECT doc_id, CASE WHEN length(text) > 600 THEN regexp_replace(substr(text, 1, 600), '[ \t\n\r\f\v]+[^ \t\n\r\f\v]*$', '') || '...' ELSE text END AS snippet FROM documents")
def D12_snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.snippet("text").alias("snippet"))


@query(f"WITH {_LEX}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, item_id) AS p FROM lex) SELECT item_id, round(max(s), 8) AS score, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS topics FROM r WHERE p <= 3 GROUP BY 1")
def D13_multi_topic_search(t: Tables) -> DataFrame:
    top = S.hybrid(lexical(t).withColumn("cosine", F.lit(0.0)), "doc_id", "item_id", 3, 1.0, "item_id")
    topics = F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda x: x.cast("string")), ",")
    return top.groupBy("item_id").agg(F.round(F.max("score"), 8).alias("score"), topics.alias("topics"))


@query("WITH q AS (SELECT event_id, unnest(regexp_extract_all('see section ' || (event_id % 60)::VARCHAR || ' and section ' || (event_id % 7)::VARCHAR, 'section ([0-9]+)', 1))::BIGINT AS s FROM events) SELECT DISTINCT event_id, s AS missing FROM q WHERE s NOT IN (SELECT item_id FROM benchmark)")
def D14_cited_missing(t: Tables) -> DataFrame:
    asked = F.concat(F.lit("see section "), c("event_id") % 60, F.lit(" and section "), c("event_id") % 7)
    cited = t.events.select("event_id", F.explode(F.regexp_extract_all(asked, F.lit("section ([0-9]+)"), 1)).alias("s")).select("event_id", c("s").cast("long").alias("missing")).distinct()
    return cited.join(t.benchmark, c("missing") == c("item_id"), "left_anti")


@query(f"WITH {_FACTS} SELECT doc, item, value FROM fa WHERE item <> 'tax_rate' UNION ALL SELECT doc, item, value FROM fa WHERE item = 'tax_rate'")
def D15_extract_facts(t: Tables) -> DataFrame:
    return facts(t).select("doc", "item", F.round("value", 2).alias("value"))


@query(f"WITH {_FACTS} SELECT doc, item, value, 1 AS page FROM fa")
def D16_best_fact(t: Tables) -> DataFrame:
    return best(t).select("doc", "item", F.round("value", 2).alias("value"), "page")


@query("WITH w AS (SELECT conv_id, word, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS word FROM conversations) GROUP BY 1, 2) SELECT conv_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) AS r FROM w) WHERE r = 1")
def D18_most_frequent_header(t: Tables) -> DataFrame:
    words = t.conversations.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1)).alias("word")).groupBy("conv_id", "word").agg(F.count("*").alias("n"))
    return J.keep_first(words, ["conv_id"], [c("n").desc(), c("word")])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), h AS (SELECT *, (contains(lower(line), 'license') OR contains(lower(line), 'password')) AS hit FROM l),
k AS (SELECT *, max(hit::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 OR i < 6 AS keep FROM h) SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS reduced FROM k WHERE keep GROUP BY 1""")
def D19_reduce_document(t: Tables) -> DataFrame:
    """The first six lines and those with a keyword, with one neighbour on each side."""
    hit = lambda line: F.contains(F.lower(line), F.lit("license")) | F.contains(F.lower(line), F.lit("password"))
    rows = t.documents.where("text is not null").select("doc_id", F.split("text", "\n").alias("lines")).withColumn("hits", F.transform("lines", hit))
    near = lambda i: F.coalesce(F.get("hits", i), F.lit(False))
    kept = F.filter("lines", lambda line, i: (i < 6) | near(i - 1) | near(i) | near(i + 1))
    return rows.select("doc_id", F.array_join(kept, "\n").alias("reduced"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, c_nationkey::DOUBLE) AS value, CASE WHEN c_acctbal >= 0 THEN 'primary' ELSE 'fallback' END AS source FROM customer")
def D25_merge_readings(t: Tables) -> DataFrame:
    one = t.customer.where("c_acctbal >= 0").select("c_custkey", c("c_acctbal").alias("x"))
    two = t.customer.select("c_custkey", c("c_nationkey").cast("double").alias("y"))
    return one.join(two, "c_custkey", "full").select("c_custkey", F.coalesce("x", "y").alias("value"), F.when(c("x").isNotNull(), "primary").otherwise("fallback").alias("source"))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS accounts, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS credit, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END), 2) AS debit, round(avg(l_quantity), 6) AS balance FROM lineitem GROUP BY 1")
def D26_statement_summary(t: Tables) -> DataFrame:
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity")).alias("rows"))
    x = nested.select("l_orderkey", F.inline("rows"))
    back = c("l_returnflag") == "R"
    return x.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("accounts"), F.round(F.sum(F.when(back, c("l_extendedprice")).otherwise(0)), 2).alias("credit"), F.round(F.sum(F.when(~back, c("l_extendedprice")).otherwise(0)), 2).alias("debit"), F.round(F.avg("l_quantity"), 6).alias("balance"))


@query("SELECT conv_id, concat_ws(',', CASE WHEN NOT bool_or(role = 'system') THEN 'system' END, CASE WHEN NOT bool_or(role = 'assistant') THEN 'assistant' END) AS missing FROM conversations GROUP BY 1")
def D27_document_completeness(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.concat_ws(",", *[F.when(~F.bool_or(c("role") == r), r) for r in ("system", "assistant")]).alias("missing"))


@query("SELECT min(p_partkey) AS p_partkey, lower(trim(p_name)) AS name FROM part GROUP BY 2")
def D29_dedupe_by_key(t: Tables) -> DataFrame:
    return J.keep_first(t.part.withColumn("name", F.lower(F.trim("p_name"))), ["name"], [c("p_partkey")]).select("p_partkey", "name")


@query("WITH s AS (SELECT l_orderkey AS doc, l_suppkey AS holder, sum(l_quantity) AS shares FROM lineitem GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY shares DESC, holder) AS r, sum(shares) OVER (PARTITION BY doc) AS total FROM s) SELECT doc, 'Holder ' || holder AS name, round(shares / total, 6) AS share FROM x WHERE r <= 12")
def D30_extract_shareholders(t: Tables) -> DataFrame:
    """Lists of holders, three lines each (name, shares, position); a holder's share is of the sum; the twelve largest."""
    held = t.lineitem.groupBy(c("l_orderkey").alias("doc"), c("l_suppkey").alias("holder")).agg(F.sum("l_quantity").alias("shares"))
    cells = F.concat(F.lit("Holder "), c("holder"), F.lit("\n "), F.format_string("%,.0f", c("shares") * 1000), F.lit("\nDirector"))
    listed = F.array_sort(F.collect_list(F.struct("holder", cells.alias("x"))))  # an order's holders are the lines of one page
    text = held.groupBy("doc").agg(F.concat(F.lit("HOLDERS\n"), F.array_join(F.transform(listed, lambda h: h["x"]), "\n")).alias("text"))
    return O.holders(text).select("doc", "name", F.round("share", 6).alias("share"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, o_orderkey % 2 = 0 AS flag FROM orders")
def D31_extract_form_fields(t: Tables) -> DataFrame:
    """Fields of a form: the first alias that stands there, its value on the same or the next line; A / B labels split."""
    yes = F.when(c("o_orderkey") % 2 == 0, "Yes").otherwise("No")
    text = F.concat(F.lit("Status: "), "o_orderstatus", F.lit("\nClass / Priority:\nX / "), "o_orderpriority", F.lit("\nRevolving: "), yes)
    form = t.orders.select(c("o_orderkey").alias("doc"), text.alias("text"))
    return O.fields(form, {"status": ("state", "status"), "priority": ("priority",), "flag": ("revolving",)}, ["flag"]).withColumnRenamed("doc", "o_orderkey")


#: The rules of statements: labels, kinds and priorities.
STATEMENT = (
    O.Rule("current_assets", (r"current\s+assets",), "money", 180), O.Rule("total_assets", (r"total\s+assets",), "money", 170), O.Rule("current_liabilities", (r"^current\s+liabilities$", r"total\s+current\s+liabilities"), "money", 170),
    O.Rule("revenue", (r"net\s+sales", "revenue"), "money", 160), O.Rule("net_income", (r"net\s+(?:income|loss)",), "money", 175), O.Rule("tax_rate", (r"tax\s+rate",), "percent", 90), O.Rule("tenor", (r"^tenor",), "int", 100),
)


def statements(t: Tables) -> DataFrame:
    """Two pages of a statement of each order, as a firm would print them: units by page and by line, totals, losses in parentheses."""
    k, v = c("o_orderkey"), c("o_totalprice")
    two = F.format_string("%,.2f", v)
    one = F.concat(F.lit("CONSOLIDATED BALANCE SHEET\nIn thousands of rupiah\nCurrent   assets: "), two, F.lit("\nTotal assets Rp "), two, F.lit("\n\nCurrent liabilities "), two, F.lit("\nTotal current liabilities: "), F.format_string("%,d", F.floor(v)), F.lit("\nNote to page"))
    other = F.concat(F.lit("INCOME\nNet sales "), F.format_string("%,d", k % 90 + 1000), F.lit(" million\nRevenue "), F.format_string("%,d", k), F.lit("\nNet loss ("), two, F.lit(")\nTax rate "), (k % 30).cast("string"), F.lit("%\nTenor (months) "), (k % 60).cast("string"))
    return t.orders.select(k.alias("doc"), F.lit(1).alias("page"), one.alias("text")).unionByName(t.orders.select(k.alias("doc"), F.lit(2).alias("page"), other.alias("text")))


_RULES = ", ".join(f"('{r.item}', {k}, '{label}', '{r.kind}', {r.priority})" for r in STATEMENT for k, label in enumerate(r.labels))
_PRINTED = rf"""WITH pg AS (SELECT o_orderkey AS doc, 1 AS page, concat_ws(chr(10), 'CONSOLIDATED BALANCE SHEET', 'In thousands of rupiah', 'Current   assets: ' || format('{{:,.2f}}', o_totalprice), 'Total assets Rp ' || format('{{:,.2f}}', o_totalprice), '', 'Current liabilities ' || format('{{:,.2f}}', o_totalprice), 'Total current liabilities: ' || format('{{:,}}', floor(o_totalprice)::BIGINT), 'Note to page') AS text FROM orders
UNION ALL SELECT o_orderkey, 2, concat_ws(chr(10), 'INCOME', 'Net sales ' || format('{{:,}}', o_orderkey % 90 + 1000) || ' million', 'Revenue ' || format('{{:,}}', o_orderkey), 'Net loss (' || format('{{:,.2f}}', o_totalprice) || ')', 'Tax rate ' || (o_orderkey % 30) || '%', 'Tenor (months) ' || (o_orderkey % 60)) FROM orders),
ln AS (SELECT doc, page, CASE WHEN regexp_matches(text, '(?i)in thousands') THEN 1000.0 ELSE 1.0 END AS scale, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS quote, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS line FROM pg),
pt AS (SELECT *, regexp_extract(quote, '^(.*?)[\s:.]*(\b[Rr]p\.? *)?(\(?-?\b[0-9][0-9.,]*\)?) *(%)? *(million|thousand)?$', ['label', 'money', 'num', 'pct', 'word']) AS m FROM ln),
rd AS (SELECT *, trim(m.label) AS label, (CASE WHEN m.num LIKE '(%' THEN -1 ELSE 1 END) * replace(regexp_replace(m.num, '[()]', '', 'g'), ',', '')::DOUBLE / CASE WHEN m.pct = '%' THEN 100 ELSE 1 END AS read, CASE m.word WHEN 'million' THEN 1e6 WHEN 'thousand' THEN 1e3 ELSE scale END AS unit FROM pt WHERE m.num <> ''),
hit AS (SELECT doc, item, kind, round(CASE kind WHEN 'money' THEN read * unit WHEN 'int' THEN round(read) ELSE read END, 2) AS value, CASE WHEN kind = 'money' THEN unit ELSE 1 END AS unit, priority + CASE WHEN regexp_matches(quote, '(?i)\btotal\b') THEN 15 ELSE 0 END + CASE WHEN contains(quote, ':') THEN 2 ELSE 0 END AS score, page, line::INTEGER AS line, quote
FROM rd JOIN (VALUES {_RULES}) r(item, k, pattern, kind, priority) ON regexp_matches(label, pattern, 'i') QUALIFY row_number() OVER (PARTITION BY doc, page, item, k ORDER BY line) = 1)"""


@query(f"{_PRINTED} SELECT * FROM hit")
def D15_statement_facts(t: Tables) -> DataFrame:
    """What the rules find in statements, with unit, score, page, line and quote."""
    return O.facts(statements(t), STATEMENT).withColumn("value", F.round("value", 2))


@query(f"{_PRINTED} SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc, item ORDER BY score DESC, page, line, value) = 1")
def D16_statement_best(t: Tables) -> DataFrame:
    """Of each statement's items the fact of the highest score, with its evidence."""
    return O.best_facts(O.facts(statements(t), STATEMENT).withColumn("value", F.round("value", 2)))


@query(rf"""WITH ln AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\n\r\f\x0B]+', ' ', 'g'))), lambda x: x <> '')) AS quote FROM documents), x AS (SELECT *, regexp_extract(quote, '(?i)^(.*(?:version|CC BY[A-Z-]*))[ :.]*([0-9]+(?:\.[0-9]+)?)\.?$', ['label', 'num']) AS m FROM ln) SELECT doc_id, quote, m.num::DOUBLE AS value, count(*) AS n FROM x WHERE m.num <> '' GROUP BY ALL""")
def D15_licence_versions(t: Tables) -> DataFrame:
    """Versions of licences that documents name: the rules held against real lines."""
    rules = [O.Rule("version", (r"(?:version|CC BY[A-Z-]*)$",), "number")]
    lines_ = t.documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.posexplode(O.clean_lines(c("text"))).alias("page", "text"))
    found = O.facts(lines_.select(F.struct("row", "doc_id").alias("doc"), "page", F.regexp_replace("text", r"\.$", "").alias("text")), rules)
    quotes = lines_.select(F.struct("row", "doc_id").alias("doc"), "page", c("text").alias("quote"))
    return found.drop("quote").join(quotes, ["doc", "page"]).groupBy("doc.doc_id", "quote", "value").agg(F.count("*").alias("n"))


SECTION, CHAPTER = r"^([A-Z][a-z]{0,3})\.$", r"^([A-Z][a-z]+) [a-z]+\.$"


@query(rf"""WITH RECURSIVE cv AS (SELECT conv_id AS doc, turn AS page, text FROM conversations), pt AS (SELECT doc, page, sum(length(text) + 1) OVER w - length(text) - 1 AS a, sum(length(text) + 1) OVER w AS b FROM cv WINDOW w AS (PARTITION BY doc ORDER BY page, text ROWS UNBOUNDED PRECEDING)),
wh AS (SELECT doc, string_agg(text, chr(10) ORDER BY page, text) AS text FROM cv GROUP BY 1), l0 AS (SELECT doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM wh),
l1 AS (SELECT *, sum(length(x) + 1) OVER w - length(x) - 1 AS o, nullif(regexp_extract(x, '{SECTION}', 1), '') AS sec, nullif(regexp_extract(x, '{CHAPTER}', 1), '') AS ch FROM l0 WINDOW w AS (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING)),
l2 AS (SELECT *, sum((sec IS NOT NULL OR ch IS NOT NULL OR i = 1)::INTEGER) OVER w AS run, last_value(ch IGNORE NULLS) OVER w AS cur FROM l1 WINDOW w AS (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING)),
rn AS (SELECT doc, run, min(o) AS base, string_agg(x, chr(10) ORDER BY i) AS text, arg_min(sec, i) AS section, CASE WHEN arg_min(sec, i) IS NOT NULL THEN arg_min(cur, i) END AS chapter, bool_or(ch IS NOT NULL) AS gone FROM l2 GROUP BY 1, 2),
ar AS (SELECT r.* REPLACE (CASE WHEN (SELECT any_value(sec) FROM l2 WHERE l2.doc = r.doc AND l2.run = r.run AND l2.o = r.base) IS NULL THEN NULL ELSE section END AS section) FROM rn r WHERE NOT gone),
w AS (SELECT doc, run, 0::BIGINT AS k, CASE WHEN length(text) > 1200 AND contains(substr(text, 1, 1200), chr(10)) AND 1200 - strpos(reverse(substr(text, 1, 1200)), chr(10)) > 600 THEN 1200 - strpos(reverse(substr(text, 1, 1200)), chr(10)) ELSE least(length(text), 1200) END AS cut, length(text) AS n FROM ar
UNION ALL SELECT w.doc, w.run, k + greatest(1050, cut - 150), CASE WHEN k + greatest(1050, cut - 150) + 1200 < n AND contains(substr(text, k + greatest(1050, cut - 150) + 1, 1200), chr(10)) AND 1200 - strpos(reverse(substr(text, k + greatest(1050, cut - 150) + 1, 1200)), chr(10)) > 600 THEN 1200 - strpos(reverse(substr(text, k + greatest(1050, cut - 150) + 1, 1200)), chr(10)) ELSE length(substr(text, k + greatest(1050, cut - 150) + 1, 1200)) END, n FROM w JOIN ar USING (doc, run) WHERE n > 1200 AND k + greatest(1050, cut - 150) < n),
c AS (SELECT doc, chapter, section, (base + k)::BIGINT AS "at", base + k + cut AS e, regexp_replace(substr(text, k + 1, cut), '^\s+|\s+$', '', 'g') AS chunk FROM w JOIN ar USING (doc, run))
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY "at") AS place, chapter, section, "at", (SELECT min(page) FROM pt WHERE pt.doc = c.doc AND a < e AND b > "at") AS first_page, (SELECT max(page) FROM pt WHERE pt.doc = c.doc AND a < e AND b > "at") AS last_page, chunk FROM c WHERE length(chunk) >= 40""")
def D04_chunk_by_mark(t: Tables) -> DataFrame:
    """Conversations as documents, a turn a page: sections by lines of one short word, chapters by lines of two words."""
    return O.chunks(pages(t), SECTION, CHAPTER).select("doc", "place", "chapter", "section", "at", "first_page", "last_page", "chunk")


@query(r"""WITH pg AS (SELECT conv_id AS doc, turn AS page, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, length(text) AS n FROM conversations WHERE trim(text) <> ''), l AS (SELECT doc, page, t, n, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM pg),
h AS (SELECT *, list_transform(l, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'ment')) AS h FROM l),
b AS (SELECT doc, page, n, '[page ' || page || ']' || chr(10) || CASE WHEN length(t) <= 400 THEN t ELSE array_to_string(list_filter(l, lambda x, i: i <= 6 OR list_contains(h[greatest(i - 1, 1):i + 1], true)), chr(10)) END AS block, CASE WHEN length(t) <= 400 THEN len(l) ELSE len(list_filter(l, lambda x, i: i <= 6 OR list_contains(h[greatest(i - 1, 1):i + 1], true))) END AS k FROM h),
d AS (SELECT doc, string_agg(block, chr(10) || chr(10) ORDER BY page, block) AS text, sum(n)::BIGINT AS original, sum(k)::BIGINT AS chosen FROM b GROUP BY 1)
SELECT doc, CASE WHEN length(text) > 1500 THEN regexp_replace(substr(text, 1, 1064), '\s+$', '') || chr(10) || chr(10) || '[... reduced ...]' || chr(10) || chr(10) || regexp_replace(right(text, 415), '^\s+', '') ELSE text END AS reduced, original, chosen FROM d""")
def D19_reduce_to_budget(t: Tables) -> DataFrame:
    """Conversations reduced to 1500 characters: short turns whole, of others the head and lines with a keyword."""
    return O.reduced(pages(t), ("license", "ment"), budget=1500, short=400)


_BEST = f"{_PRINTED}, bst AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc, item ORDER BY score DESC, page, line, value) = 1)"


def read_best(t: Tables) -> DataFrame:
    return O.best_facts(O.facts(statements(t), STATEMENT).withColumn("value", F.round("value", 2)))


@query(f"{_BEST} SELECT doc, round(sum(CASE item WHEN 'current_assets' THEN value WHEN 'current_liabilities' THEN -value END), 2) AS working_capital, max(CASE WHEN item = 'net_income' THEN value END) AS net_income FROM bst GROUP BY 1")
def D17_derive_facts(t: Tables) -> DataFrame:
    """Facts that follow from others, by the pivoted best ones of a document."""
    wide = read_best(t).groupBy("doc").pivot("item", ["current_assets", "current_liabilities", "net_income"]).agg(F.first("value"))
    return wide.select("doc", F.round(c("current_assets") - c("current_liabilities"), 2).alias("working_capital"), "net_income")


_NUMBER = r"^\s*\(?\s*-?\s*(?:[Rr][Pp]\.?\s*)?[0-9][0-9.,]*\s*\)?\s*$"


def cells(t: Tables) -> DataFrame:
    """Cells of a bank's summary of each order, a line each: labels, then values, a remark, and a label beside its value."""
    v = c("o_totalprice")
    text = F.concat(F.lit("Opening\nDebit\nClosing\n"), F.format_string("%.2f", v), F.lit("\nRp "), F.format_string("%.2f", v + 1), F.lit("\n"), F.format_string("%.2f", v + 2), F.lit("\nRemark "), c("o_orderpriority"), F.lit("\nOnly one\n"), (c("o_orderkey") + 10).cast("string"))
    return t.orders.select(c("o_orderkey").alias("doc"), F.lit(1).alias("page"), text.alias("text"))


_CELLS = f"""ce AS (SELECT o_orderkey AS doc, concat_ws(chr(10), 'Opening', 'Debit', 'Closing', format('{{:.2f}}', o_totalprice), 'Rp ' || format('{{:.2f}}', o_totalprice + 1), format('{{:.2f}}', o_totalprice + 2), 'Remark ' || o_orderpriority, 'Only one', (o_orderkey + 10)::VARCHAR) AS text FROM orders),
cl AS (SELECT doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ce), cn AS (SELECT *, regexp_matches(x, '{_NUMBER}') AS num FROM cl)"""


@query(f"WITH {_CELLS}, j AS (SELECT *, num AND NOT lag(num) OVER w AND NOT regexp_matches(lag(x) OVER w, '[0-9]\\s*$') AND trim(lag(x) OVER w) <> '' AS joined FROM cn WINDOW w AS (PARTITION BY doc ORDER BY i)) SELECT doc, count(*) - count(CASE WHEN joined THEN 1 END) AS n FROM j GROUP BY 1")
def D20_join_label_value_lines(t: Tables) -> DataFrame:
    """How many lines are left when those of a label and of its number have become one."""
    return cells(t).select("doc", F.size(X.join_label_value(F.split("text", "\n"))).cast("long").alias("n"))


@query(f"{_PRINTED}, k AS (SELECT doc, read, line, CASE WHEN regexp_matches(label, '(?i)total assets') THEN 0 WHEN regexp_matches(label, '(?i)current\\s+assets') THEN 1 END AS k FROM rd WHERE page = 1) SELECT doc, round(arg_min(read, (k, line)), 2) AS assets FROM k WHERE k IS NOT NULL GROUP BY 1")
def D21_first_keyword_value(t: Tables) -> DataFrame:
    """The first keyword that has a value wins over the first line."""
    hits = F.array_compact(F.array(*[F.when(X.value_after("content", k).isNotNull(), F.struct(F.lit(i).alias("k"), c("line").alias("line"), X.value_after("content", k).alias("v"))) for i, k in enumerate(("total assets", r"current\s+assets"))]))
    rows = lines(statements(t).where("page = 1")).select("doc", F.explode(hits).alias("h"))
    return rows.groupBy("doc").agg(F.round(F.min_by("h.v", F.struct("h.k", "h.line")), 2).alias("assets"))


@query(f"WITH {_CELLS}, n AS (SELECT *, CASE WHEN num IS DISTINCT FROM lag(num) OVER (PARTITION BY doc ORDER BY i) THEN 1 ELSE 0 END AS new FROM cn), g AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY i) AS island FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY doc, island ORDER BY i) AS a, row_number() OVER (PARTITION BY doc, island ORDER BY i DESC) AS z FROM g), s AS (SELECT doc, island, count(*) AS size FROM g GROUP BY 1, 2) SELECT l.doc, l.x AS label, round(replace(replace(v.x, 'Rp ', ''), ',', '')::DOUBLE, 2) AS value FROM r v JOIN s ON s.doc = v.doc AND s.island = v.island JOIN r l ON l.doc = v.doc AND l.island = v.island - 1 AND l.z = s.size - v.a + 1 WHERE v.num AND NOT l.num")
def D22_block_label_values(t: Tables) -> DataFrame:
    """A block of values belongs to as many labels right above it, matched by place."""
    run, island = W.partitionBy("doc").orderBy("i"), W.partitionBy("doc", "island")
    rows = cells(t).select("doc", F.posexplode(F.split("text", "\n")).alias("i", "x")).withColumn("num", c("x").rlike(_NUMBER))
    rows = rows.withColumn("new", F.coalesce((c("num") != F.lag("num").over(run)).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(run))
    rows = rows.withColumns({"back": F.row_number().over(island.orderBy(c("i").desc())), "size": F.count("*").over(island)})
    values = rows.where("num").select("doc", (c("island") - 1).alias("island"), "back", L.parse_local_number(F.regexp_replace("x", "^Rp ", "")).alias("value"))
    return rows.where("not num").select("doc", "island", "back", c("x").alias("label")).join(values, ["doc", "island", "back"]).select("doc", "label", F.round("value", 2).alias("value"))


@query(f"{_BEST} SELECT doc, round(sum(value), 2) AS total FROM bst WHERE item IN ('current_assets', 'revenue') GROUP BY 1")
def D23_component_sum(t: Tables) -> DataFrame:
    parts = read_best(t).where(c("item").isin("current_assets", "revenue"))
    return parts.groupBy("doc").agg(F.round(F.sum("value"), 2).alias("total"))


@query(f"{_BEST}, b AS (SELECT doc, item, value AS x, value / CASE doc % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1e6 END * CASE WHEN item = 'revenue' THEN 100 ELSE 1 END AS y FROM bst WHERE kind = 'money'), v AS (SELECT doc, round(log10(abs(x / y)))::INTEGER AS vote, count(*) AS n FROM b WHERE x <> 0 GROUP BY 1, 2), u AS (SELECT doc, arg_max(vote, (n, -vote)) AS vote FROM v GROUP BY 1) SELECT doc, pow(10.0, vote) AS unit, round(y * pow(10.0, vote), 2) AS rescaled FROM b JOIN u USING (doc) WHERE item = 'total_assets'")
def D24_unit_vote(t: Tables) -> DataFrame:
    """The unit on which most items seen in two readings agree, by the ratio's logarithm; the second has no units and one slip."""
    lost = F.when(c("doc") % 3 == 0, 1.0).when(c("doc") % 3 == 1, 1000.0).otherwise(1e6)
    both = read_best(t).where("kind = 'money'").select("doc", "item", c("value").alias("x"), (c("value") / lost * F.when(c("item") == "revenue", 100).otherwise(1)).alias("y"))
    votes = both.where("x <> 0").withColumn("vote", F.round(F.log10(F.abs(c("x") / c("y")))).cast("int")).groupBy("doc", "vote").agg(F.count("*").alias("n"))
    unit = J.keep_first(votes, ["doc"], [c("n").desc(), c("vote")]).select("doc", F.pow(F.lit(10.0), c("vote")).alias("unit"))
    return both.where("item = 'total_assets'").join(unit, "doc").select("doc", "unit", F.round(c("y") * c("unit"), 2).alias("rescaled"))


@query(f"{_BEST}, g AS (SELECT o_orderkey AS doc, 'current_assets' AS item, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 1000 ELSE 1.0 END AS want FROM orders UNION ALL SELECT o_orderkey, 'net_income', -o_totalprice FROM orders UNION ALL SELECT o_orderkey, 'equity', 1.0 FROM orders), x AS (SELECT want, value, item FROM g FULL JOIN bst USING (doc, item)) SELECT round(count(CASE WHEN abs(want - value) <= 1e-6 * abs(want) THEN 1 END) / count(want), 6) AS recall, round(count(CASE WHEN abs(want - value) <= 1e-6 * abs(want) THEN 1 END) / count(value), 6) AS precision, count(CASE WHEN item = 'tax_rate' AND value IS NOT NULL THEN 1 END) AS forbidden FROM x")
def D28_extraction_eval(t: Tables) -> DataFrame:
    """Expected facts against extracted ones with a relative tolerance; each tax rate counts as forbidden."""
    k, v = c("o_orderkey"), c("o_totalprice")
    expect = t.orders.select(k.alias("doc"), F.inline(F.array(*[F.struct(F.lit(n).alias("item"), x.cast("double").alias("want")) for n, x in (("current_assets", F.when(k % 10 == 0, v * 1000).otherwise(1.0)), ("net_income", -v), ("equity", F.lit(1.0)))])))
    both = expect.join(read_best(t).select("doc", "item", "value"), ["doc", "item"], "full")
    hit = F.abs(c("want") - c("value")) <= 1e-6 * F.abs("want")
    return both.agg(F.round(F.count_if(hit) / F.count("want"), 6).alias("recall"), F.round(F.count_if(hit) / F.count("value"), 6).alias("precision"), F.count_if((c("item") == "tax_rate") & c("value").isNotNull()).alias("forbidden"))


@query(f"{_BEST}, w AS (SELECT doc, max(CASE WHEN item = 'revenue' AND doc % 2 = 0 THEN value END) AS direct, sum(CASE WHEN item IN ('current_assets', 'current_liabilities') THEN value END) AS parts FROM bst GROUP BY 1) SELECT doc, round(coalesce(direct, parts), 2) AS total, CASE WHEN direct IS NOT NULL THEN 'direct' WHEN parts IS NOT NULL THEN 'derived' END AS source FROM w")
def D32_component_liabilities(t: Tables) -> DataFrame:
    """A total as it stands, else the sum of its parts, with which of them it is."""
    wide = read_best(t).where("item <> 'revenue' or doc % 2 = 0").groupBy("doc").pivot("item", ["revenue", "current_assets", "current_liabilities"]).agg(F.first("value"))
    total = c("current_assets") + c("current_liabilities")
    return wide.select("doc", F.round(F.coalesce("revenue", total), 2).alias("total"), F.when(c("revenue").isNotNull(), "direct").when(total.isNotNull(), "derived").alias("source"))
