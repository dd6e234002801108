"""Pages and documents to rows (inventory A3 to A9, J, O1 to O7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction as ex
from ..sources import readers
from .registry import Tables, filled, filled_sql, query


@query()
def a4_html_to_text(t: Tables) -> DataFrame:
    """Whole pages; SQL can't decode character references, so a test holds it against plain Python."""
    return t.pages.select("page_id", F.md5(ex.html_to_text(F.col("html"))).alias("text_md5"))


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS pos FROM pages),
 b AS (SELECT page_id, pos, trim(regexp_extract(a, '>([^<]*)<', 1)) AS title, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS link FROM a)
 SELECT page_id, pos::INT AS pos, title, link FROM b WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY page_id, title ORDER BY pos) = 1""")
def a3_listing_links(t: Tables) -> DataFrame:
    return ex.listing_links(t.pages)


@query("""SELECT doc_id, page_no::INT AS page_no, length(p)::INT AS size FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(12)), chr(12))) AS p, generate_subscripts(string_split(replace(text, chr(10), chr(12)), chr(12)), 1) AS page_no FROM documents)""")
def a9_text_pages(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return readers.text_pages(d).select("doc_id", "page_no", F.length("text").alias("size"))


@query("""SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1""")
def a5_first_seen_urls(t: Tables) -> DataFrame:
    return readers.first_seen_urls(t.pages.select("url", "page_id"), "url", ["page_id"])


@query("SELECT level, count(*) AS n, count(*) FILTER (ok) AS collectable FROM (VALUES " + ", ".join(f"('{s[1]}', {s[3]})" for s in readers.SOURCES) + ") v(level, ok) GROUP BY 1")
def a6_source_registry(t: Tables) -> DataFrame:
    return readers.source_registry(t.spark).groupBy("level").agg(F.count("*").alias("n"), F.count_if("collectable").alias("collectable"))


#: Field, kind, proposed quote, the page that holds it, its number, why it is refused.
QUOTES = (
    ("ceiling", "amount", "最高投标限价：{a}00万元", 1, "{a}000000", None), ("bond", "amount", "投标保证金：人民币{a}万元", 2, "{a}0000", None), ("validity", "duration", "投标有效期为{a}日历天", 2, "{a}", None),
    ("price", "amount", "报价不高于{a}万", None, None, "quote_not_found"), ("grade", "percent", "施工总承包{d}级", 1, None, "no_value"),
)


def _quote_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The proposed quotes of each supplier, and its pages, which hold those with a page."""
    on = lambda n: F.concat(F.lit("正文。"), *[F.concat(filled(q, "s_suppkey"), F.lit("。")) for _, _, q, p, _, _ in QUOTES if p == n])
    pages = t.supplier.select("s_suppkey", F.posexplode(F.array(on(1), on(2))).alias("n", "text")).select("s_suppkey", (F.col("n") + 1).alias("page_no"), "text")
    asked = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), filled(q, "s_suppkey").alias("quote")) for f, k, q, *_ in QUOTES])
    return t.supplier.select("s_suppkey", F.inline(asked)), pages


_WANTED = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in (f, p, x, r)) + ")" for f, _, _, p, x, r in QUOTES)


@query(f"SELECT s_suppkey, field, page_no::INT AS page_no, {filled_sql('number', 's_suppkey')}::DOUBLE AS number, reject_reason FROM supplier, (VALUES {_WANTED}) v(field, page_no, number, reject_reason)")
def j6_o5_verified_quotes(t: Tables) -> DataFrame:
    quotes, pages = _quote_rows(t)
    return ex.verified_quotes(quotes, pages, "s_suppkey").select("s_suppkey", "field", "page_no", F.col("value").cast("double").alias("number"), "reject_reason")


@query()
def j9_chunk_documents(t: Tables) -> DataFrame:
    return ex.chunks(t.documents).select("doc_id", "chunk_seq", F.length("chunk").alias("size"), F.md5("chunk").alias("chunk_md5"))


@query("""WITH p AS (SELECT doc_id, page_no, text, len(list_filter(['the', 'and', 'ing', 'tion'], lambda h: contains(text, h)))::INT AS score FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT AS page_no FROM documents)),
 u AS (SELECT doc_id, page_no, score, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY score DESC, page_no ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM p WHERE score > 0) SELECT * FROM u WHERE used <= 1000""")
def o7_pages_within_budget(t: Tables) -> DataFrame:
    pages = readers.text_pages(t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text")))
    return ex.pages_within_budget(pages, ["the", "and", "ing", "tion"], 1000).select("doc_id", "page_no", "score", "used")


@query("""SELECT d.doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def d12_j7_passage_links(t: Tables) -> DataFrame:
    """Documents that hold a whole benchmark passage."""
    return ex.passage_links(t.documents, t.benchmark)
