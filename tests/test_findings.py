"""Queries against their SQL on small made tables: rows that larger inputs hold and the supplied ones don't."""

import duckdb
import pyarrow as pa

import __spark_entry__ as entry
from leadweave.functions import html as H
from leadweave.operators import ranking


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as {name: (schema, rows)}."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    d = entry.queries()[name](spark, str(folder))
    cols = sorted(d.columns)
    r = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    return sorted((tuple(x[c] for c in cols) for x in d.collect()), key=repr), sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=repr)


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_lead_master_words_end_before_accents(spark, tmp_path):
    """A title's word ends at an ASCII edge, as in the SQL: "doesó" begins with "does"."""
    texts = ["Doesó de lación", "Whyé not", "Companies inñ x", "Doesn de lación", "Acme"]
    rows = [(k, t, "es", "src1") for k, t in zip((1, 2, 4, 8, 13), texts)]
    got, sql = both(spark, tmp_path, "lead_master", documents=(DOCUMENTS, rows))
    assert got == sql and [x[4] for x in got] == [2]  # merged


PAGES = "page_id long, url string, html string"


def test_html_profile_references_need_their_semicolon(spark, tmp_path):
    """A title cut off inside a reference keeps the piece, as in the SQL."""
    page = "<html><head><title>{}</title></head><body><nav></nav><p>{}</p></body></html>"
    rows = [(1, "https://a.example.com/", page.format("Tom &amp; Ann&amp;&amp", "x")), (2, "https://b.example.com/", page.format("R&D &copy", "a &copy; b &amp c"))]
    got, sql = both(spark, tmp_path, "html_profile", pages=(PAGES, rows))
    assert got == sql and {x[-1] for x in got} == {"Tom & Ann&&amp", "R&D &copy"}
    links = H.parse('<a href="/x?a=1&copy=2&amp;b=&lt;">&amp &lt;</a><script type="application/ld+json">{"name": "A & B &amp"}</script>')
    assert (links["links"][0]["href"], links["links"][0]["text"], links["ld_text"]) == ("/x?a=1&copy=2&b=<", "&amp <", "A & B &amp")


def test_pages_are_parsed_a_few_at_a_time():
    """What a task holds is bounded by the pages' size, not by the rows of a batch."""
    pages = pa.array(["<a href='/x'>y</a>" + "z" * 400_000] * 9 + [None, ""])
    sizes = [len(x) for x in H.parsed_batches(iter([(pages, pa.array([""] * 11))]), pa.struct([("text", pa.string())]))]
    assert sizes == [3, 3, 3, 2]


def test_nearest_concepts_need_no_shuffle_of_pairs(spark, tmp_path):
    """Only the first concepts of each document are shuffled; nulls, repeated ids, ties and other words as in the SQL."""
    texts = ["red green blue", "Red  red\tcyan", None, "", "nothing here", "blue green", "green red"]
    docs = [(k, t) for k, t in zip((1, 2, 3, 4, 5, 6, 6), texts)]
    items = [(10, "red green"), (20, "green  red"), (30, "blue"), (40, "cyan red"), (50, "red green"), (60, "éa b"), (71, "grey")]
    got, sql = both(spark, tmp_path, "jaccard_topk", documents=("doc_id long, text string", docs), benchmark=("item_id long, text string", items))
    assert got == sql and len(got) == 9
    plan = entry.queries()["jaccard_topk"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_provider_order_is_total(spark):
    """Providers equal in everything else stand by name, whatever order they come in."""
    rows = [(k, 1, 10, 0, 1, True, "CLOSED") for k in (9, 2, 7, 1, 8)]
    for x in (rows, rows[::-1]):
        d = spark.createDataFrame(x, "provider long, position int, queries long, failures long, cost int, healthy boolean, breaker string")
        assert [(r.provider, r.place) for r in ranking.provider_order(d).orderBy("place").collect()] == [(1, 1), (2, 2), (7, 3), (8, 4), (9, 5)]


def test_person_lines_by_cheaper_searches(spark, tmp_path):
    """Same rows by plain searches as by patterns (a change of speed: this held before as well)."""
    lines = ["Written by  Ann   Example", "by " + " " * 30 + "Ann Lee", "PUBLISHED BY Bob Q Sample", "Co-Founder, ACME Agencies Ltd", "vp of startups - how to", "x" * 80 + " founder", "--  a -- b", "", "linkedin company tips", "Ann 7  Lee"]
    got, sql = both(spark, tmp_path, "text_person_lines", documents=("doc_id long, text string", [(1, "\n".join(lines)), (2, "")]))
    assert got == sql and len(got) == 11
