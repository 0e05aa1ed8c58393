"""Queries over documents: contact fields, deduplication, dictionaries, lookups, stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadweave.functions import classify as C
from leadweave.functions import contact as E
from leadweave.functions import names as N
from leadweave.operators import dedup, lookup, ranking, stages

#: Dictionaries whose terms occur in the supplied texts: label -> terms, in order.
CLASSES = {"english": ("the", "and", "that", "with"), "french": ("que", "les", "dans", "pour"), "spanish": ("los", "del", "para", "una"), "german": ("und", "die", "der", "nicht")}


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def extract_emails(spark, sf_dir):
    d = _docs(spark, sf_dir).filter(F.col("text").contains("@")).select("doc_id", F.posexplode(E.emails_in(F.col("text"))).alias("place", "email"))
    return d.select("doc_id", "place", "email", E.email_status(F.col("email")).alias("status"))


def classify_emails(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.explode(E.emails_in(F.col("text"))).alias("email"))
    return d.groupBy(E.email_status(F.col("email")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def extract_phones(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", E.phones_in(F.col("text")).alias("p"))
    return d.filter(F.size("p") > 0).select("doc_id", F.array_join("p", "|").alias("phones"), F.size("p").cast("long").alias("n"))


def dedup_keep_first_text(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text")
    return dedup.keep_first(d, [F.sha2(F.lower(F.trim("text")), 256)], [F.col("doc_id")]).select("doc_id")


def lookup_left_default(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("ord", F.col("quality"))
    default = F.struct(F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    d = lookup.with_default(_docs(spark, sf_dir).select("doc_id"), labels, "doc_id", "ord", default, "l")
    return d.select("doc_id", "l.quality", "l.toxic")


def labelled_semi(spark, sf_dir):
    return lookup.listed(_docs(spark, sf_dir).select("doc_id", "lang"), F.col("doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", keep=True)


def labelled_anti(spark, sf_dir):
    return lookup.listed(_docs(spark, sf_dir).select("doc_id", "lang"), F.col("doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", keep=False)


def keyword_argmax(spark, sf_dir):
    """Class with the most dictionary hits in each text."""
    rows = [(t, label, i, 1.0) for i, (label, terms) in enumerate(CLASSES.items()) for t in terms]
    classes = spark.createDataFrame(rows, "term string, label string, ordinal int, weight double")
    hits = lookup.term_hits(_docs(spark, sf_dir), "doc_id", "text", classes, "term", longest=1)
    return lookup.best_class(hits, "doc_id", classes)


def quality_penalty(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.quality_penalty(F.concat_ws(" ", "text", "source")).cast("long").alias("penalty"))


def coverage_matrix(spark, sf_dir):
    return stages.coverage(_docs(spark, sf_dir).select(E.emails_in(F.col("text")).alias("emails"), E.phones_in(F.col("text")).alias("phones")))


def jaccard_topk(spark, sf_dir):
    """For each document the 3 benchmark items by word overlap (roi: the item's id modulo 10)."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_replace(F.trim("text"), r"\s+", " ").alias("term"), (F.col("item_id") % 10).cast("double").alias("roi"), "item_id")
    d = ranking.nearest_concepts(_docs(spark, sf_dir), words, items, 3, "doc_id")
    return d.join(items.groupBy("term").agg(F.min("item_id").alias("item_id")), "term").select("doc_id", "item_id", "common", F.bround("score", 9).alias("score"))


def text_person_lines(spark, sf_dir):
    """Every line of the texts, letters only, judged as a name, a title and a query."""
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    name = F.trim(F.regexp_replace(F.regexp_replace("t", "[^A-Za-z ]+", ""), " {2,}", " "))
    return d.select("doc_id", "line", name.alias("name")).select("doc_id", "line", "name", E.is_person(F.col("name")).alias("is_person"), C.query_intent(F.col("name")).alias("intent"), C.is_listing(F.col("name")).alias("listing"), N.name_key(F.col("name")).alias("name_key"))


def _leads(spark, sf_dir):
    """Documents as lead records: named by their first line."""
    t, k = F.col("text"), F.col("doc_id")
    name = F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.lit("Top 10 widget makers")).otherwise(F.trim(F.substring_index(t, "\n", 1)))
    more = F.when(k % 5 == 0, F.array(F.lit("logo@2x.png"), F.lit("info@example"))).otherwise(F.array().cast("array<string>"))
    found = _docs(spark, sf_dir).select("doc_id", "lang", "source", name.alias("company_name"), E.emails_in(t).alias("found"), E.phones_in(t).alias("phones"))
    return found.select(
        k.alias("ord"), "company_name", F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://www."), F.lower("source"), F.lit(".example.com/"))).alias("website"),
        F.concat("found", more).alias("emails"), "phones", F.col("lang").alias("industry"), F.lit(None).cast("array<struct<name:string,designation:string>>").alias("people"), F.col("source"),
    )


def clean_flags(spark, sf_dir):
    """Clean stage over documents as lead records: flags of the rejects."""
    return stages.flag_tally(stages.clean(_leads(spark, sf_dir)).rejects)


def lead_master(spark, sf_dir):
    """Clean, finalize and merge documents as lead records into the master."""
    kept = stages.finalize(stages.clean(_leads(spark, sf_dir)).kept).kept
    m = stages.to_master(kept).kept
    return m.select("domain", "company_name", "industry", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), "merged")


QUERIES = {f.__name__: f for f in (extract_emails, classify_emails, extract_phones, dedup_keep_first_text, lookup_left_default, labelled_semi, labelled_anti, keyword_argmax, quality_penalty, coverage_matrix, jaccard_topk, text_person_lines, clean_flags, lead_master)}

_EM = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_STATUS = r"CASE WHEN regexp_matches(lower(email), '\.(png|jpg|jpeg|gif|svg|webp)$|^your@email\.com$|^(test|example|sample|noreply|no-reply)@') THEN 'junk' WHEN NOT regexp_matches(email, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$') THEN 'malformed' ELSE 'ok' END"
_DIG = "length(regexp_replace(x, '[^0-9]', '', 'g'))"
_PHONE_OK = rf"NOT regexp_matches(x, '^[0-9]{{1,2}}[.\-/][0-9]{{1,2}}[.\-/][0-9]{{4}}$|^[0-9]{{4}}\s*[-–]\s*[0-9]{{4}}$|^[0-9]{{4}}\s*[-–]\s*[0-9]{{4}}\s+[0-9]{{4}}$|^[0-9]{{1,2}}\.[0-9]{{2}}\s*[-–]\s*[0-9]{{2}}\.[0-9]{{2}}$|^[0-9]{{4}}$|^[0-9]{{8}}$') AND {_DIG} BETWEEN 7 AND 15 AND regexp_matches(x, '^[+0-9(][0-9\s\-().]{{5,20}}[0-9]$')"
_PHONES = rf"list_filter(list_transform(regexp_extract_all(text, '[+]?[0-9(][0-9\s().-]{{5,20}}[0-9]'), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '[\n\r]') AND {_PHONE_OK})"
_HITS = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {i} AS ordinal, CAST(len(list_filter(w, lambda x: x IN ({', '.join(repr(t) for t in terms)}))) AS DOUBLE) AS score FROM w" for i, (label, terms) in enumerate(CLASSES.items()))
_PEN = " + ".join(f"CASE WHEN contains(t, '{k}') THEN {v} ELSE 0 END" for k, v in (("wikipedia", 40), ("college", 30), ("university", 30), ("admission", 30), ("fees", 30), ("placement", 30), ("ranking", 30), ("rankings", 30), ("blog", 25), ("tutorial", 25), ("course", 25), ("documentation", 25), ("news", 20), ("magazine", 20), ("forum", 20), ("community", 15)))
ORACLES = {
    "extract_emails": f"SELECT doc_id, CAST(i - 1 AS INT) AS place, email, {_STATUS} AS status FROM (SELECT doc_id, unnest(e) AS email, generate_subscripts(e, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_EM}') AS e FROM documents))",
    "classify_emails": f"SELECT {_STATUS} AS status, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_EM}')) AS email FROM documents) GROUP BY 1",
    "extract_phones": f"SELECT doc_id, array_to_string(list_transform(list_filter(p, lambda x, i: list_position(p, x) = i), lambda x: x), '|') AS phones, CAST(len(list_distinct(p)) AS BIGINT) AS n FROM (SELECT doc_id, {_PHONES} AS p FROM documents) WHERE len(p) > 0",
    "dedup_keep_first_text": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(text))",
    "lookup_left_default": "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "labelled_semi": "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "labelled_anti": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "keyword_argmax": f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), s AS ({_HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS rn FROM s WHERE score > 0) SELECT doc_id, label, score FROM r WHERE rn = 1",
    "quality_penalty": f"SELECT doc_id, CAST({_PEN} AS BIGINT) AS penalty FROM (SELECT doc_id, lower(text || ' ' || source) AS t FROM documents)",
    "coverage_matrix": f"SELECT count(*) AS total, round_even(CAST(100.0 * count(*) FILTER (regexp_matches(text, '{_EM}')) / count(*) AS DOUBLE), 1) AS pct_email, round_even(CAST(100.0 * count(*) FILTER (len({_PHONES}) > 0) / count(*) AS DOUBLE), 1) AS pct_phone FROM documents",
}
_FIRST_LINE = "regexp_extract(text, '^[^\\n]*')"
_PERSON = "trim(regexp_replace(trim(name), '(?i)^(written by |posted by |published by |author: |author |by )', ''))"
_NOISE = "certificate|certification|course|degree|diploma|training|workshop|program|bootcamp|module|college|university|institute|academy|school|campus|blog|article|guide|tutorial|documentation|introduction|overview|review|ranking|comparison|what is|how to|learn|admission|placement|fees|recommendation|engineering|technology|management|science|artificial intelligence|machine learning|address|registered|corporate|communications|floor|building|street|office"
_LISTED = r"^top\s+\d*|^\d+\s+(top|best)|top\s+\d+|best\s+\d+|companies\s+in\b|companies\s+to\s+know|jobs\s+in\b|^popular\b|services\s+in\b.*\(?\d{4}\)?$|in\s+\w+\s*\(?\d{4}\)?$"
_TAIL = lambda c, words: f"regexp_replace({c}, '(?i)((^|\\s+)({words})\\.?)+$', '')"
_LEGAL_SQL, _PLACE_SQL = "inc|incorporated|ltd|limited|llc|corp|corporation|co|plc|pvt|gmbh|ag|sa|bv", "india|india pvt|international|global|worldwide|americas|america|europe|european|asia|asian|apac"
_BARE = _TAIL(_TAIL(_TAIL("name", _LEGAL_SQL), _PLACE_SQL), _LEGAL_SQL)
ORACLES["text_person_lines"] = f"""SELECT doc_id, line, name, len(string_split({_PERSON}, ' ')) BETWEEN 2 AND 5 AND regexp_matches({_PERSON}, '^[A-Za-z][A-Za-z.\\-'' ]{{1,59}}$') AND NOT regexp_matches(lower({_PERSON}), '{_NOISE}') AS is_person,
    CASE WHEN s >= 4 THEN 'HIGH' WHEN s >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS intent, name = '' OR regexp_matches(lower(name), '{_LISTED}') AS listing,
    regexp_replace(lower(CASE WHEN {_BARE} = '' THEN name ELSE {_BARE} END), '[^a-z0-9]', '', 'g') AS name_key
    FROM (SELECT *, CASE WHEN regexp_matches(lower(name), 'founder|ceo|director|cto|coo|vp|vice president|head of|our team|about us|meet the team|leadership') THEN 3 ELSE 0 END + CASE WHEN contains(lower(name), 'linkedin') THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(lower(name), 'company|companies|agency|agencies|firm|startup|services|pvt|ltd|inc|llp|corporation|enterprise') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(name), 'justdial|indiamart|yellowpages|sulekha|tradeindia|exportersindia|linkedin') THEN 2 ELSE 0 END
        - CASE WHEN regexp_matches(lower(name), 'ideas|tips|how to|what is|tutorial|guide|learn|best practices|examples') THEN 3 ELSE 0 END AS s
      FROM (SELECT doc_id, CAST(i - 1 AS INT) AS line, trim(regexp_replace(regexp_replace(t, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) AS name FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"""
_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> ''))"
ORACLES["jaccard_topk"] = f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), b AS (SELECT term, min(item_id) AS item_id, max(item_id % 10) AS roi, list_distinct(string_split(lower(term), ' ')) AS v FROM (SELECT item_id, regexp_replace(trim(text), '\\s+', ' ', 'g') AS term FROM benchmark) GROUP BY term),
    x AS (SELECT doc_id, item_id, term, len(list_intersect(w, v)) AS common, 0.6 * len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))) + 0.4 * roi / 10 AS score FROM d, b),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rn FROM x WHERE common > 0)
    SELECT doc_id, item_id, CAST(common AS BIGINT) AS common, round_even(CAST(score AS DOUBLE), 9) AS score FROM r WHERE rn <= 3"""
_LISTING = f"regexp_matches(lower(name), '{_LISTED}') OR name = ''"
ORACLES["clean_flags"] = f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'Top 10 widget makers' ELSE trim({_FIRST_LINE}) END AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://www.' || lower(source) || '.example.com/' END AS site, regexp_extract_all(text, '{_EM}') || CASE WHEN doc_id % 5 = 0 THEN ['logo@2x.png', 'info@example'] ELSE [] END AS e, {_PHONES} AS p FROM documents),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(site) ORDER BY doc_id) AS rn FROM d) WHERE rn = 1),
    m AS (SELECT doc_id, email, {_STATUS} AS status FROM (SELECT doc_id, unnest(e) AS email FROM k)),
    f AS (SELECT 'directory_or_article_page' AS tag FROM k WHERE {_LISTING} UNION ALL SELECT 'email_' || status FROM m WHERE status <> 'ok'
      UNION ALL SELECT 'sparse_no_contact_channel' FROM k WHERE site = '' AND len(p) = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = k.doc_id AND status = 'ok') AND (length(name) < 2 OR {_LISTING}))
    SELECT tag, count(*) AS n FROM f GROUP BY tag"""

ORACLES["lead_master"] = f"""WITH d AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'Top 10 widget makers' ELSE trim({_FIRST_LINE}) END AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://www.' || lower(source) || '.example.com/' END AS site, regexp_extract_all(text, '{_EM}') || CASE WHEN doc_id % 5 = 0 THEN ['logo@2x.png', 'info@example'] ELSE [] END AS e, {_PHONES} AS p FROM documents),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(site) ORDER BY doc_id) AS rn FROM d) WHERE rn = 1),
    c AS (SELECT *, list_filter(e, lambda email: ({_STATUS}) = 'ok') AS ok, list_filter(p, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7) AS ph FROM k WHERE NOT ({_LISTING}) AND len(list_filter(e, lambda email: ({_STATUS}) <> 'ok')) = 0),
    f AS (SELECT * FROM c WHERE (len(ok) > 0 OR len(ph) > 0 OR site <> '') AND NOT regexp_matches(lower(trim(name)), '^list of\\b|^what is\\b|^what are\\b|^how to\\b|^why\\b|^the \\w+ of\\b|^guide to\\b|\\bguide$|^top\\s+\\d*|^\\d+\\s+(top|best|different)|companies\\s+in\\b|companies\\s+to\\s+know|jobs\\s+in\\b|^popular\\b|^best\\b.*\\(?\\d{{4}}\\)?$|largest\\s+\\w+\\s+by\\b|^does\\b|^is\\b.*\\?$|vs\\s+human|^free\\b.*writer')
      AND lower(trim(name)) NOT IN ('artificial intelligence', 'ai', 'artificial intelligence (ai)') AND name <> '' AND site <> ''),
    m AS (SELECT *, lower(source) || '.example.com' AS domain, CASE WHEN length(lang) <= 3 THEN upper(lang) ELSE lang END AS ind FROM f)
    SELECT domain, arg_min(name, doc_id) AS company_name, arg_min(ind, doc_id) FILTER (ind IS NOT NULL) AS industry,
      array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list(ok)), lambda x: lower(trim(x))), lambda x: regexp_matches(x, '^[\\w.-]+@[\\w.-]+\\.\\w+$')))), ',') AS emails,
      array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list(ph)), lambda x: regexp_replace(trim(x), '[\\s\\-()]', '', 'g')), lambda x: regexp_matches(x, '^\\+?[0-9]{{7,15}}$')))), ',') AS phones, count(*) AS merged FROM m GROUP BY domain"""
