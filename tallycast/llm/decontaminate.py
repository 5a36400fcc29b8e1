"""Benchmark decontamination by a positional inverted index: exact phrase matches and proximity matches.

Everything is DataFrame functions; the corpus is tokenised once into a written table, and only postings of the terms
that a search needs are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallycast.llm.queries import query, table
from tallycast.llm.rows import row_key, small
from tallycast.session import materialise

WINDOW_WORDS = 13
RAREST = 3  # terms of a phrase whose postings are intersected before the words are compared
SHARE = 20  # contaminated: hit words times this reach the document's words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: runs of a-z, 0-9 and everything beyond ASCII; null has none."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, GAPS), "")


def token_table(docs: DataFrame) -> DataFrame:
    """``(ka, kb, doc_id, n_words, words)``, written once."""
    tokens = docs.select("doc_id", *row_key(), words_of(F.col("text")).alias("words"))
    return materialise(tokens.select("ka", "kb", "doc_id", F.size("words").cast("bigint").alias("n_words"), "words"), "tokens")


def term_counts(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n)`` of the given distinct terms over the whole corpus."""
    every = tokens.select(F.explode("words").alias("term"))
    return every.join(small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, ka, kb, pos)`` of the given distinct terms: the positional index, one row per occurrence."""
    every = tokens.select("ka", "kb", F.posexplode("words").alias("pos", "term"))
    return materialise(every.join(small(terms), "term", "left_semi").select("term", "ka", "kb", "pos"), "postings")


def phrases_of(items: DataFrame, window: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(pid, phrase)`` and their items ``(pid, item_id)``; an item of fewer words is one window.

    Items with a null id or without a word have none; repeated items and windows meet here, before any search.
    """
    words = items.filter("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    cut = words.select("item_id", "words", F.explode(starts).alias("s")).select("item_id", F.slice("words", F.col("s"), window).alias("phrase"))
    cut = cut.withColumn("pid", F.md5(F.array_join("phrase", " ").cast("binary")))
    return materialise(cut.select("pid", "phrase").distinct(), "phrases"), materialise(cut.select("pid", "item_id").distinct(), "phrase-items")


def with_rarest(phrases: DataFrame, tokens: DataFrame, rarest: int = RAREST) -> DataFrame:
    """``(pid, phrase, rare)``: ``rare`` holds (n, off, term) of the phrase's terms from the rarest on, at most ``rarest``.

    Phrases with a term that the corpus lacks are left out: they cannot occur.
    """
    terms = phrases.select("pid", F.posexplode("phrase").alias("off", "term"))
    distinct = materialise(terms.select("term").distinct(), "terms")
    counted = terms.join(term_counts(tokens, distinct), "term", "left")
    ranked = counted.groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("rare")
    )
    known = ranked.filter(F.col("rare")[0]["n"] > 0).withColumn("rare", F.slice("rare", 1, rarest))
    return materialise(phrases.join(known, "pid"), "rarest")


def phrase_matches(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(ka, kb, spans)`` of documents with an occurrence of a phrase; a span is (start, n, pid).

    Postings of the rarest term, shifted by its place in the phrase, give the candidate starts; they stay if the
    second and third rarest terms stand at their places from the same start (equi-joins on key, term and position),
    and the words there must then equal the phrase.  Lists of frequent terms are never built.
    """
    ranked = with_rarest(phrases, tokens)
    last = F.size("rare") - 1
    lists = materialise(postings(tokens, ranked.select(F.explode("rare.term").alias("term")).distinct()), "lists")
    place = [F.col("rare")[F.least(F.lit(k), last)] for k in range(RAREST)]
    searched = ranked.select("pid", *[p[f].alias(f"{f}{k}") for k, p in enumerate(place) for f in ("term", "off")])
    found = lists.withColumnRenamed("term", "term0").join(small(searched), "term0")
    found = found.select("*", (F.col("pos") - F.col("off0")).alias("start")).filter("start >= 0").drop("pos", "term0", "off0")
    for k in range(1, RAREST):
        other = lists.select("ka", "kb", F.col("term").alias(f"term{k}"), F.col("pos").alias("at"))
        found = found.withColumn("at", F.col("start") + F.col(f"off{k}")).join(other, ["ka", "kb", f"term{k}", "at"], "left_semi")
        found = found.drop("at", f"term{k}", f"off{k}")
    found = materialise(found.select("ka", "kb", "pid", "start").distinct(), "candidates")
    spans = found.join(small(phrases), "pid").groupBy("ka", "kb").agg(F.collect_list(F.struct("start", "phrase", "pid")).alias("spans"))
    keys = small(materialise(found.select("ka", "kb").distinct(), "candidate-keys"))
    texts = tokens.select("ka", "kb", "words").join(keys, ["ka", "kb"], "left_semi").dropDuplicates(["ka", "kb"])
    same = F.filter("spans", lambda s: F.slice(F.col("words"), s["start"] + 1, F.size(s["phrase"])) == s["phrase"])
    narrow = F.transform(same, lambda s: F.struct(s["start"].alias("start"), F.size(s["phrase"]).alias("n"), s["pid"].alias("pid")))
    return texts.join(spans, ["ka", "kb"]).select("ka", "kb", narrow.alias("spans")).filter(F.size("spans") > 0)


def covered(spans: Column) -> Column:
    """Number of words inside any of the spans: a fold over them in order of their start."""
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("reach"))

    def step(acc: Column, s: Column) -> Column:
        begin, end = s["start"].cast("bigint"), (s["start"] + s["n"]).cast("bigint")
        new = F.greatest(end - F.greatest(begin, acc["reach"]), F.lit(0).cast("bigint"))
        return F.struct((acc["sum"] + new).alias("sum"), F.greatest(acc["reach"], end).alias("reach"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["sum"])


def hit_counts(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, share: int = SHARE) -> DataFrame:
    """The columns of :func:`decontaminate` with the row key (ka, kb) of :func:`row_key`."""
    tokens = token_table(docs)
    phrases, names = phrases_of(items, window)
    found = materialise(phrase_matches(tokens, phrases), "matches")
    hits = found.select("ka", "kb", covered(F.col("spans")).alias("n_hit"))
    pairs = found.select("ka", "kb", F.explode(F.array_distinct("spans.pid")).alias("pid")).join(small(names), "pid")
    named = pairs.select("ka", "kb", F.col("item_id").cast("string").alias("item")).groupBy("ka", "kb").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = hits.join(named, ["ka", "kb"])
    rows = tokens.select("ka", "kb", "doc_id", "n_words").join(result, ["ka", "kb"], "left")
    n_hit, items_ = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "ka", "kb", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs`` (doc_id, text).

    A document word inside any occurrence of an item's window is hit; contaminated when hit words are more than 0
    and ``share`` times them reach the document's words.  Null and empty texts have no words and no hits; items
    with a null id or without words are ignored; repeated items and rows change nothing and rows stay repeated; an empty
    ``items`` hits nothing; other columns are not read.
    """
    return hit_counts(docs, items, window, share).drop("ka", "kb")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, share: int = SHARE) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    hit = materialise(hit_counts(docs, items, window, share).filter("contaminated").select("ka", "kb").distinct(), "contaminated")
    whole = docs.select(F.struct("*").alias("_row"), *row_key())
    return whole.join(small(hit), ["ka", "kb"], "left_anti").select("_row.*")


def proximity_matches(docs: DataFrame, items: DataFrame, terms: int = RAREST, within: int = 20) -> DataFrame:
    """``(doc_id, item_id)`` where the item's ``terms`` rarest words stand within ``within`` words, in any order.

    Postings of these words only are intersected: a frame over the positions of one document and item looks
    ``within - 1`` words ahead.  Items with fewer different words use all of them; null ids as in :func:`decontaminate`.
    """
    tokens = token_table(docs)
    words = items.filter("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item_id"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")
    ).distinct()
    counted = words.join(term_counts(tokens, words.select("term").distinct()), "term", "left")
    ranked = counted.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("rare"))
    ranked = ranked.filter(F.col("rare")[0]["n"] > 0).withColumn("rare", F.slice("rare", 1, terms))
    wanted = materialise(ranked.select("item_id", F.size("rare").alias("need"), F.explode("rare.term").alias("term")), "wanted")
    near = postings(tokens, wanted.select("term").distinct()).join(small(wanted), "term")
    ahead = Window.partitionBy("ka", "kb", "item_id").orderBy("pos").rangeBetween(0, within - 1)
    met = near.withColumn("met", F.size(F.collect_set("term").over(ahead))).filter("met = need").select("ka", "kb", "item_id").distinct()
    return tokens.select("ka", "kb", "doc_id").join(met, ["ka", "kb"]).select("doc_id", "item_id")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(u=UPPER, l=LOWER)
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW_WORDS}) AS n, list_slice(w, s, s + {WINDOW_WORDS - 1}) AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW_WORDS - 1}, 1))) AS s FROM b WHERE len(w) > 0)),
grams AS (SELECT k, n, s, list_slice(w, s, s + n - 1) AS phrase FROM (
  SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT g.k, g.s, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.phrase = x.phrase),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(s, s + n - 1)) AS p FROM found) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (
  SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN named USING (k)
"""


@query("op3_decontaminate", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
