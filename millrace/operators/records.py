"""Source rows to documents, labelled cases, suggestions, and the upkeep of an index table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import normalize_whitespace, strip


def query_id_of(raw: Column) -> Column:
    """An id without the n that a big integer was written with."""
    return F.regexp_replace(F.coalesce(raw.cast("string"), F.lit("")), "n$", "")


def english_query_of(raw: Column) -> Column:
    return F.regexp_replace(normalize_whitespace(F.coalesce(raw, F.lit(""))), r"^[.\s]+", "")


def normalize_rows(raw: DataFrame) -> DataFrame:
    """Source rows (query_id, query_type, target_lang, query, answer, eng_query, eng_answer and passages: a struct of
    english_passages, translated_passages, is_selected) as records with passages: array of (index, english, translated, selected).

    Arrays are as long as the longer of the two texts'; missing texts are empty; passages empty in both languages and
    records without passages are left out.
    """
    text = lambda a, i: normalize_whitespace(F.coalesce(F.get(F.col(f"passages.{a}"), i), F.lit("")))
    n = F.greatest(F.coalesce(F.size("passages.english_passages"), F.lit(0)), F.coalesce(F.size("passages.translated_passages"), F.lit(0)), F.lit(0))
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    made = F.transform(
        index,
        lambda i: F.struct(i.alias("index"), text("english_passages", i).alias("english"), text("translated_passages", i).alias("translated"), (F.coalesce(F.get(F.col("passages.is_selected"), i), F.lit(0)) == 1).alias("selected")),
    )
    kept = F.filter(made, lambda p: (p["english"] != "") | (p["translated"] != ""))
    plain = lambda c: normalize_whitespace(F.coalesce(F.col(c), F.lit("")))
    return raw.select(
        query_id_of(F.col("query_id")).alias("query_id"),
        F.coalesce("query_type", F.lit("UNKNOWN")).alias("query_type"),
        F.coalesce("target_lang", F.lit("unknown")).alias("language"),
        plain("query").alias("query"),
        english_query_of(F.col("eng_query")).alias("english_query"),
        plain("answer").alias("answer"),
        plain("eng_answer").alias("english_answer"),
        kept.alias("passages"),
    ).filter(F.size("passages") > 0)


def _or(a: str, b: str) -> Column:
    return F.when(F.col(a) != "", F.col(a)).otherwise(F.col(b))


def to_documents(records: DataFrame, repository: str, split: str, english: bool = True) -> DataFrame:
    """A row a passage and language in which it has text, the English one only if ``english``."""
    rows = records.select("query_id", "language", "query", "english_query", F.explode("passages").alias("p"))
    own = F.struct(F.col("language").alias("lang"), F.col("p.translated").alias("text"), _or("query", "english_query").alias("topic"))
    twin = F.struct(F.lit("eng_Latn").alias("lang"), F.col("p.english").alias("text"), _or("english_query", "query").alias("topic"))
    both = rows.select("query_id", "p.index", "p.selected", F.explode(F.array(own, twin) if english else F.array(own)).alias("d")).filter(F.col("d.text") != "")
    return both.select(
        F.concat_ws("-", "query_id", "index", "d.lang").alias("document_id"),
        F.col("index").cast("string").alias("passage_id"),
        "d.text",
        F.col("d.lang").alias("language"),
        F.concat(F.lit(f"{repository}/{split}#"), "query_id").alias("source"),
        "d.topic",
        F.col("selected").alias("is_selected"),
        "query_id",
        F.col("d.topic").alias("query_text"),
    )


def cases_from_records(records: DataFrame, english: bool = True) -> DataFrame:
    """query_id, query, english_query, language, expected_document_ids, answer of the records with a selected passage."""
    ids = F.flatten(
        F.transform(
            F.filter("passages", lambda p: p["selected"]),
            lambda p: F.array_compact(
                F.array(
                    F.when(p["translated"] != "", F.concat_ws("-", F.col("query_id"), p["index"], F.col("language"))),
                    *([F.when(p["english"] != "", F.concat_ws("-", F.col("query_id"), p["index"], F.lit("eng_Latn")))] if english else []),
                )
            ),
        )
    )
    rows = records.withColumn("expected_document_ids", ids).filter(F.size("expected_document_ids") > 0)
    return rows.select("query_id", _or("query", "english_query").alias("query"), "english_query", "language", "expected_document_ids", _or("english_answer", "answer").alias("answer"))


def cases_from_index(chunks: DataFrame) -> DataFrame:
    """query_id, query, language, expected_document_ids (sorted, distinct): from the selected chunks of each query.

    Query and language are those of the chunk of the least id; queries of blank text are left out.
    """
    picked = chunks.filter(F.col("is_selected") & (F.coalesce("query_id", F.lit("")) != ""))
    documents = picked.select("query_id", "document_id").distinct().groupBy("query_id").agg(F.array_sort(F.collect_list("document_id")).alias("expected_document_ids"))  # a query's documents
    first = picked.groupBy("query_id").agg(F.min(F.struct("id", F.coalesce("query_text", "topic", F.lit("")).alias("query"), "language")).alias("f"))
    return documents.join(first, "query_id").select("query_id", "f.query", "f.language", "expected_document_ids").filter(strip(F.col("query")) != "")


def suggestions(chunks: DataFrame, limit: int = 140) -> DataFrame:
    """query_id, language, text: of each question and language the text of the chunk of the least id, blank and long ones left out."""
    text = strip(F.coalesce("query_text", F.lit("")))
    rows = chunks.select("query_id", "language", "id", text.alias("text")).filter((F.coalesce("query_id", F.lit("")) != "") & (F.col("text") != "") & (F.length("text") <= limit))
    return rows.groupBy("query_id", "language").agg(F.min_by("text", "id").alias("text"))


def suggestion_pairs(index: DataFrame) -> DataFrame:
    """query_id, english, language, text: the questions that are in English and in another language."""
    english = index.filter("language = 'eng_Latn'").select("query_id", F.col("text").alias("english"))
    return english.join(index.filter("language <> 'eng_Latn'"), "query_id").select("query_id", "english", "language", "text")


def sample_suggestions(index: DataFrame, count: int, seed: str) -> DataFrame:
    """``count`` questions in an order drawn by ``seed``, each in one language drawn by it, with their place."""
    drawn = index.withColumn("_draw", F.xxhash64(F.lit(seed), "query_id", "language"))
    one = drawn.groupBy("query_id").agg(F.min_by(F.struct("language", "text"), "_draw").alias("s"))
    best = one.withColumn("_order", F.xxhash64(F.lit(seed), "query_id")).orderBy("_order", "query_id").limit(count)
    return best.select("query_id", "s.language", "s.text", F.row_number().over(W.orderBy("_order", "query_id")).alias("place"))  # count rows


def language_quota(df: DataFrame, wanted: int, languages: int, language: str, order: str) -> DataFrame:
    """At most ceil(wanted / languages) rows of each language, the first by ``order``; then at most ``wanted``."""
    quota = -(-wanted // languages)
    first = df.withColumn("_nth", F.row_number().over(W.partitionBy(language).orderBy(order))).filter(F.col("_nth") <= quota)
    return first.orderBy("_nth", language).limit(wanted).drop("_nth")


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Both tables' rows, of each key the one of the greatest version (``incoming`` wins a tie)."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(rows, key, version, "_new").drop("_new")


def latest(df: DataFrame, key: str, *version: str) -> DataFrame:
    """Of each key the row of the greatest version: a partial maximum in each partition, then one of those."""
    order = W.partitionBy(key).orderBy(*(F.desc_nulls_last(v) for v in version))
    return df.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted ids, with a score of 1; ids that are not there are left out."""
    return df.join(ids.select(key).distinct(), key, "left_semi").withColumn("score", F.lit(1.0))


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: vectors, documents, chunks and parents, mean length and tokens of non-parents, the latest indexing."""
    child = F.col("strategy") != "parent"
    mean = lambda c: F.coalesce(F.floor(F.avg(F.when(child, c)) + 0.5).cast("int"), F.lit(0))
    return chunks.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.countDistinct("document_id").alias("documents"),
        F.count_if(child).alias("chunks"),
        F.count_if(~child).alias("parents"),
        mean(F.length("text")).alias("average_chars"),
        mean(F.col("token_count")).alias("average_tokens"),
        F.max("indexed_at").alias("last_indexed_at"),
    )


def index_counts(chunks: DataFrame) -> DataFrame:
    """kind (language or strategy), value, chunks, average_chars, average_tokens (parents included)."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("language", "strategy")))
    rows = chunks.select(F.length("text").alias("n"), "token_count", F.inline(kinds))
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("chunks"), F.floor(F.avg("n") + 0.5).alias("average_chars"), F.floor(F.avg("token_count") + 0.5).alias("average_tokens"))


def grouped_parents(chunks: DataFrame, least: int = 2) -> DataFrame:
    """The parents that at least so many chunks name."""
    named = chunks.filter("parent_chunk IS NOT NULL").groupBy(F.col("parent_chunk").alias("id")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return chunks.join(named.select("id"), "id", "left_semi")


def new_windows(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The windows whose text is not that of a chunk of the same passage."""
    return windows.join(chunks.select("document_id", "passage_id", "text"), ["document_id", "passage_id", "text"], "left_anti")


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """``df`` with batch, from 0: so many rows each in the order of ``order`` (unique)."""
    from millrace.operators.evaluation import numbered

    return numbered(df, order).withColumn("batch", F.floor((F.col("_place") - 1) / F.lit(size))).drop("_place")


def form_boolean(value: Column, fallback: bool) -> Column:
    """A form field as a truth value: blank or null gives the fallback; false, 0, no, off, null and undefined are false, others true."""
    text = F.lower(strip(value))
    return F.when(text.isNull() | (text == ""), F.lit(fallback)).otherwise(~text.isin("false", "0", "no", "off", "null", "undefined"))


def validate_requests(df: DataFrame) -> DataFrame:
    """``df`` (query, top_k, top_n, history) with its defaults and problems: array of the names of what is not allowed."""
    query = F.length(strip(F.coalesce("query", F.lit(""))))
    checks = {
        "query_too_short": query < 2,
        "query_too_long": query > 2000,
        "top_k": F.col("top_k").isNotNull() & ~F.col("top_k").between(1, 50),
        "top_n": F.col("top_n").isNotNull() & ~F.col("top_n").between(1, 20),
        "history": F.coalesce("history", F.lit(0)) > 20,
    }
    problems = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return df.withColumns({"problems": problems, "top_k": F.coalesce("top_k", F.lit(10)), "top_n": F.coalesce("top_n", F.lit(5)), "history": F.coalesce("history", F.lit(0))})


def merge_web_results(tiers: DataFrame, query: str = "query_id", limit: int = 5) -> DataFrame:
    """Of two tiers' results (query, tier, position, url, …) each url once, the first tier's first, at most ``limit`` a query, with place."""
    order = [F.col("tier"), F.col("position")]
    once = tiers.withColumn("_nth", F.row_number().over(W.partitionBy(query, "url").orderBy(*order))).filter("_nth = 1")
    return once.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(*order))).filter(F.col("place") <= limit).drop("_nth")


def web_context(results: DataFrame, query: str = "query_id") -> DataFrame:
    """query, context: the results of a query as one block of text."""
    line = F.concat(F.lit("[Web "), F.col("place").cast("string"), F.lit("] **"), "title", F.lit("**\n"), "snippet", F.lit("\nSource: "), "url")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])  # at most the limit
    head = F.concat(F.lit('Query: "'), F.first("query"), F.lit('"'))
    return results.groupBy(query).agg(F.array_join(F.concat(F.array(F.lit("## Web Search Results"), head, F.lit("")), lines), "\n\n").alias("context"))


def health(parts: DataFrame) -> DataFrame:
    """One row: status (down if any is, else degraded if any is, else up) and code."""
    worst = F.max(F.when(F.col("status") == "down", 2).when(F.col("status") == "degraded", 1).otherwise(0))
    return parts.agg(F.coalesce(worst, F.lit(0)).alias("w")).select(F.element_at(F.array(F.lit("up"), F.lit("degraded"), F.lit("down")), F.col("w") + 1).alias("status"), F.when(F.col("w") == 2, 503).otherwise(200).alias("code"))
