"""Benchmark decontamination by a prefix-filtered set join (operator 10, DataFrame functions only).

Benchmark texts are cut into windows of ``window`` words. Each window is a set of positioned word
shingles; as containment has to be exact, one shingle is a necessary prefix. The shingles are ordered by
how often they occur in all the documents, and each window is joined on its rarest. A match gives the
window's start; starts that don't leave room for it before the document's first or behind its last word
are dropped (positional and length bounds), and the others are compared word by word.

One pass over the documents finds where any benchmark shingle stands; that serves both the counts and the
candidates. A second pass compares words. Both tables of shingles and windows are broadcast only while
they have at most ``broadcast_rows`` rows; beyond that Spark's shuffled joins do the same.

Defined results: a null or wordless text has no words, and no hits; a wordless or null item has no window;
repeated items and windows count once per ``item_id``; rows with the same id are judged each by its own
text; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import materialize

DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else unchanged."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_words(df: DataFrame, text_col: str, to: str = "words") -> DataFrame:
    """``df`` with the array of the text's words; empty for null."""
    parts = df.withColumn("_parts", F.split(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), DELIMITERS))
    first = F.when(F.col("_parts")[0] == "", 2).otherwise(1)
    last = F.size("_parts") - F.when(F.element_at("_parts", -1) == "", 1).otherwise(0)
    return parts.withColumn(to, F.slice("_parts", first, F.greatest(last - first + 1, F.lit(0)))).drop("_parts")


def _shingles(df: DataFrame, words: str, q: int, *keep: str) -> DataFrame:
    """A row for each run of ``q`` words: its position ``pos`` and hash ``h``."""
    n = F.greatest(F.size(words) - (q - 1), F.lit(0))
    runs = F.arrays_zip(*(F.slice(words, i + 1, n).alias(f"w{i}") for i in range(q)))
    rows = df.where(F.size(words) >= q).select(*keep, F.posexplode(runs).alias("pos", "run"))
    return rows.select(*keep, "pos", F.xxhash64(F.lit(q), *(F.col("run")[f"w{i}"] for i in range(q))).alias("h"))


def windows(items: DataFrame, id_col: str, text_col: str, window: int = 10) -> DataFrame:
    """The distinct windows of all items: ``wid``, ``win`` (words) and ``items`` (the ids as strings)."""
    w = with_words(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), "text")
    w = w.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window)))
    starts = w.select("item", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("s"))
    return (
        starts.select("item", F.expr("slice(words, s, len)").alias("win"))
        .groupBy("win")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.xxhash64("win").alias("wid"), "win", "items")
    )


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, shingle: int = 3, broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``items`` (sorted strings) and ``spans`` (hit windows' start and end)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    win = materialize(windows(items, item_id, item_text, window))
    q = F.least(F.size("win"), F.lit(shingle))
    sizes = [r[0] for r in win.select(q.alias("q")).distinct().collect()]  # at most `shingle` values
    hint = F.broadcast if win.count() * window <= broadcast_rows else lambda df: df
    of_win = None
    for k in sizes:
        part = _shingles(win.where(q == k), "win", k, "wid", "win", "items")
        of_win = part if of_win is None else of_win.union(part)
    if of_win is None:
        found, hits = None, docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, c array<struct<s:int,win:array<string>,items:array<string>>>")
    else:
        of_win = materialize(of_win)
        words = with_words(docs, "text").select("doc_id", F.size("words").alias("n"), "words")
        found = None
        for k in sizes:
            known = of_win.where(q == k).select("h").distinct()
            part = _shingles(words, "words", k, "doc_id", "n").join(hint(known), "h")
            found = part if found is None else found.union(part)
        found = materialize(found.select("doc_id", "n", "pos", "h"))
        often = found.groupBy("h").agg(F.count("*").alias("often"))
        rare = Window.partitionBy("wid", "win").orderBy("often", "h", "pos")
        prefix = of_win.join(often, "h").withColumn("k", F.row_number().over(rare)).where("k = 1")
        prefix = prefix.select("h", F.col("pos").alias("off"), "win", "items")
        hits = (
            found.join(hint(prefix), "h")
            .withColumn("s", F.col("pos") - F.col("off"))
            .where((F.col("s") >= 0) & (F.col("s") + F.size("win") <= F.col("n")))
            .groupBy("doc_id")
            .agg(F.collect_set(F.struct("s", "win", "items")).alias("c"))
        )
    joined = docs.join(hits.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    judged = with_words(joined, "text").select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.expr("filter(coalesce(c, array()), x -> slice(words, x.s + 1, size(x.win)) = x.win)").alias("c"),
    )
    spans = judged.select("doc_id", "n_words", F.expr("array_sort(transform(c, x -> struct(x.s as s, x.s + size(x.win) as e)))").alias("spans"), F.expr("array_sort(array_distinct(flatten(transform(c, x -> x.items))))").alias("items"))
    covered = "aggregate(spans, struct(0L as n, 0 as e), (a, x) -> struct(a.n + greatest(0, x.e - greatest(a.e, x.s)) as n, greatest(a.e, x.e) as e), a -> a.n)"
    return spans.select("doc_id", "n_words", F.expr(covered).alias("n_hit"), "items", "spans")


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for ``documents`` against ``benchmark``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bs as (
  select item_id, w, least(10, len(w)) as l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0
), win as (
  select distinct item_id, l, array_to_string(w[i : i + l - 1], ' ') as g from bs
), ds as (
  select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from d, (select distinct l from win) where len(w) >= l
), occ as (
  select doc_id, i, ds.l as l, item_id from ds join win on win.l = ds.l and array_to_string(w[i : i + ds.l - 1], ' ') = win.g
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from (select distinct doc_id, i, l from occ)) group by doc_id
), it as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids
  from (select distinct doc_id, cast(item_id as varchar) as s from occ) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on hit.doc_id = d.doc_id left join it on it.doc_id = d.doc_id
"""
