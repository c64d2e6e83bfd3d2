"""Benchmark decontamination with a positional inverted index.

1. One scan of the documents writes the postings (term, document, position) of all terms that the test
   windows have, as Parquet in the shared folder. All later steps read this index.
2. Its counts give each window's rarest terms. The lists of the two rarest are shifted by their distance
   and joined by document and place, once for each pair of terms and distance, however many
   windows share it: what meets at the same place may be a phrase, what meets within ``slop`` words
   is a proximity match.
3. Each phrase's other terms are looked up in the index at their places, and those that all are there are exact
   matches.

All of it is DataFrame expressions. Joins of postings are keyed by document, term and place, so a very common term
is spread like the places where it stands.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwire.llm.common import ascii_lower, keep, lookup, remove, shared_folder, small

#: What separates words; A-Z are lowered before or, in texts of the corpus, after the split.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words that a proximity match may be off the distance.
SLOP = 4


def split_words(text: Column) -> Column:
    """Words as written; an empty one may stand first and last."""
    return F.split(F.coalesce(text, F.lit("")), GAP, -1)


def key() -> tuple[Column, Column]:
    """Rows with the same id and the same text share their result; others never meet."""
    return F.col("doc_id").alias("kid"), F.xxhash64("text").alias("kh")


def tokens(docs: DataFrame) -> DataFrame:
    """kid, kh, pos, word (as written) of every word.

    Positions count from the text's first word or, if something else comes first, from one before it.
    """
    words = docs.select(*key(), split_words(F.col("text")).alias("words"))
    rows = words.select("kid", "kh", F.posexplode_outer("words").alias("pos", "word"))  # an inner one would have a filter inferred that splits again
    return rows.where("word <> ''")


def windows(benchmark: DataFrame, size: int = 8) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, terms) and their items (wid, item_id).

    Items without words have none; one of fewer than ``size`` words is a single window.
    """
    words = F.filter(split_words(ascii_lower(F.coalesce("text", F.lit("")))), lambda x: x != "")
    items = benchmark.select("item_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, size))).alias("terms"))
    each = keep(each.distinct().withColumn("wid", F.sha1(F.concat_ws(" ", "terms"))))
    return each.select("wid", "terms").distinct(), each.select("wid", "item_id")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """tid, kid, kh, pos of every occurrence of ``terms`` (tid, term), A-Z lowered.

    The join is on the word in full lower case, which is cheap; what differs from lowering A-Z alone is
    dropped after it.
    """
    found = tokens(docs).withColumn("fold", F.lower("word")).join(small(terms.withColumn("fold", F.lower("term"))), "fold")
    return found.where((F.col("word") == F.col("term")) | (ascii_lower(F.col("word")) == F.col("term"))).select("tid", "kid", "kh", "pos")


class Index:
    """The written postings of the terms of ``wins`` (wid, terms) in ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, wins: DataFrame) -> None:
        self.spark = docs.sparkSession
        self.folder = f"{shared_folder(self.spark)}/postings-{uuid.uuid4().hex}"
        places = wins.select("wid", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
        terms = keep(places.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
        postings(docs, terms).write.option("compression", "zstd").parquet(self.folder)
        self.rows = self.spark.read.parquet(self.folder)
        counts = self.rows.groupBy("tid").agg(F.count("*").alias("n"))
        places = places.join(terms, "term").join(counts, "tid", "left").fillna(0, ["n"])
        self.places = keep(places.withColumn("rank", F.expr("row_number() over (partition by wid order by n, off)")).select("wid", "len", "off", "tid", "rank"))
        second = self.places.where("rank = 2").select("wid", F.col("tid").alias("tid2"), F.col("off").alias("off2"))
        lead = self.places.where("rank = 1").select("wid", "len", F.col("tid").alias("tid1"), "off").join(second, "wid", "left")
        lead = lead.withColumn("d", F.col("off2") - F.col("off"))
        pairs = keep(lead.select("tid1", "tid2", "d").distinct().withColumn("pid", F.monotonically_increasing_id()))
        same = [lead["tid1"] == pairs["tid1"], lead["tid2"].eqNullSafe(pairs["tid2"]), lead["d"].eqNullSafe(pairs["d"])]
        #: windows by the pair of their rarest terms and the distance between these
        self.lead = keep(lead.join(pairs, same).select("pid", "wid", "len", "off"))
        self.pairs = pairs

    def close(self) -> None:
        remove(self.spark, self.folder)

    def meetings(self, slop: int) -> DataFrame:
        """kid, kh, pid, p (place of the rarest term), exact: where the pair's lists meet within ``slop`` words.

        The lists meet in bins of ``slop + 1`` places and the bins beside them, so only postings that may
        match are paired. A window of one word meets where that stands.
        """
        first = self.rows.join(small(self.pairs.select(F.col("tid1").alias("tid"), "pid", F.col("tid2").isNull().alias("alone"))), "tid").select("kid", "kh", "pid", F.col("pos").alias("p"), "alone")
        second = self.rows.join(small(self.pairs.where("tid2 is not null").select(F.col("tid2").alias("tid"), "pid", "d")), "tid").select(F.col("kid").alias("kid2"), F.col("kh").alias("kh2"), F.col("pid").alias("pid2"), (F.col("pos") - F.col("d")).alias("p2"))
        width = slop + 1
        beside = [F.lit(0)] if not slop else [F.lit(-1), F.lit(0), F.lit(1)]
        a = first.where("not alone").withColumn("bin", F.explode(F.array(*[F.floor(F.col("p") / width) + i for i in beside])))
        b = second.withColumn("bin2", F.floor(F.col("p2") / width))
        met = a.join(b, [F.col("kid").eqNullSafe(F.col("kid2")), F.col("kh") == F.col("kh2"), F.col("pid") == F.col("pid2"), F.col("bin") == F.col("bin2"), F.abs(F.col("p") - F.col("p2")) <= slop])
        met = met.select("kid", "kh", "pid", "p", (F.col("p") == F.col("p2")).alias("exact"))
        return met.unionByName(first.where("alone").select("kid", "kh", "pid", "p", F.lit(True).alias("exact"))).groupBy("kid", "kh", "pid", "p").agg(F.max("exact").alias("exact"))

    def phrases(self, met: DataFrame) -> DataFrame:
        """kid, kh, wid, start, len: every place where a window's words follow each other."""
        lead = small(self.lead)
        starts = keep(met.where("exact").join(lead, "pid").select("kid", "kh", "wid", "len", (F.col("p") - F.col("off")).alias("start")))
        docs = lookup(starts.where("len > 2").select("kid", "kh").distinct())
        near = self.rows.join(docs, [self.rows["kid"].eqNullSafe(docs["kid"]), self.rows["kh"] == docs["kh"]], "left_semi")
        near = near.select(F.col("kid").alias("kid2"), F.col("kh").alias("kh2"), F.col("tid").alias("tid2"), "pos").distinct()
        asked = starts.join(small(self.places.where("rank > 2").select("wid", "off", "tid")), "wid").withColumn("at", F.col("start") + F.col("off"))
        held = asked.join(near, [F.col("kid").eqNullSafe(F.col("kid2")), F.col("kh") == F.col("kh2"), F.col("tid") == F.col("tid2"), F.col("at") == F.col("pos")])
        whole = held.groupBy("kid", "kh", "wid", "len", "start").agg(F.count("*").alias("n")).where("n = len - 2").drop("n")
        return starts.where("len <= 2").unionByName(whole).select("kid", "kh", "wid", "start", "len")


def judged(docs: DataFrame, benchmark: DataFrame, size: int, slop: int = SLOP) -> DataFrame:
    """kid, kh, n_hit, n_items, items, n_near of the documents in which windows occur or are nearly there; written."""
    wins, items = windows(benchmark.select("item_id", "text"), size)
    index = Index(docs.select("doc_id", "text"), wins)
    met = keep(index.meetings(slop))
    found = keep(index.phrases(met))
    same = ["kid", "kh"]
    covered = found.select(*same, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")).distinct()
    hits = covered.groupBy(*same).agg(F.count("*").alias("n_hit"))
    items = items.where("item_id is not null").select("wid", F.col("item_id").cast("string").alias("item"))
    named = found.select(*same, "wid").distinct().join(small(keep(items)), "wid").select(*same, "item").distinct()
    listed = named.groupBy(*same).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    beside = keep(index.lead.join(items, "wid").select("pid", "item").distinct())
    near = met.select(*same, "pid").distinct().join(small(beside), "pid").select(*same, "item").distinct().groupBy(*same).agg(F.count("*").alias("n_near"))
    parts = [near.select(*same, F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"), "n_near")]
    zero = F.lit(0).cast("long")
    parts += [hits.select(*same, "n_hit", zero.alias("n_items"), F.lit("").alias("items"), zero.alias("n_near")), listed.select(*same, zero.alias("n_hit"), "n_items", "items", zero.alias("n_near"))]
    out = keep(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*same).agg(F.sum("n_hit").alias("n_hit"), F.sum("n_items").alias("n_items"), F.max("items").alias("items"), F.sum("n_near").alias("n_near")))
    index.close()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 8, least: int = 2, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row of ``docs``.

    A word is hit inside any occurrence of a window. ``contaminated``: ``least`` items or more
    have occurring windows. n_near: items of which a window's two rarest words (by their count in ``docs``, then
    their place) stand no more than ``slop`` words off their distance. Null texts have no words; rows
    that share a doc_id are judged one by one; item ids that are null are left out of the list but their windows hit.
    An empty benchmark contaminates nothing. Other columns are ignored.
    """
    counted = small(judged(docs, benchmark, size, slop))
    words = split_words(F.col("text"))
    n_words = F.size(words) - (words[0] == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    rows = docs.select("doc_id", n_words.cast("long").alias("n_words"), F.xxhash64("text").alias("h"))
    rows = rows.join(counted, [F.col("doc_id").eqNullSafe(F.col("kid")), F.col("h") == F.col("kh")], "left")
    none = F.lit(0).cast("long")
    n_items = F.coalesce("n_items", none)
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_items >= least).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 8, least: int = 2) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`contamination` does not mark."""
    bad = small(judged(docs, benchmark, size, 0).where(F.col("n_items") >= least).select("kid", "kh"))
    return docs.join(bad, [docs["doc_id"].eqNullSafe(bad["kid"]), F.xxhash64(docs["text"]) == bad["kh"]], "left_anti")
