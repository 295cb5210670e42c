"""Document fingerprints: canonical exact digests, grouped and compared byte by byte.

Everything here is DataFrame or SQL functions.

Canonical form: NFKC, full case folding, NFKC again (folding can undo the
composition), each run of Unicode white space to one space, trimmed.  Null
texts count as empty, so null, empty and all-blank texts share one fingerprint.
Repeated rows get equal fingerprints; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.common import table, written

#: Ids of one ordering bucket, and keys that rows without an id are spread over: 2 to these powers.
BUCKET_BITS, NULL_BITS = 9, 30


def canonical(text: Column) -> Column:
    """Canonical form of a text; see the module's docstring.

    The JVM's ICU library, which Spark ships, is called through the SQL
    function ``java_method``.
    """

    def compose(c: Column) -> Column:
        return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    def fold(c: Column) -> Column:
        return F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))

    return F.trim(F.regexp_replace(compose(fold(compose(F.coalesce(text, F.lit(""))))), r"(?U)\s+", " "))


def wide_digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: two xxhash64 of the text under different seeds."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), canon)), 16, "0")))


def fingerprints(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] = wide_digest) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``fingerprint``.

    Rows are bucketed by ``digest`` of their canonical text and compared byte
    by byte inside equal buckets: should one digest stand for several texts,
    those get the digest plus ``-`` and their rank in byte order.
    """
    forms = df.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("canon")).withColumn("digest", digest(F.col("canon")))
    return resolved(forms, "canon", "digest", clashes(forms)).select("doc_id", F.col("digest").alias("fingerprint"))


def clashes(forms: DataFrame) -> DataFrame | None:
    """(digest, variants) for each digest of ``forms`` (canon, digest) that stands for several byte sequences; None where there are none.

    The least and the greatest text of a bucket are compared; copies collapse
    before the shuffle, so a hot group costs two rows per task.
    """
    texts = forms.select("digest", F.col("canon").cast("binary").alias("canon"))
    bad = written(texts.groupBy("digest").agg(F.min("canon").alias("a"), F.max("canon").alias("z")).where("a <> z").select("digest"), "clashes")
    if bad.isEmpty():
        return None
    return texts.join(bad, "digest", "left_semi").groupBy("digest").agg(F.array_sort(F.collect_set("canon")).alias("variants"))


def resolved(forms: DataFrame, canon: str, digest: str, found: DataFrame | None) -> DataFrame:
    """``forms`` with column ``digest`` made distinct for each byte sequence; ``found`` must know all texts."""
    if found is None:
        return forms
    rank = F.array_position("variants", F.col(canon).cast("binary"))
    named = F.when(F.col("variants").isNotNull(), F.concat(F.col(digest), F.lit("-"), rank.cast("string"))).otherwise(F.col(digest))
    return forms.join(found.withColumnRenamed("digest", "__of"), F.col(digest) == F.col("__of"), "left").withColumn(digest, named).drop("__of", "variants")


def with_next(df: DataFrame, lo: int, hi: int, more: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``df`` (k long, v, no nulls) with v as ``more`` makes it, ``v_next``, that of the next row in descending k, after the last the first's, and ``b``, k's bucket.

    Buckets of consecutive k are ordered on their own; each bucket's last row
    takes the head of the next bucket that has rows, which the same rule finds
    among the heads.  Equal k are ordered by v.
    """
    rows = df.withColumn("b", F.shiftright("k", BUCKET_BITS))
    made = rows.withColumn("v", more(F.col("v")))
    if hi - lo < 1 << BUCKET_BITS:
        whole = Window.partitionBy(F.lit(0)).orderBy(F.col("k").desc(), "v")
        return made.withColumn("v_next", F.coalesce(F.lead("v").over(whole), F.first("v").over(whole)))
    heads = rows.groupBy("b").agg(F.min(F.struct(F.bitwise_not("k").alias("r"), "v")).alias("h")).select(F.col("b").alias("k"), F.col("h.v").alias("v"))
    if (hi >> BUCKET_BITS) - (lo >> BUCKET_BITS) >= 1 << BUCKET_BITS:
        heads = written(heads, "heads")  # else each level would double the plan
    after = with_next(heads, lo >> BUCKET_BITS, hi >> BUCKET_BITS).select(F.col("k").alias("b"), more(F.col("v_next")).alias("head"))
    own = Window.partitionBy("b").orderBy(F.col("k").desc(), "v")
    return made.withColumn("lead", F.lead("v").over(own)).join(after, "b", "left").withColumn("v_next", F.coalesce("lead", "head")).drop("lead", "head")


def edited(docs: DataFrame, more: Callable[[Column], Column]) -> DataFrame:
    """``docs`` (doc_id, text) with ``k`` (place in the order), ``b`` (its bucket), ``v`` and ``v_next`` (own and next text as ``more`` makes them, with a field text) and ``edited``."""
    text = F.coalesce("text", F.lit(""))
    # Rows without an id come last; they are spread over keys of their own by content and partition, as they may be many.
    none = F.lit(-(2**63)) + F.pmod(F.xxhash64(text, F.spark_partition_id()), F.lit(1 << NULL_BITS))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), none).alias("k"), text.alias("v"))
    ends = docs.agg(F.min("doc_id").cast("long").alias("lo"), F.max("doc_id").cast("long").alias("hi"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    lo = -(2**63) if ends["none"] else ends["lo"] or 0
    rows = with_next(keyed, lo, -(2**63) + (1 << NULL_BITS) if ends["hi"] is None and ends["none"] else ends["hi"] or 0, more)
    n = F.char_length("v.text")
    cut = F.floor(n / 3).cast("int")
    return rows.withColumn("edited", F.concat(F.col("v.text").substr(F.lit(1), n - cut), F.col("v_next.text").substr(F.lit(1), cut)))


def edited_fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = wide_digest) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of ``docs`` (doc_id, text).

    Own texts are made canonical once, before they are dealt by bucket; the next
    document's digest comes with its text.  Where digests are equal the
    texts themselves are compared.
    """
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    every = edited(docs, lambda c: F.struct(c.alias("text"), digest(canonical(c)).alias("digest")))
    every = every.withColumn("changed", canonical(F.col("edited"))).withColumn("edited_fingerprint", digest(F.col("changed")))
    every = every.select("doc_id", "k", "b", F.col("v.text").alias("own"), F.col("v_next.text").alias("after"), "edited", "changed", F.col("v.digest").alias("fingerprint"), "edited_fingerprint", F.col("v_next.digest").alias("next_digest"))

    def alike(same: Column, other: Column) -> Column:
        return F.when(same, canonical(F.col("own")) == other).otherwise(F.lit(False)).cast("double")

    near = alike(F.col("fingerprint") == F.col("edited_fingerprint"), F.col("changed")), alike(F.col("fingerprint") == F.col("next_digest"), canonical(F.col("after")))
    told = every.withColumns({"n_chars": F.char_length("own").cast("long"), "edited_sha256": F.sha2("edited", 256), "near_edited": near[0], "near_next": near[1]})
    kept = written(told.select("k", "b", *columns), "digests")
    # Only texts whose digest stands on more than one row are held against each other, own and edited ones alike.
    seen = kept.select("k", "b", F.explode(F.array_distinct(F.array("fingerprint", "edited_fingerprint"))).alias("digest"))
    shared = seen.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    marks = seen.join(shared, "digest", "left_semi").groupBy("b").agg(F.collect_set("k").alias("ks"), F.collect_set("digest").alias("digests"))
    # A bucket has few ids, and its rows are where the edit puts them, so no text is dealt again before copies collapse.
    some = edited(docs, lambda c: F.struct(c.alias("text"))).join(marks, "b").where(F.array_contains("ks", F.col("k")))
    forms = some.select("digests", F.explode(F.array("v.text", "edited")).alias("text")).select("digests", canonical(F.col("text")).alias("canon"))
    forms = forms.withColumn("digest", digest(F.col("canon"))).where(F.array_contains("digests", F.col("digest")))
    found = clashes(forms.select("canon", "digest"))
    if found is None:
        return kept.select(*columns)
    rows = told.withColumn("own", canonical(F.col("own")))
    for canon, name in (("own", "fingerprint"), ("changed", "edited_fingerprint")):
        rows = resolved(rows, canon, name, found)
    return rows.select(*columns)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    A null doc_id comes after all others in the descending order.
    """
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
