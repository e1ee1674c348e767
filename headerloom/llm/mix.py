"""Mixing sources to target weights: random order by hash, distributed prefix sums, exact cuts.

Each document's place within its source is a hash of its id and text. The range of hashes is divided into
slots of about ``SLOT_ROWS`` documents (more slots for larger sources), slot totals give each slot's
offset, and a window inside the slot gives the document's own prefix sum: no source is ever sorted in
one task. A source's budget is whole epochs of all its documents and then the documents in hash order
up to the exact word at which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headerloom.llm.shared import written

#: A run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SLOT_ROWS = 4_000
#: What is known of the sources is broadcast up to so many of them, at some hundred bytes each.
SOURCES = 50_000


def _keys(id_col: str, text_col: str):
    """(words of the text, 0 for null; the hash that orders the documents of a source; the text's digest) as columns."""
    text = F.col(text_col).cast("string")
    digest = F.coalesce(F.md5(text.cast("binary")), F.lit(""))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return size, F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), digest).cast("binary")), digest


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size (words; 0 for null), the hash that orders the documents of a source and the text's digest."""
    size, key, digest = _keys(id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), digest.alias("digest"))


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target for the per-source totals ``sizes`` (source, source_size, ...).

    ``weights`` repeat over the sources in code-point order, null last. Targets share ``share`` times
    all words by weight; one that would exceed ``most`` times its source's words stops there, and the
    rest is shared among the others until none is above. In the order of cap/weight, a source is
    capped iff its share of what the sources before it leave is its cap or more.
    """
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % n + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    capped = (F.col("total") - F.col("cap_before")) * F.col("weight") / F.col("weight_left") >= F.col("cap")
    rows = rows.withColumn("capped", capped)
    rows = rows.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)).alias("taken_caps"),
        F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything).alias("weight_open"),
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("total") - F.col("taken_caps")) * F.col("weight") / F.col("weight_open"))
    return rows.select("source", "source_size", target.alias("target"), "documents")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target (its source's), taken.

    taken counts the words of the document that the mix takes, repeats counted: its size for each
    whole epoch, and what the cut leaves of it in the last. The words taken of a source are exactly
    its target rounded down. Null texts have size 0 and are never taken; a null source is a source of
    its own; rows that repeat a doc_id count each; an empty table gives an empty one. Other columns
    are ignored.
    """
    return _planned(docs, weights, share, most, id_col, source_col, text_col).drop("digest", "key", "epochs")


def _planned(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """mix() with the digest of each row's text, its key and its source's whole epochs."""
    one = written(sized(docs, id_col, source_col, text_col))
    totals = one.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    goal = targets(totals, weights, share, most).withColumn("slots", F.ceil(F.col("documents") / SLOT_ROWS))
    named = goal.select(F.col("source").alias("s"), "source_size", "target", "slots")
    rows = one.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("slot", F.floor(place * F.col("slots") / F.lit(2.0**32)))
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    slots = slots.withColumn("offset", F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot")) - F.col("slot_size"))
    slots = slots.select(F.col("source").alias("s"), F.col("slot").alias("t"), "offset")
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("t")))
    inside = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "digest", "key", epochs.alias("epochs"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document once per epoch it is taken in, the one at the cut up to the cut.

    docs: doc_id, text, source and any other columns; n_chars, if there, is brought up to date.

    In a source's order all documents before the cut are taken once more than its whole epochs, and those after it
    are not. So a row needs its own place and what is known of its source, no text is shuffled. Rows
    equal in doc_id, source and text stand together in that order; only where the cut is within such a group its rows are numbered.
    """
    place = F.struct("key", "doc_id", "size", "digest")
    extra = F.col("taken") - F.col("epochs") * F.col("size")
    plan = written(_planned(docs, **options))
    facts = plan.groupBy("source").agg(F.first("epochs").alias("epochs"), F.max(F.when(extra > 0, place)).alias("cut"))
    facts = written(facts.select(F.col("source").alias("__s"), "epochs", "cut"))
    last = plan.join(facts.select("__s", "cut"), F.col("source").eqNullSafe(F.col("__s"))).where(place == F.col("cut"))
    last = last.groupBy("__s").agg(F.sum(extra).alias("rest"), F.count("*").alias("many")).withColumnRenamed("__s", "__t")
    facts = written(facts.join(last, F.col("__s").eqNullSafe(F.col("__t")), "left").drop("__t"))
    within = not facts.where("many > 1").isEmpty()  # whether a cut lies within a group of equal rows
    if facts.count() <= SOURCES:
        facts = F.broadcast(facts)

    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names of their own, so that no column of docs clashes
    size, key, digest = _keys(names["doc_id"], names["text"])
    rows = docs.toDF(*names.values()).withColumns({"size": size, "key": key, "digest": digest})
    rows = rows.join(facts, F.col(names["source"]).eqNullSafe(F.col("__s")))
    own = F.struct("key", F.col(names["doc_id"]).alias("doc_id"), "size", "digest")
    whole = F.col("epochs") * F.col("size")
    at_cut = F.coalesce(own == F.col("cut"), F.lit(False))
    more = F.when(at_cut, F.col("rest")).when(F.coalesce(own < F.col("cut"), F.lit(False)), F.col("size")).otherwise(0)
    first = rows.withColumn("taken", whole + more)
    if within:
        nth = F.row_number().over(Window.partitionBy("__s").orderBy("key")) - 1
        group = rows.where(at_cut & (F.col("many") > 1)).withColumn("taken", whole + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - nth * F.col("size"))))
        first = first.where(~(at_cut & F.coalesce(F.col("many") > 1, F.lit(False)))).unionByName(group)
    first = first.where("taken > 0")
    text = F.col(names["text"]).cast("string")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    copies = first.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    out = copies.withColumn(names["text"], F.when(left >= F.col("size"), text).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")))
    if "n_chars" in docs.columns:
        out = out.withColumn(names["n_chars"], F.length(names["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
