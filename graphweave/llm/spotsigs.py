"""Document fingerprints by SpotSigs, in DataFrame functions only.

A signature is an anchor and the chain of content words after it.  Anchors are the
common words of a list; in stretches without any, every word beyond the first ``GAP``
ones is an anchor too, so texts in other languages, tables and lists also have
signatures, by a rule that looks at near words only.  A document's fingerprint is
the set of the hashes of its signatures, sorted, in hexadecimal; a text of marks
without any word has one, that of the whole text.

``likeness`` is the Jaccard similarity of two fingerprints; with a least value, pairs whose set
sizes alone rule it out aren't compared (0.0).  ``compare_edits`` sets every document beside its edited
text and the next document; it looks at these pairs only and joins no others.

Null text: empty; an empty text has an empty fingerprint, which is like another empty one
(1.0) and unlike all others.  Very long texts are taken whole.  Equal texts have equal
fingerprints; repeated rows stay; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, prepare

#: Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be been but by can could did do does for from had has have he her his how i if in into is it its more no not of on one or
our said she should so some than that the their them then there these they this those to up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist ja
kein man mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur
au aux avec ce ces cette d dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou par pas plus pour qu que qui
sa se ses si son sont sur un une vous y été être
al algo como con de del desde donde el ella en entre era es esa ese eso esta este esto fue ha hay la las le lo los más me mi muy no nos o para
pero por porque que quien se sin sobre son su sus también te tu un una uno y ya
""".split()

CHAIN = 3  # content words of a signature
REACH = 9  # words after the anchor among which they are looked for
GAP = 8  # words without an anchor before each word is one


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def signatures(text: Column, chain: int = CHAIN, reach: int = REACH, gap: int = GAP) -> Column:
    """Sorted distinct 64-bit hashes of the text's signatures; null counts as empty."""
    listed = sorted(set(ANCHORS))
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        marks = F.filter(F.transform(w, lambda x, i: F.when(x.isin(listed), i)), lambda i: i.isNotNull())
        return F.transform(F.array(marks), lambda p: of_marks(w, n, p))[0]

    def of_marks(w: Column, n: Column, p: Column) -> Column:
        none = F.array().cast("array<int>")
        # between an anchor and the next: the words beyond the first ``gap``; before the first anchor: all
        spaces = F.filter(F.arrays_zip(F.concat(F.array(F.lit(-1 - gap)), p).alias("a"), F.concat(p, F.array(n)).alias("b")), lambda s: s["b"] - s["a"] > gap + 1)
        filled = F.flatten(F.transform(spaces, lambda s: F.sequence(s["a"] + gap + 1, s["b"] - 1)))
        chained = lambda i: F.slice(F.filter(F.slice(w, i + 2, reach), lambda x: ~x.isin(listed)), 1, chain)
        return F.transform(F.concat(p, F.coalesce(filled, none)), lambda i: F.xxhash64(F.concat_ws(" ", F.get(w, i), chained(i))))

    found = F.transform(F.array(words(text)), of_words)[0]
    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text)))
    return F.transform(F.array(found), lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).otherwise(whole))[0]


def render(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.hex(s))), " ")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets of signatures; 0 without a comparison where their sizes rule out ``least``."""
    if not least:
        return jaccard(a, b)
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    value = jaccard(a, b)
    return F.when(small < least * large, F.lit(0.0)).when(value < least, F.lit(0.0)).otherwise(value)


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are less than a value, found among every ``step``-th cut first."""
    step = max(1, math.isqrt(len(cuts)))
    array = lambda own: F.array(*[F.lit(c) for c in own]).cast("array<bigint>")
    below = lambda own: F.size(F.filter(own, lambda c: c < value))
    coarse = below(array(cuts[step - 1 :: step])) * step
    return coarse + below(F.slice(array(cuts), coarse + 1, step))


def with_next(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Adds sigs, next_text and next_sigs: the signatures, and those of the following row by doc_id (after the last: the first).

    docs: doc_id, text.  Null ids come last, by a hash of their texts; equal ids are in that
    order too.  Rows are dealt into ranges of ids, sorted there, and each range also gets the first
    row of the next one, so texts move once and no range depends on another.  Signatures are made
    after that move, as they shrink less than texts on their way.
    """
    spark = prepare(docs.sparkSession)
    n_buckets = n_buckets or 4 * parts(spark)
    steps = [(k + 1) / n_buckets for k in range(n_buckets - 1)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(s) for s in steps]), F.lit(20 * n_buckets))).first()[0] if steps else None
    cuts = sorted(set(cuts or []))
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    # ranges of ids by their place among the cuts; null ids fill 64 ranges of their own
    bucket = F.when(F.col("doc_id").isNotNull(), _place(F.col("doc_id"), cuts)).otherwise(len(cuts) + 33 + F.shiftright(hashed, 58)).cast("int")
    rows = docs.withColumn("bucket", bucket).withColumn("tie", hashed)
    known = rows.where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id").alias("doc_id"), F.lit(None).cast("long").alias("tie"))
    nulls = rows.where("doc_id is null").groupBy("bucket").agg(F.lit(None).cast("long").alias("doc_id"), F.min("tie").alias("tie"))
    firsts = sorted(known.union(nulls).collect())  # a row a range
    if not firsts:
        none = F.array().cast("array<bigint>")
        return docs.select("*", none.alias("sigs"), F.lit("").alias("next_text"), none.alias("next_sigs"))
    guests = [(firsts[k - 1]["bucket"], k == 0, f["doc_id"], f["tie"]) for k, f in enumerate(firsts)]
    guests = spark.createDataFrame(guests, "host int, wraps boolean, g_id long, g_tie long")
    match = F.when(F.col("g_id").isNotNull(), F.col("g_id") == F.col("doc_id")).otherwise(F.col("doc_id").isNull() & (F.col("g_tie") == F.col("tie")))
    key = F.coalesce(F.col("doc_id"), F.col("tie"))
    visiting = rows.withColumn("k", key).join(F.broadcast(guests.withColumn("k", F.coalesce("g_id", "g_tie"))), "k").where(match)
    both = rows.select("*", F.lit(0).alias("guest")).unionByName(visiting.select(*[c for c in rows.columns if c != "bucket"], F.col("host").alias("bucket"), F.lit(1).alias("guest")))
    both = both.repartition(parts(spark), "bucket").withColumn("sigs", signatures(F.col("text")))
    order = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), "tie", "text")
    after = both.withColumn("next", F.lead(F.struct("text", "sigs")).over(order)).where("guest = 0")
    return after.select(*docs.columns, "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many of the following one."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, sigs) of every row."""
    prepare(docs.sparkSession)
    return texts(docs, id_col, text_col).withColumn("sigs", signatures(F.col("text")))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, sigs, edited, edited_sigs, near_edited, near_next): each document beside its edited text and the next document."""
    rows = with_next(texts(docs, id_col, text_col)).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select("doc_id", "text", "sigs", "edited", "edited_sigs", likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), render(F.col("sigs")).alias("fingerprint"), render(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next")
