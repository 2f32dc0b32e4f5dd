"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions alone.

A text's words are runs without ASCII white space, in lower case; a shingle is five words in a row (fewer words: all of them). A
sketch retains every distinct shingle hash below 1/scale of the range of hashes: all of them at a scale of 1, since of a
short text any share is too few, and a larger text's sketch has to hold what a shorter one's does. Of a retained hash the first
32 bits are stored. Sketches of one scale merge by
union (`merge`, `merged`); the share of the smaller sketch that the larger one holds is the containment, also of a note in a book.

The next document comes from one shuffle of texts by segments of the order, which follow the quantiles of the ids and so hold
about as many documents each whatever the ids are. Rows at the head of a segment go to the segment before it as well.

Cases: a null text is an empty one; an empty text's sketch is empty; two empty sketches are alike (1), one
empty sketch is unlike any other (0); a null doc_id comes after all others; rows of one doc_id follow in falling order of
their texts' hashes; of one row alone the next document is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, SCALE = 5, 1
#: Documents of a segment of the order by doc_id, about.
SEGMENT = 500
#: Quantiles that cut the order, and that cut each of its parts again if those are large; parts of one id's rows, of all.
CUTS, INNER_CUTS, HOT_PARTS = 512, 128, 1 << 16


def held(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, scale: int = SCALE) -> Column:
    """The sorted retained hashes of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), "")

    def shingles(w: Column) -> Column:
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(SHINGLE))))
        return F.when(F.size(w) < SHINGLE, whole).otherwise(runs)

    def retained(h: Column) -> Column:
        kept = h if scale == 1 else F.filter(h, lambda x: F.shiftrightunsigned(x, 1) < (1 << 63) // scale)
        return F.sort_array(F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 32).cast("int"))))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return held(held(hashed, shingles), retained)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches of one scale."""
    return F.sort_array(F.array_union(a, b))


def merged(sketches: Column) -> Column:
    """The sketch of a group's shingles together, as an aggregate."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketches))))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller text's sketch in the larger's."""
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) / least.cast("double")
    return F.when(least > 0, shared).otherwise(((F.size(a) == 0) & (F.size(b) == 0)).cast("double"))


def place(value: Column, cuts: Column) -> Column:
    """Where a value lies among sorted cuts: an odd number on a cut, an even one between two."""
    return (2 * F.size(F.filter(cuts, lambda c: c < value)) + F.array_contains(cuts, value).cast("int")).cast("long")


def quantiles(n: int) -> Column:
    return F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, text) with `bucket` and `part`, and the segments: bucket, part, own and previous number, head's id and hash.

    A bucket holds the rows of one id that is a cut, or those between two cuts. One id's rows, if many, are parted by their texts' hashes.
    """
    cuts, n = rows.agg(quantiles(CUTS), F.count("*")).first()
    if not n:
        return rows.withColumns({"bucket": F.lit(0), "part": F.lit(0)}), rows.sparkSession.createDataFrame([], "bucket long, part int, own int, previous int, head long, hash long")
    outer = sorted(set((cuts or [])[:: max(1, CUTS * SEGMENT // n)]))
    rows = rows.withColumn("bucket", F.coalesce(place(F.col("doc_id"), F.array(*map(F.lit, outer)).cast("array<long>")), F.lit(-1)))
    inner = min(INNER_CUTS, -(-n // (SEGMENT * CUTS)))
    if inner > 1:
        found = rows.where("bucket >= 0").groupBy("bucket").agg(F.array_distinct(quantiles(inner)).alias("cuts")).collect()
        small = rows.sparkSession.createDataFrame(found, "bucket long, cuts array<long>")
        rows = rows.join(F.broadcast(small), "bucket", "left")
        rows = rows.withColumn("bucket", F.col("bucket") * (2 * INNER_CUTS) + F.coalesce(place(F.col("doc_id"), F.col("cuts")), F.lit(0))).drop("cuts")
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
    hot = {r["bucket"]: min(-(-r["n"] // SEGMENT), -(-r["n"] * HOT_PARTS // n)) for r in found if r["low"] == r["high"] and r["n"] > 4 * SEGMENT}
    heads = [(r["bucket"], 0, r["high"], None) for r in found if r["bucket"] not in hot]
    rows = rows.withColumn("part", F.lit(0))
    if hot:
        small = rows.sparkSession.createDataFrame(list(hot.items()), "bucket long, parts int")
        share = F.xxhash64("text") / F.lit(2.0**64) + 0.5
        rows = rows.join(F.broadcast(small), "bucket", "left").withColumn("part", F.coalesce(F.least(F.floor(share * F.col("parts")), F.col("parts") - 1), F.lit(0)).cast("int"))
        heads += map(tuple, rows.where("parts is not null").groupBy("bucket", "part").agg(F.max("doc_id"), F.max(F.xxhash64("text"))).collect())
    heads.sort(key=lambda x: x[:2], reverse=True)
    segments = [(bucket, part, i, (i or len(heads)) - 1, head, hashed) for i, (bucket, part, head, hashed) in enumerate(heads)]
    return rows, rows.sparkSession.createDataFrame(segments, "bucket long, part int, own int, previous int, head long, hash long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, own sketch, and the text and sketch of the next document in falling order of doc_id.

    Texts are shuffled once, by segment of that order, and sketched after that.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, segments = dealt(docs)
    at_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("hash").isNull() | (F.col("hash") == F.xxhash64("text")))
    own = F.array(F.struct(F.col("own").alias("segment"), F.lit(0).alias("visits")))
    both = F.array(F.struct(F.col("own").alias("segment"), F.lit(0).alias("visits")), F.struct(F.col("previous").alias("segment"), F.lit(1).alias("visits")))
    # segments are at most some 10 per thousand documents, and in all some 2 * CUTS * INNER_CUTS + HOT_PARTS
    met = rows.join(F.broadcast(segments), ["bucket", "part"]).select("doc_id", "text", F.explode(F.when(at_head, both).otherwise(own)).alias("in"))
    order = Window.partitionBy("segment").orderBy("visits", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")), F.desc("text"))
    # the window takes the partitions as they are, so sketches are made once and after the shuffle
    placed = met.select("doc_id", "text", "in.*").repartition("segment").withColumn("sketch", sketch(F.col("text")))
    found = placed.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).where("visits = 0")
    return found.select("doc_id", "text", "sketch", F.struct(F.col("next_text").alias("text"), F.col("next_sketch").alias("sketch")).alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last half is taken from the next document, and their likeness."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
    )
