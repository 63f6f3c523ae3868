"""Document fingerprints by winnowing, in DataFrame operations only.

The text in lower case is cut into tokens: runs of at most 12 characters without white space, but single characters in scripts that put no
space between words, so that an inserted one shifts no token. Every k consecutive tokens have a rolling hash, the polynomial over GF(2) in
their hashes: shift by one and exclusive or. (An array expression hands nothing from one element to the next, so each value comes from
its k tokens, which is what rolling it would give.) Of each window of w consecutive hashes the smallest is picked, the rightmost of equal ones, with its position.
Two texts that share k + w - 1 consecutive tokens share a pick, whatever else differs. Fewer than k tokens make one
gram; no token makes an empty fingerprint.

A pick is one long: 31 bits of hash, then 32 bits that fall as the position rises, so that the plain minimum of longs
is the smallest hash and, of equal hashes, the rightmost. No string has more than 2^31 tokens, so positions are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 4, 6
UNSPACED = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Javanese", "Balinese", "Tai_Le", "New_Tai_Lue", "Tai_Tham"))
TOKEN = rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,12}}"
PLAIN, FROM_UNSPACED = r"\S{1,12}", r"[\x{0E00}-\x{10FFFF}]"  # below the first of these scripts the plain pattern gives the same tokens, in half the time
POSITION_BITS = 32
LAST = (1 << POSITION_BITS) - 1


def fingerprint(df: DataFrame, text_column: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``out``: array<long> of picks in the order of the text. Null counts as the empty text."""
    text = F.lower(F.coalesce(F.col(text_column), F.lit("")))
    tokens = F.when(text.rlike(FROM_UNSPACED), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)))
    df = df.withColumn("_h", F.transform(tokens, lambda t: F.xxhash64(t)))
    gram = " ^ ".join(f"shiftleft(_h[i + {j}], {k - 1 - j})" for j in range(k))
    few = "aggregate(_h, 0L, (a, t) -> shiftleft(a, 1) ^ t)"
    # the highest bits, which all k tokens reach
    packed = f"shiftleft(shiftrightunsigned({{}}, {POSITION_BITS + 1}), {POSITION_BITS}) + ({LAST}L - {{}})"
    df = df.withColumn(
        "_g",
        F.expr(
            f"CASE WHEN size(_h) = 0 THEN cast(array() AS array<bigint>) WHEN size(_h) < {k} THEN array({packed.format(few, '0')}) "
            f"ELSE transform(sequence(0, size(_h) - {k}), i -> {packed.format(gram, 'i')}) END"
        ),
    )
    window = ", ".join(f"get(_g, i + {j})" for j in range(w))
    picks = F.expr(f"CASE WHEN size(_g) = 0 THEN _g WHEN size(_g) <= {w} THEN array(array_min(_g)) ELSE array_distinct(transform(sequence(0, size(_g) - {w}), i -> least({window}))) END")
    return df.withColumn(out, picks).drop("_h", "_g")


def as_text(picks: Column) -> Column:
    """``hash:position`` of each pick, hexadecimal and decimal, joined by spaces."""
    return F.array_join(F.transform(picks, lambda p: F.concat(F.lower(F.hex(F.shiftright(p, POSITION_BITS))), F.lit(":"), (F.lit(LAST) - p.bitwiseAND(F.lit(LAST))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two fingerprints as sets of hashes; two empty ones are alike, an empty and a filled one not."""
    x, y = (f"transform({c}, p -> shiftright(p, {POSITION_BITS}))" for c in (a, b))
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE cast(size(array_intersect({x}, {y})) AS double) / size(array_union({x}, {y})) END")


def with_next(df: DataFrame, id_column: str, columns: list[str], order_by: str, per_bucket: int = 2048, most: int = 16384) -> DataFrame:
    """``df`` with ``next_<column>`` of the next row in descending order of the id, of the first row for the last one.

    Ids of null come last; rows of the same id follow each other by a hash of ``order_by``. The order is global, but no task sees more than a bucket of
    it: ids are cut at quantiles into buckets of about ``per_bucket`` rows (more where that would take over ``most`` buckets; a window sorts its
    bucket with spilling), an id that would fill buckets alone is cut by the hash, and the first row of each bucket is also sent to the end of the bucket
    before it, so that each window finds all its next rows in its own partition. To the driver come the boundaries alone, a few longs a bucket.
    """
    df = df.withColumns({"_sk": F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64(order_by)})
    n, low = df.agg(F.count(F.lit(1)), F.min("_sk")).first()
    per_bucket = max(per_bucket, -(-n // most))
    parts, bounds, hot = -(-n // per_bucket), set(), {}
    if parts > 1:
        cuts = df.agg(F.percentile_approx("_sk", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
        hot = {r["_sk"]: -(-r["n"] // per_bucket) for r in df.groupBy("_sk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_bucket).collect()}
        bounds = {c for c in cuts if c > low} | {c for c in hot if c > low} | {c + 1 for c in hot if c < (1 << 63) - 1}
    bounds = sorted(bounds)
    ways = [hot.get(c, 1) for c in [low, *bounds]]  # into how many buckets each range of ids is cut
    offsets = [sum(ways[:i]) for i in range(len(ways))] if hot else list(range(len(ways)))

    def listed(values: list) -> Column:
        return F.from_json(F.lit(str(values).replace("None", "null")), "array<bigint>")

    step = 1 << max(0, len(bounds).bit_length() - 1)
    at = F.lit(0)
    if bounds:  # binary search among the boundaries
        at = F.aggregate(F.array(*(F.lit(step >> j) for j in range(step.bit_length()))), F.lit(0), lambda a, s: F.when(F.get(listed(bounds), a + s - 1) <= F.col("_sk"), a + s).otherwise(a))
    df = df.withColumn("_b", at)
    if hot:
        way = F.get(listed(ways), F.col("_b"))
        part = F.floor((F.col("_h") / F.lit(float(1 << 64)) + 0.5) * way)
        df = df.withColumn("_b", (F.get(listed(offsets), F.col("_b")) + F.greatest(F.lit(0), F.least(way - 1, part))).cast("int"))
    down = F.bitwise_not("_sk")  # rises as the id falls
    first = {r["_b"]: (r["f"]["sk"], r["f"]["h"]) for r in df.groupBy("_b").agg(F.min(F.struct(down.alias("sk"), F.col("_h").alias("h"))).alias("f")).collect()}
    order = sorted(first, key=first.get)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    known = range(sum(ways))
    is_first = (F.get(listed([first.get(b, (None, None))[0] for b in known]), F.col("_b")) == down) & (F.get(listed([first.get(b, (None, None))[1] for b in known]), F.col("_b")) == F.col("_h"))
    here, above = F.struct(F.col("_b").alias("b"), F.lit(0).alias("s")), F.struct(F.get(listed([before.get(b) for b in known]), F.col("_b")).cast("int").alias("b"), F.lit(1).alias("s"))
    df = df.withColumn("_to", F.explode(F.when(is_first, F.array(here, above)).otherwise(F.array(here))))
    window = Window.partitionBy("_to.b").orderBy("_to.s", down, "_h")
    return df.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where("_to.s = 0").drop("_sk", "_h", "_b", "_to")


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprint of each text and of its edited form, whose last third of code points gives way to the start of the next document.

    Takes doc_id and text, any further columns are dropped. Null texts count as empty. Repeated rows are documents of
    their own; equal rows follow each other, in one bucket. An empty table gives no rows.
    """
    docs = fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fp", k, w)
    docs = with_next(docs, "doc_id", ["text", "fp"], "text").withColumn("n_chars", F.char_length("text").cast("long"))
    docs = docs.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 AS int)), left(next_text, cast(n_chars div 3 AS int)))"))
    docs = fingerprint(docs.select("doc_id", "n_chars", "edited", "fp", "next_fp"), "edited", "efp", k, w)
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
