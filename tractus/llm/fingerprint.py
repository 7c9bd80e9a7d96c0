"""Document fingerprints: a homomorphic multiset hash, in DataFrame
operations only.

A paragraph is hashed to a wide vector, and a document's fingerprint is the sum
of its paragraphs' vectors modulo powers of two.  Sums don't depend on the
order of paragraphs, and a paragraph is inserted or deleted by adding or
subtracting its vector (``combine``).  A vector has two parts:

* eight 32-bit lanes hashed from the whole paragraph, summed modulo 2^32: equal
  documents have equal sums, others differ but for a hash accident;
* one count and 128 lanes modulo 2^32, summed over the runs of up to three words
  from the paragraph's start: each run adds the bits of two hashes.  Centred,
  these lanes are random +-1 vectors, whose sums' inner product estimates
  how many runs two documents share, and ``likeness`` is that estimate over the
  mean of the two squared lengths, between 0 and 1.  It is exact for equal texts; otherwise its
  standard error is about 0.09 (1 / sqrt(128)), as tests measure.  Lanes hold the exact counts of
  documents of up to 2^31 runs, so no lane wraps.

Cases: null and empty texts have the fingerprint of one empty paragraph;
their likeness to each other is 1 and to any other text 0; repeated rows are
kept as often as they occur; rows with equal ids follow by their texts' hash; an empty table
gives no row; paragraphs of any length are hashed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractus.llm.common import id_text, materialize, shuffle_width

DIGEST, SKETCH = 8, 128
DIGEST_MOD, SKETCH_MOD = 1 << 32, 1 << 32
#: A run: up to three words of one line.
RUN = r"[^ \t\n\r\f\x0B]+(?:[ \t]+[^ \t\n\r\f\x0B]+){0,2}"


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def vectors(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, digest array<long>, runs long, sketch array<long>): the sums of
    each key's paragraphs' vectors.  Sums are made map-side, lane pairs
    packed in one long (counts of a document stay below 2^31)."""
    para = texts.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("_p"))
    run = para.select(*keys, "_p", F.posexplode_outer(F.regexp_extract_all("_p", F.lit(RUN), F.lit(0)))
                      .alias("_at", "_run"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    wide = [F.when(first, F.xxhash64(F.lit(1000 + k), "_p")) for k in range(DIGEST // 2)]
    bits = run.select(
        *keys, *[w.alias(f"_w{k}") for k, w in enumerate(wide)],
        *[F.when(F.col("_run").isNotNull(), F.xxhash64(F.lit(7 + k), "_run")).alias(f"_h{k}") for k in range(SKETCH // 64)])
    zero = F.lit(0).cast("long")
    sums = []
    for k in range(DIGEST // 2):
        w = F.col(f"_w{k}")
        sums += [F.sum(_low(w)).alias(f"d{2 * k}"), F.sum(F.shiftrightunsigned(w, 32)).alias(f"d{2 * k + 1}")]
    pair = 0x0000000100000001   # bits i and i + 32 of the hash, one lane each
    sums += [F.sum(F.shiftrightunsigned(f"_h{i // 32}", i % 32).bitwiseAND(F.lit(pair))).alias(f"s{i}") for i in range(SKETCH // 2)]
    total = bits.groupBy(*keys).agg(F.count("_h0").alias("runs"), *sums)
    lane = lambda c: F.coalesce(F.col(c), zero)
    return total.select(
        *keys,
        F.array(*[lane(f"d{k}").bitwiseAND(F.lit(DIGEST_MOD - 1)) for k in range(DIGEST)]).alias("digest"),
        "runs",
        F.array(*[_low(lane(f"s{i}")) for i in range(SKETCH // 2)],
                *[F.shiftrightunsigned(lane(f"s{i}"), 32) for i in range(SKETCH // 2)]).alias("sketch"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint struct (digest, runs, sketch) of a with the paragraphs of b
    inserted (sign 1) or deleted (sign -1)."""
    add = lambda m: lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(m))
    return F.struct(F.zip_with(a["digest"], b["digest"], add(DIGEST_MOD)).alias("digest"),
                    (a["runs"] + F.lit(sign) * b["runs"]).alias("runs"),
                    F.zip_with(a["sketch"], b["sketch"], add(SKETCH_MOD)).alias("sketch"))


def text_form(fp: Column) -> Column:
    """Hex: digest lanes, number of runs, sketch lanes."""
    pad = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    join = lambda a, n: F.array_join(F.transform(a, lambda x: pad(x, n)), "")
    return F.concat(join(fp["digest"], 8), pad(F.pmod(fp["runs"], F.lit(1 << 32)), 8), join(fp["sketch"], 8))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common runs, from two fingerprint structs.

    Lanes are numbers modulo 2^32, lifted to the nearest whole number
    around half of the count, then centred to sums of +-1."""
    half = SKETCH_MOD // 2

    def centred(fp):
        mid = F.floor(fp["runs"] / 2).cast("long")
        return F.transform(fp["sketch"], lambda x: (
            2 * (mid + F.pmod(x - mid + half, F.lit(SKETCH_MOD)) - half) - fp["runs"]).cast("double"))

    ca, cb = centred(a), centred(b)
    den = _dot(ca, ca) + _dot(cb, cb)
    same = (a["digest"] == b["digest"]) & (a["runs"] == b["runs"]) & (a["sketch"] == b["sketch"])
    share = F.when(den > 0, 2 * _dot(ca, cb) / den).otherwise(0.0)
    return F.when(same, 1.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def _range_of(col: str, bounds: list[int]) -> Column:
    """Number of bounds below the value: a binary search in one literal, whose
    steps are a lambda, so that the expression stays small."""
    if not bounds:
        return F.lit(0)
    cut, value = F.lit(bounds).cast("array<long>"), F.col(col)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (value > F.get(cut, at + step - 1)), at + step).otherwise(at))


def with_next(rows: DataFrame, carry: list[str]) -> DataFrame:
    """``rows`` with the key (part, at) of each row and, as ``next_<c>``, the key
    and the columns ``carry`` of the row after it by doc_id (after the last: the
    first).  Rows with equal ids follow by the text's hash, null ids come first.

    Rows are laid out by ranges of doc_id, whose bounds are quantiles (as many as
    shuffle partitions).  Inside a range the next row is a window's; the last
    row of a range takes the first one of the next range from a table
    with one row per range."""
    parts = shuffle_width(rows.sparkSession)
    keyed = rows.withColumn("_o", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    bounds = []
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        got = keyed.agg(F.percentile_approx("_o", at, 20 * parts).alias("b")).first()["b"]
        bounds = sorted(set(got or []))
    keyed = keyed.withColumn("part", _range_of("_o", bounds).cast("int")).withColumn("_h", F.xxhash64("text"))

    lowest = keyed.groupBy("part").agg(F.min("_o").alias("_o"))
    # one row per range, so it can go to all tasks; the texts stay where they are
    heads = materialize(keyed.join(F.broadcast(lowest), ["part", "_o"]).groupBy("part").agg(
        F.min_by(F.struct(*carry), "_h").alias("_first")), "range-heads")
    over_ranges = Window.orderBy("part")   # one row per range
    whole = over_ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.struct(*[F.col(f"_first.{c}").alias(c) for c in carry], F.col("part"), F.lit(1).alias("at"))
    after = (heads.select("part", first.alias("_f"))
             .select("part", F.coalesce(F.lead("_f").over(over_ranges), F.first("_f").over(whole)).alias("_over")))

    w = Window.partitionBy("part").orderBy("_o", "_h")
    inner = keyed.withColumn("at", F.row_number().over(w))
    inner = inner.withColumn("_next", F.lead(F.struct(*carry, "part", "at")).over(w)).join(after, "part")
    n = F.coalesce("_next", "_over")
    return inner.select(*rows.columns, "part", "at", *[n[c].alias(f"next_{c}") for c in (*carry, "part", "at")])


def edited_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, at, next_part, next_at, n_chars, text, edited): the last
    floor(n / 4) code points replaced by the first as many (or all) of the next document."""
    linked = with_next(id_text(docs).withColumn("n_chars", F.length("text").cast("long")), ["text"])
    k = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - k),
                      F.substring("next_text", F.lit(1), k))
    return linked.select("doc_id", "part", "at", "next_part", "next_at", "n_chars", "text", edited.alias("edited"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, runs, sketch) of every text of a table with unique ids."""
    return vectors(id_text(docs), ["doc_id"])


def compare_edits(docs: DataFrame) -> DataFrame:
    """The columns of the registered query: fingerprints of the text and of its
    edited form, and likenesses to the edited text and to the next document."""
    row = ["part", "at", "doc_id", "n_chars", "next_part", "next_at", "sha"]
    e = edited_texts(docs).withColumn("sha", F.sha2("edited", 256))
    # both texts of a row are hashed in the task that holds its range: the
    # sums are keyed by the range too, so nothing is shuffled
    both = e.select(*row, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
                                            F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("v"))
    sums = vectors(both.select(*row, "v.kind", "v.t"), [*row, "kind"], "t")
    fp = F.struct("digest", "runs", "sketch")
    pair = materialize(sums.groupBy(*row).agg(F.max(F.when(F.col("kind") == 0, fp)).alias("own"),
                                              F.max(F.when(F.col("kind") == 1, fp)).alias("edit")), "fingerprints")
    after = pair.select(F.col("part").alias("next_part"), F.col("at").alias("next_at"), F.col("own").alias("after"))
    rows = pair.join(after, ["next_part", "next_at"])
    return rows.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"),
                       text_form(F.col("own")).alias("fingerprint"), text_form(F.col("edit")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("edit")).alias("near_edited"),
                       likeness(F.col("own"), F.col("after")).alias("near_next"))
