"""Document fingerprints by consistent weighted sampling, in DataFrame functions.

A text's terms are its words, each weighted by how often it occurs.  For each
of ``samples`` dimensions and each term, hashes of the two give uniform
numbers, and these a shift ``beta`` and two gamma variates ``r`` and ``c`` of
shape 2.  A term of weight ``w`` is sampled at the level
``t = floor(ln(w) / r + beta)`` with ``ln a = ln c - r * (t - beta + 1)``; the
term of least ``a`` is the dimension's sample, known by (term, t).  Two texts
agree in a dimension with a probability equal to the generalised Jaccard
similarity of their weighted terms, so the share of equal samples estimates it.
A sample is kept as 16 bits of its hash (unequal samples look equal once in
65,536); a fingerprint is the samples' bits in hexadecimal.

Words are maximal runs of ASCII letters, ASCII digits and any characters
beyond ASCII, in lower case.  A text without words is one term of its own, so
every text, the empty one too, has a fingerprint, and equal texts have equal
fingerprints.

:func:`neighbour_fingerprints` compares each text with the next one and with
its edited text, whose last half is the next text's beginning.  Rows are cut
into buckets of consecutive ids, one shuffle brings each bucket's rows
together, and the first row of the following bucket is dealt to the bucket as
well, so a window inside the bucket sees every row's successor.  Words,
weights and samples are then worked out where the rows lie, without another
shuffle; only the finished fingerprints are joined to their rows.

The bucket bounds are approximate quantiles of the ids at two levels, at most
a thousand bounds each.  Rows that share an id (or have none) and fill several
buckets are spread over them by the hash of their texts, which is also their
order.  The buckets are dealt to tasks of about ``TASK_BUCKETS`` each, however
many rows there are, as a task holds the words of its buckets in memory.  Null text is empty.  Null ids come after all others.  Repeated rows are
answered row by row.  An empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, stage_table

#: What lies between words, and its complement, for the JVM's patterns, which
#: look single characters of a class up in a table but try its ranges in turn.
_GAPS = "".join(f"\\x{k:02X}" for k in range(128) if not chr(k).isalnum())
GAP, WORD = f"[{_GAPS}]", f"[^{_GAPS}]"
#: Dimensions that share one row while samples are drawn.
WIDTH = 16
BITS = 16
#: Buckets that one task works on.
TASK_BUCKETS = 2


def words(text: Column) -> Column:
    """The words of a text in order, with repeats; empty strings may be among them."""
    return F.split(text, GAP + "+")


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """A uniform number inside (0, 1) from ``bits`` bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / F.lit(float(1 << bits))


def draws(term: Column, dim: Column) -> tuple[Column, Column, Column]:
    """r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), and beta ~ U(0, 1) of a term
    and a dimension."""
    a, b = F.xxhash64(term, dim), F.xxhash64(dim, term)
    r = -F.ln(_uniform(a, 0, 32) * _uniform(a, 32, 32))
    ln_c = F.ln(-F.ln(_uniform(b, 0, 24) * _uniform(b, 24, 24)))
    return r, ln_c, _uniform(b, 48, 16)


def sample(term: Column, dim: Column, ln_weight: Column, r: Column, ln_c: Column, beta: Column) -> Column:
    """One number whose least over a text's terms is the sample: ``ln a`` in
    its high bits, the hash of (term, t) in its low ones."""
    t = F.floor(ln_weight / r + beta)
    ln_a = ln_c - r * (t - beta + F.lit(1.0))
    level = F.floor((ln_a + F.lit(192.0)) * F.lit(float(1 << 36))).cast("long")
    return F.shiftleft(level, BITS).bitwiseOR(F.xxhash64(dim, t, term).bitwiseAND(F.lit((1 << BITS) - 1)))


def signatures(weights: DataFrame, group: str, member: str, samples: int = 64) -> DataFrame:
    """group, member, part, sig: WIDTH samples of every member and part; part p
    holds the dimensions from p * WIDTH on.

    ``weights`` holds ``group``, ``member`` (an int within the group), ``term``
    (long) and ``weight`` (over 0).  A term is drawn once for all members of
    its group in whose texts it has the same weight.  A list of these has no
    more entries than the group has members."""
    if samples % WIDTH:
        raise ValueError(f"samples must be a multiple of {WIDTH}")
    # the term first: where the lists are made by sorting, it tells rows apart at once
    shared = weights.groupBy("term", group, "weight").agg(F.collect_list(member).alias("members"))
    rows = shared.select(group, "term", F.ln(F.col("weight").cast("double")).alias("ln_w"), "members",
                         F.explode_outer(F.sequence(F.lit(0), F.lit(samples // WIDTH - 1))).alias("part"))
    dim = lambda j: F.col("part") * WIDTH + j
    # a lambda keeps this projection out of whole-stage code, where it would be
    # one method too long for the JVM to compile
    apart = F.when(F.exists(F.array("part"), lambda p: p < 0), None).otherwise(F.col("members"))
    sampled = rows.select(group, "part", apart.alias("members"), *[
        sample(F.col("term"), dim(j), F.col("ln_w"), *draws(F.col("term"), dim(j))).alias(f"s{j}") for j in range(WIDTH)])
    each = sampled.select(group, "part", *[f"s{j}" for j in range(WIDTH)], F.explode_outer("members").alias(member))
    least = each.groupBy(group, member, "part").agg(*[F.min(f"s{j}").alias(f"s{j}") for j in range(WIDTH)])
    return least.select(group, member, "part", F.array(*[F.col(f"s{j}").bitwiseAND(F.lit((1 << BITS) - 1)) for j in range(WIDTH)]).alias("sig"))


def _hex(part: Column) -> Column:
    """An array of samples as a string."""
    return F.concat(*[F.lower(F.lpad(F.hex(part[j]), BITS // 4, "0")) for j in range(WIDTH)])


def _same(a: Column, b: Column) -> Column:
    """How many samples of two arrays agree."""
    same = [(a[j] == b[j]).cast("int") for j in range(WIDTH)]
    return sum(same[1:], same[0])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints (strings)."""
    size = BITS // 4
    number = F.floor(F.length(a) / size).cast("int")
    at = lambda s, k: F.substr(s, k * size + 1, F.lit(size))
    return F.size(F.filter(F.sequence(F.lit(0), number - 1), lambda k: at(a, k) == at(b, k))) / number


def _assemble(parts: Column) -> Column:
    """The fingerprint of the structs (part, hex, ...) of one text."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p.hex), "")


def fingerprints(docs: DataFrame, samples: int = 64, bucket_rows: int = 500) -> DataFrame:
    """doc_id, fingerprint of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # whole-row order makes the numbers the same in both uses below
    line = Window.partitionBy("bucket").orderBy(F.asc_nulls_last("doc_id"), "text")
    placed = dealt_by_bucket(*bucketed(rows, bucket_rows)).select("bucket", F.row_number().over(line).alias("member"), "doc_id", "text")
    found = placed.select("bucket", "member", F.explode_outer(_terms(words("text"), F.col("text"))).alias("word"))
    weights = found.where("word <> ''").groupBy("bucket", "member", F.xxhash64(F.lower("word")).alias("term")).agg(F.count("*").alias("weight"))
    parts = signatures(weights, "bucket", "member", samples)
    whole = parts.groupBy("bucket", "member").agg(F.collect_list(F.struct("part", _hex(F.col("sig")).alias("hex"))).alias("parts"))
    return placed.select("bucket", "member", "doc_id").join(whole, ["bucket", "member"]).select("doc_id", _assemble(F.col("parts")).alias("fingerprint"))


def _terms(found: Column, text: Column) -> Column:
    """The words, or where there are none, one term that no word equals."""
    return F.when(F.size(F.array_remove(found, "")) > 0, found).otherwise(F.array(F.concat(F.lit("\x00"), text)))


# --- rows beside their successors ---------------------------------------------

#: Ids in descending order, null last, as ascending numbers.
_PLACE = F.when(F.col("doc_id").isNull(), F.lit((1 << 63) - 1)).otherwise(F.bitwise_not(F.col("doc_id")))
#: Each of two levels has at most so many buckets.
LEVEL = 1000


def _side(place: Column, spread: Column, cuts: Column) -> Column:
    """The number of the range of ``cuts`` (ascending) that a place lies in.
    A place equal to several cuts spreads over the ranges they bound."""
    least = F.size(F.filter(cuts, lambda c: c < place))
    most = F.size(F.filter(cuts, lambda c: c <= place))
    return least + F.floor(spread * (most - least + 1)).cast("int")


def bucketed(docs: DataFrame, bucket_rows: int = 500) -> tuple[DataFrame, int]:
    """doc_id, text, text_hash, bucket: buckets of about ``bucket_rows`` rows in
    descending order of (doc_id, and rising text_hash); and how many there are
    at most, which is never over a million."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select(_PLACE.alias("place"))
    n = ids.count()
    per_level = min(LEVEL, max(1, ceil(sqrt(n / bucket_rows))))
    inner = [k / per_level for k in range(1, per_level)]
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    if not inner:
        return keyed.withColumn("bucket", F.lit(0)), 1
    # at most 999 numbers
    outer_cuts = F.array(*[F.lit(c).cast("long") for c in ids.agg(F.percentile_approx("place", inner).alias("cuts")).first().cuts])
    # in [0, 1), rising with the hash
    spread = (F.col("text_hash") / float(1 << 64) + 0.5) * (1 - 2.0 ** -20)
    by_outer = stage_table(ids.groupBy(_side(F.col("place"), F.lit(0.0), outer_cuts).alias("outer")).agg(
        F.percentile_approx("place", inner).alias("cuts")), "fingerprint-cuts")
    # at most LEVEL rows of LEVEL numbers; an outer range that one id's rows alone fill is not cut further
    placed = keyed.withColumn("outer", _side(_PLACE, spread, outer_cuts)).join(F.broadcast(by_outer), "outer", "left")
    step = F.coalesce(_side(_PLACE, spread, F.col("cuts")), F.lit(0))
    return placed.select("doc_id", "text", "text_hash", (F.col("outer") * per_level + step).alias("bucket")), per_level ** 2


def dealt_by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows in as many partitions as keep each to a few buckets."""
    return rows.repartition(max(parallelism(rows.sparkSession), ceil(buckets / TASK_BUCKETS)), "bucket")


def with_next(docs: DataFrame, bucket_rows: int = 500) -> DataFrame:
    """bucket, seq, guest, doc_id, text, next_text: every row with the text of
    the row that follows it in descending order of ids, the first after the
    last.  Rows with ``guest`` are copies of the next bucket's first row."""
    rows, buckets = bucketed(docs, bucket_rows)
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(_PLACE.alias("place"), F.col("doc_id").isNull().alias("no_id"), "text_hash")).alias("first"))
    every = Window.orderBy("bucket")   # one narrow row per bucket
    back = stage_table(firsts.select(
        "bucket", F.col("first.place").alias("place"), F.col("first.no_id").alias("no_id"), F.col("first.text_hash").alias("text_hash"),
        F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(Window.partitionBy())).alias("guest_of")), "fingerprint-firsts")
    # one row per bucket, so at most a million
    met = rows.withColumn("place", _PLACE).withColumn("no_id", F.col("doc_id").isNull()).join(
        F.broadcast(back), ["bucket", "place", "no_id", "text_hash"], "left")
    own, guest = (F.struct(F.col(c).alias("bucket"), F.lit(g).alias("guest")) for c, g in (("bucket", False), ("guest_of", True)))
    dealt = met.select("doc_id", "text", "text_hash", F.explode_outer(
        F.when(F.col("guest_of").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("to"))
    line = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "text_hash")
    return dealt_by_bucket(dealt.select("to.bucket", "to.guest", "doc_id", "text", "text_hash"), buckets).select(
        "bucket", F.row_number().over(line).alias("seq"), "guest", "doc_id", "text", F.lead("text").over(line).alias("next_text"))


def neighbour_fingerprints(docs: DataFrame, samples: int = 64, bucket_rows: int = 500) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next for every row of ``docs`` (doc_id, text)."""
    rows = with_next(docs, bucket_rows)
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substr("text", F.lit(1), F.length("text") - half)
    beside = rows.select("bucket", "seq", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", kept.alias("kept"),
                         F.concat(kept, F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half)).alias("edited_text"))
    # what the two texts share up to their last whole common word is split once
    tail = F.length(F.regexp_extract(F.reverse("kept"), f"^{WORD}*+", 0))
    shared = F.substr("kept", F.lit(1), F.length("kept") - tail)
    cut = beside.select("bucket", "seq", "text", "edited_text", shared.alias("shared"))
    rest = lambda c: F.substr(c, F.length("shared") + 1)
    both, own, edited = words(F.col("shared")), words(rest(F.col("text"))), words(rest(F.col("edited_text")))
    none = F.size(F.array_remove(both, "")) == 0
    lone = lambda found, text: F.when(none, _terms(found, F.col(text))).otherwise(found)
    lists = cut.select("bucket", "seq", F.array(
        F.struct(F.lit(0).alias("side"), both.alias("words")),
        F.struct(F.lit(1).alias("side"), lone(own, "text").alias("words")),
        F.struct(F.lit(2).alias("side"), lone(edited, "edited_text").alias("words"))).alias("lists"))
    found = lists.select("bucket", "seq", F.explode_outer("lists").alias("one")).select(
        "bucket", "seq", "one.side", F.explode_outer("one.words").alias("word"))
    counts = found.where("word <> ''").groupBy("bucket", "seq", F.xxhash64(F.lower("word")).alias("term")).agg(
        F.count(F.when(F.col("side") != 2, 1)).alias("own"), F.count(F.when(F.col("side") != 1, 1)).alias("edited"))
    # a row's own text is member 2 * seq, its edited text the next
    weights = counts.select("bucket", "term", F.explode_outer(F.array(
        F.struct((F.col("seq") * 2).alias("member"), F.col("own").alias("weight")),
        F.struct((F.col("seq") * 2 + 1).alias("member"), F.col("edited").alias("weight")))).alias("one")).select(
        "bucket", "one.member", "term", "one.weight").where("weight > 0")
    parts = signatures(weights, "bucket", "member", samples)
    line = Window.partitionBy("bucket", "part").orderBy("member")
    compared = parts.select("bucket", "member", "part", "sig", F.lead("sig", 1).over(line).alias("edited"), F.lead("sig", 2).over(line).alias("following"))
    compared = compared.where(F.col("member") % 2 == 0).select("bucket", F.floor(F.col("member") / 2).cast("int").alias("seq"), F.struct(
        "part", _hex(F.col("sig")).alias("hex"), _hex(F.col("edited")).alias("edited_hex"),
        _same(F.col("sig"), F.col("edited")).alias("as_edited"), _same(F.col("sig"), F.col("following")).alias("as_next")).alias("one"))
    # samples / WIDTH short entries per row
    whole = compared.groupBy("bucket", "seq").agg(F.array_sort(F.collect_list("one")).alias("parts"))
    total = lambda name: F.aggregate("parts", F.lit(0), lambda n, p: n + p[name]) / samples
    whole = whole.select("bucket", "seq", total("as_edited").alias("near_edited"), total("as_next").alias("near_next"),
                         F.array_join("parts.hex", "").alias("fingerprint"), F.array_join("parts.edited_hex", "").alias("edited_fingerprint"))
    facts = beside.where("not guest").select("bucket", "seq", "doc_id", "n_chars", "edited_text")
    return facts.join(whole, ["bucket", "seq"]).select(
        "doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
