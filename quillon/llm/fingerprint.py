"""Homomorphic multiset fingerprints of documents (operator 7). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Salted hashes of a paragraph; each gives two lanes that are summed modulo 2^32.
HASHES = 8
MASK = (1 << 32) - 1
#: Pieces fall into so many classes by their hash modulo that (odd, so that bits stay even within a class); each class
#: has 64 lanes, one for every bit of the hash.
CLASSES = 7
LANES = 64 * CLASSES
#: Sums of lanes during counting: eight lanes of 8 bits in a long (signed, so at most 127 pieces go into one).
ONES, CHUNK = 0x0101010101010101, 127
#: Longs of a fingerprint: strong lanes, bit lanes (two 32-bit counts each), pieces of each class.
STRONG, PACKED = 2 * HASHES, LANES // 2
#: Rows that one range of ids holds, about.
RANGE_ROWS = 1_000


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def with_lanes(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of its column ``text`` (null: empty) as the array of longs ``out``.

    A paragraph's vector has 16 hashed lanes of 32 bits, each pair from a hash under a salt of its own (the salt is what
    the hash starts from, so no lane follows from another), and, summed over its pieces (cut at punctuation before a
    blank), 64 hashed bits and a one in the piece's class. The vectors of all paragraphs are added, all lanes modulo 2^32:
    the order of paragraphs doesn't matter, and ``added`` and ``removed`` change a fingerprint without the text.
    """
    kept, zero = df.columns, F.lit(0).cast("long")
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = F.transform(paragraphs(whole), lambda p: F.array(*[F.xxhash64(F.lit(i), p) for i in range(HASHES)]))
    pieces = F.filter(F.flatten(F.transform(paragraphs(whole), lambda p: F.split(p, r"[.!?;:,|] +", -1))), lambda c: c != "")
    parts = F.transform(pieces, lambda c: F.xxhash64(F.lit(HASHES), c))
    df = df.select(*kept, hashed.alias("__h"), parts.alias("__p"))
    # loops over lanes are lambdas too: trees that list every lane cost each task seconds before its first row
    df = df.select(*kept, "__h", _each(CLASSES, lambda g: F.filter("__p", lambda h: F.pmod(h, F.lit(CLASSES)) == g)).alias("__g"))

    def strong(i: Column) -> Column:
        lane = lambda h: _shifted(F.get(h, _half(i)), 32 * (i % 2)).bitwiseAND(F.lit(MASK))
        return F.aggregate("__h", zero, lambda a, h: (a + lane(h)).bitwiseAND(F.lit(MASK)))

    def summed(chunk: Column) -> Column:
        return _each(8, lambda j: F.aggregate(chunk, zero, lambda a, h: a + _shifted(h, j).bitwiseAND(F.lit(ONES))))

    def chunks(pieces: Column) -> Column:
        n = F.ceil(F.size(pieces) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda k: summed(F.slice(pieces, k * CHUNK + 1, F.lit(CHUNK))))

    df = df.select(*kept, "__h", F.transform("__g", lambda c: F.size(c).cast("long")).alias("__n"), F.transform("__g", chunks).alias("__s"))
    # lanes at bytes 0 to 3 of a sum go with those at bytes 4 to 7, so that each long of the result holds two counts
    cell = lambda c, i: _shifted(F.get(c, F.floor(i / 4).cast("int")), 8 * (i % 4)).bitwiseAND(F.lit(255 | 255 << 32))
    wide = F.flatten(F.transform("__s", lambda s: _each(32, lambda i: F.aggregate(s, zero, lambda a, c: a + cell(c, i)))))
    return df.select(*kept, F.concat(_each(STRONG, strong), wide, "__n").alias(out))


def _each(n: int, of) -> Column:
    """The array of ``of(0)`` to ``of(n - 1)``."""
    return F.transform(F.array(*map(F.lit, range(n))), of)


def _half(i: Column) -> Column:
    return F.floor(i / 2).cast("int")


def _shifted(x: Column, bits: Column) -> Column:
    """``x`` shifted right by a number of bits that is a column."""
    return F.call_function("shiftrightunsigned", x, bits.cast("int"))


def _counts(a: Column, b: Column, sign: int) -> Column:
    """Sums or differences of the two 32-bit counts that each long of a and b holds."""
    low = (a + sign * b).bitwiseAND(F.lit(MASK))
    high = F.shiftrightunsigned(a, 32) + sign * F.shiftrightunsigned(b, 32)
    return low.bitwiseOR(F.shiftleft(high, 32))


def _combined(a: Column, b: Column, sign: int) -> Column:
    zipped = F.arrays_zip(a.alias("a"), b.alias("b"))
    each = lambda x, i: F.when(i < STRONG, (x["a"] + sign * x["b"]).bitwiseAND(F.lit(MASK))).when(i < STRONG + PACKED, _counts(x["a"], x["b"], sign)).otherwise(x["a"] + sign * x["b"])
    return F.transform(zipped, each)


def added(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs."""
    return _combined(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """The fingerprint without paragraphs that it holds."""
    return _combined(a, b, -1)


def as_text(fp: Column) -> Column:
    """Equal for equal multisets of paragraphs: the strong lanes as 128 hexadecimal digits and the number of pieces."""
    strong = F.transform(F.slice(fp, 1, STRONG), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.concat(F.array_join(strong, ""), F.lit(":"), _pieces(fp).cast("string"))


def _pieces(fp: Column) -> Column:
    return F.aggregate(F.slice(fp, STRONG + PACKED + 1, CLASSES), F.lit(0).cast("long"), lambda a, n: a + n)


def _of_classes(each) -> Column:
    """The sum of ``each(class, first long of its counts, how many)``."""
    width = PACKED // CLASSES
    return F.aggregate(F.array(*map(F.lit, range(CLASSES))), F.lit(0.0), lambda acc, g: acc + each(g, g * width + STRONG + 1, F.lit(width)))


def _lanes(x: Column, n: Column) -> tuple[Column, Column]:
    """Both lanes of a long, a one read as +1 and a zero as -1, ``n`` pieces being in the class."""
    return (2 * x.bitwiseAND(F.lit(MASK)) - n).cast("double"), (2 * F.shiftrightunsigned(x, 32) - n).cast("double")


def squared_size(fp: Column) -> Column:
    """64 times the estimated squared size of a fingerprint's multiset of pieces: the sum of its lanes' squares."""

    def of_class(g: Column, start: Column, width: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            low, high = _lanes(x, F.get(fp, g + STRONG + PACKED))
            return acc + low * low + high * high

        return F.aggregate(F.slice(fp, start, width), F.lit(0.0), step)

    return _of_classes(of_class)


def _product(a: Column, b: Column) -> Column:
    """The sum of the products of two fingerprints' lanes."""

    def of_class(g: Column, start: Column, width: Column) -> Column:
        def both(x: Column, y: Column) -> Column:
            (low, high), (low2, high2) = _lanes(x, F.get(a, g + STRONG + PACKED)), _lanes(y, F.get(b, g + STRONG + PACKED))
            return low * low2 + high * high2

        return F.aggregate(F.zip_with(F.slice(a, start, width), F.slice(b, start, width), both), F.lit(0.0), lambda acc, v: acc + v)

    return _of_classes(of_class)


def _likeness(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """``likeness`` from fingerprints and their squared sizes: the squared size of a difference is both less twice the product."""
    n, m = _pieces(a), _pieces(b)
    near = 2 * _product(a, b) / (size_a + size_b)
    return F.when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the common pieces over all pieces, estimated from 448 one-bit lanes (1 if both are empty or equal).

    Read as +1 or -1, a lane's sum squared estimates the squared size of its class of a multiset; so does a difference of
    sums for the difference of two multisets. The classes' estimates add up.
    """
    return _likeness(a, b, squared_size(a), squared_size(b))


def _slots(ids: DataFrame) -> tuple[list[int], list[int], list[int]]:
    """Bounds of id ranges, the number of parts that each range is cut into by a hash of the text, and each range's first slot.

    Ranges are cut at quantiles of the ids. An id so frequent that quantiles meet on it, and the rows without an id, are
    ranges of their own, in as many parts as their rows need. Slots count up in descending order of ids.
    """
    n = ids.count()
    cuts = max(1, min(20_000, n // RANGE_ROWS))
    found = ids.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)] or [0.5], max(10_000, 4 * cuts)).alias("c")).first()["c"] or []
    often = {a for a, b in zip(found, found[1:], strict=False) if a == b}
    bounds = sorted({*found, *(v + 1 for v in often if v < (1 << 63) - 1)})
    sizes = ids.groupBy(_range(F.col("doc_id"), bounds).alias("range")).agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()
    parts = [1] * (len(bounds) + 2)
    for r in sizes:
        if r["a"] == r["b"]:  # one id, or none
            parts[r["range"]] = max(1, r["n"] // RANGE_ROWS)
    first, at = [0] * len(parts), 0
    for r in reversed(range(len(parts))):
        first[r], at = at, at + parts[r]
    return bounds, parts, first


def _range(doc_id: Column, bounds: list[int]) -> Column:
    return F.when(doc_id.isNull(), 0).otherwise(1 + _rank(doc_id, bounds)).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, its squared size, and those of the next document in descending doc_id, then a hash of the text (after the last: the first).

    Rows are dealt to slots of about 1,000 rows up to 20 million rows, beyond which there are 20,000 slots and each grows
    with the rows and is sorted with spilling (the driver gets the cuts and each slot's first row, no texts). The first document of a slot is sent to the slot before it as well, so every slot is done by itself.
    Fingerprints are made behind the exchange, which moves texts only.
    """
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    bounds, parts, first = _slots(docs.select("doc_id"))
    known = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("range") + 1)
    part = F.least(known(parts) - 1, F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * known(parts)))
    placed = docs.withColumns({"range": _range(F.col("doc_id"), bounds), "h": F.xxhash64("text")}).withColumn("slot", (known(first) + part).cast("int"))
    # a slot's first row is the one of greatest id and, where an id fills slots, of the least hash
    tops = placed.groupBy("slot").agg(F.max("doc_id").alias("top"), F.min("h").alias("least") if max(parts) > 1 else F.lit(0).cast("long").alias("least")).collect()
    single = [p > 1 for r in reversed(range(len(parts))) for p in [parts[r]] for _ in range(parts[r])]
    top, least, to = [None] * len(single), [None] * len(single), [None] * len(single)
    there = sorted(r["slot"] for r in tops)
    for r in tops:
        top[r["slot"]], least[r["slot"]] = r["top"], r["least"]
    for i, slot in enumerate(there):
        to[slot] = there[i - 1]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("slot") + 1)
    leads = F.when(of(single, "boolean"), F.col("h") == of(least, "long")).otherwise(F.col("doc_id").eqNullSafe(of(top, "long")))
    spots = F.when(~leads, F.array(F.struct(F.col("slot").alias("r"), F.lit(0).alias("g"))))
    spots = spots.otherwise(F.array(F.struct(F.col("slot").alias("r"), F.lit(0).alias("g")), F.struct(of(to, "int").alias("r"), F.lit(1).alias("g"))))
    dealt = placed.select("doc_id", "text", "h", F.explode(spots).alias("s")).select("doc_id", "text", "h", "s.r", "s.g")
    # a number of partitions keeps adaptive coalescing from putting small tables, whose fingerprints are the work, into one task
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "r")
    down = Window.partitionBy("r").orderBy("g", F.desc_nulls_last("doc_id"), "h", "text")
    made = with_lanes(dealt, "text", "fp").withColumn("size", squared_size(F.col("fp")))
    after = [F.lead(c).over(down).alias(f"next_{c}") for c in ("text", "fp", "size")]
    return made.select("doc_id", "text", "fp", "size", "g", *after).filter("g = 0").drop("g")


def _rank(of: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``of``: first among every w-th, then among the w that follow one."""
    if not bounds:
        return F.lit(0)
    w = max(1, int(len(bounds) ** 0.5))
    below = lambda a: F.size(F.filter(a, lambda b: b <= of))
    block = below(F.array(*map(F.lit, bounds[::w])))
    every = F.array(*map(F.lit, bounds))
    return F.when(block == 0, 0).otherwise((block - 1) * w + below(F.slice(every, F.greatest(F.lit(1), (block - 1) * w + 1), F.lit(w))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in descending doc_id; after the last document comes the first.

    Defined results: null texts are empty; null doc_ids come after all others; rows with the same doc_id follow each
    other by a hash of their text; a lone document is its own next; an empty table gives no rows; other columns are ignored.
    """
    paired = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    paired = with_lanes(paired.select("doc_id", "n_chars", "fp", "size", "next_fp", "next_size", edited.alias("edited")), "edited", "efp")
    near = lambda other, size: _likeness(F.col("fp"), F.col(other), F.col("size"), size)
    return paired.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"), near("efp", squared_size(F.col("efp"))).alias("near_edited"), near("next_fp", F.col("next_size")).alias("near_next"),
    )
