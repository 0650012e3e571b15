"""Order MinHash fingerprints of texts; DataFrame functions only.

A text is a row of words (runs without white space, cut after 16 characters).
Its k-mers are numbered by occurrence, so that a repeated one counts as often as
it stands. Each numbered k-mer has one hash; the leading bits name a register,
and in each register the ``least`` smallest are selected, put back into text
order and hashed as a tuple. So two texts agree in a register if they share its
minimal k-mers in the same order, which tracks edit distance: moved passages
keep a bag's k-mers, but not their order.

A hash is 34 bits, followed by 30 bits of its place in the text. These 64 bits
make one long, so sorting and selecting are done on arrays of longs in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import checkpoint_folder, parts_for, text_bytes

PLACE_BITS, REGISTER_BITS = 30, 6
WORD = r"[^\x20\x09-\x0D]{1,16}"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is made once."""
    return F.transform(F.array(value), use)[0]


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(hashed, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("bigint"))


def _numbered(mers: Column) -> Column:
    """Sorted (hash, place) longs, with the second and later occurrences of a k-mer hashed anew with their number."""
    mask = (1 << PLACE_BITS) - 1
    key = lambda x: F.shiftright(x, PLACE_BITS)

    def renumbered(again: Column) -> Column:
        starts = F.filter(F.transform(again, lambda x, i: F.when((i == 0) | (key(x) != key(F.get(again, i - 1))), i)), lambda i: i.isNotNull())

        def of_run(s: Column) -> Column:
            own = lambda at, j: F.slice(again, at + 1, F.coalesce(F.get(s, j + 1), F.size(again)) - at)
            new = lambda x, o: _packed(F.xxhash64(key(x), (o + 1).cast("bigint")), x.bitwiseAND(F.lit(mask)))
            return F.flatten(F.transform(s, lambda at, j: F.transform(own(at, j), new)))

        return _let(starts, of_run)

    def split(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (i > 0) & (key(x) == key(F.get(s, i - 1))))
        # Most texts have few repeats: only those are renumbered.
        whole = lambda a: F.when(F.size(a) == 0, s).otherwise(F.sort_array(F.concat(F.array_except(s, a), renumbered(a))))
        return _let(again, whole)

    return _let(F.sort_array(mers), split)


def fingerprint(text: Column, *, k: int = 2, least: int = 2) -> Column:
    """Registers of a text as an array of longs (register << 32 | 32 bits), those that have k-mers; empty for a text without words (null, empty)."""
    shift = 64 - REGISTER_BITS
    register = lambda x: F.shiftright(x, shift)
    mask = (1 << PLACE_BITS) - 1

    def mers(words: Column) -> Column:
        each = lambda w, i: _packed(F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]), i)
        # Fewer words than k are one k-mer.
        return F.slice(F.transform(words, each), 1, F.greatest(F.lit(1), F.size(words) - (k - 1)))

    def selected(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < least) | (register(F.get(s, i - least)) != register(x)))

    def signed(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (register(x) != register(F.get(s, i - 1))), i)), lambda i: i.isNotNull())
        # In text order: the place moves to the front.
        turned = lambda x: F.shiftleft(x.bitwiseAND(F.lit(mask)), 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS))
        back = lambda y: y.bitwiseAND(F.lit((1 << (64 - PLACE_BITS)) - 1))
        low = lambda h: h.bitwiseAND(F.lit((1 << 32) - 1))

        def tuple_of(at: Column) -> Column:
            own = F.filter(F.slice(s, at + 1, least), lambda x: register(x) == register(F.get(s, at)))
            ordered = F.transform(F.array_sort(F.transform(own, turned)), back)
            name = F.shiftleft(F.pmod(register(F.get(s, at)), F.lit(1 << REGISTER_BITS)), 32)
            return name.bitwiseOR(low(F.xxhash64(ordered)))

        return F.transform(starts, tuple_of)

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return _let(words, lambda w: _let(_let(_numbered(mers(w)), selected), signed))


def as_text(registers: Column) -> Column:
    """Two hexadecimal digits of the register and eight of its hash, for each that has k-mers."""
    return F.array_join(F.transform(registers, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the registers that either has in which both agree; 1 for two texts without words."""
    names = lambda x: F.transform(x, lambda r: F.shiftright(r, 32))
    n = F.size(F.array_union(names(a), names(b)))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def _bounds(keys: DataFrame, n: int, ranges: int, sampled: int) -> DataFrame:
    """One row: about ``ranges`` bounds from a sample of at most about ``sampled`` keys. They say which task holds a row, not which row is next."""
    share = min(1.0, sampled / max(1, n), 20 * ranges / max(1, n))
    some = sorted(tuple(r) for r in keys.where(F.rand(7) < share).collect())
    return keys.sparkSession.createDataFrame([(some[:: max(1, len(some) // ranges)],)], "bounds array<struct<late:boolean,doc_id:bigint,hash:bigint,row:bigint>>")


def with_next(rows: DataFrame, carried: list[str], *, size: int, range_bytes: int = 16 << 20, most_ranges: int = 1 << 16, sampled: int = 1 << 18) -> DataFrame:
    """Rows (row, doc_id, hash and more) beside ``next_<column>`` of the next one by (doc_id, hash, row), null ids last; after the last comes the first.

    ``rows`` is a written table of about ``size`` bytes whose ``row`` is unique. It
    is dealt once, into ranges of about ``range_bytes`` (``most_ranges`` at most,
    so that the bounds stay small); a range is read in order within its task. A
    range's first row is copied to the end of the range before it, and the very
    first to the end of the last.
    """
    order = ["late", "doc_id", "hash", "row"]
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("doc_id"), "hash", "row")
    least = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows.select(key.alias("key")).select("key.*"), rows.count(), min(most_ranges, parts_for(size, range_bytes, least)), sampled)
    # How many bounds are not above the key, by halving.
    fits = lambda lo, p: (lo + p <= F.size("bounds")) & (F.get("bounds", lo + p - 1) <= F.col("key"))
    halving = F.aggregate(F.array(*[F.lit(1 << p) for p in range(most_ranges.bit_length(), -1, -1)]), F.lit(0), lambda lo, p: F.when(fits(lo, p), lo + p).otherwise(lo))
    ranged = rows.withColumn("key", key).crossJoin(F.broadcast(bounds)).withColumn("range", halving).drop("bounds")
    # One row for each range.
    firsts = ranged.groupBy("range").agg(F.min("key").alias("first"))
    in_order = Window.orderBy("range")
    ends = firsts.select(F.col("first.row").alias("row"), F.coalesce(F.lag("range").over(in_order), F.max("range").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    placed = ranged.join(F.broadcast(ends), "row", "left")
    at = lambda c, turn: F.struct(F.col(c).alias("range"), F.lit(turn).alias("turn"))
    dealt = placed.select("*", F.inline(F.when(F.col("before").isNull(), F.array(at("range", 0))).otherwise(F.array(at("range", 0), at("before", 1)))).alias("held", "turn")).drop("range", "before")
    by = Window.partitionBy("held").orderBy("turn", *[f"key.{c}" for c in order])
    return dealt.select("*", *[F.lead(c).over(by).alias(f"next_{c}") for c in carried]).where("turn = 0").drop("held", "turn", "key")


def fingerprint_edits(docs: DataFrame, *, k: int = 2, least: int = 2) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half (floor of n_chars / 2 code points) is the beginning of the next document.

    ``docs`` has doc_id and text; other columns are ignored. The next document is
    the one with the next doc_id; among rows of one doc_id the order is that of a
    hash of the text (equal rows: any, they are alike), rows without doc_id come
    last, and after the last comes the first, which of a single row is itself. A
    null text is empty. A next document shorter than the half gives all it has.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (ten
    hexadecimal digits for each register that has k-mers), near_edited and
    near_next (see ``likeness``), one row for each row.
    """
    spark, path = docs.sparkSession, f"{checkpoint_folder(docs.sparkSession)}/fingerprints"
    text = F.coalesce("text", F.lit(""))
    # Registers are made once, as an output of explode; a projection would be repeated for each use.
    made = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("hash"), F.length(text).cast("bigint").alias("n_chars"), text.alias("text"), F.explode(F.array(fingerprint(F.col("text"), k=k, least=least))).alias("registers"))
    # Texts stay here once more, so they are written small.
    made.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema("row bigint, doc_id bigint, hash bigint, n_chars bigint, text string, registers array<bigint>").parquet(path)
    both = with_next(rows, ["text", "registers"], size=text_bytes(rows))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    both = both.select("doc_id", "n_chars", "registers", "next_registers", edited.alias("edited"))
    both = both.select("*", F.explode(F.array(fingerprint(F.col("edited"), k=k, least=least))).alias("edited_registers"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("registers")).alias("fingerprint"), as_text(F.col("edited_registers")).alias("edited_fingerprint"),
        likeness(F.col("registers"), F.col("edited_registers")).alias("near_edited"), likeness(F.col("registers"), F.col("next_registers")).alias("near_next"),
    )
