"""Document fingerprints: a canonical exact digest.

The canonical form of a text is its compatibility composition (NFKC), case-folded and composed again, with each run of white space as one
space and none at the ends. Its fingerprint is 128 bits of xxhash in hex: two 64-bit hashes with different seeds. Texts that share a bucket of that
width are compared byte for byte; should different canonical forms ever share one, each but the first (in byte order) gets "-1", "-2" ...
after its digest, so equal fingerprints mean equal canonical forms. Likeness is 1.0 for equal canonical forms, compared byte for byte, else 0.0.

Everything is DataFrame functions; normalisation and folding are static methods of the ICU classes that Spark ships, by ``java_method``.

Each text is folded once and written with its digest; what follows reads that. The next document in falling order of id comes from one shuffle of the
texts: rows are dealt by ranges of ids (borders from quantiles, subdivided evenly), ordered within each range, and the first row of each range is copied to
the end of the range before it. An id with more than a share of the rows (``HOT``), null too, is a range of its own, cut by the texts' hashes; a text
that stands so often with one id is cut by row numbers, its rows being alike.

Defined cases: a null text counts as empty; null ids come last; rows with one id go by a hash of their text, and identical rows in any order,
which shows in no column; a table of one row has itself as next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import DOUBLE, LONG, STRING, durable, schema

#: An id or text is hot that has more than one row in so many.
HOT = 128
#: Ranges of ids at most, and rows that each should hold; the rows of range borders are broadcast.
RANGES, RANGE_ROWS = 1 << 16, 5_000
#: Bytes of bucket keys that may be broadcast.
BROADCAST_BYTES = 4 << 20


def canonical(text: Column) -> Column:
    """NFKC, case folded, composed again, white space folded. ``text`` isn't null."""
    icu = lambda cls, method, x: F.call_function("java_method", F.lit(f"com.ibm.icu.{cls}"), F.lit(method), x, F.lit(True))
    folded = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", text)))
    return F.trim(F.regexp_replace(folded, r"[\s\x1C-\x1F\x85  ]+", " "))


def wide_hash(form: Column, bits: int) -> tuple[Column, Column]:
    """Two hashes; with under 64 bits (for tests) only so many of the first."""
    a, b = F.xxhash64(F.lit(1), form), F.xxhash64(F.lit(2), form)
    return (a, b) if bits >= 64 else (F.pmod(a, F.lit(1 << bits)), F.lit(0).cast(LONG))


def digits(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def with_next(rows: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """rows (doc_id, text, __h: hash of the text, and ``carry``) with next_<column> of text and carry: the next row's in falling order of doc_id, the last's the first's."""
    spark = rows.sparkSession
    n, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    alike = rows.groupBy("doc_id", "__h").agg(F.count("*").alias("n"))
    least = max(RANGE_ROWS, n // HOT)
    # At most ``HOT`` ids, and as many texts, with the pieces that they are cut into.
    ids = {r[0]: -(-r[1] // least) for r in alike.groupBy("doc_id").agg(F.sum("n").alias("n")).filter(F.col("n") > least).collect()}
    same = {(r[0], r[1]): -(-r[2] // least) for r in alike.filter(F.col("n") > least).collect()}
    if low is None:
        rows, borders = rows.withColumn("__range", F.lit(-1).cast(LONG)), []
    else:
        ranges = max(1, min(RANGES, n // RANGE_ROWS))
        coarse = min(ranges, 256)
        got = rows.agg(F.percentile_approx("doc_id", [i / coarse for i in range(1, coarse)], 10_000)).first()[0] if coarse > 1 else []
        borders = sorted({low, *got, *(i for i in ids if i is not None), *(i + 1 for i in ids if i is not None and i < high)})
        ends = [*borders[1:], high + 1]
        fine = -(-ranges // len(borders))

        def tree(i: int, j: int) -> Column:
            if j - i == 1:
                width = max(1, -(-(ends[i] - borders[i]) // fine))
                return F.lit(i * fine).cast(LONG) + F.floor((F.col("doc_id") - F.lit(borders[i])) / F.lit(width)).cast(LONG)
            m = (i + j) // 2
            return F.when(F.col("doc_id") < F.lit(borders[m]), tree(i, m)).otherwise(tree(m, j))

        rows = rows.withColumn("__range", F.when(F.col("doc_id").isNull(), F.lit(-1).cast(LONG)).otherwise(tree(0, len(borders))))
    piece = salt = F.lit(0).cast(LONG)
    for i, k in ids.items():  # hashes in order, cut evenly
        piece = F.when(F.col("doc_id").eqNullSafe(F.lit(i)), F.floor((F.col("__h") / F.lit(2.0**64) + 0.5) * k).cast(LONG)).otherwise(piece)
    for (i, h), k in same.items():
        salt = F.when(F.col("doc_id").eqNullSafe(F.lit(i)) & (F.col("__h") == h), F.pmod(F.monotonically_increasing_id(), F.lit(k))).otherwise(salt)
    rows = rows.withColumns({"__piece": piece, "__salt": salt})
    own = ("__range", "__piece", "__salt")
    # First rows of the ranges: highest id, then lowest hash. A few times ``RANGES`` of them at most.
    firsts = rows.groupBy(*own).agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), -F.shiftright(F.col("__h"), 1), -F.col("__h").bitwiseAND(1))).alias("m")).collect()
    firsts = sorted(((-r[0], r[1], r[2], r[3][0] if r[0] >= 0 else None, -(2 * r[3][1] + r[3][2])) for r in firsts))
    copies = [(-a[0], a[1], a[2], b[3], b[4]) for a, b in zip(firsts, [*firsts[1:], *firsts[:1]], strict=True)]
    heads = spark.createDataFrame(copies, schema(__to0=LONG, __to1=LONG, __to2=LONG, __id=LONG, __hash=LONG))
    # The copied rows, by id and hash: one of those that are alike, for each range that it follows.
    is_head = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("__h"))
    some = rows.drop(*own).join(F.broadcast(heads.select("__id", "__hash").distinct()), is_head, "left_semi").dropDuplicates(["doc_id", "__h"])
    ghosts = some.join(F.broadcast(heads), is_head)
    ghosts = ghosts.withColumns({c: F.col(f"__to{i}") for i, c in enumerate(own)}).drop("__to0", "__to1", "__to2", "__id", "__hash")
    both = rows.withColumn("__ghost", F.lit(False)).unionByName(ghosts.withColumn("__ghost", F.lit(True)))
    order = Window.partitionBy(*own).orderBy("__ghost", F.col("doc_id").desc_nulls_last(), "__h")
    leads = {f"next_{c}": F.lead(c).over(order) for c in ("text", *carry)}
    return both.withColumns(leads).filter(~F.col("__ghost")).drop(*own, "__ghost", "__h")


def whole(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def digested(rows: DataFrame, bits: int = 64) -> DataFrame:
    """``rows`` (text: not null) with __a and __b, the wide hash of the canonical form."""
    a, b = wide_hash(F.col("__form"), bits)
    return rows.withColumn("__form", canonical(F.col("text"))).withColumns({"__a": a, "__b": b}).drop("__form")


def clashes(hashed: DataFrame) -> DataFrame | None:
    """__a, __b, __form and __nth (1, 2, ...) of canonical forms that share a bucket with another and aren't its first; None if there are none.

    Only buckets with more than one row are looked at. Equal forms are combined before they are shuffled, so a hot bucket costs one row a task.
    """
    many = hashed.groupBy("__a", "__b").agg(F.count("*").alias("n")).filter("n > 1").select("__a", "__b")
    many = F.broadcast(many) if many.count() * 16 <= BROADCAST_BYTES else many
    members = hashed.join(many, ["__a", "__b"], "left_semi").select("__a", "__b", canonical(F.col("text")).alias("__form"))
    apart = members.groupBy("__a", "__b").agg(F.min("__form").alias("lo"), F.max("__form").alias("hi")).filter("lo <> hi").select("__a", "__b")
    if apart.isEmpty():
        return None
    distinct = members.join(apart, ["__a", "__b"], "left_semi").distinct()
    nth = F.row_number().over(Window.partitionBy("__a", "__b").orderBy("__form")) - 1
    return distinct.withColumn("__nth", nth).filter("__nth > 0")


def fingerprinted(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, text and fingerprint."""
    hashed = digested(whole(docs), bits)
    extra = clashes(hashed)
    rows = hashed.withColumn("fingerprint", digits(F.col("__a"), F.col("__b")))
    if extra is not None:
        rows = settled(rows.withColumn("__form", canonical(F.col("text"))), extra, "__a", "__b", "__form", "fingerprint")
    return rows.select("doc_id", "text", "fingerprint")


def settled(rows: DataFrame, extra: DataFrame, a: str, b: str, form: str, name: str) -> DataFrame:
    other = extra.select(*(F.col(c).alias(f"__x{i}") for i, c in enumerate(("__a", "__b", "__form", "__nth"))))
    joined = rows.join(other, (F.col(a) == F.col("__x0")) & (F.col(b) == F.col("__x1")) & (F.col(form) == F.col("__x2")), "left")
    return joined.withColumn(name, F.concat(F.col(name), F.coalesce(F.concat(F.lit("-"), F.col("__x3").cast(STRING)), F.lit("")))).drop("__x0", "__x1", "__x2", "__x3")


def compared(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The contract query: each document beside its edited text and the next document."""
    folded = durable(digested(whole(docs), bits).withColumn("__h", F.xxhash64("text")))
    extra = clashes(folded)
    rows = with_next(folded, ("__a", "__b")).withColumn("n_chars", F.length("text").cast(LONG))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.withColumn("__edited_form", canonical(F.col("__edited")))
    a, b = wide_hash(F.col("__edited_form"), bits)
    rows = rows.withColumns({"__ea": a, "__eb": b})
    form, following = canonical(F.col("text")), canonical(F.col("next_text"))
    same = lambda x, y, f: F.when((F.col("__a") == F.col(x)) & (F.col("__b") == F.col(y)), (form == f).cast(DOUBLE)).otherwise(F.lit(0.0))
    rows = rows.withColumns({
        "edited_sha256": F.sha2(F.col("__edited").cast("binary"), 256),
        "fingerprint": digits(F.col("__a"), F.col("__b")),
        "edited_fingerprint": digits(F.col("__ea"), F.col("__eb")),
        "near_edited": same("__ea", "__eb", F.col("__edited_form")),
        "near_next": same("next___a", "next___b", following),
    })
    if extra is not None:
        rows = settled(rows.withColumn("__form", form), extra, "__a", "__b", "__form", "fingerprint")
        rows = settled(rows, extra, "__ea", "__eb", "__edited_form", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2(spark, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
