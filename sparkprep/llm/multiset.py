"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a piece between line feeds) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo 2 ** 32. So the order of paragraphs doesn't matter, and a paragraph is inserted or
deleted by adding or subtracting its vector (:func:`add`, :func:`remove`), without the rest of the text.

A vector has ``IDENTITY`` lanes with 32 bits hashed from the whole paragraph each, a lane that counts its pieces, and
64 lanes that count the pieces whose hash has the lane's bit. The identity lanes decide equality. Counts less half of the
pieces are a random projection of the bag of pieces, so the cosine of two fingerprints estimates how much two texts
share, whatever their lengths; likeness is that cosine, at least 0, and 1 for equal fingerprints.

A piece is a word or a few: it ends with a sentence or a separator, with a word of ``LONG`` characters, with the second
of two shorter words, and with every character of a script that is written without spaces. So a text needs no
punctuation to be like its own edit, and short words, which all texts have, stand in pieces with others.

Counting lanes are kept two to a long (bits k and k + 32), so a vector is an array of ``IDENTITY + 1 + 32`` longs. Only
column functions are used.

Defined cases: a null text is the empty text, which is one empty paragraph; a fingerprint without a piece is like
equal ones only; documents are ordered by doc_id, null last, then by a hash of the text; rows that agree in both are one
document, so each of them has the same next document; the only document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let, text_of

IDENTITY = 8
LANES = 32
#: Hashes that a counter of one byte holds, its sign left free.
BYTES = 127
LOW = (1 << 32) - 1
#: A word of so many characters ends a piece.
LONG = 4
_SPACE, _OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_TWO_SHORT = [f"(?<={_SPACE}{_OTHER}{{{i}}}{_SPACE}{_OTHER}{{{j}}}{_SPACE})" for i in range(1, LONG) for j in range(1, LONG)]
#: Where a piece ends inside a paragraph: marks and separators; spaces behind a long word or two short ones; Thai to Lao,
#: Burmese, Khmer, kana and Chinese characters. Lookbehinds have fixed widths, for which regular expressions agree.
SENTENCE = (
    rf"[.!?…。！？।॥؟۔,;:|/、，；：•»]+{_SPACE}*"
    rf"|{_SPACE}(?:(?<={_OTHER}{{{LONG}}}{_SPACE})|{'|'.join(_TWO_SHORT)})"
    rf"|(?<=[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF]){_SPACE}*"
)


def vector(text: Column) -> Column:
    """The fingerprint as an array of longs."""
    paragraphs = F.split(text, "\n", -1)
    pieces = F.transform(F.filter(F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE))), lambda s: s != ""), lambda s: F.xxhash64(s))
    identity = F.aggregate(
        paragraphs,
        F.array(*[F.lit(0).cast("long")] * IDENTITY),
        lambda total, p: F.array(*[(total[i] + F.xxhash64(F.lit(i), p).bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW)) for i in range(IDENTITY)]),
    )
    return let(pieces, lambda hashes: F.concat(identity, F.array(F.size(hashes).cast("long")), bit_counts(hashes)))


def bit_counts(hashes: Column) -> Column:
    """How many hashes have each bit, bits k and k + 32 in one long.

    Hashes are added ``BYTES`` at a time to eight longs of eight counters of one byte, which hold so many without a carry.
    """
    bytes_ = F.lit(0x0101010101010101)
    pair = F.lit(0xFF | 0xFF << 32)

    def added(at: int, some: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast("long"), lambda total, h: total + F.shiftrightunsigned(h, at).bitwiseAND(bytes_))

    blocks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(BYTES)),
        lambda at: let(F.slice(hashes, at, BYTES), lambda some: F.array(*[added(i, some) for i in range(8)])),
    )
    return F.aggregate(
        blocks,
        F.array(*[F.lit(0).cast("long")] * LANES),
        lambda total, block: F.array(*[total[k] + F.shiftrightunsigned(block[k % 8], 8 * (k // 8)).bitwiseAND(pair) for k in range(LANES)]),
    )


def _lanes(x: Column, y: Column, sign: int) -> Column:
    def low(v):
        return v.bitwiseAND(F.lit(LOW))

    def high(v):
        return F.shiftrightunsigned(v, 32)

    return F.zip_with(x, y, lambda a, b: F.shiftleft(low(high(a) + F.lit(sign) * high(b)), 32).bitwiseOR(low(low(a) + F.lit(sign) * low(b))))


def add(whole: Column, part: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return _lanes(whole, part, 1)


def remove(whole: Column, part: Column) -> Column:
    """The fingerprint of ``whole`` without the paragraphs of ``part``."""
    return _lanes(whole, part, -1)


def text_form(vec: Column) -> Column:
    """The fingerprint as lowercase hex digits: 8 for the lanes of identity and the count, 16 for each pair of counts."""
    head = F.transform(F.slice(vec, 1, IDENTITY + 1), lambda v: F.lpad(F.hex(v), 8, "0"))
    rest = F.transform(F.slice(vec, IDENTITY + 2, LANES), lambda v: F.lpad(F.hex(v), 16, "0"))
    return F.lower(F.array_join(F.concat(head, rest), ""))


def likeness(x: Column, y: Column) -> Column:
    """The cosine of the centred counts. Both fingerprints are bound, so that a pushed-down filter works them out once."""

    def lanes(v: Column) -> Column:
        n, rest = F.element_at(v, IDENTITY + 1).cast("double"), F.slice(v, IDENTITY + 2, LANES)
        centred = lambda c: 2 * c.cast("double") - n
        return F.concat(F.transform(rest, lambda c: centred(c.bitwiseAND(F.lit(LOW)))), F.transform(rest, lambda c: centred(F.shiftrightunsigned(c, 32))))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v)

    def compared(v: Column) -> Column:
        size = F.sqrt(dot(v["a"], v["a"])) * F.sqrt(dot(v["b"], v["b"]))
        return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(v["a"], v["b"]) / size)))

    def judged(v: Column) -> Column:
        return F.when(v["x"] == v["y"], 1.0).otherwise(let(F.struct(lanes(v["x"]).alias("a"), lanes(v["y"]).alias("b")), compared))

    return let(F.struct(x.alias("x"), y.alias("y")), judged)


def following(ids: DataFrame) -> DataFrame:
    """For each distinct ``id`` (doc_id, h) with its ``n``, the ``next`` id in ascending order, the first after the last.

    Only ids move. Range partitions are written once; the next of a partition's last id is the first of the partition
    after, from a table with one row for each partition.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.struct(F.col("id.doc_id").isNull().alias("none"), F.col("id.doc_id").alias("doc_id"), F.col("id.h").alias("h"))
    dealt = cut(ids.withColumn("o", order).repartitionByRange(parts, "o").withColumn("part", F.spark_partition_id()))
    firsts = dealt.groupBy("part").agg(F.min("o").alias("o"))
    after = firsts.select("part", F.coalesce(F.lead("o").over(Window.orderBy("part")), F.first("o").over(Window.orderBy("part"))).alias("over"))
    found = dealt.withColumn("lead", F.lead("o").over(Window.partitionBy("part").orderBy("o"))).join(F.broadcast(after), "part")
    then = F.coalesce("lead", "over")
    # a hash is never null; saying so gives both ids one type, so that both joins use one shuffle of the texts
    return found.select("id", "n", F.struct(then["doc_id"].alias("doc_id"), F.coalesce(then["h"], F.lit(0).cast("long")).alias("h")).alias("next"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``."""
    return docs.withColumn("fingerprint", text_form(vector(text_of(text))))


def with_next(docs: DataFrame, edit) -> DataFrame:
    """Every document (``id``, ``text``, ``vec``) with ``head`` and ``next_vec`` of the next one.

    ``edit`` gives from a document's length the code points of the next text that it needs. Texts are shuffled once;
    what moves on to the document before is the head that it needs and the fingerprint.
    """
    text = text_of("text")
    key = F.struct(F.col("doc_id"), F.xxhash64(text).alias("h")).alias("id")
    ids = cut(docs.select(key, F.length(text).alias("n")).groupBy("id").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("rows")))
    rows = docs.select(key, text.alias("text")).withColumn("vec", vector(F.col("text")))
    wants = following(ids.select("id", "n")).select(F.col("next").alias("id"), F.col("id").alias("to"), edit(F.col("n")).alias("k"))
    heads = rows.join(wants, "id").select(F.col("to").alias("id"), F.expr("left(text, k)").alias("head"), F.col("vec").alias("next_vec"))
    if (ids.agg(F.max("rows")).first()[0] or 0) > 1:  # equal rows would each send their head
        heads = heads.dropDuplicates(["id"])
    return rows.join(heads, "id")


def edits(docs: DataFrame) -> DataFrame:
    """The query's digest: each document and its edited text, fingerprinted and compared."""
    found = with_next(docs.select("doc_id", "text"), lambda n: F.floor(n / 4).cast("int"))
    n = F.length("text")
    found = found.withColumn("edited", F.concat(F.left(F.col("text"), (n - F.floor(n / 4)).cast("int")), "head")).withColumn("edited_vec", vector(F.col("edited")))
    return found.select(
        F.col("id.doc_id").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        text_form(F.col("vec")).alias("fingerprint"),
        text_form(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
