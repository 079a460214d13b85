"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ranges import Cells
from tessera.llm.common import SPACE, pick

#: A text is read as tokens: words, cut after each TOKEN characters, so that texts without spaces have tokens too.
TOKEN = 4
#: Tokens of a gram, and grams of a window. Equal runs of GRAM + WINDOW - 1 tokens always share a fingerprint.
GRAM, WINDOW = 4, 4
#: Documents of a range, which are ordered together.
RANGE_ROWS = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rotated(x: Column, by: int) -> Column:
    """The 64 bits of x rotated to the left."""
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def gram_hashes(text: Column, gram: int = GRAM) -> Column:
    """The rolling hash of each gram of tokens (cyclic polynomial): hashes of the tokens, rotated by their distance from
    the gram's end and combined by exclusive or, so that a gram's hash is the one before, rotated by one, with one token
    out and one token in. Fewer tokens than a gram make one gram of all of them; no token makes none."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]{{1,{TOKEN}}}"), 0), lambda t: F.xxhash64(t))

    def rolled(x: Column) -> Column:
        def at(i: Column) -> Column:
            out = F.get(x, i + (gram - 1))
            for k in range(gram - 1):
                out = out.bitwiseXOR(rotated(F.get(x, i + k), gram - 1 - k))
            return out

        few = F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(x)))
        return F.when(F.size(x) < gram, few).otherwise(F.transform(F.sequence(F.lit(0), F.size(x) - gram), at))

    return let(tokens, rolled)


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The fingerprints of a text, array<struct<hash, pos>>: of each window of grams the smallest hash, the rightmost of
    equal ones, with the position of its first token; each position once. Fewer grams than a window make one window."""

    def chosen(h: Column) -> Column:
        def place(i: Column) -> Column:
            out = i
            for last in range(1, window):  # the outermost test is that of the rightmost gram
                best = F.get(h, i + last) <= F.get(h, i)
                for k in range(1, last):
                    best = best & (F.get(h, i + last) <= F.get(h, i + k))
                out = F.when(best, i + last).otherwise(out)
            return out

        places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - window, F.lit(0))), place))
        none = F.array().cast("array<struct<hash:bigint,pos:int>>")
        return F.when(F.size(h) == 0, none).otherwise(F.transform(places, lambda p: F.struct(F.get(h, p).alias("hash"), p.cast("int").alias("pos"))))

    return let(gram_hashes(text, gram), chosen)


def hash_set(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def digest(fingerprint: Column) -> Column:
    """A short name of a whole fingerprint, hashes and positions."""
    return F.lower(F.lpad(F.hex(F.xxhash64(fingerprint)), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes as a part of all hashes of two sets; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each whole text. Null and empty texts have no fingerprints; rows that repeat come back
    each; an empty table gives no rows; other columns are ignored."""
    base = pick(docs, doc_id=id_col, text=text_col)
    return base.select("doc_id", winnow(F.coalesce("text", F.lit("")), gram, window).alias("fingerprint"))


def with_next(base: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, W]:
    """The rows (doc_id, text), n_chars, and next_text, the text of the next row in descending order of doc_id (after
    the last: of the first), with the window that orders them; rows with `guard` are to be left out in the end.

    Ids are cut into ranges of about `range_rows` rows; see Cells, which has up to 2 ** 20 of them, with a table of bounded size for
    their splits. Each range also gets the row that follows its last one, which is the first row of the next range. So each
    text is shuffled once, and no task orders all rows. Null ids come last; rows of one id are ordered by a hash of their texts.
    """
    place = F.col("doc_id").cast("double")
    ranges = Cells.of(base.select(place.alias("v")), base.select(F.count("*")).first()[0], range_rows)
    rows = ranges.put(base, place, "range")
    heads = rows.groupBy("range").agg(F.max("doc_id").alias("head"))  # a row for each range
    below = W.orderBy("range")
    heads = heads.select("head", F.coalesce(F.lead("range").over(below), F.min("range").over(W.partitionBy())).alias("to"))
    guards = base.join(F.broadcast(heads), base["doc_id"].eqNullSafe(heads["head"])).select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("guard"))
    order = W.partitionBy("range").orderBy("guard", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    out = rows.withColumn("guard", F.lit(False)).unionByName(guards)
    return out.withColumn("next_text", F.lead("text").over(order)), order


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How well fingerprints tell an edited text and the next document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, hashes (how many the fingerprint has).

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document; see with_next. A null text counts as empty. A single document is its own next one. Rows that repeat come
    back each; an empty table gives no rows; other columns are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows, order = with_next(base)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half)
    edited = F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    marked = rows.select("doc_id", "range", "guard", "n_chars", "text", edited.alias("edited"))
    marked = marked.select("doc_id", "range", "guard", "n_chars", F.xxhash64("text").alias("tie"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow(F.col("text")).alias("own"), winnow(F.col("edited")).alias("other"))
    sets = marked.select("doc_id", "range", "guard", "tie", "n_chars", "edited_sha256", digest(F.col("own")).alias("fingerprint"), digest(F.col("other")).alias("edited_fingerprint"), hash_set(F.col("own")).alias("a"), hash_set(F.col("other")).alias("b"))
    again = W.partitionBy("range").orderBy("guard", F.col("doc_id").desc_nulls_last(), "tie")
    near = sets.withColumn("next", F.lead("a").over(again)).where("not guard")
    return near.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), F.coalesce(likeness(F.col("a"), F.col("next")), F.lit(0.0)).alias("near_next"), F.size("a").alias("hashes"))
