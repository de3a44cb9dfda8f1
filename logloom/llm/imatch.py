"""I-Match fingerprints, with DataFrame functions only.

A text's terms are its runs of letters in lower case, each told by ``DIGITS`` hexadecimal digits of its digest. Terms are
counted by documents; the lexicon is the terms whose share of documents lies in a band (inverse document frequency
neither too low nor too high). As each of its terms is in one of ``RARE`` documents at least, it has at most ``RARE`` times as many
terms as a document has on average, whatever the corpus, so it can be part of every task and no term of a text is
shuffled for a look-up. Of a text's distinct terms those in the lexicon are kept and sorted by their digests; each of
the randomised lexicon subsets keeps the terms whose digest is below a bound at one place, and hashes them together.
The fingerprint is the row of these hashes; a subset without terms leaves its place empty.

Likeness is the share of equal places among those that are not empty on both sides; it is 1 for equal
fingerprints. A text without lexicon terms is fingerprinted by all its terms at once, so two such texts
are alike only if their terms are equal.

Defined results: null is an empty text; texts without letters share one fingerprint. Rows of equal id and
text are one place in the order of documents and have one result each. A null id is ordered before all.
With one document, its next document is itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import checkpointed, no_text, salted_join
from logloom.operators.indexing import with_order_index

#: Hexadecimal digits that tell terms apart, and how many of a hash of them name a line of the lexicon's table.
DIGITS, LINE = 15, 4
#: Least and greatest share of documents of a lexicon term, as one in so many, and the least number of documents.
RARE, COMMON, LEAST_DOCS = 1000, 10, 2
#: Of each lexicon subset: bound of two hexadecimal digits, that is its share of the terms. Place k starts at digit k + 1.
SUBSETS = ("80",) * 2 + ("40",) * 4 + ("10",) * 6 + ("04",) * 9 + ("01",) * 9
#: What is somewhere in the digits of a bound's places if a term is in one of its subsets at all. Most terms lack it, so they are
#: looked at once for all subsets of the bound; the other bounds take too many of the terms for that.
SHOWN = {"10": "0", "04": "0[0-3]", "01": "00"}


def digests(text: Column) -> Column:
    """Digests of the distinct terms of a text."""
    terms = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != ""))
    return F.transform(terms, lambda t: F.md5(t.cast("binary")))


def _line(term: Column) -> Column:
    """The line of the lexicon's table that a term's digits belong to."""
    return F.shiftrightunsigned(F.xxhash64(term), 64 - 4 * LINE).cast("int")


def lexicon(docs: DataFrame, text: str = "text", rare: int = RARE, common: int = COMMON) -> list[str]:
    """The lexicon as a table: a line holds the digits, with commas between, of the terms that belong to it.

    Terms are counted as numbers, which take half the room of their digits in the shuffle.
    """
    terms = F.array_distinct(F.transform(digests(no_text(text)), lambda d: F.conv(F.substring(d, 1, DIGITS), 16, 10).cast("long")))
    counted = docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    total = docs.count()
    kept = counted.where((F.col("docs") >= max(LEAST_DOCS, -(-total // rare))) & (F.col("docs") <= total // common))
    kept = kept.select(F.lpad(F.lower(F.hex("term")), DIGITS, "0").alias("term"))
    lines = kept.groupBy(_line(F.col("term")).alias("line")).agg(F.array_join(F.sort_array(F.collect_list("term")), ",").alias("terms"))
    table = [""] * 16**LINE
    for row in lines.collect():  # bounded as the lexicon is
        table[row["line"]] = row["terms"]
    return table


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_subsets(known: Column) -> Column:
    """Of each lexicon subset the terms that are in it, in their order."""

    def below(bound: str, k: int) -> Callable[[Column], Column]:
        return lambda d: F.substring(d, k + 1, 2) < bound

    def of(bound: str, places: list[int]) -> Callable[[Column], Column]:
        return lambda some: F.array(*[F.filter(some, below(bound, k)) for k in places])

    def shown(bound: str, places: list[int]) -> Callable[[Column], Column]:
        digits, what = lambda d: F.substring(d, places[0] + 1, len(places) + 1), SHOWN[bound]
        return (lambda d: F.contains(digits(d), F.lit(what))) if what.isdigit() else (lambda d: F.rlike(digits(d), F.lit(what)))

    groups = [(bound, list(places)) for bound, places in groupby(range(len(SUBSETS)), SUBSETS.__getitem__)]
    return F.concat(*[_let(F.filter(known, shown(*g)), of(*g)) if g[0] in SHOWN else of(*g)(known) for g in groups])


def parts(text: Column, table: list[str]) -> Column:
    """The hashes of the lexicon subsets, or one of all terms if none is in the lexicon."""
    lines = F.split(F.lit("|".join(table)), r"\|")
    # All terms have as many digits, so these are found in a line only as one of its terms.
    inside = lambda d: F.contains(F.get(lines, _line(F.substring(d, 1, DIGITS))), F.substring(d, 1, DIGITS))
    one = lambda some: F.when(F.size(some) > 0, F.substring(F.md5(F.array_join(some, "").cast("binary")), 1, 8)).otherwise("")
    whole = lambda all_: F.array(F.concat(F.lit("*"), F.md5(F.array_join(F.sort_array(all_), "").cast("binary"))))
    found = lambda all_: F.struct(all_.alias("all"), F.sort_array(F.filter(all_, inside)).alias("known"))
    return _let(_let(digests(text), found), lambda f: F.when(F.size(f["known"]) > 0, F.transform(_in_subsets(f["known"]), one)).otherwise(whole(f["all"])))


def written(found: Column) -> Column:
    return F.array_join(found, "-")


def likeness(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != "")), lambda v: v))
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit("")) != "") | (F.coalesce(y, F.lit("")) != "")), lambda v: v))
    return F.when(a == b, 1.0).otherwise(same / F.greatest(used, F.lit(1))).cast("double")


def _key(doc_id: str, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.xxhash64(text))


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = RARE, common: int = COMMON) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of next lower id, after the last the first; the edited text has its last
    half replaced by the next document's beginning.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), no_text(text).alias("text"))
    keyed = rows.withColumn("key", _key("doc_id", F.col("text")))
    ids = keyed.select("doc_id", "key", F.length("text").alias("n")).groupBy("doc_id", "key", "n").agg(F.count(F.lit(1)).alias("times"))
    order = checkpointed(with_order_index(ids, ["doc_id", "key"], name="at"))
    total = order.count()
    half = F.floor(F.col("n") / 2).cast("int")
    after = order.select(F.pmod(F.col("at") - 1, F.lit(total)).alias("at"), F.col("key").alias("before_key"), half.alias("before_half"))
    places = checkpointed(order.join(after, "at").select("doc_id", "key", "times", "at", "before_key", "before_half"))
    one = Window.partitionBy("key").orderBy("key")
    # Repeated rows go before the shuffle. Only the key and the text of a document are shuffled, so both uses below share one exchange.
    texts = keyed.select("key", "text").withColumn("nth", F.row_number().over(one)).where("nth = 1").join(places, "key")
    tails = texts.select(F.col("before_key").alias("key"), F.expr("substring(text, 1, before_half)").alias("tail"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 2) AS INT))"), F.col("tail"))
    pairs = texts.join(tails, "key").select("doc_id", "at", "times", "text", edited.alias("edited"))
    table = lexicon(rows, rare=rare, common=common)
    # Fingerprints go on as they are written, digests as bytes and documents by their place: less than half of what arrays and keys take.
    prints = checkpointed(
        pairs.select(
            "doc_id", "at", "times", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("digest"),
            written(parts(F.col("text"), table)).alias("own"), written(parts(F.col("edited"), table)).alias("other"),
        )
    )
    following = prints.select(F.pmod(F.col("at") + 1, F.lit(total)).alias("at"), F.col("own").alias("next"))
    found = prints.join(following, "at").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    own, other, after_it = (F.split(name, "-") for name in ("own", "other", "next"))
    return found.select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), F.col("own").alias("fingerprint"), F.col("other").alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, after_it).alias("near_next"),
    )
