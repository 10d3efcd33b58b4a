"""Document fingerprints by SpotSigs, in DataFrame functions only.

A signature is a common word (the anchor) and the chain of up to CHAIN content words that follow it
before the next anchor; other common words are passed over. A text's fingerprint is its set of
signatures. Two sets are compared by Jaccard similarity; likeness() can partition them by length, so that
sets of partitions that aren't neighbours can't reach FLOOR and are not compared. near_edited and near_next
are exact at any length. A join of all documents within and across length partitions is not built.

Anchors are common words of four languages; a text without any that a content word follows (such as one in
another script) has as anchors the words that a hash draws, one of DRAWN.

Defined results: a null text counts as the empty text; a text without a signature of either kind has one that
is made of all its words, so equal texts are always alike; very long texts are fingerprinted whole; repeated rows
give repeated results; ties of the id are ordered by the text; a null id comes after all others; other
columns are not read.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Content words of a chain, the least likeness that set lengths must allow, and of how many words one is drawn as an anchor.
CHAIN, FLOOR, DRAWN = 3, 0.1, 4

#: Anchors, and common words that chains pass over (English, German, French, Spanish).
ANCHORS = "a the is was der die das ist le la les une est el los las una es que".split()
COMMON = (
    "of and to in that for it on with be as by this are at from not or an have had he she they we you "
    "und in den von zu sich mit auf des für nicht im dem ein eine als auch an aus bei nach "
    "de et des en un du pour qui dans par pas au sur avec ce il sont plus "
    "y se del por no con su para al lo como más o pero"
).split()
_MARK = "\x01"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The set of signatures of a text, as sorted 64-bit hashes."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    passed = ["", *sorted(set(COMMON) - set(ANCHORS))]

    def pieces(marked: Column) -> Column:
        # Each piece after the first is an anchor and what follows it up to the next.
        return F.split(F.concat(F.lit(" "), F.array_join(F.array_remove(marked, ""), " ")), f" {_MARK}", -1)

    def chains(pieces: Column) -> Column:
        return F.filter(F.slice(pieces, 2, F.size(pieces)), lambda p: p.contains(" "))

    def bound(value: Column, *steps) -> Column:
        # A lambda's variable is evaluated once, however often it is used.
        held = F.array(value)
        for step in steps:
            held = F.transform(held, step)
        return F.get(held, F.lit(0))

    def hashed(found: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.xxhash64(F.substring_index(p, " ", chain + 1)))))

    def marked(w: Column) -> Column:
        return F.when(w.isin(passed), "").when(w.isin(ANCHORS), F.concat(F.lit(_MARK), w)).otherwise(w)

    def drawn(w: Column) -> Column:
        return F.when((w != "") & (F.pmod(F.xxhash64(w), F.lit(DRAWN)) == 0), F.concat(F.lit(_MARK), w)).otherwise(w)

    # Texts in other languages have no common words that are known: their anchors are drawn by a hash of the word.
    alone = F.array(F.xxhash64(F.array_join(F.array_remove(words, ""), " ")))
    other = bound(pieces(F.transform(words, drawn)), chains, lambda found: F.when(F.size(found) > 0, hashed(found)).otherwise(alone))
    return bound(pieces(F.transform(words, marked)), chains, lambda found: F.when(F.size(found) > 0, hashed(found)).otherwise(other))


def fingerprint(signs: Column) -> Column:
    """A short name of a set of signatures: its length and a digest."""
    return F.concat_ws(":", F.size(signs), F.sha2(F.array_join(signs, ","), 256))


def partition(signs: Column, floor: float = FLOOR) -> Column:
    """The partition of a set's length: sets of partitions 2 or more apart are less than `floor` alike."""
    return F.floor(F.log(F.size(signs).cast("double")) / F.log(F.lit(1 / floor)))


def likeness(a: Column, b: Column, floor: float | None = FLOOR) -> Column:
    """Jaccard similarity of two sets; 0 without comparing them where their lengths rule `floor` out (None: always exact)."""
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    if floor is None:
        return exact
    return F.when(F.abs(partition(a, floor) - partition(b, floor)) > 1, F.lit(0.0)).when(F.least(F.size(a), F.size(b)) < floor * F.greatest(F.size(a), F.size(b)), F.lit(0.0)).otherwise(exact)


def with_next(rows: DataFrame, key: str, text: str, columns: tuple[str, ...]) -> DataFrame:
    """Add next_<column>: the values of the next row by descending key; after the last comes the first.

    Rows go to ranges of the key (bounds from a quantile sketch), and a copy of each range's first row to
    the range before it, so a window over a range knows what follows. One shuffle; the driver sees one id
    and one number a range.
    """
    n = partitions(rows.sparkSession)
    bounds = rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    bounds = sorted(set(bounds or []))
    # Ranges are numbered downwards in the key; a null key is in the last.
    at = F.lit(0)
    for k, bound in enumerate(reversed(bounds)):
        at = F.when(F.coalesce(F.col(key) < bound, F.lit(True)), F.lit(k + 1)).otherwise(at)
    ranged = rows.withColumn("__range", at)
    firsts = sorted((r["__range"], r["first"]) for r in ranged.groupBy("__range").agg(F.max(key).alias("first")).collect())
    if not firsts:
        return ranged.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("__range")
    homes = [*((a[0], b[1]) for a, b in pairwise(firsts)), (firsts[-1][0], firsts[0][1])]
    ids = [i for _, i in homes if i is not None]
    wanted = F.col(key).isin(ids) if ids else F.lit(False)
    if len(ids) < len(homes):
        wanted = wanted | F.col(key).isNull()
    least = F.min(F.struct(text, *[c for c in columns if c != text])).alias("r")
    copies = rows.where(wanted).groupBy(key).agg(least)
    home = F.lit(None).cast("int")
    for r, i in homes:
        home = F.when(F.col(key).eqNullSafe(F.lit(i)), F.lit(r)).otherwise(home)
    copies = copies.select(key, *[F.col(f"r.{c}").alias(c) for c in columns], home.alias("__range"), F.lit(True).alias("__copy"))
    order = Window.partitionBy("__range").orderBy("__copy", F.col(key).desc_nulls_last(), text)
    joined = ranged.withColumn("__copy", F.lit(False)).unionByName(copies, allowMissingColumns=True)
    return joined.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(~F.col("__copy")).drop("__range", "__copy")


def edited_and_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: `key`, n_chars, edited text, signs, edited_signs, near_edited, near_next.

    The edited text has its second half replaced by as much of the beginning of the next document.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("id"), whole.alias("body"), F.length(whole).cast("bigint").alias("n_chars"))
    rows = with_next(rows.withColumn("signs", signatures(F.col("body"))), "id", "body", ("body", "signs"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_body", F.lit(1), half))
    rows = rows.select("id", "n_chars", edited.alias("edited"), "signs", "next_signs").withColumn("edited_signs", signatures(F.col("edited")))
    return rows.select(F.col("id").alias(key), "n_chars", "edited", "signs", "edited_signs", likeness(F.col("signs"), F.col("edited_signs"), None).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs"), None).alias("near_next"))
