"""Benchmark decontamination with a positional inverted index.

Postings are (document, position, term). For every window of test words the two terms with the fewest
postings in the training data are its anchors; only postings of anchors are kept. A posting of an
item's word at item position i votes for the offset-adjusted start (position - i); intersecting the
lists of a window's anchors on document and start leaves the places where its rarest terms stand the right
distance apart. Those places are then compared word by word. Everything is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import LOWER, UPPER, named, stored

WINDOW = 10
ANCHORS = 2
# Words are made of a-z, A-Z, 0-9 and everything beyond ASCII; the other ASCII characters separate them.
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + _SEPARATORS, LOWER + " " * len(_SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _postings(docs: DataFrame) -> DataFrame:
    """One row a word: ``id, mark, position, term``."""
    return docs.select("id", "mark", F.posexplode(words(F.col("text"))).alias("position", "term"))


def _items(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """Distinct items that have words: ``item`` (a number from id and text), ``item_id, ws, last`` (last window start)."""
    ws = words(named(items, text))
    item = F.xxhash64(named(items, item_id), named(items, text))
    return (
        items.select(item.alias("item"), named(items, item_id).cast("string").alias("item_id"), ws.alias("ws"))
        .where(F.size("ws") > 0)
        .dropDuplicates(["item"])
        .withColumn("last", F.greatest(F.size("ws") - window, F.lit(0)))
    )


def index_terms(docs: DataFrame, items: DataFrame) -> DataFrame:
    """How many postings each term of the items has in the documents: ``term, n``."""
    vocabulary = stored(items.select(F.explode("ws").alias("term")).distinct(), "terms")
    return _postings(docs).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def window_anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """``item, start, rare``: the item positions of the rarest terms of each window (ties: the earlier).

    Windows with a term that no document has cannot occur and are left out.
    """
    positions = items.select("item", "last", F.posexplode("ws").alias("at", "term")).join(counts, "term", "left")
    first = F.greatest(F.col("at") - (window - 1), F.lit(0))
    return (
        positions.withColumn("start", F.explode(F.sequence(first, F.least("at", "last"))))
        .groupBy("item", "start")
        .agg(
            F.count_if(F.col("n").isNull()).alias("absent"),
            F.slice(F.array_sort(F.collect_list(F.struct("n", "at"))), 1, anchors).alias("rare"),
        )
        .where("absent = 0")
        .select("item", "start", F.col("rare.at").alias("rare"))
    )


def anchor_places(docs: DataFrame, items: DataFrame, anchors: DataFrame) -> DataFrame:
    """Postings of anchor terms, offset-adjusted: ``id, mark, item, diagonal, at``."""
    terms = items.select("item", F.posexplode("ws").alias("at", "term"))
    wanted = anchors.select("item", F.explode("rare").alias("at")).distinct().join(terms, ["item", "at"])
    return _postings(docs).join(stored(wanted, "anchors"), "term").select(
        "id", "mark", "item", (F.col("position") - F.col("at")).alias("diagonal"), "at"
    )


def phrase_candidates(docs: DataFrame, items: DataFrame, anchors: DataFrame) -> DataFrame:
    """``id, mark, item, diagonal, starts``: windows all of whose anchors meet on one diagonal."""
    by_item = anchors.groupBy("item").agg(
        F.min(F.size("rare")).alias("least"), F.collect_list(F.struct("start", "rare")).alias("windows")
    )
    by_item = stored(by_item, "item-windows")
    met = (
        anchor_places(docs, items, anchors)
        .groupBy("id", "mark", "item", "diagonal")
        .agg(F.collect_set("at").alias("met"))
        .join(by_item.select("item", "least"), "item")
        .where(F.size("met") >= F.col("least"))  # before the wide windows come in: most diagonals hold one chance posting
        .drop("least")
    )
    fit = F.filter(
        "windows",
        lambda w: (w["start"] + F.col("diagonal") >= 0) & (F.size(F.array_except(w["rare"], F.col("met"))) == 0),
    )
    return (
        met.join(by_item, "item")
        .select("id", "mark", "item", "diagonal", fit["start"].alias("starts"))
        .where(F.size("starts") > 0)
    )


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The text with the pair that names it: its id and a hash. Rows that agree in both have one result."""
    body = named(docs, text)
    rest = [named(docs, c) for c in docs.columns if c != text]
    return docs.select(
        F.struct(*rest).alias("row"), F.coalesce(named(docs, doc_id).cast("string"), F.lit("")).alias("id"),
        F.xxhash64(body).alias("mark"), body.alias("text"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Every document with what the benchmark's windows hit in it.

    Returns ``row`` (the document's other columns), ``text, n_words, n_hit`` (words inside an exact occurrence of a
    window), ``items`` (sorted distinct ids, as strings, of items with such a window) and ``starts``
    (sorted word positions at which windows begin). An item shorter than the window is one window. Null and
    wordless texts are hit by nothing; wordless items hit nothing; items without an id hit words but are not
    listed; repeated rows each get the result. The index and the candidates are
    tables; the benchmark's side of a join is broadcast only where Spark finds the stored table small.
    """
    marked = _marked(docs, doc_id, text)
    plain = marked.select("id", "mark", "text")
    items = stored(_items(benchmark, item_id, item_text, window), "items")
    anchors = stored(window_anchors(items, index_terms(plain, items), window), "windows")
    candidates = phrase_candidates(plain, items, anchors).join(items.select("item", "item_id", "ws"), "item")
    places = stored(
        candidates.groupBy("id", "mark").agg(
            F.collect_list(F.struct("item_id", "ws", "diagonal", "starts")).alias("places")
        ),
        "places",
    )
    # Candidates grow with the corpus, so this join is always shuffled; only their texts are cut into words again.
    counted = marked.withColumn("n_words", F.size(words(F.col("text"))))
    joined = counted.join(places.hint("merge"), ["id", "mark"], "left").withColumn(
        "ws", F.when(F.col("places").isNotNull(), words(F.col("text")))
    )

    def length(place: Column) -> Column:
        return F.least(F.size(place["ws"]), F.lit(window))

    def occurring(place: Column) -> Column:
        """Document positions of those windows that are there word by word."""
        there = F.filter(
            place["starts"],
            lambda s: F.slice(F.col("ws"), place["diagonal"] + s + 1, length(place))
            == F.slice(place["ws"], s + 1, length(place)),
        )
        begins = F.transform(there, lambda s: place["diagonal"] + s)
        return F.struct(place["item_id"].alias("item_id"), length(place).alias("length"), begins.alias("begins"))

    exact = F.filter(F.transform("places", occurring), lambda p: F.size(p["begins"]) > 0)
    found = joined.select("row", "text", "n_words", F.coalesce(exact, F.array()).alias("exact"))
    hit = F.flatten(
        F.transform(
            "exact", lambda p: F.flatten(F.transform(p["begins"], lambda b: F.sequence(b, b + p["length"] - 1)))
        )
    )
    ids = F.array_sort(F.array_distinct(F.filter(F.col("exact.item_id"), lambda i: i.isNotNull())))
    return found.select(
        "row", "text", F.col("n_words").cast("long").alias("n_words"), F.size(F.array_distinct(hit)).cast("long").alias("n_hit"),
        ids.alias("items"), F.array_sort(F.array_distinct(F.flatten("exact.begins"))).alias("starts"),
    )


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, slop: int, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Windows whose rarest terms stand near, not just at, their right distance: ``doc_id, item_id, start, gap``.

    ``gap`` is the difference (0 to ``slop``) between the distance of the window's two rarest terms in the document
    and in the item; ``start`` the window's start in the item. Windows of one word match exactly.
    """
    marked = _marked(docs, doc_id, text).select("id", "mark", "text")
    items = stored(_items(benchmark, item_id, item_text, WINDOW), "items")
    anchors = stored(window_anchors(items, index_terms(marked, items)), "windows")
    places = stored(anchor_places(marked, items, anchors), "anchor-places")
    ends = anchors.select(
        "item", "start", F.col("rare")[0].alias("at"), F.coalesce(F.get("rare", F.lit(1)), F.col("rare")[0]).alias("other")
    )
    # buckets as wide as the slop: a near partner lies in the same bucket or the next
    bucket = F.floor(F.col("diagonal") / F.lit(slop + 1))
    left = places.join(ends, ["item", "at"]).select(
        "id", "mark", "item", "start", "other", F.col("diagonal").alias("d1"),
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"),
    )
    right = places.select("id", "mark", "item", F.col("at").alias("other"), F.col("diagonal").alias("d2"), bucket.alias("bucket"))
    gap = F.abs(F.col("d1") - F.col("d2"))
    return (
        left.join(right, ["id", "mark", "item", "other", "bucket"])
        .where(gap <= slop)
        .groupBy(F.col("id").alias("doc_id"), "item", "start")
        .agg(F.min(gap).alias("gap"))
        .join(items.select("item", "item_id"), "item")
        .select("doc_id", "item_id", "start", "gap")
    )
