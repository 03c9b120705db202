"""Document fingerprints from spot signatures: a common word and the content words that follow it.

Every common word is an anchor; its signature is the anchor with the next ``CHAIN`` content words, common
words between them left out. Texts in which nothing but signs, links or menus repeats share
few. The first words of a text form a signature too, so that no text with words is without one.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.staging import shuffle_partitions, staged

CHAIN = 2
# Common words of more than two letters; shorter words are all common. Fixed values.
COMMON = (
    "the and that with for was are this from not have had but were they which will their been has "
    "les des une est que qui dans pour par sur pas avec plus sont aux ont mais "
    "der die das und den von mit ist des sich dem nicht ein eine als auch auf aus bei nach wird "
    "los las del que por con una para como más pero sus este"
)


def _common(word: Column) -> Column:
    return (F.length(word) <= 2) | word.isin(*sorted(set(COMMON.split())))


def with_signatures(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the distinct signatures of a text in ``name``, as ascending 32-bit numbers.

    Words are runs of letters and digits, lower-cased. A null text or one without words has no signature. The
    arrays of words and of places of content words are columns on the way, so that each is made once; the
    anchors that stand before a content word share its chain, and the work is in proportion to the words.
    """
    words, places = f"_words_{name}", f"_places_{name}"
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    rows = df.withColumn(words, F.filter(F.split(plain, " "), lambda w: w != ""))
    w = F.col(words)
    rows = rows.withColumn(places, F.filter(
        F.sequence(F.lit(1), F.size(w) + 1), lambda i: ~F.coalesce(_common(F.try_element_at(w, i.cast("int"))), F.lit(True))))
    p = F.col(places)

    def chain(k: Column) -> list[Column]:
        return [F.element_at(w, F.element_at(p, k + c)) for c in range(CHAIN)]

    def of_anchors(k: Column) -> Column:
        before = F.when(k > 1, F.try_element_at(p, F.greatest(k - 1, F.lit(1)))).otherwise(0)
        anchors = F.array_distinct(F.slice(w, before + 1, F.element_at(p, k) - before - 1))
        return F.transform(anchors, lambda a: F.hash(a, *chain(k)))

    none = F.array().cast("array<int>")
    chains = F.when(F.size(p) >= CHAIN, F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(p) - (CHAIN - 1), F.lit(1))), of_anchors))).otherwise(none)
    head = F.array_join(F.slice(w, 1, 2), " ")
    first = F.when(F.size(w) == 0, none).otherwise(F.array(F.hash(F.lit("^"), head)))
    return rows.withColumn(name, F.sort_array(F.array_distinct(F.concat(chains, first)))).drop(words, places)


def fingerprint(found: Column) -> Column:
    """Signatures as text, eight hexadecimal digits each."""
    digits = F.transform(found, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty ones are alike."""
    together = F.size(a) + F.size(b)
    common = F.size(F.array_intersect(a, b))
    return F.when(together == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        common / (together - common)).cast("double")


def following(ids: DataFrame) -> DataFrame:
    """``doc_id`` and ``next_id`` of distinct ids in descending order; the last is followed by the first.

    Ids are dealt out by range and each range looks at its own rows; what crosses the border of two
    ranges is one row for each.
    """
    n = shuffle_partitions(ids.sparkSession)
    ranged = staged(
        ids.repartitionByRange(n, F.col("doc_id").desc()).withColumn("range", F.spark_partition_id()))
    inner = ranged.selectExpr("doc_id", "range").groupBy("range").agg(
        F.max("doc_id").alias("top"), F.min("doc_id").alias("bottom"))
    # One row for each range: as many as partitions, whatever the table.
    after = inner.select(
        "range", F.expr("coalesce(lead(top) over (order by range), max(top) over ())").alias("beyond"))
    within = ranged.selectExpr("doc_id", "range", "lead(doc_id) over (partition by range order by doc_id desc) as next_id")
    return within.join(F.broadcast(after), "range").select("doc_id", F.coalesce("next_id", "beyond").alias("next_id"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has the last third (rounded down) of the code points replaced by the first as many (or
    all) of the next document's, in descending order of ids. Returns ``doc_id, n_chars, edited_text, signatures,
    edited_signatures, next_signatures``. A null text is empty. Rows that repeat an id all have the next smaller id's
    text as the next one (the least of them if that id repeats too); a row without an id has no next document: an
    empty text stands for it. An empty table gives an empty result.
    """
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    wanted = known.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("most"))
    order = following(wanted)
    needs = order.join(wanted, "doc_id").select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), "most")
    heads = with_signatures(known.join(needs, "doc_id"), F.col("text"), "found").select(
        "for_id", F.struct(F.substring("text", F.lit(1), F.col("most")).alias("head"), "found").alias("next"))
    heads = staged(heads.groupBy("for_id").agg(F.min("next").alias("next")))
    joined = known.join(heads, known.doc_id == heads.for_id, "left").select("doc_id", "text", "next").union(
        docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(heads.schema["next"].dataType)))
    n = F.length("text")
    moved = F.floor(n / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - moved), F.substring(F.coalesce("next.head", F.lit("")), F.lit(1), moved))
    rows = joined.select(
        "doc_id", "text", n.alias("n_chars"), edited.alias("edited_text"),
        F.coalesce("next.found", F.array().cast("array<int>")).alias("next_signatures"))
    rows = with_signatures(with_signatures(rows, F.col("text"), "signatures"), F.col("edited_text"), "edited_signatures")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_text", "signatures", "edited_signatures",
        "next_signatures")


def near_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Pairs ``a < b`` of ids whose signature sets have a Jaccard similarity of ``percent`` or more, and ``likeness``.

    Ids with equal sets stand for each other: a pair names the smallest id of each set; sets are partitioned by
    length so that sets of a wanted similarity lie in the same or neighbouring ones, meet by a rare signature among
    the first of their order, and are compared only if their lengths and places allow the similarity. Rows without an
    id or without words pair with nothing.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = with_signatures(docs, F.col("text"), "found").drop("text")
    sets = staged(
        sets.where("doc_id is not null and size(found) > 0").groupBy("found").agg(F.min("doc_id").alias("doc_id"))
        .withColumn("n", F.size("found")))
    each = sets.select("doc_id", "n", F.explode("found").alias("signature"))
    often = each.groupBy("signature").agg(F.count("*").alias("often"))
    ordered = each.join(often, "signature").groupBy("doc_id", "n").agg(
        F.array_sort(F.collect_list(F.struct("often", "signature"))).alias("order"))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = ordered.select(
        "doc_id", "n", F.posexplode(F.slice("order", F.lit(1), reach.cast("int"))).alias("place", "one")
    ).select("doc_id", "n", "place", F.col("one.signature").alias("signature"),
             F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int").alias("band"))
    probe = prefix.select(
        F.col("doc_id").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"), "signature",
        F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    allowed = (100 + percent) * left >= percent * (F.col("n") + F.col("m"))
    pairs = prefix.join(probe, ["signature", "band"]).where((F.col("doc_id") < F.col("other")) & allowed).select(
        F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct()
    one = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("found").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(
        F.col("likeness") * 100 >= percent)
