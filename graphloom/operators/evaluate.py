"""Quality of extraction against labelled data: greedy one-to-one matching in each document, precision, recall and F1.

Predictions and truth are arrays on the row of a document, so matching is an expression without a further shuffle. Its cost grows with
the product of their sizes in one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normalise_name


def _like(a: Column, b: Column) -> Column:
    """Equal, or one holds the other; an empty string is in every string."""
    return F.contains(a, b) | F.contains(b, a)


def names_match(p: Column, t: Column) -> Column:
    """Fuzzy match of normalised names."""
    return _like(p["norm"], t["norm"])


def triples_match(p: Column, t: Column) -> Column:
    """Fuzzy match of both ends, normalised, and of the predicate as it is."""
    return _like(p["subject_norm"], t["subject_norm"]) & _like(p["object_norm"], t["object_norm"]) & _like(p["predicate"], t["predicate"])


def greedy(predictions: Column, truth: Column, match) -> Column:
    """For each prediction, in order, the index from 1 of the first truth that matches and is not taken yet; 0 if none.

    The state has a flag for each truth, so a prediction costs one pass over them.
    """
    start = F.struct(F.transform(truth, lambda t: F.lit(False)).alias("taken"), F.array().cast("array<int>").alias("hits"))

    def step(acc: Column, p: Column) -> Column:
        open_ = F.zip_with(truth, acc["taken"], lambda t, k: ~k & F.coalesce(match(p, t), F.lit(False)))
        first = F.coalesce(F.array_position(open_, True), F.lit(0)).cast("int")
        # A lambda's variable, so that the search is made once.
        return F.transform(F.array(first), lambda hit: F.struct(F.transform(acc["taken"], lambda k, i: k | (i == hit - 1)).alias("taken"), F.concat(acc["hits"], F.array(hit)).alias("hits")))[0]

    return F.aggregate(predictions, start, step, lambda acc: acc["hits"])


def entity_lists(df: DataFrame, prefix: str) -> DataFrame:
    """(doc_id, prefix): per document the first of each name, in order, from (doc_id, ord, name, label) (D5, D6). Rows with a null or empty name or label are skipped."""
    valid = df.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("label", F.lit("")) != ""))
    first = valid.groupBy("doc_id", "name").agg(F.min(F.struct("ord", "label")).alias("f"))
    rows = F.struct(F.col("f.ord").alias("ord"), "name", F.col("f.label").alias("label"), normalise_name(F.col("name")).alias("norm"))
    return first.groupBy("doc_id").agg(F.array_sort(F.collect_list(rows)).alias(prefix))


def relation_lists(df: DataFrame, prefix: str) -> DataFrame:
    """The same for (doc_id, ord, subject, object, predicate), by triple."""
    parts = ["subject", "object", "predicate"]
    valid = df.filter(F.forall(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""))
    first = valid.groupBy("doc_id", *parts).agg(F.min("ord").alias("ord"))
    rows = F.struct("ord", *parts, normalise_name(F.col("subject")).alias("subject_norm"), normalise_name(F.col("object")).alias("object_norm"))
    return first.groupBy("doc_id").agg(F.array_sort(F.collect_list(rows)).alias(prefix))


def _details(docs: DataFrame, predicted: DataFrame, truth: DataFrame, match, extra: str, correct) -> DataFrame:
    none = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    both = docs.select("doc_id").distinct().join(predicted, "doc_id", "left").join(truth, "doc_id", "left")
    both = both.select("doc_id", none(predicted, "predicted").alias("predicted"), none(truth, "truth").alias("truth"))
    both = both.withColumn("hits", greedy(F.col("predicted"), F.col("truth"), match))
    good = F.size(F.filter(F.zip_with("predicted", "hits", lambda p, i: (i > 0) & F.coalesce(correct(p, F.get(F.col("truth"), i - 1)), F.lit(False))), lambda x: x))
    n_hits = F.size(F.filter("hits", lambda i: i > 0))
    missed = F.size("truth") - n_hits
    return both.select(
        "doc_id", "predicted", "truth", "hits",
        F.size("truth").cast("long").alias("n_truth"), F.size("predicted").cast("long").alias("n_predicted"), n_hits.cast("long").alias("n_correct"),
        (F.size("predicted") - n_hits).cast("long").alias("n_wrong"), missed.cast("long").alias("n_missed"), good.cast("long").alias(extra),
    )


def entity_details(docs: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """A row for each document of ``docs`` with its matches and counts (A5); n_type_correct counts matches with fuzzily equal labels."""
    return _details(docs, entity_lists(predicted, "predicted"), entity_lists(truth, "truth"), names_match, "n_type_correct", lambda p, t: _like(p["label"], t["label"]))


def relation_details(docs: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """The same for relations; n_direction_correct counts matches whose two ends are equal once normalised."""
    exact = lambda p, t: (p["subject_norm"] == t["subject_norm"]) & (p["object_norm"] == t["object_norm"])
    return _details(docs, relation_lists(predicted, "predicted"), relation_lists(truth, "truth"), triples_match, "n_direction_correct", exact)


def missed(details: DataFrame) -> DataFrame:
    """(doc_id, truth) for each truth that no prediction took."""
    left = F.filter(F.arrays_zip(F.col("truth"), F.sequence(F.lit(1), F.size("truth")).alias("i")), lambda x: ~F.array_contains(F.col("hits"), x["i"]))
    return details.filter(F.size("truth") > 0).select("doc_id", F.explode(left).alias("x")).select("doc_id", "x.truth")


def metrics(details: DataFrame, extra: str) -> DataFrame:
    """One row: sums over all documents, precision, recall, F1, and the share of matches that are ``extra`` (A2-A4); 0 where a denominator is 0."""
    s = details.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_truth", "n_predicted", "n_correct", extra)))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    s = s.withColumns({"precision": share("n_correct", "n_predicted"), "recall": share("n_correct", "n_truth"), "accuracy": share(extra, "n_correct")})
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
