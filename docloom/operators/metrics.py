"""Token and entity metrics, and audits of tagged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import once
from docloom.operators.spans import IGNORED


def token_accuracy(df: DataFrame, predicted: str = "predicted", labels: str = "labels") -> DataFrame:
    """Share of labelled positions (not IGNORED) where the prediction is right; 0 if there are none."""
    pairs = F.filter(F.arrays_zip(F.col(predicted).alias("p"), F.col(labels).alias("l")), lambda x: x["l"].isNotNull() & (x["l"] != IGNORED))
    counted = df.select(F.size(pairs).alias("n"), F.size(F.filter(pairs, lambda x: x["p"] == x["l"])).alias("hit"))
    return counted.agg(F.coalesce(F.sum("hit") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("token_accuracy"))


def tag_spans(tags: Column) -> Column:
    """(start, end, label) of a tag sequence; an I- that nothing of its label precedes opens a span too."""
    return once(tags, _bound_tag_spans)


def _bound_tag_spans(tags: Column) -> Column:
    n = F.size(tags)
    label = lambda t: F.when(t != "O", F.substring(t, 3, 100))
    opens = lambda i: (F.get(tags, i) != "O") & (F.startswith(F.get(tags, i), F.lit("B-")) | (i == 0) | ~label(F.get(tags, i - 1)).eqNullSafe(label(F.get(tags, i))))
    # a span's last place stands before one that opens another or is outside; so the k-th last place ends the k-th span
    closes = lambda i: (F.get(tags, i) != "O") & ((i == n - 1) | (F.get(tags, i + 1) == "O") | opens(i + 1))
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.zip_with(F.filter(places, opens), F.filter(places, closes), lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end"), label(F.get(tags, a)).alias("label")))


def entity_counts(df: DataFrame, predicted: str, labels: str) -> DataFrame:
    """Per label: true positives, predicted and gold spans, by exact span within a row (no shuffle but the counts')."""
    both = df.select(tag_spans(F.col(predicted)).alias("p"), tag_spans(F.col(labels)).alias("g"))
    marked = both.select(
        F.explode(
            F.concat(
                F.transform(F.array_intersect("p", "g"), lambda s: F.struct(s["label"].alias("label"), F.lit("tp").alias("kind"))),
                F.transform("p", lambda s: F.struct(s["label"].alias("label"), F.lit("predicted").alias("kind"))),
                F.transform("g", lambda s: F.struct(s["label"].alias("label"), F.lit("gold").alias("kind"))),
            )
        ).alias("x")
    )
    count = lambda kind: F.count(F.when(F.col("x.kind") == kind, 1)).alias(kind)
    return marked.groupBy(F.col("x.label").alias("label")).agg(count("tp"), count("predicted"), count("gold"))


def scores(tp: Column, predicted: Column, gold: Column) -> list[Column]:
    p = F.when(predicted > 0, tp / predicted).otherwise(0.0)
    r = F.when(gold > 0, tp / gold).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def entity_f1(df: DataFrame, predicted: str = "predicted", labels: str = "labels") -> DataFrame:
    """Precision, recall, F1 and support per label, and their micro, macro and weighted averages."""
    counts = entity_counts(df, predicted, labels)
    each = counts.select("label", *scores(F.col("tp"), F.col("predicted"), F.col("gold")), F.col("gold").alias("support"))
    micro = counts.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("p"), F.sum("gold").alias("g")).select(F.lit("micro avg").alias("label"), *scores(F.col("tp"), F.col("p"), F.col("g")), F.col("g").alias("support"))
    macro = each.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    weighted = each.agg(mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    return each.unionByName(micro).unionByName(macro).unionByName(weighted)


def audit(df: DataFrame, n_labels: int, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """df with ``error``: null arrays, lengths that differ, or an id out of range (IGNORED is fine)."""
    bad = F.exists(labels, lambda x: (x != IGNORED) & ((x < 0) | (x >= n_labels)))
    error = F.when(F.col(ids).isNull() | F.col(labels).isNull(), "not lists").when(F.size(ids) != F.size(labels), "length mismatch").when(bad, "label out of range")
    return df.withColumn("error", error)


def counted_labels(df: DataFrame, n_labels: int, labels: str = "labels") -> DataFrame:
    """(label, n) over rows of equal lengths; of a row with an id out of range, those before it count."""
    bad = lambda x: (x != IGNORED) & ((x < 0) | (x >= n_labels))
    seen = F.col(labels)
    first = F.array_min(F.filter(F.transform(seen, lambda x, i: F.when(bad(x), i)), lambda i: i.isNotNull()))
    kept = F.when(first.isNull(), seen).otherwise(F.slice(seen, F.lit(1), F.coalesce(first, F.lit(0))))
    return df.select(F.explode(kept).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def tag_histogram(df: DataFrame, tags: str = "tags", least: int = 10) -> DataFrame:
    """(tag, n, rare): counts of tags; B- tags with under ``least`` occurrences are rare."""
    # outer: else the arrays are computed a second time, for a filter on their size
    found = df.select(F.posexplode_outer(tags).alias("pos", "tag")).filter("pos IS NOT NULL")
    counts = found.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rare", F.startswith("tag", F.lit("B-")) & (F.col("n") < least))
