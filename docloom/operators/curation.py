"""Corpus curation: quality verdicts, input checks, labels, splits, samples and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.contact import HAS_EMAIL
from docloom.functions.text import MIN_MEANINGFUL_CHARS, SPACE, lines, n_words, once, strip
from docloom.functions.vocabulary import QUALITY_HEADERS

MAX_UPLOAD_BYTES = 10 * 1024 * 1024
PDF_TYPES = ("application/pdf", "application/x-pdf")


_CONSONANT = "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]"
#: Of words of ASCII letters: four consonants and then a fifth, with the rest of the word, or four that are the whole word.
_GARBLED = rf"{_CONSONANT}{{4}}(?:{_CONSONANT}[a-zA-Z]*+|(?![a-zA-Z])(?<![a-zA-Z]{_CONSONANT}{{4}}))"


def n_garbled(text: Column) -> Column:
    """How many words have four or more ASCII letters without a vowel, or five consonants in a row, with other characters left out."""
    return F.regexp_count(F.regexp_replace(text, rf"[^a-zA-Z{SPACE}]+", ""), F.lit(_GARBLED))


def quality_scores(text: Column) -> dict[str, Column]:
    """Measures of a text and the issues they raise."""
    m = _measures(text)
    return {**m, "issues": _issues(*m.values())}


def _measures(text: Column) -> dict[str, Column]:
    """Counts by patterns on the whole text; words get no array of their own."""
    garbled = n_garbled(text) / F.greatest(n_words(text), F.lit(1))
    scramble = once(lines(text), lambda ls: F.size(F.filter(ls, lambda x: F.length(x) > 120)) / F.greatest(F.size(ls), F.lit(1)))
    headers = once(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(h)), h) for h in QUALITY_HEADERS))))
    return {"garbled_ratio": garbled, "headers_found": headers, "has_email": text.rlike(HAS_EMAIL), "text_length": F.length(text), "scramble_ratio": scramble}


def _issues(garbled: Column, headers: Column, has_email: Column, length: Column, scramble: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(garbled > 0.20, "garble"),
            F.when(F.size(headers) < 2, "headers"),
            F.when(~has_email, "email"),
            F.when(length < 300, "short"),
            F.when(scramble > 0.25, "scramble"),
        )
    )


def verdict(issues: Column) -> Column:
    """READY without issues, REVIEW for one mild issue, SKIP for three or a scrambled or short text, else REVIEW."""
    n = F.size(issues)
    worst = F.array_contains(issues, "scramble") | F.array_contains(issues, "short")
    mild = ~F.array_contains(issues, "garble") & ~F.array_contains(issues, "scramble")
    return F.when(n == 0, "READY").when((n == 1) & mild, "REVIEW").when((n >= 3) | worst, "SKIP").otherwise("REVIEW")


def with_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the measures and the verdict; null texts count as empty."""
    # columns of their own: the issues read them again
    measures = _measures(F.coalesce(F.col(text_col), F.lit("")))
    out = df.withColumns(measures).withColumn("issues", _issues(*map(F.col, measures)))
    return out.withColumn("verdict", verdict(F.col("issues")))


def input_error(content_type: Column, seconds: Column, size: Column, parse_error: Column) -> Column:
    """Status of the first check that an upload fails, or null."""
    return (
        F.when(~F.coalesce(content_type, F.lit("")).isin(*PDF_TYPES), 400)
        .when(seconds > 30, 408)
        .when(F.coalesce(size, F.lit(0)) == 0, 400)
        .when(size > MAX_UPLOAD_BYTES, 413)
        .when(parse_error.isNotNull(), 422)
    )


def parser_choice(embedded: Column, second: Column, ocr: Column) -> Column:
    """(text, parser): the embedded text; if weak, the second parser's if longer; if still weak, recognition's if it found any."""
    size = lambda c: F.length(strip(F.coalesce(c, F.lit(""))))
    longer = (size(embedded) < MIN_MEANINGFUL_CHARS) & (size(second) > size(embedded))
    first = F.when(longer, F.struct(second.alias("text"), F.lit("second").alias("parser"))).otherwise(F.struct(F.coalesce(embedded, F.lit("")).alias("text"), F.lit("embedded").alias("parser")))
    recognised = F.struct(ocr.alias("text"), F.lit("ocr").alias("parser"))
    none = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("parser"))
    return F.when(size(first["text"]) >= MIN_MEANINGFUL_CHARS, first).when(F.coalesce(ocr, F.lit("")) != "", recognised).otherwise(none)


def best_pages(candidates: DataFrame, least: int = 20) -> DataFrame:
    """Of (doc_id, page, cfg, text): each page's longest stripped text, the first on ties, if over ``least`` characters."""
    t = strip(F.coalesce(F.col("text"), F.lit("")))
    best = candidates.groupBy("doc_id", "page").agg(F.max_by(F.struct("cfg", t.alias("text")), F.struct(F.length(t), -F.col("cfg"))).alias("b"))
    return best.select("doc_id", "page", F.col("b.cfg").alias("cfg"), F.col("b.text").alias("text")).filter(F.length("text") > least)


def label_slug(label: Column) -> Column:
    """Lower case, without the word resume(s), words joined by underscores."""
    x = F.replace(F.lower(strip(label)), F.lit("_"), F.lit(" "))
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}_])resumes?(?![\p{L}\p{N}_])", "")
    return F.replace(strip(F.regexp_replace(x, rf"[{SPACE}]+", " ")), F.lit(" "), F.lit("_"))


def canonical_labels(df: DataFrame, overrides: dict[str, str], label_col: str = "raw_label") -> DataFrame:
    """df with ``canonical_label``: the override of the raw label, else its slug. Overrides are configuration, a map literal."""
    pairs = [F.lit(x) for pair in sorted(overrides.items()) for x in pair]
    known = F.try_element_at(F.create_map(*pairs), F.col(label_col)) if pairs else F.lit(None).cast("string")
    return df.withColumn("canonical_label", F.coalesce(known, label_slug(F.col(label_col))))


def label_variants(df: DataFrame) -> DataFrame:
    return df.groupBy("canonical_label").agg(F.sort_array(F.collect_set("raw_label")).alias("variants"))


def split_counts(counts: DataFrame, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """(label, n) with n_train, n_val, n_test: half-even shares; two rows or fewer all train; from ten on at least one each."""
    n = F.col("n")
    share = lambda r: F.bround(n * F.lit(r), 0).cast("long")
    least = F.when(n >= 10, 1).otherwise(0)
    v, t = (F.when(n <= 2, 0).otherwise(F.greatest(share(r), least)).cast("long") for r in (val, test))
    return counts.withColumns({"n_val": v, "n_test": t}).withColumn("n_train", n - F.col("n_val") - F.col("n_test"))


def hash_order(key: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random order: engines agree on md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified_split(df: DataFrame, label_col: str, key_col: str, seed: int = 42) -> DataFrame:
    """df with ``split``: within each label, in hash order, first train, then val, then test.

    Ranks come from counts of hash buckets below each row's plus its rank within
    the bucket, so that one label of most rows is still ranked by many tasks.
    """
    order = hash_order(F.col(key_col), seed)
    placed = df.withColumn("_order", order).withColumn("_bucket", F.substring(order, 1, 2))
    sizes = placed.groupBy(label_col, "_bucket").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.withColumn("_before", F.sum("c").over(Window.partitionBy(label_col).orderBy("_bucket")) - F.col("c")).drop("c")
    totals = split_counts(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")))
    inside = Window.partitionBy(label_col, "_bucket").orderBy("_order", key_col)
    ranked = placed.withColumn("_rank", F.row_number().over(inside)).join(before, [label_col, "_bucket"]).join(totals, label_col)
    rank = F.col("_rank") + F.col("_before")
    split = F.when(rank <= F.col("n_train"), "train").when(rank <= F.col("n_train") + F.col("n_val"), "val").otherwise("test")
    return ranked.withColumn("split", split).select(*df.columns, "split")


#: Rows that one task ranks, about; the number of ranges follows the input up to MOST_RANGES.
RANGE_ROWS, MOST_RANGES = 200_000, 512
SAMPLED = 20_000


def range_of(order: Column, cuts: list[str]) -> Column:
    """Number of cuts at or below the order: a binary search in nested conditions."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order < F.lit(cuts[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(cuts))


def global_rank(df: DataFrame, order: Column, tie: str, to: str) -> DataFrame:
    """df with a gapless rank from 1 by (order, tie), without one task that sorts all rows.

    Cuts between ranges of about RANGE_ROWS rows come from a hash sample of about
    SAMPLED orders; each range is ranked by itself and starts after the counts of
    those below. The rank is exact wherever the cuts are.
    """
    placed = df.withColumn("_order", order)
    n = df.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    sample = sorted(r[0] for r in placed.filter(F.pmod(F.xxhash64("_order"), F.lit(max(1, n // SAMPLED))) == 0).select("_order").collect()) if ranges > 1 else []
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    placed = placed.withColumn("_range", range_of(F.col("_order"), cuts))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("_range", (F.sum("c").over(Window.orderBy("_range")) - F.col("c")).alias("_before"))  # a row a range
    inside = Window.partitionBy("_range").orderBy("_order", tie)
    ranked = placed.withColumn(to, F.row_number().over(inside).cast("long")).join(F.broadcast(before), "_range")
    return ranked.withColumn(to, F.col(to) + F.col("_before")).select(*df.columns, to)


def holdout(df: DataFrame, key_col: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with ``split``: the first int(share * n) rows in hash order train, the others are held out."""
    cut = int(df.count() * share)
    ranked = global_rank(df, hash_order(F.col(key_col), seed), key_col, "_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") <= cut, "train").otherwise("val")).select(*df.columns, "split")


def seeded_sample(df: DataFrame, key_col: str, size: int = 150, seed: int = 42) -> DataFrame:
    """The ``size`` rows that come first in hash order (a top-k, not a sort)."""
    return df.orderBy(hash_order(F.col(key_col), seed), key_col).limit(size)


def batches(df: DataFrame, key_col: str, size: int = 50) -> DataFrame:
    """df with ``batch``, from 1: groups of ``size`` rows in the order of a zero-padded key."""
    ranked = global_rank(df, F.lpad(F.col(key_col).cast("string"), 20, "0"), key_col, "_rank")
    return ranked.withColumn("batch", (F.floor((F.col("_rank") - 1) / size) + 1).cast("long")).select(*df.columns, "batch")


def parse_uri(uri: Column) -> list[Column]:
    """Scheme, bucket and prefix (without slashes at its ends) of an object-store address."""
    shape = r"^([a-z0-9]+)://([^/]+)/?(.*)$"
    return [F.regexp_extract(uri, shape, 1).alias("scheme"), F.regexp_extract(uri, shape, 2).alias("bucket"), F.regexp_replace(F.regexp_extract(uri, shape, 3), "^/+|/+$", "").alias("prefix")]


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """One row from (ok, chars, parser, error): the success rate (4 places) and mean characters of successes (1 place)."""
    return rows.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.round(F.avg(F.col("ok").cast("double")), 4).alias("non_empty_text_rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("ok"), F.col("chars"))), F.lit(0.0)), 1).alias("avg_chars_on_success"),
    )


def parser_counts(rows: DataFrame) -> DataFrame:
    """(parser, n) of the successes; a null parser is unknown."""
    return rows.filter("ok").groupBy(F.coalesce("parser", F.lit("unknown")).alias("parser")).agg(F.count(F.lit(1)).alias("n"))


def error_samples(rows: DataFrame, key_col: str, most: int = 8) -> DataFrame:
    """The first failures in the order of a key, with their errors (a report's sample)."""
    return rows.filter("error IS NOT NULL").select(key_col, "error").orderBy(key_col).limit(most)


def top_errors(rows: DataFrame, most: int = 5) -> DataFrame:
    return rows.filter("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(most)

