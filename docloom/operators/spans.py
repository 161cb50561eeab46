"""Labelled spans and token tags. One row a document, with arrays; folds keep the order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import WORD, once, replaced, strip, words
from docloom.functions.vocabulary import ENTITY_LABELS

#: Defaults of the score filter.
DOC_PEAK_MIN, ABSOLUTE_FLOOR, RELATIVE_TO_PEAK = 0.20, 0.17, 0.50
IGNORED = -100
ENTITY = "struct<text:string,label:string,score:double>"
SPAN = "struct<start:int,end:int,label:string>"


def peak_of(tokens: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(tokens, lambda t: t["score"])), F.lit(0.0))


def above_peak(items: Column, peak: Column, peak_min: float = DOC_PEAK_MIN, floor: float = ABSOLUTE_FLOOR, relative: float = RELATIVE_TO_PEAK) -> Column:
    """Nothing if the document's peak is low, else items with a score that reaches the floor or the share of the peak."""
    least = F.when(peak >= peak_min, F.greatest(F.lit(floor), relative * peak))
    return once(least, lambda low: F.filter(items, lambda t: F.coalesce(t["score"] >= low, F.lit(False))))


def group_entities(tokens: Column) -> Column:
    """Spans of array<struct<entity, score, word>>.

    B- opens a span; I- of the same label extends it (a space before the word
    unless it begins with an apostrophe, the score becomes the mean of old and
    new); I- of another label is passed over; any other tag closes.
    """
    none = F.lit(None).cast(ENTITY)
    start = F.struct(F.array().cast(f"array<{ENTITY}>").alias("out"), none.alias("open"))

    def step(s: Column, t: Column) -> Column:
        label, word = F.substring(t["entity"], 3, 100), F.replace(t["word"], F.lit("##"), F.lit(""))
        begins, inside = F.startswith(t["entity"], F.lit("B-")), F.startswith(t["entity"], F.lit("I-")) & s["open"].isNotNull()
        fresh = F.struct(word.alias("text"), label.alias("label"), t["score"].alias("score"))
        joined = F.concat(s["open"]["text"], F.when(F.startswith(word, F.lit("'")), "").otherwise(" "), word)
        longer = F.struct(joined.alias("text"), s["open"]["label"].alias("label"), ((s["open"]["score"] + t["score"]) / 2).alias("score"))
        out = F.when(s["open"].isNotNull() & (begins | ~inside), F.array_append(s["out"], s["open"])).otherwise(s["out"])
        now = F.when(begins, fresh).when(inside & (label == s["open"]["label"]), longer).when(inside, s["open"])
        return F.struct(out.alias("out"), now.alias("open"))

    return F.aggregate(tokens, start, step, lambda s: F.when(s["open"].isNotNull(), F.array_append(s["out"], s["open"])).otherwise(s["out"]))


def texts_of(entities: Column, label: str) -> Column:
    """Distinct stripped texts of a label's spans, in order."""
    own = F.transform(F.filter(entities, lambda e: e["label"] == label), lambda e: strip(e["text"]))
    return F.array_distinct(F.filter(own, lambda t: t != ""))


def span_confidence(entities: Column) -> Column:
    """Mean score of the spans of the four labels that make a profile; 0.45 if there are none."""
    own = F.transform(F.filter(entities, lambda e: e["label"].isin("NAME", "SKILL", "EDUCATION", "EXPERIENCE")), lambda e: e["score"])
    return once(own, lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)).otherwise(0.45))


def entities_by_label(entities: Column) -> Column:
    """Name, skills, education, experience and confidence from spans."""
    return once(entities, _entities_by_label)


def _entities_by_label(entities: Column) -> Column:
    names = F.filter(entities, lambda e: e["label"] == "NAME")
    return F.struct(
        F.nullif(strip(F.get(names, F.lit(0))["text"]), F.lit("")).alias("name"),
        texts_of(entities, "SKILL").alias("skills"),
        texts_of(entities, "EDUCATION").alias("education"),
        texts_of(entities, "EXPERIENCE").alias("experience"),
        span_confidence(entities).alias("confidence"),
    )


def ner_entities(tokens: Column) -> Column:
    """Filter by the tokens' peak, group, filter the spans by the same peak."""
    return once(tokens, lambda t: above_peak(group_entities(above_peak(t, peak_of(t))), peak_of(t)))


def trimmed(text: Column, span: Column) -> Column:
    """The span without trailing characters that are no letters or digits."""
    part = F.substring(text, span["start"] + 1, span["end"] - span["start"])
    return F.struct(span["start"].alias("start"), (span["start"] + F.length(F.regexp_replace(part, r"[^\p{L}\p{N}]+$", ""))).cast("int").alias("end"), span["label"].alias("label"))


def resolve_overlaps(spans: Column) -> Column:
    """Spans by start, the longer first; each is kept if it begins at or after the end of the last kept one."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("shorter"), s["label"].alias("label"))))
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("out"), F.lit(None).cast("int").alias("last"))

    def step(state: Column, s: Column) -> Column:
        end = s["start"] - s["shorter"]
        keep = state["last"].isNull() | (s["start"] >= state["last"])
        span = F.struct(s["start"].alias("start"), end.alias("end"), s["label"].alias("label"))
        return F.struct(F.when(keep, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"), F.when(keep, end).otherwise(state["last"]).alias("last"))

    return F.aggregate(keyed, start, step, lambda s: s["out"])


def annotated_spans(tasks: DataFrame) -> DataFrame:
    """(id, text, spans) of annotation tasks: results of kind "labels" with a known label, of annotations not cancelled.

    Tasks with blank texts or without annotations go. Spans are trimmed,
    emptied ones dropped, overlaps resolved.
    """
    live = F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    results = F.flatten(F.transform(live, lambda a: a["result"]))
    good = F.filter(results, lambda r: (r["type"] == "labels") & F.get(r["value"]["labels"], F.lit(0)).isin(*ENTITY_LABELS, "O"))
    text = F.col("data.text")
    spans = F.transform(good, lambda r: F.struct(r["value"]["start"].alias("start"), r["value"]["end"].alias("end"), F.get(r["value"]["labels"], F.lit(0)).alias("label")))
    kept = F.filter(F.transform(spans, lambda s: trimmed(text, s)), lambda s: s["end"] > s["start"])
    return tasks.filter((strip(text) != "") & (F.size("annotations") > 0)).select("id", text.alias("text"), resolve_overlaps(kept).alias("spans"))


def bio_tags(labels: Column) -> Column:
    """Tags of token labels (null: outside): B- where the label differs from the one before, else I-."""
    return once(labels, _bio_tags)


def _bio_tags(labels: Column) -> Column:
    """bio_tags of labels that are bound."""

    def tag(x: Column, i: Column) -> Column:
        same = (i > 0) & F.get(labels, i - 1).eqNullSafe(x)
        return F.when(x.isNull() | (x == "O"), "O").when(same, F.concat(F.lit("I-"), x)).otherwise(F.concat(F.lit("B-"), x))

    return F.transform(labels, tag)


def label_at(start: Column, end: Column, spans: Column) -> Column:
    """Label of the span that covers the first covered character of [start, end), or null."""
    over = F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start))
    return F.array_min(F.transform(over, lambda s: F.struct(F.greatest(s["start"], start).alias("at"), s["label"].alias("label"))))["label"]


def folded(text: Column) -> Column:
    """The text with each character as what matches ASCII letters whatever their case: to ``first_span`` of many phrases. Places stay."""
    return F.lower(reduce(lambda x, pair: replaced(x, *pair), (("ſ", "s"), ("ı", "i"), ("İ", "i")), text))


def first_span(text: Column, phrase: Column, plain: Column | None = None) -> Column:
    """(start, end) of a phrase's first occurrence, whatever its case, or null.

    One token matches anywhere (a single word character only by itself); several
    tokens may have any non-word characters between, and stand by themselves.
    ``plain`` is the text ``folded``: phrases of ASCII are sought there, faster.
    """
    bound = F.struct(phrase.alias("phrase"), words(phrase).alias("tokens"))
    usual = lambda x: once(once(x, lambda p: _pattern(p["phrase"], p["tokens"])), lambda p: _place(text, p))
    if plain is None:
        return usual(bound)
    low = F.struct(phrase.alias("phrase"), words(F.lower(phrase)).alias("tokens"))
    fast = once(once(low, lambda p: _pattern(p["phrase"], p["tokens"], True)), lambda p: _place(plain, p))
    return F.when(phrase.rlike(r"[^\x00-\x7f]"), usual(bound)).otherwise(fast)


def _pattern(phrase: Column, tokens: Column, fast: bool = False) -> Column:
    """Pattern of a phrase, null if it has no tokens.

    ``fast`` ones, for folded texts, begin with the first token's letters: the engine skips to these.
    """
    quote = lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    body = F.array_join(F.transform(tokens, quote), rf"[^{WORD}]+")
    alone = (F.size(tokens) > 1) | (F.length(F.regexp_replace(phrase, rf"[^{WORD}]", "")) <= 1)
    bounded = F.concat(F.lit(rf"(?iu)(?<![{WORD}])"), body, F.lit(rf"(?![{WORD}])"))
    if fast:
        first = quote(F.get(tokens, F.lit(0)))
        behind = F.concat(F.lit(rf"(?<![{WORD}]"), first, F.lit(")"))
        rest = F.array_join(F.concat(F.array(F.lit("")), F.transform(F.slice(tokens, 2, 1_000_000), quote)), rf"[^{WORD}]+")
        return F.when(F.size(tokens) > 0, F.when(alone, F.concat(first, behind, rest, F.lit(rf"(?![{WORD}])"))).otherwise(first))
    return F.when(F.size(tokens) > 0, F.when(alone, bounded).otherwise(F.concat(F.lit("(?iu)"), body)))


def _place(text: Column, pattern: Column) -> Column:
    found = F.regexp_substr(text, pattern)
    at = F.regexp_instr(text, pattern) - 1
    return F.when(found.isNotNull(), F.struct(at.cast("int").alias("start"), (at + F.length(found)).cast("int").alias("end")))
