"""One registered query for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import contact, names, noise, text as tx
from docloom.operators import curation, metrics, profile as pf, sections as sec, skills as sk, spans as sp
from docloom.plans.inputs import resumes, table, tokens
from docloom.sources import files

ITEM = "¦"  # between items of joined lists


def joined(c: Column) -> Column:
    return F.array_join(c, ITEM)


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


# -- text ---------------------------------------------------------------------------------------


def clean_text(spark, d):
    return resumes(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


def ocr_artifact_flag(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("s"), F.lit(tx.ARTIFACT))).otherwise(F.col("text"))
    return documents(spark, d).select("doc_id", tx.has_ocr_artifact(t).alias("artifact"))


def ocr_artifact_repair(spark, d):
    return documents(spark, d).select("doc_id", tx.repair_ocr_artifact(F.replace("text", F.lit("s"), F.lit(tx.ARTIFACT))).alias("repaired"))


def ocr_normalize(spark, d):
    return documents(spark, d).select("doc_id", tx.normalize_ocr(F.concat("text", F.lit(" SOL RESOLVE sol x t-sql I ve Hi ve master s Camputer campany"))).alias("normalized"))


def lines(spark, d):
    return documents(spark, d).select("doc_id", F.size(tx.lines(F.col("text"))).alias("n_lines"), joined(tx.lines(F.col("text"))).alias("lines"))


def parser_quality(spark, d):
    flag = tx.quality_flag(F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "[aeiou]", "\x01")).otherwise(F.col("text")))
    return documents(spark, d).select("doc_id", flag.alias("quality_flag"), tx.parser_confidence(flag).alias("parser_confidence"))


def collapse_pages(spark, d):
    return documents(spark, d).select("doc_id", tx.collapse_pages(F.split("text", r"\.")).alias("collapsed"))


def parser_cascade(spark, d):
    docs = documents(spark, d)
    embedded = F.when(docs["doc_id"] % 3 == 0, F.lit(" short ")).when(docs["doc_id"] % 3 == 1, docs["text"])
    second = F.when(docs["doc_id"] % 2 == 0, docs["text"])
    ocr = F.when(docs["doc_id"] % 5 != 0, F.reverse(docs["text"]))
    choice = curation.parser_choice(embedded, second, ocr)
    return docs.select("doc_id", choice["text"].alias("text"), choice["parser"].alias("parser"))


def best_candidate_per_page(spark, d):
    turns = table(spark, d, "conversations")
    return curation.best_pages(turns.select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("cfg"), "text"))


# -- sources ------------------------------------------------------------------------------------


def _listing(spark, d):
    name = F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".pdf").otherwise(".txt"))
    return documents(spark, d).select(name.alias("path"), (F.col("n_chars") * F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1)).alias("length"))


def inventory(spark, d):
    return files.inventory(_listing(spark, d))


def ingest_binary(spark, d):
    """Files of the input folder itself; the bytes are never read."""
    return files.read_binary(spark, d, "*.parquet", recursive=True).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def validate_input(spark, d):
    docs = documents(spark, d)
    kind = F.when(docs["lang"] == "en", "application/pdf").when(docs["lang"] == "de", "application/x-pdf").when(docs["lang"] == "fr", "text/plain")
    size = F.when(docs["doc_id"] % 11 == 0, 0).otherwise(docs["n_chars"] * 1000)
    error = curation.input_error(kind, docs["n_chars"] / 500, size, F.when(docs["doc_id"] % 4 == 0, "broken"))
    return docs.select("doc_id", error.alias("error_code"))


def _ready(spark, d):
    names_ = F.concat("doc_id", F.lit(".txt"))
    ready = documents(spark, d).filter(F.col("lang").isin("en", "de")).select(names_.alias("file_name"))
    texts = documents(spark, d).select(names_.alias("file_name"), F.when(F.col("n_chars") > 500, F.col("text")).otherwise(F.lit(" \n")).alias("text"))
    return files.ready_texts(ready, texts)


def read_text(spark, d):
    raw = F.encode(F.concat("text", F.lit("\r\nlast\rline")), "utf-8")
    return documents(spark, d).select(F.concat("doc_id", F.lit(".txt")).alias("file_name"), files.decoded(raw).alias("text"))


def ready_list(spark, d):
    return files.listed(documents(spark, d).select(F.when(F.col("doc_id") % 4 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("\t "), "doc_id", F.lit(".txt  "))).alias("value")))


def annotations(spark, d):
    """Annotation tasks out of JSON arrays, one for each document."""
    result = F.struct(F.lit("r1").alias("id"), F.lit("labels").alias("type"), F.struct(F.lit(0).alias("start"), F.col("n_chars").alias("end"), F.array(F.col("lang")).alias("labels")).alias("value"))
    task = F.struct(F.col("doc_id").alias("id"), F.struct("text", F.struct(F.col("source").alias("filename"), F.col("n_chars").alias("char_count")).alias("meta")).alias("data"), F.array(F.struct((F.col("doc_id") % 3 == 0).alias("was_cancelled"), F.array(result).alias("result"))).alias("annotations"))
    t = documents(spark, d).select(F.explode(files.tasks_of(F.to_json(F.array(task)))).alias("t"))
    return t.select("t.id", F.col("t.data.text").alias("text"), F.col("t.data.meta.filename").alias("filename"), F.col("t.annotations")[0]["was_cancelled"].alias("was_cancelled"), F.col("t.annotations")[0]["result"][0]["value"]["end"].alias("end"), F.col("t.annotations")[0]["result"][0]["value"]["labels"][0].alias("label"))


def ready_join(spark, d):
    return _ready(spark, d)[0]


def ready_missing(spark, d):
    return _ready(spark, d)[1]


# -- scalars ------------------------------------------------------------------------------------


def first_email(spark, d):
    return resumes(spark, d).select("doc_id", contact.first_email(F.col("text")).alias("email"))


def first_phone(spark, d):
    return resumes(spark, d).select("doc_id", contact.first_phone(F.col("text")).alias("phone"))


def format_phone(spark, d):
    digits = F.concat(F.when(F.col("c_custkey") % 3 == 0, "01").when(F.col("c_custkey") % 3 == 1, "1").otherwise(""), F.regexp_replace((F.col("c_custkey") * 7919 * 104729).cast("string"), "[^0-9]", ""))
    return table(spark, d, "customer").select("c_custkey", digits.alias("digits"), contact.format_phone(digits).alias("phone"))


def _exploded(df, items, name):
    """(doc_id, pos, name) of the items. Outer: else the items are computed a second time, for a filter on their number."""
    return df.select("doc_id", F.posexplode_outer(items).alias("pos", name)).filter("pos IS NOT NULL")


def _lines_of_resumes(spark, d):
    return _exploded(resumes(spark, d), tx.lines(F.col("text")), "line")


def name_score(spark, d):
    return _lines_of_resumes(spark, d).select("doc_id", "pos", names.name_score(F.col("line")).alias("score"))


def best_name(spark, d):
    return resumes(spark, d).select("doc_id", names.best_name(tx.lines(F.col("text"))).alias("name"))


def name_candidates(spark, d):
    found = _exploded(resumes(spark, d), pf.name_candidates(F.col("text")), "c")
    return found.select("doc_id", "pos", "c.line", "c.score")


def name_bad(spark, d):
    t = F.when(F.col("c_custkey") % 4 == 0, F.lit("Anna Resume")).when(F.col("c_custkey") % 4 == 1, F.col("c_name")).when(F.col("c_custkey") % 4 == 2, F.concat(F.col("c_mktsegment"), F.lit(" Lee"))).otherwise(None)
    return table(spark, d, "customer").select("c_custkey", names.name_is_bad(t).alias("bad"))


def label_slug(spark, d):
    raw = F.concat(F.lit(" "), "p_type", F.when(F.col("p_partkey") % 2 == 0, "_Resumes").otherwise(" resume "))
    return table(spark, d, "part").select("p_partkey", curation.label_slug(raw).alias("slug"))


OVERRIDES = {"src1": "engineering", "src2": "engineering", "src3": "people_ops"}


def canonical_label(spark, d):
    return curation.canonical_labels(documents(spark, d).select("doc_id", F.col("source").alias("raw_label")), OVERRIDES)


def parse_uri(spark, d):
    return table(spark, d, "pages").select("page_id", *curation.parse_uri(F.col("url")))


def noise_lines(spark, d):
    return _lines_of_resumes(spark, d).select("doc_id", "pos", noise.is_noise(F.col("line")).alias("noise"))


def drop_states(spark, d):
    kept = F.filter(tx.lines(F.col("text")), lambda x: ~noise.is_state(x))
    return resumes(spark, d).select("doc_id", F.size(kept).alias("kept"))


# -- sections and skills ------------------------------------------------------------------------


def section_headers(spark, d):
    h = sec.header_of(F.col("line"))
    found = _lines_of_resumes(spark, d).select("doc_id", "pos", h["section"].alias("section"), h["keyword"].alias("keyword"), sec.header_tail(F.col("line"), h["keyword"]).alias("tail"))
    return found.filter("section IS NOT NULL")


def sections(spark, d):
    """Lines by section before the cleaning of sections."""
    tagged = _exploded(resumes(spark, d), sec.tagged_lines(F.col("text")), "t")
    return tagged.groupBy("doc_id", "t.section").agg(F.count(F.lit(1)).alias("n_lines"), joined(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t.line"))), lambda x: x["line"])).alias("lines"))


def section_dedupe(spark, d):
    return resumes(spark, d).select("doc_id", joined(noise.clean_section_lines(tx.lines(F.col("text")))).alias("lines"))


def education_merge(spark, d):
    return resumes(spark, d).select("doc_id", joined(sec.section_lines(sec.tagged_lines(F.col("text")), "education")).alias("education"))


def dedupe_ci(spark, d):
    return documents(spark, d).select("doc_id", joined(noise.dedupe_ci(F.split("text", r"[.\n]"))).alias("items"))


def dedupe_ws(spark, d):
    return documents(spark, d).select("doc_id", joined(noise.dedupe_ws(F.split("text", r"[.\n]"))).alias("items"))


def skills_exact(spark, d):
    return resumes(spark, d).select("doc_id", joined(sk.exact_skills(tx.collapse_space(F.lower("text")))).alias("skills"))


def skills_fuzzy(spark, d):
    found = sk.with_similar_skills(resumes(spark, d).select("doc_id", "text"), tx.collapse_space(F.lower("text")), "found")
    return found.select("doc_id", joined(F.col("found")).alias("skills"))


def skills(spark, d):
    return sk.skills(resumes(spark, d).select("doc_id", "text"), F.col("text"), F.array().cast("array<string>")).select("doc_id", joined(F.col("skills")).alias("skills"))


def ngrams(spark, d):
    grams = sk.ngrams(tx.words(F.col("text")), 3)
    return documents(spark, d).select("doc_id", F.size(grams).alias("n"), F.md5(joined(grams)).alias("grams_md5"))


def profile(spark, d):
    out = pf.profile(resumes(spark, d).select("doc_id", "text"))
    return out.withColumns({c: joined(F.col(c)) for c in ("skills", "education", "experience")})


def backend(spark, d):
    docs = documents(spark, d)
    way = pf.backend(docs["doc_id"] % 5 == 0, docs["doc_id"] % 2 == 0, F.when(docs["doc_id"] % 3 == 0, "failed"))
    return docs.select(way.alias("backend")).groupBy("backend").agg(F.count(F.lit(1)).alias("n"))


def response_json(spark, d):
    return pf.response(pf.profile(resumes(spark, d).select("doc_id", "text"))).select("doc_id", "json")


def debug_view(spark, d):
    docs = resumes(spark, d).select("doc_id", "text", tx.clean_text(F.col("text")).alias("clean"))  # a column of its own: it is read for each part
    view = docs.select("doc_id", *pf.debug_view(F.col("text"), F.col("clean")))
    return view.select("doc_id", "raw_sample", "clean_sample", joined(F.col("lines")).alias("lines"), F.size("name_candidates").alias("n_candidates"))


# -- curation -----------------------------------------------------------------------------------


def quality_score(spark, d):
    return curation.with_quality(resumes(spark, d)).select("doc_id", "garbled_ratio", joined(F.col("headers_found")).alias("headers_found"), "has_email", "text_length", "scramble_ratio", joined(F.col("issues")).alias("issues"), "verdict")


def verdict_counts(spark, d):
    return curation.with_quality(documents(spark, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def label_counts(spark, d):
    return canonical_label(spark, d).groupBy("canonical_label").agg(F.count(F.lit(1)).alias("n"))


def label_variants(spark, d):
    return curation.label_variants(canonical_label(spark, d)).select("canonical_label", joined(F.col("variants")).alias("variants"))


def split_counts(spark, d):
    return curation.split_counts(label_counts(spark, d))


def stratified_split(spark, d):
    return curation.stratified_split(canonical_label(spark, d), "canonical_label", "doc_id")


def holdout_split(spark, d):
    return curation.holdout(documents(spark, d).select("doc_id"), "doc_id")


def seeded_sample(spark, d):
    return curation.seeded_sample(documents(spark, d).select("doc_id", "source"), "doc_id")


def batches(spark, d):
    return curation.batches(documents(spark, d).select("doc_id"), "doc_id")


def _parsed(spark, d):
    t = tx.quality_flag(F.col("text"))
    return documents(spark, d).select("doc_id", (F.col("doc_id") % 4 != 0).alias("ok"), F.col("n_chars").alias("chars"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("failed: "), "source", F.lit(" "), t)).alias("error"))


def parser_benchmark(spark, d):
    return curation.benchmark_summary(_parsed(spark, d))


def parser_counts(spark, d):
    rows = _parsed(spark, d).withColumn("parser", F.when(F.col("chars") % 3 == 0, "embedded").when(F.col("chars") % 3 == 1, "second"))
    return curation.parser_counts(rows)


def error_samples(spark, d):
    return curation.error_samples(_parsed(spark, d), "doc_id")


def top_errors(spark, d):
    return curation.top_errors(_parsed(spark, d))


# -- spans --------------------------------------------------------------------------------------


def group_entities(spark, d):
    found = _exploded(tokens(spark, d), sp.group_entities(F.col("tokens")), "e")
    return found.select("doc_id", "pos", "e.text", "e.label", "e.score")


def peak_filter(spark, d):
    kept = sp.above_peak(F.col("tokens"), sp.peak_of(F.col("tokens")))
    return tokens(spark, d).select("doc_id", F.size(kept).alias("kept"), F.size("tokens").alias("n"))


def ner_profile(spark, d):
    e = sp.entities_by_label(sp.ner_entities(F.col("tokens")))
    out = tokens(spark, d).select("doc_id", e.alias("e"))
    return out.select("doc_id", "e.name", *(joined(F.col("e")[c]).alias(c) for c in ("skills", "education", "experience")), "e.confidence")


def entities_by_label(spark, d):
    e = sp.entities_by_label(sp.group_entities(F.col("tokens")))
    out = tokens(spark, d).select("doc_id", e.alias("e"))
    return out.select("doc_id", "e.name", joined(F.col("e.skills")).alias("skills"), joined(F.col("e.experience")).alias("experience"))


def confidence(spark, d):
    return tokens(spark, d).select("doc_id", sp.span_confidence(sp.group_entities(F.col("tokens"))).alias("confidence"))


def _items(spark, d):
    extra = F.array(*map(F.lit, ("Education:", "2014", "2010-2014", "zation", "han", "a b", "US", "-", "oh", " Experience ", "Team lead")))
    return documents(spark, d).select("doc_id", F.concat(F.split("text", " "), extra).alias("items"))


def entity_filter(spark, d):
    return _items(spark, d).select("doc_id", joined(noise.clean_entities(F.col("items"))).alias("items"))


def experience_filter(spark, d):
    return _items(spark, d).select("doc_id", joined(noise.clean_experience(F.col("items"))).alias("items"))


def education_filter(spark, d):
    return _items(spark, d).select("doc_id", joined(noise.clean_education(F.col("items"))).alias("items"))


def hybrid_merge(spark, d):
    none = F.array().cast("array<string>")
    found = tokens(spark, d).select("doc_id", sp.ner_entities(F.col("tokens")).alias("found"))
    ner = found.select("doc_id", sp.entities_by_label(F.col("found")).alias("e"), F.size("found").alias("n_entities"))
    # columns of their own: they are read for each part; before the join, so that no texts are shuffled
    docs = resumes(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("clean")).withColumn("tagged", sec.tagged_lines(F.col("clean")))
    text, tagged, e = F.col("clean"), F.col("tagged"), F.col("e")
    h = F.struct(names.best_name(tx.lines(text)).alias("name"), contact.first_email(text).alias("email"), contact.first_phone(text).alias("phone"), none.alias("skills"), sec.section_lines(tagged, "education").alias("education"), sec.section_lines(tagged, "experience").alias("experience"), F.lit(pf.CONFIDENCE).alias("confidence"))
    n = F.struct(e["name"].alias("name"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("phone"), e["skills"].alias("skills"), e["education"].alias("education"), e["experience"].alias("experience"), e["confidence"].alias("confidence"))
    both = docs.select("doc_id", h.alias("heuristic")).join(ner, "doc_id", "left")
    out = pf.hybrid_merge(both.select("doc_id", "n_entities", n.alias("ner"), "heuristic"))
    return out.select("doc_id", "merged.name", "merged.email", "merged.phone", *(joined(F.col("merged")[c]).alias(c) for c in ("skills", "education", "experience")), "merged.confidence")


def resolve_overlaps(spark, d):
    start = F.col("l_linenumber") * 5 + F.col("l_partkey") % 7
    span = F.struct(start.cast("int").alias("start"), (start + F.col("l_suppkey") % 11 + 1).cast("int").alias("end"), F.col("l_returnflag").alias("label"))
    kept = table(spark, d, "lineitem").groupBy("l_orderkey").agg(sp.resolve_overlaps(F.collect_list(span)).alias("spans"))
    return kept.select("l_orderkey", F.explode("spans").alias("s")).select("l_orderkey", "s.start", "s.end", "s.label")


def span_trim(spark, d):
    start = F.floor(F.col("n_chars") / 3).cast("int")
    span = F.struct(start.alias("start"), (start + 23).cast("int").alias("end"), F.lit("NAME").alias("label"))
    return documents(spark, d).select("doc_id", sp.trimmed(F.col("text"), span)["end"].alias("end"))


def span_extract(spark, d):
    n = F.col("n_chars").cast("int")
    result = lambda kind, a, b, label: F.struct(F.lit(kind).alias("type"), F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.array(F.lit(label)).alias("labels")).alias("value"))
    live = F.array(result("labels", n * 0, n * 0 + 9, "NAME"), result("labels", n * 0 + 4, n * 0 + 30, "SKILL"), result("labels", n * 0 + 12, n * 0 + 15, "DATE"), result("choices", n * 0 + 40, n * 0 + 44, "SKILL"), result("labels", n * 0 + 50, n * 0 + 58, "OTHER"), result("labels", n * 0 + 60, n * 0 + 68, "O"))
    annotations = F.array(F.struct((F.col("doc_id") % 3 == 0).alias("was_cancelled"), live.alias("result")), F.struct(F.lit(True).alias("was_cancelled"), live.alias("result")))
    tasks = documents(spark, d).select(F.col("doc_id").alias("id"), F.struct("text").alias("data"), annotations.alias("annotations"))
    found = sp.annotated_spans(tasks).select("id", F.explode("spans").alias("s"))
    return found.select("id", "s.start", "s.end", "s.label")


def _tagged_words(spark, d):
    """Words with labels by their length, as arrays."""
    label = lambda w: F.when(F.length(w) % 5 < 2, "SKILL").when(F.length(w) % 5 == 2, "NAME")
    return documents(spark, d).select("doc_id", F.transform(tx.words(F.col("text")), label).alias("labels"))


def bio_tags(spark, d):
    return _tagged_words(spark, d).select("doc_id", F.array_join(sp.bio_tags(F.col("labels")), " ").alias("tags"))


def tag_histogram(spark, d):
    return metrics.tag_histogram(_tagged_words(spark, d).select(sp.bio_tags(F.col("labels")).alias("tags")))


def _offsets(df: DataFrame) -> DataFrame:
    """(doc_id, pos, start, end, ...) of the words between single spaces."""
    words = df.select("doc_id", "spans", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    ends = F.sum(F.length("word") + 1).over(Window.partitionBy("doc_id").orderBy("pos"))
    return words.filter("doc_id IS NOT NULL").select("doc_id", "spans", "pos", (ends - F.length("word") - 1).alias("start"), (ends - 1).alias("end")).filter("end > start")


def _with_spans(spark, d):
    n = F.col("n_chars").cast("int")
    span = lambda a, size, label: F.struct(F.floor(a).cast("int").alias("start"), (F.floor(a) + size).cast("int").alias("end"), F.lit(label).alias("label"))
    return documents(spark, d).select("doc_id", "text", F.array(span(n / 10, 20, "NAME"), span(n / 2, 15, "SKILL"), span(n / 2 + 4, 30, "DATE")).alias("spans"))


def bio_align(spark, d):
    at = _offsets(_with_spans(spark, d))
    return at.select("doc_id", "pos", sp.label_at(F.col("start"), F.col("end"), F.col("spans")).alias("label")).filter("label IS NOT NULL")


def bio_dataset(spark, d):
    resolved = _with_spans(spark, d).withColumn("spans", sp.resolve_overlaps(F.col("spans")))
    labelled = _offsets(resolved).select("doc_id", "pos", sp.label_at(F.col("start"), F.col("end"), F.col("spans")).alias("label"))
    rows = labelled.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels"))
    return rows.select("doc_id", F.array_join(sp.bio_tags(F.col("labels")), " ").alias("tags"))


def first_span(spark, d):
    phrase = F.concat_ws(" ", F.slice(tx.first_words(F.lower("text"), 4), 3, 2))
    span = sp.first_span(F.col("text"), phrase)
    return documents(spark, d).select("doc_id", span["start"].alias("start"), span["end"].alias("end"))


def prelabel(spark, d):
    """First spans of each profile's phrases, overlaps resolved."""
    found = pf.profile(resumes(spark, d).select("doc_id", "text"), clean_to="clean")
    one = lambda c, label: F.transform(c, lambda x: F.struct(x.alias("phrase"), F.lit(label).alias("label")))
    phrases = F.concat(one(F.array_compact(F.array("name")), "NAME"), one(F.col("education"), "EDUCATION"), one(F.col("experience"), "EXPERIENCE"), one(F.col("skills"), "SKILL"))
    spans = F.transform("phrases", lambda p: F.struct(sp.first_span(F.col("clean"), p["phrase"], F.col("folded")).alias("s"), p["label"].alias("label")))
    kept = F.transform(F.filter(spans, lambda x: x["s"].isNotNull()), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["label"].alias("label")))
    by_doc = found.select("doc_id", "clean", sp.folded(F.col("clean")).alias("folded"), phrases.alias("phrases")).select("doc_id", kept.alias("spans")).groupBy("doc_id").agg(sp.resolve_overlaps(F.flatten(F.collect_list("spans"))).alias("spans"))
    return by_doc.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label")


# -- metrics ------------------------------------------------------------------------------------


def _predictions(spark, d):
    """Predicted and true label ids of each conversation's turns, in order."""
    turns = table(spark, d, "conversations").filter("conv_id IS NOT NULL")
    label = F.when(F.col("turn") % 7 == 6, -100).otherwise((F.length("text") % 5).cast("int"))
    row = F.struct("turn", (F.length("text") % 5 - F.when(F.length("text") % 3 == 0, 1).otherwise(0)).cast("int").alias("p"), label.cast("int").alias("l"))
    got = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return got.select("conv_id", F.transform("r", lambda x: x["p"]).alias("predicted"), F.transform("r", lambda x: x["l"]).alias("labels"))


def token_accuracy(spark, d):
    return metrics.token_accuracy(_predictions(spark, d))


def _audited(spark, d):
    p = _predictions(spark, d)
    ids = F.when(p["conv_id"] % 9 == 0, F.array_append(p["predicted"], F.lit(1))).when(p["conv_id"] % 10 != 0, p["predicted"])
    return metrics.audit(p.select("conv_id", ids.alias("input_ids"), "labels"), 4)


def ner_audit(spark, d):
    return _audited(spark, d).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def ner_label_top(spark, d):
    return metrics.counted_labels(_audited(spark, d).filter("error IS NULL OR error = 'label out of range'"), 4).orderBy(F.desc("n"), "label").limit(12)


def entity_f1(spark, d):
    tag = lambda x: F.element_at(F.array(*map(F.lit, ("O", "B-NAME", "I-NAME", "B-SKILL", "I-SKILL"))), F.greatest(x, F.lit(0)) + 1)
    rows = _predictions(spark, d).select(F.transform("predicted", tag).alias("predicted"), F.transform("labels", tag).alias("labels"))
    return metrics.entity_f1(rows)


QUERIES = {
    f.__name__: f
    for f in (
        profile, clean_text, ocr_artifact_flag, ocr_artifact_repair, ocr_normalize, lines, parser_quality, collapse_pages, parser_cascade, best_candidate_per_page,
        inventory, ingest_binary, validate_input, read_text, ready_list, annotations, ready_join, ready_missing,
        first_email, first_phone, format_phone, name_score, best_name, name_candidates, name_bad, label_slug, canonical_label, parse_uri, noise_lines, drop_states,
        section_headers, sections, section_dedupe, education_merge, dedupe_ci, dedupe_ws, skills_exact, skills_fuzzy, skills, ngrams, backend, response_json, debug_view,
        quality_score, verdict_counts, label_counts, label_variants, split_counts, stratified_split, holdout_split, seeded_sample, batches, parser_benchmark, parser_counts, error_samples, top_errors,
        group_entities, peak_filter, ner_profile, entities_by_label, confidence, entity_filter, experience_filter, education_filter, hybrid_merge, resolve_overlaps,
        span_trim, span_extract, bio_tags, tag_histogram, bio_align, bio_dataset, first_span, prelabel, token_accuracy, ner_audit, ner_label_top, entity_f1,
    )
}
