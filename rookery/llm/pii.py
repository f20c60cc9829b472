"""Personal data: patterns, and terms that the corpus shows to give a protected value away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.llm.storage import BROADCAST_ROWS, cut, join_dictionary

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns with possessive repeats, which match the same and need no stack; the look-behinds
#: say that no earlier start in the run of characters is possible, so that long runs are read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{M}\p{N}]++"
SPAN = "struct<kind:string,start:int,end:int,value:string>"
ORDER = ("email", "ip", "card", "phone", "term")


def _luhn(digits: Column) -> Column:
    back = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.when(d.cast("int") > 4, 1).otherwise(0))
    return F.aggregate(F.transform(back, value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of all leftmost matches that don't overlap, in code points. Each match is also
    taken with all that lies between it and the one before (\\G), so that sums of lengths give its place."""
    none = F.array().cast("array<string>")
    values = F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), none)
    reach = F.coalesce(F.regexp_extract_all(text, F.lit(rf"(?s)(\G.*?(?:{pattern}))"), F.lit(1)), none)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("ends"))
    ends = F.aggregate(reach, start, lambda a, r: F.struct((a["at"] + F.length(r)).alias("at"), F.concat(a["ends"], F.array(a["at"] + F.length(r))).alias("ends")))["ends"]
    pairs = F.when(F.size(values) == 0, F.array().cast("array<struct<start:int,end:int,value:string>>")).otherwise(
        F.zip_with(values, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
    )
    return pairs


def _spans_of(text: Column, kind: str) -> Column:
    named = lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))
    spans = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"])), named).cast(f"array<{SPAN}>")
    if not NEEDS[kind]:
        return spans
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def pattern_spans(text: Column) -> Column:
    """array<SPAN> by kind, then start: what the four patterns find and their checks accept."""
    found = [_spans_of(text, kind) for kind in KINDS]
    return F.concat(*found)


def _occurrences(texts: DataFrame, shortest: int) -> DataFrame:
    """(copy, term, start, end): every term of texts (copy, text, spans) that no span touches, in code points.

    Places are running sums over a text's terms; a span touches a term if, of those that start before its end, one ends after its start."""
    values = F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1))
    steps = F.transform(F.regexp_extract_all("text", F.lit(rf"(?s)(\G.*?{TERM})"), F.lit(1)), F.length)
    terms = texts.select("copy", F.posexplode(F.arrays_zip(values.alias("value"), steps.alias("step"))).alias("k", "m")).select("copy", "k", "m.value", "m.step")
    so_far = W.partitionBy("copy").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    terms = terms.withColumn("end", F.sum("step").over(so_far).cast("int")).withColumn("start", (F.col("end") - F.length("value")).cast("int"))
    terms = terms.select("copy", F.lower("value").alias("term"), "start", "end", F.col("end").alias("at"), F.lit(0).alias("is_span"))
    spans = texts.select("copy", F.explode("spans").alias("s")).select("copy", F.lit(None).cast("string").alias("term"), "s.start", "s.end", F.col("s.start").alias("at"), F.lit(1).alias("is_span"))
    before = W.partitionBy("copy").orderBy("at", "is_span").rowsBetween(W.unboundedPreceding, 0)
    both = terms.unionByName(spans).withColumn("covered", F.max(F.when(F.col("is_span") == 1, F.col("end"))).over(before))
    free = both.where((F.col("is_span") == 0) & (F.coalesce("covered", F.lit(0)) <= F.col("start")) & (F.length("term") >= shortest))
    return free.select("copy", "term", "start", "end")


def revealing_terms(found: DataFrame, docs_texts: DataFrame, shortest: int, threshold: float, support: int) -> DataFrame:
    """(copy, marks): all occurrences of terms that give a protected value away, in each text that holds the value.

    found has (copy, text, spans), a row per document, copy telling its text. For a value e and a term t anywhere in the
    documents that hold e, the information t carries about e is PMI = log(n(t,e) N / (n(t) n(e))), in documents; over the
    self-information log(N / n(e)) it is the share of e that t discloses. A term is revealing for e at `threshold` or
    more, if `support` different texts hold the pair; so only texts with a value that `support` texts hold are taken apart.
    """
    texts = cut(found.groupBy("copy").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"), F.first("spans").alias("spans")), "texts")
    names = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    held = texts.select("copy", "n", F.explode(names).alias("e"))
    shared = cut(held.groupBy("e").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") >= support).drop("copies"), "shared")
    none = texts.select("copy", F.array().cast("array<struct<start:int,end:int>>").alias("marks")).limit(0)
    if shared.isEmpty():
        return none
    held = cut(join_dictionary(held, shared, "e", "inner"), "held")
    free = cut(_occurrences(texts.join(held.select("copy").distinct(), "copy", "left_semi"), shortest), "terms")
    near = cut(free.select("copy", "term").distinct().join(held, "copy"), "near")
    pairs = near.groupBy("term", "e").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("copies"), F.first("n_e").alias("n_e"))
    pairs = cut(pairs.where(F.col("copies") >= support), "pairs")
    if pairs.isEmpty():
        return none
    terms = cut(pairs.select(F.col("term").alias("w")).distinct(), "words")
    words = docs_texts.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1)), F.lower))).alias("w"))
    n_t = words.groupBy("w").agg(F.count(F.lit(1)).alias("n_t"))  # counted before it meets the terms: frequent ones are one row by then
    # terms are distinct, so an inner join gives the same rows; a semi join would be moved below the count
    n_t = n_t.join(F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms, "w")
    n_docs = docs_texts.count()
    # one row per word against the values of its pairs: a word in very many pairs is spread over tasks
    told = join_dictionary(pairs, cut(n_t.withColumnRenamed("w", "term"), "n_t"), "term", "inner")
    self_information = F.log(F.lit(float(max(n_docs, 1))) / F.col("n_e"))
    pmi = F.log(F.col("n_te") * float(n_docs) / (F.col("n_t").cast("double") * F.col("n_e")))
    told = cut(told.where((self_information > 0) & (pmi >= threshold * self_information)).select(F.struct("term", "e").alias("pair")).withColumn("told", F.lit(True)), "told")
    hits = join_dictionary(near.select("copy", "term", F.struct("term", "e").alias("pair")), told, "pair", "inner").select("copy", "term").distinct()
    return free.join(hits, ["copy", "term"], "left_semi").groupBy("copy").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("marks"))


def _searched(docs: DataFrame, shortest: int, threshold: float, support: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, text), those with pattern spans (copy, doc_id, text, spans), and (copy, marks) of the texts in which terms reveal a value."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = rows.withColumn("spans", pattern_spans(F.col("text"))).where(F.size("spans") > 0)
    found = cut(based.select(F.md5("text").alias("copy"), "doc_id", "text", "spans"), "found")
    return rows, found, cut(revealing_terms(found, rows, shortest, threshold, support), "marks")


def _term_spans() -> Column:
    marks = F.coalesce("marks", F.array().cast("array<struct<start:int,end:int>>"))
    return F.transform(marks, lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit("").alias("value"))).cast(f"array<{SPAN}>")


def find_personal_data(docs: DataFrame, shortest: int = 1, threshold: float = 0.8, support: int = 3) -> DataFrame:
    """docs' doc_id and text with spans array<SPAN>: pattern spans by kind and start, then `term` spans by start.

    Every whole text is searched; null texts are empty. Counts cover all documents, copies included, while support counts
    different texts, so that a page copied a thousand times proves nothing. A term is marked wherever it stands in a
    document that holds the value it gives away: a document without personal data stays as it is. Repeated rows and equal doc_ids get
    the spans of their own text. An empty table gives an empty result.
    """
    rows, found, marks = _searched(docs, shortest, threshold, support)
    with_pii = found.join(marks, "copy", "left").select("doc_id", "text", F.concat("spans", _term_spans()).alias("spans"))
    clean = rows.where(~has_personal_data(F.col("text"))).select("doc_id", "text", F.array().cast(f"array<{SPAN}>").alias("spans"))
    return with_pii.unionByName(clean)


def has_personal_data(text: Column) -> Column:
    return F.size(pattern_spans(text)) > 0


def redact(text: Column, spans: Column) -> Column:
    """text with each stretch of joined spans replaced: <EMAIL>, <IP>, <CARD>, <PHONE>; revealing terms are generalised to <TERM>."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] > a["at"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).otherwise("")
        label = F.when(s["start"] >= a["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap, label).alias("out"))

    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redacted_documents(docs: DataFrame, shortest: int = 1, threshold: float = 0.8, support: int = 3) -> DataFrame:
    """docs, all columns, with found spans replaced in text and n_chars, if there is one, set to the new length.

    Rows without personal data are passed on as they are, null texts too."""
    marks = _searched(docs, shortest, threshold, support)[2].withColumnRenamed("copy", "__copy")
    spanned = docs.withColumn("__spans", F.coalesce(pattern_spans(F.col("text")), F.array().cast(f"array<{SPAN}>")))
    clean, dirty = spanned.where("size(__spans) = 0"), spanned.where("size(__spans) > 0")
    dirty = dirty.withColumn("__copy", F.md5("text")).join(marks, "__copy", "left")
    dirty = dirty.withColumn("text", redact(F.col("text"), F.concat("__spans", _term_spans())))
    if "n_chars" in docs.columns:
        dirty = dirty.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns).unionByName(dirty.select(*docs.columns))
