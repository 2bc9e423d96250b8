"""PII: base patterns, and terms whose co-occurrence discloses what they found. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each pattern: the pattern marks its
matches, and the lengths of the pieces between the marks are the places. Patterns are
written so that they never try a place twice (possessive, with the start of a run), which
changes no match.

The rest is information-theoretic: a protected value e (an e-mail address, ...) has the
information content log(D/n(e)) over D documents; a term t, any run of letters or digits, lower-cased, of a
text that mentions it discloses log(n(t,e) D / (n(t) n(e))) of it. Where that is at least `share` of the content,
with `support` different texts as evidence, every occurrence of t in texts that mention e is a
span of kind `term`. Terms of any length anywhere in a text count, but for those inside base spans. Counts are over all documents;
each term is counted in every text that has it, before anything is known of the values, so the work
grows with the texts alone. What `support` misses: values in fewer different texts disclose nothing (see README).

A null text counts as empty. Repeated rows get equal spans. Empty tables give no rows. Columns
of the input may have any name: whole rows are carried beside the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewave.llm.rows import field, named, packed, unpacked, with_length
from brinewave.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base kinds, as Java regular expressions.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"[\p{L}\p{N}]+"
SUPPORT = 3
SHARE = 0.85
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def pieces_of(text: Column, pattern: Column) -> Column:
    """The text cut at the pattern's matches: every second piece is a match. Marks that the text itself holds are taken for another character."""
    plain = F.translate(text, "\x01\x02", "\x03\x03")
    return F.split(F.regexp_replace(plain, pattern, F.lit("\x01$0\x02")), "[\x01\x02]", -1)


def marked_spans(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of the pattern's matches in order."""
    pieces = pieces_of(text, pattern)
    empty = F.lit(None).cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.coalesce(empty, F.array().cast(SPAN)).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        stop = acc["at"] + F.length(piece)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), stop.alias("end"), piece.alias("value"))
        return F.struct(
            stop.alias("at"), (~acc["inside"]).alias("inside"),
            F.when(acc["inside"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """True if the digits pass Luhn's check."""
    places = F.sequence(F.lit(1), F.length(digits))
    digit = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(places, F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def _valid(kind: str):
    return lambda span: valid(span["value"], kind)


def valid(value: Column, kind: str) -> Column:
    """True for a match that is one of its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _first(text: Column) -> dict[str, Column]:
    """What a text must have for a kind to be looked for."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then by start."""
    none = F.array().cast(SPAN)
    found = []
    for kind in KINDS:
        spans = marked_spans(text, F.lit(PATTERNS[kind]), kind)
        found.append(F.when(_first(text)[kind], F.filter(spans, _valid(kind))).otherwise(none))
    return F.concat(*found)


def _blanked(kind: str):
    return lambda piece, i: F.when((i % 2 == 1) & valid(piece, kind), F.regexp_replace(piece, "(?s).", "\x03")).otherwise(piece)


def without_base(text: Column) -> Column:
    """The text with control characters for those of base spans, so that places stay."""
    for kind in KINDS:
        text = F.when(_first(text)[kind], F.array_join(F.transform(pieces_of(text, F.lit(PATTERNS[kind])), _blanked(kind)), "")).otherwise(text)
    return text


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def with_base(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """_row (the kept columns), _same (a digest of the text) and _spans. Written once."""
    body = F.coalesce(named(text), F.lit(""))
    rows = docs.select(packed(keep), body.alias("_body")).withColumn("_spans", base_spans(F.col("_body")))
    return cut_lineage(rows.select("_row", F.md5("_body").alias("_same"), "_spans"))


def disclosing_terms(docs: DataFrame, base: DataFrame, text: str, support: int, share: float) -> tuple[DataFrame, DataFrame]:
    """_same and _rest, each text that mentions a value with support, base spans blanked; _same and term, what to protect in it."""
    told = base.where(F.size("_spans") > 0).select("_same", F.array_distinct("_spans.value").alias("_values"))
    told = told.groupBy("_same", "_values").agg(F.count(F.lit(1)).alias("copies"))
    once = told.select("_same", "copies", F.explode("_values").alias("value"))
    values = once.groupBy("value").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    mentions = cut_lineage(once.join(values.select("value", "n_e"), "value"))

    body = F.coalesce(named(text), F.lit(""))
    bodies = docs.select(body.alias("_body")).withColumn("_same", F.md5("_body"))
    there = bodies.join(mentions.select("_same").distinct(), "_same").dropDuplicates(["_same"])
    texts = cut_lineage(there.select("_same", without_base(F.col("_body")).alias("_rest")))
    told_in = texts.select("_same", F.explode(terms_of(F.col("_rest"))).alias("term"))
    pairs = mentions.join(told_in, "_same").groupBy("value", "n_e", "term").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("texts"))
    pairs = pairs.where(F.col("texts") >= support).drop("texts")

    held = docs.select(F.explode(terms_of(body)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    d = F.lit(float(base.count()))
    content = F.log(d / F.col("n_e"))
    told_by = F.log(F.col("n_te") * d / (F.col("n_t") * F.col("n_e")))
    flagged = pairs.join(held, "term").where((content > 0) & (told_by >= share * content)).select("value", "term")
    found = mentions.select("_same", "value").join(flagged, "value").select("_same", "term").distinct()
    return texts, found


def spanned(docs: DataFrame, text: str, keep: list[str], support: int, share: float) -> DataFrame:
    """_row (the kept columns) and _spans."""
    base = with_base(docs, text, keep)
    texts, found = disclosing_terms(docs, base, text, support, share)
    found = cut_lineage(found)
    # a row for each piece of the texts that have something to protect; places are sums of the lengths before
    pieces = texts.join(found.select("_same").distinct(), "_same").select("_same", F.posexplode(pieces_of(F.col("_rest"), F.lit(TERM))).alias("_i", "value"))
    before = Window.partitionBy("_same").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("value")).over(before), F.lit(0)).cast("int")
    placed = pieces.select("_same", "_i", "value", F.lower("value").alias("term"), start.alias("start")).where(F.col("_i") % 2 == 1)
    span = F.struct(F.lit("term").alias("kind"), F.col("start"), (F.col("start") + F.length("value")).alias("end"), F.col("value"))
    hits = placed.join(found, ["_same", "term"]).groupBy("_same").agg(F.array_sort(F.collect_list(F.struct("start", span.alias("span")))).alias("_l"))
    more = cut_lineage(hits.select("_same", F.col("_l.span").cast(SPAN).alias("_more")))
    both = base.join(more, "_same", "left")
    return both.select("_row", F.concat("_spans", F.coalesce("_more", F.array().cast(SPAN))).alias("_spans"))


def find(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, support: int = SUPPORT, share: float = SHARE, spans: str = "spans"
) -> DataFrame:
    """keep (all columns unless given) and `spans`: kind, start, end (code points, exclusive) and value of every span."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != spans]
    return spanned(docs, text, keep, support, share).select(*unpacked(keep), F.col("_spans").alias(spans))


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(docs: DataFrame, text: str = "text", support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """docs with every span of `text` generalised to its kind in brackets; spans that overlap become one."""
    names = docs.columns
    found = spanned(docs, text, names, support, share)
    body = field(names, text)
    line = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    ended = lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))
    new = F.when(F.size("_spans") > 0, F.aggregate(line, start, step, ended)).otherwise(body)
    return found.select(*unpacked(names, **with_length(names, new, text, docs)))
