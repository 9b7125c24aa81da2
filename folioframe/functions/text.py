"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply and forward marks of a subject.
REPLY = r"(?i)^\s*(?:(?:re|fwd?|fw|aw|wg|sv|vs|tr|rv|antw)\s*(?:\[\d+\])?\s*:\s*)+"
FORWARDED = r"(?i)\s*\((?:fwd|fw|forwarded)\)\s*$"
# Words that a retrieval query leaves out.
QUERY_STOP = tuple("""a an the and or but of to in on at by for with from as is are was were be been being do does did have has
had what which who whom whose why how when where whether if then than that this these those it its we our us you your
they their them i me my ever any some there here about into over under after before again ever did decide decided
decision approve approved plan current currently now still""".split())
# Words that never name an entity.
ENTITY_STOP = tuple("""a an the and or to of for in on at by with from we our all
approve approved launch keep use move stay switch set start adopt hire
offer cut add drop contract defer delay proceed grant give go make run
eur q1 q2 q3 q4 january february march april may june july august
september october november december monday tuesday wednesday thursday friday
saturday sunday new existing pro plan team customer customers""".split())
# What redaction masks, in this order.
IBAN = r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?\b"
EMAIL = r"(?U)(?<![\w.<])[\w.+-]{1,64}@(?:[\w-]+\.)+[\w-]{2,}"
PHONE = r"(?U)(?<![\w€$£])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}(?:[\s.-]\d{2,4}){2,4}(?![\w%])"
# Citation markers, and sentences that state that nothing was decided.
MARKER = r"\s*\[\^(\d+)\]"
NO_DECISION = r"(?i)^\s*(no\b[^.]{0,80}?\bdecision\b|there (is|was) no (recorded )?decision|(we|the company) (did not|never) decide)"


# Reply marks before a subject and forward marks behind it, however many there are on either side.
_BEHIND = FORWARDED.replace(r"\s*\(", r"(?:\s*\(", 1).replace(r"\)\s*$", r"\)\s*)+$")


def normalize_subject(subject: Column) -> Column:
    """Without reply marks in front and forward marks behind, to any depth; spaces collapsed, lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(subject, F.lit("")), REPLY, ""), _BEHIND, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


#: Letters that fold to others than their lower case: one by one, and to two.
_FOLDED = "".join(c for c in map(chr, range(0x80, 0x2000)) if len(c.casefold()) == 1 and c.casefold() != c.lower())
_WIDER = {c: c.casefold() for c in "ßŉǰẞﬀﬁﬂﬃﬄﬅﬆ"}


def casefold(text: Column) -> Column:
    """Lower case without distinctions of case: as lower, but for letters that have a folded form of their own."""
    out = F.translate(F.lower(text), "".join(c.lower() if len(c.lower()) == 1 else c for c in _FOLDED), "".join(c.casefold() for c in _FOLDED))
    for c, wide in _WIDER.items():
        out = F.replace(out, F.lit(c), F.lit(wide))
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(F.lower(text))


def clean_id(header: Column) -> Column:
    """The first <...> of a header, brackets included; null if there is none."""
    found = F.regexp_extract(header, r"(<[^<>\s]+>)", 1)
    return F.when(found != "", found)


def reference_ids(header: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r"(<[^<>\s]+>)"), F.lit(1))


def generated_message_id(sender: Column, sent_at: Column, subject: Column, body: Column) -> Column:
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (sender, sent_at, subject, F.substring(body, 1, 200))])
    return F.concat(F.lit("<generated-"), F.substring(F.sha1(key), 1, 20), F.lit("@local>"))


def thread_id(first_message_id: Column) -> Column:
    return F.concat(F.lit("T-"), F.substring(F.sha1(first_message_id), 1, 10))


def cluster_id(member_ids: Column) -> Column:
    return F.concat(F.lit("C-"), F.substring(F.sha1(F.array_join(F.array_sort(member_ids), "|")), 1, 8))


def domain_of(address: Column) -> Column:
    return F.lower(F.when(F.instr(address, "@") > 0, F.split_part(address, F.lit("@"), F.lit(2))).otherwise(""))


def name_from_address(address: Column) -> Column:
    words = F.filter(F.split(F.split_part(address, F.lit("@"), F.lit(1)), "[._-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 99)))), " ")


def query_terms(question: Column) -> Column:
    """Distinct words of three characters and more, in order, without the stop words."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)([\w€%]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*QUERY_STOP)))


def fts_query(question: Column) -> Column:
    return F.array_join(F.transform(query_terms(question), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def entities(text: Column, people: Column) -> Column:
    """Capitalized words, words with digits and abbreviations, lower case, without stop words and people's names."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][\w&-]+|[a-z]+\d[\w.]*|[A-Z]{2,})\b"), F.lit(1))
    low = F.transform(words, lambda w: F.regexp_replace(casefold(w), r"^-+|-+$", ""))
    return F.array_distinct(F.filter(low, lambda w: (F.length(w) >= 2) & ~w.isin(*ENTITY_STOP) & ~F.array_contains(people, w)))


def is_verbatim(quote: Column, *texts: Column) -> Column:
    """Whether a quote that isn't empty stands in one of the texts as it is."""
    held = [F.coalesce(t.contains(quote), F.lit(False)) for t in texts]
    out = held[0]
    for h in held[1:]:
        out = out | h
    return (F.coalesce(quote, F.lit("")) != "") & out


def _phones(text: Column) -> Column:
    """Number groups of nine digits and more become a tag; shorter ones stay."""
    found = F.regexp_extract_all(text, F.lit(f"({PHONE})"), F.lit(1))
    between = F.split(text, PHONE, -1)
    shown = F.transform(found, lambda m: F.when(F.length(F.regexp_replace(m, r"\D", "")) >= 9, "[phone]").otherwise(m))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.flatten(F.zip_with(between, shown, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""))


def redact_text(text: Column) -> Column:
    return _phones(F.regexp_replace(F.regexp_replace(text, IBAN, "[IBAN]"), EMAIL, "[email]"))


#: Fields whose strings are keys and stay readable.
KEY_FIELDS = ("message_id", "id", "decision_id", "cluster_id", "conflict_id", "record_id", "thread_id")


def redacted(column: Column, dtype, name: str | None = None) -> Column:
    """Redaction of every string within a nested column, but those of key fields."""
    from pyspark.sql import types as T

    if isinstance(dtype, T.StringType):
        return column if name in KEY_FIELDS else redact_text(column)
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: redacted(x, dtype.elementType, name))
    if isinstance(dtype, T.MapType):
        return F.transform_values(column, lambda k, v: F.when(k.isin(*KEY_FIELDS), v).otherwise(redacted(v, dtype.valueType, None))) if isinstance(dtype.keyType, T.StringType) else column
    if isinstance(dtype, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[redacted(column[f.name], f.dataType, f.name).alias(f.name) for f in dtype.fields]))
    return column


def redact(df):
    """A frame with every string redacted but those of key fields."""
    return df.select(*[redacted(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def markers(markdown: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(markdown, F.lit(r"\[\^(\d+)\]"), F.lit(1)), lambda n: n.cast("int")))


def enforce_citations(markdown: Column, verified: Column, status: Column) -> Column:
    """struct<text, dropped>: markers of unverified citations go, then every sentence without a marker goes, but for a
    leading sentence that states the outcome and for lines without a word."""
    shown = F.aggregate(
        F.array_except(markers(markdown), F.coalesce(verified, F.array().cast("array<int>"))), markdown,
        lambda text, n: F.regexp_replace(text, F.concat(F.lit(r"\s*\[\^"), n.cast("string"), F.lit(r"\]")), F.lit("")),
    )
    lines = F.transform(F.split(shown, "\n"), lambda line, i: F.struct(i.alias("i"), F.split(line, "(?<=[.!?\\]])\\s+(?=[A-Z\"“(*])").alias("s"), line.alias("line")))
    stated = status.isin("no_decision", "contested", "partial")

    def kept(line: Column) -> Column:
        return F.filter(line["s"], lambda s, k: s.rlike(MARKER) | ((line["i"] == 0) & (k == 0) & (stated | s.rlike(NO_DECISION))) | ~s.rlike(r"(?U)\w"))

    full = F.transform(lines, lambda line: F.struct(F.when(F.trim(line["line"]) == "", line["line"]).otherwise(F.array_join(kept(line), " ")).alias("text"), F.when(F.trim(line["line"]) == "", 0).otherwise(F.size(line["s"]) - F.size(kept(line))).alias("gone")))
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(full, lambda x: x["text"]), "\n"), r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")
    return F.struct(text.alias("text"), F.aggregate(full, F.lit(0), lambda a, x: a + x["gone"]).alias("dropped"))


def strip_fence(text: Column) -> Column:
    """Model text without the code fence around it."""
    return F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\n?|\n?```$", "")


def slug(text: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, most), "^-+|-+$", "")


def local_time(sent_at: Column, offset: Column) -> Column:
    """Sender's wall clock of a UTC time; the offset counts only in the form +HHMM."""
    zone = F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))
    return F.when(offset.rlike(r"^[+-]\d{4}$"), F.convert_timezone(F.lit("UTC"), zone, sent_at.cast("timestamp_ntz"))).otherwise(sent_at.cast("timestamp_ntz"))


def rfc2822_time(header: Column) -> Column:
    """UTC time of a mail date without its weekday; the epoch if it can't be read."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(header, r"^\s*[A-Za-z]{3},\s*", "")), r"\s*\([^)]*\)\s*$", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss")), F.timestamp_seconds(F.lit(0)))


def valid_date(text: Column) -> Column:
    """Whether a text is a date in one of the ISO forms: 2026-01-05, 20260105, 2026-W02-1, 2026W021, 2026-W02, 2026W02."""
    digits = F.regexp_replace(text, r"[-W]", "")
    calendar = F.try_to_timestamp(digits, F.lit("yyyyMMdd")).isNotNull()
    year, week, day = (F.substring(digits, *at).try_cast("int") for at in ((1, 4), (5, 2), (7, 1)))
    # a year has a week 53 if its 28th of December is in one
    weeks = F.weekofyear(F.make_date(F.greatest(year, F.lit(1)), F.lit(12), F.lit(28)))
    by_week = (year >= 1) & week.between(1, weeks) & (day.isNull() | day.between(1, 7))
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{8}$"), calendar & (F.substring(digits, 1, 4) != "0000"))
        .when(text.rlike(r"^\d{4}-W\d{2}(?:-\d)?$|^\d{4}W\d{2}\d?$"), by_week), F.lit(False),
    )


def cited_parts(markdown: Column) -> Column:
    """array<struct<text, n>>: what stands before each citation marker and the marker's number, null after the last."""
    between = F.split(markdown, r"\[\^\d+\]", -1)
    numbers = F.transform(F.regexp_extract_all(markdown, F.lit(r"\[\^(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.zip_with(between, numbers, lambda text, n: F.struct(text.alias("text"), n.alias("n")))


def highlighted(text: Column, quote: Column) -> Column:
    """struct<before, hit, after>: the first place of the quote, whatever its case; a null hit if it isn't there."""
    at = F.instr(F.lower(text), F.lower(quote))
    held = (at > 0) & (F.length(quote) > 0)
    return F.struct(
        F.when(held, F.left(text, at - 1)).otherwise(text).alias("before"), F.when(held, F.substr(text, at, F.length(quote))).alias("hit"),
        F.when(held, F.substr(text, at + F.length(quote))).alias("after"),
    )


def json_or(text: Column, schema: str, default: Column) -> Column:
    """A JSON text as a value, the default where it can't be read."""
    return F.coalesce(F.from_json(text, schema), default)
