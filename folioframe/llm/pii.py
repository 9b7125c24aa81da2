"""Personal data: patterns propose spans, checksums confirm them, words near by adjust their score. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Secrets: a value that a name gives away, and forms of keys, tokens and certificates that stand by themselves.
_SECRET = (
    r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)[\x22\x27]? ?[=:] ?[\x22\x27]?[A-Za-z0-9+/_.-]{16,}"
    r"|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)
#: Kinds in the order that breaks ties; the first four are the base ones, which always stay. Possessive repeats and
#: look-behinds leave each pattern's leftmost longest match as it is and keep the matcher linear and off the stack.
#: kind: (pattern, what a text must hold for it to match, score, words whose nearness raises the score)
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write|kontakt|correo"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.8, r"\bip\b|address|host|server|login"),
    "card": (r"[0-9](?:[ -]?[0-9])++", None, 0.8, r"card|visa|credit|karte|tarjeta|carte"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.8, r"phone|tel|call|mobile|fax"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", None, 0.8, r"iban|account|bank|konto|cuenta|compte"),
    "ssn": (r"[0-9-]++", "-", 0.3, r"ssn|social|security|tax|insurance"),
    "secret": (_SECRET, None, 0.9, r"key|token|secret|login|auth"),
}
BASE = ("email", "ip", "card", "phone")
#: Added spans stay from this score on; words within so many code points before a span count as near.
ACCEPT, NEAR, BONUS = 0.5, 40, 0.3


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return ~m.rlike(r"(?:^|\.)0*+(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        compact = F.replace(m, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
        # letters count as 10 to 35; the remainder by 97 is carried from one character to the next
        rest = F.aggregate(
            F.split(turned, ""), F.lit(0),
            lambda acc, c: F.when(c >= "A", (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97).cast("int"),
        )
        return F.length(compact).between(15, 34) & (rest == 1)
    if kind == "ssn":
        return m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    if kind == "secret":
        # made values mix digits in; words don't
        return m.rlike("[0-9].*[0-9]|PRIVATE KEY")
    return F.lit(True)


def _found(kind: str, text: Column) -> Column:
    """array<struct<start, stop, match>>, in code points: what lies between two matches gives their places."""
    pattern, must = KINDS[kind][:2]
    held = text.contains(must) if must else F.lit(True)
    held = held & text.rlike("[0-9]") if kind != "email" else held
    matches = F.when(held, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(F.size(F.coalesce(matches, F.array().cast("array<string>"))) > 0, matches)


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """array<struct<start, stop, match>> of the valid matches. The places are carried along as one text and split at the
    end: an array that grew by one at each step would be copied as often."""
    between = F.split(text, KINDS[kind][0], -1)
    steps = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len")))
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], start.cast("string"), F.lit(",")).alias("out"))

    starts = F.split(F.aggregate(steps, none, step)["out"], ",")
    spans = F.zip_with(F.slice(starts, 1, F.size(matches)), matches, lambda a, m: F.struct(a.cast("int").alias("start"), (a.cast("int") + F.length(m)).alias("stop"), m.alias("match")))
    return F.when(matches.isNotNull(), F.filter(spans, lambda x: _valid(kind, x["match"])))


def _scored(kind: str, text: Column, spans: Column) -> Column:
    """Scores spans by kind and by the words near; added kinds below ACCEPT go, base kinds all stay."""
    place, (_, _, score, words) = list(KINDS).index(kind), KINDS[kind]

    def one(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(x["start"] - NEAR + 1, F.lit(1)), F.least(x["start"], F.lit(NEAR))))
        points = F.lit(score) + F.when(before.rlike(words), BONUS).otherwise(0.0)
        fields = {"start": x["start"], "place": F.lit(place), "kind": F.lit(kind), "stop": x["stop"], "match": x["match"], "score": F.round(F.least(points, F.lit(1.0)), 2)}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    out = F.transform(spans, one)
    return out if kind in BASE else F.filter(out, lambda x: x["score"] >= ACCEPT)


def _of_place(i: int):
    return lambda x: x["place"] == i


def find(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """Adds column ``into``: array<struct<start, place, kind, stop, match, score>> by start, then kind as in KINDS.

    Offsets are code points, ends exclusive. A null or empty text has an empty array. Overlapping spans of different
    kinds all stand. Whole texts are read; columns of any other names stay as they are, rows are neither lost nor
    joined, so repeated rows and null ids keep their own results.
    """
    m, s = ({k: fresh(docs, f"_{x}_{k}") for k in KINDS} for x in "ms")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumns({m[k]: _found(k, text) for k in KINDS})
    df = df.withColumns({s[k]: _spans(k, text, F.col(m[k])) for k in KINDS}).drop(*m.values())
    none = F.expr("cast(array() as array<struct<start:int,place:int,kind:string,stop:int,match:string,score:double>>)")
    scored = [F.coalesce(_scored(kind, text, F.col(s[kind])), none) for kind in KINDS]
    return df.withColumn(into, F.array_sort(F.concat(*scored))).drop(*s.values())


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns, with each run of overlapping spans replaced by the tag of its first one, as in <email>."""
    spans, joined_spans = fresh(docs, "_pii"), fresh(docs, "_runs")
    df = find(docs, text_col, spans)
    # as above, what has been found is carried along as a text: start:stop:kind of each run
    told = lambda acc: F.when(acc["stop"] > 0, F.concat(acc["out"], F.concat_ws(":", acc["start"].cast("string"), acc["stop"].cast("string"), acc["kind"]), F.lit(";"))).otherwise(acc["out"])
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("kind"), F.lit("").alias("out"))

    def grow(acc: Column, x: Column) -> Column:
        new = F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), told(acc).alias("out"))
        wider = F.struct(acc["start"].alias("start"), F.greatest(acc["stop"], x["stop"]).alias("stop"), acc["kind"].alias("kind"), acc["out"].alias("out"))
        return F.when(acc["stop"] > x["start"], wider).otherwise(new)

    parts = F.transform(F.filter(F.split(F.aggregate(F.col(spans), none, grow, told), ";"), lambda r: r != ""), lambda r: F.split(r, ":"))
    runs = F.transform(parts, lambda r: F.struct(r[0].cast("int").alias("start"), r[1].cast("int").alias("stop"), r[2].alias("kind")))

    # what is left of the text shrinks, so that no step counts code points from its beginning
    def cut(acc: Column, x: Column) -> Column:
        gap = x["start"] - acc["at"]
        return F.struct(
            x["stop"].alias("at"), F.substr(acc["rest"], gap + (x["stop"] - x["start"]) + 1).alias("rest"),
            F.concat(acc["out"], F.left(acc["rest"], gap), F.lit("<"), x["kind"], F.lit(">")).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.coalesce(F.col(text_col), F.lit("")).alias("rest"), F.lit("").alias("out"))
    rebuilt = F.aggregate(F.col(joined_spans), begin, cut, lambda acc: F.concat(acc["out"], acc["rest"]))
    df = df.withColumn(joined_spans, runs)
    return df.withColumn(text_col, F.when(F.size(spans) > 0, rebuilt).otherwise(F.col(text_col))).select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["place"] < len(BASE))
    return docs.select(
        "doc_id",
        *[F.size(F.filter("pii", _of_place(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda x: x["score"] >= 0.8)).cast("long").alias("n_sure"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their whole texts masked, each row for itself. Null and empty texts stay as they are,
    as do rows without an id and columns of any names; an empty table gives an empty one."""
    return mask(docs)


def _sql_spans(kind: str, pattern: str, ok: str) -> str:
    return f"""select doc_id, r, kind, place, st, st + length(m) en, m from (
        select doc_id, r, '{kind}' kind, {list(KINDS).index(kind)} place, unnest(ms) m,
          unnest(list_transform(ms, lambda x, i: list_sum(list_transform(gaps[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(ms[:i-1], lambda y: length(y))), 0))) st
        from (select doc_id, r, regexp_extract_all(text, '{pattern}') ms, string_split_regex(text, '{pattern}') gaps from d where regexp_matches(text, '{pattern}'))
      ) where {ok}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_NTH = f"cast(substr(reverse({_DIGITS}), cast(i as int), 1) as int)"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: case when i % 2 = 1 then {_NTH} else ({_NTH} * 2) // 10 + ({_NTH} * 2) % 10 end)) % 10 = 0"
_IBAN = "replace(m, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0::bigint, list_transform(string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), ''), lambda c: case when c >= 'A' then ascii(c) - 55 else ascii(c) - 48 end::bigint)), lambda a, b: (a * (case when b > 9 then 100 else 10 end) + b) % 97) = 1"

ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () r from documents),
found as (
  {_sql_spans('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
  union all {_sql_spans('ip', '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', "list_max(list_transform(string_split(m, '.'), lambda p: cast(p as hugeint))) <= 255")}
  union all {_sql_spans('card', '[0-9](?:[ -]?[0-9])+', f"length({_DIGITS}) between 12 and 19 and {_LUHN}")}
  union all {_sql_spans('ssn', '[0-9-]+', "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')")}
  union all {_sql_spans('phone', '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) between 9 and 15")}
  union all {_sql_spans('secret', _SECRET, "regexp_matches(m, '[0-9].*[0-9]|PRIVATE KEY')")}
  union all {_sql_spans('iban', '[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?', f"length({_IBAN}) between 15 and 34 and {_MOD97}")}
), scored as (
  select f.*, least(1.0, case kind {' '.join(f"when '{k}' then {v[2]}" for k, v in KINDS.items())} end
    + case when regexp_matches(lower(case when st = 0 then '' else substr(text, cast(greatest(st - 39, 1) as bigint), cast(least(st, 40) as bigint)) end),
      case kind {' '.join(f"when '{k}' then '{v[3]}'" for k, v in KINDS.items())} end) then 0.3 else 0 end) score
  from found f join d using (r)
), kept as (select * from scored where place < 4 or score >= 0.5)
select d.doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip, count(*) filter (kind = 'card') n_card, count(*) filter (kind = 'phone') n_phone,
  sha256(coalesce(string_agg(kind || ':' || cast(st as bigint) || ':' || cast(en as bigint), ',' order by st, place) filter (place < 4), '')) base_sha256,
  coalesce(string_agg(kind || ':' || cast(st as bigint) || ':' || cast(en as bigint), ',' order by st, place), '') spans,
  count(*) filter (score >= 0.8) n_sure
from d left join kept using (r) group by d.r, d.doc_id
"""
