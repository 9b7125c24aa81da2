"""Passages, embeddings, BM25 and cosine rankings, their fusion, and what surrounds an answer."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from ..functions import text as T
from ..plans.scratch import Scratch
from .relational import answer_confidence
from .segments import Segments

K1, B, RRF_K, DIM, PASSAGE_WORDS = 1.2, 0.75, 60, 1024, 120


def split_passages(text: str, most: int = PASSAGE_WORDS) -> list[str]:
    """Paragraphs packed to at most ``most`` words; longer ones are cut at sentence ends, a longer sentence stays whole."""

    def packed(units, glue):
        out, words = [], 0
        for u in units:
            n = len(u.split())
            if out and words + n <= most:
                out[-1] += glue + u
                words += n
            else:
                out.append(u)
                words = n
        return out

    units = []
    for p in (p.strip() for p in re.split(r"\n\s*\n", text or "")):
        if p:
            units += [p] if len(p.split()) <= most else packed(re.split(r"(?<=[.!?])\s+", p), " ")
    return packed(units, "\n\n")


@F.pandas_udf(ArrayType(StringType()))
def passages(text: pd.Series) -> pd.Series:
    return text.map(split_passages)


def passage_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(passages(text)).alias("pos", "passage"))


#: Codes of words and 4-grams that a worker keeps between batches, at most; speed alone depends on it.
KNOWN = 400_000
_known: dict[str, int] = {}


def _hashed(grams: list[str]) -> np.ndarray:
    """Twice the bucket of each gram, and one more where its sign is minus."""
    h = np.frombuffer(b"".join([hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams]), "<u8")
    return (h % np.uint64(DIM) * np.uint64(2) + (h >> np.uint64(63))).astype(np.int64)


def _codes(grams: list[str]) -> np.ndarray:
    """The same for grams that texts share with those before, each hashed once."""
    new = [g for g in grams if g not in _known]
    if len(_known) + len(new) > KNOWN:
        _known.clear()
        new = grams
    code = _hashed(new)
    if len(new) == len(grams):
        if len(new) <= KNOWN:
            _known.update(zip(new, code.tolist()))
        return code
    _known.update(zip(new, code.tolist()))
    return np.fromiter(map(_known.__getitem__, grams), np.int64, len(grams))


def _words(texts: list[str]):
    """(text, gram, count, codes) of the texts' words, then of their pairs of neighbours, which are numbered, so that each is
    hashed once for all texts."""
    held = [re.findall(r"\w+", t) for t in texts]
    number: dict[str, int] = {}
    word = np.array([number.setdefault(w, len(number)) for words in held for w in words], np.int64)
    text, names = np.repeat(np.arange(len(held)), [len(words) for words in held]), list(number)
    at, count = np.unique(text * max(len(names), 1) + word, return_counts=True)
    yield *np.divmod(at, max(len(names), 1)), count, _codes(names)
    next_to = np.flatnonzero(text[:-1] == text[1:])
    distinct, of = np.unique(word[next_to] * max(len(names), 1) + word[next_to + 1], return_inverse=True)
    at, count = np.unique(text[next_to] * max(distinct.size, 1) + of, return_counts=True)
    left, right = np.divmod(distinct, max(len(names), 1))
    yield *np.divmod(at, max(distinct.size, 1)), count, _hashed([f"{names[a]}_{names[b]}" for a, b in zip(left.tolist(), right.tolist())])


def _four_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, gram, grams): how often which of the distinct 4-grams stands in which text, as rows (text * grams + gram, count)
    and the grams themselves. Code points are numbered within the batch, so that four of them are one number."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    whole = np.flatnonzero(text[:-3] == text[3:]) if points.size > 3 else np.zeros(0, np.int64)
    alphabet, code = np.unique(points, return_inverse=True)
    key, base = np.zeros(whole.size, object if alphabet.size > 1 << 15 else np.int64), max(int(alphabet.size), 1)
    for k in range(4):
        key = key * base + code[whole + k]
    distinct, of = np.unique(key, return_inverse=True)
    pair, count = np.unique(text[whole] * max(distinct.size, 1) + of, return_counts=True)
    parts = []
    for _ in range(4):
        parts.append(alphabet[(distinct % base).astype(np.int64)] if distinct.size else alphabet[:0])
        distinct = distinct // base
    joined = np.stack(parts[::-1], 1).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return pair, count, [joined[k : k + 4] for k in range(0, len(joined), 4)]


def embed_texts(texts: list[str]) -> np.ndarray:
    """Signed counts of hashed words, word pairs and 4-grams, damped, of length one; a row a text. A gram is hashed once
    for all texts."""
    texts = [(t or "").casefold() for t in texts]
    pair, times, grams = _four_grams(texts)
    v = np.zeros(len(texts) * DIM)
    for text, gram, count, codes in (*_words(texts), (*np.divmod(pair, max(len(grams), 1)), times, _codes(grams))):
        code = codes[gram]
        v += np.bincount(text * DIM + (code >> 1), np.where(code & 1, -count, count), v.size)
    v = v.reshape(len(texts), DIM)
    v = np.sign(v) * np.log1p(np.abs(v))
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=v, where=n > 0).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    """The vectors of embed_texts."""
    return pd.Series([v for at in range(0, len(text), 128) for v in embed_texts(text.iloc[at : at + 128].tolist())], index=text.index, dtype=object)


def embed(rows: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with vec, fresh cache rows): texts of the cache aren't embedded again."""
    keyed = rows.withColumn("key", F.sha2(F.concat(F.lit("hash:"), F.col(text)), 256))
    missing = keyed.select("key", text).dropDuplicates(["key"]).join(cache, "key", "left_anti").select("key", hash_embedding(text).alias("vec"))
    missing = Scratch(rows.sparkSession, "embed").write(missing)  # both results read it; a vector is computed once
    return keyed.join(cache.unionByName(missing), "key"), missing


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_normalized(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings(docs: DataFrame, key: str, text: Column, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, term, tf, dl) and (n_docs, avgdl). With terms, only theirs are exploded; lengths count every word."""
    tok = docs.select(key, words_of(text).alias("w")).withColumn("dl", F.size("w"))
    kept = F.filter("w", lambda w: w.isin(*terms)) if terms else F.col("w")
    tf = tok.select(key, "dl", F.explode(kept).alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    return tf, tok.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25(docs: DataFrame, key: str, text: Column, terms: list[str], k: int | None = None) -> DataFrame:
    """(key, score) by falling score, then key: the sum over terms of idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl))."""
    tf, stats = postings(docs, key, text, terms)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = s.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.col("score").desc(), key)
    return out.limit(k) if k else out


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, score): the k rows of highest cosine with the query, ties by key; a top-k, never a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def ranked(df: DataFrame, key: str, score: str = "score") -> DataFrame:
    return df.select(key, F.row_number().over(Window.orderBy(F.col(score).desc(), key)).alias("rank"))


def rrf(rankings: list[DataFrame], key: str, top: int | None = None, k: int = RRF_K) -> DataFrame:
    """(key, score): the sum of 1 / (k + rank) over rankings (key, rank), ties by first rank, then key."""
    both = rankings[0]
    for r in rankings[1:]:
        both = both.unionByName(r)
    out = both.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"), F.min("rank").alias("best")).orderBy(F.col("score").desc(), "best", key).drop("best")
    return out.limit(top) if top else out


def retrieve(docs: DataFrame, vectors: DataFrame, key: str, text: str, vector: str, question: str, query: list[float], first: int = 30, top: int = 8) -> DataFrame:
    """Fusion of the two rankings; a question without terms has only the second."""
    spark = docs.sparkSession
    terms = spark.range(1).select(T.query_terms(F.lit(question)).alias("t")).first()["t"]
    rankings = [ranked(nearest(vectors, key, vector, query, first), key)]
    if terms:
        rankings.insert(0, ranked(bm25(docs, key, F.col(text), terms, first), key))
    return rrf(rankings, key, top)


def field_postings(rows: DataFrame, key: str, fields: list[str], terms: list[str] | None = None) -> DataFrame:
    """(key, field, term, tf, dl) of several text columns; dl: the words of all columns of the row."""
    held = [words_of(F.coalesce(F.col(c), F.lit(""))) for c in fields]
    tok = rows.select(key, *[w.alias(f"_w{i}") for i, w in enumerate(held)])
    tok = tok.withColumn("dl", sum((F.size(f"_w{i}") for i in range(len(fields))), F.lit(0)))
    kept = lambda c: F.filter(c, lambda w: w.isin(*terms)) if terms else F.col(c)
    each = F.flatten(F.array(*[F.transform(kept(f"_w{i}"), lambda w, i=i: F.struct(F.lit(c).alias("field"), w.alias("term"))) for i, c in enumerate(fields)]))
    return tok.select(key, "dl", F.explode(each).alias("p")).groupBy(key, "dl", "p.field", "p.term").agg(F.count("*").alias("tf")).select(key, "field", "term", "tf", "dl")


def build_index(rows: DataFrame, key: str, fields: list[str], root: str, name: str) -> None:
    """Writes the index of a table's text columns (``Segments``). Replaces an index of that name."""
    index = Segments(rows.sparkSession, root, name)
    index.clear()
    index.refresh(rows, key, fields)


def search(spark, root: str, name: str, key: str, terms: list[str], k: int, weights: dict | None = None) -> DataFrame:
    """(key, score): BM25 over a written index. A term's frequency in a row is the weighted sum over its columns."""
    return Segments(spark, root, name).search(key, terms, k, weights)


def _scored(posts: DataFrame, stats: DataFrame, key: str, k: int | None, weights: dict | None = None) -> DataFrame:
    weight = F.lit(1.0)
    for c, w in (weights or {}).items():
        weight = F.when(F.col("field") == c, float(w)).otherwise(weight)
    tf = posts.groupBy(key, "term", "dl").agg(F.sum(F.col("tf") * weight).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = s.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.col("score").desc(), key)
    return out.limit(k) if k else out


def bm25_fields(rows: DataFrame, key: str, fields: list[str], terms: list[str], k: int | None = None, weights: dict | None = None) -> DataFrame:
    """The same without a written index."""
    size = sum((F.size(words_of(F.coalesce(F.col(c), F.lit("")))) for c in fields), F.lit(0))
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg(size).alias("avgdl"))
    return _scored(field_postings(rows, key, fields, terms), stats, key, k, weights)


def index_ledger(emails: DataFrame, decisions: DataFrame, cache: DataFrame, root: str) -> dict[str, DataFrame]:
    """Builds, or brings up to date, all that a question reads: passages of new and forwarded text with their vectors, decisions with
    theirs, and the postings of both. Texts in the cache (key, vec) aren't embedded again, and rows that are as they were aren't
    read for words again; fresh holds what to add to the cache."""
    parts = emails.select("message_id", "sent_at", F.posexplode(F.array("new_text", "fwd_text")).alias("part", "text"))
    rows = parts.select("message_id", "sent_at", "part", F.posexplode(passages("text")).alias("pos", "text"))
    vectors, fresh = embed(rows.select("message_id", "part", "pos", "text"), cache)
    told = decisions.withColumn("text", F.trim(F.concat_ws(" ", "canonical_text", "rationale")))
    of_decisions, more = embed(told.select("decision_id", "text"), cache.unionByName(fresh))
    pid = F.concat_ws("#", "message_id", F.col("part").cast("string"), F.col("pos").cast("string"))
    passages_of = vectors.select(pid.alias("passage_id"), "message_id", "text", "vec")
    passages_of.write.mode("overwrite").parquet(f"{root}/passages")
    of_decisions.select("decision_id", "vec").write.mode("overwrite").parquet(f"{root}/decision_vectors")
    spark = emails.sparkSession
    Segments(spark, root, "passages").refresh(spark.read.parquet(f"{root}/passages"), "passage_id", ["text"])
    Segments(spark, root, "decisions").refresh(decisions, "decision_id", ["canonical_text", "rationale"])
    return {"passages": passages_of, "fresh": fresh.unionByName(more).dropDuplicates(["key"])}


def retrieve_ledger(spark, root: str, question: str, first_decisions: int = 30, first_passages: int = 40, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """(decision_id, score) and (passage_id, score) for a question over a built index: BM25 and cosine fused."""
    asked = spark.createDataFrame([(question,)], "q string").select(T.query_terms(F.col("q")).alias("t"), hash_embedding("q").alias("v")).first()
    out = []
    for name, key, vectors, first in (("decisions", "decision_id", "decision_vectors", first_decisions), ("passages", "passage_id", "passages", first_passages)):
        found = [ranked(nearest(spark.read.parquet(f"{root}/{vectors}"), key, "vec", list(asked["v"]), first), key)]
        if asked["t"]:
            found.insert(0, ranked(search(spark, root, name, key, asked["t"], first), key))
        out.append(rrf(found, key, top))
    return out[0], out[1]


def index_stamp(*tables: tuple[DataFrame, str]) -> DataFrame:
    """(n, checksum) of each table's texts: it changes whenever one does."""
    rows = [t.agg(F.lit(i).alias("i"), F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(c).cast("decimal(38,0)")), F.lit(0)).alias("checksum")) for i, (t, c) in enumerate(tables)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def check_answer(answers: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Per answer: citations that hold, and errors: markers without a citation, quotes that aren't verbatim in the cited
    message, decisions that aren't there. answers (answer_id, answer_md, citations, decision_ids), texts (message_id,
    new_text, fwd_text), known (decision_id)."""
    from ..functions.matching import exact_span, fuzzy_span

    cites = answers.select("answer_id", F.explode("citations").alias("c")).select("answer_id", "c.n", "c.message_id", "c.quote")
    seen = cites.join(texts, "message_id", "left")
    span = F.coalesce(exact_span("quote", "new_text"), exact_span("quote", "fwd_text"), fuzzy_span("quote", "new_text"), fuzzy_span("quote", "fwd_text"))
    seen = seen.select("answer_id", "n", "message_id", "quote", span.alias("found"))
    good = seen.where("found is not null").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("n", "message_id", F.col("found").alias("quote")))).alias("cites"))
    bad = seen.where("found is null").select("answer_id", F.concat(F.lit("citation [^"), F.col("n").cast("string"), F.lit("] quote is not verbatim in "), F.col("message_id")).alias("error"))
    loose = answers.select("answer_id", F.explode(F.array_except(T.markers(F.col("answer_md")), F.transform("citations", lambda c: c["n"]))).alias("n")).select("answer_id", F.concat(F.lit("marker [^"), F.col("n").cast("string"), F.lit("] has no citation")).alias("error"))
    unknown = answers.select("answer_id", F.explode("decision_ids").alias("decision_id")).join(known, "decision_id", "left_anti").select("answer_id", F.concat(F.lit("unknown decision id "), F.col("decision_id")).alias("error"))
    errors = loose.unionByName(bad).unionByName(unknown).groupBy("answer_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    return answers.select("answer_id").join(good, "answer_id", "left").join(errors, "answer_id", "left")


def answered(answers: DataFrame, retries: DataFrame | None, texts: DataFrame, decisions: DataFrame) -> DataFrame:
    """What a question is told, of answers (answer_id, answer) as ANSWERS["answer"] and second answers to those with errors.

    A second answer stands in unless it has more errors. An answer whose text says that nothing was decided has that
    status. Statements without a verified citation go, and what is left out is a caveat. (answer_id, status, answer_md,
    citations, decision_ids, confidence, model_confidence, caveats, closest, verification_errors)."""
    flat = lambda a: a.select("answer_id", "answer.answer_md", "answer.citations", "answer.decision_ids")
    none = F.array().cast("array<string>")
    known = decisions.select("decision_id")

    def checked(a: DataFrame, mark: str) -> DataFrame:
        got = check_answer(flat(a), texts, known)
        return a.select("answer_id", F.col("answer").alias(f"a{mark}")).join(got.select("answer_id", F.col("cites").alias(f"c{mark}"), F.coalesce("errors", none).alias(f"e{mark}")), "answer_id", "left")

    both = checked(answers, "1")
    if retries is not None:
        both = both.join(checked(retries, "2"), "answer_id", "left")
        again = F.col("a2").isNotNull() & (F.size("e1") > 0) & (F.size("e2") <= F.size("e1"))
        pick = lambda c: F.when(again, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    else:
        pick = lambda c: F.col(f"{c}1")
    one = both.select("answer_id", pick("a").alias("a"), pick("c").alias("cites"), pick("e").alias("errors"))
    says_none = F.col("a.status").isin("found", "partial") & F.col("a.answer_md").rlike(T.NO_DECISION)
    one = one.withColumn("status", F.when(says_none, "no_decision").otherwise(F.col("a.status")))
    numbers = F.coalesce(F.transform("cites", lambda c: c["n"]), F.array().cast("array<int>"))
    one = one.withColumn("told", T.enforce_citations(F.col("a.answer_md"), numbers, F.col("status")))
    cited = one.select("answer_id", F.explode("a.decision_ids").alias("decision_id")).join(decisions.select("decision_id", "decision_type"), "decision_id")
    explicit = cited.groupBy("answer_id").agg(F.min(F.col("decision_type") == "explicit").alias("all_explicit"), F.array_sort(F.collect_set("decision_id")).alias("used"))
    one = one.join(explicit, "answer_id", "left")
    sources = F.size(F.array_distinct(F.coalesce(F.transform("cites", lambda c: c["message_id"]), none)))
    level = answer_confidence(F.col("status"), F.size("errors"), F.size(numbers), sources, F.size(F.coalesce("a.closest", F.array().cast("array<struct<message_id:string,why:string>>"))), F.col("all_explicit"))
    gone = F.col("told.dropped")
    note = F.when(gone > 0, F.array(F.concat(gone.cast("string"), F.lit(" statement(s) without a verified citation were left out")))).when(F.size("errors") > 0, F.array(F.lit("some citations couldn't be verified and were left out"))).otherwise(none)
    return one.select(
        "answer_id", "status", F.col("told.text").alias("answer_md"), F.coalesce("cites", F.array().cast("array<struct<n:int,message_id:string,quote:string>>")).alias("citations"), F.coalesce("used", none).alias("decision_ids"),
        level.alias("confidence"), F.col("a.confidence").alias("model_confidence"), F.concat(F.coalesce("a.caveats", none), note).alias("caveats"), F.col("a.closest").alias("closest"), F.col("errors").alias("verification_errors"),
    )
