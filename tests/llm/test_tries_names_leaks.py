"""Prefix tries, name joins and decontamination against brute force in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioframe.llm import leaks, names, trie

CONV = "conv_id long, turn long, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def nodes_of(convs: dict) -> list:
    """Rows of the trie of {id: [(role, text)]}."""
    members, ends, last = defaultdict(set), defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            last[tuple(turns[:d])] = len(turns[d - 1][1].encode()) if d else 0
        ends[tuple(turns)].append(c)
    out = []
    for node, held in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = sum(not any(m[:-1] == b for m in members if len(m) == len(b) + 1) for b in below)
        saved = sum((len(members[m]) - 1) * last[m] for m in below)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(kids), leaves, saved, sha(",".join(map(str, sorted(ends[node]))))))
    return sorted(out, key=str)


def as_rows(df) -> list:
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def random_conversations(seed: int, n: int, words: int = 3, longest: int = 7) -> dict:
    rng = random.Random(seed)
    return {c: [(rng.choice(("user", "")), "é" * rng.randrange(words)) for _ in range(rng.randrange(1, longest))] for c in rng.sample(range(4 * n), n)}


def frame(spark, convs: dict):
    rows = [(c, None if k == 0 else k, role or None, text or None) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, CONV).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_plain_prefixes(spark, seed):
    convs = random_conversations(seed, 90)
    assert as_rows(trie.prefix_trie(frame(spark, convs))) == nodes_of(convs)


def test_trie_of_a_deep_path_with_many_light_levels(spark):
    # a caterpillar whose legs branch again, one long conversation, and many that only start with its turns
    convs = {k: [("u", "a")] * k + [("u", "b")] * (k % 3) for k in range(1, 40)} | {100: [("u", "a")] * 120}
    assert as_rows(trie.prefix_trie(frame(spark, convs))) == nodes_of(convs)


def test_rebuilt_conversations(spark):
    convs = random_conversations(5, 70, words=2, longest=11)
    want = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert as_rows(trie.trie(*trie.rebuilt(trie.turns_of(frame(spark, convs))))) == nodes_of(want)


def test_trie_of_awkward_rows(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (2, None, None, None), (None, 0, "u", "x"), (3, 1, "u", "y" * 300_000)]
    df = spark.createDataFrame(rows, CONV).withColumns({"c": F.lit(1), "pos": F.lit(2), "d": F.lit("d"), "h1": F.lit(0)})
    assert as_rows(trie.prefix_trie(df)) == nodes_of({1: [("u", "x")] * 2, 2: [("", "")], 3: [("u", "y" * 300_000)]})
    assert trie.prefix_trie(df.where("false")).collect() == []
    turnless = spark.createDataFrame([(c, 0, "u", "x") for c in (6, 7)], CONV)  # h is above 0 and conversation 5 isn't there
    assert as_rows(trie.trie(*trie.rebuilt(trie.turns_of(turnless)))) == nodes_of({6: [], 7: []})


def osa(a: str, b: str) -> int:
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def edited(rng, name: str, alphabet: str) -> str:
    for _ in range(rng.randrange(4)):
        kind, at = rng.randrange(4), rng.randrange(len(name) + 1)
        if kind == 0:
            name = name[:at] + rng.choice(alphabet) + name[at:]
        elif kind == 1:
            name = name[:at] + name[at + 1 :]
        elif kind == 2 and at < len(name):
            name = name[:at] + rng.choice(alphabet) + name[at + 1 :]
        elif at + 1 < len(name):
            name = name[:at] + name[at + 1] + name[at] + name[at + 2 :]
    return name


@pytest.mark.parametrize("alphabet, lengths", [("ab", range(1, 10)), ("abé😀", range(1, 8)), ("abcdefgh -", range(3, 22))])
def test_names_within_two_edits(spark, alphabet, lengths):
    rng = random.Random(len(alphabet))
    left = {"".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(120)}
    right = {x for name in left for x in (edited(rng, name, alphabet) for _ in range(4)) if x} | {"".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(100)}
    rows = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None, ""]], "name string").withColumn("key", F.lit(1))
    got = names.near_names(rows(left), rows(right)).collect()
    want = {(a, b): d for a in left for b in right if (d := osa(a, b)) <= 2}
    assert {(r["cut_name"], r["whole_name"]): r["distance"] for r in got} == want and len(got) == len(want)
    flat = [(a, b) for a in list(left)[:60] for b in list(right)[:200]]
    assert names.distances([a for a, _ in flat], [b for _, b in flat]).tolist() == [min(osa(a, b), 3) for a, b in flat]


def test_swaps_at_every_cut_are_found(spark):
    # two swaps, at both cuts, for every length: no piece stays as it was
    left = ["".join(chr(97 + k) for k in range(n)) for n in range(3, 25)]
    right = set()
    for x in left:
        for i in range(len(x) - 1):
            y = x[:i] + x[i + 1] + x[i] + x[i + 2 :]
            right |= {y} | {y[:j] + y[j + 1] + y[j] + y[j + 2 :] for j in range(len(x) - 1)} | {y[:j] + y[j + 1 :] for j in range(len(x))} | {y[:j] + "#" + y[j:] for j in range(len(x) + 1)}
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = {(r["cut_name"], r["whole_name"]): r["distance"] for r in names.near_names(df(left), df(right)).collect()}
    assert got == {(a, b): d for a in left for b in right if abs(len(a) - len(b)) <= 2 and (d := osa(a, b)) <= 2}


def test_name_query_counts_clients(spark, tmp_path):
    rng = random.Random(9)
    clients = [(k if k % 17 else None, rng.choice((None, "", "ana lo", "ana lol", "naa lo", "bo", "b"))) for k in range(200)]
    vendors = [(k, rng.choice((None, "", "ana lo", "aan lo", "bo", "c", "quite another name"))) for k in range(40)] + [(3, "ana lo"), (3, "ana lo")]
    spark.createDataFrame(clients, "client_id long, name string").write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame(vendors, "vendor_id long, name string").write.parquet(f"{tmp_path}/vendors.parquet")
    want = defaultdict(list)
    for v, name in set(vendors):
        if name:
            h, form = zlib.crc32(str(v).encode()), name
            if h % 2 == 0 and len(name) > 1:
                at = h % (len(name) - 1)
                form = name[:at] + name[at + 1] + name[at] + name[at + 2 :]
            for c, other in clients:
                if other and osa(form, other) <= 2:
                    want[v, osa(form, other)].append(c)
    got = {(r["vendor_id"], r["distance"]): (r["n_clients"], r["first_client_id"], r["clients_crc"]) for r in names.op12(spark, str(tmp_path)).collect()}
    known = {k: [c for c in v if c is not None] for k, v in want.items()}
    assert got == {k: (len(v), min(known[k]), sum(zlib.crc32(str(c).encode()) for c in known[k])) for k, v in want.items()}


def test_very_long_names(spark):
    long = "".join(chr(97 + k * k % 23) for k in range(20_000))
    other = long[:7000] + long[7001] + long[7000] + long[7002:-1]
    assert osa(long[6990:7010], other[6990:7010]) == 1
    got = names.near_names(spark.createDataFrame([(long,)], "name string"), spark.createDataFrame([(other,), (long[::-1],)], "name string")).collect()
    assert [(r["whole_name"] == other, r["distance"]) for r in got] == [(True, 2)]


DOCS = "doc_id long, text string"


def hit_words(text: str | None, items: list, window: int) -> tuple:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    found = list(word.finditer(fold(text)))
    w, hit, ids = [m[0] for m in found], set(), set()
    for item, t in items:
        of = word.findall(fold(t))
        k = min(window, len(of))
        for at in range(len(of) - k + 1) if k else ():
            for p in range(len(w) - k + 1):
                if w[p : p + k] == of[at : at + k]:
                    hit |= set(range(p, p + k))
                    ids |= {str(item)} if item is not None else set()
    runs = [p for p in sorted(hit) if p - 1 not in hit]
    ends = [p for p in sorted(hit) if p + 1 not in hit]
    return len(w), len(hit), sorted(ids), [(found[a].start(), found[b].end()) for a, b in zip(runs, ends)], bool(hit)


@pytest.mark.parametrize("seed, words", [(1, 100_000), (2, 100_000), (3, 25)])
def test_contamination_is_that_of_plain_windows(spark, seed, words, monkeypatch):
    monkeypatch.setattr(leaks, "PIECE", 7)
    rng = random.Random(seed)
    vocabulary = ["a", "B", "ça", "日本", "x1", "é", "😀k"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice((" ", "-", "\n", "…", "'", ", ")) for _ in range(n))
    items = [(k % 9 if k else None, text(rng.choice((0, 1, 2, 3, 4, 5, 9, 30)))) for k in range(12)] + [(20, None), (21, "?!")]
    docs = [(k // 2 if k else None, (text(rng.randrange(30)) + rng.choice(items)[1 if k % 2 else 0].__str__().upper()) if k % 7 else None) for k in range(60)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"n_words": F.lit("old"), "_row": F.lit(1), "item": F.lit(2)})
    got = leaks.scan(df, spark.createDataFrame(items, "item_id int, text string"), window=4, words=words)
    assert got.columns == ["doc_id", "text", "_row", "item", "n_words", "items", "n_hit", "spans", "contaminated"]
    as_told = lambda r: (r["n_words"], r["n_hit"], r["items"], [(s["from"], s["to"]) for s in r["spans"]], r["contaminated"])
    assert sorted((str(r["doc_id"]), r["text"] or "", as_told(r)) for r in got.collect()) == sorted((str(i), t or "", hit_words(t, items, 4)) for i, t in docs)


def test_contamination_of_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 64)
    item = " ".join(f"w{k}" for k in range(14))
    long = "filler " * 3000 + item.upper() + "," + " pad" * 3000 + "é" * 400 + " " + item
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (2, ""), (3, "x" * 100_000)], DOCS)
    for k, window in ((10, 10), (3, 3)):
        rows = {r["doc_id"]: r for r in leaks.scan(docs, bench, window=window).collect()}
        first = long.index("W0")
        assert [(s["from"], s["to"]) for s in rows[1]["spans"]] == [(first, first + len(item)), (len(long) - len(item), len(long))]
        assert (rows[1]["n_hit"], rows[1]["items"], rows[2]["n_words"], rows[3]["n_words"], rows[3]["contaminated"]) == (28, ["1"], 0, 1, False)
    assert leaks.scan(docs.where("false"), bench).collect() == []
    assert [r["n_hit"] for r in leaks.scan(docs, bench.where("false")).collect()] == [0, 0, 0]
