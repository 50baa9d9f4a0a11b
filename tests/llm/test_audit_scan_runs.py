"""Filter interaction audit, secret scans and periodic runs against brute force, with the odd cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from cartwise.llm import filter_audit, periodic_runs, secret_scan
from cartwise.llm import queries as Q

from .test_operators import empty_docs, odd_docs, split_words


# ------------------------------------------------------------------ filter interaction audit
def test_radix_trie_holds_whole_texts():
    rng, trie, want = random.Random(3), filter_audit.RadixTrie(), {}
    for i in range(3000):
        text = "".join(rng.choice("ab€") for _ in range(rng.randrange(0, 9))) * rng.randrange(1, 3)
        doc_id = rng.randrange(2000)
        trie.insert(text, doc_id, ("p", 0))
        want.setdefault(text, []).append(doc_id)
    got = {t: (least, sum(m.values())) for t, least, m in trie.traverse()}
    assert got == {t: (min(ids), len(ids)) for t, ids in want.items()}

    def labels(node):
        for c, child in node.edges.items():
            assert child.label[0] == c and (child.members is not None or len(child.edges) > 1)   # compressed
            labels(child)
    labels(trie.root)


def plain_masks(rows, conditions):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = collections.Counter()
    for i, text, part in rows:
        t = text or ""
        mask = sum(1 << k for k, c in enumerate(conditions) if c(t))
        if i is not None and i > least.get(t, i):
            mask |= 1 << len(conditions)
        out[i, part or "", mask] += 1
    return out


@pytest.mark.parametrize("flush", [filter_audit.FLUSH, 50])
def test_copy_flags_with_hot_copies_and_shared_beginnings(spark, flush, monkeypatch):
    rng = random.Random(5)
    near = "the same long beginning of many texts " * 40
    rows = [(i, rng.choice(["hot text " * 30] * 4 + [near + str(rng.randrange(300)), f"own {i}", "", None, near]), rng.choice(["en", "de", None]))
            for i in range(2500)]
    rows += [(None, "hot text " * 30, "en"), (None, "", None), (7, "hot text " * 30, "en"), (7, "hot text " * 30, "fr")]
    rng.shuffle(rows)
    taken = []
    monkeypatch.setattr(filter_audit, "trie_pass", lambda *a, f=filter_audit.trie_pass, **k: taken.append(k) or f(*a, **k))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(40)
    got = filter_audit.masks(df, [F.size("words") < 5], salts=4, flush=flush).collect()
    want = plain_masks(rows, [lambda t: len(split_words(t)) < 5])
    have = collections.Counter()
    for r in got:
        have[r["doc_id"], r["part"], r["mask"]] += r["copies"]
    assert have == want
    assert len(taken) == 3                                     # map side, salted hot texts, ranges


def test_adaptive_prefixes(spark):
    assert [filter_audit.whole_level(n) for n in (0, 1, 8, 9, 16, 17, 32, 33, 64, 65)] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4]
    shared = "x" * 100
    df = spark.createDataFrame([(shared + str(i),) for i in range(64)] + [(f"{i} alone",) for i in range(64)] + [("whole",)] * 200, "text string")
    df = df.withColumn("whole", F.udf(lambda t: filter_audit.whole_level(len(t)), "int")("text"))
    heavy = filter_audit.heavy_prefixes(df, 500)
    levels = {r["level"]: r["whole"] for r in heavy.collect()}
    assert set(levels) == {0, 1, 2, 3}                          # 8, 16, 32 and 64 characters; 128 hold the whole texts
    rows = filter_audit.with_prefix(df, heavy, 3).collect()
    assert {r["hot"] for r in rows if r["text"] == "whole"} == {True}
    assert len({r["prefix_hash"] for r in rows if r["text"].startswith(shared)}) == 64
    assert len({(r["prefix_start"], r["prefix_hash"]) for r in rows if "alone" in r["text"]}) == 64
    assert max(len(r["prefix_start"]) for r in rows) <= filter_audit.KEY_CHARS


def plain_audit(rows, labels, conditions):
    fails = []
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in rows:
        t = text or ""
        f = {c for c, cond in conditions.items() if cond(t)} | ({"E"} if i is not None and i > least[t] else set())
        fails.append((part or "", f, labels.get(i, (0, 0))))
    out, names = {}, "".join(conditions) + "E"
    for part in {p for p, _, _ in fails}:
        own, shapley = [(f, m) for p, f, m in fails if p == part], collections.Counter()
        for order in map("".join, itertools.permutations(names)):
            left = list(own)
            for step, c in enumerate(order):
                gone, left_now = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                shapley[c] += len(gone)
                out[part, order, step + 1] = [len(left_now), len(gone), sum(c in f for f, _ in own) - len(gone), sum(f == {c} for f, _ in own),
                                              sum(m[0] for _, m in gone), sum(m[1] for _, m in gone)]
                left = left_now
        for order in map("".join, itertools.permutations(names)):
            for step, c in enumerate(order):
                out[part, order, step + 1].append(shapley[c])
    return out


def test_audit_against_brute_force(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["a", "B", "cc", "#d", "E" * 9, str(rng.randrange(9999))]) for _ in range(rng.choice([0, 3, 150, 250])))
    texts = [text() for _ in range(60)] + [None]
    rows = [(i, rng.choice(texts), rng.choice(["en", "", None, "de"])) for i in range(300)] + [(None, texts[0], "en")]
    marks = {i: (int(rng.random() < 0.5), int(rng.random() < 0.3)) for i in range(0, 320, 2)}
    labels = [(i, *m) for i, m in marks.items()] + [(0, 0, 0), (None, 1, 1), (4, None, None)]      # repeated, without id, null marks
    conditions = {
        "A": lambda t: len(split_words(t)) < 200, "B": lambda t: 100 * len(set(split_words(t))) < 50 * len(split_words(t)),
        "C": lambda t: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": lambda t: bool(re.search("[#$%&*|]", t))}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"mask": F.lit("x"), "words": F.lit(1), "n": F.lit(None)})
    got = filter_audit.audit(docs, filter_audit.standard_filters(), "E", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
                             {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == plain_audit(rows, marks, conditions)
    assert len(got) == 600 * 3


def test_audit_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    marks = {"good_lost": F.col("quality") == 1}
    got = filter_audit.audit(odd_docs(spark), filter_audit.standard_filters(), "E", labels, marks).collect()
    first = {r["part"]: r["kept"] + r["removed"] for r in got if r["step"] == 1 and r["filter_order"] == "EABCD"}
    assert sum(first.values()) == 11 and "" in first
    assert sum(r["removed"] for r in got if r["step"] == 1 and r["filter_order"] == "EABCD") == 2      # ids 4 (of null text 3) and 8
    assert filter_audit.audit(empty_docs(spark), filter_audit.standard_filters(), "E", labels, marks).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(odd_docs(spark), {"E": F.lit(True)}, "E", labels, marks)


# ------------------------------------------------------------------ secret scans
def plain_spans(text, classes=secret_scan.CLASSES, allow=secret_scan.ALLOW):
    text, out = text or "", []
    for rank, (pattern, group) in enumerate([(secret_scan.ASSIGN, 2), (secret_scan.ACCESS, 0), (secret_scan.HEX, 0)]):
        kind, least = list(secret_scan.LEAST.items())[rank]
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    for k, c in enumerate(classes):
        for m in re.finditer(c.pattern, text):
            if re.fullmatch("|".join(f"(?:{a})" for a in allow), m[0]):
                continue
            hot = set()
            for i in range(len(m[0]) - c.window + 1):
                counts = collections.Counter(m[0][i:i + c.window]).values()
                if sum(round(secret_scan.SCALE * n * math.log2(n)) for n in counts) <= c.limit:
                    hot |= set(range(i, i + c.window))
            for a in sorted(hot):
                if a - 1 not in hot:
                    b = a
                    while b in hot:
                        b += 1
                    out.append((m.start() + a, 3 + k, m.start() + b, c.kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def secret_texts():
    rng = random.Random(2)
    make = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    c64 = secret_scan.CLASSES[2].chars
    texts = [f"é😀 Password: '{make(c64, 15)}' and token = {make('0123456789abcdef', 40)} APIKEY={make('abc', 11)}",
             f"AKIA{make(secret_scan.CLASSES[0].chars, 16)} AKIAAKIAAKIAAKIA12 xAKIA1", "token=token: secret = abcdefghijkl password==abcdefghijklm",
             make(c64, 1500), "A" * 300 + make(c64, 40) + "A" * 300 + make(c64, 700), "see some/path/of/words-and-more and 550e8400-e29b-41d4-a716-446655440000",
             " ".join(make("0123456789abcdef", rng.randrange(14, 19)) for _ in range(700)), make(secret_scan.CLASSES[0].chars, 260), None, "", "plain words only",
             "donaudampfschifffahrtsgesellschaft " + make(secret_scan.CLASSES[1].chars, 25), "api-key=abcdefghijklmnop", "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop"]
    texts += ["".join(rng.choice(["a", "Zq9", " ", "=", "token", make(c64, 12), "-", "\n", "ß"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    return texts


def test_secret_scan_against_brute_force(spark):
    texts = secret_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["s"] for r in secret_scan.scan(df).select("doc_id", secret_scan.shown(F.col("spans")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), t
    assert "entropy_base64" in got[3] and got[5] == "" and got[2].startswith("assign:13:34,")


def test_secret_scan_allow_list_and_odd_rows(spark):
    value = "Zx81qPw_93mNbVc7LkJh2T"
    df = spark.createDataFrame([(1, f"call {value} now")], "doc_id long, text string")
    spans = lambda **k: secret_scan.scan(df, **k).first()["spans"]
    assert [s["kind"] for s in spans()] == ["entropy_base64"] and (spans()[0]["start"], spans()[0]["end"]) == (5, 5 + len(value))
    assert spans(allow=[*secret_scan.ALLOW, "Zx81.*"]) == [] and spans(allow=[]) == spans()
    got = secret_scan.scan(odd_docs(spark))
    assert got.count() == 11 and got.where(F.size("spans") > 0).count() == 0
    assert secret_scan.scan(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        secret_scan.scan(df, classes=[secret_scan.CharClass("bad", "ab]", 4, 1.0)])


def test_secret_scan_is_native_and_linear(spark):
    plan = secret_scan.scan(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan.split("Scan")[0])
    rng = random.Random(4)
    blob = "".join(rng.choice(secret_scan.CLASSES[2].chars) for _ in range(100_000))
    many = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(17)) for _ in range(30_000))
    df = spark.createDataFrame([(1, blob), (2, many)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["n"] for r in secret_scan.scan(df).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got[2] >= 30_000 and got[1] >= 1 and time.time() - began < 60


# ------------------------------------------------------------------ periodic runs
def plain_runs(w, least):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(w[i + p:i + length] == w[i:i + length - p] for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_words(rng, most):
    n = rng.randrange(0, most)
    w = [rng.choice("abcd"[:rng.randrange(1, 5)]) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randrange(1, 9)
        w = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < n else "z" for i in range(a, n)]
    return w


def test_runs_of_words_against_brute_force():
    rng = random.Random(6)
    for _ in range(600):
        w, least = run_words(rng, 70), rng.choice([2, 3, 5, 12])
        numbers = [ord(x) - 96 for x in w]
        assert periodic_runs.runs_of(numbers, least) == plain_runs(w, least)
        assert periodic_runs.document_runs([x.encode() for x in w], least) == plain_runs(w, least)


def test_longest_common_extensions():
    rng = random.Random(8)
    s = [rng.randrange(1, 3) for _ in range(300)] + [1, 2] * 60
    tree = periodic_runs.SuffixTree(s)
    i, j = zip(*[rng.sample(range(len(s) + 1), 2) for _ in range(4000)], strict=True)
    import numpy as np
    got = tree.extension(np.array(i), np.array(j)).tolist()
    for a, b, k in zip(i, j, got, strict=True):
        assert s[a:a + k] == s[b:b + k] and (max(a, b) + k == len(s) or s[a + k] != s[b + k])
    ends = [s[k:] for k in range(len(s) + 1)]
    assert [tree.rank[k] for k in sorted(range(len(s) + 1), key=lambda k: ends[k])] == list(range(len(s) + 1))
    turned = tree.turned_rank()
    assert [turned[k] for k in sorted(range(len(s) + 1), key=lambda k: [-x for x in ends[k]])] == list(range(len(s) + 1))


def test_runs_of_long_documents_end_in_time():
    began = time.time()
    assert periodic_runs.runs_of([1] * 40_000) == [(0, 40_000, 1)]
    assert (1000, 99_000, 3000) in periodic_runs.document_runs([str(i).encode() for i in range(1000)] + [b"w%d" % (i % 3000) for i in range(99_000)])
    assert time.time() - began < 30


def test_find_runs_odd_rows(spark):
    got = periodic_runs.find_runs(odd_docs(spark)).collect()
    assert len(got) == 11
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[6]["runs"] == [(0, 30000, 1)] and by_id[6]["collapsed"] == "w"
    assert by_id[3]["runs"] == [] and by_id[3]["collapsed"] == "" and by_id[3]["n_words"] == 0
    assert by_id[5]["collapsed"] == "é É ß x"
    assert periodic_runs.find_runs(empty_docs(spark)).count() == 0


def plain_op13(doc_id, text):
    w = split_words(text)
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc_id, len(runs), *(top if top else (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abc") * rng.randrange(1, 4) for _ in range(rng.randrange(150)))) for i in range(400)]
    rows += [(1000 + i, rng.choice(["\t", " \n"]).join(run_words(rng, 200))) for i in range(100)] + [(None, "a " * 20), (5000, None), (5001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, Q.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain_op13(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 50
