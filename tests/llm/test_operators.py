"""Operators of cartwise.llm against brute force, round trips and held-out rows, with the odd cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartwise.llm import (chat, compression_quality, dedup, language, line_rules, mixing, packing, sharding, simhash,
                          toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, kept string, `row` int"


def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, other columns named like results."""
    rows = [
        (1, "Alpha beta gamma\nalpha", "en", "a", "x", 1), (2, "alpha BETA gamma\nalpha", "en", None, "x", 2),
        (3, None, None, "a", None, None), (4, "", "en", "b", "x", 4), (None, "no id at all", "en", "b", "x", 5),
        (None, "no id at all", "en", "b", "x", 5), (5, "é É  ß\t\n\n x", "de", "b", "x", 6), (6, "w " * 30000, "en", "a", "x", 7),
        (7, "same row", "en", "a", "x", 8), (7, "same row", "en", "a", "x", 8), (8, "same row", "en", "a", "x", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ------------------------------------------------------------------ quality rules
def test_line_rules_odd_rows(spark):
    got = line_rules.with_verdict(odd_docs(spark)).collect()
    assert len(got) == 11
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["n_words"] == 0 and by_id[3]["base_failed"] and not by_id[3]["kept"]
    assert by_id[6]["n_words"] == 30000 and by_id[6]["n_repeat_words"] == 30000
    assert by_id[5]["word_chars"] == 4
    assert line_rules.with_verdict(empty_docs(spark)).count() == 0
    assert line_rules.drop_rejected(odd_docs(spark)).columns == odd_docs(spark).columns


def test_repeat_words_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "c"], n)) for n in (0, 1, 2, 3, 4, 9, 40, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", "t", line_rules.base_metrics(F.col("t")).alias("m")).collect():
        w = split_words(r["t"])
        wins = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        covered = {p for k, x in enumerate(wins) if wins.count(x) > 1 for p in (k, k + 1, k + 2)}
        assert r["m"]["n_repeat_words"] == len(covered)


@pytest.mark.parametrize("bound", [1000, 0])
def test_frequent_lines_are_removed_on_both_join_paths(spark, bound):
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(60)]
    rows = [(i, f"Share  this page\n{own[i]}", "h") for i in range(30)] + [(i, own[i], "h") for i in range(30, 58)]
    boiler = " ".join(f"b{k}" for k in range(80))
    rows += [(100 + i, f"{boiler}\n{own[i]} {' '.join(f'z{i}y{k}' for k in range(40))}", "g") for i in range(25)]
    rows += [(200, f"{boiler}\nshort end", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_rules.with_verdict(df, max_broadcast_lines=bound).collect()}
    assert got[3]["lost_words"] == 3 and got[3]["kept"] and "Share" not in got[3]["clean_text"]
    assert got[40]["lost_words"] == 0 and got[40]["kept"]
    assert got[200]["lost_words"] == 80 and not got[200]["kept"]       # depleted: the line is all it has
    assert got[101]["lost_words"] == 80 and got[101]["kept"]           # it still has 100 words of its own


def test_copies_do_not_make_their_lines_frequent(spark):
    text = " ".join(f"own{k}" for k in range(70)) + "\nsecond line of it"
    df = spark.createDataFrame([(i, text, "h") for i in range(300)], "doc_id long, text string, source string")
    assert line_rules.with_verdict(df).where("kept").count() == 300


def test_documents_that_share_their_longest_line_count_each(spark):
    """30 documents of a notice and a short line of their own, three copies of each: all are depleted."""
    notice = " ".join(f"n{k}" for k in range(120))
    rows = [(3 * i + c, f"{notice}\npage {i} of it", "h") for i in range(30) for c in range(3)]
    rows += [(1000 + i, " ".join(f"w{i}x{k}" for k in range(60)), "h") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r["n_docs"] for r in line_rules.frequent_lines(df).collect()] == [30]
    got = {r["doc_id"]: r for r in line_rules.with_verdict(df).collect()}
    assert all(got[i]["lost_words"] == 120 and not got[i]["kept"] for i in range(90))
    assert all(got[1000 + i]["kept"] for i in range(30))


def test_a_line_of_many_documents_is_removed_on_a_large_host(spark):
    """60,000 documents of one host: 1,000 with a line (1.7 %) lose it, 999 with another keep it."""
    i = F.col("id")
    line = F.when(i < 1000, F.lit("many share this\n")).when(i < 1999, F.lit("fewer share that\n")).otherwise(F.lit(""))
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.concat_ws("x", F.lit("w"), i, k)), " ")
    df = spark.range(60000).select(i.alias("doc_id"), F.concat(line, own).alias("text"), F.lit("h").alias("source"))
    assert [r["n_docs"] for r in line_rules.frequent_lines(df).collect()] == [1000]
    got = {(r["doc_id"] < 1000, r["lost_words"], r["kept"]): r["count"]
           for r in line_rules.with_verdict(df).groupBy("doc_id", "lost_words", "kept").count().collect()}
    assert set(got) == {(True, 3, True), (False, 0, True)}


def test_kept_rows_lose_the_removed_lines(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    rows = [(i, f"Share this PAGE \n{own[i]}\n\nlast {i}", "h", 500, i) for i in range(25)]
    rows += [(i, own[i], "h", 7, i) for i in range(25, 30)] + [(99, None, "h", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lost_words int")
    out = line_rules.drop_rejected(df)
    assert out.dtypes == df.dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    assert sorted(got) == list(range(30))
    assert all(got[i]["text"] == f"{own[i]}\n\nlast {i}" and got[i]["n_chars"] == len(got[i]["text"]) for i in range(25))
    assert all((got[i]["text"], got[i]["n_chars"]) == (own[i], 7) for i in range(25, 30))
    assert all(got[i]["lost_words"] == i for i in range(30))
    bare = line_rules.drop_rejected(df.select("source", "doc_id", F.col("text").alias("body")), text_col="body").collect()
    assert {r["doc_id"]: r["body"] for r in bare} == {i: r["text"] for i, r in got.items()}


# ------------------------------------------------------------------ exact dedup
def test_exact_dedup_odd_rows(spark):
    got = dedup.exact_dedup(odd_docs(spark)).collect()
    assert len(got) == 11
    one = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got}
    assert {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (8, 8, 3, True), (7, 8, 3, False)} <= one
    assert sorted(r["kept"] for r in got if r["doc_id"] is None) == [False, True]
    digest = {r["doc_id"]: r["text_sha256"] for r in got}
    assert digest[5] == hashlib.sha256(lowered("é É  ß\t\n\n x").encode()).hexdigest()
    kept = dedup.drop_copies(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "5", "6", "8", "None"]
    assert dedup.exact_dedup(empty_docs(spark)).count() == 0


# ------------------------------------------------------------------ SimHash
def plain_fingerprint(text):
    w = split_words(lowered(text))
    grams = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprint_against_brute_force():
    for t in [None, "", "one", "Two words", "É a B c D e", "x y z " * 50, "Alpha\tbeta\x0bgamma\ndelta"]:
        assert simhash.fingerprint(t) % (1 << 64) == plain_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(1 << 9), base ^ np.uint64(7 << 20), base ^ np.uint64(15 << 40)])
    near = simhash.within(fps, simhash.planes_of(fps), radius)
    got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :len(fps)].astype(bool)
    assert (got == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


def test_components_with_chunked_keys(spark):
    """A group of linked fingerprints larger than a chunk, in chains, keeps all its links."""
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 60, dtype=np.int64)]
    for k in range(0, 160):
        fps.append(fps[-1] ^ (1 << (k % 63)) ^ (1 << ((k * 7 + 3) % 63)))
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, chunk=8)).collect()}
    nodes = sorted(set(fps))
    want = [nodes[i] for i in plain_components(nodes)]
    assert [roots.get(f, f) for f in nodes] == want


def test_simhash_odd_rows(spark):
    got = simhash.simhash_classes(odd_docs(spark)).collect()
    assert len(got) == 11
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == 1
    assert by_id[3]["component_id"] == by_id[4]["component_id"] == 3 and by_id[3]["fingerprint"] == "0" * 16
    assert by_id[8]["component_id"] == 7 and by_id[None]["component_id"] is None
    kept = sorted(str(r["doc_id"]) for r in simhash.drop_near_copies(odd_docs(spark)).collect())
    assert kept == ["1", "3", "5", "6", "7", "None"]
    assert simhash.simhash_classes(empty_docs(spark)).count() == 0


# ------------------------------------------------------------------ mixing
def test_mix_targets_and_limits(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": 9000, "b": 300, "c": 2000, None: 1500}
    rows, i = [], 0
    for source, words in sizes.items():
        while words > 0:
            n = int(min(words, rng.integers(1, 30)))
            rows.append((i, "w " * n, source))
            words, i = words - n, i + 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    total = sum(sizes.values())
    # Weights 1, 2, 3, 1: b stops at 900, then c at 6000; a and the null source share the rest evenly.
    level = (total - 900 - 6000) / 2
    want = {"a": level, "b": 900.0, "c": 6000.0, None: level}
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in sizes}
    for s in sizes:
        target = {r["target"] for r in got if r["source"] == s}
        assert len(target) == 1 and abs(target.pop() - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 30
    assert all(r["taken"] <= 3 * r["size"] for r in got) and sum(taken.values()) <= total
    again = mixing.mix(df.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}


def test_mix_odd_rows(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == 11 and all(r["taken"] == 0 for r in got if not r["size"])
    mixed = mixing.mix_rows(odd_docs(spark))
    assert mixed.columns == odd_docs(spark).columns
    assert mixed.count() == sum(r["passes"] for r in got)
    assert mixing.mix(empty_docs(spark)).count() == 0


# ------------------------------------------------------------------ packing
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_ids_equal_whole_encoding():
    from tokenizers import Tokenizer
    path = tokenizer_path()
    whole, ours = Tokenizer.from_file(path), packing.TextEncoder(open(path, encoding="utf-8").read())
    assert ours.fast is not None
    rng = random.Random(7)
    signs = "ab cdE 's 've 12.\n\t\r \u00e9\u00df\u4e2d\u6587\U0001f642\u200b\u3000\u0301<|endoftext|>"
    texts = ["", " ", "  ", "a  b", "a\n b", "a \nb", "\n\n x  y", "a <|endoftext|> b", "don't we'll 12a345\t x", "é　 ü",
             "it's a_b, c%%% d.\nThe x.\n\ny ², (abc) z.\r\nq", "x\n", "\nx", "a  b", "é f"]
    texts += ["  a", "<|endoftext|>", "x <|endoftext|> y", "\x00\x1c\x85\u00a0\u2028", "ab " * 5000, "a" * 60_000,
             " " * 300_000, "a" + "\t " * 150_000 + "b", *("".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000))]
    texts += ["".join(rng.choices("aB1é,.'_% \n\t-", k=60)) for _ in range(400)]
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}?" for c in points[::7]]
    for t in texts:
        assert np.frombuffer(ours(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def test_other_tokenizers_are_not_taken_for_ranks():
    import json

    from tokenizers import Tokenizer
    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    assert packing.ranks(json.dumps(spec)) is not None
    swapped = json.loads(json.dumps(spec))
    swapped["model"]["merges"][5:7] = swapped["model"]["merges"][6:4:-1]
    prefixed = json.loads(json.dumps(spec))
    prefixed["pre_tokenizer"]["add_prefix_space"] = True
    for other in (swapped, prefixed):
        assert packing.ranks(json.dumps(other)) is None
        text = "The lower newest widest words"
        assert np.frombuffer(packing.TextEncoder(json.dumps(other))(text), "<u4").tolist() == Tokenizer.from_str(json.dumps(other)).encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    path = tokenizer_path()
    whole = Tokenizer.from_file(path)
    docs = odd_docs(spark)
    packed = packing.pack(packing.pieces(docs, path, with_ids=True, capacity=256), capacity=256, shard_items=5)
    rows = packed.collect()
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 256
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d in (3, 5, 6):
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        ids = [x for r in mine for x in r["ids"]]
        assert ids == [*whole.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        assert [r["start"] for r in mine] == list(np.cumsum([0, *[r["length"] for r in mine[:-1]]]))
        assert all(r["length"] == 256 for r in mine[1:])
    for s, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256, s
    sequences = packing.assemble(packed).collect()
    assert sum(r["n_tokens"] for r in sequences) == sum(r["length"] for r in rows)
    assert packing.pack(packing.pieces(empty_docs(spark), path)).count() == 0


def test_search_reaches_the_bound_where_best_fit_does_not():
    rng = np.random.default_rng(0)
    for _ in range(5):
        sizes = []
        for _ in range(60):                       # bins that can be filled exactly
            cuts = np.sort(rng.choice(np.arange(1, 100), 2, replace=False))
            sizes += [int(cuts[0]), int(cuts[1] - cuts[0]), int(100 - cuts[1])]
        before, _ = packing.pack_sizes(sizes, 100, 0)
        after, offset = packing.pack_sizes(sizes, 100, 20)
        assert 60 <= max(after) + 1 <= max(before) + 1
        fill = np.bincount(after, weights=sizes)
        assert fill.max() <= 100 and fill.sum() == sum(sizes)


# ------------------------------------------------------------------ chat
def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>assistant\nhi", "<|im_end|>\n<|im_start|>assistant\nok", "", None, "<<|im_end|>>",
             "plain", "<|im_end|", "ends with <", "\n", "a%0Ab", "日本 <|im_start|>"]
    rows = [(c, t, role, text) for c, (text, other) in enumerate(itertools.product(nasty, nasty))
            for t, (role, text) in enumerate([("user", text), ("assistant", other), ("odd\nro%le<", text)])]
    rows += [(None, 0, None, "x"), (999, None, "user", "tie"), (999, None, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(want[r["conv_id"]]) == r["formatted"].count("<|im_end|>")
        if all("|im_" not in x for _, x in want[r["conv_id"]]):
            assert r["escaped"] == 0
    assert chat.format_conversations(df.limit(0)).count() == 0
    bad = spark.createDataFrame([("<|im_start|>user\nno end",), ("x<|im_start|>a\nb<|im_end|>\n",)], "f string")
    assert [r[0] for r in bad.select(chat.parse(F.col("f"))).collect()] == [None, None]


# ------------------------------------------------------------------ sharding
def test_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 1009)
    counts = np.bincount(table, minlength=10)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_placement_against_brute_force(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 251)
    rows = sharding.place(odd_docs(spark), shards=names, prime=251).collect()
    assert len(rows) == 11
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 251
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.place(empty_docs(spark), shards=names, prime=251).count() == 0


# ------------------------------------------------------------------ classifiers
def toy(n=400):
    rng = np.random.default_rng(4)
    words = ["ba", "co", "du", "fe", "gi", "ho", "ku", "li", "mo", "nu"]
    out = []
    for i in range(n):
        w = ["".join(rng.choice(words, 3)) for _ in range(40)]
        y = i % 4 == 0
        if y:
            w[5] = "vilething"
        if rng.random() < (0.8 if y else 0.1):       # the group is named more often in toxic texts
            w[9] = "muslims"
        out.append((i, " ".join(w), int(y)))
    return out


def test_toxicity_counterfactual_penalty():
    rows = toy()
    y = np.array([r[2] for r in rows], float)
    with_it = toxicity.fit_texts([r[1] for r in rows], y, 0.25)
    without = toxicity.fit_texts([r[1] for r in rows], y, 0.25, penalty=0.0)
    mention = ["the muslims came to the feast"]
    neutral = ["the jews came to the feast"]
    gap = [abs(float(np.subtract(*(np.log(s / (1 - s)) for s in (m.scores(mention)[0], m.scores(neutral)[0]))))) for m in (with_it, without)]
    assert gap[0] < 0.1 * gap[1] and with_it.scores(mention)[0] < 0.5
    assert with_it.scores(["a vilething here"])[0] > 0.5


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_classifiers_on_odd_rows(spark, name):
    op = {"toxicity": toxicity, "quality": compression_quality}[name]
    rng = np.random.default_rng(6)
    labelled = toy(200) if name == "toxicity" else [
        (i, " ".join("".join(rng.choice(list("abcdefgh"), 5)) + ("%%%" if i % 3 == 0 else "") for _ in range(60)), int(i % 3 > 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in labelled] + [(None, 1), (5000, 1), (3, None)], "doc_id long, mark int")
    model = op.fit(docs, labels, "mark")
    scores = {r["doc_id"]: r["score"] for r in op.score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == bool(c) for i, _, c in labelled]) > 0.95
    odd = op.score(odd_docs(spark), model).collect()
    assert len(odd) == 11 and all(0 <= r["score"] <= 1 for r in odd)
    assert op.score(empty_docs(spark), model).count() == 0
    bare = op.fit(docs, labels.limit(0), "mark")
    assert {r["score"] for r in op.score(odd_docs(spark), bare).collect()} == {0.5}


def test_rare_languages_have_models(spark):
    """One document in 400 is Welsh and the sample holds 20 documents of each language."""
    texts = {"en": "the house and the garden with a tree ", "cy": "y ty a'r ardd gyda choeden "}
    rows = [(i, "cy" if i in (7, 1207) else "en", texts["cy" if i in (7, 1207) else "en"] * (1 + i % 3)) for i in range(1600)]
    rows += [(None, "xx", "no id"), (5000, None, "no language"), (5001, "de", None), (7, "cy", texts["cy"])]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5), max_rows=20)
    assert model.languages == ["cy", "en"]
    assert (model.log_likelihoods([texts["cy"], texts["en"]]).argmax(1) == [0, 1]).all()
    few = [r for r in rows[:1600] if r[0] < 12 or r[0] == 1207]
    all_of = language.fit(spark.createDataFrame(few, "doc_id long, lang string, text string"), max_rows=20)
    plain = language.fit_texts([r[1:] for r in few])
    assert all_of.languages == plain.languages and all_of.scores.keys() == plain.scores.keys()
    assert all(np.allclose(all_of.scores[g], plain.scores[g]) for g in plain.scores) and np.allclose(all_of.unseen, plain.unseen)


def test_language_evidence(spark):
    en, de = "the house and the garden with a tree ", "das haus und der garten mit einem baum "
    model = language.fit_texts([("en", en * 5), ("de", de * 5)])
    rows = [(i, f"http://www.a.example.de/{i}", f"<html lang='de'><body>{de * 3}</body></html>") for i in range(30)]
    rows += [(100, "http://www.a.example.de/x", "<html><body>42</body></html>"), (101, "http://b.example.com/x", "<html lang=en><p>7</p></html>"),
             (102, None, None), (103, "http://b.example.com/y", f"<html><script>{de}</script><body>{en * 3}</body></html>"), (None, "x", "")]
    rows += [(200 + i, f"http://c{i}.example.com/", f"<html lang=en>{en * 2}</html>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in language.identify(df, model).collect()}
    assert len(got) == len(rows)
    assert got[0]["lang"] == "de" and got[103]["lang"] == "en" and got[103]["declared"] == ""
    assert got[100]["lang"] == "de"          # no text of its own: its host decides
    assert got[101]["lang"] == "en" and got[102]["host"] == ""
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in got.values())
    assert language.identify(df.limit(0), model).count() == 0


def test_language_posterior_against_brute_force(spark):
    en, de = "the house and the garden ", "das haus und der garten "
    model = language.fit_texts([("en", en * 5), ("de", de * 5)])
    rows = [(i, f"http://h{i % 3}.d{i % 2}.{'com' if i % 4 else 'de'}/", f"<html lang={'en' if i % 5 else 'de'}>{(en if i % 3 else de)[:6 + i]}</html>") for i in range(12)]
    got = {r["page_id"]: r["posterior"] for r in language.identify(
        spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    ll = model.log_likelihoods([language.visible_text(h) for _, _, h in rows])
    p = np.exp(ll - ll.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    hosts = [u.split("/")[2] for _, u, _ in rows]
    said = [re.search(r"lang=(\w\w)", h)[1] for _, _, h in rows]
    for k, (i, _, _) in enumerate(rows):
        prior = np.full(2, 0.5)
        for level in (lambda h: "", lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h):
            own = sum(p[j] for j in range(len(rows)) if level(hosts[j]) == level(hosts[k]) and j != k) + np.zeros(2)
            prior = (own + language.KAPPA * prior) / (own.sum() + language.KAPPA)
        others = sum(p[j] for j in range(len(rows)) if j != k)
        same = sum((p[j] for j in range(len(rows)) if j != k and said[j] == said[k]), np.zeros(2))
        logs = ll[k] + np.log(prior) + np.log((same + language.ALPHA) / (others + language.ALPHA * len(set(said))))
        want = np.exp(logs - logs.max())
        assert np.allclose(got[i], want / want.sum(), atol=1e-9)
