"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables
and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, common, jaccard_join, kn_quality, kn_shards, langid, license_scan, lm_scoring, mixing, packing, pii, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, score double, kind string, n long, copy int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, syllables="an the or ing tion re st er ly ou".split()):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that the operators don't read carry names that they use themselves."""
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [None, "", "   \n\t ", "word", "a  b\tc\n\nd", "ünï çödé 𝄞 text", "<|endoftext|> x", "one<|endoftext|><|endoftext|>  two <|ENDOFTEXT|>", "x" * 3000, " ".join(["very"] * 5000), prose(rng, 3000)]
    texts += texts[:6] + [texts[3]] * 5
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 3 if i % 2 else 0}" if i % 7 else None, 0.5, "k", 1, 2) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, 0.5, "k", 1, 2), (5, texts[5], "fr", "s1", 0.5, "k", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    assert t.encode("<|endoftext|> x", add_special_tokens=False).ids == [50256, 2124]  # added tokens in a text are tokens
    want = Counter((r["doc_id"], tuple(t.encode(r["text"] or "", add_special_tokens=False).ids + [0])) for r in docs.collect())
    window = 64
    pieces = packing.pack(docs, window=window).collect()
    by_sequence: dict[int, list] = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert len(p["ids"]) == 4 * p["length"]
    for s in by_sequence.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == [sum(q["length"] for q in s[:i]) for i in range(len(s))]
        assert sum(p["length"] for p in s) <= window
    assert sum(sum(p["length"] for p in s) < window for s in by_sequence.values()) <= 1
    # every document's ids again: pieces of one row chain up by start; equal rows are interchangeable
    slots: dict = {}
    for p in pieces:
        slots.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    got = 0
    for (doc, n), ps in slots.items():
        for ids, times in ((k[1], v) for k, v in want.items() if k[0] == doc and len(k[1]) == n):
            mine = [p for p in ps if np.frombuffer(p["ids"], "<u4").tolist() == list(ids[p["start"] : p["start"] + p["length"]])]
            assert sum(p["length"] for p in mine) >= n * times
            got += n * times
    assert got == sum(len(k[1]) * v for k, v in want.items()) == sum(p["length"] for p in pieces)
    assert packing.pack(none, window=window).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    window = 128
    h = np.bincount(rng.integers(1, window + 1, 900), minlength=window + 1)
    h[100] += 600  # a length that a large part has
    plan = packing.plan(h, window)
    used = np.zeros((window * 2000,), dtype=int)
    for one in range(1, window + 1):
        rank = np.arange(h[one])
        s, o = plan.place(np.full(len(rank), one), rank)
        for a, b in zip(s, o, strict=True):
            used[a * window + b : a * window + b + one] += 1
    assert used.max() == 1 and used.sum() == (h * np.arange(window + 1)).sum()
    assert np.flatnonzero(used).max() + 1 == used.sum()  # no gaps but at the very end
    assert len(packing.plan(np.zeros(window + 1, dtype=int), window).keys) == 0


def test_license_scan(spark, docs, none):
    rng = random.Random(2)
    mit = license_scan.TEMPLATES["mit-permission"]
    changed = mit.split()
    changed[3], changed[9] = "xx", "yy"
    half = " ".join(mit.split()[:12])
    texts = [prose(rng, 50) + "\n" + mit + " " + prose(rng, 20), prose(rng, 9) + " " + " ".join(changed), half, "MIT License. the MIT-license and GNU General Public License", None, "", "cc by cc by", "é cc  BY-nc"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["labels"] == "mit-permission" and got[0]["score"] == 1.0 and got[0]["base_labels"] == ""
    assert got[1]["labels"] == "mit-permission" and 0.9 <= got[1]["score"] < 1
    assert got[2]["labels"] == "" and got[2]["score"] == 0.0
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"], got[3]["score"]) == (3, 0, 6, "gpl,mit", 1.0)
    assert got[4]["n_words"] == 0 and got[4]["first_word"] is None and got[5]["n_base"] == 0
    assert (got[6]["n_base"], got[6]["last_word"]) == (2, 2) and got[7]["first_word"] == 1
    # whole bodies, with a tenth of their distinct words changed, in any case and layout
    bodies = [k for k in license_scan.TEMPLATES if k.endswith("-body")]
    edited = []
    for k in bodies:
        text = license_scan.TEMPLATES[k].upper()
        times = Counter(license_scan.words(text))
        once = [license_scan.words(w)[0] for w in text.split() if len(license_scan.words(w)) == 1 and times[license_scan.words(w)[0]] == 1]
        gone = set(rng.sample(once, int(0.09 * len(set(license_scan.words(text))))))
        edited.append(prose(rng, 30) + "\n* " + "\n* ".join("changed" if set(license_scan.words(w)) & gone else w for w in text.split()) + " " + prose(rng, 30))
    found = license_scan.scan(spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(k in r["labels"].split(",") and 0.9 <= max(b["containment"] for b in r["blocks"] if b["label"] == k) < 1 for k, r in zip(bodies, found, strict=True))
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_license_index_against_all_blocks(seed):
    rng = random.Random(seed)
    templates = {f"t{i}": " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for i in range(4)}
    vocabulary = sorted({w for t in templates.values() for w in license_scan.words(t)})
    rng.shuffle(vocabulary)
    index = license_scan.Index(templates, 0.7, {w: i for i, w in enumerate(vocabulary)})
    found = [rng.choice("abcdefghxyz").encode() for _ in range(60)]
    want = set()
    for label, t in templates.items():
        span, members = len(t.split()), set(license_scan.words(t))
        for k in range(0, len(found), span):
            share = len(members & set(found[k : k + 2 * span])) / len(members)
            if share >= 0.7 - 1e-9:
                want.add((label, k, round(share, 9)))
    assert {(m[0], m[1], round(m[3], 9)) for m in index.matches(found)} == want


def plain_spans(text):
    def luhn(d):
        v = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in v) % 10 == 0

    only = lambda m: re.sub("[^0-9]", "", m)
    tests = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 16 <= len(only(m)) <= 19 and luhn(only(m)), "phone": lambda m: 8 <= len(only(m)) <= 15}
    return [f"{k.name}:{m.start()}:{m.end()}" for k in pii.KINDS if k.base for m in re.finditer(k.plain, text or "") if tests[k.name](m.group())]


def test_pii(spark, docs, none):
    rng = random.Random(3)
    alphabet = ["a", "B", "@", ".", "-", " ", "1", "4", "9", "0", "+", "(", ")", "_", "é", "𝄞", "\n", "a@b.co", "10.0.0.1", "4111111111111111", "+1 (386) 555-3733"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "1 " * 20000, "a" * 20000, "a@b.c " * 2000, "+1" + "1 " * 9000, "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432 GB82WEST12345698765433", "ssn 123-45-6789", "no 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t or "")[:80]
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]
    n = len(texts)
    assert (got[n - 4]["spans"], got[n - 3]["spans"], got[n - 2]["spans"], got[n - 1]["spans"]) == ("iban:0:27", "iban:0:22", "national_id:4:15", "")
    clean = pii.redact(df)
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in pii.digest(pii.find(clean)).where("doc_id >= 300").collect())
    assert clean.where("doc_id = 308").first()["text"] == "ssn <NATIONAL_ID>" and clean.where("text is null").count() == 1
    assert pii.find(docs).count() == docs.count() and pii.find(none).count() == 0
    assert pii.redact(docs).columns == docs.columns


def shingle_sets(texts, k):
    words = [lower(t).encode().split() for t in texts]
    return [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []) for w in words]


def plain_components(ids, texts, k, num, den):
    """doc_id: (n_shingles, component_id), from all pairs."""
    sets = shingle_sets(texts, k)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest: dict[int, int] = {}
    for i in range(len(texts)):
        smallest[find(i)] = min(smallest.get(find(i), 1 << 60), ids[i])
    return {ids[i]: (len(sets[i]), smallest[find(i)]) for i in range(len(texts))}


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join(spark, seed):
    """Chains and clusters of edited texts, a passage that many share, exact copies, short texts."""
    rng = random.Random(seed)
    passage = prose(rng, 12)
    texts = [None, "", " ", "One", "one", "one two", "one two"]
    for _ in range(6):
        seed_text = prose(rng, rng.randint(20, 60)).split()
        for _ in range(rng.randint(1, 9)):
            words = list(seed_text)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            if rng.random() < 0.3:
                seed_text = words  # a chain goes on from here
            texts.append(" ".join(words) + (" " + passage if rng.random() < 0.3 else ""))
    texts += texts[-3:]
    ids = rng.sample(range(1000), len(texts))
    want = plain_components(ids, texts, 3, 70, 100)
    df = spark.createDataFrame([(a, b, 7) for a, b in zip(ids, texts, strict=True)], "doc_id long, text string, n long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(df, shingle_words=3, share=(70, 100)).collect()}
    assert got == want
    kept = sorted(r["doc_id"] for r in jaccard_join.one_of_each(df, shingle_words=3, share=(70, 100)).collect())
    assert kept == sorted({c for _, c in want.values()})


@pytest.mark.parametrize(("k", "num"), [(5, 80), (4, 85)])
def test_jaccard_join_of_one_large_group(spark, k, num):
    """Many near copies of one text around the threshold, some linked to the original and some to nothing; and no further
    pairs are made of those that cannot link."""
    rng = random.Random(num)
    original = prose(rng, 120).split()
    texts = [" ".join(original)]
    for _ in range(220):
        words = list(original)
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(len(words))] = "".join(rng.choice("bcdfg") for _ in range(7))
        texts.append(" ".join(words))
    texts += [prose(rng, rng.randint(5, 80)) for _ in range(60)]
    ids = rng.sample(range(5000), len(texts))
    want = plain_components(ids, texts, k, num, 100)
    assert 20 < len({c for _, c in want.values()}) - 60 < 210
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(df, shingle_words=k, share=(num, 100)).collect()} == want


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 40, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.append(a[: n // 2], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)))
        unlike = int(np.bitwise_count((jaccard_join.parities(a) ^ jaccard_join.parities(b)).view(np.uint64)).sum())
        assert unlike <= len(np.setxor1d(a, b)) and (n == 5000 or unlike > 0.6 * len(np.setxor1d(a, b)))


def test_jaccard_join_of_split_shingles(spark, monkeypatch):
    """Shingles dealt to several tasks lose no posting and no link, though a group be alone in any of them."""
    monkeypatch.setattr(jaccard_join, "SPLIT", 1)
    words = prose(random.Random(4), 60).split()
    df = spark.createDataFrame([(i, " ".join([*words[:-1], f"end{i}"])) for i in range(20)], "doc_id long, text string")
    join = jaccard_join.Join(df, "doc_id", "text", 4, (80, 100))
    rows = {(r["token"], r["gid"]) for r in join.signed.select("gid", F.explode("prefix").alias("token")).collect()}
    groups = Counter(token for token, _ in rows)
    want = {row for row in rows if groups[row[0]] > 1}
    assert want and want <= {(r["token"], r["gid"]) for r in join.shared_postings().collect()}
    test_jaccard_join(spark, 1)


def test_jaccard_join_edges(spark, docs, none):
    found = jaccard_join.link(docs)
    assert found.count() == docs.count()
    assert jaccard_join.link(none).count() == 0 and jaccard_join.one_of_each(none).columns == none.columns
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, ""), (2, ""), (None, None)], "doc_id long, text string")
    assert jaccard_join.one_of_each(twice).count() == 4  # of equal rows with words one stays; texts without words all stay
    clash = twice.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(("__id", "__rows", "__many", "__fp", "__set", "c0", "root", "fp"))])
    assert jaccard_join.one_of_each(clash).columns == clash.columns and jaccard_join.one_of_each(clash).count() == 4


def test_one_of_each_with_null_and_repeated_ids(spark):
    """One row of every component stays though ids are null or repeat: unrelated texts of an id stay, near copies go."""
    rng = random.Random(8)
    a, b, c, d, e, f = (prose(rng, 40) for _ in range(6))
    near = lambda t: t + " more"
    rows = [(None, a), (None, b), (None, near(b)), (5, c), (5, d), (5, d), (7, e), (None, near(e)), (9, near(f)), (8, f), (9, prose(rng, 40)), (None, ""), (1, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df).collect())
    of_b = [t for i, t in got if t in (b, near(b))]
    assert len(of_b) == 1
    assert got == Counter([(None, a), (None, of_b[0]), (5, c), (5, d), (7, e), (8, f), rows[10], (None, ""), (1, "x y z")])


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r["vertex"]: r["root"] for r in jaccard_join.components(links).collect()}
    assert {roots[i] for i in range(41)} == {0} and roots[101] == 100 and len(roots) == 43


def plain_statistics(x):
    w = WORD.findall(x or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    covered = {j for i, y in enumerate(g) if c[y] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (x or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x or ""), dup, len(covered)


def test_quality_statistics(spark, docs, none):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "é", "\x0b", "a b c "]) for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, "", "a b c a b c", "a a a a", "a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality_rules.statistics(df).collect():
        assert tuple(r[n] for n in names) == plain_statistics(texts[r["doc_id"]]), texts[r["doc_id"]]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.judge(docs, labels)
    assert out.count() == docs.count() and out.where("kept and n_words < 50").count() == 0
    assert quality_rules.judge(none, labels).count() == 0


def test_quality_rules(spark):
    rng = random.Random(6)
    clean = [prose(rng, 80) for _ in range(150)]
    junk = [" ".join(w + "###" for w in prose(rng, 80).split()) for _ in range(40)] + [prose(rng, 80).upper() for _ in range(40)]
    rows = [(i, t, int(i < 150)) for i, t in enumerate(clean + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality", F.lit(1).alias("text"), F.lit(2).alias("n_words")).where("doc_id % 2 = 0").union(spark.createDataFrame([(9999, 0, 1, 1), (None, 1, 1, 1), (4, None, 1, 1)], "doc_id long, quality int, text int, n_words int"))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, labels).collect()}
    assert sum(got[i] for i in range(150)) >= 147
    assert sum(got[i] for i in range(150, 230)) <= 4


def test_language_id(spark, docs, none):
    rng = random.Random(7)
    kinds = {"xx": "an the or ing tion".split(), "yy": "zu über ß und ach".split()}
    rows = [(i, prose(rng, rng.randint(3, 60), kinds[k]), k) for i, k in enumerate(list(kinds) * 60)] + [(900, None, "xx"), (901, "123 ... !", "yy"), (902, "the ing", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = common.crc_fold("doc_id", 4) == 2
    got = {r["doc_id"]: r for r in langid.identify(df, held_out=held).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:120]) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "xx"
    kept = langid.identify(docs, keep=docs.columns)
    assert kept.count() == docs.count() and kept.columns[4:] == docs.columns
    assert langid.identify(none).count() == 0
    # a very long text is counted in pieces, to the same counts
    text = prose(rng, 3000)
    whole = langid.bucket_counts(text)
    chunk, langid.CHUNK = langid.CHUNK, 101
    try:
        pieces = langid.bucket_counts(text)
    finally:
        langid.CHUNK = chunk
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def test_language_posteriors(spark, monkeypatch):
    """Log-probabilities of a batch against naive Bayes by plain counters of the same buckets; a bounded matrix folds them."""
    rng = random.Random(9)
    kinds = {"xx": "an the or ing tion".split(), "yy": "zu über ß und ach".split(), "zz": "an zu the und la".split()}
    rows = [(prose(rng, rng.randint(1, 30), kinds[k]), k) for k in list(kinds) * 20]
    df = spark.createDataFrame(rows, "text string, lang string")
    texts = ["the und ing", "x", "ß ß", "tion " * 50]
    for most, bits in ((langid.MOST_CELLS, 14), (3 << 6, 6)):
        monkeypatch.setattr(langid, "MOST_CELLS", most)
        monkeypatch.setattr(langid, "AT_ONCE", 40)
        model = langid.train(df)
        assert model.matrix.shape == (1 << bits, 3)
        buckets = lambda t: Counter({int(b) >> 14 - bits: 0 for b in langid.bucket_counts(t)[0]}) + sum((Counter({int(b) >> 14 - bits: int(n)}) for b, n in zip(*langid.bucket_counts(t), strict=True)), Counter())  # noqa: B023, E731
        sums = {k: sum((buckets(t) for t, lang in rows if lang == k), Counter()) for k in kinds}
        for text, logs in zip(texts, model.logs(texts), strict=True):
            want = [math.log(20 / 60) + sum(n * math.log((sums[k][b] + 0.5) / (sums[k].total() + 0.5 * (1 << bits))) for b, n in buckets(text).items()) for k in sorted(kinds)]
            assert np.allclose(logs, want)
        for (lang, score), logs in zip(model.predict([*texts, None])[:4], model.logs(texts), strict=True):
            p = np.exp(logs - logs.max())
            assert lang == sorted(kinds)[int(p.argmax())] and abs(score - p.max() / p.sum()) < 1e-9
    assert model.predict([None, "1 2"]) == [("und", 0.0)] * 2 and model.predict([]) == []


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[100:140] = x[60]  # ties: the smaller id goes first
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    x = np.array([r[1] for r in rows])
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, []), (2080, [None] + [1.0] * 15), (2100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10, shard_rows=300, query_rows=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:10]
        hits += len({v for v, _ in found} & set(want))
        assert len(found) == 10 and q not in {v for v, _ in found}
        assert all(abs(s[v] - sc) < 1e-12 for v, sc in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.95 * 10 * len(got)
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0, k=10)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3]
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_collisions_are_counted():
    """The bit sets' counts are those of a plain count of windows, and candidates are the rows that reach the threshold."""
    rng = np.random.default_rng(4)
    sets = rng.integers(0, 1 << 63, (37, 2, 5)).astype(np.uint64)
    bits = np.unpackbits(sets.view(np.uint8), axis=2, bitorder="little").sum(axis=0)
    digits = ann.added(iter(sets))
    got = sum(np.unpackbits(d.view(np.uint8), axis=1, bitorder="little").astype(int) << i for i, d in enumerate(digits))
    assert (got == bits).all()
    for least in (1, 17, 18, 37, 64):
        assert (np.unpackbits(ann.reaching(digits, least).view(np.uint8), axis=1, bitorder="little") == (bits >= least)).all()
    x = rng.standard_normal((700, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = ann.Shard(x)
    values = np.concatenate([x, np.zeros((700, 1))], axis=1).astype(np.float32) @ shard.lines
    for q, (found, half) in zip(x[:90], shard._widen(x[:90], 3), strict=True):
        far = np.abs(values - q.astype(np.float32) @ shard.lines[:-1])
        plain = lambda h: set(np.flatnonzero((far <= h).sum(axis=1) >= np.ceil(ann.THRESHOLD * shard.m)))
        assert plain(half - 1.51 * ann.GRID) <= set(found) <= plain(half + 1.51 * ann.GRID) and len(found) >= min(700, 30 + 140)
    assert [len(f) for f in ann.Shard(x[:3]).candidates(x[:5], 20)] == [3] * 5  # fewer rows than wanted: all


def test_lm_scoring(spark, docs, none):
    held = common.crc_fold("doc_id", 7) == 2
    few, lm_scoring.FREQUENT_WORDS, steps, lm_scoring.LEAST_STEPS = lm_scoring.FREQUENT_WORDS, 40, lm_scoring.LEAST_STEPS, 3
    try:
        got = lm_scoring.score(docs, held_out=held).collect()
        assert lm_scoring.score(none).count() == 0
    finally:
        lm_scoring.FREQUENT_WORDS, lm_scoring.LEAST_STEPS = few, steps
    rows = docs.collect()
    words = lambda t: [*lower(t).encode().split(), None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for r in rows if not out(r["doc_id"]) for w in words(r["text"]))
    total, distinct = sum(c.values()), len(c)
    key = lambda *v: (str(v[0]), *(round(x, 6) if isinstance(x, float) else x for x in v[1:]))
    want = sorted(key(r["doc_id"], out(r["doc_id"]), len(words(r["text"])), sum(c[w] > 0 for w in words(r["text"])), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words(r["text"]))) for r in rows)
    assert sorted(key(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_attention_model():
    rng = np.random.default_rng(9)
    w = {k: rng.standard_normal(s) * 0.5 for k, s in lm_scoring.SHAPES.items()}
    b = lm_scoring.BLOCK
    x, y = rng.integers(0, lm_scoring.BUCKETS, (6, b)), rng.integers(0, lm_scoring.CLASSES, (6, b))
    prior = rng.standard_normal((6 * b, lm_scoring.CLASSES))
    follows = np.array([False, True, True, False, True, True])
    counted = rng.random((6, b)) < 0.9
    loss = lambda: -(lm_scoring.forward(w, x, follows, prior, y)["logp"] * counted).sum() / counted.sum()
    g = lm_scoring.backward(w, lm_scoring.forward(w, x, follows, prior, y), x, follows, y, counted)
    for k in w:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        up, e = w[k].copy(), 1e-5
        w[k][at] += e
        high = loss()
        w[k][at] -= 2 * e
        assert abs((high - loss()) / (2 * e) - g[k][at]) < 1e-5 * max(1, abs(g[k][at]))
        w[k] = up
    # position by position, written out
    want = np.zeros((6, b))
    for i in range(6):
        for t in range(b):
            seen = [(i, u) for u in range(t + 1)] + ([(i - 1, u) for u in range(b)] if follows[i] else [])
            e = w["embed"][x[i, t]]
            s = np.array([e @ w["q"] @ (w["embed"][x[u]] @ w["k"]) / math.sqrt(lm_scoring.WIDTH) + w["near"][(i - u[0]) * b + t - u[1]] for u in seen])
            p = np.exp(s - s.max())
            h = np.tanh(e + (p / p.sum()) @ np.stack([w["embed"][x[u]] @ w["v"] for u in seen]) @ w["o"])
            z = h @ w["out"] + w["bias"] + prior[i * b + t]
            want[i, t] = z[y[i, t]] - z.max() - np.log(np.exp(z - z.max()).sum())
    assert np.allclose(lm_scoring.forward(w, x, follows, prior, y)["logp"], want)
    big = {k: v * 12 for k, v in w.items()}  # scores and log-odds that would overflow without a shift
    assert np.isfinite(lm_scoring.forward({k: v.astype(np.float32) for k, v in big.items()}, x, follows, prior.astype(np.float32), y)["p"]).all()
    # causal, and blind beyond the block before
    z = x.copy()
    z[2, 5:] = 0
    z[3:] = 0
    assert np.allclose(lm_scoring.forward(w, z, follows, prior, y)["logp"][2, :5], lm_scoring.forward(w, x, follows, prior, y)["logp"][2, :5])


def lm_texts(rng: random.Random, n: int) -> list[str]:
    """Texts of words in a fixed order, more or less, so that what comes before a word tells it."""
    words = [f"w{i}x" for i in range(60)]
    return [" ".join(words[(at + i) % 60] if rng.random() < 0.9 else rng.choice(words) for i in range(rng.randint(3, 90))) for at in (rng.randrange(60) for _ in range(n))]


def lm_parts(texts):
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    column = pa.array([lm_scoring.subwords(t, path).tobytes() for t in texts], pa.binary())
    ids, first = lm_scoring.joined(column)
    counts = Counter(i for t in texts for i in lm_scoring.subwords(t, path)[1:].tolist())
    words = lm_scoring.lexicon(np.bincount(list(counts.elements()), minlength=lm_scoring.VOCABULARY))
    tables = [np.zeros(n, np.int32) for n in lm_scoring.TABLES]
    lm_scoring.add_pairs(*tables, ids, first, words)
    packed = {(k, i): lm_scoring.pack(part.astype(np.int64)) for k, t in enumerate(tables) for i, part in enumerate(np.split(t, lm_scoring.PARTS)) if part.any()}
    return path, column, counts, lm_scoring.Pairs(words, packed), tables


def test_counted_pairs(spark):
    texts = [*lm_texts(random.Random(3), 40), None, "", "x"]
    path, column, counts, pairs, (of_class, of_id) = lm_parts(texts)
    words = pairs.words
    want_class, want_id = Counter(), Counter()
    for t in texts:
        ids = [lm_scoring.END_OF_TEXT, *lm_scoring.subwords(t, path).tolist()]
        for two, one, y in zip(ids, ids[1:], ids[2:]):
            want_class[words.previous[one], words.previous[two], words.class_of[y]] += 1
            want_id[words.previous[one], y] += 1
    at = np.unravel_index(np.flatnonzero(of_class), (lm_scoring.PREVIOUS, lm_scoring.PREVIOUS, lm_scoring.CLASSES))
    assert dict(zip(zip(*(i.tolist() for i in at)), of_class[of_class > 0].tolist())) == dict(want_class)
    at = np.unravel_index(np.flatnonzero(of_id), (lm_scoring.PREVIOUS, lm_scoring.VOCABULARY))
    assert dict(zip(zip(*(i.tolist() for i in at)), of_id[of_id > 0].tolist())) == dict(want_id)
    assert np.allclose(np.exp(pairs.classes[::97]).sum(axis=1), 1, atol=1e-4)  # both add up to 1
    assert all(np.allclose(np.bincount(words.class_of, np.exp(row), minlength=64)[np.unique(words.class_of)], 1, atol=1e-4) for row in pairs.within[::51])
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").repartition(5)
    stored = lm_scoring.cut(docs, path).cache()
    spread = lm_scoring.count_pairs(stored.select("ids"), words)
    assert np.array_equal(spread.classes, pairs.classes) and np.array_equal(spread.within, pairs.within)
    seen = lm_scoring.gather(stored.select("words", "ids")).groupBy("kind").agg(F.sum("n").alias("n"))
    assert {r["kind"]: r["n"] for r in seen.collect()} == {lm_scoring.WORD: sum(len((t or "").split()) + 1 for t in texts), lm_scoring.TOKEN: counts.total()}


def test_all_windows_are_trained_on(spark, monkeypatch):
    """Every subword id of every training document is the target of one window, and each window is trained on once."""
    texts = [*lm_texts(random.Random(4), 40), None, ""]
    path, column, want, pairs, _ = lm_parts(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([i % 3 for i in range(len(texts))], pa.int32()), column], names=["turn", "ids"])
    rounds = [list(lm_scoring.mixed_parts([batch, batch.slice(0, 0)], turn)) for turn in range(lm_scoring.ROUNDS)]
    windows = np.concatenate([w for part in rounds for w in part])
    assert all(rounds) and Counter(i for i in windows[:, 2:].ravel().tolist() if i >= 0) == want
    monkeypatch.setattr(lm_scoring, "LEAST_STEPS", 0)
    steps = []
    backward = lm_scoring.backward
    monkeypatch.setattr(lm_scoring, "backward", lambda *a: steps.append(int(a[5].sum())) or backward(*a))
    _, n = lm_scoring.local_training(lm_scoring.fresh(), np.array_split(windows, 5), pairs.words, pairs.classes, 1)
    assert n == len(windows) and sum(steps) == want.total()
    # one short text has one window, which reaches the model whatever its id
    monkeypatch.setattr(lm_scoring, "LEAST_STEPS", 3)
    for i in range(2):
        one = lm_scoring.cut(spark.createDataFrame([(i, False, "a b c")], "doc_id long, held_out boolean, text string"), path)
        assert not np.array_equal(lm_scoring.train(one.select("turn", "ids"), spark.sparkContext.broadcast(pairs))["bias"], lm_scoring.fresh()["bias"])


def test_scores_of_whole_texts(monkeypatch):
    """Against one forward pass over each text, whatever is scored at a time."""
    texts = [prose(random.Random(10), 800), None, "x", *lm_texts(random.Random(5), 9), ""]
    path, column, _, counted, _ = lm_parts(texts)
    words, rng = counted.words, np.random.default_rng(1)
    w = {k: v + rng.standard_normal(v.shape).astype(np.float32) * np.float32(0.1) for k, v in lm_scoring.fresh().items()}
    want = []
    for t in texts:
        ids = np.concatenate([[lm_scoring.END_OF_TEXT], lm_scoring.subwords(t, path)]).astype(int)
        n = len(ids) - 2
        padded = np.append(ids, np.zeros(-n % lm_scoring.BLOCK, int))
        one, two, y = padded[1:-1], padded[:-2], padded[2:]
        block = lambda v: v.reshape(-1, lm_scoring.BLOCK)
        f = lm_scoring.forward(w, words.bucket[block(one)], np.arange(len(block(y))) > 0, lm_scoring.prior_of(words, counted.classes, one, two), words.class_of[block(y)])
        want.append((f["logp"].ravel() + counted.within[words.previous[one], y])[:n].sum() / math.log(10))
    for at_once in (lm_scoring.AT_ONCE, 5 * lm_scoring.BLOCK, lm_scoring.BLOCK):
        monkeypatch.setattr(lm_scoring, "AT_ONCE", at_once)
        assert np.allclose(lm_scoring.Scorer(w, counted)(column), want, rtol=1e-4)


@pytest.mark.parametrize("most", [lm_scoring.MOST_CELLS, 30])
def test_counted_pairs_take_the_memory_of_cells_with_a_count(monkeypatch, most):
    """Scores need no whole table of ids after buckets where few of its cells have a count."""
    texts = [prose(random.Random(17), 400), *lm_texts(random.Random(18), 30)]
    _, column, _, counted, (_, of_id) = lm_parts(texts)
    monkeypatch.setattr(lm_scoring, "MOST_CELLS", most)
    cells = lm_scoring.Cells()
    places = np.repeat(np.arange(len(of_id)), of_id)
    for some in np.array_split(np.random.default_rng(2).permutation(places), 7):
        cells.add(some)
        cells._merge() if cells.table is None else None
    assert np.array_equal(np.concatenate(list(cells.parts())), of_id) and (cells.table is None) == (most > 30)
    assert not any(part.any() for part in lm_scoring.Cells().parts())
    lm_scoring.Scorer(lm_scoring.fresh(), counted)(column)
    assert ("within" in vars(counted)) == (most == 30)
    previous, ids = np.divmod(np.concatenate([np.flatnonzero(of_id), np.arange(0, len(of_id), 997)]), lm_scoring.VOCABULARY)
    assert np.allclose(counted.within_of(previous, ids), counted.within[previous, ids], atol=1e-5)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_places_of_words(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.append(rng.integers(-(1 << 63), (1 << 63) - 1, n), np.array([5, 6, -(1 << 63), (1 << 63) - 1][:n], np.int64)))
    wanted = rng.permutation(np.concatenate([keys, keys, rng.integers(-(1 << 63), (1 << 63) - 1, 500), [5, 6, 7, 0, -1, -(1 << 63), (1 << 63) - 1]]))
    at = {k: i for i, k in enumerate(keys.tolist())}
    assert lm_scoring.Places(keys)(wanted).tolist() == [at.get(k, -1) for k in wanted.tolist()]


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.createDataFrame(list(enumerate(lm_texts(random.Random(6), 400))), "doc_id long, text string")
    got = lm_scoring.score(docs, held_out=common.crc_fold("doc_id", 7) == 2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_with_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, held_out=F.lit(True)).collect()}
    assert {i: (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for i, r in got.items()} == {1: (3, 0, 0, 0.0), None: (1, 0, 0, 0.0), 3: (1, 0, 0, 0.0)}
    assert abs(got[3]["score"] + math.log10(lm_scoring.VOCABULARY)) < 1e-3 and got[None]["score"] == got[3]["score"] and got[1]["score"] < got[3]["score"]


def test_texts_are_cut_word_by_word(monkeypatch):
    """Hashes and ids are those of texts cut one by one, and a word is encoded once, however often and wherever it stands."""
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    plain = ["a", "a b", "a\nb", "It's DON'T 's 'S\n's", "<|endoftext|> \u00e9 \u00c9\n1234 12, ;;a\n;;b", "x\u00a0y z", "a" * 300, "\U0001f600\n\U0001f600 \U0001f600", "a\x1cb c", *lm_texts(random.Random(7), 20)]
    odd = ["", None, " ", " a", "a ", "a  b", "a\n\nb", "\na\n", "a \n b", "a\n b", "a\tb\r\nc", "x\u2003 \u2003y", "\u3000z a\u3000", "x\vy\fz", "A\x85\x85B"]
    texts = [*plain, *odd, *plain]
    words = lm_scoring.Words(path)
    want = [np.append(lm_scoring.word_hashes(t), lm_scoring.END_WORD).tobytes() for t in texts], [lm_scoring.subwords(t, path).tobytes() for t in texts]
    assert words(texts) == want and all(words.plain(t) is None for t in odd) and all(words.plain(t) for t in plain)
    encode, seen = lm_scoring.packing.Encoder.__call__, []
    monkeypatch.setattr(lm_scoring.packing.Encoder, "__call__", lambda self, t: seen.append(t) or encode(self, t))
    assert words(plain[::-1]) == tuple(w[: len(plain)][::-1] for w in want) and not seen
    assert words(["a new\nword new new new\nword"])[1] and seen == [" new\nword"]
    words.reset()
    assert words(texts[::-1]) == tuple(w[::-1] for w in want)


def test_windows_are_attended_to_at_once():
    """As their blocks would be, in log-probabilities and gradients."""
    rng = np.random.default_rng(12)
    w = {k: rng.standard_normal(s) * 0.5 for k, s in lm_scoring.SHAPES.items()}
    x, y = rng.integers(0, lm_scoring.BUCKETS, (8, lm_scoring.BLOCK)), rng.integers(0, lm_scoring.CLASSES, (8, lm_scoring.BLOCK))
    prior, counted = rng.standard_normal((8 * lm_scoring.BLOCK, lm_scoring.CLASSES)), rng.random((8, lm_scoring.BLOCK)) < 0.9
    blocks, windows = (lm_scoring.forward(w, x, follows, prior, y) for follows in (np.arange(8) % 2 == 1, None))
    assert np.allclose(blocks["logp"], windows["logp"]) and np.isfinite(blocks["logp"]).all()
    one, two = lm_scoring.backward(w, blocks, x, np.arange(8) % 2 == 1, y, counted), lm_scoring.backward(w, windows, x, None, y, counted)
    assert all(np.allclose(one[k], two[k]) for k in lm_scoring.SHAPES)


def test_mixing(spark, docs, none):
    from plumbline.llm.mixing import ORACLE_SQL

    duckdb = pytest.importorskip("duckdb")
    plain = docs.drop("score", "kind", "n", "copy").withColumn("n_chars", F.length("text").cast("long")).where("doc_id is null or doc_id <> 5")
    documents = plain.toPandas()  # noqa: F841  DuckDB reads it by name
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = sorted(map(str, duckdb.sql(ORACLE_SQL).select("shuffle_key, doc_id, source, copy").fetchall()))
    got = mixing.mix(plain)
    assert sorted(str((r["shuffle_key"], r["doc_id"], r["source"], r["copy"])) for r in got.collect()) == want
    assert mixing.mix(docs).columns == [c for c in docs.columns if c != "copy"] + ["copy", "shuffle_key"]
    assert mixing.mix(docs, weights={"s1": 2, "s2": 0}).where("source = 's2' or source is null").count() == 0
    assert mixing.mix(none).count() == 0
    clash = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("__source", "__rate", "__steps", "__n", "c0", "rate"))])
    assert mixing.mix(clash).columns == [*clash.columns, "copy", "shuffle_key"] and {r["__n"] for r in mixing.mix(clash).collect()} == {3}


def test_poisson(spark):
    draws = spark.range(4000).select(mixing.poisson(F.lit(3.5), mixing.uniform(F.col("id"))).alias("k")).agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert abs(draws["m"] - 3.5) < 0.15 and abs(draws["v"] - 3.5) < 0.4


def test_kneser_ney(spark, docs, none):
    rng = random.Random(11)
    sample = spark.createDataFrame([(prose(rng, 30),) for _ in range(40)] + [(None,)], "text string")
    model = kn_quality.fit(sample)
    words = sorted({w for r in sample.collect() for w in (r["text"] or "").split()})
    # the probabilities of all known words, the end and one unknown word add up to 1, after seen and unseen contexts
    for context in (f"{words[0]} {words[1]}", " ".join(sample.first()["text"].split()[:2]), "never heard"):
        stem = model.log_probabilities([context])[0][0]
        end = 10**stem
        before = kn_quality.Model.log_probabilities(model, [f"{context} {w}" for w in [*words, "unheard"]])[0]
        grams = [kn_quality.grams(f"{context} {w}") for w in [*words, "unheard"]]
        last = np.array([model.share3.get(g[0])[2] + model.weight3.get(g[1])[2] * (model.share2.get(g[2])[2] + model.weight2.get(g[3])[2] * (model.share1.get(g[4])[2] + model.unknown)) for g in grams])
        stop = kn_quality.grams(context)
        last_stop = model.share3.get(stop[0])[2] + model.weight3.get(stop[1])[2] * (model.share2.get(stop[2])[2] + model.weight2.get(stop[3])[2] * (model.share1.get(stop[4])[2] + model.unknown))
        assert abs(last.sum() + last_stop - 1) < 1e-3 and end > 0 and len(before) == len(words) + 1
    trusted = docs.select("doc_id", F.lit(1).alias("text")).where("doc_id < 40")
    out = kn_quality.classify(docs, trusted)
    assert out.count() == docs.count() and out.where("kept and n_tokens = 1").count() == 0
    assert kn_quality.classify(none, trusted).count() == 0
    assert kn_quality.classify(docs, trusted.where("false")).where("not kept and n_tokens > 1").count() == 0


def test_kneser_ney_against_plain_counts(spark):
    """Perplexities by the formulas of interpolated modified Kneser-Ney over dictionaries of words."""
    rng = random.Random(13)
    vocabulary = [prose(rng, 1) for _ in range(25)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    model = kn_quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    cut = lambda t: ["<a>", "<a>", *lower(t).split(), "<z>"]
    tri = Counter(tuple(w[i : i + 3]) for w in map(cut, texts) for i in range(len(w) - 2))
    bi = Counter(k[1:] for k in tri)
    uni = Counter(k[1:] for k in bi)

    def level(grams):
        n = [0, *(max(1, sum(c == i for c in grams.values())) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2])
        cut_by = [min(max(v, 0.05), i - 0.05) for i, v in ((1, 1 - 2 * y * n[2] / n[1]), (2, 2 - 3 * y * n[3] / n[2]), (3, 3 - 4 * y * n[4] / n[3]))]
        total, taken = Counter(), Counter()
        for k, c in grams.items():
            total[k[:-1]] += c
            taken[k[:-1]] += cut_by[min(c, 3) - 1]

        def p(gram, lower_p):
            if not total[gram[:-1]]:
                return lower_p
            c = grams[gram]
            return (c - cut_by[min(c, 3) - 1] if c else 0) / total[gram[:-1]] + taken[gram[:-1]] / total[gram[:-1]] * lower_p

        return p

    p3, p2, p1 = level(tri), level(bi), level(uni)
    tests = [*texts[:5], "never heard " + texts[0], "", " ".join(vocabulary)]
    logs, sizes = model.log_probabilities(tests)
    for t, got, n in zip(tests, logs, sizes, strict=True):
        w = cut(t)
        want = sum(math.log10(p3(tuple(w[i : i + 3]), p2(tuple(w[i + 1 : i + 3]), p1((w[i + 2],), 1 / (len(uni) + 1))))) for i in range(len(w) - 2))
        assert n == len(w) - 2 and abs(got - want) < 1e-4 * n


def test_one_long_trusted_text_does_not_crowd_out_the_rest(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 4000 if i % 2 else 40), "xx") for i in range(60)] + [(100, "qwz " * 40, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in kn_quality.classify(df, df.where("doc_id < 60").select("doc_id"), train_characters=3000).collect()}
    assert got[100]["perplexity"] > 1 and not got[100]["kept"]
    with pytest.warns(UserWarning, match="no trusted text"):
        assert kn_quality.classify(df, df.where("false").select("doc_id")).where("kept").count() == len(rows)


def test_kneser_ney_rejects_noise(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 60), "xx") for i in range(240)] + [(1000 + i, " ".join("".join(rng.choice("qwzxk") for _ in range(6)) for _ in range(60)), "xx") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in kn_quality.classify(df, df.where("doc_id < 200").select("doc_id")).collect()}
    assert sum(got[i] for i in range(200, 240)) >= 38 and not any(got[1000 + i] for i in range(20))


@pytest.mark.parametrize("frequent", [1 << 21, 12, 0])
def test_kneser_ney_in_parts(spark, docs, none, monkeypatch, frequent):
    """Dealt out to parts, with common middle words in several of them and rare words joined, perplexities are those of the whole model."""
    monkeypatch.setattr(kn_shards, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(kn_shards, "ONE_WORD", 5)
    monkeypatch.setattr(kn_shards, "MOST_HELD", 700)
    rng = random.Random(15)
    vocabulary = [prose(rng, 1) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((2, 10, 40))]) for _ in range(n))
    training = spark.createDataFrame([(text(rng.randint(0, 60)),) for _ in range(80)], "text string")
    asked = docs.select("doc_id", "lang", "text").unionByName(spark.createDataFrame([(1000 + i, "xx", text(rng.randint(1, 90)) + " unheard of") for i in range(60)], "doc_id long, lang string, text string"))
    rows = lambda df: sorted(((str(r["doc_id"]), str(r["lang"]), r["n_tokens"], r["perplexity"]) for r in df.collect()), key=str)
    got, want = rows(kn_shards.score(asked, training, kn_shards.word_counts(training))), rows(kn_quality.score_by(asked, kn_quality.fit(training)))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-4)
    assert kn_shards.score(none.select("doc_id", "lang", "text"), training, kn_shards.word_counts(training)).count() == 0


def test_all_trusted_documents_are_trained_on(spark, monkeypatch):
    """The words of every trusted document, and of its whole text, are counted, not those of 3000 documents; the quantile is exact."""
    rng = random.Random(16)
    rows = [(i, prose(rng, 3) + f" only{i} " + prose(rng, 3), "xx") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = kn_shards.word_counts
    monkeypatch.setattr(kn_shards, "word_counts", lambda texts: seen.append({r[0] for r in texts.collect()}) or real(texts))
    got = kn_quality.classify(df, df.select("doc_id"), quantile=0.9)
    fold = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2))).collect()}
    assert seen == [{t for i, t, _ in rows if not fold[i]}] and len(seen[0]) > 3500
    others = sorted(r["perplexity"] for r in got.collect() if fold[r["doc_id"]])
    assert {r["threshold"] for r in got.collect()} == {others[math.ceil(0.9 * len(others)) - 1]}
    monkeypatch.setattr(kn_quality, "SENT_WORDS", 100)
    parts = {r["doc_id"]: r["perplexity"] for r in kn_quality.classify(df, df.select("doc_id"), quantile=0.9).collect()}
    assert all(abs(parts[r["doc_id"]] / r["perplexity"] - 1) < 1e-4 for r in got.collect())
