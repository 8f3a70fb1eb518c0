"""Mixing, language model, toxicity, fingerprints, Jaccard join, pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import class_lm, decontaminate, fingerprint, jaccard_join, mixing, pii, toxicity
from tracemill.llm.common import text_bytes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


# ------------------------------------------------------------ mixing


def plain_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    """Reshare the excess by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    open_, left, target = set(names), share * sum(sizes.values()), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not full:
            return target | {s: left * w[s] / total for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_against_resharing(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i}é" if i % 3 else f"S{i}": rng.choice((0, 1, 10, 500, 9000)) for i in range(rng.randint(1, 9))} | {None: rng.choice((0, 70))}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = plain_targets(sizes)
        assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_mix(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs_of(spark, [(9000, None, None), (9001, "", "src1"), (9002, "a b\x85c", None), (9002, "a b\x85c", None)]))
    rows = mixing.mix(docs, labels).collect()
    assert sorted(map(tuple, mixing.mix(docs.repartition(7), labels).collect()), key=str) == sorted(map(tuple, rows), key=str)
    texts = Counter((r.doc_id, len((r.text or "").encode().split())) for r in docs.collect())
    assert Counter((r.doc_id, r.size) for r in rows) == texts
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    want = plain_targets({s: sum(r.size for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert math.isclose(v[0].target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v) / 2 + 1e-6
        assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in v)
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_slots_are_even_and_the_draw_is_that_of_sorted_keys(spark):
    n = 60_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 3 = 0, null, id) as id", "cast(id % 2 as string) as source", "1 + id % 50 as n", "case id % 4 when 0 then 0.5 when 1 then 2.0 when 2 then 1.0 end as w", "id as mark")
    got = mixing.draw(docs, size=F.col("n"), weight=F.col("w"), mark=F.col("mark"), share=0.7, slots=200, rows_per_slot=200)
    base = spark.range(100_000).selectExpr("-ln((id + 0.5) / 100000) / 0.5 as _key", "0.5D as _w").unionAll(spark.range(100_000).selectExpr("-ln((id + 0.5) / 100000) / 2 as _key", "2D as _w"))
    sizes = [r["count"] for r in mixing._slotted(base, 100, 1000).groupBy("_slot").count().collect()]
    assert len(sizes) == 200 and max(sizes) < 1100
    rows = got.join(docs.select(F.col("doc_id").alias("id"), "w", "mark"), "id").collect()
    key = {r.id: r._key for r in docs.select("doc_id", F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), "mark").alias("h"), "w").selectExpr("doc_id as id", "-ln((cast(shiftrightunsigned(h, 11) as double) + 0.5) / pow(2D, 53)) / coalesce(w, 1D) as _key").collect()}
    for s in ("0", "1"):
        own = sorted((r for r in rows if r.source == s), key=lambda r: (key[r.id], r.id))
        epochs, before = own[0].target // own[0].source_size, 0
        left = own[0].target - epochs * own[0].source_size
        for r in own:
            assert r.copies == epochs + int(before + r.size / 2 < left)
            before += r.size


def test_mix_of_rows_without_ids(spark):
    docs = docs_of(spark, [(None if i % 3 else 5, f"{i} " * (1 + i % 5), "s") for i in range(3000)]).withColumns({"copies": F.lit("clash"), "size": F.lit("clash")})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == 3000 and {r.copies for r in rows} == {1, 2}
    out = mixing.mixed(docs, labels)
    assert out.count() == sum(r.copies for r in rows) and out.filter("size = copies").count() > 0


def test_mixed_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(i, f"w{i} " * (i % 7 + 1), f"s{i % 3}") for i in range(90)] + [(None, "no id", "s0"), (5, "a b", "s1"), (5, "a b", "s1"), (91, "", "s2")]
    docs = docs_of(spark, rows)
    digest = Counter()
    for r in mixing.mix(docs, labels).collect():
        digest[r.doc_id, r.source, r.size] += r.copies
    got = mixing.mixed(docs, labels).collect()
    assert {0, 1, 2} <= set(digest.values())
    assert Counter((r.doc_id, r.source, r.size) for r in got) == +digest
    assert all(len(r.text.split()) == r.size and 1 <= r.copy <= r.copies for r in got)
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert {*docs.columns, "copy", "copies", "target"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns)


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * 10, "s") for i in range(4000)] + [(i, "w " * 10, "t") for i in range(4000, 4500)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    got = mixing.draw(mixing.with_quality(docs_of(spark, rows), labels), size=mixing.word_count("text"), weight=F.col("_tm_quality"), share=0.5)
    taken = got.filter("source = 's' and copies > 0").groupBy((F.col("id") % 2).alias("good")).count().collect()
    n = {r.good: r["count"] for r in taken}
    assert n[1] > 1.5 * n[0]


# ------------------------------------------------------------ language model


def test_base_score_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs_of(spark, [(9000, None, "s"), (9001, "", "s"), (9002, "ABC abc\x85 \x0bx", "s"), (None, "the of", "s")]))
    rows = docs.collect()
    got = {r.doc_id: r for r in class_lm.report(docs, n_words=64, n_groups=32, n_classes=12, n_head=200).collect()}
    train = Counter()
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for r in rows:
        if not is_held(r.doc_id):
            train.update(tokens(r.text))
    n, v = sum(train.values()), len(train)
    for r in rows:
        w, g = tokens(r.text), got[r.doc_id]
        base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (is_held(r.doc_id), len(w), sum(x in train for x in w), n)
        assert math.isclose(g.base_score, base, rel_tol=1e-9)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    texts = docs.select(text_bytes().alias("_tm_bytes"))
    counts = class_lm.count_words(texts)
    m = class_lm.train(texts, counts, n_words=20, n_groups=16, n_classes=6, n_head=1_000_000)
    assert np.allclose((10.0**m.step).sum(axis=1), 1)
    mass = np.bincount(m.head_class, weights=10.0**m.head_emit, minlength=6) + 10.0 ** (m.unseen_log - m.class_log)
    used = 10.0**m.class_log > 1
    assert np.allclose(mass[used], 1, atol=1e-6)


def test_words_of_one_group_are_parted_by_their_contexts(spark):
    nouns, verbs = [f"n{i}zzz" for i in range(20)], [f"v{i}zzz" for i in range(20)]
    rng = random.Random(5)
    one_of = lambda words: rng.choices(words, [30] * 5 + [2] * 15)[0]
    texts = [" ".join(f"the {one_of(nouns)} will {one_of(verbs)}" for _ in range(30)) for _ in range(60)]
    df = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", text_bytes().alias("_tm_bytes"))
    for n_head in (1_000, 16):
        m, placed = class_lm._fit(df.withColumn("held_out", F.lit(False)), class_lm.count_words(df), n_words=13, n_groups=1, n_classes=6, n_head=n_head, trust=1.0)
        by_class = {}
        for r in placed.collect():
            for w, k in zip(texts[r.doc_id].split(), np.frombuffer(r.classes, dtype=np.int16).tolist(), strict=False):
                if w in nouns[5:] or w in verbs[5:]:
                    by_class.setdefault(k, Counter())[w[0]] += 1
        most = sum(max(c.values()) for c in by_class.values()) / sum(sum(c.values()) for c in by_class.values())
        assert most > 0.9, by_class


def test_no_training_rows(spark):
    docs = docs_of(spark, [(9000, "a b", "s")])
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = docs.withColumn("doc_id", F.lit(held).cast("long"))
    row = class_lm.report(docs).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == row.score == 0.0
    assert class_lm.report(docs.limit(0)).count() == 0


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    side = np.arange(24) % 2
    bigrams = rng.poisson(np.where(side[:, None] != side[None, :], 40, 2)).astype(float)
    cls = class_lm.exchange(bigrams, 2)
    assert len({tuple(cls[side == k]) for k in (0, 1)}) == 2 and len(set(cls[side == 0])) == 1 and len(set(cls[side == 1])) == 1


# ------------------------------------------------------------ toxicity


def test_toxicity_generalises_to_misspellings():
    rng = random.Random(4)
    clean = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["wretchkoz", "grumpvik", "zoxxard", "kwyjibo"]
    text = lambda n, extra: " ".join(rng.sample(extra + [rng.choice(clean) for _ in range(n)], n + len(extra)))
    texts = [text(40, [rng.choice(bad)]) for _ in range(120)] + [text(40, []) for _ in range(240)]
    m = toxicity.train([t.encode() for t in texts], [1] * 120 + [0] * 240)
    score = lambda t: m.score(toxicity.tokens(t.encode()))
    assert np.mean([score(text(300, ["wretchkozz"])) > 0.5 for _ in range(20)]) > 0.8
    assert np.mean([score(text(300, [])) < 0.5 for _ in range(20)]) > 0.8
    assert 0 <= score("") < 0.5


@pytest.mark.parametrize("joint", ["\u00a0", "\u3000", "_", "/", "-"])
def test_words_behind_many_bytes_are_scored(joint):
    words = [f"clean{i}" for i in range(200)] + ["wretchkoz"]
    assert toxicity.tokens(joint.join(words).encode()) == [w.encode() for w in words]


def test_text_without_joints_is_scored_to_its_end():
    text = "".join(chr(0x4E00 + i) for i in range(1000))
    got = [w.decode() for w in toxicity.tokens(text.encode())]
    assert max(map(len, got)) <= 24 and {text[i : i + 5] for i in range(996)} == {w[i : i + 5] for w in got for i in range(len(w) - 4)}
    assert toxicity.tokens(b"-" * 100) and toxicity.features([b"x" * 500], 16)[0].size > 1400


def test_toxicity_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = docs_of(spark, [(90_000, None, "s"), (90_001, "", "s"), (None, "text", "s"), (90_002, "w " * 200_000, "s")])
    rows = toxicity.report(docs.unionByName(odd).withColumn("score", F.lit("clash")), labels, max_docs=200).collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.8
    assert all(r.score == 0 for r in toxicity.report(odd, labels.limit(0)).collect())
    assert toxicity.reject(docs.limit(0), labels, max_docs=50).count() == 0


def test_long_labelled_texts_and_repeated_ids(spark):
    rng = random.Random(8)
    text = lambda bad: " ".join(rng.choice(["zorgblat", "quibnix"]) if bad and rng.random() < 0.02 else f"word{rng.randint(0, 300)}" for _ in range(3000))
    rows = [(i, text(i % 2), "s") for i in range(60)]
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert min(len(t) for _, t, _ in rows) > 20_000
    score = {r.doc_id: r.score for r in toxicity.report(docs, labels).collect()}
    assert np.mean([score[i] for i in range(1, 60, 2)]) > np.mean([score[i] for i in range(0, 60, 2)]) + 0.3
    # the order of rows with one id makes no difference, and columns of any name come back
    odd = docs.unionByName(docs_of(spark, [(i, f"other {i}", "s") for i in range(60)] + [(None, "", "s"), (None, None, "s")])).withColumns({"bytes": F.lit(1), "_1": F.lit(2)})
    a, b = (Counter(map(tuple, toxicity.report(odd.repartition(n), labels).collect())) for n in (2, 5))
    assert a == b
    kept = toxicity.reject(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(n for r, n in a.items() if r[2] < 0.5)
    empty = docs_of(spark, [(i, " ", "s") for i in range(60)])
    assert {r.score for r in toxicity.report(empty, labels).collect()} == {0.0}


# ------------------------------------------------------------ fingerprints


def test_fingerprint_is_homomorphic(spark):
    one, two = "a b c\nd e", "f g\n\nd e"
    rows = [(1, one, "s"), (2, two, "s"), (3, one + "\n" + two, "s"), (4, "d e\nf g\nd e\na b c", "s"), (5, "", "s"), (6, None, "s"), (7, "a b c\nd", "s")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs_of(spark, rows)).collect()}
    assert got[3].fingerprint == got[4].fingerprint != got[1].fingerprint
    assert set(got[5].lanes) == {0} and got[5].fingerprint == got[6].fingerprint
    df = spark.createDataFrame([(got[1].lanes, got[2].lanes, got[3].lanes)], "a array<long>, b array<long>, c array<long>")
    both, rest = df.select(fingerprint.combine(F.col("a"), F.col("b")), fingerprint.combine(F.col("c"), F.col("b"), -1)).first()
    assert both == got[3].lanes and rest == got[1].lanes


def check_edits(rows, texts):
    order = sorted(texts)
    for i, k in enumerate(order):
        text, after = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert rows[k].n_chars == len(text) and rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_edited_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in fingerprint.report(docs).collect()}
    check_edits(rows, {r.doc_id: r.text for r in docs.collect()})
    far = [r for r in rows.values() if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in far]) > 0.95 and all(0 <= r.near_next <= 1 for r in far)


@pytest.mark.parametrize("per_bucket", [1, 2, 3, 100])
def test_order_over_buckets(spark, per_bucket):
    texts = {i * i - 7: f"text {i} \U0001f600 é " * (i % 5) or None for i in range(23)}
    df = docs_of(spark, [(k, t, "s") for k, t in texts.items()]).repartition(3)
    order = sorted(texts)
    got = {r.doc_id: r for r in fingerprint.in_order(df, per_bucket=per_bucket).collect()}
    for i, k in enumerate(order):
        after = order[(i + 1) % len(order)]
        assert got[k]._next == (texts[after] or "") and (got[k]._nb, got[k]._nr) == (got[after]._b, got[after]._r)


def test_fingerprints_of_odd_tables(spark):
    assert fingerprint.report(docs_of(spark, [])).count() == 0
    one = fingerprint.report(docs_of(spark, [(1, "abcd", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and one.near_next == 1.0
    rows = fingerprint.report(docs_of(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "x", "s"), (None, None, "s"), (2, "long word " * 30_000, "s")])).collect()
    assert len(rows) == 5


# ------------------------------------------------------------ Jaccard join


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            o = len(sets[a] & sets[b])
            if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(rng, n, spread):
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, spread)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [f"w{rng.randint(0, 400)}"], [w[at], "Extra"]))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components_against_brute_force(spark, k, num, den):
    rng = random.Random(k)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d", "a  b\nc d", "a b c d e f g h", "a b c d e f g h i"]
    for spread in (2, 4, 8):
        texts += near_copies(rng, 25, spread)
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [f"{passage} {' '.join(f'u{j}x{i}' for i in range(rng.randint(0, 30)))}" for j in range(30)]
    texts += texts[10:20] + ["x " * 30_000 + "y"]
    rows = dict(enumerate(texts))
    df = docs_of(spark, [(i, t, "s") for i, t in rows.items()]).withColumn("component_id", F.lit("clash"))
    members, _ = jaccard_join.find(df, shingle=k, num=num, den=den)
    got = {r.id: (r.n, r.component_id) for r in members.collect()}
    want = brute_components(rows, k, num, den)
    assert got == want
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(df, shingle=k, num=num, den=den).collect())
    assert kept == sorted({c for _, c in want.values()})


def test_join_of_odd_tables(spark):
    assert jaccard_join.report(docs_of(spark, [])).count() == 0
    rows = [(1, "a b c d e", "s"), (1, "a b c d e", "s"), (None, "a b c d e", "s"), (7, "", "s")]
    assert sorted(map(tuple, jaccard_join.report(docs_of(spark, rows)).collect()), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (7, 0, 7)], key=str)
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs_of(spark, rows)).filter("doc_id is not null").collect()) == [1, 7]


def test_one_row_stays_of_rows_with_null_or_repeated_ids(spark):
    a, b, c = ("".join(f"{p}{i} " for i in range(30)) for p in "abc")
    rows = [(None, a, "s"), (None, a, "s"), (None, a + "x", "s"), (4, b, "s"), (4, c, "s"), (2, c, "s"), (None, b, "s"), (4, b, "s"), (None, None, "s")]
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(docs_of(spark, rows)).collect()), key=str)
    assert len(kept) == 4 and {(4, b), (2, c), (None, None)} <= set(kept) and sum(i is None and t is not None for i, t in kept) == 1


def test_long_texts_hash_alike_in_blocks():
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(700_000)]
    data = " ".join(words).encode()
    whole = np.unique(jaccard_join._hash_block(data, 4))
    assert len(data) > 4_000_000 and np.array_equal(jaccard_join.shingle_set(data, 4), whole)


def test_long_words_count_alike_in_texts_of_any_size(spark):
    words = [f"{i:04d}" * 1049 for i in range(962)]
    long, short = " ".join(words), " ".join(words[:942])
    assert len(long) > 4_000_000 > len(short)
    rows = {1: long, 2: short, 3: " ".join(words[500:]), 4: "a " + "x" * 5000, 5: "a " + "x" * 5001}
    got = jaccard_join.report(docs_of(spark, [(i, t, "s") for i, t in rows.items()])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85, 100)


def test_rows_of_a_hot_shingle_meet_only_where_their_pair_is_viable(spark):
    rng = random.Random(7)
    num, den = 85, 100
    rows = [(s, c, n, rng.randint(0, n - -(-n * num // den)), c % 40 if s else c // 700) for s in (0, 1) for c in range(400) for n in [rng.randint(40, 60)]]
    # templates with too many words of their own: none may meet
    rows += [(2, c, 63, 9, c) for c in range(20_000)]
    df = spark.createDataFrame(rows, "s long, c long, n int, pos int, l long")
    rest = df.withColumn("most", jaccard_join._most(F.col("n"), F.col("pos"), num, den))
    got = {(min(r), max(r)) for r in jaccard_join._across(rest, num, den).select("c1", "c").collect()}
    want = set()
    for s in (0, 1):
        own = [r for r in rows if r[0] == s]
        big = max(Counter(r[4] for r in own).items(), key=lambda x: (x[1], x[0]))[0]
        for i, (_, a, n1, p1, la) in enumerate(own):
            for _, b, n2, p2, lb in own[i + 1 :]:
                fits = min(n1, n2) * den >= max(n1, n2) * num and min(n1 - p1, n2 - p2) * (num + den) >= (n1 + n2) * num
                if la != lb and fits and (la != big or lb != big):
                    want.add((min(a, b), max(a, b)))
    assert got == want and want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    got = {r.c: r.label for r in jaccard_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ------------------------------------------------------------ pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near copies", "benchmark", "personal data", "mix"]
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}

    def kept(name, before):
        out = stages[name](spark, spark.createDataFrame([tuple(r) for r in before.values()], docs.schema), SF)
        assert out.schema.names == docs.columns
        got = out.collect()
        after = {r.doc_id: r for r in got}
        assert len(after) == len(got) and after.keys() <= before.keys()
        return after

    # toxicity: what the operator scores under 0.5 stays as it was
    after = kept("toxicity", rows)
    scores = {r.doc_id: r.score for r in toxicity.report(docs, labels).collect()}
    assert after == {i: r for i, r in rows.items() if scores[i] < 0.5}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in rows and r.toxic is not None}
    learned = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    toxic, clean = {i for i, t in truth.items() if t and learned(i)}, {i for i, t in truth.items() if not t}
    assert toxic and not toxic & after.keys() and len(clean & after.keys()) >= 0.9 * len(clean)
    # near copies: one row of each component by brute force
    before, after = after, kept("near copies", after)
    named = brute_components({i: r.text for i, r in before.items()}, 5, 80, 100)
    assert after == {i: before[i] for i in {c for _, c in named.values()}} and len(after) < len(before)
    # benchmark: no window is left; what has none is as it was
    before, after = after, kept("benchmark", after)
    windows = set()
    for r in items.collect():
        w = decontaminate.words_of((r.text or "").encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = decontaminate.words_of((text or "").encode())
        return {p for k in sizes for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in windows for p in range(i, i + k)}, len(w)

    for i, r in before.items():
        found, n = hit(r.text)
        assert (i in after) == (len(found) <= 0.5 * n)
        if i in after:
            assert after[i] == r if not found else len(decontaminate.words_of(after[i].text.encode())) == n - len(found) and after[i].n_chars == len(after[i].text)
    assert any(hit(r.text)[0] for r in before.values())
    # personal data: nothing of the fixed patterns is left; nobody goes
    before, after = after, kept("personal data", after)
    assert after.keys() == before.keys()
    changed = 0
    for i, r in before.items():
        if any(pii.base_spans(r.text).values()):
            assert not any(pii.base_spans(after[i].text).values()) and after[i].n_chars == len(after[i].text)
            changed += 1
    assert changed and sum(after[i] == r for i, r in before.items()) > len(before) / 2
    # mix: each document as often as its source's target takes it
    last = spark.createDataFrame([tuple(r) for r in after.values()], docs.schema)
    mix = stages["mix"](spark, last, SF).collect()
    digest = {r.doc_id: r for r in mixing.mix(last, labels).collect()}
    assert Counter(r.doc_id for r in mix) == +Counter({i: d.copies for i, d in digest.items()})
    assert all(r.text == after[r.doc_id].text and r.target == digest[r.doc_id].target for r in mix)
    run = corpus_pipeline.run(spark, SF).collect()
    assert Counter(map(tuple, run)) == Counter(map(tuple, mix))


def test_pipeline_stages_on_odd_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    plain = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, plain, "en", "a", 5), (1, plain, "en", "a", 5), (None, plain, None, None, None), (2, None, "en", "a", None), (3, "", "en", None, 0), (4, "\n \t", "en", "b", 3), (5, "call +49 151 2345678 now", "en", "a", 24),
        (6, "long " + "words and more text " * 60_000, "en", "b", 1), (7, "x" * 300_000, "en", "b", 1), (8, plain + " tail", "en", "b", 1), (None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    clash = ("_tm_row", "_0", "_1", "bytes", "row", "spans", "new", "component_id", "score", "id")
    odd = docs.withColumns({c: F.lit(f"{c}!") for c in clash})
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, odd, SF)
        got = out.collect()
        assert out.columns[: len(odd.columns)] == odd.columns if i == 4 else out.columns == odd.columns
        assert all(r[c] == f"{c}!" for r in got for c in clash)
        now = Counter((r.doc_id, r.text) for r in got)
        if name == "toxicity":
            assert now <= texts and now[2, None] and now[3, ""] and now[None, None]
        elif name == "near copies":
            assert now == texts - Counter([(1, plain), (None, plain), (8, plain + " tail")])
        elif name == "benchmark":
            assert now == texts
        elif name == "personal data":
            assert {i: n for i, n in Counter(k for k, _ in now.elements()).items()} == Counter(k for k, _ in texts.elements()) and now[5, "call <PHONE> now"] and now[2, None]
        else:
            assert now.keys() <= texts.keys() and now[6, rows[7][1]]
