"""Each operator against a plain version, a round trip or held-out accuracy; and on odd tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, common, langid, linear_text, lines, media, near, packing, quality, rules, token_counts, warc
from tessera.llm.byte_ids import ByteIds

SF = "/root/testdata/sf0.001"
ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "Long " * 30_000), (5, "tie\ntie\nTIE "), (6, "tie\ntie\nTIE "), (6, "tie\ntie\nTIE "), (7, "İΣΣ <|endoftext|> é́ 日本"), (None, "no id here"), (8, "#*$%&|<>" * 20)]


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    rows = [(i, t, "en", "s", 1, True, 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, key long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_bpe_equals_the_library(docs, odd):
    whole = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    for df in (docs, odd):
        got = Counter(tuple(r) for r in bpe.encode_digests(df).collect())
        want = Counter()
        for i, t in texts_of(df):
            ids = whole.encode(t, add_special_tokens=False).ids
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            want[i, len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))] += 1
        assert got == want


def test_bpe_remembers_what_recurs(monkeypatch):
    """Words that recur are merged once however many others come between; what is remembered is bounded and as right as what is not."""
    merged = Counter()

    def counted(symbols, *rest, merge=bpe.merge_word):
        merged[tuple(symbols)] += 1
        return merge(symbols, *rest)

    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(bpe, "merge_word", counted)
    path = common.tokenizer_path("word_bpe_49k.json")
    codec, whole, rng = bpe.BpeCodec(path), Tokenizer.from_file(path), random.Random(2)
    odd = ["Frequent", "frequent,", "H\u0331\u00c9", "\u0130\u03a3", "it's", "''s", "<|endoftext|>x", "a<|b", "\u65e5\u672c1", "-" * 80]
    for _ in range(40):
        words = [w for k in range(15) for w in ("frequent", "w" + "".join(rng.choices("abcdefgh", k=9)), odd[(k + rng.randrange(3)) % len(odd)])]
        text = " ".join(words)
        ids = whole.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        n, shown, spelled = codec.encode_joined(text.encode())
        assert (n, shown.decode(), spelled.decode()) == (len(ids), " ".join(map(str, ids)), whole.decode(ids, skip_special_tokens=False))
        assert len(codec.cache) <= 50
    merged.clear()
    text = " ".join(f"frequent q{''.join(rng.choices('abcdefgh', k=9))}" for _ in range(500))
    codec.encode_joined(text.encode())
    assert len(merged) > 400 and max(merged.values()) <= 2


def test_bpe_keeps_columns(odd, empty):
    assert bpe.encode_digests(empty).count() == 0
    made = bpe.encode_texts(odd)
    assert made.columns == [*odd.columns, "ids", "decoded"] and made.count() == len(ODD)


def plain_token_counts(text, parts, ids, whole, rule):
    """(first, characters, tokens, crossing) of each part, character by character."""
    spans, at, raw = [], 0, text.encode()
    assert ids.encode(raw).tolist() == whole.encode(text, add_special_tokens=False).ids
    of = [k for k, c in enumerate(text) for _ in c.encode()]
    for i in ids.encode(raw).tolist():
        spans.append(sorted(set(of[at : at + ids.lengths[i]])))
        at += ids.lengths[i]
    owner = [k for k, part in enumerate(parts) for _ in part]
    tokens, crossing = [0.0] * len(parts), [0] * len(parts)
    for span in spans:
        share = Counter(owner[c] for c in span)
        for k in share if len(share) > 1 else ():
            crossing[k] += 1
        if rule == "start":
            tokens[owner[span[0]]] += 1
        elif rule == "majority":
            tokens[max(share, key=lambda k: (share[k], -k))] += 1
        else:
            for k, n in share.items():
                tokens[k] += n / len(span)
    firsts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    return [(f, len(p), round(n, 6), c) for f, p, n, c in zip(firsts, parts, tokens, crossing, strict=True)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_equal_a_loop(docs, odd, empty, rule):
    whole, ids = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json")), ByteIds()
    for df in (docs.limit(40), odd):
        rows = token_counts.section_token_counts(df, rule).collect()
        got = Counter((r["doc_id"], r["section"], r["first_char"], r["n_chars"], round(r["n_tokens"], 6), r["n_crossing"]) for r in rows)
        want = Counter()
        for i, t in texts_of(df):
            lines = [x for x in t.replace("\n", "\n\0").split("\0")]
            lines = lines[:-1] if len(lines) > 1 and not lines[-1] else lines
            want.update((i, k, *found) for k, found in enumerate(plain_token_counts(t, lines, ids, whole, rule)))
        assert got == want
    assert token_counts.section_token_counts(empty, rule).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_of_fields(spark, rule):
    whole, ids = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json")), ByteIds()
    rows = [(1, "a title", "日本 é́", 7), (2, None, None, None), (3, "", "x\n", 10), (3, "", "x\n", 10), (None, "İ", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, title string, field string, n_tokens int")
    for separator in ("\n", "", " é"):
        got = token_counts.field_token_counts(df, ("title", "field", "n_tokens"), separator, rule).collect()
        got = Counter((r["doc_id"], r["field"], r["first_char"], r["n_chars"], round(r["n_tokens"], 6), r["n_crossing"]) for r in got)
        want = Counter()
        for i, *values in rows:
            values = ["" if v is None else str(v) for v in values]
            parts = [v + separator for v in values[:-1]] + values[-1:]
            want.update((i, f, *found) for f, found in zip(("title", "field", "n_tokens"), plain_token_counts("".join(parts), parts, ids, whole, rule), strict=True))
        assert got == want


def test_language_of_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    held = [(r["doc_id"], r["lang"]) for r in docs.select("doc_id", "lang").collect() if common.held_out(r["doc_id"])]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97


def test_language_of_odd_texts(odd, empty, docs):
    model = langid.train(docs)
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 8)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.predict(empty, model).count() == 0
    assert langid.predict(odd, langid.train(empty)).count() == len(ODD)


def test_letters_of_all_planes_and_rare_languages(spark):
    read = langid.Reader()
    assert [langid.BLANK != read(chr(c))[0] for c in (0x61, 0x4E00, 0x323AF, 0x1F600, 0xE0001, 0x10FFFF)] == [True, True, True, False, False, False]
    assert langid.quotas({"a": 5, "b": 1000, "c": 400}, 305) == {"a": 5, "c": 150, "b": 150}
    rows = [(i, "common words here", "en") for i in range(3000)] + [(3000 + i, "ein seltenes Wort", "de") for i in range(8)]
    common.prepare(spark)
    sample = langid.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 200, alike=True)
    found = Counter(r["lang"] for r in sample.collect())
    assert found["de"] == sum(not common.held_out(3000 + i) for i in range(8)) and 150 < found["en"] < 250
    model = langid.fit([(1, "tie", "b"), (1, "tie", "a")])
    assert model.languages == ["a", "b"]


def test_sums_do_not_depend_on_blocks(monkeypatch, docs):
    """A plain scorer, one text at a time by its counted features, against sums over a batch in blocks of any size."""
    texts = [t.encode() for _, t in texts_of(docs)[:30]] + [b"", b"x" * 500 + b" y", b" " * 300, "日本é ".encode() * 60]
    gain = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    gain[-1] = 0
    want = []
    for t in texts:
        at, count = quality.counted(t)
        want.append(1 / (1 + np.exp(-((gain[at] * count).sum() / max(count.sum(), 1) + 0.3))))
        plain = Counter(t.split())
        assert sum(n for w, n in plain.items() if len(w) > quality.INLINE_WORD) == len(quality.long_words(np.frombuffer(t, np.uint8)))
    for block in (97, 1 << 18):
        monkeypatch.setattr(linear_text, "BLOCK", block)
        assert np.allclose(quality.scores(texts, gain[:, None], 0.3), want, atol=1e-9)
    read, weights = langid.Reader(), np.random.default_rng(2).normal(size=((1 << langid.BITS) + 1, 3))
    weights[-1] = 0
    codes = [read(t.decode()) for t in texts]
    monkeypatch.setattr(linear_text, "BLOCK", 101)
    total, n = linear_text.sums(codes, langid.BLANK, langid.blanks, langid.extract, weights)
    for k, text in enumerate(codes):
        at, count = linear_text.features(text, langid.BLANK, langid.blanks, langid.extract)
        assert n[k] == count.sum() and np.allclose(total[k], count @ weights[at])


def test_quality_of_unseen_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in quality.predict(docs, quality.train(docs, labels)).collect()}
    held = [r for r in labels.collect() if common.held_out(r["doc_id"])]
    good = [got[r["doc_id"]]["score"] for r in held if r["quality"] == 1]
    bad = [got[r["doc_id"]]["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_quality_of_odd_texts(odd, empty, spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    assert quality.predict(odd, model).count() == len(ODD) and quality.predict(empty, model).count() == 0


def plain_rules(text):
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_rules_equal_a_loop(docs, odd):
    for df in (docs, odd):
        got = [(r["doc_id"], *(r[c] for c in rules.COUNTS[:5])) for r in rules.count_signals(df).collect()]
        assert sorted(got, key=str) == sorted(((i, *plain_rules(t)) for i, t in texts_of(df)), key=str)


def test_binomial_bound_and_ladder():
    assert rules.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert rules.binomial_upper(5, 5, 0.05) == 1.0
    assert rules.choose(1000, [0, 10, 20, 60, 0], 0.05, 0.02) == 3
    assert rules.choose(20, [0] * 8, 0.05, 0.02) == 0


@pytest.mark.parametrize("n,p", [(10, 0.05), (300, 0.05), (2000, 0.31)])
def test_binomial_tail_equals_its_sum(n, p):
    terms = [math.comb(n, i) * p**i * (1 - p) ** (n - i) if n < 500 else math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(n + 1)]
    for k in range(0, n + 1, max(1, n // 17)):
        assert rules.at_most(k, n, p) == pytest.approx(sum(terms[: k + 1]), abs=1e-9)
    assert 0 <= rules.at_most(49_000_000, 10**9, 0.05) < 1e-9


def plain_verdicts(rows, good):
    """Base verdicts and verdicts of (id, text), by the ladder and plain sums."""
    facts = []
    for i, t in rows:
        words, raw = t.encode().split(), t.encode()
        lines = [x for x in raw.split(b"\n") if x.split()]
        n, chars, symbols, dup, repeated = plain_rules(t)
        per = lambda x, y: x / max(y, 1)
        values = {
            "symbol_rate": per(symbols, n), "dup_line_rate": per(dup, len(lines)), "repeat_rate": per(repeated, n), "capital_rate": per(sum(65 <= c < 91 for c in raw), chars),
            "exclaim_rate": per(raw.count(b"!"), n), "long_words": per(chars, n), "short_words": -per(chars, n),
        }
        failed = n < 50 or 100 * repeated > 50 * n
        facts.append((i, failed, sum(n >= b for b in rules.BANDS[1:]), [any(values[s] > cut[r] for s, cut in rules.LADDER.items()) for r in range(rules.RUNGS)]))
    rung = []
    for band in range(len(rules.BANDS)):
        held = [r for i, failed, own, r in facts if i in good and not failed and own == band]
        last = 0
        for k in range(rules.RUNGS if held else 0):
            n, bad = len(held), sum(r[k] for r in held)
            if bad < n and sum(math.comb(n, j) * rules.RISK**j * (1 - rules.RISK) ** (n - j) for j in range(bad + 1)) <= rules.ERROR / len(rules.BANDS):
                last = k + 1
            else:
                break
        rung.append(last)
    return [(i, failed, not failed and not (rung[band] and out[rung[band] - 1])) for i, failed, band, out in facts]


def test_verdicts_equal_a_plain_version(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    for df in (docs, odd):
        got = [(r["doc_id"], r["base_failed"], r["kept"]) for r in rules.judge(df, labels).collect()]
        assert sorted(got, key=str) == sorted(plain_verdicts(texts_of(df), good), key=str)


def test_rules_keep_good_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in rules.judge(docs, labels).collect()}
    assert all(not r["kept"] for r in got.values() if r["base_failed"])
    good = [got[r["doc_id"]] for r in labels.collect() if r["quality"] == 1]
    assert np.mean([r["kept"] for r in good if not r["base_failed"]]) > 0.93


def test_rules_on_odd_tables(odd, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.judge(odd, labels).count() == len(ODD) and rules.judge(empty, labels).count() == 0
    assert odd.where(rules.accepted(odd["text"], [0, 0, 0])).columns == odd.columns


def plain_components(rows, words, share):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_all_pairs(docs, words):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(docs, words).collect()}
    assert got == plain_components(texts_of(docs), words, 80)


def test_near_duplicates_of_one_large_group(spark):
    """Nodes that stay large at the last depth: copies of one text with a few other words each."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(1, 14)):
            own[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    common.prepare(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df, 2).collect()}
    assert got == plain_components(rows, 2, 80)


def test_near_duplicates_equal_all_pairs_of_a_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    common.prepare(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df, 2).collect()}
    assert got == plain_components(texts_of(df), 2, 80)


def test_near_duplicates_make_few_files_of_many_partitions(spark, docs, monkeypatch):
    held = defaultdict(list)

    def noted(df, tag, keep=False, store=near.stored):
        found = store(df, tag, keep)
        held[tag].append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(near, "stored", noted)
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for name, value in zip(before, ("96", "false"), strict=True):
            spark.conf.set(name, value)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(docs, 2).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == plain_components(texts_of(docs), 2, 80)
    assert {"stars", "groups", "own", "candidates"} <= held.keys()
    assert max(n for tag in ("stars", "groups", "own", "candidates", "large", "left") for n in held[tag]) <= max(near.PER_CORE * spark.sparkContext.defaultParallelism, 96 // near.PER_FILE)


@pytest.mark.parametrize("stray_blocks", [0, 3, 1000])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, stray_blocks):
    """A group of which many members are linked with neither its centre nor one another, compared in tiles of a few, at the last depth or before."""
    monkeypatch.setattr(near, "STRAY_BLOCKS", stray_blocks)
    monkeypatch.setattr(near, "BLOCK", 7)
    monkeypatch.setattr(near, "CHUNK", 5)
    rng, rows = random.Random(8), []
    base = [f"w{k}" for k in range(100)]
    for i in range(160):
        own = list(base)
        for k in rng.sample(range(100), rng.randint(1, 20)):
            own[k] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(own[: rng.randint(80, 100)])))
    common.prepare(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    want = plain_components(rows, 2, 80)
    assert got == want and 20 < len({c for _, c in want.values()}) < 150


def test_overlaps_equal_set_intersections(monkeypatch):
    monkeypatch.setattr(near, "COLUMNS", 16)
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 120, rng.integers(1, 90), np.uint64)) for _ in range(40)]
    for one, two in ((sets[:9], sets[9:]), (sets[:2], sets[2:]), (sets[:6], [np.array([999], np.uint64)])):
        assert near.overlaps(one, two).tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]


def test_near_duplicates_of_ids_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (3, a), (3, b), (4, c), (5, c), (5, c), (6, None)]
    common.prepare(spark)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == [(1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True)]


def pairs_of_tokens(pairs, common):
    """Tokens of pairs at 0.8 (rows 2k and 2k + 1) of which other rows share about the square of `common`."""
    rng = np.random.default_rng(6)
    draw = lambda: rng.integers(0, 2**63, (pairs, near.FUNCTIONS), np.uint64)
    one = np.where(rng.random((pairs, near.FUNCTIONS)) < common, draw()[:1], draw())
    two = np.where(rng.random((pairs, near.FUNCTIONS)) < 0.8, one, draw())
    return np.stack([one, two], axis=1).reshape(2 * pairs, near.FUNCTIONS)


@pytest.mark.parametrize("depth", range(near.DEPTHS))
def test_trees_rarely_miss_a_pair_at_any_depth(depth):
    keys = near.paths(pairs_of_tokens(5000, 0), near.TREES)[depth]
    assert (keys[::2] == keys[1::2]).any(axis=1).all()


def test_sketch_filter_rarely_drops_a_pair():
    assert sum(math.comb(128, k) * 0.9**k * 0.1 ** (128 - k) for k in range(near.LEAST_BITS)) < 1e-6


def test_pairs_of_large_nodes_are_found(spark):
    """All documents share tokens, so that nodes stay large up to the last depth but one."""
    common.prepare(spark)
    tokens = pairs_of_tokens(1500, 0.67)
    bits = np.packbits((near.mix(tokens[:, :128]) >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
    keys = [k.view(np.int64).tolist() for k in map(np.ascontiguousarray, near.paths(tokens, near.TREES))]
    rows = [(i, 100, *map(int, bits[i]), *(k[i] for k in keys)) for i in range(len(tokens))]
    signed = common.stored(spark.createDataFrame(rows, "id long, n long, low long, high long, " + ", ".join(f"k{d} array<bigint>" for d in range(near.DEPTHS))), "signed")
    none = spark.createDataFrame([], "a long, b long")  # nothing is confirmed, so no pair is left to an earlier link
    nodes = defaultdict(set)

    def branch_on(large, last):
        for r in large.collect() if last else []:
            nodes[r["node"]].add(r["id"])
        return none, none.toDF("id", "cluster"), large.limit(0) if last else large

    candidates, _, _ = near.walk(signed, lambda candidates, members: none, branch_on)
    found = {(r["a"], r["b"]) for r in candidates.where("a % 2 = 0 and b = a + 1").collect()}
    found |= {(i, i + 1) for own in nodes.values() for i in own if i % 2 == 0 and i + 1 in own}
    assert found == {(i, i + 1) for i in range(0, len(tokens), 2)}


def test_near_duplicates_on_odd_tables(odd, empty):
    rows = near.near_duplicates(odd, 2).collect()
    assert len(rows) >= len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["component_id"] is None and by[None]["kept"] and by[0]["component_id"] == 0 and by[6]["component_id"] == 5
    assert near.near_duplicates(empty).count() == 0


def test_best_two_fit_is_valid_and_tight():
    rng = np.random.default_rng(5)
    for size in (16, 1024):
        count = Counter(np.minimum(rng.geometric(3 / size, 3000), size).tolist())
        left = Counter(count)
        bins = 0
        for pattern, times in packing.best_two_fit(count, size):
            assert sum(s * k for s, k in pattern.items()) <= size
            bins += times
            for s, k in pattern.items():
                left[s] -= k * times
        assert not any(left.values()) and bins <= -(-sum(s * k for s, k in count.items()) // size) * 1.02 + 1


def plain_pieces(rows, whole):
    out = Counter()
    for i, t in rows:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [(0, first), *((k, k + 1024) for k in range(first, len(ids), 1024))]
        out.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(cuts))
    return out


def one_by_one(lengths, size):
    """Best-two-fit a bin at a time on a list of pieces."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, room = [], size
        for x in list(left):
            if x <= room:
                own.append(x)
                left.remove(x)
                room -= x
        gap, least = room + own[-1], own[-1]
        pairs = [(a + b, a) for k, a in enumerate(left) for b in left[k + 1 :] if a + b <= gap]
        if room and pairs and max(pairs)[0] > least:
            total = max(pairs)[0]
            small = min(min(a, total - a) for t, a in pairs if t == total)  # of equal sums the one with the smallest piece
            own.remove(least)
            own += [total - small, small]
            left.remove(small)
            left.remove(total - small)
            left = sorted([*left, least], reverse=True)
        bins.append(tuple(sorted(own, reverse=True)))
    return Counter(bins)


@pytest.mark.parametrize("seed", range(12))
def test_best_two_fit_equals_packing_one_by_one(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    lengths = rng.integers(1, size + 1, int(rng.integers(1, 120))).tolist()
    got = Counter()
    for pattern, times in packing.best_two_fit(Counter(lengths), size):
        got[tuple(s for s, k in pattern.items() for _ in range(k))] += times
    assert got == one_by_one(lengths, size)


def test_packing_holds_every_token_once(docs, odd, empty):
    whole = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    for df in (docs, odd):
        rows = packing.pack(df).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == plain_pieces(texts_of(df), whole)
        places = defaultdict(list)
        for r in rows:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        assert sum(r["length"] for r in rows) == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts_of(df))
    assert packing.pack(empty).count() == 0


def plain_lines(rows, least):
    key = lambda x: x.encode().strip(common.SPACES).lower()
    df = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")})
    out = []
    for i, t in rows:
        kept = [x for x in t.split("\n") if not (key(x) and df[key(x)] >= least)]
        out.append((i, t.count("\n") + 1, t.count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("least,batches,fan_out", [(2, 5, 2), (3, 1, 2), (10, 4, 2)])
def test_line_dedup_equals_a_count(docs, odd, least, batches, fan_out):
    for df in (docs, odd):
        got = [tuple(r) for r in lines.line_digests(df, least=least, batches=batches, fan_out=fan_out).collect()]
        assert sorted(got, key=str) == sorted(plain_lines(texts_of(df), least), key=str)


@pytest.mark.parametrize("least,batches,fan_out", [(2, 9, 2), (10, 4, 2), (5, 8, 3), (3, 2, 4)])
def test_line_dedup_of_many_batches_equals_a_count(docs, odd, least, batches, fan_out):
    for df in (docs, odd):
        dealt = df.select("doc_id", "text").repartition(8)
        assert {r[0] for r in lines.keyed_lines(dealt, batches).select("batch").distinct().collect()} <= {*range(batches)}
        got = [tuple(r) for r in lines.line_digests(dealt, least=least, batches=batches, fan_out=fan_out).collect()]
        assert sorted(got, key=str) == sorted(plain_lines(texts_of(df), least), key=str)


def test_line_dedup_makes_few_files(spark, docs, monkeypatch):
    made, kept, write = [], [], lines.SortedRuns._write

    def written(self, counted):
        made.append(write(self, counted))
        return made[-1]

    def noted(session, tag, keep=False, place=lines.scratch):
        kept.append(place(session, tag, keep))
        return kept[-1]

    def held(df, tag, keep=False, store=lines.stored):
        found = store(df, tag, keep)
        kept.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(lines.SortedRuns, "_write", written)
    monkeypatch.setattr(lines, "scratch", noted)
    monkeypatch.setattr(lines, "stored", held)
    lines.line_digests(docs.repartition(8)).count()
    assert len(made) == 3  # of four batches: a run, two in one, a run; the last batch is not written
    assert len(spark.read.parquet(kept[0]).inputFiles()) == 8  # a file for each partition, whatever the batches
    assert kept[-1] == 1


def test_line_dedup_keeps_columns(odd, empty):
    assert lines.drop_frequent_lines(odd).drop("__n_lines", "__n_dropped").columns == odd.columns
    assert lines.drop_frequent_lines(empty).count() == 0


def test_media_round_trip():
    rng = np.random.default_rng(1)
    payloads = [bytes(rng.integers(0, 256, 192 * k, dtype=np.uint8)) for k in (1, 2, 3, 50)]
    payloads += [bytes([v]) * 192 * 3 for v in (0, 32, 127, 128, 129, 255)]
    payloads += [bytes(rng.choice([128] * 30 + [127, 131], 192 * 40).astype(np.uint8)), bytes(rng.choice([126, 127, 128, 129, 130], 192 * 9).astype(np.uint8))]
    for made, p in zip(media.decode_group(media.encode_payload(payloads), media.Tables()), payloads, strict=True):
        assert media.read_payload(made[0], made[1]) == p


def test_media_tensor_equals_a_direct_transform():
    payload = bytes(np.random.default_rng(2).integers(100, 156, 384, dtype=np.uint8))
    image, coefficients, rgb = media.decode_group(media.encode_payload([payload]), media.Tables())[0]
    order = media.zigzag()

    def block(k):
        c = np.zeros(64)
        c[order] = coefficients[k]
        u = np.arange(8)
        basis = np.cos((2 * u[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
        return np.clip(basis @ c.reshape(8, 8) @ basis.T + 128, 0, 255)

    y = np.block([[block(0), block(1)], [block(2), block(3)]])
    cb, cr = (np.kron(block(k), np.ones((2, 2))) - 128 for k in (4, 5))
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
    assert rgb.shape == (16, 16, 3) and np.abs(rgb - want).max() <= 3


def test_media_digests_equal_plain_ones(docs, odd):
    for df in (docs, odd):
        held = df.select("doc_id", "text")
        made = {(r["doc_id"], r["n_bytes"]): r["media"] for r in media.store_texts(held).collect()}
        rows = media.media_digests(media.store_texts(held)).collect()
        assert len(rows) == df.count()
        texts = {(i, len(t.encode())): t.encode() for i, t in texts_of(df)}
        features = {}
        for r in rows:
            key = (r["doc_id"], r["n_bytes"])
            payload, own = texts[key] + b" " * (-len(texts[key]) % 192 if texts[key] else 192), bytes(made[key])
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload)
            assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_bytes"] == len(own) and r["media_sha256"] == hashlib.sha256(own).hexdigest()
            assert features.setdefault(texts[key], r["feature"]) == r["feature"]
            if len(payload) < 4000:
                rgb = media.decode_group([own], media.Tables())[0][2]
                assert r["feature"] == f"{rgb.shape[1]}x{rgb.shape[0]} rgb " + " ".join(str(int(rgb[..., k].astype(np.int64).sum())) for k in range(3))


def test_media_of_odd_texts(odd, empty, spark):
    rows = media.media_digests(media.store_texts(odd)).collect()
    assert len(rows) == len(ODD)
    want = Counter((i, hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for i, t in ODD)
    assert Counter((r["doc_id"], r["payload_sha256"]) for r in rows) == want
    assert media.media_digests(media.store_texts(empty)).count() == 0
    good = media.encode_payload([b" " * 192])[0]
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"nothing")), (3, bytearray(good[: len(good) // 2])), (4, bytearray(good))], "k long, m binary")
    got = {r["k"]: r for r in media.decode_tensors(bad, "k", "m").collect()}
    assert [got[k]["error"] is None for k in (1, 2, 3, 4)] == [False, False, False, True] and len(got[4]["tensor"]) == 16 * 16 * 3


def test_loser_tree_merges_like_a_sort():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 64):
        runs = [sorted((rng.choice("abc"), "t", rng.randrange(9), "f", 0, 0) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.merge([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_archives_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 2)
    rows = [(3, "http://b.org/x", "p" * 200), (1, "http://a.org/", "p" * 200), (2, None, None), (4, "http://a.org:8080/q?x=1 2", "short"), (5, "http://www.a.org/", "short"), (None, "u\r\nv", "p" * 200), (3, "http://b.org/x", "p" * 200)]
    pages = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, time string").repartition(5)
    got = warc.archive_and_read(pages).orderBy("range", "position").collect()
    assert [r["url_key"] for r in got] == sorted(r["url_key"] for r in got) and len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[3]["record_type"], by[3]["refers_to"]) == ("revisit", 1) and by[1]["record_type"] == by[5]["record_type"] == by[None]["record_type"] == "response"
    assert by[2]["payload_digest"] == hashlib.sha256(b"").hexdigest() and by[1]["payload_bytes"] == 200
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_history_of_one_url_is_split_and_ordered(spark, monkeypatch):
    """Ranges split the captures of one URL; ids of any size keep their order; payloads may be very long."""
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 5)
    ids = [3, 1, 2, *range(10, 40), 2_000_000_001, 1_999_999_999, 2**62, 2**62 - 1, -5, None]
    rows = [(i, "http://a.org/", f"payload {i} " * (100_000 if i == 2 else 20)) for i in ids]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_and_read(pages).orderBy("range", "position").collect()
    assert [r["page_id"] for r in got] == sorted(ids, key=lambda i: i or 0) and len({r["range"] for r in got}) > 3
    assert {r["page_id"]: r["payload_bytes"] for r in got} == {i: len(t) for i, _, t in rows}


def test_archives_of_ids_with_two_payloads(spark):
    a, b, c = ("abc"[k] * 200 for k in range(3))
    rows = [(1, a), (2, b), (7, a), (7, c), (8, a), (8, b)]
    pages = spark.createDataFrame([(i, "http://a.org/", t) for i, t in rows], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_digest"], r["refers_to"]) for r in warc.archive_and_read(pages).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter([(1, sha(a), None), (2, sha(b), None), (7, sha(a), 1), (7, sha(c), None), (8, sha(a), 1), (8, sha(b), 2)])


def test_archives_of_long_pages_hold_few_rows(spark, monkeypatch):
    """Scans hold few rows at once, and the setting comes back; only the tables of copies are written, and they go."""
    name, seen, files = "spark.sql.parquet.columnarReaderBatchSize", [], []
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 5)

    def watched(df, tag, *more):
        out = common.stored(df, tag, *more)
        seen.append((tag, spark.conf.get(name)))
        files.extend(out.inputFiles())
        return out

    monkeypatch.setattr(warc, "stored", watched)
    before = spark.conf.get(name, None)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"payload {i % 30}" * 20) for i in range(45)], "page_id long, url string, html string").repartition(9)
    got = warc.archive_and_read(pages).orderBy("range", "position").collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {i: i - 30 if i >= 30 else None for i in range(45)}
    assert [r["url_key"] for r in got] == sorted(r["url_key"] for r in got) and len({r["range"] for r in got}) > 4
    assert seen == [("first", str(warc.VECTOR_ROWS)), ("revisits", str(warc.VECTOR_ROWS))] and warc.VECTOR_ROWS <= 64
    assert spark.conf.get(name, None) == before
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_scratch_is_shared_and_removed(spark):
    class Cluster:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext, conf = Cluster(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Session(), "x")
    with common.temporary(spark):
        gone, left = common.stored(spark.range(3), "gone"), common.stored(spark.range(3), "left", keep=True)
        names = [df.inputFiles()[0].removeprefix("file://") for df in (gone, left)]
        assert gone.count() == 3
    assert not os.path.exists(names[0]) and os.path.exists(names[1]) and left.count() == 3


def test_line_runs_leave_no_tables(spark, docs):
    lines.line_digests(docs).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run_")]


def plain_stages(spark, docs):
    """What each stage but the last keeps, by id, from plain versions."""
    kept = dict(texts_of(docs))
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1}
    kept = {i: kept[i] for i, _, ok in plain_verdicts(list(kept.items()), good) if ok}
    yield kept
    model, read, sure = langid.train(docs.where(docs["doc_id"].isin([*kept]))), langid.Reader(), {}
    for i, t in kept.items():
        at, count = linear_text.features(read(t), langid.BLANK, langid.blanks, langid.extract)
        p = langid.softmax(((count @ model.weights[at]) / max(count.sum(), 1) + model.bias)[None] / model.temperature)
        if len(at) and p.max() >= 0.5:
            sure[i] = t
    yield sure
    key = lambda x: x.encode().strip(common.SPACES).lower()
    often = Counter(k for t in sure.values() for k in {key(x) for x in t.split("\n")})
    kept = {i: "\n".join(x for x in t.split("\n") if not key(x) or often[key(x)] < 10) for i, t in sure.items()}
    yield kept
    yield {i: kept[i] for i, (_, c) in plain_components(kept.items(), 5, 80).items() if i == c}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_stages(spark, docs), strict=False):
        kept = common.stored(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in kept.collect()} == want
    whole = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == plain_pieces(texts_of(kept), whole)


def test_stages_on_odd_tables(spark, odd, empty):
    """Every stage alone on nulls, empty and long texts, repeated rows and clashing columns, and on an empty table."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd, SF).collect()
        if name != "best_fit_packing":
            held = Counter(map(tuple, odd.collect()))
            assert all(held[tuple(r)] for r in rows if name != "line_dedup") and set(rows[0].asDict() if rows else odd.columns) == set(odd.columns)
        assert name not in ("line_dedup", "best_fit_packing") or len(rows) >= len(ODD)
        assert stage(spark, empty, SF).count() == 0
