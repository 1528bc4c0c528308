"""Operators against brute force on small tables with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import factor_machine, minhash, mixing, packing, phrases, quality_rules, repeats, suffix_dedup, token_files, topk, transcripts
from canvass.llm.common import table
from canvass.llm.token_ids import Encoder, public_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, part string, anchor int, mix int"


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n\t ", "one", "ha " * 400, passage, passage, passage + " tail", "head " + passage, " ".join(word() for _ in range(3000))]
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) + "\n" + passage[rng.randint(0, 50): rng.randint(60, 300)] for _ in range(40)]
    texts += ["été " * 30 + "x", "\x1c\x85  <|endoftext|> a\x0bb", "😀" * 60, passage]
    return [(i * 3 % 97, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, "q", "p", 1, 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def windows_cut(docs, length):
    """Tokens that lie in a window which starts in a document with a smaller id."""
    first = {}
    for i, w in docs:
        for a in range(len(w) - length + 1):
            key = tuple(w[a : a + length])
            first[key] = min(i, first.get(key, i))
    for i, w in docs:
        cut = [False] * len(w)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < i:
                cut[a : a + length] = [True] * length
        yield i, w, cut


def test_quality_rules(odd, none):
    got = {r.doc_id: r for r in quality_rules.rule_report(odd).collect()}
    for doc_id, text, *_ in odd_rows():
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(inside), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.rule_report(none).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns
    plan = quality_rules.rule_report(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowColumn", "")


def test_verdicts_can_be_filtered(odd):
    """A filter neither hangs nor changes a row, and the plan stays small."""
    report = quality_rules.rule_report(odd)
    kept = report.where("kept and n_repeat_words < 3")
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    want = [tuple(r) for r in report.collect() if r.kept and r.n_repeat_words < 3]
    assert sorted(map(tuple, kept.collect())) == sorted(want)


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    letters = " \n\t\x0b   ab1,.'sé́ß<|endoftext|>\x1c\x85Σ中😀 \n  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [r[1] for r in odd_rows()]
    texts += ["a <|endoftext|> b", "<|startoftext|><|endoftext|>", "x<|ENDOFTEXT|>y", "<|endoftext|", "word <|endoftext|>\n" * 50]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_path(name))
        want = [np.array(x.ids + [7], "<u4").tobytes() for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert Encoder(public_path(name), limit=500)(texts, 7) == want


def test_encoder_on_words_and_marks():
    """What is put together from letters, marks and white space; the memory starting anew; other letters and white space."""
    from tokenizers import Tokenizer

    rng = random.Random(2)
    pieces = ["a", "Foo", "don", "'s", "’s", "É", "ß", "İ", "ſ", "K", "ŉ", "Ÿ", "ž", "ƀ", "ΑΣ", "H\u0331", "A\u0301", "12", "½", "ª", "×", "÷", "***", "...", ",", "Ж", "中文", "é" * 11, "a" * 23, "b" * 24, "c" * 1100]
    texts = ["".join("".join(rng.choices(pieces, k=rng.choice([1, 2, 3]))) + rng.choice([" ", " ", " ", "\n", " \n", "\n\n"]) for _ in range(rng.choice([1, 4, 12])))[:-1] for _ in range(6000)]
    texts += ["_\n\n\u3000 ", "x\n\n\t\ny", "x \n\xa0 y", "  ", "\n", None]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_path(name))
        want = [np.array(x.ids + [7], "<u4").tobytes() for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for limit, lot in ((500_000, 500), (100, 7)):
            encode = Encoder(public_path(name), limit=limit)
            assert [x for at in range(0, len(texts), lot) for x in encode(texts[at : at + lot], 7)] == want


def test_words_are_hashed_at_once(monkeypatch):
    """Equal hashes for equal words only, cut as a bytes split cuts; no short word is digested by itself."""
    rng = random.Random(8)
    pieces = [b" ", b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\xc2\x85", b"a", b"b", b"\x00", "é".encode(), b"\xff", b"x" * 11]
    bodies = [b"".join(rng.choices(pieces, k=rng.choice([0, 1, 2, 5, 20]))) for _ in range(3000)]
    long = repeats.WordWindows().tokens([b"", b"y" * 22, b"y" * 23, b"y" * 24, b"y" * 25 + b" " + b"y" * 24, b""])
    assert [len(x) for x in long] == [0, 1, 1, 1, 2, 0] and len({*long[1], *long[2], *long[3], *long[4]}) == 4
    bodies = [b for b in bodies if max(map(len, b.split()), default=0) < 24]
    monkeypatch.setattr(repeats.xxhash, "xxh3_64_intdigest", None)
    of: dict[bytes, int] = {}
    for body, tok in zip(bodies, repeats.WordWindows().tokens(bodies), strict=True):
        assert [of.setdefault(w, x) for w, x in zip(body.split(), tok.tolist(), strict=True)] == tok.tolist()
    assert len(set(of.values())) == len(of) and repeats.WordWindows().tokens([]) == []


def test_passages_are_compiled_as_one(monkeypatch):
    """A copied document of 600 words is a few passages to the automaton, not one per anchor."""
    rng = random.Random(9)
    body = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(600)).encode()
    spec, bodies = repeats.WordWindows(), [body, b"tail " + body, b"", body + b" " + body]
    toks = spec.tokens(bodies)
    part = repeats.Part(np.array([5, 3, 4, 9]), np.zeros(4, bool), bodies, np.concatenate(toks), np.cumsum([len(t) for t in toks]))
    found = repeats.segments(part, spec)
    windows = Counter()
    for a, n in zip(found.start, found.count):
        windows.update(tuple(part.tok[i : i + 13]) for i in range(a, a + n))
    keep = [i for i, (a, n) in enumerate(zip(found.start, found.count)) if min(windows[tuple(part.tok[j : j + 13])] for j in range(a, a + n)) > 1]
    hits = repeats.Hits(found.start[keep], found.count[keep], np.full(len(keep), 3), found.doc[keep])
    compiled, call = [], phrases._compile
    monkeypatch.setattr(phrases, "_compile", lambda word, hits, length: compiled.append(len(hits.start)) or call(word, hits, length))
    rows = {r["doc_id"]: r for r in phrases._finish(13)(part, hits).to_pylist()}
    assert len(keep) > 100 and compiled[0] <= 4 * 4
    assert [rows[i]["n_removed"] for i in (3, 4, 5, 9)] == [0, 0, 600, 1200]
    assert rows[9]["spans"] == [{"start": 0, "end": 1200}] and rows[9]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_encoder_sends_words_past_the_patterns():
    """New words, also with marks after them, cost the model alone; the tokenizer's patterns see little but the marks."""
    rng = random.Random(3)
    words = ["".join(rng.choices(["er", "on", "lich", "ä", "que", "Th", "ung", "s"], k=rng.randint(2, 5))) for _ in range(5000)]
    texts = [" ".join(w + rng.choice(["", "", ",", ".", "***", "!!"]) for w in words)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode, seen = Encoder(public_path(name)), []
        call = encode._encode_chunks
        encode._encode_chunks = lambda chunks: seen.extend(chunks) or call(chunks)
        assert encode(texts, 7) == [encode._encode(texts)[0] + (7).to_bytes(4, "little")]
        assert len(seen) <= 4


@pytest.mark.parametrize("fan_in", [2])
def test_packing(odd, none, fan_in):
    rows = packing.pack(odd, fan_in=fan_in).collect()
    encode = Encoder(public_path("byte_bpe_50k.json"))
    ids = {r[0]: np.frombuffer(encode([r[1]], 0)[0], "<u4") for r in odd_rows()}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[doc][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[doc])
    for pieces in by_bin.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_cut_lengths_fill_classes():
    for total in range(1, 3000):
        pieces = packing.cut_lengths(total)
        assert sum(pieces) == total and max(pieces) <= 1024 and len(pieces) <= total // 1024 + 6


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(30)] + [(500, [0.0] * 6), (600, None), (700, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (800, [float("nan")] * 6), (900, [1.0] * 5), (901, []), (902, [1e300] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df.where("vec_id < 902"), df.where("vec_id % 100 = 0"), block=64, query_block=2).collect()}
    good = [(i, np.floor(np.array(v) * 1024).astype(int)) for i, v in rows if v and len(v) == 6 and None not in v and np.isfinite(v).all() and i < 902]
    want = {}
    for q, x in good:
        if q % 100 == 0:
            best = sorted((-(int(x @ y)), i) for i, y in good if i != q)[:10]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    few = df.where("vec_id in (0, 1, 900)")
    assert topk.top_k(few, few.where("vec_id % 100 = 0")).count() == 1
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_threshold_stops_early():
    vals = np.zeros((1000, 4), np.int64)
    vals[:20] = 1000 + np.arange(20)[:, None]
    lists = np.argsort(-vals, axis=0, kind="stable")
    block = topk.SortedLists(np.arange(1000).astype("<i8").tobytes(), vals.astype("<i8").tobytes(), lists.astype("<u2").tobytes(), 1000, 4)
    ids, _, depth = block.best(-1, np.ones(4, np.int64), 10, None)
    assert ids.tolist() == list(range(19, 9, -1)) and depth < 100


def test_mixing(spark, odd, none):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 3 else f"s{i % 4}") for i in range(900)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    have = {r.source: r.t for r in docs.groupBy("source").agg(F.sum(mixing.n_tokens(F.col("text"))).alias("t")).collect()}
    for target in (mixing.Target(entropy=0.9, max_repeat=2.0), mixing.Target(budget=1500, entropy=1.0)):
        mixed = mixing.mix(docs, target, block_docs=16).cache()
        got = {r.source: r for r in mixed.groupBy("source").agg(F.sum("mix.tokens").alias("t"), F.first("mix.weight").alias("w"), F.countDistinct("doc_id").alias("n")).collect()}
        if target.max_repeat:
            assert all(got[s].t <= target.max_repeat * have[s] + 1e-6 for s in got)
        if target.budget:
            assert sum(r.t for r in got.values()) <= target.budget
        else:
            assert got["big"].t == have["big"] and got["big"].n == 600  # the largest source is passed once, whole
        assert mixed.groupBy("doc_id", "mix.pass").count().where("count > 1").count() == 0
        plan = mixed._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "MapInArrow" not in plan
    again = mixing.mix(docs.repartition(7), target, block_docs=16)
    assert mixed.exceptAll(again).count() == 0
    assert mixing.mix(odd, mixing.Target()).columns[: len(odd.columns)] == odd.columns
    assert mixing.mix(none, mixing.Target()).count() == 0


@pytest.mark.parametrize("sizes", [{"part_bytes": 2000, "most_local": 1}])
def test_repeated_phrases(odd, none, sizes):
    got = {r.doc_id: r for r in phrases.locate_phrases(odd, **sizes).collect()}
    for i, w, cut in windows_cut([(r[0], (r[1] or "").encode().split()) for r in odd_rows()], 13):
        kept = b" ".join(x for x, c in zip(w, cut) if not c)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(cut), hashlib.sha256(kept).hexdigest())
    assert phrases.locate_phrases(none).count() == 0


@pytest.mark.parametrize("sizes", [{"part_bytes": 2000}])
def test_suffix_dedup(odd, none, sizes):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd, **sizes).collect()}
    for i, w, cut in windows_cut([(r[0], (r[1] or "").encode()) for r in odd_rows()], 50):
        kept = bytes(x for x, c in zip(w, cut) if not c)
        spans = sum(c and (a == 0 or not cut[a - 1]) for a, c in enumerate(cut))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(w), sum(cut), spans, kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.remove_repeats(none).count() == 0
    clean = suffix_dedup.dedup_texts(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()


def test_repeated_ids_and_clashing_columns(spark):
    """Rows that repeat a doc_id come back once each, with their own texts; added names never clash."""
    passage = " ".join(f"word{i}" for i in range(40))
    rows = [(1, passage, "a", "x"), (2, "head " + passage, "b", "x"), (2, "head " + passage, "c", "x"), (2, passage + " tail é", "d", "x"), (2, None, "e", "x"), (None, passage, "f", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __own_text string, __own__gone string")
    got = {r["__own_text"]: r.text for r in suffix_dedup.dedup_texts(docs).collect()}
    assert got == {"a": passage, "b": "head ", "c": "head ", "d": " tail é", "e": None, "f": passage}
    assert suffix_dedup.dedup_texts(docs).columns == docs.columns
    near = spark.createDataFrame([(3, passage, "a"), (5, passage, "b"), (5, passage, "c"), (7, passage + " x", "d")], "doc_id long, text string, __own_gone string")
    assert {r["__own_gone"] for r in minhash.keep_first(near).collect()} == {"a"}


def test_null_ids_take_no_part(spark):
    text = "word " * 3 + " ".join(str(i) for i in range(40))
    docs = spark.createDataFrame([(None, text), (2, text), (2, text), (None, None)], "doc_id long, text string")
    assert {r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()} == {0}
    assert {r.n_removed for r in phrases.locate_phrases(docs).collect()} == {0}
    classes = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=repr)
    assert classes == [(2, 2), (2, 2), (None, None), (None, None)]


def test_near_duplicates(spark, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, true, n = [], {}, 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(80, 300))]
        for copy in range(rng.choice([1, 1, 3, 6])):
            text = list(base)
            if copy % 3:
                text[rng.randrange(len(text))] = word()
            rows.append((n, " ".join(text), "x", "y"))
            true[n] = min(true.get(n, n), n - copy)
            n += 1
    rows += [(n, None, "", ""), (n + 1, "", "", ""), (n + 2, "few words", "", ""), (n + 3, "few words", "", "")]
    true |= {n: n, n + 1: n, n + 2: n + 2, n + 3: n + 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, bands string").repartition(4)
    assert dict(minhash.near_duplicates(docs).collect()) == true
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(true.values())
    assert minhash.near_duplicates(none).count() == 0


def linked_classes(texts):
    """Classes of (id, text) by brute force: every pair's weighted Jaccard, weights as the operator counts them."""
    tok = [minhash._SPEC.tokens([t.encode()])[0] for _, t in texts]
    seen = sum(np.bincount(np.unique((w % np.uint64(minhash.BUCKETS)).astype(int)), minlength=minhash.BUCKETS) for w in tok)
    idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    vectors = [minhash.shingles(w, np.array([len(w)]), idf)[1:] for w in tok]
    label, likeness = {i: i for i, _ in texts}, {}
    for a, (i, _) in enumerate(texts):
        for b in range(a):
            j = texts[b][0]
            likeness[i, j] = minhash.weighted_jaccard(vectors[a], vectors[b])
            if likeness[i, j] >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label, likeness


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 16, "FIRST": 2}])
def test_links_of_linked_nodes(spark, monkeypatch, sizes):
    """Copies that are like their base and not like each other, the base in the middle or last; chains."""
    for name, value in sizes.items():
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(11)
    new = lambda: f"w{rng.randrange(10**9)}"

    def edited(words, places):
        return [new() if i in places else w for i, w in enumerate(words)]

    texts = []
    for start, at in ((0, 15), (1000, 30)):
        base = [new() for _ in range(1000)]
        for i in range(31):
            # each edit changes five shingles: 18 edits are a similarity of about 0.83 to the base, of 0.71 to each other
            texts.append((start + i, " ".join(base if i == at else edited(base, set(rng.sample(range(5, 990), 18))))))
    ids = rng.sample(range(2000, 2012), 12)
    words = [new() for _ in range(1000)]
    for i in ids:
        texts.append((i, " ".join(words)))
        words = edited(words, set(rng.sample(range(5, 990), 16)))
    true, likeness = linked_classes(texts)
    assert len(set(true.values())) == 3 and sum(x < 0.8 for x in likeness.values()) > len(likeness) // 2
    assert not any(0.795 < x < 0.805 for x in likeness.values())
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert dict(minhash.near_duplicates(docs).collect()) == true


def test_similarities_of_blocks(monkeypatch):
    """All pairs of two blocks at once, with words that repeat; the links connect what all pairs connect."""
    monkeypatch.setattr(minhash, "FEATURES", 50)
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") for _ in range(120)]
    tok = [minhash._SPEC.tokens([" ".join(rng.choice("klm") if rng.random() < i / 200 else w for w in base * (1 + i % 2)).encode()])[0] for i in range(30)]
    tok += [tok[0][:3], tok[0][:3], tok[0][:0], tok[0][:0]]
    idf = (np.arange(minhash.BUCKETS) % 7 + 1).astype(np.float32)
    texts = [minhash.counted(w, np.array([len(w)]), idf)[1:] for w in tok]
    assert max(t[1].max(initial=0) for t in texts) > 1
    true = np.array([[minhash.weighted_jaccard((a[0], a[1] * a[2]), (b[0], b[1] * b[2])) for b in texts] for a in texts])
    assert np.abs(minhash.similarities(texts[:20], texts[20:]) - true[:20, 20:]).max() < 1e-5
    assert np.abs(np.triu(minhash.similarities(texts, None) - true, 1)).max() < 1e-5
    label = np.arange(len(texts))

    def classes(pairs):
        out = label.copy()
        for a, b in pairs:
            out[out == out[b]] = out[a]
        return {tuple(np.flatnonzero(out == k)) for k in out}

    whole = minhash.links_between(texts, None, label, label, 0.6)
    assert classes(whole) == classes(np.argwhere(np.triu(true >= 0.6, 1)))
    assert all(true[a, b] >= 0.6 for a, b in whole) and len(whole) < len(texts)
    two = [(a, b + 20) for a, b in minhash.links_between(texts[:20], texts[20:], label[:20], label[20:], 0.6)]
    assert classes(two) == classes([(a, b) for a, b in np.argwhere(true >= 0.6) if a < 20 <= b])


def test_copies_that_are_not_linked_are_not_paired(spark, monkeypatch):
    """A group of edited copies below the threshold: what is moved grows with its members, not with its pairs."""
    rng, made = random.Random(2), {}
    base = [f"w{i}" for i in range(400)]
    edits = [set(rng.sample(range(5, 390), 5)) for _ in range(120)]
    texts = [(i, " ".join(f"x{rng.randrange(10**9)}" if k in own else w for k, w in enumerate(base))) for i, own in enumerate(edits)]
    true, likeness = linked_classes(texts)
    assert sum(x < 0.8 for x in likeness.values()) > 6_000
    settle = minhash.settle

    def count(df, *more):
        out = settle(df, *more)
        if {"lead", "node"} <= set(out.columns):
            made[len(made)] = out.count()
        return out

    monkeypatch.setattr(minhash, "settle", count)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert dict(minhash.near_duplicates(docs).collect()) == true
    assert max(made.values()) <= 12 * len(texts)


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(4)
    value = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.random(400) + 0.1, rng.random(400) + 0.1
    doc = np.repeat([0, 1], 400)
    estimates = []
    for shift in range(20):
        both = np.sort(minhash.mix(value, shift))
        _, drawn = minhash.sample(doc, np.r_[both, both], np.r_[a, b])
        estimates.append((drawn[0] == drawn[1]).mean())
    assert abs(np.mean(estimates) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 9), (8, 9), (20, 21), *[(100 + i, 101 + i) for i in range(30)]]
    got = dict(minhash.components(spark.createDataFrame(links, "lead long, node long")).collect())
    assert {got[i] for i in (1, 2, 3, 8, 9)} == {1} and got[21] == 20 and {got[100 + i] for i in range(31)} == {100}


def test_merged_components(spark):
    frame = lambda links: spark.createDataFrame(links, "lead long, node long")
    got = dict(minhash.merge(minhash.components(frame([(5, 6), (7, 8), (1, 2)])), frame([(6, 8), (3, 7), (2, 9), (10, 11)])).collect())
    assert got == {3: 3, 5: 3, 6: 3, 7: 3, 8: 3, 1: 1, 2: 1, 9: 1, 10: 10, 11: 10}


def test_token_files(spark, odd, none, tmp_path):
    rows = sorted(odd_rows(), key=lambda r: r[0])
    encode, at = Encoder(public_path("word_bpe_49k.json")), 0
    want = []
    for r in rows:
        ids = encode([r[1]], 1)[0]
        want.append((r[0], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, token_files.token_file_digest(odd).collect())) == want
    assert token_files.token_file_digest(none).count() == 0
    manifest, dictionary = token_files.write_token_files(odd, str(tmp_path / "ids"))
    name = manifest.orderBy("shard").first().name
    one = token_files.Frames(str(tmp_path / "ids"), name, dictionary)
    assert zlib.crc32(one.ids(1).tobytes()) == want[1][3]
    with pytest.raises(ValueError):
        token_files.Frames(str(tmp_path / "ids"), name, b"another dictionary")


def test_factor_machine(spark, odd, none):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = factor_machine.classify(docs, labels, ("n_chars",)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97
    assert factor_machine.classify(odd, labels.limit(0)).where("score is null or score < 0 or score > 1").count() == 0
    assert factor_machine.classify(none, labels).count() == 0


def test_pairs_in_linear_time():
    rng = np.random.default_rng(1)
    m = factor_machine.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 3)), np.zeros(0), np.ones(0))
    at, x = np.array([1, 4, 7]), np.array([0.5, -1.0, 2.0])
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(m.margin(at, x) - (0.3 + m.weights[at] @ x + pairs)) < 1e-9


def test_transcripts(spark):
    turns = table(spark, SF, "conversations")
    rows = transcripts.format_chats(turns).join(turns.withColumnRenamed("role", "truth"), ["conv_id", "turn"]).where("held_out").collect()
    assert np.mean([r.role == r.truth for r in rows]) > 0.95
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>" for r in rows)
    long = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"{'Q' if i % 2 == 0 else 'A'}: t{i}" if i % 5 else None) for i in range(700)] + [(None, None, "user", "x")], "conv_id long, turn long, role string, text string")
    model = transcripts.fit(long)
    whole = {r.turn: r.role for r in transcripts.parse(long, model, block=10_000).collect()}
    assert {r.turn: r.role for r in transcripts.parse(long, model, block=16).collect()} == whole and len(whole) == 701
    assert transcripts.parse(long.limit(0), model).count() == 0
