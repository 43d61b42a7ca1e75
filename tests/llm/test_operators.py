"""The corpus operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra
columns with clashing names, and brute force."""

import gzip
import hashlib
import io
import itertools
import math
import random
import re
import resource
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import fertility, jaccard, jpeg, language, mixing, pieces, pii, resampling, token_counts, warc
from larkspur.llm._text import SEPARATORS, mix, raw_bytes, shingle_sets, slices, word_hashes

SEP = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(120, 1)
    near = base.replace("w", "w", 1).split()
    near[50] = "changed"
    rows = [
        (0, base, "en", "a"), (1, base.upper(), "en", "a"), (2, " ".join(near), "en", "b"), (3, words(80, 2), "de", None), (4, None, None, None), (5, "", "en", "a"), (6, " \t\n", "en", "b"),
        (7, "one two", "en", "b"), (8, "ONE\x0btwo", "en", "c"), (9, words(30000, 3, 50000), "en", "c"), (10, words(60, 4), "en", "a"), (10, words(60, 4), "en", "a"), (None, words(60, 5), "en", "a"),
        (11, "a b é漢字 \U0001f600 ▁ <|endoftext|> x", "fr", "ü"), (12, "\n".join(["same line here"] * 40), "en", "a"), (13, base + " tail words", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], SCHEMA)


def clashing(df):
    """df with columns that operators use as names of their own."""
    names = ("node", "n", "root", "token", "fertility", "verdict", "kept", "copies", "place", "bin", "size", "own_row", "taken", "_kept_id", "spans")
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def test_words_match_the_pattern(docs):
    for (text,) in docs.select("text").collect():
        data, offsets = raw_bytes(pa.array([text]))
        assert len(word_hashes(data, offsets, True)[0]) == len(re.findall(SEP, text or ""))


def test_slices_cover_everything():
    a = pa.array(["x" * n for n in (5, 0, 900, 3, 3)] + [None])
    assert [len(p) for p in slices(a, 6)] == [2, 1, 3]
    assert sum((p.to_pylist() for p in slices(a, 6)), []) == a.to_pylist()


# -- 4
def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(SEP, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, len(sets[i]), best.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def found_components(df):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_jaccard_against_brute_force(spark, docs):
    assert found_components(clashing(docs)) == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_jaccard_on_chains_and_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "APART", 4)
    r, rows = random.Random(5), []
    for g in range(6):
        base = words(40 + 30 * g, g, 5000).split()
        for k in range(14):
            t = list(base)
            for _ in range(r.randrange(0, 5)):
                t[r.randrange(len(t))] = f"m{r.random()}"
            rows.append((len(rows), " ".join(t)))
    step = words(60, 99, 9000).split()
    for k in range(12):
        rows.append((len(rows), " ".join(step[k * 3 :] + [f"z{k}{i}" for i in range(k * 3)])))
    r.shuffle(rows)
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_jaccard_of_an_inner_size(spark):
    # a (50 shingles) and b (55) share 45: 0.75 exactly, and 5 of those are in front. b's component has sizes 46 to 56,
    # for whose ends a would need 6. The other 40 are in more than LIGHT documents, so they come last.
    def texts(salt):
        t, x = [f"t{salt}x{i}" for i in range(49)], [f"b{salt}x{i}" for i in range(10)]
        a, b = [*t, *(f"a{i}" for i in range(5))], [*x, *t]
        return [" ".join(w) for w in (a, b, ["c", *b], [*x[4:], *t[:42], "d0", "d1"])], " ".join(t[5:])

    def leaders(four):
        nodes = np.array([jaccard.set_keys(s)[0] for s in shingle_sets(pa.array(four), jaccard.WORDS)]).view(np.uint64)
        return [int(mix(nodes ^ np.uint64(k + 1)).argmin()) for k in range(jaccard.LEADERS)]

    # c or d lead the lists that a and b are in, so the first step does not compare a with b.
    four, common = next(x for x in map(texts, range(1000)) if min(leaders(x[0])) > 1)
    rows = list(enumerate([*four, *(f"{words(200, k, 10**9)} {common}" for k in range(jaccard.LIGHT + 2))]))
    want = brute_components(rows)
    assert [(n, c) for _, n, c in sorted(want)[:4]] == [(50, 0), (55, 0), (56, 0), (46, 0)]
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_least_in_range_is_the_least(spark):
    def least(n, m):
        return max(-(-(n + m) * 75 // 175) - (-(-max(n, m) * 75 // 100) - jaccard.SUBSET), jaccard.SUBSET)

    rows = []
    for n in (3, 4, 10, 50, 51, 77, 150):
        sizes = range(-(-n * 75 // 100), n * 100 // 75 + 1)
        rows += [(n, low, high, min(least(n, m) for m in range(low, high + 1))) for low in sizes for high in sizes if low <= high]
    df = spark.createDataFrame(rows, "n long, low long, high long, want long")
    assert df.where(jaccard.least_in_range(F.col("n"), F.col("low"), F.col("high")) != F.col("want")).count() == 0


def test_jaccard_of_nothing(spark, docs):
    assert found_components(docs.where("false")) == []
    assert jaccard.keep_one(docs).columns == docs.columns
    assert sorted((r.doc_id for r in jaccard.keep_one(docs).collect()), key=repr) == [0, 10, 11, 12, 3, 4, 5, 6, 7, 9, None]


def test_jaccard_of_clashing_digests(spark, docs, monkeypatch):
    whole = jaccard.set_keys
    monkeypatch.setattr(jaccard, "set_keys", lambda s: (whole(s)[0] % 5, whole(s)[1]))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found_components(docs) == brute_components(rows)


def test_links_grow_with_the_nodes(spark, monkeypatch):
    # A group of near copies of each size leaves little more than a link for each of its nodes.
    r, base, seen = random.Random(8), words(150, 8, 10**6).split(), []
    thinned = jaccard.thinned
    monkeypatch.setattr(jaccard, "thinned", lambda links: seen.append(thinned(links)) or seen[-1])
    monkeypatch.setattr(jaccard, "drop", lambda df: None)
    for n in (40, 300):
        rows = [(i, " ".join(f"m{r.random()}" if k in cut else w for k, w in enumerate(base))) for i in range(n) for cut in [set(r.sample(range(150), r.randint(1, 3)))]]
        assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)
        assert seen[-1].count() <= 1.5 * n


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b = words(70, 1), words(70, 2)
    rows = [(1, a, "x"), (1, a, "x"), (None, a, "y"), (1, b, "z"), (2, b, "w"), (None, None, "n"), (None, None, "n"), (3, "", "e"), (3, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((tuple(x) for x in jaccard.keep_one(df).collect()), key=repr)
    assert got == sorted([(1, a, "x"), (1, b, "z"), (None, None, "n"), (None, None, "n"), (3, "", "e"), (3, "", "e")], key=repr)


def test_boundary_is_the_cheapest(spark):
    rows = [(i, p, s) for i, (p, s) in enumerate([(2, 4), (2, 4), (3, 90), (9, 27), (40, 4000)])]
    cost = lambda x: sum(p * (p - 1) / 2 if p <= x else p + jaccard.SCAN * s for _, p, s in rows)
    x = jaccard.boundary(spark.createDataFrame(rows, "node long, pi long, scan long"))
    assert cost(x) == min(cost(k) for k in (1, 2, 3, 9, 40))


# -- 2
def test_metrics_and_verdicts_against_brute_force(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path(fertility.VOCABULARY))
    r, rows = random.Random(21), []
    for i in range(160):
        t = words(r.randint(55, 120), i, 4000) + "".join(r.choice("é漢ཀ#<|x ") for _ in range(r.choice([0, 0, 3, 200])))
        rows.append((i, t, r.choice(["en", "en", "de", None])))
    rows += [(900, "short #text", "en"), (901, None, "en"), (902, "", None), (5, rows[5][1], rows[5][2])]
    measured = {}
    for n, (_, t, lang) in enumerate(rows):
        ids = sp.encode(t or "")
        share = [ids.count(x) / len(ids) for x in set(ids)]
        entropy = -sum(p * math.log2(p) for p in share) / math.log2(len(ids)) if len(ids) > 1 else 1.0
        w = re.findall(SEP, t or "")
        three = list(zip(w, w[1:], w[2:], strict=False))
        twice = {i + k for i, x in enumerate(three) if three.count(x) > 1 for k in range(3)}
        m = {"chars_per_token": len(t) / len(ids) if ids else 0.0, "fallback_share": sum(sp.is_byte(x) for x in ids) / len(ids) if ids else 0.0, "token_entropy": entropy}
        measured[n] = (m, len(ids), len(w) < 50 or 2 * len(twice) > len(w), lang or "script:" + fertility.script_of(t or ""), fertility.script_of(t or ""), sum((t or "").count(c) for c in "#*$%&|<>"))

    def band(members, m):
        values = sorted(round(measured[n][0][m] + 1e-12, fertility.DIGITS) for n in members)
        low, mid, high = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.5, 0.75))
        return mid, max(fertility.FLOOR[m], fertility.WIDTH[m] * (high - low) / 1.349)

    good = [n for n in measured if not measured[n][2]]
    want = []
    for n, (m, tokens, failed, group, script, symbols) in measured.items():
        own = [x for x in good if measured[x][3] == group]
        members = own if len(own) >= fertility.JUDGES else [x for x in good if measured[x][4] == script]
        verdict = "ok"
        for k in reversed(fertility.METRICS):
            if not members:
                continue
            mid, half = band(members, k)
            half = half * math.sqrt(max(fertility.LEAST / len(own), 1) if own else fertility.LEAST) + fertility.NOISE[k] / math.sqrt(max(tokens, 1))
            if m[k] > mid + half or (m[k] < mid - half and k != "fallback_share"):
                verdict = k
        want.append((rows[n][0], tokens, symbols, failed, verdict, not failed and verdict == "ok", *(round(m[k], 6) for k in fertility.METRICS)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(x.doc_id, x.n_tokens, x.n_symbols, x.base_failed, x.verdict, x.kept, *(round(x[k], 6) for k in fertility.METRICS)) for x in fertility.with_verdict(df).select("doc_id", "fertility.*").collect()]
    assert sorted(got) == sorted(want)
    again = fertility.with_verdict(df.withColumn("fertility", F.lit("x")).repartition(7)).select("doc_id", "fertility.kept").collect()
    assert sorted((x.doc_id, x.kept) for x in again) == sorted((x[0], x[5]) for x in want)


def test_base_counts(docs):
    got = fertility.with_verdict(docs).select("text", "fertility.*").collect()
    assert len(got) == docs.count()
    for r in got:
        w = re.findall(SEP, r.text or "")
        three = list(zip(w, w[1:], w[2:], strict=False))
        twice = {i + k for i, x in enumerate(three) if len(w) < 500 and three.count(x) > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if re.search(SEP, x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert len(w) >= 500 or r.n_repeat_words == len(twice)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_keep_good_keeps_columns(docs):
    odd = clashing(docs)
    assert fertility.keep_good(odd).columns == odd.columns
    assert fertility.keep_good(docs.where("false")).count() == 0


def test_odd_fertility_is_rejected(spark):
    good = [(i, words(100, i, 4000), "en") for i in range(80)]
    rows = spark.createDataFrame([*good, (999, " ".join("ཀག" * 3 for _ in range(60)), "en")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in fertility.with_verdict(rows).where("not fertility.kept").collect()] == [999]


def test_small_groups_are_not_judged_by_other_scripts(spark):
    def odd(seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice("ཀཁགངཅཆཇཉཏཐདན") for _ in range(r.randint(2, 6))) for _ in range(80))

    rows = [(i, words(100, i, 4000), "en") for i in range(200)]
    rows += [(1000 + i, odd(i), "bo") for i in range(49)] + [(2000 + i, odd(100 + i), f"one{i}") for i in range(2)] + [(3000 + i, odd(200 + i), None) for i in range(5)]
    # Junk goes in a small group, and in one of a single document too.
    rows += [(4000 + i, words(100, 300 + i, 4000), "xx") for i in range(20)] + [(4999, " ".join("ཀག" * 3 for _ in range(60)), "xx")]
    junk = " ".join(f"w{i}" + "\u02f0\u02f1" * 5 for i in range(60))
    rows += [(5000, junk, "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in fertility.with_verdict(df).where("not fertility.kept").collect()) == [4999, 5000]


# -- 3
def test_token_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary_path("byte_bpe_50k.json"))
    for r in token_counts.with_token_counts(docs).select("text", "n_tokens").collect():
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False))
    long = words(3000, 8) + "  \n  " + "x" * 500
    assert sum(len(t.encode(p)) for p in token_counts.safe_pieces(long, 700)) == len(t.encode(long))
    assert "".join(token_counts.safe_pieces(long, 700)) == long
    assert token_counts.spaces_begin_tokens(t) and not token_counts.spaces_begin_tokens(Tokenizer.from_file(token_counts.vocabulary_path("word_bpe_49k.json")))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_long_texts_have_the_tokens_of_the_whole(name):
    # Far above the length at which texts are cut, with marks, runs of spaces and special strings in them.
    r = random.Random(name)
    text = " ".join(r.choice(["word", "Ünder", "  ", "▁", "▁ ▁", "x▁", "漢字", "<|endoftext|>", "</s>", "1234", "\n"]) for _ in range(60_000))
    assert len(text) > 2 * token_counts.PIECE_CHARS
    path = token_counts.vocabulary_path(name)
    if name.endswith(".model"):
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
        row = fertility.measure(pa.array([text]), name)[0]
        assert row["n_tokens"] == len(want) and row["chars_per_token"] == len(text) / len(want)
    else:
        from tokenizers import Tokenizer

        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert token_counts.count_tokens(pa.array([text, None, "", text[:9]]), name)[:3] == [len(want), 0, 0]


def test_counts_replace_a_column_of_their_name(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "y")], "doc_id long, text string, n_tokens string")
    assert sorted((x.n_tokens for x in token_counts.with_token_counts(df).collect())) == [0, 2]
    assert token_counts.with_token_counts(df.where("false")).count() == 0


# -- 5
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    r = random.Random(7)
    texts = ["a@b.c@d.e f@@g.h x@y.z.", "é 1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111 1111 1111 +49 (30) 123-4567", "@", "a@b", "a@b.c-.d"]
    texts += ["".join(r.choice("ab.@-+ 019é") for _ in range(60)) for _ in range(1500)]
    for t in texts:
        assert [s[:3] for s in pii.find_spans(t) if s.kind in pii.BASE_KINDS] == brute_spans(t), t


def test_spans_of_long_texts_take_linear_time():
    for text in ("1" * 10**6, "1.1" * 300_000, "+1(" * 300_000, "a@" * 300_000, "+" * 10**6, "AB12" * 250_000, "DE89 3704 0044 " * 60_000, "token " * 150_000):
        begin = time.process_time()
        pii.find_spans(text)
        assert time.process_time() - begin < 8, text[:8]


def test_spans_as_columns(spark):
    rows = [(1, "call +49 30 1234567 now, 10.0.0.1", "x"), (1, "call +49 30 1234567 now, 10.0.0.1", "x"), (None, "", "y"), (2, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    got = sorted(((x.doc_id, [(s.kind, s.start, s.end) for s in x.pii_spans]) for x in pii.with_spans(df).collect()), key=repr)
    assert got == [(1, [("ip", 25, 33), ("phone", 5, 19)])] * 2 + [(2, []), (None, [])]
    assert pii.with_spans(df.where("false")).count() == 0 and pii.redact(df.where("false")).count() == 0
    assert sorted((x.text for x in pii.redact(df).collect()), key=repr)[:3] == ["", "call [PHONE] now, [IP]", "call [PHONE] now, [IP]"]
    # Context on both sides, words that speak against it before.
    assert [s.kind for s in pii.find_spans("123-45-6789 is my ssn")] == ["ssn"] and pii.find_spans("order 123-45-6789 shipped") == []


def test_added_spans_and_redaction(docs):
    t = "pay to IBAN GB82 WEST 1234 5698 7654 32 or token = 'abcdefgh12345678' my ssn 123-45-6789; and then, a long way behind all of that, code 123-45-6789"
    assert [s.kind for s in pii.find_spans(t)] == ["iban", "ssn", "secret"]
    assert pii.redact_text("mail me@x.org, 10.0.0.1") == "mail [EMAIL], [IP]"
    assert pii.redact_text(None) is None and pii.redact_text("") == ""
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83 WEST 1234 5698 7654 32")
    assert pii.redact(clashing(docs)).columns == clashing(docs).columns


def test_iban_before_other_tokens():
    def found(t):
        return [t[s.start : s.end] for s in pii.find_spans(t) if s.kind == "iban"]

    de, spaced, no, be = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "BE68539007547034"
    assert found(f"IBAN {de} BIC COBADEFFXXX") == [de]
    assert found(f"{spaced} IN 2024") == [spaced]
    assert found(f"{no} {be}") == [no, be]
    assert found(f"AB12 CDEF GH {spaced} X") == [spaced]
    assert found(f"{de[:-1]}1 BIC COBADEFFXXX") == []
    assert pii.redact_text(f"IBAN {de} BIC COBADEFFXXX") == "IBAN [IBAN] BIC COBADEFFXXX"


# -- 1
def brute_language(texts, trained):
    """Languages by plain loops: trigrams of each word, EM over words, nested sets while the penalised likelihood gains."""
    fold = lambda t: [32 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in t.encode()]

    def split(t):
        b, out = fold(t), []
        for i, c in enumerate(b):
            if c == 32:
                continue
            before, after = b[i - 1] if i else 32, b[i + 1] if i + 1 < len(b) else 32
            code = (before << 16 | c << 8 | after) * 0x9E3779B1 % 2**32 >> 16
            if before == 32:
                out.append([])
            out[-1].append(code)
        return out

    counts = {}
    for text, lang in trained:
        mine = counts.setdefault(lang, {})
        for w in split(text):
            for g in w:
                mine[g] = mine.get(g, 0) + 1
    names, found = sorted(counts), []
    total = {k: sum(counts[k].values()) + language.SMOOTHING * language.BUCKETS for k in names}
    log = lambda k, g: math.log((counts[k].get(g, 0) + language.SMOOTHING) / total[k])

    def expect(like, allowed):
        share = [a / sum(allowed) for a in allowed]
        for _ in range(language.ROUNDS):
            parts = [[x * s for x, s in zip(w, share, strict=True)] for w in like]
            share = [sum(p[k] / sum(p) for p in parts) / len(like) for k in range(len(names))]
        return share, sum(math.log(sum(x * s for x, s in zip(w, share, strict=True))) for w in like)

    for text in texts:
        raw = [[sum(log(k, g) for g in w) for k in names] for w in split(text)]
        like = [[math.exp(max(x - max(w), -200)) for x in w] for w in raw]
        share, _ = expect(like, [1] * len(names))
        order = sorted(range(len(names)), key=lambda k: -share[k])
        single = [sum(math.log(w[k]) for w in like) for k in range(len(names))]
        best = max(range(len(names)), key=lambda k: single[k])
        if single[best] > single[order[0]]:
            order = [best, *[k for k in order if k != best]]
        value, chosen = single[order[0]], [float(k == order[0]) for k in range(len(names))]
        for size in range(2, len(names) + 1):
            s, fit = expect(like, [float(k in order[:size]) for k in range(len(names))])
            fit -= (size - 1) * 0.5 * language.PENALTY * math.log(max(len(like), 2))
            if fit <= value:
                break
            value, chosen = fit, s
        found.append((names[chosen.index(max(chosen))], max(chosen)))
    return found


def test_language_against_brute_force(spark):
    r, syllables = random.Random(13), {"aa": "to re n ti", "bb": "to ke ve ra", "cc": "ci re ve mo", "dd": "mo ke n zu"}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))
    trained = [(text(k, 60), k) for k in syllables for _ in range(8)]
    texts = [text(a, r.randint(1, 40)) + " " + text(b, r.randint(1, 40)) for a in syllables for b in syllables]
    names, model = language.learn(spark.createDataFrame(trained, "text string, lang string"))
    df = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {x.doc_id: x for x in language.predict(df, names, model).collect()}
    for i, (lang, score) in enumerate(brute_language(texts, trained)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4), texts[i]


def test_language_bounds(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abc def", "aa"), (1, "abc def", "aa"), (2, "abc def", "bb"), (3, "x y " * 200_000, "cc")], "doc_id long, text string, lang string")
    names, model = language.learn(df)
    got = sorted((x.doc_id, x.lang_pred) for x in language.predict(df, names, model).collect())
    assert got == [(1, "aa"), (1, "aa"), (2, "aa"), (3, "cc")]  # a tie goes to the first name
    assert language.predict(df.where("false"), names, model).count() == 0
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.learn(df)


def test_language(spark):
    r, syllables = random.Random(3), {"aa": ["tor", "ent", "ing"], "bb": ["schu", "keit", "ver"], "cc": ["ción", "que", "ado"]}

    def text(lang, n):
        return " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))

    train = spark.createDataFrame([(i, text(k, 80), k) for i, k in enumerate("aa bb cc".split() * 20)], "doc_id long, text string, lang string")
    names, model = language.learn(train)
    assert names == ["aa", "bb", "cc"]
    test = [(1, text("aa", 60)), (2, text("bb", 60)), (3, text("aa", 70) + " " + text("cc", 30)), (4, None), (5, ""), (6, "123 456"), (7, text("cc", 5)), (8, "\u00b2 \u00bd ___"), (9, "\u5b57")]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(test, "doc_id long, text string"), names, model).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["aa", "bb", "aa", "und", "und", "und", "cc"]
    assert got[8].lang_pred == "und" != got[9].lang_pred
    assert got[1].mixture == "aa:1.000" and 0.6 < got[3].score < 0.8 and got[3].mixture.startswith("aa:0.7") and got[4].score == 0
    assert language.learn(train.where("false"))[0] == []
    assert language.predict(train, *language.learn(train.where("false"))).where("lang_pred != 'und'").count() == 0


# -- 6
def test_resampling(spark):
    good = [(i, words(60, i, 50)) for i in range(60)]
    bad = [(100 + i, " ".join(f"junk{random.Random(i).randrange(40)}" for _ in range(60))) for i in range(20)]
    rows = spark.createDataFrame([*good, *bad, (900, None), (901, " ")], "doc_id long, text string")
    out = {r.doc_id: r for r in resampling.resample(rows, spark.createDataFrame([(i,) for i in range(60)], "doc_id long")).collect()}
    assert len(out) == 82 and all(out[i].kept for i, _ in good) and not any(out[i].kept for i, _ in bad)
    assert out[900].gumbel_key is None and not out[900].kept and not out[901].kept
    nothing = resampling.resample(rows, spark.createDataFrame([], "doc_id long"))
    assert nothing.where("kept").count() == 80
    assert resampling.resample(rows.where("false"), nothing.select("doc_id")).count() == 0


def test_ratios_against_brute_force(spark, docs):
    def grams(text):
        w = re.findall(SEP, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        data, offsets = raw_bytes(pa.array([text]))
        found = resampling.ngrams(pa.array([text]))[0].tolist()
        assert len(found) == max(0, 2 * len(w) - 1)
        return found

    rows = [tuple(r) for r in clashing(docs).select("doc_id", "text").collect()]
    good = {0, 1, 2, 3}
    raw, target = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    log = lambda c: np.log((c + resampling.SMOOTHING) / (c.sum() + resampling.SMOOTHING * resampling.BUCKETS))
    model = log(target) - log(raw)
    want = sorted((i, len(grams(t)), round(float(model[grams(t)].sum() / (len(grams(t)) + resampling.SHRINK)), 5) if grams(t) else None) for i, t in rows if i is not None)
    out = resampling.resample(clashing(docs), spark.createDataFrame([(i,) for i in good], "doc_id long"), k=5).collect()
    assert sorted((r.doc_id, r.n_grams, None if r.log_ratio is None else round(r.log_ratio, 5)) for r in out if r.doc_id is not None) == want
    # The five largest sums of log weight and noise, rows of one id and text together.
    keyed = sorted(((r.gumbel_key, -(r.doc_id if r.doc_id is not None else 10**9)) for r in out if r.gumbel_key is not None), reverse=True)
    assert all(r.kept == (r.gumbel_key is not None and (r.gumbel_key, -(r.doc_id if r.doc_id is not None else 10**9)) >= keyed[4]) for r in out)
    for r in out:
        if r.log_ratio is not None:
            name = "null" if r.doc_id is None else str(r.doc_id)
            assert r.gumbel_key > resampling.TEMPER * r.log_ratio - 5, name


def test_inclusion_follows_the_weights(spark):
    # 40 texts of weight 1 and 40 of weight e, ten taken: over many seeds the heavier are taken as sampling without
    # replacement takes them, and the noise decides which.
    from larkspur.llm._text import uniform

    scored = spark.createDataFrame([(i, float(i >= 40)) for i in range(80)], "doc_id long, log_weight double")
    seeds = spark.range(400).select(F.col("id").alias("seed"))
    keyed = scored.join(seeds).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform(F.concat_ws(":", "doc_id", "seed"), "t")))).collect()
    heavy = []
    for s in range(400):
        top = sorted((r for r in keyed if r.seed == s), key=lambda r: -r.key)[:10]
        heavy.append(sum(r.doc_id >= 40 for r in top))
    r, want = np.random.default_rng(3), []
    for _ in range(4000):
        p = np.where(np.arange(80) >= 40, math.e, 1.0)
        want.append((r.choice(80, 10, replace=False, p=p / p.sum()) >= 40).sum())
    assert abs(np.mean(heavy) - np.mean(want)) < 0.3 and len(set(heavy)) > 3


@pytest.mark.parametrize("most", [100_000, 3])
def test_k_is_counted_from_the_exact_quantile(spark, monkeypatch, most):
    monkeypatch.setattr(resampling, "SORT_MOST", most)
    monkeypatch.setattr(resampling, "BINS", 7)
    monkeypatch.setattr(resampling, "TAIL", 0.2)
    r = random.Random(7)
    ratios = [(i, r.choice([None, 0.5, 0.25, r.uniform(-2, 1)])) for i in range(200)]
    goal = spark.createDataFrame([(i,) for i in range(0, 200, 3)] + [(0,), (None,)], "doc_id long")
    own = sorted(v for i, v in ratios if i % 3 == 0 and v is not None)
    floor = own[math.ceil(0.2 * len(own)) - 1] - resampling.MARGIN
    for parts in (1, 9):
        scored = spark.createDataFrame(ratios, "doc_id long, log_ratio double").repartition(parts)
        assert resampling.texts_like_targets(scored, goal) == sum(v is not None and v >= floor for _, v in ratios)
    assert resampling.texts_like_targets(scored, goal.where("false")) == sum(v is not None for _, v in ratios)


def test_k_and_seed_are_parameters(spark):
    rows = spark.createDataFrame([(i, words(60, i, 50)) for i in range(100)], "doc_id long, text string")
    goal = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    one, two = ({r.doc_id for r in resampling.resample(rows, goal, seed=s, k=k).where("kept").collect()} for s, k in (("a", 0.3), ("b", 30)))
    assert len(one) == len(two) == 30 and one != two


@pytest.mark.parametrize("most", [100_000, 20, 3])
def test_keep_largest_is_exact(spark, monkeypatch, most):
    monkeypatch.setattr(resampling, "SORT_MOST", most)
    monkeypatch.setattr(resampling, "BINS", 7)
    r = random.Random(2)
    rows = [(i if r.random() < 0.9 else None, r.choice([1.0, 2.0, 2.5, 1e9, r.random() * 3, None])) for i in range(300)] + [(5, 2.0)] * 20
    df = spark.createDataFrame(rows, "doc_id long, key double")
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    ranked = sorted((x for x in rows if x[1] is not None), key=order)
    for k in (0, 1, 60, 100, 137, len(ranked), 999):
        got = resampling.keep_largest(df, "key", k, "doc_id")
        want = [x for x in ranked if k and order(x) <= order(ranked[min(k, len(ranked)) - 1])]
        assert sorted(((x.doc_id, x.key) for x in got.where("kept").collect()), key=repr) == sorted(want, key=repr) and got.count() == 320


# -- 7
def all_paths(model, text):
    seg = b"".join(bytes([pieces.MARK]) if c == 32 else bytes([c]) for c in b" " + text.encode())
    first, start, piece = model.edges(seg)

    def upto(j):
        if not j:
            return [0.0]
        return [s + model.worth[piece[e]] for e in range(first[j], first[j + 1]) for s in upto(start[e])]

    return sorted(upto(len(seg)), reverse=True)


def test_n_best_against_every_path():
    model, r = pieces.lattice(), random.Random(4)
    for _ in range(150):
        text = "".join(r.choice("abthe \n\té漢▁") for _ in range(r.randint(1, 9)))
        got, want = model.encode(pa.array([text]), 5)[0], all_paths(model, text)
        assert [s for s, _ in got] == pytest.approx(want[:5]) and len({tuple(x.tolist()) for _, x in got}) == len(got)
        assert all(model.decode(x) == text for _, x in got)


def test_long_texts_without_a_space():
    model, r = pieces.Lattice(), random.Random(6)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for letters in ("abcdefghijklmnop0123456789+/", "漢字的一是不了人我ab"):
        text = "".join(r.choice(letters) for _ in range(100_000))
        found = model.encode(pa.array([text]), 4)[0]
        assert len(found) == 4 and all(model.decode(x) == text for _, x in found)
        assert sorted((s for s, _ in found), reverse=True) == [s for s, _ in found]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_pieces_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, "", 0)], "doc_id long, text string, n_pieces int")
    assert sorted((x.doc_id, x.n_pieces) for x in pieces.digests(df).collect()) == [(1, 2), (1, 2), (2, 0)]
    assert pieces.digests(df.where("false")).count() == 0 and pieces.encode_decode(df.where("false")).count() == 0


def test_pieces_of_long_segments_and_columns(spark, docs):
    model = pieces.lattice()
    long = "".join(random.Random(1).choice("abcdefgh漢") for _ in range(300))
    best = model.encode(pa.array([long]), 2)[0]
    assert best[0][0] == pytest.approx(model.search(b"\xff" + long.encode(), 1)[0][0]) and best[0][0] >= best[1][0]
    out = {(r.doc_id, r.round_trip, r.n_pieces is None) for r in pieces.digests(clashing(docs)).collect()}
    assert (4, None, True) in out and (5, True, False) in out and all(r is not False for _, r, _ in out)
    back = pieces.decode_pieces(pieces.encode_nbest(docs, n=1), out_col="back").join(docs.where("doc_id is not null and doc_id != 10"), "doc_id")
    assert back.where("back != text").count() == 0 and back.count() == 12


# -- 8
def test_warc(spark, tmp_path):
    big = "x" * 1200
    rows = [(1, "http://a/ b", big), (2, "u", big), (3, "u", "small"), (4, "u", "small"), (5, None, None), (2, "u", big), (None, "u", big), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(warc.plan_records(clashing(pages)), f"file://{tmp_path}/w", 4000)
    got = sorted((tuple(r) for r in warc.read(manifest, f"file://{tmp_path}/w").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    want = [(i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), "revisit" if t == big and i != 2 else "response", 2 if t == big and i != 2 else None) for i, _, t in rows]
    assert got == sorted(want, key=repr) and manifest.count() >= 1
    assert warc.read(warc.write(warc.plan_records(pages.where("false")), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0


def test_warc_names(spark, tmp_path):
    assert warc.arrow_uri("s3a://bucket/x") == "s3://bucket/x" and warc.arrow_uri("hdfs://h/x") == "hdfs://h/x" and warc.arrow_uri("/x") == "/x"
    rows = [(None, "u", "a"), (None, "v", "a"), (1, "u", "b" * 2000), (2, "u", "b" * 2000), (None, "u", "b" * 2000)]
    folder = f"file://{tmp_path}/n"
    manifest = warc.write(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string")), folder)
    names = []
    for m in manifest.collect():
        with open(f"{tmp_path}/n/{m.path}", "rb") as f:
            names += [(r.headers["WARC-Record-ID"], r.headers.get("WARC-Refers-To")) for r in warc.read_records(f)]
    assert len({n for n, _ in names}) == 5 and {x for _, x in names if x} <= {n for n, _ in names}


def test_warc_members_and_damage():
    payload = b"<html>" + b"q" * 5000
    one = warc.make_record(7, "u", payload, hashlib.sha1(payload).hexdigest(), len(payload), "response", None)
    assert [r.payload for r in warc.read_records(io.BytesIO(one * 3))] == [payload] * 3
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    with pytest.raises(warc.BadArchive):
        list(warc.read_records(io.BytesIO(one[:-9])))
    bad = gzip.compress(gzip.decompress(one).replace(b"qqq", b"qqr", 1))
    with pytest.raises(warc.BadArchive):
        list(warc.read_records(io.BytesIO(bad)))


# -- 9
def test_mix(spark, docs):
    r = random.Random(9)
    rows = [(i, words(r.randint(0, 90), i), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = [tuple(x) for x in mixing.mix_counts(df).orderBy("doc_id").collect()]
    assert first == [tuple(x) for x in mixing.mix_counts(df.repartition(7)).orderBy("doc_id").collect()]
    sizes, weight, taken = {}, {}, {}
    for _, s, size, _, _, copies in first:
        sizes[s] = sizes.get(s, 0) + size
        taken[s] = taken.get(s, 0) + size * copies
        assert 0 <= copies <= 3
    for k, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or ""))):
        weight[s] = (5, 2, 1)[k % 3]
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    targets = {**share, **fixed}
    for _, s, _, source_size, target, _ in first:
        assert source_size == sizes[s] and target == pytest.approx(targets[s])
    assert all(abs(taken[s] - targets[s]) <= 90 for s in sizes)
    # Without ids, texts draw for themselves: no source is far from its target.
    none = mixing.mix_counts(df.withColumn("doc_id", F.lit(None).cast("long"))).groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()
    assert all(abs(x.t - x.target) <= 90 for x in none)
    mixed = mixing.mix_documents(clashing(docs))
    assert mixed.columns == clashing(docs).columns
    assert mixing.mix_documents(docs.where("false")).count() == 0


# -- 10
def test_jpeg_round_trip():
    r = np.random.default_rng(1)
    payloads = [bytes(64), b"\xff" * 128, r.integers(0, 256, 64 * 300, dtype=np.uint8).tobytes(), bytes(63) + b"a", (bytes(20) + b"a" + bytes(43)) * 3, bytes(range(256)) * 50]
    files = jpeg.pack(payloads)
    for j, p in zip(jpeg.decode(files), payloads, strict=True):
        assert jpeg.stored_payload(j) == p
    for f, p in zip(files, payloads, strict=True):
        assert jpeg.stored_payload(jpeg.decode([f])[0]) == p  # the other decoder where there are few intervals
    broken = jpeg.decode([files[2][:-40], b"", None, b"\xff\xd8junk", files[5]])
    assert broken[:4] == [None] * 4 and jpeg.stored_payload(broken[4]) == payloads[5]


def test_thumbnail_is_the_mean_of_each_block():
    blocks = np.zeros((6, 64), np.int8)
    blocks[:, 0] = [-100, -50, 0, 20, 60, 127]
    j = jpeg.decode(jpeg.pack([blocks.tobytes()]))[0]
    assert jpeg.thumbnail(j).ravel().tolist()[:6] == [int((v + 4) // 8 + 128) for v in (-100, -50, 0, 20, 60, 127)]
    assert (j.width, j.height) == (24, 16)


def encode_scan(j, names, blocks, restart=0):
    """Bits of one scan: blocks holds the components' coefficients in the order in which the scan has them."""
    dc, ac = jpeg._codes(*j.tables[0, 0]), jpeg._codes(*j.tables[1, 0])
    before, bits, out = {}, "", b""

    def put(v, codes, run):
        size = int(abs(v)).bit_length()
        code, length = codes[run * 16 + size]
        return f"{code:0{length}b}" + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for n, unit in enumerate(blocks):
        if restart and n and n % restart == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            bits, before = "", {}
        for name, block in unit:
            bits += put(int(block[0]) - before.get(name, 0), dc, 0)
            before[name] = int(block[0])
            run = 0
            last = max(np.flatnonzero(block).tolist(), default=0)
            for v in block[1 : last + 1].tolist():
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    code, length = ac[0xF0]
                    bits, run = bits + f"{code:0{length}b}", run - 16
                bits += put(v, ac, run)
                run = 0
            if last < 63:
                code, length = ac[0]
                bits += f"{code:0{length}b}"
    head = bytes([len(names)]) + b"".join(bytes([n, 0]) for n in names) + bytes([0, 63, 0])
    return jpeg._segment(0xDA, head) + out + flush(bits)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("own_scans", [False, True])
def test_colour_files_of_others(wide, restart, own_scans):
    # 37 x 21 pixels, luminance twice as fine as the two others; fill bytes, a comment, 8- or 16-bit quantisation.
    r, width, height = np.random.default_rng(5), 37, 21
    model = jpeg.parse(jpeg.pack([bytes(64)])[0])
    quant = r.integers(1, 40, 64)
    table = bytes([wide << 4]) + (quant.astype(">u2") if wide else quant.astype(np.uint8)).tobytes()
    sampling = {1: (2, 2), 2: (1, 1), 3: (1, 1)}
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, (h, v) in sampling.items())
    across, down = -(-width // 16), -(-height // 16)
    full = {i: np.where(r.random((down * v, across * h, 64)) < 0.2, r.integers(-60, 60, (down * v, across * h, 64)), 0) for i, (h, v) in sampling.items()}
    data = b"\xff\xd8" + jpeg._segment(0xFE, b"made by hand") + jpeg._segment(0xDB, table) + b"\xff\xff" + jpeg._segment(0xC0, frame) + jpeg._OWN_TABLES
    data += jpeg._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    if own_scans:
        for i, (h, v) in sampling.items():
            rows, columns = -(-(-(-height * v // 2)) // 8), -(-(-(-width * h // 2)) // 8)
            full[i] = full[i][:rows, :columns]
            data += encode_scan(model, [i], [[(i, b)] for b in full[i].reshape(-1, 64)], restart)
    else:
        units = [[(i, full[i][y * v + b, x * h + a]) for i, (h, v) in sampling.items() for b in range(v) for a in range(h)] for y in range(down) for x in range(across)]
        data += encode_scan(model, [1, 2, 3], units, restart)
    data += b"\xff\xd9"
    for j in jpeg.decode([data] * 3 + [data[:-30]])[:3]:
        assert all(np.array_equal(c.blocks, full[c.ident]) for c in j.components) and (j.width, j.height) == (width, height)
        thumb = jpeg.thumbnail(j)
        assert thumb.shape == (3, 5) and np.array_equal(thumb, np.clip((full[1][:3, :5, 0] * quant[0] + 4) // 8 + 128, 0, 255))
    assert jpeg.decode([data[:-30]])[0] is None


def test_media_of_nothing_long_and_repeated(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "long é " * 200_000)], "doc_id long, text string")
    rows = jpeg.read_media(jpeg.store_text_media(df).withColumn("width", F.lit("mine"))).collect()
    assert sorted((x.doc_id, x.n_bytes, x.payload_bytes) for x in rows) == [(1, 1, 64), (1, 1, 64), (2, 1_600_000, 1_600_000)]
    assert jpeg.read_media(jpeg.store_text_media(df.where("false"))).count() == 0


def test_media_columns(docs):
    stored = jpeg.store_text_media(clashing(docs))
    for r in jpeg.read_media(stored).join(docs.where("doc_id != 10"), "doc_id").collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_shingle_sets_of_short_texts():
    a, b, c, d = shingle_sets(pa.array(["One two", "one\ttwo", "one two three", None]))
    assert a.tolist() == b.tolist() != c.tolist() and len(a) == len(c) == 1 and len(d) == 0
