"""Operators against brute force on small, awkward tables: nulls, empty and long texts, repeated rows, extra columns."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import fingerprint, html_text, katz, langid, mixing, neardup, packing, pii, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def documents(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 120))), "en", r.choice(["a", "b", "b", None]), 0, "x") for i in range(n)]
    for i in range(n, n + 20):  # near and exact copies
        t = rows[i % 7][1].split()
        if i % 3:
            t[r.randrange(len(t))] = "changed"
        rows.append((i, " ".join(t), "en", "c", 0, "x"))
    rows += [(900, None, None, None, None, None), (901, "", "en", "a", 0, "x"), (902, " \n ", "en", "a", 0, "x"), (903, "One", "en", "a", 0, "x"), (904, "long " * 5000, "en", "b", 0, "x")]
    return [*rows, rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mix(docs, empty):
    rows = mixing.mix(docs, block=4).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 10 and target[s] <= 3 * size[s] for s in size)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, block=4).collect()))


def test_quotas_are_the_highest_quotients(spark):
    r = random.Random(5)
    items = [(i, float(r.randint(0, 50)), r.randint(0, 40)) for i in range(30)]
    seats = 200
    df = spark.createDataFrame(items, "i long, w double, cap long").withColumn("seats", F.lit(seats).cast("long"))
    got = {x.i: x.quota for x in mixing.apportion(df, [], "seats", "w", "cap", [F.col("i")]).collect()}
    best = sorted(((-w / (2 * k - 1), i, k) for i, w, cap in items for k in range(1, cap + 1) if w))[:seats]
    want = defaultdict(int)
    for _, i, _ in best:
        want[i] += 1
    assert got == {i: want[i] for i, _, _ in items}


def test_pack_holds_every_token_once(docs, empty):
    rows = [r for r in packing.pack(docs.dropDuplicates(["doc_id"]), window=64, grain=8, rounds_per_part=4).collect()]
    assert packing.pack(empty).count() == 0
    encode = packing.Tokens(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    texts = {d[0]: d[1] or "" for d in documents()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids = np.append(np.frombuffer(encode.encode(texts[d]), "<u2"), 1).astype("<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(len(np.frombuffer(encode.encode(t), "<u2")) + 1 for t in texts.values()) > 0.9 * 64 * len(sequences)


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 6)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, []), (304, [1.0] * 6), (305, [1.0] * 6)]
    v = spark.createDataFrame(rows, "id long, e array<float>").select("id", topk.quantise("e").alias("v")).filter("v is not null")
    got = defaultdict(list)
    for x in topk.top_k(v, v.filter("id % 20 = 0"), 5, block=8, range_rows=64, chunk_rows=4).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    full = {i: [int(64 * x) for x in e] for i, e in rows if e is not None and all(x is not None and x == x for x in e)}
    for q in (i for i in full if i % 20 == 0):
        want = sorted(((-sum(a * b for a, b in zip(full[q], full[i])), i) for i in full if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, k, percent):
    sets = {}
    for d, t, *_ in documents():
        w = (t or "").lower().split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, k, percent).collect()}
    assert got == {(d, len(s), root(d), d == root(d)) for d, s in sets.items()}
    assert neardup.near_duplicates(empty).count() == 0


def test_fingerprints(docs, empty):
    rows = fingerprint.compare_next(docs).collect()
    assert len(rows) == docs.count() and fingerprint.compare_next(empty).count() == 0
    ordered = sorted((d[0], d[1] or "") for d in documents())
    want = defaultdict(list)
    for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        want[d].append((len(t), __import__("hashlib").sha256(fingerprint.edited(t, n).encode()).hexdigest(), fingerprint.fingerprint(t.encode())))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_chars, r.edited_sha256, r.fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_likeness_is_the_edit_distance():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                last, d[j + 1] = d[j + 1], last if x == y else 1 + min(d[j], d[j + 1])
        return 1 - d[-1] / (len(a) + len(b))

    r = random.Random(4)
    for _ in range(50):
        a = "".join(r.choices("ABCDE", k=r.randint(4, 64)))
        b = a[: len(a) // 2] + "".join(r.choices("ABCDE", k=r.randint(0, 32)))
        want = plain(a, b) if fingerprint._common_run(a, b) else 0.0
        assert abs(fingerprint.likeness([(f"3:{a}:", f"3:{b}:")])[0] - (1.0 if a == b else want)) < 1e-12


def test_html(spark):
    page = '<html><head><title>t</title><script>var x="</p>"</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>Head {0}</h1><p>One &amp; two\n three {0}<br>four<p><b>Last {0} word</b><aside>side</aside><form>f</form><div class="comments"><p>hey</p></div></article><footer>foot</footer>'
    rows = [(i, f"https://h{i % 2}.org/{i}", page.replace("{0}", str(i))) for i in range(10)] + [(20, None, None), (21, "https://x.org/", ""), (22, "https://x.org/", "<p>just text</p>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head {i}\n\nOne & two three {i} four\n\nLast {i} word" for i in range(10))
    assert (got[20], got[21], got[22]) == ("", "", "just text")
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("batch", [katz.BATCH_TOKENS, 37])
def test_katz_is_the_textbook_model(docs, empty, batch, monkeypatch):
    monkeypatch.setattr(katz, "BATCH_TOKENS", batch)  # the smaller one cuts texts
    rows = {r.doc_id: r for r in katz.score(docs.dropDuplicates(["doc_id"]).withColumn("train", F.col("doc_id") % 5 != 0)).collect()}
    assert katz.score(empty.withColumn("train", F.lit(True))).count() == 0
    tokens = {d: (t or "").lower().split() + [1] for d, t, *_ in documents()}
    assert set(rows) == set(tokens)
    one, two = Counter(), Counter()
    for d, w in tokens.items():
        if d % 5:
            one.update(w)
            two.update(zip([2] + w[:-1], w))
    n, v, after = sum(one.values()), len(one), Counter()
    for (h, _), c in two.items():
        after[h] += c
    seen = lambda counts: [sum(c == r for c in counts.values()) for r in range(1, katz.TOP + 2)]
    keep1, keep2 = katz.discounts(seen(one)), katz.discounts(seen(two))
    kept = lambda keep, c: c * keep[c] if c <= katz.TOP else c
    whole = n if any(c <= katz.TOP for c in one.values()) else n + 1
    unknown = 1 - sum(kept(keep1, c) for c in one.values()) / whole
    p1 = lambda w: kept(keep1, one[w]) / whole if one[w] else unknown
    mass, lower = Counter(), Counter()
    low = {h for (h, _), c in two.items() if c <= katz.TOP}
    total = {h: c if h in low else c + 1 for h, c in after.items()}
    for (h, w), c in two.items():
        mass[h] += kept(keep2, c) / total[h]
        lower[h] += p1(w)
    p = lambda h, w: kept(keep2, two[h, w]) / total[h] if two[h, w] else p1(w) * ((1 - mass[h]) / (1 - lower[h]) if after[h] else 1)
    for h in [2, "w1", "w7", "one"]:  # sums to one over the known words and the unknown one
        assert abs(sum(p(h, w) for w in [*one, "unheard-of"]) - 1) < 1e-9
    for d, w in tokens.items():
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(p(h, x)) for h, x in zip([2] + w[:-1], w))
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and abs(r.score - score) < 1e-6 * max(1, -score)


def test_url_filter(spark):
    rows = [(1, "https://a.NET/x"), (2, "http://example.net/en/1?q"), (3, "http://m.example.com/de/"), (4, "http://b.org/fr/x#t"), (5, "net/"), (6, None), (7, "http://net"), (8, "http://xnet/"), (9, "http://a.org/de/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("a.net", "/x", "net/", "block"), 2: ("example.net", "/en/1", "example.net/en/", "allow"), 3: ("m.example.com", "/de/", "example.com/de/", "block"), 4: ("b.org", "/fr/x", "org/fr/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("net", "", None, "allow"), 8: ("xnet", "/", None, "allow"), 9: ("a.org", "/de/", None, "allow")}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_bloom_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"), (F.col("id") % 50 == 0).alias("listed"))
    cascade = url_filter.BloomCascade.fit(keys, bits_per_key=4, hashes=2)
    pdf = keys.toPandas()
    assert len(cascade.levels) > 2
    assert (cascade.contains(pdf["h"].to_numpy().view(np.uint64)) == pdf["listed"].to_numpy()).all()


def test_pii_base_and_model(spark):
    text = "Mail bob.x@mail.example.com, call +1 (269) 555-3296 or 10.0.0.255 and 4111 1111 1111 1111 not 4111 1111 1111 1112 nor 300.1.1.1"
    assert [(k, text[s:e]) for k, s, e in pii.base_spans(text)] == [("email", "bob.x@mail.example.com"), ("phone", "+1 (269) 555-3296"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111")]
    assert pii.base_spans("@" * 1000 + "1" * 50_000) == []
    rows = [(i, f"some words user{i}@site{i}.org then {i}.2.3.4 more words {i}") for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.annotate(docs, pii.fit(docs)).collect()}
    assert got[100].spans == got[101].spans == "" and got[7].n_email == 1 and got[7].n_ip == 1
    assert all(b in got[7].spans for b in (pii.joined(pii.base_spans(rows[7][1])).split(",")))


def test_language(spark):
    r = random.Random(3)
    vocab = {"en": ["the", "house", "water", "through", "which"], "de": ["das", "haus", "wasser", "durch", "welche"], "fr": ["la", "maison", "eau", "travers", "laquelle"]}
    rows = [(i, " ".join(r.choices(vocab[lang], k=20)), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)] + [(900, None, "en"), (901, "123 !", "de"), (902, "haus wasser", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(docs.withColumn("order", langid.sample_order(F.col("doc_id"))))
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(docs, models).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows[:90]) and got[900] == got[901] == ("und", 0.0) and got[902][0] == "de"
    assert {x.lang_pred for x in langid.identify(docs, {}).collect()} == {"und"}
    scorer = langid.Scorer(models)
    words = ["haus", "ñandú", "x" * 40, "a"]
    assert np.allclose(scorer.words(words), [scorer.word(w) for w in words])


def test_a_group_that_is_alike_but_not_linked(spark, monkeypatch):
    """Copies of one text with 0 to 12 words changed: most pairs lie below the threshold, few are compared, and no link is lost."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(300):
        t = list(base)
        for at in r.sample(range(120), i % 13):
            t[at] = f"x{r.randrange(60)}"
        texts.append(" ".join(t))
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for w in map(str.split, texts)]
    component = list(range(300))
    changed = True
    while changed:
        changed = False
        for a in range(300):
            for b in range(a):
                if component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
                    changed = True
    compared = []
    confirmed = neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, s: compared.append(pairs.count()) or confirmed(pairs, s))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(docs, 3, 85).collect()} == dict(enumerate(component))
    assert len(set(component)) > 100 and sum(compared) < 300 * 299 / 10


def test_least_common_is_the_threshold():
    for n in range(1, 60):
        for m in range(1, 60):
            i = int(neardup.least_common(np.int64(n), np.int64(m), 85))
            assert 100 * i >= 85 * (n + m - i) and 100 * (i - 1) < 85 * (n + m - i + 1)


def test_the_forward_sum_is_over_all_segmentations():
    r = random.Random(6)
    pieces = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab", "bca"]
    models = {lang: {p: r.random() / 20 for p in pieces if r.random() < 0.8} for lang in ("x", "y")}
    scorer = langid.Scorer(models)

    def total(word, p):
        if not word:
            return 1.0
        return sum(p(word[:n]) * total(word[n:], p) for n in range(1, len(word) + 1))

    table = {q for m in models.values() for q in m}
    for word in ["a", "ab", "abcab", "cabbca", "abcabcab", "zz"]:
        got = scorer.words([word])[0]
        for i, m in enumerate(models.values()):
            p = lambda s: max(m.get(s, langid.FLOOR**2), langid.FLOOR if len(s) == 1 else 0) if s in table else langid.FLOOR if len(s) == 1 else 0.0  # noqa: B023, E731
            assert abs(got[i] - math.log(total("▁" + word, p))) < 1e-9
    # expected counts against counts over enumerated segmentations
    m = models["x"]
    words, want = {"▁abca": 2.0, "▁cab": 1.0}, Counter()
    for w, c in words.items():
        ways = [[w[i:j] for i, j in zip((0, *cut), (*cut, len(w)))] for k in range(len(w)) for cut in __import__("itertools").combinations(range(1, len(w)), k)]
        weight = [math.prod(m.get(s) or (langid.FLOOR if len(s) == 1 else 0.0) for s in way) for way in ways]
        for way, x in zip(ways, weight):
            for s in way:
                if s in m:
                    want[s] += c * x / sum(weight)
    got = langid.expected_counts(words, m)
    assert all(abs(got[s] - want[s]) < 1e-9 for s in {*got, *want})


def test_letters():
    assert langid.words_of("नमस्ते ½² Ångström x2y") == ["नमस्ते", "ångström", "x", "y"]


def test_language_of_awkward_tables(spark):
    """Ties go to the smaller language; repeated rows agree; clashing columns are replaced; an empty table is an empty result."""
    models = {"a": {"▁": 0.5, "w": 0.5}, "b": {"▁": 0.5, "w": 0.5}}
    rows = spark.createDataFrame([(1, "w w", "old"), (1, "w w", "old"), (2, "½²", "old"), (3, "w " * 30_000, "old")], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(rows, models).orderBy("doc_id").collect()]
    assert got == [(1, "a", 0.5), (1, "a", 0.5), (2, "und", 0.0), (3, "a", 0.5)]
    assert langid.identify(rows.limit(0), models).count() == 0
    assert langid.fit(rows.limit(0).select("text", F.lit("x").alias("lang"), F.lit("0").alias("order"))) == {}


def test_language_without_labels(spark, tmp_path):
    """Where nothing is learned every text is und with score 0, in the operator, the query and the stage."""
    rows = [(i, t, None, "a", 0) for i, t in enumerate(["one two", None, "", "das haus", "x " * 3000])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        path = str(tmp_path / str(docs.count()))
        docs.write.parquet(f"{path}/documents.parquet")
        got = langid.op10_langid(spark, path).collect()
        assert len(got) == docs.count() and {(r.lang_pred, r.score) for r in got} <= {("und", 0.0)}


def segmentations(model, text, tokens):
    """All labelled segmentations with their scores, by enumeration."""
    if not tokens:
        return [((), 0.0)]
    out = []

    def walk(i, path, score):
        if i == len(tokens):
            out.append((tuple(path), score))
            return
        for j in range(i + 1, min(len(tokens), i + pii.MAX_TOKENS) + 1):
            _, scores = model.allowed(text, tokens, i, j) or (None, ())
            for y, s in enumerate(scores):
                if s is not None:
                    walk(j, [*path, (i, j, y)], score + s)

    walk(0, [], 0.0)
    return out


def test_pii_decoding_and_gradient_against_enumeration():
    model = pii.SemiCrf(np.random.default_rng(3).normal(size=(len(pii.KINDS) + 1, pii.DIM)))
    for text in ["a 1 b", "call 555 123 4567 or x@y.z now", "7", "bob (at) site.org ok 9", "1 2 3 4 5 6"]:
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        every = segmentations(model, text, tokens)
        best = max(every, key=lambda x: x[1])[0]
        want = [(pii.KINDS[y - 1], *pii.segment_span(text, tokens[i][0], tokens[j - 1][1])) for i, j, y in best if y]
        assert model.decode(text, tokens) == want
        total = sum(math.exp(s) for _, s in every)
        gold = [(i, i + 1, 0) for i in range(len(tokens))]
        for (i, j), (_, parts) in model.gradient(text, tokens, gold).items():
            for y, g in parts:
                expected = sum(math.exp(s) for path, s in every if (i, j, y) in path) / total
                assert abs(g - (((i, j, y) in gold) - expected)) < 1e-9


def test_pii_adds_forms_that_the_base_patterns_miss(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        name = "".join(r.choices("abcdefg", k=5))
        ip, phone = f"10.{i}.3.{r.randrange(256)}", f"+1 (269) 555-{r.randrange(10**4):04d}"
        rows.append((i, f"some words {name}.{name}@{name}place.org then {ip} more {i} words {phone} in 20{i % 90 + 10}", "x"))
    rows += [(500, "write to ann.b[at]place.org or (743) 555-3824 or 10[.]0[.]3[.]25, not 12.50 or 2024-03-04", "x"), (501, "one 1 " * 20_000, "x"), (501, "one 1 " * 20_000, "x"), (None, "9" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = pii.fit(docs)
    got = {x.doc_id: x for x in pii.annotate(docs, model).collect()}
    text = rows[120][1]
    found = [(k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in got[500].spans.split(","))]
    assert {("phone", "(743) 555-3824"), ("ip", "10[.]0[.]3[.]25")} <= set(found) and any(k == "email" and "place.org" in b for k, b in found)
    assert not any("12.50" in b or "2024" in b for _, b in found) and got[500].n_ip == 0
    assert pii.annotate(docs.limit(0), model).count() == 0 and pii.annotate(docs, model).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert pii.fit(docs.limit(0)).decode("9 9", [(0, 1), (2, 3)]) == []


def test_top_k_prunes_blocks_and_holds_large_numbers(spark):
    r = np.random.default_rng(4)
    centres = r.integers(-40, 41, (40, 16))
    d = __import__("pandas").DataFrame({"id": np.arange(4000), "v": list((centres[r.integers(0, 40, 4000)] + r.integers(-2, 3, (4000, 16))).astype(np.int64))})
    q = d[d["id"] % 100 == 0]
    found, scored, blocks = topk.search_range(q, d, 5, 32)
    assert scored < 0.5 * blocks
    v = np.stack(d["v"])
    for i in q["id"]:
        want = sorted((-int(v[i] @ v[j]), j) for j in range(4000) if j != i)[:5]
        own = found[found["query_id"] == i]
        assert list(zip(-own["score"], own["vec_id"])) == want
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (1, [1e30, 0.0]), (20, [-1e30, 2.0]), (21, [0.5, 0.5]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "id long, e array<float>").filter("id is not null").select("id", topk.quantise("e").alias("v"), F.lit(1).alias("score"))
    got = topk.top_k(vectors, vectors.filter("id % 20 = 0"), 2).orderBy("query_id", "rank").collect()
    big, small = 2**63 - 1, -(2**63) + 1
    assert [(x.query_id, x.vec_id, x.score) for x in got] == [(0, 1, big), (0, 1, big), (20, 0, small), (20, 1, small)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_topk_floors_from_the_first_ranges(spark):
    """The same results whether or not ranges share floors, with ties, repeated rows and fewer rows than k; later ranges return less."""
    r = np.random.default_rng(6)
    rows = [(int(i), (r.integers(-3, 4, 5)).tolist()) for i in r.permutation(150)] + [(3, [9, 9, 9, 9, 9])] * 3
    vectors = spark.createDataFrame(rows, "id long, v array<long>")
    queries = spark.createDataFrame([(i, [1, -2, 3, 0, i]) for i in range(12)], "id long, v array<long>")
    plain = [tuple(x) for x in topk.top_k(vectors, queries, 7).orderBy("query_id", "rank").collect()]
    for sizes in ({"range_rows": 10}, {"range_rows": 10, "first_of": 2, "chunk_rows": 5}, {"range_rows": 2}):
        assert [tuple(x) for x in topk.top_k(vectors, queries, 7, **sizes).orderBy("query_id", "rank").collect()] == plain
    want = []
    for q in range(12):
        own = sorted((-int(np.dot([1, -2, 3, 0, q], v)), i) for i, v in rows if i != q)[:7]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(own, 1)]
    assert plain == want
    import pandas as pd

    d, q = (pd.DataFrame({"id": [i for i, _ in x], "v": [v for _, v in x]}) for x in (rows, [(900, [1, 1, 1, 1, 1])]))
    free = topk.search_range(q, d, 7, 8)
    held = topk.search_range(q.assign(floor=int(free[0].score.iloc[3])), d, 7, 8)
    assert len(held[0]) < len(free[0]) and held[1] <= free[1] and (held[0].score >= free[0].score.iloc[3]).all()


def test_two_cards_side_by_side_are_both_found():
    """The base pattern takes two numbers side by side for one and drops it; the field, which learns from such tokens, adds both."""
    regions = [f"pay 4465758382889437 4465758382889437 now {i}" for i in range(6)] + [f"mail a{i}@b.org or 4465758382889437 today {i}" for i in range(6)]
    model = pii.SemiCrf().fit([x for r in regions for x in pii.examples(r)])
    base, found = pii.find("my cards: 4111111111111111 4111111111111111 thanks", model)
    assert base == [] and found == [("card", 10, 26), ("card", 27, 43)]
    assert pii.labelled("x 4465758382889437 4465758382889437") == [("card", 2, 18), ("card", 19, 35)]
