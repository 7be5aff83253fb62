"""Stages of the pipeline against plain Python on small tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from routeloom.llm import langid, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def seeded(*parts):
    return int(hashlib.md5(":".join([mixing.SEED, *map(str, parts)]).encode()).hexdigest()[:8], 16)


def test_mixing_keeps_the_blocks_that_the_mix_takes(spark):
    r = random.Random(7)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(r.randint(40, 700))), "en", "abc"[i % 3], 0) for i in range(36)]
    docs = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.mixed(spark, docs, "").collect()
    got = Counter(w for x in out for w in x.text.split())
    shares = mixing.mix(docs).collect()
    targets = {x.source: x.target for x in shares}
    words, most = defaultdict(int), Counter()
    for x in out:
        words[x.doc_id] += len(x.text.split())
        most[x.doc_id] += 1
        assert x.n_chars == len(x.text)
    assert all(words[x.doc_id] == x.taken for x in shares) and max(most.values()) <= 3
    for x in out:  # in text order, none twice in a row of the result
        at = [int(w.split("w")[1]) for w in x.text.split()]
        assert at == sorted(set(at))
    spread = 64
    for source in "abc":
        own = sorted((seeded(d) % spread, seeded(d), str(d), len(t.split()), t) for d, t, _, s, _ in rows if s == source)
        stream = " ".join(t for *_, t in own).split()
        blocks = [stream[i : i + 32] for i in range(0, len(stream), 32)]
        counts = [{got[w] for w in b} for b in blocks]
        assert all(len(c) == 1 for c in counts)  # blocks are taken whole
        counts = [c.pop() for c in counts]
        wide = max(1, math.ceil(len(blocks) / 64))
        for at in range(0, len(blocks), wide):  # the choice inside a shard
            n, q = len(blocks[at : at + wide]), sum(counts[at : at + wide])
            start, more = seeded(source, at // wide) % n, q % n
            assert counts[at : at + wide] == [q // n + (i + 1 + start) * more // n - (i + start) * more // n for i in range(n)]
        assert abs(sum(counts) - targets[source] / 32) <= 2
    under = [x for x in shares if 0 < x.taken < x["size"]]
    text = {d: t.split() for d, t, *_ in rows}
    assert any(got[text[x.doc_id][-1]] for x in under)  # ends of cut documents come through


def test_mixing_gives_each_row_its_own_share(spark):
    r = random.Random(8)
    ids = [None] * 12 + [5] * 12 + list(range(10, 22))  # null ids, and one id with a third of all rows and different texts
    rows = [(d, " ".join(f"r{i}w{j}" for j in range(r.choice([3, 40, 300]))), "en", "abc"[i % 3], 0) for i, d in enumerate(ids)] + [(5, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.mixed(spark, docs, "").collect()
    targets = {x.source: x.target for x in mixing.mix(docs).collect()}
    words, owner, repeats = Counter(), {w: (d, s) for d, t, _, s, _ in rows for w in (t or "").split()}, Counter()
    for x in out:
        words[x.source] += len(x.text.split())
        assert {owner[w] for w in x.text.split()} == {(x.doc_id, x.source)}
        assert len({w.split("w")[0] for w in x.text.split()}) == 1
        repeats[x.text.split()[0].split("w")[0]] += 1
    assert all(abs(words[s] - targets[s]) <= 64 for s in targets)  # a block or two of rounding
    assert max(repeats.values()) <= 3 and any(x.doc_id is None for x in out)


def test_near_duplicates_keep_one_row_of_a_group(spark):
    r = random.Random(9)
    text = lambda: " ".join(r.choices([f"w{i}" for i in range(60)], k=80))
    a, b, c, d = (text() for _ in range(4))
    near = a.replace(a.split()[0], "other", 1)
    given = [(7, a), (7, a), (None, a), (3, near), (None, b), (None, b), (4, c), (4, c), (4, d), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in given], DOCS)
    got = sorted(((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, near), (None, b), (4, c), (4, d), (8, "")], key=str)


VOCABULARY = {"en": ["the", "house", "water", "through", "which"], "de": ["das", "haus", "wasser", "durch", "welche"]}


def awkward(r):
    """Rows in two languages: null and repeated ids, copies, personal data, text without letters or null."""
    line = lambda lang: " ".join(r.choices(VOCABULARY[lang], k=60))
    rows = [(i, line(lang), lang) for i, lang in enumerate(["en", "de"] * 20)]
    rows += [(None, line("en"), "en"), (None, line("de"), "de"), (3, line("de"), "de"), (50, line("en") + " mail bob.x@mail.example.com now", "en")]
    rows += [rows[4], rows[4], (None, rows[6][1], "en"), (60, "123 !", "en"), (61, None, "de")]
    return [(i, t, lang, "ab"[k % 2], len(t or "")) for k, (i, t, lang) in enumerate(rows)]


def test_language_and_personal_data_stages(spark):
    rows = awkward(random.Random(11))
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(x for x in rows if x[0] not in (60, 61))
    out = corpus_pipeline.personal_data(spark, docs, "").collect()
    assert len(out) == len(rows) and all(x.n_chars == len(x.text) for x in out if x.text)
    texts = Counter(x.text for x in out)
    assert not any("bob.x@mail" in (t or "") for t in texts)
    assert texts - Counter(x[1] for x in rows) == Counter([next(x.text for x in out if x.doc_id == 50)])  # no other changes


def test_run_keeps_null_and_repeated_ids(spark, tmp_path):
    rows = awkward(random.Random(12))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = Counter(x.doc_id if x.doc_id == x.doc_id else None for x in out)
    assert None in pieces and 60 not in pieces and 61 not in pieces
    assert set(pieces) <= {x[0] for x in rows}
    whole = defaultdict(int)
    for x in out:
        whole[x.sequence_id] = max(whole[x.sequence_id], x.offset + x.length)
    assert sum(x.length for x in out) == sum(whole.values())  # sequences have no gaps


def test_language_is_told_on_texts_not_learned_from(spark):
    r = random.Random(13)
    rows = [(i, " ".join(r.choices(VOCABULARY[lang], k=12)), lang) for i, lang in enumerate(["en", "de"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(docs.filter("doc_id < 60").withColumn("order", langid.sample_order(F.col("doc_id"))))
    held = langid.identify(docs.filter("doc_id >= 60"), models).collect()
    assert len(held) == 20 and all(x.lang_pred == rows[x.doc_id][2] for x in held)


def test_stages_of_tables_without_labels_and_of_empty_ones(spark, tmp_path):
    """Without labels no document is rejected for its language; columns called first and copies come through; empty tables give no rows."""
    rows = [(i, f"word{i} and some other words of text {i}", None, "ab"[i % 2], 0, i, "c") for i in range(12)] + [(20, None, None, None, 0, 1, None), (21, "", None, "a", 0, 1, None)]
    docs = spark.createDataFrame(rows, DOCS + ", first long, copies string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [*range(12), 20, 21]
    mixed = corpus_pipeline.mixed(spark, docs, "")
    assert mixed.columns == docs.columns and {r["first"] for r in mixed.collect()} <= set(range(12))
    for name, some in (("some", docs), ("none", docs.limit(0))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()}
        assert ids <= set(range(12)) and bool(ids) == (name == "some")
