"""Small cases and brute force for operators that SQL can't express."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataflow.llm import chat, decontamination, jaccard_join, language, mixing, quality_rules, registry, substring_dedup, token_counts, toxicity, warc
from strataflow.llm.common import table
from strataflow.llm.components import components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").toPandas()


def test_odd_documents(spark, odd_documents):
    d = odd_documents
    scorer = toxicity.fit(["you utter moron"] * 3, ["a fine day"] * 3)
    assert toxicity.score_toxicity(d, scorer).filter("score BETWEEN 0 AND 1").count() == 9
    assert {r.doc_id: r.lang_pred for r in language.identify(d, language.fit(d)).collect() if r.doc_id in (2, 3, 5, 6)} == dict.fromkeys((2, 3, 5, 6), "und")
    assert quality_rules.ledger(d).count() == 9
    counts = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(d).collect()}
    assert (2, 0) in counts and (3, 0) in counts
    mix, _ = mixing.mix_sources(d)
    rows = mix.collect()
    assert len(rows) == 9 and all(r.taken <= 2 * r["size"] for r in rows)
    comp = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(d).collect()}
    assert comp[2] == (0, 2) and comp[None] == (comp[7][0], 7) and comp[1][1] == 1
    assert jaccard_join.one_of_each_group(d).filter("doc_id = 1").count() == 1
    cleaned = substring_dedup.remove_repeated_spans(d)
    assert cleaned.count() == 9 and cleaned.columns[:5] == d.columns
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked"), (2, None), (None, "x y"), (3, "cat")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(d, items).collect()} == {(1, 1)}


def test_empty_tables(spark, odd_documents):
    none = odd_documents.limit(0)
    assert mixing.mix_sources(none)[0].count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert substring_dedup.remove_repeated_spans(none).count() == 0
    assert language.identify(none, language.fit(none)).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert decontamination.contained_items(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert toxicity.score_toxicity(none, toxicity.fit([], [])).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_toxicity_folding():
    scorer = toxicity.fit([f"what a m0ron {w}" for w in "abcdefgh"] * 2 + ["such a mоron", "moron"], [f"what a lovely {w}" for w in "abcdefghijklmnop"] * 2)
    scores = scorer.scores(["You MORON", "you m0r0n", "you mоrоn", "lovely", "", None])
    assert min(scores[:3]) > 0.5 > max(scores[3:])
    quiet = toxicity.Scorer({" trash ": 5.0}, (-3.0, 2.0, 1.0))
    assert quiet.scores(["put it in the trash can"])[0] < 0.5 < quiet.scores(["you are trash"])[0]


def test_toxicity_and_language_held_out(spark):
    rows = registry.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97
    r = spark.createDataFrame([(0,), (7,)], "doc_id long").select("doc_id", toxicity.held_out()).collect()
    assert [x[1] for x in r] == [zlib.crc32(str(x[0]).encode()) % 5 == 0 for x in r]


def test_forward_backward_sums_all_paths():
    rng = np.random.default_rng(0)
    e, a = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    p, _ = language.forward_backward(e, np.array([4]), a)
    want, total = np.zeros((4, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(e[0, t, s] for t, s in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
        total += w
        for t, s in enumerate(path):
            want[t, s] += w
    assert np.allclose(p[0], want / total)


def shingles(text):
    w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def test_jaccard_join_against_brute_force(spark):
    random.seed(5)
    base = [f"w{random.randint(0, 400)}" for _ in range(90)]
    texts = ["", None, "A b", "a B", "only four words here"]
    for k in range(120):
        t = list(base)
        for _ in range(k // 12):
            t[random.randrange(len(t))] = f"x{random.randint(0, 10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"y{random.randint(0, 500)}" for _ in range(40)) + " " + " ".join(base[:20]) for _ in range(40)]
    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for i, g in enumerate(group):
        low.setdefault(g, i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {i: (len(s), low[group[i]]) for i, s in enumerate(sets)}


def test_jaccard_links_are_all_found(spark):
    random.seed(8)
    base = [f"w{random.randint(0, 400)}" for _ in range(90)]
    texts = ["", None, "A b", "a B"]
    for k in range(60):
        t = list(base)
        for _ in range(k // 20):
            t[random.randrange(len(t))] = f"x{random.randint(0, 10**6)}"
        texts.append(" ".join(t))
    sets = [shingles(t) for t in texts]
    want = {i: sum(i != j and bool(a) and 100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.jaccard_links(df).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}


def test_pipeline_drops_near_copies_by_five_words_and_80_percent(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(100)]

    def changed(*places):
        return " ".join(f"{w}x" if i in places else w for i, w in enumerate(base))

    def five(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    texts = [changed(), changed(30, 70), changed(20, 50, 80), "other " + " ".join(f"v{i}" for i in range(60))]
    near = [len(five(texts[0]) & five(t)) / len(five(texts[0]) | five(t)) for t in texts[1:]]
    assert near[0] >= 0.8 > near[1] and not near[2]
    assert 100 * len(shingles(texts[0]) & shingles(texts[1])) < 85 * len(shingles(texts[0]) | shingles(texts[1]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, DATA).collect()} == {0, 2, 3}


def test_trie_prunes_but_misses_nothing():
    random.seed(3)
    sets = [np.array(sorted(random.sample(range(30), random.randint(1, 20))), np.uint64) for _ in range(300)]
    probes = sets[:60] + [np.array([100, 200], np.uint64), np.array([1, 2, 500], np.uint64)]
    for percent in (30, 60, 85, 100):
        want = [[100 * len({*s} & {*t}) >= percent * len({*s} | {*t}) for t in map(np.ndarray.tolist, probes)] for s in map(np.ndarray.tolist, sets)]
        assert (jaccard_join.similar_sets(sets, probes, percent) == np.array(want)).all()


def test_jaccard_links_in_several_blocks_and_over_rows_without_an_id(spark, monkeypatch):
    """Tiny chunks, meetings and blocks; a text that only rows without an id have joins two others."""
    for name, value in (("CHUNK", 400), ("MEETING", 8), ("SMALL", 2), ("BLOCK_SETS", 7), ("BUCKET_BYTES", 4000)):
        monkeypatch.setattr(jaccard_join, name, value)
    random.seed(9)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(f"v{random.randrange(40)}" if random.random() < i / 900 else w for w in base)) for i in range(90)]
    rows += [(500, " ".join(f"c{i}" for i in range(80)))]
    rows += [(None, " ".join(f"c{i}" if i else "d" for i in range(5, 80)) + " e1 e2 e3 e4 e5"), (501, " ".join(f"c{i}" for i in range(10, 80)) + " e1 e2 e3 e4 e5 e6 e7 e8 e9 e10")]
    rows += [(3, rows[3][1]), (None, ""), (None, None)]
    sets = [shingles(t) for _, t in rows]
    near = [[bool(a) and bool(b) and i != j and 100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert near[-6][-5] and near[-5][-4] and not near[-6][-4]
    group = list(range(len(rows)))
    for i, row in enumerate(near):
        for j in np.flatnonzero(row):
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_links(df).collect()), key=str)
    assert got == sorted(((r[0], len(s), least[g], sum(m)) for r, s, g, m in zip(rows, sets, group, near)), key=str)


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64))
        b = np.unique(np.r_[a[: rng.integers(1, 300)], rng.integers(0, 2**63, 20, dtype=np.int64).astype(np.uint64)])
        apart = np.bitwise_count((jaccard_join.signature(a) ^ jaccard_join.signature(b)).view(np.uint64)).sum()
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 10), (2, 7)], "u long, v long")
    got = {tuple(r) for r in components(links).collect()}
    assert got == {(3, 2), (4, 2), (5, 2), (7, 2), (9, 8), (10, 8)}


def test_spans_against_brute_force(spark, docs):
    """Spans by plain tuples of words instead of hashes."""
    texts = dict(zip(docs.doc_id, docs.text))
    found, first = {}, {}
    for i in sorted(texts):
        made = substring_dedup.Sentences(pa.array([texts[i].encode()], pa.large_binary()), 3, 20)
        limits, a, b, one, _ = made.of(0)
        ws = texts[i].encode().lower().split()
        keys = [tuple(ws[limits[x] : limits[y]]) for x, y in zip(a, b)]
        assert len({*zip(keys, one)}) == len({*keys}) == len({*one.tolist()})
        found[i] = (limits, [(k, x, y) for k, x, y in zip(keys, a, b)])
        for k in keys:
            first.setdefault(k, i)
    df = spark.createDataFrame([(int(i), t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeated_spans(df).collect()}
    for i, (limits, spans) in found.items():
        gone, seen = set(), set()
        for k, x, y in spans:
            if first[k] != i or k in seen:
                gone |= set(range(x, y))
            seen.add(k)
        assert got[i].n_removed == len(gone), i
        if not gone:
            assert got[i].text == texts[i]
        else:
            ws = texts[i].split(None)
            assert len(got[i].text.encode().split()) == len(texts[i].encode().split()) - got[i].words_removed


def test_a_frequent_span_sends_one_candidate_a_chunk(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 1)
    passage = " ".join(f"w{k}" for k in range(60)) + "."
    ids = [7, 3, 9, 3, 5]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([passage] * 5)], ["doc_id", "text"])
    for rows in substring_dedup._span_rows([batch], sentences=3, words=20):
        told = {}
        for h, d, later in zip(*(rows.column(c).to_pylist() for c in ("h1", "doc_id", "later"))):
            told.setdefault(h, []).append((d, later is not None))
        assert told
        assert all(sorted(v) == [(3, False), (5, True), (7, True), (9, True)] for v in told.values())


def test_spans_of_several_batches_are_one_chunk():
    passage = " ".join(f"w{k}" for k in range(60)) + "."
    batches = [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["doc_id", "text"]) for ids, texts in (([7, 2], [passage, "short"]), ([3], [passage]), ([9, 5], ["", passage]))]
    told = {}
    for rows in substring_dedup._span_rows(iter(batches), sentences=3, words=20):
        for h, d, later in zip(*(rows.column(c).to_pylist() for c in ("h1", "doc_id", "later"))):
            told.setdefault(h, []).append((d, later is not None))
    assert told
    assert all(sorted(v) == [(3, False), (5, True), (7, True)] for v in told.values())


def test_no_batch_holds_all_text_of_a_task(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 1000)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 320)
    texts = [" ".join(f"w{j}x{k}" for k in range(60)) for j in range(20)]
    ids = pa.array(range(20), pa.int64())
    sent = list(substring_dedup._span_rows([pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["doc_id", "text"])], sentences=3, words=20))
    assert max(rows.num_rows for rows in sent) <= 10 < sum(rows.num_rows for rows in sent)
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), pa.array([[]] * 20, pa.list_(pa.int64())), pa.array([True] * 20)], ["doc_id", "text", "_repeated", "_known"])
    cleaned = list(substring_dedup._cleaned([batch], sentences=3, words=20))
    assert max(sum(map(len, rows.column("text").to_pylist())) for rows in cleaned) <= 1000
    assert [(d, t) for rows in cleaned for d, t in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist())] == list(enumerate(texts))


def test_spans_and_texts_meet_python_in_bounded_batches(spark, monkeypatch):
    name, held = "spark.sql.execution.arrow.maxBytesPerBatch", []
    stored = substring_dedup.stored
    monkeypatch.setattr(substring_dedup, "stored", lambda *a: held.append(spark.conf.get(name)) or stored(*a))
    before = spark.conf.get(name, None)
    passage = " ".join(f"w{k}" for k in range(60)) + "."
    d = spark.createDataFrame([(1, passage), (2, passage)], "doc_id long, text string").withColumn("nothing", F.lit(None))
    got = substring_dedup.remove_repeated_spans(d)
    assert got.columns[:3] == d.columns and got.filter("n_removed = 0 AND nothing IS NULL").count() == 1
    assert held == [str(substring_dedup.BATCH_BYTES)] * 2 and spark.conf.get(name, None) == before


@pytest.mark.parametrize("kind", ["int", "string", "decimal(10,0)", "double", "date"])
def test_first_document_of_a_span_by_ids_of_any_type(spark, kind):
    passage = " ".join(f"w{k}" for k in range(60)) + "."
    of = "date_add(DATE'2024-01-01', CAST(id AS INT))" if kind == "date" else f"CAST(id AS {kind})"
    d = spark.range(5, 400, numPartitions=3).selectExpr(f"{of} AS doc_id", "id").withColumn("text", F.lit(passage)).drop("id")
    least = d.agg(F.min("doc_id")).first()[0]
    got = substring_dedup.remove_repeated_spans(d).filter("n_removed = 0").collect()
    assert [r.doc_id for r in got] == [least]


def test_spans_find_passages_in_the_middle_of_sentences(spark):
    random.seed(11)
    word = lambda: f"w{random.randint(0, 10**7)}"

    def prose(n, longest=22):
        out = []
        while len(out) < n:
            out += [word() for _ in range(random.randint(8, longest))]
            out[-1] += "."
        return out[: n - 1] + [word()]  # ends in the middle of a sentence

    rows, planted = [], 0
    for k in range(90):
        passage = prose(51) if k % 3 else [word() for _ in range(51)]
        for longest in (22, 60) if k % 2 else (22, 22):
            rows.append((planted, " ".join(prose(random.randint(25, 70), longest) + passage + prose(random.randint(25, 70)))))
            planted += 1
    got = {r.doc_id: r.words_removed for r in substring_dedup.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(0, planted, 2))
    assert all(20 <= got[i] <= 51 for i in range(1, planted, 2))


def test_warc_salvage():
    def record(n, payload, kind="response"):
        import base64
        import hashlib

        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    import gzip

    a, b, c = (record(i, f"page {i} WARC/1.1\n".encode() * 5) for i in range(3))
    good = list(warc.salvage(a + b + c))
    assert [x[1][0] for x in good] == [f"<urn:page:{i}>" for i in range(3)]
    broken = a + b[:-30] + c
    out = list(warc.salvage(broken))
    assert [x[1][0] for x in out if x[0] == "record"] == ["<urn:page:0>", "<urn:page:2>"]
    gap = next(x[1] for x in out if x[0] == "gap")
    assert gap[:2] == (len(a), len(a) + len(b) - 30)
    flipped = bytearray(a + b + c)
    flipped[len(a) + len(b) - 10] ^= 1
    assert [x[0] for x in warc.salvage(bytes(flipped))] == ["record", "gap", "record"]
    zipped = [gzip.compress(x) for x in (a, b, c)]
    zipped[1] = zipped[1][: len(zipped[1]) // 2]
    out = list(warc.salvage(b"junk" + b"".join(zipped)))
    assert [x[1][0] for x in out if x[0] == "record"] == ["<urn:page:0>", "<urn:page:2>"] and [x[0] for x in out][0] == "gap"
    assert list(warc.salvage(b"")) == []


def test_warc_salvage_inside_a_member():
    import gzip

    def record(n, body):
        return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r:{n}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    a, b, c = (record(n, random.Random(n).randbytes(3000)) for n in range(3))
    names = lambda data: [x[0] if x[0] == "gap" else x[1][0] for x in warc.salvage(data)]
    assert names(gzip.compress(a + b[:-30] + c)) == ["<r:0>", "gap", "<r:2>"]
    whole = gzip.compress(a + b + c)
    assert names(whole) == ["<r:0>", "<r:1>", "<r:2>"]
    assert names(whole[: len(whole) * 3 // 4]) == ["<r:0>", "<r:1>", "gap"]
    assert names(gzip.compress(b"nothing") + gzip.compress(a)) == ["gap", "<r:0>"]


def test_warc_nulls(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, None, "x"), (3, "u\nv", None), (4, "u", ""), (None, "u", "q")], "page_id long, url string, html string")
    from strataflow.llm.common import new_path

    warc.write_archives(pages, path := new_path(spark, "test"))
    rows = {r.record_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, path).collect()}
    assert rows == {"<urn:page:1>": ("revisit", "<urn:page:2>", 1), "<urn:page:2>": ("response", None, 1), "<urn:page:3>": ("revisit", "<urn:page:4>", 0), "<urn:page:4>": ("response", None, 0), "<urn:page:>": ("response", None, 1)}


def test_policies(spark, docs):
    rows = quality_rules.ledger(spark.createDataFrame(docs[["doc_id", "text"]])).cache()
    kept = [quality_rules.apply_policy(rows, v).filter("kept").count() for v in ("1", "2")]
    lost = {r.rule: r.n_only_this for r in quality_rules.ablations(rows, "2").collect()}
    without = quality_rules.mask(r for r in quality_rules.RULES if r != "few_words")
    assert kept[0] >= kept[1]
    assert lost["few_words"] == rows.filter(F.col("failed").bitwiseAND(F.lit(without)) == 0).count() - kept[1]


def test_token_cache(spark, docs, tmp_path):
    df = spark.createDataFrame(docs[["doc_id", "text"]].head(60))
    cache = f"file://{tmp_path}/cache"
    a = token_counts.count_tokens(df.limit(40), cache=cache).collect()
    stored = spark.read.parquet(cache).count()
    b = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, cache=cache).collect()}
    assert all(b[r.doc_id] == r.n_tokens for r in a)
    assert spark.read.parquet(cache).count() == df.select("text").distinct().count() >= stored
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path())
    assert all(b[i] == len(model.encode(t)) for i, t in zip(docs.doc_id.head(60), docs.text.head(60)))
    made = token_counts.counter(token_counts.tokenizer_path())
    random.seed(2)
    for _ in range(500):
        text = "".join(random.choice(["a", "the", "\n", " ", "  ", "é", "😀", "<s>", "▁", " of", "7"]) for _ in range(9))
        assert made.count(text) == len(model.encode(text))
    other = token_counts.counter(token_counts.tokenizer_path("byte_bpe_50k.json"))
    assert other.count("hello world") == 2


def test_mix(spark):
    for row in (registry.QUERIES["op9_mix_sources"](spark, DATA).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))).collect():
        assert abs(row.t - row.g) <= 1 and row.over <= 0
    n = 97
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
    assert sorted(got) == list(range(n)) != got


def test_chat_layouts(spark):
    texts = ["<|im_end|>\n", "\\", "\\!", "[INST] [/INST]</s><s>", "<<SYS>>x<</SYS>>", "\\n", "plain", "", None, "é😀"]
    rows = [(c, k, r, t) for c in range(3) for k, (r, t) in enumerate(zip(["user", "assistant", "sys\ntem\\n", "assistant", None, "user", "assistant", "user", "assistant", "assistant"], texts))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.canonical_turns(df)).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    for r in out:
        assert [(x.role, x.text) for x in r.t] == [(a or "", b or "") for _, _, a, b in rows[:10]]
        assert r.loss == "".join(t or "" for _, _, role, t in rows[:10] if role == "assistant")
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
    records = [(1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'), (2, '{"instruction":"a","input":"","output":"b"}'), (3, '{"prompt":"a","response":"b"}'), (4, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'), (5, '{"odd":1}'), (6, "broken"), (7, None)]
    got = chat.record_turns(spark.createDataFrame(records, "conv_id long, json string")).collect()
    for c in range(1, 5):
        assert [(r.role, r.text) for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)] == [("user", "a"), ("assistant", "b")]
    assert {r.conv_id for r in got if r.layout == "unknown"} == {5, 6, 7}


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda d: sorted(tuple(None if x is None or x != x else str(int(x)) if isinstance(x, (float, np.floating)) else str(x) for x in r) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False))
    assert plain(a) == plain(b)


def test_pipeline_stages(spark):
    import corpus_pipeline

    source = table(spark, DATA, "documents")
    docs = source
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, DATA)
        assert out.columns == source.columns
        assert 0 < out.count() <= docs.count()
        docs = out.cache()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
