"""Long words, clashing names, brute force and large archives."""

import gzip
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import chat, decontamination, language, mixing, quality_rules, substring_dedup, token_counts, toxicity, warc
from strataflow.llm.common import table, whole_groups

DATA = "/root/testdata/sf0.001"


def features_of(word):
    ids, first = language.feature_ids(["x", word, "yy"])
    return sorted(ids[first[1] : first[2]].tolist())


def test_language_features_cover_whole_words():
    stem = "a" * 60
    assert features_of(stem + "b" * 40) != features_of(stem + "c" * 40)
    assert len(features_of("w" * 100)) == 4 + 4 + 1 + 98
    end, other = language.feature_ids(["p" * 50 + "ing"])[0], language.feature_ids(["running"])[0]
    assert len(set(end) & set(other)) >= 3  # affixes are those of the true end
    # features don't depend on the words beside
    assert features_of("straße") == sorted(language.feature_ids(["straße"])[0].tolist())


def test_language_of_texts_without_spaces():
    han = ["".join(chr(0x4E00 + (7 * i + k) % 50) for i in range(40)) for k in range(8)]
    kana = ["".join(chr(0x3042 + (5 * i + k) % 50) for i in range(40)) for k in range(8)]
    model = language.train(han + kana, ["zh"] * 8 + ["ja"] * 8)
    head = han[0][:21]
    assert model.documents([head + kana[1] + kana[2], head + han[1] + han[2]])[0] == ["ja", "zh"]


def test_language_scores_are_sums_over_paths():
    model = language.train(["der hund und die katze", "the dog and the cat"] * 4, ["de", "en"] * 4)
    text = "the hund and katze"
    e = language.emission_scores(text.split(), model.weights).astype(float)
    mean, total = np.zeros(2), 0.0
    for path in itertools.product(range(2), repeat=4):
        w = np.exp(sum(e[t, s] for t, s in enumerate(path)) + sum(model.moves[x, y] for x, y in zip(path, path[1:])))
        total += w
        for s in path:
            mean[s] += w / 4
    found, score = model.documents([text])
    assert found[0] == ["de", "en"][int(mean.argmax())] and score[0] == pytest.approx(mean.max() / total, abs=1e-4)


def test_language_spans_of_a_code_switched_text(spark):
    de, en = "der hund und die katze gehen nach hause", "the dog and the cat walk back home"
    model = language.train([de, en] * 6, ["de", "en"] * 6)
    rows = spark.createDataFrame([(1, f"{de} {en}"), (2, None), (3, "123")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in language.label_spans(rows, model).collect()}
    assert got == {1: [("de", 0, 8), ("en", 8, 8)], 2: [], 3: []}


def test_toxicity_matches_by_plain_search():
    scorer = toxicity.Scorer({" mor": 2.0, " trash ": 5.0, " clown ": 3.0}, (-3.0, 2.0, 1.0)).build()

    def plain(text):
        folded, total = toxicity.fold(text), 0.0
        terms = dict(scorer.lexicon)
        for phrase in (p + s for p in toxicity.EXCEPTIONS for s in ("", "s", "es")):
            x = toxicity.fold(phrase)
            held = sum(scorer.lexicon.get(t, 0) for w in x.split() for t in toxicity.terms(w))
            if held:
                terms[x] = terms.get(x, 0) - held
        for term, weight in terms.items():
            total += weight * sum(folded.startswith(term, i) for i in range(len(folded)))
        return max(0.0, total)

    for text in ("moron and m0rsel", "trash, can", "trash  cans!", "the trash can is trash", "circus clown clown", "no", "", None, "tra​sh"):
        assert scorer.weigh(text)[0] == pytest.approx(plain(text)), text
    assert scorer.scores(["put it in the trash, can't you"])[0] > 0  # defined whatever stands between
    assert max(scorer.scores(["the trash can", "the trash, can", "two trash cans", "the trash  can"])) < 0.5 < scorer.scores(["you are trash"])[0]


def test_mixing_sizes_and_targets_by_plain_rules(spark):
    texts = {"a": [3, 5, 0], "b": [100], None: [40, 2], "c": [7]}
    rows = [(i, " ".join("w" * n for n in [1] * k), s) for i, (s, k) in enumerate((s, k) for s, v in texts.items() for k in v)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].toPandas()
    size = {s: sum(v) for s, v in texts.items()}
    weight = dict(zip(sorted((s for s in size if s is not None), key=str) + [None], itertools.cycle((3, 1, 2))))
    goal, target, free = 1.5 * sum(size.values()), {}, set(size)
    while free:
        level = (goal - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    for i, text, source in rows:
        r = out[out.doc_id == i].iloc[0]
        assert (r["size"], r.source_size) == (len(text.split()), size[source]) and r.target == pytest.approx(target[source]) and r.taken <= 2 * r["size"]


def test_names_that_clash(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents").withColumns({c: F.lit(i) for i, c in enumerate(("score", "lang_pred", "n_sentences", "n_removed", "words_removed", "_0", "_known", "digest", "component", "node", "h1", "source_id", "block"))})
    docs = docs.unionByName(docs.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes})).persist()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.filter("score = 0 AND n_removed = 3 AND block = 12").count() > 0, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    assert mixing.mix_sources(docs)[0].count() == docs.count()
    assert {"lang_pred", "score"} < set(language.identify(docs, language.fit(docs), tuple(docs.columns)).columns)
    assert substring_dedup.remove_repeated_spans(docs).columns.count("n_removed") == 1
    assert token_counts.count_tokens(docs).count() == quality_rules.ledger(docs).count() == docs.count()


def test_decontamination_joins_rows_of_one_id(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "x four five six seven eight nine ten"), (2, item + " " + item), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {tuple(r) for r in decontamination.contained_items(docs, items).collect()} == {(1, 1, 6, 6), (2, 1, 6, 6)}


def test_salvage_of_many_members_is_linear():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 200\r\n\r\n" + bytes(range(200)) + b"\r\n\r\n"
    member = gzip.compress(record)
    data = member * 20_000
    data = data[:5000] + b"\0\0\0\0" + data[5004:]
    began = time.time()
    got = list(warc.salvage(data))
    assert time.time() - began < 60
    assert sum(kind == "record" for kind, _ in got) >= 19_997 and sum(kind == "gap" for kind, _ in got) >= 1


def test_large_pages_get_archives_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1000)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "y" * (2000 if i % 3 == 0 else 10) + str(i)) for i in range(9)], "page_id long, url string, html string")
    warc.write_archives(pages, path := f"file://{tmp_path}/w")
    assert len(list((tmp_path / "w/large").glob("part-*"))) == 3
    got = warc.read_archives(spark, path)
    assert got.count() == 9 and {r.payload.decode() for r in got.collect()} == {r.html for r in pages.collect()}


def test_chat_layouts_with_further_fields(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}], "id": "x"}'),
        (2, '{"id": 7, "instruction": "a", "output": "b", "input": "c"}'),
        (3, '{"prompt": {"text": "a"}, "response": "b"}'),
        (4, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": null}'),
        (5, '{"prompt": "a", "response": "b", "system": null, "extra": [1]}'),
        (6, '{"messages": []}'), (7, "no json"), (8, None),
    ]
    got = {}
    for r in chat.record_turns(spark.createDataFrame(records, "conv_id long, json string")).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, [r.layout]).append((r.role, r.text))
    two = [("user", "a"), ("assistant", "b")]
    assert got[1] == ["messages", *two] and got[4] == ["conversations", *two] and got[5] == ["system_prompt", *two]
    assert got[2] == ["instruction_input", ("user", "a"), ("user", "c"), ("assistant", "b")]
    assert {k for k, v in got.items() if v[0] == "unknown"} == {3, 6, 7, 8}
    rows = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 1, "assistant", None, 6)], "conv_id long, turn long, role string, text string, m long")
    assert chat.format_chats(chat.canonical_turns(rows)).count() == 1


def test_whole_groups_cuts_no_run():
    import pyarrow as pa

    values = np.sort(np.random.default_rng(2).integers(0, 12, 200))
    for step in (1, 3, 7, 50, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + step])], ["k"]) for i in range(0, 200, step)]
        out = [b.column("k").to_numpy() for b in whole_groups(batches, ["k"])]
        assert (np.concatenate(out) == values).all()
        assert all(a[-1] != b[0] for a, b in zip(out, out[1:]))
