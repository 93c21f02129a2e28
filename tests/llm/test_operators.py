"""The training-data operators against brute force, and their results for odd input."""

import itertools
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm import common, decontaminate, line_dedup, minhash, mixing, neighbours, notices, repeats, token_binary, token_counts, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = "doc string, hash string, row int, key int, copies int, score int"


def documents(spark, texts, ids=None, sources=None):
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources or itertools.repeat("src"))]
    return spark.createDataFrame(rows, DOCS)


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (None, "Alone with no id.", "en", "a", 1), (2, "", "en", "a", 0), (3, "   \n\n ", "en", None, 6), (4, long, "en", "a", len(long))]
    rows += [(5, "Twice the same row here.", "en", "b", 1)] * 2 + [(6, "é ß – “quoted” \U0001f600 naïve", "fr", "b", 1)]
    return spark.createDataFrame([(*r, "x", "x", 1, 2, 3, 4) for r in rows], f"{DOCS}, {ODD}")


def random_texts(seed, n, vocabulary=400, low=5, high=120):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(low, high))) for _ in range(n)]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), min_size=1, max_size=6))
def test_word_hashes_agree_with_the_words(texts):
    hashes, counts = common.hash_words(texts)
    found = [common.words(t) for t in texts]
    assert counts.tolist() == [len(x) for x in found]
    seen = {}
    for word, value in zip(itertools.chain(*found), hashes.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


# 1: decontamination


def brute_phrases(docs, items, n):
    out = set()
    for d, text in docs:
        words = common.words(text)
        for i, item in items:
            terms = common.words(item)
            size = min(n, len(terms))
            for o in range(len(terms) - size + 1 if size else 0):
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == terms[o : o + size]:
                        out |= {(d, i, w) for w in range(p, p + size)}
    return out


def test_decontamination_finds_the_phrases_that_brute_force_finds(spark):
    items = [(i, t) for i, t in enumerate(random_texts(1, 8, 60, 4, 30))]
    texts = random_texts(2, 60, 60)
    r = random.Random(3)
    for k in range(0, 60, 3):
        words = texts[k].split()
        passage = items[r.randrange(8)][1].split()
        a = r.randrange(len(passage) // 2 + 1)
        words[r.randrange(len(words)) : 0] = passage[a : a + r.randrange(3, 20)]
        texts[k] = " ".join(words).upper()
    items += [(99, None), (98, ""), (97, "...")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for pass_words in (1 << 30, 40):
        found = decontaminate.find_matches(documents(spark, texts).repartition(3), benchmark, 10, pass_words).where("kind = 'phrase'").collect()
        got = {(x.doc_id, x.item_id, w) for x in found for w in range(x.start_word, x.end_word)}
        assert got == brute_phrases(list(enumerate(texts)), items, 10)


def test_decontamination_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    near = "theta x alpha eta y beta gamma z delta epsilon zeta kappa iota mu lambda"
    far = " ".join(f"{w} " + "pad " * 30 for w in item.split())
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    found = decontaminate.find_matches(documents(spark, [near, far, "nothing here"]), benchmark).collect()
    assert {(x.doc_id, x.kind) for x in found} == {(0, "proximity")}


def brute_proximity(docs, items):
    out = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        words, terms = common.words(text), common.words(item)
        found = []
        for a in range(len(words)):
            missing = set(terms)
            for b in range(a, min(len(words), a + len(terms) * 3 // 2)):
                missing.discard(words[b])
                if terms and not missing:
                    found.append((b + 1 - a, a))
                    break
        if found:
            out.add((d, i, min(found)[1], sum(min(found))))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_decontamination_proximity_is_that_of_brute_force_under_any_partitioning(spark, parts):
    r = random.Random(8)
    items = [(i, " ".join(f"t{r.randrange(9)}" for _ in range(r.randrange(1, 12)))) for i in range(12)]
    texts = [" ".join(f"t{r.randrange(14)}" for _ in range(r.randrange(0, 30))) for _ in range(60)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_matches(documents(spark, texts).repartition(parts), benchmark).where("kind = 'proximity'").collect()
    assert {(x.doc_id, x.item_id, x.start_word, x.end_word) for x in found} == brute_proximity(list(enumerate(texts)), items)
    assert found


def test_decontamination_odd_input(spark):
    docs = odd_documents(spark)
    benchmark = spark.createDataFrame([(None, "twice the same row here"), (2, None)], "item_id bigint, text string")
    found = decontaminate.find_matches(docs, benchmark).collect()
    assert sorted(((x.doc_id, x.item_id, x.kind) for x in found), key=str) == [(5, None, "phrase")] * 2 + [(5, None, "proximity")] * 2
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.find_matches(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_matches(docs, benchmark.limit(0)).count() == 0


# 2: token ids


@pytest.fixture(scope="module")
def encoder():
    return token_binary.encoder_of(token_binary.VOCABULARY)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'.s1é"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    own = token_binary.encoder_of(token_binary.VOCABULARY)
    assert own.encode(pa.array(texts, pa.string())) == [own.whole(t) for t in texts]


def test_token_records_round_trip(spark, encoder):
    docs = odd_documents(spark)
    records = token_binary.encode_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(records) == docs.count()
    for r in records:
        ids = token_binary.read_document(r.shard, r.byte_offset, r.byte_length, r.dictionary_hash)
        assert len(ids) == r.n_tokens and ids.tobytes() == encoder.whole(texts[r.doc_id] or "")
    assert token_binary.encode_documents(docs.limit(0)).count() == 0


def test_shard_files_give_single_documents(spark, encoder, tmp_path):
    texts = random_texts(5, 300, 3000)
    index = token_binary.encode_documents(documents(spark, texts).repartition(3), f"file://{tmp_path}/out").collect()
    assert len(index) == 300 and max(r.byte_offset for r in index) > 0
    assert len(list((tmp_path / "out").glob("*.tok"))) == len({r.shard for r in index}) == 3
    for r in index[::7]:
        ids = token_binary.read_document(r.shard, r.byte_offset, r.byte_length, r.dictionary_hash)
        assert ids.tobytes() == encoder.whole(texts[r.doc_id])


def test_dictionaries_are_trained_on_samples_of_any_number():
    for samples in ([b"ab"], [b"abcdefgh" * 9] * 3, [bytes([i]) * 30 for i in range(200)]):
        assert token_binary.trained(samples)[:4] == b"\x37\xa4\x30\xec"
    assert token_binary.trained([]) == b""


# 3: toxicity


def toxic_corpus(seed, n):
    r = random.Random(seed)
    texts, labels, spots = [], [], []
    for _ in range(n):
        sentences = [[f"w{r.randrange(300)}" for _ in range(r.randrange(4, 12))] for _ in range(r.randrange(2, 9))]
        bad = r.random() < 0.3
        spot = r.randrange(len(sentences)) if bad else None
        if bad:
            sentences[spot].insert(1, r.choice(["vileword", "badword", "meanword"]))
        texts.append(". ".join(" ".join(s) for s in sentences) + ".")
        labels.append(int(bad))
        spots.append(spot)
    return texts, labels, spots


def test_toxicity_is_right_on_held_out_documents_and_finds_the_sentences(spark):
    texts, labels, spots = toxic_corpus(1, 1200)
    docs = documents(spark, texts)
    known = spark.createDataFrame([(i, 1, labels[i]) for i in range(800)], "doc_id bigint, quality int, toxic int")
    found = toxicity.offending_sentences(docs, known).collect()
    flagged = {r.doc_id for r in found}
    right = sum((i in flagged) == bool(labels[i]) for i in range(800, 1200))
    assert right >= 392
    worst = {}
    for r in found:
        worst[r.doc_id] = max(worst.get(r.doc_id, (0, 0)), (r.sentence_score, r.sentence))
        assert "." not in texts[r.doc_id][r.start_char : r.end_char]
    hits = [worst[i][1] == spots[i] for i in flagged if labels[i]]
    assert sum(hits) >= 0.97 * len(hits)
    kept = toxicity.keep_clean(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(1200)) - flagged


def test_toxicity_knows_unseen_forms_of_a_word_and_leaves_long_clean_texts_alone():
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(300)]
    for i in range(60):
        texts[i] += f". you vileform{i} there"
    model = toxicity.fit(texts, np.array([1.0] * 60 + [0.0] * 240))
    scorer = toxicity.Scorer(model)
    assert scorer.score("a b. you vilefornew c")[0] > 0.5
    assert scorer.score(". ".join(f"w{i} w{i + 1}" for i in range(3000)))[0] < 0.5


def test_toxicity_odd_input(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (4, 0, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.keep_clean(docs, labels).count() == docs.count()
    assert toxicity.offending_sentences(docs, labels.limit(0)).count() == 0
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


def test_toxicity_scores_are_those_of_brute_force(spark):
    texts, labels, _ = toxic_corpus(7, 300)
    texts[:3] = [None, "", "vileword " * 40 + "! badword badly. fine"]
    docs = documents(spark, texts)
    known = spark.createDataFrame([(i, 1, x) for i, x in enumerate(labels)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, known)
    expected = set()
    for i, text in enumerate(texts):
        clean, found, number = 1.0, [], 0
        for m in re.finditer(r"[^.!?\n]+", text or ""):
            total = sum(model.get(f, 0) for w in set(re.findall(r"\w+", m.group().lower())) for f in [w] + [w[:n] + "*" for n in (4, 5) if len(w) > n])
            p = 1 / (1 + math.exp(-(model[""] + total) / 1e6)) if total else 0.0
            clean *= 1 - p
            found += [(p, -number, m.start(), m.end())] if total else []
            number += 1
        if 1 - clean >= toxicity.THRESHOLD:
            expected |= {(i, -n, a, b) for p, n, a, b in found if p >= toxicity.THRESHOLD or (p, n) == max(found)[:2]}
    got = toxicity.offending_sentences(docs, known).collect()
    assert expected and {(r.doc_id, r.sentence, r.start_char, r.end_char) for r in got} == expected


# 4: repeated passages


def brute_repeats(rows, size):
    seen = defaultdict(set)
    words = [common.words(t) for _, t in rows]
    for (i, t), own in zip(rows, words):
        for j in range(len(own) - size + 1):
            seen[tuple(own[j : j + size])].add(i)
    out = set()
    for (i, t), own in zip(rows, words):
        spans = []
        for j in range(len(own) - size + 1):
            if len(seen[tuple(own[j : j + size])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + size
                else:
                    spans.append([j, j + size])
        out |= {(i, *s) for s in spans}
    return out


def test_repeats_are_those_of_brute_force(spark):
    texts = random_texts(7, 80, 40, 10, 160)
    r = random.Random(8)
    for _ in range(60):
        source, target = r.sample(range(80), 2)
        words, passage = texts[target].split(), texts[source].split()
        at = r.randrange(len(passage))
        words[r.randrange(len(words)) : 0] = passage[at : at + r.randrange(6, 60)]
        texts[target] = " ".join(words)
    texts[11] = texts[12] = texts[13]
    texts[20] = "same " * 70
    texts[21] = "same " * 40
    got = {(x.doc_id, x.start_word, x.end_word) for x in repeats.find_repeats(documents(spark, texts).repartition(3), 12, 5).collect()}
    assert got == brute_repeats(list(enumerate(texts)), 12)


@pytest.mark.parametrize("seed", range(12))
def test_construction_in_memory_and_in_files(seed, tmp_path, monkeypatch):
    r = np.random.default_rng(seed)
    lengths = r.integers(0, 14, r.integers(1, 12))
    words = r.integers(0, 3, lengths.sum()).astype("u4")
    at = np.concatenate([[0], np.cumsum(lengths)])
    suffixes = sorted((tuple(map(int, words[at[i + 1] - j : at[i + 1]])) + (i - 1000,), i, j) for i in range(len(lengths)) for j in range(lengths[i] + 1))
    common_prefixes = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), 0) for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:])]
    monkeypatch.setattr(repeats, "BLOCK", 4)
    for folder in (None, f"file://{tmp_path}"):
        string, length, lcp = repeats.construct(words, lengths, folder)
        assert list(zip(string.tolist(), length.tolist())) == [(i, j) for _, i, j in suffixes]
        assert lcp.tolist() == common_prefixes


@pytest.mark.parametrize("seed", range(6))
def test_aligned_order_is_that_of_the_whole_construction(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(0, 9, r.integers(1, 14))
    columns = r.integers(0, 4, len(lengths))
    words, begins = r.integers(0, 3, lengths.sum()).astype("u4"), common.starts_of(lengths)[:-1]
    string, length, lcp = repeats.construct(words, lengths)
    place = {(i, j): k for k, (i, j) in enumerate(zip(string.tolist(), length.tolist()))}
    for c, order, shared in repeats.aligned_order(words, begins, lengths, columns, 13):
        at = [place[i, max(0, int(columns[i] + lengths[i]) - c)] for i in order.tolist() if columns[i] <= c < columns[i] + lengths[i]]
        assert at == sorted(at)
        assert shared[len(order) - len(at) :][1:].tolist() == [int(lcp[a + 1 : b + 1].min()) for a, b in zip(at, at[1:])]


def test_one_anchor_of_many_different_segments_takes_a_step_for_each_word():
    n, r = 20_000, np.random.default_rng(5)
    words = r.integers(0, 1 << 32, (n, 80), dtype="u4")
    words[:, 25:75] = words[0, 25:75]
    words[-1, 74] += 1
    one = pa.table({"anchor": [1] * n, "row": range(n), "first": range(100, 100 + n), "start": [7] * n, "at": [30] * n, "words": [x.tobytes() for x in words]})
    one = one.cast(pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("start", pa.int32()), ("at", pa.int32()), ("words", pa.binary())]))
    began = time.process_time()
    found = repeats.repeated(one, 50, 20)
    assert time.process_time() - began < 4
    assert {x for x in zip(*(c.tolist() for c in found))} == {(i, 32, 82, 100) for i in range(n - 1)}


def test_repeats_odd_input(spark):
    docs = odd_documents(spark)
    assert repeats.find_repeats(docs).count() == 0  # repeated rows are one document
    both = docs.unionAll(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("bigint")))
    found = repeats.find_repeats(both).collect()
    assert sorted((x.doc_id or 0, x.start_word, x.end_word, x.first_doc_id) for x in found) == [(0, 0, 30000, 4), (4, 0, 30000, 4)]
    assert repeats.find_repeats(docs.limit(0)).count() == 0


# 5: lines


def test_line_dedup_odd_input(spark):
    texts = [f"Boiler  PLATE\nown {i}\n\nboiler plate" for i in range(12)] + [None, "", "boiler plate"]
    ids = [*range(11), None, 50, 51, 52]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts, ids), 10).collect()}
    assert got[3].text == "own 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[None].text == "own 11\n"
    assert got[50].text is None and (got[50].n_lines, got[50].n_dropped) == (0, 0)
    assert got[51].text == "" and got[51].n_lines == 1 and got[52].text == ""
    once = documents(spark, ["a\nb"] * 30, [1] * 30)
    assert {(r.text, r.n_dropped) for r in line_dedup.dedup_lines(once, 10).collect()} == {("a\nb", 0)}
    odd = odd_documents(spark)
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 6: neighbours


def test_neighbours_reach_the_recall_of_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((8, 24)) * 2
    x = (centres[r.integers(0, 8, 700)] + r.standard_normal((700, 24))).astype("f4")
    x[10] = x[11]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [], 0), (902, [1.0] * 5, 0), (903, [float("nan")] * 24, 0), (904, [None] * 24, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = defaultdict(list)
    for n in neighbours.nearest(table, 10, 150).collect():
        got[n.vec_id].append((n.rank, n.neighbor_id, n.distance))
    assert set(got) == set(range(700)) and all(sorted(a for a, _, _ in v) == list(range(1, 11)) for v in got.values())
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, 1)[:, :10]
    assert np.mean([len(set(best[i]) & {n for _, n, _ in got[i]}) / 10 for i in range(700)]) >= 0.95
    assert min(got[10])[1:] == (11, 0.0)
    assert all(abs(dist - d[i, n]) < 1e-9 for i in range(0, 700, 50) for _, n, dist in got[i])


def test_neighbours_of_the_query_set_of_the_whole_table(spark):
    table = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = table.where("embedding is not null").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(set)
    for n in neighbours.nearest(table.withColumn("shard", F.lit("x")), every=50, shard=256, block=16).collect():
        got[n.vec_id].add(n.neighbor_id)
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    right = []
    for i in np.flatnonzero(ids % 50 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        right.append(len(set(ids[np.argsort(d)[:10]].tolist()) & got[int(ids[i])]) / 10)
    assert np.mean(right) >= 0.95


def test_a_shard_is_searched_faster_than_all_its_distances_are_computed():
    r = np.random.default_rng(9)
    x, points = r.standard_normal((4096, 64)), r.standard_normal((400, 64))
    began = time.thread_time()
    d = np.array([np.sqrt(((x - p) ** 2).sum(1)) for p in points])
    plain = time.thread_time() - began
    best = np.argsort(d, 1)[:, :10]
    bounds = np.sort(d, 1)[:, 14]
    index = neighbours.Index(x)
    began = time.thread_time()
    got = index.search(points, points @ neighbours.directions(64), bounds, 10)
    assert time.thread_time() - began < plain
    assert np.mean([len(set(b.tolist()) & set(places.tolist())) / 10 for b, (places, _) in zip(best, got)]) >= 0.95
    assert all(abs(row[n] - y) < 1e-9 and y <= bound for row, bound, (places, ys) in zip(d, bounds, got) for n, y in zip(places.tolist(), ys.tolist()))


def test_neighbours_of_few_and_repeated_rows(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [3.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(((n.vec_id or 0, n.rank, n.neighbor_id or 0, n.distance) for n in neighbours.nearest(table, 5).collect()))
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 3.0), (1, 1, 1, 0.0), (1, 1, 1, 0.0), (1, 2, 0, 3.0), (1, 2, 0, 3.0)]
    assert neighbours.nearest(table.limit(0)).count() == 0
    spread = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "vec_id bigint, embedding array<double>").repartition(3)
    few = [(n.vec_id, n.rank, n.distance) for n in neighbours.nearest(spread, 4, 2).collect()]
    assert len(few) == 24 and sorted(d for v, _, d in few if v == 0) == [1.0, 2.0, 3.0, 4.0]


# 7: near duplicates


def test_signatures_estimate_similarity_with_little_variance():
    r = np.random.default_rng(5)
    errors = []
    for share in (0.3, 0.5, 0.8):
        for _ in range(60):
            pool = r.integers(0, 2**63, 400, dtype=np.uint64)
            both = int(400 * share)
            a, b = pool[: both + (400 - both) // 2], np.concatenate([pool[:both], pool[both + (400 - both) // 2 :]])
            s = minhash.super_minhash(np.concatenate([a, b]), np.array([len(a), len(b)]), 128)
            errors.append((s[0] == s[1]).mean() - both / 400)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_early_stopping_changes_no_signature():
    r = np.random.default_rng(6)
    sizes = np.array([1, 2, 7, 40, 0, 900])
    elements = r.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    got = minhash.super_minhash(elements, sizes, 32)
    for row, (a, b) in zip(got, zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
        slots = [math.inf] * 32
        for e in elements[a:b]:
            p = list(range(32))
            for j in range(32):
                draw = int(minhash.mix64(np.array([(int(e) + (j + 1) * int(minhash.GOLDEN)) % 2**64], np.uint64))[0])
                k = j + ((draw & 0xFFFFFFFF) * (32 - j) >> 32)
                p[j], p[k] = p[k], p[j]
                slots[p[j]] = min(slots[p[j]], j + (draw >> 32) / 2**32)
        assert row.tolist() == slots


def near_corpus(seed):
    r = random.Random(seed)
    texts = random_texts(seed, 40, 2000, 60, 120)
    for base in range(10):
        for _ in range(r.randrange(1, 6)):
            words = texts[base].split()
            for _ in range(r.randrange(0, 6)):
                words[r.randrange(len(words))] = "edit"
            texts.append(" ".join(words).upper())
    return texts


def brute_groups(texts, threshold):
    sets = []
    for t in texts:
        w = common.words(t)
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(set)
    for i in range(len(texts)):
        groups[root(i)].add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_near_duplicate_groups_are_those_of_brute_force(spark):
    texts = near_corpus(9)
    rows = minhash.near_duplicates(documents(spark, texts).repartition(3)).collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r.group_id].add(r.doc_id)
        assert r.is_representative == (r.doc_id == r.group_id)
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts, minhash.THRESHOLD)
    assert all(r.group_size == len(groups[r.group_id]) for r in rows)
    kept = {r.doc_id for r in minhash.keep_representatives(documents(spark, texts)).collect()}
    assert kept == set(range(len(texts))) - {d for g, own in groups.items() for d in own if d != g}


def test_near_duplicates_odd_input(spark):
    docs = odd_documents(spark)
    found = minhash.near_duplicates(docs).collect()
    assert [(r.doc_id, r.group_size) for r in found] == [(5, 2)] * 2
    kept = minhash.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.keep_representatives(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 130)] + [(129, 200), (200, 201)]
    random.Random(1).shuffle(edges)
    table = spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)
    got = {r.node: r.root for r in minhash.components(table).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {x: 100 for x in [*range(101, 130), 200, 201]}


# 8: mixing


def test_mixing_takes_epochs_and_then_the_best_keys(spark):
    texts = ["t " * (5 + i % 7) for i in range(300)]
    sources = ["big" if i < 260 else "small" if i < 299 else None for i in range(300)]
    labels = spark.createDataFrame([(i, i % 3 // 2, 0) for i in range(0, 300, 2)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, texts, sources=sources)
    chosen = {r.doc_id: r.copies for r in mixing.select_documents(docs, labels).collect()}
    total = defaultdict(int)
    for i in range(300):
        total[sources[i]] += len(texts[i].split())
    norm = sum(t**0.5 for t in total.values())
    keyed = {r.doc_id: r.key for r in mixing.with_keys(docs.select("doc_id"), labels).collect()}
    for source, own in total.items():
        target = math.floor(sum(total.values()) * own**0.5 / norm)
        epochs, rest = divmod(target, own)
        run = 0
        for i in sorted((i for i in range(300) if sources[i] == source), key=lambda i: (keyed[i], i)):
            run += len(texts[i].split())
            assert chosen.get(i, 0) == epochs + (run <= rest)
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == chosen


def test_mixing_odd_input(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert mixing.mix(docs, labels).columns == docs.columns
    got = mixing.select_documents(docs, labels, budget=3.0).collect()
    assert len({r.copies for r in got if r.doc_id == 5}) == 1
    assert mixing.select_documents(docs.limit(0), labels).count() == 0


# 9: notices


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(last + (p != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def test_notice_search_finds_every_text_that_brute_force_finds(spark):
    r = random.Random(4)
    texts = random_texts(11, 60, 200)
    for k in range(0, 60, 2):
        wording = list(r.choice(notices.NOTICES)[1])
        for _ in range(r.randrange(0, 9)):
            at = r.randrange(len(wording))
            wording[at : at + r.randrange(2)] = r.choice(["", "x", " "])
        texts[k] = texts[k][:50] + "".join(wording).upper() + texts[k][50:]
    scanner = notices.Scanner(notices.NOTICES, notices.CHARS_PER_ERROR)
    found = defaultdict(list)
    for x in notices.scan_notices(documents(spark, texts).repartition(3)).collect():
        assert x.matched == texts[x.doc_id][x.start_char : x.end_char]
        found[x.doc_id, x.notice].append(x.errors)
    for i, text in enumerate(texts):
        for plan in scanner.plans:
            least = sellers(plan.text, text.lower())
            assert least == plan.distances(text.lower()).min()
            assert ((i, plan.name) in found) == (least <= plan.errors)
            if least <= plan.errors:
                assert min(found[i, plan.name]) == least


def test_notice_search_odd_input(spark):
    docs = odd_documents(spark)
    assert notices.scan_notices(docs).count() == 0 and notices.scan_notices(docs.limit(0)).count() == 0
    twice = documents(spark, ["İ Released under the MIT License. and İ released under the mit licence."], [None])
    got = notices.scan_notices(twice).collect()
    assert [(x.doc_id, x.notice, x.errors) for x in got] == [(None, "MIT", 0), (None, "MIT", 1)] and got[0].matched == "Released under the MIT License."


def test_notice_search_in_a_text_full_of_notices(spark):
    exact, near = "Released under the MIT License. ", "Released under teh MIT License. "
    texts = [exact * 5000, near * 5000, (exact + near) * 700]
    found = notices.scan_notices(documents(spark, texts)).where("notice = 'MIT'").groupBy("doc_id", "errors").count().collect()
    assert {(x.doc_id, x.errors): x["count"] for x in found} == {(0, 0): 5000, (1, 2): 5000, (2, 0): 700, (2, 2): 700}


def test_notice_search_finds_the_licence_lines_of_the_documents_table(spark):
    lines = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "reserved-short": "All rights reserved.",
    }
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").cache()
    found = {(x.doc_id, x.notice) for x in notices.scan_notices(docs).where("errors = 0").collect()}
    plain = {(d.doc_id, name) for d in docs.where("text is not null").collect() for name, line in lines.items() if line.lower() in d.text.lower()}
    assert found == plain and {name for _, name in plain} == set(lines)


# 10: token counts


def brute_count(scores, of_bytes, pretoken):
    text = token_counts.MARK + pretoken
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        spelt = text[end - 1].encode()
        now = (best[end - 1][0] + sum(of_bytes[b] for b in spelt), best[end - 1][1] + len(spelt))
        for start in range(end - 1, -1, -1):
            if text[start:end] in scores:
                one = (best[start][0] + scores[text[start:end]], best[start][1] + 1)
                if one[0] > now[0] or one[0] == now[0] and one[1] <= now[1]:
                    now = one
        best.append(now)
    return best[-1][1]


def test_token_counts_are_those_of_plain_dynamic_programming(spark):
    texts = ["The theory of the thermal theatre, theoretically.", "naïve \U0001f600 ☃ x" * 3, *random_texts(13, 20, 5000)]
    docs = documents(spark, texts).repartition(2)
    model = token_counts.vocabulary_of(token_counts.VOCABULARY)
    plain = np.zeros(model.get_piece_size(), np.int64)
    for text in texts:
        for pretoken in text.split():
            for i in model.encode(pretoken):
                plain[i] += 1
    counts = token_counts.piece_counts(docs, token_counts.VOCABULARY)
    assert counts.tolist() == plain.tolist()
    scores, of_bytes = token_counts.unigram(token_counts.VOCABULARY, counts)
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(docs).collect()}
    for i, text in enumerate(texts):
        parts = re.split(r"\s+", text)
        assert got[i] == (len(parts), sum(brute_count(scores, of_bytes, p) for p in parts))


def test_a_shared_prefix_is_scored_once():
    own = token_counts.Counter({"▁a": -1.0, "b": -2.0, "ab": -2.5}, [-9.0] * 256)
    own.insert("ab")
    before = len(own.forward)
    own.insert("abb")
    assert len(own.forward) == before + 1 and own.terminal == {"ab": 2, "abb": 3}


def test_token_counts_odd_input(spark):
    docs = odd_documents(spark)
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(docs).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4][0] == 30_000 and token_counts.count_tokens(docs).count() == docs.count()
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


# pipeline: its stages


def test_stages_begin_on_heaps_that_were_given_back(spark):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())

    for name, stage in corpus_pipeline.STAGES[1:]:
        before = collections()
        docs = stage(spark, documents(spark, ["one two", "three"]), "/root/testdata/sf0.001")
        assert collections() > before, name
        assert docs.count() <= 2
