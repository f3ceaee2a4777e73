"""The operators against brute force, and the cases their docstrings define."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismill.llm import chunk_dedup, components, credentials, line_dedup, mixing, ngram_join, outliers, packing, toxicity, vector_graph, weak_quality

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(draw: random.Random, words: int, stems=("lor", "ip", "dol", "sit", "amet", "con", "sec", "tur")) -> str:
    return " ".join("".join(draw.choice(stems) for _ in range(draw.randint(1, 4))) for _ in range(words))


def texts(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- components ---


def test_components_of_chain_star_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, None)]
    got = {r.node: r.component for r in components.components(texts(spark, links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(texts(spark, [], "u long, v long")).count() == 0


# --- 1: n-gram Jaccard join ---


def brute_groups(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_groups_agree_with_brute_force_on_a_large_near_copy_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    draw = random.Random(3)
    base, rows = prose(draw, 150).split(), []
    for i in range(100):  # edits that leave pairs on both sides of the threshold
        w = list(base)
        for _ in range(draw.randint(1, 5)):
            w[draw.randrange(len(w))] = prose(draw, 1) + str(i)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(draw, draw.randint(1, 60)) if i % 3 else rows[i][1].upper()) for i in range(60)]
    rows += [(2000 + i, f"start{i} " + " ".join(base[:100])) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(texts(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_prefix_lengthens_with_cost_and_pairs_never_escape():
    draw = random.Random(5)
    for _ in range(300):
        n = draw.randint(1, 60)
        a = set(draw.sample(range(90), n))
        b = set(a)
        for _ in range(draw.randint(0, 8)):
            b.discard(draw.choice(sorted(b))) if draw.random() < 0.5 and len(b) > 1 else b.add(draw.randint(0, 120))
        df = {x: (x * 7919) % 23 + 2 for x in range(130)}
        order = lambda s: np.array(sorted(s, key=lambda x: (df[x], x)))  # noqa: B023, E731
        got = [ngram_join.choose_prefix(len(s), order(s), np.array([df[x] for x in order(s)]), 80) for s in (a, b)]
        if 100 * len(a & b) >= 80 * len(a | b):
            assert len(set(got[0][1]) & set(got[1][1])) >= min(got[0][0], got[1][0])
    cheap, _ = ngram_join.choose_prefix(50, np.arange(50), np.full(50, 2), 80)
    dear, longer = ngram_join.choose_prefix(50, np.arange(50), np.full(50, 100_000), 80)
    assert dear > cheap or dear == ngram_join.LONGEST
    assert len(longer) == 50 - 40 + dear


def test_groups_of_odd_rows(odd):
    got = ngram_join.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd.count()
    assert (by[1].component_id, by[3].component_id, by[2].component_id) == (1, 1, 2)
    assert [by[i].n_shingles for i in (4, 5, 6, 10)] == [0, 0, 0, 1] and all(by[i].component_id == i for i in (4, 5, 6, 9, 10))
    assert by[8].component_id == 7
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0


# --- 2: toxicity ---


def test_folding():
    assert [toxicity.fold(t).strip() for t in ("1diot!", "іdiоt", "L0S3R", "100 %", "a$$$ and&&&", "naïve", "sc​um")] == ["idiot", "idiot", "loser", "100", "a and", "naive", "scum"]


def test_exceptions_length_and_word_starts():
    model = toxicity.Lexicon({"trash": 3.0}, ("trash can",))
    machine = model.automaton()
    assert model.evidence(machine, "You are tr4sh") > 0
    assert model.evidence(machine, "the trash can is full") == 0 == model.evidence(machine, "untrashed") == model.evidence(machine, None)
    assert model.evidence(machine, "trash " + "calm " * 5000) < model.evidence(machine, "trash calm")
    assert model.evidence(machine, "trash in the trash can") == pytest.approx(model.evidence(machine, "trash in the calm can"), rel=0.01)


def toxic_corpus(n=400):
    draw = random.Random(11)
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        words = prose(draw, draw.randint(20, 200)).split()
        for w in draw.sample(["grimbol", "fizzwart", "snorkle"], 2) if bad else []:
            words.insert(draw.randrange(len(words)), w + draw.choice(["", "ish", "er"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_learned_lexicon_finds_disguised_words_in_held_out_texts(spark):
    rows = toxic_corpus()
    seen = texts(spark, [r for r in rows if r[0] % 4], "id long, text string, toxic int")
    model = toxicity.fit_lexicon(seen.select("id", "text"), seen.select("id", "toxic"))
    hidden = [(i, t.replace("i", "1").replace("o", "0") if bad else t, bad) for i, t, bad in rows if i % 4 == 0]
    got = toxicity.score_toxicity(texts(spark, hidden, "doc_id long, text string, toxic int"), model).collect()
    assert all((r.score >= 0.3) == bool(r.toxic) for r in got)


def test_toxicity_of_odd_rows(spark, odd):
    seen = texts(spark, toxic_corpus(100), "id long, text string, toxic int")
    model = toxicity.fit_lexicon(seen.select("id", "text"), seen.select("id", "toxic"))
    got = toxicity.score_toxicity(odd, model)
    assert got.columns == [*odd.columns, "_score", "evidence"]
    assert got.count() == odd.count() and got.where("_score >= 0 AND _score < 0.3").count() == odd.count()
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    empty = toxicity.fit_lexicon(texts(spark, [(1, "x"), (2, None)], "id long, text string"), texts(spark, [(1, None), (2, 1), (None, 0)], "id long, toxic int"))
    assert not empty.weights and toxicity.score_toxicity(odd, empty).where("_score < 0.3").count() == odd.count()


def test_held_out_rows_follow_the_checksum(spark):
    got = spark.range(200).select("id", toxicity.held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


# --- 3: weak labels ---


def test_label_model_recovers_accuracies_of_overlapping_labellers():
    draw = np.random.default_rng(2)
    k, n = len(weak_quality.LABELLERS), 20_000
    good = draw.random(n) < 0.85
    blames = np.array([v == weak_quality.BAD for *_, v in weak_quality.LABELLERS])
    chance = np.where(blames[:, None], [0.45, 0.03], [0.4, 0.9])
    speaks = draw.random((n, k)) < chance[:, good.astype(int)].T
    votes = np.where(speaks, np.where(blames, weak_quality.BAD, weak_quality.GOOD), weak_quality.NONE)
    patterns, code, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, found, share = weak_quality.label_model(patterns, counts.astype(float))
    assert abs(share - good.mean()) < 0.02 and np.abs(found - chance).max() < 0.05
    assert ((posterior[code.ravel()] > 0.5) == good).mean() > 0.95


def test_quality_separates_junk_from_prose(spark, odd):
    draw = random.Random(4)
    rows = []
    for i in range(300):
        words = prose(draw, 120).split()
        junk = i % 10 == 0
        if junk:
            words = [w + draw.choice(["###", "&&&", "$$$"]) for w in words] if i % 20 else [w for w in words[:10] for _ in range(12)]
        rows.append((i, ". ".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)) + "."))
    got = weak_quality.score_quality(texts(spark, rows)).collect()
    assert all(r.kept == bool(r.doc_id % 10) for r in got)
    assert weak_quality.score_quality(odd).count() == odd.count()
    assert weak_quality.score_quality(odd.limit(0)).count() == 0


# --- 4: line dedup ---


def test_lines_of_odd_rows(odd):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "_n_lines", "n_dropped"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].text == "the same short line\nand a second line of it" and by[2].text == "another one here" and by[3].text == ""
    assert (by[3]["_n_lines"], by[3].n_dropped, by[4].text, by[4]["_n_lines"]) == (2, 2, "", 1)
    assert got.where("doc_id IS NULL AND text = 'the same short line'").count() == 1
    assert [r.n_dropped for r in got.where("doc_id = 9").collect()] == [0, 0]
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0
    assert line_dedup.dedup_lines(odd, min_docs=4).where("n_dropped > 0").count() == 0


def test_only_ascii_letters_are_folded(spark):
    got = line_dedup.dedup_lines(texts(spark, [(1, "ÉCOLE NORMALE"), (2, "école normale"), (3, "École NORMALE\x0b"), (4, "École normale")])).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {1: 0, 2: 0, 3: 1, 4: 1}  # É stays É, so 2 is another line


# --- 5: mixing ---


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w, fixed, total = {s: weights[i % 3] for i, s in enumerate(names)}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in fixed)
        share = sum(w[s] for s in names if s not in fixed)
        target = {s: most * sizes[s] if s in fixed else rest * w[s] / share for s in names}
        over = {s for s in names if s not in fixed and target[s] > most * sizes[s]}
        if not over:
            return target
        fixed |= over


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    draw = random.Random(9)
    rows = [(i, "w " * draw.choice([3, 10, 10, 10, draw.randint(1, 300)]), draw.choice(["b", "b", "b", "b", "a", "c", None]) if i > 5 else "zz") for i in range(3000)]
    frame = texts(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    want = brute_targets(sizes)
    assert all(target[s] == pytest.approx(want[s], rel=1e-9) for s in want)
    assert all(abs(taken[s] - target[s]) <= 300 for s in want)
    mixed = mixing.apply_mix(frame.repartition(7))  # another layout, the same copies
    assert mixed.columns == frame.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_mix_of_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.copies <= 3 for r in got)
    assert mixing.apply_mix(odd.limit(0)).count() == 0 and mixing.apply_mix(odd.limit(0)).columns == odd.columns


# --- 6: credentials ---

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_agree_with_a_scan(spark, odd):
    draw = random.Random(1)
    bits = ["token", "TOKEN", "Secret", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdefgh", "abc", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "é", "𝔘", "\n", "passwd", "k", "=="]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randint(0, 30)))) for i in range(500)] + [(1000, None)]
    got = credentials.find_credentials(texts(spark, rows)).select("doc_id", credentials.written(F.col("base")).alias("s")).collect()
    known = dict(rows)
    assert all(r.s == brute_spans(known[r.doc_id] or "") for r in got) and len(got) == len(rows)
    assert credentials.find_credentials(odd).count() == odd.count()
    assert credentials.find_credentials(odd.limit(0)).count() == 0


def test_weak_parts_need_a_complement_in_reach(spark):
    weak = "Zk3xPq8LmN2vRt5wYb7cJd"
    rows = [(1, f"user: alice and {weak}"), (2, f"only {weak} here"), (3, f"user: alice {'x ' * 200} {weak}"), (4, "pwd=abc123 at https://db.example.org/x"), (5, "see https://db.example.org/x"), (5, f"login=bob {weak}")]
    got = [(r.doc_id, sorted(p["kind"] for p in r.linked)) for r in credentials.find_credentials(texts(spark, rows)).collect()]
    assert sorted(got) == [(1, ["login", "string"]), (2, []), (3, []), (4, ["endpoint", "phrase"]), (5, []), (5, ["login", "string"])]


# --- 7: chunks ---


def test_passages_are_found_after_insertions_and_clean_texts_are_left(spark, odd):
    draw = random.Random(8)
    passage = prose(draw, 60)
    rows = [(i, prose(draw, 80)) for i in range(60)]
    rows += [(100 + i, prose(draw, draw.randint(5, 40)) + " " + passage + " " + prose(draw, draw.randint(5, 40))) for i in range(12)]
    frame = texts(spark, rows)
    got = {r.doc_id: r for r in chunk_dedup.shared_passages(frame).collect()}
    assert set(got) == set(range(100, 112)) and got[100].n_dropped == 0
    # A chunk at the edge of the passage may be first held by another copy.
    assert all(100 in r.holders and r.n_dropped for i, r in got.items() if i > 100)
    kept = {r.doc_id: r.text for r in chunk_dedup.drop_passages(frame).collect()}
    assert all(len(kept[i]) < len(dict(rows)[i]) - 150 if i > 100 else kept[i] == dict(rows)[i] for i in kept)
    assert chunk_dedup.drop_passages(odd).count() == odd.count() and chunk_dedup.shared_passages(odd.limit(0)).count() == 0


def test_chunks_cover_the_text_and_hold_their_bounds():
    draw = random.Random(6)
    for text in (b"", b"short", prose(draw, 3000).encode(), b"a" * 5000):
        ends = chunk_dedup.cuts(text)
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(text) and all(s <= chunk_dedup.MOST for s in sizes) and all(s >= chunk_dedup.LEAST for s in sizes[:-1])


# --- 8: packing ---


def test_packing_is_a_round_trip(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    draw = random.Random(12)
    rows = [(i, prose(draw, draw.choice([0, 1, 5, 60, 400])) + draw.choice(["", "!", " <|endoftext|> it's", " ÀÉ́ ΣΑΣ x", ' "a", b.c; Ab,'])) for i in range(200)] + [(500, None)]
    encoder = Tokenizer.from_file(VOCABULARY)
    for frame in (texts(spark, rows), odd.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        want = {r.doc_id: [*encoder.encode(r.text or "", add_special_tokens=False).ids, 2] for r in frame.collect()}
        got, filled = collections.defaultdict(list), collections.Counter()
        spots = collections.defaultdict(list)
        for r in packing.pack(frame, VOCABULARY, shard=5000).collect():
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
            got[r.doc_id].append((r.start, ids))
            filled[r.sequence_id] += r.length
            spots[r.sequence_id].append((r.offset, r.length))
        assert {k: [i for _, ids in sorted(v) for i in ids] for k, v in got.items()} == want
        assert all(n <= 4096 and n & (n - 1) == 0 for n in filled.values())
        for parts in spots.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
    assert packing.pack(odd.limit(0), VOCABULARY).count() == 0 and packing.pack(odd, VOCABULARY).select("doc_id").distinct().count() == 11


def test_neighbours_share_rare_terms():
    draw = np.random.default_rng(0)
    docs = [np.append(draw.integers(10, 60, 200), [1000 + k % 5] * 4).astype(np.uint32) for k in range(50)]
    near = packing.Index(docs).neighbours(7, np.ones(50, bool))
    assert set(near[1:9].tolist()) <= set(range(2, 50, 5)) | {7}


# --- 9: outliers ---


def test_statistics_agree_with_a_plain_count():
    draw = random.Random(2)
    for _ in range(200):
        t = "".join(draw.choice(["a", "b ", "c\n", "a b c ", "#", "é ", "\t", "\n"]) for _ in range(draw.randint(0, 60)))
        w = WORD.findall(t)
        runs = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert outliers.statistics(t.encode()) == (len(w), sum(map(len, w)), t.count("#"), len(lines) - len(set(lines)), len(covered))


def test_outliers_do_not_move_the_fit(spark, odd):
    draw = random.Random(7)
    rows = []
    for i in range(600):
        words = prose(draw, draw.randint(60, 200)).split()
        if i % 5 == 0:  # a fifth of the rows: far too many for a plain mean and covariance
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "s" if i % 3 else "t"))
    got = outliers.reject_outliers(texts(spark, rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == bool(r.doc_id % 5) and not r.base_failed for r in got)
    strange = outliers.reject_outliers(odd).collect()
    assert len(strange) == odd.count() and {r.doc_id for r in strange if r.kept} <= {7, 8}
    assert outliers.reject_outliers(odd.limit(0)).count() == 0


def plain_mcd(x, draw, starts=60):
    """Smallest log determinant of the scatter of 75 % of the rows, from random starts of six rows each."""
    h, found = int(0.75 * len(x)), []
    for _ in range(starts):
        rows = x[draw.choice(len(x), 6, replace=False)]
        last = np.inf
        while True:
            mean, scatter = rows.mean(0), np.cov(rows.T, bias=True) + 1e-6 * np.eye(5)
            size = np.linalg.slogdet(scatter)[1]
            if len(rows) == h and size > last - 1e-9:
                break
            last = size if len(rows) == h else np.inf
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
            rows = x[np.argsort(d)[:h]]
        found.append(last)
    return min(found)


def test_fit_is_a_minimum_covariance_determinant(spark):
    draw = np.random.default_rng(3)
    rows, wanted = [], {}
    for g in range(4):
        turn = np.linalg.qr(draw.normal(size=(5, 5)))[0] * np.array([3, 2.5, 2, 1.5, 1.5])
        x = draw.normal(size=(240, 5)) @ turn.T + 20
        x[: 50 * (g % 2)] = 20 + draw.normal(size=5) * 15 + draw.normal(size=(50 * (g % 2), 5)) * 0.5  # a tight cluster of strangers
        rows += [(f"g{g}", *map(float, v)) for v in x]
        wanted[f"g{g}"] = plain_mcd(x, draw) + 5 * np.log(outliers.consistency(0.75, 5))
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r.g: r["size"] for r in outliers.fit_groups(df.repartition(5), ["g"]).collect()}
    assert all(got[g] < wanted[g] + 0.1 for g in wanted)
    again = {r.g: r["size"] for r in outliers.fit_groups(df.repartition(2), ["g"]).collect()}
    assert again == pytest.approx(got, abs=1e-9)


def test_chi_square():
    assert outliers.chi_square_quantile(0.75, 5) == pytest.approx(6.6257, abs=1e-4)
    assert outliers.chi_square(18.307, 10) == pytest.approx(0.95, abs=1e-5)
    assert outliers.consistency(0.999999, 5) == pytest.approx(1, abs=1e-3)


# --- 10: vectors ---


def brute_vectors(names, x):
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.array(names)
    while True:
        new = np.array([min(label[i], label[linked[i]].min(initial=label[i])) for i in range(len(names))])
        if (new == label).all():
            return {n: (int(c), int(k), n == k) for n, c, k in zip(names, linked.sum(1), label)}
        label = new


def test_vectors_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "GROUP", 120)
    monkeypatch.setattr(vector_graph, "PER_CELL", 60)
    draw = np.random.default_rng(5)
    hubs = draw.standard_normal((6, 24))
    x = np.concatenate([draw.standard_normal((300, 24)), np.repeat(hubs, 60, 0) + 0.22 * draw.standard_normal((360, 24)), np.repeat(hubs[:1], 40, 0)])
    names = draw.permutation(len(x)).tolist()
    frame = spark.createDataFrame([(int(n), [float(c) for c in v], "x") for n, v in zip(names, x)], "vec_id long, embedding array<double>, component_id string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.near_vectors(frame).collect()}
    want = brute_vectors(names, x / np.linalg.norm(x, axis=1, keepdims=True))
    found = sum(min(got[n][0], want[n][0]) for n in names) / sum(want[n][0] for n in names)
    assert found >= 0.95 and all(got[n][0] <= want[n][0] for n in names)
    assert sum(got[n][1] == want[n][1] for n in names) >= 0.95 * len(names)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (8, [float("inf"), 0.0]), (9, [1e-300, 0.0])]
    got = vector_graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert by == {1: (2, 1, True), 2: (2, 1, False), 9: (2, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8)}}
    assert vector_graph.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
