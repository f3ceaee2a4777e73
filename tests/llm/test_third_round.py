"""Hard negatives, archives and the source audit against brute force, round trips and odd rows."""

import gzip
import os
import random
import subprocess
import sys
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismill.llm import hard_negatives, source_audit, warc


def brute_negatives(rows, anchors, positives=5, negatives=3):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, label, ints)."""
    out = set()
    for a, la, xa in rows:
        if a not in anchors:
            continue
        scores = sorted((-sum(p * q for p, q in zip(xa, xb)), b, lb) for b, lb, xb in rows if b != a)
        same = [(b, -s) for s, b, lb in scores if lb == la][:positives]
        for pos, ps in same:
            fits = [(b, -s) for s, b, lb in scores if lb != la and 50 * ps <= -100 * s <= 95 * ps][:negatives]
            out |= {(a, pos, n + 1, b, ps, ns) for n, (b, ns) in enumerate(fits)}
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_negatives_equal_brute_force_over_blocks_and_thresholds(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "PER_CELL", 60)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(4, 12))
    vectors = [(centres[k % 4] + draw.normal(size=12) * 0.4).tolist() for k in range(240)]
    # Ties: rows 0..5 repeat one vector under different labels.
    rows = [(k, k % 3, vectors[0] if k < 6 else v) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").repartition(5)
    got = {tuple(r) for r in hard_negatives.mine_negatives(frame, F.pmod("vec_id", F.lit(5)) == 0).collect()}
    ints = [(k, lab, [floor(256 * x) for x in v]) for k, lab, v in rows]
    assert got == brute_negatives(ints, {k for k, _, _ in rows if k % 5 == 0}) and len(got) > 100


def test_the_index_finds_every_pair_above_its_threshold():
    draw = np.random.default_rng(8)
    x = np.floor(draw.normal(size=(300, 40)) * 100 * np.linspace(3, 0.1, 40))
    q = np.floor(draw.normal(size=(20, 40)) * 100 * np.linspace(3, 0.1, 40))
    full = (q @ x.T).astype(np.int64)
    for share in (0.99, 0.9, 0.5, 0.0):
        least = np.quantile(full, share, axis=1).astype(np.int64)
        i, j, score = hard_negatives.reaching(x, q, least)
        want = {(a, b, full[a, b]) for a, b in zip(*np.nonzero(full >= least[:, None]))}
        assert set(zip(i, j, score)) == want and len(i) == len(want)


def test_negatives_of_odd_rows(spark):
    kinds = "vec_id long, label long, embedding array<double>, score string, cell string, id string"
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.7, 0.0]), (2, 2, [0.7, 0.0]), (3, None, [1.0, 0.0]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]),
        (7, 2, [float("inf"), 1.0]), (None, 2, [0.7, 0.0]), (8, 2, [0.6]), (9, 2, []), (10, 3, [0.5, 0.5, 0.5]), (11, 2, [-1.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], kinds)
    got = {tuple(r) for r in hard_negatives.mine_negatives(frame, F.col("vec_id") == 0).collect()}
    ints = [(0, 1, [256, 0, 0]), (1, 1, [230, 25, 0]), (2, 2, [179, 0, 0]), (8, 2, [153, 0, 0]), (9, 2, [0, 0, 0]), (10, 3, [128, 128, 128]), (11, 2, [-256, 0, 0])]
    assert got == brute_negatives(ints, {0}) and len(got) == 3
    assert hard_negatives.mine_negatives(frame.limit(0), F.col("vec_id") == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine_negatives(spark.createDataFrame([(1, 1, [1e18])], "vec_id long, label long, embedding array<double>"), F.lit(True))


PAGES = [
    (5, "http://a/x y\r\nz", "<p>one</p>"), (3, "http://b/é", "<p>one</p>"), (9, None, "<p>one</p>"), (4, "http://c", None), (1, "http://d", ""), (2, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n"),
    (None, "n", "<p>one</p>"), (None, "n", "alone"), (None, "n", "alone"), (7, "r", "twice"), (7, "r", "twice"), (8, "l", "long " * 600_000), (6, "u", "päss 🙂"),
]


def brute_records(pages):
    out = []
    for k, _, html in pages:
        body = html or ""
        first = min((p for p, _, h in pages if (h or "") == body and p is not None), default=None)
        data = body.encode()
        kind = ("response", None) if first is None or k == first else ("revisit", first)
        out.append((k, len(data), warc.sha1_base32(data), *kind))
    return sorted(out, key=repr)


def read_back(archives, folder):
    files = warc.normalise(archives, folder)
    found = warc.read_records(warc.read_index(files))
    return files, sorted((tuple(r) for r in found.select(warc.page_of("id"), "payload_bytes", "payload_digest", "type", warc.page_of("refers_to")).collect()), key=repr), found


@pytest.mark.parametrize("small", [0, 100_000])
def test_pages_survive_the_archives(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(warc, "SMALL", small)
    frame = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, path string, digest string").repartition(3)
    written = warc.write_archives(frame, f"{tmp_path}/whole")
    files, got, found = read_back(written, f"{tmp_path}/members")
    assert got == brute_records(PAGES)
    assert all(r.complete for r in files.collect()) and files.agg(F.sum("records")).first()[0] == len(PAGES)
    held = {r.payload.decode() for r in found.where("type = 'response'").collect()}
    assert held == {h or "" for _, _, h in PAGES}
    # One gzip stream before, one member per record after: each member opens by itself.
    line = warc.read_index(files).where("offset > 0").first()
    with open(line.path, "rb") as f:
        f.seek(line.offset)
        assert gzip.decompress(f.read(line.length)).startswith(b"WARC/1.1\r\n")
    # Small archives, a list of archives twice over, and nothing at all.
    many = warc.write_archives(frame, f"{tmp_path}/many", per_file=1)
    assert many.count() == len(PAGES) and read_back(many, f"{tmp_path}/many-members")[1] == brute_records(PAGES)
    none = read_back(warc.write_archives(frame.limit(0), f"{tmp_path}/none"), f"{tmp_path}/none-members")
    assert none[1] == [] and none[0].count() == 0


def test_archives_of_others(spark, tmp_path):
    """Plain, many-member, cut and damaged files; folded headers; a payload shorter than a threshold is never a revisit."""
    record = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nX-Folded: a\r\n  b\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n\r\n"
    both = record % 1 + record % 2
    bodies = {"plain": both, "members": gzip.compress(record % 1) + gzip.compress(record % 2), "whole": gzip.compress(both), "cut": gzip.compress(both * 50)[:-30], "short": gzip.compress(both[:-15]), "junk": gzip.compress(record % 1 + b"nonsense\r\n"), "empty": b""}
    for name, data in bodies.items():
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in bodies] + [(None,)], "path string")
    got = {os.path.basename(r.source): (r.records, r.complete) for r in warc.normalise(paths, f"{tmp_path}/out").collect()}
    assert {n: got[n] for n in ("plain", "members", "whole", "short", "junk", "empty")} == {"plain": (2, True), "members": (2, True), "whole": (2, True), "short": (1, False), "junk": (1, False), "empty": (0, True)}
    assert not got["cut"][1] and got["cut"][0] < 100
    twice = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    written = warc.write_archives(twice, f"{tmp_path}/least", least=3)
    kinds = {r[0]: r[3] for r in read_back(written, f"{tmp_path}/least-members")[1]}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def brute_audit(docs, least, top):
    """Rows of (text, lang, source) by plain loops and fractions."""
    import re

    docs = [tuple(x or "" for x in d) for d in docs]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), la, s) for t, la, s in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        df, counts, total = {}, {}, {}
        for words, la, s in split:
            if la == lang:
                counts.setdefault(s, {})
                for w in set(words):
                    df[w] = df.get(w, 0) + 1
                for w in words:
                    counts[s][w] = counts[s].get(w, 0) + 1
                    total[w] = total.get(w, 0) + 1
        kept = {w for w, n in df.items() if n >= least}

        def shares(c):
            n = sum(c.get(w, 0) for w in kept)
            return {w: 1 + floor(Fraction(10**9 * (c.get(w, 0) + 2), n + 2 * len(kept))) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o, "pair") for o in counts if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w, "term") for w in kept if counts[s].get(w, 0) and p[s][w] > q[w]]
            for part in (sorted(pairs), sorted(terms)[:top]):
                out |= {(lang, s, kind, item, -v, n + 1) for n, (v, _, item, kind) in enumerate(part)}
    return out


@pytest.mark.parametrize("block", [2, 512])
def test_audit_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    monkeypatch.setattr(source_audit, "SOURCES", block)
    monkeypatch.setattr(source_audit, "HELD", 2)
    monkeypatch.setattr(source_audit, "HELD_TERMS", 20 if block == 2 else 10**6)
    draw = random.Random(3)
    words = [f"w{chr(97 + k)}" for k in range(20)] + ["Äb", "äb", "ÄB", "naïve", "日本"]
    docs = [(" ".join(draw.choices(words[: 5 + k % 20], k=draw.randrange(12))), f"l{k % 2}", f"s{draw.randrange(7)}") for k in range(150)]
    docs += [("wa wb, WA-wc 1wd", "l0", f"s{k % 7}") for k in range(60)]  # one text in all sources
    docs += [(None, None, None), ("", "l0", "empty"), ("12 34", "l1", "digits"), ("lonely words", "l2", "a"), ("other words", "l2", "b"), ("x", "l3", None)]
    docs.append((" ".join(["wa"] * 30_000), "l0", "s1"))
    frame = spark.createDataFrame([(*d, "v", "n", "e") for d in docs], "text string, lang string, source string, value string, term string, entries string").repartition(4)
    got = [tuple(r) for r in source_audit.audit_sources(frame, least=3, top=4).collect()]
    assert set(got) == brute_audit(docs, 3, 4) and len(got) == len(set(got))
    assert source_audit.audit_sources(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_ids_equal_whole_texts(monkeypatch, name):
    """Every character of the lower planes between letters, contractions, runs of signs, special tokens, other vocabularies."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from prismill.llm import packing

    monkeypatch.setattr(packing, "REMEMBERED", 3000)
    path = public_tokenizers.path(name)
    known, plain = packing.WordIds(path), Tokenizer.from_file(path)
    signs = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F300, 0x1F700)]
    texts = ["", " ", "it's we'll THEY'RE 'd '' 'tis", 'a."b".. c?! d,e 12ab3', "<|endoftext|> a", "x<|y", "ΑΣ ΣΑΣ. İi", "é É́", "don''t"]
    texts += [" ".join(f"a{c}B 1{c}, {c}{c}" for c in signs[k : k + 300]) for k in range(0, len(signs), 300)]
    got = [ids.tolist() for k in range(0, len(texts), 40) for ids in known.encode(texts[k : k + 40], 2)]
    assert got == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_entries_of_equal_weight_count_apart():
    from prismill.llm.toxicity import Lexicon

    for weights in ({"alpha": 2.0, "bravo": 2.0}, {"alpha": 2.0, "bravo": 2.0000001}):
        model = Lexicon(weights)
        assert abs(model.evidence(model.automaton(), "alpha bravo") - 4.0 / np.log2(2 + 2 / model.half_length)) < 1e-4


def test_a_mix_takes_each_source_on_its_own(spark):
    from prismill.llm.mixing import apply_mix, mix

    rows = [(1, "the same text", "x"), (1, "the same text", "y")] + [(k, "some other words " * (k % 7), "x" if k % 5 else "y") for k in range(2, 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {(r.doc_id, r.source): r.copies for r in mix(frame).collect() if r.copies}
    for parts in (1, 7):
        got = apply_mix(frame.repartition(parts)).groupBy("doc_id", "source").count().collect()
        assert {(r.doc_id, r.source): r["count"] for r in got} == want


def test_passages_are_cut_from_the_row_that_has_them(spark):
    from prismill.llm.chunk_dedup import drop_passages

    draw = random.Random(21)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 9))) for _ in range(n))
    passage, own, other = prose(400), prose(200), prose(300)
    rows = [(1, passage), (2, own + " " + passage + " " + prose(100)), (2, other), (2, other), (3, None), (None, passage), (4, "")]
    got = drop_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    texts = sorted((r.doc_id or 0, r.text) for r in got)
    assert (1, passage) in texts and (0, passage) in texts and (3, "") in texts and (4, "") in texts and texts.count((2, other)) == 2
    cut = [t for k, t in texts if k == 2 and t != other]
    assert len(texts) == 7 and len(cut) == 1 and len(cut[0]) < len(own) + 1500 and cut[0].startswith(own[: len(own) - 300])


@pytest.mark.parametrize("module", ["hard_negatives", "ngram_join", "packing"])
def test_functions_of_tasks_import_what_they_call(module):
    """A Python worker starts with nothing loaded but what the function's own module imports."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(hard_negatives.__file__))))
    done = subprocess.run([sys.executable, "-c", f"from prismill.llm import {module}; {module}.pa.compute"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
